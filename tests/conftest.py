import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, os.environ.get("PYTHONPATH"))))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def server(spark, tmp_path):
    from knotwork.session import Server

    return Server(spark, f"file://{tmp_path}")


PEOPLE = """define attribute age value integer; attribute name value string;
entity person, owns age @card(0..), owns name @card(0..), plays membership:member, plays friendship:friend;
entity organisation, plays membership:group;
relation membership, relates member @card(0..), relates group @card(0..);
relation friendship, relates friend @card(0..);"""


@pytest.fixture
def database(server):
    """make(schema, *writes) -> a database with data."""

    def make(schema: str, *writes: str):
        db = server.create(f"d{len(server.databases())}")
        with db.transaction("schema") as tx:
            tx.query(schema)
            for w in writes:
                tx.query(w)
            tx.commit()
        return db

    return make


def rows(df):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in df.collect()), key=str)
