from knotwork.sources.store import EdgeStore
from knotwork.streaming.batches import read_batches, write_batches
from tests.conftest import PEOPLE, rows


def test_stream_of_given_rows(spark, database, tmp_path):
    db = database(PEOPLE, 'insert $a isa person, has age 10, has name "John";')
    for k, n in enumerate(("Ann", "Ben", "Ann")):
        spark.createDataFrame([(n,)], "n string").write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("n string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    write_batches(stream, db, "given $n: string; put $p isa person, has name == $n;", f"{tmp_path}/c1").awaitTermination()
    with db.transaction() as tx:
        assert rows(tx.query("match $p isa person, has name $n; select $n;")) == [("Ann",), ("Ben",), ("John",)]
        got = []
        catalog, store = tx.catalog, EdgeStore(spark, tx.catalog, tx.store.tables)
        read_batches(stream, catalog, store, "given $n: string; match $p isa person, has name == $n; select $n;", lambda df, _: got.extend(r[0] for r in df.collect()), f"{tmp_path}/c2").awaitTermination()
    assert sorted(got) == ["Ann", "Ann", "Ben"]
