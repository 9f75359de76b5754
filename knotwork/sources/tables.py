"""An ontology over the driver's tables: keys become instances, columns attributes, foreign keys role players."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from knotwork.schema import Catalog
from knotwork.sources.store import MappedStore, Source

SCHEMA = """
define
attribute r_name value string; attribute r_regionkey value integer;
attribute n_name value string; attribute n_nationkey value integer;
attribute name value string; attribute acctbal value double; attribute c_mktsegment value string;
attribute c_custkey value integer; attribute s_suppkey value integer;
attribute p_partkey value integer; attribute p_name value string; attribute p_brand value string; attribute p_type value string; attribute p_size value integer; attribute p_retailprice value double;
attribute o_orderkey value integer; attribute o_orderstatus value string; attribute o_totalprice value double; attribute o_orderdate value datetime; attribute o_orderpriority value string;
attribute l_linenumber value integer; attribute l_quantity value double; attribute l_extendedprice value double; attribute l_discount value double; attribute l_tax value double; attribute l_returnflag value string; attribute l_linestatus value string; attribute l_shipdate value datetime;
attribute event_id value integer; attribute ts value datetime; attribute user_id value integer; attribute event_type value string; attribute event_value value double; attribute props value string;
attribute doc_id value integer; attribute doc_text value string; attribute lang value string; attribute origin value string; attribute n_chars value integer; attribute quality value integer; attribute toxic value integer;
attribute page_id value integer; attribute url value string; attribute html value string;
attribute item_id value integer; attribute item_text value string;
attribute conv_id value integer; attribute turn value integer; attribute speaker value string; attribute said value string;
attribute vec_id value integer; attribute cluster value integer;

entity region, owns r_regionkey @key, owns r_name, plays location:outer @doc("regions hold nations");
entity nation @doc("a country") @meta("level", "2"), owns n_nationkey @key, owns n_name, plays location:inner, plays residence:place;
entity party @abstract, owns name, owns acctbal, plays residence:resident;
entity customer sub party @doc("a party that buys"), owns c_custkey @key, owns c_mktsegment @doc("market segment"), plays placement:buyer;
entity supplier sub party @meta("does", "sells"), owns s_suppkey @key @meta("unit", "number"), plays line-item:vendor @meta("since", "1992");
entity part, owns p_partkey @key, owns p_name, owns p_brand, owns p_type, owns p_size, owns p_retailprice, plays line-item:item;
entity order, owns o_orderkey @key, owns o_orderstatus, owns o_totalprice, owns o_orderdate, owns o_orderpriority, plays line-item:order, plays placement:order;
entity event, owns event_id @key, owns ts, owns user_id, owns event_type, owns event_value, owns props;
entity document, owns doc_id @key, owns doc_text, owns lang, owns origin, owns n_chars, plays labelling:subject;
entity page, owns page_id @key, owns url, owns html;
entity item, owns item_id @key, owns item_text;
entity utterance, owns conv_id, owns turn, owns speaker, owns said, plays reply:prev, plays reply:next;
entity vector, owns vec_id @key, owns cluster;

relation location, relates inner @card(1), relates outer @card(1);
relation residence, relates resident @card(1), relates place @card(1);
relation placement, relates order @card(1), relates buyer @card(1) @meta("k", "v");
relation line-item, relates order @card(1), relates item @card(1), relates vendor @card(1), owns l_linenumber, owns l_quantity, owns l_extendedprice, owns l_discount, owns l_tax, owns l_returnflag, owns l_linestatus, owns l_shipdate;
relation labelling, relates subject @card(1), owns quality, owns toxic;
relation reply, relates prev @card(1), relates next @card(1);
"""

_LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


SOURCES = [
    Source("region", "region", ("r_regionkey",), _same("r_regionkey", "r_name")),
    Source("nation", "nation", ("n_nationkey",), _same("n_nationkey", "n_name")),
    Source("location", "nation", ("n_nationkey",), {}, {"location:inner": ("nation", ("n_nationkey",)), "location:outer": ("region", ("n_regionkey",))}),
    Source("customer", "customer", ("c_custkey",), {"c_custkey": "c_custkey", "name": "c_name", "acctbal": "c_acctbal", "c_mktsegment": "c_mktsegment"}),
    Source("supplier", "supplier", ("s_suppkey",), {"s_suppkey": "s_suppkey", "name": "s_name", "acctbal": "s_acctbal"}),
    Source("residence", "customer", ("c_custkey",), {}, {"residence:resident": ("customer", ("c_custkey",)), "residence:place": ("nation", ("c_nationkey",))}),
    Source("residence", "supplier", ("s_suppkey",), {}, {"residence:resident": ("supplier", ("s_suppkey",)), "residence:place": ("nation", ("s_nationkey",))}),
    Source("part", "part", ("p_partkey",), _same("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")),
    Source("order", "orders", ("o_orderkey",), _same("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")),
    Source("placement", "orders", ("o_orderkey",), {}, {"placement:order": ("order", ("o_orderkey",)), "placement:buyer": ("customer", ("o_custkey",))}),
    Source("line-item", "lineitem", _LINE, _same(*_LINE[3:]), {"line-item:order": ("order", ("l_orderkey",)), "line-item:item": ("part", ("l_partkey",)), "line-item:vendor": ("supplier", ("l_suppkey",))}),
    Source("event", "events", ("event_id",), {**_same("event_id", "ts", "user_id", "event_type", "props"), "event_value": "value"}),
    Source("document", "documents", ("doc_id",), {"doc_id": "doc_id", "doc_text": "text", "lang": "lang", "origin": "source", "n_chars": "n_chars"}),
    Source("labelling", "labels", ("doc_id",), _same("quality", "toxic"), {"labelling:subject": ("document", ("doc_id",))}),
    Source("page", "pages", ("page_id",), _same("page_id", "url", "html")),
    Source("item", "benchmark", ("item_id",), {"item_id": "item_id", "item_text": "text"}),
    Source("utterance", "conversations", ("conv_id", "turn"), {"conv_id": "conv_id", "turn": "turn", "speaker": "role", "said": "text"}),
    Source("reply", "reply", ("conv_id", "turn", "next_turn"), {}, {"reply:prev": ("utterance", ("conv_id", "turn")), "reply:next": ("utterance", ("conv_id", "next_turn"))}),
    Source("vector", "embeddings", ("vec_id",), {"vec_id": "vec_id", "cluster": "label"}),
]


class TableStore(MappedStore):
    def frame(self, table: str):
        if table == "reply" and table not in self.frames:
            said = super().frame("conversations").select("conv_id", "turn")
            after = said.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("turn").alias("next_turn"))
            self.frames[table] = said.join(after, ["conv_id", "turn"])
        return super().frame(table)


def catalog() -> Catalog:
    return Catalog.of(SCHEMA)


def store(spark: SparkSession, folder: str) -> TableStore:
    return TableStore(spark, folder, SOURCES)
