"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly into buckets that fit in memory, by a seeded hash. Pass two
shuffles each bucket by Fisher-Yates and writes it. The buckets, one after the other, are one
random order of all rows; shards are equal ranges of it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.llm import common as C

#: Copies of a row that one task makes at once; numbers of buckets that are summed together.
COPIES, RUN = 4096, 4096


def _fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A random order of n rows: position k from the end is swapped with one at or before it."""
    order = np.arange(n)
    at = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64)
    for k in range(n - 1, 0, -1):
        j = at[k]
        order[k], order[j] = order[j], order[k]
    return order


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _holds_map(kind.elementType)


def _offsets(sizes: DataFrame, bucket: str, rows: str, before: str) -> DataFrame:
    """(bucket, rows in the buckets before it), summed in runs of buckets, then over the runs."""
    run = sizes.withColumn("__run", F.expr(f"`{bucket}` div {RUN}"))
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = run.groupBy("__run").agg(F.sum(rows).alias("__n")).select("__run", F.coalesce(F.sum("__n").over(up_to(Window.orderBy("__run"))), F.lit(0)).alias("__first"))
    inside = run.select(bucket, "__run", F.coalesce(F.sum(rows).over(up_to(Window.partitionBy("__run").orderBy(bucket))), F.lit(0)).alias("__in"))
    return inside.join(sums, "__run").select(bucket, (F.col("__first") + F.col("__in")).alias(before))


def shuffle_to_shards(docs: DataFrame, *, shards: int = 40, seed: int = 11, bucket_bytes: int = 24 << 20) -> DataFrame:
    """Writes docs as Parquet in `shards` folders, shuffled, and returns what was written.

    The columns are those of docs and bucket (int), shard (int) and slot (long, gapless from 0 in
    each shard); columns of docs with these names are replaced, others may have any name and type.
    Shards differ by at most one row (law `rows`). Null texts and repeated rows are rows like
    others. The result depends on the rows, seed, shards and bucket_bytes, not on the order or
    partitioning of docs: the bucket comes from a hash of every column. An empty table gives an
    empty result.

    bucket_bytes bounds the text of a bucket, and so the memory of a task; a row is never split.
    Equal rows that take more than a bucket together are counted, then made again and dealt over
    the buckets by their number, so they are no hot key. Bucket sizes are summed in a table: neither
    the driver nor a broadcast holds what grows with the corpus.
    """
    names = [c for c in docs.columns if c not in ("bucket", "shard", "slot")]
    order, before, copies = (C.free(c, names) for c in ("__order", "__before", "__copies"))
    docs = docs.select(*(F.col(f"`{c}`") for c in names))
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    plain = lambda c: F.to_json(F.struct(F.col(f"`{c}`"))) if _holds_map(kinds[c]) else F.col(f"`{c}`")
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 16 if "text" in names else F.lit(64)
    hashed = docs.withColumn(order, F.xxhash64(F.lit(seed), *map(plain, names)))
    groups = C.cut(hashed.groupBy(order).agg(F.count(F.lit(1)).alias("n"), F.sum(size.cast("long")).alias("size")))
    rows, total = groups.agg(F.sum("n"), F.sum("size")).first()
    rows, buckets = rows or 0, max(1, math.ceil((total or 0) / bucket_bytes))
    heavy = groups.where((F.col("n") > 1) & (F.col("size") > bucket_bytes)).select(order)  # fewer than there are buckets
    deal = lambda c: F.pmod(F.shiftrightunsigned(c, 20), F.lit(buckets)).cast("int")
    if heavy.isEmpty():
        sizes = groups.select(deal(F.col(order)).alias("bucket"), "n")
    else:
        equal = hashed.join(heavy, order, "left_semi").groupBy(order, *(plain(c).alias(f"__{k}") for k, c in enumerate(names))).agg(*(F.first(f"`{c}`").alias(c) for c in names), F.count(F.lit(1)).alias(copies))
        runs = equal.withColumn("__run", F.explode(F.expr(f"sequence(0L, (`{copies}` - 1) div {COPIES})"))).repartition(order, "__run")
        again = runs.withColumn("__copy", F.explode(F.expr(f"sequence(__run * {COPIES}, least((__run + 1) * {COPIES}, `{copies}`) - 1)"))).withColumn(order, F.xxhash64(order, "__copy"))
        spread = C.cut(again.select(*(F.col(f"`{c}`") for c in names), order))
        hashed = hashed.join(heavy, order, "left_anti").unionByName(spread)
        sizes = groups.join(heavy, order, "left_anti").select(deal(F.col(order)).alias("bucket"), "n").unionByName(spread.select(deal(F.col(order)).alias("bucket"), F.lit(1).cast("long").alias("n")))
    hashed = hashed.withColumn("bucket", deal(F.col(order)))
    table = _offsets(sizes.groupBy("bucket").agg(F.sum("n").alias("n")), "bucket", "n", before)

    def shuffled(group: pa.Table, offset: pa.Table) -> pa.Table:
        group = group.sort_by([(order, "ascending")])
        if not group.num_rows:
            return group
        bucket, first = (offset.column(c)[0].as_py() for c in ("bucket", before))
        at = _fisher_yates(group.num_rows, np.random.default_rng([seed, bucket]))
        return group.take(pa.array(at)).set_column(group.column_names.index(order), order, pa.array(first + np.arange(group.num_rows)))

    placed = hashed.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInArrow(shuffled, hashed.schema)
    rank = F.col(order)
    shard = F.floor(rank * shards / F.lit(max(rows, 1))) if rows * shards < 1 << 50 else F.expr(f"CAST(CAST(`{order}` AS DECIMAL(38,0)) * {shards} DIV {rows} AS LONG)")
    placed = placed.withColumn("shard", shard.cast("int"))
    start = F.ceil(F.col("shard").cast("decimal(20,0)") * F.lit(rows) / F.lit(shards)).cast("long")
    placed = placed.withColumn("slot", rank - start).select(*(F.col(f"`{c}`") for c in names), "bucket", "slot", "shard")
    out = C.cut(placed, "shard")
    C.remove(groups)
    return out


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = shuffle_to_shards(C.read(spark, sf_dir, "documents").select("doc_id", "text"))
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return written.select(
        "doc_id",
        (F.length(raw) + 16).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
