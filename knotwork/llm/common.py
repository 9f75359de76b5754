"""What the operators share: scratch tables, text kernels on Arrow buffers, connected components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.sources.scratch import remove, scratch

BLOCK = 1 << 18  # bytes of text that a kernel looks at together


# ---------------------------------------------------------------- scratch tables


def cut(df: DataFrame, *partition_by: str) -> DataFrame:
    """df, written to a table in the shared folder and read back: its lineage ends there. Tables that df holds are deleted."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/t-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    remove(*getattr(df, "_held", ()))
    return out


def hold(df: DataFrame, *tables: DataFrame | None) -> DataFrame:
    """df, with the tables of cut() that only it reads: they can go when df has been written."""
    df._held = tables
    return df


def tidy(spark: SparkSession) -> None:
    """Shuffle files that nothing reads any more are deleted now, not at the next collection of garbage."""
    gc.collect()
    spark._jvm.System.gc()


def free(name: str, taken: list[str]) -> str:
    """A column name that is not taken."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def map_rows(df: DataFrame, f, dropped: str | None = None) -> DataFrame:
    """df.mapInArrow(f) with the columns of df, whatever their names hold, but for a last one that f drops."""
    names = [c if "." not in c else free(c.replace(".", "_"), df.columns) for c in df.columns]
    plain = df.toDF(*names)
    fields = [x for x in plain.schema.fields if x.name != dropped]
    return plain.mapInArrow(f, T.StructType(fields)).toDF(*(c for c in df.columns if c != dropped))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of `rows` rows where the session leaves Spark's default of 10,000: JVM and worker hold a batch of whole texts several times."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, rows)


def id_crc(column: str = "doc_id"):
    """crc32 of the id as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


# ---------------------------------------------------------------- text kernels


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one after the other, and where each text starts (with the end). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def small(batches, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The rows of batches in smaller ones, so that what is made of them stays small too."""
    for batch in batches:
        for a in range(0, max(batch.num_rows, 1), rows):
            yield batch.slice(a, rows)


def runs(off: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together; a longer text comes alone."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = b


def byte_table(test) -> np.ndarray:
    return np.array([bool(test(b)) for b in range(256)])


#: Lower-cases A-Z, leaves every other byte.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
NOT_SPACE = byte_table(lambda b: not (b == 32 or 9 <= b <= 13))
ALNUM = byte_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)  # after lower-casing

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        m = max(n, BLOCK + 4096)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(m, b)))) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads each bit over all (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _block_words(data: np.ndarray, cuts: np.ndarray, table: np.ndarray):
    """Words in one block: hashes, starts, ends. cuts: where texts start inside."""
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[cuts] = True
    edge[0] = edge[-1] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    p, q = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * q[starts]
    return mix(h), starts, ends


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every maximal run of bytes in `table` inside a text: 64-bit hash, start, end; and the index of each text's first word (with the end).

    Equal words have equal hashes wherever they stand. Work arrays stay at BLOCK bytes times a
    small constant, however long one text is, as blocks end at a byte between words.
    """
    hs, ss, es, a, n = [], [], [], 0, len(data)
    while a < n:
        b = min(n, a + BLOCK)
        while b < n:  # up to a byte that is no part of a word
            gap = np.flatnonzero(~table[data[b - 1 : b + 4095]])
            if len(gap):
                b = b + int(gap[0])
                break
            b = min(n, b + 4096)
        inner = off[np.searchsorted(off, a) : np.searchsorted(off, b)] - a
        h, s, e = _block_words(data[a:b], inner, table)
        hs.append(h), ss.append(s + a), es.append(e + a)
        a = b
    h, s, e = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((hs, np.uint64), (ss, np.int64), (es, np.int64)))
    return h, s, e, np.searchsorted(s, off)


def shingles(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the runs of n words in each text; a text with fewer words but at least one has one for all of them.

    Returns the hashes and the index of each text's first one (with the end).
    """
    lengths = np.diff(first)
    counts = np.where(lengths >= n, lengths - n + 1, np.minimum(lengths, 1))
    out_first = np.concatenate(([0], np.cumsum(counts)))
    total = int(out_first[-1])
    text = np.repeat(np.arange(len(lengths)), counts)
    at = np.arange(total) - out_first[text] + first[text]
    size = np.minimum(lengths, n)[text]
    with np.errstate(over="ignore"):
        g = np.zeros(total, np.uint64)
        for k in range(n):
            live = size > k
            g[live] = mix(g[live] * np.uint64(0x2545F4914F6CDD1D) + h[at[live] + k] + np.uint64(k + 1))
    return g, out_first


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


# ---------------------------------------------------------------- connected components


def smallest(p: np.ndarray, q: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Smallest name in the component of each node, under links between the nodes p and q (indices into names).

    Roots are hooked to smaller ones, then every path is halved until it is one step long, so a chain takes a logarithm of its length.
    """
    order = np.argsort(names, kind="stable")
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    p, q, label = place[p], place[q], np.arange(len(names))
    while True:
        a, b = label[p], label[q]
        apart = a != b
        if not apart.any():
            return names[order][label[place]]
        p, q, a, b = p[apart], q[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != (up := label[label])).any():
            label = up


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """cut(), and the number of rows, counted while they are written."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, int(seen.get["n"])


#: Links that one task joins at once in components().
LINKS = 1 << 20


def components(links: DataFrame, *, block: int = LINKS) -> DataFrame:
    """(node, component) of every node in links (u, v): component is the smallest node that can be reached.

    Each task joins the links that it reads to stars, about `block` at once. While there is more
    than one block, a round hooks every node to its smallest neighbour (every other
    round: to the one with the smallest hash), shortens the paths by pointer doubling until each
    tree is a star, and puts the trees in the places of their nodes. A tree's path of n steps takes
    a logarithm of n doublings, and by a random order half of the nodes or more are expected to be
    hooked, whatever the graph: so the number of rounds is a logarithm too. The last block is joined
    by one task. Rounds are cut by tables in the shared folder, which are deleted when they are
    read; the driver sees counts only.
    """
    kind = dict(links.dtypes)["u"]
    edges, n = counted(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct())
    found, turn = None, 0

    def stars(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= block:
                yield from joined(held)
                held, size = [], 0
        yield from joined(held)

    def joined(held):
        if not sum(b.num_rows for b in held):
            return
        t = pa.Table.from_batches(held)
        names, at = np.unique(np.concatenate([t.column(c).to_numpy() for c in ("u", "v")]), return_inverse=True)
        root = smallest(at[: t.num_rows], at[t.num_rows :], names)
        moved = names != root
        yield pa.RecordBatch.from_arrays([pa.array(root[moved]), pa.array(names[moved])], ["u", "v"])

    def renamed(old: DataFrame | None, new: DataFrame) -> DataFrame:
        """Components of components: new (u, p) tells where those of old went."""
        if old is None:
            return new.select(F.col("u").alias("node"), F.col("p").alias("component"))
        return old.join(new, F.col("component") == F.col("u"), "left").select("node", F.coalesce("p", "component").alias("component"))

    while n > block:
        local, n = counted(edges.mapInArrow(stars, f"u {kind}, v {kind}").distinct())
        remove(edges)
        edges = local
        rank = (lambda c: F.col(c)) if turn % 2 == 0 else (lambda c: F.xxhash64(c, F.lit(turn)))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min_by("v", F.struct(rank("v"), "v")).alias("m"))
        parent = cut(low.select("u", F.when(F.struct(rank("m"), "m") < F.struct(rank("u"), "u"), F.col("m")).otherwise(F.col("u")).alias("p")))
        steps = 1
        while steps:  # pointer doubling
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            seen = Observation()
            higher = cut(parent.join(up, "p").select("u", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")).observe(seen, F.sum(F.col("moved").cast("long")).alias("n")).select("u", "p"))
            steps = int(seen.get["n"] or 0)
            remove(parent)
            parent = higher
        new = cut(renamed(found, parent))
        pu, pv = parent.select("u", F.col("p").alias("pu")), parent.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        nxt, n = counted(edges.join(pu, "u").join(pv, "v").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).where("u < v").distinct())
        remove(edges, parent, found)
        edges, found, turn = nxt, new, turn + 1
    if n:
        last = edges.coalesce(1).mapInArrow(stars, f"u {kind}, v {kind}")
        last = last.select(F.col("v").alias("u"), F.col("u").alias("p"))
        if found is None:
            last = last.unionByName(last.select(F.col("p").alias("u"), "p").distinct())
        new = cut(renamed(found, last))
        remove(found)
        found = new
    remove(edges)
    if found is None:
        return links.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    if turn > 1:  # a tree's root need not be its smallest node where hashes chose it
        least = found.groupBy("component").agg(F.min("node").alias("least"))
        new = cut(found.join(least, "component").select("node", F.col("least").alias("component")))
        remove(found)
        found = new
    return found
