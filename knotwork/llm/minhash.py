"""MinHash near-dedup by min-max hashing.

Every permutation gives two signature values, the smallest and the largest image of the set, so
half as many hash evaluations fill the bands. Bands only propose pairs; every link is confirmed
on the full shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import common as C

_SIGNED = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"


def _sets(batch: pa.RecordBatch, size: int):
    """Per text of the batch, in order: its distinct shingles, sorted."""
    data, off = C.flat(batch.column("text"))
    for a, b in C.runs(off):
        part = C.LOWER[data[off[a] : off[b]]]
        h, _, _, first = C.words(part, off[a : b + 1] - off[a], C.NOT_SPACE)
        g, at = C.shingles(h, first, size)
        for k in range(b - a):
            yield a + k, np.unique(g[at[k] : at[k + 1]])


def _signatures(size: int, bands: int, rows: int):
    hashes = bands * rows // 2
    seeds = C.mix(np.arange(1, hashes + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    salt = C.mix(np.arange(1, bands + 1, dtype=np.uint64))

    def one(values: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            low, high = np.empty(hashes, np.uint64), np.empty(hashes, np.uint64)
            for k, seed in enumerate(seeds):  # multiplication by an odd number permutes 64 bits; the xor-shift before it breaks linear ties
                v = (values ^ (values >> np.uint64(29 + k % 7))) * seed
                v ^= v >> np.uint64(32)
                low[k], high[k] = v.min(), v.max()
            sig = np.concatenate((low, high)).reshape(2, hashes).T.reshape(bands, rows)
            out = salt.copy()
            for r in range(rows):
                out = C.mix(out * np.uint64(0x2545F4914F6CDD1D) + sig[:, r])
        return out

    def run(batches):
        for batch in C.small(batches):
            n, f1, f2, sig, some = [], [], [], [], []
            for _, s in _sets(batch, size):
                n.append(len(s))
                with np.errstate(over="ignore"):
                    f1.append(int(np.sum(C.mix(s + np.uint64(7)), dtype=np.uint64)))
                    f2.append(int(np.sum(C.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)))
                some.append(len(s) > 0)
                if len(s):
                    sig.append(one(s))
            lengths = np.where(some, bands, 0)
            flat = C.signed(np.concatenate(sig)) if sig else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(C.signed(np.array(f1, np.uint64))), pa.array(C.signed(np.array(f2, np.uint64))), lists],
                ["doc_id", "n_shingles", "f1", "f2", "bands"],
            )

    return run


def _full_sets(size: int):
    def run(batches):
        for batch in C.small(batches):
            each = [C.signed(s) for _, s in _sets(batch, size)]
            ends = np.concatenate(([0], np.cumsum([len(s) for s in each]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(each) if each else np.zeros(0, np.int64)))], ["doc_id", "shingles"])

    return run


def _compare(percent: int):
    """Links between two blocks of one bucket, across components."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        us, vs = [], []
        if left.num_rows and right.num_rows:
            rows = [right.column(c).to_numpy() for c in ("id", "comp")]
            lists = right.column("shingles").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            values = lists.flatten().to_numpy()
            for i, c, s in zip(left.column("id").to_pylist(), left.column("comp").to_pylist(), left.column("shingles")):
                mine = np.array(s.as_py(), np.int64)
                mine.sort()
                at = np.minimum(np.searchsorted(mine, values), len(mine) - 1)
                same = np.bincount(owner[mine[at] == values], minlength=len(sizes))
                hit = np.flatnonzero((same * 100 >= (len(mine) + sizes - same) * percent) & (rows[1] != c))
                us.append(np.minimum(rows[0][hit], i)), vs.append(np.maximum(rows[0][hit], i))
        u, v = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (us, vs))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, *, size: int = 2, percent: int = 80, bands: int = 24, rows: int = 4, pivots: int = 4, small: int = 32, block: int = 256) -> DataFrame:
    """Groups of documents joined by links of shingle Jaccard >= percent / 100.

    docs: doc_id (long) and text; other columns are ignored. Lower-cases A-Z,
    takes words between ASCII white space and runs of `size` words. Null and empty texts and
    texts of white space have the empty set and link with nothing. Returns doc_id, n_shingles,
    component_id (smallest doc_id reachable by links, itself included), kept, and class_id (the
    smallest doc_id with the same set). A repeated row comes back as often as it came; rows with
    one doc_id and several texts are linked by any of them. A row without doc_id links with nothing,
    has no component and is kept. Long texts are hashed as a whole. An empty table gives an empty
    result.

    A pair at Jaccard 0.8 shares none of 24 bands of 4 values with probability 4e-6 (a band of
    two minima and two maxima matches with probability of about J^4).

    Documents with one set are one class, of which only the representative is hashed into
    buckets, so exact copies cost one aggregation. In a bucket of many near copies not all pairs are
    made: first every member is compared with the one that shares most buckets (it stands in the
    middle of its copies) and links are joined to components. Then buckets of up to `small` members
    are compared in full, and in larger ones what lies outside the largest component with `pivots`
    more members. What is outside after that is compared with all members of its bucket in blocks
    of about `block`, which give links and no other pairs; so no link between components is missed.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = C.cut(src.mapInArrow(_signatures(size, bands, rows), _SIGNED))
    filled = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = C.cut(filled.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("class_id"), F.first("bands").alias("bands")))

    keys = classes.select(F.col("class_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    busy = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = C.cut(keys.join(busy, "key"))

    # whole sets of the classes that share a bucket, and of no others
    wanted = members.select("id").distinct()
    sets = C.cut(src.join(wanted, src["doc_id"] == wanted["id"], "left_semi").mapInArrow(_full_sets(size), "doc_id long, shingles array<long>"))

    left = sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("su"))
    right = sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("sv"))
    same = F.size(F.array_intersect("su", "sv"))
    enough = same * 100 >= (F.size("su") + F.size("sv") - same) * percent

    made: list[DataFrame] = []

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Links among pairs (a, na, b, nb), on the full sets."""
        near = pairs.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
        near = near.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        made.append(C.cut(near.join(left, "u").join(right, "v").where(enough).select("u", "v")))
        return made[-1]

    def split_buckets(comps: DataFrame) -> DataFrame:
        """Members of buckets that hold several components, with the size of the bucket and whether their component is the bucket's largest."""
        now = members.join(comps.select(F.col("node").alias("id"), F.col("component").alias("comp")), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        by = now.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.max_by("comp", F.struct("c", "comp")).alias("main"), (F.sum("c") - F.max("c")).alias("others")).where("comps > 1")
        made.append(C.cut(now.join(by, "key").select("key", "id", "n", "comp", "members", "others", (F.col("comp") == F.col("main")).alias("main"))))
        return made[-1]

    # first round: every member of a bucket against the one of its members that shares most buckets
    degree = members.groupBy("id").agg(F.sum("members").alias("degree"))
    pivot = members.join(degree, "id").groupBy("key").agg(F.max_by(F.struct("id", "n"), F.struct("degree", "id")).alias("p")).select("key", F.col("p.id").alias("b"), F.col("p.n").alias("nb"))
    as_a = lambda df: df.select("key", F.col("id").alias("a"), F.col("n").alias("na"))
    links = confirmed(as_a(members).join(pivot, "key").where("a <> b"))
    comps = C.components(links)

    # second round: small buckets in full; in large ones, those outside the largest component against some more members
    current = split_buckets(comps)
    rows_a = current.select("key", F.col("id").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), "members", "main")
    rows_b = current.select("key", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), "members")
    few = rows_a.where(F.col("members") <= small).drop("members", "main").join(rows_b.where(F.col("members") <= small).drop("members"), "key").where("ca < cb")
    draw = F.xxhash64("b", F.lit(1))
    drawn = rows_b.where(F.col("members") > small).groupBy("key").agg(*(F.max_by(F.struct("b", "nb", "cb"), F.pmod(draw, F.lit(p))).alias(f"p{p}") for p in (10007, 10009, 10037, 10039)[:pivots]))
    drawn = drawn.select("key", F.explode(F.array(*drawn.columns[1:])).alias("p")).select("key", F.col("p.b").alias("b"), F.col("p.nb").alias("nb"), F.col("p.cb").alias("cb"))
    many = rows_a.where((F.col("members") > small) & ~F.col("main")).drop("members", "main").join(drawn, "key").where("ca <> cb")
    links = links.unionByName(confirmed(few.unionByName(many)))
    C.remove(comps)
    comps = C.components(links)

    # third round: what large buckets still hold outside their largest component, against all their members, block by block
    current = split_buckets(comps).where(F.col("members") > small)
    with_sets = current.join(sets.withColumnRenamed("doc_id", "id"), "id")
    xs, ys = (F.ceil(F.col(c) / block).cast("int") for c in ("others", "members"))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    outside = with_sets.where(~F.col("main")).select("key", F.pmod(F.xxhash64("id"), xs).cast("int").alias("x"), each(ys).alias("y"), "id", "comp", "shingles")
    whole = with_sets.select(F.col("key").alias("key"), each(xs).alias("x"), F.pmod(F.xxhash64("id"), ys).cast("int").alias("y"), *(F.col(c).alias(c) for c in ("id", "comp", "shingles")))
    whole = whole.select(*(F.col(c).alias(c) for c in whole.columns))  # columns of their own, for the cogroup
    found = C.cut(outside.groupBy("key", "x", "y").cogroup(whole.groupBy("key", "x", "y")).applyInArrow(_compare(percent), "u long, v long").distinct())
    links = links.unionByName(found)
    C.remove(comps)
    comps = C.components(links)
    C.remove(members, sets, found, *made)
    merged = classes.select("n_shingles", "f1", "f2", "class_id")
    merged = merged.join(comps, merged["class_id"] == comps["node"], "left").drop("node")
    on = ["n_shingles", "f1", "f2"]
    out = signed.select("doc_id", *on).join(merged, on, "left")
    named = F.col("doc_id").isNotNull()
    out = out.select(
        "doc_id", "n_shingles",
        F.when(named, F.coalesce("component", "class_id", "doc_id")).alias("component_id"),
        F.when(named, F.coalesce("class_id", "doc_id")).alias("class_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    return C.hold(out, signed, classes, comps)


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row of each component of near_duplicates(), with all its columns: one of the smallest doc_id. Rows without doc_id stay."""
    found = C.cut(near_duplicates(docs, **options))
    gone = C.cut(found.where(~F.col("kept")).select("doc_id").distinct())
    again = C.cut(found.where(F.col("kept") & F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id"))
    C.remove(found)
    same = lambda a, b: a["doc_id"].cast("long") == b["doc_id"]
    away = gone.hint("merge")  # one plan at every size: what goes grows with the corpus
    out = docs.join(away, same(docs, away), "left_anti")
    if not again.isEmpty():
        once = out.join(again, same(out, again), "left_semi").dropDuplicates(["doc_id"])
        out = out.join(again, same(out, again), "left_anti").unionByName(once)
    return C.hold(out, gone, again)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 2 THEN unnest(list_transform(range(1, greatest(len(ws), 2)), lambda i: ws[i] || ' ' || ws[i + 1])) ELSE ws[1] END AS sh
  FROM w WHERE len(ws) >= 1
), n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
rep AS (SELECT min(doc_id) AS doc_id FROM (SELECT doc_id, list(sh ORDER BY sh) AS l FROM s GROUP BY 1) GROUP BY l),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT u, v FROM pairs JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * i >= 80 * (x.c + y.c - i)
), both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT doc_id AS node, doc_id AS lo FROM documents UNION SELECT b.v, r.lo FROM reach r JOIN both_ways b ON r.node = b.u),
comp AS (SELECT node, min(lo) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.c, 0) AS n_shingles, comp.component_id, comp.component_id = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN comp ON comp.node = d.doc_id
"""
