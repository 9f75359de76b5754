"""Embedding near-dedup with an inverted multi-index.

Unit vectors are cut into halves, each with its own codebook; the pairs of codewords are a grid of
cells. Each vector visits the cells nearest to it in the order of the multi-sequence algorithm, as
many as vectors at exactly the cosine in question need to be met with the target rate, and is
compared with what is stored there in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import common as C


def _normal(v: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so that no square leaves the range of doubles."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _by_width(column: pa.Array):
    """Vectors of one length at a time: their rows, and the matrix as it was given."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    begin = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    for width in np.unique(lengths):
        rows = np.flatnonzero(lengths == width)
        yield rows, values[begin[rows][:, None] + np.arange(width)[None]]


def _packed(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """Unit vectors from their bytes, in double precision."""
    raw = b"".join(column.to_pylist())
    return _normal(np.frombuffer(raw, kind).astype(np.float64).reshape(len(column), -1))


#: Vectors whose distances to a codebook are held at once.
_ROWS = 1024


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([_distances(x[a : a + _ROWS], centres).argmin(axis=1) for a in range(0, len(x), _ROWS)])
        for j in range(k):
            if (m := near == j).any():
                centres[j] = x[m].mean(axis=0)
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None]


def multi_sequence(d1: np.ndarray, d2: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of d1 and d2 the `most` pairs (i, j) with the smallest d1[i] + d2[j], in that order.

    The traversal of two ascending sequences reaches the pair of their a-th and b-th element only
    after the (a + 1)(b + 1) - 1 pairs before it in both, so the first `most` are among the pairs
    with (a + 1)(b + 1) <= most; those are few, and are ordered for all rows at once.
    """
    o1, o2 = np.argsort(d1, axis=1, kind="stable"), np.argsort(d2, axis=1, kind="stable")
    s1, s2 = np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1)
    a, b = (np.array(x, np.int64) for x in zip(*((a, b) for a in range(min(d1.shape[1], most)) for b in range(min(d2.shape[1], most // (a + 1))))))
    first = np.argsort(s1[:, a] + s2[:, b], axis=1, kind="stable")[:, :most]
    return np.take_along_axis(o1, a[first], 1), np.take_along_axis(o2, b[first], 1)


class Index:
    """Codebooks of both halves, and the number of cells to visit; the cells of one first codeword are cut into runs of `run` second ones."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray], visits: int, run: int):
        self.books, self.visits, self.run = books, visits, run
        self.runs = -(-len(books[1]) // run)

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        return [_distances(part, b) for part, b in zip(_halves(x), self.books)]


def fit(sample: np.ndarray, rows: int, cosine: float, recall: float, per_cell: int, block: int, seed: int) -> Index:
    """An index for `rows` vectors like those of the sample.

    The number of visits is taken from vectors turned away from sample vectors by exactly the cosine in
    question, in random directions: `recall` of them lie in the cells that are visited. Links have
    that cosine or more, and each is met from either end, so the recall of links is higher. A
    codeword is the mean of eight sample vectors or more, so a larger table needs a larger sample,
    or has more vectors in a cell.
    """
    rng = np.random.default_rng(seed)
    k = max(1, min(math.isqrt(max(1, rows // per_cell)), len(sample) // 8))
    books = tuple(_kmeans(part, k, rng) for part in _halves(sample))
    books = books[0], books[1][np.argsort(books[1] @ np.linalg.svd(books[1] - books[1].mean(axis=0), full_matrices=False)[2][0], kind="stable")]  # neighbours stand together
    some = sample[rng.choice(len(sample), min(len(sample), 1500), replace=False)]
    noise = rng.standard_normal(some.shape)
    noise -= (noise * some).sum(axis=1, keepdims=True) * some
    norm = np.sqrt((noise * noise).sum(axis=1, keepdims=True))
    moved = cosine * some + math.sqrt(1 - cosine * cosine) * noise / np.where(norm > 0, norm, 1)
    own = [_distances(part, b) for part, b in zip(_halves(some), books)]
    other = [_distances(part, b).argmin(axis=1) for part, b in zip(_halves(moved), books)]
    rank = []
    for n in range(len(some)):
        d1, d2 = own[0][n], np.sort(own[1][n])
        rank.append(int(np.searchsorted(d2, d1[other[0][n]] + own[1][n][other[1][n]] - d1, "left").sum()))
    visits = int(np.sort(rank)[min(len(rank) - 1, math.ceil(recall * len(rank)))]) + 1
    return Index(books, visits, max(1, block // per_cell))


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = x.shape[1] // 2 or 1
    return x[:, :half], x[:, half:] if x.shape[1] > 1 else np.zeros((len(x), 1))


def _compare(cosine: float, kind: str):
    """Links between visitors of a run of cells and its members: how many vectors each is linked with, and one node of its component here.

    A link is counted once at either end: at the visitor always, at the member only if the member
    does not visit the visitor's cell in its turn. So no pairs leave the block.
    """

    def lists(column: pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        return np.repeat(np.arange(len(size)), size), column.flatten().to_numpy()

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        empty = np.zeros(0, np.int64)
        ids, counts, stars = empty, empty, empty
        if a.num_rows and b.num_rows:
            x, y = _packed(a.column("vec"), kind), _packed(b.column("vec"), kind)
            i, j, ci, cj = (t.column(c).to_numpy() for t, c in ((a, "id"), (b, "id"), (a, "copies"), (b, "copies")))
            home, place = a.column("home").to_numpy(), b.column("home").to_numpy()
            guest, cell = lists(a.column("here"))
            theirs = np.unique(np.stack(lists(b.column("cells"))[::-1]), axis=1)  # (cell, member), ordered
            nx, ny, ps, qs = np.zeros(len(i), np.int64), np.zeros(len(j), np.int64), [empty], [empty]
            members = np.argsort(place, kind="stable")
            order = np.argsort(cell, kind="stable")
            cells, start = np.unique(cell[order], return_index=True)
            for c, g in zip(cells, np.split(guest[order], start[1:])):
                lo, hi = np.searchsorted(place[members], (c, c + 1))
                m = members[lo:hi]
                for s in range(0, len(g) if len(m) else 0, 512):
                    p, q = np.nonzero((x[g[s : s + 512]] @ y[m].T >= cosine) & (i[g[s : s + 512], None] != j[m][None]))
                    p, q = g[s + p], m[q]
                    np.add.at(nx, p, cj[q])
                    pair, have = home[p] * len(j) + q, theirs[0] * len(j) + theirs[1]
                    at = np.minimum(np.searchsorted(have, pair), len(have) - 1)
                    once = have[at] != pair
                    np.add.at(ny, q[once], ci[p[once]])
                    ps.append(p), qs.append(q + len(i))
            p, q = np.concatenate(ps), np.concatenate(qs)
            names = np.concatenate((i, j))
            star = C.smallest(p, q, names)
            n = np.concatenate((nx, ny))
            linked = np.zeros(len(names), bool)
            linked[p] = linked[q] = True
            ids, counts, stars = names[linked], n[linked], star[linked]
        return pa.table({"u": pa.array(ids, pa.int64()), "n": pa.array(counts, pa.int64()), "v": pa.array(stars, pa.int64())})

    return run


def near_duplicates(vectors: DataFrame, *, cosine: float = 0.9, recall: float = 0.95, sample: int = 20_000, per_cell: int = 64, block: int = 2048, seed: int = 5) -> DataFrame:
    """Links of vectors with a cosine of at least `cosine`, and what they join.

    vectors: vec_id (long) and embedding (list of numbers); other columns are ignored. Vectors of
    different lengths have no cosine: each length has an index of its own. Vectors that are null,
    empty, zero, or hold a null or a non-finite component link with nothing. Returns one row for
    each row: vec_id, n_links, component_id (smallest vec_id reachable, itself included) and kept.
    A repeated row is the same vector: it counts once and comes back as often as it came. Rows with
    one vec_id and several vectors are vectors of their own with one name. A row without vec_id
    links with nothing, and its component is null. An empty table gives an empty result.

    sample bounds the vectors that the codebooks are fitted on (those with the smallest hashes);
    every vector is indexed. Equal vectors are one class and are indexed once; their links are
    counted from the class's size. A vector is sent once to each run of cells that it visits. Runs
    are compared in blocks of about `block` members and eight times as many visitors (a member is
    sent once to each block of visitors), so a hot cell is split over many tasks, and a block gives
    counts and one link a vector, not its pairs.
    """
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))
    usable = F.expr("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists(v, x -> x <> 0)")
    sound = src.where(usable)
    classes = C.cut(sound.groupBy("v").agg(F.min("vec_id").alias("least"), F.count_distinct("vec_id").alias("copies")).withColumn("id", F.monotonically_increasing_id()))
    widths = {r["w"]: r["count"] for r in classes.groupBy(F.size("v").alias("w")).count().collect()}  # lengths and numbers
    drawn = classes.orderBy(F.xxhash64("least", F.lit(seed)), "least").limit(sample).select("v").toArrow().column("v")
    indexes: dict[int, Index] = {}
    if len(drawn):
        drawn = drawn.combine_chunks()
        for _, x in _by_width(drawn.chunk(0) if isinstance(drawn, pa.ChunkedArray) else drawn):
            indexes[x.shape[1]] = fit(_normal(x.astype(np.float64)), widths[x.shape[1]], cosine, recall, per_cell, block, seed)

    def cells(batches):
        for batch in batches:
            for rows, raw in _by_width(batch.column("v")) if batch.num_rows else ():
                index = indexes.get(raw.shape[1]) or Index((np.zeros((1, 1)), np.zeros((1, 1))), 1, 1)  # a length that the sample lacks has one cell
                x = _normal(raw.astype(np.float64))
                wide, i, j = len(index.books[1]), np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1), np.int64)
                if raw.shape[1] in indexes:
                    found = [multi_sequence(*index.distances(x[a : a + _ROWS]), index.visits) for a in range(0, len(x), _ROWS)]
                    i, j = (np.concatenate(z) for z in zip(*found))
                cell = np.sort(i * wide + j, axis=1)
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * cell.shape[1])
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(take), batch.column("copies").take(take), pa.array([r.tobytes() for r in np.ascontiguousarray(raw.astype(kind))], pa.binary()),
                        pa.array(np.full(len(x), raw.shape[1], np.int32)), pa.array(np.full(len(x), wide, np.int32)), pa.array(np.full(len(x), index.run, np.int32)),
                        pa.array(i[:, 0] * wide + j[:, 0]), pa.ListArray.from_arrays(ends, pa.array(cell.reshape(-1))),
                    ],
                    ["id", "copies", "vec", "width", "wide", "run", "home", "cells"],
                )

    indexed = C.cut(classes.select("id", "copies", "v").mapInArrow(cells, "id long, copies long, vec binary, width int, wide int, run int, home long, cells array<long>"))
    spot = lambda c: f"(({c} div wide) * wide + (({c} % wide) div run) * run)"  # noqa: E731  the first cell of a run names it
    stored = indexed.groupBy("width", F.expr(spot("home")).alias("spot")).agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("sb"))
    sent = indexed.withColumn("spot", F.explode(F.expr(f"array_distinct(transform(cells, c -> {spot('c')}))")))
    guests = sent.groupBy("width", "spot").agg(F.ceil(F.count(F.lit(1)) / (8 * block)).cast("long").alias("vb"))
    grid = stored.join(guests, ["width", "spot"])
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = sent.join(grid, ["width", "spot"]).select("width", "spot", F.pmod(F.xxhash64("id", F.lit(1)), "vb").alias("vb"), each("sb").alias("sb"), "id", "copies", "vec", "home", F.expr(f"filter(cells, c -> {spot('c')} = spot)").alias("here"))
    right = indexed.withColumn("spot", F.expr(spot("home"))).join(grid, ["width", "spot"]).select("width", "spot", each("vb").alias("vb"), F.pmod(F.xxhash64("id", F.lit(2)), "sb").alias("sb"), "id", "copies", "vec", "home", "cells")
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # columns of their own, for the cogroup
    key = ["width", "spot", "vb", "sb"]
    found = C.cut(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_compare(cosine, kind), "u long, n long, v long"))
    others = found.groupBy("u").agg(F.sum("n").alias("linked"))
    comps = C.components(found.select("u", "v"))
    ids = classes.select("id", "least")
    named = comps.join(ids, comps["node"] == ids["id"]).groupBy("component").agg(F.min("least").alias("component_id"))
    facts = classes.join(others, classes["id"] == others["u"], "left").join(comps, classes["id"] == comps["node"], "left").join(named, "component", "left")
    facts = C.cut(facts.select(F.col("v").alias("same"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")))
    C.remove(classes, indexed, found, comps)
    out = src.join(facts, (src["v"] == facts["same"]) & F.col("vec_id").isNotNull(), "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return C.hold(out.withColumn("kept", F.col("vec_id") == F.col("component_id")), facts)


def op5_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.read(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9
), n AS (SELECT u, count(*) AS c FROM links GROUP BY 1),
reach AS (SELECT vec_id AS node, vec_id AS lo FROM embeddings UNION SELECT l.v, r.lo FROM reach r JOIN links l ON r.node = l.u),
comp AS (SELECT node, min(lo) AS component_id FROM reach GROUP BY 1)
SELECT x.vec_id, coalesce(n.c, 0) AS n_links, comp.component_id, x.vec_id = comp.component_id AS kept
FROM embeddings x LEFT JOIN n ON n.u = x.vec_id JOIN comp ON comp.node = x.vec_id
"""
