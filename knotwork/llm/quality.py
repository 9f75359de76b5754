"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The pairwise part of the score is the sum over factors of ((sum of v x)^2 - sum of (v x)^2) / 2,
so scoring is linear in the features of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import common as C

WORDS = 1 << 14
_UPPER, _LOWER_, _DIGIT, _HIGH, _SPACE, _NEWLINE, _STOP, _COMMA = range(8)
_KIND = np.full(256, 8, np.uint8)
for _kind, _bytes in ((_UPPER, range(65, 91)), (_LOWER_, range(97, 123)), (_DIGIT, range(48, 58)), (_HIGH, range(128, 256)), (_SPACE, (32, 9, 13)), (_NEWLINE, (10,)), (_STOP, b".!?"), (_COMMA, b",;:'\"()-")):
    _KIND[list(_bytes)] = _kind
KINDS = 9
STATS = KINDS + 9
SIZE = WORDS + STATS


def features(batch: pa.RecordBatch):
    """Runs of texts: index of the first, number, and the non-zero features as (text, feature, value), ordered by text."""
    data, off = C.flat(batch.column("text"))
    stated = batch.column("n_chars").to_numpy(zero_copy_only=False).astype(np.float64) if "n_chars" in batch.schema.names else np.full(batch.num_rows, np.nan)
    for a, b in C.runs(off):
        raw, at = data[off[a] : off[b]], off[a : b + 1] - off[a]
        many, size = b - a, np.diff(at)
        part = C.LOWER[raw]
        h, s, e, first = C.words(part, at, C.NOT_SPACE)
        text = np.repeat(np.arange(many), np.diff(first))
        n = np.maximum(np.diff(first), 1)

        u, c = np.unique((text.astype(np.uint64) << np.uint64(14)) | (h >> np.uint64(50)), return_counts=True)
        doc, word = (u >> np.uint64(14)).astype(np.int64), (u & np.uint64(WORDS - 1)).astype(np.int64)
        value = np.sqrt(c / n[doc])

        stats = np.zeros((many, STATS))
        owner = np.repeat(np.arange(many), size)
        stats[:, :KINDS] = np.bincount(owner * KINDS + _KIND[raw], minlength=many * KINDS).reshape(many, KINDS) / np.maximum(size, 1)[:, None]
        distinct = np.bincount(doc, minlength=many)
        lengths = np.bincount(text, weights=(e - s).astype(np.float64), minlength=many) / n
        g, where = C.shingles(h, first, 3)
        owner3 = np.repeat(np.arange(many), np.diff(where))
        pair = np.unique(C.mix(g) ^ C.mix(owner3.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
        fresh = np.bincount(owner3[pair], minlength=many) / np.maximum(np.diff(where), 1)
        twice = np.bincount(text[1:], weights=(h[1:] == h[:-1]) & (text[1:] == text[:-1]), minlength=many) / n if len(h) else np.zeros(many)
        lines = stats[:, _NEWLINE] * size + 1
        known = stated[a:b]
        stats[:, KINDS:] = np.stack([
            distinct / n, lengths / 10, 1 - fresh, twice, np.log1p(n) / 10, np.log1p(lines) / 5, np.log1p(n / lines) / 5,
            np.where(np.isnan(known), 0, np.log1p(np.maximum(np.nan_to_num(known), 0)) / 10), np.isnan(known),
        ], axis=1)
        sd, sf = np.nonzero(stats)
        all_doc = np.concatenate((doc, sd))
        order = np.argsort(all_doc, kind="stable")
        yield a, many, all_doc[order], np.concatenate((word, sf + WORDS))[order], np.concatenate((value, stats[sd, sf]))[order]


class Machine:
    """w0 + w x + pairwise interactions of rank `rank`, on standardised statistics."""

    def __init__(self, rank: int, seed: int):
        rng = np.random.default_rng(seed)
        self.w0, self.w, self.v = 0.0, np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, rank))
        self.mean, self.scale = np.zeros(SIZE), np.ones(SIZE)

    def shift(self, idx, x):
        return (x - self.mean[idx]) / self.scale[idx]

    def score(self, many: int, doc, idx, x) -> np.ndarray:
        """Features in doc order; every statistic of a text must be given (zeros may be left out, as their shift is added here)."""
        if not len(doc):
            doc, idx, x = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        d, i, v = _with_zero_statistics(many, doc, idx, x)
        v = self.shift(i, v)
        linear = np.bincount(d, weights=self.w[i] * v, minlength=many)
        pairs = np.zeros(many)
        for f in range(self.v.shape[1]):
            t = self.v[i, f] * v
            pairs += np.bincount(d, weights=t, minlength=many) ** 2 - np.bincount(d, weights=t * t, minlength=many)
        return self.w0 + linear + pairs / 2

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int, rate: float = 0.05, l2: float = 1e-4, seed: int = 1):
        dense = np.zeros((len(rows), STATS))
        for k, (i, x) in enumerate(rows):
            m = i >= WORDS
            dense[k, i[m] - WORDS] = x[m]
        self.mean[WORDS:], self.scale[WORDS:] = dense.mean(axis=0), np.maximum(dense.std(axis=0), 0.02)
        ready = [(np.concatenate((i[i < WORDS], np.arange(WORDS, SIZE))), np.concatenate((x[i < WORDS], (d - self.mean[WORDS:]) / self.scale[WORDS:]))) for (i, x), d in zip(rows, dense)]
        p = np.clip(y.mean(), 0.01, 0.99)
        self.w0 = float(np.log(p / (1 - p)))
        gw, gv, g0 = np.full(SIZE, 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in rng.permutation(len(ready)):
                i, x = ready[k]
                v = self.v[i]
                vx = v * x[:, None]
                s = vx.sum(axis=0)
                z = self.w0 + self.w[i] @ x + ((s * s).sum() - (vx * vx).sum()) / 2
                g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[k]
                dw = g * x + l2 * self.w[i]
                dv = g * (x[:, None] * s[None] - v * (x * x)[:, None]) + l2 * v
                gw[i] += dw * dw
                gv[i] += dv * dv
                g0 += g * g
                self.w[i] -= rate * dw / np.sqrt(gw[i])
                self.v[i] -= rate * dv / np.sqrt(gv[i])
                self.w0 -= rate * g / np.sqrt(g0)


def _with_zero_statistics(many: int, doc, idx, x):
    have = np.zeros((many, STATS), bool)
    m = idx >= WORDS
    have[doc[m], idx[m] - WORDS] = True
    zd, zf = np.nonzero(~have)
    return np.concatenate((doc, zd)), np.concatenate((idx, zf + WORDS)), np.concatenate((x, np.zeros(len(zd))))


def _rows(batches):
    for batch in batches:
        idx, val = [], []
        for _, many, doc, i, x in features(batch):
            bounds = np.searchsorted(doc, np.arange(many + 1))
            idx += [i[p:q].astype(np.int32) for p, q in zip(bounds, bounds[1:])]
            val += [x[p:q].astype(np.float32) for p, q in zip(bounds, bounds[1:])]
        ends = pa.array(np.concatenate(([0], np.cumsum([len(i) for i in idx]))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(z) if z else np.zeros(0, t))) for z, t in ((idx, np.int32), (val, np.float32))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], ["doc_id", "idx", "val"])


def _inputs(docs: DataFrame) -> DataFrame:
    chars = F.col("n_chars").try_cast("double") if "n_chars" in docs.columns else F.length("text").cast("double")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), chars.alias("n_chars"))


def labelled_sample(labels: DataFrame, column: str, most: int, seed: int) -> DataFrame:
    """Up to `most` rows (doc_id, y) with a label of 0 or 1, those with the smallest hashes of doc_id; of a document that has both, 1."""
    y = F.col(column).cast("int")
    rows = labels.where(F.col("doc_id").isNotNull() & y.isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), y.alias("y"))
    return rows.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "y").limit(most).groupBy("doc_id").agg(F.max("y").alias("y"))


def train(docs: DataFrame, labels: DataFrame, *, sample: int = 6000, rank: int = 6, epochs: int = 6, seed: int = 2) -> Machine | None:
    """Fits on at most `sample` labelled rows of labels (doc_id, quality); None where no document has a label."""
    few = labelled_sample(labels, "quality", sample, seed).collect()
    y = {r["doc_id"]: r["y"] for r in few}
    if not y:
        return None
    spark = docs.sparkSession
    chosen = F.broadcast(spark.createDataFrame([(d,) for d in y], "doc_id long"))  # `sample` ids at most
    got = _inputs(docs).join(chosen, "doc_id", "left_semi").mapInArrow(_rows, "doc_id long, idx array<int>, val array<float>").toArrow().sort_by("doc_id").to_pydict()
    rows = [(np.array(i, np.int64), np.array(v, np.float64)) for i, v in zip(got["idx"], got["val"])]
    if not rows:
        return None
    model = Machine(rank, seed)
    model.fit(rows, np.array([y[d] for d in got["doc_id"]], float), epochs)
    return model


def predict(docs: DataFrame, model: Machine | None) -> DataFrame:
    """doc_id and score: how likely the label is 1.

    Null and empty texts are scored as empty; 0.5 where model is None. Whole texts are read, long
    ones too; n_chars is taken as missing where it is no number, other columns are ignored.
    Repeated rows are scored each and equal texts with one n_chars alike; an empty table gives an
    empty result.
    """

    def run(batches):
        for batch in batches:
            z = np.zeros(batch.num_rows)
            for a, many, doc, idx, x in features(batch) if model else ():
                z[a : a + many] = model.score(many, doc, idx, x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    return _inputs(docs).mapInArrow(run, "doc_id long, score double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    model = train(docs, C.read(spark, sf_dir, "labels").where(C.id_crc() % 4 != 2))
    return predict(docs, model).select("doc_id", (C.id_crc() % 4 == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
