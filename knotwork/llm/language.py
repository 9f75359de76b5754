"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader (per-coordinate rates, elastic-net penalties), then
calibrated by a temperature.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import common as C

BUCKETS = 1 << 16
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_TABLE = 0x30000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case letter of each code point; a space for anything else, so that n-grams see word edges."""
    out = np.full(_TABLE, 32, np.uint32)
    for cp in range(_TABLE):
        if (c := chr(cp)).isalpha():
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


def _grams(batch: pa.RecordBatch, column: str = "text"):
    """Runs of texts: index of the first, where each text's characters start (with the end), and for n of 1, 2, 3 the bucket of the n-gram at each character (BUCKETS where it would pass the text's end)."""
    data, off = C.flat(batch.column(column))
    table = _letters()
    for a, b in C.runs(off, 1 << 19):
        part, at = data[off[a] : off[b]], off[a : b + 1] - off[a]
        chars = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))[at]
        cp = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        c = table[np.minimum(cp, _TABLE - 1)]
        out = []
        with np.errstate(over="ignore"):
            h = np.zeros(len(c), np.uint32)
            for n in range(3):
                if n < len(c):
                    h[: len(c) - n] += (c[n:] + np.uint32(7)) * _MULTIPLIERS[n]
                g = (((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)).astype(np.int32)
                for back in range(1, n + 1):
                    ends = chars[1:] - back
                    g[ends[ends >= chars[:-1]]] = BUCKETS
                out.append(g)
        yield a, chars, out


def _document_frequency(batches):
    total, docs = np.zeros(BUCKETS + 1, np.int64), 0
    flags = np.zeros(BUCKETS + 1, bool)
    for batch in batches:
        for _, chars, grams in _grams(batch):
            for k in range(len(chars) - 1):
                x, y = chars[k], chars[k + 1]
                if y > x:
                    for g in grams:
                        flags[g[x:y]] = True
                    total += flags
                    flags[:] = False
            docs += len(chars) - 1
    seen = np.flatnonzero(total[:BUCKETS])
    yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(total[seen], docs))], ["bucket", "df"])


def _counts(batches):
    """Bucket counts of each text."""
    for batch in batches:
        idx, cnt, total = [], [], []
        for _, chars, grams in _grams(batch):
            for k in range(len(chars) - 1):
                g = np.concatenate([x[chars[k] : chars[k + 1]] for x in grams])
                u, c = np.unique(g[g < BUCKETS], return_counts=True)
                idx.append(u.astype(np.int32)), cnt.append(c.astype(np.int32)), total.append(int(chars[k + 1] - chars[k]))
        ends = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in idx]))).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), pa.array(total, pa.int64()), *(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if x else np.zeros(0, np.int32))) for x in (idx, cnt))],
            ["lang", "total", "idx", "cnt"],
        )


class Ftrl:
    """Multinomial logistic regression by FTRL-proximal: weights are zero until the summed gradients pass l1."""

    def __init__(self, size: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05):
        self.z, self.n = np.zeros((size, classes)), np.zeros((size, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, idx=slice(None)) -> np.ndarray:
        z, n = self.z[idx], self.n[idx]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0, w)

    def learn(self, idx: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(idx)
        g = x[:, None] * (softmax(x @ w) - np.eye(self.z.shape[1])[y])[None]
        n = self.n[idx]
        self.z[idx] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[idx] = n + g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the smallest log loss on rows that training has not seen."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 80))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


class Model:
    """labels, weights (bucket x label, with idf and scale in them), bias, temperature."""

    def __init__(self, labels, weights, bias, temp):
        self.labels, self.weights, self.bias, self.temp = labels, weights, bias, temp


SCALE = 20.0  # brings relative n-gram frequencies to about 1


def train(labelled: DataFrame, *, per_label: int = 1000, epochs: int = 4, seed: int = 3) -> Model | None:
    """Learns from labelled (text, lang, doc_id). None where there is nothing to learn from.

    Document frequencies are counted over all rows. Weights are fitted on a sample of about
    `per_label` rows of each label (those with the smallest hashes of doc_id), every label; every
    fifth sampled row is kept for the temperature. Repeated rows are sampled together. The driver
    holds the sampled rows' n-gram counts and a megabyte a label.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.col("doc_id").alias("doc_id"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    shares = rows.sparkSession.createDataFrame([(lang, min(1.0, per_label / n)) for lang, n in counts.items()], "lang string, share double")
    sample = rows.withColumn("draw", draw).join(F.broadcast(shares), "lang").where("draw < share").select("lang", "text")  # one row a label
    sample = sample.mapInArrow(_counts, "lang string, total long, idx array<int>, cnt array<int>").toArrow().to_pydict()
    df = np.zeros(BUCKETS + 1)
    total = 0
    for r in rows.select("text").mapInArrow(_document_frequency, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect():
        if r["bucket"] < 0:
            total = r["df"]
        else:
            df[r["bucket"]] = r["df"]
    idf = np.log((1 + total) / (1 + df)) + 1
    idf[BUCKETS] = 0
    labels = sorted(set(sample["lang"])) or sorted(counts)[:1]
    code = {v: k for k, v in enumerate(labels)}
    rng = np.random.default_rng(seed)
    data = []
    for lang, n, idx, cnt in zip(*(sample[k] for k in ("lang", "total", "idx", "cnt"))):
        i = np.array(idx, np.int64)
        data.append((np.append(i, BUCKETS), np.append(np.array(cnt) / max(n, 1) * idf[i] * SCALE, 1.0), code[lang]))
    data.sort(key=lambda d: (d[2], len(d[0]), float(d[1].sum())))  # any order of arrival gives the same model
    order = rng.permutation(len(data))
    held, fit = order[::5] if len(order) >= 50 else order[:0], np.setdiff1d(order, order[::5], assume_unique=True) if len(order) >= 50 else order
    model = Ftrl(BUCKETS + 1, len(labels))
    for _ in range(epochs):
        for k in rng.permutation(fit):
            model.learn(*data[k])
    w = model.weights()
    logits = np.array([data[k][1] @ w[data[k][0]] for k in held]).reshape(len(held), len(labels))
    temp = temperature(logits, np.array([data[k][2] for k in held], int))
    bias = w[BUCKETS].copy()
    table = w * idf[:, None] * SCALE
    table[BUCKETS] = 0
    return Model(labels, np.ascontiguousarray(table, np.float32), bias, temp)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds lang_pred and score (calibrated probability) to docs (text and other columns).

    A text that is null or has no letter is `und` with score 0; so is every text where model is
    None. The whole of a long text is counted, in blocks of bounded size; of labels with one score
    the first in order is taken; a repeated row is predicted as often as it comes, an empty table
    gives an empty result, and columns named like the new ones are replaced.
    """
    passed = [c for c in docs.columns if c not in ("lang_pred", "score", "__letters")]
    src = docs.select(*[c for c in passed if c != "text"], F.col("text").cast("string").alias("text"), F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("__letters"))
    keep = [f for f in src.schema.fields if f.name not in ("text", "__letters")]

    def run(batches):
        for batch in C.small(batches):
            best, prob = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for a, chars, grams in _grams(batch) if model else ():
                n = np.diff(chars)
                full = np.flatnonzero(n)
                if not len(full):
                    continue
                logits = np.zeros((len(n), len(model.labels)))
                for g in grams:
                    logits[full] += np.add.reduceat(model.weights[g], chars[:-1][full], axis=0)
                logits = logits / np.maximum(n, 1)[:, None] + model.bias
                p = softmax(logits / model.temp)
                best[a : a + len(n)], prob[a : a + len(n)] = p.argmax(axis=1), p.max(axis=1)
            real = batch.column("__letters").to_numpy(zero_copy_only=False) & (model is not None)
            names = [model.labels[k] if r else "und" for k, r in zip(best, real)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(names, pa.string()), pa.array(np.where(real, prob, 0.0))], [*(f.name for f in keep), "lang_pred", "score"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep) + "lang_pred string, score double"
    return src.mapInArrow(run, schema)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    model = train(docs.where(C.id_crc() % 3 != 1))
    return predict(docs.select("doc_id", (C.id_crc() % 3 == 1).alias("held_out"), "text"), model)
