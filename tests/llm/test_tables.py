"""Every query and the pipeline on tables of odd rows, and what the learnt operators say against plain computations."""

import math
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from knotwork.llm import common as C
from knotwork.llm import decontaminate, language, quality, queries, sharding, toxicity
from tests.llm.test_ops import ODD, SF, prose

LONG = prose(320_000, 77)  # about 2 MB: more than a kernel looks at together
#: Texts by id: odd ones, a long one, ties (equal texts with other ids), and a repeated row.
ROWS = [*enumerate(ODD), (50, LONG), (51, LONG[:-4]), (52, "the same"), (53, "the same"), (54, prose(90, 3)), (54, prose(90, 3)), (55, "MIT License " + prose(60, 4))]


def _write(spark, folder: str, rows) -> str:
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(k, t, ("en", "de", None)[k % 3], None if k % 2 else "s", None if t is None else len(t)) for k, t in rows], kinds)
    extra = ["1 AS score", "'x' AS shard", "2 AS bucket", "3 AS key", "4 AS u", "5 AS node", "map('a', doc_id) AS spans", "6 AS __order", "7 AS __before", "8 AS `a.b`", "true AS kept", "9 AS component_id"]
    docs.selectExpr("*", *extra).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k, _ in rows] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    vectors = [(k, v) for k, v in enumerate([None, [], [0.0, 0.0], [1.0, 2.0], [2.0, 4.0], [1.0, None], [1.0, float("nan")]]) if rows] + [(3, [1.0, 2.0])] * bool(rows)
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").selectExpr("*", "1 AS v", "2 AS id", "3 AS width").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([(0, prose(40, 5)), (1, None), (2, "")] if rows else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    return _write(spark, str(tmp_path_factory.mktemp("odd")), ROWS)


@pytest.fixture(scope="module")
def empty_tables(spark, tmp_path_factory):
    return _write(spark, str(tmp_path_factory.mktemp("empty")), [])


PER_ROW = {"op1_language", "op2_license", "op3_sharding", "op4_quality", "op9_minhash", "op10_toxicity"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_tables(spark, odd_tables, name):
    got = queries.QUERIES[name](spark, odd_tables).collect()
    ids = sorted(r["doc_id"] for r in got) if got and "doc_id" in got[0] else []
    if name in PER_ROW:
        assert ids == sorted(k for k, _ in ROWS)
    by: dict = {}
    for r in got:
        by.setdefault(r["doc_id"] if "doc_id" in r else r["vec_id"], []).append(r)
    if name in ("op1_language", "op4_quality", "op10_toxicity"):
        assert by[52][0]["score"] == by[53][0]["score"] and by[54][0] == by[54][1] and all(0 <= r["score"] <= 1 for r in got)
    if name == "op1_language":
        assert by[0][0]["lang_pred"] == "und" and by[50][0]["lang_pred"] in ("en", "de")
    if name == "op2_license":
        assert by[50][0]["n_words"] == 320_000 and by[55][0]["base_labels"] == "mit" and by[0][0]["n_words"] == 0
    if name == "op5_embedding":
        assert len(got) == 8 and [r["n_links"] for r in by[3]] == [1, 1] and by[4][0]["component_id"] == 3 and not by[4][0]["kept"]
    if name == "op6_packing":
        assert set(ids) == {k for k, _ in ROWS} and sum(r["length"] for r in by[50]) == by[50][0]["doc_tokens"] and len(by[54]) == 2
    if name == "op7_substring":
        assert {(r["doc_id"], r["class_id"]) for r in got} == {(51, 50)}
    if name == "op9_minhash":
        assert by[51][0]["component_id"] == 50 and by[53][0]["component_id"] == 52 and by[0][0]["kept"] and [r["kept"] for r in by[54]] == [True, True]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty_tables, name):
    assert queries.QUERIES[name](spark, empty_tables).count() == 0


def test_pipeline_on_odd_and_empty_tables(spark, odd_tables, empty_tables):
    docs = C.read(spark, odd_tables, "documents")
    names, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = C.cut(stage(spark, docs, odd_tables))
        kept[name] = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
        assert name == "packing" or docs.columns == names
    assert kept["minhash"] == sorted(set(kept["toxicity"]) - {7, 51, 53})  # a repeated row is left once
    assert kept["substring"] == kept["minhash"] and set(kept["packing"]) == set(kept["decontaminate"])
    assert corpus_pipeline.run(spark, empty_tables).count() == 0


def test_pipeline_result_holds_the_tokens(spark, odd_tables):
    out = corpus_pipeline.run(spark, odd_tables).collect()
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in out)


def test_written_tables_are_deleted(spark, odd_tables):
    """What the stages cut on their way is gone when the pipeline ends, but for its result and the pieces that it was packed from."""
    folder = C.scratch(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    corpus_pipeline.run(spark, odd_tables)
    assert len(set(os.listdir(folder)) - before) <= 2


# ------------------------------------------------------------------ plain computations


def test_language_against_plain_sums(spark):
    """Scores of the query's operator against n-grams counted one by one in a dictionary."""
    rows = [(k, prose(30, k) if k % 2 else "ß ünd " + prose(20, k).upper(), ("aa", "bb")[k % 2]) for k in range(40)]
    docs = spark.createDataFrame([*rows, (90, "é", None), (91, "a", None)], "doc_id long, text string, lang string")
    model = language.train(docs, per_label=15)
    mask = (1 << 32) - 1

    def plain(text):
        letters = [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 32 for c in text]
        total = np.zeros(len(model.labels))
        for at in range(len(letters)):
            h = 0
            for n in range(3):
                if at + n < len(letters):
                    h = (h + (letters[at + n] + 7) * int(language._MULTIPLIERS[n])) & mask
                    g = (((h ^ (h >> 15)) * 0x2C1B3C6D) & mask) >> 16
                    total += model.weights[g]
        z = (total / max(len(letters), 1) + model.bias) / model.temp
        e = np.exp(z - z.max())
        return model.labels[int(e.argmax())], float((e / e.sum()).max())

    texts = dict(docs.select("doc_id", "text").collect())
    for r in language.predict(docs, model).collect():
        want = plain(texts[r["doc_id"]])
        assert r["lang_pred"] == want[0] and abs(r["score"] - want[1]) < 1e-5


def test_quality_against_all_pairs(spark):
    """Scores of whole batches against sums over every pair of features of one text."""
    docs = spark.createDataFrame([(k, t, None if t is None else len(t)) for k, t in enumerate([*ODD[:5], prose(12, 1), prose(25, 2) + "\nA b, c."])], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2) for k in range(7)], "doc_id long, quality int")
    model = quality.train(docs, labels, epochs=2)
    for r in quality.predict(docs, model).collect():
        text = docs.where(F.col("doc_id") == r["doc_id"]).first()
        batch = pa.RecordBatch.from_arrays([pa.array([text["text"]], pa.string()), pa.array([None if text["n_chars"] is None else float(text["n_chars"])], pa.float64())], ["text", "n_chars"])
        _, _, _, idx, x = next(quality.features(batch))
        value = np.zeros(quality.SIZE)
        value[idx] = x
        value[quality.WORDS :] = (value[quality.WORDS :] - model.mean[quality.WORDS :]) / model.scale[quality.WORDS :]
        on = np.flatnonzero(value)
        z = model.w0 + model.w[on] @ value[on] + sum(model.v[a] @ model.v[b] * value[a] * value[b] for n, a in enumerate(on) for b in on[n + 1 :])
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9


def test_toxicity_against_sums_over_landmarks():
    """Scores of words, of two words and of sentences by the collapsed weights against the kernel with every landmark."""
    spell = lambda t: tuple(bytes(toxicity._LETTER[c] for c in w.encode()) for w in t.split())
    marks = toxicity.Marks([spell(x) for x in ("grumble", "other", "gutter snipe", "banana", "vile toad")])
    r = np.random.default_rng(3)
    alpha = np.array([1.5, -0.4, 2.0, -0.3, 1.7])
    model = toxicity.Model(marks, alpha, -0.8)
    text = "A gutter snipe ate bananas. Other toads vile grumbles! " + prose(45, 6) + " gutter\nsnipe " + " ".join(r.permutation(["toad", "vile", "x", "gruxmble"]))
    data = np.frombuffer(text.encode(), np.uint8)
    letters, bounds, _, sentence = toxicity.word_letters(data, np.array([0, len(data)]))
    words = [letters[a:b].astype(np.uint8).tobytes() for a, b in zip(bounds, bounds[1:])]
    f = lambda s: float((marks.kernel([s]) @ alpha)[0]) - 0.8
    assert np.allclose(model.words(letters, bounds), [f((w,)) for w in words], atol=1e-5)
    parts = [tuple(words[k] for k in np.flatnonzero(sentence == n)) for n in np.unique(sentence)]
    got = model.documents(data, np.array([0, len(data)]))[0]
    assert abs(got[4] - np.clip(max(map(f, parts)), -2, 2)) < 0.2  # neighbours far from any landmark are left out there
    best = max([f((w,)) for w in words] + [f(p[k : k + 2]) for p in parts for k in range(len(p) - 1) if f(p[k : k + 2]) - f(p[k : k + 1]) - f(p[k + 1 : k + 2]) - 0.8 > 0.1])
    assert abs(got[0] - np.clip(best, -2, 1.2)) < 1e-4


def test_sharding_query_keeps_its_law(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op3_sharding"](spark, folder).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in C.read(spark, folder, "documents").select("doc_id", "text").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts) and all(r["size"] == len(texts[r["doc_id"]]) + 16 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) for r in rows)
    slots: dict = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shuffle_to_shards(C.read(spark, folder, "documents").repartition(7).select("doc_id", "text")).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in again} == {(r["doc_id"], r["shard"], r["slot"]) for r in rows}


def test_decontamination_against_every_document_and_item(spark):
    """The documents and items that match, and no others: edit distances of all of them, on the whole table."""
    docs = {r["doc_id"]: decontaminate.normal(r["text"]) for r in C.read(spark, SF, "documents").select("doc_id", "text").collect()}
    items = {r["item_id"]: decontaminate.normal(r["text"]) for r in C.read(spark, SF, "benchmark").collect()}
    r = np.random.default_rng(8)
    planted = {}
    for k, (i, t) in enumerate(sorted(items.items())[:20]):  # with edits: at the allowed number, one below, one above
        w = list(t)
        for x in r.choice(len(w), decontaminate.budget(len(t), 0.07) + k % 3 - 1, replace=False):
            w[x] = "q" if w[x] != "q" else "z"
        planted[10_000 + k] = prose(10, k) + " " + "".join(w) + " " + prose(10, 100 + k)
    short = {d: t for d, t in docs.items() if len(t) < 6000} | {d: decontaminate.normal(t) for d, t in planted.items()}
    frame = spark.createDataFrame([(d, t) for d, t in short.items()], "doc_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["distance"] for x in decontaminate.matches(frame, C.read(spark, SF, "benchmark")).groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance")).collect()}
    want = {}
    for i, t in items.items():
        eq, m, k = decontaminate.masks(t), len(t), decontaminate.budget(len(t), 0.07)
        for d, text in short.items():
            best = decontaminate.myers(eq, m, text)[0]
            if best <= k:
                want[d, i] = best
    assert got == want and len([1 for d, _ in want if d >= 10_000]) >= 13


def test_words_of_long_texts_hash_alike_over_block_ends():
    data = np.frombuffer(LONG.encode(), np.uint8)
    h, s, e, first = C.words(data, np.array([0, len(data)]), C.NOT_SPACE)
    assert first[1] == 320_000 and len(data) > C.BLOCK
    some = {}
    for k in range(0, 320_000, 37):
        assert some.setdefault(LONG[s[k] : e[k]], h[k]) == h[k]
    assert re.findall(r"\S+", LONG)[160_000] == LONG[s[160_000] : e[160_000]]
