"""Each operator on small tables against brute force, and on the cases that tables can hold: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import zlib
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from knotwork.llm import common as C
from knotwork.llm import decontaminate, embedding, language, license, minhash, packing, quality, queries, sharding, substring, toxicity

SF = "/root/testdata/sf0.001"
WORD = "public_tokenizers"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
RNG = np.random.default_rng(0)
VOCABULARY = ["".join(RNG.choice(list("abcdefghijklmnop"), RNG.integers(2, 8))) for _ in range(400)]


def prose(n, seed):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(VOCABULARY, n))


ODD = [None, "", " \n\t ", "a", "Ünï çödé ß 日本 語", "x " * 3000, "same text here twice over", "same text here twice over"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, with columns whose names operators use inside."""
    rows = [(k, t, None if k % 3 else "en", None if k % 2 else "s", None, 1, "b", 2, "k") for k, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard int, bucket string, score int, key string").repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, duck, name):
    a, b = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.SQL[name]).df()
    plain = lambda d: sorted(map(tuple, d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).values.tolist()), key=str)
    assert sorted(a.columns) == sorted(b.columns) and plain(a) == plain(b)


# ------------------------------------------------------------------ kernels


def test_words_are_found_whole_and_hash_alike():
    texts = [t or "" for t in ODD] + [prose(500, 1), "w" * 3000 + " tail"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    block, C.BLOCK = C.BLOCK, 64
    try:
        h, s, e, first = C.words(data, off, C.NOT_SPACE)
    finally:
        C.BLOCK = block
    raw = data.tobytes()
    seen = {}
    for k, t in enumerate(texts):
        got = [raw[s[j] : e[j]].decode() for j in range(first[k], first[k + 1])]
        assert got == [w for w in t.replace("\xa0", "\xa0").split(" ") for w in w.split()]
        for j in range(first[k], first[k + 1]):
            assert seen.setdefault(raw[s[j] : e[j]], h[j]) == h[j]
    assert len(set(seen.values())) == len(seen)


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 50), (100, 60), (200, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in C.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[k] for k in range(1, 41)} == {1} and {got[k] for k in (50, 60, 100, 200)} == {50}
    assert C.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_of_long_chains_take_few_rounds(spark, monkeypatch):
    """Ascending, descending, zigzag and shuffled chains of 1,000 nodes, with one link a task so that tasks join nothing."""
    rounds, counted = [], C.counted
    monkeypatch.setattr(C, "counted", lambda df: rounds.append(1) or counted(df))
    r = np.random.default_rng(0)
    up = np.arange(1000)
    zigzag = np.stack((up // 2, 999 - up // 2), 1).reshape(-1)[::2][:1000]
    for names in (up, up[::-1], np.where(up % 2 == 0, up // 2, 999 - up // 2), r.permutation(1000), zigzag):
        rounds.clear()
        links = spark.createDataFrame([(int(a), int(b)) for a, b in zip(names, names[1:])], "u long, v long")
        got = C.components(links, block=1).collect()
        assert {x["component"] for x in got} == {int(names.min())} and len(got) == len(set(names.tolist())) and (len(rounds) - 1) / 2 <= 15
    links = [(int(a), int(b)) for a, b in r.integers(0, 3000, (1500, 2))]
    want = C.smallest(np.array([a for a, _ in links]), np.array([b for _, b in links]), np.arange(3000))
    got = {x["node"]: x["component"] for x in C.components(spark.createDataFrame(links, "u long, v long"), block=40).collect()}
    assert all(want[k] == c for k, c in got.items()) and set(got) == {k for a, b in links if a != b for k in (a, b)}


# ------------------------------------------------------------------ 1 language


def test_language_odd(odd, none):
    model = language.train(odd.withColumn("lang", F.lit("en")), per_label=10)
    got = {r["doc_id"]: r for r in language.predict(odd, model).collect()}
    assert len(got) == len(ODD) and [got[k]["lang_pred"] for k in range(3)] == ["und"] * 3 and got[3]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.train(none) is None and language.predict(none, model).count() == 0
    assert {r["lang_pred"] for r in language.predict(odd, None).collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    df = queries.QUERIES["op1_language"](spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert df.where("lang = lang_pred").count() / df.count() > 0.97


def test_temperature_recovers_confidence():
    r = np.random.default_rng(1)
    true = r.normal(0, 2, (4000, 3))
    y = np.array([r.choice(3, p=p) for p in language.softmax(true)])
    assert abs(language.temperature(true * 4, y) - 4) < 0.8


# ------------------------------------------------------------------ 2 licenses


def brute_license(text):
    import re

    text = (text or "").translate({k: k + 32 for k in range(65, 91)})
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    labels, best = set(), 0
    words = pattern.findall(text)
    for label, t in license.TEMPLATES:
        spelled = pattern.findall(t.lower())
        for k in range(len(words)):
            common = len(set(spelled) & set(words[k : k + len(spelled) + len(spelled) // 4]))
            if common >= 0.8 * len(set(spelled)) - 1e-9:
                labels.add(label)
                best = max(best, common / len(set(spelled)))
    base = [(label, k) for label, p in license.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    return len(words), len(base), labels | {b[0] for b in base}, best


def test_license_brute_force(spark):
    r = np.random.default_rng(2)
    pool = [w for _, t in license.TEMPLATES for w in t.split()] + VOCABULARY[:30]
    texts = ODD + [" ".join(r.choice(pool, 60)) for _ in range(20)]
    for k, (_, t) in enumerate(license.TEMPLATES):
        w = t.split()
        texts += [prose(20, k) + "\n" + t.upper() + "\n", " ".join(r.permutation(w)), " ".join(w[: int(len(w) * 0.8)]), " ".join(w[: int(len(w) * 0.7)]), t[: len(t) // 2] + "\n" + t[len(t) // 2 :], prose(9, k) + "\n# " + "\n# ".join(" ".join(w[j : j + 7]) for j in range(0, len(w), 7)), " ".join(v + " " + x for v, x in zip(w, VOCABULARY))]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for row in license.scan(df).collect():
        n, base, labels, best = brute_license(texts[row["doc_id"]])
        assert (row["n_words"], row["n_base"], row["labels"], round(row["score"], 9)) == (n, base, ",".join(sorted(labels)), round(best, 9)), texts[row["doc_id"]]


def test_license_wrapped_and_whole_texts(spark, tmp_path):
    """A notice that is wrapped is found; whole licenses are read from a folder; a word counts only where it is spelled alike."""
    import textwrap

    mit = dict(license.TEMPLATES)["mit-permission"]
    wrapped = "/*\n * " + "\n * ".join(textwrap.wrap(mit, 60)) + "\n */ int main() {}"
    scattered = " ".join(x + " " + prose(3, k) for k, x in enumerate(mit.split()))
    (tmp_path / "own.txt").write_text(" ".join(VOCABULARY[:300]))
    own = license.read_templates(str(tmp_path))
    assert [label for label, _ in own] == ["own"]
    texts = [wrapped, scattered, prose(5, 1) + " " + own[0][1][5:-9] + prose(5, 2), prose(300, 3)]
    got = {r["doc_id"]: r for r in license.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates=license.TEMPLATES + own).collect()}
    assert "mit-permission" in got[0]["labels"] and "mit-text" in got[0]["labels"] and got[0]["score"] == 1 and got[2]["labels"] == "own"
    assert "mit-permission" not in got[1]["labels"] and got[3]["labels"] == ""


def test_license_odd(odd, none):
    assert license.scan(odd).count() == len(ODD) and license.scan(none).count() == 0


# ------------------------------------------------------------------ 3 sharding


def test_sharding(spark, odd, none):
    docs = spark.createDataFrame([(k % 700, prose(k % 40, k)) for k in range(2000)] + [(5, None)] * 3, "doc_id long, text string")
    a = sharding.shuffle_to_shards(docs, shards=7, bucket_bytes=4000).toPandas()
    b = sharding.shuffle_to_shards(docs.repartition(5), shards=7, bucket_bytes=4000).toPandas()
    assert len(a) == 2003 and a.groupby("shard").size().max() - a.groupby("shard").size().min() <= 1 and a.shard.nunique() == 7
    assert all(sorted(g) == list(range(len(g))) for _, g in a.groupby("shard").slot)
    key = ["shard", "slot", "doc_id"]
    assert (a.sort_values(key)[key].values == b.sort_values(key)[key].values).all()
    assert sorted(map(str, a[["doc_id", "text"]].values.tolist())) == sorted(map(str, docs.toPandas().values.tolist()))
    assert abs(np.corrcoef(a.sort_values(["shard", "slot"]).doc_id, np.arange(len(a)))[0, 1]) < 0.1
    assert sharding.shuffle_to_shards(odd, shards=40).count() == len(ODD) and sharding.shuffle_to_shards(none).count() == 0


def test_sharding_deals_equal_rows_and_takes_any_column(spark):
    """Half of the rows are one row: it is dealt over the buckets. Columns have the names that are used inside, and a map."""
    docs = spark.createDataFrame([(k, prose(10, k)) for k in range(600)] + [(5000, "one " * 50)] * 600, "doc_id long, text string")
    docs = docs.selectExpr("doc_id", "text", "1 AS __before", "doc_id AS __order", "2 AS __copies", "map('a', doc_id) AS m", "array(struct(map(1, text) AS x)) AS n", "3 AS shard", "4 AS bucket", "5 AS slot", "6 AS n_")
    made = sharding.shuffle_to_shards(docs.repartition(3), shards=7, bucket_bytes=9000)
    a = made.toPandas()
    assert len(a) == 1200 and set(a.groupby("shard").size()) <= {171, 172} and all(sorted(g) == list(range(len(g))) for _, g in a.groupby("shard").slot)
    one = a[a.doc_id == 5000]
    assert len(one) == 600 and one.groupby("bucket").size().max() < 60 and (a.__order == a.doc_id).all() and (a.m.map(lambda m: m["a"]) == a.doc_id).all()
    assert sorted(a[a.doc_id < 5000].doc_id) == list(range(600))


def test_fisher_yates_is_uniform():
    seen = {}
    for k in range(6000):
        seen[tuple(sharding._fisher_yates(3, np.random.default_rng(k)))] = seen.get(tuple(sharding._fisher_yates(3, np.random.default_rng(k))), 0) + 1
    assert len(seen) == 6 and max(seen.values()) < 1200 and min(seen.values()) > 800


# ------------------------------------------------------------------ 4 quality


def test_machine_is_linear_time_identity():
    r = np.random.default_rng(3)
    m = quality.Machine(4, 0)
    m.w, m.v, m.w0 = r.normal(size=quality.SIZE), r.normal(size=m.v.shape), 0.3
    idx = np.concatenate((np.sort(r.choice(quality.WORDS, 12, replace=False)), np.arange(quality.WORDS, quality.SIZE)))
    x = r.normal(size=len(idx))
    direct = m.w0 + m.w[idx] @ x + sum((m.v[i] @ m.v[j]) * x[a] * x[b] for (a, i), (b, j) in combinations(enumerate(idx), 2))
    assert abs(m.score(1, np.zeros(len(idx), int), idx, x)[0] - direct) < 1e-8


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(8)] + [(None, 1, 1), (3, None, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(odd, labels)
    got = quality.predict(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.train(odd, labels.limit(0)) is None and quality.predict(none, model).count() == 0
    assert {r["score"] for r in quality.predict(odd.drop("n_chars"), None).collect()} == {0.5}


def test_quality_held_out(spark):
    df = queries.QUERIES["op4_quality"](spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    assert df.where("predicted = quality").count() / df.count() > 0.9


# ------------------------------------------------------------------ 5 embeddings


def test_embedding_brute_force(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(60, 16))
    v = np.concatenate([base, base[:30] + r.normal(0, 0.12, (30, 16)), base[:10] * 3, r.normal(size=(200, 16))])
    bad = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [], [1.0] * 8]
    data = [(k, [float(y) for y in x]) for k, x in enumerate(v)] + [(len(v) + k, x) for k, x in enumerate(bad)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("cell", F.lit("c"))
    got = {x["vec_id"]: x for x in embedding.near_duplicates(df, per_cell=16, block=20).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    close = u @ u.T >= 0.9
    np.fill_diagonal(close, False)
    found = sum(got[k]["n_links"] for k in range(len(v)))
    assert found >= 0.97 * close.sum() and all(got[k]["n_links"] <= close[k].sum() for k in range(len(v)))
    assert all(got[len(v) + k]["n_links"] == 0 and got[len(v) + k]["kept"] for k in range(len(bad)))
    assert embedding.near_duplicates(df.limit(0)).count() == 0


def test_multi_sequence_is_sorted():
    r = np.random.default_rng(5)
    a, b = r.random((3, 7)), r.random((3, 9))
    i, j = embedding.multi_sequence(a, b, 40)
    for n in range(3):
        assert (a[n][i[n]] + b[n][j[n]]).tolist() == pytest.approx(sorted(x + y for x in a[n] for y in b[n])[:40]) and len(set(zip(i[n], j[n]))) == 40
    assert embedding.multi_sequence(a, b, 100)[0].shape == (3, 63)


def test_embedding_rows_of_all_kinds(spark):
    """Repeated rows, one name for two vectors, no name, other lengths, components whose squares leave the range."""
    e = lambda k, n=4: [float(k == j) for j in range(n)]
    data = [(1, e(0)), (1, e(0)), (2, e(0)), (3, e(1)), (3, e(2)), (4, e(2)), (None, e(0)), (5, [1e200, 0.0, 0.0, 0.0]), (6, [1e-200, 0.0, 0.0, 0.0]), (7, e(0, 3)), (8, [2.0, 0.0, 0.0]), (9, e(3))]
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in embedding.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect())
    assert got == [(0, 0, None, None), (1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), (3, 1, 3, True), (4, 1, 3, False), (5, 3, 1, False), (6, 3, 1, False), (7, 1, 7, True), (8, 1, 7, False), (9, 0, 9, True)]


def test_embedding_recall_of_a_grid_with_links_at_the_threshold(spark):
    """4,000 vectors in pairs at cosines from 0.9 to 0.93, in the directions that are hardest to meet, over 7 x 7 cells; and exact links of a hot cell in blocks."""
    r = np.random.default_rng(11)
    a = r.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = r.normal(size=a.shape)
    z -= (z * a).sum(1, keepdims=True) * a
    c = r.uniform(0.901, 0.93, (2000, 1))
    v = np.concatenate((a, c * a + np.sqrt(1 - c * c) * z / np.linalg.norm(z, axis=1, keepdims=True)))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {x["vec_id"]: x for x in embedding.near_duplicates(df).collect()}
    assert len(embedding.fit(v, 4000, 0.9, 0.95, 64, 2048, 5).books[0]) == 7
    assert 0.95 * 4000 <= sum(x["n_links"] for x in got.values()) <= 4000
    assert all(got[k + 2000]["component_id"] in (k, k + 2000) for k in range(2000))
    hot = r.normal(size=(1, 64)) + r.normal(0, 0.01, (300, 64))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(hot)], "vec_id long, embedding array<double>")
    got = embedding.near_duplicates(df, per_cell=8, block=32).collect()
    assert {x["component_id"] for x in got} == {0} and 0.97 * 300 * 299 <= sum(x["n_links"] for x in got) <= 300 * 299


# ------------------------------------------------------------------ 6 packing


def test_encode_is_the_tokenizers_own():
    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    texts = [x or "" for x in ODD] + ["J̌ it's WE'LL_ __a²½ x\x1cy İstanbul ΣΑΣ don't 12ab ﬁ Å é é 日本語 tab\tq <|endoftext|> áb", "plain <|startoftext|> ABC's 'twas 'tHE n't ÀÉß ǅ ŉ", prose(300, 6)]
    want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert packing.encode(texts, TOKENIZER) == want
    old = packing.CACHE_PARTS, packing.CACHE_WORDS
    packing.CACHE_PARTS = packing.CACHE_WORDS = 5
    try:
        assert [packing.encode([x], TOKENIZER)[0] for x in texts] == want
    finally:
        packing.CACHE_PARTS, packing.CACHE_WORDS = old


def test_added_tokens_in_texts_are_those_tokens(spark):
    texts = ["one <|endoftext|> two", "<|startoftext|>x", prose(30, 6), "a <|EndOfText|> b", "<|endoftext", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t = Tokenizer.from_file(TOKENIZER)
    for r in packing.pieces(docs, tokenizer=TOKENIZER, keep_ids=True).collect():
        want = np.array(t.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [2], "<u4").tobytes()
        assert bytes(r["ids"]) == want and r["ids_crc32"] == zlib.crc32(want) and r["doc_tokens"] == len(want) // 4


def test_shortest_pack_first():
    r = np.random.default_rng(7)
    h = {int(k): int(c) for k, c in zip(r.integers(1, 101, 40), r.integers(1, 500, 40))}
    out = packing.shortest_pack_first(h, 100)
    used = {}
    for lengths, count in out:
        assert sum(lengths) <= 100 and count > 0
        for n in lengths:
            used[n] = used.get(n, 0) + count
    assert used == h
    assert packing.shortest_pack_first({}, 10) == [] and packing.shortest_pack_first({6: 3, 4: 3}, 10) == [((6, 4), 3)]


def test_packing_round_trip(spark, odd, none):
    long = spark.createDataFrame([(100 + k, prose(n, k)) for k, n in enumerate((5, 4000, 9000, 700, 0))], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(long)
    got = packing.place(C.cut(packing.pieces(docs, tokenizer=TOKENIZER, keep_ids=True)), group=3).toPandas()
    t = Tokenizer.from_file(TOKENIZER)
    for d, text in docs.collect():
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        mine = got[got.doc_id == d].sort_values("start")
        assert b"".join(mine.ids) == ids.tobytes() and (mine.doc_tokens == len(ids)).all() and (mine.length == mine.ids.map(len) // 4).all()
        assert all(zlib.crc32(x) == c for x, c in zip(mine.ids, mine.ids_crc32))
    s = got.sort_values(["sequence_id", "offset"])
    assert (s.groupby("sequence_id").length.cumsum() - s.length == s.offset).all() and s.groupby("sequence_id").length.sum().max() <= 4096
    assert sorted(got.sequence_id.unique()) == list(range(got.sequence_id.nunique()))
    assert packing.pack(none, tokenizer=TOKENIZER).count() == 0


# ------------------------------------------------------------------ 7 substrings


def brute_windows(h, least):
    out = set()
    for i in range(len(h)):
        for j in range(i + least - 1, len(h)):
            c = min(range(i, j + 1), key=lambda k: (h[k], k))
            out.add((i, j, c))
    return out


def test_compact_windows_cover_every_subsequence_once():
    r = np.random.default_rng(8)
    h = C.mix(r.integers(0, 60, 50).astype(np.uint64))
    first = np.array([0, 30, 33, 50])
    left, c, right = substring.compact_windows(h, first, 5)
    packed = ((h >> np.uint64(32)) << np.uint64(32))
    for a, b in zip(first, first[1:]):
        want = {(i + a, j + a, k + a) for i, j, k in brute_windows(packed[a:b], 5)}
        got = {(i, j, k) for lo, k, hi in zip(left, c, right) if a <= k < b for i in range(lo, k + 1) for j in range(k, hi + 1) if j - i + 1 >= 5}
        assert got == want
    assert sum(1 for _ in c) < 2 * 50 / 5


def test_repeats_are_found(spark, odd, none):
    shared, other = prose(60, 900), prose(80, 901)
    words = other.split()
    words[40] = "changed"
    texts = [prose(200, 1), prose(50, 2) + " " + shared + " " + prose(90, 3), prose(30, 4) + " " + shared.upper(), other, prose(100, 5) + " " + " ".join(words) + " " + prose(10, 6), prose(300, 7), shared[: len(shared) // 2]]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = substring.repeats(df).collect()
    assert {(r["doc_id"], r["match_id"]) for r in got} == {(2, 1), (4, 3)}
    r = next(x for x in got if x["doc_id"] == 2)
    assert (r["start_word"], r["end_word"], r["match_start"], r["match_end"], r["similarity"]) == (30, 90, 50, 110, 1.0)
    left = {x["doc_id"]: x["text"] for x in substring.cut_repeats(df.withColumn("n_chars", F.lit(1))).collect()}
    assert left[1] == texts[1] and left[2].split() == texts[2].split()[:30] and left[5] == texts[5] and len(left[4].split()) <= 111
    assert substring.repeats(odd).count() == 0 and substring.repeats(none).count() == 0 and substring.cut_repeats(odd).count() == len(ODD)


def test_many_copies_of_a_passage(spark):
    shared = prose(70, 950)
    df = spark.createDataFrame([(k, prose(60 + k, k) + " " + shared + " " + prose(40, 1000 + k)) for k in range(120)], "doc_id long, text string").repartition(6)
    got = substring.repeats(df)
    assert {r["doc_id"] for r in got.select("doc_id").collect()} == set(range(1, 120))


def test_repeats_made_of_lines_that_are_common(spark):
    """Two lines stand each singly in many documents with smaller ids, and side by side in a few."""
    one, two = prose(25, 960), prose(25, 961)
    texts = [prose(60, 2000 + k) + " " + (one, two)[k % 2] + " " + prose(60, 3000 + k) for k in range(60)]
    texts += [prose(60, 4000 + k) + " " + one + " " + two + " " + prose(60, 5000 + k) for k in range(6)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for parts in (1, 5):
        assert {r["doc_id"] for r in substring.repeats(df.repartition(parts)).collect()} == set(range(61, 66))


def test_all_windows_of_a_document_are_kept():
    """Its words come again, so a key has several windows in it."""
    import pyarrow as pa

    text = " ".join(prose(60, 970) + " " + prose(40, 980 + k) for k in range(4))
    batch = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([text])], ["doc_id", "text"])
    rows = pa.Table.from_batches(substring._windows(5, 46, 6, np.zeros(0, np.uint64), False)([batch]))
    g, want = next(substring._sequences(batch, 5))[2], 0
    for seed in C.mix(np.arange(1, 7, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)):
        want += len(substring.compact_windows(C.mix(g ^ seed), np.array([0, len(g)]), 46)[1])
    assert rows.num_rows == want and len(set(rows["key"].to_pylist())) < want


def test_windows_meet_the_nearest_other_document():
    key, none = np.zeros(7, np.int64), np.ones(7, np.int64)  # one run of tokens around all of them
    doc, pos = np.array([1, 2, 2, 2, 3, 3, 4]), np.arange(7)
    got = [b.to_pydict() for b in substring._pairs_of(key, doc, pos << 32, none, none, 46, 1, False)]
    pairs = {(a >> 32, c >> 32) for b in got for a, c in zip(b["pu"], b["pv"])}
    assert pairs == {(1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (6, 0), (4, 3), (5, 3), (6, 5)}


def test_spans_are_never_cut_short():
    c = np.array([5, 40_000, 2_000_000, 900_000_000])
    left, right = np.array([5, 31_809, 0, 3]), c + np.array([0, 8_191, 3_000_000, 800_000_000])
    k, lo, at, hi = substring._unpack(substring._pack(3, left, c, right))
    assert (k == 3).all() and (at == c).all() and (lo <= left).all() and (hi >= right).all()
    assert lo[0] == 5 and hi[1] == 48_191 and lo[1] == 31_809 and (left - lo < 1 << 17).all() and (hi - right < 1 << 17).all()
    with pytest.raises(ValueError):
        next(substring._windows(5, 46, 16, np.zeros(0, np.uint64), False)([]))


def test_a_run_around_a_place_lies_inside_any_repeat():
    for least in (4, 5, 7, 20, 46, 100):
        around = substring._surroundings(least)
        assert len(around) == 6
        for p in range(least):
            assert any(left <= p and right <= least - 1 - p for left, right in around[:4])


def test_variants_of_passages_are_one_class(spark):
    """12 groups of 12 passages of 100 words, each with one or two words changed anywhere, among other words."""
    r, texts, group = np.random.default_rng(20), [], []
    for k in range(12):
        base = prose(100, 6000 + k).split()
        for j in range(12):
            w = list(base)
            for x in r.choice(100, r.integers(0, 3), replace=False):
                w[x] = f"new{k}{j}{x}"
            texts.append(prose(int(r.integers(20, 80)), 7000 + 20 * k + j) + " " + " ".join(w) + " " + prose(30, 8000 + 20 * k + j))
            group.append(k)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = substring.repeats(df).collect()
    assert len(got) == len({x["doc_id"] for x in got}) == 132
    assert {(group[x["doc_id"]], x["class_id"]) for x in got} == {(k, 12 * k) for k in range(12)} and all(x["n_links"] > 0 and x["similarity"] >= 0.8 for x in got)


def test_hot_keys_are_dealt_by_what_stands_around(spark, monkeypatch):
    """A passage in 150 documents and a line in 300; with a low bound their keys are hot."""
    shared, line = prose(70, 950), prose(20, 951)
    texts = [prose(60 + k % 9, k) + " " + (shared if k % 2 else line) + " " + prose(40, 1000 + k) for k in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = {tuple(x) for x in substring.repeats(df).select("doc_id", "start_word", "end_word", "class_id").collect()}
    monkeypatch.setattr(substring, "LOOK", 2)
    monkeypatch.setattr(substring, "HOT_LEAST", 20)
    seen, keys = [], substring._hot_keys
    monkeypatch.setattr(substring, "_hot_keys", lambda w: seen.append(keys(w)) or seen[-1])
    got = {tuple(x) for x in substring.repeats(df).select("doc_id", "start_word", "end_word", "class_id").collect()}
    assert len(seen[0]) and {x[0] for x in got} == set(range(3, 300, 2)) == {x[0] for x in want} and {x[3] for x in got} == {1}


def test_neighbours_in_ranges_are_those_of_the_whole_order():
    import pyarrow as pa

    r = np.random.default_rng(77)
    names = ["key", "u", "pu"]
    for trial in range(60):
        n = int(r.integers(1, 60))
        rows = sorted(zip(r.integers(0, 3, n).tolist(), r.integers(0, 1 + trial % 12, n).tolist(), (r.integers(0, 9, n) << 32).tolist()))
        cuts = [0, *sorted(r.integers(0, n + 1, int(r.integers(0, 6))).tolist()), n]

        def batch(part):
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in part], pa.int64()) for i in range(3)], names)

        out = [x for a, b in zip(cuts, cuts[1:]) for y in substring._neighbours(46, False)(batch(rows[k : k + 4]) for k in range(a, b, 4)) for x in y.to_pylist()]
        ends = sorted((x["key"], x["u"], x["pu"]) for x in out if x["key"] is not None)
        out += [x for y in substring._neighbours(46, False)([batch(ends)]) for x in y.to_pylist()]
        got = {(x["u"], x["pu"], x["v"], x["pv"]) for x in out if x["key"] is None}
        assert all(u > v for u, _, v, _ in got)
        for i, (k, u, p) in enumerate(rows):
            before = [x for x in rows[:i] if x[0] == k and x[1] != u]
            assert not before or (u, p, *before[-1][1:]) in got


def test_hot_keys_find_passages_after_a_common_line(spark, monkeypatch):
    """A line in 240 documents, then a passage that two of them share, with a word changed: the line's keys are hot or not."""
    line, texts = prose(24, 1951), []
    for k in range(240):
        w = prose(60, 3000 + k // 2).split()
        if k % 2:
            w[int(5 + k % 50)] = f"new{k}"
        texts.append(prose(30 + k % 9, 5000 + k) + " " + line + " " + " ".join(w) + " " + prose(20, 7000 + k))
    order = np.random.default_rng(3).permutation(240)
    df = spark.createDataFrame([(int(i), texts[k]) for i, k in enumerate(order)], "doc_id long, text string").repartition(4)
    found = lambda: {(x["doc_id"], x["match_id"]) for x in substring.links(df).where("end_word - start_word > 60").select("doc_id", "match_id").collect()}
    place = {int(k): i for i, k in enumerate(order)}
    want = {tuple(sorted((place[k], place[k + 1]), reverse=True)) for k in range(0, 240, 2)}
    cold = found()
    monkeypatch.setattr(substring, "LOOK", 2)
    monkeypatch.setattr(substring, "HOT_LEAST", 60)
    hot = found()
    print(len(want), len(want & cold), len(want & hot))
    assert len(want & hot) >= len(want & cold) and want <= hot


def test_windows_of_a_large_key_are_all_compared():
    """30 windows of one key: 10 have a run of tokens in common, which links them for sure, the others none."""
    n = 30
    runs = np.array([3 if k % 3 == 0 else 2 * k + 5 for k in range(n)])
    x = runs | runs << 32
    got = [b.to_pydict() for b in substring._pairs_of(np.zeros(n, np.int64), np.arange(n), np.arange(n) << 32, x, x, 46, 8, False)]
    pairs = {(u, v) for b in got for u, v in zip(b["u"], b["v"])}
    sure = {(u, v) for b in got for u, v, p in zip(b["u"], b["v"], b["pu"]) if p & 15 == 15}
    chain = {(k, 0) for k in range(3, n, 3)} | {(k, k - 3) for k in range(3, n, 3)}
    # the first of the ten stands for all of them
    others = {(u, v) for u in range(n) for v in range(u) if all(k % 3 or k == 0 for k in (u, v))}
    assert sure == chain and pairs == chain | others


def lines_and_variants():
    """A line of 30 words in 90 documents; what follows is shared by two or three of them, each with a word changed near the line or at the end."""
    line, texts, r = prose(30, 2951), [], np.random.default_rng(9)
    for k in range(90):
        w = prose(28, 12_000 + k // 3).split()
        if k % 3:
            w[(1, 22)[k % 2]] = f"new{k}"
        texts.append(prose(30 + k % 9, 15_000 + k) + " " + line + " " + " ".join(w) + " " + prose(20, 17_000 + k))
    return [(int(i), texts[k]) for i, k in enumerate(r.permutation(90))]


def test_large_and_hot_keys_lose_no_class(spark, monkeypatch):
    """The classes are those of all pairs of windows of a key, whether it is small, large or hot and cut in blocks."""
    df = spark.createDataFrame(lines_and_variants(), "doc_id long, text string").repartition(4)
    found = lambda **o: {tuple(x) for x in substring.repeats(df, **o).select("doc_id", "class_id").collect()}
    want = found(small=1 << 20)
    assert len(want) >= 30 and found() == want
    monkeypatch.setattr(substring, "LOOK", 2)
    monkeypatch.setattr(substring, "HOT_LEAST", 40)
    monkeypatch.setattr(substring, "_BLOCK", 16)
    assert found() == want


def test_pairs_come_in_rounds(spark, monkeypatch):
    """Where there are many windows, pairs are made in rounds and verified in rounds; links are the same."""
    df = spark.createDataFrame(lines_and_variants(), "doc_id long, text string").repartition(4)
    found = lambda: {tuple(x) for x in substring.links(df).collect()}
    want, rounds, verified = found(), [], []
    spots, verify = substring._spots, substring._verify
    monkeypatch.setattr(substring, "_spots", lambda *a: rounds.append(1) or spots(*a))
    monkeypatch.setattr(substring, "_verify", lambda *a: verified.append(1) or verify(*a))
    monkeypatch.setattr(substring, "AT_ONCE", 100)
    monkeypatch.setattr(substring, "STRETCHES", 1 / 8)
    assert found() == want and len(want) > 30
    assert len(rounds) > 1 and len(verified) > 1


def test_large_keys_lose_no_document_to_cut(spark):
    """The pipeline's stage cuts the documents that it would cut if all windows of a key were paired."""
    df = spark.createDataFrame(lines_and_variants(), "doc_id long, text string").repartition(4)
    texts = dict(lines_and_variants())
    cut = lambda **o: {x["doc_id"] for x in substring.cut_repeats(df, **o).collect() if x["text"] != texts[x["doc_id"]]}
    want = cut(small=1 << 20)
    assert len(want) >= 30 and cut() == want


def test_windows_without_a_passage_are_left_out(spark):
    """A run of tokens may repeat only where enough of them stand in two texts: against all runs."""
    r = np.random.default_rng(31)
    for trial in range(40):
        first = np.concatenate(([0], np.cumsum(r.integers(0, 40, 4))))
        single, least, share = r.random(first[-1]) < r.choice([0.05, 0.2, 0.5]), int(r.integers(1, 9)), float(r.choice([0.5, 8 / 9]))
        got = np.diff(substring._may_repeat(single, first, least, share))
        for a, b in zip(first, first[1:]):
            for s in range(a, b):
                want = s + least <= b and any((~single[i:j]).sum() >= share * (j - i) - 1e-9 for i in range(a, s + 1) for j in range(s + least, b + 1))
                assert got[s] == want
    tokens = r.integers(0, 50, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    texts = [" ".join(f"w{int(x) % 97}" for x in tokens[a : a + 100]) for a in range(0, 400, 100)]
    seen = substring._repeated_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), 1, False)
    words = [set(t.split()) for t in texts]
    hashes, _, _, _ = C.words(np.frombuffer(" ".join(sorted(set().union(*words))).encode(), np.uint8), np.array([0, len(" ".join(sorted(set().union(*words))).encode())]), C.NOT_SPACE)
    g, _ = C.shingles(hashes, np.array([0, len(hashes)]), 1)
    for w, alone in zip(sorted(set().union(*words)), substring._single(g, seen)):
        assert alone == (sum(w in x for x in words) == 1)


def test_repeats_of_all_kinds_of_rows(spark):
    """Equal texts, a repeated row, a repeat inside one text, no id."""
    one, two = prose(60, 1), prose(55, 2)
    inside = two + " " + prose(30, 3) + " " + two
    rows = [(1, one), (5, one), (5, one), (7, one), (2, inside), (3, "x y " + two + " z"), (3, "x y " + two + " z"), (None, one), (9, None), (4, "y " * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(x) for x in substring.repeats(df).select("doc_id", "start_word", "end_word", "class_id", "class_start", "n_links").collect())
    assert [x[:4] for x in got] == [(2, 85, 140, 2), (3, 2, 57, 2), (5, 0, 60, 1), (7, 0, 60, 1)]  # the first by way of document 3
    got = {tuple(x) for x in substring.repeats(df, within=True).select("doc_id", "start_word", "end_word", "class_id", "class_start").collect()}
    assert {(2, 85, 140, 2, 0), (3, 2, 57, 2, 0)} <= got and {x[0] for x in got} == {2, 3, 4, 5, 7}
    left = {x["doc_id"]: x["text"] for x in substring.cut_repeats(df).collect()}
    assert left[1] == one and left[5].strip() == left[7].strip() == "" and left[2] == inside and left[3].split() == ["x", "y", "z"] and left[9] is None


# ------------------------------------------------------------------ 8 decontamination


def edit(a, b):
    """Smallest distance of a to a substring of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_myers():
    r = np.random.default_rng(9)
    for _ in range(60):
        a, b = ("".join(r.choice(list("abc "), n)) for n in (r.integers(1, 90), r.integers(0, 60)))
        best, end = decontaminate.myers(decontaminate.masks(a), len(a), b)
        assert best == edit(a, b) and 0 <= end <= len(b)


def test_decontamination(spark, odd, none):
    items = [(k, prose(30, 500 + k)) for k in range(6)] + [(6, None), (7, "short"), (8, "")]
    item = items[0][1]
    changed = item[:20] + "x" + item[20:60] + item[62:]
    far = " ".join(w[::-1] for w in item.split())
    texts = [prose(80, 1) + " " + item.upper() + ". " + prose(20, 2), changed, far, prose(200, 3), items[1][1] + "\n" + items[2][1]]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.matches(docs, bench).collect()}
    assert got == {(0, 0): 0, (1, 0): 3, (4, 1): 0, (4, 2): 0}
    for (d, i), n in got.items():
        assert edit(decontaminate.normal(items[i][1]), decontaminate.normal(texts[d])) == n
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, bench).collect()) == [2, 3]
    old, decontaminate.BLOCK_CHARS = decontaminate.BLOCK_CHARS, 300
    try:
        assert decontaminate.matches(docs, bench).count() == 4
    finally:
        decontaminate.BLOCK_CHARS = old
    assert decontaminate.clean(odd, bench).count() == len(ODD) and decontaminate.matches(none, bench).count() == 0 and decontaminate.matches(docs, bench.limit(0)).count() == 0


def test_short_items_are_matched_exactly(spark):
    chinese = "水在标准大气压下的沸点是多少摄氏度"
    bench = spark.createDataFrame([(0, "Who wrote Hamlet?"), (1, "a[i] += b[i]*2"), (2, chinese), (3, "+-*/"), (4, None), (5, " ")], "item_id long, text string")
    texts = ["He asked: who  wrote\nHAMLET, then left", "for i: A[i] +=  b[i]*2;", "问题。" + chinese + "呢", "signs +-*/ here", "who wrote hamlets", "a i b i 2", "data[i] += b[i]*2", "nothing"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.matches(docs, bench).collect()}
    assert set(got) == {(0, 0), (1, 1), (2, 2), (3, 3)} and all(r["distance"] == 0 for r in got.values())
    for (d, i), r in got.items():
        assert decontaminate.normal(texts[d])[r["start"] : r["end"]] == decontaminate.normal(bench.where(f"item_id = {i}").first()["text"])
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, bench).collect()) == [4, 5, 6, 7]


# ------------------------------------------------------------------ 9 near duplicates


def test_minhash_brute_force(spark):
    r = np.random.default_rng(10)
    texts = list(ODD)
    for k in range(25):
        words = prose(int(r.integers(20, 120)), 700 + k).split()
        for _ in range(4):
            w = list(words)
            for _ in range(int(r.integers(0, 6))):
                w[int(r.integers(len(w)))] = "new" + str(r.integers(1000))
            texts.append(" ".join(w))
    hub = prose(100, 999).split()  # one large group of near copies
    for k in range(80):
        w = list(hub)
        for j in r.choice(100, 6, replace=False):
            w[j] = f"h{k}{j}"
        texts.append(" ".join(w))

    def sets(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 2]) for i in range(len(w) - 1)} or ({tuple(w)} if w else set())

    s = [sets(t) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(range(len(texts)), 2):
        i = len(s[a] & s[b])
        if s[a] and s[b] and 100 * i >= 80 * (len(s[a]) + len(s[b]) - i):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    for options in ({}, {"small": 4, "block": 8, "pivots": 1}):
        got = {x["doc_id"]: x for x in minhash.near_duplicates(df, **options).collect()}
        assert [got[k]["component_id"] for k in range(len(texts))] == [find(k) for k in range(len(texts))]
        assert [got[k]["n_shingles"] for k in range(len(texts))] == [len(x) for x in s]


def test_minhash_odd(odd, none):
    got = {r["doc_id"]: r for r in minhash.near_duplicates(odd).collect()}
    assert [got[k]["kept"] for k in range(8)] == [True] * 7 + [False] and got[0]["n_shingles"] == 0
    assert minhash.near_duplicates(none).count() == 0


# ------------------------------------------------------------------ 10 toxicity


def test_kernel_counts_gapped_subsequences():
    def direct(a, b):
        def features(w):
            w = [63, *w, 63]
            out = {}
            for i in range(len(w)):
                for j in range(i + 1, len(w)):
                    for k in range(j + 1, min(len(w), i + toxicity.REACH)):
                        u = (w[i], w[j], w[k])
                        out.setdefault(u, []).append(toxicity.DECAY ** (k - i + 1))
            n = np.sqrt(sum(x * x for v in out.values() for x in v)) or 1
            return {u: sum(v) / n for u, v in out.items()}

        x, y = features(a), features(b)
        return sum(v * y.get(u, 0) for u, v in x.items())

    words = [bytes(c - 96 for c in w.encode()) for w in ("stupid", "stuxpid", "other", "ab", "banana")]
    e = toxicity._explicit(words)
    got = toxicity._kernel(e, e)
    assert np.allclose(got, [[direct(a, b) for b in words] for a in words])
    assert got[0, 1] > 0.4 > got[0, 2]


def test_words_lose_signs_and_join_letters():
    raw = "St-u.pid! s t u p i d a b 1d10t".encode()
    letters, bounds, first, _ = toxicity.word_letters(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    spelled = ["".join(chr(96 + c) for c in letters[a:b]) for a, b in zip(bounds, bounds[1:])]
    assert spelled == ["stupid", "stupidab", "idiot"] and list(first) == [0, 3]


def test_sentences_end_at_stops_lines_and_after_forty_words():
    texts = ["one two. three 4.5 four!  five\nsix", "", "seven eight", "w " * 2 + "xy " * 90]
    raw = "".join(texts).encode()
    off = np.cumsum([0, *(len(t.encode()) for t in texts)])
    _, _, first, sentence = toxicity.word_letters(np.frombuffer(raw, np.uint8), off)
    parts = [np.unique(sentence[a:b], return_counts=True)[1].tolist() for a, b in zip(first, first[1:])]
    assert parts == [[2, 3, 1, 1], [], [2], [40, 40, 12]] and (np.diff(sentence) >= 0).all()


def test_kernel_of_sentences():
    """Against sums over all pairs of words and of neighbouring words; the matrix of any sentences is positive."""
    spell = lambda t: tuple(bytes(c - 96 for c in w.encode()) for w in t.split())
    one = lambda a, b: float(toxicity._kernel(toxicity._explicit([a]), toxicity._explicit([b]))[0, 0])

    def direct(s, t):
        both = sum(one(a, c) * one(b, d) for a, b in zip(s, s[1:]) for c, d in zip(t, t[1:]))
        return sum(one(a, c) for a in s for c in t) + both

    marks = [spell(x) for x in ("rotten fish", "fish", "other banana", "ab", "rotten rotten")]
    sentences = [spell(x) for x in ("a rotten fish today", "fish rotten", "ab", "nothing like it", "rotten rotten fish banana fish")] + marks
    assert np.allclose(toxicity.Marks(marks).kernel(sentences), [[direct(s, m) for m in marks] for s in sentences])
    square = toxicity.Marks(marks).kernel(marks)
    assert np.allclose(square, square.T) and np.linalg.eigvalsh(square).min() > -1e-9


def test_two_harmless_words_that_are_an_insult_together(spark):
    """Either word stands in as many clean documents as toxic ones; only the two in a row are toxic."""
    rows = []
    for k in range(400):
        toxic = k % 2
        w = prose(40, k).split()
        w[5], w[20] = ("gutter", "snipe")[k % 4 // 2], ("snipe", "gutter")[k % 4 // 2]
        if toxic:
            w[10:12] = ["gutter", "snipe"]
        rows.append((k, " ".join(w) + ". " + prose(20, 5000 + k), toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs, docs)
    tests = ["gutter " + prose(30, 9000) + " snipe", prose(10, 9001) + " gutter snipe " + prose(10, 9002), prose(10, 9001) + " gut-ter Snipe! " + prose(10, 9002), prose(50, 9003), "snipe gutter " + prose(10, 9004)]
    got = {r["doc_id"]: r["score"] for r in toxicity.predict(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), model).collect()}
    assert got[1] > 0.7 and got[2] > 0.7 and max(got[0], got[3], got[4]) < 0.5, got


def test_toxicity_learns_insults_and_their_variants(spark, odd, none):
    rows = []
    for k in range(240):
        toxic = k % 3 == 0
        w = prose(40, k).split()
        if toxic:
            for _ in range(3):
                w[k % 37] = ("grumblekin", "vexhollow")[k % 2]
        rows.append((k, " ".join(w) + ". " + prose(20, 5000 + k), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    tests = spark.createDataFrame([(0, prose(30, 9000) + " grumblekin"), (1, prose(30, 9001) + " grum-blexkin " + prose(5, 9002)), (2, prose(60, 9003)), (3, "v e x h o l l o w " + prose(9, 9004))], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.predict(tests, model).collect()}
    assert got[0] > 0.7 and got[1] > 0.7 and got[3] > 0.7 and got[2] < 0.5
    assert [r["doc_id"] for r in toxicity.keep_below(tests, model, 0.7).collect()] == [2]
    assert toxicity.predict(odd, model).count() == len(ODD) and toxicity.predict(none, model).count() == 0
    assert toxicity.train(docs, docs.select("doc_id", "toxic").where("toxic = 1")) is None
    assert {r["score"] for r in toxicity.predict(odd, None).collect()} == {0.0}


def test_every_repeat_of_fifty_words_is_found(spark):
    """On a whole table: each run of 50 words that stands in a document with a smaller id is inside a passage that is found, but for a few words at its ends."""
    import re

    folder = "/root/testdata/sf0.01"
    found = {}
    for r in queries.QUERIES["op7_substring"](spark, folder).collect():
        found.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"]))
    lower = {k: k + 32 for k in range(65, 91)}
    seen = {}
    for r in C.read(spark, folder, "documents").orderBy("doc_id").select("doc_id", "text").collect():
        w = re.findall(r"[^\x20\x09-\x0d]+", (r["text"] or "").translate(lower))
        runs = {tuple(w[k : k + 50]): k for k in range(len(w) - 49)}
        for run, k in runs.items():
            if seen.get(run, r["doc_id"]) != r["doc_id"]:
                assert any(a <= k + 5 and k + 45 <= b for a, b in found.get(r["doc_id"], ())), (r["doc_id"], k)
        for run in runs:
            seen.setdefault(run, r["doc_id"])
