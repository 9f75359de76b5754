"""Packing documents into sequences, shortest pack first over the length histogram.

Only the histogram of piece lengths (at most one entry for each length) comes to the driver.
Lengths are placed longest first, all pieces of a length at once, each time into the pattern with
the most room; what comes out is a list of patterns and how often each is used. Pieces then find
their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from knotwork.llm import common as C

#: White-space separated parts, and words in them, that a worker keeps the ids of. One that is not kept is encoded anew.
CACHE_PARTS, CACHE_WORDS = 250_000, 180_000
#: Texts without these characters are composed already, lower-cased alike by Python and the
#: tokenizer, and cut by _WORDS as by the tokenizer's own pattern: Latin letters up to U+024F but
#: dotted I, no fractions and superscripts, no separators U+001C to U+001F.
_UNUSUAL = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0130\u0250-\U0010ffff]")
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


class _Words(dict):
    """Ids of words that are lower-cased and cut already: what is left of the tokenizer for them is its merges."""

    def __init__(self, model):
        self.tokenize = model.tokenize
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # the letter that stands for each byte, learnt from characters of one and two bytes
        self.letters = {}
        for cp in range(0x250):
            raw = chr(cp).encode()
            self.letters.update(zip(raw, level.pre_tokenize_str(chr(cp))[0][0]))

    def __missing__(self, word: str) -> bytes:
        spelled = word if word.isascii() and word.isalnum() else word.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.tokenize(spelled)]
        out = self[word] = struct.pack(f"<{len(ids)}I", *ids)
        return out


class _Parts(dict):
    """Ids of white-space separated parts."""

    def __init__(self, words: _Words):
        self.words = words

    def __missing__(self, part: str) -> bytes:
        words = self.words
        out = self[part] = words[part] if part.isalpha() else b"".join([words[w] for w in _WORDS.findall(part)])
        return out


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker on each core
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    words = _Words(t.model)
    # White space as the tokenizer's own pattern has it; no token crosses it.
    return t, regex.compile(r"[^\p{White_Space}]+"), words, _Parts(words), {}


def encode(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers.

    The tokenizer lower-cases, drops white space and merges inside words only, so a text's ids are
    those of its white-space separated parts, and theirs those of their words. Both repeat, and
    each is encoded once while a cache holds it. Texts with unusual characters are cut at white
    space only, and those parts are left to the tokenizer.
    """
    t, chunks, words, parts, odd = _tokenizer(path)
    out: list[bytes] = []
    for x in texts:
        if not _UNUSUAL.search(x):
            out.append(b"".join(map(parts.__getitem__, x.lower().split())))
            continue
        split = chunks.findall(x)
        new = list({p for p in split if p not in odd})
        odd |= {p: np.array(e.ids, "<u4").tobytes() for p, e in zip(new, t.encode_batch(new, add_special_tokens=False))}
        out.append(b"".join(map(odd.__getitem__, split)))
    for known, most in ((words, CACHE_WORDS), (parts, CACHE_PARTS), (odd, CACHE_WORDS)):
        if len(known) > most:
            known.clear()
    return out


@lru_cache(maxsize=2)
def _added(path: str):
    """A pattern of the tokenizer's added tokens, in any case."""
    added = [re.escape(a.content) for a in _tokenizer(path)[0].get_added_tokens_decoder().values()]
    return re.compile("|".join(added), re.IGNORECASE) if added else None


def contract_ids(texts: list[str], path: str) -> list[bytes]:
    """encode(), but a text that holds an added token's string goes to the tokenizer whole, with default settings, so the string is that token."""
    out = encode(texts, path)
    t, added = _tokenizer(path)[0], _added(path)
    special = [k for k, x in enumerate(texts) if added.search(x)] if added else []
    if special:
        t.encode_special_tokens = False  # for these only: a second tokenizer would double its memory
        try:
            for k in special:
                out[k] = np.array(t.encode(texts[k], add_special_tokens=False).ids, "<u4").tobytes()
        finally:
            t.encode_special_tokens = True
    return out


def pieces(docs: DataFrame, *, tokenizer: str, end_id: int = 2, most: int = 4096, keep_ids: bool = False) -> DataFrame:
    """Each document's ids and `end_id`, cut into pieces of `most` ids and a rest.

    Returns doc_id, start, length, ids_crc32, doc_tokens, and with keep_ids the ids as binary. A
    null or empty text is one piece that holds `end_id` alone.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        for batch in C.small(batches):
            texts = ["" if x is None else x for x in batch.column("text").to_pylist()]
            ids = batch.column("doc_id").to_pylist()
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size + len(texts[stop]) < 2 << 20):
                    size += len(texts[stop])
                    stop += 1
                out: list[list] = [[] for _ in range(5 + keep_ids)]
                for d, raw in zip(ids[at:stop], contract_ids(texts[at:stop], tokenizer)):
                    raw += tail
                    n = len(raw) // 4
                    for s in range(0, n, most):
                        piece = raw[4 * s : 4 * (s + most)]
                        for column, v in zip(out, (d, s, len(piece) // 4, zlib.crc32(piece), n, piece)):
                            column.append(v)
                at = stop
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64()] * 5 + [pa.binary()])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(out)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def shortest_pack_first(histogram: dict[int, int], most: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, longest first, with a sum of at most `most`) and how often each is used.

    The lengths go longest first. The pieces of one length go to the patterns with the smallest sum
    so far, one piece to a pack, as long as they fit; a pattern of which only some packs get a
    piece is split. The rest open new packs.
    """
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    sums: list[int] = []

    def put(total: int, pattern: tuple[int, ...], count: int) -> None:
        if total not in open_:
            bisect.insort(sums, total)
            open_[total] = []
        open_[total].append((pattern, count))

    for length in sorted((k for k, v in histogram.items() if v), reverse=True):
        left = histogram[length]
        while left:
            if sums and sums[0] + length <= most:
                total = sums[0]
                pattern, count = open_[total].pop()
                if not open_[total]:
                    del open_[total], sums[0]
                used = min(left, count)
                if count > used:
                    put(total, pattern, count - used)
                put(total + length, (*pattern, length), used)
                left -= used
            else:
                fit = most // length  # as many of one length as a pack holds
                full, rest = divmod(left, fit)
                if full:
                    put(fit * length, (length,) * fit, full)
                if rest:
                    put(rest * length, (length,) * rest, 1)
                left = 0
    return [x for total in sums for x in open_[total]]


def place(cut_pieces: DataFrame, *, most: int = 4096, group: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, ...).

    A piece's rank among those of its length is its rank among those that also share a salt of its
    hash, plus the pieces of smaller salts: a window holds about `group` rows at most, however
    common a length is.
    """
    counted = cut_pieces.groupBy("length").count().collect()  # at most `most` rows
    total = sum(r["count"] for r in counted)
    salts = max(1, -(-total // group))
    patterns = shortest_pack_first({r["length"]: r["count"] for r in counted}, most)
    slots: dict[int, list[tuple[int, int, int]]] = {}  # length -> (pieces in this slot, first sequence, offset)
    sequence = 0
    for lengths, count in patterns:
        offset = 0
        for n in lengths:
            slots.setdefault(n, []).append((count, sequence, offset))
            offset += n
        sequence += count
    look = {}
    for n, rows in slots.items():
        a = np.array(rows, np.int64)
        look[n] = (np.concatenate(([0], np.cumsum(a[:, 0]))), a[:, 1], a[:, 2])

    salted = cut_pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    before = salted.groupBy("length", "__salt").count()
    before = before.withColumn("__before", F.sum("count").over(Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "__salt", F.coalesce("__before", F.lit(0)).alias("__before"))
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "start", "ids_crc32"))).join(before, ["length", "__salt"])
    ranked = ranked.select(*cut_pieces.columns, (F.col("__before") + F.col("__rank") - 1).alias("__rank"))

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "__rank"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                m = np.flatnonzero(length == n)
                bounds, first, offset = look[int(n)]
                k = np.searchsorted(bounds, rank[m], "right") - 1
                seq[m], off[m] = first[k] + rank[m] - bounds[k], offset[k]
            keep = [c for c in batch.schema.names if c != "__rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(seq), pa.array(off)], [*keep, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_pieces.schema.fields) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, *, tokenizer: str, end_id: int = 2, most: int = 4096, keep_ids: bool = False) -> DataFrame:
    """Packs docs (doc_id long, text; others are ignored) into sequences of at most `most` tokens.

    Returns one row for each piece: doc_id, start (ids of its document before it), length,
    ids_crc32, doc_tokens, with keep_ids also ids, then sequence_id and offset (its place there,
    gapless from 0). Every id is in exactly one piece. Null texts are packed as empty ones,
    repeated documents as often as they come. An empty table gives an empty result.
    """
    return place(C.cut(pieces(docs, tokenizer=tokenizer, end_id=end_id, most=most, keep_ids=keep_ids)), most=most)


def op6_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    out = pack(C.read(spark, sf_dir, "documents"), tokenizer=tokenizer or public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
