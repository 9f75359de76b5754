"""Benchmark decontamination by pigeonhole edit matching.

With at most k edits against k + 1 pieces of a test item, one piece is left whole. Pieces are found
exactly, all at once, by an Aho-Corasick automaton; each hit is verified by Myers' bit-parallel
edit distance on the text around it.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import common as C

_WORD = re.compile(r"[^\W_]+")
_SIGN = re.compile(r"[^\w\s.,;:!?'\"()\u2018-\u201f\u3001\u3002\uff01\uff0c\uff1f-]|_|(?<=\d)[^\w\s]+(?=\d)|(?<!\w)-")

#: Characters of test items whose automaton a task holds at once; more items are taken in blocks.
BLOCK_CHARS = 4 << 20

_SCHEMA = "doc_id long, item_id long, start long, end long, distance long, n_chars long"


def normal(text: str | None) -> str:
    """Lower case, words (letters and digits) with one space between."""
    return " ".join(_WORD.findall(text.lower())) if text else ""


def spaced(text: str | None) -> str:
    """Lower case with all signs, one space for each white space."""
    return " ".join(text.lower().split()) if text else ""


def prepared(text: str, least: int) -> tuple[str, str]:
    """How an item is matched, and as what: "edits"; with fewer than `least` characters "words", exactly; "signs", exactly and with its signs, where it has others than those of sentences or no word."""
    t, raw = normal(text), spaced(text)
    if len(t) >= least:
        return "edits", t
    return ("words", t) if t and not _SIGN.search(raw) else ("signs", raw)


def apart(text: str, start: int, end: int) -> bool:
    """Whether no word goes on over either end. Scripts without spaces (from Thai on) have no such ends."""
    part = lambda c: c.isalnum() and c < "\u0e00"
    return not (start and part(text[start - 1]) and part(text[start])) and not (end < len(text) and part(text[end - 1]) and part(text[end]))


def budget(n: int, rate: float) -> int:
    return int(n * rate)


def split(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces with nearly equal lengths, and where each starts. An item with fewer characters than that gives one a character."""
    parts = min(k + 1, len(item))
    ends = [len(item) * j // parts for j in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:])]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for j, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << j
    return out


def myers(eq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Smallest edit distance of the item to any substring of text, and the (last) position after such a substring."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for at, c in enumerate(text, 1):
        e = eq.get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score <= best:
            best, end = score, at
    return best, end


def _automaton(entries: dict[str, list]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for piece, where in entries.items():
        automaton.add_word(piece, (len(piece), where))
    automaton.make_automaton()
    return automaton


def _finder(items: list[tuple[int, str, str]], rate: float):
    entries: dict[str, list[tuple[int, int]]] = {}
    signs: dict[str, list[int]] = {}
    facts = []
    for n, (_, kind, text) in enumerate(items):
        k = budget(len(text), rate) if kind == "edits" else 0
        facts.append((len(text), k, masks(text), masks(text[::-1])) if kind == "edits" else None)
        if kind == "signs":
            signs.setdefault(text, []).append(n)
            continue
        for at, piece in split(text, k):
            entries.setdefault(piece, []).append((n, at))
    automaton = _automaton(entries) if entries else None
    signed = _automaton(signs) if signs else None

    def find(document: str | None):
        """(item, start, end, distance) of each place, on the normalised text."""
        text = normal(document)
        done: dict[int, int] = {}  # item -> up to where its hits need no second look
        for last, (size, where) in automaton.iter(text) if automaton else ():
            begin = last + 1 - size
            for n, at in where:
                if done.get(n, -1) >= begin:
                    continue
                if facts[n] is None:
                    if apart(text, begin, last + 1):
                        yield n, begin, last + 1, 0
                        done[n] = last
                    continue
                m, k, eq, back = facts[n]
                lo = max(0, begin - at - k)
                window = text[lo : begin - at + m + k]
                best, end = myers(eq, m, window)
                if best <= k:
                    stop = lo + end
                    turned = text[max(0, stop - m - k) : stop][::-1]
                    _, length = myers(back, m, turned)
                    yield n, stop - length, stop, best
                    done[n] = stop - 1
        raw = spaced(document) if signed else ""
        for last, (size, where) in signed.iter(raw) if signed else ():
            begin = last + 1 - size
            if apart(raw, begin, last + 1):
                stop = len(normal(raw[: last + 1]))
                for n in where:
                    if done.get(n, -1) < begin:
                        yield n, stop - len(normal(raw[begin : last + 1])), stop, 0
                        done[n] = last

    return find


def _blocks(items: DataFrame, least: int):
    """Test items (item_id, how they are matched, as what), collected block by block; a block has about BLOCK_CHARS characters."""
    sized = items.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = sized.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))
    for b in range(blocks):
        mine = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        if block := sorted({(r["item_id"], *p) for r in mine if (p := prepared(r["text"], least))[1]}, key=str):
            yield block


def matches(docs: DataFrame, items: DataFrame, *, rate: float = 0.07, least: int = 40) -> DataFrame:
    """Every place where a document holds a test item with at most rate * length edits.

    docs: doc_id, text; items: item_id, text; other columns are ignored. Both texts are compared as
    lower-case words with one space between. Items shorter than `least` characters then
    are matched exactly and not inside longer words, with all their signs where they have others
    than those of sentences. Null and empty items are left out. Returns doc_id, item_id, start and end (in the
    normalised document), distance and n_chars (of the item), one row for each place; places of one
    item do not overlap by more than an edit budget. Null and empty documents match nothing.
    Repeated rows match as often as they come. Long texts are searched as a whole. Empty tables
    give an empty result.

    Items are collected in blocks of BLOCK_CHARS characters, and each block's automaton is matched
    against all documents; nothing of the documents is collected.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in _blocks(items, least):

        def run(batches, block=block):
            find = _finder(block, rate)
            sizes = [len(normal(text)) for _, _, text in block]
            for batch in C.small(batches):
                rows: list[tuple] = []
                for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                    rows += [(d, block[n][0], a, e, x, sizes[n]) for n, a, e, x in find(text.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], ["doc_id", "item_id", "start", "end", "distance", "n_chars"])

        found = src.mapInArrow(run, _SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], _SCHEMA)


def clean(docs: DataFrame, items: DataFrame, *, rate: float = 0.07, least: int = 40) -> DataFrame:
    """The documents that hold no test item (as matches() finds them), with all their columns. They are filtered where they are read."""
    for block in _blocks(items, least):

        def run(batches, block=block):
            find = _finder(block, rate)
            for batch in C.small(batches):
                keep = [next(find(text.as_py()), None) is None for text in batch.column("text")]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = C.map_rows(docs, run)
    return docs


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "benchmark"))
