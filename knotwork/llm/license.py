"""License scans by an exact set-similarity join.

License templates and text blocks are sets of words. A block is any stretch of a text's words that
is a quarter longer than the template, wherever lines end. Tokens are ordered by their frequency in
the whole corpus, rarest first. A block can hold the share `threshold` of a template only if it has
one of the template's first tokens in that order (prefix), enough tokens (length), and enough
tokens after the first one that they share (position). What passes is verified on the words.
"""

from __future__ import annotations

import math
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import common as C

#: label -> phrase: a place is where its words stand consecutively.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: (label, text) of short license notices.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License"),
    ("mit-notice", "Released under the MIT License."),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mit-permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("no-warranty", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
]


def read_templates(folder: str) -> list[tuple[str, str]]:
    """(label, text) of every file in a folder of license texts, such as those that a system keeps of the licenses of its packages; the label is the file's name without its ending."""
    out = []
    for name in sorted(os.listdir(folder)):
        if os.path.isfile(path := os.path.join(folder, name)):
            with open(path, encoding="utf-8", errors="replace") as f:
                out.append((os.path.splitext(name)[0] if name.endswith((".txt", ".md")) else name, f.read()))
    return out


def stretch(words: int) -> int:
    """Words of a block for a template of so many words."""
    return words + words // 4


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _spelled(text: str) -> list[tuple[int, bytes]]:
    """Hash and bytes of each word."""
    data = C.LOWER[np.frombuffer(text.encode(), np.uint8)]
    h, s, e, _ = C.words(data, np.array([0, len(data)]), C.ALNUM)
    return [(int(x), data[a:b].tobytes()) for x, a, b in zip(h, s, e)]


def _each(batch: pa.RecordBatch):
    """Runs of texts: index of the first, number, words (hash, start, end, first of each text), bytes, offsets."""
    data, off = C.flat(batch.column("text"))
    for a, b in C.runs(off):
        part = C.LOWER[data[off[a] : off[b]]]
        yield a, b - a, C.words(part, off[a : b + 1] - off[a], C.ALNUM), part, off[a : b + 1] - off[a]


def frequencies(docs: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """How often each word of the templates stands in the corpus; words are summed in each task before the shuffle."""
    vocab = np.sort(vocabulary)

    def run(batches):
        total = np.zeros(len(vocab), np.int64)
        for batch in batches:
            for _, _, (h, _, _, _), _, _ in _each(batch):
                at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
                total += np.bincount(at[vocab[at] == h], minlength=len(vocab))
        yield pa.RecordBatch.from_arrays([pa.array(C.signed(vocab)), pa.array(total)], ["h", "c"])

    rows = docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).collect()
    found = {r["h"]: r["c"] for r in rows}
    return {int(v): found.get(int(s), 0) for v, s in zip(vocab, C.signed(vocab))}


def most_in_a_stretch(place: np.ndarray, token: np.ndarray, width: int) -> int:
    """The most different tokens that stand in `width` neighbouring places. place: ascending."""
    have: dict[int, int] = {}
    best = end = 0
    p, t = place.tolist(), token.tolist()
    for begin in range(len(p)):
        while end < len(p) and p[end] < p[begin] + width:
            have[t[end]] = have.get(t[end], 0) + 1
            end += 1
        best = max(best, len(have))
        have[t[begin]] -= 1
        if not have[t[begin]]:
            del have[t[begin]]
    return best


def scan(docs: DataFrame, *, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = 0.8) -> DataFrame:
    """License labels of each document.

    docs: doc_id (long) and text; other columns are ignored. A-Z is lower-cased; words are runs of
    digits, letters and non-ASCII bytes. A template of n words is found where n + n // 4 words in
    a row, over the ends of lines, hold at least `threshold` of its distinct words. Returns doc_id,
    n_words, n_base (places of phrases), first_word and last_word (start of the first and last such
    place, else null), base_labels, labels (phrases' and templates'), score (the largest share of a
    template that reaches the threshold, else 0). A null or empty text has no words and no labels.
    A template without words is found nowhere. Repeated rows give repeated results; an empty table
    an empty one; a long text is worked on as a whole.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    read = [(label, _spelled(text)) for label, text in templates]
    read = [(label, w) for label, w in read if w]
    count = frequencies(src, np.unique(np.array([h for _, w in read for h, _ in w], np.uint64))) if read else {}
    order = {h: n for n, h in enumerate(sorted(count, key=lambda h: (count[h], h)))}
    spelling = {order[h]: raw for _, w in read for h, raw in w}
    ranked = [(label, sorted({order[h] for h, _ in w}), stretch(len(w))) for label, w in read]
    index: dict[int, list[tuple[int, int]]] = {}
    need = []
    member = np.zeros((len(ranked), max(len(order), 1)), bool)
    for t, (_, tokens, _) in enumerate(ranked):
        need.append(max(1, math.ceil(threshold * len(tokens) - 1e-9)))
        member[t, tokens] = True
        for i in range(len(tokens) - need[t] + 1):  # one of these is in every block that holds enough
            index.setdefault(tokens[i], []).append((t, i))
    known = np.array(sorted(order), np.uint64) if order else np.zeros(1, np.uint64)
    rank = np.array([order[int(h)] for h in known]) if order else np.array([-1])
    leading = np.zeros(max(len(order), 1), bool)
    leading[list(index)] = True
    spelled = [(label, _spelled(p)) for label, p in phrases.items()]

    def templates_in(place: np.ndarray, token: np.ndarray, same):
        """(template, share) of a text given by the places and ranks of its words that templates have; same(k): whether the words k are spelled like the template's."""
        lead: dict[int, list[int]] = {}
        first: dict[int, int] = {}
        for k in np.flatnonzero(leading[token]).tolist():
            for t, i in index[int(token[k])]:
                lead.setdefault(t, []).append(int(place[k]))
                first[t] = min(first.get(t, i), i)
        for t, at in lead.items():
            _, tokens, width = ranked[t]
            mine = np.flatnonzero(member[t][token])
            spots = np.array(at)
            near = np.searchsorted(spots, place[mine] + width) > np.searchsorted(spots, place[mine] - width, "right")  # within a block of a prefix token
            mine = mine[near]
            # length: enough different tokens at all; position: enough of them from the first shared one on
            if len(np.unique(token[mine])) < need[t] or len(tokens) - first[t] < need[t]:
                continue
            mine = mine[same(mine)]
            if (most := most_in_a_stretch(place[mine], token[mine], width)) >= need[t]:
                yield t, most / len(tokens)

    def run(batches):
        for batch in C.small(batches):
            n = batch.num_rows
            n_words, n_base, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            first, last = [None] * n, [None] * n
            base: dict[int, set] = {}
            more: dict[int, set] = {}
            for a, many, (h, s, e, begin), data, off in _each(batch):
                n_words[a : a + many] = np.diff(begin)
                doc = lambda w: np.searchsorted(begin, w, "right") - 1
                for label, p in spelled:
                    at = np.flatnonzero(h[: max(0, len(h) - len(p) + 1)] == np.uint64(p[0][0]))
                    for k in range(1, len(p)):
                        at = at[h[at + k] == np.uint64(p[k][0])]
                    at = at[doc(at) == doc(at + len(p) - 1)] if len(at) else at
                    for w in at.tolist():
                        if any(data[s[w + k] : e[w + k]].tobytes() != raw for k, (_, raw) in enumerate(p)):
                            continue
                        d = int(doc(w))
                        x, place = a + d, w - int(begin[d])
                        n_base[x] += 1
                        first[x] = place if first[x] is None else min(first[x], place)
                        last[x] = place if last[x] is None else max(last[x], place)
                        base.setdefault(x, set()).add(label)
                if not order:
                    continue
                k = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = np.flatnonzero(known[k] == h)
                ranks = rank[k[hit]]
                bounds = np.searchsorted(hit, begin)
                for d in np.unique(doc(hit[leading[ranks]])).tolist():
                    mine, token = hit[bounds[d] : bounds[d + 1]], ranks[bounds[d] : bounds[d + 1]]
                    same = lambda z, mine=mine, token=token: np.array([data[s[mine[v]] : e[mine[v]]].tobytes() == spelling[int(token[v])] for v in z], bool)
                    for t, share in templates_in(mine - begin[d], token, same):
                        more.setdefault(a + d, set()).add(ranked[t][0])
                        score[a + d] = max(score[a + d], share)
            join = lambda *sets: ",".join(sorted(set().union(*sets), key=lambda v: v.encode()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words), pa.array(n_base), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array([join(base.get(x, ())) for x in range(n)], pa.string()), pa.array([join(base.get(x, ()), more.get(x, ())) for x in range(n)], pa.string()), pa.array(score)],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return src.mapInArrow(run, _SCHEMA)


def op2_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(C.read(spark, sf_dir, "documents"))


def _sql() -> str:
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    templates = ", ".join(f"('{label}', '{text}')" for label, text in TEMPLATES)
    phrases = ", ".join(f"('{label}', {p.split()!r})" for label, p in PHRASES.items())
    return f"""
WITH d AS (SELECT doc_id, {lower.format('text')} AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS ws FROM d),
p(label, words) AS (VALUES {phrases}),
place AS (
  SELECT doc_id, label, i FROM (SELECT doc_id, label, words, ws, unnest(range(0, len(ws))) AS i FROM w, p)
  WHERE ws[i + 1 : i + len(words)] = words
), base AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_distinct(list(label)) AS base FROM place GROUP BY 1
), tt(label, t) AS (VALUES {templates}),
tl AS (SELECT label, regexp_extract_all({lower.format('t')}, '{pattern}') AS l FROM tt),
tw AS (SELECT DISTINCT label, unnest(l) AS word FROM tl),
size AS (SELECT label, count(*) AS n, ceil(0.8 * count(*) - 1e-9) AS need FROM tw GROUP BY 1),
width AS (SELECT label, len(l) + len(l) // 4 AS width FROM tl),
dw AS (SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS i FROM w),
hit AS (SELECT doc_id, label, word, i FROM dw JOIN tw USING (word)),
enough AS (SELECT doc_id, label FROM hit JOIN size USING (label) GROUP BY 1, 2 HAVING count(DISTINCT word) >= any_value(need)),
near AS (SELECT * FROM hit SEMI JOIN enough USING (doc_id, label)),
block AS (
  SELECT a.doc_id, a.label, a.i, count(DISTINCT b.word) AS c FROM near a JOIN width USING (label)
  JOIN near b ON b.doc_id = a.doc_id AND b.label = a.label AND b.i >= a.i AND b.i < a.i + width GROUP BY 1, 2, 3
), found AS (SELECT doc_id, label, max(c / n) AS share FROM block JOIN size USING (label) WHERE c >= need GROUP BY 1, 2),
tmpl AS (SELECT doc_id, list(label) AS ls, max(share) AS score FROM found GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(ls, [])))), ','), '') AS labels,
  coalesce(score, 0)::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN tmpl USING (doc_id)
"""


SQL = _sql()
