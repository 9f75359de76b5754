"""Toxicity: a support vector machine on a subsequence string kernel with Nystrom landmarks.

The kernel of two words counts their common subsequences of three letters, each weighted down with
the letters it skips, so that inserted and left-out letters change it little. The kernel of two
sentences sums it over all pairs of their words, and sums the product of two words' kernels over all
pairs of neighbouring words, so that two words can be an insult which each of them is not.

Training takes sentences and stretches of them from labelled documents. The landmarks are short
sentences. What the machine expands in single words is collapsed to one weight a subsequence, so a
word is scored without a look at the landmarks; those of two words stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import common as C
from knotwork.llm.quality import labelled_sample

DECAY = 0.6
REACH = 6  # letters that a subsequence of three may span
FIRM = 0.8  # a word with this score or more is taken for an insult by itself
_PATTERNS = [(i, j) for j in range(2, REACH) for i in range(1, j)]
_CODES = 64**3

#: Digits and signs that stand for letters.
_STANDS_FOR = {b"0": b"o", b"1": b"i", b"3": b"e", b"4": b"a", b"5": b"s", b"7": b"t", b"@": b"a", b"$": b"s"}
_LETTER = np.zeros(256, np.int64)  # 0: no letter
for _b in range(97, 123):
    _LETTER[_b] = _LETTER[_b - 32] = _b - 96
for _b in range(48, 58):
    _LETTER[_b] = 27 + _b - 48
for _b in range(128, 256):
    _LETTER[_b] = 37 + _b % 26
for _k, _v in _STANDS_FOR.items():
    _LETTER[_k[0]] = _LETTER[_v[0]]
_EDGE = 63
_STOP = C.byte_table(lambda b: b in b".!?")
MOST_WORDS = 40  # a sentence without an end goes on in another one after so many words


def word_letters(data: np.ndarray, off: np.ndarray):
    """Letters of all words, one after the other; where each word starts (with the end); the index of each text's first word (with the end); the number of each word's sentence.

    Words stand between white space. What is no letter is left out of them, and three or more words
    of one letter in a row are taken together (s t u p i d). A sentence ends with its line, with a
    stop before white space, or after MOST_WORDS words.
    """
    letters = _LETTER[data]
    size = np.diff(off)
    text = np.repeat(np.arange(len(size)), size)
    space = ~C.NOT_SPACE[data]
    begins = np.zeros(len(data), bool)
    if len(data):
        begins[off[:-1][size > 0]] = True
        begins[1:] |= space[:-1]
    keep = np.flatnonzero(letters)
    if not len(keep):
        return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(len(size) + 1, np.int64), np.zeros(0, np.int64)
    chunk = np.cumsum(begins)[keep]  # white-space separated part that each letter stands in
    first = np.concatenate(([True], chunk[1:] != chunk[:-1]))
    starts = np.flatnonzero(first)
    owner = text[keep[starts]]
    lengths = np.diff(np.append(starts, len(keep)))
    single = lengths == 1
    joined = np.zeros(len(starts), bool)  # goes on from the word before
    if len(starts) > 2:
        run = single[1:] & single[:-1] & (owner[1:] == owner[:-1])
        edges = np.flatnonzero(np.diff(np.concatenate(([False], run, [False])).astype(np.int8)))
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a >= 2:
                joined[a + 1 : b + 1] = True
    starts, owner = starts[~joined], owner[~joined]
    mark = np.zeros(len(data) + 1, np.int64)  # 1 where another sentence begins
    mark[1:] = (data == 10) | _STOP[data] & np.append(space[1:], True)
    mark[off[:-1]] = 1
    number = np.cumsum(mark)[keep[starts]]
    new = np.concatenate(([True], number[1:] != number[:-1]))
    place = np.arange(len(number)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return letters[keep], np.append(starts, len(keep)), np.searchsorted(owner, np.arange(len(size) + 1)), np.cumsum(new | (place % MOST_WORDS == 0)) - 1


def framed(letters: np.ndarray, bounds: np.ndarray):
    """Words with an edge mark on both sides, and their bounds."""
    n = len(bounds) - 1
    size = np.diff(bounds)
    new = bounds + 2 * np.arange(n + 1)
    out = np.full(int(new[-1]) if n else 0, _EDGE, np.int64)
    out[np.arange(len(letters)) + 2 * np.repeat(np.arange(n), size) + 1] = letters
    return out, new


def subsequences(chars: np.ndarray, bounds: np.ndarray):
    """(word, code, weight) of every subsequence of three letters that spans at most REACH."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    room = bounds[1:][owner] - np.arange(len(chars))
    for i, j in _PATTERNS:
        at = np.flatnonzero(room > j)
        yield owner[at], chars[at] * 4096 + chars[at + i] * 64 + chars[at + j], DECAY ** (j + 1)


def norms(bounds: np.ndarray) -> np.ndarray:
    """Square root of the summed squared weights of each word's subsequences; 1 where there is none."""
    size = np.diff(bounds)
    total = sum(np.maximum(size - j, 0) * DECAY ** (2 * (j + 1)) for _, j in _PATTERNS)
    return np.sqrt(np.where(total > 0, total, 1))


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float, rounds: int = 60) -> np.ndarray:
    """Linear support vector machine with squared hinge loss, by Newton steps with line search. The last column of x is the bias."""
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], l2)
    reg[-1] = 1e-6

    def loss(v: np.ndarray) -> float:
        m = np.maximum(1 - y * (x @ v), 0)
        return 0.5 * float(reg @ (v * v) + weight @ (m * m))

    now = loss(w)
    for _ in range(rounds):
        m = 1 - y * (x @ w)
        inside = m > 0
        xs = x[inside] * weight[inside][:, None]
        gradient = reg * w - xs.T @ (y[inside] * m[inside])
        step = np.linalg.solve(xs.T @ x[inside] + np.diag(reg), -gradient)
        size = 1.0
        while (new := loss(w + size * step)) > now + 1e-4 * size * float(gradient @ step) and size > 1e-6:
            size /= 2
        w = w + size * step
        if now - new < 1e-7 * max(now, 1e-12):
            break
        now = new
    return w


class Marks:
    """Landmarks: sentences of one or two words."""

    def __init__(self, landmarks: list[tuple[bytes, ...]]):
        self.landmarks = landmarks
        self.words = sorted({w for m in landmarks for w in m})
        at = {w: k for k, w in enumerate(self.words)}
        self.explicit = _explicit(self.words)
        self.member = np.zeros((len(self.words), len(landmarks)))  # how often a word stands in a landmark
        for j, m in enumerate(landmarks):
            for w in m:
                self.member[at[w], j] += 1
        self.two = [j for j, m in enumerate(landmarks) if len(m) == 2]
        self.left, self.right = (np.array([at[landmarks[j][k]] for j in self.two], np.int64) for k in (0, 1))

    def pairs(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Products of word kernels with landmarks of two words, for neighbouring words given by their kernels with the landmarks' words."""
        return first[:, self.left] * second[:, self.right]

    def kernel(self, sentences: list[tuple[bytes, ...]]) -> np.ndarray:
        """Kernel of each sentence (its words, in order; not empty) with each landmark."""
        out = np.zeros((len(sentences), len(self.landmarks)))
        for a in range(0, len(sentences), 500):
            part = sentences[a : a + 500]
            names = sorted({w for s in part for w in s})
            at = {w: k for k, w in enumerate(names)}
            k = _kernel(_explicit(names), self.explicit)
            word = np.array([at[w] for s in part for w in s])
            size = np.array([len(s) for s in part])
            begin = np.cumsum(size) - size
            out[a : a + len(part)] = np.add.reduceat(k[word], begin, axis=0) @ self.member
            if self.two:
                same = np.delete(np.arange(len(word) - 1), begin[1:] - 1)  # a word and the next one, in one sentence
                if len(same):
                    owner = np.repeat(np.arange(len(part)), size)[same]
                    more = self.pairs(k[word[same]], k[word[same + 1]])
                    for n, j in enumerate(self.two):
                        out[a : a + len(part), j] += np.bincount(owner, weights=more[:, n], minlength=len(part))
        return out


class Model:
    """Weight of each subsequence, of each landmark of two words, bias, and the calibration of a document's score from its sentences."""

    def __init__(self, marks: Marks, alpha: np.ndarray, bias: float):
        table = np.zeros(_CODES)
        np.add.at(table, marks.explicit[1], (marks.member @ alpha)[marks.explicit[0]] * marks.explicit[2])
        self.weights, self.bias = table.astype(np.float32), bias
        self.marks, self.alpha = Marks([marks.landmarks[j] for j in marks.two]) if marks.two else None, alpha[marks.two]
        self.calibration = np.zeros(6)

    def words(self, letters: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Scores of words, each as a sentence of its own."""
        chars, new = framed(letters, bounds)
        out = np.zeros(len(bounds) - 1)
        for w, c, v in subsequences(chars, new):
            out += np.bincount(w, weights=self.weights[c], minlength=len(out)) * v
        return out / norms(new) + self.bias

    def documents(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(texts, 5): the largest score of a word or of two words that are an insult together (from -2 to 1.2), logs of one plus such stretches with a score above FIRM and above 0, and of one plus all words, and the largest score of a sentence (from -2 to 2)."""
        letters, bounds, first, sentence = word_letters(data, off)
        out = np.zeros((len(off) - 1, 5))
        out[:, 0] = out[:, 4] = -2.0
        if len(bounds) > 1:
            key = _word_keys(letters, bounds)
            _, where, back = np.unique(key, return_index=True, return_inverse=True)
            size = np.diff(bounds)[where]
            take = np.concatenate(([0], np.cumsum(size)))
            flat = letters[np.arange(take[-1]) - np.repeat(take[:-1] - bounds[:-1][where], size)]
            score = self.words(flat, take)[back]
            total = score - self.bias
            if self.marks:
                chars, new = framed(flat, take)
                k = _kernel(_framed_explicit(chars, new), self.marks.explicit)
                near = np.flatnonzero(sentence[1:] == sentence[:-1])
                live = near[(k[back[near]].max(axis=1) > 0.2) & (k[back[near + 1]].max(axis=1) > 0.2)]  # others add next to nothing
                more = self.marks.pairs(k[back[live]], k[back[live + 1]]) @ self.alpha
                total[live] += more
                both = score[live] + score[live + 1] - self.bias + more
                firm = more > 0.1
                score[live[firm]] = np.maximum(score[live[firm]], both[firm])
            full = np.flatnonzero(np.diff(first))
            begin = first[:-1][full]
            out[full, 0] = np.clip(np.maximum.reduceat(score, begin), -2.0, 1.2)
            out[full, 1] = np.log1p(np.add.reduceat((score > FIRM).astype(float), begin))
            out[full, 2] = np.log1p(np.add.reduceat((score > 0).astype(float), begin))
            out[:, 3] = np.log1p(np.diff(first))
            starts = np.flatnonzero(np.concatenate(([True], sentence[1:] != sentence[:-1])))
            whole = np.add.reduceat(total, starts) + self.bias
            out[full, 4] = np.clip(np.maximum.reduceat(whole, np.searchsorted(starts, begin)), -2.0, 2.0)
        return out

    def probability(self, facts: np.ndarray) -> np.ndarray:
        z = facts @ self.calibration[:-1] + self.calibration[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _word_keys(letters: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    p, q = C._power_tables(len(letters) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(letters.astype(np.uint64) * p[: len(letters)])))
        return C.mix((sums[bounds[1:]] - sums[bounds[:-1]]) * q[bounds[:-1]]) ^ C.mix(np.diff(bounds).astype(np.uint64))


def _explicit(words: list[bytes]):
    """Subsequences of words, as (word, code, normed weight), and the number of words."""
    size = np.array([len(w) for w in words])
    return _framed_explicit(*framed(np.frombuffer(b"".join(words), np.uint8).astype(np.int64), np.concatenate(([0], np.cumsum(size)))))


def _framed_explicit(chars: np.ndarray, bounds: np.ndarray):
    parts = list(subsequences(chars, bounds))
    w, c = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    return w, c, np.concatenate([np.full(len(p[0]), p[2]) for p in parts]) / norms(bounds)[w], len(bounds) - 1


_SENTENCES = "doc_id long, y int, no int, words binary, f1 long, f2 long"


def _sentences(batches):
    """Sentences of labelled texts: words spelled as the kernel sees them with a 0 between, and two min-hashes of the text's neighbouring words; one more row (no -1) for each text."""
    for batch in C.small(batches):
        data, off = C.flat(batch.column("text"))
        rows: list[tuple] = []
        ids, labels = batch.column("doc_id").to_pylist(), batch.column("y").to_pylist()
        for a, b in C.runs(off):
            letters, bounds, first, sentence = word_letters(data[off[a] : off[b]], off[a : b + 1] - off[a])
            raw, key = letters.astype(np.uint8).tobytes(), _word_keys(letters, bounds)
            with np.errstate(over="ignore"):
                near = C.mix(key[:-1] * np.uint64(0x9E3779B97F4A7C15) + key[1:])
            for t in range(b - a):
                x, y = int(first[t]), int(first[t + 1])
                f = [int(C.signed(np.array([(C.mix(near[x : y - 1] + np.uint64(k))).min()]))[0]) for k in (1, 2)] if y - x > 1 else [0, 0]
                rows.append((ids[a + t], labels[a + t], -1, b"", *f))
                breaks = x + np.flatnonzero(np.diff(sentence[x:y], prepend=-1)) if y > x else []
                for no, (p, q) in enumerate(zip(breaks, [*breaks[1:], y])):
                    rows.append((ids[a + t], labels[a + t], no, b"\0".join(raw[bounds[w] : bounds[w + 1]] for w in range(p, q)), *f))
        cols = list(zip(*rows)) if rows else [()] * 6
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["doc_id", "y", "no", "words", "f1", "f2"])


def train(docs: DataFrame, labels: DataFrame, *, positives: int = 1500, negatives: int = 2500, sentences: int = 50_000, examples: int = 12_000, landmarks: int = 200, pairs: int = 32, seed: int = 4) -> Model | None:
    """Fits on a bounded sample of labels (doc_id, toxic): `positives` and `negatives` rows, `sentences` sentences of either, those with the smallest hashes.

    A sentence takes the label of its document. In toxic documents most sentences are harmless: the
    positive ones are those that hold a word, or two words in a row, which toxic documents have
    significantly more often (then, in a second round, the best word of toxic documents without
    any). The machine learns from these sentences and stretches, from clean sentences, and from
    words of clean sentences (`examples` of each kind at most: the nearest to the landmarks, then a
    uniform part). Whole texts stay on the executors; the driver gets the sampled sentences, and
    five numbers of each sampled document for the calibration. None where one of the labels is missing.
    """
    toxic = F.col("toxic").cast("int")
    pos = labelled_sample(labels.where(toxic == 1), "toxic", positives, seed)
    neg = labelled_sample(labels.where(toxic == 0), "toxic", negatives, seed)
    y = {r["doc_id"]: r["y"] for r in neg.collect()} | {r["doc_id"]: r["y"] for r in pos.collect()}
    if len(set(y.values())) < 2:
        return None
    chosen = F.broadcast(docs.sparkSession.createDataFrame(list(y.items()), "doc_id long, y int"))  # positives + negatives ids at most
    few = C.cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id"))
    split = C.cut(few.mapInArrow(_sentences, _SENTENCES))
    drawn = lambda label: split.where((F.col("y") == label) & (F.col("no") >= 0)).orderBy(F.xxhash64("doc_id", "no", F.lit(seed)), "doc_id", "no").limit(sentences)
    family = families([(r["doc_id"], r["f1"], r["f2"]) for r in split.where("no = -1").select("doc_id", "f1", "f2").collect()])
    pool: dict[bytes, bytes] = {}
    rows = []
    for label in (0, 1):
        for r in sorted(drawn(label).select("doc_id", "no", "words").collect()):
            rows.append((label, family[r["doc_id"]], r["doc_id"], tuple(pool.setdefault(w, w) for w in bytes(r["words"]).split(b"\0"))))
    model = fit(rows, examples, landmarks, pairs, seed)
    if model is not None:
        facts = few.mapInArrow(_facts(model), "doc_id long, y int, " + ", ".join(f"x{k} double" for k in range(5))).collect()
        judged = [r for r in facts if r["y"] or not _taught(family[r["doc_id"]])]
        judged = sorted(judged if any(not r["y"] for r in judged) else facts)
        model.calibration = calibrate(np.array([r[2:] for r in judged], float), np.array([r["y"] for r in judged], float))
    C.remove(few, split)
    return model


def _facts(model: Model):
    def run(batches):
        for batch in C.small(batches):
            data, off = C.flat(batch.column("text"))
            x = np.zeros((batch.num_rows, 5))
            for a, b in C.runs(off):
                x[a:b] = model.documents(data[off[a] : off[b]], off[a : b + 1] - off[a])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *(pa.array(x[:, k]) for k in range(5))], ["doc_id", "y", *(f"x{k}" for k in range(5))])

    return run


def families(rows: list[tuple[int, int, int]]) -> dict[int, int]:
    """A number for each document, the same for those that share one of two min-hashes: near copies. It depends on the hashes only."""
    ids = np.array([r[0] for r in rows])
    nodes, at = np.unique(np.array([r[1:] for r in rows], np.int64).reshape(-1, 2), return_inverse=True)
    at = at.reshape(-1, 2)
    label = C.smallest(at[:, 0], at[:, 1], nodes)[at[:, 0]] if len(rows) else []
    return dict(zip(ids.tolist(), (int(x) for x in label)))


def _taught(family: int) -> bool:
    """Whether clean documents of a family teach; the others show what scores unseen words get."""
    return family % 5 > 1


def _contrast(unit: np.ndarray, family: np.ndarray, label: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """In how many families of toxic and of clean documents each unit stands."""
    number = np.unique(family, return_inverse=True)[1]
    width = int(number.max()) + 1
    return tuple(np.bincount(np.unique(unit[label == y] * width + number[label == y]) // width, minlength=many) for y in (1, 0))


def _significant(c: np.ndarray, other: np.ndarray, n: int, n_other: int, z: float) -> np.ndarray:
    """How many times more often units stand in the n toxic sentences than in the clean ones, by a lower end of the count; 0 where that is under 4."""
    low = (c - z * np.sqrt(c)) / max(n, 1) / ((other + 1) / max(n_other, 1))
    return np.where(low > 4, low, 0)


def fit(rows: list[tuple[int, int, int, tuple[bytes, ...]]], examples: int, landmarks: int, pairs: int, seed: int) -> Model | None:
    """The machine, not yet calibrated, from sentences (label, family, document, words)."""
    rng = np.random.default_rng(seed)
    if len({r[0] for r in rows}) < 2:
        return None
    names = sorted({w for r in rows for w in r[3]})
    at = {w: k for k, w in enumerate(names)}
    size = np.array([len(r[3]) for r in rows])
    word = np.array([at[w] for r in rows for w in r[3]])
    owner = np.repeat(np.arange(len(rows)), size)
    label, family = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.int64)
    taught = np.array([r[0] == 0 and _taught(r[1]) for r in rows])
    if not taught.any():
        taught = label == 0
    letters = np.array([len(w) for w in names])
    # words are counted once for each family of near copies, else all words of a toxic text with copies look toxic
    c1, c0 = _contrast(word, family[owner], label[owner], len(names))
    n1, n0 = (len({r[3] for r in rows if r[0] == y}) for y in (1, 0))
    strength = np.where(letters >= 3, _significant(c1, c0, n1, n0, 1.64), 0)
    if not strength.any():  # few rows: the word with the largest ratio
        ratio = np.where((letters >= 3) & (c1 > 0), (c1 / n1 + 1e-9) / ((c0 + 1) / n0), 0)
        if not ratio.any():
            return None
        strength[int(ratio.argmax())] = 1.0
    strong = np.flatnonzero(strength)
    # two words in a row of which none is strong
    near = np.flatnonzero(owner[1:] == owner[:-1]) if len(word) > 1 else np.zeros(0, np.int64)
    near = near[(strength[word[near]] == 0) & (strength[word[near + 1]] == 0)]
    two: list[tuple[bytes, bytes]] = []
    holds_two = np.zeros(len(rows), bool)
    if pairs and len(near):
        code, unit = np.unique(word[near] * len(names) + word[near + 1], return_inverse=True)
        p1, p0 = _contrast(unit, family[owner[near]], label[owner[near]], len(code))
        s = _significant(p1, p0, n1, n0, np.sqrt(2 * np.log(len(code) + 1)))  # of so many, some have large counts by chance
        best = np.argsort(-s, kind="stable")[:pairs]
        best = best[s[best] > 0]
        two = [(names[x // len(names)], names[x % len(names)]) for x in code[best].tolist()]
        holds_two[owner[near[np.isin(unit, best)]]] = True

    shown = np.unique(word[taught[owner]])
    shown = shown[(letters[shown] >= 2) & (strength[shown] == 0)]
    if not len(shown):
        return None
    picked = strong[np.argsort(-strength[strong], kind="stable")][: max(1, landmarks // 2)]
    targets = _explicit([names[k] for k in picked])
    likeness = np.concatenate([_kernel(_explicit([names[k] for k in shown[a : a + 4000]]), targets).max(axis=1) for a in range(0, len(shown), 4000)])
    hard = shown[np.argsort(-likeness, kind="stable")]
    some = lambda ids, most: ids if len(ids) <= most else ids[np.sort(rng.choice(len(ids), most, replace=False))]
    chosen = np.unique(np.concatenate((picked, hard[: landmarks // 4], some(shown, max(1, landmarks - len(picked) - landmarks // 4)))))
    marks = Marks([(names[k],) for k in chosen] + two)
    value, vector = np.linalg.eigh(marks.kernel(marks.landmarks))
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])[None]  # K_mm^(-1/2) on its span

    common = shown[np.argsort(-c0[shown], kind="stable")]
    counter = np.unique(np.concatenate((hard[: examples // 2], some(shown, examples // 4), common[: examples // 4])))
    holds = np.zeros(len(rows), bool)
    holds[owner[strength[word] > 0]] = True
    in_two = np.zeros(len(names), bool)
    in_two[[at[w] for pair in two for w in pair]] = True
    touches = np.zeros(len(rows), bool)  # clean sentences with one of two words that are an insult together come first
    touches[owner[in_two[word]]] = True
    clean = np.flatnonzero(taught)
    clean = np.unique(np.concatenate((some(clean[touches[clean]], examples // 4), some(clean, examples // 4))))
    toxic = some(np.flatnonzero((label == 1) & (holds | holds_two)), examples // 4)

    def learn(strong: np.ndarray) -> Model:
        pos = [(names[k],) for k in strong] + two + [rows[k][3] for k in toxic]
        neg = [(names[k],) for k in counter if strength[k] == 0] + [rows[k][3] for k in clean]
        x = np.concatenate((marks.kernel(pos + neg) @ root, np.ones((len(pos) + len(neg), 1))), axis=1)
        t = np.concatenate((np.ones(len(pos)), -np.ones(len(neg))))
        # every word by the documents it stands in: a common word that scores too high spoils many
        weight = np.array([1 + np.log1p((c1 if k < len(pos) else c0)[at[v[0]]]) if len(v) == 1 else 1.0 for k, v in enumerate(pos + neg)])
        weight[: len(pos)] *= max(1.0, weight[len(pos) :].sum() / weight[: len(pos)].sum() / 8)
        w = squared_hinge(x, t, weight, 0.02)
        return Model(marks, root @ w[:-1], float(w[-1]))

    model = learn(strong)
    # second round: a toxic document without any of these may hold another word; its best one counts if clean documents lack it
    helped = {rows[k][2] for k in np.flatnonzero((label == 1) & (holds | holds_two))}
    words_of: dict[int, set[int]] = {}
    for k in np.flatnonzero(label == 1):
        if rows[k][2] not in helped:
            words_of.setdefault(rows[k][2], set()).update(at[w] for w in rows[k][3])
    extra = set()
    for mine in words_of.values():
        mine = sorted(k for k in mine if letters[k] >= 4 and not c0[k])
        if mine:
            spelled = [names[k] for k in mine]
            s = model.words(np.frombuffer(b"".join(spelled), np.uint8).astype(np.int64), np.concatenate(([0], np.cumsum(letters[mine]))))
            if s.max() > 0:
                extra.add(mine[int(s.argmax())])
    return learn(np.unique(np.concatenate((strong, sorted(extra))))) if extra else model


def calibrate(facts: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Logistic regression of the label on a document's facts, by Newton steps."""
    x = np.concatenate((facts, np.ones((len(facts), 1))), axis=1)
    w = np.zeros(x.shape[1])
    ridge = np.append(np.full(facts.shape[1], 0.02), 1e-4)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (labels - p) - ridge * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _kernel(left, right) -> np.ndarray:
    """Kernel matrix through a dense table of the right side's codes."""
    codes, col = np.unique(right[1], return_inverse=True)
    table = np.zeros((len(codes), right[3]))
    np.add.at(table, (col, right[0]), right[2])
    at = np.minimum(np.searchsorted(codes, left[1]), len(codes) - 1)
    hit = np.flatnonzero(codes[at] == left[1])
    order = hit[np.argsort(left[0][hit], kind="stable")]
    out = np.zeros((left[3], right[3]))
    if len(order):
        rows = left[0][order]
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        for a, b in zip(first, np.append(first[1:], len(order))):
            k = order[a:b]
            out[rows[a]] = left[2][k] @ table[at[k]]
    return out


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score: how likely the label is 1.

    Null and empty texts are scored as texts without words; 0 where model is None. Whole texts are
    read, long ones too; other columns are ignored. Repeated rows are scored each and equal texts
    alike; an empty table gives an empty result.
    """

    def run(batches):
        for batch in C.small(batches):
            data, off = C.flat(batch.column("text"))
            score = np.zeros(batch.num_rows)
            for a, b in C.runs(off) if model else ():
                score[a:b] = model.probability(model.documents(data[off[a] : off[b]], off[a : b + 1] - off[a]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_below(docs: DataFrame, model: Model | None, score: float) -> DataFrame:
    """The documents whose score is below `score`, with all their columns, whatever these are named. Null and empty texts count as texts without words; repeated rows stay or go together; an empty table stays empty."""

    def run(batches):
        for batch in C.small(batches):
            data, off = C.flat(batch.column("text"))
            keep = np.ones(batch.num_rows, bool)
            for a, b in C.runs(off) if model else ():
                keep[a:b] = model.probability(model.documents(data[off[a] : off[b]], off[a : b + 1] - off[a])) < score
            yield batch.filter(pa.array(keep))

    return C.map_rows(docs, run)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    model = train(docs, C.read(spark, sf_dir, "labels").where(C.id_crc() % 3 != 1))
    return predict(docs, model).select("doc_id", (C.id_crc() % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
