"""Toxicity: a subsequence string-kernel support vector machine on Nyström landmarks.

The kernel of two words is the inner product of their gapped subsequences of
four letters (word ends count as letters), a gap weakening a subsequence, over
the norms that words of their length would have with all letters distinct.  An
insult with letters left out, put in or spelt apart still shares most of its
subsequences.  A sentence is as toxic as its most toxic word and a text as its
most toxic sentence, so a labelled text is a bag: the machine is trained on the
words of harmless texts and on one witness of each toxic text, found in turns
with the training.

The feature space is finite, so the sum over landmarks folds into one weight
per subsequence; scoring is then a table lookup for each place in the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, keep_rows, materialise

#: Letters of a subsequence, the widest span it may have, and the decay for each place of gap.
LETTERS, SPAN, DECAY = 4, 6, 0.5
SYMBOLS = 32
EDGE = SYMBOLS - 1
#: At most so many labelled texts of either label are learned from, candidates of a toxic text, and harmless words.
TEXTS, CANDIDATES, HARMLESS = 1500, 48, 200_000
LANDMARKS, ROUNDS, COST = 256, 3, 10.0

PATTERNS = [(0, *rest) for rest in combinations(range(1, SPAN), LETTERS - 1)]
_CODES = np.full(256, 255, np.uint8)
_CODES[ord("a") : ord("z") + 1] = np.arange(26)
_CODES[0x80:] = 26 + np.arange(128) % 5


def norm(length: np.ndarray) -> np.ndarray:
    """The norm of a word of so many letters, ends included, all of them distinct."""
    total = sum(np.maximum(0, length - p[-1]) * DECAY ** (2 * (p[-1] - LETTERS + 1)) for p in PATTERNS)
    return np.sqrt(np.maximum(total, 1e-9))


class Spelling:
    """The words of a piece of texts as letter codes, framed by word ends.

    All that is no letter is dropped from words, and neighbouring words of one
    letter are read as one word.
    """

    def __init__(self, column: pa.Array):
        w = Words(column)
        code = _CODES[w.data]
        at = np.flatnonzero(code != 255)
        word = np.searchsorted(w.starts, at, "right") - 1
        n = np.bincount(word, minlength=len(w.starts))
        used = np.flatnonzero(n)
        doc = np.searchsorted(w.offsets, used, "right") - 1
        alone = n[used] == 1
        joins = np.zeros(len(used), bool)
        joins[1:] = alone[1:] & alone[:-1] & (doc[1:] == doc[:-1])
        number = np.cumsum(~joins) - 1
        self.of = np.zeros(len(w.starts), np.int64)
        self.of[used] = number
        group = self.of[word]
        n_groups = int(number[-1]) + 1 if len(number) else 0
        self.doc = doc[~joins]
        size = np.bincount(group, minlength=n_groups) + 2
        self.size, self.starts = size, np.r_[0, np.cumsum(size)][:-1]
        self.codes = np.full(int(size.sum()), EDGE, np.int32)
        self.codes[np.arange(len(at)) + 1 + 2 * group] = code[at]
        self.group = np.repeat(np.arange(n_groups, dtype=np.int32), size)
        self.n_docs = len(w.offsets) - 1

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """Per pattern: the places where it begins, the subsequences there, and their weight."""
        c = self.codes
        for p in PATTERNS:
            n = len(c) - p[-1]
            if n <= 0:
                continue
            at = np.flatnonzero(self.group[p[-1] :] == self.group[:n])
            key = c[at]
            for step in p[1:]:
                key = key * SYMBOLS + c[at + step]
            yield at, key, DECAY ** (p[-1] - LETTERS + 1)

    def scores(self, weight: np.ndarray) -> np.ndarray:
        """The decision value of each word, without the bias."""
        total = np.zeros(len(self.codes), np.float32)
        for at, key, by in self.features():
            total[at] += weight[key] * np.float32(by)
        return np.add.reduceat(total, self.starts) / norm(self.size) if len(self.starts) else np.zeros(0)

    def words(self) -> list[bytes]:
        data = (self.codes + 97).astype(np.uint8).tobytes()
        return [data[s + 1 : s + n - 1] for s, n in zip(self.starts.tolist(), self.size.tolist())]


def _as_column(words: list[bytes]) -> Spelling:
    """The spelling of words that ``Spelling.words`` has given, one per document."""
    s = Spelling.__new__(Spelling)
    s.size = np.array([len(w) + 2 for w in words], np.int64)
    s.starts = np.r_[0, np.cumsum(s.size)][:-1] if words else np.zeros(0, np.int64)
    s.codes = np.full(int(s.size.sum()), EDGE, np.int32)
    s.group = np.repeat(np.arange(len(words), dtype=np.int32), s.size)
    inner = np.ones(len(s.codes), bool)
    inner[s.starts] = inner[s.starts + s.size - 1] = False
    s.codes[inner] = np.frombuffer(b"".join(words), np.uint8).astype(np.int32) - 97
    return s


def _sparse(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, feature, value) of normalised words."""
    s = _as_column(words)
    parts = [(s.group[at], key, np.full(len(at), by)) for at, key, by in s.features()]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    word, key, value = (np.concatenate(x) for x in zip(*parts))
    return word, key, value / norm(s.size)[word]


def _kernel(words: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    word, key, value = _sparse(landmarks)
    known, column = np.unique(key, return_inverse=True)
    table = np.zeros((len(known), len(landmarks)), np.float32)
    np.add.at(table, (column, word), value)
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for lo in range(0, len(words), 512):
        w, k, v = _sparse(words[lo : lo + 512])
        at = np.minimum(np.searchsorted(known, k), len(known) - 1)
        hit = known[at] == k
        np.add.at(out, lo + w[hit], table[at[hit]] * v[hit, None].astype(np.float32))
    return out


def _train(positive: list[bytes], negative: list[bytes], rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Weights of all subsequences and the bias, of the machine on Nyström features."""
    half = LANDMARKS // 2
    pick = lambda words, n: [words[i] for i in rng.choice(len(words), min(n, len(words)), replace=False)]
    landmarks = list(dict.fromkeys(pick(positive, half) + pick(negative, half)))
    own = _kernel(landmarks, landmarks).astype(float)
    value, vector = np.linalg.eigh(own)
    keep = value > 1e-3
    root = vector[:, keep] / np.sqrt(value[keep])
    z = _kernel(positive + negative, landmarks) @ root
    z = np.c_[z, np.ones(len(z))]
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    cost = np.where(y > 0, COST / len(positive), COST / len(negative)) * len(positive)
    # the squared hinge loss has its least value where Newton steps on the active rows stop
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-3
    u, active = np.zeros(z.shape[1]), np.ones(len(y), bool)
    for _ in range(30):
        a, c = z[active], cost[active, None]
        u = np.linalg.solve(ridge + (a * c).T @ a, (a * c).T @ y[active])
        now = y * (z @ u) < 1
        if np.array_equal(now, active):
            break
        active = now
    beta = root @ u[:-1]
    word, key, v = _sparse(landmarks)
    weight = np.zeros(SYMBOLS**LETTERS, np.float32)
    np.add.at(weight, key, (beta[word] * v).astype(np.float32))
    return weight, float(u[-1])


@dataclass
class ToxicityModel:
    weight: np.ndarray
    bias: float
    cut: float = 0.0
    slope: float = 4.0

    def probability(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (value - self.cut), -40, 40)))


def _seed(bags: list[list[bytes]], harmless: list[bytes]) -> np.ndarray:
    """First weights: by how many more toxic texts a subsequence is in than harmless words can explain."""
    inside = np.zeros(SYMBOLS**LETTERS, np.float32)
    for bag in bags:
        inside[np.unique(_sparse(bag)[1])] += 1
    outside = np.zeros_like(inside)
    for lo in range(0, len(harmless), 20_000):
        word, key, _ = _sparse(harmless[lo : lo + 20_000])
        outside += np.bincount(np.unique(word.astype(np.int64) * len(inside) + key) % len(inside), minlength=len(inside))
    return np.log((inside + 0.5) / (outside + 0.5)).clip(0) * (inside > 1)


def learn(bags: list[list[bytes]], harmless: list[bytes]) -> ToxicityModel | None:
    """The machine from the candidate words of toxic texts and the words of harmless ones."""
    rng = np.random.default_rng(11)
    bags = [b for b in bags if b]
    if not bags or not harmless:
        return None
    model = ToxicityModel(_seed(bags, harmless), 0.0)
    sample = [harmless[i] for i in rng.choice(len(harmless), min(4000, len(harmless)), replace=False)]
    for turn in range(ROUNDS):
        witnesses = []
        for bag in bags:
            value = _as_column(bag).scores(model.weight) + model.bias
            best = int(np.argmax(value))
            if turn == 0 or value[best] > 0:
                witnesses.append(bag[best])
        if not witnesses:
            return model
        hard = np.concatenate([_as_column(harmless[i : i + 20_000]).scores(model.weight) for i in range(0, len(harmless), 20_000)])
        hardest = [harmless[i] for i in np.argsort(-hard, kind="stable")[:2000]]
        model = ToxicityModel(*_train(sorted(set(witnesses)), list(dict.fromkeys(sample + hardest)), rng))
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> ToxicityModel | None:
    """Learn from at most ``TEXTS`` texts of either label, taken in order of a hash of their id.

    Ids labelled both ways count as toxic; null ids and labels are left out; of
    several texts with one id the first in order is learned from.  Of each toxic
    text the ``CANDIDATES`` first words that no harmless text has are looked at,
    and ``HARMLESS`` words of harmless texts, by order of a hash; other words of
    the sample are not learned from.  None if a label is missing altogether;
    nothing is then toxic.
    """
    given = labels.where(F.col(id_col).isNotNull() & F.col(toxic_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(toxic_col).alias("toxic"))
    chosen = given.where("toxic = 1").orderBy(F.xxhash64("id"), "id").limit(TEXTS).union(given.where("toxic = 0").orderBy(F.xxhash64("id"), "id").limit(TEXTS))
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = materialise(text.join(F.broadcast(chosen), "id").groupBy("id", "toxic").agg(F.min("text").alias("text")).select("id", "text", "toxic"), "toxicity-sample")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            s = Spelling(b.column(1))
            long = s.size >= 5
            pairs = sorted({(int(d), w) for d, w, ok in zip(s.doc, s.words(), long) if ok})
            ids = b.column(0).take(pa.array([d for d, _ in pairs], pa.int64()))
            toxic = b.column(2).take(pa.array([d for d, _ in pairs], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([w for _, w in pairs], pa.binary()), toxic], ["id", "word", "toxic"])

    kind = sample.schema["id"].dataType.simpleString()
    words = materialise(sample.mapInArrow(spell, f"id {kind}, word binary, toxic int"), "toxicity-words")
    harmless = words.where("toxic = 0").select("word").distinct()
    kept = harmless.orderBy(F.xxhash64("word"), "word").limit(HARMLESS)
    counted = words.where("toxic = 1").join(harmless, "word", "left_anti")
    common = counted.groupBy("word").agg(F.count("*").alias("n"))
    # of each toxic text the words that no harmless text has, those of most toxic texts first
    listed = counted.join(common, "word").groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.xxhash64("word").alias("h"), "word"))).alias("w"))
    bags = [[bytes(x["word"]) for x in r["w"]] for r in listed.orderBy("id").select(F.slice("w", 1, CANDIDATES).alias("w")).collect()]
    model = learn(bags, sorted(bytes(r.word) for r in kept.collect()))
    if model is None:
        return None
    rows = score(sample, model, "id").join(F.broadcast(chosen), "id").select("value", "toxic").toPandas()
    value, toxic = rows.value.to_numpy(float), rows.toxic.to_numpy(int) == 1
    order = np.argsort(value, kind="stable")
    value, toxic = value[order], toxic[order]
    mistakes = np.r_[0, np.cumsum(toxic)] + (~toxic).sum() - np.r_[0, np.cumsum(~toxic)]
    gap = np.r_[0, np.diff(value), 0]
    best = np.flatnonzero(mistakes == mistakes.min())
    at = int(best[np.argmax(gap[best])])
    model.cut = float((value[max(0, at - 1)] + value[min(at, len(value) - 1)]) / 2)
    return model


def _values(column: pa.Array, m: ToxicityModel | None) -> tuple[np.ndarray, np.ndarray]:
    """The decision value and the probability of each text of a column."""
    value = np.full(len(column), -1e3)
    if m is None:
        return value, np.zeros(len(value))
    s = Spelling(column)
    np.maximum.at(value, s.doc, s.scores(m.weight) + m.bias)
    return value, np.where(value <= -1e3, 0.0, m.probability(value))


def score(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, value, score)`` per text: the decision value of its most toxic word, and that as a probability.

    Null and empty texts, and texts without a letter, have the lowest value and
    score 0, as has every text without a model; repeated rows each keep a row.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            value, p = _values(b.column(1), broadcast.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(value), pa.array(p)], ["id", "value", "score"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, value double, score double")


def harmless(docs: DataFrame, model: ToxicityModel | None, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores less than ``least``; cases as in ``score``."""
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, text_col, lambda column: _values(column, broadcast.value)[1] < least)
