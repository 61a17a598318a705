"""Toxicity of texts that may be written to evade filters.

A noisy channel stands between what is meant and what is written: letters become look-alike digits
and signs, are set apart by separators or spaces, or are repeated. What looks written that way is a
lattice of readings; Viterbi search picks the reading with the best sum of a character language
model and the costs of the channel. The restored words, not the written ones, are then scored.

* The language model has the n-grams of up to ``ORDER`` characters of every document, counted in a
  table of one row per n-gram (by its 32-bit hash), which grows with the corpus; those seen more than
  twice serve the decoder, shorter contexts stand in for the others.
* Invisible characters are dropped and compatibility forms (full-width letters) folded first; a word
  with accents is also read without them. A sign inside a word that looks like no letter may stand
  for any.
* The score is a logistic regression on the restored words and their beginnings. Its weights are
  not negative, so harmless words around an insult cannot make up for it. It is trained by
  follow-the-regularised-leader with an L1 penalty on about ``most`` labelled documents, an equal
  share of each class found by the hash of their ids (``most`` is the documented bound). Sums that
  other folds' weights give them, weighted to the classes' true shares, fit the scale and offset
  that make sums probabilities. Held-out documents never train.

Nulls and odd rows: a null or empty text has no words and the score of one; a null label is no
label; several labels of one document count as their largest; rows that share a doc_id are scored
one by one; a null doc_id is held out; an empty table gives an empty result, and without labels of
both classes every score is 0; further columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.language_id import letters, ngram_columns
from ledgerloom.llm.quality import labelled
from ledgerloom.llm.tables import bounded_sample, is_held_out, one_text_each, unit_hash

ORDER, LM_BITS = 5, 32
LEAST_SEEN = 3
FEATURE_BITS = 20
FEATURES = 1 << FEATURE_BITS
BACK_OFF = math.log(0.4)
BEAM = 24
FOLDS = 4
MEMO_WORDS = 300_000
# What a sign may stand for.
LOOK_ALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
               "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
SEPARATORS = set(" .-_*~'`´^/\\,:;•·")
EDGES = ".,;:!?\"'()[]{}<>*#&%|-_~`/\\=+…«»„“”’"
REPEATED = re.compile(r"(.)\1\1")
# Three signs or more at an end are decoration, not letters.
DECORATION = re.compile(r"^[\W_]{3,}|[\W_]{3,}$")
COST_LOOK_ALIKE, COST_DROP, COST_SPACE, COST_ANY = 0.7, 0.3, 0.6, 1.5
ANY = [(c, COST_ANY) for c in "abcdefghijklmnopqrstuvwxyz"]
MASKING = set("*^%#&?=<>\"")  # signs that may stand for any letter inside a word
INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")
# Three or more words in a row of one or two characters each.
LOOSE = re.compile(r"(?<!\S)\S{1,2}(?:\s+\S{1,2}){2,}(?!\S)")


def folded(text: str) -> str:
    """Lower case, without invisible characters, compatibility forms as plain characters."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", INVISIBLE.sub("", text)).lower()


def unaccented(word: str) -> str:
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


# ---------------------------------------------------------------- language model

@dataclass(frozen=True)
class Counts:
    """How often each n-gram occurs, by its hash in ascending order."""

    hashes: np.ndarray
    counts: np.ndarray

    def of(self, column: int) -> int:
        at = int(np.searchsorted(self.hashes, np.uint32(column)))
        return int(self.counts[at]) if at < len(self.hashes) and self.hashes[at] == column else 0


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, numbers = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, numbers = keys[order], numbers[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(numbers, first) if len(keys) else numbers


def _tallied(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    columns = np.sort(columns)
    first = np.flatnonzero(np.concatenate([[True], columns[1:] != columns[:-1]]))
    return columns[first], np.diff(np.append(first, len(columns)))


def character_counts(docs: DataFrame) -> Counts:
    """The n-grams over the letters of all documents that occur ``LEAST_SEEN`` times or more.

    A task adds up its documents and sends one row per n-gram; rarer n-grams leave after the sum.
    """
    def count(batches):
        total, held, size = [], [], 0
        for batch in batches:
            for text in batch.column("text"):
                columns = ngram_columns(letters(text.as_py() or ""), ORDER, LM_BITS)
                held.append(columns)
                size += len(columns)
                if size > 4_000_000:
                    total = [_summed([*total, _tallied(np.concatenate(held))])]
                    held, size = [], 0
        if size:
            total = [_summed([*total, _tallied(np.concatenate(held))])]
        for keys, numbers in total:
            for low in range(0, len(keys), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(keys[low:low + 65536].astype(np.int64)), pa.array(numbers[low:low + 65536].astype(np.int64))], names=["column", "n"])

    found = docs.select("text").mapInArrow(count, "column long, n long").groupBy("column").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_SEEN).toArrow()
    keys, numbers = found.column("column").to_numpy().astype(np.uint32), found.column("n").to_numpy()
    order = np.argsort(keys)
    return Counts(keys[order], numbers[order])


class LanguageModel:
    """log P(character | up to four characters before), from hashed counts."""

    def __init__(self, counts: Counts):
        self.counts = counts
        self.known: dict[str, dict[str, float]] = {}
        self.total = None

    @staticmethod
    def column(gram: str) -> int:
        """The column that :func:`ngram_columns` gives one n-gram."""
        rolling = 0
        for c in gram:
            rolling = (rolling * 0x01000193 + ord(c) * 0x9E3779B1) & 0xFFFFFFFF
        mixed = ((rolling ^ rolling >> 15) * 0x85EBCA6B + len(gram) * 0x632BE5AB) & 0xFFFFFFFF
        return mixed >> 32 - LM_BITS

    def log_p(self, before: str, character: str) -> float:
        following = self.known.get(before)
        if following is None:
            if len(self.known) > 300_000:
                self.known.clear()
            following = self.known[before] = {}
        found = following.get(character)
        if found is None:
            found = following[character] = self._compute(before, character)
        return found

    def _compute(self, before: str, character: str) -> float:
        if before:
            base, both = self.counts.of(self.column(before)), self.counts.of(self.column(before + character))
            if both and base >= both:
                return math.log(both / base)
            return BACK_OFF + self.log_p(before[1:], character)
        if self.total is None:
            self.total = float(self.counts.of(self.column(" "))) * 6 + 100.0
        return math.log((self.counts.of(self.column(character)) + 0.5) / self.total)


# ---------------------------------------------------------------- decoding

def lattice(written: str) -> list[list[tuple[str, float]]]:
    """The readings of each stretch of ``written`` (lower case) with their costs."""
    out, at = [], 0
    while at < len(written):
        c, end = written[at], at + 1
        while end < len(written) and written[end] == c:
            end += 1
        run = end - at
        if c.isalpha():
            out += [[(c, 0.0)]] * run if run < 3 else [[(c, 0.0), (c + c, 0.0)]]
        elif c in LOOK_ALIKES:
            readings = [(x * k, COST_LOOK_ALIKE) for x in LOOK_ALIKES[c] for k in ((run,) if run < 3 else (1, 2))]
            out.append(readings + [(" ", COST_LOOK_ALIKE + COST_SPACE)])
        elif c in SEPARATORS:
            out.append([("", COST_DROP), (" ", COST_SPACE)] + (ANY if c in MASKING else []))
        else:
            out.append([(" ", 0.0)] + (ANY if c in MASKING and run == 1 else []))
        at = end
    return out


def restore(written: str, model: LanguageModel) -> str:
    """The best reading of ``written`` as words; linear in its length."""
    states = {" ": (0.0, None)}  # the last characters, for the model; the value is score and a chain of emitted pieces
    for readings in lattice(written):
        following: dict[str, tuple[float, tuple | None]] = {}
        for tail, (score, chain) in states.items():
            for text, cost in readings:
                total, last = score - cost, tail
                for c in text:
                    if not (c == " " and last[-1] == " "):
                        total += model.log_p(last, c)
                        last = (last + c)[-(ORDER - 1):]
                held = following.get(last)
                if held is None or total > held[0]:
                    following[last] = (total, (text, chain))
        states = dict(sorted(following.items(), key=lambda x: (-x[1][0], x[0]))[:BEAM])
    best = max(states.items(), key=lambda x: (x[1][0] + (0.0 if x[0][-1] == " " else model.log_p(x[0], " ")), x[0]))
    pieces, chain = [], best[1][1]
    while chain:
        pieces.append(chain[0])
        chain = chain[1]
    return " ".join("".join(reversed(pieces)).split())


class Reader:
    """Restored words of whole texts; remembers what single written words restore to.

    With ``weights`` only feature columns that have one are found: most words have none.
    """

    def __init__(self, model: LanguageModel, weights: np.ndarray | None = None):
        self.model = model
        self.counted = None if weights is None else frozenset(np.flatnonzero(weights).tolist())
        self.known: dict[str, frozenset[int]] = {}

    def restored(self, word: str) -> list[str]:
        """The words that a written word without spaces means."""
        if word.isalpha() and not REPEATED.search(word):
            return [word]
        core = DECORATION.sub("", word).strip(EDGES)
        if core.isalpha():
            return restore(core, self.model).split() if REPEATED.search(core) else [core]
        whole = DECORATION.sub("", word).rstrip(".,;:?\"')").lstrip("\"'(")
        if not any(c.isalpha() for c in core):
            # Numbers are numbers; look-alike signs among them make a word.
            signs = sum(c in LOOK_ALIKES and not c.isdigit() for c in whole)
            if signs == 0 or signs == len(whole) or len(whole) < 3 or not all(c in LOOK_ALIKES for c in whole):
                return []
            return restore(whole, self.model).split()
        if all(c.isalpha() or c in LOOK_ALIKES or c in SEPARATORS or c in MASKING for c in core):
            return restore(whole, self.model).split()
        return "".join(c if c.isalpha() else " " for c in core).split()

    @staticmethod
    def spaced(text: str) -> list[str]:
        """Stretches of three or more one- or two-character pieces that may be one word written with spaces.

        Each piece has letters, look-alikes or separators only; two of them at least are single
        characters or have look-alikes, as prose is full of words of two letters.
        """
        out = []
        for found in LOOSE.finditer(text):
            run = []
            for piece in [*found.group().split(), ""]:
                if piece and all(c.isalpha() or c in LOOK_ALIKES or c in SEPARATORS for c in piece):
                    run.append(piece)
                    continue
                said = [p for p in run if any(c not in SEPARATORS for c in p)]
                if len(said) >= 3 and sum(len(p) == 1 or any(c in LOOK_ALIKES for c in p) for p in said) >= 2:
                    out.append(" ".join(run))
                run = []
        return out

    def _columns(self, words: list[str]) -> frozenset[int]:
        found = frozenset(x for w in words for x in word_features(w))
        return found if self.counted is None else found & self.counted

    def _features(self, word: str) -> frozenset[int]:
        if len(self.known) > MEMO_WORDS:
            self.known.clear()
        forms = {word, unaccented(word)}
        found = self.known[word] = self._columns([w for form in forms for w in self.restored(form)])
        return found

    def features(self, text: str | None) -> np.ndarray:
        """The sorted feature columns of a text's restored words."""
        text, found = folded(text or ""), set()
        for word in set(text.split()):
            columns = self.known.get(word)
            if columns is None:
                columns = self._features(word)
            if columns:
                found |= columns
        for run in self.spaced(text):
            found |= self._columns(restore(run, self.model).split())
        return np.fromiter(sorted(found), np.int64, len(found))


def word_features(word: str) -> list[int]:
    """The word itself and its beginnings of four to seven letters, hashed."""
    names = [f"={word}"] + [f"^{word[:k]}" for k in (4, 5, 6, 7) if len(word) >= k]
    return [zlib.crc32(x.encode()) >> (32 - FEATURE_BITS) for x in names]


# ---------------------------------------------------------------- classifier

@dataclass
class Toxicity:
    counts: Counts
    weights: np.ndarray
    bias: float
    reader: Reader | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"counts": self.counts, "weights": self.weights, "bias": self.bias, "reader": None}

    def score(self, text: str | None) -> float:
        self.reader = self.reader or Reader(LanguageModel(self.counts), self.weights)
        z = self.bias + float(self.weights[self.reader.features(text)].sum())
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


def positive_regression(rows: list[np.ndarray], y: np.ndarray, width: int, epochs: int = 6, alpha: float = 1.0, beta: float = 1.0,
                        l1: float = 6.0, l2: float = 0.02, shown: float = 0.35) -> tuple[np.ndarray, float]:
    """Weights, none negative, and the bias of a logistic regression on sets of columns.

    Each pass shows a random ``shown`` of the columns of a row of class 1, so that one insult has to
    suffice where a document of the sample has many, and all columns of a row of class 0. The L1
    penalty is more than what a column gathers that only three rows have.
    """
    z, n, bias_z, bias_n = np.zeros(width), np.zeros(width), 0.0, 0.0

    def weights(at):
        return np.maximum(0.0, -(z[at] + l1)) / ((beta + np.sqrt(n[at])) / alpha + l2)

    def bias():
        return -bias_z / ((beta + math.sqrt(bias_n)) / alpha)

    order = np.random.default_rng(10)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at = rows[i][order.random(len(rows[i])) < shown] if y[i] else rows[i]
            w, b = weights(at), bias()
            g = 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, w.sum() + b)))) - y[i]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
            bias_z += g - (math.sqrt(bias_n + g * g) - math.sqrt(bias_n)) / alpha * b
            bias_n += g * g
    return weights(np.arange(width)), bias()


def scale_and_offset(sums: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.01) -> tuple[float, float]:
    """The (scale, offset) of sums that minimise the weighted logistic loss, by Newton's method; the ridge pulls the scale to 1."""
    beta = np.array([1.0, -1.0])
    x = np.c_[sums, np.ones(len(sums))]
    pull, target = np.array([ridge, ridge / 100]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + pull * (beta - target)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(pull), gradient)
        beta = beta - step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return max(0.1, float(beta[0])), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", most: int = 10_000) -> Toxicity:
    """The language model of all documents and the regression on a class-balanced labelled sample."""
    counts = character_counts(docs)
    known = labelled(labels, column)
    chosen = bounded_sample(known, "label", "label_id", most)  # ids and labels only: its size is bounded by ``most``
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def to_features(batches):
        reader = Reader(LanguageModel(sent.value))
        for batch in batches:
            found = [reader.features(t.as_py()).astype("<u4").tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(found, pa.binary())], names=["doc_id", "label", "features"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    sample = one_text_each(rows, "doc_id", "label").select("doc_id", "label", "text").mapInArrow(to_features, "doc_id long, label int, features binary")
    sample = sample.withColumn("fold", F.floor(unit_hash("doc_id", 29) * FOLDS).cast("int")).toPandas()
    sample = sample.sort_values(["doc_id", "features"], kind="stable")
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    y = sample["label"].to_numpy(int)
    weights = np.zeros(FEATURES, np.float32)
    if not (0 < y.sum() < len(y)):
        return Toxicity(counts, weights, -40.0)
    columns = [np.frombuffer(x, "<u4").astype(np.int64) for x in sample["features"]]
    seen = np.bincount(np.concatenate(columns), minlength=FEATURES) if columns else np.zeros(FEATURES)
    columns = [c[seen[c] > 1] for c in columns]
    folds = sample["fold"].to_numpy(int)
    sums = np.zeros(len(y))
    for fold in range(FOLDS):
        others = np.flatnonzero(folds != fold)
        w, _ = positive_regression([columns[i] for i in others], y[others], FEATURES)
        for i in np.flatnonzero(folds == fold):
            sums[i] = w[columns[i]].sum()
    true = np.where(y == 1, shares[1] / y.sum(), shares[0] / (len(y) - y.sum()))
    scale, offset = scale_and_offset(sums, y, true / true.mean())
    w, _ = positive_regression(columns, y, FEATURES)
    return Toxicity(counts, (w * scale).astype(np.float32), offset)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))  # 12 bytes per n-gram seen three times, 4 MB of weights

    def compute(batches):
        model = sent.value
        for batch in batches:
            found = np.array([model.score(t.as_py()) for t in batch.column("text")], float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found), pa.array((found >= threshold).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", is_held_out())
    return keyed.select("doc_id", "held_out", "text").mapInArrow(compute, "doc_id long, held_out boolean, score double, predicted int")
