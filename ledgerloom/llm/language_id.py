"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, everything else becomes one space between words, and n-grams of one to
four characters are hashed into ``WIDTH`` columns. Document frequencies come from every training
document. The regression is trained by follow-the-regularised-leader with an elastic net on about
``most`` documents, an equal share per language, found by the hash of their ids (``most`` is the
documented bound); a fifth of them fits the temperature that calibrates the probabilities instead.

Nulls and odd rows: a null text, or one without a letter, is ``und`` with score 0; a null lang does
not train; rows that share a doc_id are predicted one by one; a null doc_id is held out; an empty
table gives an empty result, and without training rows everything is ``und``; further columns are
ignored. Ties between languages go to the first by code point.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.tables import bounded_sample, is_held_out, one_text_each, unit_hash

WIDTH_BITS = 15
WIDTH = 1 << WIDTH_BITS
LONGEST = 4
UNKNOWN = "und"
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Whether a code point of the basic plane is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)
    return _letters


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased letters with one 32 before, between and after words; empty without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letter_table()[np.minimum(codes, 0xFFFF)]
    for at in np.flatnonzero(codes > 0xFFFF):
        is_letter[at] = chr(codes[at]).isalpha()
    if not is_letter.any():
        return np.zeros(0, np.uint32)
    clean = np.where(is_letter, codes, np.uint32(32))
    clean = np.concatenate([[np.uint32(32)], clean, [np.uint32(32)]]).astype(np.uint32)
    keep = np.ones(len(clean), bool)
    keep[1:] = (clean[1:] != 32) | (clean[:-1] != 32)
    return clean[keep]


def ngram_columns(codes: np.ndarray, longest: int = LONGEST, bits: int = WIDTH_BITS) -> np.ndarray:
    """The hashed column of every n-gram, repeats included."""
    out, rolling = [], np.zeros(len(codes), np.uint32)
    for n in range(1, longest + 1):
        if len(codes) < n:
            break
        rolling = rolling[:len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1:] * np.uint32(0x9E3779B1)
        mixed = (rolling ^ (rolling >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n * 0x632BE5AB & 0xFFFFFFFF)
        out.append(mixed >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The columns of a text and how often each occurs."""
    found = np.bincount(ngram_columns(letters(text or "")), minlength=WIDTH)
    at = np.flatnonzero(found)
    return at, found[at]


def tf_idf(columns: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit-length values; counts enter by their logarithm."""
    values = (1 + np.log(counts)) * idf[columns]
    norm = np.sqrt((values * values).sum())
    return values / norm if norm else values


@dataclass(frozen=True)
class Languages:
    names: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (WIDTH, languages)
    bias: np.ndarray
    temperature: float

    def logits(self, columns: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return tf_idf(columns, counts, self.idf) @ self.weights[columns] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        columns, counts = counted(text)
        if not len(columns) or not self.names:
            return UNKNOWN, 0.0
        p = _softmax(self.logits(columns, counts) / self.temperature)
        best = int(np.argmax(p))
        return self.names[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def follow_leader(rows: list[tuple[np.ndarray, np.ndarray]], classes: np.ndarray, n_classes: int, width: int = WIDTH, epochs: int = 2,
                  alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases after passes over (columns, values) rows with per-coordinate rates.

    A weight is zero until its summed gradients exceed ``l1``; ``l2`` shrinks the rest. The bias is
    the last column and is not penalised by ``l1``.
    """
    z, n = np.zeros((width + 1, n_classes)), np.zeros((width + 1, n_classes))
    slack = np.full((width + 1, 1), l1)
    slack[width] = 0.0

    def weights(at):
        zs = z[at]
        return np.where(np.abs(zs) <= slack[at], 0.0, -(zs - np.sign(zs) * slack[at]) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(8)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, values = np.append(rows[i][0], width), np.append(rows[i][1], 1.0)
            w = weights(at)
            error = _softmax(values @ w)
            error[classes[i]] -= 1.0
            gradient = values[:, None] * error
            squared = gradient * gradient
            z[at] += gradient - (np.sqrt(n[at] + squared) - np.sqrt(n[at])) / alpha * w
            n[at] += squared
    final = weights(np.arange(width + 1))
    return final[:width], final[width]


def calibrate(logits: np.ndarray, classes: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search on its logarithm."""
    if not len(logits):
        return 1.0

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), classes]).mean() + 1e-4 * log_t * log_t)

    low, high, ratio = -4.0, 4.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of documents with a letter, and in how many each column occurs, over all rows.

    A task adds up its documents and sends one row per column, so what is shuffled is bounded per
    task; ``WIDTH`` sums reach the driver.
    """
    def count(batches):
        total, found = 0, np.zeros(WIDTH, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                columns = ngram_columns(letters(text.as_py() or ""))
                occurs = np.zeros(WIDTH, bool)
                occurs[columns] = True
                found += occurs
                total += len(columns) > 0
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, WIDTH]), pa.array(np.r_[found[at], total])], names=["column", "documents"])

    rows = docs.select("text").mapInArrow(count, "column long, documents long").groupBy("column").agg(F.sum("documents").alias("n")).collect()
    out = np.zeros(WIDTH + 1, np.int64)
    for row in rows:
        out[row["column"]] = row["n"]
    return int(out[WIDTH]), out[:WIDTH]


def train(docs: DataFrame, most: int = 4_000) -> Languages:
    """Fit on the documents (doc_id, text, lang) that are not held out and have a lang."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out()).select(
        F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    total, documents = document_frequencies(usable)
    idf = np.log((1 + total) / (1 + documents)) + 1

    def to_counts(batches):
        for batch in batches:
            found = [counted(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), batch.column("calibrates"),
                 pa.array([c.astype("<u2").tobytes() for c, _ in found], pa.binary()), pa.array([n.astype("<u4").tobytes() for _, n in found], pa.binary())],
                names=["doc_id", "lang", "calibrates", "columns", "counts"])

    chosen = one_text_each(bounded_sample(usable, "lang", "doc_id", most), "doc_id", "lang").withColumn("calibrates", unit_hash("doc_id", 23) < 0.2)
    sample = chosen.mapInArrow(to_counts, "doc_id long, lang string, calibrates boolean, columns binary, counts binary").toPandas()
    sample = sample.sort_values(["doc_id", "lang"], kind="stable")
    rows = [(np.frombuffer(c, "<u2").astype(np.int64), np.frombuffer(n, "<u4")) for c, n in zip(sample["columns"], sample["counts"])]
    usable_rows = np.array([len(c) > 0 for c, _ in rows], bool)
    names = sorted(sample["lang"][usable_rows].unique().tolist()) if len(sample) else []
    if not names:
        return Languages([], idf, np.zeros((WIDTH, 0)), np.zeros(0), 1.0)
    classes = np.array([names.index(x) if ok else -1 for x, ok in zip(sample["lang"], usable_rows)])
    held = sample["calibrates"].to_numpy(bool)
    fits, checks = np.flatnonzero(usable_rows & ~held), np.flatnonzero(usable_rows & held)
    weights, bias = follow_leader([(rows[i][0], tf_idf(*rows[i], idf)) for i in fits], classes[fits], len(names))
    plain = Languages(names, idf, weights, bias, 1.0)
    logits = np.array([plain.logits(*rows[i]) for i in checks]).reshape(len(checks), len(names))
    return Languages(names, idf, weights, bias, calibrate(logits, classes[checks]))


def predict_languages(docs: DataFrame, most: int = 4_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    model = train(docs, most)
    # 2**15 columns times the languages, in single precision: a few megabytes at most.
    model = Languages(model.names, model.idf.astype(np.float32), model.weights.astype(np.float32), model.bias, model.temperature)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        known = sent.value
        for batch in batches:
            found = [known.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()),
                                              pa.array([x for _, x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", is_held_out())
    return keyed.select("doc_id", "held_out", "text").mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
