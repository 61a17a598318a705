"""Quality of whole documents: boosted trees over document statistics.

The statistics are computed from the text alone, in one pass over its bytes and one over its words.
The trees are fitted on at most about ``most`` labelled documents, an equal share of each class,
found by the hash of their ids (``most`` is the documented bound; scoring covers every document).
Held-out documents never train. The classes' true shares come back as weights in the base score.

Nulls and odd rows: a null text is an empty one, whose statistics are all zero, and gets a score; a
null label is no label; several labels of one document count as their largest; rows that share a
doc_id are scored one by one; a null doc_id is held out; an empty table gives an empty result, and
without labels every score is 0.5; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm import boosted_trees
from ledgerloom.llm.tables import bounded_sample, is_held_out, one_text_each

# Which bytes count as what; bytes over 127 are parts of letters beyond ASCII.
_CLASSES = np.full(256, 0)
_CLASSES[list(range(97, 123)) + list(range(128, 256))] = 1
_CLASSES[range(65, 91)] = 2
_CLASSES[range(48, 58)] = 3
_CLASSES[[32, 9, 11, 12, 13]] = 4
_CLASSES[10] = 5
_CLASSES[[ord(c) for c in ".,;:'\"()-?"]] = 6
_CLASSES[[ord(c) for c in "!"]] = 7
_CLASSES[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 8
CLASSES = 9
STATISTICS = ("log_bytes", "log_words", *[f"share_{c}" for c in ("other", "lower", "upper", "digit", "space", "line", "punctuation", "exclamation", "symbol")],
              "word_length", "distinct_words", "top_word", "next_same", "one_case", "symbol_words", "lines", "same_lines",
              "words_a_line", "sentence_ends", "longest_repeat", "long_words")


def statistics(text: bytes) -> list[float]:
    """The document statistics of one UTF-8 text, each a finite number; see STATISTICS."""
    raw = np.frombuffer(text, np.uint8)
    size = max(1, len(raw))
    share = np.bincount(_CLASSES, np.bincount(raw, minlength=256), CLASSES) / size
    words = text.split()
    n = max(1, len(words))
    distinct = set(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    same = np.fromiter(map(bytes.__eq__, words[1:], words), bool, max(0, len(words) - 1))
    top = max(np.unique(np.fromiter(map(hash, words), np.int64, len(words)), return_counts=True)[1], default=0)
    breaks = np.flatnonzero(~same)
    longest = int(np.diff(np.r_[-1, breaks, len(same)]).max()) if len(same) else 0
    lines = [line for line in text.split(b"\n") if line.strip()]
    ends = sum(text.count(c) for c in (b".", b"?", b"!"))
    alone = sum(1 for w in distinct if not w.isalnum() and len(w) < 4 and max(w) < 128)
    upper = sum(1 for w in distinct if w.isupper())
    return [np.log1p(len(raw)), np.log1p(len(words)), *share.tolist(), lengths.mean() if len(words) else 0.0, len(distinct) / n, top / n,
            same.sum() / n, upper / max(1, len(distinct)), alone / max(1, len(distinct)), np.log1p(len(lines)),
            1 - len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)), ends / n, np.log1p(longest), (lengths > 20).sum() / n]


def _with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    kinds = dict(docs.dtypes)

    def compute(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            values = [statistics(t.as_py() or b"") for t in texts]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(values, pa.list_(pa.float64()))], names=[*keep, "statistics"])

    return docs.select(*keep, "text").mapInArrow(compute, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", statistics array<double>")


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """(label_id, label) of documents that may train, one row each."""
    usable = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out())
    return usable.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max((F.col(column) > 0).cast("int")).alias("label"))


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", most: int = 16_000) -> boosted_trees.FlatTrees:
    """Fit on a class-balanced sample of about ``most`` labelled documents; the base score is set back to the classes' shares."""
    known = labelled(labels, column)
    chosen = bounded_sample(known, "label", "label_id", most)  # ids and labels only: its size is bounded by ``most``
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    rows = _with_statistics(one_text_each(texts, "label_id", "label"), ["label_id", "label"])
    found = rows.toPandas().sort_values("label_id", kind="stable")  # one row per chosen id
    x = np.array(found["statistics"].tolist(), float).reshape(len(found), len(STATISTICS))
    y = found["label"].to_numpy(float)
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = boosted_trees.fit(x, y)
    if 0 < y.sum() < len(y):
        true_odds, own_odds = shares[1] / shares[0], y.sum() / (len(y) - y.sum())
        model = boosted_trees.FlatTrees(**{**model.__dict__, "base": model.base + float(np.log(true_odds / own_odds))})
    return model


def scored(batch: pa.RecordBatch, model: boosted_trees.FlatTrees) -> np.ndarray:
    texts = batch.column("text").cast(pa.binary())
    x = np.array([statistics(t.as_py() or b"") for t in texts], float).reshape(len(texts), len(STATISTICS))
    return model.scores(x)


def accepted(docs: DataFrame, model: boosted_trees.FlatTrees, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, all columns as they are."""
    def compute(batches):
        for batch in batches:
            yield batch.filter(pa.array(scored(batch, model) >= threshold))

    return docs.mapInArrow(compute, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = train(docs, labels)

    def compute(batches):
        for batch in batches:
            found = scored(batch, model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found), pa.array((found >= threshold).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", is_held_out())
    return keyed.select("doc_id", "held_out", "text").mapInArrow(compute, "doc_id long, held_out boolean, score double, predicted int")
