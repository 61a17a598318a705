"""Token counts of whole texts by batch encoding that returns lengths only.

An Arrow function takes the texts of a partition, deals them into batches of about equal bytes,
cuts a text that is longer than a batch at safe boundaries into stretches that go to batches like
short texts do, and adds the stretches' counts up per row. Nothing but three numbers per row leaves
the worker, and there is no shuffle: a row's count needs its row alone. A worker holds one batch
and its memo, whatever the lengths of the texts beside the row itself.

A boundary is safe where no token can cross it: before a space or line feed that something visible follows, for
byte-level vocabularies without a normaliser. Files of other kinds (other ``.json`` pre-tokenisers,
sentencepiece's ``.model``) have no boundary that holds for all of them, so their texts are encoded
whole, in batches of about equal bytes too.

Nulls and odd rows: a null or empty text has 0 bytes and 0 tokens; rows that share a doc_id are
counted each for itself and a null doc_id stays null; special strings inside texts count as the
library takes them by default; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.pieces import BATCH_BYTES, Counter, byte_slices, cut_long, load_tokenizer

COUNTED = "doc_id long, n_bytes long, n_tokens long"


def has_safe_cuts(path: str) -> bool:
    """Whether the file is a byte-level vocabulary whose texts may be cut in front of visible characters."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    before = made.get("pre_tokenizer") or {}
    plain = not made.get("normalizer") and not made.get("truncation") and not made.get("padding")
    tokens_apart = not any(t.get(k) for t in made.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word"))
    spaceless = not any(" " in t["content"] for t in made.get("added_tokens", []))
    return bool(plain and tokens_apart and spaceless and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space"))


class WholeCounter:
    """Counts of texts that are encoded whole, by the library that the file belongs to."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            tokenizer = load_tokenizer(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.lengths = lambda texts: [len(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: pa.Array) -> np.ndarray:
        return np.array(self.lengths(pc.fill_null(texts, "").to_pylist()), np.int64)


_counters: dict[str, tuple] = {}


def counter(path: str) -> tuple:
    """The counter of a file and whether its texts may be cut, one per worker process, kept between tasks."""
    if path not in _counters:
        cuts = has_safe_cuts(path)
        _counters[path] = (Counter(path) if cuts else WholeCounter(path), cuts)
    return _counters[path]


def count_array(texts: pa.Array, path: str, most: int = BATCH_BYTES) -> np.ndarray:
    """Tokens per text."""
    count, cuts = counter(path)
    out = np.zeros(len(texts), np.int64)
    for low, high in byte_slices(texts, most):
        part = texts.slice(low, high - low)
        if cuts and high == low + 1 and len(text := part[0].as_py() or "") > most:
            for stretches in byte_groups(cut_long(text, most // 4, count.pieces.cuts), most):
                out[low] += count(pa.array(stretches, pa.string())).sum()
        else:
            out[low:high] = count(part)
    return out


def byte_groups(stretches: list[str], most: int):
    """The stretches in groups of about ``most`` characters."""
    held, size = [], 0
    for stretch in stretches:
        if held and size + len(stretch) > most:
            yield held
            held, size = [], 0
        held.append(stretch)
        size += len(stretch)
    if held:
        yield held


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of every row."""
    def count(batches):
        for batch in batches:
            texts = batch.column("text")
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            found = pa.array(count_array(texts, tokenizer_path, batch_bytes), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, found], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, COUNTED).withColumn("over_limit", F.col("n_tokens") > limit)
