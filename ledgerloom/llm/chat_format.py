"""Chat formatting: conversations as one text, one encoding and a loss mask aligned by offsets.

The template writes, per turn, ``<|turn|>role<|says|>text<|end|>``. Inside roles and texts every
``<|`` becomes ``<|/|``, which the template never writes, so a text cannot forge a marker; reading
back turns ``<|/|`` into ``<|`` again. (A text that holds ``<|/|`` itself becomes ``<|/|/|`` and
comes back right, as its first two characters are escaped like any others.)

A conversation is rendered whole and encoded once. The markers are special tokens of the encoder,
so no token reaches across the edge of a turn's text. A token belongs to the loss if its character
range overlaps the text of an assistant turn; those ranges are sorted and disjoint, and each token
finds its range by binary search.

Rows are shuffled by conversation and sorted inside partitions, and a task holds one conversation
at a time: a training sample has to fit in a task's memory, the table does not.

Nulls and odd rows: null texts and roles are empty; rows without a conv_id are the conversation
null; turns that share a number are ordered by role and text; null turns come first; a conversation
without an assistant has an empty loss; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TURN, SAYS, END = MARKERS = ("<|turn|>", "<|says|>", "<|end|>")
OPEN, ESCAPED = "<|", "<|/|"
FORMATTED = ("conv_id long, text string, input_ids array<int>, token_start array<int>, token_end array<int>, "
             "loss_mask array<byte>")
# Characters of text that go to the encoder in one call.
BATCH_CHARS = 1 << 20


def escape(text: str) -> str:
    return text.replace(OPEN, ESCAPED)


def unescape(text: str) -> str:
    return text.replace(ESCAPED, OPEN)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[int], list[int]]:
    """The formatted text and the begins and ends of the assistant texts in it, in order."""
    parts, at, begins, ends = [], 0, [], []
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{SAYS}", escape(text)
        if role == "assistant":
            begins.append(at + len(head))
            ends.append(at + len(head) + len(body))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), begins, ends


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for part in formatted.split(TURN)[1:]:
        role, text = part.removesuffix(END).split(SAYS, 1)
        turns.append((unescape(role), unescape(text)))
    return turns


def loss_mask(starts: np.ndarray, stops: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """1 for each token range that overlaps a span; the spans are sorted and disjoint."""
    if not len(begins) or not len(starts):
        return np.zeros(len(starts), np.int8)
    span = np.searchsorted(begins, stops, side="left") - 1  # the last span that begins before the token ends
    inside = (span >= 0) & (starts < ends[np.maximum(span, 0)]) & (stops > starts)
    return inside.astype(np.int8)


_encoders: dict[str, object] = {}


def encoder(path: str):
    """The byte-level encoder with the markers as special tokens and untrimmed offsets, one per worker."""
    if path not in _encoders:
        from tokenizers import AddedToken, Tokenizer, processors

        made = Tokenizer.from_file(path)
        made.post_processor = processors.ByteLevel(trim_offsets=False)
        made.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in MARKERS])
        _encoders[path] = made
    return _encoders[path]


def format_conversations(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text): text, ids, offsets and loss mask."""

    def conversations(batches) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
        current, turns = None, None
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if turns is None or conv != current:
                    if turns is not None:
                        yield current, turns
                    current, turns = conv, []
                turns.append((role or "", text or ""))
        if turns is not None:
            yield current, turns

    def write(batches):
        encode = encoder(tokenizer_path)

        def flush(held):
            texts = [text for _, text, _, _ in held]
            columns = {name: [] for name in ("input_ids", "token_start", "token_end", "loss_mask")}
            for found, (_, _, begins, ends) in zip(encode.encode_batch(texts, add_special_tokens=False), held):
                offsets = np.array(found.offsets, np.int32).reshape(-1, 2)
                starts, stops = offsets[:, 0], offsets[:, 1]
                mask = loss_mask(starts, stops, np.array(begins, np.int64), np.array(ends, np.int64))
                for name, values in zip(columns, (found.ids, starts, stops, mask)):
                    columns[name].append(values)
            arrays = [pa.array([c for c, *_ in held], pa.int64()), pa.array(texts)]
            arrays += [pa.array(columns[n], pa.list_(pa.int8() if n == "loss_mask" else pa.int32())) for n in columns]
            return pa.RecordBatch.from_arrays(arrays, names=["conv_id", "text", *columns])

        held, chars = [], 0
        for conv, turns in conversations(batches):
            held.append((conv, *render(turns)))
            chars += len(held[-1][1])
            if chars >= BATCH_CHARS:
                yield flush(held)
                held, chars = [], 0
        if held:
            yield flush(held)

    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    ordered = turns.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    return ordered.drop("turn").mapInArrow(write, FORMATTED)


def loss_text(formatted: str, starts: np.ndarray, stops: np.ndarray, mask: np.ndarray) -> str:
    """What the tokens under the mask cover, each character once, unescaped turn by turn."""
    low, high = starts[mask == 1], stops[mask == 1]
    if not len(low):
        return ""
    # Tokens that share a character overlap and turns are never adjacent: gaps separate the texts.
    reach = np.maximum.accumulate(high)
    new = np.r_[True, low[1:] > reach[:-1]]
    firsts = np.flatnonzero(new)
    lasts = np.r_[firsts[1:] - 1, len(low) - 1]
    return "".join(unescape(formatted[low[a]:reach[b]]) for a, b in zip(firsts, lasts))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests computed from formatted rows alone; see the names of the columns.

    turns_sha256 is over role, line feed, text, line feed of each parsed turn; loss_sha256 is over the
    text under the loss mask.
    """
    def read(batches):
        for batch in batches:
            out = {name: [] for name in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            lists = [batch.column(c) for c in ("token_start", "token_end", "loss_mask")]
            for i, text in enumerate(batch.column("text").to_pylist()):
                turns = parse(text)
                loss = loss_text(text, *(x[i].values.to_numpy(zero_copy_only=False) for x in lists))
                out["n_turns"].append(len(turns))
                out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                out["loss_chars"].append(len(loss))
                out["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
                out["formatted_chars"].append(len(text))
            yield pa.RecordBatch.from_pydict({"conv_id": batch.column("conv_id"), **out})

    return formatted.select("conv_id", "text", "token_start", "token_end", "loss_mask").mapInArrow(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
