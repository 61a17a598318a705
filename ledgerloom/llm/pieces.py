"""Byte-level encoding of whole Arrow arrays of texts, one distinct piece at a time.

The byte-level pre-tokeniser never joins the last character of a run of white space to what stands
before it if something visible follows, so a text may be cut before such a space or line feed: the
pieces give the ids of the whole text. (Special strings are taken out before, so the run in front of
one ends a text of its own and is not cut.) A batch of texts is split in Arrow, its pieces are dictionary-encoded and looked up in a memo by a hash join, so
Python and the tokeniser see only distinct pieces that are new. What a text has is gathered by numpy
from the pieces.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Pieces that a worker remembers; beyond it the memo starts anew with the pieces of the last batch.
MEMO_PIECES = 1_000_000
# Bytes of text that are split at once, and pieces whose ids are gathered at once.
BATCH_BYTES = 16 << 20
PLACES = 500_000
STOPS = ".,;:!?"
# Letters of alphabets that all engines agree on.
LETTER = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0391-\u03a1\u03a3-\u03f5\u0400-\u0481\u048a-\u052f]"
# A single word of them is one piece of the pre-tokeniser, whole.
WORD = re.compile(f" ?{LETTER}+")
# What some engine takes for white space, besides the ASCII kinds.
WHITE = r"\x0b\x1c-\x1f\x85"


class Cuts:
    """Where texts may be cut, given the strings that the tokeniser takes out beforehand."""

    def __init__(self, special: list[str]):
        taken = "".join(f"|{re.escape(x)}" for x in special)
        self.place = re.compile(rf"(?=[ \n]\S)(?![ \n](?:[{WHITE}]{taken}))")
        #: Begins of pieces (without their space) that do not follow a safe cut.
        self.unsafe = rf"^(?:\n\n|\n?(?:$|[\t\f\r{WHITE}\pZ]{taken}))"


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is visible, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


def byte_slices(texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes; a row that has more is a range of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low, before = 0, 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield low, high
        low, before = high, int(ends[high - 1])


def cut_long(text: str, most: int, cuts: Cuts) -> list[str]:
    """The text in stretches of about ``most`` characters, cut where pieces begin."""
    parts, low = [], 0
    while len(text) - low > most:
        found = cuts.place.search(text, low + most)
        if not found:
            break
        parts.append(text[low:found.start()])
        low = found.start()
    return [*parts, text[low:]]


def split_pieces(texts: pa.Array, cuts: Cuts) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct pieces, which of them each place holds, first place of each text).

    A token never spans a letter and a stop behind it, so a word and the stops behind it are two places.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    coded = flat.dictionary_encode()
    unsafe = pc.match_substring_regex(coded.dictionary, cuts.unsafe).to_numpy(zero_copy_only=False)
    if unsafe.any():
        wrong = unsafe[coded.indices.to_numpy()]
        wrong[offsets[:-1] - offsets[0]] = False
        rows = np.unique(np.searchsorted(offsets - offsets[0], np.flatnonzero(wrong), side="right") - 1)
        if len(rows):
            again = [cuts.place.split(t) for t in texts.take(pa.array(rows)).to_pylist()]
            again = pa.array([[x[0], *(p.removeprefix(" ") for p in x[1:])] for x in again], pa.list_(pa.string()))
            order = np.arange(len(texts))
            order[rows] = len(texts) + np.arange(len(rows))
            lists = pa.concat_arrays([lists, again]).take(pa.array(order))
            flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
            coded = flat.dictionary_encode()
    first = offsets[:-1] - offsets[0]
    begins = flat.take(pa.array(first)).dictionary_encode()
    at = coded.indices.to_numpy().astype(np.int64)
    at[first] = len(coded.dictionary) + begins.indices.to_numpy()
    spaced = pc.binary_join_element_wise(pa.array([""] * len(coded.dictionary), pa.string()), coded.dictionary, " ")
    later = pc.if_else(pc.starts_with(coded.dictionary, "\n"), coded.dictionary, spaced)
    return _without_stops(pa.concat_arrays([later, begins.dictionary]), at, first)


def _without_stops(pieces: pa.Array, at: np.ndarray, first: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    heads = pc.utf8_rtrim(pieces, STOPS)
    two = pc.and_(pc.match_substring_regex(heads, f"{LETTER}$"), pc.not_equal(heads, pieces))
    tails = pc.struct_field(pc.extract_regex(pieces.filter(two), f"(?P<stops>[{STOPS}]+)$"), "stops")
    coded = pa.concat_arrays([pc.if_else(two, heads, pieces), tails]).dictionary_encode()
    codes, two = coded.indices.to_numpy().astype(np.int64), two.to_numpy(zero_copy_only=False)
    tail = np.zeros(len(pieces), np.int64)
    tail[two] = codes[len(pieces):]
    both = two[at]
    ends = np.cumsum(1 + both)
    places = np.repeat(codes[at], 1 + both)
    places[ends[both] - 1] = tail[at[both]]
    return coded.dictionary, places, np.r_[0, ends][first]


class Pieces:
    """The ids of pieces, remembered between batches.

    The memo is an Arrow array of pieces with their ids one after the other, so a batch is looked up by one
    hash join and Python sees only pieces that are new. A single word goes to the vocabulary's model at once,
    anything else through the whole tokeniser.
    """

    def __init__(self, path: str, kind: str, memo_pieces: int = MEMO_PIECES):
        self.tokenizer, self.kind, self.most = load_tokenizer(path), np.dtype(kind), memo_pieces
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.cuts = Cuts([t.content for t in self.tokenizer.get_added_tokens_decoder().values()])
        self.known, self.sizes, self.flat = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, self.kind)

    def __call__(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of many pieces, begin of each given piece's ids in them, their number)."""
        found = pc.index_in(pieces, value_set=self.known)
        new = pieces.filter(pc.is_null(found))
        sizes, flat = self._encoded(new.to_pylist())
        at = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        at[at < 0] = len(self.known) + np.arange(len(new))
        all_sizes, all_ids = np.r_[self.sizes, sizes], np.r_[self.flat, flat]
        starts = np.cumsum(all_sizes) - all_sizes
        out = all_ids, starts[at], all_sizes[at]
        if len(self.known) + len(new) <= self.most:
            self.known, self.sizes, self.flat = pa.concat_arrays([self.known, new]), all_sizes, all_ids
        elif len(pieces) <= self.most:  # begin anew with what this batch holds
            self.known, self.sizes, self.flat = pieces, out[2], gathered(*out)
        return out

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, all ids)."""
        sizes, parts = np.zeros(len(pieces), np.int64), []
        for low in range(0, len(pieces), 10_000):
            part = pieces[low:low + 10_000]
            word = [WORD.fullmatch(p) is not None for p in part]
            others = iter(self.tokenizer.encode_batch_fast([p for p, w in zip(part, word) if not w], add_special_tokens=False))
            ids = [[t.id for t in self.model.tokenize(p.encode().decode("latin-1").translate(self.letters))] if w else next(others).ids
                   for p, w in zip(part, word)]
            sizes[low:low + len(part)] = [len(x) for x in ids]
            parts.append(np.fromiter(chain.from_iterable(ids), self.kind))
        return sizes, np.concatenate(parts) if parts else np.zeros(0, self.kind)


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` with these begins and lengths, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class IdEncoder:
    """Whole texts to the ids that the tokeniser gives, laid out one after the other."""

    def __init__(self, path: str, wide: bool, memo_pieces: int = MEMO_PIECES):
        self.kind = np.dtype("<u4" if wide else "<u2")
        self.pieces = Pieces(path, self.kind.str, memo_pieces)

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by ``end_id``; number of ids per text with that one)."""
        distinct, at, first = split_pieces(texts, self.pieces.cuts)
        flat, starts, sizes = self.pieces(distinct)
        # The end id is one more piece, in a place behind each text.
        flat, starts, sizes = np.append(flat, np.array([end_id], self.kind)), np.append(starts, len(flat)), np.append(sizes, 1)
        places = np.insert(at, np.r_[first[1:], len(at)], len(distinct))
        counts = np.add.reduceat(sizes[at], first) + 1
        parts = [gathered(flat, starts[p], sizes[p]) for p in (places[low:low + PLACES] for low in range(0, len(places), PLACES))]
        return np.concatenate(parts), counts


class Counter:
    """Numbers of ids of whole texts."""

    def __init__(self, path: str, memo_pieces: int = MEMO_PIECES):
        self.pieces = Pieces(path, "<u4", memo_pieces)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        distinct, at, first = split_pieces(texts, self.pieces.cuts)
        return np.add.reduceat(self.pieces(distinct)[2][at], first)
