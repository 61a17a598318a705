"""The token store: exact round trips, the minimal perfect hash, pieces against whole texts."""

import random
import zlib

import numpy as np
import pytest

from ledgerloom.llm import queries, token_store as store


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(queries.byte_bpe())


def test_pieces_give_the_ids_of_whole_texts(tokenizer):
    rng = random.Random(2)
    bits = ["a", "The", " ", "  ", "\n", "\t", " \n ", " ", " ", "é", "ß", "1", "23", "'s", "'", "don't", ".", "!!", "<|endoftext|>", "\x1c", "\x85", "日本", "🙂", "　x"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["", None]
    encode = store.Encoder(queries.byte_bpe(), False, 2)
    for low in range(0, len(texts), 100):
        for text, found in zip(texts[low:low + 100], encode(texts[low:low + 100])):
            assert np.frombuffer(found, "<u2").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_a_small_memo_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(store, "MEMO_PIECES", 5)
    encode = store.Encoder(queries.byte_bpe(), True, 2)
    for text in ("a b c d e f g h", "h g f e d c b a z", "a a a", "one two a b"):
        assert np.frombuffer(encode([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("n", [0, 1, 2, 37, 5000])
def test_minimal_perfect_hash(n):
    hashes = store.key_hash(np.arange(n) * 977 - 5, np.zeros(n, np.int64))
    levels = store.build_levels(hashes)
    assert sorted(store.slots(levels, hashes).tolist()) == list(range(n))
    data = store._index_bytes(levels, np.zeros(n, store.ENTRY))
    again, entries = store._index_from(data)
    assert len(entries) == n and all((a == b).all() for a, b in zip(levels, again))
    if n > 100:
        assert sum(len(x) for x in levels) < 8 * n  # bits


def test_round_trip(spark, documents, tokenizer):
    rows = [(i * 3 % 101, f"text {i} " * (i % 9)) for i in range(101)] + [(None, "no id"), (500, None), (501, ""), (7, "again"), (7, "again"), (600, "long word " * 20000)]
    table = documents(rows)
    kept = store.write_store(table, queries.byte_bpe(), 2, 50257)
    found = store.read_documents(store.document_keys(table), kept).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(found) == len(rows)
    texts, at = {}, 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 2
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        texts.setdefault(r.doc_id, []).append(tokenizer.decode(r.ids[:-1]))
        at += r.n_tokens
    assert [r.doc_id for r in sorted(found, key=lambda r: r.start)] == [r[0] for r in ordered]
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(t or "")
    assert {k: sorted(v) for k, v in texts.items()} == {k: sorted(v) for k, v in want.items()}
    missing = spark.createDataFrame([(123456, 0), (7, 9), (7, 1)], "doc_id long, copy long")
    assert [(r.doc_id, r["copy"]) for r in store.look_up(missing, kept).collect()] == [(7, 1)]


def test_empty_table(documents):
    assert store.store_digest(documents([]), queries.byte_bpe(), 2, 50257).count() == 0
