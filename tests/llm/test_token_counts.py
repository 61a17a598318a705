"""Token counts against the libraries on whole texts: the query, stretches of long texts, other kinds of files, odd rows."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerloom.llm import pieces, queries, token_counts

FOLDER = "/root/testdata/sf0.001"
BITS = ["a", "The", " ", "  ", "\n", "\n\n", "\t", " \n ", "\r\n", " ", "é", "ß", "1", "23", "'s", "don't", ".", "!!", ", ", "<|endoftext|>", "<|", "\x1c", "\x85",
        "日本", "🙂", "　x", "᠎", "​"]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(queries.byte_bpe())
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["", None, " ", "\n", "<|endoftext|>"]


def test_the_query(spark, plain):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = queries.op11_token_counts(spark, FOLDER).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in found} == {
        d: (len((t or "").encode()), plain(t), plain(t) > 1024) for d, t in docs.items()}
    assert len(found) == len(docs)


@pytest.mark.parametrize("most", [16, 300, 1 << 20])
def test_batches_and_stretches_change_nothing(plain, texts, most):
    long = " ".join(t or "" for t in texts[:200])
    assert token_counts.count_array(pa.array([*texts, long]), queries.byte_bpe(), most).tolist() == [plain(t) for t in [*texts, long]]


def test_stretches_are_bounded_and_whole():
    cuts = pieces.Cuts(["<|endoftext|>"])
    text = "word other\nline " * 1000
    parts = pieces.cut_long(text, 100, cuts)
    assert "".join(parts) == text and max(map(len, parts)) < 120
    assert pieces.cut_long("x" * 1000, 100, cuts) == ["x" * 1000]
    assert [high - low for low, high in pieces.byte_slices(pa.array(["a" * 50, "b" * 60, None, "c" * 500, "d"]), 120)] == [3, 1, 1]


def test_a_small_memo_changes_nothing(plain, texts):
    count = pieces.Counter(queries.byte_bpe(), 6)
    for low in range(0, 300, 10):
        assert count(pa.array(texts[low:low + 10])).tolist() == [plain(t) for t in texts[low:low + 10]]


def test_files_without_safe_cuts(texts):
    words = public_tokenizers.path("word_bpe_49k.json")
    assert not token_counts.has_safe_cuts(words) and token_counts.has_safe_cuts(queries.byte_bpe())
    whole = Tokenizer.from_file(words)
    assert token_counts.count_array(pa.array(texts), words, 300).tolist() == [len(whole.encode(t or "", add_special_tokens=False).ids) for t in texts]
    model = public_tokenizers.path("piece_bpe_32k.model")
    other = sentencepiece.SentencePieceProcessor(model_file=model)
    assert token_counts.count_array(pa.array(texts), model, 300).tolist() == [len(other.encode(t or "")) for t in texts]


def test_odd_rows(documents, plain):
    rows = [(1, None), (2, ""), (3, " \n\t "), (3, "twice"), (3, "twice"), (None, "no id"), (4, "long word, " * 30_000)]
    found = token_counts.token_counts(documents(rows), queries.byte_bpe(), 3, 10_000).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in found), key=key) == sorted(
        ((d, len((t or "").encode()), plain(t), plain(t) > 3) for d, t in rows), key=key)
    assert token_counts.token_counts(documents([]), queries.byte_bpe(), 3).count() == 0
