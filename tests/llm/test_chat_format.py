"""Chat formatting: reversible escapes, exact loss masks, odd rows."""

import hashlib
import random

import numpy as np

from ledgerloom.llm import chat_format as chat, queries

SCHEMA = "conv_id long, turn long, role string, text string, size string, input_ids string"


def digests(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_escapes_are_reversible():
    rng = random.Random(4)
    bits = ["<", "|", "/", "<|", "<|/|", "<|turn|>", "<|says|>", "<|end|>", "a", " ", "é", "\n"]
    for _ in range(3000):
        turns = [("".join(rng.choice(bits) for _ in range(rng.randint(0, 3))), "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))) for _ in range(rng.randint(0, 4))]
        assert chat.parse(chat.render(turns)[0]) == turns


def test_mask_against_plain_overlap():
    rng = np.random.default_rng(6)
    for _ in range(200):
        edges = np.sort(rng.choice(200, 8, replace=False))
        begins, ends = edges[::2], edges[1::2]
        starts = rng.integers(0, 200, 40)
        stops = starts + rng.integers(0, 6, 40)
        want = [int(any(s < e and t > b and t > s for b, e in zip(begins, ends))) for s, t in zip(starts, stops)]
        assert chat.loss_mask(starts, stops, begins, ends).tolist() == want


def test_round_trip_of_odd_conversations(spark):
    rng = random.Random(9)
    bits = ["<|end|>", "<|endoftext|>", " a", "\n", "  ", "é", "日本", "🙂", "👩‍👩‍👧", "'s", "[INST]", "<", "|>", "x" * 30, "́"]
    conversations = {c: [(rng.choice(["user", "assistant", "system"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for _ in range(rng.randint(1, 9))] for c in range(60)}
    conversations[900] = [("assistant", "long text " * 30000)]
    rows = [(c, i, r, t, "x", "y") for c, turns in conversations.items() for i, (r, t) in enumerate(turns)]
    rows += [(901, None, "assistant", "first", "", ""), (901, 0, "assistant", None, "", ""), (901, 0, None, "b", "", ""), (None, 0, "assistant", "nobody", "", ""),
             (902, 1, "user", "same", "", ""), (902, 1, "user", "same", "", "")]
    conversations |= {901: [("assistant", "first"), ("", "b"), ("assistant", "")], None: [("assistant", "nobody")], 902: [("user", "same")] * 2}
    rng.shuffle(rows)
    found = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, SCHEMA), queries.byte_bpe())).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found} == {c: digests(t) for c, t in conversations.items()}


def test_ids_decode_to_the_text(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hello  there", "", ""), (1, 1, "assistant", "é 日本!", "", "")], SCHEMA)
    r = chat.format_conversations(rows, queries.byte_bpe()).first()
    assert chat.encoder(queries.byte_bpe()).decode(r.input_ids, skip_special_tokens=False) == r.text
    masked = [i for i, m in zip(r.input_ids, r.loss_mask) if m]
    assert chat.encoder(queries.byte_bpe()).decode(masked) == "é 日本!"


def test_empty_table(spark):
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], SCHEMA), queries.byte_bpe())).count() == 0
