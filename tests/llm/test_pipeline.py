"""The pipeline's stages against plain versions, each on its own input."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from ledgerloom.llm import quality, queries, simhash

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from ledgerloom.scratch import materialise
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], FOLDER), "stage"))
    return [[r.asDict() for r in d.collect()] for d in out]


def test_columns_and_rows(stages):
    first = list(stages[0][0])
    assert all(list(r) == first for stage in stages[1:5] for r in stage)
    originals = {r["doc_id"]: r for r in stages[0]}
    assert all(r == originals[r["doc_id"]] for stage in stages[1:5] for r in stage)


def test_quality(spark, stages):
    model = quality.train(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    want = {r["doc_id"] for r in stages[0] if model.scores(np.array([quality.statistics((r["text"] or "").encode())]))[0] >= 0.3}
    assert {r["doc_id"] for r in stages[1]} == want


def test_near_copies(stages):
    prints = {r["doc_id"]: simhash.text_fingerprint((r["text"] or "").encode()) for r in stages[1]}
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {r["doc_id"] for r in stages[2]} == {find(d) for d in prints}


def test_decontamination(spark, stages):
    bench = [(r.text or "").lower().split() for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    grams = {tuple(w[i:i + 12]) for w in bench for i in range(len(w) - 11)}
    hit = {r["doc_id"] for r in stages[2] for w in [(r["text"] or "").lower().split()] if any(tuple(w[i:i + 12]) in grams for i in range(len(w) - 11))}
    assert {r["doc_id"] for r in stages[3]} == {r["doc_id"] for r in stages[2]} - hit


def test_mix_and_tokens(stages):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(queries.byte_bpe())
    counts = {}
    for r in stages[4]:
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert max(counts.values()) <= 3 and set(counts) <= {r["doc_id"] for r in stages[3]}
    at, texts = 0, {r["doc_id"]: r["text"] for r in stages[4]}
    found = sorted(stages[5], key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == sorted(r["doc_id"] for r in stages[4])
    for r in found:
        ids = np.array(tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_run_is_the_stages(spark, stages):
    assert sorted(map(str, (r.asDict() for r in corpus_pipeline.run(spark, FOLDER).collect()))) == sorted(map(str, stages[5]))
