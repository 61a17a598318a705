"""Quality, language and toxicity models: held-out accuracy, contracts, odd rows, restoration."""

import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from ledgerloom.llm import boosted_trees, language_id, quality, queries, tables, toxicity

FOLDER = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int, text string, label string"
ODD = [(1, None), (2, ""), (3, " \n "), (4, "x"), (4, "x"), (None, "no id here"), (5, "日本語 🙂"), (6, "!!! 123 $$$"), (7, "word " * 40000)]


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.fixture(scope="module")
def truth(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    return docs, {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}


def test_trees_learn_and_flat_arrays_agree():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = boosted_trees.fit(x[:1500], y[:1500])
    assert ((model.scores(x[1500:]) > 0.5) == y[1500:]).mean() > 0.97

    def walk(row):
        total = model.base
        for node in model.roots:
            while model.left[node] != node:
                node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
            total += model.value[node]
        return 1 / (1 + np.exp(-total))
    assert np.allclose(model.scores(x[:50]), [walk(r) for r in x[:50]])
    assert boosted_trees.fit(np.zeros((0, 5)), np.zeros(0)).scores(np.zeros((2, 5))).tolist() == [0.5, 0.5]


@pytest.mark.parametrize(("query", "column", "least"), [(queries.op4_quality, "quality", 0.95), (queries.op10_toxicity, "toxic", 0.93)])
def test_held_out_accuracy(spark, truth, query, column, least):
    docs, labels = truth
    found = {r.doc_id: r for r in query(spark, FOLDER).collect()}
    assert set(found) == set(docs) and all(0 <= r.score <= 1 and r.held_out == held_out(d) for d, r in found.items())
    cut = 0.3 if column == "quality" else 0.5
    assert all(r.predicted == int(r.score >= cut) for r in found.values())
    checked = [(found[d].predicted, r[column]) for d, r in labels.items() if held_out(d)]
    assert np.mean([p == y for p, y in checked]) >= least


def test_language_accuracy(spark, truth):
    found = {r.doc_id: r for r in queries.op8_language_id(spark, FOLDER).collect()}
    docs, _ = truth
    checked = [found[d].lang_pred == r.lang for d, r in docs.items() if held_out(d)]
    assert np.mean(checked) >= 0.98 and all(r.held_out == held_out(d) for d, r in found.items())


def test_labels_of_held_out_documents_do_not_matter(spark, documents):
    rows = [(i, ("plain words of prose here. " if i % 2 else "$$$ ### &&& ") * (i % 9 + 1)) for i in range(300)]
    label = lambda flip: spark.createDataFrame([(i, (i % 2) ^ int(flip and held_out(i)), 0, "", "") for i in range(300)], LABELS)
    one, two = (sorted((r.doc_id, r.score) for r in quality.quality_scores(documents(rows), label(f)).collect()) for f in (False, True))
    assert one == two


def test_odd_rows(spark, documents):
    known = [(i, "der die das und nicht ein" if i % 2 else "the of and to in is", "de" if i % 2 else "en") for i in range(100, 300)]
    table = documents([(*r, None) for r in ODD] + known)
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0), "", "") for i in range(100, 300)] + [(100, None, None, "", ""), (None, 1, 1, "", "")], LABELS)
    for found in (quality.quality_scores(table, labels).collect(), toxicity.toxicity_scores(table, labels).collect()):
        assert len(found) == len(ODD) + 200 and all(0 <= r.score <= 1 for r in found)
        assert [r.held_out for r in found if r.doc_id is None] == [True]
    found = language_id.predict_languages(table).collect()
    assert len(found) == len(ODD) + 200
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1, 2, 3, 6)) and by_id[7].lang_pred in ("de", "en")
    assert np.mean([by_id[i].lang_pred == ("de" if i % 2 else "en") for i in range(100, 300)]) == 1


def test_empty_tables_and_no_labels(spark, documents):
    none = spark.createDataFrame([], LABELS)
    empty, some = documents([]), documents([(1, "some text"), (2, None)])
    assert quality.quality_scores(empty, none).count() == toxicity.toxicity_scores(empty, none).count() == language_id.predict_languages(empty).count() == 0
    assert {r.score for r in quality.quality_scores(some, none).collect()} == {0.5}
    assert {r.predicted for r in toxicity.toxicity_scores(some, none).collect()} == {0}
    unknown = documents([(1, "some text", None), (2, None, None)])
    assert {r.lang_pred for r in language_id.predict_languages(unknown).collect()} == {"und"}


def test_vectorised_ngrams_agree_with_plain_hash():
    for text in ("a", "The quick—brown fox", "été 日本 🙂ok"):
        codes = language_id.letters(text)
        found = sorted(language_id.ngram_columns(codes, 5, toxicity.LM_BITS).tolist())
        gram = "".join(map(chr, codes))
        assert found == sorted(toxicity.LanguageModel.column(gram[i:i + n]) for n in range(1, 6) for i in range(len(gram) - n + 1))


def test_restoration(spark, documents):
    prose = "you are such an idiot and a moron but the weather is nice today she said so it is a pathetic trash heap of stupid worthless scum"
    model = toxicity.LanguageModel(toxicity.character_counts(documents([(i, prose) for i in range(50)])))
    for written, meant in {"1d10t": "idiot", "m0r0n": "moron", "i d i o t": "idiot", "s.c.u.m": "scum", "idiooooot": "idiot", "$tup1d": "stupid", "p@thet1c": "pathetic",
                           "m-o-r-o-n": "moron", "tr4sh": "trash", "w0rthl3ss": "worthless"}.items():
        assert toxicity.restore(written, model) == meant
    reader = toxicity.Reader(model)
    assert reader.restored("weather") == ["weather"] and reader.restored("nice!!") == ["nice"] and reader.restored("3.14") == []
    assert toxicity.Reader.spaced("a b i d i o t nice a b") == ["a b i d i o t"] and toxicity.Reader.spaced("as it is up to me if so") == []
    insult = set(reader.features("idiot"))
    for written in ("i - d - i - o - t", "i . d . i . o . t", "id 10 t", "1d1%t", "ｉｄｉｏｔ", "ìdïót", "id\u200biot", "so ( i d i o t )"):
        assert insult <= set(reader.features(written)), written
    assert set(reader.features("moron")) <= set(reader.features("m%ron")) and set(reader.features("scum")) <= set(reader.features("5(^m"))
    weights = np.zeros(toxicity.FEATURES, np.float32)
    weights[list(reader.features("idiot"))[:2]] = 1.5
    few = toxicity.Reader(model, weights)
    for text in ("an 1d10t she said", "i d i o t", "nice weather", "", None):
        assert few.features(text).tolist() == [c for c in reader.features(text).tolist() if weights[c]]
    assert reader.restored("2024") == reader.restored("10.5%") == reader.restored("$!") == []
    assert reader.features("1d10t").tolist() == reader.features("idiot").tolist()
    assert set(reader.features("idiot")) <= set(reader.features("i d i o t"))  # the single letters are words as well
    assert toxicity.restore("1d10t " * 20000, model).split()[-1] == "idiot"


def test_repeated_ids_cannot_swell_the_sample(spark, documents):
    rows = documents([(2, f"text number {i}") for i in range(3000)] + [(i, f"other {i}") for i in range(3, 9)])
    found = tables.one_text_each(rows.select("doc_id", "text", "lang"), "doc_id", "lang").collect()
    assert sorted(r.doc_id for r in found) == [2, *range(3, 9)]
    labels = spark.createDataFrame([(i, i % 2, i % 2, "", "") for i in range(2, 9)], LABELS)
    one, two = (quality.train(t, labels).scores(np.zeros((1, len(quality.STATISTICS)))) for t in (rows, rows.orderBy(F.desc("text"))))
    assert one == two


def test_every_ngram_is_counted(spark, documents):
    from collections import Counter
    texts = ["the cat sat on the mat"] * 3 + ["été à la plage"] * 2 + [None, "", "xyz"]
    counts, plain = toxicity.character_counts(documents(list(enumerate(texts)))), Counter()
    for text in texts:
        padded = "".join(map(chr, language_id.letters(text or "")))
        plain.update(padded[i:i + n] for n in range(1, 6) for i in range(len(padded) - n + 1))
    assert len(counts.hashes) == sum(n >= 3 for n in plain.values())
    assert all(counts.of(toxicity.LanguageModel.column(g)) == (n if n >= 3 else 0) for g, n in plain.items())
