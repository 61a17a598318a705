"""Mixing: water-filled targets, exact totals, repeats, odd rows."""

import math

from ledgerloom.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((n for n in sizes if n is not None)) + [n for n in sizes if n is None]
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while True:
        rest = total - sum(target.values())
        share = {n: rest * weight[n] / sum(weight[m] for m in open_) for n in open_}
        above = {n for n in open_ if share[n] > most * sizes[n]}
        if not above:
            return {**target, **share}
        for n in above:
            target[n] = float(most * sizes[n])
        open_ -= above


def test_targets_totals_and_bounds(spark, documents):
    rows = [(i, "w " * (i % 17 + i % 7 * 3) if i % 5 else None, "en", f"s{i % 7}" if i % 11 else None) for i in range(700)]
    rows += [(10_000 + i, "hot " * 400, "en", "big") for i in range(60)] + [(3, "w w w", "en", "s3"), (None, "w w", "en", "s1")]
    found = [r.asDict() for r in mixing.taken_words(documents(rows), block_words=16).collect()]
    again = [r.asDict() for r in mixing.taken_words(documents(rows), block_words=16).collect()]
    key = lambda r: tuple(str(x) for x in r.values())
    assert sorted(found, key=key) == sorted(again, key=key) and len(found) == len(rows)
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = plain_targets(sizes)
    by_target = {}
    for r in found:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by_target.setdefault((r["source_size"], round(r["target"], 4)), []).append(r["taken"])
    for source, target in want.items():
        assert abs(sum(by_target[sizes[source], round(target, 4)]) - target) <= 0.5 + 1e-6


def test_schedule_is_spread_evenly(spark, documents):
    rows = [(i, "w " * 50, "en", f"s{i % 3}") for i in range(600)]
    laid, per_source, _ = mixing.mix(documents(rows), block_words=16)
    slots = mixing.schedule(per_source, 16).collect()
    target = {r.source_key: r.target for r in per_source.collect()}
    share = {k: v / sum(target.values()) for k, v in target.items()}
    for cut in (100, 500, 1500):
        for key, part in share.items():
            got = sum(1 for s in slots if s.slot < cut and s.source_key == key)
            assert abs(got - part * cut) <= 2 + math.log2(cut)
    ranks = {}
    for s in sorted(slots, key=lambda s: s.slot):
        ranks.setdefault(s.source_key, []).append((s.epoch, s.block))
    assert all(r == sorted(r) for r in ranks.values())


def test_segments_cover_documents_in_order(spark, documents):
    rows = [(i, "w " * (1 + i * 7 % 90), "en", f"s{i % 4}") for i in range(200)]
    laid, _, parts = mixing.mix(documents(rows), block_words=32)
    taken = {}
    for p in parts.collect():
        taken.setdefault((p.doc_id, p.epoch), []).append((p.from_word, p.n_words))
    for spans in taken.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))


def test_mixed_rows_keep_columns_and_repeat(spark, documents):
    rows = [(i, "w " * 40, "en", "a" if i < 20 else "b") for i in range(300)] + [(900, "", "en", "a"), (901, None, "en", None)]
    table = documents(rows)
    found = mixing.mixed_rows(table)
    assert found.columns == table.columns
    counts = {r.doc_id: r["count"] for r in found.groupBy("doc_id").count().collect()}
    assert all(counts[i] == 3 for i in range(20)) and counts[900] == counts[901] == 1
    assert max(counts.values()) == 3
    empty = documents([])
    assert mixing.mixed_rows(empty).count() == 0 and mixing.taken_words(empty).count() == 0
    assert [r.taken for r in mixing.taken_words(documents([(1, None), (2, "")])).collect()] == [0, 0]
