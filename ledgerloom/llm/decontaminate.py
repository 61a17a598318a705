"""Benchmark decontamination by spaced seeds, in DataFrame operations alone.

Texts become words: lower case, runs of letters and digits. A seed is a fixed mask over consecutive
words, such as 1101100101111; the words under its ones are hashed, those under its zeros may
differ. Documents and benchmark items are joined on (mask, hash); a hit fixes how the two are
aligned. Around hits the alignment is verified word by word. It counts if any of these holds:

* 13 words in a row of which at least 11 are equal;
* the best stretch, where an equal word counts 1 and a different one -2, scores 12, or 0.55 of the
  item's words if that is less;
* the item has less than nine words, and all of them are there, in a row (items of one to three
  words: and the document has no others, as such items stand in any text).

Items of less than nine words have a seed of their own, the hash of the whole item. The masks find
every place of one substituted word in 13 and of two in 20; of the 78 places of two in 13 words they
miss 11, of the 105 in 15 none.

Documents' seeds are never shuffled where the benchmark's hashes are few (their number is counted
and a size bound checked): they are broadcast and probed where the text is read. Otherwise the
join is by hash, and Spark's runtime filters thin the documents' side. Only documents with a hit
are read again and aligned.

Nulls and odd rows: null, empty and one-word texts have no seeds; equal items are one item with the
smallest item_id (null last); documents that share a doc_id are all searched and reported under it;
a null doc_id is reported as null; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.scratch import materialise

# Fixed masks: eight or nine of 9 to 13 words.
MASKS = ("110111111", "1110100110111", "1101011001111", "1111101011")
SPAN, SHORTEST = max(map(len, MASKS)), min(map(len, MASKS))
PENALTY = 2
LEAST_SCORE, LEAST_SHARE = 12, 0.55
WINDOW, LEAST_EQUAL = 13, 11
ALONE_BELOW = 4  # items with fewer words count only where they are the whole document
# Benchmark hashes (24 bytes each) that may be broadcast: about 50 MB.
BROADCAST_SEEDS = 2_000_000
ABSENT = 0


def words(text: str = "text") -> Column:
    """The array of a text's words."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), "")


def seeds(words_table: DataFrame, keys: list[str], whole: tuple[int, ...] = (), of_items: bool = False) -> DataFrame:
    """(keys, position, seed): one row per mask and position where it fits; ``words_table`` has (keys, words).

    ``whole`` lists lengths below the shortest mask that some item has: these words in a row are a
    seed too, of items only if they are the whole item.
    """
    masks = [(k, m) for k, m in enumerate(MASKS)] + [(-n, "1" * n) for n in whole]
    used = sorted({i for _, m in masks for i, c in enumerate(m) if c == "1"})
    hashed = F.transform("words", lambda w: F.xxhash64(w))
    padded = words_table.select(*keys, F.concat(hashed, F.array_repeat(F.lit(ABSENT).cast("long"), SPAN - 1)).alias("_h"),
                                F.size("words").alias("_n")).where("_n >= %d" % min(len(m) for _, m in masks))
    shifted = F.arrays_zip(*[F.slice("_h", i + 1, F.col("_n")).alias(f"w{i}") for i in used])
    rows = padded.select(*keys, "_n", F.posexplode(shifted).alias("position", "_w"))

    def fits(k: int, m: str) -> Column:
        there = F.col(f"_w.w{len(m) - 1}") != ABSENT
        return there & (F.col("_n") == len(m)) if k < 0 and (of_items or len(m) < ALONE_BELOW) else there

    per_mask = [F.when(fits(k, m), F.xxhash64(F.lit(k), *[F.col(f"_w.w{i}") for i, c in enumerate(m) if c == "1"])) for k, m in masks]
    return rows.select(*keys, "position", F.explode(F.array(*per_mask)).alias("seed")).where("seed is not null")


def distinct_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, item_words) with equal word sequences once."""
    return benchmark.select("item_id", words().alias("item_words")).groupBy("item_words").agg(F.min("item_id").alias("item_id"))


def _points(document: str, item: str, shift: str) -> Column:
    """1 for an equal word and -2 for a different one, over the item's words from ``_low`` that meet the document."""
    high = F.least(F.size(item), F.size(document) - F.col(shift))
    return F.zip_with(F.slice(document, F.col("_low") + F.col(shift) + 1, high - F.col("_low")), F.slice(item, F.col("_low") + 1, high - F.col("_low")),
                      lambda a, b: F.when(a == b, 1).otherwise(-PENALTY))


def _dense(points: str) -> Column:
    """Whether ``WINDOW`` words in a row have ``LEAST_EQUAL`` equal ones."""
    least = LEAST_EQUAL - PENALTY * (WINDOW - LEAST_EQUAL)
    total = lambda i: F.aggregate(F.slice(points, i, F.lit(WINDOW)), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(points) >= WINDOW, F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(points) - WINDOW + 1)), lambda i: total(i) >= least)).otherwise(False)


def _alignment(points: str) -> Column:
    """(score, begin, end) of the best stretch; begin and end are words of the item, end exclusive."""
    low = F.col("_low")
    start = F.struct(F.lit(0).alias("run"), low.alias("from"), low.alias("at"), F.lit(0).alias("score"), low.alias("begin"), low.alias("end"))

    def step(s, x):
        run = F.when(s["run"] > 0, s["run"]).otherwise(0) + x
        since = F.when(s["run"] > 0, s["from"]).otherwise(s["at"])
        better = run > s["score"]
        return F.struct(run.alias("run"), since.alias("from"), (s["at"] + 1).alias("at"),
                        F.when(better, run).otherwise(s["score"]).alias("score"),
                        F.when(better, since).otherwise(s["begin"]).alias("begin"),
                        F.when(better, s["at"] + 1).otherwise(s["end"]).alias("end"))

    return F.aggregate(points, start, step, lambda s: F.struct(s["score"], s["begin"], s["end"]))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified overlaps: doc_id, item_id, shift (document word minus item word), score, item_begin, item_end, item_words."""
    items = distinct_items(benchmark)
    # The lengths of short items, eight at most.
    whole = tuple(r[0] for r in items.select(F.size("item_words").alias("n")).where(F.col("n").between(1, SHORTEST - 1)).distinct().orderBy("n").collect())
    item_seeds = seeds(items.withColumnRenamed("item_words", "words"), ["item_id"], whole, True).select(
        "item_id", F.col("position").alias("item_position"), F.col("seed"))
    few = item_seeds.count() <= BROADCAST_SEEDS
    found = seeds(docs.select("doc_id", words().alias("words")), ["doc_id"], whole)
    hits = found.join(F.broadcast(item_seeds) if few else item_seeds, "seed")
    # Stored: the texts are thinned by it and aligned with it.
    pairs = materialise(hits.select("doc_id", "item_id", (F.col("position") - F.col("item_position")).alias("shift")).distinct(), "leak-places")
    texts = docs.select(F.col("doc_id").alias("_doc"), "text").join(
        pairs.select(F.col("doc_id").alias("_hit")).distinct(), F.col("_doc").eqNullSafe(F.col("_hit")), "left_semi")
    texts = texts.select("_doc", words().alias("words"))
    placed = (pairs.join(items.select(F.col("item_id").alias("_item"), "item_words"), F.col("item_id").eqNullSafe(F.col("_item")))
              .join(texts, F.col("doc_id").eqNullSafe(F.col("_doc")))
              .withColumn("_low", F.greatest(F.lit(0), -F.col("shift"))))
    placed = placed.select("doc_id", "item_id", "shift", "_low", F.size("item_words").alias("item_words"), F.size("words").alias("_words"),
                           _points("words", "item_words", "shift").alias("_points"))
    aligned = placed.select("doc_id", "item_id", "shift", "item_words", "_words", _alignment("_points").alias("_a"), _dense("_points").alias("_dense"))
    n = F.col("item_words")
    least = F.least(F.lit(LEAST_SCORE), F.ceil(F.lit(LEAST_SHARE) * n).cast("int"))
    short = (F.col("_a.score") == n) & ((n >= ALONE_BELOW) | (F.col("_words") == n))
    return (aligned.where(F.when(n < SHORTEST, short).otherwise(F.col("_dense") | (F.col("_a.score") >= least)))
            .select("doc_id", "item_id", "shift", F.col("_a.score").alias("score"), F.col("_a.begin").alias("item_begin"),
                    F.col("_a.end").alias("item_end"), "item_words"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item: doc_id, item_id, best score, number of places, item_words."""
    return (overlaps(docs, benchmark).distinct().groupBy("doc_id", "item_id", "item_words")
            .agg(F.max("score").cast("long").alias("score"), F.count(F.lit(1)).alias("places"))
            .select("doc_id", "item_id", F.col("item_words").cast("long").alias("item_words"), "score", "places"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a verified overlap, all columns kept."""
    hit = overlaps(docs, benchmark).select(F.col("doc_id").alias("_leak_doc")).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("_leak_doc")), "left_anti")
