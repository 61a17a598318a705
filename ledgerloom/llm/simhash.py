"""SimHash near-duplicate detection with pigeonhole blocks.

A fingerprint has 64 bits, cut into six blocks. Two fingerprints that differ in at most three bits
agree on at least three whole blocks, so they share one of the twenty keys made of three blocks
(32 bits or so each). Keys are joined, pairs are verified by their Hamming distance, and what is
linked forms components. Only distinct fingerprints are compared; copies join by equality.

Keys that many fingerprints share (a large group of near copies) are not expanded into all pairs,
and lose no link all the same. Such a key links its members to its smallest one where they are
close enough. Where members of several components are left under a key, it is
refined: the bits that it leaves open are cut into eight parts, of which at least five agree, which
makes 56 finer keys; these are refined once more down to single bits, where at most eight
fingerprints can share a key. So the rows per fingerprint are bounded at every level.

Nulls and odd rows: a null or white-space text has no words and fingerprint zero, which links like
any other; fewer words than a shingle make one shingle; rows that share a doc_id are separate
documents with one id; a null doc_id is kept and takes the component of its fingerprint's others,
or null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.components import components
from ledgerloom.scratch import materialise

BITS, DISTANCE = 64, 3
# Up to so many fingerprints under one key are compared in pairs at once.
PAIRED = 24


# ---------------------------------------------------------------- fingerprints

def _majority(hashes: np.ndarray) -> int:
    bits = np.zeros(64, np.int64)
    for low in range(0, len(hashes), 4096):  # one long text needs no more memory than a short one
        bits += np.unpackbits(hashes[low:low + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.uint64)[0])


def text_fingerprint(text: bytes, words: int = 3) -> int:
    """The fingerprint of one UTF-8 text: a bit is set if it is set in over half the shingles' XXH64."""
    import xxhash

    found = text.lower().split()  # bytes: lower-cases A-Z and splits at the six ASCII white-space characters
    if not found:
        return 0
    if len(found) <= words:
        shingles = [b" ".join(found)]
    else:
        joined, at = b" ".join(found), np.zeros(len(found) + 1, np.int64)
        np.cumsum([len(w) + 1 for w in found], out=at[1:])
        shingles = [joined[a:b] for a, b in zip(at[:-words].tolist(), (at[words:] - 1).tolist())]
    digest = xxhash.xxh64_intdigest
    return _majority(np.fromiter((digest(s, 42) for s in shingles), np.uint64, len(shingles)))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint of every whole text as a signed long."""
    def compute(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            found = np.fromiter((text_fingerprint(t.as_py() or b"", words) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(compute, "doc_id long, text_hash long, fp long")


# ---------------------------------------------------------------- keys

def _parts(bits: list[int], parts: int) -> list[list[int]]:
    cuts = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(cuts, cuts[1:])]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def open_masks(bits: list[int], parts: int) -> list[int]:
    """Which bits the keys leave open: all choices of three of so many parts of ``bits``."""
    return [_mask(sum(chosen, [])) for chosen in combinations(_parts(bits, parts), DISTANCE)]


def _bits_of(mask: int) -> list[int]:
    return [b for b in range(BITS) if mask >> b & 1]


def _levels() -> list[dict[int | None, list[int]]]:
    """Per level, the finer masks of each mask of the level above."""
    first = open_masks(list(range(BITS)), 6)
    second = {m: open_masks(_bits_of(m), 8) for m in first}
    seconds = sorted({m for found in second.values() for m in found})
    return [{None: first}, second, {m: open_masks(_bits_of(m), len(_bits_of(m))) for m in seconds}]


def _keyed(members: DataFrame, level: int) -> DataFrame:
    """(open, key, fp): the members under their keys of a level; ``members`` has (fp) or (open, fp)."""
    finer = _levels()[level]
    if level == 0:
        masks = F.array(*[F.lit(m) for m in finer[None]])
        rows = members.select("fp", F.explode(masks).alias("open"))
    else:
        table = members.sparkSession.createDataFrame(
            [(m, f) for m, found in finer.items() for f in found], "open long, finer long")
        rows = (members.join(F.broadcast(table), "open")  # a fixed table: 20 x 56 or 560 x 220 rows
                .select("fp", F.col("finer").alias("open")).distinct())
    return rows.select("open", F.col("fp").bitwiseAND(F.bitwise_not("open")).alias("key"), "fp")


def _near(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DISTANCE


def hamming_links(fps: DataFrame) -> DataFrame:
    """(a, b): links of at most three bits that connect all that such links connect.

    ``fps`` has distinct fingerprints (fp). Not every link is listed: those inside a large group may
    be left out once the group is connected.
    """
    members, found = fps, []
    for level in range(3):
        keyed = _keyed(members, level)
        per_key = keyed.groupBy("open", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"))
        per_key = materialise(per_key.where("n > 1"), "simhash-keys")
        found.append(per_key.where(_near("lo", "hi")).select(F.col("lo").alias("a"), F.col("hi").alias("b")))
        crowded = per_key.where("n > 2")
        if crowded.isEmpty():
            break
        rows = materialise(keyed.join(crowded, ["open", "key"]), "simhash-crowded")
        found.append(rows.where((F.col("fp") != F.col("lo")) & _near("fp", "lo")).select(F.col("lo").alias("a"), F.col("fp").alias("b")))
        links = materialise(reduce(DataFrame.union, found).distinct(), "simhash-links")
        found = [links]
        at = components(links)
        rows = rows.join(at, F.col("fp") == F.col("node"), "left").withColumn("component", F.coalesce("component", "fp"))
        rows = materialise(rows.select("open", "key", "n", "fp", "component"), "simhash-mixed")
        mixed = rows.groupBy("open", "key").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a <> _b").drop("_a", "_b")
        rows = rows.join(mixed, ["open", "key"])
        few = rows.where(F.col("n") <= PAIRED)
        other = few.select("open", "key", F.col("fp").alias("fp2"), F.col("component").alias("component2"))
        pairs = few.join(other, ["open", "key"]).where((F.col("component") < F.col("component2")) & _near("fp", "fp2"))
        found.append(pairs.select(F.least("fp", "fp2").alias("a"), F.greatest("fp", "fp2").alias("b")))
        members = rows.where(F.col("n") > PAIRED).select("open", "fp")
        if members.isEmpty():
            break
    return materialise(reduce(DataFrame.union, found).distinct(), "simhash-links")


def with_groups(fps: DataFrame) -> DataFrame:
    """The rows of ``fps`` (doc_id, fp) with component_id, the smallest doc_id that can be reached over links of at most three bits."""
    fps = materialise(fps, "simhash-documents")
    per_fp = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    at = components(hamming_links(per_fp.select("fp")))
    per_fp = per_fp.join(at, F.col("fp") == F.col("node"), "left").withColumn("component", F.coalesce("component", "fp")).drop("node")
    least = per_fp.groupBy("component").agg(F.min("least").alias("component_id"))
    named = per_fp.join(least, "component").select("fp", "component_id")
    return fps.join(named, "fp")


def near_duplicates(fps: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of the documents in ``fps`` (doc_id, fp)."""
    return with_groups(fps).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- one document of each group

def without_near_copies(docs: DataFrame, words: int = 3) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id, all columns kept.

    Rows without a doc_id stay. Of rows that share the id that stays one row stays, of those that
    lead their group that with the smallest text hash.
    """
    heads = with_groups(fingerprints(docs.where("doc_id is not null"), words)).where("doc_id = component_id")
    heads = heads.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    heads = heads.groupBy(F.col("doc_id").alias("_id")).agg(F.min(F.struct("text_hash", "n")).alias("_head"))
    kept = docs.join(heads, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_head.text_hash")))
    once = kept.where("_head.n = 1").select(*docs.columns)
    repeated = kept.where("_head.n > 1").dropDuplicates(["doc_id"]).select(*docs.columns)
    return once.union(repeated).union(docs.where("doc_id is null"))
