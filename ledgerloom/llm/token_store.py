"""Token ids as raw binary shards with a keyed index of minimal perfect hashes.

``write_store`` encodes documents, lays their ids out in ascending doc_id order and writes

* ``ids-<shard>.bin``: the ids of a contiguous range of documents, little-endian, two bytes each if
  the vocabulary allows, else four, nothing else;
* ``index-<bucket>.bin``: for the keys whose hash falls into the bucket, a minimal perfect hash
  (levels of bit arrays with ranks) and per slot the key's fingerprint, shard, offset in the shard,
  length and first position in the whole store.

A lookup hashes its key to one bucket and one slot and compares the fingerprint: constant time,
whatever the number of documents. ``read_documents`` does it for a table of keys.

Nulls and odd rows: a null or empty text is the end id alone; a null doc_id sorts first and has a
key of its own; documents with the same doc_id lie next to each other, ordered by text hash, and
their keys are (doc_id, 0), (doc_id, 1) and so on; an empty table gives no files; further columns
are ignored.

Files go to a folder that all executors share, through the file system that its URI names. A task
writes under a name of its own and renames at the end, and its content depends on its rows only,
so a task that runs again or twice leaves the same file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerloom.llm.pieces import MEMO_PIECES, IdEncoder, byte_slices
from ledgerloom.scratch import materialise, shared_root

NULL_KEY = -(1 << 63)
ENTRY = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("tokens", "<u8"), ("start", "<u8")])
KEYS_PER_BUCKET = 50_000
GAMMA = 2.0
READ_BYTES = 8 << 20


# ---------------------------------------------------------------- encoding

class Encoder:
    """Encodes whole texts and ends each with the end id."""

    def __init__(self, path: str, wide: bool, end_id: int):
        self.end_id, self.encode = end_id, IdEncoder(path, wide, MEMO_PIECES)

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts one after the other, how many each text has)."""
        return self.encode(texts, self.end_id)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        ids, counts = self.flat(pa.array(texts, pa.string()))
        ends = np.cumsum(counts)
        return [ids[a:b].tobytes() for a, b in zip(ends - counts, ends)]


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, wide: bool, end_id: int) -> Encoder:
    """One encoder per worker process, kept between tasks."""
    key = (path, wide, end_id)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


# ---------------------------------------------------------------- files

def _open(root: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(root)


def _publish(root: str, name: str, parts: Iterator[bytes]) -> None:
    """Write a file under a name of this attempt's own, then give it its name."""
    files, folder = _open(root)
    own = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(own) as out:
        for part in parts:
            out.write(part)
    files.move(own, f"{folder}/{name}")


# ---------------------------------------------------------------- minimal perfect hash

def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply, shift) of the keys under a salt."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def key_hash(doc_id: np.ndarray, copy: np.ndarray) -> np.ndarray:
    return _mixed(doc_id.astype(np.int64).view(np.uint64) ^ _mixed(copy.astype(np.uint64), 101), 7)


def _fingerprint(hashes: np.ndarray) -> np.ndarray:
    return (_mixed(hashes, 11) >> np.uint64(32)).astype(np.uint32)


def build_levels(hashes: np.ndarray) -> list[np.ndarray]:
    """Bit arrays, one per level: a key sets its bit on the first level where no other key wants it."""
    levels, left = [], np.asarray(hashes, np.uint64)
    while len(left):
        if len(levels) == 64:
            raise RuntimeError("two keys have the same 64-bit hash")
        places = (_mixed(left, 1000 + len(levels)) % np.uint64(max(8, int(GAMMA * len(left))))).astype(np.int64)
        wanted = np.bincount(places, minlength=max(8, int(GAMMA * len(left))))
        levels.append(wanted == 1)
        left = left[wanted[places] != 1]
    return levels


def slots(levels: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """The slot of each key, 0 to n - 1; -1 for a hash that cannot be a key."""
    out, open_, base = np.full(len(hashes), -1, np.int64), np.arange(len(hashes)), 0
    for number, bits in enumerate(levels):
        places = (_mixed(hashes[open_], 1000 + number) % np.uint64(len(bits))).astype(np.int64)
        found = bits[places]
        out[open_[found]] = base + np.cumsum(bits)[places[found]] - 1
        open_, base = open_[~found], base + int(bits.sum())
    return out


def _index_bytes(levels: list[np.ndarray], entries: np.ndarray) -> bytes:
    sizes = np.array([len(levels), len(entries), *[len(x) for x in levels]], "<u8")
    return sizes.tobytes() + b"".join(np.packbits(x).tobytes() for x in levels) + entries.tobytes()


def _index_from(data: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    n_levels, n = np.frombuffer(data, "<u8", 2).astype(int)
    sizes, at, levels = np.frombuffer(data, "<u8", n_levels, 16).astype(int), 16 + 8 * n_levels, []
    for size in sizes:
        width = (size + 7) // 8
        levels.append(np.unpackbits(np.frombuffer(data, np.uint8, width, at), count=size).astype(bool))
        at += width
    return levels, np.frombuffer(data, ENTRY, n, at)


# ---------------------------------------------------------------- writing

@dataclass(frozen=True)
class Store:
    root: str
    buckets: int
    wide: bool


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int, vocabulary: int, root: str | None = None) -> Store:
    """Encode ``docs`` (doc_id, text) and write shards and index under ``root`` (a new shared folder)."""
    spark = docs.sparkSession
    root = root or f"{shared_root(spark)}/token-store-{uuid.uuid4().hex}"
    files, folder = _open(root)
    files.create_dir(folder, recursive=True)
    wide = max(vocabulary, end_id + 1) > 65536

    def encode_and_write(batches):
        encode = encoder(tokenizer_path, wide, end_id)
        shard = TaskContext.get().partitionId()
        listed = []

        def payload():
            offset = row = 0
            for batch in batches:
                ids, texts = batch.column("doc_id"), batch.column("text")
                for low, high in byte_slices(texts):
                    encoded, lengths = encode.flat(texts.slice(low, high - low))
                    starts = offset + np.cumsum(lengths) - lengths
                    listed.append(pa.RecordBatch.from_arrays(
                        [ids.slice(low, high - low), pa.array(np.full(len(lengths), shard, np.int64)), pa.array(row + np.arange(len(lengths))),
                         pa.array(starts), pa.array(lengths)], names=["doc_id", "shard", "row", "offset", "tokens"]))
                    offset, row = offset + int(lengths.sum()), row + len(lengths)
                    yield encoded.tobytes()

        first = next(rest := payload(), None)
        if first is not None:
            def everything():
                yield first
                yield from rest
            _publish(root, f"ids-{shard:06d}.bin", everything())
        yield from listed

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_hash", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_first(), "_hash").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_hash")
    listed = materialise(ordered.select("doc_id", "text").mapInArrow(encode_and_write, "doc_id long, shard long, row long, offset long, tokens long"), "token-rows")

    earlier = W.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = listed.groupBy("shard").agg(F.sum("tokens").alias("_t"), F.count(F.lit(1)).alias("_r"))
    shards = shards.select("shard", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_tokens"), F.coalesce(F.sum("_r").over(earlier), F.lit(0)).alias("_rows"))
    placed = listed.join(shards, "shard").select(
        F.coalesce("doc_id", F.lit(NULL_KEY)).alias("doc_id"), "shard", "offset", "tokens",
        (F.col("_tokens") + F.col("offset")).alias("start"), (F.col("_rows") + F.col("row")).alias("_at"))
    first = placed.groupBy(F.col("doc_id").alias("_id")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    repeated = first.where("_n > 1").drop("_n")
    placed = (placed.join(repeated, F.col("doc_id") == F.col("_id"), "left")
              .withColumn("copy", F.coalesce(F.col("_at") - F.col("_first"), F.lit(0))).drop("_id", "_first", "_at"))
    buckets = max(1, -(-listed.count() // KEYS_PER_BUCKET))

    def build(frame):
        hashes = key_hash(frame["doc_id"].to_numpy(), frame["copy"].to_numpy())
        levels = build_levels(hashes)
        entries = np.zeros(len(hashes), ENTRY)
        at = slots(levels, hashes)
        entries["fingerprint"][at] = _fingerprint(hashes)
        for name in ("shard", "offset", "tokens", "start"):
            entries[name][at] = frame[name].to_numpy()
        bucket = int(frame["bucket"].iloc[0])
        _publish(root, f"index-{bucket:06d}.bin", iter([_index_bytes(levels, entries)]))
        return frame[["bucket"]].head(1)

    in_buckets = placed.withColumn("bucket", _bucket_of(buckets))
    materialise(in_buckets.groupBy("bucket").applyInPandas(build, "bucket long"), "token-index")
    return Store(root, buckets, wide)


def _bucket_of(buckets: int):
    return F.pmod(F.xxhash64("doc_id", F.col("copy").cast("long")), F.lit(buckets).cast("long"))


# ---------------------------------------------------------------- reading

def look_up(keys: DataFrame, store: Store) -> DataFrame:
    """The index entries of ``keys`` (doc_id, copy); keys that the store lacks have none."""
    def find(frame):
        files, folder = _open(store.root)
        name = f"{folder}/index-{int(frame['bucket'].iloc[0]):06d}.bin"
        if files.get_file_info(name).type != pa.fs.FileType.File:
            return frame.iloc[:0].reindex(columns=columns)
        with files.open_input_file(name) as data:
            levels, entries = _index_from(data.read())
        hashes = key_hash(frame["doc_id"].to_numpy(), frame["copy"].to_numpy())
        at = slots(levels, hashes)
        known = at >= 0
        known[known] = entries["fingerprint"][at[known]] == _fingerprint(hashes[known])
        out, got = frame.loc[known, ["doc_id", "copy"]], entries[at[known]]
        return out.assign(**{c: got[c].astype(np.int64) for c in ("shard", "offset", "tokens", "start")})

    columns = ["doc_id", "copy", "shard", "offset", "tokens", "start"]
    keyed = keys.select(F.coalesce("doc_id", F.lit(NULL_KEY)).alias("doc_id"), F.col("copy").cast("long").alias("copy"))
    return keyed.withColumn("bucket", _bucket_of(store.buckets)).groupBy("bucket").applyInPandas(
        find, ", ".join(f"{c} long" for c in columns))


def read_documents(keys: DataFrame, store: Store, digest_only: bool = False) -> DataFrame:
    """doc_id, copy, start, n_tokens, ids_crc32 and (unless ``digest_only``) the ids of the keyed documents."""
    kind, width = ("<u4", 4) if store.wide else ("<u2", 2)

    def read(batches):
        files, folder = _open(store.root)
        shard, source, held, held_at = None, None, np.zeros(0, "<u4"), 0
        for batch in batches:
            frame = batch.to_pandas()
            crc, ids = np.empty(len(frame), np.int64), []
            for i, (s, offset, tokens) in enumerate(zip(frame["shard"], frame["offset"], frame["tokens"])):
                if s != shard:
                    if source:
                        source.close()
                    shard, source, held, held_at = s, files.open_input_file(f"{folder}/ids-{s:06d}.bin"), np.zeros(0, "<u4"), 0
                if offset < held_at or offset + tokens > held_at + len(held):
                    read_bytes = source.read_at(max(tokens * width, READ_BYTES), offset * width)
                    held, held_at = np.frombuffer(read_bytes, kind).astype("<u4"), offset
                found = held[offset - held_at:offset - held_at + tokens]
                crc[i] = zlib.crc32(found)
                if not digest_only:
                    ids.append(found.copy())
            known = frame["doc_id"].to_numpy()
            columns = {"doc_id": pa.array(known, mask=known == NULL_KEY), "copy": pa.array(frame["copy"]), "start": pa.array(frame["start"]),
                       "n_tokens": pa.array(frame["tokens"]), "ids_crc32": pa.array(crc)}
            if not digest_only:
                columns["ids"] = pa.array(ids, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(columns)

    found = look_up(keys, store).repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")
    return found.mapInArrow(read, "doc_id long, copy long, start long, n_tokens long, ids_crc32 long" + ("" if digest_only else ", ids array<long>"))


def document_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, copy) of every row: rows with one doc_id are its copies 0, 1, 2 ..."""
    counts = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("copy"))


def store_digest(docs: DataFrame, tokenizer_path: str, end_id: int, vocabulary: int) -> DataFrame:
    """Write the store and read every document back by key: doc_id, start, n_tokens, ids_crc32."""
    store = write_store(docs, tokenizer_path, end_id, vocabulary)
    return read_documents(document_keys(docs), store, digest_only=True).select("doc_id", "start", "n_tokens", "ids_crc32")
