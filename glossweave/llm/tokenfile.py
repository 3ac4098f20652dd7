"""Token ids in raw binary shards, and keyed access to them through a minimal perfect hash.

A shard holds a range of documents in ascending doc_id:

    32 bytes  b"GWIDS001", then big-endian: bytes per id u4, shard u4, documents u8, ids u8
    16 bytes a document, little-endian: doc_id i8, number of ids u8
    the ids of all documents, one after another, little-endian unsigned
    one line feed

Ids of vocabularies up to 65,536 take two bytes.  Shards go through Spark's own
writer (a text row is written byte for byte), so any file system will do, and a lost
task leaves no half file behind.

The index deals keys into buckets of about BUCKET; a bucket is one row with the
displacements of a minimal perfect hash and, slot by slot, the key's fingerprint,
shard, first id and number of ids.  A key is a doc_id and, for rows that share one,
their number among them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm import mph
from glossweave.llm.common import map_arrow, shared, written
from glossweave.llm.encode import encoder

MAGIC, HEAD, HEAD_SIZE, ENTRY, BUCKET = b"GWIDS001", ">8sIIQQ", 32, np.dtype([("key", "<i8"), ("n", "<u8")]), 16_384
#: Pieces of text whose ids a worker remembers.
MEMO = 600_000
#: A shard has at least so many rows, if there are so many.
SHARD_ROWS = 1000
#: Places of documents in shards travel to the shards up to this size, beyond it both meet in a shuffle.
BROADCAST_BYTES = 32 << 20
#: Shards whose sums of ids are added up in one task.
BLOCK = 4096
#: A null doc_id is stored as this key and comes first; a doc_id of this value is the same as null.
NULL = -(1 << 63)


def write_shards(docs: DataFrame, path: str, tokenizer: str, kind: str, end_id: int, width: int, shard_bytes: int) -> None:
    """Encode all documents (doc_id, text) into shards of about shard_bytes of the input, as Spark estimates its size."""
    docs = docs.select("doc_id", "text")
    # Spark knows a size from files' sizes alone, and makes up a huge one where there are no files.
    size, rows = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()), docs.count()
    shards = max(1, min(-(-size // shard_bytes), -(-rows // SHARD_ROWS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = encoder(tokenizer, kind, f"<u{width}", MEMO), end_id.to_bytes(width, "little")
        keys, counts, payload = [], [], []
        for batch in batches:
            keys += [NULL if k is None else k for k in batch.column(0).to_pylist()]
            for text in batch.column(1).to_pylist():
                payload += [encode(text), tail]
                counts.append(len(payload[-2]) // width + 1)
        if keys:
            entries = np.empty(len(keys), ENTRY)
            entries["key"], entries["n"] = keys, counts
            head = struct.pack(HEAD, MAGIC, width, TaskContext.get().partitionId(), len(keys), sum(counts))
            yield pa.RecordBatch.from_arrays([pa.array([b"".join([head, entries.tobytes(), *payload])], pa.binary())], ["shard"])

    ranged = docs.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    map_arrow(ranged, run, "shard binary").select(F.col("shard").cast("string")).write.text(path)


def parse(content: bytes) -> tuple[int, int, np.ndarray, int]:
    """Shard, bytes per id, entries, and where the ids begin."""
    magic, width, shard, docs, _ = struct.unpack_from(HEAD, content)
    if magic != MAGIC:
        raise ValueError("not a shard of token ids")
    return shard, width, np.frombuffer(content, ENTRY, docs, HEAD_SIZE), HEAD_SIZE + docs * ENTRY.itemsize


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where(F.col("length") >= HEAD_SIZE).select("content")


def _hash(key: np.ndarray, nth: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mph.mix(key.astype(np.int64).view(np.uint64), 7) + nth.astype(np.uint64)


def build_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, int]:
    """(index, one row per bucket; ids by shard; number of buckets)."""

    def directory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                shard, _, e, _ = parse(content.as_py())
                n = e["n"].astype(np.int64)
                nth = np.arange(len(e)) - np.searchsorted(e["key"], e["key"])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (e["key"], nth, np.full(len(e), shard, np.int64), np.cumsum(n) - n, n)], ["key", "nth", "shard", "first", "n"])

    entries = written(map_arrow(read_files(spark, path), directory, "key long, nth long, shard long, first long, n long"), "directory")
    buckets = max(1, entries.count() // BUCKET)

    def hashed(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = _hash(pdf["key"].to_numpy(), pdf["nth"].to_numpy())
        seeds = mph.build(keys)
        out = np.argsort(mph.find(seeds, len(keys), keys))
        cells = [mph.fingerprint(keys)[out], *(pdf[c].to_numpy()[out] for c in ("shard", "first", "n"))]
        return pd.DataFrame([[pdf["bucket"].iloc[0], len(keys), seeds.tobytes(), *(x.tobytes() for x in cells)]], columns=["bucket", "size", "seeds", "prints", "shards", "firsts", "ns"])

    index = _bucketed(entries, buckets).groupBy("bucket").applyInPandas(hashed, "bucket long, size long, seeds binary, prints binary, shards binary, firsts binary, ns binary")
    return written(index, "index"), entries.groupBy("shard").agg(F.sum("n").alias("ids")), buckets


def _bucketed(keys: DataFrame, buckets: int) -> DataFrame:
    return keys.withColumn("bucket", F.pmod(F.xxhash64("key", "nth"), F.lit(buckets)))


def look_up(index: DataFrame, keys: DataFrame, buckets: int) -> DataFrame:
    """(key, nth) to (key, nth, shard, first, n) of those the index has."""

    def found(wanted: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        out = wanted[["key", "nth"]].assign(shard=0, first=0, n=0)
        if not len(cells) or not len(wanted):
            return out[:0]
        c = cells.iloc[0]
        keys = _hash(wanted["key"].to_numpy(), wanted["nth"].to_numpy())
        at = mph.find(np.frombuffer(c["seeds"], np.int64), int(c["size"]), keys)
        for name, column in (("shard", "shards"), ("first", "firsts"), ("n", "ns")):
            out[name] = np.frombuffer(c[column], np.int64)[at]
        return out[np.frombuffer(c["prints"], np.uint32)[at] == mph.fingerprint(keys)]

    return _bucketed(keys, buckets).groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(found, "key long, nth long, shard long, first long, n long")


def fetch(spark: SparkSession, path: str, places: DataFrame, with_ids: bool = False) -> DataFrame:
    """(key, nth, shard, first, n) to (key, nth, shard, first, n, ids_crc32), or with ids instead of ids_crc32: reads each id range out of its shard.

    A place that isn't its key's own one in the shard's directory gives no row: it belongs
    to a key that was never stored, which a fingerprint lets pass with a chance of 2**-32.
    """
    kinds = "key long, nth long, shard long, first long, n long, " + ("ids array<long>" if with_ids else "ids_crc32 long")
    names = [x.split()[0] for x in kinds.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, cells in zip(batch.column(0), batch.column(1), strict=True):
                content, (key, nth, first, n) = content.as_py(), (cells.values.field(i).to_numpy() for i in range(4))
                shard, width, entries, base = parse(content)
                firsts = np.cumsum(entries["n"]).astype(np.int64) - entries["n"].astype(np.int64)
                at = np.minimum(np.searchsorted(firsts, first), len(entries) - 1)
                own = (entries["key"][at] == key) & (firsts[at] == first) & (entries["n"][at].astype(np.int64) == n)
                key, nth, first, n = (x[own] for x in (key, nth, first, n))
                ids = (np.frombuffer(content, f"<u{width}", m, base + width * a).astype("<u4") for a, m in zip(first, n, strict=True))
                last = pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())) if with_ids else pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (key, nth, np.full(len(key), shard), first, n)), last], names)

    wanted = written(places.groupBy("shard").agg(F.collect_list(F.struct("key", "nth", "first", "n")).alias("cells")), "places")
    small = (wanted.agg(F.sum(F.size("cells"))).first()[0] or 0) * 32 <= BROADCAST_BYTES
    shards = read_files(spark, path).withColumn("shard", F.conv(F.hex(F.substring("content", 13, 4)), 16, 10).cast("long"))
    met = shards.join(F.broadcast(wanted) if small else wanted, "shard").select("content", "cells")
    return map_arrow(met, read, kinds)


def before(totals: DataFrame) -> DataFrame:
    """(shard, before): ids of all shards before each, from (shard, ids); sums of blocks first, then within blocks."""
    t = totals.withColumn("block", F.floor(F.col("shard") / BLOCK))
    sums = "coalesce(sum(ids) over ({} rows between unbounded preceding and 1 preceding), 0)"
    blocks = t.groupBy("block").agg(F.sum("ids").alias("ids")).select("block", F.expr(sums.format("order by block")).alias("base"))
    own = t.select("shard", "block", F.expr(sums.format("partition by block order by shard")).alias("own"))
    return own.join(blocks, "block").select("shard", (F.col("base") + F.col("own")).alias("before"))


def get(spark: SparkSession, path: str, index: DataFrame, buckets: int, keys: DataFrame) -> DataFrame:
    """(doc_id, nth, ids) of keys (doc_id, and nth among the rows that share it, 0 if it isn't there): the raw ids of each document that is stored.

    A key that was never stored gives no row: its fingerprint differs, or, with a chance of
    2**-32, the directory of the shard says so.
    """
    nth = F.col("nth").cast("long") if "nth" in keys.columns else F.lit(0).cast("long")
    wanted = keys.select(F.coalesce("doc_id", F.lit(NULL)).alias("key"), nth.alias("nth")).distinct()
    places = look_up(index, wanted, buckets)
    found = fetch(spark, path, places, with_ids=True)
    return found.select(F.when(F.col("key") != F.lit(NULL), F.col("key")).alias("doc_id"), "nth", "ids")


def write_and_read(docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 2, width: int = 2, shard_bytes: int = 3 << 20) -> DataFrame:
    """Write the ids of all documents, index them, and read each document back by its key.

    Returns doc_id, start (ids of all documents before it), n_tokens and ids_crc32, a
    row for each row of docs.  Null or empty text: the end id alone.  A null doc_id
    comes first and stays null.  Rows with the same doc_id follow each other, ordered
    by text.  An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    path = f"{shared(spark)}/ids"
    write_shards(docs, path, tokenizer, kind, end_id, width, shard_bytes)
    index, totals, buckets = build_index(spark, path)
    keys = docs.groupBy(F.coalesce("doc_id", F.lit(NULL)).alias("key")).agg(F.count("*").alias("copies")).select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("nth"))
    rows = fetch(spark, path, look_up(index, keys, buckets))
    return rows.join(before(totals), "shard").select(F.when(F.col("key") != F.lit(NULL), F.col("key")).alias("doc_id"), (F.col("before") + F.col("first")).alias("start"), F.col("n").alias("n_tokens"), "ids_crc32")
