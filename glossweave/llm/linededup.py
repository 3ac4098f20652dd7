"""Line dedup that can be taken back: exact reference counts behind sharded cuckoo filters.

State, in tables of the shared folder:

    postings  (k1, k2, doc): which document holds which line key, a key being 128 bits
              of BLAKE2b of the normalized line
    counts    (k1, k2, refs, keeper): exact; keeper is the largest document
    filters   (shard, blob): a cuckoo filter of the keys with at least ``min_docs``
              references, sharded by the key

insert() adds documents, delete() takes them out, and both touch only the counts of
the keys concerned and only the filters of keys that cross ``min_docs``.  apply() sends
every distinct key of its documents to the filter of its shard, once, however many lines
have it; what a filter doesn't know stays, and what one knows is looked up in the counts,
which decide.  Filters never leave their shards: no task or driver holds all of them.

Counting is partial before the shuffle, so a line that every document has costs each
task one row, and the verdicts on such lines are broadcast, at most a thousand of them.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.functions.names import unused
from glossweave.llm.common import joined, map_arrow, written
from glossweave.llm.cuckoo import Cuckoo

#: Keys of a filter, about; keys that meet a filter in one call, about.
SHARD_KEYS, SLICE_KEYS = 50_000, 250_000
#: Stands for a null doc_id: the smallest document.  A doc_id of this value is the same as null.
NULL = -(1 << 63)
_SPACE = b" \t\n\x0b\x0c\r"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
KEY = "k1 long, k2 long"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """16 bytes for a line that can be dropped, None for one that is too short."""
    key = line.strip(_SPACE)
    if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
        return None
    return hashlib.blake2b(key.translate(_LOWER), digest_size=16).digest()


def _pairs(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)


def postings(docs: DataFrame, min_chars: int) -> DataFrame:
    """(k1, k2, doc), each key once per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owners = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = {k for line in (text.as_py() or "").encode().split(b"\n") if (k := line_key(line, min_chars))}
                keys += own
                owners += [NULL if doc is None else doc] * len(own)
            pairs = _pairs(keys)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(owners, pa.int64())], ["k1", "k2", "doc"])

    return map_arrow(docs.select("doc_id", "text"), run, f"{KEY}, doc long")


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("k1", "k2").agg(F.count("*").alias("refs"), F.max("doc").alias("keeper"))


def _shard(shards: int) -> Column:
    return F.pmod(F.col("k1"), F.lit(shards))


class LineIndex:
    """Lines of all documents inserted so far.

    Each inserted row counts as one document, whatever its doc_id; of rows that share
    the largest doc_id, all keep the line.  A null doc_id is the smallest.  Null or
    empty text is one empty line, which has no key.
    """

    def __init__(self, spark: SparkSession, min_docs: int = 3, min_chars: int = 20):
        self.min_docs, self.min_chars = min_docs, min_chars
        self.postings = spark.createDataFrame([], f"{KEY}, doc long")
        self.counts = spark.createDataFrame([], f"{KEY}, refs long, keeper long")
        self.filters = spark.createDataFrame([], "shard long, blob binary")
        self.shards, self.empty = 0, True

    def insert(self, docs: DataFrame) -> LineIndex:
        new = written(postings(docs, self.min_chars), "postings")
        if self.empty:
            counts = written(_counted(new), "counts")
            self.postings, self.empty = new, False
        else:
            added = self.counts.unionByName(_counted(new)).groupBy("k1", "k2").agg(F.sum("refs").alias("refs"), F.max("keeper").alias("keeper"))
            self.postings, counts = written(self.postings.unionByName(new), "postings"), written(added, "counts")
        return self._moved(counts)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Take out all rows of these doc_ids."""
        gone = doc_ids.select(F.coalesce("doc_id", F.lit(NULL)).alias("doc")).distinct()
        touched = self.postings.join(gone, "doc", "left_semi").select("k1", "k2").distinct()
        rest = written(self.postings.join(gone, "doc", "left_anti").select("k1", "k2", "doc"), "postings")
        again = _counted(rest.join(touched, ["k1", "k2"], "left_semi"))
        counts = written(self.counts.join(touched, ["k1", "k2"], "left_anti").unionByName(again), "counts")
        self.postings = rest
        return self._moved(counts)

    def _frequent(self, counts: DataFrame) -> DataFrame:
        return counts.where(F.col("refs") >= self.min_docs)

    def _moved(self, counts: DataFrame) -> LineIndex:
        """Bring the filters from the old counts to the new ones."""
        old, self.counts = self._frequent(self.counts).select("k1", "k2"), counts
        new = self._frequent(counts).select("k1", "k2")
        n = new.count()
        if not self.shards or n > 2 * self.shards * SHARD_KEYS:
            self.shards = max(4, n // SHARD_KEYS * 2)
            self.filters = written(new.withColumn("shard", _shard(self.shards)).groupBy("shard").applyInPandas(_built, "shard long, blob binary"), "filters")
            return self
        both = old.withColumn("sign", F.lit(-1)).unionByName(new.withColumn("sign", F.lit(1)))
        moved = both.groupBy("k1", "k2").agg(F.sum("sign").alias("sign")).where("sign <> 0").withColumn("shard", _shard(self.shards))
        # A filter that runs full is built anew from its keys, so those of its shard come along.
        keys = new.withColumn("shard", _shard(self.shards)).withColumn("sign", F.lit(0).cast("long"))
        moved = moved.unionByName(keys.join(moved.select("shard").distinct(), "shard", "left_semi").select(*moved.columns))
        self.filters = written(moved.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(_changed, "shard long, blob binary"), "filters")
        return self

    def known(self, keys: DataFrame) -> DataFrame:
        """Those of keys (k1, k2, n), each there once, that the filter of their shard knows, which false ones may pass."""
        slices = max(1, -(-keys.count() // (max(1, self.shards) * SLICE_KEYS)))
        parts = keys.withColumns({"shard": _shard(max(1, self.shards)), "slice": F.pmod(F.col("k2"), F.lit(slices))})
        filters = self.filters.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
        return parts.groupBy("shard", "slice").cogroup(filters.groupBy("shard", "slice")).applyInPandas(_probed, f"{KEY}, n long")

    def dropped(self, asked: DataFrame) -> DataFrame:
        """(doc, keys that go from it) of postings."""
        keys = written(asked.groupBy("k1", "k2").agg(F.count("*").alias("n")), "keys")
        total = keys.agg(F.sum("n")).first()[0] or 0
        frequent = self.known(keys).join(self._frequent(self.counts), ["k1", "k2"]).select("k1", "k2", "n", "keeper")
        gone = joined(asked, written(frequent, "frequent"), ["k1", "k2"], "n", total).where("doc <> keeper")
        return gone.groupBy("doc").agg(F.collect_list(F.struct("k1", "k2")).alias("keys"))

    def apply(self, docs: DataFrame, asked: DataFrame | None = None) -> DataFrame:
        """docs (doc_id, text and any others) with the kept lines as text, and two more columns: lines before, lines dropped.

        These are n_lines and n_dropped, with underscores behind them where docs has such
        columns.  asked: postings of docs, if they are known.
        """
        min_chars, names = self.min_chars, docs.columns
        n_lines, n_dropped, doc, drop = unused(docs, "n_lines", "n_dropped", "doc", "drop")
        shown = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
        gone = self.dropped(written(postings(docs, min_chars), "asked") if asked is None else asked)
        met = docs.withColumn(doc, F.coalesce("doc_id", F.lit(NULL))).join(gone.select(F.col("doc").alias(doc), F.col("keys").alias(drop)), doc, "left")

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = names.index("text")
            for batch in batches:
                texts, befores, counts = [], [], []
                for t, keys in zip(batch.column(at), batch.column(len(names)), strict=True):
                    t = t.as_py()
                    lines = (t or "").encode().split(b"\n")
                    befores.append(len(lines))
                    if not keys.is_valid:
                        texts.append(t)
                        counts.append(0)
                        continue
                    own = {struct.pack("<qq", k["k1"], k["k2"]) for k in keys.as_py()}
                    rest = [x for x in lines if line_key(x, min_chars) not in own]
                    texts.append(b"\n".join(rest).decode())
                    counts.append(len(lines) - len(rest))
                columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns[: len(names)])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(befores, pa.int64()), pa.array(counts, pa.int64())], [*names, n_lines, n_dropped])

        return map_arrow(met.select(*(F.col(f"`{c}`") for c in names), drop), kept, f"{shown}, `{n_lines}` long, `{n_dropped}` long")


def _hash(pairs: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(pairs).view(np.uint64)[:, 1]


def _built(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "blob": [Cuckoo.of(_hash(pdf[["k1", "k2"]].to_numpy())).write()]})


def _probed(keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    out = keys[["k1", "k2", "n"]]
    if not len(filters) or not len(keys):
        return out[:0]
    return out[Cuckoo.read(filters["blob"].iloc[0]).has(_hash(keys[["k1", "k2"]].to_numpy()))]


def _changed(keys: pd.DataFrame, now: pd.DataFrame) -> pd.DataFrame:
    if not len(keys):
        return now[["shard", "blob"]]
    hashes, sign = _hash(keys[["k1", "k2"]].to_numpy()), keys["sign"].to_numpy()
    filter_ = Cuckoo.read(now["blob"].iloc[0]) if len(now) else Cuckoo(1)
    for k in hashes[sign < 0]:
        filter_.delete(k)
    if not all(filter_.insert(k) for k in hashes[sign > 0]):
        filter_ = Cuckoo.of(hashes[sign == 0])
    return pd.DataFrame({"shard": [keys["shard"].iloc[0]], "blob": [filter_.write()]})


def deduped(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """docs with repeated lines dropped, and the two columns of apply().

    Null or empty text is one empty line and stays as it is.  Rows count as documents each
    for itself; rows that share a doc_id, or have none, keep or lose a line together.
    An empty table gives no rows.
    """
    index = LineIndex(docs.sparkSession, min_docs, min_chars).insert(docs)
    return index.apply(docs, index.postings)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: lines before, lines dropped, and the digest of what stays."""
    out = deduped(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: DuckDB SQL of report() over the table documents.
SQL = r"""
with lines as (select doc_id, unnest(l) as line, unnest(range(len(l))) as i from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)),
keyed as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
often as (select k, max(doc_id) as keeper from keyed where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
judged as (select doc_id, i, line, keeper is not null and keeper <> doc_id as gone from keyed left join often using (k))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from judged group by doc_id
"""
