"""Near-duplicate documents by MinHash, confirmed on full shingle sets.

1. One pass makes each document's set of 5-word shingles, its digest, and a
   one-permutation signature of 128 bins with optimal densification.
2. Documents with equal sets are one class; only its smallest doc_id goes on, so copies
   cost nothing further.
3. Signatures fall into 32 bands of 4 rows; classes that agree in a band share a bucket.
4. Buckets of at most SMALL classes give every pair whose estimate allows the similarity;
   larger ones give a star: each class with the smallest of its bucket.  Candidates are
   confirmed on the full sets, made again for the documents that have any, and links are
   joined into components by minimum labels.
5. A large bucket whose classes are one component by then needs nothing more.  What is
   left, buckets of several components, is compared exactly: those that share classes are
   one group, a group is cut into parts, and every two parts meet in a tile, where the
   intersections of all pairs are counted, as a product of matrices.  A tile gives a
   spanning forest of its links between components: all that is needed to join them.

So every two classes that share a bucket are looked at, or are in one component already.
Copies of one text and its small changes cost a star; only groups of many documents that
are just under the similarity to each other cost the square of their number.

What meets on a hot key (a bucket, a label, the centre of a star, a digest of copies) is
dealt to many tasks by ``common.joined``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.functions.names import unused
from glossweave.llm import shingles
from glossweave.llm.common import joined, map_arrow, written

#: Classes of a bucket whose pairs are listed; of a part of a larger group, classes and shingles.
SMALL, PART, PART_SHINGLES = 16, 1024, 4_000_000
#: Columns of a matrix that are multiplied at a time.
COLUMNS = 4096
#: An estimate this far under the asked similarity still makes a candidate: over four standard deviations for sets of FEW shingles or more, and for smaller ones, whose estimates vary more.
MARGIN, FEW, MARGIN_FEW = 0.14, 512, 0.22
BROADCAST_ROWS = 1_000_000
#: Stands for a null doc_id: the largest.
NULL = (1 << 63) - 1
BASE = "doc long, none boolean, h long, n long, d1 long, d2 long, sig binary, bands array<bigint>"


def _digest(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return tuple(int(shingles.mix(s, seed).sum().view(np.int64)) for seed in (41, 42))


def based(docs: DataFrame) -> DataFrame:
    """BASE, one row for each of docs (doc_id, text); none says that there is no doc_id, and h is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                sets = shingles.shingle_sets(part.column(1).to_pylist())
                has = [i for i, s in enumerate(sets) if len(s)]
                sig = shingles.signatures([sets[i] for i in has])
                keys, brief = shingles.band_keys(sig).tolist(), [x.tobytes() for x in shingles.short(sig)]
                bands: list = [None] * len(sets)
                sigs: list = [None] * len(sets)
                for j, i in enumerate(has):
                    bands[i], sigs[i] = keys[j], brief[j]
                d = [_digest(s) for s in sets]
                columns = [part.column(0).fill_null(NULL), part.column(0).is_null(), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in d], pa.int64()), pa.array([x[1] for x in d], pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in BASE.split(", ")])

    return map_arrow(docs.select("doc_id", "text", F.xxhash64("text")), run, BASE)


def buckets(classes: DataFrame) -> tuple[DataFrame, int]:
    """(key, node, size, least) of each class in each bucket that it shares, and how many rows all buckets have."""
    rows = classes.select("node", F.explode("bands").alias("key"))
    sizes = written(rows.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("least")).where("size > 1"), "sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    return written(joined(rows, sizes.withColumn("weight", F.col("size")), ["key"], "weight", total), "buckets"), total


def candidates(classes: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """(a, b) with a < b, distinct: pairs of small buckets whose signatures allow the similarity, and stars of large ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sigs, ns = None, [], [], []

        def bucket():
            sig, n = np.frombuffer(b"".join(sigs), np.uint16).reshape(len(nodes), shingles.BINS), np.array(ns)
            for i in range(len(nodes) - 1):
                margin = np.where(np.maximum(n[i + 1 :], n[i]) < FEW, MARGIN_FEW, MARGIN)
                for j in np.flatnonzero((sig[i + 1 :] == sig[i]).mean(axis=1) >= percent / 100 - margin) + i + 1:
                    yield min(nodes[i], nodes[j]), max(nodes[i], nodes[j])

        for batch in batches:
            out = []
            for k, d, s, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    out += bucket()
                    key, nodes, sigs, ns = k, [], [], []
                nodes.append(d)
                sigs.append(s)
                ns.append(n)
            if out:
                yield _pairs(out)
        if out := list(bucket()):
            yield _pairs(out)

    small = shared.where(F.col("size") <= SMALL).select("key", "node").join(classes.select("node", "sig", "n"), "node")
    pairs = map_arrow(small.repartition("key").sortWithinPartitions("key", "node").select("key", "node", "sig", "n"), run, "a long, b long")
    stars = shared.where((F.col("size") > SMALL) & (F.col("least") < F.col("node"))).select(F.col("least").alias("a"), F.col("node").alias("b"))
    return pairs.unionByName(stars).distinct()


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """(left, right) sizes of all intersections of sets, exactly."""
    m, sides = len(left), left + right
    owner = np.repeat(np.arange(len(sides)), [len(s) for s in sides])
    _, column, counts = np.unique(np.concatenate(sides), return_inverse=True, return_counts=True)
    # What only one set has is in no intersection.
    number = np.cumsum(counts > 1) - 1
    owner, column = owner[counts[column] > 1], number[column[counts[column] > 1]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((m, len(right)), np.float32)
    for first in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
        at = slice(*np.searchsorted(column, [first, first + COLUMNS]))
        has = np.zeros((len(sides), COLUMNS), np.float32)
        has[owner[at], column[at] - first] = 1
        out += has[:m] @ has[m:].T
    return out.astype(np.int64)


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) of a spanning forest of the links of a matrix between two sides."""
    rows, columns = np.ones(linked.shape[0], bool), np.ones(linked.shape[1], bool)
    edges = []
    for start in range(len(rows)):
        stack = [(0, start)] if rows[start] else []
        rows[start] = False
        while stack:
            side, i = stack.pop()
            new = np.flatnonzero((linked[:, i] & rows) if side else (linked[i] & columns))
            (rows if side else columns)[new] = False
            edges += [(int(j), i) if side else (i, int(j)) for j in new]
            stack += [(1 - side, int(j)) for j in new]
    return edges


def _sets(docs: DataFrame, wanted: DataFrame, names: str) -> DataFrame:
    """wanted (doc, h and ``names``, as a schema), a row each, with the shingles of these documents."""
    few = wanted.count() <= BROADCAST_ROWS
    columns = [x.split()[0] for x in names.split(", ")]
    texts = docs.select(F.coalesce("doc_id", F.lit(NULL)).alias("doc"), F.xxhash64("text").alias("h"), "text").join(F.broadcast(wanted) if few else wanted, ["doc", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = shingles.shingle_sets(batch.column(len(columns)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array([s.tobytes() for s in made], pa.binary())], [*columns, "shingles"])

    # A row that is repeated gives its set again.
    return written(map_arrow(texts.select(*columns, "text"), run, f"{names}, shingles binary").dropDuplicates(["node"]), "sets")


def group_links(docs: DataFrame, classes: DataFrame, mixed: DataFrame, percent: int) -> DataFrame:
    """(a, b) with a < b: links between components, by all pairs of each group of buckets.

    mixed: (key, node, least, label) of large buckets, label being a node's component.
    """
    pairs = mixed.select(F.col("node").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
    member = components(pairs).withColumnsRenamed({"doc": "node", "label": "group"})
    member = written(member.join(classes.select("node", "doc", "h", "n"), "node").join(mixed.select("node", "label").distinct(), "node"), "members")
    sizes = member.groupBy("group").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
    sizes = written(sizes.select("group", "size", F.ceil(F.greatest(F.col("size") / PART, F.col("n") / PART_SHINGLES)).cast("int").alias("parts")), "groups")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    member = joined(member, sizes, ["group"], "size", total).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    made = _sets(docs, written(member.select("doc", "h", "node", "group", "label", "parts", "part"), "wanted"), "node long, group long, label long, parts int, part int")
    tiles = made.select("group", "part", "label", "shingles", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    tiles = tiles.select("group", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "label", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def tile():
            sides = [[r for r in rows if r[0] == part and len(r[2])] for part in key[1:]] if key else [[], []]
            if not all(sides):
                return []
            (left, right), n = ([r[2] for r in s] for s in sides), [np.array([len(r[2]) for r in s], np.int64) for s in sides]
            label = [np.array([r[1] for r in s], np.int64) for s in sides]
            both = common(left, right)
            linked = (label[0][:, None] != label[1]) & (both > 0) & (100 * both >= percent * (n[0][:, None] + n[1] - both))
            pairs = ((int(label[0][i]), int(label[1][j])) for i, j in forest(linked))
            return sorted({(min(p), max(p)) for p in pairs})

        for batch in batches:
            out = []
            for *k, part, label, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    out += tile()
                    key, rows = k, []
                rows.append((part, label, np.frombuffer(s, np.uint64)))
            if out:
                yield _pairs(out)
        if out := tile():
            yield _pairs(out)

    return map_arrow(tiles.repartition("group", "p", "q").sortWithinPartitions("group", "p", "q"), run, "a long, b long").distinct()


def confirmed(docs: DataFrame, classes: DataFrame, edges: DataFrame, percent: int) -> DataFrame:
    """Those of edges (a, b) whose full sets are similar enough."""
    sides = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("x"), F.lit(0).alias("y")), F.struct(F.col("b").alias("node"), F.lit(0).alias("x"), F.lit(1).alias("y")))).alias("s")
    ids = edges.select(sides).select("s.*").groupBy("node").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    wanted = written(ids.join(classes.select("node", "doc", "h"), "node").select("doc", "h", "node", "x", "y"), "ids")
    made, total = _sets(docs, wanted, "node long, x long, y long"), wanted.agg(F.sum("x")).first()[0] or 0

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [shingles.similar(*(np.frombuffer(x.as_buffer(), np.uint64) for x in pair), percent) for pair in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    met = joined(edges, made.where("x > 0").select(F.col("node").alias("a"), "x", F.col("shingles").alias("s")), ["a"], "x", total)
    met = joined(met, made.where("y > 0").select(F.col("node").alias("b"), "y", F.col("shingles").alias("t")), ["b"], "y", total)
    return map_arrow(met.select("a", "b", "s", "t"), verdicts, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(doc, label): label is the smallest doc reachable over links (a, b).

    Each round takes the smallest label among neighbours, then that label's own label,
    which halves what is left of a path.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    labels = written(both.groupBy(F.col("a").alias("doc")).agg(F.min("b").alias("m"), F.count("*").alias("degree")).select("doc", F.least("doc", "m").alias("label"), "degree"), "labels")
    ends, docs = labels.agg(F.coalesce(F.sum("degree"), F.lit(0)), F.count("*")).first()
    while True:
        near = joined(both, labels.select(F.col("doc").alias("b"), "label", "degree"), ["b"], "degree", ends).groupBy(F.col("a").alias("doc")).agg(F.min("label").alias("m"))
        best = written(labels.join(near, "doc").select("doc", F.col("label").alias("was"), F.least("label", "m").alias("label"), "degree"), "best")
        roots = best.groupBy("label").agg(F.count("*").alias("weight")).join(best.select(F.col("doc").alias("label"), F.col("label").alias("next")), "label")
        new = joined(best, written(roots, "roots"), ["label"], "weight", docs, "left").select("doc", "was", F.least("label", "next").alias("label"), "degree")
        new = written(new, "labels")
        if new.where("label <> was").limit(1).count() == 0:
            return new.select("doc", "label")
        labels = new.select("doc", "label", "degree")


def labelled(docs: DataFrame, percent: int) -> DataFrame:
    """(doc, none, h, n, component, first): of each row of docs, what BASE says, the smallest doc of its component, and whether the row is the first of it.

    first is true for one document of each component: of rows that share its smallest
    doc_id, those with one text.  Documents without words are components of their own.
    """
    base = written(based(docs), "base")
    classes = base.where("n > 0").groupBy("d1", "d2", "n").agg(F.min(F.struct("doc", "h")).alias("first"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = classes.select("d1", "d2", "n", "copies", "first.doc", "first.h", "sig", "bands")
    # A class is known by its smallest doc_id; where several have the same one, by a hash.
    shared = written(classes.groupBy("doc").agg(F.count("*").alias("weight")).where("weight > 1"), "shared")
    named = joined(classes, shared.withColumn("several", F.lit(True)), ["doc"], "weight", base.count(), "left")
    classes = written(named.withColumn("node", F.when(F.col("several"), F.xxhash64("d1", "d2", "n", "doc")).otherwise(F.col("doc"))).drop("several"), "classes")

    rows, total = buckets(classes)
    edges = written(candidates(classes, rows, percent), "edges")
    found = components(written(confirmed(docs, classes, edges, percent), "links"))
    large = rows.where(F.col("size") > SMALL).join(found.withColumnRenamed("doc", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    large = written(large, "large")
    mixed = large.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("weight")).where("low <> high").select("key", "weight")
    mixed = written(joined(large, written(mixed, "mixed"), ["key"], "weight", total), "rest")
    more = components(written(group_links(docs, classes, mixed, percent), "more")).select(F.col("doc").alias("label"), F.col("label").alias("over"))

    of_class = classes.select("d1", "d2", "n", "copies", "doc", "h", "node").join(found.withColumnRenamed("doc", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    members = written(of_class, "of_class")
    labels = members.groupBy("label").agg(F.count("*").alias("weight"), F.min(F.struct("doc", "h")).alias("own"))
    labels = written(labels.join(more, "label", "left").withColumn("over", F.coalesce("over", "label")), "labels")
    over = labels.groupBy("over").agg(F.min("own").alias("own"), F.count("*").alias("many"))
    labels = joined(labels.select("label", "weight", "over"), written(over, "over"), ["over"], "many", labels.count()).select("label", "weight", "own")
    of_class = joined(members, written(labels, "own"), ["label"], "weight", members.count()).select("d1", "d2", "n", "copies", "own")
    out = joined(base.select("doc", "none", "h", "n", "d1", "d2"), written(of_class, "named"), ["d1", "d2", "n"], "copies", base.count(), "left")
    return out.select("doc", "none", "h", "n", F.coalesce("own.doc", "doc").alias("component"), F.coalesce((F.col("doc") == F.col("own.doc")) & (F.col("h") == F.col("own.h")), F.lit(True)).alias("first"))


def grouped(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Links: 100 * |intersection| >= percent * |union| of the sets of 5-word shingles (one
    shingle of all words if there are fewer than five).  Null or empty text has an empty
    set and links with nothing.  A null doc_id ranks after all others, with 2^63 - 1.  Rows
    that share a doc_id are linked each for its own text.  component_id is the smallest
    doc_id of those linked, directly or not, null if none has one; kept is doc_id =
    component_id.  An empty table gives no rows; other columns are not read.
    """
    out = labelled(docs, percent)
    return out.select(F.when(~F.col("none"), F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("component") != NULL, F.col("component")).alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))


def deduped(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with its own columns.

    Documents without words all stay.  Of rows that share that doc_id the ones with one
    text stay, and of rows that repeat both one.  Nothing else is dropped by doc_id: rows
    with a shared or null one are judged each by its own text.
    """
    doc, h = unused(docs, "doc", "h")
    rows = written(labelled(docs, percent).groupBy("doc", "h").agg(F.first("n").alias("n"), F.bool_or("first").alias("stays"), F.count("*").alias("copies")), "rows")
    own = docs.withColumns({doc: F.coalesce("doc_id", F.lit(NULL)), h: F.xxhash64("text")})
    names = [F.col("doc").alias(doc), F.col("h").alias(h)]
    shown = [F.col(f"`{c}`") for c in docs.columns]
    twice = rows.where("stays and copies > 1 and n > 0")
    kept = own.join(rows.where("not stays or copies > 1 and n > 0").select(*names), [doc, h], "left_anti")
    if twice.limit(1).count():
        kept = kept.unionByName(own.join(twice.select(*names), [doc, h], "left_semi").dropDuplicates([doc, h]))
    return kept.select(*shown)


#: DuckDB SQL of grouped() over the table documents.
SQL = r"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, shingle from (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end) as shingle from d)),
n as (select doc_id, count(*) as n from s group by doc_id),
pair as (select x.doc_id as a, y.doc_id as b, count(*) as common from s x join s y on x.shingle = y.shingle and x.doc_id < y.doc_id group by all),
link as (select a, b from pair join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * common >= 85 * (na.n + nb.n - common)),
edge as (select a, b from link union all select b, a from link),
reach as (select a, b from edge union select reach.a, edge.b from reach join edge on reach.b = edge.a)
select d.doc_id, coalesce(any_value(n.n), 0) as n_shingles, least(d.doc_id, coalesce(min(reach.b), d.doc_id)) as component_id, d.doc_id = least(d.doc_id, coalesce(min(reach.b), d.doc_id)) as kept
from d left join n using (doc_id) left join reach on reach.a = d.doc_id group by d.doc_id
"""
