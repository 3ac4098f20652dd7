"""Benchmark decontamination as a prefix-filtered set join.

A window is ``size`` consecutive words of a benchmark item, or the whole item if it is
shorter.  Its tokens are its shingles of SHINGLE words (of all its words, if it has
fewer).  A document that holds a window holds all of them, so the rarest one is a
sufficient prefix, and all that has to be joined:

1. the shingles of all windows are counted over all documents, and each window's
   shingles are ordered by rarity; the first is its prefix;
2. documents' shingles meet the prefixes; a place is a candidate if the window, shifted
   so that the shingles agree, lies inside the document (positional and length bounds);
3. candidates return to their document, and each window is compared word by word, so
   shingles may travel as hashes.

Only DataFrame expressions are used.  The words of the benchmark are broadcast if there
are at most ``BROADCAST_ROWS`` of them in all windows; beyond that the joins shuffle.
Items never travel with candidates: what a document hits is known by window, and the
items of a window are looked up for hits alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.functions.names import unused
from glossweave.llm.common import ascii_lower, joined, written

#: Fixed value: what separates words once A-Z are lower case.
APART = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
SHINGLE = 3
BROADCAST_ROWS = 500_000
#: Stands for a null doc_id in joins, which a hash of the text joins too: rows that agree in both hold the same windows.
NULL = -(1 << 63)


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), APART), "")


def windows(benchmark: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(id, win: array of words), each window once, and (id, items: array of item_id as strings)."""
    w = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    own = F.transform(F.array("w"), lambda a: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(a) - size + 1)), lambda i: F.slice(a, i, F.lit(size))))[0]
    rows = w.select("item_id", F.explode(own).alias("win")).groupBy("win").agg(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit(""))).alias("items"))
    rows = written(rows.withColumn("id", F.monotonically_increasing_id()), "windows")
    return rows.select("id", "win"), rows.select("id", "items")


def _shingles(w: Column, size: int) -> Column:
    """Hashes of the runs of ``size`` words; the array around w binds it."""
    def run(a: Column, i: Column) -> Column:
        return F.xxhash64(F.lit(size), *(F.get(a, i + k) for k in range(size)))

    return F.transform(F.array(w), lambda a: F.when(F.size(a) >= size, F.transform(F.sequence(F.lit(0), F.greatest(F.size(a) - size, F.lit(0))), lambda i: run(a, i))).otherwise(F.array().cast("array<long>")))[0]


def _sized(wins: DataFrame) -> list[int]:
    """The sizes of shingles that windows have: at most SHINGLE of them."""
    return sorted(r[0] for r in wins.select(F.least(F.size("win"), F.lit(SHINGLE))).distinct().collect())


def prefixes(docs: DataFrame, wins: DataFrame, sizes: list[int], small) -> DataFrame:
    """(token, offset, length, id, win): each window at its rarest shingle."""
    own = F.coalesce(*(F.when(F.least(F.size("win"), F.lit(SHINGLE)) == s, _shingles(F.col("win"), s)) for s in sizes))
    ranked = written(wins.select("id", F.posexplode(own).alias("offset", "token")), "shingles")
    every = F.concat(*(_shingles(words(F.col("text")), s) for s in sizes))
    seen = docs.select(F.explode(every).alias("token")).join(small(ranked.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    # A window with a shingle that no document has is in none.
    best = ranked.join(small(written(seen, "seen")), "token", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("first"))
    return best.where("first.n > 0").join(wins, "id").select("first.token", "first.offset", F.size("win").alias("length"), "id", "win")


def matched(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> tuple[DataFrame, DataFrame, list[str]]:
    """docs (doc_id, text and any others) with four more columns, the items of windows, and the names of the columns.

    The columns are n_words, n_hit, hits (ids of windows, sorted) and contaminated, with
    underscores behind them where docs has such columns.  Null or empty text has no
    words.  Null or empty items have no windows; a null item_id is "".  Rows with the same
    doc_id, and rows that are repeated, are matched each for itself.  Empty tables match
    nothing.
    """
    wins, items = windows(benchmark, size)
    sizes = _sized(wins) or [SHINGLE]
    fits = (wins.agg(F.sum(F.size("win"))).first()[0] or 0) <= BROADCAST_ROWS
    small = F.broadcast if fits else (lambda df: df)
    prefix = written(prefixes(docs, wins, sizes, small), "prefixes")

    key = F.coalesce(F.col("doc_id"), F.lit(NULL)), F.xxhash64("text")
    placed = None
    for s in sizes:
        own = docs.select(key[0].alias("k"), key[1].alias("h"), words(F.col("text")).alias("w"))
        # Nothing else of the words is asked for here: beside the places it would be copied to each of them.
        own = own.select("k", "h", F.posexplode(_shingles(F.col("w"), s)).alias("at", "token"))
        placed = own if placed is None else placed.unionByName(own)
    found = placed.join(small(prefix), "token").withColumn("start", F.col("at") - F.col("offset"))
    found = found.where("start >= 0")
    candidates = found.groupBy("k", "h").agg(F.collect_set(F.struct("start", "length", "win", "id")).alias("c"))

    k, h, c, w, out, *names = unused(docs, "k", "h", "c", "w", "found", "n_words", "n_hit", "hits", "contaminated")
    both = docs.withColumns({k: key[0], h: key[1]}).join(candidates.select(F.col("k").alias(k), F.col("h").alias(h), F.col("c").alias(c)), [k, h], "left")
    both = both.withColumn(w, words(F.col("text")))
    true = F.coalesce(F.filter(c, lambda x: (x["start"] + x["length"] <= F.size(w)) & (F.slice(w, x["start"] + 1, x["length"]) == x["win"])), F.array())
    both = both.withColumn(c, true)
    places = F.flatten(F.transform(c, lambda x: F.sequence(x["start"], x["start"] + x["length"] - 1)))
    n_words, n_hit = F.size(w).cast("long"), F.size(F.array_distinct(places)).cast("long")
    told = F.struct(n_words.alias("a"), n_hit.alias("b"), F.array_sort(F.array_distinct(F.transform(c, lambda x: x["id"]))).alias("c"))
    # explode() of one element keeps filters on the result above it: pushed below, they would split the text for each candidate.
    shown = [F.col(f"`{x}`") for x in docs.columns]
    both = both.select(*shown, F.explode(F.array(told)).alias(out))
    bad = (F.col(out)["b"] > 0) & (20 * F.col(out)["b"] >= F.col(out)["a"])
    return both.select(*shown, *(F.col(out)[x].alias(n) for x, n in zip("abc", names, strict=False)), bad.alias(names[3])), items, names


def report(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """One row per document: words, words hit, items with occurring windows, and the verdict."""
    m, items, _ = matched(docs.select("doc_id", "text"), benchmark, size)
    m = written(m.withColumn("h", F.xxhash64("text")).drop("text"), "matched")
    hits = m.where("n_hit > 0").select("doc_id", "h", F.explode("hits").alias("id")).distinct()
    often = written(hits.groupBy("id").agg(F.count("*").alias("n")).join(items, "id"), "often")
    named = joined(hits, often, ["id"], "n", often.agg(F.sum("n")).first()[0] or 0).select("doc_id", "h", F.explode("items").alias("item"))
    named = named.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumnsRenamed({"doc_id": "o_doc", "h": "o_h"})
    out = m.join(named, (F.col("h") == F.col("o_h")) & F.col("doc_id").eqNullSafe(F.col("o_doc")), "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def cleaned(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """The documents that are not contaminated, with their own columns; what matched() says holds."""
    m, _, names = matched(docs, benchmark, size)
    return m.where(~F.col(names[3])).select(*(F.col(f"`{c}`") for c in docs.columns))


#: DuckDB SQL of report() over the tables documents and benchmark.
SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (select cast(item_id as varchar) as item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
win as (select distinct item, least(13, len(w)) as n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as win
  from (select item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct n from win),
occ as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
hit as (select doc_id, i, occ.n, item from occ join win using (n, win)),
spots as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from hit) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join spots using (doc_id) left join items using (doc_id)
"""
