r"""Personal data: base patterns, and identifiers that their contexts give away.

Base spans come from fixed patterns, kind by kind, leftmost and non-overlapping.  The
patterns are possessive and begin a run once, so time is linear in the text and the
stack stays flat; \G lets a match begin right after another.

Bootstrapping finds what no pattern describes.  A mention is a token with a digit or @,
or up to RUN neighbouring tokens of digits and what is written between digits.  Mentions
in which a base pattern fits are seeds of its kind; keys of unmistakable form seed a fifth
kind, "secret", that has no base spans.  The last and the last two words before a mention
are its lexical patterns.  Over the graph of distinct mentions and patterns, Spark repeats:

    confidence of a pattern for a kind = sum of its mentions' weights / (mentions + 1)
    weight of a mention for a kind     = 1 - product of (1 - confidence) over its patterns

with seeds at weight 1, and only patterns that at least SUPPORT seeds, or mentions of at
least weight SURE by then, share; no word before a mention is no pattern.  A mention in which no base pattern fits is added if its
weight from patterns ends at ACCEPT or more and it has the rough shape of the kind, or at SURE
or more whatever its shape; so are seeds of secrets, whose form alone isn't enough, also around a base span.  Base spans
never change.  All of it is DataFrame expressions, and time is nearly linear in the text.

Patterns and mentions that a large share of the graph has are broadcast when tables meet
(no more than a thousand can be that frequent); the others are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.llm.common import SPACE, joined, written

#: The kinds in their order, each as a possessive pattern and the condition on a match ``v``.
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", "ip"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "card"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "phone"),
}
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Tokens of a mention of more than one: card and phone numbers in groups.
RUN = 6
_NUMERIC = f"[0-9()./+-]*[0-9][0-9()./+-]*+(?![^{SPACE}])"
MENTION = f"(?<![^{SPACE}])(?:{_NUMERIC}(?:\\x20{_NUMERIC}){{0,{RUN - 1}}}+|[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+)"
#: What a mention has around it that isn't part of an identifier.
_EDGE = "[\"'\\[<{#$%&*|=,;:!?.\\]>}-]"
BEFORE, AFTER = f"^{_EDGE}++", f"(?<!{_EDGE}){_EDGE}++$"
#: Rough shapes: what a mention of a kind may look like when no base pattern fits.
SHAPES = {
    "email": r"^[^\x20]*[A-Za-z][^\x20]*@[^\x20]*[A-Za-z][^\x20]*$",
    "ip": r"^[0-9A-Fa-f]{1,4}(?:[.:][0-9A-Fa-f]{0,4}){3,7}$",
    "card": r"^[0-9](?:[\x20./-]?[0-9]){11,18}$",
    "phone": r"^[(+]?[0-9](?:[\x20()./-]{0,2}[0-9]){6,14}$",
    "secret": r"^(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9+/_=.~-]{12,}$",
}
#: Forms of keys that are seeds of secrets: hexadecimal digests, and prefixes that public services give to their keys.
SECRET = r"^(?:(?=[^0-9]*[0-9])(?=[0-9]*[A-Fa-f])[0-9A-Fa-f]{32,}|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|xox[abprs]-[0-9A-Za-z-]{10,}|sk_live_[0-9A-Za-z]{16,}|AIza[0-9A-Za-z_-]{35})$"
ALL_KINDS = (*KINDS, "secret")
ROUNDS, SUPPORT, ACCEPT, SURE = 3, 3, 0.8, 0.9
_FOUND = "array<struct<start:int,end:int,value:string>>"
_WORD = r"[\p{L}\p{N}]++"
_GAP = r"[^\p{L}\p{N}]"
#: Of the reversed text before a mention: its last word and the one before.
_LAST_WORDS = f"^{_GAP}*+({_WORD})(?:{_GAP}++({_WORD}))?"


def running(numbers: Column) -> Column:
    """Sums of an array up to each element.

    The array is summed in blocks of about the square root of its size, as an array that
    grows by one element a step is copied each time.
    """
    size = F.greatest(F.ceil(F.sqrt(F.size(numbers).cast("double"))).cast("int"), F.lit(1))

    def summed(x: Column) -> Column:
        zero = F.struct(F.lit(0).cast("int").alias("sum"), F.array().cast("array<int>").alias("out"))
        step = lambda a, v: F.struct((a["sum"] + v).alias("sum"), F.concat(a["out"], F.array(a["sum"] + v)).alias("out"))
        return F.aggregate(x, zero, step, lambda a: a["out"])

    def bound(both: Column) -> Column:
        x, n = both["x"], both["n"]
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), n), lambda i: summed(F.slice(x, i + 1, n)))
        return F.transform(F.array(parts), lambda p: F.flatten(F.zip_with(p, F.concat(F.array(F.lit(0)), summed(F.transform(p, lambda q: F.coalesce(F.try_element_at(q, F.lit(-1)), F.lit(0))))), lambda q, before: F.transform(F.coalesce(q, F.array().cast("array<int>")), lambda v: v + before))))[0]

    return F.transform(F.array(F.struct(numbers.alias("x"), size.alias("n"))), bound)[0]


def _placed(values: Column, gaps: Column) -> Column:
    """(start, end, value) of values in code points, from what stands before each."""
    ends = running(F.zip_with(values, F.slice(gaps, F.lit(1), F.size(values)), lambda v, gap: F.length(gap) + F.length(v)))
    return F.zip_with(values, ends, lambda v, end: F.struct((end - F.length(v)).alias("start"), end.alias("end"), v.alias("value"))).cast(_FOUND)


def located(text: Column, pattern: str) -> Column:
    """All matches as (start, end, value), in code points: what split leaves between them gives their places."""
    found = F.array(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("v"), F.split(text, pattern, -1).alias("g")))
    return F.transform(found, lambda x: F.when(F.size(x["v"]) > 0, _placed(x["v"], x["g"])).otherwise(F.array().cast(_FOUND)))[0]


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    numbers = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(v: Column, rule: str | None) -> Column:
    if rule == "ip":
        return v.rlike(f"^{_BYTE}(?:\\.{_BYTE}){{3}}$")
    if rule == "card":
        return F.length(_digits(v)).between(12, 19) & _luhn(_digits(v))
    if rule == "phone":
        return F.length(_digits(v)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of (start, rank, end, kind), by start and then kind as listed."""
    return F.array_sort(F.concat(*(_of_kind(text, rank, kind) for rank, kind in enumerate(KINDS))))


def _of_kind(text: Column, rank: int, kind: str) -> Column:
    pattern, rule = KINDS[kind]
    needed = {"email": "@", "ip": ".", "phone": "+"}.get(kind)
    found = located(text, pattern)
    if needed:
        found = F.when(F.contains(text, F.lit(needed)), found).otherwise(F.array().cast(_FOUND))
    good = F.filter(found, lambda s: _valid(s["value"], rule))
    return F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def mentions(text: Column) -> Column:
    """Array of (start, end, value, one, two): trimmed mentions and their patterns, the last words between a mention and the one before."""
    found = F.array(F.struct(F.regexp_extract_all(text, F.lit(MENTION), F.lit(0)).alias("v"), F.split(text, MENTION, -1).alias("g")))

    def trimmed(m: Column, gap: Column) -> Column:
        head = F.regexp_replace(m["value"], BEFORE, "")
        value = F.regexp_replace(head, AFTER, "")
        start = m["start"] + F.length(m["value"]) - F.length(head)
        back = F.lower(F.reverse(gap))
        word = lambda i: F.coalesce(F.nullif(F.reverse(F.regexp_extract(back, _LAST_WORDS, i)), F.lit("")), F.lit("^"))
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), word(1).alias("one"), F.concat_ws(" ", word(2), word(1)).alias("two"))

    none = F.array().cast("array<struct<start:int,end:int,value:string,one:string,two:string>>")
    both = F.transform(found, lambda x: F.when(F.size(x["v"]) > 0, F.zip_with(_placed(x["v"], x["g"]), F.slice(x["g"], F.lit(1), F.size(x["v"])), trimmed)).otherwise(none))[0]
    return F.filter(both, lambda m: F.length(m["value"]) > 1)


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id and h (a row's identity), base and mentions; texts without digits and @ cost one look."""
    text = F.coalesce(F.col("text"), F.lit(""))
    q = docs.select("doc_id", F.xxhash64("text").alias("h"), text.alias("text"), text.rlike("[0-9@]").alias("some"))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    q = q.withColumn("base", F.when(F.col("some"), base_spans(F.col("text"))).otherwise(empty))
    none = F.array().cast("array<struct<start:int,end:int,value:string,one:string,two:string>>")
    return q.withColumn("mentions", F.when(F.col("some"), mentions(F.col("text"))).otherwise(none)).drop("text", "some")


def _seeds(value: Column) -> list[Column]:
    """1.0 or 0.0 for each of ALL_KINDS."""
    fits = lambda rule: lambda v: _valid(v, rule)
    found = [F.exists(F.regexp_extract_all(value, F.lit(pattern), F.lit(0)), fits(rule)) for pattern, rule in KINDS.values()]
    return [F.when(x, 1.0).otherwise(0.0).alias(f"s_{k}") for k, x in zip(ALL_KINDS, [*found, value.rlike(SECRET)], strict=True)]


def _hidden(value: Column, held_out: float) -> Column:
    """Is a seed treated as unknown, to measure what patterns find again?"""
    return F.pmod(F.xxhash64(value, F.lit(17)), F.lit(1000)) < int(held_out * 1000)


def weighed(scan: DataFrame, held_out: float = 0.0) -> DataFrame:
    """One row per distinct mention that has a pattern: value, n (its mentions or more), s_kind (1 for a seed), hidden, and w_kind, what its patterns say."""
    m = scan.select(F.explode("mentions").alias("m")).select("m.value", "m.one", "m.two")
    pattern = F.explode(F.array(F.concat(F.lit("1 "), "one"), F.concat(F.lit("2 "), "two"))).alias("pattern")
    edges = written(m.select("value", pattern).where("pattern not in ('1 ^', '2 ^ ^')").groupBy("pattern", "value").agg(F.count("*").alias("n")), "edges")
    total = edges.count()
    known = edges.groupBy("value").agg(F.sum("n").alias("n"), F.count("*").alias("degree"))
    known = written(known.select("value", "n", "degree", *_seeds(F.col("value")), _hidden(F.col("value"), held_out).alias("hidden")), "values")
    own = {k: F.when(F.col("hidden"), 0.0).otherwise(F.col(f"s_{k}")) for k in ALL_KINDS}
    weights = known.select("value", "degree", *(own[k].alias(f"w_{k}") for k in ALL_KINDS))
    for _ in range(ROUNDS):
        met = joined(edges.select("pattern", "value"), weights, ["value"], "degree", total)
        patterns = met.groupBy("pattern").agg(
            F.count("*").alias("size"),
            *((F.sum(f"w_{k}") / (F.count("*") + 1)).alias(f"p_{k}") for k in ALL_KINDS),
            *(F.count_if(F.col(f"w_{k}") >= SURE).alias(f"n_{k}") for k in ALL_KINDS),
        )
        sure = [F.when(F.col(f"n_{k}") >= SUPPORT, F.least(f"p_{k}", F.lit(0.999))).otherwise(0.0).alias(f"p_{k}") for k in ALL_KINDS]
        patterns = written(patterns.where(F.greatest(*(F.col(f"n_{k}") for k in ALL_KINDS)) >= SUPPORT).select("pattern", "size", *sure), "patterns")
        heard = joined(edges.select("pattern", "value"), patterns, ["pattern"], "size", total)
        told = heard.groupBy("value").agg(*((1 - F.exp(F.sum(F.log(1 - F.col(f"p_{k}"))))).alias(f"t_{k}") for k in ALL_KINDS))
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        out = written(known.join(told, "value", "left").select("value", "n", "degree", "hidden", *(f"s_{k}" for k in ALL_KINDS), *(zero(F.col(f"t_{k}")).alias(f"t_{k}") for k in ALL_KINDS)), "weights")
        weights = out.select("value", "degree", *(F.greatest(own[k], F.col(f"t_{k}")).alias(f"w_{k}") for k in ALL_KINDS))
    return out.select("value", "n", "hidden", *(f"s_{k}" for k in ALL_KINDS), *(F.col(f"t_{k}").alias(f"w_{k}") for k in ALL_KINDS))


def accepted(weights: DataFrame) -> DataFrame:
    """(value, n, rank) of the mentions that patterns give away as a kind; rank is its place in ALL_KINDS."""
    enough = [F.when(F.col(f"w_{k}") >= F.when(F.col("value").rlike(SHAPES[k]), ACCEPT).otherwise(SURE), F.col(f"w_{k}")).otherwise(0.0) for k in ALL_KINDS]
    best = F.array_max(F.array(*(F.struct(w.alias("w"), F.lit(-i).alias("i")) for i, w in enumerate(enough))))
    return weights.withColumn("best", best).where(F.col("best.w") > 0).select("value", "n", (-F.col("best.i")).alias("rank"), *(f"s_{k}" for k in ALL_KINDS), "hidden")


def _bootstrapped(scan: DataFrame) -> DataFrame:
    """(doc_id, h, start, rank, end, kind) of mentions that the iteration accepts."""
    good = accepted(weighed(scan)).where("s_secret = 1 or " + " + ".join(f"s_{k}" for k in KINDS) + " = 0").select("value", "n", "rank")
    m = scan.select("doc_id", "h", F.explode("mentions").alias("m")).select("doc_id", "h", "m.start", "m.end", "m.value")
    total = 2 * (scan.agg(F.sum(F.size("mentions"))).first()[0] or 0)  # as n counts a mention for each of its patterns
    added = joined(m, written(good, "accepted"), ["value"], "n", total)
    return added.select("doc_id", "h", "start", "rank", "end", F.element_at(F.array(*map(F.lit, ALL_KINDS)), F.col("rank") + 1).alias("kind")).distinct()


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def detected(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of base spans, and all spans.

    doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added,
    n_spans (all of them).  Null or empty text has no spans.  Rows with the same doc_id
    or a null one are searched each for itself.  An empty table gives no rows.  Other
    columns are not read.
    """
    scan = written(scanned(docs.select("doc_id", "text")), "scan")
    added = _bootstrapped(scan).groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "rank", "end", "kind")).alias("added"))
    a = added.withColumnsRenamed({"doc_id": "a_doc", "h": "a_h"})
    both = scan.drop("mentions").join(a, (F.col("h") == F.col("a_h")) & F.col("doc_id").eqNullSafe(F.col("a_doc")), "left").withColumn("added", F.coalesce("added", F.array()))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, x))).cast("long").alias(f"n_{x}") for x in KINDS]
    every = F.array_sort(F.concat("base", "added"))
    return both.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"), F.size("added").cast("long").alias("n_added"), F.size(every).cast("long").alias("n_spans"))


def measured(docs: DataFrame, held_out: float = 0.2) -> DataFrame:
    """(kind, hidden, found, told, right): distinct seeds that were hidden from the iteration, how many of them patterns
    found again, and of all distinct mentions that patterns gave to the kind, how many are seeds of it.

    found / hidden is recall on held-out seeds, right / told a lower bound of precision, as unseen
    identifiers count as wrong.
    """
    w = written(weighed(scanned(docs.select("doc_id", "text")), held_out), "measured")
    good = accepted(w).withColumn("kind", F.element_at(F.array(*map(F.lit, ALL_KINDS)), F.col("rank") + 1))
    seed = F.exists(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"s_{k}").alias("s")) for k in ALL_KINDS)), lambda x: (x["k"] == F.col("kind")) & (x["s"] > 0))
    told = good.groupBy("kind").agg(F.count_if(F.col("hidden") & seed).alias("found"), F.count("*").alias("told"), F.count_if(seed).alias("right"))
    hidden = w.agg(F.array(*(F.struct(F.lit(k).alias("kind"), F.count_if(F.col("hidden") & (F.col(f"s_{k}") > 0)).alias("hidden")) for k in ALL_KINDS)).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return hidden.join(told, "kind", "left").na.fill(0)
