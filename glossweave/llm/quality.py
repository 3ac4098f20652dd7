"""Quality by weak supervision: rules vote or abstain, and expectation-maximisation weighs them.

Each rule looks at one measure of the text and votes good, doubtful or bad, or abstains.
Documents are good or bad in one of several ways, one for each rule: junk of
one kind trips the rule for it and few others, so one class of bad documents would
only learn the commonest kind.  A class has a probability of each vote for each rule
that votes.  These accuracies and the shares of the classes are estimated from the
votes of all documents: Spark counts each pattern of votes, of which there are at most
4 ** len(RULES) whatever the corpus, and the iterations run over those counts.  Pseudo-counts
(PRIOR) say that rules are rarely wrong about good documents until the votes show
otherwise, and hold a corpus without bad documents together.  They say so more of bad votes
than of doubtful ones: good votes of other rules outweigh one doubtful vote, as a list of names or
a very long text gets, but not one bad vote or two doubtful ones that go together.

A document is kept if it passes the base rules and the posterior probability that it
is good is at least ``keep``.  All of it is DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.llm.common import SPACE, written

#: rule: (measure x, and the conditions of a good, a doubtful and a bad vote, of which the last that holds counts), in SQL over the measures' names.
RULES = {
    "symbols": ("try_divide({symbols}, {words})", "{x} < 0.03", "{x} > 0.1", "{x} > 0.2"),
    "word_length": ("try_divide({word_chars}, {words})", "{x} between 3.5 and 7", "{x} < 2.5 or {x} > 12", "{x} < 2 or {x} > 20"),
    "dup_lines": ("if({lines} > 3, {dup_lines} / {lines}, null)", "{x} < 0.2", "{x} > 0.45", "{x} > 0.7"),
    "repeats": ("try_divide({repeats}, {words})", "{x} < 0.15", "{x} > 0.3", "{x} > 0.4"),
    "variety": ("try_divide({distinct_words}, {words})", "{x} > 0.3", "{x} < 0.1", "{x} < 0.02"),
    "capitals": ("try_divide({capitals}, {word_chars})", "{x} < 0.1", "{x} > 0.3", "{x} > 0.6"),
    "line_ends": ("if({lines} > 9, {ended_lines} / {lines}, null)", "{x} > 0.6", "{x} < 0.1", "false"),
    "shouts": ("try_divide({shouts}, {words})", "{x} < 0.05", "{x} > 0.3", "{x} > 0.6"),
}
MEASURES = ["words", "word_chars", "symbols", "lines", "dup_lines", "repeats", "distinct_words", "capitals", "ended_lines", "shouts"]
GOOD = "good"
CLASSES = (GOOD, *RULES)
#: Pseudo-counts of (good, doubtful, bad) votes: of a rule in its own class, in another bad class, in good documents; and of the classes.
PRIOR = {"own": (2.0, 3.0, 8.0), "other": (19.0, 0.5, 0.5), "good": (50.0, 1.5, 0.1), "share": {GOOD: 20.0} | dict.fromkeys(RULES, 0.5)}
#: A bad class is one where its own rule votes bad more often than not.
LEAST_OWN = 0.5
_P = "__q_"


def _removed(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, chars, ""))


def _hashed(*words: Column) -> Column:
    return F.xxhash64(*words)


def measured(docs: DataFrame) -> DataFrame:
    """docs with measures in columns named __q_*; the text is split once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    q = docs.withColumn(_P + "w", F.array_remove(F.split(text, f"[{SPACE}]+"), ""))
    q = q.withColumn(_P + "l", F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    w, lines = F.col(_P + "w"), F.col(_P + "l")
    q = q.withColumns({_P + "words": F.size(w).cast("long"), _P + "bits": F.length(F.bin(F.size(w)))})
    # Hashes of the three-word windows with their places in the low bits: equal windows become neighbours in one sort of longs.
    bits, n = F.col(_P + "bits"), F.col(_P + "words").cast("int")
    hashed = F.transform(w, lambda x, i: _hashed(x, F.get(w, i + 1), F.get(w, i + 2)))
    q = q.withColumn(_P + "h", F.when(n > 2, F.slice(hashed, F.lit(1), F.greatest(n - 2, F.lit(0)))).otherwise(F.array().cast("array<long>")))
    packed = F.transform(F.col(_P + "h"), lambda h, i: F.call_function("shiftleft", h, bits).bitwiseOR(i.cast("long")))
    q = q.withColumn(_P + "s", F.sort_array(packed))
    s = F.col(_P + "s")
    q = q.withColumn(_P + "t", F.slice(s, F.lit(2), F.greatest(F.size(s), F.lit(1))))
    place = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

    def compared(a: Column, b: Column) -> Column:
        """0: hashes differ; 1: the words are the same; 2: only the hashes are."""
        i, j = (x.bitwiseAND(place).cast("int") for x in (a, b))
        same = (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))
        equal = F.coalesce(F.call_function("shiftright", a, bits) == F.call_function("shiftright", b, bits), F.lit(False))
        return F.when(~equal, F.lit(0)).when(same, F.lit(1)).otherwise(F.lit(2))

    q = q.withColumn(_P + "e", F.zip_with(s, F.col(_P + "t"), compared))
    marked = lambda a: F.filter(F.zip_with(a, F.col(_P + "e"), lambda x, e: F.when(e == 1, x.bitwiseAND(place)).otherwise(F.lit(-1).cast("long"))), lambda x: x >= 0)
    # Where two different windows have one hash, which only very long texts can see, their words are sorted instead.
    full = F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.cast("long").alias("i"))))
    pairs = F.transform(F.array(full), lambda f: F.flatten(F.zip_with(f, F.slice(f, F.lit(2), F.size(f)), lambda x, y: F.when((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.array(x["i"], y["i"])).otherwise(F.array().cast("array<long>")))))[0]
    q = q.withColumn(_P + "m", F.when(F.array_contains(_P + "e", 2), F.array_distinct(pairs)).otherwise(F.array_union(marked(s), marked(F.col(_P + "t")))))
    m = F.col(_P + "m")
    q = q.withColumns({
        _P + "word_chars": F.length(F.array_join(w, "")).cast("long"),
        _P + "symbols": _removed(text, "[#*$%&|<>]").cast("long"),
        _P + "lines": F.size(lines).cast("long"),
        _P + "dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        _P + "repeats": F.size(F.array_distinct(F.concat(m, F.transform(m, lambda x: x + 1), F.transform(m, lambda x: x + 2)))).cast("long"),
        _P + "distinct_words": F.size(F.array_distinct(w)).cast("long"),
        _P + "capitals": _removed(text, "[A-Z]").cast("long"),
        _P + "ended_lines": F.size(F.filter(lines, lambda x: x.rlike(f"[.!?:;\"'»”)]+[{SPACE}]*$"))).cast("long"),
        _P + "shouts": _removed(text, "!").cast("long"),
    })
    return q.drop(*(_P + c for c in "wlhstem"), _P + "bits")


def voted(measures: DataFrame) -> DataFrame:
    """Adds __q_code, the votes as digits of base 4 (0 abstains, 1 good, 2 doubtful, 3 bad), and __q_failed for the base rules."""
    own = {m: _P + m for m in MEASURES}
    q = measures.withColumns({f"{_P}x_{r}": F.expr(x.format(**own)) for r, (x, *_) in RULES.items()})
    code = F.lit(0)
    for k, (r, (_, *conditions)) in enumerate(RULES.items()):
        good, doubtful, bad = (c.format(x=f"{_P}x_{r}") for c in conditions)
        code = code + F.expr(f"case when {bad} then 3 when {doubtful} then 2 when {good} then 1 else 0 end") * 4**k
    failed = (F.col(_P + "words") < 50) | (100 * F.col(_P + "repeats") > 50 * F.col(_P + "words"))
    return q.withColumns({_P + "failed": failed, _P + "code": code}).drop(*(f"{_P}x_{r}" for r in RULES))


def _votes(code: int) -> list[tuple[str, int]]:
    """(rule, 0 good, 1 doubtful or 2 bad) of the rules that vote."""
    return [(r, v - 1) for k, r in enumerate(RULES) if (v := code // 4**k % 4)]


def _logs(p: dict) -> dict:
    return {"share": {c: math.log(x) for c, x in p["share"].items()}, "votes": {k: [math.log(x) for x in v] for k, v in p["votes"].items()}}


def _classes(logs: dict, votes: list[tuple[str, int]]) -> dict[str, float]:
    """The posterior probability of each class."""
    w = {c: math.exp(logs["share"][c] + sum(logs["votes"][c, r][v] for r, v in votes)) for c in CLASSES}
    total = sum(w.values())
    return {c: x / total for c, x in w.items()}


def _shares(counts: list[float], least: float) -> list[float]:
    """counts as shares of their sum, the last of them at least ``least``."""
    last = max(least, counts[-1] / sum(counts))
    return [x / sum(counts[:-1]) * (1 - last) for x in counts[:-1]] + [last]


def fit(counts: dict[int, int], iterations: int = 100, tolerance: float = 1e-7) -> dict:
    """share of each class, and probabilities of the votes by (class, rule), from the counts of codes."""
    patterns = [(n, _votes(code)) for code, n in sorted(counts.items())]
    prior = {(c, r): PRIOR["good" if c == GOOD else "own" if c == r else "other"] for c in CLASSES for r in RULES}

    def estimated(share: dict, cast: dict) -> dict:
        return {"share": {c: x / sum(share.values()) for c, x in share.items()}, "votes": {(c, r): _shares(x, LEAST_OWN if c == r else 0) for (c, r), x in cast.items()}}

    p = estimated(PRIOR["share"], prior)
    for _ in range(iterations):
        logs, share, cast = _logs(p), dict(PRIOR["share"]), {k: list(x) for k, x in prior.items()}
        for n, votes in patterns:
            for c, q in _classes(logs, votes).items():
                share[c] += n * q
                for r, v in votes:
                    cast[c, r][v] += n * q
        new = estimated(share, cast)
        moved = max(max(abs(new["share"][c] - x) for c, x in p["share"].items()), max(abs(a - b) for k, x in p["votes"].items() for a, b in zip(new["votes"][k], x, strict=True)))
        p = new
        if moved < tolerance:
            break
    return p


def rated(votes: DataFrame, keep: float) -> DataFrame:
    """Adds __q_quality, the posterior probability of a good document, and __q_kept."""
    counts = {r[0]: r[1] for r in votes.groupBy(_P + "code").count().collect()}  # at most 4 ** len(RULES) rows
    logs = _logs(fit(counts))
    rows = ", ".join(f"({c}, {_classes(logs, _votes(c))[GOOD]!r}d)" for c in sorted(counts)) or "(0, 0d)"
    quality = votes.sparkSession.sql(f"select * from values {rows} as t({_P}code, {_P}quality)")
    kept = ~F.col(_P + "failed") & (F.col(_P + "quality") >= keep)
    return votes.join(F.broadcast(quality), _P + "code").withColumn(_P + "kept", kept)


def judged(docs: DataFrame, keep: float = 0.5) -> DataFrame:
    """docs (doc_id, text and any others) with __q_* columns: measures, __q_quality and __q_kept.

    Null or empty text has no words and fails the base rules.  Rows are judged each for
    itself, whatever their doc_id, also when they are repeated; a posterior of just
    ``keep`` keeps.  An empty table gives no rows.  Other columns stay as they are; those of
    the same names are replaced.
    """
    return rated(written(voted(measured(docs)), "judged"), keep)


def filtered(docs: DataFrame, keep: float = 0.5) -> DataFrame:
    """The documents that are kept, with their own columns, whatever their names."""
    own = {c: f"own{i}_{c}" for i, c in enumerate(docs.columns) if c.lower().startswith(_P)}
    kept = judged(docs.withColumnsRenamed(own), keep).where(_P + "kept")
    return kept.select(*(F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns))


def report(docs: DataFrame, keep: float = 0.5) -> DataFrame:
    """One row per document: its counts and whether it is kept."""
    # The text is not needed after it has been measured, and isn't written.
    q = rated(written(voted(measured(docs.select("doc_id", "text")).drop("text")), "judged"), keep)
    names = {"words": "n_words", "word_chars": "word_chars", "symbols": "n_symbols", "dup_lines": "n_dup_lines", "repeats": "n_repeat_words", "failed": "base_failed", "kept": "kept", "quality": "quality"}
    return q.select("doc_id", *(F.col(_P + k).alias(v) for k, v in names.items()))
