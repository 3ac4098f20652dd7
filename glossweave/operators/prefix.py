"""State machines as tables, and tries for words with a prefix.

Nodes (id, accepting) and edges (src, symbol, dst); state 0 is the start.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.functions.names import unused
from glossweave.sources.tables import checkpoint_dir

#: Transitions, and accepting states, of a machine that is sent to executors.
SENT_EDGES = 1_000_000
NODE, EDGE = "id long, accepting boolean", "src long, symbol string, dst long"


class FSMException(Exception):
    """A machine was given what it can't hold."""


@dataclass
class Machine:
    """A machine under construction; small, on the driver, and turned into tables when it is used."""

    accepting: list[bool] = field(default_factory=lambda: [False])
    edges: set[tuple[int, str, int]] = field(default_factory=set)

    def new_state(self, accepting: bool = False) -> int:
        self.accepting.append(accepting)
        return len(self.accepting) - 1

    def add_transition(self, src: int, symbol: str, *dst: int) -> None:
        if not symbol:
            raise FSMException("a transition needs a symbol")
        self.edges |= {(src, symbol, d) for d in dst}

    def transition(self, state: int, symbol: str) -> set[int]:
        return {d for s, x, d in self.edges if (s, x) == (state, symbol)}

    def alphabet(self) -> set[str]:
        return {x for _, x, _ in self.edges}

    def start(self) -> int:
        return 0

    def states(self) -> set[int]:
        return set(range(len(self.accepting)))

    def accepting_states(self) -> set[int]:
        return {i for i, a in enumerate(self.accepting) if a}

    def transitions(self) -> dict[tuple[int, str], set[int]]:
        """(state, symbol): the states it leads to."""
        return {(s, x): self.transition(s, x) for s, x, _ in self.edges}

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        return spark.createDataFrame(list(enumerate(self.accepting)), NODE), spark.createDataFrame(sorted(self.edges), EDGE)


def accepting_states(nodes: DataFrame) -> DataFrame:
    return nodes.where("accepting").select("id")


def transitions(edges: DataFrame, states: DataFrame) -> DataFrame:
    """(src, symbol) to (src, symbol, dst)."""
    return states.join(edges, ["src", "symbol"])


def walk(accepting: frozenset, steps: dict, word: str) -> bool:
    """Does the machine accept the word?  One pass with the set of states it may be in."""
    states = {0}
    for symbol in word:
        states = {d for s in states for d in steps.get((s, symbol), ())}
        if not states:
            return False
    return not states.isdisjoint(accepting)


def recognizes(nodes: DataFrame, edges: DataFrame, words: DataFrame) -> DataFrame:
    """Adds ``recognized`` to words (word), in place of a column of that name; null for a null word.

    The machine goes to every executor, as one of at most SENT_EDGES transitions and
    accepting states does; each word is walked once.  A larger machine walks all words
    together, a join a symbol, with equal states of a word joined into one.
    """
    if edges.limit(SENT_EDGES + 1).count() > SENT_EDGES or accepting_states(nodes).limit(SENT_EDGES + 1).count() > SENT_EDGES:
        return _joined(nodes, edges, words)
    steps: dict[tuple[int, str], list[int]] = {}
    for e in edges.distinct().collect():
        steps.setdefault((e.src, e.symbol), []).append(e.dst)
    held = words.sparkSession.sparkContext.broadcast((frozenset(r.id for r in accepting_states(nodes).collect()), steps))

    def run(some: pd.Series) -> pd.Series:
        return some.map(lambda w: None if w is None else walk(*held.value, w))

    return words.withColumn("recognized", F.pandas_udf(run, "boolean", F.PandasUDFType.SCALAR)(F.col("word")))


def _joined(nodes: DataFrame, edges: DataFrame, words: DataFrame, cut: int = 8) -> DataFrame:
    """recognizes() by joins; the lineage is cut every ``cut`` symbols."""
    spark = words.sparkSession
    if cut and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    one = words.select("word").where("word is not null").distinct()
    longest = one.agg(F.max(F.length("word"))).first()[0] or 0
    ends = accepting_states(nodes).withColumnRenamed("id", "state")
    front = one.withColumn("state", F.lit(0).cast("long"))
    found = front.where("word = ''").join(ends, "state", "left_semi").select("word")
    for i in range(1, longest + 1):
        moved = front.where(F.length("word") >= i).select("word", F.col("state").alias("src"), F.substring("word", i, 1).alias("symbol"))
        front = moved.join(edges, ["src", "symbol"]).select("word", F.col("dst").alias("state")).distinct()
        found = found.unionByName(front.where(F.length("word") == i).join(ends, "state", "left_semi").select("word"))
        if i % cut == 0:
            front, found = front.checkpoint(), found.checkpoint()
    (hit,) = unused(words, "hit")
    out = words.join(found.distinct().withColumn(hit, F.lit(True)), "word", "left")
    told = F.when(F.col("word").isNotNull(), F.coalesce(F.col(hit), F.lit(False)))
    return out.select(*(F.col(f"`{c}`") for c in words.columns if c.lower() != "recognized"), told.alias("recognized"))


def trie(words: DataFrame) -> DataFrame:
    """(prefix, accepting): every prefix of every word (word) once; the empty one is the start."""
    w = words.select("word").where("word is not null").distinct()
    ends = w.select("word", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("n"))
    return ends.groupBy(F.expr("substring(word, 1, n)").alias("prefix")).agg(F.max(F.col("n") == F.length("word")).alias("accepting"))


def trie_edges(nodes: DataFrame) -> DataFrame:
    """(src, symbol, dst) between prefixes."""
    return nodes.where("prefix <> ''").select(F.expr("substring(prefix, 1, length(prefix) - 1)").alias("src"), F.expr("right(prefix, 1)").alias("symbol"), F.col("prefix").alias("dst"))


def accepts(nodes: DataFrame, words: DataFrame) -> DataFrame:
    """Adds ``recognized``, in place of a column of that name: in a trie a word is its own path."""
    (hit,) = unused(words, "hit")
    ends = nodes.where("accepting").select(F.col("prefix").alias("word"), F.lit(True).alias(hit))
    return words.join(ends, "word", "left").withColumn("recognized", F.coalesce(F.col(hit), F.lit(False))).drop(hit)


def with_prefix(words: DataFrame, prefix: str) -> DataFrame:
    """Words that begin with a prefix, itself included; files of words are read with the prefix as a filter."""
    return words.where(F.col("word").startswith(prefix)).select("word").distinct()
