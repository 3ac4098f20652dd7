"""Command line: counts, collocations, dictionary look-up and conversion, similarity, evaluation, models, logs."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.operators import colloc, convert, counts, dictionary, evaluate, learn, similarity, tokenize
from glossweave.sources import corpus, dictionaries, logs, tables


def _lines(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return corpus.lines(spark, a.input) if a.input else corpus.indexed_lines(spark, a.corpus_home, a.corpus_prefix)


def _entries(spark: SparkSession, a: argparse.Namespace, chinese_only: bool = False) -> DataFrame:
    return dictionary.entries(dictionaries.open_lines(spark, a.dictionary), chinese_only=chinese_only)


def count(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    lines, ignored = _lines(spark, a), corpus.ignore_patterns(spark, a.ignorelines) if a.ignorelines else []
    if a.what == "terms":
        kept = counts.without_boilerplate(lines, ignored)
        return counts.term_counts(tokenize.tokenize(kept, _entries(spark, a, True).select(F.col("key").alias("word")), "line"))
    return (counts.character_counts if a.what == "characters" else counts.bigram_counts)(lines, ignored)


def mutual_information(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    read = lambda path, name: tables.frequencies(spark, path).toDF(name, "n")
    return colloc.mutual_information(read(a.characters, "character"), read(a.bigrams, "bigram"), read(a.terms, "term"))


def evaluation(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Recall and precision; with --output, the training rows."""
    lines = corpus.lines(spark, a.input).coalesce(1).select(F.monotonically_increasing_id().alias("ord"), "line")
    evaluate.recall_precision(lines).show()
    rows, missing = evaluate.training_rows(evaluate.labelled_terms(lines), tables.mutual_information(spark, a.information))
    missing.show()
    return rows.orderBy("ord").drop("ord")


def lookup(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return dictionary.rolled_up(dictionary.lookup(_entries(spark, a), a.text)).select("key", "english", "pinyin")


def tokens(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    one = spark.createDataFrame([(a.text,)], "text string")
    return tokenize.tokenize(one, _entries(spark, a, True).select(F.col("key").alias("word")))


def simplified(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return dictionary.to_simplified(spark.createDataFrame([(a.text,)], "text string"), _entries(spark, a))


def traditional(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return dictionary.to_traditional(spark.createDataFrame([(a.text,)], "text string"), _entries(spark, a))


def similar(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return similarity.similar(_entries(spark, a), a.text)


def to_cedict(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return convert.cedict_lines(_entries(spark, a)).orderBy("ord").select("line")


def compare(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """What CC-CEDICT has and we don't: counts, and the first entries that could be added."""
    from glossweave.operators import rules

    rows, bad = dictionaries.cedict_rows(spark, a.input)
    bad.show(truncate=False)
    ours = _entries(spark, a)
    missing = convert.absent(convert.entries(rows), ours)
    rules.summary(missing).show()
    return convert.candidates(missing, ours)


def relevance(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """A decision tree, shown, and its report on the validation rows."""
    rows = learn.raw_features(tables.similarity_samples(spark, a.input))
    model = learn.decision_tree(rows, ["unigram_count", "hamming", "query_length"], "is_relevant")
    print(learn.shown(model))
    held = learn.raw_features(tables.similarity_samples(spark, a.validation or a.input))
    return evaluate.class_report(evaluate.confusion(learn.predicted(model, held), "is_relevant"))


def token_filter(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    rows = tables.tokenizer_training(spark, a.input)
    model = learn.decision_tree(rows, ["mi", "has_function_word"], "result")
    print(learn.shown(model))
    return learn.predicted(model, rows).drop("probability")


def log_samples(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return logs.samples(logs.read_logs(spark, a.input))


COMMANDS = {f.__name__: f for f in (count, mutual_information, evaluation, lookup, tokens, simplified, traditional, similar, to_cedict, compare, relevance, token_filter, log_samples)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glossweave", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("text", nargs="?", help="a word or text, or what to count: characters, bigrams or terms")
    for name in ("input", "output", "corpus-home", "corpus-prefix", "ignorelines", "dictionary", "characters", "bigrams", "terms", "information", "validation"):
        p.add_argument(f"--{name}", default="" if name in ("corpus-prefix",) else None)
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    a = parser().parse_args(arguments)
    a.what = a.text
    spark = spark or SparkSession.builder.appName("glossweave").getOrCreate()
    out = COMMANDS[a.command](spark, a)
    if a.output:
        tables.write_lines(out, a.output, *out.columns)
    else:
        out.show(truncate=False)
    return out


if __name__ == "__main__":
    main()
