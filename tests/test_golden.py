"""The chain from lines to a token filter, against values made once and kept."""

import os

import pytest
from pyspark.sql import functions as F

from glossweave.operators import evaluate, learn, tokenize
from glossweave.plans.chain import chain, training
from glossweave.sources import corpus, tables

HERE = os.path.join(os.path.dirname(__file__), "fixtures")
NAMES = ["shijing001", "shijing002", "shijing003", "shijing004", "shangshu001", "shangshu002"]


def golden(name):
    with open(f"{HERE}/{name}.tsv", encoding="utf-8") as f:
        return dict(line.rstrip("\n").split("\t")[:2] for line in f if "\t" in line)


@pytest.fixture(scope="module")
def home(tmp_path_factory):
    """A corpus with two levels of indexes."""
    top = tmp_path_factory.mktemp("home")
    (top / "data/corpus").mkdir(parents=True)
    (top / "texts").mkdir()
    (top / "data/corpus/collections.csv").write_text("# Collections\n\na.csv\ta.html\tA\nb.csv\tb.html\tB\n")
    (top / "data/corpus/a.csv").write_text("#Source\n" + "".join(f"{n}.txt\t{n}.html\t{n}\n" for n in NAMES[:4]))
    (top / "data/corpus/b.csv").write_text("".join(f"{n}.txt\t{n}.html\t{n}\n" for n in NAMES[4:]))
    (top / "data/corpus/ignore.txt").write_text("CreativeCommons\n\ncopyright")
    for n in NAMES:
        with open(f"{HERE}/{n}.txt", "rb") as f:
            (top / f"texts/{n}.txt").write_bytes(f.read())
    return str(top)


@pytest.fixture(scope="module")
def made(spark, home):
    words = [(w,) for w in golden("term_freq") if len(w) > 1]
    lines = corpus.indexed_lines(spark, home, "texts")
    assert lines.count() == 209
    patterns = corpus.ignore_patterns(spark, f"{home}/data/corpus/ignore.txt")
    assert patterns == ["CreativeCommons", "copyright"]
    return chain(lines, spark.createDataFrame(words, "word string"), patterns)


@pytest.mark.parametrize(("part", "name", "total"), [("characters", "char_freq", 3732), ("bigrams", "char_bigram_freq", 3647), ("terms", "term_freq", 10996)])
def test_counts(made, part, name, total):
    got = {r[0]: r[1] for r in getattr(made, part).collect()}
    assert sum(got.values()) == total
    with open(f"{HERE}/{name}.tsv", encoding="utf-8") as f:
        expected = {k: int(v) for k, _, v in (line.rstrip("\n").rpartition("\t") for line in f if "\t" in line)}
    assert got == expected


def test_mutual_information(made):
    got, expected = {r.term: r.mi for r in made.information.collect()}, golden("mutual_info")
    assert got.keys() == expected.keys()
    assert max(abs(got[k] - float(v)) for k, v in expected.items()) < 1e-9


def test_training_rows(spark, made):
    rows = corpus.lines(spark, f"{HERE}/annotated.md").coalesce(1).select(F.monotonically_increasing_id().alias("ord"), "line")
    got = [(r.term, round(r.mi, 9), r.has_function_word, r.result) for r in training(rows, made.information).collect()]
    expected = [(r.term, round(r.mi, 9), r.has_function_word, r.result) for r in tables.tokenizer_training(spark, f"{HERE}/training_example.tsv").collect()]
    assert got == expected
    assert len(got) == 30


def test_recall_and_precision(spark):
    r = evaluate.recall_precision(corpus.lines(spark, f"{HERE}/annotated.md")).first()
    assert tuple(r) == (172, 11, 1, 0.9399, 0.9942)


@pytest.mark.parametrize(("name", "expected"), [("training_balanced", (160, 10, 31, 17)), ("training_combined", (144, 29, 35, 32))])
def test_decision_tree(spark, name, expected):
    rows = learn.raw_features(tables.similarity_samples(spark, f"{HERE}/{name}.csv"))
    model = learn.decision_tree(rows, ["unigram_count", "hamming", "query_length"], "is_relevant")
    found = {(r.label, r.prediction): r.n for r in evaluate.confusion(learn.predicted(model, rows), "is_relevant").collect()}
    assert tuple(found[k] for k in ((0, 0), (0, 1), (1, 0), (1, 1))) == expected
    assert "2.5" in learn.shown(model) or name != "training_balanced"


def test_validation(spark):
    rows = tables.similarity_samples(spark, f"{HERE}/validation_biyan.csv")
    rule = (F.col("unigram_count") > learn.UNIGRAM_SPLIT) & (F.col("hamming") <= learn.HAMMING_SPLIT)
    found = {(r.label, r.prediction): r.n for r in evaluate.confusion(rows.withColumn("prediction", rule.cast("int")), "is_relevant").collect()}
    assert [found[k] for k in ((0, 0), (0, 1), (1, 0), (1, 1))] == [46, 3, 6, 5]


def test_three_tokenizers_agree(spark, home):
    words = [w for w in golden("term_freq") if len(w) > 1]
    lines = corpus.indexed_lines(spark, home, "texts").select(F.col("line").alias("text")).distinct()
    held = spark.createDataFrame([(w,) for w in words], "word string")
    by_join = tokenize.tokens_by_join(lines, held).withColumnRenamed("tokens", "a")
    all_three = by_join.withColumns({"b": tokenize.tokens_by_pattern(F.col("text"), words), "c": tokenize.tokens_by_arrow(F.col("text"), words)})
    assert all_three.where("not (a <=> b) or not (a <=> c) or array_join(a, '') <> text").count() == 0
    whole = tokenize.tokens_by_join(lines, held, exclude_whole=True).withColumnRenamed("tokens", "a")
    assert whole.withColumn("c", tokenize.tokens_by_arrow(F.col("text"), words, exclude_whole=True)).where("not (a <=> c)").count() == 0


def test_models_train(spark):
    rows = learn.raw_features(tables.similarity_samples(spark, f"{HERE}/training_combined.csv"))
    for fit in (learn.logistic_regression, lambda *a: learn.perceptron(*a, hidden=8, iterations=20)):
        out = learn.predicted(fit(rows, ["unigram_count", "hamming", "query_length"], "is_relevant"), rows)
        assert evaluate.accuracy(out, "is_relevant").first()[0] > 0.65
        assert out.where("probability between 0 and 1").count() == 240
