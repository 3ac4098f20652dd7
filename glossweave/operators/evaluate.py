"""How good tokens and predictions are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.functions.text import annotated_tokens, annotation_line, error_term, has_function_word, strip, without_punctuation


def recall_precision(lines: DataFrame, strict: bool = True) -> DataFrame:
    """One row: tokens, false_negatives, false_positives, recall, precision of an annotated text (line).

    All tokens count as found; the ratios have four significant digits and are null
    where there is nothing to divide by.
    """
    x = lines.select(strip(F.col("line")).alias("line"))
    error = F.col("line").startswith("Error")
    tokens = F.when(annotation_line(F.col("line"), strict), F.size(annotated_tokens(F.col("line")))).otherwise(0)
    n = x.agg(
        F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"),
        F.count_if(error & F.contains("line", F.lit("false negative"))).alias("false_negatives"),
        F.count_if(error & F.contains("line", F.lit("false positive"))).alias("false_positives"),
    )
    four = lambda c: F.when(c == 0, c).otherwise(F.round(c * F.pow(F.lit(10.0), 3 - F.floor(F.log10(c)))) / F.pow(F.lit(10.0), 3 - F.floor(F.log10(c))))
    return n.withColumns({"recall": four(F.try_divide("tokens", F.col("tokens") + F.col("false_negatives"))), "precision": four(F.try_divide("tokens", F.col("tokens") + F.col("false_positives")))})


def labelled_terms(lines: DataFrame, strict: bool = True) -> DataFrame:
    """(term, result, ord) from (ord, line): 1 as a token, 0 as a false positive, the later one counts; ord is where a term came first."""
    x = lines.select("ord", strip(F.col("line")).alias("line"))
    told = x.where(annotation_line(F.col("line"), strict)).select("ord", F.posexplode(annotated_tokens(F.col("line"))).alias("i", "t"))
    told = told.select("ord", "i", without_punctuation(F.col("t")).alias("term"), F.lit(1).alias("result"))
    wrong = x.where(F.col("line").startswith("Error") & F.contains("line", F.lit("false positive"))).select("ord", F.lit(0).alias("i"), error_term(F.col("line")).alias("term"), F.lit(0).alias("result"))
    at = F.struct("ord", "i")
    return told.unionByName(wrong).where("term is not null").groupBy("term").agg(F.max_by("result", at).alias("result"), F.min(at).alias("ord"))


def training_rows(terms: DataFrame, information: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, mi, has_function_word, result, ord) of two-character terms with a score, and the terms without one."""
    two = terms.where(F.length("term") == 2)
    rows = two.join(information, "term").select("term", "mi", has_function_word(F.col("term")).alias("has_function_word"), "result", "ord")
    return rows, two.join(information, "term", "left_anti").select("term")


def errors(rows: DataFrame, result: str = "result") -> DataFrame:
    """The rows of terms that were told wrongly."""
    return rows.where(F.col(result) == 0)


def confusion(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n)."""
    return predictions.groupBy(F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction")).agg(F.count("*").alias("n"))


def confusion_matrix(predictions: DataFrame, classes: list[int], label: str = "label", prediction: str = "prediction") -> DataFrame:
    out = predictions.groupBy(F.col(label).cast("int").alias("label")).pivot(prediction, classes).count()
    return out.na.fill(0)


def class_report(confused: DataFrame) -> DataFrame:
    """(class, precision, recall, f1, support) from (label, prediction, n), then accuracy, macro and weighted averages."""
    c = confused.select(F.explode(F.array(F.struct(F.col("label").alias("class"), F.lit("l").alias("side")), F.struct(F.col("prediction").alias("class"), F.lit("p").alias("side")))).alias("x"), "label", "prediction", "n")
    hit, whole = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0), lambda s: F.sum(F.when(F.col("x.side") == s, F.col("n")).otherwise(0))
    per = c.groupBy(F.col("x.class").alias("class")).agg((F.sum(hit) / 2).alias("tp"), whole("l").alias("support"), whole("p").alias("predicted"))
    zero = F.lit(0.0)
    per = per.withColumns({"precision": F.coalesce(F.try_divide("tp", "predicted"), zero), "recall": F.coalesce(F.try_divide("tp", "support"), zero)})
    per = per.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero))
    names = ["precision", "recall", "f1"]
    rows = per.select(F.col("class").cast("string").alias("class"), *names, F.col("support").cast("long").alias("support"))
    means = per.agg(*(F.avg(x).alias(x) for x in names), F.sum("support").cast("long").alias("support"))
    weighted = per.agg(*((F.sum(F.col(x) * F.col("support")) / F.sum("support")).alias(x) for x in names), F.sum("support").cast("long").alias("support"))
    right = per.agg((F.sum("tp") / F.sum("support")).alias("a"), F.sum("support").cast("long").alias("support"))
    right = right.select(F.lit("accuracy").alias("class"), *(F.col("a").alias(x) for x in names), "support")
    return rows.unionByName(right).unionByName(means.withColumn("class", F.lit("macro avg"))).unionByName(weighted.withColumn("class", F.lit("weighted avg")))


def accuracy(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return predictions.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def described(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, count, mean, stddev, min, q1, median, q3, max), with exact quartiles."""
    def one(c: str) -> DataFrame:
        q = F.percentile(F.col(c), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        x = df.agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev(c).alias("stddev"), F.min(c).cast("double").alias("min"), q.alias("q"), F.max(c).cast("double").alias("max"))
        return x.select(F.lit(c).alias("column"), "count", "mean", "stddev", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max")

    out = one(columns[0])
    for c in columns[1:]:
        out = out.unionByName(one(c))
    return out


def info(df: DataFrame) -> DataFrame:
    """(column, type, present): how many values of each column are not null."""
    counts = df.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in df.columns))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"`{c}`").alias("present")) for c, t in df.dtypes))
    return counts.select(F.explode(rows).alias("x")).select("x.*")
