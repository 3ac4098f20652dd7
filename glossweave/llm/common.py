"""What the operations share: tables, and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.functions.names import unused
from glossweave.sources.tables import checkpoint_dir

#: The characters that separate words, as a class for Java's and Python's regular expressions.
SPACE = "\\x20\\x09-\\x0D"

#: Of an Arrow batch; a row that is longer makes a batch of its own.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared(spark: SparkSession) -> str:
    """A new folder that all executors see, under spark.checkpoint.dir (a local one only while the master is local and that is unset)."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, at the latest when Python ends; on other file systems only while the session lives."""
    if path.startswith("file:"):
        shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
    elif spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def map_arrow(df: DataFrame, f, schema: str) -> DataFrame:
    """mapInArrow with batches of at most BATCH_BYTES: task and worker hold several copies of one.

    Sets the session's limits, which Spark reads when it plans; smaller ones stay.
    """
    conf = df.sparkSession.conf
    if int(str(conf.get("spark.sql.execution.arrow.maxBytesPerBatch")).rstrip("b")) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(f, schema)


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text):
    """A-Z to a-z and nothing else; lower() does that for texts of ASCII alone."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


#: A key is hot with more than one in HOT_KEYS of all rows, so there are fewer hot keys than that; and with more than WARM rows.
HOT_KEYS, WARM = 1000, 256


def joined(big: DataFrame, small: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """big joined ("inner" or "left") with small, which has each key once and, as ``weight``, how many rows of big have it.

    A key with more than a thousandth of ``total``, the sum of all weights or more, is dealt
    to as many parts as it has thousandths (or WARM rows, if that is more): its row of small is repeated, and rows of big
    are sent by a hash of their other columns.  Only the names of these keys, of which there
    can be no more than a thousand, are broadcast.  weight is dropped.
    """
    parts, salt = unused([*big.columns, *small.columns], "parts", "salt")
    most = F.lit(max(WARM, total / HOT_KEYS))
    dealt = small.withColumn(parts, F.greatest(F.ceil(F.col(weight) / most), F.lit(1)).cast("int")).drop(weight)
    hot = dealt.where(F.col(parts) > 1).select(*keys, parts)
    others = [F.col(f"`{c}`") for c in big.columns if c not in keys]
    left = big.join(F.broadcast(hot), keys, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(*others), F.col(parts)), F.lit(0)).cast("int")).drop(parts)
    right = dealt.withColumn(salt, F.explode(F.sequence(F.lit(0), F.col(parts) - 1))).drop(parts)
    return left.join(right, [*keys, salt], how).drop(salt)
