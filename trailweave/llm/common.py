"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a longest run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: The six characters between words.
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without it, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="trailweave-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove staged tables that nothing will read again."""
    for df in tables:
        if path := getattr(df, "_staged", None):
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def row_key(*values: Column) -> Column:
    """Digest of text columns that tells null from empty text and one column from the next."""
    told = [F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return F.unhex(F.md5(F.concat(*told).cast("binary")))


def map_batches(rows: DataFrame, id_col: str, run, schema: str) -> DataFrame:
    """``rows.mapInPandas(run, schema)`` with the id passed through as text, so that nulls don't turn long ids into floats."""
    kind = rows.schema[id_col].dataType
    out = rows.withColumn(id_col, F.col(id_col).cast("string")).mapInPandas(run, f"{id_col} string, {schema}")
    return out.withColumn(id_col, F.col(id_col).cast(kind))


def literal_array(values: list, kind: str) -> Column:
    """A bounded list from the driver as one constant array column."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def blank_count(text: Column) -> Column:
    """How many of the six blank characters the text holds; each takes one byte."""
    return sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in BLANKS[1:]), F.octet_length(text) - F.octet_length(F.replace(text, F.lit(BLANKS[0]), F.lit(""))))


def word_count(text: Column) -> Column:
    """Number of words; null or empty text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
