"""FASTA text as records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, header, seq): one row a record, whatever its line length; seq in upper case without line ends.

    Files are split at record starts, so a large file is read by many tasks. Two records with the same header stay two."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    body = F.regexp_replace(F.regexp_replace("value", "\\A>", ""), "\\r", "")
    parts = raw.select(body.alias("b")).where(F.length(F.trim("b")) > 0).select(F.substring_index("b", "\n", 1).alias("header"), F.when(F.instr("b", "\n") > 0, F.expr("substring(b, instr(b, '\n') + 1)")).otherwise("").alias("rest"))
    return parts.select(F.regexp_extract("header", "^(\\S+)", 1).alias("name"), "header", F.upper(F.regexp_replace("rest", "\\s+", "")).alias("seq"))


def write_fasta(records: DataFrame, path: str, name: str = "name", seq: str = "seq", width: int = 80) -> None:
    """One file a partition; null sequences become empty ones."""
    body = F.regexp_replace(F.coalesce(F.col(seq), F.lit("")), f"(.{{{width}}})(?=.)", "$1\n")
    records.select(F.concat(F.lit(">"), F.coalesce(F.col(name).cast("string"), F.lit("")), F.lit("\n"), body).alias("value")).write.text(path)
