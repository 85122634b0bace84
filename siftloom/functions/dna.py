"""Sequence expressions; all stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The IUPAC letters and their complements.
IUPAC = "ATGCYRKMBDHV"
IUPAC_COMPLEMENT = "TACGRYMKVHDB"


def clean(seq: Column) -> Column:
    """Without spaces, tabs, carriage returns and line feeds, in upper case; null stays null."""
    blank = seq.contains(" ") | seq.contains("\t") | seq.contains("\r") | seq.contains("\n")
    return F.upper(F.when(blank, F.translate(seq, " \t\r\n", "")).otherwise(seq))


def complement_reversed(seq: Column) -> Column:
    """A/T and C/G exchanged, other letters kept, read backwards."""
    return F.reverse(F.translate(seq, "ATCG", "TAGC"))


def reverse_complement(seq: Column) -> Column:
    """The same over all IUPAC letters, case folded."""
    return F.reverse(F.translate(F.upper(seq), IUPAC, IUPAC_COMPLEMENT))


def is_plain(seq: Column) -> Column:
    """At least one base, and only A, C, G and T."""
    return (F.length(seq) > 0) & ~seq.rlike("[^ACGT]")


def strand_free(seq: Column) -> Column:
    """The smaller of a cleaned sequence and its reverse complement."""
    return F.least(seq, complement_reversed(seq))


#: First and last letter of sequences that are smaller than their reverse complement whatever stands between.
SMALLER = ("AA", "AC", "AG", "CA", "CC", "GA")


def element(seq: Column) -> Column:
    """strand_free of a sequence of A, C, G and T only, which turns no sequence round whose ends tell enough."""
    ends = F.concat(F.substring(seq, 1, 1), F.substring(seq, -1, 1))
    return F.when(ends.isin(*SMALLER), seq).otherwise(strand_free(seq))


def with_element(df, seq: str = "seq", into: str = "element"):
    """Adds the element of a raw sequence column; null where it carries none."""
    c = F.col("__clean")
    return df.withColumn("__clean", clean(F.col(seq))).withColumn(into, F.when(is_plain(c), element(c))).drop("__clean")


def elements(df, seq: str = "seq", into: str = "element"):
    """The rows that carry an element, with it. Rows are told by their raw text, and the element is marked as never null, so that neither
    this filter nor a later one makes the engine work an element out twice."""
    carries = F.col(seq).rlike("\\A[ \\t\\r\\n]*[ACGTacgt][ACGTacgt \\t\\r\\n]*\\z")
    return df.where(carries).withColumn("__clean", clean(F.col(seq))).withColumn(into, F.coalesce(element(F.col("__clean")), F.lit(""))).drop("__clean")


def shred(seq: Column, k: int) -> Column:
    """Array of all k-mers of a sequence by position; empty when it is shorter than k, as sequence(0, -n) would count down."""
    return F.when(F.length(seq) >= k, F.transform(F.sequence(F.lit(0), F.length(seq) - k), lambda i: seq.substr(i + 1, F.lit(k)))).otherwise(F.array().cast("array<string>"))
