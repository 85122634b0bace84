"""Problem 5: overlap sizes between many large sets.

Method: pair counts are kept up to date by signed deltas. The state holds, for each identifier, the sorted list of the sets
it is in. A batch of joins and leaves is joined against the state; an identifier that joins a set adds one to its pair
with each other set it is in then, one that leaves takes them away. Identifiers with the same old and new memberships give
the same deltas, so they are counted first and each distinct change is expanded once, with its number as weight: no pairs
are emitted per identifier, and no intersection is built.

Defined cases: null sets and null identifiers are no members; joining a set twice, or leaving one that the identifier is
not in, changes nothing; of several changes of one membership within a batch the last one holds (ties: the join); an empty
batch leaves the counts as they are; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "item string, sets array<bigint>"
DELTAS = "a bigint, b bigint, delta bigint"


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE)


def changes(rows: DataFrame, item: str, set_id: str, sign: str | None = None, order: str | None = None) -> DataFrame:
    """(item, joins, leaves): the net change of each identifier. sign: +1 joins, -1 leaves; without it all rows join."""
    rows = rows.where(F.col(item).isNotNull() & F.col(set_id).isNotNull())
    if sign is None:
        return rows.groupBy(F.col(item).alias("item")).agg(F.collect_set(F.col(set_id).cast("bigint")).alias("joins")).withColumn("leaves", F.array().cast("array<bigint>"))
    by = F.struct(F.col(order) if order else F.lit(0), F.col(sign))
    last = rows.groupBy(F.col(item).alias("item"), F.col(set_id).cast("bigint").alias("s")).agg(F.max_by(F.col(sign), by).alias("sign"))
    pick = lambda v: F.collect_set(F.when(F.col("sign") == v, F.col("s")))
    return last.groupBy("item").agg(pick(1).alias("joins"), pick(-1).alias("leaves"))


def apply(state: DataFrame, batch: DataFrame) -> DataFrame:
    """(item, old, sets): the memberships before and after the batch, for all identifiers of either."""
    none = F.array().cast("array<bigint>")
    both = state.join(batch, "item", "full_outer")
    old = F.coalesce("sets", none)
    new = F.array_sort(F.array_except(F.array_union(old, F.coalesce("joins", none)), F.coalesce("leaves", none)))
    return both.select("item", old.alias("old"), new.alias("sets"))


def new_state(applied: DataFrame) -> DataFrame:
    return applied.where(F.size("sets") > 0).select("item", "sets")


def deltas(applied: DataFrame) -> DataFrame:
    """(a, b, delta) with a <= b: signed changes of the pair counts; a = b is the size of the set itself."""
    kinds = applied.where(F.col("old") != F.col("sets")).groupBy("old", "sets").agg(F.count(F.lit(1)).alias("n"))
    kinds = kinds.withColumn("came", F.array_except("sets", "old")).withColumn("went", F.array_except("old", "sets"))

    def pairs(moved: str, among: str, sign: int) -> DataFrame:
        # The sets that moved are rows first and the others after, so that no row holds all pairs of an identifier in many sets. A pair of
        # two sets that both moved is counted from the smaller one.
        one = kinds.select("n", moved, among, F.explode(moved).alias("j"))
        other = F.filter(F.col(among), lambda m: (m >= F.col("j")) | ~F.array_contains(F.col(moved), m))
        two = one.select("n", "j", F.explode(other).alias("m"))
        return two.select("n", F.struct(F.least("j", "m").alias("a"), F.greatest("j", "m").alias("b"), F.lit(sign).alias("sign")).alias("p"))

    moves = pairs("came", "sets", 1).unionByName(pairs("went", "old", -1))
    return moves.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum(F.col("n") * F.col("p.sign")).alias("delta"))


def overlaps(all_deltas: DataFrame) -> DataFrame:
    """(id_a, id_b, shared, size_a, size_b, either) of every pair with something shared, id_a < id_b."""
    sums = all_deltas.groupBy("a", "b").agg(F.sum("delta").alias("shared")).where(F.col("shared") != 0)
    size = lambda c: sums.where(F.col("a") == F.col("b")).select(F.col("a").alias(f"id_{c}"), F.col("shared").alias(f"size_{c}"))
    pairs = sums.where(F.col("a") < F.col("b")).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), "shared")
    sized = pairs.join(size("a"), "id_a").join(size("b"), "id_b")
    return sized.select("id_a", "id_b", "shared", "size_a", "size_b", (F.col("size_a") + F.col("size_b") - F.col("shared")).alias("either"))
