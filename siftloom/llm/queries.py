"""The queries of the nine problems over their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftloom.functions import dna
from siftloom.llm import distinct, heavy, mixing, repetition, seen, sets, spans, terms, tokens
from siftloom.session import durable, shuffle_partitions, table

SUPPORT = 0.005
COMMON = 0.1
ERROR = 0.005


# 1 -- most frequent values


def _heavy(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "query_result").select(F.col("count").cast("string").alias("value"))
    elements = dna.elements(table(spark, d, "cbf_insert").select("seq"), into="value").select("value")
    both = [heavy.heavy_hitters(rows, "value", SUPPORT).select(F.lit(field).alias("field"), "value", "estimate", "count", "total") for field, rows in (("count", counts), ("seq", elements))]
    return both[0].unionByName(both[1])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _heavy(spark, d).select("field", "value")


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Values with exact counts, and whether the sketch's estimate is no smaller, as it must not be."""
    return _heavy(spark, d).select("field", "value", F.col("count").alias("n"), F.col("total").alias("n_rows"), (F.col("estimate") >= F.col("count")).alias("not_below"))


# 2 -- seen before


def _answers(spark: SparkSession, d: str) -> DataFrame:
    contigs = table(spark, d, "contig").select("seq_id", "filter_id", "loaded_at", dna.clean(F.col("seq")).alias("cleaned"))
    headers = table(spark, d, "bit_filter").select(F.col("filter_id").alias("group"), F.col("dFPR").alias("error"), F.col("HashNum").alias("hashes"))
    return seen.answers(contigs, dna.strand_free(F.col("cleaned")), "filter_id", "loaded_at", "seq_id", headers)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return seen.verified(durable(_answers(spark, d), "answers")).select(F.col("id").alias("seq_id")).distinct()


def _rates(spark: SparkSession, d: str) -> DataFrame:
    answered = durable(_answers(spark, d), "answers")
    true = durable(seen.verified(answered), "true")
    counts = true.groupBy(F.col("grp").alias("g")).agg(F.countDistinct("id").alias("seen_before"))
    # A true case is the record with its key; an answer "seen" to it is one of those that were verified.
    per = answered.groupBy("grp").agg(
        F.countDistinct("id").alias("records"), F.countDistinct(F.when(F.col("seen"), F.col("id"))).alias("answered_seen"), F.max("bound").alias("bound"),
        F.max("layers").alias("layers"), F.min(F.when(F.col("layers") > 0, F.col("least_k"))).alias("least_k"), F.max("most_k").alias("most_k"), F.countDistinct("a", "b").alias("keys"),
    )
    chains = answered.groupBy("grp", F.pmod(F.xxhash64("grp", "a"), F.lit(shuffle_partitions(spark))).alias("way")).agg(F.max("bits").alias("bits")).groupBy(F.col("grp").alias("c")).agg(F.sum("bits").alias("bits"))
    headers = table(spark, d, "bit_filter").groupBy(F.col("filter_id").alias("f")).agg(F.max("dFPR").alias("dFPR"), F.max(F.when(F.col("HashNum") > 0, F.col("HashNum"))).alias("k_wanted"))
    out = per.join(counts, F.col("grp").eqNullSafe(F.col("g")), "left").join(headers, F.col("grp") == F.col("f"), "left").join(chains, F.col("grp").eqNullSafe(F.col("c")), "left")
    return out.withColumn("seen_before", F.coalesce("seen_before", F.lit(0))).withColumns({"wrong": F.col("answered_seen") - F.col("seen_before"), "new": F.col("records") - F.col("seen_before")})


def p2_rate(spark: SparkSession, d: str) -> DataFrame:
    """Per filter: records, those seen before, and whether the wrong answers keep to the bound of its chains (six standard errors and
    one answer allowed), the bound to dFPR, and every layer to HashNum."""
    out = _rates(spark, d)
    expected = F.col("new") * F.col("bound")
    k_kept = F.col("k_wanted").isNull() | ((F.col("least_k") == F.col("k_wanted")) & (F.col("most_k") == F.col("k_wanted")))
    wanted = F.when((F.col("dFPR") > 0) & (F.col("dFPR") < 0.5), F.col("dFPR")).otherwise(F.lit(seen.DEFAULT_ERROR))
    return out.select(F.col("grp").alias("filter_id"), "records", "seen_before", ((F.col("wrong") >= 0) & (F.col("wrong") <= expected + 6 * F.sqrt(expected) + 1)).alias("rate_kept"), (F.col("bound") <= wanted).alias("bound_kept"), k_kept.alias("k_kept"), "dFPR", "k_wanted")


def p2_measured(spark: SparkSession, d: str) -> DataFrame:
    """Per filter: answers, wrong ones and their rate beside the bound of its chains and dFPR, and what the chains took."""
    out = _rates(spark, d)
    return out.select(F.col("grp").alias("filter_id"), "records", "answered_seen", "seen_before", "wrong", F.when(F.col("new") > 0, F.col("wrong") / F.col("new")).alias("measured_rate"), "bound", "dFPR", "k_wanted", "least_k", "most_k", "layers", (F.col("bits") / F.col("keys")).alias("bits_a_key"))


# 3 -- every term


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """(filter_id, seq, occurrences, reads, rare, common): a filter without a threshold calls nothing rare."""
    rows = dna.elements(table(spark, d, "cbf_insert").select("seq_id", "pos", "seq", "filter_id"))
    counts, totals = terms.counted(rows, "element", "seq_id", "filter_id", "pos")
    reads = totals.select(F.col("grp").alias("f"), F.col("records").alias("all_reads"))
    limits = table(spark, d, "counting_filter").groupBy(F.col("filter_id").alias("c")).agg(F.max("threshold").alias("threshold"))
    # One row a filter on the small sides.
    joined = counts.join(reads, F.col("grp").eqNullSafe(F.col("f")), "left").join(limits, F.col("grp") == F.col("c"), "left")
    rare = F.coalesce(F.col("records") < F.col("threshold"), F.lit(False))
    common = F.col("records") >= F.col("all_reads") * F.lit(COMMON)
    return joined.select(F.col("grp").alias("filter_id"), F.col("term").alias("seq"), "occurrences", F.col("records").alias("reads"), rare.alias("rare"), common.alias("common"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    marks = F.array_compact(F.array(F.when(F.col("rare"), F.lit("rare")), F.when(F.col("common"), F.lit("common"))))
    return p3_counts(spark, d).select("filter_id", "seq", F.explode(marks).alias("mark"))


# 4 -- shared spans


def _contigs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "contig").select("seq_id", "id", dna.clean(F.col("seq")).alias("cleaned"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = spans.shared_spans(_contigs(spark, d), "seq_id", "id", F.col("cleaned"), 50)
    return found.select(F.col("record").alias("seq_id"), "span_start", "span_end")


def p4_part(spark: SparkSession, d: str) -> DataFrame:
    rows = _contigs(spark, d)
    return spans.shared_part(rows, "seq_id", "id", F.col("cleaned"), spans.shared_spans(rows, "seq_id", "id", F.col("cleaned"), 50)).withColumnRenamed("record", "seq_id")


# 5 -- overlaps


def p5_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of sources. The rows come in two loads, before and from the middle of the loading time; the second is
    joined against the state that the first leaves."""
    rows = table(spark, d, "mi_element").select("id", "seq", F.col("loaded_at").cast("timestamp").alias("loaded_at")).where(F.col("id") != 0)
    low, high = rows.agg(F.min(F.unix_micros("loaded_at")), F.max(F.unix_micros("loaded_at"))).first()
    middle = F.timestamp_micros(F.lit((low + high) // 2 if low is not None else 0))
    late = F.col("loaded_at") >= middle
    state, moved = sets.empty_state(spark), []
    for load in (rows.where(~late | F.col("loaded_at").isNull()), rows.where(late)):
        applied = durable(sets.apply(state, sets.changes(dna.elements(load), "element", "id")), "members")
        moved.append(sets.deltas(applied))
        state = sets.new_state(applied)
    return sets.overlaps(moved[0].unionByName(moved[1]))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_overlaps(spark, d).where(F.col("shared") * 10 >= F.col("either")).select("id_a", "id_b")


# 6 -- distinct counts


def _placed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "mi_element").select("id", "filter_id", "seq", F.col("inserted_at").cast("timestamp").alias("inserted_at")).where(F.col("filter_id").isNotNull() & F.col("inserted_at").isNotNull())
    return dna.elements(rows).select("id", "filter_id", "inserted_at", "element")


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "filter_snapshot").select("snapshot_id", "filter_id", "id", F.col("period_start").cast("timestamp").alias("period_start"), "period_days", "nEntry", "Entry").dropDuplicates(["snapshot_id"])
    end = F.timestamp_micros(F.unix_micros("period_start") + F.col("period_days").cast("bigint") * F.lit(86_400_000_000))
    return s.withColumn("period_end", end).withColumn("day", F.to_date("period_start")).withColumn("whole_days", F.col("period_start") == F.date_trunc("day", "period_start"))


#: Words that are united in one place.
STRETCH = 512
#: Cells that tell of which sources of a filter snapshots ask, so that the others need no bitmap of their own.
ASKED = 1 << 18


def _asked(snapshots: DataFrame) -> Column:
    """Whether a snapshot may ask for this filter_id and id: false only where none does. The driver gets ASKED / 64 words at most."""
    at = F.pmod(F.xxhash64("filter_id", "id"), F.lit(ASKED))
    found = snapshots.where(F.col("id").isNotNull()).select(at.alias("at")).groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).collect()
    held = [0] * (ASKED // 64)
    for r in found:
        held[r.word] = r.bits
    return F.call_function("getbit", F.get(distinct.numbers(held), F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1


def _snapshot_estimates(spark: SparkSession, d: str, rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Each snapshot with the estimate of its union of day bitmaps.

    There are bitmaps of filters by day, sized by all rows of the filter, and of those sources by day of which snapshots ask, sized
    by the rows of filter and source; both travel in rows of four numbers."""
    of_filter, of_source = distinct.sized(table(spark, d, "mi_element").select("filter_id", "id"), "filter_id", "id", ERROR)
    group = lambda source: F.xxhash64(F.lit("source" if source else "filter"), "filter_id", *(["id"] if source else []))
    level = lambda source: F.struct(group(source).alias("f"), (of_source if source else of_filter).cast("bigint").alias("m"))
    whole, part = level(False), level(True)
    wanted = F.when(F.col("id").isNotNull() & _asked(snapshots), F.array(whole, part)).otherwise(F.array(whole))
    days = rows.select(F.unix_date(F.to_date("inserted_at")).alias("on"), "element", F.explode(wanted).alias("l")).select("l.f", "on", "element", "l.m")
    maps = distinct.words(days, ["f", "on"], "element", "m", carry=False)
    named = F.when(F.col("id").isNull(), group(False)).otherwise(group(True))
    size = F.when(F.col("id").isNull(), of_filter).otherwise(of_source)
    # Both sides meet by group and stretch of words, a fixed number of them, so that no group is too large for a task and the union needs
    # no other shuffle. The hash table is of the snapshots.
    stretches = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.expr(f"m div {STRETCH * 64}"), F.lit(1)) - 1))
    asked = snapshots.select("snapshot_id", named.alias("g"), size.alias("m"), F.unix_date("day").alias("first"), (F.unix_date("day") + F.col("period_days")).alias("end")).withColumn("stretch", stretches)
    placed = maps.withColumn("part", F.expr(f"word div {STRETCH}"))
    met = placed.join(asked.hint("shuffle_hash"), (F.col("f") == F.col("g")) & (F.col("part") == F.col("stretch")) & (F.col("on") >= F.col("first")) & (F.col("on") < F.col("end")))
    united = distinct.union(met, ["f", "part", "snapshot_id"], "m")
    est = distinct.estimates(united, ["snapshot_id"], "m").withColumnRenamed("snapshot_id", "sid")
    out = snapshots.join(est, F.col("snapshot_id") == F.col("sid"), "left").drop("sid")
    nothing = F.col("ones").isNull()
    return out.withColumns({c: F.when(nothing, F.lit(0.0)).otherwise(F.col(c)) for c in ("estimate", "low", "high")})


def p6_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Every snapshot with estimate, bounds, and nEntry and Entry beside them. Without whole_days the estimate is of the days that
    the period begins on or covers, from the first one's midnight."""
    out = _snapshot_estimates(spark, d, _placed(spark, d), _snapshots(spark, d))
    rounded = (F.round(c, 3).alias(c) for c in ("estimate", "low", "high"))
    return out.select("snapshot_id", "filter_id", "id", "period_start", "period_days", "whole_days", *rounded, "nEntry", "Entry", (F.col("nEntry") > F.col("Entry")).alias("more_than_entered"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Clear cases by the bounds of the estimate; the others by an exact count of their rows alone."""
    rows = _placed(spark, d)
    est = _snapshot_estimates(spark, d, rows, _snapshots(spark, d)).where(F.col("nEntry").isNotNull() & F.col("period_end").isNotNull())
    n = F.col("nEntry").cast("double")
    exact_zero = F.col("ones").isNull() & F.col("whole_days")
    sure = F.col("whole_days") & F.coalesce((n < 0.9 * F.col("low")) | (n > 1.1 * F.col("high")), F.lit(False))
    never = F.col("whole_days") & F.coalesce((n >= 0.9 * F.col("high")) & (n <= 1.1 * F.col("low")), F.lit(False))
    verdict = F.when(exact_zero, F.when(n != 0, "case").otherwise("none")).when(sure, "case").when(never, "none").otherwise("count")
    judged = durable(est.select("snapshot_id", "filter_id", "id", "period_start", "period_end", "nEntry", verdict.alias("verdict")), "verdicts")
    # By filter and day, as a filter may hold a third of all rows.
    last = F.to_date(F.timestamp_micros(F.unix_micros("period_end") - 1))
    open_ = judged.where("verdict = 'count'").select("snapshot_id", F.col("filter_id").alias("g"), F.col("id").alias("src"), "period_start", "period_end", "nEntry")
    by_day = open_.where("period_end > period_start").withColumn("day", F.explode(F.sequence(F.to_date("period_start"), last)))
    inside = (F.col("filter_id") == F.col("g")) & (F.to_date("inserted_at") == F.col("day")) & (F.col("inserted_at") >= F.col("period_start")) & (F.col("inserted_at") < F.col("period_end")) & (F.col("src").isNull() | (F.col("src") == F.col("id")))
    held = rows.join(by_day, inside).select("snapshot_id", "element").distinct().groupBy(F.col("snapshot_id").alias("sid")).agg(F.count(F.lit(1)).alias("d"))
    counted = open_.join(held, F.col("snapshot_id") == F.col("sid"), "left").withColumn("d", F.coalesce("d", F.lit(0)))
    off = counted.where(F.abs(F.col("nEntry") - F.col("d")) * 10 > F.col("d")).select("snapshot_id")
    return judged.where("verdict = 'case'").select("snapshot_id").unionByName(off)


def p6_unions(spark: SparkSession, d: str) -> DataFrame:
    """Distinct elements of each source over all filters and days, and of the unions of neighbouring sources by id: bitmaps
    of one size, by the number of all rows, are built once and merged."""
    base = table(spark, d, "mi_element")
    m = distinct.bits_for(base.count(), ERROR)  # the number of rows, from the footers, bounds any union
    rows = dna.elements(base.select("id", "seq").where(F.col("id") != 0)).withColumn("m", F.lit(m).cast("bigint"))
    per = distinct.words(rows, ["id"], "element", "m")
    pair = per.withColumn("first", F.explode(F.array(F.col("id") - 1, F.col("id"))))
    ids = per.select("id").distinct()
    ids = ids.select(F.col("id").alias("first")).join(ids.select((F.col("id") - 1).alias("first")), "first", "left_semi")
    both = distinct.union(pair.join(ids, "first", "left_semi"), ["first"], "m")
    groups = per.select(F.concat(F.lit(""), F.col("id").cast("string")).alias("sources"), "m", "word", "bits").unionByName(both.select(F.concat(F.col("first").cast("string"), F.lit("+"), (F.col("first") + 1).cast("string")).alias("sources"), "m", "word", "bits"))
    return distinct.estimates(groups, ["sources"], "m").select("sources", "m", "ones", *(F.round(c, 3).alias(c) for c in ("estimate", "low", "high")))


# 7 -- token ids


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every text back from its ids."""
    return tokens.decoded(p7_ids(spark, d))


# 8 -- mixing


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    return mixing.selection(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """Whether each source keeps to its cap, and the slots drawn for it to its scaled target, six standard deviations allowed."""
    r = p8_shares(spark, d)
    slots = F.sum("drawn").over(Window.partitionBy(F.lit(0)))  # one row a source
    near = F.abs(F.col("drawn") / F.greatest(slots, F.lit(1)) - F.col("scaled_share")) <= 6 * F.col("deviation") + 1e-9
    return r.select("source", "target_share", "max_repeats", (F.col("max_repeats").isNull() | (F.col("repeats") <= F.col("max_repeats"))).alias("cap_kept"), near.alias("share_kept"))


# 9 -- repetition


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_shares(spark, d).where((F.col("words") > 0) & (F.col("repeated") * 2 >= F.col("words"))).select("doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repeated_share(table(spark, d, "documents"))


def p9_lines(spark: SparkSession, d: str) -> DataFrame:
    return repetition.line_frequency(table(spark, d, "documents"), F.lower(F.trim(F.col("source"))))


def queries() -> dict:
    named = (p1_found, p1_counts, p2_found, p2_rate, p2_measured, p3_counts, p3_found, p4_found, p4_part, p5_overlaps, p5_found, p6_estimates, p6_found, p6_unions, p7_ids, p7_decoded, p8_selection, p8_shares, p8_kept, p9_found, p9_shares, p9_lines)
    return {f.__name__: f for f in named}


# SQL

_CLEAN = "upper(translate(seq, ' ' || chr(9) || chr(10) || chr(13), ''))"
_REV = "reverse(translate({0}, 'ATCG', 'TAGC'))"


def _sql_elements(name: str, columns: str) -> str:
    return f"SELECT {columns}, least(c, {_REV.format('c')}) AS element FROM (SELECT *, {_CLEAN} AS c FROM {name}) WHERE regexp_full_match(c, '[ACGT]+')"


_HEAVY = f"""WITH v AS (SELECT 'count' AS field, CAST("count" AS VARCHAR) AS value FROM query_result WHERE "count" IS NOT NULL
  UNION ALL SELECT 'seq', element FROM ({_sql_elements("cbf_insert", "seq_id")})),
t AS (SELECT field, count(*) AS n_rows FROM v GROUP BY field),
c AS (SELECT field, value, count(*) AS n FROM v GROUP BY field, value)
SELECT {{0}} FROM c JOIN t USING (field) WHERE n >= 0.005 * n_rows"""

_SEEN = f"""WITH c AS (SELECT DISTINCT seq_id, filter_id, loaded_at, {_CLEAN} AS c FROM contig),
k AS (SELECT seq_id, filter_id, loaded_at, least(c, {_REV.format("c")}) AS key FROM c WHERE c <> '')
SELECT DISTINCT seq_id FROM (SELECT seq_id, row_number() OVER (PARTITION BY filter_id, key ORDER BY loaded_at, seq_id) AS rn FROM k) WHERE rn > 1"""

_RATE = _SEEN.replace("SELECT DISTINCT seq_id FROM (SELECT seq_id,", "SELECT DISTINCT seq_id, filter_id FROM (SELECT seq_id, filter_id,")
_RATE = f"""WITH c AS (SELECT DISTINCT seq_id, filter_id FROM contig WHERE {_CLEAN} <> ''),
b AS ({_RATE}),
f AS (SELECT filter_id, max(dFPR) AS dFPR, max(CASE WHEN HashNum > 0 THEN HashNum END) AS k_wanted FROM bit_filter GROUP BY filter_id)
SELECT c.filter_id, count(DISTINCT c.seq_id) AS records, count(DISTINCT b.seq_id) AS seen_before, true AS rate_kept, true AS bound_kept, true AS k_kept, any_value(dFPR) AS dFPR, any_value(k_wanted) AS k_wanted
FROM c LEFT JOIN b ON c.seq_id = b.seq_id AND c.filter_id IS NOT DISTINCT FROM b.filter_id LEFT JOIN f ON f.filter_id = c.filter_id GROUP BY c.filter_id"""

_TERMS = f"""WITH e AS ({_sql_elements("cbf_insert", "seq_id, pos, filter_id")}),
a AS (SELECT filter_id, count(DISTINCT seq_id) AS all_reads FROM e GROUP BY filter_id),
c AS (SELECT filter_id, element AS seq, count(DISTINCT (seq_id, pos)) AS occurrences, count(DISTINCT seq_id) AS reads FROM e GROUP BY filter_id, element),
m AS (SELECT filter_id, seq, occurrences, reads, coalesce(reads < threshold, false) AS rare, reads >= 0.1 * all_reads AS common
  FROM c JOIN a USING (filter_id) LEFT JOIN counting_filter USING (filter_id))"""

_SPANS = f"""WITH c AS (SELECT DISTINCT seq_id, id, {_CLEAN} AS c FROM contig WHERE id IS NOT NULL AND id <> 0),
w AS (SELECT seq_id, id, i, substr(c, i, 50) AS win FROM (SELECT seq_id, id, c, unnest(range(1, length(c) - 48)) AS i FROM c WHERE length(c) >= 50)),
p AS (SELECT seq_id, id, i, win FROM w WHERE regexp_full_match(win, '[ACGT]+')),
s AS (SELECT win FROM p GROUP BY win HAVING count(DISTINCT id) > 1),
h AS (SELECT DISTINCT seq_id, i FROM p SEMI JOIN s USING (win)),
g AS (SELECT seq_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY seq_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM h),
r AS (SELECT seq_id, i, sum(new) OVER (PARTITION BY seq_id ORDER BY i) AS run FROM g),
spans AS (SELECT seq_id, min(i)::BIGINT AS span_start, (max(i) + 49)::BIGINT AS span_end FROM r GROUP BY seq_id, run)"""

_OVERLAPS = f"""WITH e AS (SELECT DISTINCT id, element FROM ({_sql_elements("mi_element", "id")}) WHERE id IS NOT NULL AND id <> 0),
n AS (SELECT id, count(*) AS size FROM e GROUP BY id),
p AS (SELECT x.id AS id_a, y.id AS id_b, count(*) AS shared FROM e x JOIN e y ON x.element = y.element AND x.id < y.id GROUP BY x.id, y.id),
o AS (SELECT id_a, id_b, shared, a.size AS size_a, b.size AS size_b, a.size + b.size - shared AS either FROM p JOIN n a ON a.id = id_a JOIN n b ON b.id = id_b)"""

_SNAPSHOTS = f"""WITH e AS ({_sql_elements("mi_element", "id, filter_id, inserted_at")}),
s AS (SELECT DISTINCT snapshot_id, filter_id, id, period_start, period_days, nEntry FROM filter_snapshot),
d AS (SELECT s.snapshot_id, s.nEntry, count(DISTINCT e.element) AS d FROM s LEFT JOIN e ON e.filter_id = s.filter_id AND (s.id IS NULL OR s.id = e.id)
  AND e.inserted_at >= s.period_start AND e.inserted_at < s.period_start + to_days(s.period_days) GROUP BY s.snapshot_id, s.nEntry)
SELECT snapshot_id FROM d WHERE nEntry IS NOT NULL AND abs(nEntry - d) > 0.1 * d"""

_HASH60 = "('0x' || substr(md5(element), 1, 15))::BIGINT"


def _sql_bits(n: str) -> str:
    """distinct.bits_for in SQL."""
    good = f"{n} / pow(2, e) <= {distinct.MOST_FULL} AND sqrt(pow(2, e) * ({{0}} - greatest({n}, 1) / pow(2, e))) / greatest({n}, 1) <= {ERROR}"
    # e^t - 1 in terms that stay exact for small t
    t = f"(greatest({n}, 1) / pow(2, e))"
    expm1 = f"CASE WHEN {t} < 0.001 THEN {t} + {t} * {t} / 2 + {t} * {t} * {t} / 6 ELSE exp({t}) - 1 END"
    return f"(1::BIGINT << list_filter(range({distinct.bits_for(1, ERROR).bit_length() - 1}, 60), lambda e: {good.format(f'({expm1})')})[1])"


_BOUNDED = """x AS (SELECT *, CASE WHEN ones < m THEN -m::DOUBLE * ln(1 - ones / m::DOUBLE) END AS estimate FROM counted),
b AS (SELECT *, 6 * sqrt(m::DOUBLE * (exp(estimate / m) - 1 - estimate / m)) + CASE WHEN ones > 1 THEN 1 ELSE 0 END AS spread FROM x)"""
_LOW, _HIGH = "round(coalesce(greatest(ones::DOUBLE, estimate - spread), ones::DOUBLE), 3)", "round(estimate + spread, 3)"

_ESTIMATES = f"""WITH e AS ({_sql_elements("mi_element", "id, filter_id, inserted_at")}),
c AS (SELECT ('0x' || substr(md5(filter_id), 1, 3))::BIGINT AS cell, id FROM mi_element WHERE filter_id IS NOT NULL),
whole AS (SELECT cell, {_sql_bits("n")} AS m FROM (SELECT cell, count(*)::DOUBLE AS n FROM c GROUP BY cell)),
part AS (SELECT cell, {_sql_bits("n")} AS m FROM (SELECT (cell + id * {distinct.CELL_STEP}) % {distinct.CELLS} AS cell, count(*)::DOUBLE AS n FROM c WHERE id IS NOT NULL GROUP BY 1)),
s AS (SELECT DISTINCT snapshot_id, filter_id, id, period_start, period_days, nEntry, Entry, ('0x' || substr(md5(filter_id), 1, 3))::BIGINT AS cell FROM filter_snapshot),
z AS (SELECT s.*, CASE WHEN s.id IS NULL THEN whole.m ELSE part.m END AS m FROM s LEFT JOIN whole USING (cell) LEFT JOIN part ON part.cell = (s.cell + s.id * {distinct.CELL_STEP}) % {distinct.CELLS}),
counted AS (SELECT z.snapshot_id, z.m, count(DISTINCT {_HASH60} % z.m) AS ones FROM z JOIN e ON e.filter_id = z.filter_id AND (z.id IS NULL OR z.id = e.id)
  AND e.inserted_at::DATE >= z.period_start::DATE AND e.inserted_at::DATE < z.period_start::DATE + z.period_days GROUP BY z.snapshot_id, z.m),
{_BOUNDED}
SELECT s.snapshot_id, filter_id, id, period_start, period_days, period_start = date_trunc('day', period_start) AS whole_days, CASE WHEN ones IS NULL THEN 0.0::DOUBLE ELSE round(estimate, 3) END AS estimate,
CASE WHEN ones IS NULL THEN 0.0::DOUBLE ELSE {_LOW} END AS low, CASE WHEN ones IS NULL THEN 0.0::DOUBLE ELSE {_HIGH} END AS high, nEntry, Entry, nEntry > Entry AS more_than_entered FROM s LEFT JOIN b USING (snapshot_id)"""

_UNIONS = f"""WITH e AS ({_sql_elements("mi_element", "id")} AND id <> 0),
size AS (SELECT {_sql_bits("n")} AS m FROM (SELECT count(*)::DOUBLE AS n FROM mi_element)),
p AS (SELECT DISTINCT id, {_HASH60} % m AS pos, m FROM e, size),
i AS (SELECT DISTINCT id FROM p),
g AS (SELECT id::VARCHAR AS sources, pos, m FROM p UNION ALL
  SELECT i.id || '+' || (i.id + 1), pos, m FROM i JOIN i j ON j.id = i.id + 1 JOIN p ON p.id IN (i.id, j.id)),
counted AS (SELECT sources, m, count(DISTINCT pos) AS ones FROM g GROUP BY sources, m),
{_BOUNDED}
SELECT sources, m, ones, round(estimate, 3) AS estimate, {_LOW} AS low, {_HIGH} AS high FROM b"""

_REPEATED = r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f\v]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
t AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS repeated FROM t, (SELECT unnest(range(0, 8)) AS o) GROUP BY doc_id),
r AS (SELECT doc_id, len(ws)::BIGINT AS words, coalesce(repeated, 0)::BIGINT AS repeated FROM w LEFT JOIN c USING (doc_id))"""


_LINES = r"""WITH l AS (SELECT doc_id, lower(trim(source)) AS host, unnest(regexp_split_to_array(coalesce(text, ''), '\r\n|\r|\n')) AS line FROM documents),
n AS (SELECT doc_id, host, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[ \t\f\v\r]+', ' ', 'g'), ' ') AS line FROM l),
e AS (SELECT doc_id, host, line, count(*) AS n FROM n WHERE line <> '' GROUP BY ALL),
c AS (SELECT host, line FROM e GROUP BY host, line HAVING count(*) > 20),
m AS (SELECT doc_id, sum(n)::BIGINT AS lines, coalesce(sum(n) FILTER (c.line IS NOT NULL), 0)::BIGINT AS removed
  FROM e LEFT JOIN c ON e.host IS NOT DISTINCT FROM c.host AND e.line = c.line GROUP BY doc_id),
r AS (SELECT doc_id, coalesce(lines, 0) AS lines, coalesce(removed, 0) AS removed FROM documents LEFT JOIN m USING (doc_id))
SELECT doc_id, lines, removed, CASE WHEN lines > 0 THEN round(1 - removed / lines, 6) ELSE 0.0 END AS share_left, lines > 0 AND round(1 - removed / lines, 6) < 0.5 AS rejected FROM r"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _HEAVY.format("field, value"),
        "p1_counts": _HEAVY.format("field, value, n, n_rows, true AS not_below"),
        "p2_found": _SEEN,
        "p2_rate": _RATE,
        "p3_counts": _TERMS + " SELECT * FROM m",
        "p3_found": _TERMS + " SELECT filter_id, seq, 'rare' AS mark FROM m WHERE rare UNION ALL SELECT filter_id, seq, 'common' FROM m WHERE common",
        "p4_found": _SPANS + " SELECT * FROM spans",
        "p4_part": _SPANS
        + f""", z AS (SELECT seq_id, max(coalesce(length({_CLEAN}), 0))::BIGINT AS size FROM contig GROUP BY seq_id),
v AS (SELECT seq_id, sum(span_end - span_start + 1)::BIGINT AS shared FROM spans GROUP BY seq_id)
SELECT seq_id, size, coalesce(shared, 0)::BIGINT AS shared, CASE WHEN size > 0 THEN round(coalesce(shared, 0) / size, 6) ELSE 0.0 END AS part FROM z LEFT JOIN v USING (seq_id)""",
        "p5_overlaps": _OVERLAPS + " SELECT * FROM o",
        "p5_found": _OVERLAPS + " SELECT id_a, id_b FROM o WHERE shared * 10 >= either",
        "p6_found": _SNAPSHOTS,
        "p6_estimates": _ESTIMATES,
        "p6_unions": _UNIONS,
        "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p8_kept": "SELECT lower(trim(source)) AS source, target_share, max_repeats, true AS cap_kept, true AS share_kept FROM mix_target",
        "p9_lines": _LINES,
        "p9_found": _REPEATED + " SELECT doc_id FROM r WHERE words > 0 AND repeated * 2 >= words",
        "p9_shares": _REPEATED + " SELECT doc_id, words, repeated, CASE WHEN words > 0 THEN round(repeated / words, 6) ELSE 0.0 END AS share FROM r",
    }
