"""Queries over time courses: reshaping, first appearance, costs by time, stage and phase."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from costweave.functions.scalars import lookup
from costweave.operators.costs import cost_long, sum_costs, total_cost, with_costs
from costweave.operators.fill import fill_attributes
from costweave.operators.ordered import mean_spacing, trapezoid
from costweave.operators.quantiles import exact_medians
from costweave.operators.reshape import (
    column_steps,
    columns_between,
    columns_except,
    columns_with_prefix,
    fold_bucket,
    series_steps,
    subtract_baseline,
    sum_bins,
    tagged_union,
    to_long,
)
from costweave.operators.resolve import first_appearance, left_attach, mark_first
from costweave.operators.rollup import loose_sum, phase_totals, rollup_costs, selected_rollup, strict_mean
from costweave.params import DEFAULT, GERMINATION, LEGACY_GERMINATION
from costweave.plans.frames import (
    SQL_ATTRIBUTES,
    SQL_COURSE,
    SQL_HOUR,
    attributes,
    costed_course,
    quantity_course,
    quantity_matrix,
    sql_costed_course,
    sql_costs,
    sql_fills,
    sql_long,
    table,
    year_span,
)
from costweave.plans.registry import query, r, sql_r


@query(
    "cost_by_time_kind",
    f"""WITH {sql_costed_course()}, long AS ({sql_long('costed', 'time')})
    SELECT time, kind, {sql_r('sum(cost)', 1)} AS cost FROM long GROUP BY time, kind""",
)
def cost_by_time_kind(spark, sf_dir):
    rolled = rollup_costs(costed_course(spark, sf_dir), ["time"], ("kind",))
    return rolled.select("time", "kind", r(F.col("cost"), 1).alias("cost"))


@query(
    "cost_by_time",
    f"""WITH {sql_costed_course()}, long AS ({sql_long('costed', 'time')})
    SELECT time, {sql_r('sum(cost)', 1)} AS cost FROM long GROUP BY time""",
)
def cost_by_time(spark, sf_dir):
    rolled = rollup_costs(costed_course(spark, sf_dir), ["time"], ())
    return rolled.select("time", r(F.col("cost"), 1).alias("cost"))


@query(
    "cost_by_entity",
    f"""WITH {sql_costed_course()}
    SELECT entity, {sql_r('sum(transcription_direct)', 2)} AS transcription_direct,
      {sql_r('sum(translation_opportunity + translation_direct)', 2)} AS translation
    FROM costed GROUP BY entity""",
)
def cost_by_entity(spark, sf_dir):
    sums = sum_costs(costed_course(spark, sf_dir), ["entity"])
    return sums.select(
        "entity",
        r(F.col("transcription_direct"), 2).alias("transcription_direct"),
        r(F.col("translation_opportunity") + F.col("translation_direct"), 2).alias("translation"),
    )


SQL_STAGED = f"""{SQL_ATTRIBUTES},
course AS (
  SELECT entity, stage, time, sum(l_quantity) AS value
  FROM (SELECT l_partkey AS entity, l_returnflag AS stage, {SQL_HOUR} AS time, l_quantity FROM lineitem)
  GROUP BY ALL HAVING sum(l_quantity) > 0),
fact AS (
  SELECT course.*, row_number() OVER (PARTITION BY entity ORDER BY time, stage) = 1 AS is_first, {sql_fills()}
  FROM course LEFT JOIN attr USING (entity)),
costed AS (SELECT *, {sql_costs(once='is_first')} FROM fact)"""


def staged_course(spark, sf_dir):
    """Rows per part, stage and hour, the first one of each part flagged."""
    first, _ = year_span(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("entity"),
        F.col("l_returnflag").alias("stage"),
        (F.year("l_shipdate") - first + 1).cast("long").alias("time"),
        "l_quantity",
    )
    course = lines.groupBy("entity", "stage", "time").agg(F.sum("l_quantity").alias("value")).where("value > 0")
    marked = mark_first(course, ["entity"], ["time", "stage"])
    fact = left_attach(marked, attributes(spark, sf_dir), ["entity"])
    return with_costs(fill_attributes(fact, DEFAULT), once="is_first")


@query(
    "cost_by_stage",
    f"""WITH {SQL_STAGED}, long AS ({sql_long('costed', 'stage')})
    SELECT stage, kind, {sql_r('sum(cost)', 1)} AS cost FROM long GROUP BY stage, kind""",
)
def cost_by_stage(spark, sf_dir):
    rolled = rollup_costs(staged_course(spark, sf_dir), ["stage"], ("kind",))
    return rolled.select("stage", "kind", r(F.col("cost"), 1).alias("cost"))


#: Stage and its hours by place in the course; the last entry holds for all later ones.
DEVELOPMENT = ((1, "dormant"), (2, "germination"), (3, "germination"), (4, "outgrowth1"), (5, "outgrowth2"))
LATER_STAGE = "burst"
HOURS = ((1, 0.0), (2, 0.25), (3, 0.25), (4, 0.25), (5, 0.5), (6, 1.0))
LATER_HOURS = 3.0


@query(
    "cost_by_development",
    f"""WITH {SQL_ATTRIBUTES},{SQL_COURSE},
    labelled AS (SELECT course.*,
      CASE WHEN time <= 3 THEN 'germination' WHEN time = 4 THEN 'outgrowth1' WHEN time = 5 THEN 'outgrowth2'
        ELSE 'burst' END AS label,
      CASE WHEN time <= 4 THEN 0.25e0 WHEN time = 5 THEN 0.5e0 WHEN time = 6 THEN 1e0 ELSE 3e0 END AS hours
      FROM course WHERE time > 1),
    fact AS (SELECT labelled.*, time = min(time) OVER (PARTITION BY entity) AS is_first, {sql_fills(GERMINATION)}
      FROM labelled LEFT JOIN attr USING (entity)),
    costed AS (SELECT *, {sql_costs(GERMINATION, 'hours', 'is_first')} FROM fact),
    long AS ({sql_long('costed', 'label')})
    SELECT label, process, kind, {sql_r('sum(cost)', 1)} AS cost FROM long GROUP BY ALL""",
)
def cost_by_development(spark, sf_dir):
    """Hours labelled with their stage of development, the dormant ones left out, priced by the time a stage takes."""
    course = quantity_course(spark, sf_dir).drop("is_first")
    labelled = course.withColumns(
        {
            "label": F.coalesce(lookup(F.col("time"), DEVELOPMENT), F.lit(LATER_STAGE)),
            "hours": F.coalesce(lookup(F.col("time"), HOURS), F.lit(LATER_HOURS)),
        }
    ).where("label != 'dormant'")
    fact = left_attach(mark_first(labelled, ["entity"], ["time"]), attributes(spark, sf_dir), ["entity"])
    costed = with_costs(fill_attributes(fact, GERMINATION), GERMINATION, F.col("hours"), once="is_first")
    return rollup_costs(costed, ["label"]).select("label", "process", "kind", r(F.col("cost"), 1).alias("cost"))


@query(
    "tagged_union",
    f"""SELECT l_returnflag AS source, count(*) AS n, {sql_r('sum(l_quantity)', 2)} AS quantity
    FROM lineitem GROUP BY l_returnflag
    UNION ALL SELECT 'orders' AS source, count(*) AS n, {sql_r('coalesce(sum(o_totalprice), 0)', 2)} AS quantity FROM orders
      HAVING count(*) > 0""",
)
def stage_union(spark, sf_dir):
    """The stages of the line items, whose tag is a column already, and orders under a tag of their own, stacked."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("stage"), "l_quantity")
    orders = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("l_quantity"))
    stacked = tagged_union({"lines": lines, "orders": orders})
    tagged = stacked.withColumn("source", F.when(F.col("source") == "lines", F.col("stage")).otherwise(F.col("source")))
    return tagged.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("l_quantity"), 2).alias("quantity")
    )


@query(
    "cost_union_rollup",
    f"""WITH {sql_costed_course()}, long AS ({sql_long('costed', '')})
    SELECT process, kind, {sql_r('sum(cost)', 1)} AS cost FROM long GROUP BY process, kind""",
)
def cost_union_rollup(spark, sf_dir):
    """Per-hour costs as rows tagged with process and kind, all processes below one another, summed again.

    The three stacks come from one pass over the course; a union of three frames would read it three times.
    """
    tagged = cost_long(sum_costs(costed_course(spark, sf_dir), ["time"]), ["time"])
    return tagged.groupBy("process", "kind").agg(r(loose_sum("cost"), 1).alias("cost"))


SQL_BINS = f"""{SQL_COURSE},
ids AS (SELECT DISTINCT entity FROM course),
base AS (SELECT ids.entity, coalesce(value, 0e0) AS b FROM ids LEFT JOIN course ON course.entity = ids.entity AND time = 1),
shifted AS (
  SELECT base.entity, time // 2 AS slot, greatest(coalesce(value, 0e0) - b, 0e0) AS v
  FROM base JOIN course ON course.entity = base.entity AND time > 1),
bins AS (SELECT entity, slot, 'h' || CAST(slot AS VARCHAR) AS bin, sum(v) AS value FROM shifted
  GROUP BY entity, slot HAVING sum(v) <> 0)"""


def binned_course(spark, sf_dir):
    """Yearly values less those of the first year, clamped at zero, summed into bins of two years, zeros dropped."""
    wide = quantity_matrix(spark, sf_dir)
    later = columns_except(wide, "entity", "t1")
    clamped = subtract_baseline(wide, later, "t1")
    bins: dict[str, list[str]] = {}
    for name in later:
        bins.setdefault(f"h{int(name[1:]) // 2}", []).append(name)
    if not bins:  # a course of one year has nothing after its baseline
        return wide.select("entity", F.lit("").alias("bin"), F.lit(0).alias("slot"), F.lit(0.0).alias("value")).limit(0)
    binned = sum_bins(clamped, bins, ["entity"])
    long = to_long(binned, ["entity"], columns_with_prefix(binned, "h"), "bin").where("value != 0")
    return long.withColumn("slot", F.substring("bin", 2, 10).cast("int"))


@query("baseline_clamp_bins", f"WITH {SQL_BINS} SELECT entity, bin, {sql_r('value', 2)} AS value FROM bins")
def baseline_clamp_bins(spark, sf_dir):
    return binned_course(spark, sf_dir).select("entity", "bin", r(F.col("value"), 2).alias("value"))


@query(
    "alternative_course_cost",
    f"""WITH {SQL_ATTRIBUTES},{SQL_BINS},
    joined AS (SELECT bins.*, slot = min(slot) OVER (PARTITION BY entity) AS is_first, attr.* EXCLUDE (entity)
      FROM bins LEFT JOIN attr USING (entity)),
    fact AS (SELECT entity, bin, is_first, coalesce(abundance, 18e0) AS abundance_filled,
      coalesce(gene_length, 765e0) AS gene_length_filled,
      coalesce(seq_opportunity, (SELECT median(seq_opportunity) FROM joined WHERE is_first)) AS seq_opportunity_filled,
      coalesce(seq_direct, (SELECT median(seq_direct) FROM joined WHERE is_first)) AS seq_direct_filled FROM joined),
    costed AS (SELECT *, {sql_costs(once='is_first')} FROM fact),
    long AS ({sql_long('costed', 'bin')})
    SELECT bin, kind, {sql_r('sum(cost)', 1)} AS cost FROM long GROUP BY bin, kind""",
)
def alternative_course_cost(spark, sf_dir):
    """The binned course costed, gaps in sequence cost filled with the median over first appearances."""
    joined = left_attach(mark_first(binned_course(spark, sf_dir), ["entity"], ["slot"]), attributes(spark, sf_dir), ["entity"])
    once = joined.where("is_first")
    sequence = ["seq_opportunity", "seq_direct"]
    medians = exact_medians(once, sequence).select(F.struct(*sequence)).scalar()
    filled = joined.withColumns(
        {
            "abundance_filled": F.coalesce("abundance", F.lit(DEFAULT.fill_abundance)),
            "gene_length_filled": F.coalesce("gene_length", F.lit(DEFAULT.fill_gene_length)),
            **{c + "_filled": F.coalesce(F.col(c), medians[c]) for c in sequence},
        }
    )
    rolled = rollup_costs(with_costs(filled, once="is_first"), ["bin"], ("kind",))
    return rolled.select("bin", "kind", r(F.col("cost"), 1).alias("cost"))


def daily_scores(spark, sf_dir):
    """Score of each user per day: one row per (user, day), whatever the number of events."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("entity"), F.to_date("ts").alias("day"), "value"
    )
    cents = F.sum(F.round(F.col("value") * 100).cast("decimal(20,0)"))  # whole numbers: a step of zero is zero
    return events.groupBy("entity", "day").agg(cents.alias("score"))


SQL_STEPS = """
daily AS (SELECT user_id AS entity, CAST(ts AS DATE) AS day, sum(CAST(round(value * 100) AS HUGEINT)) AS score
  FROM events GROUP BY ALL),
steps AS (SELECT entity, day, score - lag(score) OVER (PARTITION BY entity ORDER BY day) AS step FROM daily)"""


@query(
    "interval_deltas",
    f"WITH {SQL_STEPS} SELECT entity, day, {sql_r('CAST(step AS DOUBLE) / 100', 4)} AS step FROM steps WHERE step > 0",
)
def interval_deltas(spark, sf_dir):
    steps = series_steps(daily_scores(spark, sf_dir), ["entity"], "day", "score")
    risen = steps.where("step > 0")
    return risen.select("entity", "day", r(F.col("step").cast("double") / 100, 4).alias("step"))


#: Hours that the first intervals stand for; later intervals are as long as the last one.
INTERVALS = (("H0_H6", 0.25), ("H6_H12", 0.5), ("H12_H18", 1.0))
LATER_INTERVAL = 1.5
SAMPLING_DAYS = 6


def sampling(events):
    """Number of the sampling an event falls in: six days each, from the first day of the table."""
    first = events.agg(F.min(F.to_date("ts"))).scalar()
    return F.floor(F.datediff(F.to_date("ts"), first) / SAMPLING_DAYS)


def increment_costs(spark, sf_dir):
    """Scores per sampling, rises over the one before taken as abundance and costed.

    Scores are summed in whole hundredths, so a rise is told from none exactly. A sampling without events has score 0;
    only samplings with events can hold a rise, so the absent ones need no rows.
    """
    events = table(spark, sf_dir, "events").select("user_id", "ts", "value")
    slots = events.select(
        F.col("user_id").alias("entity"), sampling(events).alias("slot"), F.round(F.col("value") * 100).alias("cents")
    )
    scores = slots.groupBy("entity", "slot").agg(F.sum(F.col("cents").cast("decimal(20,0)")).alias("cents"))
    w = Window.partitionBy("entity").orderBy("slot")
    before = F.when(F.lag("slot").over(w) == F.col("slot") - 1, F.lag("cents").over(w))
    rises = scores.withColumn("rise", F.col("cents") - F.coalesce(before, F.lit(0))).where("rise > 0 AND slot > 0")
    label = F.concat(
        F.lit("H"), (F.col("slot") - 1) * SAMPLING_DAYS, F.lit("_H"), F.col("slot") * SAMPLING_DAYS
    )
    long = rises.select(
        "entity", label.alias("interval"), (F.col("rise").cast("double") / 100).alias("abundance")
    )
    fact = left_attach(long, attributes(spark, sf_dir).drop("abundance"), ["entity"])
    hours = F.coalesce(lookup(F.col("interval"), INTERVALS), F.lit(LATER_INTERVAL))
    return rollup_costs(with_costs(fill_attributes(fact, GERMINATION), GERMINATION, hours), ["interval"], ("kind",))


SQL_INCREMENTS = f"""{SQL_ATTRIBUTES},
slots AS (SELECT user_id AS entity, (CAST(ts AS DATE) - (SELECT min(CAST(ts AS DATE)) FROM events)) // {SAMPLING_DAYS} AS slot,
    CAST(sum(CAST(round(value * 100) AS HUGEINT)) AS HUGEINT) AS score FROM events GROUP BY ALL),
ids AS (SELECT DISTINCT user_id AS entity FROM events),
filled AS (SELECT ids.entity, g.slot, coalesce(slots.score, 0) AS score
  FROM ids CROSS JOIN (SELECT unnest(range(0, (SELECT max(slot) + 1 FROM slots))) AS slot) g
  LEFT JOIN slots ON slots.entity = ids.entity AND slots.slot = g.slot),
steps AS (SELECT entity, slot, score - lag(score) OVER (PARTITION BY entity ORDER BY slot) AS score FROM filled),
kept AS (SELECT entity, CAST(score AS DOUBLE) / 100 AS abundance,
    'H' || CAST((slot - 1) * 6 AS VARCHAR) || '_H' || CAST(slot * 6 AS VARCHAR) AS "interval",
    CASE slot WHEN 1 THEN 0.25e0 WHEN 2 THEN 0.5e0 WHEN 3 THEN 1e0 ELSE 1.5e0 END AS hours
  FROM steps WHERE score > 0),
fact AS (SELECT kept.entity, "interval", hours, {sql_fills(GERMINATION).replace('abundance,', 'kept.abundance,')}
  FROM kept LEFT JOIN attr USING (entity)),
costed AS (SELECT *, {sql_costs(GERMINATION, 'hours')} FROM fact),
long AS ({sql_long('costed', '"interval"')}),
costs AS (SELECT "interval", kind, sum(cost) AS cost FROM long GROUP BY ALL)"""


@query(
    "increment_cost",
    f'WITH {SQL_INCREMENTS} SELECT "interval", kind, {sql_r("cost", 1)} AS cost FROM costs',
)
def increment_cost(spark, sf_dir):
    return increment_costs(spark, sf_dir).select("interval", "kind", r(F.col("cost"), 1).alias("cost"))


@query(
    "phase_totals",
    f"""WITH {SQL_INCREMENTS}
    SELECT CASE WHEN "interval" IN ('H0_H6', 'H6_H12') THEN 'germination' ELSE 'outgrowth' END AS phase,
      {sql_r('sum(cost)', 1)} AS cost FROM costs GROUP BY 1""",
)
def phases(spark, sf_dir):
    """First interval folded into the second, then germination against outgrowth."""
    folded = fold_bucket(increment_costs(spark, sf_dir), "interval", "H0_H6", "H6_H12", ["kind"], "cost")
    named = folded.withColumn("interval", F.when(F.col("interval") == "H6_H12", "early").otherwise("late"))
    totals = phase_totals(named, "interval", {"germination": ["early"], "outgrowth": ["late"]})
    return totals.select("phase", r(F.col("cost"), 1).alias("cost"))


@query(
    "merge_first_bucket",
    f"""WITH {sql_costed_course()}, long AS ({sql_long('costed', 'time')})
    SELECT CASE WHEN time = 1 THEN 2 ELSE time END AS time, kind, {sql_r('sum(cost)', 1)} AS cost
    FROM long GROUP BY 1, 2""",
)
def merge_first_bucket(spark, sf_dir):
    rolled = rollup_costs(costed_course(spark, sf_dir), ["time"], ("kind",))
    folded = fold_bucket(rolled, "time", 1, 2, ["kind"], "cost")
    return folded.select(F.col("time").cast("long").alias("time"), "kind", r(F.col("cost"), 1).alias("cost"))


@query(
    "first_appearance",
    """SELECT entity, year, stage FROM (
      SELECT l_partkey AS entity, CAST(year(l_shipdate) AS BIGINT) AS year, l_returnflag AS stage,
        row_number() OVER (PARTITION BY l_partkey ORDER BY year(l_shipdate), l_returnflag) AS k
      FROM lineitem WHERE l_quantity > 0) WHERE k = 1""",
)
def first_seen(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 0")
    seen = lines.select(
        F.col("l_partkey").alias("entity"),
        F.year("l_shipdate").cast("long").alias("year"),
        F.col("l_returnflag").alias("stage"),
    )
    return first_appearance(seen, ["entity"], ["year", "stage"])


#: Hours and bucket of an interval by the hour that ends it; the last entry holds for all later ones.
CALLS = ((2, 0.25, "H0.25"), (3, 0.25, "H0.5"), (4, 0.5, "H1"), (5, 1.0, "H2"), (6, 1.5, "H3.5"))
LATER_CALL = (2.0, "H5.5")


def up_calls(spark, sf_dir):
    """Sign of the yearly change of each part, as calls -1 / 0 / 1; only the rises are kept."""
    wide = quantity_matrix(spark, sf_dir).na.fill(0.0)
    names = columns_between(wide, "t1", wide.columns[-1])
    pairs = [(f"{a}_{b}", b, a) for a, b in zip(names, names[1:])] or [("t1_t2", "t1", "t1")]
    steps = column_steps(wide, pairs, ["entity"])
    signs = steps.select("entity", *[F.signum(c).cast("int").alias(c) for c in columns_with_prefix(steps, "t")])
    long = to_long(signs, ["entity"], columns_with_prefix(signs, "t"), "interval", "call")
    return long.where("call != 0").where("call != -1")


SQL_CALLS = f"""{SQL_COURSE},
ids AS (SELECT DISTINCT l_partkey AS entity FROM lineitem),
filled AS (SELECT ids.entity, g.time, coalesce(course.value, 0e0) AS value
  FROM ids CROSS JOIN (SELECT unnest(range(1, (SELECT max(time) + 1 FROM course))) AS time) g
  LEFT JOIN course ON course.entity = ids.entity AND course.time = g.time),
changes AS (SELECT entity, time, value - lag(value) OVER (PARTITION BY entity ORDER BY time) AS change FROM filled),
calls AS (SELECT entity, 't' || CAST(time - 1 AS VARCHAR) || '_t' || CAST(time AS VARCHAR) AS "interval", time,
    CASE time WHEN 2 THEN 0.25e0 WHEN 3 THEN 0.25e0 WHEN 4 THEN 0.5e0 WHEN 5 THEN 1e0 WHEN 6 THEN 1.5e0 ELSE 2e0 END AS hours,
    CASE time WHEN 2 THEN 'H0.25' WHEN 3 THEN 'H0.5' WHEN 4 THEN 'H1' WHEN 5 THEN 'H2' WHEN 6 THEN 'H3.5' ELSE 'H5.5' END AS bucket
  FROM changes WHERE change > 0)"""


@query("upregulated_long", f'WITH {SQL_CALLS} SELECT entity, "interval", hours, bucket FROM calls')
def upregulated_long(spark, sf_dir):
    return timed_calls(spark, sf_dir).drop("ends")


def timed_calls(spark, sf_dir):
    ends = F.substring_index("interval", "_t", -1).cast("int")
    calls = up_calls(spark, sf_dir).withColumn("ends", ends)
    return calls.select(
        "entity",
        "interval",
        F.coalesce(lookup(F.col("ends"), [(n, h) for n, h, _ in CALLS]), F.lit(LATER_CALL[0])).alias("hours"),
        F.coalesce(lookup(F.col("ends"), [(n, b) for n, _, b in CALLS]), F.lit(LATER_CALL[1])).alias("bucket"),
        "ends",
    )


@query(
    "upregulated_cost",
    f"""WITH {SQL_ATTRIBUTES},{SQL_CALLS},
    fact AS (SELECT calls.*, time = min(time) OVER (PARTITION BY entity) AS is_first, {sql_fills(GERMINATION)}
      FROM calls LEFT JOIN attr USING (entity)),
    costed AS (SELECT *, {sql_costs(GERMINATION, 'hours', 'is_first')} FROM fact),
    long AS ({sql_long('costed', 'bucket')})
    SELECT bucket, kind, {sql_r('sum(cost)', 1)} AS cost FROM long GROUP BY bucket, kind""",
)
def upregulated_cost(spark, sf_dir):
    """Rises costed by interval: transcripts for as long as the interval lasts, the rest at the first rise."""
    calls = timed_calls(spark, sf_dir)
    fact = left_attach(mark_first(calls, ["entity"], ["ends"]), attributes(spark, sf_dir), ["entity"])
    costed = with_costs(fill_attributes(fact, GERMINATION), GERMINATION, F.col("hours"), once="is_first")
    return rollup_costs(costed, ["bucket"], ("kind",)).select("bucket", "kind", r(F.col("cost"), 1).alias("cost"))


@query(
    "presence_course_cost",
    f"""WITH {SQL_ATTRIBUTES},
    seen AS (SELECT DISTINCT user_id AS entity,
      (CAST(ts AS DATE) - (SELECT min(CAST(ts AS DATE)) FROM events)) // {SAMPLING_DAYS} AS slot FROM events),
    fact AS (SELECT seen.*, slot = min(slot) OVER (PARTITION BY entity) AS is_first, {sql_fills(LEGACY_GERMINATION)}
      FROM seen LEFT JOIN attr USING (entity)),
    costed AS (SELECT *, {sql_costs(GERMINATION, '0.5e0', 'is_first')} FROM fact),
    long AS ({sql_long('costed', 'slot')})
    SELECT CAST(slot * 30 + 30 AS BIGINT) AS minutes, process, kind, {sql_r('sum(cost)', 1)} AS cost FROM long GROUP BY ALL""",
)
def presence_course_cost(spark, sf_dir):
    """Presence of users per sampling, costed by sampling; half an hour of transcripts each. Absence has no row."""
    events = table(spark, sf_dir, "events").select("user_id", "ts")
    seen = events.select(F.col("user_id").alias("entity"), sampling(events).alias("slot")).distinct()
    timed = seen.select("entity", (F.col("slot") * 30 + 30).cast("long").alias("minutes"))
    fact = left_attach(mark_first(timed, ["entity"], ["minutes"]), attributes(spark, sf_dir), ["entity"])
    costed = with_costs(fill_attributes(fact, GERMINATION), GERMINATION, 0.5, once="is_first")
    return rollup_costs(costed, ["minutes"]).select("minutes", "process", "kind", r(F.col("cost"), 1).alias("cost"))


@query(
    "mean_positive_long",
    f"""WITH means AS (
      SELECT time, stage, l_linestatus, l_suppkey, l_partkey, avg(l_quantity - 20e0) AS m
        FROM (SELECT {SQL_HOUR} AS time, l_returnflag AS stage, l_linestatus, l_suppkey, l_partkey, l_quantity FROM lineitem)
        GROUP BY ALL HAVING avg(l_quantity - 20e0) > 0)
    SELECT time, stage, count(*) AS n, {sql_r('sum(m)', 3)} AS total FROM means GROUP BY time, stage""",
)
def mean_positive_long(spark, sf_dir):
    """Mean by five keys, positive means kept, then counted by hour and stage."""
    first, _ = year_span(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select(
        (F.year("l_shipdate") - first + 1).cast("long").alias("time"),
        F.col("l_returnflag").alias("stage"),
        "l_linestatus",
        "l_suppkey",
        "l_partkey",
        (F.col("l_quantity") - 20.0).alias("shifted"),
    )
    means = lines.groupBy("time", "stage", "l_linestatus", "l_suppkey", "l_partkey").agg(
        strict_mean("shifted").alias("m")
    )
    return (
        means.where("m > 0").groupBy("time", "stage").agg(F.count(F.lit(1)).alias("n"), r(F.sum("m"), 3).alias("total"))
    )


BRANDS = ("Brand#3", "Brand#7", "Brand#12", "Brand#18", "Brand#25")


@query(
    "regulon_rollup",
    f"""WITH {sql_costed_course()}
    SELECT p_brand, {sql_r('sum(replication_opportunity + replication_direct + transcription_opportunity'
    ' + transcription_direct + translation_opportunity + translation_direct)', 1)} AS cost
    FROM costed WHERE p_brand IN {BRANDS} GROUP BY p_brand ORDER BY cost DESC""",
)
def regulon_rollup(spark, sf_dir):
    rolled = selected_rollup(costed_course(spark, sf_dir), "time", "p_brand", BRANDS, total_cost())
    return rolled.select("p_brand", r(F.col("cost"), 1).alias("cost")).orderBy(F.desc("cost"))


@query(
    "prefix_integral",
    f"""WITH {SQL_COURSE},
    steps AS (SELECT entity, time, (time - lag(time) OVER w) * (value + lag(value) OVER w) / 2e0 AS a
      FROM course WINDOW w AS (PARTITION BY entity ORDER BY time))
    SELECT entity, {sql_r('coalesce(sum(a), 0)', 4)} AS area,
      {sql_r('coalesce(sum(CASE WHEN time <= 3 THEN a END), 0)', 4)} AS area_to_3 FROM steps GROUP BY entity""",
)
def prefix_integral(spark, sf_dir):
    """Area under each part's course, whole and up to the third hour."""
    course = quantity_course(spark, sf_dir).select("entity", F.col("time").cast("double").alias("time"), "value")
    areas = trapezoid(course, ["entity"], "time", "value", {"area_to_3": 3.0})
    return areas.select("entity", r(F.col("area"), 4).alias("area"), r(F.col("area_to_3"), 4).alias("area_to_3"))


@query(
    "mean_spacing",
    f"""WITH {SQL_COURSE},
    gaps AS (SELECT entity, time - lag(time) OVER (PARTITION BY entity ORDER BY time) AS g FROM course)
    SELECT entity, {sql_r('avg(g)', 6)} AS spacing FROM gaps GROUP BY entity""",
)
def spacing(spark, sf_dir):
    spaced = mean_spacing(quantity_course(spark, sf_dir), ["entity"], "time")
    return spaced.select("entity", r(F.col("spacing"), 6).alias("spacing"))
