"""What follows from draws: their median, interval and density, and the density of bootstrapped totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from costweave.operators.attach import attach
from costweave.operators.costs import total_cost
from costweave.operators.density import density_curve, kernel_density
from costweave.operators.multinomial import sql_bootstrap, sql_drawn
from costweave.operators.sampling import bootstrap_sums, median_interval, resample_truncated_many
from costweave.operators.sketches import merged_sketches, quantile_sketches, rank_error, sketched_quantiles
from costweave.params import EFFICIENCY_BANDWIDTH, RESAMPLED_DRAWS, SUCCESS_BANDS, T_975_49
from costweave.plans.entities import SQL_SCORED, SQL_TOTAL, scored
from costweave.plans.frames import table
from costweave.plans.models import _BELL, DENSITY_POINTS, REPLICATES, SEED, _sql_curve, sql_truncated, sql_uniform52
from costweave.plans.registry import query, r, sql_r
from costweave.session import cut_lineage

SQL_RESAMPLED = f"""held AS (SELECT event_id, value FROM events WHERE value IS NOT NULL),
    {sql_drawn('held', 'event_id', 'value', RESAMPLED_DRAWS, SEED)},
    bounds AS (SELECT least(0e0, min(value)) AS low, max(value) AS high FROM held),
    aimed AS (SELECT value AS mean, low, high, low - value AS za, high - value AS zb,
        {sql_uniform52(f"'{SEED}:' || leaf || ':' || draw || ':n'")} AS u FROM drawn, bounds),
    {sql_truncated('aimed', 'u', 'za', 'zb')},
    resampled AS MATERIALIZED (SELECT greatest(low, least(high, mean + 1e0 * tz)) AS x FROM truncated)"""


@query(
    "resampled_density",
    f"""WITH RECURSIVE {SQL_RESAMPLED},
    middle AS (SELECT count(*) AS n, median(x) AS median, stddev_samp(x) AS sd FROM resampled),
    curve AS (SELECT g.x, sum(exp(-((g.x - v.x) / 11.35555e0) * ((g.x - v.x) / 11.35555e0) / 2e0) / 11.35555e0) / ({_BELL}) AS density
      FROM resampled v CROSS JOIN (SELECT unnest(range(0, 101))::DOUBLE AS x) g GROUP BY g.x)
    SELECT x, {sql_r('density', 9)} AS density, n, {sql_r('sd', 6)} AS sd, {sql_r('median', 5)} AS median,
      {sql_r('median - 2.0096e0 * sd / sqrt(n)', 5)} AS lower, {sql_r('median + 2.0096e0 * sd / sqrt(n)', 5)} AS upper
    FROM curve, middle""",
)
def resampled_density(spark, sf_dir):
    """Density of a million blurred draws of the values, with the median of the draws and its interval beside it."""
    sample = table(spark, sf_dir, "events").select("event_id", "value")
    low = sample.agg(F.least(F.lit(0.0), F.min("value"))).scalar()
    high = sample.agg(F.max("value")).scalar()
    drawn = resample_truncated_many(sample, "event_id", "value", RESAMPLED_DRAWS, SEED, low, high)
    drawn = cut_lineage(drawn.select("x"))
    middle = median_interval(drawn, "x", T_975_49).select(
        F.struct("n", *[r(F.col(c), d).alias(c) for c, d in (("sd", 6), ("median", 5), ("lower", 5), ("upper", 5))])
    )
    curve = kernel_density(drawn.withColumnRenamed("x", "value"), "value", (0, 100, 1), EFFICIENCY_BANDWIDTH)
    marked = curve.withColumn("__middle", middle.scalar())
    return marked.select("x", r(F.col("density"), 9).alias("density"), "__middle.*")


ESSENTIAL = next(high for name, _, high in SUCCESS_BANDS if name == "essential")


@query(
    "bootstrap_density",
    f"""WITH RECURSIVE {SQL_SCORED},
    kept AS (SELECT entity, {SQL_TOTAL} AS total FROM costed WHERE score >= {ESSENTIAL}e0),
    {sql_bootstrap('kept', 'entity', 'total', REPLICATES, SEED)},
    shares AS (SELECT 'bootstrap' AS sample, total / (SELECT sum(total) FROM kept) AS share FROM drawn),
    {_sql_curve('shares', 'share', 'sample').lstrip()}""",
)
def bootstrap_density(spark, sf_dir):
    """Density of the bootstrapped total cost of the entities above the essential band, as a share of their real total."""
    kept = scored(spark, sf_dir).where(F.col("score") >= F.lit(ESSENTIAL)).select("entity", total_cost().alias("total"))
    kept = cut_lineage(kept)
    drawn = bootstrap_sums(kept, "entity", "total", REPLICATES, SEED)
    real = kept.agg(F.sum("total")).scalar()
    shares = cut_lineage(drawn.select(F.lit("bootstrap").alias("sample"), (F.col("total") / real).alias("share")))
    curve = density_curve(shares, "share", DENSITY_POINTS, ["sample"])
    return curve.select(
        "sample", F.col("point").cast("long").alias("point"), r(F.col("x"), 4).alias("x"), r(F.col("density"), 7).alias("density")
    )


SKETCH_LEVELS = {"stage": ["event_type", "month"], "type": ["event_type"], "all": []}


@query(
    "sketched_medians",
    """WITH held AS (SELECT event_type, month(ts)::BIGINT AS month FROM events WHERE value IS NOT NULL)
    SELECT 'stage' AS level, event_type, month, count(*) AS n, true AS within FROM held GROUP BY ALL
    UNION ALL SELECT 'type', event_type, NULL, count(*), true FROM held GROUP BY ALL
    UNION ALL SELECT 'all', NULL, NULL, count(*), true FROM held HAVING count(*) > 0""",
)
def sketched_medians(spark, sf_dir):
    """Sketches by type and month, stored, merged to types and to all; each level's median is held against the values.

    ``within`` tells whether the true rank of the sketch's median is inside three times the stated error.
    """
    events = table(spark, sf_dir, "events").select("event_type", F.month("ts").cast("long").alias("month"), "value")
    fine = cut_lineage(quantile_sketches(events, "value", ["event_type", "month"]))
    held = events.where("value IS NOT NULL AND NOT isnan(value)")
    reports = []
    for level, by in SKETCH_LEVELS.items():
        sketches = fine if level == "stage" else merged_sketches(fine, by)
        middle = sketched_quantiles(sketches, [0.5])
        against = attach(held, middle, by)
        ranks = against.groupBy(*by).agg(
            F.max("n").alias("n"),
            F.avg((F.col("value") < F.col("q0")).cast("double")).alias("below"),
            F.avg((F.col("value") <= F.col("q0")).cast("double")).alias("upto"),
        )
        slack = F.lit(3 * rank_error()) + 1 / F.col("n")
        within = (F.col("below") <= 0.5 + slack) & (F.col("upto") >= 0.5 - slack)
        names = [F.col(c) if c in by else F.lit(None).cast(t).alias(c) for c, t in (("event_type", "string"), ("month", "long"))]
        reports.append(ranks.where("n > 0").select(F.lit(level).alias("level"), *names, "n", within.alias("within")))
    return reports[0].unionByName(reports[1]).unionByName(reports[2])
