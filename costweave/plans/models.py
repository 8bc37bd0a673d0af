"""Queries over fitted, resampled and pairwise results."""

from __future__ import annotations

from pyspark.sql import functions as F

from costweave.functions.scalars import (
    clamp_negative,
    half_up,
    letter_count,
    ordinal,
    pattern_count,
    percent_label,
    positive_log10,
    scientific_label,
    strip_letters,
)
from costweave.operators.costs import total_cost
from costweave.functions.draws import truncated_steps
from costweave.operators.curve import asymptotic_fit, asymptotic_predict
from costweave.operators.density import box_summary, density_curve, histogram, kernel_density, rule_bandwidth
from costweave.operators.multinomial import sql_bootstrap
from costweave.operators.ordination import principal_axes
from costweave.operators.regress import linear_fit
from costweave.operators.resolve import left_attach
from costweave.operators.rollup import presence_share, selection_long
from costweave.operators.sampling import (
    bootstrap_sums,
    bootstrap_sums_poisson,
    median_interval,
    poisson_weight_bounds,
    resample_truncated,
    subsample_curve,
)
from costweave.operators.similarity import jaccard_distances, restrict_columns
from costweave.params import DEFAULT, EFFICIENCY_BANDWIDTH, T_975_49
from costweave.plans.entities import SQL_NATIONS, SQL_PRESENCE, SQL_TOTAL, presence_counts
from costweave.plans.frames import costed_parts, sql_costed_parts, sql_long, table
from costweave.plans.registry import query, r, sql_r

# curves --------------------------------------------------------------------------------------------------------------

FIT_ROUNDS = 3


def _sql_fit() -> str:
    """The grid fit in SQL: every round fits all candidate rates and keeps the best per group."""

    def best(source: str, name: str) -> str:
        return f"""
{name}_sums AS (SELECT event_type, lrc, any_value(m) AS m, count(*)::DOUBLE AS n, avg(e) AS me, avg(c) AS c, avg(y - m) AS my
  FROM (SELECT *, exp(-exp(lrc) * mx) AS c, exp(-exp(lrc) * x) - exp(-exp(lrc) * mx) AS e FROM {source}) GROUP BY event_type, lrc),
{name}_fit AS (SELECT s.event_type, s.lrc, any_value(s.m) AS m, any_value(n) AS n, any_value(me) AS me, any_value(c) AS c,
    sum((exp(-exp(g.lrc) * x) - c - me) * (exp(-exp(g.lrc) * x) - c - me)) AS dee,
    sum((exp(-exp(g.lrc) * x) - c - me) * (y - g.m)) AS dey, sum((y - g.m) * (y - g.m)) AS tss,
    sum(log10(y) * log10(y)) - 2 * any_value(s.m) * sum(log10(y)) + any_value(n) * any_value(s.m) * any_value(s.m) AS mixed
  FROM {source} g JOIN {name}_sums s ON g.event_type = s.event_type AND g.lrc = s.lrc GROUP BY s.event_type, s.lrc),
{name} AS (SELECT event_type, lrc, n, m - dey / dee * (me + c) AS asym, dey / dee AS b, tss, mixed
  FROM {name}_fit WHERE dee > 0
  QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY round((tss - dey / dee * dey) / tss * 1e13), lrc) = 1)"""

    text = f"""points AS (SELECT event_type, (CAST(ts AS DATE) - (SELECT min(CAST(ts AS DATE)) FROM events) + 1) / 4e0 AS x,
  sum(value) AS y FROM events GROUP BY ALL),
shapes AS (SELECT event_type, avg(y) AS m, avg(x) AS mx, floor(ln(1e-4 / (max(x) - min(x))) * 10) AS low,
    ceil(ln(1e1 * (count(DISTINCT x) - 1) / (max(x) - min(x))) * 10) AS high
  FROM points GROUP BY event_type HAVING max(x) > min(x)),
series AS (SELECT * FROM points JOIN shapes USING (event_type)),
grid1 AS (SELECT series.*, k::DOUBLE / 10 AS lrc FROM series
  JOIN (SELECT event_type, unnest(range(low::BIGINT, high::BIGINT + 1)) AS k FROM shapes) USING (event_type)),
{best('grid1', 'f1')}"""
    step = 10
    for i in range(2, FIT_ROUNDS + 1):
        step *= 20
        text += f""",
grid{i} AS (SELECT s.*, f.lrc + k / {step}e0 AS lrc
  FROM series s JOIN f{i - 1} f ON f.event_type = s.event_type CROSS JOIN (SELECT unnest(range(-20, 21))::DOUBLE AS k)),
{best(f'grid{i}', f'f{i}')}"""
    return text + f""",
curve AS (SELECT f.event_type, f.n, CASE WHEN f.lrc > low / 10 + 0.05e0 AND f.lrc < high / 10 - 0.05e0 THEN f.lrc END AS lrc,
    f.asym, f.b, f.tss, f.mixed, r.rss
  FROM f{FIT_ROUNDS} f JOIN shapes USING (event_type) JOIN (
    SELECT s.event_type, sum(pow(y - (asym + b * exp(-exp(lrc) * x)), 2)) AS rss
    FROM series s JOIN f{FIT_ROUNDS} USING (event_type) GROUP BY s.event_type) r USING (event_type))"""


def daily_fit(spark, sf_dir):
    """Asymptotic curve of the daily value of each event type."""
    events = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), "value")
    day = F.datediff("day", events.agg(F.min("day")).scalar()) + 1
    series = (
        events.groupBy("event_type", (day / F.lit(4.0)).alias("x"))
        .agg(F.sum("value").alias("y"))
    )
    return asymptotic_fit(series, ["event_type"], "x", "y", rounds=FIT_ROUNDS)


@query(
    "asymptotic_fit",
    f"""WITH {_sql_fit()}
    SELECT event_type, n::BIGINT AS n, {', '.join(f"CASE WHEN lrc IS NOT NULL THEN {sql_r(c, d)} END AS {name}" for name, c, d in (
        ('lrc', 'lrc', 5), ('asym', 'asym', 3), ('r0', 'asym + b', 3), ('rss', 'rss', 1), ('r2', '1 - rss / tss', 6),
        ('r2_mixed', '1 - rss / mixed', 6)))}
    FROM curve""",
)
def fit_query(spark, sf_dir):
    fit = daily_fit(spark, sf_dir)
    digits = {"lrc": 5, "asym": 3, "r0": 3, "rss": 1, "r2": 6, "r2_mixed": 6}
    return fit.select("event_type", "n", *[r(F.col(c), d).alias(c) for c, d in digits.items()])


@query(
    "asymptotic_predict",
    f"""WITH {_sql_fit()}
    SELECT event_type, k / 10e0 AS x, {sql_r('asym + b * exp(-exp(lrc) * (k / 10e0))', 3)} AS predicted
    FROM curve CROSS JOIN (SELECT unnest(range(10, 71)) AS k)""",
)
def predict_query(spark, sf_dir):
    predicted = asymptotic_predict(daily_fit(spark, sf_dir), ["event_type"], 1, 7, 10)
    return predicted.select("event_type", "x", r(F.col("predicted"), 3).alias("predicted"))


@query(
    "linear_fit_by_group",
    f"""WITH pts AS (SELECT p_type, log10(p_size) AS x, log10(p_retailprice) AS y FROM part WHERE p_size > 0)
    SELECT p_type, regr_count(y, x)::BIGINT AS n, {sql_r('regr_slope(y, x)', 7)} AS slope,
      {sql_r('regr_intercept(y, x)', 7)} AS intercept, {sql_r('regr_r2(y, x)', 7)} AS r2,
      printf('y = %.2f + %.2f x', regr_intercept(y, x), regr_slope(y, x)) AS equation FROM pts GROUP BY p_type""",
)
def linear_fit_by_group(spark, sf_dir):
    points = table(spark, sf_dir, "part").select(
        "p_type", positive_log10(F.col("p_size")).alias("x"), positive_log10(F.col("p_retailprice")).alias("y")
    )
    fit = linear_fit(points, ["p_type"], "x", "y")
    return fit.select(
        "p_type", "n", *[r(F.col(c), 7).alias(c) for c in ("slope", "intercept", "r2")], "equation"
    )


@query(
    "selection_fit",
    f"""WITH {sql_costed_parts()}, long AS ({sql_long('costed', 'entity, gene_length_filled')}),
    pts AS (SELECT process, kind, log10(gene_length_filled) AS x, log10(cost / 2.6e10 * 0.69e0) AS y FROM long)
    SELECT process, kind, regr_count(y, x)::BIGINT AS n, {sql_r('regr_slope(y, x)', 6)} AS slope,
      {sql_r('regr_intercept(y, x)', 6)} AS intercept, {sql_r('regr_r2(y, x)', 6)} AS r2 FROM pts GROUP BY process, kind""",
)
def selection_fit(spark, sf_dir):
    """Selection coefficient against length, a line per process and kind."""
    long = selection_long(
        costed_parts(spark, sf_dir), ["entity", "gene_length_filled"], DEFAULT.cell_budget, DEFAULT.selection_factor
    )
    points = long.select("process", "kind", F.log10("gene_length_filled").alias("x"), (-F.col("ne")).alias("y"))
    fit = linear_fit(points, ["process", "kind"], "x", "y")
    return fit.select("process", "kind", "n", *[r(F.col(c), 6).alias(c) for c in ("slope", "intercept", "r2")])


@query(
    "presence_cost_fit",
    f"""WITH {sql_costed_parts()},{SQL_PRESENCE},
    pts AS (SELECT log10({SQL_TOTAL}) AS x, CAST(present AS DOUBLE) / {SQL_NATIONS} * 100e0 AS y FROM held JOIN costed USING (entity))
    SELECT regr_count(y, x)::BIGINT AS n, {sql_r('regr_slope(y, x)', 6)} AS slope,
      {sql_r('regr_intercept(y, x)', 5)} AS intercept, {sql_r('regr_r2(y, x)', 7)} AS r2 FROM pts""",
)
def presence_cost_fit(spark, sf_dir):
    """How often a part is present, against its total cost."""
    share = presence_share(F.col("present"), F.col("places"))
    present = presence_counts(spark, sf_dir).select("entity", share.alias("y"))
    costs = costed_parts(spark, sf_dir).select("entity", F.log10(total_cost()).alias("x"))
    fit = linear_fit(present.join(costs, "entity"), [], "x", "y")
    return fit.select(
        "n",
        r(F.col("slope"), 6).alias("slope"),
        r(F.col("intercept"), 5).alias("intercept"),
        r(F.col("r2"), 7).alias("r2"),
    )


# resampling ----------------------------------------------------------------------------------------------------------

SEED = 7


def _sql_word(address: str, digits: int) -> str:
    return f"('0x' || substr(md5({address}), 1, {digits}))::BIGINT"


def sql_uniform52(address: str) -> str:
    return f"(({_sql_word(address, 13)} + 0.5e0) / {float(2**52)!r})"


def sql_truncated(source: str, u: str, za: str, zb: str) -> str:
    """Table expressions t0 .. that add the steps of a truncated draw to a source; the last one is ``truncated``."""
    steps = truncated_steps(u, za, zb)
    names = [source, *[f"step{k}" for k in range(1, len(steps))], "truncated"]
    return ",\n    ".join(
        f"{after} AS (SELECT *, {', '.join(f'{text} AS {name}' for name, text in step.items())} FROM {before})"
        for before, after, step in zip(names, names[1:], steps)
    )


@query(
    "truncnorm_resample",
    f"""WITH indexed AS (SELECT value, row_number() OVER (ORDER BY md5('{SEED}:' || event_id), event_id) - 1 AS i
      FROM events WHERE value IS NOT NULL),
    picks AS (SELECT event_id, {_sql_word(f"'{SEED}:' || event_id", 15)} % (SELECT count(*) FROM indexed) AS i FROM events),
    bounds AS (SELECT least(0e0, min(value)) AS low, max(value) AS high FROM events),
    drawn AS (SELECT event_id, value AS mean, low, high, low - value AS za, high - value AS zb,
        {sql_uniform52(f"'{SEED}:' || event_id || ':n'")} AS u FROM picks JOIN indexed USING (i), bounds),
    {sql_truncated('drawn', 'u', 'za', 'zb')}
    SELECT event_id, {sql_r("greatest(low, least(high, mean + 1e0 * tz))", 5)} AS x FROM truncated""",
)
def truncnorm_resample(spark, sf_dir):
    """As many draws as there are events, around their values, inside the range that values have."""
    events = table(spark, sf_dir, "events").select("event_id", "value")
    sample = events.where("value IS NOT NULL")
    low = sample.agg(F.least(F.lit(0.0), F.min("value"))).scalar()
    high = sample.agg(F.max("value")).scalar()
    drawn = resample_truncated(sample, "event_id", "value", events, "event_id", SEED, low, high)
    return drawn.select("event_id", r(F.col("x"), 5).alias("x"))


SQL_PART_TOTALS = f"{sql_costed_parts()}, totals AS (SELECT entity, {SQL_TOTAL} AS total FROM costed)"
REPLICATES = 1000


@query(
    "bootstrap_sum",
    f"""WITH RECURSIVE {SQL_PART_TOTALS}, {sql_bootstrap('totals', 'entity', 'total', REPLICATES, SEED)}
    SELECT replicate, {sql_r('total', 1)} AS total FROM drawn""",
)
def bootstrap_sum(spark, sf_dir):
    totals = costed_parts(spark, sf_dir).select("entity", total_cost().alias("total"))
    drawn = bootstrap_sums(totals, "entity", "total", REPLICATES, SEED)
    if table(spark, sf_dir, "part").isEmpty():
        drawn = drawn.limit(0)  # the SQL draws nothing from nothing
    return drawn.select(F.col("replicate").cast("long").alias("replicate"), r(F.col("total"), 1).alias("total"))


_POISSON_SQL = (
    "CASE " + " ".join(f"WHEN u < {bound!r}e0 THEN {k}" for bound, k in poisson_weight_bounds()) + " END"
)


@query(
    "bootstrap_sum_poisson",
    f"""WITH {SQL_PART_TOTALS},
    u AS (SELECT replicate, total, {sql_uniform52(f"'{SEED}:' || replicate || ':' || entity")} AS u
      FROM totals CROSS JOIN (SELECT unnest(range(1, {REPLICATES + 1})) AS replicate))
    SELECT replicate, {sql_r(f'sum(total * ({_POISSON_SQL}))', 1)} AS total, sum({_POISSON_SQL})::BIGINT AS draws
    FROM u GROUP BY replicate""",
)
def bootstrap_sum_poisson(spark, sf_dir):
    totals = costed_parts(spark, sf_dir).select("entity", total_cost().alias("total"))
    drawn = bootstrap_sums_poisson(totals, "entity", "total", REPLICATES, SEED)
    return drawn.select(F.col("replicate").cast("long").alias("replicate"), r(F.col("total"), 1).alias("total"), "draws")


@query(
    "subsample_curve",
    f"""WITH {SQL_PART_TOTALS},
    run AS (SELECT row_number() OVER w AS size, sum(total) OVER w AS total FROM totals
      WINDOW w AS (ORDER BY md5('{SEED}:' || entity), entity))
    SELECT size, {sql_r('total', 1)} AS total, {sql_r('total / size', 2)} AS mean FROM run""",
)
def nested_subsamples(spark, sf_dir):
    totals = costed_parts(spark, sf_dir).select("entity", total_cost().alias("total"))
    curve = subsample_curve(totals, "entity", "total", SEED)
    return curve.select("size", r(F.col("total"), 1).alias("total"), r(F.col("mean"), 2).alias("mean"))


@query(
    "median_ci",
    f"""SELECT event_type, count(value) AS n, {sql_r('stddev_samp(value)', 6)} AS sd, {sql_r('median(value)', 4)} AS median,
      {sql_r('median(value) - 2.0096e0 * stddev_samp(value) / sqrt(count(value))', 6)} AS lower,
      {sql_r('median(value) + 2.0096e0 * stddev_samp(value) / sqrt(count(value))', 6)} AS upper
    FROM events GROUP BY event_type""",
)
def median_ci(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "value")
    spread = median_interval(events, "value", T_975_49, ["event_type"])
    digits = {"sd": 6, "median": 4, "lower": 6, "upper": 6}
    return spread.select("event_type", "n", *[r(F.col(c), d).alias(c) for c, d in digits.items()])


# densities -----------------------------------------------------------------------------------------------------------

_BELL = "count(*) * sqrt(2 * pi())"


def _sql_width(value: str) -> str:
    """Bandwidth by the rule, as an aggregate."""
    iqr = f"(quantile_cont({value}, 0.75) - quantile_cont({value}, 0.25)) / 1.34e0"
    sd = f"stddev_samp({value})"
    return f"""0.9e0 * CASE WHEN {sd} IS NULL THEN NULL WHEN least({sd}, {iqr}) > 0 THEN least({sd}, {iqr}) WHEN {sd} > 0 THEN {sd}
      WHEN max(abs({value})) > 0 THEN max(abs({value})) ELSE 1e0 END * pow(count({value}), -0.2e0)"""


@query(
    "kde_grid",
    f"""WITH grid AS (SELECT unnest(range(0, 101))::DOUBLE AS x)
    SELECT event_type, x, {sql_r(f'sum(exp(-((x - value) / 11.35555e0) * ((x - value) / 11.35555e0) / 2e0) / 11.35555e0) / ({_BELL})', 9)}
      AS density FROM events CROSS JOIN grid WHERE value IS NOT NULL GROUP BY event_type, x""",
)
def kde_grid(spark, sf_dir):
    sample = table(spark, sf_dir, "events").select("event_type", "value")
    density = kernel_density(sample, "value", (0, 100, 1), EFFICIENCY_BANDWIDTH, ["event_type"])
    return density.select("event_type", "x", r(F.col("density"), 9).alias("density"))


DENSITY_POINTS = 512


def _sql_curve(source: str, value: str, by: str) -> str:
    return f"""
    width AS (SELECT {by}, {_sql_width(value)} AS h, min({value}) AS low, max({value}) AS high
      FROM {source} WHERE {value} IS NOT NULL GROUP BY {by}),
    ends AS (SELECT {by}, h, low - 3e0 * h AS low, high + 3e0 * h AS high FROM width WHERE h IS NOT NULL),
    grid AS (SELECT unnest(range(0, {DENSITY_POINTS})) AS point),
    counted AS (SELECT {by}, {value} AS v, count(*) AS n FROM {source} WHERE {value} IS NOT NULL GROUP BY {by}, {value}),
    placed AS (SELECT {by}, v, n, h, point, low + point * ((high - low) / {DENSITY_POINTS - 1}e0) AS x
      FROM counted JOIN ends USING ({by}) CROSS JOIN grid)
    SELECT {by}, point, {sql_r('max(x)', 4)} AS x,
      {sql_r('sum(n * exp(-((x - v) / h) * ((x - v) / h) / 2e0) / h) / (sum(n) * sqrt(2 * pi()))', 7)} AS density
    FROM placed GROUP BY {by}, point"""


@query("kde_rule", f"WITH {_sql_curve('events', 'value', 'event_type').lstrip()}")
def kde_rule(spark, sf_dir):
    """Density over each group's own range, with the bandwidth its own spread asks for."""
    sample = table(spark, sf_dir, "events").select("event_type", "value")
    curve = density_curve(sample, "value", DENSITY_POINTS, ["event_type"])
    return curve.select(
        "event_type", F.col("point").cast("long").alias("point"), r(F.col("x"), 4).alias("x"), r(F.col("density"), 7).alias("density")
    )


@query(
    "selection_density",
    f"""WITH {sql_costed_parts()}, long AS ({sql_long('costed', 'entity')}),
    pts AS (SELECT process, log10(cost / 2.6e10 * 0.69e0) AS v FROM long WHERE cost > 0),{_sql_curve('pts', 'v', 'process')}""",
)
def selection_density(spark, sf_dir):
    """Density of the logarithm of the selection coefficients, per process."""
    long = selection_long(costed_parts(spark, sf_dir), ["entity"], DEFAULT.cell_budget, DEFAULT.selection_factor)
    points = long.select("process", positive_log10(F.col("sc")).alias("v"))
    curve = density_curve(points, "v", DENSITY_POINTS, ["process"])
    return curve.select(
        "process", F.col("point").cast("long").alias("point"), r(F.col("x"), 4).alias("x"), r(F.col("density"), 7).alias("density")
    )


@query("density_bandwidth", f"SELECT {sql_r(_sql_width('value'), 7)} AS bandwidth FROM events")
def density_bandwidth(spark, sf_dir):
    sample = table(spark, sf_dir, "events").select("value")
    return rule_bandwidth(sample, "value").select(r(F.col("bandwidth"), 7).alias("bandwidth"))


@query(
    "histogram_density",
    f"""WITH c AS (SELECT event_type, floor((value - 0e0) / 25e0)::BIGINT AS bin, count(*) AS n FROM events GROUP BY ALL)
    SELECT event_type, bin, 0e0 + bin * 25e0 AS bin_from, n,
      {sql_r('n / (sum(n) OVER (PARTITION BY event_type) * 25e0)', 9)} AS density FROM c""",
)
def histogram_density(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "value")
    cells = histogram(events, "value", 0.0, 25.0, ["event_type"])
    return cells.select("event_type", "bin", "bin_from", "n", r(F.col("density"), 9).alias("density"))


@query(
    "box_summary",
    f"""WITH q AS (SELECT event_type, count(*) AS n, quantile_cont(value, 0.25) AS q0, quantile_cont(value, 0.5) AS q1,
      quantile_cont(value, 0.75) AS q2 FROM events GROUP BY event_type)
    SELECT event_type, any_value(n) AS n, {sql_r('any_value(q0)', 5)} AS lower, {sql_r('any_value(q1)', 5)} AS middle,
      {sql_r('any_value(q2)', 5)} AS upper,
      min(value) FILTER (value BETWEEN q0 - 1.5e0 * (q2 - q0) AND q2 + 1.5e0 * (q2 - q0)) AS whisker_low,
      max(value) FILTER (value BETWEEN q0 - 1.5e0 * (q2 - q0) AND q2 + 1.5e0 * (q2 - q0)) AS whisker_high,
      count(*) FILTER (NOT value BETWEEN q0 - 1.5e0 * (q2 - q0) AND q2 + 1.5e0 * (q2 - q0)) AS outside
    FROM events JOIN q USING (event_type) GROUP BY event_type""",
)
def boxes(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "value")
    box = box_summary(events, "value", ["event_type"])
    return box.select(
        "event_type",
        "n",
        r(F.col("q0"), 5).alias("lower"),
        r(F.col("q1"), 5).alias("middle"),
        r(F.col("q2"), 5).alias("upper"),
        "whisker_low",
        "whisker_high",
        "outside",
    )


# similarity ----------------------------------------------------------------------------------------------------------


def nation_parts(spark, sf_dir):
    """Which nation's suppliers deliver which part."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return lines.join(suppliers, "l_suppkey").select(F.col("s_nationkey").cast("long").alias("nation"), "l_partkey")


def _sql_jaccard(condition: str = "") -> str:
    return f"""WITH held AS (SELECT DISTINCT s_nationkey::BIGINT AS nation, l_partkey
      FROM lineitem JOIN supplier ON s_suppkey = l_suppkey {condition}),
    sizes AS (SELECT nation, count(*) AS size FROM held GROUP BY nation),
    shared AS (SELECT a.nation AS row_i, b.nation AS row_j, count(*) AS shared
      FROM held a JOIN held b ON a.l_partkey = b.l_partkey AND a.nation < b.nation GROUP BY ALL)
    SELECT a.nation AS row_i, b.nation AS row_j, coalesce(shared, 0) AS shared,
      {sql_r('1 - coalesce(shared, 0) / (a.size + b.size - coalesce(shared, 0))::DOUBLE', 8)} AS distance
    FROM sizes a JOIN sizes b ON a.nation < b.nation
    LEFT JOIN shared ON row_i = a.nation AND row_j = b.nation"""


@query("jaccard_distance", _sql_jaccard())
def jaccard_distance(spark, sf_dir):
    pairs = jaccard_distances(nation_parts(spark, sf_dir), "nation", "l_partkey", disjoint=True)
    return pairs.select("row_i", "row_j", "shared", r(F.col("distance"), 8).alias("distance"))


@query("jaccard_subset", _sql_jaccard("JOIN part ON p_partkey = l_partkey AND p_type = 'PROMO'"))
def jaccard_subset(spark, sf_dir):
    """Distances over the columns another table lists."""
    listed = table(spark, sf_dir, "part").where("p_type = 'PROMO'")
    subset = restrict_columns(nation_parts(spark, sf_dir), "l_partkey", listed, "p_partkey")
    pairs = jaccard_distances(subset, "nation", "l_partkey", disjoint=True)
    return pairs.select("row_i", "row_j", "shared", r(F.col("distance"), 8).alias("distance"))


def nation_axes(spark, sf_dir):
    held = nation_parts(spark, sf_dir)
    return principal_axes(jaccard_distances(held, "nation", "l_partkey"), entities=held.select("nation"))


@query("pcoa_axes")
def pcoa_axes(spark, sf_dir):
    return nation_axes(spark, sf_dir)


@query("ordination_costs")
def ordination_costs(spark, sf_dir):
    """Coordinates of each nation next to the cost of the parts it delivers."""
    parts = nation_parts(spark, sf_dir).distinct().withColumnRenamed("l_partkey", "entity")
    costs = costed_parts(spark, sf_dir).select("entity", total_cost().alias("total"))
    per_nation = parts.join(costs, "entity").groupBy(F.col("nation").alias("row")).agg(F.sum("total").alias("total"))
    return left_attach(nation_axes(spark, sf_dir), per_nation, ["row"]).withColumn(
        "log_cost", positive_log10(F.col("total"))
    )


# scalar functions ----------------------------------------------------------------------------------------------------


@query(
    "scalar_suite",
    f"""SELECT p_partkey, regexp_replace(p_brand, '[A-Za-z#]', '', 'g') AS brand_number,
      len(regexp_extract_all(p_name, '[aeiou]'))::BIGINT AS vowels,
      (length(p_name) - length(replace(p_name, 'l', '')))::BIGINT AS ls,
      concat_ws(', ', p_type, p_brand) AS label, {sql_r('log10(p_retailprice)', 8)} AS log_price,
      {sql_r('sqrt(p_size) * pi() + exp(-p_size / 10e0) + pow(p_size, 2)', 6)} AS curve,
      CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS size_class,
      CASE p_type WHEN 'SMALL' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LARGE' THEN 3 END::BIGINT AS type_order,
      greatest(p_size - 25e0, 0) AS above_25, coalesce(nullif(p_type, 'PROMO'), 'none') AS type_filled,
      len(range(1, p_size + 1))::BIGINT AS steps,
      p_name || ' ' || printf('%.1f', p_size * 2e0) || ' %' AS share_label,
      replace(printf('%.4e', p_retailprice), 'e', ' x 10^') AS price_label,
      CASE WHEN p_size % 7 <> 0 THEN {sql_r('p_retailprice / (p_size % 7)', 6)} END AS quotient
    FROM part""",
)
def scalar_suite(spark, sf_dir):
    """Every scalar function once per part."""
    size = F.col("p_size").cast("double")
    parts = table(spark, sf_dir, "part")
    return parts.select(
        "p_partkey",
        strip_letters(F.col("p_brand"), "[A-Za-z#]").alias("brand_number"),
        pattern_count(F.col("p_name"), "[aeiou]").cast("long").alias("vowels"),
        letter_count(F.col("p_name"), "l").cast("long").alias("ls"),
        F.concat_ws(", ", "p_type", "p_brand").alias("label"),
        half_up(positive_log10(F.col("p_retailprice")), 8).alias("log_price"),
        half_up(F.sqrt(size) * F.pi() + F.exp(-size / 10.0) + F.pow(size, F.lit(2.0)), 6).alias("curve"),
        F.when(size < 10, "small").when(size < 30, "middle").otherwise("large").alias("size_class"),
        ordinal(F.col("p_type"), ["SMALL", "MEDIUM", "LARGE"]).cast("long").alias("type_order"),
        clamp_negative(size - 25.0).alias("above_25"),
        F.coalesce(F.nullif(F.col("p_type"), F.lit("PROMO")), F.lit("none")).alias("type_filled"),
        F.size(F.sequence(F.lit(1), F.col("p_size"))).cast("long").alias("steps"),
        percent_label(F.col("p_name"), size * 2.0).alias("share_label"),
        scientific_label(F.col("p_retailprice"), 4).alias("price_label"),
        half_up(F.try_divide(F.col("p_retailprice"), F.col("p_size") % 7), 6).alias("quotient"),
    )
