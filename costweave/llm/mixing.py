"""Time-varying curriculum over weighted sources, in SQL functions only.

Each source has a weight schedule over the training time t in [0, 1], given as linear pieces between points. A schedule
is scaled so that its integral is the source's weight; weights share a budget of words, and no source takes more than ``MAX_REPEATS`` times
its size (the excess is shared again). A source's documents form a stream in the order of a digest, repeated as often as needed. Word
number c of a stream stands at the time where the cumulative demand of the schedule reaches c: the integral is inverted
in the piece whose cumulative demand holds c. Documents are then numbered and sorted by that time, range by range.

Defined cases: null text has size 0 and is never taken; a null source is a source of its own and comes last; ties of
the digest are broken by key, size and text; equal rows are copies that follow each other; sources without words get target
0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costweave.llm.common import (
    SPACE,
    count_copies,
    expand_copies,
    hex_number,
    key_text,
    one_per_row_key,
    row_key,
    running_start,
    table,
    words,
)
from costweave.llm.registry import query
from costweave.session import cut_lineage

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
#: Hex digits of the order that cut a stream into segments.
SEGMENT_DIGITS = 3
#: Leading characters of a source's name that split the ranking.
RANK_CHARACTERS = 8
#: Schedules by the same place: points (time, weight) with time rising from 0 to 1; only their proportions count.
Schedule = tuple[tuple[float, float], ...]
SCHEDULES: tuple[Schedule, ...] = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.25), (0.5, 0.5), (0.75, 2.0), (1.0, 1.5)),
)
#: Digits of the times that are returned and sorted by, and segments of the training order.
TIME_DIGITS = 9
TIME_SEGMENTS = 4096


def integrals(schedule: Schedule) -> list[float]:
    """Demand met by each point of a schedule, as a share of the whole."""
    if schedule[0][0] != 0.0 or schedule[-1][0] != 1.0 or any(a >= b for (a, _), (b, _) in zip(schedule, schedule[1:])):
        raise ValueError("times of a schedule rise from 0 to 1")
    met = [0.0]
    for (t, w), (u, v) in zip(schedule, schedule[1:]):
        if min(w, v) < 0.0:
            raise ValueError("a weight is not below 0")
        met.append(met[-1] + (w + v) / 2.0 * (u - t))
    if not met[-1]:
        raise ValueError("a schedule has some weight")
    return [m / met[-1] for m in met]


def inverse_pieces(schedule: Schedule) -> list[tuple[float, float, float, float, float]]:
    """(share met at the end, share met at the start, time of the start, weight there, slope) of each piece that demands
    anything; weights are those of the schedule with integral 1."""
    met = integrals(schedule)
    whole = sum((w + v) / 2.0 * (u - t) for (t, w), (u, v) in zip(schedule, schedule[1:]))
    pieces = []
    for (t, w), (u, v), start, end in zip(schedule, schedule[1:], met, met[1:]):
        if end > start:
            pieces.append((end, start, t, w / whole, (v - w) / whole / (u - t)))
    return pieces


def scheduled_time(share: Column, schedule: Schedule) -> Column:
    """Time at which a schedule has met this share of its demand."""
    found = None
    for end, start, t, w, slope in reversed(inverse_pieces(schedule)):
        rest = share - F.lit(start)
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w * w) + F.lit(2.0 * slope) * rest))
        time = F.lit(t) + F.coalesce(F.try_divide(F.lit(2.0) * rest, F.lit(w) + root), F.lit(0.0))
        found = time if found is None else F.when(share < F.lit(end), time).otherwise(found)
    return F.round(F.least(F.lit(1.0), found), TIME_DIGITS)


def sql_scheduled_time(share: str, schedule: Schedule) -> str:
    found = None
    for end, start, t, w, slope in reversed(inverse_pieces(schedule)):
        rest = f"({share} - {start!r}e0)"
        root = f"sqrt(greatest(0e0, {w * w!r}e0 + {2.0 * slope!r}e0 * {rest}))"
        time = f"({t!r}e0 + coalesce(2e0 * {rest} / nullif({w!r}e0 + {root}, 0e0), 0e0))"
        found = time if found is None else f"CASE WHEN {share} < {end!r}e0 THEN {time} ELSE {found} END"
    return f"round(least(1e0, {found}), {TIME_DIGITS})"


def planned_time(share: Column, place: Column) -> Column:
    """The same for a schedule given by its place."""
    return F.coalesce(*[F.when(place == k, scheduled_time(share, s)) for k, s in enumerate(SCHEDULES)])


def source_weights(sizes: DataFrame) -> DataFrame:
    """Adds weight and the place of the schedule to (source, source_size): by rank in code point order, null last, repeating.

    The table has one row per source. The rank is an offset, by the beginning of the name, plus the place among the
    sources with that beginning.
    """
    null = F.col("source").isNull()
    head = F.struct(null.alias("last"), F.coalesce(F.substring("source", 1, RANK_CHARACTERS), F.lit("")).alias("head"))
    marked = sizes.withColumn("__all", F.lit(1)).withColumn("__head", head).withColumn("__one", F.lit(1).cast("long"))
    ranked = running_start(marked, ["__all"], "__head", [F.col("source").asc_nulls_last()], "__one", "__rank")
    place = (F.col("__rank") % len(WEIGHTS)).cast("int")

    weight = F.element_at(F.array(*[F.lit(v) for v in WEIGHTS]), place + 1)
    return ranked.select("source", "source_size", weight.alias("weight"), place.alias("schedule"))


def share_budget(sources: DataFrame, budget: float | None = None, repeats: float = MAX_REPEATS) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight, ..): shares of the budget by weight, stopped at the ceiling.

    A source stops where its ratio ``repeats * size / weight`` is below the level that the others share. In the order
    of the ratios the stopped ones are a leading part: it ends at the first ratio that is not below the level of the
    rest. The running sums are taken per power of two of the ratio. The budget is the sum of all sizes if not given.
    """
    ceiling = F.col("source_size") * F.lit(float(repeats))
    rated = sources.withColumn("__ratio", ceiling / F.col("weight"))
    steps = rated.groupBy("__ratio").agg(F.sum(ceiling).alias("__cap"), F.sum("weight").alias("__w"))
    steps = steps.withColumn("__all", F.lit(1)).withColumn(
        "__octave", F.when(F.col("__ratio") > 0, F.floor(F.log2("__ratio"))).otherwise(F.lit(-2000))
    )
    steps = running_start(steps, ["__all"], "__octave", ["__ratio"], "__cap", "__taken")
    steps = running_start(steps, ["__all"], "__octave", ["__ratio"], "__w", "__before")
    words_shared = F.lit(budget) if budget is not None else sources.agg(F.sum("source_size").cast("double")).scalar()
    weight_left = sources.agg(F.sum("weight")).scalar() - F.col("__before")
    levels = steps.select("__ratio", ((words_shared - F.col("__taken")) / weight_left).alias("__level"))
    found = levels.where(F.col("__level") <= F.col("__ratio")).agg(F.min_by("__level", "__ratio")).scalar()
    return rated.withColumn("target", F.least(ceiling, F.coalesce(found * F.col("weight"), ceiling))).drop("__ratio")


def draw_mix(docs: DataFrame, sources: DataFrame, key: str = "doc_id") -> DataFrame:
    """Words taken of each row of (key, source, size, ..) for sources with targets, and its first training time.

    ``start`` counts the words of the source before the row. The whole part of target / size is taken of every row,
    the rest from the beginning of the stream up to the word; ``first_time`` is null where nothing is taken.
    """
    order = F.md5(F.concat(key_text(F.col(key)), F.lit(":"), key_text(F.col("source"))))
    columns = docs.columns
    counted = cut_lineage(count_copies(docs.withColumn("__order", order)))
    laid = counted.withColumn("__part", hex_number(F.col("__order"), 1, SEGMENT_DIGITS)).withColumn(
        "__width", F.col("size") * F.col("copies")
    )
    placed = running_start(laid, ["source"], "__part", ["__order", *columns], "__width", "__start")
    rows = expand_copies(placed, "copies", "__copy").withColumn(
        "start", F.col("__start") + F.col("__copy") * F.col("size")
    )
    given = sources.withColumnRenamed("source", "__source")
    mixed = rows.drop("__order", "__part", "__width", "__start", "__copy").join(
        given, F.col("source").eqNullSafe(F.col("__source"))
    ).drop("__source")
    whole = F.floor(F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0)))
    more = F.round(F.col("target") - whole * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), more - F.col("start")))
    taken = F.when(F.col("size") == 0, F.lit(0).cast("long")).otherwise(whole * F.col("size") + part)
    share = F.try_divide(F.col("start").cast("double"), F.col("target"))
    return mixed.withColumn("taken", taken.cast("long")).withColumn(
        "first_time", F.when(F.col("taken") > 0, planned_time(share, F.col("schedule")))
    )


def numbered(mixed: DataFrame) -> DataFrame:
    """Adds ``position``: the place, from 0, of each row's first time among all rows of which something is taken.

    Segments of the time are numbered on their own and offset by the rows before them.
    """
    segment = F.least(F.lit(TIME_SEGMENTS - 1), F.floor(F.col("first_time") * TIME_SEGMENTS).cast("int"))
    some = mixed.where("taken > 0").withColumns({"__all": F.lit(1), "__part": segment, "__one": F.lit(1).cast("long")})
    order = ["first_time", "doc_id", "size", "start"]
    placed = running_start(some, ["__all"], "__part", order, "__one", "position").drop("__all", "__part", "__one")
    return placed.unionByName(mixed.where("taken = 0").withColumn("position", F.lit(None).cast("long")))


def timed_repeats(mixed: DataFrame) -> DataFrame:
    """Adds repeat (from 0) and training_time to the rows of draw_mix, one row per begun repeat."""
    begun = F.ceil(F.col("taken") / F.col("size"))
    plan = mixed.where("taken > 0").withColumn("repeat", F.explode(F.sequence(F.lit(0).cast("long"), begun - 1)))
    share = (F.col("start") + F.col("repeat") * F.col("source_size")) / F.col("target")
    return plan.withColumn("training_time", planned_time(share, F.col("schedule")))


def training_order(mixed: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` once per begun repeat, sorted by training time across range partitions.

    ``mixed`` has one row per row of ``docs`` (draw_mix over key, source, size and row key). Repeats number from 0;
    the document at which a target ends stays whole.
    """
    timed = timed_repeats(mixed).select(F.col("row").alias("__timed"), "training_time", "repeat")
    unique = one_per_row_key(docs, key, text)
    out = unique.join(timed, F.col("__row") == F.col("__timed")).drop("__row", "__timed")
    return out.repartitionByRange("training_time", key).sortWithinPartitions("training_time", key, "repeat")


def sized_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, row): the text is left behind as its size and the row's key."""
    size = F.size(words(F.col("text"))).cast("long").alias("size")
    return docs.select("doc_id", "source", size, row_key(F.col("doc_id"), F.col("text")).alias("row"))


def source_sizes(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source").agg(F.sum("size").alias("source_size"))


def planned_mix(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, source, text, ..) to what the production mix takes of each."""
    sized = cut_lineage(sized_documents(docs))
    weighted = cut_lineage(source_weights(source_sizes(sized)))
    return draw_mix(sized, share_budget(weighted))


SQL_SIZED = f"""
docs AS (
  SELECT doc_id, source, CAST(length(regexp_replace(regexp_replace(coalesce(text, ''),
    '[^{SPACE}]+', 'x', 'g'), '[{SPACE}]+', '', 'g')) AS BIGINT) AS size
  FROM documents)"""

SQL_MIX = f"""
sized AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
placed AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) AS place FROM sized),
weighted AS (
  SELECT source, source_size, [{', '.join(f'{w}e0' for w in WEIGHTS)}][place + 1] AS weight,
    place AS schedule, source_size * {float(MAX_REPEATS)}e0 AS cap
  FROM placed),
steps AS (SELECT cap / weight AS ratio, sum(cap) AS cap, sum(weight) AS w FROM weighted GROUP BY 1),
levels AS (
  SELECT ratio, ((SELECT CAST(sum(source_size) AS DOUBLE) FROM weighted)
      - coalesce(sum(cap) OVER (ORDER BY ratio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
    / sum(w) OVER (ORDER BY ratio ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM steps),
found AS (SELECT arg_min(level, ratio) AS level FROM levels WHERE level <= ratio),
targets AS (SELECT weighted.*, least(cap, coalesce(level * weight, cap)) AS target FROM weighted, found),
laid AS (
  SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), '<null>') || ':' || coalesce(source, '<null>')) AS o FROM docs),
placed_docs AS (
  SELECT doc_id, source, size, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY o, doc_id NULLS FIRST, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM laid),
joined AS (
  SELECT d.doc_id, d.source, d.size, d.start, t.source_size, t.target, t.schedule,
    coalesce(floor(t.target / nullif(t.source_size, 0)), 0e0) AS whole,
    CAST(round(t.target - coalesce(floor(t.target / nullif(t.source_size, 0)), 0e0) * t.source_size) AS BIGINT) AS more
  FROM placed_docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
mix AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE CAST(whole * size AS BIGINT) + greatest(0, least(size, more - start)) END
    AS taken FROM joined),
timed AS (
  SELECT *, CASE WHEN taken > 0 THEN CASE schedule
    {' '.join(f"WHEN {k} THEN {sql_scheduled_time('(start / target)', s)}" for k, s in enumerate(SCHEDULES))} END END AS first_time
  FROM mix)"""


@query(
    "op5_mix",
    f"WITH {SQL_SIZED}, {SQL_MIX} "
    "SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken, first_time, CASE WHEN taken > 0 THEN "
    "row_number() OVER (PARTITION BY taken > 0 ORDER BY first_time, doc_id NULLS FIRST, size, start) - 1 END AS position FROM timed",
)
def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the production mix takes of every document, the time of the first of them and its place in that order."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    mixed = numbered(cut_lineage(planned_mix(docs)))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "first_time", "position")


@query("op5_training_order")
def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The production mix in training order: every begun repeat of a document with its time, sorted across ranges."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    timed = timed_repeats(planned_mix(docs)).select("doc_id", "source", "repeat", "training_time")
    order = ["training_time", "doc_id", "repeat"]
    return timed.repartitionByRange(*order).sortWithinPartitions(*order)
