"""First appearance, deduplication, joins with the right treatment of gaps, name resolution, regex join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_appearance(df: DataFrame, entity: Sequence[str], order: Sequence[str], carry: Sequence[str] = ()):
    """The row of each entity that comes first in ``order``.

    A minimum over a struct: combined before the shuffle, so a hot entity sends one row per task. The carried
    columns break remaining ties, which makes the result independent of partitioning.
    """
    fields = list(dict.fromkeys([*order, *carry]))
    best = F.min(F.struct(*fields)).alias("__first")
    return df.groupBy(*entity).agg(best).select(*entity, *[F.col(f"__first.{c}").alias(c) for c in fields])


def mark_first(df: DataFrame, entity: Sequence[str], order: Sequence[str], out: str = "is_first") -> DataFrame:
    """Flag the first row of each entity.

    For courses already reduced to one row per (entity, order): the group is bounded by the points of a course.
    """
    w = Window.partitionBy(*entity).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w) == 1)


def lowest_per_text(df: DataFrame, text: str, key: str, carry: Sequence[str] = ()) -> DataFrame:
    """For each distinct text the row with the lowest key, and how many rows share the text.

    Texts are compared by a 256-bit digest of the whole text, so only digests and keys are shuffled.
    """
    groups = df.where(F.col(text).isNotNull()).groupBy(F.sha2(F.col(text), 256).alias("__digest"))
    copies = F.count(F.lit(1)).alias("copies")
    if not carry:
        return groups.agg(F.min(key).alias(key), copies).drop("__digest")
    return (
        groups.agg(F.min(F.struct(key, *carry)).alias("__row"), copies)
        .select(*[F.col(f"__row.{c}").alias(c) for c in (key, *carry)], "copies")
    )


def left_attach(fact: DataFrame, dimension: DataFrame, on: Sequence[str], suffix: str = "_right") -> DataFrame:
    """Left outer join; a clashing non-key column of the dimension gets a suffix.

    No hint: Spark broadcasts the dimension only if its size is under the session's threshold, else it shuffles and
    splits skewed keys at run time.
    """
    clash = set(fact.columns) - set(on)
    renamed = dimension.select(*[F.col(c).alias(c + suffix) if c in clash else F.col(c) for c in dimension.columns])
    return fact.join(renamed, list(on), "left")


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join in which a missing key matches a missing key. Keys come from the left side."""
    renamed = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    condition = None
    for c in on:
        same = F.col(c).eqNullSafe(F.col(f"__r_{c}"))
        condition = same if condition is None else condition & same
    joined = left.join(renamed, condition, how)
    if how in ("right", "full"):
        joined = joined.withColumns({c: F.coalesce(F.col(c), F.col(f"__r_{c}")) for c in on})
    return joined.drop(*[f"__r_{c}" for c in on])


def outer_fill_zero(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer join on the key, absent measures as zero."""
    joined = left.join(right, list(on), "full")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in joined.columns if c not in on})


def resolve_synonyms(
    df: DataFrame, key: str, primary: str, aliases: Sequence[str], known: DataFrame, known_name: str
) -> DataFrame:
    """The one alias that exists in ``known``, else the primary name.

    Alias columns are counted, not values: with two columns known the name is ambiguous and the primary one stays.
    ``key`` identifies a row of ``df``; the group below has as many rows as there are alias columns.
    """
    names = known.select(F.col(known_name).alias("__alias")).where("__alias is not null").distinct()
    tried = df.select(key, F.col(primary).alias("__primary"), F.explode(F.array(*aliases)).alias("__alias"))
    marked = tried.join(names.withColumn("__known", F.lit(True)), "__alias", "left")
    return (
        marked.groupBy(key, "__primary")
        .agg(
            F.count("__known").alias("alias_hits"),
            F.max(F.when(F.col("__known"), F.col("__alias"))).alias("__hit"),
        )
        .select(
            key,
            "alias_hits",
            F.coalesce(F.when(F.col("alias_hits") == 1, F.col("__hit")), F.col("__primary")).alias("resolved"),
        )
    )


#: Patterns without a literal that are tried on a text at a time, in expectation.
PACKED = 64


def required_literals(pattern: Column) -> Column:
    """For each alternative the longest piece of plain text that every match of it must contain, or empty text.

    Classes and escapes part the text around them, whatever they stand for. A pattern with groups gives one empty
    text, which sends it to the direct comparison.
    """
    plain = F.regexp_replace(pattern, r"([?*+}])[?+]", "$1")
    parted = F.regexp_replace(plain, r"(\\.|\[\^?\]?[^\]]*\])([?*+]|\{[^}]*\})?", "\n")

    def longest(branch: Column) -> Column:
        optional = F.regexp_replace(branch, r".[?*]|.\{[^}]*\}", "\n")
        pieces = F.split(F.regexp_replace(optional, r"[+.^$?*{}]", "\n"), "\n")
        return F.element_at(
            F.array_sort(F.transform(pieces, lambda x: F.struct(F.length(x).alias("n"), x.alias("s")))), -1
        ).getField("s")

    grouped = F.regexp_replace(pattern, r"\\.", "").rlike(r"[()]")
    return F.when(grouped, F.array(F.lit(""))).otherwise(F.transform(F.split(parted, r"\|"), longest))


def _grams(text: Column, size: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - F.lit(size - 1), F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))


def regex_join(left: DataFrame, text: str, right: DataFrame, pattern: str, gram: int = 3) -> DataFrame:
    """Pairs of rows where the right pattern is found in the left text.

    Distinct texts and patterns are matched first. A pattern whose alternatives all must contain a literal of at least
    ``gram`` characters is looked up by the rarest gram of each, as an equality join over (digest of text, gram) rows,
    and each candidate is then checked with the pattern itself, so the prefilter changes no result. Patterns without
    such literals are packed into arrays of ``PACKED``; every distinct text meets every array by its number, an
    equality join again, and the patterns are tried inside the row.
    """
    texts = left.select(F.col(text).alias("__text")).where("__text is not null").distinct()
    texts = texts.withColumn("__tid", F.unhex(F.md5("__text")))
    patterns = right.select(F.col(pattern).alias("__pattern")).where("__pattern is not null").distinct()
    patterns = patterns.withColumn("__literals", required_literals(F.col("__pattern")))
    certain = F.forall("__literals", lambda x: F.length(x) >= gram)
    quick, direct = patterns.where(certain), patterns.where(~certain).select("__pattern")

    branches = quick.select("__pattern", F.posexplode("__literals").alias("__branch", "__literal"))
    wanted = branches.select("__pattern", "__branch", F.explode(_grams(F.col("__literal"), gram)).alias("__gram"))
    present = texts.where(F.length("__text") >= gram).select(
        "__tid", F.explode(_grams(F.col("__text"), gram)).alias("__gram")
    )
    useful = present.join(wanted.select("__gram").distinct(), "__gram", "left_semi")
    frequency = useful.groupBy("__gram").agg(F.count(F.lit(1)).alias("__n"))
    # an alternative with a gram that no text has cannot match: the count is then 0 and no text joins
    rarest = (
        wanted.join(frequency, "__gram", "left")
        .groupBy("__pattern", "__branch")
        .agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__gram").alias("g"))).alias("__best"))
        .select("__pattern", F.col("__best.g").alias("__gram"))
        .distinct()
    )
    found = (
        useful.join(rarest, "__gram")
        .select("__tid", "__pattern")
        .distinct()
        .join(texts, "__tid")
        .where(F.expr("__text rlike __pattern"))
        .select("__tid", "__pattern")
    )
    n_packs = F.ceil(direct.agg(F.count(F.lit(1))).scalar() / F.lit(float(PACKED))).cast("int")
    packs = (
        direct.withColumn("__pack", F.pmod(F.xxhash64("__pattern"), n_packs).cast("int"))
        .groupBy("__pack")
        .agg(F.collect_list("__pattern").alias("__patterns"))
    )
    numbers = F.when(n_packs > 0, F.sequence(F.lit(0), n_packs - 1)).otherwise(F.array().cast("array<int>"))
    tried = (
        texts.withColumn("__pack", F.explode(numbers))
        .join(packs, "__pack")
        .select("__tid", F.explode(F.expr("filter(__patterns, p -> __text rlike p)")).alias("__pattern"))
    )
    found = found.unionByName(tried)
    return (
        left.withColumn("__tid", F.unhex(F.md5(text)))
        .join(found, "__tid")
        .join(right, F.col("__pattern") == F.col(pattern))
        .drop("__tid", "__pattern")
    )
