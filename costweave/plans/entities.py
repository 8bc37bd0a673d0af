"""Queries over parts, customers and suppliers: filling, costing, joining, grouping, budgets."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from costweave.functions.scalars import band, fill
from costweave.operators.costs import (
    COST_COLUMNS,
    genome_costs,
    lipid_cost,
    lipid_molecules,
    price_texts,
    septum_constants,
    septum_lipids,
    sphere_lipids,
    total_cost,
    transcription_direct,
    transcription_opportunity,
    translation_by_length,
    with_costs,
)
from costweave.operators.fill import attach_group_size, fill_attributes, fill_median
from costweave.operators.ordered import rank_slice
from costweave.operators.quantiles import exact_medians
from costweave.operators.reshape import to_long
from costweave.operators.resolve import (
    left_attach,
    lowest_per_text,
    null_safe_join,
    outer_fill_zero,
    regex_join,
    resolve_synonyms,
)
from costweave.operators.rollup import (
    band_costs,
    budget_table,
    kind_share,
    loose_sum,
    presence_share,
    process_breakdown,
    scaled_thresholds,
    selection_long,
    selection_of_known,
    strict_sum,
)
from costweave.params import DEFAULT, DORMANT, DORMANT_TRANSLATION_POOL, SUCCESS_BANDS
from costweave.plans.frames import (
    SQL_ATTRIBUTES,
    SQL_COURSE,
    attributes,
    costed_course,
    costed_parts,
    quantity_course,
    sql_costed_course,
    sql_costed_parts,
    sql_costs,
    sql_fills,
    sql_letters,
    sql_long,
    table,
    year_span,
)
from costweave.plans.registry import query, r, sql_r
from costweave.sources.delimited import literal_table, patch_rows, to_number

SQL_TOTAL = (
    "replication_opportunity + replication_direct + transcription_opportunity + transcription_direct"
    " + translation_opportunity + translation_direct"
)


# sources and cells ---------------------------------------------------------------------------------------------------


@query(
    "coerce_numeric",
    f"""SELECT o_orderpriority AS priority, count(*) AS n,
      {sql_r('sum(CAST(substr(o_orderpriority, 1, 1) AS DOUBLE))', 2)} AS first_sum,
      count(TRY_CAST(o_orderpriority AS DOUBLE)) AS whole_numbers, {sql_r('sum(o_totalprice)', 1)} AS price
    FROM orders GROUP BY o_orderpriority""",
)
def coerce_numeric(spark, sf_dir):
    """Text to number: a digit, a text that is none, and a number written with a decimal comma."""
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice")
    comma = F.replace(F.col("o_totalprice").cast("string"), F.lit("."), F.lit(","))
    return orders.groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count(F.lit(1)).alias("n"),
        r(F.sum(to_number(F.substring("o_orderpriority", 1, 1))), 2).alias("first_sum"),
        F.count(to_number(F.col("o_orderpriority"))).alias("whole_numbers"),
        r(F.sum(to_number(comma, decimal=",")), 1).alias("price"),
    )


@query(
    "patch_rows",
    """SELECT brand, count(*) AS n FROM (
      SELECT CASE p_partkey WHEN 3 THEN 'Brand#0' WHEN 20 THEN 'Brand#0' WHEN 17 THEN NULL ELSE p_brand END AS brand
      FROM part) GROUP BY brand""",
)
def patched_brands(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    patched = patch_rows(
        parts, "p_partkey", {3: {"p_brand": "Brand#0"}, 17: {"p_brand": None}, 20: {"p_brand": "Brand#0"}}
    )
    return patched.groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "complete_cases",
    f"""WITH {SQL_ATTRIBUTES}
    SELECT p_type, count(*) AS n, {sql_r('sum(abundance)', 2)} AS abundance, {sql_r('sum(gene_length)', 2)} AS length
    FROM attr WHERE abundance IS NOT NULL AND gene_length IS NOT NULL AND seq_direct IS NOT NULL GROUP BY p_type""",
)
def complete_cases(spark, sf_dir):
    kept = attributes(spark, sf_dir).dropna("any")
    return kept.groupBy("p_type").agg(
        F.count(F.lit(1)).alias("n"),
        r(F.sum("abundance"), 2).alias("abundance"),
        r(F.sum("gene_length"), 2).alias("length"),
    )


# joins ---------------------------------------------------------------------------------------------------------------


@query(
    "enrich_fill",
    f"""WITH {SQL_ATTRIBUTES},{SQL_COURSE}
    SELECT entity, min(time) AS time, {', '.join(f'any_value({c}) AS {c}' for c in (
        'abundance_filled', 'gene_length_filled', 'protein_length_filled',
        'seq_opportunity_filled', 'seq_direct_filled'))}
    FROM (SELECT entity, time, {sql_fills()} FROM course LEFT JOIN attr USING (entity)) GROUP BY entity""",
)
def enrich_fill(spark, sf_dir):
    """First appearances joined to three tables that each lack some parts; what is absent is filled."""
    parts = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "entity")
    abundance = parts.where("p_size > 10").select("entity", F.col("p_retailprice").alias("abundance"))
    lengths = parts.where("p_size % 7 != 0").select(
        "entity",
        (F.col("p_size") * 10.0).alias("gene_length"),
        F.floor(F.col("p_size") * 10.0 / 3).cast("double").alias("protein_length"),
    )
    sequences = attributes(spark, sf_dir).where("p_size % 5 != 0").select("entity", "seq_opportunity", "seq_direct")
    fact = quantity_course(spark, sf_dir).where("is_first").select("entity", "time")
    for dimension in (abundance, lengths, sequences):
        fact = left_attach(fact, dimension, ["entity"])
    filled = fill_attributes(fact, DEFAULT)
    return filled.select("entity", "time", *[c for c in filled.columns if c.endswith("_filled")])


SQL_SCORED = f"""{SQL_ATTRIBUTES},
fact AS (SELECT c_custkey AS entity, c_acctbal / 10000e0 AS score, c_mktsegment, {sql_fills()}
  FROM customer LEFT JOIN attr ON attr.entity = c_custkey),
costed AS (SELECT *, CASE WHEN score < 0.31e0 THEN 'essential' WHEN score > 0.31e0 AND score < 0.46e0 THEN '50% failure'
    WHEN score > 0.46e0 AND score < 0.83e0 THEN '10% failure' WHEN score > 0.83e0 THEN '90% success' END AS success,
  {sql_costs()} FROM fact)"""


SQL_SCORED_MEDIAN = SQL_SCORED.replace(
    "costed AS (SELECT *,",
    """med AS (SELECT fact.* EXCLUDE (seq_opportunity_filled, seq_direct_filled),
    (SELECT median(attr.seq_opportunity) FROM customer JOIN attr ON attr.entity = c_custkey) AS seq_opportunity_filled,
    (SELECT median(attr.seq_direct) FROM customer JOIN attr ON attr.entity = c_custkey) AS seq_direct_filled FROM fact),
costed AS (SELECT *,""",
)
SQL_SCORED_MEDIAN = SQL_SCORED_MEDIAN[: SQL_SCORED_MEDIAN.rindex("FROM fact")] + "FROM med)"


def scored(spark, sf_dir, sequences: str = "fill"):
    """Entities with a relative score and its success band, costed; sequence costs filled or replaced by medians."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("entity"), (F.col("c_acctbal") / 10000.0).alias("score"), "c_mktsegment"
    )
    joined = left_attach(customers, attributes(spark, sf_dir), ["entity"])
    fact = fill_attributes(joined, DEFAULT)
    if sequences == "replace":
        names = ["seq_opportunity", "seq_direct"]
        medians = exact_medians(joined, names).select(F.struct(*names)).scalar()
        fact = fact.withColumns({f"{n}_filled": medians[n] for n in names})
    return with_costs(fact.withColumn("success", band(F.col("score"), SUCCESS_BANDS)))


@query(
    "band_classify_costs",
    f"""WITH {SQL_SCORED}, long AS ({sql_long('costed', 'success')}),
    sums AS (SELECT success, process, kind, sum(cost) AS cost FROM long WHERE success <> '90% success' GROUP BY ALL)
    SELECT success, process, kind, {sql_r('cost', 1)} AS cost,
      {sql_r('cost * 100e0 / (SELECT sum(cost) FROM sums)', 6)} AS ratio FROM sums""",
)
def band_classify_costs(spark, sf_dir):
    return band_costs(scored(spark, sf_dir), "success", ["90% success"]).select(
        "success", "process", "kind", r(F.col("cost"), 1).alias("cost"), r(F.col("ratio"), 6).alias("ratio")
    )


@query(
    "band_classify_medians",
    f"""WITH {SQL_SCORED_MEDIAN}, long AS ({sql_long('costed', 'success')}),
    sums AS (SELECT success, process, kind, sum(cost) AS cost FROM long WHERE success <> '90% success' GROUP BY ALL)
    SELECT success, process, kind, {sql_r('cost', 1)} AS cost,
      {sql_r('cost * 100e0 / (SELECT sum(cost) FROM sums)', 6)} AS ratio FROM sums""",
)
def band_classify_medians(spark, sf_dir):
    """Band costs with every sequence cost replaced by the median over the scored entities."""
    return band_costs(scored(spark, sf_dir, "replace"), "success", ["90% success"]).select(
        "success", "process", "kind", r(F.col("cost"), 1).alias("cost"), r(F.col("ratio"), 6).alias("ratio")
    )


@query(
    "quality_by_cost",
    f"""WITH {SQL_SCORED},{SQL_COURSE}, seen AS (SELECT entity, min(time) AS time FROM course GROUP BY entity)
    SELECT entity, seen.time, {sql_r('score', 6)} AS score, {sql_r(SQL_TOTAL, 2)} AS total
    FROM costed RIGHT JOIN seen USING (entity)""",
)
def quality_by_cost(spark, sf_dir):
    """Every entity of the course, with score and total cost where it has been scored."""
    seen = quantity_course(spark, sf_dir).where("is_first").select("entity", "time")
    quality = scored(spark, sf_dir).select("entity", "score", total_cost().alias("total")).join(seen, "entity", "right")
    return quality.select("entity", "time", r(F.col("score"), 6).alias("score"), r(F.col("total"), 2).alias("total"))


@query(
    "full_outer_annotate",
    f"""WITH {sql_costed_parts()},
    flagged AS (SELECT c_custkey + 500 AS entity, 'known' AS mutant FROM customer WHERE c_mktsegment = 'BUILDING')
    SELECT entity, {sql_r(SQL_TOTAL, 2)} AS total, mutant FROM costed FULL JOIN flagged USING (entity)""",
)
def full_outer_annotate(spark, sf_dir):
    costed = costed_parts(spark, sf_dir).select("entity", r(total_cost(), 2).alias("total"))
    return costed.join(flagged(spark, sf_dir), "entity", "full").select("entity", "total", "mutant")


def flagged(spark, sf_dir):
    """A list of known entities that overlaps the costed ones only in part."""
    customers = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return customers.select((F.col("c_custkey") + 500).alias("entity"), F.lit("known").alias("mutant"))


@query(
    "score_thresholds",
    f"""SELECT {sql_r('avg(c_acctbal / 10000e0) * 0.5e0', 7)} AS half, {sql_r('avg(c_acctbal / 10000e0) * 0.9e0', 7)} AS most,
      {sql_r('max(c_acctbal / 10000e0) * 0.75e0', 7)} AS top FROM customer""",
)
def score_thresholds(spark, sf_dir):
    scores = table(spark, sf_dir, "customer").select((F.col("c_acctbal") / 10000.0).alias("score"))
    found = scaled_thresholds(scores, "score", {"half": 0.5, "most": 0.9}, {"top": 0.75})
    return found.select(*[r(F.col(c), 7).alias(c) for c in found.columns])


SQL_PRESENCE = """
pairs AS (SELECT DISTINCT l_partkey AS entity, s_nationkey AS nation
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
held AS (SELECT entity, count(*) AS present FROM pairs GROUP BY entity)"""


def presence_counts(spark, sf_dir):
    """(entity, present, places): nations that supply a part, and nations there are.

    Pairs are made different before they are counted; a nation that supplies nothing is only in the total.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    pairs = lines.join(suppliers, "l_suppkey").select(F.col("l_partkey").alias("entity"), "s_nationkey").distinct()
    places = table(spark, sf_dir, "nation").agg(F.count_distinct("n_nationkey")).scalar()
    held = pairs.groupBy("entity").agg(F.count(F.lit(1)).alias("present"))
    return held.withColumn("places", places)


SQL_NATIONS = "(SELECT count(DISTINCT n_nationkey) FROM nation)"


@query(
    "presence_frequency",
    f"""WITH {SQL_PRESENCE}
    SELECT entity, {sql_r(f'CAST(present AS DOUBLE) / {SQL_NATIONS} * 100e0', 4)} AS frequency FROM held""",
)
def presence_frequency(spark, sf_dir):
    share = presence_share(F.col("present"), F.col("places"))
    return presence_counts(spark, sf_dir).select("entity", r(share, 4).alias("frequency"))


@query(
    "conserved_presence",
    f"""WITH {sql_costed_parts()},{SQL_PRESENCE},
    long AS ({sql_long('costed', 'entity, p_type')}),
    cells AS (SELECT held.entity, CASE WHEN pairs.entity IS NULL THEN 'absent' ELSE 'present' END AS presence
      FROM held CROSS JOIN (SELECT DISTINCT n_nationkey AS nation FROM nation) g
      LEFT JOIN pairs ON pairs.entity = held.entity AND pairs.nation = g.nation)
    SELECT p_type, process, kind, presence, count(*) AS n, {sql_r('avg(cost)', 2)} AS cost,
      {sql_r('avg(cost / 2.6e10 * 0.69e0) * 1e9', 2)} AS selection_nano
    FROM cells JOIN long USING (entity) GROUP BY ALL""",
)
def conserved_presence(spark, sf_dir):
    """Mean cost and selection by type, process, kind and presence, over all cells of part and nation.

    Cells of one part and state carry the same cost, so they are counted and never made.
    """
    counts = presence_counts(spark, sf_dir).withColumn("absent", F.col("places") - F.col("present"))
    # one row a part meets one row a part, and neither is broadcast; rows are multiplied after the join only
    costed = costed_parts(spark, sf_dir).select("entity", "p_type", *COST_COLUMNS)
    joined = counts.join(costed.hint("merge"), "entity")
    cells = to_long(joined, ["p_type", *COST_COLUMNS], ["present", "absent"], "presence", "cells").where("cells > 0")
    weight = F.sum("cells")
    means = [(F.sum(F.col(c) * F.col("cells")) / weight).alias(c) for c in COST_COLUMNS]
    wide = cells.groupBy("p_type", "presence").agg(weight.alias("n"), *means)
    long = selection_long(wide, ["p_type", "presence", "n"], DEFAULT.cell_budget, DEFAULT.selection_factor)
    return long.select(
        "p_type",
        "process",
        "kind",
        "presence",
        "n",
        r(F.col("cost"), 2).alias("cost"),
        r(F.col("sc") * 1e9, 2).alias("selection_nano"),
    )


EXTRA_PATTERNS = (("^hot",), ("wid.et",), ("gi?zmo$",), ("^s.*l+ pla",), ("ring|gear",), ("[bc]olt",), ("(a|x)i",), ("r.d",))


@query(
    "regex_join",
    f"""WITH patterns AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS pattern FROM part
      UNION SELECT unnest([{', '.join(f"'{p}'" for (p,) in EXTRA_PATTERNS)}]))
    SELECT p_partkey, pattern FROM part JOIN patterns ON regexp_matches(p_name, pattern)""",
)
def regex_pairs(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    words = parts.select(F.split("p_name", " ")[1].alias("pattern")).distinct()
    patterns = words.unionByName(literal_table(spark, EXTRA_PATTERNS, "pattern string")).distinct()
    return regex_join(parts, "p_name", patterns, "pattern").select("p_partkey", "pattern")


KNOWN_NAMES = ("red", "hot", "ring", "gear", "ECONOMY", "PROMO", "Brand#7", "Brand#12", "Brand#19")


@query(
    "resolve_synonyms",
    f"""WITH tried AS (
      SELECT p_partkey, p_name, list_filter([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), p_type, p_brand],
        lambda x: x IN {KNOWN_NAMES}) AS hits FROM part)
    SELECT p_partkey, len(hits) AS alias_hits, CASE WHEN len(hits) = 1 THEN hits[1] ELSE p_name END AS resolved
    FROM tried""",
)
def resolved_names(spark, sf_dir):
    words = F.split("p_name", " ")
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", words[0].alias("first"), words[1].alias("second"), "p_type", "p_brand"
    )
    known = literal_table(spark, [(n,) for n in KNOWN_NAMES], "name string")
    return resolve_synonyms(parts, "p_partkey", "p_name", ["first", "second", "p_type", "p_brand"], known, "name")


@query(
    "full_outer_fill_zero",
    f"""WITH ends AS (SELECT min(year(l_shipdate)) AS first, max(year(l_shipdate)) AS last FROM lineitem),
      a AS (SELECT l_partkey AS entity, sum(l_quantity) AS early FROM lineitem, ends
        WHERE year(l_shipdate) = first GROUP BY 1),
      b AS (SELECT l_partkey AS entity, sum(l_quantity) AS late FROM lineitem, ends
        WHERE year(l_shipdate) = last GROUP BY 1)
    SELECT entity, {sql_r('coalesce(early, 0)', 2)} AS early, {sql_r('coalesce(late, 0)', 2)} AS late
    FROM a FULL JOIN b USING (entity)""",
)
def full_outer_fill_zero(spark, sf_dir):
    """Quantities of the first and of the last year side by side; the years are read as ranges of dates."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity"), "l_shipdate", "l_quantity")
    first, last = year_span(spark, sf_dir)

    def sums(year, name):
        start, end = (F.lit(f"{y:04d}-01-01").cast("timestamp_ntz") for y in (year, year + 1))
        kept = lines.where((F.col("l_shipdate") >= start) & (F.col("l_shipdate") < end))
        return kept.groupBy("entity").agg(F.sum("l_quantity").alias(name))

    both = outer_fill_zero(sums(first, "early"), sums(last, "late"), ["entity"])
    return both.select("entity", r(F.col("early"), 2).alias("early"), r(F.col("late"), 2).alias("late"))


@query(
    "rank_slice",
    f"""WITH sums AS (SELECT l_returnflag AS stage, l_partkey AS entity, sum(l_quantity) AS quantity
      FROM lineitem GROUP BY ALL)
    SELECT stage, entity, {sql_r('quantity', 2)} AS quantity FROM sums
    QUALIFY row_number() OVER (PARTITION BY stage ORDER BY quantity DESC, entity) BETWEEN 4 AND 13""",
)
def ranked_parts(spark, sf_dir):
    """Ranks 4 to 13 of each stage's parts by quantity."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("stage"), F.col("l_partkey").alias("entity"), "l_quantity"
    )
    sums = lines.groupBy("stage", "entity").agg(F.sum("l_quantity").alias("quantity"))
    kept = rank_slice(sums, ["stage"], [F.desc("quantity"), F.col("entity")], 4, 13)
    return kept.select("stage", "entity", r(F.col("quantity"), 2).alias("quantity"))


@query(
    "null_safe_join",
    f"""WITH gapped AS (SELECT p_partkey, p_retailprice, CASE WHEN p_size <= 45 THEN p_brand END AS brand FROM part),
    prices AS (SELECT brand, avg(p_retailprice) AS mean_price, count(*) AS members FROM gapped GROUP BY brand)
    SELECT p_partkey, gapped.brand, members, {sql_r('mean_price', 5)} AS mean_price
    FROM gapped JOIN prices ON gapped.brand IS NOT DISTINCT FROM prices.brand""",
)
def null_safe(spark, sf_dir):
    """A missing brand is a group of its own and finds its own row again."""
    gapped = table(spark, sf_dir, "part").select(
        "p_partkey", "p_retailprice", F.when(F.col("p_size") <= 45, F.col("p_brand")).alias("brand")
    )
    prices = gapped.groupBy("brand").agg(
        F.avg("p_retailprice").alias("mean_price"), F.count(F.lit(1)).alias("members")
    )
    joined = null_safe_join(gapped.drop("p_retailprice"), prices, ["brand"])
    return joined.select("p_partkey", "brand", "members", r(F.col("mean_price"), 5).alias("mean_price"))


# groups --------------------------------------------------------------------------------------------------------------


@query(
    "strict_sum",
    f"""WITH {SQL_ATTRIBUTES}
    SELECT p_size // 4 AS size_class, p_type,
      {sql_r('CASE WHEN count(abundance) = count(*) THEN sum(abundance) END', 2)} AS strict,
      {sql_r('coalesce(sum(abundance), 0)', 2)} AS loose FROM attr GROUP BY ALL""",
)
def strict_and_loose(spark, sf_dir):
    return (
        attributes(spark, sf_dir)
        .groupBy(F.expr("p_size div 4").alias("size_class"), "p_type")
        .agg(r(strict_sum("abundance"), 2).alias("strict"), r(loose_sum("abundance"), 2).alias("loose"))
    )


@query(
    "median_fill",
    f"""WITH {SQL_ATTRIBUTES}
    SELECT entity, {sql_r('coalesce(abundance, (SELECT median(abundance) FROM attr))', 4)} AS abundance_filled,
      {sql_r('coalesce(gene_length, (SELECT median(gene_length) FROM attr))', 4)} AS gene_length_filled FROM attr""",
)
def median_fill(spark, sf_dir):
    filled = fill_median(attributes(spark, sf_dir), ["abundance", "gene_length"])
    return filled.select(
        "entity",
        r(F.col("abundance_filled"), 4).alias("abundance_filled"),
        r(F.col("gene_length_filled"), 4).alias("gene_length_filled"),
    )


@query(
    "group_median_window",
    f"""WITH {SQL_ATTRIBUTES}
    SELECT entity, p_type, {sql_r('median(abundance) OVER (PARTITION BY p_type)', 4)} AS middle FROM attr""",
)
def group_median_window(spark, sf_dir):
    attached = fill_median(attributes(spark, sf_dir), ["abundance"], ["p_type"], mode="replace")
    return attached.select("entity", "p_type", r(F.col("abundance_filled"), 4).alias("middle"))


@query(
    "group_size_norm",
    f"""WITH {SQL_SCORED}
    SELECT success, count(*) AS members, {sql_r('sum(' + SQL_TOTAL + ') / count(*)', 2)} AS norm
    FROM costed GROUP BY success""",
)
def group_size_norm(spark, sf_dir):
    """Cost per member of each band, the size of the band taken from the rows."""
    sized = attach_group_size(scored(spark, sf_dir), ["success"], "members")
    sums = sized.groupBy("success").agg(F.max("members").alias("members"), F.sum(total_cost()).alias("total"))
    return sums.select("success", "members", r(F.try_divide("total", "members"), 2).alias("norm"))


#: Lipids of both leaflets of a cell, head and tail, opportunity and direct.
MEMBRANE = (
    4 * math.pi * (DEFAULT.cell_length * DEFAULT.cell_width
    + (DEFAULT.cell_length - DEFAULT.bilayer) * (DEFAULT.cell_width - DEFAULT.bilayer))
    / DEFAULT.head_group_area / DEFAULT.protein_discount * (DEFAULT.lipid_opportunity + DEFAULT.lipid_direct)
)


@query(
    "trait_budget",
    f"""WITH {sql_costed_course().replace('fact AS', 'course_fact AS').replace('FROM fact', 'FROM course_fact').replace(
        'costed AS (', 'course_costed AS (')},
    kept AS (SELECT * FROM attr WHERE p_type <> 'PROMO' AND p_type <> 'SMALL'),
    fact AS (SELECT p_type, coalesce(abundance, 18e0) AS abundance_filled, gene_length AS gene_length_filled,
      median(seq_opportunity) OVER (PARTITION BY p_type) AS seq_opportunity_filled,
      median(seq_direct) OVER (PARTITION BY p_type) AS seq_direct_filled FROM kept),
    costed AS (SELECT *, {sql_costs()} FROM fact),
    sums AS (SELECT p_type AS category, coalesce(sum({SQL_TOTAL}), 0) AS cost FROM costed GROUP BY 1
      UNION ALL SELECT * FROM (VALUES ('growth requirements', 2.6e10), ('basal metabolism', 3.5e8),
        ('membrane', {MEMBRANE!r}), ('genome replication', 417266190e0))
      UNION ALL SELECT 'developmental programm', (SELECT coalesce(sum({SQL_TOTAL}), 0) FROM course_costed))
    SELECT category, {sql_r('cost', 1)} AS cost, {sql_r('cost * 100e0 / 2.6e10', 6)} AS budget_share,
      CASE WHEN cost > 0 THEN {sql_r('log10(cost)', 6)} END AS log_cost FROM sums""",
)
def trait_budget(spark, sf_dir):
    """Cost per category, sequence costs replaced by the category median; rows without a length cost nothing."""
    kept = attributes(spark, sf_dir).where("p_type != 'PROMO'").where("p_type != 'SMALL'")
    medians = fill_median(kept, ["seq_opportunity", "seq_direct"], ["p_type"], mode="replace")
    fact = medians.withColumns(
        {"abundance_filled": fill(F.col("abundance"), DEFAULT.fill_abundance), "gene_length_filled": F.col("gene_length")}
    )
    sums = with_costs(fact).groupBy(F.col("p_type").alias("category")).agg(loose_sum(total_cost()).alias("cost"))
    genome = genome_costs()
    reference = [
        ("growth requirements", DEFAULT.cell_budget),
        ("basal metabolism", DEFAULT.basal_per_hour),
        ("membrane", MEMBRANE),
        ("genome replication", genome["opportunity"] + genome["direct"]),
    ]
    programme = costed_course(spark, sf_dir).agg(loose_sum(total_cost()).alias("cost"))
    sums = sums.unionByName(programme.select(F.lit("developmental programm").alias("category"), "cost"))
    return (
        budget_table(sums, "category", reference, DEFAULT.cell_budget)
        .select(
            "category",
            r(F.col("cost"), 1).alias("cost"),
            r(F.col("budget_share"), 6).alias("budget_share"),
            r(F.col("log_cost"), 6).alias("log_cost"),
        )
        .orderBy("cost")
    )


# costs ---------------------------------------------------------------------------------------------------------------


def _constants():
    genome, septum = genome_costs(), septum_constants()
    return {k: genome[k] + septum[k] for k in genome}


@query(
    "cost_breakdown",
    f"""WITH {sql_costed_course()},
    s AS (SELECT sum(replication_opportunity + replication_direct) AS rep,
      sum(transcription_opportunity + transcription_direct) AS tra,
      sum(translation_opportunity + translation_direct) AS tla FROM costed),
    lines AS (SELECT 'replication_partial' AS process, rep AS cost FROM s
      UNION ALL SELECT 'replication_rest', 417266190e0 - rep FROM s
      UNION ALL SELECT 'transcription', tra FROM s UNION ALL SELECT 'translation', tla FROM s
      UNION ALL SELECT 'membrane', (4e0 * 1000e0 + 4e0 * 996e0) / 0.65e0 / 2e0 * 230e0)
    SELECT process, {sql_r('cost', 1)} AS cost, {sql_r('cost * 100e0 / (SELECT sum(cost) FROM lines)', 6)} AS share
    FROM lines""",
)
def cost_breakdown(spark, sf_dir):
    genome, septum = genome_costs(), septum_constants()
    split = process_breakdown(costed_course(spark, sf_dir), sum(genome.values()), sum(septum.values()))
    return split.select("process", r(F.col("cost"), 1).alias("cost"), r(F.col("share"), 6).alias("share"))


@query(
    "cost_kind_share",
    f"""WITH {sql_costed_course()}, long AS ({sql_long('costed', '')}),
    lipids AS (SELECT (4e0 * 1000e0 + 4e0 * 996e0) / 0.65e0 / 2e0 AS m),
    sums AS (SELECT kind, sum(cost) + CASE kind WHEN 'opportunity' THEN 295036700e0 + (SELECT m FROM lipids) * 212e0
      ELSE 122229490e0 + (SELECT m FROM lipids) * 18e0 END AS cost FROM long GROUP BY kind)
    SELECT kind, {sql_r('cost', 1)} AS cost, {sql_r('cost * 100e0 / (SELECT sum(cost) FROM sums)', 6)} AS share
    FROM sums""",
)
def cost_kind_share(spark, sf_dir):
    split = kind_share(costed_course(spark, sf_dir), _constants())
    return split.select("kind", r(F.col("cost"), 1).alias("cost"), r(F.col("share"), 6).alias("share"))


def _simple_cost_query(name, columns):
    """Per-part costs of one process."""
    picked = ", ".join(f"{sql_r(c, 3)} AS {c}" for c in columns)

    @query(name, f"WITH {sql_costed_parts()} SELECT entity, {picked} FROM costed")
    def run(spark, sf_dir):
        return costed_parts(spark, sf_dir).select("entity", *[r(F.col(c), 3).alias(c) for c in columns])

    return run


_simple_cost_query("replication_cost", ("replication_opportunity", "replication_direct"))
_simple_cost_query("translation_cost", ("translation_opportunity", "translation_direct"))


@query(
    "transcription_cost",
    f"""WITH {sql_costed_course()}
    SELECT entity, time, {sql_r('transcription_opportunity', 3)} AS opportunity,
      {sql_r('transcription_direct', 3)} AS direct FROM costed""",
)
def transcription_cost(spark, sf_dir):
    """Opportunity at the first appearance, direct cost at every hour."""
    return costed_course(spark, sf_dir).select(
        "entity",
        "time",
        r(F.col("transcription_opportunity"), 3).alias("opportunity"),
        r(F.col("transcription_direct"), 3).alias("direct"),
    )


SQL_COPIES = "abundance_filled * 1774445e0 / 1e6"


@query(
    "translation_cost_length",
    f"""WITH {sql_costed_parts()}
    SELECT entity, {sql_r(SQL_COPIES + ' * protein_length_filled * 24e0', 3)} AS opportunity,
      {sql_r(SQL_COPIES + ' * protein_length_filled * 6e0', 3)} AS direct FROM costed""",
)
def translation_cost_length(spark, sf_dir):
    priced = costed_parts(spark, sf_dir, method="length")
    return priced.select(
        "entity",
        r(F.col("translation_opportunity"), 3).alias("opportunity"),
        r(F.col("translation_direct"), 3).alias("direct"),
    )


@query(
    "membrane_cost",
    f"""WITH g AS (SELECT p_partkey, p_retailprice + 1000e0 AS a, p_size * 20e0 + 100e0 AS b, pi() AS pi FROM part),
    m AS (SELECT p_partkey, (4 * pi * a * b / 0.65e0 + 4 * pi * ((a - 4e0) * (b - 4e0)) / 0.65e0) / 2e0 AS rod,
      4e0 * b / 0.65e0 / 2e0 + 4e0 * (b - 4e0) / 0.65e0 / 2e0 AS septum,
      (4 * pi * b * b + 4 * pi * (b - 3.5e0) * (b - 3.5e0)) / 2e0 AS sphere FROM g)
    SELECT p_partkey, {sql_r('rod * 212e0', 1)} AS membrane_opportunity, {sql_r('rod * 18e0', 1)} AS membrane_direct,
      {sql_r('septum * 212e0', 2)} AS septum_opportunity, {sql_r('septum * 18e0', 2)} AS septum_direct,
      {sql_r('rod * 230e0 / 6e0', 1)} AS recycled, {sql_r('sphere * 212e0', 1)} AS sphere_opportunity FROM m""",
)
def membrane_cost(spark, sf_dir):
    """Lipid cost of rod, septum and sphere for a table of cell sizes."""
    cells = table(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_retailprice") + 1000.0).alias("a"), (F.col("p_size") * 20.0 + 100.0).alias("b")
    )
    rod, septum, sphere = lipid_molecules("a", "b"), septum_lipids("b"), sphere_lipids("b")
    whole = lipid_cost(rod, "opportunity") + lipid_cost(rod, "direct")
    return cells.select(
        "p_partkey",
        r(lipid_cost(rod, "opportunity"), 1).alias("membrane_opportunity"),
        r(lipid_cost(rod, "direct"), 1).alias("membrane_direct"),
        r(lipid_cost(septum, "opportunity"), 2).alias("septum_opportunity"),
        r(lipid_cost(septum, "direct"), 2).alias("septum_direct"),
        r(whole / F.lit(DEFAULT.endospore_fraction), 1).alias("recycled"),
        r(lipid_cost(sphere, "opportunity"), 1).alias("sphere_opportunity"),
    )


@query(
    "dormant_cost",
    f"""WITH {SQL_ATTRIBUTES}, fact AS (SELECT {sql_fills(DORMANT)} FROM attr),
    c AS (SELECT abundance_filled / 1000e0 * 73411e0 / 1e6 * gene_length_filled AS mrna,
      abundance_filled * 73413e0 / 1e6 * protein_length_filled AS residues FROM fact)
    SELECT {sql_r('sum(mrna * 31e0) + sum(residues * 24e0)', 2)} AS opportunity,
      {sql_r('sum(mrna * 12e0) + sum(residues * 6e0)', 2)} AS direct,
      {sql_r('sum(mrna * 43e0) + sum(residues * 30e0)', 2)} AS total FROM c""",
)
def dormant_cost(spark, sf_dir):
    """A dormant spore: small protein pool, priced by length, one re-polymerisation."""
    fact = fill_attributes(attributes(spark, sf_dir), DORMANT)
    pool = DORMANT.but(proteins_per_cell=DORMANT_TRANSLATION_POOL)
    ab, gl, pl = F.col("abundance_filled"), F.col("gene_length_filled"), F.col("protein_length_filled")
    opportunity = transcription_opportunity(ab, gl, DORMANT) + translation_by_length(ab, pl, "opportunity", pool)
    direct = transcription_direct(ab, gl, 1.0, DORMANT) + translation_by_length(ab, pl, "direct", pool)
    return fact.agg(
        r(loose_sum(opportunity), 2).alias("opportunity"),
        r(loose_sum(direct), 2).alias("direct"),
        r(loose_sum(opportunity + direct), 2).alias("total"),
    )


@query(
    "sequence_cost",
    f"""SELECT doc_id, {sql_letters('text', 1)} AS seq_opportunity, {sql_letters('text', 2)} AS seq_direct
    FROM documents""",
)
def document_letters(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    return price_texts(texts, "text").select("doc_id", "seq_opportunity", "seq_direct")


@query(
    "dedupe_text",
    "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text",
)
def dedupe_text(spark, sf_dir):
    return lowest_per_text(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id")


@query(
    "selection_coefficient",
    f"""WITH {sql_costed_parts()}, long AS ({sql_long('costed', 'entity')}),
    known AS (SELECT c_custkey + 500 AS entity FROM customer WHERE c_mktsegment = 'BUILDING')
    SELECT entity, process, kind, {sql_r('cost / 2.6e10 * 0.69e0 * 1e9', 4)} AS sc_nano,
      {sql_r('-log10(cost / 2.6e10 * 0.69e0)', 6)} AS ne, 'known' AS mutant
    FROM long FULL JOIN known USING (entity) WHERE known.entity IS NOT NULL""",
)
def selection_coefficient(spark, sf_dir):
    """Selection coefficients joined to the known mutants from both sides, then the mutants alone."""
    joined = selection_of_known(
        flagged(spark, sf_dir), costed_parts(spark, sf_dir), "entity", DEFAULT.cell_budget, DEFAULT.selection_factor
    )
    return joined.select(
        "entity",
        "process",
        "kind",
        r(F.col("sc") * 1e9, 4).alias("sc_nano"),
        r(F.col("ne"), 6).alias("ne"),
        "mutant",
    )
