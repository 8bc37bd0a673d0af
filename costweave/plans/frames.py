"""The tables at hand in the roles the cost model needs, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costweave.operators.costs import COST_COLUMNS, price_sequences, with_costs
from costweave.operators.fill import fill_attributes
from costweave.operators.reshape import columns_with_prefix, first_positive, to_long, widen
from costweave.operators.resolve import left_attach
from costweave.params import DEFAULT, RESIDUE_PRICES, CostParams


SCHEMAS = {
    "lineitem": """l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double,
        l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,
        l_shipdate timestamp_ntz""",
    "orders": """o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string""",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its declared schema, so that no footer is read to infer one."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


#: Years a wide course may span, one column each. A date far outside the others is an error of the table.
MOST_YEARS = 200


def year_span(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """First and last year of the line items: an hour of the course is a year, counted from the first as 1."""
    dates = table(spark, sf_dir, "lineitem").agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
    first, last = dates.select(F.year("first"), F.year("last")).first()
    if first is None:
        return 1, 1
    if last - first >= MOST_YEARS:
        raise ValueError(f"line items from {first} to {last} make more than {MOST_YEARS} columns of years")
    return first, last


def hour_labels(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """Column ``t<hour>`` of every year of the table. Two numbers come from the data, so that columns can be named."""
    first, last = year_span(spark, sf_dir)
    return {f"t{year - first + 1}": year for year in range(first, last + 1)}


def quantity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide time matrix: ordered quantity per part, one column per year of the table."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("entity"), F.year("l_shipdate").alias("year"), "l_quantity"
    )
    return widen(lines, "entity", F.col("year"), F.col("l_quantity"), hour_labels(spark, sf_dir))


def quantity_course(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form, positive values only, with the hour as a number and the first appearance flagged.

    The first hour of a part is read off its wide row, so the course needs no sort and no second shuffle.
    """
    wide = quantity_matrix(spark, sf_dir)
    columns = columns_with_prefix(wide, "t")
    hours = {c: int(c.removeprefix("t")) for c in columns}
    marked = wide.withColumn("first", first_positive(columns, hours).cast("long"))
    long = to_long(marked, ["entity", "first"], columns, labels=hours).where("value > 0")
    return long.select("entity", "time", "value", (F.col("time") == F.col("first")).alias("is_first"))


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes per part, with gaps."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    priced = price_sequences(parts, "p_name")
    length = F.when(F.col("p_size") % 7 != 0, F.col("p_size") * F.lit(10.0))
    return priced.select(
        F.col("p_partkey").alias("entity"),
        "p_brand",
        "p_type",
        F.col("p_size").cast("long").alias("p_size"),
        F.when(F.col("p_size") > 10, F.col("p_retailprice")).alias("abundance"),
        length.alias("gene_length"),
        F.floor(length / 3).cast("double").alias("protein_length"),
        F.when(F.col("p_size") % 5 != 0, F.col("seq_opportunity")).alias("seq_opportunity"),
        F.when(F.col("p_size") % 5 != 0, F.col("seq_direct")).alias("seq_direct"),
    )


def costed_parts(spark: SparkSession, sf_dir: str, params: CostParams = DEFAULT, **options) -> DataFrame:
    """Every part once, filled and costed."""
    return with_costs(fill_attributes(attributes(spark, sf_dir), params), params, **options)


def costed_course(spark: SparkSession, sf_dir: str, params: CostParams = DEFAULT, **options) -> DataFrame:
    """Part and hour rows, filled and costed; all but direct transcription count at the first appearance."""
    fact = left_attach(quantity_course(spark, sf_dir), attributes(spark, sf_dir), ["entity"])
    return with_costs(fill_attributes(fact, params), params, once="is_first", **options)


# SQL counterparts ----------------------------------------------------------------------------------------------------


def sql_letters(text: str, place: int) -> str:
    upper = f"translate({text}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
    terms = [f"(length({upper}) - length(replace({upper}, '{row[0]}', ''))) * {row[place]}" for row in RESIDUE_PRICES]
    return "CAST(" + " + ".join(terms) + " AS DOUBLE)"


SQL_ATTRIBUTES = f"""
attr AS (
  SELECT p_partkey AS entity, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size,
    CASE WHEN p_size > 10 THEN p_retailprice END AS abundance,
    CASE WHEN p_size % 7 <> 0 THEN p_size * 10e0 END AS gene_length,
    CASE WHEN p_size % 7 <> 0 THEN floor(p_size * 10e0 / 3) END AS protein_length,
    CASE WHEN p_size % 5 <> 0 THEN {sql_letters('p_name', 1)} END AS seq_opportunity,
    CASE WHEN p_size % 5 <> 0 THEN {sql_letters('p_name', 2)} END AS seq_direct
  FROM part)"""

SQL_HOUR = "year(l_shipdate) - (SELECT min(year(l_shipdate)) FROM lineitem) + 1"

SQL_COURSE = f"""
course AS (
  SELECT entity, time, sum(l_quantity) AS value
  FROM (SELECT l_partkey AS entity, {SQL_HOUR} AS time, l_quantity FROM lineitem)
  GROUP BY entity, time HAVING sum(l_quantity) > 0)"""


def sql_fills(p: CostParams = DEFAULT) -> str:
    return f"""
    coalesce(abundance, {p.fill_abundance}e0) AS abundance_filled,
    coalesce(gene_length, {p.fill_gene_length}e0) AS gene_length_filled,
    coalesce(protein_length, {p.fill_protein_length}e0) AS protein_length_filled,
    coalesce(seq_opportunity, {p.fill_seq_opportunity}e0) AS seq_opportunity_filled,
    coalesce(seq_direct, {p.fill_seq_direct}e0) AS seq_direct_filled"""


def sql_costs(p: CostParams = DEFAULT, hours: str = "1e0", once: str | None = None) -> str:
    """The six cost expressions of a filled row."""
    mrna = f"abundance_filled / {p.proteins_per_mrna}e0 * {p.proteins_per_cell}e0 / 1e6"
    length = " * gene_length_filled" if p.opportunity_uses_length else ""
    copies = f"abundance_filled * {p.proteins_per_cell}e0 / 1e6"
    rounds = f"{p.polymerisation}e0 + {p.repolymerisation * p.turnover_per_hour}e0 * {hours}"
    formulas = {
        "replication_opportunity": "2e0 * gene_length_filled * 35e0",
        "replication_direct": "2e0 * gene_length_filled * 14e0",
        "transcription_opportunity": f"{mrna}{length} * 31e0",
        "transcription_direct": f"{mrna} * gene_length_filled * ({rounds})",
        "translation_opportunity": f"{copies} * seq_opportunity_filled",
        "translation_direct": f"{copies} * seq_direct_filled",
    }
    if once:
        formulas = {
            name: f if name == "transcription_direct" else f"CASE WHEN {once} THEN {f} ELSE 0e0 END"
            for name, f in formulas.items()
        }
    return ", ".join(f"{f} AS {name}" for name, f in formulas.items())


def sql_costed_course(p: CostParams = DEFAULT, hours: str = "1e0") -> str:
    return f"""{SQL_ATTRIBUTES},{SQL_COURSE},
fact AS (
  SELECT course.*, p_brand, p_type, p_size, time = min(time) OVER (PARTITION BY entity) AS is_first, {sql_fills(p)}
  FROM course LEFT JOIN attr USING (entity)),
costed AS (SELECT *, {sql_costs(p, hours, 'is_first')} FROM fact)"""


def sql_costed_parts(p: CostParams = DEFAULT) -> str:
    return f"""{SQL_ATTRIBUTES},
fact AS (SELECT *, {sql_fills(p)} FROM attr),
costed AS (SELECT *, {sql_costs(p)} FROM fact)"""


def sql_long(source: str, keys: str) -> str:
    """(keys, process, kind, cost) rows of a costed source."""
    head = f"{keys}, " if keys else ""
    parts = []
    for name in COST_COLUMNS:
        process, kind = name.split("_")
        parts.append(f"SELECT {head}'{process}' AS process, '{kind}' AS kind, {name} AS cost FROM {source}")
    return " UNION ALL ".join(parts)
