"""Cross-document line frequency, in SQL functions only.

Lines are normalised and hashed. For each host the different documents with a line are counted (equal texts are one
document); a line in more than ``MIN_DOCS`` documents, or in more than ``FEW_DOCS`` and more than ``MAX_SHARE`` of its
host's documents, is removed wherever it stands. A document that loses more than ``MAX_LOST`` of its words is depleted and rejected, next to the
base rules on words and repeated windows.

Defined cases: null text has no words and fails the base rules; a null host is a host of its own; equal rows get equal
results; a line without a word is never counted; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costweave.llm.common import SPACE, table, words
from costweave.llm.registry import query

#: A line is boilerplate of a host above either limit: a number of documents, or a share of them that are not too few.
MIN_DOCS = 10
FEW_DOCS = 3
MAX_SHARE = 0.1
#: Share of its words that a kept document may lose.
MAX_LOST = 0.2
#: Base rules.
LEAST_WORDS = 50
MOST_REPEATED = 0.5
WINDOW = 3
SYMBOLS = "[#*$%&|<>]"


def normal_line(line: Column) -> Column:
    """Lower case, every digit 0, runs of white space one blank, none at the ends."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), f"[{SPACE}]+", " ")
    return F.trim(plain)


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(f"[^{SPACE}]"))


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. Every step is one row's own work.

    A word counts as repeated if it stands in a window of three words that occurs twice or more. Windows are hashed to
    64 bits and sorted with their places; equal neighbours give the repeated places, whose cover is summed.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = lines_with_words(F.col(text))
    counted = docs.select(
        "*",
        words(F.col(text)).alias("__words"),
        F.length(F.translate(whole, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.regexp_replace(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
    )
    n = F.size("__words")
    hashes = F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.xxhash64(*[F.get("__words", i + k) for k in range(WINDOW)]),
    )
    none = F.array().cast("array<bigint>")
    hashed = counted.select(
        *docs.columns,
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, hashes).otherwise(none).alias("__hashes"),
    )
    kept = [*docs.columns, "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    placed = F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    sorted_places = hashed.select(
        *kept,
        F.when(F.size(F.array_distinct("__hashes")) < F.size("__hashes"), F.array_sort(placed)).alias("__sorted"),
    )
    repeated = F.filter(
        "__sorted",
        lambda s, i: F.coalesce(F.get("__sorted", i - 1)["h"] == s["h"], F.lit(False))
        | F.coalesce(F.get("__sorted", i + 1)["h"] == s["h"], F.lit(False)),
    )
    places = sorted_places.select(*kept, F.array_sort(F.transform(repeated, lambda s: s["i"])).alias("__places"))
    cover = F.transform(
        "__places",
        lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("__places", i + 1) - p, F.lit(WINDOW))).cast("long"),
    )
    covered = F.aggregate(cover, F.lit(0).cast("long"), lambda a, b: a + b)
    return places.select(*kept, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def line_rows(docs: DataFrame, text: str, host: str) -> DataFrame:
    """(host, line, document, words) per line with a word; host and line are one 64-bit key, as is the document."""
    document = F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(host))
    lines = docs.select(
        F.col(host).alias("__host"), document.alias("__document"), F.explode(lines_with_words(F.col(text))).alias("__line")
    )
    return lines.select(
        F.xxhash64(normal_line(F.col("__line")), F.col("__host")).alias("__line"),
        F.xxhash64("__host").alias("__host"),
        "__document",
        F.size(words(F.col("__line"))).cast("long").alias("__words"),
    )


def removed_words(
    docs: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE
) -> DataFrame:
    """(document, removed, lines): words in lines above the limits, and their keys, per document that loses some.

    The lines of a document are summed before they are counted, and a line's count starts from one row per task, so
    neither a frequent line nor a much copied document meets in a task. Only counts above the limits are joined back.
    """
    document = F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(host)).alias("__document")
    copies = docs.select(document, F.xxhash64(host).alias("__host")).groupBy("__document", "__host").agg(
        F.count(F.lit(1)).alias("__copies")
    )
    hosts = copies.groupBy("__host").agg(F.count(F.lit(1)).alias("__docs"))
    per_document = line_rows(docs, text, host).groupBy("__line", "__document", "__host").agg(
        F.sum("__words").alias("__words")
    )
    counts = per_document.groupBy("__line", "__host").agg(F.count(F.lit(1)).alias("__with"))
    least = min(min_docs, FEW_DOCS)  # most lines stand in one document and leave here
    shared = counts.where(F.col("__with") > least).join(hosts, "__host")
    by_share = (F.col("__with") > FEW_DOCS) & (F.col("__with") > F.col("__docs") * F.lit(max_share))
    frequent = shared.where((F.col("__with") > min_docs) | by_share).select("__line")
    lost = per_document.join(frequent, "__line", "left_semi").groupBy("__document").agg(
        F.sum("__words").alias("__lost"), F.collect_set("__line").alias("__lines")
    )
    return lost.join(copies, "__document").select(
        "__document", (F.col("__lost") / F.col("__copies")).cast("long").alias("removed"), "__lines"
    )


def without_frequent_lines(docs: DataFrame, text: str = "text", host: str = "source", **limits) -> DataFrame:
    """The documents with their texts rid of lines above the limits; every row and column stays."""
    columns = docs.columns
    document = F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(host)).alias("__document")
    joined = docs.select("*", document).join(removed_words(docs, text, host, **limits), "__document", "left")
    frequent = F.coalesce("__lines", F.array().cast("array<bigint>"))
    left = F.filter(
        F.split(text, "\n"),
        lambda line: ~line.rlike(f"[^{SPACE}]") | ~F.array_contains(frequent, F.xxhash64(normal_line(line), F.col(host))),
    )
    cleaned = F.when(F.col("removed") > 0, F.array_join(left, "\n")).otherwise(F.col(text))
    return joined.withColumn(text, cleaned).select(*columns)


def judge_documents(docs: DataFrame, text: str = "text", host: str = "source", **limits) -> DataFrame:
    """Base counts, removed words and verdict of every row; text and host are dropped on the way."""
    document = F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(host)).alias("__document")
    counted = base_counts(docs.select("*", document), text).drop(text, host)
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > int(100 * MOST_REPEATED) * F.col("n_words")
    )
    removed = F.coalesce(F.col("removed"), F.lit(0).cast("long"))
    joined = counted.join(removed_words(docs, text, host, **limits), "__document", "left").drop("__document", "__lines")
    return joined.withColumn("removed", removed).withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (F.col("removed") <= F.col("n_words") * F.lit(MAX_LOST))
    )


SQL_QUALITY = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
word AS (
  SELECT r, w, row_number() OVER (PARTITION BY r ORDER BY k) AS p FROM (
    SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS k
    FROM (SELECT r, regexp_split_to_array(text, '[{SPACE}]+') AS ws FROM docs)) WHERE w <> ''),
win AS (
  SELECT r, p, [w, lead(w, 1) OVER a, lead(w, 2) OVER a] AS x, count(*) OVER (PARTITION BY r) AS n
  FROM word WINDOW a AS (PARTITION BY r ORDER BY p)),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, x) AS c FROM win WHERE p <= n - 2) WHERE c > 1),
repeated AS (
  SELECT r, count(DISTINCT p + o) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY r),
counted AS (SELECT r, count(*) AS n_words, CAST(sum(length(w)) AS BIGINT) AS word_chars FROM word GROUP BY r),
line AS (SELECT r, source, text, unnest(string_split(text, chr(10))) AS line FROM docs),
worded AS (
  SELECT r, source, text, line, length(regexp_replace(regexp_replace(line, '[^{SPACE}]+', 'x', 'g'),
      '[{SPACE}]+', '', 'g')) AS n,
    trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[{SPACE}]+', ' ', 'g'), ' ') AS normal
  FROM line WHERE regexp_matches(line, '[^{SPACE}]')),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY r),
hosts AS (SELECT source, count(DISTINCT text) AS docs FROM docs GROUP BY source),
frequent AS (
  SELECT w.source, normal FROM (
    SELECT source, normal, count(DISTINCT text) AS c FROM worded GROUP BY source, normal) w
  JOIN hosts h ON w.source IS NOT DISTINCT FROM h.source WHERE c > {MIN_DOCS} OR c > {FEW_DOCS} AND c > docs * {MAX_SHARE}e0),
lost AS (
  SELECT r, sum(n) AS removed FROM worded w
  WHERE EXISTS (FROM frequent f WHERE f.source IS NOT DISTINCT FROM w.source AND f.normal = w.normal) GROUP BY r),
judged AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    CAST(coalesce(removed, 0) AS BIGINT) AS removed
  FROM docs LEFT JOIN counted USING (r) LEFT JOIN repeated USING (r) LEFT JOIN dups USING (r) LEFT JOIN lost USING (r))
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {int(100 * MOST_REPEATED)} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {int(100 * MOST_REPEATED)} * n_words)
    AND removed <= n_words * {MAX_LOST}e0 AS kept
FROM judged"""


@query("op2_line_quality", SQL_QUALITY)
def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and line frequency over all documents; a document's host is its source."""
    return judge_documents(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
