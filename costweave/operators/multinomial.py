"""Draws with replacement dealt out by a tree of binomial splits.

The rows are numbered in a random order and cut into leaves of ``LEAF`` neighbours. All n draws of a replicate start at
the root, which covers a power of two of leaves; each node sends a binomial share of its draws to its left half. Halves
that are full have chance 1/2, so a share is a number of random bits; the one node a level at the end of the index takes two
bits a draw. The counts that arrive are multinomial, and n draws cost about n / 60 digests a level
instead of n. A leaf then picks next to its rows, and sums by (leaf, replicate) are all that travels. No draw is
shuffled.

Every draw is a function of (seed, replicate, node), so results depend neither on partitions nor on retries. A picked
place of the last leaf comes from 60 bits modulo its rows; chances have 60 binary digits.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costweave.operators.ordered import dense_index
from costweave.session import cut_lineage, spread

#: Rows of a leaf: three hexadecimal digits pick one.
LEAF = 4096
LEAF_DIGITS = 3
WORD_BITS, WORD_DIGITS = 60, 15
#: Leaves are sent to the counts while their values are below this size, else both are shuffled by leaf.
BROADCAST_BYTES = 64 << 20
#: Draws whose words one row lists; where nodes have more, their words are dealt out over tasks.
DRAWS_AT_ONCE = 1 << 22
#: Picks that one row of a leaf turns into rows; a leaf with more is dealt out among tasks.
PICKS_AT_ONCE = 1 << 14


def root_width(n: int, leaf: int = LEAF) -> int:
    width = leaf
    while width < n:
        width *= 2
    return width


def number(digest: Column, first: int) -> Column:
    """The 60 bits of a digest that begin at a digit."""
    return F.conv(F.substring(digest, first, WORD_DIGITS), 16, 10).cast("long")


def word(*address: Column | str) -> Column:
    """60 random bits of an address."""
    parts = [a.cast("string") if isinstance(a, Column) else F.lit(a) for a in address]
    return number(F.md5(F.concat_ws(":", *parts)), 1)


def numbers(first: Column, past: Column) -> Column:
    """first .. past - 1; nothing where there is none."""
    return F.when(past > first, F.sequence(first, past - 1)).otherwise(F.array().cast("array<bigint>"))


def ones(count: Column, prefix: Column) -> Column:
    """Number of set bits among ``count`` random bits, whose words are numbered after the prefix of their address."""

    def set_bits(j: Column) -> Column:
        unused = F.lit(WORD_BITS) - F.least(F.lit(WORD_BITS), count - j * WORD_BITS).cast("int")
        digest = F.md5(F.concat(prefix, j.cast("string")))
        return F.bit_count(F.call_function("shiftright", number(digest, 1), unused)).cast("long")

    words = F.transform(numbers(F.lit(0).cast("long"), F.ceil(count / WORD_BITS)), set_bits)
    return F.aggregate(words, F.lit(0).cast("long"), lambda total, x: total + x)


def first_ones(nodes: DataFrame, seed: int, n: int, width: int, cut: bool) -> DataFrame:
    """(replicate, top, lo, draws, ones): how many of a node's draws have a first random bit that is set.

    A word is a row, so that it is worked out in compiled code and not by functions of arrays. Only the last word of a
    node becomes a number, to drop its unused bits; of the others the set bits are counted in their bytes. With ``cut``
    the words of a node are dealt out over tasks.
    """
    zero = F.lit(0).cast("long")
    # a node without a right half needs no bits; its one word keeps it among the rows
    words = F.when(F.lit(n) - F.col("lo") <= width // 2, F.lit(1).cast("long")).otherwise(F.ceil(F.col("draws") / WORD_BITS))
    prefix = F.concat(split_prefix(seed, width), F.lit("0:"))
    rows = nodes.select("replicate", "top", "lo", "draws", prefix.alias("prefix"), words.alias("words"))
    if cut:
        step = max(1, DRAWS_AT_ONCE // WORD_BITS)
        firsts = F.explode(F.sequence(zero, F.col("words") - 1, F.lit(step).cast("long")))
        rows = spread(rows.select("*", firsts.alias("first")), "replicate", "lo", "first")
        places = F.sequence("first", F.least(F.col("first") + step, F.col("words")) - 1)
    else:
        places = F.sequence(zero, F.col("words") - 1)
    rows = rows.select("replicate", "top", "lo", "draws", "prefix", F.explode(places).alias("j"))
    digest = F.md5(F.concat("prefix", F.col("j").cast("string")))
    rows = rows.select("replicate", "top", "lo", "draws", (F.col("draws") - F.col("j") * WORD_BITS).alias("left"), digest.alias("digest"))
    whole = F.bitmap_count(F.unhex(F.substring("digest", 1, WORD_DIGITS)))
    unused = F.lit(WORD_BITS) - F.col("left").cast("int")
    last = F.bit_count(F.call_function("shiftright", number(F.col("digest"), 1), unused)).cast("long")
    set_ = F.when(F.col("left") >= WORD_BITS, whole).otherwise(last)
    return rows.groupBy("replicate", "top", "lo", "draws").agg(F.sum(set_).alias("ones"))


def split_prefix(seed: int, width: int) -> Column:
    """The address of a node's words, up to the digit."""
    return F.concat(
        F.lit(f"split:{seed}:"), F.col("replicate").cast("string"), F.lit(f":{width}:"), F.col("lo").cast("string"), F.lit(":0:")
    )


def left_share(seed: int, n: int, width: int) -> Column:
    """How many of the draws of a node go to its left half, given the ``ones`` among their first random bits.

    In a node that is not full the chance is half / inside. Draws are compared with its binary digits one at a time:
    those whose random bit is the smaller go left, the larger right, and only equal ones need another bit.
    """
    half, inside = F.lit(width // 2).cast("long"), F.lit(n) - F.col("lo")
    if n % width <= width // 2:  # no node of the level is uneven
        return F.when(inside <= half, F.col("draws")).otherwise(F.col("ones"))

    def move(state: Column, u: Column) -> Column:
        doubled = state["rest"] * 2
        set_ = doubled >= inside
        return F.struct(
            (state["left"] + F.when(set_, state["open"] - u).otherwise(0)).alias("left"),
            F.when(set_, u).otherwise(state["open"] - u).alias("open"),
            (doubled - F.when(set_, inside).otherwise(0)).alias("rest"),
        )

    def compare(state: Column, digit: Column) -> Column:
        address = F.concat(split_prefix(seed, width), digit.cast("string"), F.lit(":"))
        return F.get(F.transform(F.array(ones(state["open"], address)), lambda u: move(state, u)), 0)

    start = F.struct(F.lit(0).cast("long").alias("left"), F.col("draws").alias("open"), half.alias("rest"))
    first = F.get(F.transform(F.array(start), lambda state: move(state, F.col("ones"))), 0)
    uneven = F.aggregate(F.sequence(F.lit(1), F.lit(WORD_BITS - 1)), first, compare)["left"]
    return F.when(inside <= half, F.col("draws")).when(inside >= width, F.col("ones")).otherwise(uneven)


def two_halves(half: int):
    def halves(left: Column) -> Column:
        lower = F.struct(F.col("lo"), left.alias("draws"))
        return F.array(lower, F.struct((F.col("lo") + half).alias("lo"), (F.col("draws") - left).alias("draws")))

    return halves


def leaf_counts(spark, n: int, replicates: int, seed: int, leaf: int = LEAF, draws: int | None = None) -> DataFrame:
    """(replicate, lo, draws): how often each replicate picks from the leaf that begins at row lo.

    A replicate draws as often as there are rows, unless ``draws`` is given. Levels follow each other in one task, whose
    rows have their replicate and their node ``top`` in common; only nodes with very many draws are dealt out.
    """
    draws = n if draws is None else draws
    start = spread(spark.range(1, replicates + 1).select(F.col("id").alias("replicate")), "replicate")
    first = F.pmod("replicate", F.lit(1))  # 0; as a literal it would turn the join by leaf into a product
    nodes = start.select("replicate", first.alias("top"), first.alias("lo"), F.lit(draws).cast("long").alias("draws"))
    width = root_width(n, leaf)
    dealt = True
    while width > leaf:
        cut = draws > DRAWS_AT_ONCE and width * draws > DRAWS_AT_ONCE * n
        if not (cut or dealt):
            nodes = spread(nodes.withColumn("top", F.col("lo")), "replicate", "top")
        dealt = not cut
        counted = first_ones(nodes, seed, n, width, cut)
        # bound by a lambda, so that it is worked out once
        both = F.flatten(F.transform(F.array(left_share(seed, n, width)), two_halves(width // 2)))
        split = counted.select("replicate", "top", F.explode(both).alias("half"))
        nodes = split.select("replicate", "top", "half.lo", "half.draws").where("draws > 0")
        width //= 2
    return nodes.select("replicate", "lo", "draws")


def leaf_sums(counts: DataFrame, leaves: DataFrame, seed: int, n: int) -> DataFrame:
    """(replicate, total) of picks in leaves (lo, values). A digest holds several picks, which are added up in its row."""
    full = F.col("lo") + LEAF <= n
    in_full, in_last = 32 // LEAF_DIGITS, 32 // WORD_DIGITS
    per_digest = F.when(full, F.lit(in_full)).otherwise(F.lit(in_last))
    last = F.floor((F.col("draws") - 1) / per_digest)
    prefix = F.concat(F.lit(f"pick:{seed}:"), F.col("replicate").cast("string"), F.lit(":"), F.col("lo").cast("string"), F.lit(":"))
    held = counts.join(leaves, "lo").select(
        "replicate", "draws", "values", full.alias("full"), per_digest.alias("per_digest"), prefix.alias("prefix"), last.alias("last")
    )
    blocks = held.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("block"))
    digest = F.md5(F.concat("prefix", F.col("block").cast("string")))
    left = F.col("draws") - F.col("block") * F.col("per_digest")
    marked = blocks.select("replicate", "values", "full", left.alias("left"), digest.alias("digest"))
    words = [number(F.col("digest"), 1 + k * WORD_DIGITS).alias(f"word{k}") for k in range(in_last)]
    numbered = marked.select("replicate", "values", "full", "left", *words)

    def added(places: list[Column]) -> Column:
        """Of the first ``left`` places."""
        values = [F.coalesce(F.get("values", place.cast("int")), F.lit(0.0)) for place in places]
        return reduce(add, [F.when(F.col("left") > k, v).otherwise(F.lit(0.0)) for k, v in enumerate(values)])

    each = WORD_DIGITS // LEAF_DIGITS
    digits = [
        F.call_function("shiftright", F.col(f"word{w}"), F.lit(4 * LEAF_DIGITS * (each - 1 - k))).bitwiseAND(F.lit(LEAF - 1))
        for w in range(in_last)
        for k in range(each)
    ]
    wide = [F.pmod(F.col(f"word{w}"), F.size("values")) for w in range(in_last)]
    total = F.when(F.col("full"), added(digits)).otherwise(added(wide))
    return numbered.groupBy("replicate").agg(F.sum(total).alias("total"))


def stored_rows(sample: DataFrame, key: str, value: str) -> tuple[DataFrame, int]:
    """The rows as (__key, __value), stored, and their number."""
    rows = cut_lineage(sample.select(F.col(key).alias("__key"), F.col(value).cast("double").alias("__value")))
    return rows, rows.count()


def packed_leaves(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """(lo, values): the values of each leaf in the order of their index; sent to every task if they are few."""
    lo = F.col("index") - F.pmod("index", F.lit(LEAF))
    placed = dense_index(rows, "__key", seed).select(lo.alias("lo"), "index", "__value")
    packed = placed.groupBy("lo").agg(F.array_sort(F.collect_list(F.struct("index", "__value"))).alias("m"))
    leaves = packed.select("lo", F.col("m.__value").alias("values"))
    return F.broadcast(leaves) if n * 8 <= BROADCAST_BYTES else leaves


def bootstrap_sums(sample: DataFrame, key: str, value: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, total): sum of n values drawn with replacement from n rows, for each replicate. Runs a count."""
    spark = sample.sparkSession
    rows, n = stored_rows(sample, key, value)
    if not n:
        return spark.range(1, replicates + 1).select(F.col("id").alias("replicate"), F.lit(0.0).alias("total"))
    leaves = packed_leaves(rows, n, seed)
    counts = leaf_counts(spark, n, replicates, seed)
    return leaf_sums(counts, leaves, seed, n)


def drawn_values(sample: DataFrame, key: str, value: str, draws: int, seed: int) -> DataFrame:
    """(leaf, draw, value): ``draws`` values picked with replacement from the rows of ``sample``. Runs a count.

    The number of draws is free of the number of rows. The tree tells each leaf how many draws are its own, and they are
    numbered and picked next to its values, so no draw is shuffled to find its row. ``key`` is unique; missing
    values are picked like others. A table without rows gives no draws.
    """
    if draws < 0:
        raise ValueError("the number of draws is 0 or more")
    rows, n = stored_rows(sample, key, value)
    if not n or not draws:
        return rows.limit(0).select(
            F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("draw"), F.col("__value").alias("value")
        )
    counts = leaf_counts(sample.sparkSession, n, 1, seed, draws=draws)
    firsts = F.sequence(F.lit(0).cast("long"), F.col("draws") - 1, F.lit(PICKS_AT_ONCE).cast("long"))
    pieces = counts.select("lo", "draws", F.explode(firsts).alias("first"))
    if n * 8 <= BROADCAST_BYTES:
        pieces = spread(pieces, "lo", "first")  # else the join by leaf deals them out
    last = F.least(F.col("first") + PICKS_AT_ONCE, F.col("draws")) - 1
    picks = pieces.join(packed_leaves(rows, n, seed), "lo").select(
        "lo", "values", F.explode(F.sequence("first", last)).alias("draw")
    )
    place = F.pmod(word("pick", str(seed), F.col("lo"), F.col("draw")), F.size("values")).cast("int")
    return picks.select(F.col("lo").alias("leaf"), "draw", F.get("values", place).alias("value"))


def word_sql(address: str) -> str:
    return f"('0x' || substr(md5({address}), 1, {WORD_DIGITS}))::BIGINT"


def sql_tree(table: str, key: str, value: str, replicates: int, seed: int, draws: str = "n") -> str:
    """The tree as common table expressions that end in ``picks`` (replicate, lo, room, j)."""
    node = f"'split:{seed}:' || replicate || ':' || width || ':' || lo || ':0:' || digit || ':' || j"
    bits = f"""coalesce(list_sum(list_transform(range(0, (open + {WORD_BITS - 1}) // {WORD_BITS}),
              lambda j: bit_count({word_sql(node)} >> ({WORD_BITS} - least({WORD_BITS}, open - {WORD_BITS} * j))::BIGINT))), 0)::BIGINT"""
    return f"""indexed AS MATERIALIZED (SELECT {value} AS value, row_number() OVER (ORDER BY md5('{seed}:' || {key}), {key}) - 1 AS i FROM {table}),
    size AS (SELECT count(*)::BIGINT AS n FROM indexed),
    tree AS (
      SELECT replicate, 0::BIGINT AS lo, ({LEAF} * pow(2, greatest(0, ceil(log2(n / {LEAF}e0)))))::BIGINT AS width, {draws} AS draws,
        0 AS digit, 0::BIGINT AS gone, {draws} AS open, 0::BIGINT AS rest
      FROM size, (SELECT unnest(range(1, {replicates + 1})) AS replicate) WHERE n > 0
      UNION ALL
      SELECT replicate, next.lo, next.width, next.draws, next.digit, next.gone, next.open, next.rest FROM (
        SELECT replicate, unnest(CASE WHEN uneven AND digit < {WORD_BITS} AND open > 0
            THEN [{{'lo': lo, 'width': width, 'draws': draws, 'digit': digit + 1, 'gone': gone + CASE WHEN up THEN open - u ELSE 0 END,
              'open': CASE WHEN up THEN u ELSE open - u END, 'rest': doubled - CASE WHEN up THEN room ELSE 0 END}}]
            ELSE [{{'lo': lo, 'width': half, 'draws': part, 'digit': 0, 'gone': 0::BIGINT, 'open': part, 'rest': 0::BIGINT}},
              {{'lo': lo + half, 'width': half, 'draws': draws - part, 'digit': 0, 'gone': 0::BIGINT, 'open': draws - part, 'rest': 0::BIGINT}}] END) AS next
        FROM (SELECT *, doubled >= room AS up, CASE WHEN room <= half THEN draws WHEN uneven THEN gone ELSE u END AS part
          FROM (SELECT *, n - lo AS room, width // 2 AS half, n - lo > width // 2 AND n - lo < width AS uneven,
              2 * CASE WHEN digit = 0 THEN width // 2 ELSE rest END AS doubled, {bits} AS u
            FROM tree, size WHERE width > {LEAF} AND draws > 0))) WHERE next.draws > 0),
    picks AS (SELECT replicate, lo, n - lo AS room, unnest(range(0, draws)) AS j FROM tree, size WHERE width = {LEAF})"""


def sql_bootstrap(table: str, key: str, value: str, replicates: int, seed: int) -> str:
    """``bootstrap_sums`` as common table expressions that end in ``drawn`` (replicate, total)."""
    return f"""{sql_tree(table, key, value, replicates, seed)},
    places AS (SELECT replicate, lo + CASE WHEN room >= {LEAF}
        THEN ('0x' || substr(md5('pick:{seed}:' || replicate || ':' || lo || ':' || j // {32 // LEAF_DIGITS}), (1 + {LEAF_DIGITS} * (j % {32 // LEAF_DIGITS}))::BIGINT, {LEAF_DIGITS}))::BIGINT
        ELSE ('0x' || substr(md5('pick:{seed}:' || replicate || ':' || lo || ':' || j // {32 // WORD_DIGITS}), (1 + {WORD_DIGITS} * (j % {32 // WORD_DIGITS}))::BIGINT, {WORD_DIGITS}))::BIGINT % room
        END AS i FROM picks),
    drawn AS (SELECT replicate, sum(value) AS total FROM places JOIN indexed USING (i) GROUP BY replicate)"""


def sql_drawn(table: str, key: str, value: str, draws: int, seed: int) -> str:
    """``drawn_values`` as common table expressions that end in ``drawn`` (leaf, draw, value)."""
    place = word_sql(f"'pick:{seed}:' || lo || ':' || j")
    return f"""{sql_tree(table, key, value, 1, seed, f"{draws}::BIGINT")},
    places AS (SELECT lo AS leaf, j AS draw, lo + {place} % least(room, {LEAF}) AS i FROM picks),
    drawn AS (SELECT leaf, draw, value FROM places JOIN indexed USING (i))"""
