"""Jaccard joins up to a distance limit: exact by prefix filtering, or by MinHash bands with a chosen recall.

Rows with equal sets of columns are one class; a class is represented by its least row and only representatives are
paired, so copies cost one row each. Both joins end in the same exact count of shared columns.

Exact join: with similarity ``t`` two sets must share ``ceil(t / (1 + t) * (|x| + |y|))`` columns, so in any fixed order
of the columns they share one among the first ``|x| - ceil(t |x|) + 1`` of the larger set and the first
``|y| - ceil(2 t / (1 + t) |y|) + 1`` of the smaller. The order is by rarity, so popular columns stay out of these
prefixes. Matches in the prefixes are counted; what lies behind both prefixes bounds the rest, and only pairs that can
still reach the limit are verified. Columns are dealt out in groups of bounded size, and one task holds the rows of each of its
group's columns: it counts the matches row by row and lets a pair travel only if it has its share of the matches asked for
in this group, as a pair below that in every group cannot reach the limit.

MinHash: the probability that two sets have the same least hash is their similarity. ``bands`` groups of ``rows``
hashes make a pair of the limiting similarity a candidate with at least the asked recall, closer pairs with more.

A set is one array of its row, which bounds a row's columns; sets far apart in size never meet. Null rows or columns are
left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costweave.functions.draws import draw32
from costweave.session import cut_lineage, release

#: Slack against rounding where a bound is computed; the last check is exact.
SLACK = 1e-9
#: Sets above this size are indexed by the longer prefix: counting more matches leaves few pairs with long sets to verify.
LARGE = 64
#: Sets up to this size are met by two columns at once: at most 28 combinations at a limit of 0.5.
SMALL = 12
#: Cells of the prefixes in a group of columns, and matches of columns that are counted at once.
CELLS_OF_GROUP = 1 << 23
MATCHES_AT_ONCE = 1 << 21
#: Prime modulus of the hash family.
PRIME = 2**31 - 1
MOST_HASHES = 128
RECALL = 0.95


class SetClasses:
    """The different sets of a presence table.

    ``sets``: (row, size, cols) of each representative, stored when first asked for. ``members``: (row, class_row, members) of
    every row.
    """

    def __init__(self, presence: DataFrame, row: str, column: str):
        cells = presence.select(F.col(row).alias("row"), F.col(column).alias("col")).dropna()
        sets = cells.groupBy("row").agg(F.array_sort(F.collect_set("col")).alias("cols"))
        digest = F.struct(F.size("cols").alias("n"), F.xxhash64("cols").alias("a"), F.xxhash64(F.lit("2"), "cols").alias("b"))
        self.marked = sets.withColumn("digest", digest)

    @cached_property
    def sets(self) -> DataFrame:
        least = self.marked.groupBy("digest").agg(F.min("row").alias("row"), F.first("cols").alias("cols"))
        return cut_lineage(least.select("row", F.size("cols").alias("size"), "cols"))

    @cached_property
    def members(self) -> DataFrame:
        marked = cut_lineage(self.marked.select("row", "digest"))
        classes = marked.groupBy("digest").agg(F.min("row").alias("class_row"), F.count(F.lit(1)).alias("members"))
        return marked.join(classes, "digest").select("row", "class_row", "members")


def ceiling(c: Column) -> Column:
    return F.ceil(c - F.lit(SLACK)).cast("int")


def least_shared(t: float, x: Column, y: Column) -> Column:
    """Columns that sets of these sizes share at least within the limit."""
    return ceiling(F.lit(t / (1.0 + t)) * (x + y))


def rare_first(sets: DataFrame) -> DataFrame:
    """(row, size, tokens): the columns of each set, those of the fewest sets first."""
    cells = sets.select("row", "size", F.explode("cols").alias("col"))
    counts = cells.groupBy("col").agg(F.count(F.lit(1)).alias("n"))
    ordered = cells.join(counts, "col").groupBy("row", "size")
    return ordered.agg(F.array_sort(F.collect_list(F.struct("n", "col"))).alias("tokens")).select("row", "size", "tokens.col")


def prefix_candidates(sets: DataFrame, most_distance: float) -> DataFrame:
    """(x, y) of representatives that may be within the limit; x is the larger set."""
    return ordered_candidates(cut_lineage(rare_first(sets)), most_distance)


def ordered_candidates(ordered: DataFrame, most_distance: float) -> DataFrame:
    t = limit_similarity(most_distance)
    return two_column_candidates(ordered, t).unionByName(one_column_candidates(ordered, t)).distinct()


def index_end(t: float, size: Column) -> Column:
    """How many columns of a set of this size are indexed."""
    least = size - ceiling(F.lit(2.0 * t / (1.0 + t)) * size) + 1
    return F.when(size > LARGE, size - ceiling(F.lit(t) * size) + 1).otherwise(least)


def sizes_allow(t: float) -> Column:
    """x is the larger set, and y is not too small for it."""
    smaller = (F.col("ny") < F.col("nx")) | ((F.col("ny") == F.col("nx")) & (F.col("y") < F.col("x")))
    return smaller & (F.col("ny") >= F.lit(t) * F.col("nx") - F.lit(SLACK))


def two_column_candidates(ordered: DataFrame, t: float) -> DataFrame:
    """Pairs with x of at most ``SMALL`` columns that must share two or more: they share the same two in prefixes of one
    column more, and few sets share two columns by chance."""
    size = F.col("size")

    def side(least: Column, row: str, n: str) -> DataFrame:
        length = size - F.greatest(F.lit(2), ceiling(least)) + 2
        tokens = F.slice("col", 1, length)
        rest = F.transform(tokens, lambda a, i: F.transform(F.slice(tokens, i + 2, length), lambda b: F.struct(a.alias("a"), b.alias("b"))))
        held = ordered.where(size.between(2, SMALL))
        return held.select(F.col("row").alias(row), size.alias(n), F.explode(F.flatten(rest)).alias("two")).select(row, n, "two.*")

    probe = side(F.lit(t) * size, "x", "nx")
    index = side(F.lit(2.0 * t / (1.0 + t)) * size, "y", "ny")
    return probe.join(index, ["a", "b"]).where(sizes_allow(t)).select("x", "y")


def one_column_candidates(ordered: DataFrame, t: float) -> DataFrame:
    """The other pairs: x is above ``SMALL``, or one shared column is enough."""
    size = F.col("size")
    probe_length = size - ceiling(F.lit(t) * size) + 1
    index_length = index_end(t, size)
    tiny = 1.0 / t + SLACK
    probing = (size > SMALL) | (size <= F.lit(tiny))
    indexed = (size >= F.lit(t * (SMALL + 1) - SLACK)) | (size <= F.lit(tiny))
    # the prefix of the index is never longer than that of the probe
    length = F.when(probing, probe_length).otherwise(index_length)
    held = ordered.where(probing | indexed).select(
        F.monotonically_increasing_id().alias("id"),
        size.cast("int").alias("size"),
        probing.alias("probing"),
        F.when(indexed, index_length).otherwise(0).cast("int").alias("indexed"),
        F.slice("col", 1, length).alias("cols"),
        "row",
    )
    cells = held.agg(F.coalesce(F.sum(F.size("cols")), F.lit(0))).first()[0]
    groups = int(cells) // CELLS_OF_GROUP + 1
    # few groups are copied to as many tasks as there are cores, each of which counts for its share of the rows
    shares = -(-ordered.sparkSession.sparkContext.defaultParallelism // groups)
    parts = held.select("id", "size", "probing", "indexed", F.transform("cols", lambda c: F.xxhash64(c)).alias("cols"))
    parts = parts.mapInArrow(
        cells_by_group(groups),
        "g int, id array<long>, size array<int>, probing array<boolean>, cells array<int>, first array<int>, cols array<int>",
    )
    dealt = parts.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).withColumn(
        "task", (F.col("g") * shares + F.col("share")).cast("int")
    )
    dealt = dealt.repartitionById(groups * shares, "task").drop("task")
    found = dealt.mapInArrow(
        matches_of_group(t, groups, shares, LARGE, SMALL, SLACK, MATCHES_AT_ONCE), "x long, y long, nx int, ny int, found int"
    )
    if groups > 1:
        need = needed_matches(t, F.col("nx"), F.col("ny"))
        # groups that let a pair go have one match less than its share, at most
        rest = (F.lit(groups) - F.col("groups")) * (F.ceil(need / F.lit(groups)) - 1)
        counted = found.groupBy("x", "y", "nx", "ny").agg(F.sum("found").alias("found"), F.count(F.lit(1)).alias("groups"))
        found = counted.where(F.col("found") + rest >= need)
    # stored, so that matches are not counted again by whoever asks for the plan twice
    found = cut_lineage(found.select("x", "y", "nx", "ny"))
    names = held.select("id", "row")
    pairs = found.join(names.withColumnsRenamed({"id": "x", "row": "rx"}), "x").join(
        names.withColumnsRenamed({"id": "y", "row": "ry"}), "y"
    )
    # of sets of one size the greater row is x, as in the other join
    even = F.col("nx") == F.col("ny")
    return pairs.select(
        F.when(even, F.greatest("rx", "ry")).otherwise(F.col("rx")).alias("x"),
        F.when(even, F.least("rx", "ry")).otherwise(F.col("ry")).alias("y"),
    )


def needed_matches(t: float, x: Column, y: Column) -> Column:
    """Matches in the prefixes of a pair within the limit: shared columns that are none of them lie behind one prefix."""
    behind = F.greatest(ceiling(F.lit(t) * x) - 1, y - index_end(t, y))
    return F.greatest(least_shared(t, x, y) - behind, F.lit(1))


def cells_by_group(groups: int):
    """The cells of a batch of sets by group of columns: of each set how many of its columns are there, and the first of them
    that are indexed. Columns go on as 31 bits of their hash: two that share them only add matches, and pairs are verified."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                ids, size, probing, indexed = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
                n = batch.column(4).value_lengths().to_numpy().astype(np.int64)
                cols = batch.column(4).flatten().to_numpy()
                row = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(cols)) - np.repeat(np.cumsum(n) - n, n)
                group = cols.view(np.uint64) % np.uint64(groups)
                order = np.argsort(group, kind="stable")
                edges = np.searchsorted(group[order], np.arange(groups + 1).astype(np.uint64))
                for g in range(groups):
                    own = order[edges[g] : edges[g + 1]]
                    if not len(own):
                        continue
                    cells = np.bincount(row[own], minlength=len(n))
                    first = np.bincount(row[own], weights=place[own] < indexed[row[own]], minlength=len(n))
                    met = np.flatnonzero(cells)
                    packed = (
                        pa.array(ids[met]),
                        pa.array(size[met].astype(np.int32)),
                        pa.array(probing[met].astype(bool)),
                        pa.array(cells[met].astype(np.int32)),
                        pa.array(first[met].astype(np.int32)),
                        pa.array((cols[own].view(np.uint64) >> np.uint64(33)).astype(np.int32)),
                    )
                    lists = [pa.ListArray.from_arrays(pa.array(np.array([0, len(x)], np.int32)), x) for x in packed]
                    names = ["g", "id", "size", "probing", "cells", "first", "cols"]
                    yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), *lists], names)

    return deal


def matches_of_group(t: float, groups: int, shares: int, large: int, small: int, slack: float, most: int):
    """(x, y, nx, ny, found) of the pairs with their share of the matches asked for in the one group of a task."""

    def ceiling(c: np.ndarray) -> np.ndarray:
        return np.ceil(c - slack).astype(np.int64)

    def needed(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least = ceiling(t / (1.0 + t) * (x + y))
        end = np.where(y > large, y - ceiling(t * y) + 1, y - ceiling(2.0 * t / (1.0 + t) * y) + 1)
        return least, np.maximum(least - np.maximum(ceiling(t * x) - 1, y - end), 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, share = ("id", "size", "probing", "cells", "first", "cols"), 0
        kept: dict[str, list[np.ndarray]] = {c: [] for c in names}
        for batch in batches:
            if batch.num_rows:
                share = batch.column("share")[0].as_py()
                for c in names:
                    # copied, or the memory of the whole batch would be kept
                    kept[c].append(batch.column(c).flatten().to_numpy(zero_copy_only=False).copy())
        if not kept["id"]:
            return
        ids, size, probing, cells, first, column = (np.concatenate(kept.pop(c)) for c in names)
        n = len(ids)
        # rows by size, so that the smaller set of a pair comes first
        rank = np.empty(n, np.int32)
        rank[np.lexsort((ids, size))] = np.arange(n, dtype=np.int32)
        row = np.repeat(rank, cells)
        place = np.arange(len(row), dtype=np.int32) - np.repeat((np.cumsum(cells) - cells).astype(np.int32), cells)
        held = place < np.repeat(first, cells)
        # the index: rows of each column, in the order of their sizes
        code = column[held].astype(np.int64)
        code *= n
        code += row[held]
        code.sort()
        held = np.repeat(probing.astype(bool), cells) & (row % shares == share)
        probe = row[held].astype(np.int64)
        probe <<= 31
        probe += column[held]
        del row, place, held, column
        probe.sort()
        by_rank = np.argsort(rank)
        ids, size = ids[by_rank], size[by_rank].astype(np.int64)
        least = np.searchsorted(size, t * size - slack, side="left")
        at = 0
        while at < len(probe):
            # the cells of a row stay together
            last = min(len(probe), at + most // 4)
            last = int(np.searchsorted(probe, ((probe[last - 1] >> 31) + 1) << 31))
            x, column = probe[at:last] >> 31, (probe[at:last] & (2**31 - 1)) * n
            # partners of a cell: indexed rows of its column that come before it and are not too small for it
            start = np.searchsorted(code, column + least[x])
            own = np.maximum(np.searchsorted(code, column + x) - start, 0)
            total = np.cumsum(own)
            done = 0
            while done < len(x):
                end = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + most, side="right")))
                end = int(np.searchsorted(x, x[min(end, len(x)) - 1], side="right"))
                yield from counted(code, x[done:end], start[done:end], own[done:end], ids, size)
                done = end
            at = last

    def counted(
        code: np.ndarray, x: np.ndarray, start: np.ndarray, own: np.ndarray, ids: np.ndarray, size: np.ndarray
    ) -> Iterator[pa.RecordBatch]:
        place = np.repeat(start - (np.cumsum(own) - own), own)
        place += np.arange(len(place))
        if not len(place):
            return
        codes = code[place] % len(ids)
        codes += np.repeat(x, own) * len(ids)
        del place
        codes.sort()
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        found = np.diff(np.r_[starts, len(codes)])
        a, b = np.divmod(codes[starts], len(ids))
        nx, ny = size[a], size[b]
        shared, need = needed(nx, ny)
        good = (found >= -(-need // groups)) & ((nx > small) | (shared <= 1))
        if good.any():
            columns = [ids[a], ids[b], *(v.astype(np.int32) for v in (nx, ny, found))]
            yield pa.RecordBatch.from_arrays([pa.array(v[good]) for v in columns], ["x", "y", "nx", "ny", "found"])

    return count


def limit_similarity(most_distance: float) -> float:
    if not 0.0 <= most_distance < 1.0:
        raise ValueError("a distance limit is at least 0 and below 1: at 1 every pair is within it")
    return 1.0 - most_distance


def verified(candidates: DataFrame, sets: DataFrame, most_distance: float) -> DataFrame:
    """(row_i, row_j, shared, distance) of the candidates (x, y) within the limit, row_i < row_j."""
    t = limit_similarity(most_distance)
    first = sets.select(F.col("row").alias("x"), F.col("cols").alias("__cx"))
    second = sets.select(F.col("row").alias("y"), F.col("cols").alias("__cy"))
    shared = F.size(F.array_intersect("__cx", "__cy")).cast("long")
    counted = candidates.join(first, "x").join(second, "y").select(
        F.least("x", "y").alias("row_i"),
        F.greatest("x", "y").alias("row_j"),
        shared.alias("shared"),
        (F.size("__cx") + F.size("__cy")).alias("__sum"),
    )
    similarity = F.col("shared") / (F.col("__sum") - F.col("shared")).cast("double")
    return counted.withColumn("__s", similarity).where(F.col("__s") >= F.lit(t)).select(
        "row_i", "row_j", "shared", (F.lit(1.0) - F.col("__s")).alias("distance")
    )


def jaccard_within(presence: DataFrame, row: str, column: str, most_distance: float) -> tuple[DataFrame, DataFrame]:
    """All pairs of representatives up to a distance, and the class of every row."""
    classes = SetClasses(presence, row, column)
    ordered = cut_lineage(rare_first(classes.sets))
    del classes.sets
    release(presence.sparkSession)
    pairs = verified(ordered_candidates(ordered, most_distance), ordered.withColumnRenamed("col", "cols"), most_distance)
    return pairs, classes.members


# MinHash -------------------------------------------------------------------------------------------------------------


def bands_for(most_distance: float, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the longest bands whose number still finds pairs at the limit with this probability."""
    t = limit_similarity(most_distance)
    best = None
    for rows in range(1, most_hashes + 1):
        miss = 1.0 - t**rows
        bands = 1 if miss <= 0.0 else math.ceil(math.log(1.0 - recall) / math.log(miss))
        if bands * rows > most_hashes:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError(f"{most_hashes} hashes do not reach a recall of {recall} at distance {most_distance}")
    return best


def hash_factors(k: int) -> tuple[int, int]:
    """Factor and addend of the k-th hash, drawn from its number."""
    digest = hashlib.md5(f"hash {k}".encode()).hexdigest()
    return int(digest[:8], 16) % (PRIME - 1) + 1, int(digest[8:16], 16) % PRIME


def band_keys(cols: Column, bands: int, rows: int) -> Column:
    """Array of the keys of each band, made inside the row: its number and its hashes, two in a long, nothing lost."""
    based = F.transform(cols, lambda c: draw32("minhash", c) % PRIME)

    def packed(values: list[Column]) -> Column:
        longs = [values[k] if k + 1 == len(values) else values[k] * (1 << 31) + values[k + 1] for k in range(0, len(values), 2)]
        return F.struct(*[x.cast("long").alias(f"k{k}") for k, x in enumerate(longs)])

    def least_hash(base: Column, k: int) -> Column:
        a, b = hash_factors(k)
        return F.array_min(F.transform(base, lambda x: (x * a + b) % PRIME))

    def keys(base: Column) -> Column:
        least = [least_hash(base, k) for k in range(bands * rows)]
        return F.array(*[packed([F.lit(b).cast("long"), *least[b * rows : (b + 1) * rows]]) for b in range(bands)])

    # bound by a lambda, so that the columns are digested once
    return F.get(F.transform(F.array(based), keys), F.lit(0))


def band_candidates(sets: DataFrame, most_distance: float, recall: float = RECALL) -> DataFrame:
    """(x, y) of representatives that agree in all hashes of a band and whose sizes allow the limit; x < y."""
    t = limit_similarity(most_distance)
    bands, rows = bands_for(most_distance, recall)
    # outer, or the optimizer would make every key once more to see that there is one
    banded = sets.select("row", "size", F.explode_outer(band_keys(F.col("cols"), bands, rows)).alias("key"))
    banded = banded.select("row", "size", "key.*")
    on = [c for c in banded.columns if c not in ("row", "size")]
    first = banded.withColumnsRenamed({"row": "x", "size": "nx"})
    second = banded.withColumnsRenamed({"row": "y", "size": "ny"})
    near_size = F.least("nx", "ny") >= F.lit(t) * F.greatest("nx", "ny") - F.lit(SLACK)
    return first.join(second, on).where((F.col("x") < F.col("y")) & near_size).select("x", "y").distinct()


def jaccard_minhash(
    presence: DataFrame, row: str, column: str, most_distance: float, recall: float = RECALL
) -> tuple[DataFrame, DataFrame]:
    """As ``jaccard_within``, but only pairs that a band makes candidates."""
    classes = SetClasses(presence, row, column)
    return verified(band_candidates(classes.sets, most_distance, recall), classes.sets, most_distance), classes.members
