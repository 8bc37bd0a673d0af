"""SimHash near-duplicates with BK-trees.

A fingerprint has one bit per position in which more than half of a text's shingle hashes are set. Two fingerprints
link at a Hamming distance of at most the radius. Fingerprints are cut into ``radius + 1`` blocks of bits: two within
the radius agree in a block, so every link lies inside a shard (block, its value). Each shard builds a BK-tree, whose
children hang under their parent by their distance to it; a search follows only the edges whose distance is within
the radius of its own, which leaves nothing out. Shards stay where Spark shuffled them: trees of all fingerprints
would be a broadcast without bound. A shard above ``SHARD_LIMIT`` fingerprints is cut again by the bits that its key
leaves open, again without loss, down to ``MAX_DEPTH`` cuts.

Links leave a shard as a star (each fingerprint to the least of its part of the shard), so a dense shard of n gives n
rows and not n squared. Stars are joined into components by alternating rounds in Spark.

Defined cases: texts without words (null, empty) have fingerprint zero and link like any other; equal fingerprints are
one node; a component's id is its least non-null key; repeated rows are kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costweave.llm.caching import held
from costweave.llm.common import map_batches, one_per_row_key, row_key, table
from costweave.llm.registry import query
from costweave.session import cut_lineage

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
#: Fingerprints that one tree may hold before its shard is cut again, and the number of cuts.
SHARD_LIMIT = 2000
MAX_DEPTH = 3
#: Shingles whose bits are counted at a time.
AT_ONCE = 20_000


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of a text; zero without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    span = min(shingle, len(words)) - 1
    firsts, lasts = starts[: len(words) - span].tolist(), ends[span:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(firsts, lasts)], dtype=">u8")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), AT_ONCE):
        bits = np.unpackbits(hashes[at : at + AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """The other columns of every row and its fingerprint as a signed long."""
    place = docs.columns.index(text)
    fields = [f for f in docs.schema.fields if f.name != text] + [T.StructField(out, T.LongType(), False)]
    names = [f.name for f in fields]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("fingerprints",), object)  # lets go of what the worker kept for another operator
        for batch in batches:
            found = [fingerprint(t or "", shingle) for t in batch.column(place).to_pylist()]
            columns = [c for i, c in enumerate(batch.columns) if i != place]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.array(found, np.uint64).view(np.int64))], names=names
            )

    return map_batches(docs, work, T.StructType(fields))


class BKTree:
    """Nodes hang under their parent by their distance to it."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at, place = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        while place:
            distance = (self.values[at] ^ value).bit_count()
            below = self.children[at].setdefault(distance, place)
            if below == place:
                break
            at = below

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Places of the values at most ``radius`` away: by the triangle inequality they hang under edges that are."""
        waiting = [0] if self.values else []
        while waiting:
            at = waiting.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                yield at
            for edge, child in self.children[at].items():
                if -radius <= edge - distance <= radius:
                    waiting.append(child)


def shard_stars(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """(value, least value of its part) for the values of a shard that have a link, by searches while the tree grows."""
    tree, root = BKTree(), list(range(len(values)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, value in enumerate(values):  # ascending, so the least value of a part is its root
        for j in tree.within(value, radius):
            a, b = sorted((top(i), top(j)))
            root[b] = a
        tree.add(value)
    for i, value in enumerate(values):
        if (least := top(i)) != i:
            yield value, values[least]


def cut_bits(bits: int, parts: int) -> list[list[int]]:
    """Bit positions 0..bits-1 in neighbouring parts of nearly equal size."""
    edges = [round(k * bits / parts) for k in range(parts + 1)]
    return [list(range(a, b)) for a, b in zip(edges, edges[1:])]


def first_shards(fps: DataFrame, radius: int) -> DataFrame:
    """(shard, open, fp): one row per block; ``open`` is the mask of bits that the shard's key leaves open."""
    blocks = [sum(1 << b for b in part) for part in cut_bits(BITS, radius + 1)]
    keys = [shard_key(F.lit(0).cast("long"), F.col("fp"), mask) for mask in blocks]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key")).select("key.shard", "key.open", "fp")


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def shard_key(before: Column, fp: Column, mask: int, open_: Column | None = None) -> Column:
    left = F.lit(signed(((1 << BITS) - 1) ^ mask)).cast("long")
    part = fp.bitwiseAND(F.lit(signed(mask)).cast("long"))
    kept = left if open_ is None else open_.bitwiseAND(left)
    return F.struct(F.xxhash64(before, F.lit(signed(mask)).cast("long"), part).alias("shard"), kept.alias("open"))


def split_shards(shards: DataFrame, radius: int, depth: int) -> DataFrame:
    """Rows of shards above the limit, once per part of the open bits that they agree in; others unchanged.

    Two fingerprints of a shard within the radius differ in open bits only, and agree in one of ``radius + 1`` parts
    of them. Parts are those of the whole word at another cut, met with the open bits.
    """
    sizes = shards.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD_LIMIT)
    joined = shards.join(sizes, "shard", "left")
    masks = [sum(1 << b for b in range(BITS) if (b >> depth) % (radius + 1) == k) for k in range(radius + 1)]
    keys = [
        shard_key(F.col("shard"), F.col("fp").bitwiseAND(F.col("open")), mask, F.col("open")) for mask in masks
    ]
    same = F.struct(F.col("shard").alias("shard"), F.col("open").alias("open"))
    return joined.select(
        F.explode(F.when(F.col("n").isNull(), F.array(same)).otherwise(F.array(*keys))).alias("key"), "fp"
    ).select("key.shard", "key.open", "fp")


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Stars (a, b) with a > b over different fingerprints (fp) whose components are those of all links."""
    shards = first_shards(fps, radius)
    for depth in range(MAX_DEPTH):
        shards = split_shards(shards, radius, depth)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, members = None, []

        def close():
            found = list(shard_stars(members, radius)) if len(members) > 1 else []
            return [np.array(side, np.uint64).view(np.int64) for side in zip(*found)] if found else []

        for batch in batches:
            keys, values = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
            out = []
            for a, b in zip(first, [*first[1:], len(keys)]):
                if keys[a] != shard:
                    out.append(close())
                    shard, members = keys[a], []
                members.extend(values[a:b].tolist())
            if out := [o for o in out if o]:
                sides = [pa.array(np.concatenate(side)) for side in zip(*out)]
                yield pa.RecordBatch.from_arrays(sides, names=["a", "b"])
        if out := close():
            yield pa.RecordBatch.from_arrays([pa.array(side) for side in out], names=["a", "b"])

    dealt = shards.repartition("shard").sortWithinPartitions("shard", unsigned("fp")).select("shard", "fp")
    return map_batches(dealt, work, "a long, b long").distinct()


def unsigned(column: str) -> Column:
    """Order of the unsigned number."""
    return F.col(column).bitwiseXOR(F.lit(-(1 << (BITS - 1))).cast("long"))


def components(edges: DataFrame) -> DataFrame:
    """(node, least): the least node (as a signed number) of each node's component, for nodes with an edge.

    Each round links the larger neighbours of a node, then all neighbours that are not larger, to the least of them;
    both keep the components and the edges end as stars. Rounds stop when a round changes nothing.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = cut_lineage(edges)
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = small.union(least.select("a", F.col("m").alias("b"))).distinct()
        edges = cut_lineage(small)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("least")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("least"))
            ).distinct()
        before = state


def near_duplicates(marked: DataFrame, key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """Rows with key and fp, and component_id: the least key of all rows whose fingerprints are reachable by links."""
    marked = cut_lineage(marked)
    nodes = marked.groupBy("fp").agg(F.min(key).alias("least_key"))
    found = components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "__node")
    placed = nodes.join(found, nodes["fp"] == found["__node"], "left").select(
        F.col("fp").alias("__fp"), "least_key", F.coalesce("least", "fp").alias("component")
    )
    ids = placed.groupBy("component").agg(F.min("least_key").alias("component_id"))
    named = placed.join(ids, "component")
    joined = marked.join(named, F.col("fp") == F.col("__fp"))
    return joined.select(*marked.columns, "component", "component_id")


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The row with the least key (null last) of each component; of repeated rows one. Columns stay as they are."""
    rows = docs.select(key, row_key(F.col(key), F.col(text)).alias("__row"), text)
    found = near_duplicates(with_fingerprints(rows, text), key)
    order = F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("key"), F.col("__row").alias("row"))
    first = found.groupBy("component").agg(F.min(order).alias("first")).select(F.col("first.row").alias("__kept"))
    unique = one_per_row_key(docs, key, text)
    return unique.join(first, F.col("__row") == F.col("__kept"), "left_semi").drop("__row")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = near_duplicates(with_fingerprints(docs))
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
