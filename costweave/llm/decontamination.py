"""Benchmark decontamination: a BM25 index of the test items, searched with block-max WAND by every passage.

Items are the indexed documents and passages the queries. An item's BM25 impacts are divided by its score against
itself, so a passage that holds the whole item scores 1 and one threshold serves all items. Passages are windows of
twice the longest item that overlap by half, so every item of a text lies whole in one. The search keeps the largest impact of every term
as a whole and per block of items. A passage whose bounds stay below the threshold is skipped at once; in the others
WAND moves its cursors to the next item that could reach it and leaves out blocks that cannot. All items above the
threshold are retrieved, none is capped.

A retrieved item is a leak where the text covers its question and its answer: a word is covered by a shingle of five
words of the item that the text has too. The items here are plain texts; the last third of the words is the answer.

The index is built from counts over all items and handed out in parts of a bounded number of bytes, one pass over the
texts each. A part holds its postings and a maximum per term and block in which the term occurs, so it grows with its
bytes only; parts go through the driver one at a time.

Defined cases: null and empty texts have no passages and items without words are never found; items shorter than a
shingle are one shingle; equal items under different ids are all reported; repeated documents are reported each;
words are lower case without ASCII punctuation; empty tables give no leaks and remove no documents.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costweave.llm.caching import held
from costweave.llm.common import map_batches, table
from costweave.llm.registry import query
from costweave.session import cut_lineage

#: BM25 parameters, and the share of an item's own score from which it is retrieved.
K1, B = 1.2, 0.75
THRESHOLD = 0.5
SHINGLE = 5
#: Share of the question's and of the answer's words that a leak covers.
OVERLAP = 0.8
ANSWER_SHARE = 1 / 3
#: Items of a block of the index, and bytes of item text in one part of it.
BLOCK = 4
PART_BYTES = 8 << 20
#: ASCII punctuation and controls become blanks.
PLAIN = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(PLAIN).split()


def shingles(words: list[bytes]) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))]


class BlockMaxIndex:
    """Postings with impacts, their largest value per term and per term and block."""

    def __init__(self, items: list[tuple], counts: dict[bytes, int], n_items: int, mean_length: float):
        held = sorted(((terms(text or ""), item) for item, text in items), key=lambda x: len(x[0]))
        held = [(words, item) for words, item in held if words]  # by length, so that a block's items are alike
        self.words = [words for words, _ in held]
        self.items = [item for _, item in held]
        self.longest = max(map(len, self.words), default=0)
        self.number: dict[bytes, int] = {}
        self.places: list[list[int]] = []
        self.impacts: list[list[float]] = []
        for place, words in enumerate(self.words):
            impacts = {}
            for term, tf in Counter(words).items():
                idf = np.log(1.0 + (n_items - counts[term] + 0.5) / (counts[term] + 0.5))
                impacts[term] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_length))
            whole = sum(impacts.values())
            for term, impact in impacts.items():
                n = self.number.setdefault(term, len(self.places))
                if n == len(self.places):
                    self.places.append([])
                    self.impacts.append([])
                self.places[n].append(place)
                self.impacts[n].append(impact / whole)
        self.n_blocks = -(-len(self.words) // BLOCK)
        sizes = np.array([len(places) for places in self.places], np.int64)
        term = np.repeat(np.arange(len(sizes)), sizes)
        block = np.fromiter(chain.from_iterable(self.places), np.int32, len(term)) // BLOCK
        impact = np.fromiter(chain.from_iterable(self.impacts), np.float64, len(term))
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])][: len(term)])
        self.block_no = block[first]  # blocks of term n: block_start[n] to block_start[n + 1]
        self.block_most = np.maximum.reduceat(impact, first) if len(term) else impact
        self.block_start = np.searchsorted(term[first], np.arange(len(sizes) + 1))
        self.most = np.maximum.reduceat(impact, np.cumsum(sizes) - sizes) if len(term) else impact

    def search(self, found: np.ndarray, threshold: float) -> Iterator[tuple[int, float]]:
        """Places and scores of all items that reach the threshold for a set of terms."""
        bound = threshold - 1e-9  # sums in another order must not lose an item
        start, sizes = self.block_start[found], self.block_start[found + 1] - self.block_start[found]
        at = np.repeat(start - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        blocks = np.bincount(self.block_no[at], self.block_most[at], minlength=self.n_blocks)
        alive = np.flatnonzero(blocks >= bound).tolist()
        if not alive:
            return
        cursors = [[self.places[n], self.impacts[n], 0, self.most[n]] for n in found.tolist()]
        move(cursors, alive[0] * BLOCK)
        while True:
            cursors = sorted((c for c in cursors if c[2] < len(c[0])), key=lambda c: c[0][c[2]])
            total, pivot = 0.0, None
            for cursor in cursors:
                total += cursor[3]
                if total >= bound:
                    pivot = cursor[0][cursor[2]]
                    break
            if pivot is None:
                return
            if blocks[pivot // BLOCK] < bound:
                after = bisect_left(alive, pivot // BLOCK)
                if after == len(alive):
                    return
                move(cursors, alive[after] * BLOCK)
            elif cursors[0][0][cursors[0][2]] < pivot:
                move(cursors, pivot)
            else:
                score = 0.0
                for cursor in cursors:
                    if cursor[0][cursor[2]] != pivot:
                        break
                    score += cursor[1][cursor[2]]
                    cursor[2] += 1
                if score >= bound:
                    yield pivot, score

    def retrieve(self, words: list[bytes]) -> dict[int, float]:
        """Places of items above the threshold in some passage of a text, with the best score."""
        get = self.number.get
        numbers = np.array([get(word, -1) for word in words], dtype=np.int64)
        at = np.flatnonzero(numbers >= 0)
        numbers = numbers[at]
        bound = THRESHOLD - 1e-9
        if len(at) == 0 or self.most[numbers].sum() < bound:
            return {}
        starts = np.arange(0, max(1, len(words) - self.longest), self.longest)
        lows, highs = np.searchsorted(at, starts), np.searchsorted(at, starts + 2 * self.longest)
        sums = np.r_[0.0, np.cumsum(self.most[numbers])]
        best: dict[int, float] = {}
        for k in np.flatnonzero(sums[highs] - sums[lows] >= bound).tolist():
            found = np.unique(numbers[lows[k] : highs[k]])
            if self.most[found].sum() < bound:
                continue
            for place, score in self.search(found, THRESHOLD):
                best[place] = max(score, best.get(place, 0.0))
        return best

    def leaks(self, text: str) -> list[tuple]:
        """(item, score, question overlap, answer overlap) of the items that a text leaks."""
        words = terms(text)
        best = self.retrieve(words)
        if not best:
            return []
        known = set(shingles(words))
        out = []
        for place, score in sorted(best.items()):
            item = self.words[place]
            covered = np.zeros(len(item), bool)
            for i, shingle in enumerate(shingles(item)):
                if shingle in known:
                    covered[i : i + SHINGLE] = True
            cut = len(item) - max(1, round(len(item) * ANSWER_SHARE))
            question, answer = covered[:cut].mean() if cut else 1.0, covered[cut:].mean()
            if question >= OVERLAP and answer >= OVERLAP:
                out.append((self.items[place], round(score, 9), float(question), float(answer)))
        return out


def move(cursors: list[list], place: int) -> None:
    """Moves cursors that stand before an item to it, or to the next item of their list."""
    for cursor in cursors:
        if cursor[2] < len(cursor[0]) and cursor[0][cursor[2]] < place:
            cursor[2] = bisect_left(cursor[0], place, cursor[2])


def index_parts(items: DataFrame) -> Iterator[tuple]:
    """What each part of the index is built from: its items, the number of items with each of its terms, and totals.

    Items per term, their number and their mean length are counted by Spark over all items. Parts are dealt by digest,
    as many as the bytes of text ask for; only one part at a time passes through the driver.
    """
    key, text = items.columns
    items = items.where(F.col(text).isNotNull()).distinct()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [terms(t) for t in batch.column(0).to_pylist()]
            parts = [batch.column(1), pa.array([sorted(set(r)) for r in rows], pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(
                [*parts, pa.array([len(r) for r in rows], pa.int64())], names=["part", "terms", "n"]
            )

    size = items.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).first()["bytes"]
    n_parts = max(1, -(-size // PART_BYTES))
    part = F.pmod(F.xxhash64(key, text), F.lit(n_parts)).cast("int")
    dealt = items.withColumn("part", part)
    worded = map_batches(dealt.select(text, "part"), split, "part int, terms array<binary>, n long").where("n > 0")
    totals = worded.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.avg("n"), F.lit(1.0)).alias("mean")).first()
    single = worded.select("part", F.explode("terms").alias("term"))
    counts = single.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.collect_set("part").alias("parts"))
    if n_parts > 1:
        counts = cut_lineage(counts)  # read once per part
    for p in range(n_parts):
        held = [(row[key], row[text]) for row in dealt.where(F.col("part") == p).select(key, text).collect()]
        known = counts.where(F.array_contains("parts", p)).select("term", "n").collect()
        yield held, {bytes(row["term"]): row["n"] for row in known}, totals["items"], totals["mean"]


def over_index(docs: DataFrame, part: tuple, text: str, schema: T.StructType, rows) -> DataFrame:
    """One pass over the texts with one part of the index; ``rows(batch, leaks per text)`` makes the output."""
    given = docs.sparkSession.sparkContext.broadcast(part)  # PART_BYTES of text at most, in expectation
    name, place = uuid.uuid4().hex, docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held(("index", name), lambda: BlockMaxIndex(*given.value))
        for batch in batches:
            yield rows(batch, [index.leaks(t) if t else [] for t in batch.column(place).to_pylist()])

    return map_batches(docs, work, schema)


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """One row per leak: the other columns of the document, then item_id, score, question_overlap, answer_overlap."""
    fields = [f for f in docs.schema.fields if f.name != text]
    item_type = items.schema.fields[0].dataType
    added = [("item_id", item_type)] + [(n, T.DoubleType()) for n in ("score", "question_overlap", "answer_overlap")]
    schema = T.StructType([*fields, *[T.StructField(n, t) for n, t in added]])
    place, names = docs.columns.index(text), schema.names

    def rows(batch: pa.RecordBatch, leaks: list[list[tuple]]) -> pa.RecordBatch:
        of = pa.array(np.repeat(np.arange(len(leaks)), [len(x) for x in leaks]))
        flat = [leak for each in leaks for leak in each]
        kept = [c.take(of) for i, c in enumerate(batch.columns) if i != place]
        columns = list(zip(*flat)) if flat else [[]] * 4
        kinds = [item_kind, pa.float64(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([*kept, *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    item_kind = to_arrow_type(item_type)
    found = None
    for part in index_parts(items):
        one = over_index(docs, part, text, schema, rows)
        found = one if found is None else found.union(one)
    return found


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents that leak no item; rows and columns stay as they are.

    Passes of further parts run beside each other, so that no task holds several parts; they give the leaking texts
    by digest.
    """
    parts = index_parts(items)
    clean = over_index(docs, next(parts), text, docs.schema, keep_clean)
    whole = F.coalesce(F.col(text), F.lit(""))
    digests = [F.xxhash64(whole), F.xxhash64(F.lit("second"), whole)]
    marked = docs.select(digests[0].alias("__first"), digests[1].alias("__second"), text)
    leaking = None
    for part in parts:
        one = over_index(marked, part, text, marked.drop(text).schema, digests_of_leaks)
        leaking = one if leaking is None else leaking.union(one)
    if leaking is None:
        return clean
    return clean.join(
        leaking.distinct(), (digests[0] == F.col("__first")) & (digests[1] == F.col("__second")), "left_anti"
    )


def keep_clean(batch: pa.RecordBatch, leaks: list[list[tuple]]) -> pa.RecordBatch:
    return batch.filter(pa.array([not found for found in leaks], pa.bool_()))


def digests_of_leaks(batch: pa.RecordBatch, leaks: list[list[tuple]]) -> pa.RecordBatch:
    return batch.filter(pa.array([bool(found) for found in leaks], pa.bool_())).select(["__first", "__second"])


@query("op4_decontaminate")
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All leaks of benchmark items in the documents."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return find_leaks(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
