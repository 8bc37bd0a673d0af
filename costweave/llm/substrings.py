"""Repeated substrings by suffix sorting: deep-shallow order of the suffixes that can matter.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else. Every such string (a window)
has an anchor: the leftmost position of the least hash among its grams of ``GRAM`` bytes. Equal windows have equal
anchors at the same place, so only windows whose anchor gram occurs again can be repeated. The bytes around an anchor
that all its windows can touch are its context. Anchors with equal contexts repeat each other as a whole; what is
left are anchors with equal grams and different contexts, at the edges of copied passages. Their windows are suffixes
of the contexts and are sorted: multikey quicksort on words of eight bytes down to a shallow depth, then a blind trie
for each group that still agrees there. Windows that meet in a leaf of the trie are repeated.

Anchors travel as numbers; texts are shuffled once, each different text once. Anchor groups above ``GROUP_LIMIT``
contexts are sorted in parts, and the parts' different windows are brought together by digest.

Defined cases: null texts are empty; matches never cross texts; texts shorter than ``LENGTH`` lose nothing; equal
texts of at least ``LENGTH`` bytes repeat each other wholly; texts of any length are read whole; empty tables give
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from costweave.llm.common import map_batches, table
from costweave.llm.registry import query
from costweave.session import cut_lineage

LENGTH, GRAM = 200, 100
WINDOWS = LENGTH - GRAM + 1
#: Bytes before an anchor that its windows can touch.
LEFT = LENGTH - GRAM
#: Bytes to which suffixes are sorted by quicksort; tries take the rest.
SHALLOW = 128
#: Contexts of one gram that are sorted together, and contexts that a task sorts at a time.
GROUP_LIMIT = 20_000
CONTEXTS_AT_ONCE = 20_000
#: Bytes whose anchors are found at a time; longer texts go in overlapping parts.
PART = 1 << 18
#: Order of grams: the leading bits of their hash, then their place in the part.
PLACE_BITS = 20


def odd_powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, .. modulo 2 ** 64."""
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def powers() -> list[np.ndarray]:
    if not _POWERS:
        size = PART + LENGTH
        _POWERS.extend([odd_powers(_BASE, size), odd_powers(pow(_BASE, -1, 1 << 64), size)])
        _POWERS.append(np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64))
    return _POWERS


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each gram of a part, the same wherever the gram stands."""
    up, down, code = powers()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(code[data] * up[: len(data)], out=sums[1:])
    hashes = (sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1]
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0xD6E8FEB86659FD93)
    hashes ^= hashes >> np.uint64(29)
    return hashes


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, from the minima of blocks up to and down from each place."""
    n = len(values)
    filled = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    filled[:n] = values
    blocks = filled.reshape(-1, width)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], upto[width - 1 : n])


def anchors(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, hash) of the anchors of a text, part by part, each once: neighbouring windows of two parts may share one."""
    n_windows, last = len(data) - LENGTH + 1, -1
    for at in range(0, n_windows, PART):
        part = data[at : at + PART + LENGTH - 1]
        hashes = gram_hashes(part)
        order = (hashes >> np.uint64(PLACE_BITS)) << np.uint64(PLACE_BITS)
        order |= np.arange(len(hashes), dtype=np.uint64)
        least = (window_minima(order, WINDOWS) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        place = least[np.r_[least[0] + at != last, least[1:] != least[:-1]]]
        last = least[-1] + at
        yield place + at, hashes[place]


def around(place, size):
    """Bounds of an anchor's context: what its windows can touch."""
    return np.maximum(place - LEFT, 0), np.minimum(place + LENGTH, size)


def merged(texts: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Touching intervals as one. They come by text and start, and ends do not fall within a text."""
    new = np.r_[True, (texts[1:] != texts[:-1]) | (starts[1:] > ends[:-1])]
    first = np.flatnonzero(new)
    return texts[first], starts[first], ends[np.r_[first[1:] - 1, len(ends) - 1]]


# The order of suffixes ------------------------------------------------------------------------------------------------


def multikey_quicksort(words: np.ndarray, groups: np.ndarray, first: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of 8-byte words in order within their groups, by the words ``first`` to ``depth``, and a number per part
    of rows that agree in them.

    Three-way partition at the middle row's word, of all parts at once: rows below and above it go on at the same
    word, equal rows at the next one.
    """
    order = np.argsort(groups, kind="stable")
    part = np.cumsum(np.r_[False, groups[order][1:] != groups[order][:-1]])
    at = np.full(len(order), first)
    while True:
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        sizes = np.diff(np.r_[starts, len(part)])
        open_rows = np.flatnonzero((np.repeat(sizes, sizes) > 1) & (at < depth))
        if not len(open_rows):
            return order, part
        middle = np.repeat(starts + sizes // 2, sizes)[open_rows]
        key = words[order[open_rows], at[open_rows]]
        pivot = words[order[middle], at[open_rows]]
        side = np.where(key < pivot, 0, np.where(key > pivot, 2, 1))
        code = part[open_rows] * 3 + side
        moved = np.argsort(code, kind="stable")
        order[open_rows] = order[open_rows][moved]
        at[open_rows] = (at[open_rows] + (side == 1))[moved]
        finer = part * 3
        finer[open_rows] = code[moved]
        part = np.cumsum(np.r_[False, finer[1:] != finer[:-1]])


class BlindTrie:
    """Suffixes by the places where they branch: inner nodes hold a depth and a child per byte, no texts.

    A suffix goes down by its bytes at the branching places to some leaf; only there it is compared with a text, which
    gives the place where it really leaves the trie.
    """

    def __init__(self, suffixes: list[bytes]):
        self.suffixes, self.width = suffixes, max(map(len, suffixes))
        self.numbers = [int.from_bytes(s.ljust(self.width, b"\0"), "big") for s in suffixes]
        self.root: list = [self.width, [0]]  # a leaf: its depth and the suffixes that are equal there
        for i in range(1, len(suffixes)):
            self.insert(i)

    def byte(self, i: int, depth: int) -> int:
        return (self.numbers[i] >> (8 * (self.width - 1 - depth))) & 255

    def insert(self, i: int) -> None:
        node = self.root
        while isinstance(node[1], dict):
            children = node[1]
            node = children.get(self.byte(i, node[0])) or next(iter(children.values()))
        differ = self.numbers[i] ^ self.numbers[node[1][0]]
        if not differ:
            node[1].append(i)
            return
        depth = self.width - 1 - (differ.bit_length() - 1) // 8
        other, node = node[1][0], self.root
        above, edge = None, None
        while node[0] < depth:
            above, edge = node, self.byte(i, node[0])
            node = node[1][edge]
        leaf = [self.width, [i]]
        if isinstance(node[1], dict) and node[0] == depth:
            node[1][self.byte(i, depth)] = leaf
            return
        branch = [depth, {self.byte(other, depth): node, self.byte(i, depth): leaf}]
        if above is None:
            self.root = branch
        else:
            above[1][edge] = branch

    def order(self) -> list[int]:
        out, waiting = [], [self.root]
        while waiting:
            node = waiting.pop()
            if isinstance(node[1], dict):
                waiting.extend(node[1][b] for b in sorted(node[1], reverse=True))
            else:
                out.extend(node[1])
        return out


def sorted_suffixes(rights: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Order of suffixes (rows of bytes, filled with zeros) within their groups, whose grams are equal: deep-shallow."""
    words = rights.view(">u8").astype(np.uint64)
    order, part = multikey_quicksort(words, groups, GRAM // 8, SHALLOW // 8)
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(part)]):
        if b - a > 1:
            rows = order[a:b]
            order[a:b] = rows[BlindTrie([rights[r, SHALLOW:].tobytes() for r in rows.tolist()]).order()]
    return order


def prefix_intervals(shared: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of every maximal run of neighbours in order that share at least ``depth`` bytes."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*shared, -1]):
        start = i
        while stack and stack[-1][0] > depth:
            top, start = stack.pop()
            yield top, start, i
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, start))


def repeated_parts(contexts: list[bytes], lefts: np.ndarray, groups: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(context, bytes before the anchor, bytes from it on) of strings of LENGTH or more that another context has.

    The suffixes from the anchors on are sorted. Every run of neighbours shares its ``depth`` bytes; within it the
    nearest texts before the anchor, read backwards, are neighbours in their order, and give each context the longest
    string that it shares with another of the run.
    """
    n, width = len(contexts), LENGTH + 8
    rights = np.zeros((n, width), np.uint8)
    lengths = np.zeros(n, np.int64)
    before = []
    for i, (context, left) in enumerate(zip(contexts, lefts.tolist())):
        right = np.frombuffer(context, np.uint8, offset=left)
        rights[i, : len(right)] = right
        lengths[i] = len(right)
        before.append(int.from_bytes(context[:left][::-1].ljust(LEFT, b"\0"), "big"))
    order = sorted_suffixes(rights, groups)
    ordered = rights[order]
    differ = ordered[1:] != ordered[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    shared = np.minimum(np.minimum(shared, lengths[order][1:]), np.minimum(lengths[order][:-1], LENGTH))
    starts = np.flatnonzero(np.r_[True, groups[order][1:] != groups[order][:-1]])
    rows, shared, left_of = order.tolist(), shared.tolist(), lefts.tolist()
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), n]):
        for depth, first, last in prefix_intervals(shared[a : b - 1]):
            run = sorted(rows[a + first : a + last + 1], key=before.__getitem__)
            best = [0] * len(run)
            for k in range(len(run) - 1):
                i, j = run[k], run[k + 1]
                apart = (before[i] ^ before[j]).bit_length()
                same = min(LEFT - (apart + 7) // 8, left_of[i], left_of[j])
                best[k], best[k + 1] = max(best[k], same), same
            for i, same in zip(run, best):
                if same + depth >= LENGTH:
                    yield i, same, depth


# The plan -------------------------------------------------------------------------------------------------------------


def text_numbers(text: Column) -> tuple[Column, Column]:
    """Two numbers that stand for a text: its hash and its bytes."""
    whole = F.coalesce(text, F.lit(""))
    return F.xxhash64(whole), F.octet_length(whole)


def anchor_rows(texts: DataFrame) -> DataFrame:
    """(g, c, doc, size, at, n) of (doc, size, text): an anchor's gram, context, text and place, with n = 1.

    What a batch shows to be repeated is not sent as anchors: it gives whole intervals, with n = 0, a group of their own
    and the end in c, and one row with n = 2 for each context. A task looks at equal texts once.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            found, numbers = [], []
            for doc, size, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if size < LENGTH or (doc, size) in seen:
                    continue
                seen.add((doc, size))
                data = text.encode("utf-8", "surrogatepass")
                for place, grams in anchors(np.frombuffer(data, np.uint8)):
                    start, end = around(place, size)
                    bounds = zip(start.tolist(), end.tolist(), (place - start).tolist())
                    context = [xxhash.xxh3_64_intdigest(data[a:b], left) for a, b, left in bounds]
                    found.append((place, grams, np.array(context, np.uint64), start, end))
                    numbers.append((len(found) - 1, doc, size, len(place)))
            if not found:
                continue
            at, g, c, start, end = (np.concatenate(x) for x in zip(*found))
            counts = [x[3] for x in numbers]
            text_no = np.repeat(np.arange(len(numbers)), counts)
            doc, size = (np.repeat(np.array([x[k] for x in numbers], np.int64), counts) for k in (1, 2))
            order = np.lexsort((at, text_no, c, g))
            same = np.r_[False, (g[order][1:] == g[order][:-1]) & (c[order][1:] == c[order][:-1])]
            class_no = np.cumsum(~same) - 1
            several = np.bincount(class_no)[class_no] > 1
            known = np.zeros(len(at), bool)
            known[order] = several
            marks = order[~same & several]
            single = np.flatnonzero(~known)
            rows = np.r_[single, marks]
            n = np.r_[np.ones(len(single), np.int32), np.full(len(marks), 2, np.int32)]
            out = [g[rows].view(np.int64), c[rows].view(np.int64), doc[rows], size[rows], at[rows], n]
            if known.any():
                whole = np.flatnonzero(known)
                whole = whole[np.lexsort((start[whole], doc[whole], size[whole]))]
                ids = np.stack([doc[whole], size[whole]], axis=1)
                change = np.r_[True, (ids[1:] != ids[:-1]).any(axis=1)]
                t, a, b = merged(np.cumsum(change), start[whole], end[whole])
                d, z = ids[change].T
                own = (d[t - 1] ^ (a * 0x9E3779B97F4A7C1)).astype(np.int64)
                ended = [own, b, d[t - 1], z[t - 1], a, np.zeros(len(a), np.int32)]
                out = [np.r_[x, y] for x, y in zip(out, ended)]
            kinds = [pa.int64()] * 3 + [pa.int32()] * 3
            names = ["g", "c", "doc", "size", "at", "n"]
            yield pa.RecordBatch.from_arrays([pa.array(x).cast(k) for x, k in zip(out, kinds)], names=names)

    return map_batches(texts, work, "g long, c long, doc long, size int, at int, n int")


def matched_anchors(rows: DataFrame) -> DataFrame:
    """(doc, size, g, start, end, known, sort): intervals that are known to be repeated, and contexts to be sorted.

    A context that is known to be repeated is sorted too, once, where its gram has other contexts.
    """
    of_gram, of_context = Window.partitionBy("g"), Window.partitionBy("g", "c")
    counted = rows.select(
        "*",
        F.sum("n").over(of_gram).alias("total"),
        F.sum("n").over(of_context).alias("same"),
        F.row_number().over(of_context.orderBy("doc", "size", "at")).alias("place"),
    )
    whole = F.col("n") == 0
    known = whole | ((F.col("n") == 1) & (F.col("same") > 1))
    alone = (F.col("n") == 1) & (F.col("same") == 1)
    partner = ~whole & (F.col("same") > 1) & (F.col("place") == 1) & (F.col("same") < F.col("total"))
    return counted.where(whole | (F.col("total") > 1)).select(
        "doc",
        "size",
        "g",
        "at",
        F.when(whole, F.col("at")).otherwise(F.greatest(F.col("at") - LEFT, F.lit(0))).alias("start"),
        F.when(whole, F.col("c").cast("int")).otherwise(F.least(F.col("at") + LENGTH, F.col("size"))).alias("end"),
        known.alias("known"),
        (alone | partner).alias("sort"),
    )


def cut_contexts(texts: DataFrame) -> DataFrame:
    """(g, doc, size, at, cut, context) for the anchors listed with each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, size, text, listed in zip(*(batch.column(i).to_pylist() for i in range(4))):
                data = text.encode("utf-8", "surrogatepass")
                at = np.array([x["at"] for x in listed], np.int64)
                start, end = around(at, size)
                contexts = [data[a:b] for a, b in zip(start.tolist(), end.tolist())]
                n = len(at)
                columns = [
                    pa.array([x["g"] for x in listed], pa.int64()),
                    pa.array(np.full(n, doc, np.int64)),
                    pa.array(np.full(n, size, np.int32)),
                    pa.array(at.astype(np.int32)),
                    pa.array((at - start).astype(np.int32)),
                    pa.array(contexts, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["g", "doc", "size", "at", "cut", "context"])

    return map_batches(texts, work, "g long, doc long, size int, at int, cut int, context binary")


def split_groups(contexts: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contexts of groups of usual size, and intervals of the others, which are split by content until they are small.

    A window that begins ``a`` bytes before the anchor holds those bytes and LENGTH - a from it on. Windows with a in
    lo..hi are split at the middle: the upper half holds the middle's bytes before the anchor, the lower half the bytes
    after it that its last window needs. Either is keyed by these bytes, so equal windows stay together. With
    one ``a`` left, a group's windows are equal and only need to be counted.
    """
    ranged = contexts.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(LEFT))
    usual = ranged.join(hot, "g", "left_anti")
    large = ranged.join(hot, "g", "left_semi")
    after = F.octet_length("context") - F.col("cut")
    ended = None

    def half(g: Column, lo: Column, hi: Column) -> Column:
        return F.struct(g.alias("g"), lo.alias("lo"), hi.alias("hi"))

    while True:
        middle = F.floor((F.col("lo") + F.col("hi") + 1) / 2).cast("int")
        before_text = F.expr("substring(context, cut - middle + 1, middle)")
        after_text = F.expr(f"substring(context, cut + 1, {LENGTH} - middle + 1)")
        halves = F.array(
            F.when(
                F.col("cut") >= F.col("middle"),
                half(F.xxhash64("g", F.lit(1), before_text), F.col("middle"), F.col("hi")),
            ),
            F.when(
                after >= LENGTH - F.col("middle") + 1,
                half(F.xxhash64("g", F.lit(0), after_text), F.col("lo"), F.col("middle") - 1),
            ),
        )
        halved = cut_lineage(
            large.withColumn("middle", middle)
            .withColumn("half", F.explode(F.filter(halves, lambda h: h.isNotNull())))
            .select("half.g", "doc", "size", "at", "cut", "context", "half.lo", "half.hi")
        )
        sizes = halved.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        many = sizes.where(F.col("n") > GROUP_LIMIT).select("g")
        usual = usual.unionByName(halved.join(sizes.where(F.col("n") <= GROUP_LIMIT).select("g"), "g", "left_semi"))
        large = halved.join(many, "g", "left_semi")
        done = large.where("lo = hi")
        whole = done.select(
            "doc", "size", (F.col("at") - F.col("lo")).alias("start"), (F.col("at") - F.col("lo") + LENGTH).alias("end")
        )
        ended = whole if ended is None else ended.unionByName(whole)
        large = cut_lineage(large.where("lo < hi"))
        if large.isEmpty():
            return usual.drop("lo", "hi"), ended


def sorted_intervals(contexts: DataFrame) -> DataFrame:
    """(doc, size, start, end) of strings of LENGTH or more that another context of the group has."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            g, doc, size, at, cut = (rows.column(i).to_numpy() for i in range(5))
            found = list(repeated_parts(rows.column(5).to_pylist(), cut.astype(np.int64), g))
            i, before, depth = np.array(found, np.int64).reshape(-1, 3).T
            columns = [doc[i], size[i], (at[i] - before).astype(np.int32), (at[i] + depth).astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc", "size", "start", "end"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            g = batch.column(0).to_numpy()
            if held and sum(h.num_rows for h in held) >= CONTEXTS_AT_ONCE:
                others = np.flatnonzero(g != held[-1].column(0)[-1].as_py())
                rest = int(others[0]) if len(others) else len(g)  # a group is never cut
                held.append(batch.slice(0, rest))
                if rest < len(g):
                    yield solve(held)
                    held = [batch.slice(rest)]
            elif batch.num_rows:
                held.append(batch)
        if held:
            yield solve(held)

    dealt = contexts.select("g", "doc", "size", "at", "cut", "context").repartition("g").sortWithinPartitions("g")
    return map_batches(dealt, work, "doc long, size int, start int, end int")


def cut_texts(texts: DataFrame) -> DataFrame:
    """(doc, size, n_removed, n_spans, kept_sha256, spans) of (doc, size, text, copies, intervals)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, digests, lists = [], [], [], []
            for size, text, copies, *listed in zip(*(batch.column(i).to_pylist() for i in range(1, 6))):
                data = (text or "").encode("utf-8", "surrogatepass")
                if copies > 1 and size >= LENGTH:
                    runs = [(0, size)]
                else:
                    runs = []
                    for x in sorted((x["start"], x["end"]) for some in listed for x in some or ()):
                        if runs and x[0] <= runs[-1][1]:
                            runs[-1] = (runs[-1][0], max(x[1], runs[-1][1]))
                        else:
                            runs.append(x)
                edges = [0, *(e for run in runs for e in run), size]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                removed.append(size - len(kept))
                spans.append(len(runs))
                digests.append(hashlib.sha256(kept).hexdigest())
                lists.append([{"start": a, "end": b} for a, b in runs])
            span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(span)]
            columns = [pa.array(x, k) for x, k in zip((removed, spans, digests, lists), kinds)]
            names = ["doc", "size", "n_removed", "n_spans", "kept_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    counts = "n_removed long, n_spans long, kept_sha256 string"
    return map_batches(texts, work, f"doc long, size int, {counts}, spans array<struct<start:int,end:int>>")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, spans) per row; spans are the removed bytes, start to end."""
    doc, size = text_numbers(F.col(text))
    numbered = docs.select(F.col(key), doc.alias("doc"), size.alias("size"), F.coalesce(text, F.lit("")).alias("text"))
    matched = cut_lineage(matched_anchors(anchor_rows(numbered.select("doc", "size", "text"))))
    same = ["doc", "size"]
    interval = F.struct("start", "end")
    known = matched.where("known").groupBy(*same).agg(F.collect_set(interval).alias("known"))
    listed = matched.where("sort").groupBy(*same).agg(F.collect_set(F.struct("g", "at")).alias("listed"))
    grams = matched.where("sort").groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    hot = cut_lineage(grams.where(F.col("n") > GROUP_LIMIT))
    unique = numbered.select("doc", "size", "text").dropDuplicates(same)
    contexts = cut_contexts(unique.join(listed, same))
    if hot.isEmpty():
        found = sorted_intervals(contexts)
    else:
        usual, ended = split_groups(contexts, hot.select("g"))
        found = sorted_intervals(usual).unionByName(ended)
    found = found.distinct().groupBy(*same).agg(F.collect_set(interval).alias("found"))
    copies = numbered.groupBy(*same).agg(F.count(F.lit(1)).alias("copies"))
    texts = unique.join(copies, same).join(known, same, "left").join(found, same, "left")
    cut = cut_texts(texts.select("doc", "size", "text", "copies", "known", "found"))
    return numbered.select(key, *same).join(cut, same).select(
        key, F.col("size").cast("long").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256", "spans"
    )


@query("op3_repeated_substrings")
def op3_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the strings of 200 bytes that stand elsewhere too."""
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text")).drop("spans")
