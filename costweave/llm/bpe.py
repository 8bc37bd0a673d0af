"""Byte-level BPE encoding by batched merge rounds in numpy, and decoding.

The words of a batch that are not remembered lie in one flat array of symbols, word after word. Pairs of neighbours
are looked up by binary search in the sorted keys of all merges. Each round takes the lowest rank of every word,
merges all its places (of overlapping ones every other, from the left), closes the gaps and looks up only the pairs
that changed; words without a pair leave the array. Words above ``LONG`` bytes would need a round for each of their
many ranks over all their symbols, so they stay linked in place and the places wait under their ranks: a round takes
the lowest rank of all long words and touches only its places. Both are exact because a pair with a merged symbol
always ranks behind the merge that made the symbol, which is checked when the merges are loaded.

The pattern that cuts a text into words never crosses a single blank between two other characters, so texts are cut
there first and the parts are remembered, within a bound of bytes. Decoding looks up the bytes of every id.

Defined cases: null and empty texts have no ids and decode to the empty text; strings of the added special tokens have
their own ids, as in the library; null ids decode to null; ids without entry are left out; bytes that are no UTF-8
decode to U+FFFD; texts and words of any length are read whole; repeated rows and other columns stay as they are; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from costweave.llm.caching import RecentWords, held, in_pieces
from costweave.llm.common import map_batches, table
from costweave.llm.registry import query

#: Fixed value: the public pattern of byte-level vocabularies.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: From here on the library's table of characters may be older than that of ``regex``; it then cuts the words itself.
LAST_SURE = "\u052f"
ADJACENT = re.compile(r"\s\s")
SINGLE_BLANK = re.compile(r"(?<=\S)(?= \S)")
CUT = "\x00"
#: Words above so many bytes are merged in place.
LONG = 256
#: No merge of this pair.
NONE = np.int32(2**31 - 1)
KEY_BITS = 20
CHARACTERS_AT_ONCE = 2_000_000


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next one above 255."""
    prints = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    above = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(above)) for b in range(256)]


class ByteBpe:
    """Ids of texts by a byte-level file of the tokenizers library, and texts of ids."""

    def __init__(self, path: str):
        from tokenizers.pre_tokenizers import ByteLevel

        self.library_cut = ByteLevel(add_prefix_space=False, use_regex=True)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        vocabulary, merges = described["model"]["vocab"], described["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        characters = byte_characters()
        byte_of = {c: b for b, c in enumerate(characters)}
        added = {t["content"]: t["id"] for t in described["added_tokens"]}
        size = max([*vocabulary.values(), *added.values()]) + 1
        if size > 1 << KEY_BITS:
            raise ValueError(f"{size} ids are more than the keys of pairs hold")
        self.id_type = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.spelled = [b""] * size
        for token, i in vocabulary.items():
            self.spelled[i] = bytes(byte_of[c] for c in token)
        for token, i in added.items():
            self.spelled[i] = token.encode()
        self.special = {t: np.array([i], self.id_type).tobytes() for t, i in added.items()}
        longest_first = sorted(map(re.escape, added), key=len, reverse=True)
        self.specials = re.compile(f"({'|'.join(longest_first)})") if added else None
        self.symbols = np.array([vocabulary[c] for c in characters], np.int32)
        left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        made = np.full(size, -1, np.int64)
        made[self.merged] = np.arange(len(pairs))
        ranks = np.arange(len(pairs))
        if len(np.unique(self.merged)) < len(pairs) or (np.maximum(made[left], made[right]) >= ranks).any():
            raise ValueError("a pair ranks before the merge that makes its symbol")
        keys = left << KEY_BITS | right
        self.ranks = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.ranks]
        self.units = RecentWords(self.encode_units)

    # encoding --------------------------------------------------------------------------------------------------------

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, NONE without one: binary search over the sorted keys."""
        if not len(self.keys):
            return np.full(len(left), NONE)
        keys = left.astype(np.int64) << KEY_BITS | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)

    def merge_short(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words after the last merge, word after word, and their numbers."""
        word = np.repeat(np.arange(len(lengths)), lengths)
        rank = np.full(len(symbols), NONE)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside] = self.pair_ranks(symbols[inside], symbols[inside + 1])
        done_words, done_symbols = [], []
        while len(word):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(word)]))
            finished = lowest == NONE
            if finished.any():
                done_words.append(word[finished])
                done_symbols.append(symbols[finished])
                left = ~finished
                word, symbols, rank, lowest = word[left], symbols[left], rank[left], lowest[left]
            at = every_other(np.flatnonzero(rank == lowest))
            symbols[at] = self.merged[rank[at]]
            left = np.ones(len(word), bool)
            left[at + 1] = False
            word, symbols, rank = word[left], symbols[left], rank[left]
            at = at - np.arange(len(at))
            touched = np.r_[at, at[at > 0] - 1]
            followed = np.r_[word[1:] == word[:-1], False][touched]
            rank[touched] = NONE
            touched = touched[followed]
            rank[touched] = self.pair_ranks(symbols[touched], symbols[touched + 1])
        if not done_words:
            return symbols, lengths
        words = np.concatenate(done_words)
        order = np.argsort(words, kind="stable")
        return np.concatenate(done_symbols)[order], np.bincount(words, minlength=len(lengths))

    def merge_long(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words whose rounds would be many: places wait under their rank, symbols are linked."""
        n = len(symbols)
        word = np.repeat(np.arange(len(lengths)), lengths)
        bound = np.r_[word[1:] != word[:-1], True]
        after = np.where(bound, n, np.arange(1, n + 1))
        before = np.where(np.r_[True, bound[:-1]], -1, np.arange(-1, n - 1))
        alive = np.ones(n, bool)
        rank = np.full(n, NONE)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def look_up(places: np.ndarray) -> None:
            rank[places] = NONE
            places = places[after[places] < n]
            found = self.pair_ranks(symbols[places], symbols[after[places]])
            rank[places] = found
            order = np.argsort(found, kind="stable")
            order = order[: np.searchsorted(found[order], NONE)]
            cuts = np.flatnonzero(np.r_[True, np.diff(found[order]) != 0]) if len(order) else order
            for r, part in zip(found[order][cuts].tolist(), np.split(places[order], cuts[1:])):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(part)

        look_up(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            at = at[alternating(after[at[:-1]] == at[1:])]
            gone = after[at]
            symbols[at] = self.merged[r]
            alive[gone] = False
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at][inner]] = at[inner]
            earlier = before[at]
            look_up(np.unique(np.r_[at, earlier[earlier >= 0]]))
        return symbols[alive], np.bincount(word[alive], minlength=len(lengths))

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of words in bytes."""
        out: list[bytes] = [b""] * len(words)
        for some, merge in (
            ([i for i, w in enumerate(words) if len(w) <= LONG], self.merge_short),
            ([i for i, w in enumerate(words) if len(w) > LONG], self.merge_long),
        ):
            lengths = np.array([len(words[i]) for i in some], np.int64)
            flat = np.frombuffer(b"".join(words[i] for i in some), np.uint8)
            ids, counts = merge(self.symbols[flat], lengths) if len(flat) else (flat, lengths)
            joined = ids.astype(self.id_type).tobytes()
            ends = (np.cumsum(counts) * self.id_type.itemsize).tolist()
            for i, a, b in zip(some, [0, *ends], ends):
                out[i] = joined[a:b]
        return out

    def cut(self, unit: str) -> list[str]:
        if not unit or max(unit) <= LAST_SURE:
            return PATTERN.findall(unit)
        return [unit[a:b] for _, (a, b) in self.library_cut.pre_tokenize_str(unit)]

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of parts of a text: those of the words that the pattern cuts them into."""
        split = [self.cut(unit) for unit in units]
        words = list(set().union(*split))
        known = dict(zip(words, self.encode_words([w.encode("utf-8", "surrogatepass") for w in words])))
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def split(self, text: str) -> list[str]:
        """Parts of a text that no word crosses."""
        if CUT in text or ADJACENT.search(text):
            return SINGLE_BLANK.split(text)
        return text.replace(" ", f"{CUT} ").split(CUT)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers of ``id_type``."""
        split: list[list[str]] = []
        for text in texts:
            marked = self.specials is not None and self.specials.search(text) is not None
            parts = self.specials.split(text) if marked else [text]  # every other one is a special token
            units = self.split(parts[0])
            for special, part in zip(parts[1::2], parts[2::2]):
                units = [*units, special, *self.split(part)]
            split.append(units)
        known = self.units.prepare(set().union(*split).difference(self.special)) | self.special
        return [b"".join(map(known.__getitem__, units)) for units in split]

    # decoding --------------------------------------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        spelled, size = self.spelled, len(self.spelled)
        return b"".join([spelled[i] for i in ids if 0 <= i < size]).decode("utf-8", "replace")


def alternating(follows: np.ndarray) -> np.ndarray:
    """Which places to merge: every other one, from the left, of places that follow each other; ``follows`` says of each
    place but the first whether it follows the one before."""
    number = np.arange(len(follows) + 1)
    first = np.maximum.accumulate(np.where(np.r_[False, follows], 0, number))
    return (number - first) % 2 == 0


def every_other(at: np.ndarray) -> np.ndarray:
    return at[alternating(np.diff(at) == 1)] if len(at) else at


# The plan -------------------------------------------------------------------------------------------------------------


def codec(path: str) -> ByteBpe:
    return held(("byte pairs of", path), lambda: ByteBpe(path))


def with_ids(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds the array of ids of every row's text."""
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])
    place = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            for first, last in in_pieces(texts, CHARACTERS_AT_ONCE):
                found = [np.frombuffer(ids, bpe.id_type).astype(np.int32) for ids in bpe.encode(texts[first:last])]
                offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found)))
                columns = [*batch.slice(first, last - first).columns, ids]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_batches(docs, work, schema)


def with_decoded(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of every row's ids."""
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())])
    place = docs.columns.index(ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            rows = batch.column(place).to_pylist()
            found = [None if r is None else bpe.decode([i for i in r if i is not None]) for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=schema.names)

    return map_batches(docs, work, schema)


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The other columns, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256."""
    place = docs.columns.index(text)
    kinds = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    others = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*others, *(T.StructField(n, k, False) for n, k in kinds)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = codec(path), hashlib.sha256
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            counts, ids_sha, decoded_sha = [], [], []
            for first, last in in_pieces(texts, CHARACTERS_AT_ONCE):
                for packed in bpe.encode(texts[first:last]):
                    ids = np.frombuffer(packed, bpe.id_type)
                    counts.append(len(ids))
                    ids_sha.append(sha(ids.astype("<u4").tobytes()).hexdigest())
                    decoded_sha.append(sha(bpe.decode(ids.tolist()).encode()).hexdigest())
            columns = [c for i, c in enumerate(batch.columns) if i != place]
            found = [pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *found], names=schema.names)

    return map_batches(docs, work, schema)


@query("op11_bpe")
def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
