"""Exact token counts of every prefix of a text by dynamic programming over a byte-pair vocabulary.

In a byte-pair encoding a sequence of tokens is the encoding of its text exactly if every two neighbours are: encoding
the two together gives the two again. So the encoding of each prefix is that of a shorter prefix plus one last token,
and the last token is the one that fits its predecessor. ``count[i] = count[i - length of last token] + 1`` then holds
for every prefix, without encoding any prefix anew. Blanks start a new unit that nothing merges across, and a new line
merges with nothing, so the table of a text is the units' tables one after the other; units come again and are kept.

Questions about truncation or budgets are answered from the table: ``tokens_before``, ``longest_prefix``.

Defined cases: null and empty texts have 0 tokens and the table [0]; characters outside the vocabulary count one token
per UTF-8 byte; texts of any length are read whole; repeated rows and other columns stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costweave.llm.caching import RecentWords, held, in_pieces
from costweave.llm.common import map_batches, table
from costweave.llm.registry import query

BLANK = "▁"
UNITS = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")
#: Letters, or other characters, with the blanks before them.
RUNS = re.compile(f"{BLANK}*(?:[^\\W\\d_]+|(?:(?!{BLANK})[\\W\\d_])+)|{BLANK}+")
CUT = "\x00"
#: Characters whose tables are handed back at a time.
CHARACTERS_AT_ONCE = 2_000_000
PAIRS_KEPT = 400_000
#: Production parameter of the query.
TOKEN_LIMIT = 4096

class PrefixCounter:
    """Prefix tables for one sentencepiece byte-pair model without normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
        usable = [i for i in range(model.get_piece_size()) if not any(test(i) for test in special)]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in usable}
        if any(BLANK in piece.lstrip(BLANK) or "\n" in piece for piece in self.score):
            raise ValueError("a piece goes across a blank or a new line")
        self.fits: dict[tuple[str, str], bool] = {}
        #: Every ending of a piece, and whether it is a piece that its own text is encoded as.
        self.endings = {piece[n:]: False for piece in self.score for n in range(len(piece))}
        self.endings.update((piece, self.encode(piece) == [piece]) for piece in self.score)
        self.cut_runs = all(len(RUNS.findall(piece)) == 1 for piece in self.score)
        self.units = RecentWords(self.unit_tables)
        self.runs = RecentWords(self.run_tables)

    def encode(self, text: str) -> list[str]:
        """Merges the pair with the best score, the leftmost of equals, until none is left."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            found = [(-score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in score]
            if not found:
                break
            at = min(found)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, last: str, token: str) -> bool:
        pair = (last, token)
        known = self.fits.get(pair)
        if known is None:
            if len(self.fits) > PAIRS_KEPT:
                self.fits.clear()
            known = self.fits[pair] = self.encode(last + token) == [last, token]
        return known

    def unit_tables(self, units: list[str]) -> list[bytes]:
        """For each unit the token counts of its prefixes, from the first character on, as 32-bit integers.

        Where no piece has letters and other characters, a unit is its runs of either, one after the other.
        """
        split = [RUNS.findall(unit) for unit in units] if self.cut_runs else [[unit] for unit in units]
        known = self.runs.prepare(set().union(*split))
        out = []
        for runs in split:
            if len(runs) == 1:
                out.append(known[runs[0]])
                continue
            tables, before = [], 0
            for run in runs:
                tables.append(np.frombuffer(known[run], np.int32) + np.int32(before))
                before = tables[-1][-1]
            out.append(b"".join(table.tobytes() for table in tables))
        return out

    def run_tables(self, runs: list[str]) -> list[bytes]:
        """The dynamic program itself: the one token that ends where a prefix does and fits the prefix before it.

        Runs are taken in order, so that a run goes on from the table of the beginning it shares with the last one.
        """
        endings, fits = self.endings, self.fits
        last: list[str] = [""]
        counts: list[int] = [0]
        done: dict[str, bytes] = {}
        previous = ""
        for run in sorted(runs):
            shared = 0
            for a, b in zip(run, previous):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], counts[shared + 1 :]
            for end in range(shared + 1, len(run) + 1):
                start = end - 1
                while start >= 0:
                    token = run[start:end]
                    whole = endings.get(token)
                    if whole is None:
                        start = -1
                        break
                    if whole:
                        if not start:
                            break
                        known = fits.get((last[start], token))
                        if self.follows(last[start], token) if known is None else known:
                            break
                    start -= 1
                if start < 0:  # a character of its own, spelled in bytes
                    token = run[end - 1]
                    counts.append(counts[end - 1] + len(token.encode("utf-8", "surrogatepass")))
                else:
                    counts.append(counts[start] + 1)
                last.append(token)
            done[run] = np.array(counts[1:], dtype=np.int32).tobytes()
            previous = run
        return [done[run] for run in runs]

    def split(self, text: str) -> list[str]:
        spaced = " " + text
        if "  " in spaced or CUT in spaced or BLANK in spaced:
            return UNITS.findall(spaced.replace(" ", BLANK))
        return spaced.replace(" ", CUT + BLANK).replace("\n", f"{CUT}\n{CUT}").split(CUT)

    def tables(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the token counts of its prefixes of 0, 1, .. all characters."""
        split = [self.split(text) if text else [] for text in texts]
        known = self.units.prepare(set().union(*split))
        out = []
        for units in split:
            if not units:
                out.append(np.zeros(1, np.int32))
                continue
            counts = np.frombuffer(b"".join(map(known.__getitem__, units)), np.int32)
            lengths = np.fromiter(map(len, units), np.int64, len(units))
            filled = lengths[lengths > 0]
            totals = counts[np.cumsum(filled) - 1]
            table = counts + np.repeat(np.cumsum(totals, dtype=np.int32) - totals, filled)
            table[0] = 0  # the blank that the model puts in front is no prefix of the text
            out.append(table)
        return out


def counter(path: str) -> PrefixCounter:
    return held(("tokens of", path), lambda: PrefixCounter(path))


def prefix_tables(docs: DataFrame, model: str, text: str = "text", out: str = "prefix_tokens") -> DataFrame:
    """Adds the array of token counts of every prefix, by characters, from the empty one to the whole text."""
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])
    names = [*docs.columns, out]
    place = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = counter(model).tables
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            for first, last in in_pieces(texts, CHARACTERS_AT_ONCE):
                found = tables(texts[first:last])
                offsets = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(t) for t in found], out=offsets[1:])
                values = pa.array(np.concatenate(found))
                part = batch.slice(first, last - first)
                arrays = [*part.columns, pa.ListArray.from_arrays(pa.array(offsets), values)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return map_batches(docs, work, schema)


def tokens_before(tables: Column, characters: Column | int) -> Column:
    """Tokens of the prefix of so many characters; beyond the text, those of the whole text."""
    return F.element_at(tables, F.least(F.lit(characters) + 1, F.size(tables)).cast("int"))


def longest_prefix(tables: Column, budget: int) -> Column:
    """Characters of the longest prefix whose tokens are within the budget."""
    fitting = F.transform(tables, lambda n, i: F.when(n <= budget, i))
    return F.array_max(fitting)


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents: the last entry of each prefix table."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn(
        "n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    )
    counted = prefix_tables(docs, public_tokenizers.path("piece_bpe_32k.model"))
    tokens = F.element_at("prefix_tokens", -1).cast("long")
    return counted.select("doc_id", "n_bytes", tokens.alias("n_tokens"), (tokens > TOKEN_LIMIT).alias("over_limit"))
