"""Language identification by unigram pieces with the segmentation summed out.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word under a
language is the sum, over all ways to cut it into pieces, of the product of their probabilities; a forward pass over
the word gives it. Words are independent, so a text's log-likelihood is the sum of its words', and the posterior over
the languages (equal priors) is the score of the best one.

Piece probabilities are fitted by expectation-maximisation with the same lattice: forward and backward passes give the
expected count of every piece in the words of a bounded sample of labelled texts, summed by Spark.

Defined cases: a null text or one without letters is ``und`` with score 0; so is every text if nothing is labelled;
letters are those of Unicode's category L, so numerals are none; texts and runs of letters of any length are fitted and
scored whole; more than ``MOST_LANGUAGES`` languages are an error; letters outside the vocabulary have a small fixed probability; ties go to the
first language in code point order; repeated rows, null keys and other columns stay as they are.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costweave.llm.caching import RecentWords, held, in_pieces
from costweave.llm.common import key_text, map_batches, table
from costweave.llm.registry import query
from costweave.session import cut_lineage

#: Labelled texts per language that the fit reads, as an expected number; the sample is drawn by a digest of the key.
SAMPLE_TEXTS = 1500
ROUNDS = 3
#: Count added to every piece of every language.
SMOOTHING = 0.05
#: Probability of a letter that no piece covers.
UNKNOWN = 1e-7
UNDETERMINED = "und"
BLANK = "▁"
LETTERS = regex.compile(r"\p{L}+")
#: Words up to this length are scored together; longer ones rescale at every letter.
SHORT = 24
CHARACTERS_AT_ONCE = 1_000_000
#: Words whose lattices are held at a time.
WORDS_AT_ONCE = 10_000
#: The model holds a whole vocabulary per language and passes the driver; a table with more languages is refused.
MOST_LANGUAGES = 500
#: A document is rejected by the pipeline below this score.
LEAST_SCORE = 0.5

#: No piece begins so; a piece begins so but is none; the id of an uncovered letter among the packed edges.
NO_PIECE, ONLY_BEGINS = -2, -1
NO_ID = (1 << 20) - 1

_PIECES: dict[str, dict[str, int]] = {}


def vocabulary(path: str) -> dict[str, int]:
    """Pieces of letters, lower case, with or without the blank of a word's beginning, to their ids.

    Beginnings of pieces that are none themselves have ONLY_BEGINS.
    """
    if path not in _PIECES:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
        kept: dict[str, int] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            bare = piece.removeprefix(BLANK)
            if not any(test(i) for test in special) and piece == piece.lower() and (not bare or LETTERS.fullmatch(bare)):
                kept[piece] = i
        begins = {piece[:n]: ONLY_BEGINS for piece in kept for n in range(1, len(piece))}
        _PIECES[path] = begins | kept
    return _PIECES[path]


class Lattice:
    """Edges of all segmentations of many short words, ordered by their end (or start), word by word."""

    def __init__(self, words: list[str], pieces: dict[str, int]):
        edges: list[int] = []
        get = pieces.get
        for row, word in enumerate(words):
            size = len(word)
            for start in range(size):
                at = ((row << 6) | start) << 26
                piece = get(word[start : start + 1], NO_PIECE)
                edges.append(at | (start + 1) << 20 | (piece if piece >= 0 else NO_ID))
                end = start + 1
                while piece != NO_PIECE and end < size:
                    end += 1
                    piece = get(word[start:end], NO_PIECE)
                    if piece >= 0:
                        edges.append(at | end << 20 | piece)
        packed = np.array(edges, np.int64)
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.rows, self.starts = packed >> 32, (packed >> 26) & 63
        self.ends, self.ids = (packed >> 20) & 63, packed & NO_ID
        self.ids[self.ids == NO_ID] = -1

    def forward(self, probability: np.ndarray) -> np.ndarray:
        """Sum over the segmentations of every beginning: words x (longest + 1) x languages. The last row of
        ``probability`` is that of an uncovered letter."""
        alpha = np.zeros((len(self.lengths), int(self.lengths.max(initial=0)) + 1, probability.shape[1]))
        alpha[:, 0] = 1.0
        order = np.argsort(self.ends, kind="stable")
        cuts = np.searchsorted(self.ends[order], np.arange(alpha.shape[1] + 1))
        for end in range(1, alpha.shape[1]):
            at = order[cuts[end] : cuts[end + 1]]
            add_rows(alpha[:, end], self.rows[at], alpha[self.rows[at], self.starts[at]] * probability[self.ids[at]])
        return alpha

    def backward(self, probability: np.ndarray) -> np.ndarray:
        """The same for every ending, by the place where it begins."""
        beta = np.zeros((len(self.lengths), int(self.lengths.max(initial=0)) + 1, probability.shape[1]))
        beta[np.arange(len(self.lengths)), self.lengths] = 1.0
        order = np.argsort(self.starts, kind="stable")
        cuts = np.searchsorted(self.starts[order], np.arange(beta.shape[1] + 1))
        for start in range(beta.shape[1] - 2, -1, -1):
            at = order[cuts[start] : cuts[start + 1]]
            add_rows(beta[:, start], self.rows[at], beta[self.rows[at], self.ends[at]] * probability[self.ids[at]])
        return beta

    def whole(self, alpha: np.ndarray) -> np.ndarray:
        return alpha[np.arange(len(self.lengths)), self.lengths]


def add_rows(target: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Adds values to rows of the target; rows come in order, a row's values together."""
    if len(rows):
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        target[rows[first]] += np.add.reduceat(values, first, axis=0)


def long_word(word: str, pieces: dict[str, int], probability: np.ndarray) -> np.ndarray:
    """Log-likelihoods of one word of any length: the forward pass over a sliding window, rescaled at every letter."""
    longest = max(map(len, pieces))
    window = [np.ones(probability.shape[1])]
    scale = np.zeros(probability.shape[1])
    for end in range(1, len(word) + 1):
        total = np.zeros(probability.shape[1])
        for back, alpha in enumerate(reversed(window), 1):
            piece = pieces.get(word[end - back : end], -1)
            if piece >= 0 or back == 1:
                total = total + alpha * probability[piece]
        window = [alpha / total for alpha in window[-longest + 1 :]] + [np.ones_like(total)]
        scale += np.log(total)
    return scale


def long_counts(word: str, pieces: dict[str, int], probability: np.ndarray) -> dict[int, float]:
    """Expected count of every piece in one word of any length under one language: forward and backward logarithms over a
    sliding window, each value relative to its neighbour, so nothing runs out of range."""
    longest, n = max(map(len, pieces)), len(word)
    edges: list[list[tuple[int, int, float]]] = []  # by end: start, piece, probability
    ahead = [0.0] * (n + 1)
    for end in range(1, n + 1):
        found = []
        for start in range(end - 1, max(end - longest, 0) - 1, -1):
            piece = pieces.get(word[start:end], -1)
            if piece >= 0 or start == end - 1:
                found.append((start, piece, float(probability[piece])))
        edges.append(found)
        top = max(ahead[start] for start, _, _ in found)
        ahead[end] = top + math.log(sum(math.exp(ahead[start] - top) * p for start, _, p in found))
    after: list[float] = [-math.inf] * n + [0.0]
    counts: dict[int, float] = {}
    for end in range(n, 0, -1):
        for start, piece, p in edges[end - 1]:
            way = after[end] + math.log(p)
            high, low = max(after[start], way), min(after[start], way)
            after[start] = high + math.log1p(math.exp(low - high))
            if piece >= 0:
                counts[piece] = counts.get(piece, 0.0) + math.exp(ahead[start] + way - ahead[n])
    return counts


class Scorer:
    """Log-likelihoods of tokens (text between blanks) under every language, kept for tokens that come again."""

    def __init__(self, path: str, probability: np.ndarray):
        self.pieces, self.probability = vocabulary(path), probability
        self.tokens = RecentWords(self.score_tokens)
        self.words = RecentWords(self.score_words)

    def score_words(self, words: list[str]) -> list[bytes]:
        short = [w for w in words if len(w) <= SHORT]
        found: dict[str, bytes] = {}
        for at in range(0, len(short), WORDS_AT_ONCE):
            some = short[at : at + WORDS_AT_ONCE]
            found.update((w, row.tobytes()) for w, row in zip(some, self.score_short(some)))
        return [
            found[w] if w in found else long_word(w, self.pieces, self.probability).tobytes() for w in words
        ]

    def score_short(self, words: list[str]) -> np.ndarray:
        lattice = Lattice(words, self.pieces)
        return np.log(lattice.whole(lattice.forward(self.probability)))

    def score_tokens(self, tokens: list[str]) -> list[bytes]:
        """One row per token: the sum over its runs of letters, then the number of letters."""
        split = [[BLANK + run for run in LETTERS.findall(token.lower())] for token in tokens]
        known = self.words.prepare(set().union(*split))
        rows = np.zeros((len(tokens), self.probability.shape[1] + 1))
        for row, runs in zip(rows, split):
            for run in runs:
                row[:-1] += np.frombuffer(known[run])
                row[-1] += len(run) - 1
        return [row.tobytes() for row in rows]

    def texts(self, texts: list[str]) -> np.ndarray:
        split = [text.split() for text in texts]
        known = self.tokens.prepare(set().union(*split))
        width = self.probability.shape[1] + 1
        out = np.zeros((len(texts), width))
        for i, tokens in enumerate(split):
            if tokens:
                rows = np.frombuffer(b"".join(map(known.__getitem__, tokens)))
                out[i] = rows.reshape(-1, width).sum(axis=0)
        return out


def uniform_start(languages: int, size: int, pieces: dict[str, int]) -> np.ndarray:
    """Every piece alike; the last row is for letters without piece."""
    ids = [i for i in pieces.values() if i >= 0]
    probability = np.zeros((size + 1, languages))
    probability[ids] = 1.0 / len(ids)
    probability[-1] = UNKNOWN
    return probability


def sample_words(labelled: DataFrame, key: str, text: str, lang: str, texts: int) -> DataFrame:
    """(lang, word, n) over about ``texts`` labelled texts per language, chosen by a digest of the key."""
    place = F.conv(F.substring(F.md5(key_text(F.col(key))), 1, 12), 16, 10).cast("double") / float(16**12)
    sizes = labelled.groupBy(lang).agg(F.count(F.lit(1)).alias("__n")).limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    # at most one row per language, counted above: the texts of a frequent language stay where they are
    given = labelled.sparkSession.createDataFrame(sizes, f"{lang} string, __n long")
    drawn = labelled.join(F.broadcast(given), lang).where(place * F.col("__n") < texts)
    runs = F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}]+)"), 1))
    return drawn.select(F.col(lang).alias("lang"), runs.alias("word")).groupBy("lang", "word").agg(
        F.count(F.lit(1)).alias("n")
    )


def expected_counts(rows: list[tuple[str, int, int]], pieces: dict[str, int], probability: np.ndarray):
    """(language, piece, expected count) of short words, each with its language and how often it occurs."""
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    words, which, n = zip(*rows)
    which = np.array(which)
    lattice = Lattice(list(words), pieces)
    alpha, beta = lattice.forward(probability), lattice.backward(probability)
    per_word = np.array(n, float) / lattice.whole(alpha)[np.arange(len(which)), which]
    mine = which[lattice.rows]
    share = (
        alpha[lattice.rows, lattice.starts, mine]
        * probability[lattice.ids, mine]
        * beta[lattice.rows, lattice.ends, mine]
        * per_word[lattice.rows]
    )
    kept = lattice.ids >= 0
    return mine[kept], lattice.ids[kept], share[kept]


def fit(labelled: DataFrame, model: str, key: str, text: str, lang: str, texts: int = SAMPLE_TEXTS, rounds: int = ROUNDS):
    """Languages in code point order and their piece probabilities (vocabulary + 1) x languages.

    The model is as large as the fixed vocabulary times the number of languages, whatever the corpus.
    """
    labelled = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    words = cut_lineage(sample_words(labelled, key, text, lang, texts))
    languages = [row["lang"] for row in words.select("lang").distinct().orderBy("lang").collect()]
    pieces = vocabulary(model)
    size = max(pieces.values()) + 1
    probability = uniform_start(len(languages), size, pieces)
    number = {lang: i for i, lang in enumerate(languages)}
    spark = labelled.sparkSession
    for _ in range(rounds if languages else 0):
        given = spark.sparkContext.broadcast(probability)

        def expect(batches: Iterator[pa.RecordBatch], given=given, model=model, number=number):
            for batch in batches:
                langs, texts_, counts = (c.to_pylist() for c in batch.columns)
                rows = [(BLANK + w, number[g], n) for g, w, n in zip(langs, texts_, counts)]
                parts = [expected_counts([x for x in rows if len(x[0]) <= SHORT], vocabulary(model), given.value)]
                columns: dict[int, np.ndarray] = {}
                for word, which, n in (x for x in rows if len(x[0]) > SHORT):
                    column = columns.setdefault(which, given.value[:, which].copy())
                    found = long_counts(word, vocabulary(model), column)
                    parts.append((np.full(len(found), which), np.fromiter(found, np.int64), n * np.fromiter(found.values(), float)))
                which, piece, share = (np.concatenate(x) for x in zip(*parts))
                code, place = np.unique(which * len(given.value) + piece, return_inverse=True)
                total = np.bincount(place, share, len(code))
                arrays = [pa.array(code // len(given.value)), pa.array(code % len(given.value)), pa.array(total)]
                yield pa.RecordBatch.from_arrays(arrays, names=["lang", "piece", "n"])

        expected = map_batches(words.repartition("word"), expect, "lang long, piece long, n double")
        found = expected.groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros_like(probability)
        counts[[i for i in pieces.values() if i >= 0]] = SMOOTHING
        for row in found:
            counts[row["piece"], row["lang"]] += row["n"]
        probability = counts / counts.sum(axis=0)
        probability[-1] = UNKNOWN
    return languages, probability


def predict(docs: DataFrame, languages: list[str], probability: np.ndarray, model: str, text: str = "text") -> DataFrame:
    """Adds lang_pred and score to every row; only the text is looked at."""
    fields = [T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)]
    schema = T.StructType([*docs.schema.fields, *fields])
    names, place = schema.names, docs.columns.index(text)
    given = docs.sparkSession.sparkContext.broadcast(probability)
    fitted = uuid.uuid4().hex

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(("languages", fitted), lambda: Scorer(model, given.value))
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            for first, last in in_pieces(texts, CHARACTERS_AT_ONCE):
                found = scorer.texts(texts[first:last])
                known, letters = found[:, :-1], found[:, -1]
                if languages:
                    best = known.argmax(axis=1)
                    chance = 1.0 / np.exp(known - known.max(axis=1, keepdims=True)).sum(axis=1)
                    picked = [languages[b] if n else UNDETERMINED for b, n in zip(best, letters)]
                    score = np.where(letters > 0, chance, 0.0)
                else:
                    picked, score = [UNDETERMINED] * len(found), np.zeros(len(found))
                columns = [*batch.slice(first, last - first).columns, pa.array(picked, pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(docs, work, schema)


def fold(key: str):
    """crc32 of the key as text, modulo 4."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4


def predict_documents(docs: DataFrame) -> DataFrame:
    """Fits on the learning folds of the documents and predicts all of them."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    labelled = docs.where(fold("doc_id") != 2).select("doc_id", "text", "lang")
    languages, probability = fit(labelled, model, "doc_id", "text", "lang")
    return predict(docs, languages, probability, model)


@query("op6_language")
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from three of four folds."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = (fold("doc_id") == 2).alias("held_out")
    return predict_documents(docs).select("doc_id", held_out, "lang_pred", "score")
