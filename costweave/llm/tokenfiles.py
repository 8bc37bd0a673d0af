"""Token ids as Arrow files of equal-length sequences, written in document order and read without copying.

Documents are sorted range by range of their key. Each range becomes one Arrow file whose record batches hold
fixed-size lists: ``ids`` (unsigned, 16 bits where the vocabulary fits in them) and ``mask`` (one bit,
set for an id and not for padding), so sequence k of a file is at a
known place and a memory-mapped file gives it without a copy. The ids of a file are one stream, cut into sequences;
only the last one is padded. A second Arrow file names the documents of the stream with their starts. A task writes
under a name of its own attempt and reports it in one row; only reported files count, so a repeated task does no harm.

Defined cases: null and empty texts have the end id only; documents of any length run over as many sequences as they
need; rows with equal keys are ordered by a digest of their texts, null keys come first; an empty table writes no file.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from costweave.llm.caching import RecentWords, held, in_pieces
from costweave.llm.common import map_batches, shared_folder, table
from costweave.llm.registry import query
from costweave.session import cut_lineage

#: Production parameters: ids of a sequence, sequences of a record batch, the id after each document.
SEQUENCE = 1024
SEQUENCES_AT_ONCE = 256
END_ID = 2
CHARACTERS_AT_ONCE = 3_000_000
#: Latin letters, and marks other than the apostrophe and digits, for which the pattern is known.
WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
WORD_AND_MARKS = re.compile(f"({WORD.pattern})([!-&(-/:-@\\[-`{{-~]+)")
WORDS_AT_ONCE = 256
PIECES_KEPT = 125_000_000
#: Fixed value: how the vocabulary marks the last token of a word.
END_OF_WORD = "</w>"
MANIFEST = "part int, ids_file string, documents_file string, n_ids long, n_documents long"


class WordEncoder:
    """Ids of texts by a tokenizers file. Its pattern never crosses a blank, tab or line end, so the ids of a text are
    those of its pieces between them, and the library encodes each different piece once.

    A piece of letters and marks after them is a word and its marks, which the pattern parts as well. Plain words are
    handed to the library many at a time, as a text of one word after the other.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.id_type = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        vocabulary = self.library.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(END_OF_WORD)]] = True
        self.pieces = RecentWords(self.encode_pieces, PIECES_KEPT)

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Plain words, many as one text; where the library ends a word, its ids end."""
        texts = [" ".join(words[at : at + WORDS_AT_ONCE]) for at in range(0, len(words), WORDS_AT_ONCE)]
        encoded = self.library.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in encoded), self.id_type)
        ends = ((np.flatnonzero(self.ends_word[ids]) + 1) * self.id_type.itemsize).tolist()
        joined = ids.tobytes()
        return {word: joined[a:b] for word, a, b in zip(words, [0, *ends], ends)}

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Pieces not met lately. The parts of a piece are remembered with the pieces."""
        recent, older = self.pieces.new, self.pieces.old
        words, rest, parted = [], [], {}
        for piece in pieces:
            if WORD.fullmatch(piece):
                words.append(piece)
            elif m := WORD_AND_MARKS.fullmatch(piece):
                parted[piece] = m.groups()
            else:
                rest.append(piece)
        met = set(words).union(rest)
        for part in set(chain.from_iterable(parted.values())):
            if part not in recent and part not in older and part not in met:
                (words if WORD.fullmatch(part) else rest).append(part)
        found = self.encode_words(words) if words else {}
        encoded = self.library.encode_batch_fast(rest, add_special_tokens=False)
        found.update((p, np.array(e.ids, self.id_type).tobytes()) for p, e in zip(rest, encoded))
        self.pieces.keep(found)
        for piece, (word, marks) in parted.items():
            first, second = (found.get(p) or recent.get(p) or older[p] for p in (word, marks))
            found[piece] = first + second
        return [found[piece] for piece in pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers of ``id_type``."""
        split = [lowered(t).replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        known = self.pieces.prepare(set().union(*split))
        return [b"".join(map(known.__getitem__, pieces)) for pieces in split]


def lowered(text: str) -> str:
    """The text in lower case where that is what the tokenizer does first: Latin letters, no special token."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text if "<|" in text else text.lower()


def encoder(path: str) -> WordEncoder:
    return held(("ids of", path), lambda: WordEncoder(path))


def local_path(folder: str) -> str | None:
    """Path of a folder that this machine sees as files, else null."""
    if folder.startswith("file:"):
        return "/" + folder.removeprefix("file:").lstrip("/")
    return folder if folder.startswith("/") else None


def open_output(path: str):
    local = local_path(path)
    if local is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        return pa.OSFile(local, "wb")
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(place)


def open_input(path: str):
    local = local_path(path)
    if local is not None:
        return pa.memory_map(local)
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    return system.open_input_file(place)


class SequenceWriter:
    """Cuts a stream of ids into equal sequences and writes them batch by batch."""

    def __init__(self, path: str, id_type: np.dtype, sequence: int, at_once: int):
        if sequence % 8:
            raise ValueError("a sequence is a multiple of 8 ids, so that its mask begins at a byte")
        self.id_type, self.sequence, self.size = id_type, sequence, sequence * at_once
        self.schema = pa.schema(
            [("ids", pa.list_(pa.from_numpy_dtype(id_type), sequence)), ("mask", pa.list_(pa.bool_(), sequence))],
            metadata={"sequence": str(sequence), "batch": str(at_once)},
        )
        self.sink = open_output(path)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.waiting = bytearray()

    def add(self, ids: bytes) -> None:
        self.waiting += ids
        whole = self.size * self.id_type.itemsize
        while len(self.waiting) >= whole:
            self.put(bytes(self.waiting[:whole]))
            del self.waiting[:whole]

    def put(self, ids: bytes) -> None:
        held = np.frombuffer(ids, self.id_type)
        filled = -(-len(held) // self.sequence) * self.sequence
        values, mask = np.zeros(filled, self.id_type), np.zeros(filled, bool)
        values[: len(held)], mask[: len(held)] = held, True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), self.sequence) for v in (values, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.waiting:
            self.put(bytes(self.waiting))
        self.writer.close()
        self.sink.close()


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    sequence: int = SEQUENCE,
    at_once: int = SEQUENCES_AT_ONCE,
    before: tuple[str, ...] = (),
) -> DataFrame:
    """Writes (key, text, ..) in ascending order of the columns ``before`` and the key; one row per file, as in MANIFEST.

    Runs at once.
    """
    key, text = docs.columns[:2]
    key_type = to_arrow_type(docs.schema[key].dataType)
    spread = docs.withColumn("__row", F.monotonically_increasing_id())  # rows that are equal otherwise are split too
    order = [*before, key, F.xxhash64(text), "__row"]
    sorted_docs = spread.repartitionByRange(*order).sortWithinPartitions(*order).select(key, text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        encode, id_type = encoder(tokenizer).encode, encoder(tokenizer).id_type
        end = np.array([END_ID], id_type).tobytes()
        writer, index, start, n_docs = None, None, 0, 0
        schema = pa.schema([("key", key_type), ("start", pa.int64()), ("n", pa.int64())])
        for batch in batches:
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            if writer is None and texts:
                writer = SequenceWriter(f"{name}.ids.arrow", id_type, sequence, at_once)
                sink = open_output(f"{name}.documents.arrow")
                index = pa.ipc.new_file(sink, schema)
            for first, last in in_pieces(texts, CHARACTERS_AT_ONCE):
                lengths = []
                for ids in encode(texts[first:last]):
                    writer.add(ids + end)
                    lengths.append(len(ids) // id_type.itemsize + 1)
                n = np.array(lengths, np.int64)
                starts = start + np.cumsum(n) - n
                start += int(n.sum())
                n_docs += len(n)
                arrays = [keys.slice(first, last - first), pa.array(starts), pa.array(n)]
                index.write_batch(pa.RecordBatch.from_arrays(arrays, schema=schema))
        if writer is None:
            return
        writer.close()
        index.close()
        sink.close()
        row = [[part], [f"{name}.ids.arrow"], [f"{name}.documents.arrow"], [start], [n_docs]]
        kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        names = ["part", "ids_file", "documents_file", "n_ids", "n_documents"]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=names)

    return cut_lineage(map_batches(sorted_docs, work, MANIFEST))


class TokenFile:
    """Random access to the sequences of one file: views of the mapped file, no copies."""

    def __init__(self, path: str):
        self.reader = pa.ipc.open_file(open_input(path))
        self.sequence = int(self.reader.schema.metadata[b"sequence"])
        self.at_once = int(self.reader.schema.metadata[b"batch"])

    def ids(self, k: int) -> np.ndarray:
        """The ids of sequence k."""
        values = self.reader.get_batch(k // self.at_once).column("ids").flatten().to_numpy()
        at = (k % self.at_once) * self.sequence
        return values[at : at + self.sequence]

    def mask(self, k: int) -> np.ndarray:
        """The mask of sequence k as it is stored: a bit per id, the lowest first, set where there is an id."""
        bits = self.reader.get_batch(k // self.at_once).column("mask").flatten().buffers()[1]
        at = (k % self.at_once) * self.sequence // 8
        return np.frombuffer(bits, np.uint8)[at : at + self.sequence // 8]

    def streams(self, counts: list[int]) -> Iterator[list[np.ndarray]]:
        """The ids of each document in turn, given their numbers of ids: views of the record batches they lie in."""
        batch, at, values = -1, 0, np.zeros(0, np.uint32)
        for n in counts:
            parts = []
            while n > 0:
                if at == len(values):
                    batch, at = batch + 1, 0
                    values = self.reader.get_batch(batch).column("ids").flatten().to_numpy()
                parts.append(values[at : at + n])
                at, n = at + len(parts[-1]), n - len(parts[-1])
            yield parts


def read_token_files(manifest: DataFrame, key_type: str = "bigint", key: str = "doc_id") -> DataFrame:
    """One row per document, read back: key, start (ids of all documents before it), n_tokens, ids_crc32.

    Files are in the order of their parts, so a file starts after the ids of the earlier ones: a running sum over the
    manifest, which has one row per file.
    """
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    placed = manifest.select("*", F.coalesce(F.sum("n_ids").over(earlier), zero).alias("before"))
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = placed.select("ids_file", "documents_file", "before").repartition(tasks, "ids_file")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = TokenFile(row["ids_file"])
                index = pa.ipc.open_file(open_input(row["documents_file"]))
                parts = [index.get_batch(k) for k in range(index.num_record_batches)]
                counts = np.concatenate([part.column("n").to_numpy() for part in parts])
                streams = ids.streams(counts.tolist())
                for part in parts:
                    sums = np.zeros(part.num_rows, np.int64)
                    for i, pieces in zip(range(part.num_rows), streams):
                        crc = 0
                        for values in pieces:
                            crc = zlib.crc32(values.astype("<u4"), crc)
                        sums[i] = crc
                    starts = part.column("start").to_numpy() + row["before"]
                    arrays = [part.column("key"), pa.array(starts), part.column("n"), pa.array(sums)]
                    yield pa.RecordBatch.from_arrays(arrays, names=[key, "start", "n_tokens", "ids_crc32"])

    return map_batches(files, work, f"{key} {key_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files_digest(docs: DataFrame, before: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, ..) through the production files and back, in the order of ``before`` and the key."""
    import public_tokenizers

    spark = docs.sparkSession
    tokenizer, folder = public_tokenizers.path("word_bpe_49k.json"), shared_folder(spark, "tokens")
    manifest = write_token_files(docs, tokenizer, folder, before=before)
    return read_token_files(manifest, docs.schema["doc_id"].dataType.simpleString())


@query("op10_token_files")
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files, read back."""
    return token_files_digest(table(spark, sf_dir, "documents", "doc_id", "text"))
