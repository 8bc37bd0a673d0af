"""Byte-level BPE against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from costweave.llm import bpe
from costweave.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(codec, texts):
    return [np.frombuffer(ids, codec.id_type).tolist() for ids in codec.encode(texts)]


@pytest.mark.parametrize("name", ["tables", "odd", "none"])
def test_whole_tables(name, spark, sf_dir, odd_dir, none_dir, library):
    folder = {"tables": sf_dir, "odd": odd_dir, "none": none_dir}[name]
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()

    def sha(data):
        return hashlib.sha256(data).hexdigest()

    want = Counter()
    for key, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[key, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(decoded.encode())] += 1
    assert Counter(tuple(r) for r in QUERIES["op11_bpe"](spark, folder).collect()) == want


def test_odd_texts(library):
    draw = random.Random(1)
    parts = [*"ab  \n▁ther.,é①梦\x00\t \x85\x1c<>0A1_𝒳́=ΣσİI'sS|\r　", "<|endoftext|>", "'ll", "wörd***", "½", "Ⅷ", "aaa"]
    some = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 30))) for _ in range(3000)]
    some += ["".join(chr(draw.choice([draw.randrange(1, 0xD800), draw.randrange(0xE000, 0x110000)])) for _ in range(20)) for _ in range(500)]
    codec = bpe.ByteBpe(PATH)
    assert ids_of(codec, some) == [library.encode(t, add_special_tokens=False).ids for t in some]


@pytest.mark.parametrize("long", [bpe.LONG, 0, 3])
def test_words_of_any_length(long, library, monkeypatch):
    monkeypatch.setattr(bpe, "LONG", long)  # 0: every word is merged in place
    draw = random.Random(2)
    some = ["x" * n for n in (1, 2, 3, 255, 256, 257, 1000, 5001)] + ["ab" * 3000, "aab" * 500]
    some += ["".join(draw.choices("abcdefghij", k=20_000)), "".join(draw.choices("ACGT", k=20_000)), "é梦" * 700]
    codec = bpe.ByteBpe(PATH)
    assert ids_of(codec, some) == [library.encode(t, add_special_tokens=False).ids for t in some]


def test_the_pattern_agrees_with_the_library(library):
    codec = bpe.ByteBpe(PATH)
    for c in [*range(1, 0x3000), *range(0xA000, 0xAC00), *range(0x10900, 0x10A00)]:
        text = f"a{chr(c)}a1{chr(c)}1.{chr(c)}."
        want = [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
        assert codec.cut(text) == want, hex(c)


def test_any_ids_decode(library):
    draw = random.Random(3)
    codec = bpe.ByteBpe(PATH)
    for _ in range(500):
        ids = [draw.randrange(50_257) for _ in range(8)]
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_columns_of_ids_and_texts(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "Some  words.", None)], "id long, text string, ids string")
    ids = bpe.with_ids(docs, PATH, out="tokens")
    back = bpe.with_decoded(ids, PATH, "tokens").collect()
    assert [(r["id"], r["ids"], r["decoded"]) for r in back] == [(1, "x", ""), (2, None, "Some  words.")]
    none = spark.createDataFrame([(None,), ([1, 10**6, -1, None],)], "ids array<int>")
    assert [r["decoded"] for r in bpe.with_decoded(none, PATH).collect()] == [None, '"']


def test_a_merge_before_its_part_is_refused(tmp_path):
    import json

    letters = bpe.byte_characters()
    vocabulary = {c: i for i, c in enumerate(letters)} | {"ab": 256, "abc": 257}
    model = {"vocab": vocabulary, "merges": [["ab", "c"], ["a", "b"]]}
    path = tmp_path / "wrong.json"
    path.write_text(json.dumps({"model": model, "added_tokens": []}))
    with pytest.raises(ValueError, match="ranks before"):
        bpe.ByteBpe(str(path))


def test_memory_is_bounded_by_bytes():
    from costweave.llm.caching import LONGEST_KEPT, RecentWords

    draw = random.Random(4)
    words = RecentWords(lambda todo: [w.encode() * 5 for w in todo], limit=1_000_000)
    for _ in range(50):  # 50 MB of units of 1,000 letters that never come again
        some = {"".join(draw.choices("abcdefghijklmnop", k=1000)) for _ in range(1000)}
        assert all(words.prepare(some)[w] == w.encode() * 5 for w in some)
        assert len(words.new) <= 1000 and not words.old
    for at in range(100):
        some = {f"{at} {i}" for i in range(1000)}
        assert some <= set(words.prepare(some))
        assert len(words.new) + len(words.old) < 15_000
    assert max(map(len, [*words.new, *words.old])) <= LONGEST_KEPT
