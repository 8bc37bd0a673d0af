"""The registered training-data queries: against their SQL, or against plain Python where SQL cannot say it."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from oracle import compare

import __spark_entry__ as entry
from costweave.llm import decontamination, quality
from costweave.llm.queries import ORACLES, QUERIES

TABLES = ("documents", "labels", "pages", "benchmark")


def connect(folder, files=""):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet{files}')")
    return connection


def result(spark, name, folder):
    return [tuple(row) for row in QUERIES[name](spark, folder).collect()]


def ordered(rows):
    return sorted(rows, key=repr)


def texts(spark, folder):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(params=["tables", "odd", "none"])
def folder(request, sf_dir, odd_dir, none_dir):
    return {"tables": sf_dir, "odd": odd_dir, "none": none_dir}[request.param]


def test_all_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(name, spark, folder, sf_dir):
    files = "" if folder == sf_dir else "/*.parquet"
    assert compare(QUERIES[name](spark, folder), connect(folder, files), ORACLES[name]) == ""


@pytest.mark.parametrize("name", ["op1_shards", "op2_line_quality", "op5_mix"])
def test_native_plans_run_no_python(name, spark, sf_dir):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


# Shards ---------------------------------------------------------------------------------------------------------------


def test_shards(spark, odd_dir):
    rows = result(spark, "op1_shards", odd_dir)
    slots = defaultdict(list)
    of_key = defaultdict(set)
    for doc_id, size, crc, law, shard, slot, grown in rows:
        assert law == "key" and grown in (shard, 8)
        slots[shard].append(slot)
        of_key[doc_id].add((shard, grown))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(places) == 1 for places in of_key.values())
    got = Counter((r[0], r[1], r[2]) for r in rows)
    want = Counter(
        (k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in texts(spark, odd_dir)
    )
    assert got == want


def test_shards_follow_weights(spark):
    from costweave.llm.sharding import assign_shards

    got = assign_shards(spark.range(20_000), "id", [1.0, 2.0, 5.0], 2.0)
    counts = {r["shard"]: r["count"] for r in got.groupBy("shard").count().collect()}
    assert all(abs(counts[s] / 20_000 - w / 8) < 0.02 for s, w in enumerate((1, 2, 5)))
    assert got.where("grown_shard not in (shard, 3)").count() == 0
    assert abs(got.where("grown_shard = 3").count() / 20_000 - 0.2) < 0.02


def test_much_repeated_rows_are_dealt_out(spark):
    from costweave.llm.sharding import number_slots

    rows = spark.range(150_000).selectExpr("cast(1 as long) as k", "0 as shard")
    slots = number_slots(rows, "shard", "k").agg({"slot": "max", "k": "count"}).first()
    assert (slots["max(slot)"], slots["count(k)"]) == (149_999, 150_000)


# Quality --------------------------------------------------------------------------------------------------------------


def test_base_counts(spark, odd_dir):
    got = {}
    for row in QUERIES["op2_line_quality"](spark, odd_dir).collect():
        got.setdefault(row["doc_id"], set()).add(tuple(row[c] for c in row.__fields__ if c not in ("doc_id", "kept")))
    for doc_id, text in texts(spark, odd_dir):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        twice = Counter(windows)
        repeated = {i + k for i, w in enumerate(windows) if twice[w] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        counts = (
            len(words),
            sum(map(len, words)),
            len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)),
            len(repeated),
        )
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        assert any(g[:5] == counts and g[-1] == failed for g in got[doc_id]), doc_id


def test_frequent_lines_deplete(spark):
    common = "this line stands in every document of the host"
    docs = [(i, f"{common}\nown words {i} go here", "h") for i in range(30)]
    docs += [(100, f"{common}\n" + " ".join(f"w{i}" for i in range(40)), "h"), (101, f"{common}\n{common}", "other")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality.judge_documents(df, min_docs=25, max_share=0.5).collect()}
    assert (got[0]["removed"], got[100]["removed"], got[101]["removed"]) == (9, 9, 0)
    cleaned = {r["doc_id"]: r["text"] for r in quality.without_frequent_lines(df, min_docs=25, max_share=0.5).collect()}
    assert cleaned[0] == "own words 0 go here" and cleaned[101] == f"{common}\n{common}"


def test_copies_of_one_document_are_one_document(spark):
    docs = [(i, "a line of some words\nand another one", "h") for i in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert quality.removed_words(df, min_docs=5, max_share=0.0).count() == 0


# Repeated substrings --------------------------------------------------------------------------------------------------


def plain_cut(all_texts, length=200):
    data = [(t or "").encode() for t in all_texts]
    counts = Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        yield len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("limit", [20_000, 3])
def test_repeated_substrings(spark, folder, limit, monkeypatch):
    from costweave.llm import substrings

    monkeypatch.setattr(substrings, "GROUP_LIMIT", limit)  # small: every group is split by content
    docs = texts(spark, folder)
    want = [(k, *cut) for (k, _), cut in zip(docs, plain_cut([t for _, t in docs]))]
    assert ordered(result(spark, "op3_repeated_substrings", folder)) == ordered(want)


def test_suffix_order(monkeypatch):
    from costweave.llm import substrings

    draw = np.random.default_rng(3)
    rights = draw.integers(97, 99, (400, substrings.LENGTH + 8), dtype=np.uint8)
    rights[:, : substrings.GRAM] = 97
    rights[200:300, : substrings.SHALLOW + 30] = rights[0, : substrings.SHALLOW + 30]
    rights[300:320] = rights[5]
    groups = draw.integers(0, 3, 400)
    order = substrings.sorted_suffixes(rights, groups)
    keys = [(groups[i], rights[i].tobytes()) for i in order]
    assert keys == sorted(keys)


# Decontamination ------------------------------------------------------------------------------------------------------


def plain_leaks(docs, items):
    split = {(i, t): decontamination.terms(t or "") for i, t in items}
    for key, text in docs:
        known = set(decontamination.shingles(decontamination.terms(text or "")))
        for (item, _), words in split.items():
            if not words:
                continue
            covered = [False] * len(words)
            for i, shingle in enumerate(decontamination.shingles(words)):
                if shingle in known:
                    covered[i : i + 5] = [True] * len(covered[i : i + 5])
            cut = len(words) - max(1, round(len(words) / 3))
            if (not cut or np.mean(covered[:cut]) >= 0.8) and np.mean(covered[cut:]) >= 0.8:
                yield key, item


def test_leaks(spark, folder):
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    want = list(plain_leaks([d for d in texts(spark, folder)], set(items)))
    got = [(r[0], r[1]) for r in result(spark, "op4_decontaminate", folder)]
    assert ordered(got) == ordered(want)


def test_search_returns_all_above_the_threshold():
    draw = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(draw.choice(vocabulary, draw.integers(3, 20)))) for i in range(100)]
    counts = Counter(t for _, text in items for t in set(decontamination.terms(text)))
    mean = np.mean([len(text.split()) for _, text in items])
    index = decontamination.BlockMaxIndex(items, counts, len(items), mean)
    dense = np.zeros((len(index.places), len(items)))
    for n, (places, impacts) in enumerate(zip(index.places, index.impacts)):
        dense[n, places] = impacts
    for _ in range(50):
        found = np.unique(draw.integers(0, len(dense), 15))
        scores = dense[found].sum(axis=0)
        got = dict(index.search(found, 0.3))
        assert sorted(got) == np.flatnonzero(scores >= 0.3).tolist()
        assert all(abs(scores[p] - s) < 1e-9 for p, s in got.items())


def test_parts_of_the_index_find_the_same(spark, sf_dir, monkeypatch):
    one = ordered(result(spark, "op4_decontaminate", sf_dir))
    monkeypatch.setattr(decontamination, "PART_BYTES", 2000)
    assert ordered(result(spark, "op4_decontaminate", sf_dir)) == one


# Mixing ---------------------------------------------------------------------------------------------------------------


def test_mix_meets_targets(spark, odd_dir):
    taken, targets = Counter(), {}
    for doc_id, size, source_size, target, words, *_ in result(spark, "op5_mix", odd_dir):
        assert 0 <= words <= 3 * size
        taken[source_size] += words
        targets[source_size] = target
    assert all(abs(taken[s] - t) <= 1 for s, t in targets.items())


def test_schedules_are_inverted(spark):
    """Ramps w(t) = 1 + r (2 t - 1), whose integral is t (1 - r) + r t^2."""
    from pyspark.sql import functions as F

    from costweave.llm.mixing import scheduled_time

    shares = spark.createDataFrame([(s / 10,) for s in range(11)], "s double")
    for r in (-0.5, 0.0, 0.8, 1.0):
        for s, t in shares.select("s", scheduled_time(F.col("s"), ((0.0, 1.0 - r), (1.0, 1.0 + r)))).collect():
            assert abs(t * (1 - r) + r * t * t - s) < 2e-9


# Language -------------------------------------------------------------------------------------------------------------


def test_languages_of_held_out_texts(spark):
    folder = "/root/testdata/sf0.01"
    langs = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect())
    rows = result(spark, "op6_language", folder)
    held = [(langs[d], p) for d, out, p, _ in rows if out]
    assert [out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, out, _, _ in rows] == [True] * len(rows)
    assert sum(a == b for a, b in held) / len(held) > 0.98


def test_languages_of_odd_texts(spark, odd_dir):
    got = defaultdict(set)
    for doc_id, _, lang, score in result(spark, "op6_language", odd_dir):
        assert 0 <= score <= 1
        got[doc_id].add((lang, score))
    for doc_id, text in texts(spark, odd_dir):
        if not any(c.isalpha() for c in text or ""):
            assert ("und", 0.0) in got[doc_id]


def test_no_labels_no_language(spark, none_dir):
    assert result(spark, "op6_language", none_dir) == []
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    from costweave.llm.language import predict_documents

    assert predict_documents(docs).select("lang_pred", "score").collect() == [("und", 0.0)]


def test_forward_sums_every_segmentation():
    import public_tokenizers

    from costweave.llm import language

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = language.vocabulary(path)
    probability = np.random.default_rng(0).random((max(pieces.values()) + 2, 3)) / 1000
    scorer = language.Scorer(path, probability)
    for word in ("▁theré", "▁a", "▁ŝĝthion", "▁ing", "▁qwertzui"):
        total = np.zeros(3)
        for cuts in range(2 ** (len(word) - 1)):
            edges = [0, *(i + 1 for i in range(len(word) - 1) if cuts >> i & 1), len(word)]
            parts = [word[a:b] for a, b in zip(edges, edges[1:])]
            ids = [pieces.get(p, -1) for p in parts]
            if all(i >= 0 or len(p) == 1 for i, p in zip(ids, parts)):
                total += np.prod([probability[max(i, -1)] for i in ids], axis=0)
        assert np.allclose(np.frombuffer(scorer.score_words([word])[0]), np.log(total))
        assert np.allclose(language.long_word(word, pieces, probability), np.log(total))


# Token counts ---------------------------------------------------------------------------------------------------------


def test_token_counts(spark, folder):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for key, text in texts(spark, folder):
        n = len(model.encode(text or ""))
        want.append((key, len((text or "").encode()), n, n > 4096))
    assert ordered(result(spark, "op7_token_counts", folder)) == ordered(want)


def test_every_prefix_and_the_questions_it_answers(spark):
    import public_tokenizers
    import sentencepiece

    from costweave.llm import tokencount

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    draw = np.random.default_rng(1)
    letters = list("ab  \n▁thera.,é①梦\x00\t<s>0A1_𝒳")
    some = ["".join(draw.choice(letters, draw.integers(0, 30))) for _ in range(200)]
    want = [[len(model.encode(t[:i])) for i in range(len(t) + 1)] for t in some]
    assert [t.tolist() for t in tokencount.counter(path).tables(some)] == want
    docs = spark.createDataFrame(list(enumerate(some)), "id long, text string")
    rows = tokencount.prefix_tables(docs, path)
    asked = rows.select(
        "id",
        tokencount.tokens_before(rows["prefix_tokens"], 5).alias("before"),
        tokencount.longest_prefix(rows["prefix_tokens"], 4).alias("longest"),
    )
    for i, before, longest in asked.collect():
        table = want[i]
        assert before == table[min(5, len(table) - 1)]
        assert longest == max(k for k, n in enumerate(table) if n <= 4)


# Near copies ----------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    import xxhash

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    hashes = [
        xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))
    ]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fingerprints, radius=3):
    parent = {f: f for f in fingerprints}

    def top(f):
        while parent[f] != f:
            f = parent[f]
        return f

    known = sorted(parent)
    for i, a in enumerate(known):
        for b in known[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[top(a)] = top(b)
    return {f: top(f) for f in known}


def test_near_copies(spark, folder):
    docs = [(k, plain_fingerprint(t)) for k, t in texts(spark, folder)]
    of = plain_components({f for _, f in docs})
    least = {}
    for key, f in docs:
        if key is not None:
            least[of[f]] = min(key, least.get(of[f], key))
    want = [(key, f"{f:016x}", least.get(of[f])) for key, f in docs]
    assert ordered(result(spark, "op9_simhash", folder)) == ordered(want)


def test_dense_shards_are_split_without_loss(spark, monkeypatch):
    import random

    from costweave.llm import simhash

    monkeypatch.setattr(simhash, "SHARD_LIMIT", 20)
    draw = random.Random(3)
    values = set()
    for _ in range(20):
        base = draw.getrandbits(64)
        for _ in range(50):
            value = base
            for _ in range(draw.randint(0, 6)):
                value ^= 1 << draw.randrange(64)
            values.add(value)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    found = simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()
    got = {v: v for v in values} | {r["node"] % (1 << 64): r["least"] % (1 << 64) for r in found}
    want = plain_components(values)
    pairs = {(got[v], want[v]) for v in values}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


# Token files ----------------------------------------------------------------------------------------------------------


def test_token_files(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encoded = [
        (key, library.encode(text or "", add_special_tokens=False).ids + [2]) for key, text in texts(spark, folder)
    ]
    rows = result(spark, "op10_token_files", folder)
    sums = Counter((k, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for k, ids in encoded)
    assert Counter((r[0], r[2], r[3]) for r in rows) == sums
    start = 0
    for key, at, n, _ in sorted(rows, key=lambda r: r[1]):
        assert at == start
        start += n
    keys = [r[0] for r in sorted(rows, key=lambda r: r[1])]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))


def test_sequences_are_views(spark, tmp_path):
    import public_tokenizers

    from costweave.llm import tokenfiles

    docs = spark.createDataFrame([(i, "some words " * i) for i in range(40)], "doc_id long, text string").coalesce(1)
    manifest = tokenfiles.write_token_files(
        docs, public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "tokens"), sequence=16, at_once=4
    )
    ids = 0
    for row in sorted(manifest.collect()):
        file = tokenfiles.TokenFile(row["ids_file"])
        n = -(-row["n_ids"] // 16)
        bits = [np.unpackbits(file.mask(k), bitorder="little") for k in range(n)]
        assert all(len(file.ids(k)) == 16 and not file.ids(k).flags.owndata for k in range(n))
        assert sum(int(b.sum()) for b in bits) == row["n_ids"]
        ids += row["n_ids"]
    assert ids == 2 * sum(range(40)) + 40


def test_pieces_are_what_the_library_gives():
    import public_tokenizers

    from costweave.llm.tokenfiles import WordEncoder

    encoder = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    draw = np.random.default_rng(2)
    parts = [*"ab  \n▁ther.,é①梦\x00\t\u00a0\x85\x1c<>0A1_𝒳\u0301=ΣσİI'sS|\r", "<|endoftext|>", "'ll", "wörd***", "Éa!?"]
    some = ["".join(draw.choice(parts, draw.integers(0, 25))) for _ in range(3000)]
    want = [np.array(encoder.library.encode(t, add_special_tokens=False).ids, encoder.id_type).tobytes() for t in some]
    assert encoder.encode(some) == want
