"""Cases in which an operator once did less than its whole job."""

from __future__ import annotations

import hashlib
import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from costweave.llm import decontamination, language, mixing, quality, simhash
from costweave.llm.queries import QUERIES

# Repeated substrings --------------------------------------------------------------------------------------------------


def test_long_texts_lose_nothing_at_the_bounds_of_parts(spark, tmp_path):
    draw = random.Random(8)
    unique = ["".join(draw.choices("abcdefgh ", k=n)) for n in (620_000, 530_000)]
    shared = unique[1][262_000:262_700]  # a real repeat across a bound still goes
    table = [(i, t) for i, t in enumerate([*unique, f"x{shared}y"])]
    spark.createDataFrame(table, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r[0]: tuple(r[1:]) for r in QUERIES["op3_repeated_substrings"](spark, str(tmp_path)).collect()}
    want = [
        (unique[0], 0, 0),
        (unique[1][:262_000] + unique[1][262_700:], 700, 1),
        ("xy", 700, 1),
    ]
    for i, (kept, removed, spans) in enumerate(want):
        assert rows[i] == (len(kept) + removed, removed, spans, hashlib.sha256(kept.encode()).hexdigest())


def test_anchors_do_not_depend_on_parts(monkeypatch):
    from costweave.llm import substrings

    data = np.random.default_rng(2).integers(97, 101, 6000, dtype=np.uint8)
    whole = [np.concatenate(x).tolist() for x in zip(*substrings.anchors(data))]
    for part in (1, 50, 300, 301):
        monkeypatch.setattr(substrings, "PART", part)
        assert [np.concatenate(x).tolist() for x in zip(*substrings.anchors(data))] == whole


# Decontamination ------------------------------------------------------------------------------------------------------


def test_index_grows_with_its_bytes():
    draw = random.Random(4)
    items = [(i, " ".join(f"w{draw.randrange(40_000)}" for _ in range(30))) for i in range(4000)]
    counts = Counter(t for _, text in items for t in set(decontamination.terms(text)))
    tracemalloc.start()
    index = decontamination.BlockMaxIndex(items, counts, len(items), 30.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(index.places) > 35_000
    assert peak < 100e6  # terms times blocks would be 300 MB


def test_parts_pass_one_by_one(spark, sf_dir, monkeypatch):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = items.where("item_id is not null").select("item_id", "text")
    docs = docs.union(held).union(held.limit(3)).union(spark.createDataFrame([(1, None), (1, "")], docs.schema))
    one = sorted(map(repr, decontamination.without_leaks(docs, items).collect()))
    assert len(one) < docs.count()
    monkeypatch.setattr(decontamination, "PART_BYTES", 1000)
    parts = decontamination.index_parts(items)
    assert iter(parts) is parts and next(parts) and next(parts)
    assert sorted(map(repr, decontamination.without_leaks(docs, items).collect())) == one


# Mixing ---------------------------------------------------------------------------------------------------------------


def demand(schedule, until):
    """Share of a schedule's integral up to a time."""

    def area(end):
        total = 0.0
        for (t, w), (u, v) in zip(schedule, schedule[1:]):
            stop = min(u, end)
            if stop > t:
                total += (stop - t) * (w + w + (v - w) * (stop - t) / (u - t)) / 2
        return total

    return area(until) / area(1.0)


def plain_order(docs):
    """(time, doc_id, source, repeat) of (doc_id, source, text) with different keys."""
    streams = {}
    for key, source, text in docs:
        streams.setdefault(source, []).append((hashlib.md5(f"{key}:{source}".encode()).hexdigest(), key, len(text.split())))
    sizes = {s: sum(n for _, _, n in stream) for s, stream in streams.items()}
    place = {s: i % 3 for i, s in enumerate(sorted(sizes))}
    weight = {s: (5.0, 2.0, 1.0)[p] for s, p in place.items()}
    cap, open_, left = {s: 3.0 * n for s, n in sizes.items()}, set(sizes), float(sum(sizes.values()))
    target = {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > cap[s]}
        for s in full or open_:
            target[s] = cap[s] if full else level * weight[s]
        left -= sum(cap[s] for s in full)
        open_ = open_ - full if full else set()
    for source, stream in streams.items():
        size, schedule, at = sizes[source], mixing.SCHEDULES[place[source]], 0
        whole = math.floor(target[source] / size)
        more = round(target[source] - whole * size)
        for _, key, n in sorted(stream):
            for repeat in range(whole + (at < more)):
                share = (at + repeat * size) / target[source]
                low, high = 0.0, 1.0  # by halving: independent of the closed form
                for _ in range(60):
                    middle = (low + high) / 2
                    low, high = (low, middle) if demand(schedule, middle) >= share else (middle, high)
                yield (round(high, 9) if share else 0.0), key, source, repeat
            at += n


def sources_of_three(spark):
    draw = random.Random(6)
    rows = [(i, " ".join(f"w{draw.randrange(50)}" for _ in range(draw.randint(1, 60))), f"s{i % 7 % 4}") for i in range(300)]
    return [(key, source, text) for key, text, source in rows], spark.createDataFrame(
        [(key, text, "en", source, len(text)) for key, text, source in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    )


def test_training_order_is_a_query(spark, tmp_path):
    rows, docs = sources_of_three(spark)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op5_training_order"](spark, str(tmp_path)).collect()]
    want = sorted(plain_order(rows))
    assert [(k, s, r) for k, s, r, _ in got] == [(k, s, r) for _, k, s, r in want]
    assert all(abs(g[3] - w[0]) < 1e-9 for g, w in zip(got, want))


def test_token_files_follow_the_mix(spark):
    rows, docs = sources_of_three(spark)
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    found = corpus_pipeline.token_files(spark, mixed.repartition(5), "").collect()
    got = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    want = [key for _, key, _, _ in sorted(plain_order(rows))]
    assert got == want and got != sorted(got)


def test_schedules_of_several_pieces(spark):
    from pyspark.sql import functions as F

    shares = spark.createDataFrame([(k / 40,) for k in range(41)], "s double")
    for schedule in [
        ((0.0, 1.0), (1.0, 1.0)),
        ((0.0, 0.0), (0.5, 2.0), (1.0, 1.0)),
        ((0.0, 3.0), (0.2, 0.0), (0.6, 0.0), (1.0, 1.0)),  # no demand in between
        mixing.SCHEDULES[2],
    ]:
        for s, t in shares.select("s", mixing.scheduled_time(F.col("s"), schedule)).collect():
            assert 0.0 <= t <= 1.0 and abs(demand(schedule, t) - s) < 1e-7
    with pytest.raises(ValueError):
        mixing.integrals(((0.0, 1.0), (0.5, 1.0)))
    with pytest.raises(ValueError):
        mixing.integrals(((0.0, 1.0), (1.0, -1.0)))


def test_the_schedule_changes_the_order(spark, tmp_path, monkeypatch):
    rows, docs = sources_of_three(spark)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")

    def positions():
        return {r["doc_id"]: (r["taken"], r["position"]) for r in QUERIES["op5_mix"](spark, str(tmp_path)).collect()}

    one = positions()
    first = {}
    for k, (_, key, _, _) in enumerate(sorted(r for r in plain_order(rows) if r[3] == 0)):
        first[key] = k
    assert {key: p for key, (taken, p) in one.items() if taken} == first
    late = ((0.0, 0.1), (0.8, 0.1), (1.0, 5.0))
    monkeypatch.setattr(mixing, "SCHEDULES", (late, *mixing.SCHEDULES[1:]))
    two = positions()
    assert {k: t for k, (t, _) in one.items()} == {k: t for k, (t, _) in two.items()} and one != two


def test_training_order_of_odd_tables(spark, odd_dir, none_dir):
    assert QUERIES["op5_training_order"](spark, none_dir).collect() == []
    taken = Counter()
    for r in QUERIES["op5_mix"](spark, odd_dir).collect():
        if r["taken"]:
            taken[r["doc_id"]] += -(-r["taken"] // r["size"])
    rows = QUERIES["op5_training_order"](spark, odd_dir)
    assert Counter(r["doc_id"] for r in rows.collect()) == taken
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Cartesian", "NestedLoop"))


# Quality --------------------------------------------------------------------------------------------------------------


def test_boilerplate_rejects_documents(spark):
    """One footer in a third of a large host's documents: below no share of it, above the number of documents."""
    draw = random.Random(9)

    def own(n):
        return " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))

    footer = "all rights reserved by the owners of this page and of all its parts in any form"
    docs = [(i, f"{own(55)}\n{footer}", "h") for i in range(20)] + [(i, own(71), "h") for i in range(20, 400)]
    docs += [(500 + i, f"{own(200)}\n{footer}", "h") for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge_documents(df).collect()}
    assert {d for d, k in kept.items() if not k} == set(range(20))
    share = {r["doc_id"]: r["removed"] for r in quality.judge_documents(df, min_docs=10**6, max_share=0.05).collect()}
    assert share[0] == len(footer.split()) and share[399] == 0


# Language -------------------------------------------------------------------------------------------------------------


def test_numerals_are_no_letters(spark):
    texts = ["½ 12", "²", "Ⅷ", "① ٣", "_", "12 a"]
    rows = [(i, t, None) for i, t in enumerate(texts)]
    rows += [(100 + i, "ein text der alten art", "de") for i in range(8)] + [(200 + i, "some text of old", "en") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict_documents(docs).collect()}
    assert all(got[i] == ("und", 0.0) for i in range(5)) and got[5][0] in ("de", "en")


def test_languages_without_blanks(spark):
    draw = random.Random(3)
    sounds = {"aa": ["ka", "to", "mi", "ra", "su", "ne"], "bb": ["gol", "brun", "ost", "eld", "ing", "ark"]}
    rows = [(i, "".join(draw.choices(sounds[lang], k=40)), lang) for i, lang in enumerate(["aa", "bb"] * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [(r["lang"], r["lang_pred"]) for r in language.predict_documents(docs).collect()]
    assert sum(a == b for a, b in got) / len(got) > 0.95


def cuts(word, pieces):
    for bits in range(2 ** (len(word) - 1)):
        edges = [0, *(i + 1 for i in range(len(word) - 1) if bits >> i & 1), len(word)]
        ids = [(pieces.get(word[a:b], -1), b - a) for a, b in zip(edges, edges[1:])]
        if all(i >= 0 or size == 1 for i, size in ids):
            yield [max(i, -1) for i, _ in ids]


def test_fit_and_posterior_by_all_segmentations(spark, monkeypatch):
    """Two rounds over a few words by enumeration, with short words on the lattice and with all of them as long ones."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = language.vocabulary(path)
    texts = {"de": ["der hund", "die stadt", "der zug"], "en": ["the dog", "the town", "a train"]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((g, t) for g, some in texts.items() for t in some)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    size = max(pieces.values()) + 1
    probability = language.uniform_start(2, size, pieces)
    for _ in range(2):
        counts = np.zeros_like(probability)
        counts[[i for i in pieces.values() if i >= 0]] = language.SMOOTHING
        for g, lang in enumerate(sorted(texts)):
            for word in " ".join(texts[lang]).split():
                ways = list(cuts("▁" + word, pieces))
                chances = [np.prod([probability[i, g] for i in way]) for way in ways]
                for way, chance in zip(ways, chances):
                    for i in way:
                        if i >= 0:
                            counts[i, g] += chance / sum(chances)
        probability = counts / counts.sum(axis=0)
        probability[-1] = language.UNKNOWN
    for short in (language.SHORT, 2):
        monkeypatch.setattr(language, "SHORT", short)
        langs, got = language.fit(docs, path, "doc_id", "text", "lang", texts=10**9, rounds=2)
        assert langs == ["de", "en"] and np.allclose(got, probability, rtol=1e-9, atol=1e-15)
    text = "der dog, die TOWN 12 x"
    chances = np.ones(2)
    for word in ("der", "dog", "die", "town", "x"):
        chances *= [sum(np.prod([probability[i, g] for i in way]) for way in cuts("▁" + word, pieces)) for g in range(2)]
    (row,) = language.predict(docs.sparkSession.createDataFrame([(text,)], "text string"), langs, probability, path).collect()
    assert row["lang_pred"] == langs[int(chances.argmax())] and abs(row["score"] - chances.max() / chances.sum()) < 1e-9


# Pipeline -------------------------------------------------------------------------------------------------------------


def test_language_stage_keeps_what_it_tells(spark):
    rows = [(i, "ein text der alten art und noch mehr davon", "de", "s", 1) for i in range(12)]
    rows += [(20 + i, "some text of the old kind and more of it", None if i % 2 else "en", "s", None) for i in range(12)]
    rows += [(50, "12 34 !?", "en", "s", 8), (51, None, "en", None, None), (52, "", None, "s", 0), (None, "der alte text", "de", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.known_language(spark, docs.selectExpr("*", "'x' AS score"), "")
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, (r for r in docs.collect() if r["doc_id"] not in (50, 51, 52))))
    assert corpus_pipeline.known_language(spark, docs.limit(0), "").collect() == []


def test_near_copies_stage_keeps_one_of_each_group(spark):
    draw = random.Random(12)
    words = [f"w{i}" for i in range(500)]
    base = [" ".join(draw.choices(words, k=200)) for _ in range(12)]
    rows = []
    for b in base:
        rows.append(b)
        rows += [b] * draw.randint(0, 3)
        changed = b.split()
        changed[50] = "changed"
        rows.append(" ".join(changed))
    rows += [None, "", "one", "one"]
    table = [(i if i % 9 else None, t, None, f"s{i % 3}", i) for i, t in enumerate(rows)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.without_near_copies(spark, docs.selectExpr("*", "'x' AS fp", "'y' AS component"), "").collect()
    fingerprints = {t: simhash.fingerprint(t or "") for t in rows}
    group = {}
    for t in rows:
        for other in list(group):
            if bin(fingerprints[t] ^ fingerprints[other]).count("1") <= simhash.RADIUS:
                old = group[other]
                for x in group:
                    if group[x] == old:
                        group[x] = group.get(t, t)
        group.setdefault(t, t)
    parts = {t: frozenset(x for x in group if group[x] == group[t]) for t in group}
    assert Counter(parts[r["text"]] for r in kept) == Counter(set(parts.values()))
    for r in kept:
        keys = [k for k, t, *_ in table if t in parts[r["text"]] and k is not None]
        assert r["doc_id"] == (min(keys) if keys else None)
        assert tuple(r) in table
    assert corpus_pipeline.without_near_copies(spark, docs.limit(0), "").collect() == []
