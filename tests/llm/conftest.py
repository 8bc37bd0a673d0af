from __future__ import annotations

import random

import pytest

COLUMNS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "conversations": "conv_id long, turn long, role string, text string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}
#: Names that the operators use themselves.
CLASHING = "x ids copies again gaps cost component size shard slot copies copy start target taken g c n at cut fp component score words row part __row __part"


def word(draw: random.Random) -> str:
    return "".join(draw.choice("abcdeéü") for _ in range(draw.randint(1, 7)))


def odd_rows() -> dict[str, list[tuple]]:
    """Nulls everywhere, empty and very long texts, ties, repeated rows, copies and shared passages."""
    draw = random.Random(11)
    known = [word(draw) for _ in range(300)]

    def prose(n: int) -> str:
        return " ".join(draw.choice(known) for _ in range(n))

    item = prose(40)
    shared, base = prose(90), prose(150)
    near = [" ".join("changed" if i == k else w for i, w in enumerate(base.split())) for k in range(5, 65, 5)]
    texts = [None, "", " \n\t\x0b ", "a", "a b", "A b\nA b\n\nA b", "12 34 !? ***", "x" * 199, "x" * 200, "x" * 1000]
    texts += [f"{prose(20)} {shared} {prose(30)}" for _ in range(12)] + near + [base] * 5
    texts += [f"{prose(60)}\n{item}\n{prose(25)}", item, item.upper(), " ".join(item.split()[:20])]
    texts += [prose(12_000), "no-blank" * 3_000, "ab " * 500, "Ünïcode ①梦 \x00 <|endoftext|> it's 'll\u2028z"]
    texts += [f"{prose(8)}\nthe same line for all of them\n{prose(70)}" for _ in range(15)]
    documents = [(i, t, draw.choice(["en", "de", None]), f"s{i % 5}", len(t or "")) for i, t in enumerate(texts)]
    documents += [(None, prose(30), None, None, None), (None, None, None, None, None), (None, "", "en", None, 0)]
    documents += [(900, "", "en", "no words", 0), (901, None, "en", "no words", None)]
    documents += documents[10:13] * 2 + [(7, "other text for an id", "en", "s1", 20), (3, "a", None, "s3", 1)] * 2
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 40, 2)] + [(4, None, 1), (6, None, None), (None, 0, 1), (8, 0, 0)]
    hosts = ["example.org", "a.example.org", "x.com", "y.x.com", "z.net", "org", "Z.NET", "", "münchen.com"]
    paths = ["", "/", "/es/1", "/en/12", "/en/2", "/fr/", "/de/a/b", "/de", "?q=/de/", "#x", "/a?b#c"]
    urls = [f"{s}://{h}{p}" for s in ("http", "https") for h in hosts for p in paths]
    urls += [None, "", "no address", "://", "http:/x", "a://b://c/d", "://x.com/de/"]
    pages = [(i % 150, u, None) for i, u in enumerate(urls)] + [(None, "http://x.com/de/1", "h"), (3, urls[3], "h")]
    benchmark = [(0, item), (1, prose(30)), (2, None), (3, ""), (4, "one"), (5, item), (None, prose(25)), (0, item)]
    says = ["Yes.", "No", "", " \t", "What then?", "Well. Well. Yes!", "Ja…", prose(8), prose(9) + ".", prose(3000), None]
    roles = ["user", "assistant", "system", "user", "assistant", "", "tool", "User", None]
    conversations = [(c, t, draw.choice(roles), draw.choice(says)) for c in range(40) for t in range(draw.randint(1, 9))]
    conversations += [(50, t // 2, ("user", "assistant")[t % 2], draw.choice(says)) for t in range(300)]
    conversations += [(51, None, "user", "Yes."), (51, None, "assistant", "Yes."), (51, 7, "user", "Yes."), (51, 3, "user", "x")]
    conversations += [(None, t, "user", f"{t}.") for t in (None, 1, 5)] + [(52, 2, "user", "Same.")] * 5
    conversations += [(c, 0, "user", "Alone.") for c in range(60, 90)]
    vectors = [[draw.gauss(0, 1) * (k + 1) for k in range(6)] for _ in range(60)]
    vectors += [None, [], [1.0] * 5, [None] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5]
    vectors += vectors[:3] * 2
    embeddings = [(i, v, None) for i, v in enumerate(vectors)] + [(None, vectors[4], 1), (5, vectors[9], 1)]
    return {
        "documents": documents,
        "labels": labels,
        "pages": pages,
        "benchmark": benchmark,
        "conversations": conversations,
        "embeddings": embeddings,
    }


def write(spark, out, rows: dict[str, list[tuple]], added: str = "") -> str:
    from pyspark.sql import functions as F

    for name, schema in COLUMNS.items():
        df = spark.createDataFrame(rows.get(name, []), schema)
        df = df.withColumns({c: F.lit("clash") for c in added.split() if c not in df.columns})
        df.repartition(3).write.parquet(f"{out}/{name}.parquet")
    return str(out)


@pytest.fixture(scope="session")
def rows():
    return odd_rows()


@pytest.fixture(scope="session")
def odd_dir(spark, rows, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("odd"), rows, CLASHING)


@pytest.fixture(scope="session")
def none_dir(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("none"), {})
