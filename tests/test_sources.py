"""Delimited scans on small files with the oddities of real ones."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costweave.sources import schemas
from costweave.sources.delimited import (
    literal_table,
    patch_rows,
    read_checked,
    read_delimited,
    read_stage_folder,
    write_table,
)

BOM = "﻿"


def schema(**kinds):
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


def test_mark_missing_and_numbers(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(BOM + "gene,category,score\nx, ,1.5\nNA,c,NA\n y ,d,oops\n", encoding="utf-8")
    s = schema(gene=T.StringType(), category=T.StringType(), score=T.DoubleType())
    got = [tuple(r) for r in read_delimited(spark, str(path), s).collect()]
    assert got == [("x", None, 1.5), (None, "c", None), ("y", "d", None)]


def test_tabs_short_rows_quotes(spark, tmp_path):
    path = tmp_path / "b.txt"
    path.write_text('id\tname\tseq\n1\t"a,b"\tMKV\n2\tc\n', encoding="utf-8")
    s = schema(id=T.IntegerType(), name=T.StringType(), seq=T.StringType())
    got = [tuple(r) for r in read_delimited(spark, str(path), s, sep="\t").collect()]
    assert got == [(1, "a,b", "MKV"), (2, "c", None)]


def test_decimal_comma(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("efficiency;n\n1,5;2\n95;x\n", encoding="utf-8")
    s = schema(efficiency=T.DoubleType(), n=T.LongType())
    got = [tuple(r) for r in read_delimited(spark, str(path), s, sep=";", decimal=",").collect()]
    assert got == [(1.5, 2), (95.0, None)]


def test_no_header(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text("T1,n,a,5,\nT2,m,,6,note\n", encoding="utf-8")
    got = [tuple(r) for r in read_delimited(spark, str(path), schemas.SYNONYMS, header=False).collect()]
    assert got == [("T1", "n", "a", 5.0, None), ("T2", "m", None, 6.0, "note")]


def test_stage_folder_is_labelled_by_file_name(spark, tmp_path):
    head = BOM + ",".join(schemas.STAGE_MATRIX.fieldNames()) + "\n"
    for stage, value in (("vegetative", 1), ("onset", -2), ("engulfment", 3), ("other", 4)):
        row = f'A,"R1, R2",g_{stage},T{value},0,' + ",".join([str(value)] * 8) + ",1,2,3\n"
        (tmp_path / f"Maps_{stage}.csv").write_text(head + row, encoding="utf-8")
    df = read_stage_folder(spark, str(tmp_path), schemas.STAGE_MATRIX, schemas.STAGE_LABELS)
    got = {(r.stage, r.gene, r.t1, r.regulators) for r in df.collect()}
    assert got == {
        ("1.vegetative", "g_vegetative", 1.0, "R1, R2"),
        ("3.onset", "g_onset", -2.0, "R1, R2"),
        ("5.engulfment", "g_engulfment", 3.0, "R1, R2"),
        ("other", "g_other", 4.0, "R1, R2"),
    }


def test_patch_literal_and_sink(spark, tmp_path):
    df = literal_table(spark, [(1, "a"), (2, "b")], "k int, v string")
    patched = patch_rows(df, "k", {2: {"v": None}})
    assert {tuple(r) for r in patched.collect()} == {(1, "a"), (2, None)}
    out = str(tmp_path / "out")
    write_table(patched, out, ["k"])
    assert spark.read.parquet(out).count() == 2
    with pytest.raises(Exception):
        write_table(patched, out)


@pytest.mark.parametrize("table", ["GENE_CALL_INTERVALS", "PROTEIN_CALL_INTERVALS", "SCORE_INTERVALS"])
def test_interval_tables(table):
    rows = getattr(schemas, table)
    assert len({r[0] for r in rows}) == len(rows) and all(r[1] > 0 for r in rows)


def test_pushdown_of_text_scan(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_text("gene,category\nx,c\n", encoding="utf-8")
    df = read_delimited(spark, str(path), schemas.TRAITS).select("gene")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "category" not in plan.split("ReadSchema")[1]
    assert df.select(F.count("gene")).first()[0] == 1


def test_rows_that_do_not_fit_are_returned(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text('gene,n,score\nx,1,1.5\ny,2,99,7\nz,2\n"a,b",3,4\n"a,b",3,4,"c,d"\nw,2.5,1\nv,4,oops\nu,NA,\nt,1,2,\n')
    s = schema(gene=T.StringType(), n=T.LongType(), score=T.DoubleType())
    good, bad = read_checked(spark, str(path), s)
    assert [tuple(r) for r in good.collect()] == [("x", 1, 1.5), ("z", 2, None), ("a,b", 3, 4.0), ("u", None, None)]
    assert [tuple(r) for r in bad.collect()] == [
        ("f.csv", "y,2,99,7", "fields"),
        ("f.csv", '"a,b",3,4,"c,d"', "fields"),
        ("f.csv", '{"gene":"w","n":"2.5","score":"1"}', "value: n"),
        ("f.csv", '{"gene":"v","n":"4","score":"oops"}', "value: score"),
        ("f.csv", "t,1,2,", "fields"),
    ]
    assert good.select("gene").count() == 4 and bad.count() == 5
    tabs = tmp_path / "g.txt"
    tabs.write_text("p\t1\t2\tmore\nq\t1,5\t2\n")
    good, bad = read_checked(spark, str(tabs), schema(a=T.StringType(), b=T.DoubleType(), c=T.LongType()), "\t", ",", False)
    assert [tuple(r) for r in good.collect()] == [("q", 1.5, 2)]
    assert [r.reason for r in bad.collect()] == ["fields"]
