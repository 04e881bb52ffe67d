"""Encodings that lose nothing, and JSON arrays in parts."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerlens.sources import json_arrays, readers


@pytest.mark.parametrize(
    "raw,names,values",
    [
        ("name,n\nMüller �,1\n".encode(), ["name", "n"], ("Müller �", 1)),
        ("naïve,n\nMüller,1\n".encode(), ["naïve", "n"], ("Müller", 1)),
        ("﻿name,n\nMüller,1\n".encode(), ["name", "n"], ("Müller", 1)),
        ("naïve,n\nMüller,1\n".encode("latin-1"), ["naïve", "n"], ("Müller", 1)),
        ("preis €,n\n„Müller“ \x7f,1\n".encode("cp1252"), ["preis €", "n"], ("„Müller“ \x7f", 1)),
        ("name,n\nplain,1\n".encode(), ["name", "n"], ("plain", 1)),
        ("name,n\nMüller,1\n".encode("utf-16"), ["name", "n"], ("Müller", 1)),
    ],
)
def test_encodings(spark, tmp_path, raw, names, values):
    path = tmp_path / "in.csv"
    path.write_bytes(raw)
    df = readers.read_csv(spark, str(path))
    assert df.columns == names and tuple(df.first()) == values


def test_a_given_schema_keeps_its_names(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_bytes("x,n\nMüller,1\n".encode())
    df = readers.read_csv(spark, str(path), schema="`日本` string, n int")
    assert df.columns == ["日本", "n"] and df.first()[0] == "Müller"


RECORDS = [
    {"a": 1, "t": 'x}"{[,', "o": {"p": {"q": [1, {"r": "}"}]}}},
    {"a": 2, "t": "\\", "o": None},
    {"a": 3, "t": 'ends with \\"', "o": {"p": {"q": []}}},
    {"a": 4, "t": "line\nend é 😀", "o": {"p": None}},
    {"a": 5},
]


def in_parts(spark, path, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        return sorted((json.loads(r.line) for r in json_arrays.records_of(spark, path).collect()), key=lambda r: r["a"])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size", [7, 50, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_array_cut_anywhere(spark, tmp_path, size, indent):
    path = tmp_path / "in.json"
    path.write_text(json.dumps(RECORDS, indent=indent, ensure_ascii=False), encoding="utf-8")
    assert in_parts(spark, str(path), size) == RECORDS


def test_one_file_gives_several_parts_and_the_rows_of_a_whole_read(spark, tmp_path):
    path = tmp_path / "in.json"
    rows = [{"id": k, "note": "}{" * (k % 5) + '"', "inner": {"v": [k, -k]}} for k in range(3000)]
    path.write_text(json.dumps(rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        raw = spark.read.option("lineSep", "}").text(str(path))
        assert raw.rdd.getNumPartitions() > 5
        found = readers.read_dataset(spark, str(path))
        whole = spark.read.option("multiLine", True).json(str(path))
        assert found.schema == whole.schema and found.count() == 3000 and found.exceptAll(whole).isEmpty()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_several_files_and_empty_arrays(spark, tmp_path):
    for name, text in (("a.json", '[{"a": 1}]'), ("b.json", "[]"), ("c.json", ' [ {"a": 2} , {"a": 3} ] \n')):
        (tmp_path / name).write_text(text)
    assert in_parts(spark, str(tmp_path), 5) == [{"a": 1}, {"a": 2}, {"a": 3}]
    assert readers.read_dataset(spark, str(tmp_path), "json").agg(F.sum("a")).first()[0] == 6


def test_whole_frames_are_parsed_once_and_texts_squeezed_as_before(spark):
    from pyspark.sql import functions as F

    from ledgerlens.functions.coerce import only_if, sanitize_text
    from ledgerlens.operators import clean

    rows = [("2024-01-02", "$5", "a"), ("x", "7", "b"), (None, "3", "c"), ("2024-03-04", "none", "d"), ("05/06/2024", "(2.5)", None)]
    df, roles = spark.createDataFrame(rows, "d string, v string, who string"), {"date": "d", "total_amount": "v", "customer_id": "who"}
    whole, plain = (clean.canonical_frame(df, roles, False, whole=w) for w in (True, False))
    assert whole.columns == plain.columns and whole.collect() == plain.collect() and len(whole.collect()) == 1
    assert "Filter" not in whole._jdf.queryExecution().optimizedPlan().toString()
    odd = ["a  b", " a ", "aBLANKb", "x ", "x y", "na ", "NA", "Null", "\t", "", None, "a\x85b", "none ", "blank", "a\rb", "nana", "K blanK", "\xa0a"]
    texts = spark.createDataFrame([(t,) for t in odd], "t string")
    squeezed = F.trim(F.regexp_replace("t", r"(?i)(?:\s|blank)+", " "))
    before = only_if(squeezed, r"(?i)^(?!(?:nan|none|null|na)$).+$")
    assert texts.where(~sanitize_text(F.col("t")).eqNullSafe(before)).count() == 0
