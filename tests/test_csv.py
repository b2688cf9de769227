"""The CSV reader against pandas."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from sparkprep.sources import multiline
from sparkprep.sources.csv import NULL_TOKENS, NotACsv, header_names, read_csv, write_csv

KINDS = {"int64": "bigint", "float64": "double", "bool": "boolean", "object": "string"}


def check(spark, path, int_with_gaps=(), bool_with_gaps=()):
    """Same names, types and cells as pandas; long columns with gaps stay long."""
    want, got = pd.read_csv(path), read_csv(spark, str(path))
    assert got.columns == list(want.columns)
    types = dict(got.dtypes)
    for name in want.columns:
        assert types[name] == ("bigint" if name in int_with_gaps else KINDS[str(want[name].dtype)]), name
    rows = [tuple(r) for r in got.collect()]

    def cell(v):
        return None if v is None or (isinstance(v, float) and math.isnan(v)) else v

    theirs = [tuple(cell(v) for v in r) for r in want.itertuples(index=False, name=None)]
    as_text = [i for i, n in enumerate(want.columns) if n in bool_with_gaps]
    theirs = [tuple(str(v) if i in as_text and v is not None else v for i, v in enumerate(r)) for r in theirs]
    assert sorted(rows, key=str) == sorted(theirs, key=str) or list(map(list, rows)) == pytest.approx(list(map(list, theirs)))


def test_headers_tokens_quotes_and_newlines(spark, tmp_path):
    path = tmp_path / "na.csv"
    path.write_text(
        'a,a,b,c,d,\n1,NA,"x, y",true,0.5,u\n2,n/a,"line\nbreak",false,1e3,v\n3,None,"say ""hi""",True,-inf,\n,,,False,inf,w\n'
    )
    check(spark, path, int_with_gaps=["a"])


def test_every_null_token(spark, tmp_path):
    path = tmp_path / "tokens.csv"
    path.write_text("k,x\n" + "".join(f"{i},{t}\n" for i, t in enumerate(NULL_TOKENS)) + "99,5\n")
    assert pd.read_csv(path)["x"].isna().sum() == len(NULL_TOKENS)
    got = read_csv(spark, str(path))
    assert got.where("x is null").count() == len(NULL_TOKENS)
    assert dict(got.dtypes) == {"k": "bigint", "x": "bigint"}


@pytest.mark.parametrize(
    "cells",
    [
        ["1", "2", "x"],
        ["1", "2.5", ""],
        ["", "", ""],
        ["True", "False", "True"],
        ["True", "False", "yes"],
        ["1d", "2f", "3"],
        ["2024-01-01", "2024-01-02", ""],
        [" 1", "2 ", "+3"],
        [".5", "5.", "-1e-3"],
        ["0x10", "1_000", "1"],
        ["Infinity", "-INF", "1"],
        ["1 2", "a ", " b"],
    ],
)
def test_inference(spark, tmp_path, cells):
    path = tmp_path / "t.csv"
    pd.DataFrame({"k": range(3), "x": cells}).to_csv(path, index=False)
    check(spark, path)


def test_flags_with_gaps_are_text(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("k,x\n1,True\n2,\n3,False\n")
    check(spark, path, bool_with_gaps=["x"])


def test_short_rows_are_padded_and_long_rows_refused(spark, tmp_path):
    path = tmp_path / "short.csv"
    path.write_text("a,b,c\n1,2,3\n4,5\n")
    check(spark, path, int_with_gaps=["c"])
    path = tmp_path / "long.csv"
    path.write_text('a,b\n1,2\n3,4,5\n"6,7",8\n')
    with pytest.raises(NotACsv, match="1 records"):
        read_csv(spark, str(path))


def test_guards(spark, tmp_path):
    with pytest.raises(NotACsv, match="not a .csv"):
        read_csv(spark, str(tmp_path / "t.xlsx"))
    with pytest.raises(NotACsv, match="cannot read"):
        read_csv(spark, str(tmp_path / "missing.csv"))
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(NotACsv):
        read_csv(spark, str(tmp_path / "empty.csv"))


def test_header_only(spark, tmp_path):
    (tmp_path / "h.csv").write_text("a,b\n")
    got = read_csv(spark, str(tmp_path / "h.csv"))
    assert got.columns == ["a", "b"] and got.count() == 0


def test_header_names():
    assert header_names(["a", "a", "", None, "a", "a.1"]) == ["a", "a.1", "Unnamed: 2", "Unnamed: 3", "a.2", "a.1.1"]


def test_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(
        {
            "i": rng.integers(-(2**60), 2**60, 200),
            "x": rng.normal(size=200) * 10.0 ** rng.integers(-20, 20, 200),
            "s": [["plain", 'quo"te', "com,ma", "new\nline", "ünï", "-"][i % 6] for i in range(200)],
            "f": rng.random(200) < 0.5,
        }
    )
    df = spark.createDataFrame(pdf)
    write_csv(df.repartition(3), f"{tmp_path}/out")
    back = read_csv(spark, f"{tmp_path}/out")
    assert back.dtypes == df.dtypes
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    parts = pd.concat([pd.read_csv(p) for p in tmp_path.glob("out/*.csv")])
    assert len(parts) == 200 and str(parts["f"].dtype) == "bool"


def test_given_schema_skips_inference(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n1,2\n")
    schema = spark.range(0).selectExpr("'' as a", "1.0d as b").schema
    assert read_csv(spark, str(path), schema=schema).first() == ("1", 2.0)


def test_names_that_differ_in_case(spark, tmp_path):
    path = tmp_path / "case.csv"
    path.write_text("a,A,a\n1,x,2\n")
    df = read_csv(spark, str(path))
    assert df.columns == ["a", "A.1", "a.2"]
    assert tuple(df.first()) == (1, "x", 2)
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        assert read_csv(spark, str(path)).columns == ["a", "A", "a.1"]
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")


def cells_of(rng, n):
    """Awkward cells: line breaks, quotes within plain fields, commas, blanks, quotes at every place."""
    odd = ["", "a", 'say ""hi""', "x, y", "line\nbreak", "\n", "\n\n", '""', '"",""', '\n""\n', "two\r\nlines", "ünï", "  "]
    return ["".join(rng.choice(odd, rng.integers(0, 4))) for _ in range(n)]


@pytest.fixture
def small_blocks(spark):
    def size(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield size
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("block,broadcast", [(37, 100_000), (150, 0)])
def test_fields_with_line_breaks_in_many_blocks(spark, tmp_path, small_blocks, monkeypatch, block, broadcast):
    monkeypatch.setattr(multiline, "BROADCAST_BLOCKS", broadcast)
    rng = np.random.default_rng(block)
    rows = []
    for i, cell in enumerate(cells_of(rng, 60)):
        plain = ['5" pipe', 'a"b"c', "p", 'q"', "NA"][rng.integers(5)]
        rows.append(f'{i},{plain},"{cell}"' + ["\n", "\n\n", "\r\n"][rng.integers(3)])
    path = tmp_path / "big.csv"
    path.write_bytes(('\n\n"the\nnumber",plain,"te""xt"\n' + "".join(rows)).encode())
    small_blocks(block)
    assert multiline.splittable(spark, str(path)) and spark.read.text(str(path)).rdd.getNumPartitions() > 8
    check(spark, path)


def test_files_are_cut_on_their_own(spark, tmp_path, small_blocks):
    folder = tmp_path / "many"
    folder.mkdir()
    want = []
    for f in range(3):
        pdf = pd.DataFrame({"k": range(f * 40, f * 40 + 40), "s": [["plain", 'x"\n"y', "\n", "z,\n1,2"][i % 4] * (1 + i % 3) for i in range(40)]})
        pdf.to_csv(folder / f"{f}.csv", index=False)
        want += list(pdf.itertuples(index=False, name=None))
    (folder / "empty.csv").write_text("")
    (folder / "header.csv").write_text("k,s\n")
    small_blocks(64)
    got = read_csv(spark, str(folder))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_a_quote_never_closed_runs_to_the_end_of_its_file(spark, tmp_path, small_blocks):
    folder = tmp_path / "open"
    folder.mkdir()
    (folder / "a.csv").write_text('k,s\n1,x\n2,"open\n' + "3,y\n" * 60)
    (folder / "b.csv").write_text('k,s\n4,"u\nv"\n')
    small_blocks(50)
    got = sorted(map(tuple, multiline.read_records(spark, str(folder)).collect()))
    assert got == [("1,x",), ('2,"open\n' + "\n".join(["3,y"] * 60),), ('4,"u\nv"',)]


def test_states_of_lines_against_a_machine():
    """Every line of up to seven characters, from both states, against one character at a time."""

    def machine(line, inside):
        state = "quoted" if inside else "start"
        for c in line:
            if state == "quoted":
                state = "quote" if c == '"' else "quoted"
            elif state == "quote" and c == '"':
                state = "quoted"
            elif c == ",":
                state = "start"
            else:
                state = "quoted" if state == "start" and c == '"' else "plain"
        return state == "quoted"

    for n in range(8):
        for line in itertools.product('",a', repeat=n):
            for inside in (False, True):
                assert multiline.ends_inside("".join(line), inside) == machine(line, inside), (line, inside)


def test_lone_carriage_returns_use_the_reader_of_whole_files(spark, tmp_path):
    path = tmp_path / "cr.csv"
    path.write_bytes(b'a,b\r1,"x\ny"\r2,z\r')
    assert not multiline.splittable(spark, str(path))
    check(spark, path)
