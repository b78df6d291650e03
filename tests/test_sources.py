import csv
import io
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bandwise.sources.reader import WHITESPACE, read_csv
from bandwise.sources.records import lines_of, records_of, with_maps
from bandwise.sources.union import (
    SOURCE,
    common_columns,
    only_sources,
    preview,
    supertype_schema,
    union_sources,
)
from bandwise.sources.writer import write_scored


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def types(df):
    return [f.dataType.simpleString() for f in df.schema.fields]


def test_types_come_from_the_whole_file(spark, tmp_path):
    path = write(
        tmp_path, "a.csv",
        "i,f,b,s,d,e,m\n1,1,true,x,2020-01-01,,1\n-2,2.5,False,1,2020-01-02,,\n3,1e3,TRUE,2,2020-01-03,,x\n",
    )
    df = read_csv(spark, path)
    assert types(df) == ["bigint", "double", "boolean", "string", "string", "string", "string"]
    assert [tuple(r) for r in df.select("i", "f", "b").collect()] == [
        (1, 1.0, True), (-2, 2.5, False), (3, 1000.0, True)
    ]


@pytest.mark.parametrize("delimiter", [";", "|"])
def test_delimiter_and_lines_before_the_header(spark, tmp_path, delimiter):
    body = "\n".join(["skip", "v;w|x", delimiter.join("ab"), delimiter.join("12"), delimiter.join("ab"), ""])
    df = read_csv(spark, write(tmp_path, "b.csv", body), delimiter, header_row=2)
    assert df.columns == ["a", "b"]
    # A data line that repeats the header stays.
    assert sorted(tuple(r) for r in df.collect()) == [("1", "2"), ("a", "b")]


def test_each_file_has_its_own_skipped_lines(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(3):
        write(folder, f"{i}.csv", f"noise {i}\nk,v\n{i},0.5\n{i},1.5\n")
    df = read_csv(spark, str(folder), header_row=1)
    assert types(df) == ["bigint", "double"]
    assert sorted(tuple(r) for r in df.collect()) == [(i, v) for i in range(3) for v in (0.5, 1.5)]


def test_whitespace_delimiter(spark, tmp_path):
    df = read_csv(spark, write(tmp_path, "c.txt", "a   b\n1  x\n 2\ty\n"), WHITESPACE)
    assert types(df) == ["bigint", "string"]
    assert sorted(tuple(r) for r in df.collect()) == [(1, "x"), (2, "y")]


def test_union_widens_and_fills(spark):
    one = spark.createDataFrame([(1, 10, "X")], "id int, value int, city string")
    two = spark.createDataFrame([(2, 1.5, True)], "id bigint, value double, flag boolean")
    df = union_sources({"one": one, "two": two})
    assert dict(zip(df.columns, types(df))) == {
        "id": "bigint", "value": "double", "city": "string", "flag": "boolean", SOURCE: "string"
    }
    assert sorted(tuple(r) for r in df.select("id", "value", SOURCE).collect()) == [
        (1, 10.0, "one"), (2, 1.5, "two")
    ]
    assert common_columns({"one": one, "two": two}) == [("id", "Numerical"), ("value", "Numerical")]


def test_number_and_text_become_text(spark):
    a = spark.createDataFrame([(1,)], "value int")
    b = spark.createDataFrame([("hello",)], "value string")
    df = union_sources({"a": a, "b": b})
    assert sorted(r.value for r in df.collect()) == ["1", "hello"]
    assert common_columns({"a": a, "b": b}, ["a"]) == [("value", "Categorical")]
    assert supertype_schema([a.schema, b.schema]).fields[0].dataType.simpleString() == "string"


def test_choice_limit_and_isolation(spark):
    sources = {n: spark.range(5).withColumn("n", F.lit(n)) for n in ("a", "b")}
    assert union_sources(sources, ["b", "unknown"]).count() == 5
    assert union_sources(sources, []).count() == 0
    assert union_sources(sources, limit_per_source=2).count() == 4
    assert only_sources(union_sources(sources), ["a"]).count() == 5
    assert only_sources(union_sources(sources), []).count() == 0
    assert preview(sources["a"], 3).count() == 3
    with pytest.raises(ValueError):
        union_sources({})


@pytest.mark.parametrize("format", ["parquet", "csv"])
def test_write(spark, tmp_path, format):
    path = str(tmp_path / "out")
    write_scored(spark.range(10).withColumn("segment", F.col("id") % 2), path, format, partition_by=["segment"])
    reader = spark.read.option("header", True).option("inferSchema", True).format(format)
    assert reader.load(path).filter("segment = 1").count() == 5


def test_csv_with_missing_integers_quotes_and_infinities(spark, tmp_path):
    body = 'a,b,c,d,e\n9007199254740993,"say ""hi"", ok",inf,"c:\\",true\n,x,-inf,y,\n3,,1.5,z,FALSE\n'
    df = read_csv(spark, write(tmp_path, "q.csv", body))
    assert types(df) == ["bigint", "string", "double", "string", "boolean"]
    rows = [tuple(r) for r in df.collect()]
    inf = float("inf")
    assert rows == [(9007199254740993, 'say "hi", ok', inf, "c:\\", True), (None, "x", -inf, "y", None), (3, None, 1.5, "z", False)]
    skipped = read_csv(spark, write(tmp_path, "q1.csv", "noise\n" + body), header_row=1)
    assert types(skipped) == types(df) and [tuple(r) for r in skipped.collect()] == rows


@pytest.fixture()
def small_splits(spark):
    """Files are read in splits of few bytes."""
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "48")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_line_breaks_in_cells(spark, tmp_path):
    path = write(tmp_path, "m.csv", 'a,b\n1,"two\nlines"\n2,x\n')
    assert rows(read_csv(spark, path)) == rows(read_csv(spark, path, multi_line=True)) == [(1, "two\nlines"), (2, "x")]
    skipped = write(tmp_path, "m1.csv", 'said "so\n\na,b\r\n1,"a\r\nb"\r\n2,c\r\n')
    assert rows(read_csv(spark, skipped, header_row=2)) == [(1, "a\nb"), (2, "c")]
    typed = read_csv(spark, path, schema=StructType.fromDDL("a string, b string"))
    assert rows(typed) == [("1", "two\nlines"), ("2", "x")]
    with pytest.raises(ValueError, match="one character"):
        read_csv(spark, path, delimiter="::", multi_line=True)


def test_quotes_within_cells_are_characters(spark, tmp_path):
    path = write(tmp_path, "p.csv", 'a,b\n1,5" pipe\n2,"6"" pipe"\n3,x"y"z\n')
    assert rows(read_csv(spark, path)) == [(1, '5" pipe'), (2, '6" pipe'), (3, 'x"y"z')]
    path = write(tmp_path, "p1.csv", 'noise "\na;b\n1;5" pipe\n2;"6\n7"\n')
    assert rows(read_csv(spark, path, delimiter=";", header_row=1)) == [(1, '5" pipe'), (2, "6\n7")]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


CELLS = ["", "x", "two\nlines", "\n", 'say "hi"', '"', '""', "a,b", 'end"\n"begin', "é" * 30, "\n\n\n" + "long " * 40 + "\n", ' 5" pipe', '"\n,"']


@pytest.mark.parametrize("seed", range(4))
def test_records_of_many_splits(spark, tmp_path, small_splits, seed):
    """Against Python's own reader; cells hold breaks, quotes and delimiters, and some span several splits."""
    rng = random.Random(seed)
    expected = []
    folder = tmp_path / "many"
    folder.mkdir()
    for name in ("x.csv", "y.csv"):
        table = [[str(i), rng.choice(CELLS), rng.choice(CELLS)] for i in range(60)]
        out = io.StringIO()
        out.write("noise with a quote \" here\n")
        writer = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
        writer.writerows([["k", "a", "b"], *table])
        (folder / name).write_text(out.getvalue())
        text = out.getvalue().split("\n", 1)[1]
        expected += [tuple(r) for r in list(csv.reader(io.StringIO(text, newline="")))[1:]]
    lines = with_maps(lines_of(spark, str(folder)), ",", 1)
    assert lines.rdd.getNumPartitions() > 20
    found = records_of(lines).filter("position is null or position > 1")
    assert sorted(r["value"].rstrip("\r") for r in found.collect()) == sorted(_raw(folder))
    schema = StructType.fromDDL("k string, a string, b string")
    got = read_csv(spark, str(folder), header_row=1, schema=schema, multi_line=True)
    assert rows(got.fillna("")) == sorted(expected, key=repr)


def _raw(folder):
    """The records as they stand in the files, cut by a state machine over characters."""
    for path in folder.iterdir():
        text = path.read_bytes().decode().split("\n", 1)[1]
        inside, at_start, record, found, i = False, True, "", [], 0
        while i < len(text):
            c = text[i]
            if inside and c == '"':
                if text[i + 1 : i + 2] == '"':
                    record += '"'
                    i += 1
                else:
                    inside = False
            elif at_start and c == '"':
                inside = True
            elif c == "\n" and not inside:
                found.append(record.rstrip("\r"))
                record, at_start, i = "", True, i + 1
                continue
            record += c
            at_start = c == "," and not inside
            i += 1
        yield from found[1:]


def test_a_record_that_is_never_closed_ends_with_its_file(spark, tmp_path, small_splits):
    path = write(tmp_path, "o.csv", "a,b\n1,x\n2,\"" + "open\n" * 40)
    assert rows(read_csv(spark, path))[0] == (1, "x")
    assert len(rows(read_csv(spark, path))) == 2


def test_ragged_rows(spark, tmp_path):
    df = read_csv(spark, write(tmp_path, "r.csv", "a,b\n1,2,3\n4\n"))
    assert [tuple(r) for r in df.collect()] == [(1, 2), (4, None)]


def _files(path):
    return {p.name: len(list(p.glob("part-*"))) for p in path.iterdir() if p.is_dir()}


def test_segments_have_few_files_and_hot_ones_are_split(spark, tmp_path):
    segment = F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 10).alias("segment")
    rows = spark.range(0, 200_000, 1, 16).select("id", segment, F.sha2(F.col("id").cast("string"), 256).alias("body"))
    write_scored(rows, str(tmp_path / "plain"), partition_by=["segment"], rebalance=False)
    assert set(_files(tmp_path / "plain").values()) == {16}
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m")
    try:
        write_scored(rows, str(tmp_path / "few"), partition_by=["segment"])
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    files = _files(tmp_path / "few")
    assert files["segment=0"] > 2 and all(files[f"segment={i}"] <= 2 for i in (7, 8, 9))
    assert spark.read.parquet(str(tmp_path / "few")).count() == 200_000


def test_rerunning_one_segment_replaces_it_only(spark, tmp_path):
    path = str(tmp_path / "scored")
    rows = spark.range(100).select("id", (F.col("id") % 4).alias("segment"))
    write_scored(rows, path, partition_by=["segment"])
    for _ in range(2):
        write_scored(rows.filter("segment = 2").withColumn("id", F.col("id") + 1000), path, partition_by=["segment"], replace_partitions=True)
        got = {r.segment: (r.n, r.low) for r in spark.read.parquet(path).groupBy("segment").agg(F.count("*").alias("n"), F.min("id").alias("low")).collect()}
        assert got == {0: (25, 0), 1: (25, 1), 2: (25, 1002), 3: (25, 3)}
    with pytest.raises(ValueError):
        write_scored(rows, path, replace_partitions=True)


def test_whitespace_files_grow_in_number_not_in_size(spark, tmp_path, monkeypatch):
    from catalog import sources

    rows = [(k, k % 4 + 1, float(k % 7)) for k in range(40)] + [(None, 1, 1.0), (7, 2, None)]
    items = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double")
    items.repartition(4, F.col("l_linenumber") + F.pmod("l_orderkey", F.lit(5))).write.parquet(str(tmp_path / "lineitem.parquet"))
    for files, name in [(3, "empty"), (6, "rows")]:
        path = tmp_path / name
        monkeypatch.setattr(sources, "shared_folder", lambda _, path=path: str(path))
        given = tmp_path
        if name == "empty":
            given = tmp_path / "none"
            items.limit(0).write.parquet(str(given / "lineitem.parquet"))
        got = sources.csv_whitespace(spark, str(given)).collect()
        texts = [f.read_text() for f in path.rglob("part-*")]
        assert len(texts) >= files
        assert all(text.startswith("l_orderkey l_linenumber\tl_quantity\n") for text in texts)
        lines = sorted(x for text in texts for x in text.split("\n")[1:] if x)
        if name == "empty":
            assert got == [] and lines == []
        else:
            # A row that lacks a cell is no line.
            assert lines == sorted(f" {k} \t {n}   {q}\t" for k, n, q in rows[:40])
            assert {r["l_linenumber"]: (r["n"], r["keys"]) for r in got} == {n + 1: (10, sum(range(n, 40, 4))) for n in range(4)}
