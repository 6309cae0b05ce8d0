"""One folder per company: the files against those of Spark's own partitioned writer, and what a second export replaces."""
import datetime
from pathlib import Path

from rolecall.sinks import exports as X

SCHEMA = "domain string, title string, n bigint, price double, posted date, seen timestamp"
DAY, SEEN = datetime.date(2024, 2, 29), datetime.datetime(2024, 2, 29, 1, 2, 3, 456000)
ROWS = [("a", "plain", 1, 0.1, DAY, SEEN), ("a", None, None, None, None, None), ("a", "", 2, 1e20, DAY, SEEN),
        ("b:80/x=1 %", 'say "hi", \\ there', 3, -0.0, DAY, SEEN), ("é[^]", "two\nlines\r\n", 4, 2.0, DAY, SEEN), ("é[^]", "  spaced\t", 5, 2.5, DAY, None),
        (None, "nobody's", 6, 3.0, None, SEEN), ("", "no name", 7, 4.0, DAY, SEEN), ("A", "=1+1", 8, 5.0, DAY, SEEN), ("a", "plain", 1, 0.1, DAY, SEEN)]
FIELDS = ["title", "n", "price", "posted", "seen"]


def held(path):
    """Bytes of each company's files, without their headers; headers; names of all files."""
    out, headers = {}, set()
    for file in Path(path).glob("domain=*/*.csv"):
        header, body = file.read_bytes().split(b"\n", 1)
        headers.add(header)
        out[file.parent.name] = out.get(file.parent.name, b"") + body
    return {k: sorted(v) for k, v in out.items()}, headers, [f.name for f in Path(path).glob("domain=*/.*")]


def test_files_are_those_of_the_partitioned_writer(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    X.write_companies(rows, str(tmp_path / "own"), FIELDS)
    (X.export_columns(rows, FIELDS, "domain").write.partitionBy("domain").option("header", True).csv(str(tmp_path / "plain")))
    own, headers, hidden = held(tmp_path / "own")
    assert (own, headers) == held(tmp_path / "plain")[:2]
    assert hidden == []  # no file was made by Spark's local file system, which starts processes for each
    assert sorted(p.name for p in (tmp_path / "own").iterdir() if not p.name.startswith("domain=")) == ["_SUCCESS"]


def test_only_companies_written_are_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    rows = spark.createDataFrame(ROWS, SCHEMA)
    X.write_companies(rows, path, FIELDS)
    X.write_companies(spark.createDataFrame([("a", "new", 9, 1.0, DAY, SEEN)], SCHEMA), path, FIELDS)
    back = X.read_companies(spark, path, FIELDS).select("domain", "n").collect()
    assert sorted((str(r.domain), r.n) for r in back if r.domain != "é[^]") == [("A", "8"), ("None", "6"), ("None", "7"), ("a", "9"), ("b:80/x=1 %", "3")]


def test_a_company_of_many_rows_takes_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "PER_FILE", 40)
    rows = spark.range(100).selectExpr("'big' as domain", "cast(id as string) as title")
    X.write_companies(rows.unionByName(rows.limit(3).selectExpr("'small' as domain", "title")), str(tmp_path / "out"), ["title"], filtered=True)
    assert X.read_companies(spark, str(tmp_path / "out_filtered"), ["title"]).filter("domain = 'big'").distinct().count() == 100
    X.write_companies(rows.limit(0), str(tmp_path / "none"), ["title"])
    assert X.read_companies(spark, str(tmp_path / "none"), ["title"]).count() == 0


def test_folders_are_listed_by_tasks_and_read_as_by_sparks_source(spark, tmp_path):
    path = f"{tmp_path}/out"
    X.write_companies(spark.createDataFrame(ROWS, SCHEMA), path, FIELDS)
    Path(path, "domain=a", "part-1.csv").write_bytes(b'\n \t\nhead\r\nx,1\r"y ""z"",",2,3,4,5,6\n\n"",,,,\xff\n\xc3\xa9')
    Path(path, "domain=a", "part-2.csv").write_bytes(b"")
    Path(path, "domain=a", "_hidden.csv").write_bytes(b"h\nx\n")
    Path(path, "domain=none").mkdir()
    back = X.read_companies(spark, path, FIELDS)
    assert back.inputFiles() == []  # a file source would name every file here, kept on the driver
    schema = ", ".join(f"`{f}` string" for f in [*FIELDS, "domain"])
    plain = spark.read.option("header", True).schema(schema).csv(path)
    assert back.columns == plain.columns and [f.dataType for f in back.schema] == [f.dataType for f in plain.schema]
    assert sorted(map(repr, back.collect())) == sorted(map(repr, plain.collect()))
    assert sorted(back.groupBy("domain").count().collect(), key=str) == sorted(plain.groupBy("domain").count().collect(), key=str)
