import pytest
from pyspark.sql import functions as F

from tabsight.plans import ingest
from tabsight.sources import dates, detect_source_kind, load_csv, load_json, load_table, project, promote_datetimes, where_equals


def put(folder, name, content: bytes) -> str:
    path = folder / name
    path.write_bytes(content)
    return str(path)


def test_malformed_lines(spark, tmp_path):
    path = put(tmp_path, "a.csv", b'x,y\n1,a\n2\n3,b,extra\n4,"q,""r"\n')
    rows = sorted(tuple(r) for r in load_csv(spark, path).collect())
    assert rows == [(1, "a"), (2, None), (4, 'q,"r')]


def test_missing_words_and_types(spark, tmp_path):
    path = put(tmp_path, "a.csv", b"i,j,d,s,b,e\n1,2,1.5,NA,True,\n2,N/A,nan,x,False,NULL\n")
    df = load_csv(spark, path)
    assert df.dtypes == [("i", "bigint"), ("j", "double"), ("d", "double"), ("s", "string"), ("b", "boolean"), ("e", "double")]
    assert df.where("j is null and d is null").count() == 1 and df.where("s is null").count() == 1


def test_latin1_tab_and_mark(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    put(folder, "a.tsv", "name\tn\ncafé\t1\n".encode("latin-1"))
    put(folder, "b.tsv", "name\tn\nthé\t2\n".encode("utf-8"))
    rows = sorted(tuple(r) for r in load_csv(spark, str(folder)).collect())
    assert rows == [("café", 1), ("thé", 2)]
    path = put(tmp_path, "bom.csv", b"\xef\xbb\xbfk;v\n1;2\n3;4\n")
    assert load_csv(spark, path).columns == ["k", "v"] and load_csv(spark, path).count() == 2


def test_csv_shaping(spark, tmp_path):
    path = put(tmp_path, "a.csv", b"x,y\n3,a\n1,a\n2,b\n")
    got = load_csv(spark, path, columns=["x", "y"], filters={"y": "a"}, row_limit=1, order_by=["x"]).collect()
    assert [tuple(r) for r in got] == [(1, "a")]
    with pytest.raises(ValueError):
        load_csv(spark, path, columns=["x", "absent"])


def test_json_shapes(spark, tmp_path):
    nested = b'[{"id":1,"user":{"name":"a","geo":{"lat":1.0}},"tags":["t"]}]'
    df = load_json(spark, put(tmp_path, "list.json", nested))
    assert sorted(df.columns) == ["id", "tags", "user.geo.lat", "user.name"] and df.count() == 1
    wrapped = b'{"rows":[{"a":9}],"items":[{"a":1},{"a":2}],"meta":3}'
    df = load_json(spark, put(tmp_path, "wrapped.json", wrapped), columns=["a", "zzz"])
    assert sorted(r["a"] for r in df.collect()) == [1, 2]
    assert load_json(spark, put(tmp_path, "one.json", b'{"a":1,"data":5}')).first()["data"] == 5


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(10).withColumn("g", F.col("id") % 2).write.parquet(path)
    assert load_table(spark, path, columns=["id"], filters={"g": 1}, row_limit=2, order_by=["id"]).collect()[1][0] == 3
    spark.read.parquet(path).createOrReplaceTempView("some_table")
    assert load_table(spark, "some_table").count() == 10
    with pytest.raises(ValueError):
        load_table(spark, "jdbc:postgresql://host/db")


def test_kinds():
    kinds = {"a/b.tsv": "csv", "x.json": "json", "s3://b/t.parquet": "parquet", "jdbc:x:y": "jdbc", "db.orders": "table", "a/b.txt": "csv"}
    assert {k: detect_source_kind(k) for k in kinds} == kinds


def test_dates(spark):
    rows = [("2024-01-01", "2024-01-01", None, "01 Feb 2024"), ("2024-01-02", "nope", None, "02 Mar 2024"), ("2024-02-30"[:8] + "03", "2024-01-03", "2024-01-01", "03 Mar 2024")]
    df = promote_datetimes(spark.createDataFrame(rows, "good string, bad string, sparse string, named string"))
    assert [t for _, t in df.dtypes] == ["timestamp", "string", "string", "timestamp"]


def test_filters_and_projection(spark):
    df = spark.createDataFrame([(1, "o'x"), (2, None)], "a int, b string")
    assert where_equals(df, {"b": "o'x"}).count() == 1 and where_equals(df, {"b": None, "a": 2}).count() == 1
    assert project(df, ["b", "zz"], strict=False).columns == ["b"]


def test_empty_source(spark, tmp_path):
    with pytest.raises(ValueError):
        ingest(spark, spark.range(0))


def test_awkward_path(spark, tmp_path):
    folder = tmp_path / "a b%20c"
    folder.mkdir()
    assert load_csv(spark, put(folder, "x y.csv", b"k,v\n1,2\n")).first()["v"] == 2


def test_breaks_in_quotes_and_other_header_orders(spark, tmp_path):
    path = put(tmp_path, "b.csv", b'k,t,n\n1,"line one\nline two",5\n2,"say ""hi""",6\n')
    assert sorted(tuple(r) for r in load_csv(spark, path).collect()) == [(1, "line one\nline two", 5), (2, 'say "hi"', 6)]
    folder = tmp_path / "heads"
    folder.mkdir()
    put(folder, "a.csv", b"a,b\n1,x\n")
    put(folder, "b.csv", b"b,a\ny,2\n")
    put(folder, "c.csv", b"b;a\nz;3\n")
    got = load_csv(spark, str(folder)).select("a", "b").collect()
    assert sorted(tuple(r) for r in got) == [(1, "x"), (2, "y"), (3, "z")]


def test_lines_are_told_from_documents(spark, tmp_path):
    assert load_json(spark, put(tmp_path, "l.json", b'{"a":1}\n{"a":2}\n\n{"a":3}\n')).count() == 3
    folder = tmp_path / "both"
    folder.mkdir()
    put(folder, "l.json", b'{"a":1}\n{"a":2}\n')
    put(folder, "d.json", b'[\n {"a":3},\n {"a":4}\n]\n')
    assert sorted(r["a"] for r in load_json(spark, str(folder)).collect()) == [1, 2, 3, 4]


def test_sources_that_are_refused():
    for source in ("a.xlsx", "dir/b.XLS", "x.db", "y.sqlite", "https://example.com/a.csv"):
        with pytest.raises(ValueError):
            detect_source_kind(source)
    assert detect_source_kind("a/b.jsonl") == detect_source_kind("b.ndjson") == "json"


@pytest.mark.parametrize(
    "value", ["2024-01-02T03:04:05Z", "2024-01-02T05:04:05+02:00", "2024-01-02T03:04:05.000Z", "2024-01-02 03:04:05.000"]
)
def test_everyday_layouts(spark, value):
    got = promote_datetimes(spark.createDataFrame([(value,)], "t string"))
    assert got.select(F.date_format("t", "yyyy-MM-dd HH:mm:ss")).first()[0] == "2024-01-02 03:04:05"


@pytest.mark.parametrize("values", [["1/2/2024", "12/25/2024"], ["Jan 5, 2024", "Feb 15, 2024"], ["5 Jan 2024", "15 Feb 2024"], ["2024-01-01 10:30"]])
def test_short_layouts(spark, values):
    got = promote_datetimes(spark.createDataFrame([(v,) for v in values], "t string"))
    assert got.dtypes == [("t", "timestamp")] and got.where("t IS NULL").count() == 0


def test_shapes_of_layouts():
    assert dates.layout_shapes("M/d/yyyy") == {"9/9/9999", "9/99/9999", "99/9/9999", "99/99/9999"}
    assert dates.layout_shapes("yyyy-MM-dd'T'HH:mmXXX") == {"9999-99-99a99:99a", "9999-99-99a99:99+99:99", "9999-99-99a99:99-99:99"}


def test_shapes_of_columns(spark):
    rows = [("2024-01-02", "1/2/2024", "x", None), ("2024-13-02", "11/12/2024", "2024-01-01", None), (None, "1/12/2024", "2024-01-02", None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    known = dates.layout_shapes("yyyy-MM-dd") | dates.layout_shapes("M/d/yyyy")
    got = dates.column_shapes(df, list("abcd"), known)
    assert got == {"a": (2 / 3, {"9999-99-99"}), "b": (1.0, {"9/9/9999", "99/99/9999", "9/99/9999"}), "c": None, "d": (0.0, set())}
    # A shape that fits is not enough: 2024-13-02 is no date.
    assert [f.dataType.typeName() for f in promote_datetimes(df).schema.fields] == ["string", "timestamp", "string", "string"]
    assert promote_datetimes(df.limit(0)).schema == df.schema
