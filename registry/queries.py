"""Every registered query with, where SQL can express it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsight.functions.order import dense_position
from tabsight.operators import (
    bivariate,
    charts,
    evaluate,
    features,
    problem,
    profile,
    rules,
    segments,
    series,
    shape,
    train,
    univariate,
)
from tabsight.plans import analyze, explore, ingest, model
from tabsight.session import materialise, scratch_path
from tabsight.sources import load_csv, load_json, load_table, project, promote_datetimes, where_equals

from . import data, oracle
from .data import SQL
from .oracle import r

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def round_columns(df: DataFrame, columns, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_CATEGORIES = ["l_returnflag", "l_linestatus"]
SIGNAL_NUMBERS = ["user_id", "value", "amount", "penalty", "wave"]
SIGNAL_CATEGORIES = ["event_type", "channel"]
L, O, E, P, S = (SQL[k] for k in ("lineitem_gaps", "orders_gaps", "events_gaps", "priced_lines", "signals"))
RP, CP = SQL["regression_predictions"], SQL["class_predictions"]

# --- sources ----------------------------------------------------------------------------


def _written(df: DataFrame, label: str, fmt: str, **options) -> str:
    """The given table written by Spark in another format, to be read back."""
    path = scratch_path(df.sparkSession, label)
    df.write.options(**options).format(fmt).save(path)
    return path


@query("csv_scan", f"SELECT * FROM {O}")
def csv_scan(spark, d):
    # Gaps are written as "missing" words, which the reader must recognise.
    o = data.orders_gaps(spark, d)
    text = o.withColumns(
        {
            "o_totalprice": F.coalesce(F.col("o_totalprice").cast("string"), F.lit("N/A")),
            "o_orderpriority": F.coalesce("o_orderpriority", F.lit("null")),
            "o_orderdate": F.coalesce(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("NaN")),
        }
    )
    got = load_csv(spark, _written(text, "csv", "csv", header=True))
    return promote_datetimes(got).withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@query(
    "csv_quoted_breaks",
    "SELECT conv_id, turn, role, text FROM conversations",
)
def csv_quoted_breaks(spark, d):
    """Texts with line breaks and quotes, in quoted fields."""
    path = _written(data.table(spark, d, "conversations"), "breaks", "csv", header=True, quoteAll=True, escape='"')
    return load_csv(spark, path)


@query("csv_mixed_headers", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_mixed_headers(spark, d):
    """Files of one folder whose headers list the columns in another order."""
    c = data.table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    path = scratch_path(spark, "headers")
    for name, part, order in (("a", 0, ["c_custkey", "c_name", "c_acctbal"]), ("b", 1, ["c_acctbal", "c_custkey", "c_name"])):
        c.where(F.col("c_custkey") % 2 == part).select(*order).write.csv(f"{path}/{name}", header=True)
    return load_csv(spark, f"{path}/*")


@query("tsv_scan", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def tsv_scan(spark, d):
    path = _written(data.table(spark, d, "customer"), "tsv", "csv", header=True, sep="\t")
    return load_csv(spark, path)


# Latin-1 text: what it cannot hold, and the breaks that the CSV twin does not tell apart.
_LATIN = "regexp_replace(text, '[^\\x{20}-\\x{7E}\\x{A1}-\\x{FF}]', '?', 'g')"


@query("latin1_csv_scan", f"SELECT doc_id, nullif(trim({_LATIN}), '') AS text, lang, source, n_chars FROM documents")
def latin1_csv_scan(spark, d):
    plain = F.regexp_replace("text", "[^\\x20-\\x7E\\xA1-\\xFF]", "?")
    docs = data.table(spark, d, "documents").withColumn("text", F.trim(plain))
    path = _written(docs, "latin1", "csv", header=True, encoding="ISO-8859-1", quoteAll=True, escape='"')
    return load_csv(spark, path)


@query(
    "csv_projection_filter_limit",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 100",
)
def csv_projection_filter_limit(spark, d):
    path = _written(data.table(spark, d, "orders"), "csv", "csv", header=True)
    return load_csv(
        spark,
        path,
        columns=["o_orderkey", "o_orderstatus"],
        filters={"o_orderstatus": "F"},
        row_limit=100,
        order_by=["o_orderkey"],
    )


@query(
    "json_records",
    """SELECT event_id AS id, user_id AS "user.id", event_type AS "user.act.type", value AS "user.act.value" FROM events""",
)
def json_records(spark, d):
    e = data.table(spark, d, "events")
    act = F.struct(F.col("event_type").alias("type"), F.col("value"))
    nested = e.select(F.col("event_id").alias("id"), F.struct(F.col("user_id").alias("id"), act.alias("act")).alias("user"))
    return load_json(spark, _written(nested, "json", "json"), lines=True).select(
        "id", "`user.id`", "`user.act.type`", "`user.act.value`"
    )


@query("json_lines_detected", "SELECT event_id, user_id, event_type, value, props FROM events")
def json_lines_detected(spark, d):
    """Line-delimited records, without being told."""
    e = data.table(spark, d, "events").drop("ts")
    return load_json(spark, _written(e, "json", "json"))


@query("json_document_wrapped", "SELECT s_suppkey AS id, s_name AS name FROM supplier")
def json_document_wrapped(spark, d):
    """One document a file, over several lines, that wraps its records: a hundred each, however
    many suppliers there are."""
    s = data.table(spark, d, "supplier")
    record = F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))
    rows = s.select(F.expr("s_suppkey div 100").alias("file"), record.alias("r")).groupBy("file").agg(F.array_join(F.collect_list("r"), ",\n").alias("r"))
    document = rows.select("file", F.concat(F.lit('{"status": "ok",\n"results": [\n'), "r", F.lit("\n]}")).alias("value"))
    path = scratch_path(spark, "documents")
    document.repartition("file").sortWithinPartitions("file").write.partitionBy("file").text(path)
    return load_json(spark, f"{path}/*")


@query("json_wrapped_records", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer")
def json_wrapped_records(spark, d):
    c = data.table(spark, d, "customer")
    record = F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    wrapped = c.select(F.lit("ok").alias("status"), F.array(record).alias("results"))
    return load_json(spark, _written(wrapped, "json", "json"), lines=True, columns=["id", "name", "balance", "absent"])


@query("table_scan", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
def table_scan(spark, d):
    return load_table(
        spark,
        f"{d.rstrip('/')}/lineitem.parquet",
        columns=["l_orderkey", "l_partkey", "l_quantity"],
        filters={"l_returnflag": "R", "l_linestatus": "F"},
    )


@query("column_projection", "SELECT p_brand, p_size FROM part")
def column_projection(spark, d):
    return project(data.table(spark, d, "part"), ["p_brand", "absent", "p_size"], strict=False)


@query("equality_filter", f"SELECT o_orderkey, o_custkey FROM {O} WHERE o_orderpriority IS NULL AND o_orderstatus = 'P'")
def equality_filter(spark, d):
    out = where_equals(data.orders_gaps(spark, d), {"o_orderpriority": None, "o_orderstatus": "P"})
    return out.select("o_orderkey", "o_custkey")


@query("row_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 250")
def row_limit(spark, d):
    return load_table(
        spark,
        f"{d.rstrip('/')}/orders.parquet",
        columns=["o_orderkey", "o_totalprice"],
        row_limit=250,
        order_by=["o_totalprice", "o_orderkey"],
    )


@query(
    "date_promotion",
    f"""SELECT o_orderkey, o_orderdate AS day, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || CASE WHEN o_orderkey = 0 THEN '?' ELSE '' END AS stamp,
    CASE WHEN o_orderkey % 3 <> 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS sparse FROM orders""",
)
def date_promotion(spark, d):
    o = data.table(spark, d, "orders")
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = o.select(
        "o_orderkey",
        day.alias("day"),
        F.concat(stamp, F.when(F.col("o_orderkey") == 0, "?").otherwise("")).alias("stamp"),
        F.when(F.col("o_orderkey") % 3 == 0, day).alias("sparse"),
    )
    return promote_datetimes(text).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query(
    "date_layouts",
    """SELECT o_orderkey, o_orderdate AS zulu, o_orderdate AS millis, date_trunc('minute', o_orderdate) AS minutes,
    date_trunc('day', o_orderdate) AS us, date_trunc('day', o_orderdate) AS words FROM orders""",
)
def date_layouts(spark, d):
    o = data.table(spark, d, "orders")
    at = F.col("o_orderdate")
    layouts = {"zulu": "yyyy-MM-dd'T'HH:mm:ss'Z'", "millis": "yyyy-MM-dd HH:mm:ss.SSS", "minutes": "yyyy-MM-dd HH:mm", "us": "M/d/yyyy", "words": "MMM d, yyyy"}
    text = o.select("o_orderkey", *[F.date_format(at, f).alias(c) for c, f in layouts.items()])
    return promote_datetimes(text).withColumns({c: F.col(c).cast("timestamp_ntz") for c in layouts})


# --- profile ----------------------------------------------------------------------------

_METADATA_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
    "l_linestatus", "l_shipdate",
]
_nulls = " + ".join(f"count(*) - count({c})" for c in _METADATA_COLUMNS)


@query(
    "dataset_metadata",
    f"""SELECT count(*) AS row_count, {len(_METADATA_COLUMNS)} AS column_count, {_nulls} AS total_missing_cells,
    count(*) - (SELECT count(*) FROM (SELECT DISTINCT {", ".join(_METADATA_COLUMNS)} FROM {L})) AS duplicate_row_count,
    'table' AS source_type FROM {L}""",
)
def dataset_metadata(spark, d):
    return profile.dataset_metadata(data.lineitem_gaps(spark, d).select(*_METADATA_COLUMNS))


@query(
    "duplicate_documents",
    """SELECT count(*) AS row_count, 3 AS column_count, 0 AS total_missing_cells,
    count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source FROM documents)) AS duplicate_row_count,
    'table' AS source_type FROM documents""",
)
def duplicate_documents(spark, d):
    return profile.dataset_metadata(data.table(spark, d, "documents").select("text", "lang", "source"))


@query(
    "missing_values",
    oracle.union(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing FROM {O} HAVING count(*) > count({c})"""
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    ),
)
def missing_values(spark, d):
    return profile.missing_values(data.orders_gaps(spark, d))


_order_nulls = " + ".join(f"count(*) - count({c})" for c in ("o_totalprice", "o_orderdate", "o_orderpriority"))


@query(
    "missing_share",
    f"SELECT {_order_nulls} AS total_missing_cells, {r(f'({_order_nulls}) * 100.0::DOUBLE / (count(*) * 6)', 1)} AS missing_pct FROM {O}",
)
def missing_share(spark, d):
    return profile.missing_share(data.orders_gaps(spark, d))


@query(
    "data_size",
    """SELECT sum(8 + 8 + strlen(text) + strlen(lang) + strlen(source))::BIGINT AS data_bytes,
    round(sum(8 + 8 + strlen(text) + strlen(lang) + strlen(source)) / 1048576.0::DOUBLE, 3) AS data_mb FROM documents""",
)
def data_size(spark, d):
    return profile.data_size(data.table(spark, d, "documents"))


_ORDER_COLUMNS = [
    ("o_orderkey", "bigint", "numeric"),
    ("o_custkey", "bigint", "numeric"),
    ("o_orderstatus", "string", "categorical"),
    ("o_totalprice", "double", "numeric"),
    ("o_orderdate", "timestamp_ntz", "datetime"),
    ("o_orderpriority", "string", "categorical"),
]
_DOCUMENT_COLUMNS = [
    ("doc_id", "bigint", "numeric"),
    ("text", "string", "categorical"),
    ("lang", "string", "categorical"),
    ("source", "string", "categorical"),
    ("n_chars", "bigint", "numeric"),
]


@query("column_summary", oracle.column_summary(O, _ORDER_COLUMNS))
def column_summary(spark, d):
    return profile.column_summary(data.orders_gaps(spark, d))


@query("column_summary_documents", oracle.column_summary("documents", _DOCUMENT_COLUMNS))
def column_summary_documents(spark, d):
    return profile.column_summary(data.table(spark, d, "documents"))


@query("preview", "SELECT * FROM customer ORDER BY c_custkey LIMIT 5")
def preview(spark, d):
    return profile.preview(data.table(spark, d, "customer"), order_by=["c_custkey"])


_details = f"""SELECT s.position, s."column", dtype, non_null, null_pct, "unique", top_value, s.mean, n.std, s.min, n.q1, n.median, n.q3,
    s.max, n.skewness, n.kurtosis FROM ({oracle.column_summary(O, _ORDER_COLUMNS)}) s
    LEFT JOIN ({oracle.numeric_univariate(O, ["o_orderkey", "o_custkey", "o_totalprice"], 4)}) n ON n."column" = s."column" """


@query("column_details", _details)
def column_details(spark, d):
    return profile.column_details(data.orders_gaps(spark, d))


@query("sample_rows", "SELECT event_id, ts, event_type, value FROM events ORDER BY ts, event_id LIMIT 50")
def sample_rows(spark, d):
    e = data.table(spark, d, "events").select("event_id", "ts", "event_type", "value")
    return profile.sample_rows(e, order_by=["ts", "event_id"])


# --- univariate -------------------------------------------------------------------------


@query("numeric_univariate", oracle.numeric_univariate(L, LINE_NUMBERS))
def numeric_univariate(spark, d):
    return univariate.numeric_univariate(data.lineitem_gaps(spark, d), LINE_NUMBERS, ndigits=6)


@query(
    "iqr_outliers",
    f"""SELECT "column", count, outlier_lower_bound AS lower_bound, outlier_upper_bound AS upper_bound, outlier_count
    FROM ({oracle.numeric_univariate(S, SIGNAL_NUMBERS)})""",
)
def iqr_outliers(spark, d):
    return univariate.iqr_outliers(data.signals(spark, d), SIGNAL_NUMBERS, ndigits=6)


@query("categorical_univariate", oracle.categorical_univariate(O, ["o_orderstatus", "o_orderpriority"]))
def categorical_univariate(spark, d):
    return univariate.categorical_univariate(data.orders_gaps(spark, d))


@query("top_values", oracle.top_values("documents", ["text", "lang", "source"]))
def top_values(spark, d):
    return univariate.top_values(data.table(spark, d, "documents"))


@query("datetime_univariate", oracle.datetime_univariate(O, "o_orderdate"))
def datetime_univariate(spark, d):
    return univariate.datetime_univariate(data.orders_gaps(spark, d))


@query("datetime_univariate_events", oracle.datetime_univariate("events", "ts"))
def datetime_univariate_events(spark, d):
    return univariate.datetime_univariate(data.table(spark, d, "events"))


# --- bivariate --------------------------------------------------------------------------


@query("correlation_matrix", oracle.correlations(L, LINE_NUMBERS))
def correlation_matrix(spark, d):
    return round_columns(bivariate.correlation_matrix(data.lineitem_gaps(spark, d), LINE_NUMBERS), ["r"])


WIDE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("correlation_wide", oracle.correlations(L, WIDE_NUMBERS))
def correlation_wide(spark, d):
    return round_columns(bivariate.correlation_matrix(data.lineitem_gaps(spark, d), WIDE_NUMBERS), ["r"])


def _spearman_sql(src: str, columns) -> str:
    parts = []
    for i, a in enumerate(columns):
        for j in range(i + 1, len(columns)):
            b = columns[j]
            ranks = ", ".join(
                f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS r_{n}"
                for n, c in (("a", a), ("b", b))
            )
            parts.append(
                f"SELECT {i} AS i, {j} AS j, '{a}' AS a, '{b}' AS b, {r('corr(r_a, r_b)')} AS r "
                f"FROM (SELECT {ranks} FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
            )
    return oracle.union(parts)


@query("rank_correlation", _spearman_sql(E, ["user_id", "value"]))
def rank_correlation(spark, d):
    e = data.events_gaps(spark, d)
    return round_columns(bivariate.correlation_matrix(e, ["user_id", "value"], "spearman"), ["r"])


_PRICED = ["l_quantity", "list_price", "taxed_price", "headroom", "flagged_price"]


@query("strong_correlations", oracle.strong(P, _PRICED))
def strong_correlations(spark, d):
    pairs = bivariate.correlation_matrix(data.priced_lines(spark, d), _PRICED)
    return bivariate.strong_correlations(pairs, ndigits=6)


@query("grouped_statistics", oracle.grouped_statistics(L, LINE_CATEGORIES, ["l_quantity", "l_extendedprice", "l_tax"]))
def grouped_statistics(spark, d):
    return bivariate.grouped_statistics(
        data.lineitem_gaps(spark, d), LINE_CATEGORIES, ["l_quantity", "l_extendedprice", "l_tax"]
    )


@query(
    "crosstab",
    f"""SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS count FROM {L}
    WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY ALL""",
)
def crosstab(spark, d):
    return bivariate.crosstab(data.lineitem_gaps(spark, d), "l_returnflag", "l_linestatus")


@query("cramers_v", oracle.association(O, "o_orderstatus", "o_orderpriority"))
def cramers_v(spark, d):
    return bivariate.cramers_v(data.orders_gaps(spark, d), "o_orderstatus", "o_orderpriority", ndigits=6)


@query("cramers_v_2x2", oracle.association(f"(SELECT * FROM {L} WHERE l_returnflag IN ('A', 'R'))", "l_returnflag", "l_linestatus"))
def cramers_v_2x2(spark, d):
    two = data.lineitem_gaps(spark, d).where(F.col("l_returnflag").isin("A", "R"))
    return bivariate.cramers_v(two, "l_returnflag", "l_linestatus", ndigits=6)


_dated = f"""(SELECT *, 'Q' || quarter(o_orderdate) AS quarter, CASE WHEN o_totalprice > 250000 THEN 'big' WHEN o_totalprice <= 250000 THEN 'small' END AS size FROM {O})"""
_DATED = ["o_orderstatus", "o_orderpriority", "quarter", "size"]


def dated_orders(spark, d):
    price = F.col("o_totalprice")
    return data.orders_gaps(spark, d).withColumns(
        {
            "quarter": F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")),
            "size": F.when(price > 250000, "big").when(price <= 250000, "small"),
        }
    )


@query(
    "categorical_associations",
    "SELECT a, b, cramers_v, n_rows, n_cols FROM ("
    + oracle.union(oracle.association(_dated, a, b) for i, a in enumerate(_DATED) for b in _DATED[i + 1 :])
    + ")",
)
def categorical_associations(spark, d):
    return bivariate.categorical_associations(dated_orders(spark, d), _DATED, ndigits=6)


# --- shape ------------------------------------------------------------------------------

_HIST = ["l_quantity", "l_extendedprice", "l_linenumber"]
_SHAPED = ["value", "penalty", "wave", "user_id"]


@query(
    "auto_histogram",
    f"""SELECT "column", bin, {r('low')} AS low, {r('high')} AS high, count FROM ({oracle.auto_histogram(L, _HIST, {"l_linenumber"})})""",
)
def auto_histogram(spark, d):
    return round_columns(shape.auto_histogram(data.lineitem_gaps(spark, d), _HIST), ["low", "high"])


@query("histogram_peaks", oracle.peaks(L, _HIST, {"l_linenumber"}))
def histogram_peaks(spark, d):
    return shape.histogram_peaks(shape.auto_histogram(data.lineitem_gaps(spark, d), _HIST))


@query("classify_distribution", oracle.shapes(S, _SHAPED, {"user_id"}))
def classify_distribution(spark, d):
    return shape.classify_distribution(data.signals(spark, d), _SHAPED, ndigits=6)


@query("normality_test", oracle.normality(L, LINE_NUMBERS))
def normality_test(spark, d):
    return shape.normality_test(data.lineitem_gaps(spark, d), LINE_NUMBERS)


@query(
    "shapiro_wilk",
    oracle.union([*(oracle.shapiro_wilk(L, c) for c in LINE_NUMBERS), oracle.shapiro_wilk("customer", "c_acctbal")]),
)
def shapiro_wilk(spark, d):
    tables = [(data.lineitem_gaps(spark, d), LINE_NUMBERS), (data.table(spark, d, "customer"), ["c_acctbal"])]
    found = reduce(DataFrame.unionByName, [shape.shapiro_wilk(t, names, ndigits=None) for t, names in tables])
    return found.select("column", "n", F.round("w", 5).alias("w"), F.round("z", 3).alias("z"), "fitted")


# --- segments ---------------------------------------------------------------------------

_SPLIT_NUMBERS = ["l_quantity", "list_price", "flagged_price"]


@query("categorical_segments", oracle.categorical_segments(P, LINE_CATEGORIES, _SPLIT_NUMBERS))
def categorical_segments(spark, d):
    return segments.categorical_segments(
        data.priced_lines(spark, d), LINE_CATEGORIES, _SPLIT_NUMBERS, ndigits=6
    )


@query("skew_split", oracle.skew_split(S, SIGNAL_NUMBERS))
def skew_split(spark, d):
    return segments.skew_split(data.signals(spark, d), SIGNAL_NUMBERS, ndigits=6)


@query("outlier_segments", oracle.outlier_segments(S, SIGNAL_NUMBERS))
def outlier_segments(spark, d):
    return segments.outlier_segments(data.signals(spark, d), SIGNAL_NUMBERS, ndigits=6)


@query("detect_segments", oracle.segments(S, SIGNAL_CATEGORIES, SIGNAL_NUMBERS))
def detect_segments(spark, d):
    return segments.detect_segments(data.signals(spark, d), SIGNAL_CATEGORIES, SIGNAL_NUMBERS, ndigits=6)


# --- time series ------------------------------------------------------------------------


@query(
    "dense_position",
    f"SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate NULLS LAST, o_orderkey) - 1 AS pos FROM {O}",
)
def dense_positions(spark, d):
    return dense_position(data.orders_gaps(spark, d), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "pos")


@query("detect_trend", oracle.trend(O, "o_orderdate NULLS LAST, o_orderkey", ["o_totalprice", "o_custkey"]))
def detect_trend(spark, d):
    placed = series.positioned_series(data.orders_gaps(spark, d), ["o_orderdate", "o_orderkey"], ["o_totalprice", "o_custkey"])
    return series.detect_trend(placed, ndigits=6)


@query("autocorrelation", oracle.acf(S, "ts, event_id", ["value", "wave"]))
def autocorrelation(spark, d):
    placed = series.positioned_series(data.signals(spark, d), ["ts", "event_id"], ["value", "wave"])
    return round_columns(series.autocorrelation(placed), ["r"])


@query("detect_seasonality", oracle.seasonality(S, "ts, event_id", ["value", "wave"]))
def detect_seasonality(spark, d):
    placed = series.positioned_series(data.signals(spark, d), ["ts", "event_id"], ["value", "wave"])
    return series.detect_seasonality(placed, ndigits=6)


@query("time_series_ties", oracle.time_series("orders", "o_orderdate, o_custkey, o_totalprice", ["o_custkey", "o_totalprice"]))
def time_series_ties(spark, d):
    orders = data.table(spark, d, "orders").select("o_totalprice", "o_orderdate", "o_custkey")
    return series.time_series_analysis(orders, numbers=["o_custkey", "o_totalprice"], ndigits=6)


@query("time_series_analysis", oracle.time_series(S, "ts, event_id", ["user_id", "value", "wave"]))
def time_series_analysis(spark, d):
    return series.time_series_analysis(data.signals(spark, d), ["ts", "event_id"], ["user_id", "value", "wave"], ndigits=6)


# --- rules ------------------------------------------------------------------------------

_n = oracle.numeric_univariate(S, SIGNAL_NUMBERS)
_c = oracle.categorical_univariate(S, SIGNAL_CATEGORIES)
_strong = oracle.strong(S, SIGNAL_NUMBERS)
_shape = oracle.shapes(S, SIGNAL_NUMBERS, {"user_id"})
_seg = oracle.segments(S, SIGNAL_CATEGORIES, SIGNAL_NUMBERS)
_ts = oracle.time_series(S, "ts, event_id", SIGNAL_NUMBERS)


def _rule_inputs(spark, d):
    s = data.signals(spark, d)
    q = univariate.quartiles(s, SIGNAL_NUMBERS)
    pairs = bivariate.correlation_matrix(s, SIGNAL_NUMBERS)
    return dict(
        numeric=univariate.numeric_univariate(s, SIGNAL_NUMBERS, 6, q),
        categorical=univariate.categorical_univariate(s, SIGNAL_CATEGORIES),
        strong=materialise(bivariate.strong_correlations(pairs, ndigits=6), "strong"),
        shapes=materialise(shape.classify_distribution(s, SIGNAL_NUMBERS, 6, q), "shapes"),
        found=materialise(
            segments.detect_segments(s, SIGNAL_CATEGORIES, SIGNAL_NUMBERS, 6, known_quartiles=q), "segments"
        ),
    )


@query(
    "insights",
    f"""SELECT 'high_variability' AS category, "column" AS subject, cv AS value FROM ({_n}) WHERE cv > 1
    UNION ALL SELECT 'dominant_category', "column" || '=' || mode, mode_pct FROM ({_c}) WHERE mode_pct >= 60
    UNION ALL SELECT 'strong_correlation', a || ' & ' || b, correlation FROM ({_strong})
    UNION ALL SELECT 'skewed_distribution', "column", skewness FROM ({_shape}) WHERE ends_with(distribution_type, 'skewed')
    UNION ALL SELECT 'potential_driver', split_column || ' -> ' || "column", effect_size FROM ({_seg})
    WHERE type = 'categorical_split' AND effect_size >= 0.5""",
)
def insights(spark, d):
    i = _rule_inputs(spark, d)
    return rules.insights(i["numeric"], i["categorical"], i["strong"], i["shapes"], i["found"])


_rec = "SELECT {p} AS priority, {r} AS rule, {o} AS place, '{t}' AS chart_type, {x} AS x, {y} AS y"
_place = "list_position([" + ", ".join(f"'{c}'" for c in SIGNAL_NUMBERS) + """], "column")"""


@query(
    "chart_recommendations",
    "SELECT row_number() OVER (ORDER BY priority, rule, place, x, y)::INTEGER AS ordinal, priority, chart_type, x, y FROM ("
    + oracle.union(
        [
            *[_rec.format(p=1, r=0, o=i, t="histogram", x=f"'{c}'", y="NULL::VARCHAR") for i, c in enumerate(SIGNAL_NUMBERS)],
            *[_rec.format(p=4, r=3, o=i, t="bar", x=f"'{c}'", y="NULL::VARCHAR") for i, c in enumerate(SIGNAL_CATEGORIES)],
            _rec.format(p=2, r=5, o=0, t="correlation_heatmap", x=f"'{','.join(SIGNAL_NUMBERS)}'", y="NULL::VARCHAR"),
            *[_rec.format(p=2, r=6, o=i, t="line", x="'ts'", y=f"'{c}'") for i, c in enumerate(SIGNAL_NUMBERS)],
            _rec.format(p=2, r=1, o=_place, t="boxplot", x='"column"', y="NULL::VARCHAR") + f" FROM ({_seg}) WHERE type = 'outlier_segment'",
            _rec.format(p=3, r=4, o="-effect_size", t="grouped_boxplot", x="split_column", y='"column"') + f" FROM ({_seg}) WHERE type = 'categorical_split'",
            _rec.format(p=3, r=2, o="-abs(correlation)", t="scatter", x="a", y="b") + f" FROM ({_strong})",
        ]
    )
    + ")",
)
def chart_recommendations(spark, d):
    i = _rule_inputs(spark, d)
    ts = series.time_series_analysis(data.signals(spark, d), ["ts", "event_id"], SIGNAL_NUMBERS, 6)
    return rules.chart_recommendations(spark, SIGNAL_NUMBERS, SIGNAL_CATEGORIES, i["strong"], i["found"], ts, "ts")


_signal_nulls = " + ".join(f"count(*) - count({c})" for c in ("value", "amount", "penalty"))


@query(
    "findings",
    f"""SELECT 'rows' AS fact, NULL::VARCHAR AS subject, count(*)::DOUBLE AS value FROM events
    UNION ALL SELECT 'columns', NULL, 9 UNION ALL SELECT 'missing_cells', NULL, {_signal_nulls} FROM {S}
    UNION ALL SELECT 'skewed', "column", skewness FROM ({_shape}) WHERE ends_with(distribution_type, 'skewed')
    UNION ALL SELECT 'multimodal', "column", NULL FROM ({_shape}) WHERE is_multimodal
    UNION ALL SELECT 'strong_correlation', a || ' & ' || b, correlation FROM ({_strong})
    UNION ALL SELECT 'top_split', * FROM (SELECT split_column || ' -> ' || "column", effect_size FROM ({_seg})
        WHERE type = 'categorical_split' ORDER BY effect_size DESC, split_column, "column" LIMIT 1)
    UNION ALL SELECT 'outliers', "column", outlier_count FROM ({_seg}) WHERE type = 'outlier_segment'
    UNION ALL SELECT 'trend', "column" || ':' || trend, r_squared FROM ({_ts})""",
)
def findings(spark, d):
    i = _rule_inputs(spark, d)
    s = data.signals(spark, d)
    ts = series.time_series_analysis(s, ["ts", "event_id"], SIGNAL_NUMBERS, 6)
    return rules.findings(profile.dataset_metadata(s), i["shapes"], i["strong"], i["found"], ts)


# --- charts -----------------------------------------------------------------------------

_rounded_bins = """SELECT "column", bin, {low} AS low, {high} AS high, count FROM ({src})"""


def _bins_sql(src: str) -> str:
    return _rounded_bins.format(low=r("low"), high=r("high"), src=src)


@query("chart_histogram", _bins_sql(oracle.union(oracle.histogram30(L, c) for c in LINE_NUMBERS)))
def chart_histogram(spark, d):
    return round_columns(charts.histogram(data.lineitem_gaps(spark, d), LINE_NUMBERS), ["low", "high"])


def _box_sql(src: str, columns) -> str:
    return oracle.union(
        f"""SELECT '{c}' AS "column", count(x.{c}) AS count, {r('any_value(b.q1)')} AS q1, {r('any_value(b.q2)')} AS median,
        {r('any_value(b.q3)')} AS q3, {r(f'min(x.{c}) FILTER (WHERE {inside})')} AS whisker_low, {r(f'max(x.{c}) FILTER (WHERE {inside})')} AS whisker_high,
        count(x.{c}) FILTER (WHERE NOT ({inside})) AS outlier_count FROM {src} x, {oracle._q(c, src)}"""
        for c in columns
        for inside in [f"x.{c} BETWEEN b.q1 - 1.5 * (b.q3 - b.q1) AND b.q3 + 1.5 * (b.q3 - b.q1)"]
    )


@query("chart_box_plot", _box_sql(S, SIGNAL_NUMBERS))
def chart_box_plot(spark, d):
    out = charts.box_plot(data.signals(spark, d), SIGNAL_NUMBERS, ndigits=6)
    return round_columns(out, ["whisker_low", "whisker_high"])


@query(
    "chart_box_outliers",
    oracle.union(
        f"""SELECT '{c}' AS "column", {r(f'x.{c}')} AS value, count(*) AS count FROM {S} x, {oracle._q(c, S)}
        WHERE x.{c} < b.q1 - 1.5 * (b.q3 - b.q1) OR x.{c} > b.q3 + 1.5 * (b.q3 - b.q1) GROUP BY x.{c}"""
        for c in ("value", "penalty")
    ),
)
def chart_box_outliers(spark, d):
    return round_columns(charts.box_outliers(data.signals(spark, d), ["value", "penalty"]), ["value"])


_upper = f"(SELECT a, b, round(r, 3) + 0.0::DOUBLE AS r FROM ({oracle.correlations(L, LINE_NUMBERS, None)}))"


@query(
    "chart_heatmap",
    f"SELECT a AS x, b AS y, r FROM {_upper} UNION ALL SELECT b, a, r FROM {_upper} UNION ALL "
    + oracle.union(f"SELECT '{c}', '{c}', 1.0::DOUBLE" for c in LINE_NUMBERS),
)
def chart_heatmap(spark, d):
    return charts.heatmap(data.lineitem_gaps(spark, d), LINE_NUMBERS)


@query("chart_bar", oracle.top_values("customer", ["c_mktsegment", "c_name"], 15))
def chart_bar(spark, d):
    return charts.bar(data.table(spark, d, "customer"), ["c_mktsegment", "c_name"])


@query("chart_scatter", oracle.scatter(P, "list_price", "taxed_price"))
def chart_scatter(spark, d):
    return charts.scatter(data.priced_lines(spark, d), "list_price", "taxed_price").drop("x_low", "y_low")


@query(
    "chart_grouped_box",
    oracle.union(
        f"""SELECT '{c}' AS category, '{n}' AS number, {c} AS "group", count({n}) AS count, min({n}) AS low, {r(f'quantile_cont({n}, 0.25)')} AS q1,
        {r(f'quantile_cont({n}, 0.5)')} AS median, {r(f'quantile_cont({n}, 0.75)')} AS q3, max({n}) AS high
        FROM {L} WHERE {c} IS NOT NULL GROUP BY {c}"""
        for c, n in (("l_returnflag", "l_quantity"), ("l_returnflag", "l_extendedprice"), ("l_linestatus", "l_tax"))
    ),
)
def chart_grouped_box(spark, d):
    splits = [("l_returnflag", "l_quantity"), ("l_returnflag", "l_extendedprice"), ("l_linestatus", "l_tax")]
    return charts.grouped_box(data.lineitem_gaps(spark, d), splits, ndigits=6)


@query(
    "chart_pie",
    f"""SELECT "column", value, count, {r('count * 100.0::DOUBLE / sum(count) OVER (PARTITION BY "column")', 2)} AS share_pct
    FROM ({oracle.value_counts(O, ['o_orderstatus', 'o_orderpriority'])})""",
)
def chart_pie(spark, d):
    return charts.pie(data.orders_gaps(spark, d), ["o_orderstatus", "o_orderpriority"])


_best = f"(SELECT model FROM ({oracle.regression_metrics(RP)}) ORDER BY r2 DESC, model LIMIT 1)"


@query(
    "chart_model_bars",
    oracle.union(
        f"SELECT '{m}' AS metric, model, {m} AS value, model = {_best} AS is_best FROM ({oracle.regression_metrics(RP)})"
        for m in ("r2", "rmse", "mae")
    ),
)
def chart_model_bars(spark, d):
    scores = _regression_scores(spark, d)
    best = evaluate.best_model(scores, "r2").select(F.col("model").alias("_best"))
    flagged = scores.join(F.broadcast(best), F.col("model") == F.col("_best"), "left")
    return charts.model_bars(flagged.withColumn("is_best", F.col("_best").isNotNull()), "regression")


_scaled = f"(SELECT * FROM {RP} WHERE model = 'scaled')"


@query("chart_actual_vs_predicted", oracle.scatter(_scaled, "actual", "predicted"))
def chart_actual_vs_predicted(spark, d):
    scaled = data.regression_predictions(spark, d).where("model = 'scaled'")
    return charts.actual_vs_predicted(scaled).drop("x_low", "y_low")


@query("chart_residuals", _bins_sql(oracle.histogram30(_scaled, "predicted - actual", name="residual")))
def chart_residuals(spark, d):
    scaled = data.regression_predictions(spark, d).where("model = 'scaled'")
    return round_columns(charts.residual_histogram(scaled), ["low", "high"])


@query("chart_cluster_distribution", "SELECT label AS cluster, count(*) AS count FROM embeddings GROUP BY label")
def chart_cluster_distribution(spark, d):
    return charts.cluster_distribution(data.table(spark, d, "embeddings"), "label")


@query(
    "chart_importance_bars",
    f"""SELECT feature, importance FROM (SELECT p_type AS feature, {r('avg(p_retailprice)', 4)} AS importance FROM part GROUP BY p_type)
    ORDER BY importance DESC, feature LIMIT 15""",
)
def chart_importance_bars(spark, d):
    weights = data.table(spark, d, "part").groupBy(F.col("p_type").alias("feature"))
    return charts.importance_bars(weights.agg(F.round(F.avg("p_retailprice"), 4).alias("importance")))


# --- problem ----------------------------------------------------------------------------


@query(
    "identifier_like",
    oracle.identifier_table(
        "(SELECT * FROM lineitem)",
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
         "l_returnflag", "l_linestatus", "l_shipdate"],
    )
    + " UNION ALL "
    + oracle.identifier_table("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    + " UNION ALL "
    + oracle.identifier_table("events", ["event_id", "ts", "user_id", "event_type", "value", "props"]),
)
def identifier_like(spark, d):
    tables = [data.table(spark, d, t) for t in ("lineitem", "customer", "events")]
    return reduce(DataFrame.unionByName, [problem.identifier_table(t) for t in tables])


@query(
    "guess_target",
    f"""SELECT "column" AS target FROM (SELECT *, row_number() OVER () AS n FROM (VALUES
    ('p_retailprice', 0), ('p_size', 1), ('p_type', 2), ('p_brand', 3), ('p_name', 4), ('p_partkey', 5)) v("column", place))
    JOIN ({oracle.identifier_table("part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"])}) USING ("column")
    WHERE NOT identifier_like ORDER BY place LIMIT 1""",
)
def guess_target(spark, d):
    target = problem.guess_target(data.table(spark, d, "part"))
    return spark.createDataFrame([(target,)], "target string")


@query(
    "integer_like",
    oracle.union(
        f"""SELECT '{c}' AS "column", bool_and(round({c}::DOUBLE) = {c}) AS integer_like FROM {L}"""
        for c in ("l_orderkey", "l_quantity", "l_extendedprice", "l_discount")
    ),
)
def integer_like(spark, d):
    return problem.integer_like(data.lineitem_gaps(spark, d), ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount"])


def _classify_sql(src: str, target: str, categorical: bool) -> str:
    few = "true" if categorical else f"(w.whole AND s.d <= 20 AND s.d / s.n::DOUBLE <= 0.2)"
    return f"""SELECT '{target}' AS target, CASE WHEN s.d / s.n::DOUBLE >= 0.95 THEN 'clustering'
        WHEN {few} AND s.least_n >= 2 THEN 'classification' WHEN {few} THEN 'clustering' ELSE 'regression' END AS problem_type
        FROM (SELECT count(*) AS d, sum(c) AS n, min(c) AS least_n FROM (SELECT count(*) AS c FROM {src} WHERE {target} IS NOT NULL GROUP BY {target})) s,
        (SELECT bool_and(round(TRY_CAST({target} AS DOUBLE)) = TRY_CAST({target} AS DOUBLE)) AS whole FROM {src}) w"""


_TARGETS = [("l_quantity", False), ("l_linenumber", False), ("l_extendedprice", False), ("l_returnflag", True), ("l_discount", False)]


@query("classify_target", oracle.union(_classify_sql(L, t, c) for t, c in _TARGETS))
def classify_target(spark, d):
    lines = data.lineitem_gaps(spark, d)
    rows = [(t, problem.classify_target(lines, t).problem_type) for t, _ in _TARGETS]
    return spark.createDataFrame(rows, "target string, problem_type string")


@query(
    "detect_problem",
    """SELECT CASE WHEN count(*) < 30 THEN 'clustering' ELSE 'time_series' END AS problem_type,
    CASE WHEN count(*) < 30 THEN NULL ELSE 'value' END AS target, CASE WHEN count(*) < 30 THEN NULL ELSE 'ts' END AS time_column,
    'event_id,user_id,event_type,props' AS features FROM events""",
)
def detect_problem(spark, d):
    events = data.events_gaps(spark, d)
    return problem.detect_problem(events).table(events)


# --- features ---------------------------------------------------------------------------


def _ordered_events(spark, d):
    return features.time_ordered(data.events_gaps(spark, d).select("event_id", "ts", "value"), ["ts", "event_id"])


_placed = f"(SELECT event_id, ts, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM {E})"


@query("time_ordering", f"SELECT event_id, pos FROM {_placed}")
def time_ordering(spark, d):
    return _ordered_events(spark, d).select("event_id", "pos")


@query(
    "calendar_features",
    f"""SELECT o_orderkey, month(o_orderdate)::DOUBLE AS month, (isodow(o_orderdate) - 1)::DOUBLE AS day_of_week,
    day(o_orderdate)::DOUBLE AS day_of_month, quarter(o_orderdate)::DOUBLE AS quarter FROM {O}""",
)
def calendar_features(spark, d):
    return features.calendar_features(data.orders_gaps(spark, d), "o_orderdate").select(
        "o_orderkey", "month", "day_of_week", "day_of_month", "quarter"
    )


@query(
    "lag_features",
    f"SELECT event_id, {', '.join(f'lag(value, {k}) OVER (ORDER BY pos) AS value_lag{k}' for k in (1, 3, 7))} FROM {_placed}",
)
def lag_features(spark, d):
    return features.lag_features(_ordered_events(spark, d), "value").select(
        "event_id", "value_lag1", "value_lag3", "value_lag7"
    )


def _rolling_sql(w: int) -> str:
    return r(f"avg(value) OVER (ORDER BY pos ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)") + f" AS value_roll{w}"


@query("rolling_mean", f"SELECT event_id, {_rolling_sql(3)}, {_rolling_sql(7)} FROM {_placed}")
def rolling_mean(spark, d):
    out = features.rolling_mean(_ordered_events(spark, d), "value")
    return round_columns(out.select("event_id", "value_roll3", "value_roll7"), ["value_roll3", "value_roll7"])


@query(
    "fill_median",
    f"SELECT event_id, {r(f'coalesce(value, (SELECT quantile_cont(value, 0.5) FROM {E}))')} AS value FROM {E}",
)
def fill_median(spark, d):
    out = features.fill_median(data.events_gaps(spark, d).select("event_id", "value"), ["value"])
    return round_columns(out, ["value"])


@query(
    "fill_mode",
    f"""SELECT o_orderkey, coalesce(o_orderpriority, (SELECT o_orderpriority FROM {O} WHERE o_orderpriority IS NOT NULL
    GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 1)) AS o_orderpriority FROM {O}""",
)
def fill_mode(spark, d):
    return features.fill_mode(data.orders_gaps(spark, d).select("o_orderkey", "o_orderpriority"))


@query(
    "one_hot",
    "SELECT c_custkey, "
    + ", ".join(
        f"""CASE WHEN c_mktsegment = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "c_mktsegment_{v}" """
        for v in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    )
    + " FROM customer",
)
def one_hot(spark, d):
    out, _ = features.one_hot(data.table(spark, d, "customer").select("c_custkey", "c_mktsegment"))
    return out


_months = """(SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos FROM orders)"""


def _months_df(spark, d):
    o = data.table(spark, d, "orders").select(
        "o_orderkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM").alias("month")
    )
    return features.time_ordered(o, ["o_totalprice", "o_orderkey"])


@query(
    "factorize",
    f"""SELECT o_orderkey, (dense_rank() OVER (ORDER BY first) - 1)::DOUBLE AS month
    FROM (SELECT o_orderkey, min(pos) OVER (PARTITION BY month) AS first FROM {_months})""",
)
def factorize(spark, d):
    return features.factorize(_months_df(spark, d), "month").select("o_orderkey", "month")


@query(
    "encode_target",
    f"""SELECT value, row_number() OVER (ORDER BY first) - 1 AS code FROM (SELECT month AS value, min(pos) AS first FROM {_months} GROUP BY month)""",
)
def encode_target(spark, d):
    return features.encode_target(_months_df(spark, d), "month")[1]


@query(
    "standard_scale",
    f"""SELECT l_orderkey, l_linenumber, {r('(l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER ()')} AS l_quantity,
    {r('(l_discount - avg(l_discount) OVER ()) / stddev_samp(l_discount) OVER ()')} AS l_discount, 5.0::DOUBLE AS constant FROM {L}""",
)
def standard_scale(spark, d):
    lines = data.lineitem_gaps(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", F.lit(5.0).alias("constant"))
    out = features.standard_scale(lines, ["l_quantity", "l_discount", "constant"])
    return round_columns(out, ["l_quantity", "l_discount"])


@query(
    "model_matrix",
    f"""SELECT o_orderkey AS pos, o_custkey::DOUBLE AS o_custkey, o_totalprice FROM {O} WHERE o_totalprice IS NOT NULL""",
)
def model_matrix(spark, d):
    o = data.orders_gaps(spark, d).withColumnRenamed("o_orderkey", "pos")
    return features.model_matrix(o, ["o_custkey", "o_orderstatus"], "o_totalprice", "pos")


@query(
    "engineered_features",
    f"""SELECT c_custkey, {r('(c_nationkey - avg(c_nationkey) OVER ()) / stddev_samp(c_nationkey) OVER ()')} AS c_nationkey,
    {", ".join(r(f"(s_{v} - avg(s_{v}) OVER ()) / stddev_samp(s_{v}) OVER ()") + f' AS "c_mktsegment_{v}"' for v in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))},
    {r('(code - avg(code) OVER ()) / stddev_samp(code) OVER ()')} AS c_name, c_acctbal
    FROM (SELECT *, {", ".join(f"CASE WHEN c_mktsegment = '{v}' THEN 1.0 ELSE 0.0 END AS s_{v}" for v in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))},
    row_number() OVER (ORDER BY c_custkey) - 1 AS code FROM customer)""",
)
def engineered_features(spark, d):
    c = data.table(spark, d, "customer").withColumn("key_copy", F.col("c_custkey"))
    spec = problem.Problem("regression", "c_acctbal", ["c_nationkey", "c_mktsegment", "c_name"])
    out = features.engineer_features(c, spec, order_by=["c_custkey"]).matrix
    keys = dense_position(c.select("c_custkey"), ["c_custkey"])
    scaled = [n for n in out.columns if n not in ("pos", "c_acctbal")]
    return round_columns(keys.join(out, "pos").drop("pos"), scaled)


# --- splits and models ------------------------------------------------------------------


@query(
    "random_split",
    "SELECT 'test' AS split, ceil(0.2 * count(*))::BIGINT AS rows FROM orders UNION ALL SELECT 'train', count(*) - ceil(0.2 * count(*))::BIGINT FROM orders",
)
def random_split(spark, d):
    split = train.random_split(data.table(spark, d, "orders"), ["o_orderkey"])
    return split.groupBy("split").agg(F.count("*").alias("rows"))


@query(
    "chronological_split",
    """SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= floor(count(*) OVER () * (1 - 0.2::DOUBLE))
    THEN 'train' ELSE 'test' END AS split FROM orders""",
)
def chronological_split(spark, d):
    placed = features.time_ordered(data.table(spark, d, "orders"), ["o_orderdate", "o_orderkey"])
    return train.chronological_split(placed).select("o_orderkey", "split")


@query(
    "stratified_split",
    """WITH c AS (SELECT o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 1),
    t AS (SELECT sum(n) AS total, sum(n) - ceil(0.2 * sum(n)) AS wanted FROM c),
    f AS (SELECT label, n, floor(n * wanted / total) AS base, n * wanted / total::DOUBLE - floor(n * wanted / total) AS rest, wanted FROM c, t),
    g AS (SELECT *, row_number() OVER (ORDER BY rest DESC, label) AS place, wanted - sum(base) OVER () AS spare FROM f),
    h AS (SELECT label, n, (base + CASE WHEN place <= spare THEN 1 ELSE 0 END)::BIGINT AS train FROM g)
    SELECT label, 'train' AS split, train AS rows FROM h UNION ALL SELECT label, 'test', n - train FROM h""",
)
def stratified_split(spark, d):
    split = train.stratified_split(data.table(spark, d, "orders"), "o_orderstatus", ["o_orderkey"])
    return split.groupBy(F.col("o_orderstatus").alias("label"), "split").agg(F.count("*").alias("rows"))


def _regression_rows(spark, d):
    """Line items as a regression table: price explained by quantity and discount."""
    li = data.table(spark, d, "lineitem")
    label = F.col("l_extendedprice") + 900 * F.col("l_quantity")
    return li.select(
        F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("pos"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        label.alias("y"),
    )


_reg = "(SELECT l_quantity AS a, l_discount AS b, l_extendedprice + 900 * l_quantity AS y FROM lineitem)"


def _two_feature_sql(alpha: float) -> str:
    """Normal equations of two features, solved by Cramer's rule on centred sums."""
    return f"""WITH s AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my,
        var_pop(a) * count(*) + {alpha} AS aa, var_pop(b) * count(*) + {alpha} AS bb, covar_pop(a, b) * count(*) AS ab,
        covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS b_y FROM {_reg}),
        c AS (SELECT *, (ay * bb - b_y * ab) / (aa * bb - ab * ab) AS ca, (b_y * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM s)
        SELECT 'quantity' AS term, {r('ca', 4)} AS value FROM c UNION ALL SELECT 'discount', {r('cb', 4)} FROM c
        UNION ALL SELECT 'intercept', {r('my - ca * ma - cb * mb', 4)} FROM c"""


def _coefficients(spark, fitted, names) -> DataFrame:
    rows = [*zip(names, map(float, fitted.coefficients)), ("intercept", float(fitted.intercept))]
    return round_columns(spark.createDataFrame(rows, "term string, value double"), ["value"], 4)


@query("linear_regression", _two_feature_sql(0.0))
def linear_regression(spark, d):
    rows = train.assemble(_regression_rows(spark, d), ["quantity", "discount"], "y")
    return _coefficients(spark, train.linear_regression(rows), ["quantity", "discount"])


@query("ridge_regression", _two_feature_sql(1.0))
def ridge_regression(spark, d):
    rows = train.assemble(_regression_rows(spark, d), ["quantity", "discount"], "y")
    return _coefficients(spark, train.ridge_regression(rows), ["quantity", "discount"])


def _candidate_facts(spark, split, names, target, name, candidates, limits):
    """What holds of any right fit: the test rows are all predicted, the trees are as many
    and as deep as asked, and the model beats the constant guess."""
    saved = materialise(split, "split")
    trained = train.fit_candidates(saved, names, target, {name: candidates[name]})
    fitted = trained.models[name]
    trees, depth = limits
    parts = fitted.models if hasattr(fitted, "models") else [fitted]
    sized = all(m.getNumTrees == trees and max(t.depth for t in m.trees) <= depth for m in parts)
    test = saved.where("split = 'test'").select(F.col(target).alias("actual"))
    hit = trained.predictions
    if candidates is train.REGRESSION:
        # Less squared error than the mean of the test rows.
        both = hit.agg(F.sum((F.col("actual") - F.col("predicted")) ** 2).alias("mine"), (F.var_pop("actual") * F.count("*")).alias("flat")).first()
        better = both["mine"] < both["flat"]
    else:
        usual = test.groupBy("actual").count().agg(F.max("count")).first()[0]
        better = hit.where(F.col("actual") == F.col("predicted")).count() >= usual
    row = (name, hit.count(), bool(sized), bool(better))
    return spark.createDataFrame([row], "model string, test_rows bigint, sized boolean, better boolean")


def _facts_sql(name: str, src: str) -> str:
    return f"SELECT '{name}' AS model, ceil(0.2::DOUBLE * count(*))::BIGINT AS test_rows, true AS sized, true AS better FROM {src}"


def _part_rows(spark, d):
    """Parts as a regression table: price explained by size, brand and type."""
    p = data.table(spark, d, "part")
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("double")
    return p.select(
        F.col("p_partkey").alias("pos"),
        F.col("p_size").cast("double").alias("size"),
        brand.alias("brand"),
        F.length("p_type").cast("double").alias("type_length"),
        (F.col("p_retailprice") + 10 * F.col("p_size") + 50 * brand).alias("y"),
    )


_PART_FEATURES = ["size", "brand", "type_length"]


def _regressor(name, limits):
    def run(spark, d):
        split = train.random_split(_part_rows(spark, d), ["pos"])
        return _candidate_facts(spark, split, _PART_FEATURES, "y", name, train.REGRESSION, limits)

    return run


query("random_forest_regressor", _facts_sql("Random Forest", "part"))(_regressor("Random Forest", (100, 10)))
query("boosted_regressor", _facts_sql("Gradient Boosting", "part"))(_regressor("Gradient Boosting", (150, 5)))


def _class_rows(spark, d):
    """Customers' orders as a classification table: is an order above its customer's usual."""
    o = data.table(spark, d, "orders")
    label = ((F.col("o_totalprice") + 40 * F.col("o_custkey") % 90000) > 270000).cast("double")
    return o.select(
        F.col("o_orderkey").alias("pos"),
        (F.col("o_totalprice") / 100000).alias("price"),
        (F.col("o_custkey") % 100 / 100.0).alias("customer"),
        F.month("o_orderdate").cast("double").alias("month"),
        label.alias("y"),
    )


_CLASS_FEATURES = ["price", "customer", "month"]


def _classifier(name, limits):
    def run(spark, d):
        split = train.stratified_split(_class_rows(spark, d), "y", ["pos"])
        return _candidate_facts(spark, split, _CLASS_FEATURES, "y", name, train.CLASSIFICATION, limits)

    return run


@query(
    "logistic_regression",
    """SELECT 'Logistic Regression' AS model, true AS stationary""",
)
def logistic_regression(spark, d):
    """Whether the gradient of the penalised likelihood vanishes at the fitted coefficients."""
    rows = _class_rows(spark, d)
    fitted = train.logistic_regression(train.assemble(rows, _CLASS_FEATURES, "y"))
    z = F.lit(float(fitted.intercept))
    for name, value in zip(_CLASS_FEATURES, fitted.coefficients):
        z = z + F.col(name) * float(value)
    miss = 1 / (1 + F.exp(-z)) - F.col("y")
    slopes = rows.agg(*[F.sum(miss * F.col(n)) for n in _CLASS_FEATURES], F.sum(miss), F.count("*")).first()
    pulls = [*map(float, fitted.coefficients), 0.0]
    still = all(abs(s + p) < 1e-3 * slopes[-1] for s, p in zip(slopes, pulls))
    return spark.createDataFrame([("Logistic Regression", still)], "model string, stationary boolean")


query("random_forest_classifier", _facts_sql("Random Forest", "orders"))(_classifier("Random Forest", (100, 10)))
query("boosted_classifier", _facts_sql("Gradient Boosting", "orders"))(_classifier("Gradient Boosting", (150, 5)))


@query(
    "multinomial_boosting",
    """SELECT 3 AS classes, 10 AS rounds, true AS falls, ceil(0.2::DOUBLE * count(*))::BIGINT AS test_rows, true AS whole, true AS better FROM orders""",
)
def multinomial_boosting(spark, d):
    """Orders in three classes: the deviance of the training rows falls every round, the
    probabilities of a test row add up to one, and the log-loss of the test rows is below that of the
    class shares of the training rows."""
    o = data.table(spark, d, "orders")
    lifted = F.col("o_totalprice") + 40 * F.col("o_custkey") % 90000
    three = F.when(lifted > 270000, 2.0).when(lifted > 150000, 1.0).otherwise(0.0)
    features = _class_rows(spark, d).drop("y").join(o.select(F.col("o_orderkey").alias("pos"), three.alias("y")), "pos")
    split = materialise(train.stratified_split(features, "y", ["pos"]), "split")
    rows = train.assemble(split, _CLASS_FEATURES, "y")
    fitted = train.boosted_classifier(rows.where("split = 'train'"), maxIter=10, maxDepth=3)
    shares = {r["y"]: r["n"] for r in split.where("split = 'train'").groupBy("y").agg(F.count("*").alias("n")).collect()}
    flat = F.element_at(F.create_map(*[F.lit(v) for y, n in shares.items() for v in (y, n / sum(shares.values()))]), F.col("label"))
    mine = F.col("probability")[F.col("label").cast("int")]
    total = F.aggregate("probability", F.lit(0.0), lambda a, p: a + p)
    found = fitted.transform(rows.where("split = 'test'")).agg(
        F.count("*").alias("test_rows"), F.sum(F.log(flat) - F.log(mine)).alias("gap"), F.bool_and(F.abs(total - 1) < 1e-9).alias("whole")
    )
    falls = all(b < a for a, b in zip(fitted.deviance, fitted.deviance[1:]))
    facts = [F.lit(fitted.numClasses).alias("classes"), F.lit(len(fitted.rounds)).alias("rounds"), F.lit(falls).alias("falls")]
    return found.select(*facts, "test_rows", "whole", (F.col("gap") < 0).alias("better"))


def _embedding_columns(spark, d, dims: int | None = None) -> tuple[DataFrame, list[str]]:
    e = data.table(spark, d, "embeddings")
    width = e.select(F.size("embedding").alias("n")).first()["n"] if dims is None else dims
    names = [f"x{i}" for i in range(width)]
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]), names


@query(
    "kmeans_sweep",
    """SELECT k::INTEGER AS k, 'KMeans (k=' || k || ')' AS model, true AS bounded, true AS falls, (SELECT count(*) FROM embeddings) AS assigned,
    true AS centred FROM (SELECT unnest(range(2, 9)) AS k)""",
)
def kmeans_sweep(spark, d):
    """Facts that any right sweep has: a silhouette within bounds for each k, a cost that
    falls as k grows, every row assigned, and centres that are the means of their rows."""
    e, names = _embedding_columns(spark, d)
    found = train.kmeans_sweep(e.withColumnRenamed("vec_id", "pos"), names)
    means = found.assigned.groupBy("cluster").agg(*[F.avg(n).alias(n) for n in names])
    offs = [F.abs(F.col(n) - F.element_at(F.col("given"), i + 1)) for i, n in enumerate(names)]
    given = spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(found.model.centres)], "cluster int, given array<double>")
    # A row per cluster.
    checked = means.join(given, "cluster").agg(F.max(F.greatest(*offs)).alias("off"), F.count("*").alias("n")).first()
    centred = checked["n"] == found.best_k and checked["off"] < 0.05
    before = F.lag("cost").over(Window.partitionBy(F.lit(0)).orderBy("k"))
    return found.scores.select(
        "k",
        "model",
        (F.abs("silhouette") <= 1).alias("bounded"),
        F.coalesce(F.col("cost") < before, F.lit(True)).alias("falls"),
        F.lit(found.assigned.count()).cast("bigint").alias("assigned"),
        F.lit(centred).alias("centred"),
    )


# --- evaluation -------------------------------------------------------------------------


def _regression_scores(spark, d) -> DataFrame:
    predictions = data.regression_predictions(spark, d)
    tried = predictions.select("model", "candidate").distinct()
    return evaluate.regression_metrics(predictions).join(tried, "model")


@query("regression_metrics", oracle.regression_metrics(RP))
def regression_metrics(spark, d):
    return evaluate.regression_metrics(data.regression_predictions(spark, d))


@query("classification_metrics", oracle.classification_metrics(CP))
def classification_metrics(spark, d):
    return evaluate.classification_metrics(data.class_predictions(spark, d))


_toxic = "(SELECT 'given' AS model, quality AS actual, toxic AS predicted FROM labels)"


@query("classification_metrics_binary", oracle.classification_metrics(_toxic))
def classification_metrics_binary(spark, d):
    given = data.table(spark, d, "labels").select(
        F.lit("given").alias("model"), F.col("quality").alias("actual"), F.col("toxic").alias("predicted")
    )
    return evaluate.classification_metrics(given)


@query(
    "silhouette",
    f"""WITH p AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
    u AS (SELECT label, i, avg(x[i]) AS m FROM p, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY ALL),
    c AS (SELECT label, list(m ORDER BY i) AS m FROM u GROUP BY label),
    k AS (SELECT label, count(*) AS n, avg(list_inner_product(x, x)) AS q FROM p GROUP BY label),
    d AS (SELECT p.vec_id, p.label AS own, c.label AS other, k.n, list_inner_product(x, x) - 2 * list_inner_product(x, c.m) + k.q AS d
    FROM p, c JOIN k ON k.label = c.label),
    s AS (SELECT vec_id, max(CASE WHEN own = other THEN n END) AS own_n, max(CASE WHEN own = other THEN d * n / nullif(n - 1, 0) END) AS a,
    min(CASE WHEN own <> other THEN d END) AS b FROM d GROUP BY vec_id)
    SELECT {r('avg(CASE WHEN own_n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END)', 4)} AS silhouette, count(*) AS rows FROM s""",
)
def silhouette(spark, d):
    e, names = _embedding_columns(spark, d)
    return evaluate.silhouette(e, names, "label")


@query("best_model", f"SELECT model, r2 FROM ({oracle.regression_metrics(RP)}) ORDER BY r2 DESC, model LIMIT 1")
def best_model(spark, d):
    return evaluate.best_model(_regression_scores(spark, d), "r2").select("model", "r2")


@query(
    "model_comparison",
    f"""SELECT model, mae, rmse, r2, mape, test_rows, row_number() OVER (ORDER BY r2 DESC)::INTEGER AS rank
    FROM ({oracle.regression_metrics(RP)})""",
)
def model_comparison(spark, d):
    return evaluate.model_comparison(_regression_scores(spark, d), "r2").drop("candidate")


@query(
    "cluster_spread",
    f"""WITH c AS (SELECT c_mktsegment, avg(c_acctbal) AS balance, avg(c_nationkey) AS nation FROM customer GROUP BY 1)
    SELECT 'balance' AS feature, {r('stddev_pop(balance)', 4)} AS importance FROM c UNION ALL SELECT 'nation', {r('stddev_pop(nation)', 4)} FROM c""",
)
def cluster_spread(spark, d):
    centres = data.table(spark, d, "customer").groupBy("c_mktsegment").agg(
        F.avg("c_acctbal").alias("balance"), F.avg("c_nationkey").alias("nation")
    )
    return evaluate.cluster_spread(centres, ["balance", "nation"])


@query(
    "prediction_preview",
    f"SELECT pos, actual, {r('predicted')} AS predicted FROM {RP} WHERE model = 'scaled' ORDER BY pos LIMIT 200",
)
def prediction_preview(spark, d):
    out = evaluate.prediction_preview(data.regression_predictions(spark, d), "scaled")
    return round_columns(out, ["predicted"])


@query(
    "feature_importance",
    """SELECT * FROM (VALUES ('size', true, false), ('brand', true, true), ('type_length', true, false)) f(feature, bounded, top)""",
)
def feature_importance(spark, d):
    """Importances lie within 0 and 1, and the brand, which the price hangs on most, is first."""
    rows = train.assemble(_part_rows(spark, d), _PART_FEATURES, "y")
    fitted = train.random_forest_regressor(rows)
    found = evaluate.feature_importance(spark, _PART_FEATURES, train.importances(fitted))
    return found.select("feature", F.col("importance").between(0, 1).alias("bounded"), (F.col("importance") == 1).alias("top"))


_weights = f"(SELECT p_brand AS feature, {r('avg(p_size) / 100', 4)} AS importance FROM part GROUP BY p_brand)"


@query(
    "top_drivers",
    f"SELECT feature, importance, round(importance * 100) AS share_pct FROM {_weights} ORDER BY importance DESC, feature LIMIT 5",
)
def top_drivers(spark, d):
    weights = data.table(spark, d, "part").groupBy(F.col("p_brand").alias("feature"))
    return evaluate.top_drivers(weights.agg(F.round(F.avg("p_size") / 100, 4).alias("importance")))


# --- whole analyses ---------------------------------------------------------------------


@query("ingest_orders", oracle.column_summary(O, [(c, "timestamp" if k == "datetime" else t, k) for c, t, k in _ORDER_COLUMNS]))
def ingest_orders(spark, d):
    text = data.orders_gaps(spark, d).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return ingest(spark, _written(text, "csv", "csv", header=True), source_type="csv").summary


@query("explore_events", oracle.time_series(S, "ts, event_id", SIGNAL_NUMBERS))
def explore_events(spark, d):
    """The exploration of all columns, through its time series; that of the row number
    itself, which correlates fully at every lag, is left out of the comparison."""
    found = explore(data.signals(spark, d), order_by=["ts", "event_id"], ndigits=6).time_series
    return found.where("column <> 'event_id'").withColumn("position", F.col("position") - 1)


@query(
    "model_customers",
    """SELECT k::INTEGER AS k, 'KMeans (k=' || k || ')' AS model, 'clustering' AS problem_type, 'full_dataset' AS method,
    (SELECT count(*) FROM customer) AS assigned FROM (SELECT unnest(range(2, 9)) AS k)""",
)
def model_customers(spark, d):
    """The facts of a whole modelling run that clusters customers on all columns, the balance
    last, also where balances repeat and would make a regression."""
    done = model(data.table(spark, d, "customer"), target="c_acctbal", order_by=["c_custkey"], cluster=True)
    said = {"problem_type": done.problem.problem_type, "method": done.split_info["method"], "assigned": done.clusters.count()}
    return done.scores.select("k", "model", *[F.lit(v).alias(c) for c, v in said.items()]).withColumn("assigned", F.col("assigned").cast("bigint"))


@query(
    "analyze_events",
    """SELECT model, (count(*) - floor(count(*) * 0.8::DOUBLE))::BIGINT AS test_rows, 'time_series' AS problem_type, 'value' AS target,
    'chronological' AS method FROM events, (VALUES ('Linear Regression'), ('Ridge Regression'), ('Random Forest'), ('Gradient Boosting')) m(model)
    GROUP BY model""",
)
def analyze_events(spark, d):
    """The facts of a whole analysis of all columns with the full settings."""
    done = analyze(spark, data.table(spark, d, "events"), order_by=["ts", "event_id"])
    said = {
        "problem_type": done.modeled.problem.problem_type,
        "target": done.modeled.problem.target,
        "method": done.modeled.split_info["method"],
    }
    return done.modeled.scores.select("model", "test_rows", *[F.lit(v).alias(k) for k, v in said.items()])
