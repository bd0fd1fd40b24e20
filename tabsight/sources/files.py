"""Scans. Each returns a lazy DataFrame; only file headers are looked at up front."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, per_column, union_all
from .shaping import limit_rows, project, where_equals

# Text that means "missing" in a delimited file.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Delimiters considered, first one wins a draw.
DELIMITERS = [",", "\t", ";", "|"]
SNIFF_LINES = 20
# Keys under which a JSON document may wrap its list of records, in order.
WRAPPER_KEYS = ["data", "results", "items", "records", "rows"]
# Source kind by file extension.
KIND_BY_EXTENSION = {
    "csv": "csv",
    "tsv": "csv",
    "json": "json",
    "jsonl": "json",
    "ndjson": "json",
    "txt": "csv",
    "parquet": "parquet",
    "orc": "orc",
}

# Sources that are known and not read here.
UNREADABLE = ("xlsx", "xls", "db", "sqlite", "sqlite3")
WEB = ("http://", "https://", "ftp://")

_SURPLUS = "_surplus_field"
# Text no field holds, so that the reader itself turns nothing into null.
_NEVER = "\u0000never\u0000"


def detect_source_kind(source: str) -> str:
    """Source kind from a path, JDBC address or table name; text if nothing else fits.

    Web addresses, spreadsheets and database files are refused.
    """
    if source.lower().startswith("jdbc:"):
        return "jdbc"
    name = source.rstrip("/").rsplit("/", 1)[-1].lower()
    extension = name.rsplit(".", 1)[-1] if "." in name else ""
    if source.lower().startswith(WEB) or extension in UNREADABLE:
        raise ValueError(f"cannot read {source}: export it to CSV, JSON or Parquet first")
    if "/" not in source and extension not in KIND_BY_EXTENSION:
        return "table"
    return KIND_BY_EXTENSION.get(extension, "csv")


@dataclass
class TextFiles:
    """Files that are read alike; ``paths`` is the whole source if all files are."""

    encoding: str
    breaks: bool
    sample: str
    paths: str | list[str]


def _grouped(facts: DataFrame, by: list[str], path: str) -> list[tuple[T.Row, str | list[str]]]:
    """Groups of files with equal facts. File names come to the driver only where a
    source is mixed, so that each group can be read by itself."""
    groups = facts.groupBy(*by).agg(F.min("file").alias("sample")).orderBy(*by).collect()
    if len(groups) == 1:
        return [(groups[0], path)]
    files = facts.groupBy(*by).agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy(*by)
    return [(g, [unquote(f) for f in r["files"]]) for g, r in zip(groups, files.collect())]


def text_files(spark: SparkSession, path: str) -> list[TextFiles]:
    """Group text files by encoding, header line and whether fields hold line breaks.

    One scan looks at all lines (a multi-byte character never spans a line end), so a
    file of any size is split over tasks. UTF-8 is taken unless a line does not decode,
    then Latin-1. A line with an odd number of quotes means that some field goes on in
    the next line; only such files are read a file a task.
    """
    lines = spark.read.text(path, wholetext=False).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        # The text reader keeps undecodable bytes as they are; the check sees raw bytes.
        F.is_valid_utf8(F.col("value")).alias("ok"),
        ((F.length("value") - F.length(F.replace(F.make_valid_utf8("value"), F.lit('"'), F.lit("")))) % 2 != 0).alias("odd"),
        F.make_valid_utf8("value").alias("line"),
        F.monotonically_increasing_id().alias("at"),
    )
    # Lines of a file's first part are read in order, so its first line has the least number.
    first = F.min_by("line", F.when((F.col("start") == 0) & (F.trim("line") != ""), F.col("at")))
    facts = lines.groupBy("file").agg(F.bool_and("ok").alias("ok"), F.bool_or("odd").alias("breaks"), first.alias("header"))
    groups = _grouped(facts, ["ok", "breaks", "header"], path)
    return [TextFiles("UTF-8" if g["ok"] else "ISO-8859-1", g["breaks"], unquote(g["sample"]), paths) for g, paths in groups]


def guess_delimiter(lines: Sequence[str]) -> str:
    """The candidate that splits the head lines most evenly, comma if none does."""
    lines = [l for l in lines if l.strip()][:SNIFF_LINES]
    best, best_score = DELIMITERS[0], (0.0, 0)
    for candidate in DELIMITERS:
        per_line = Counter(re.sub(r'"[^"]*"', "", l).count(candidate) for l in lines)
        per_line.pop(0, None)
        if per_line:
            fields, agreeing = max(per_line.items(), key=lambda kv: (kv[1], kv[0]))
            score = (agreeing / len(lines), fields)
            if score[0] > best_score[0] or (score[0] == best_score[0] and fields > best_score[1]):
                best, best_score = candidate, score
    return best


def load_csv(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    filters: Mapping[str, object] | None = None,
    row_limit: int | None = None,
    order_by: Sequence[str] | None = None,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Delimited text with a header row; encoding, delimiter, header and line breaks
    inside quotes are found for each group of like files, and columns meet by name.

    Short rows are filled with nulls, rows with too many fields are dropped, and the
    usual "missing" words become null before column types are decided. Types come from
    ``schema`` when given, else from one aggregate pass over all values.
    """
    frames = [_read_delimited(spark, group) for group in text_files(spark, path)]
    if not frames:
        raise ValueError(f"no rows in {path}")
    raw = union_all(frames)
    raw = project(raw, columns, strict=True)
    if schema is not None:
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        types = {f.name: f.dataType for f in wanted.fields}
        typed = raw.select(
            *[col(c).try_cast(types.get(c, T.StringType())).alias(c) for c in raw.columns]
        )
    else:
        typed = infer_types(raw)
    return limit_rows(where_equals(typed, filters), row_limit, order_by)


def _read_delimited(spark: SparkSession, group: TextFiles) -> DataFrame:
    head = [
        r["value"].lstrip("\ufeff")
        for r in spark.read.text(group.sample).limit(SNIFF_LINES).collect()
        if r["value"] is not None
    ]
    options = dict(header=True, sep=guess_delimiter(head), encoding=group.encoding, quote='"', escape='"', multiLine=group.breaks)
    names = [n.lstrip("\ufeff") for n in spark.read.csv(group.sample, **options).columns]
    # One column more than the header: only rows with too many fields fill it. Empty
    # fields are kept apart from absent ones until then.
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _SURPLUS]])
    rows = spark.read.csv(
        group.paths, schema=schema, mode="PERMISSIVE", enforceSchema=True, nullValue=_NEVER, **options
    )
    return rows.where(F.col(_SURPLUS).isNull()).select(
        *[F.when(~col(n).isin(NULL_TOKENS), col(n)).alias(n) for n in names]
    )


def infer_types(df: DataFrame) -> DataFrame:
    """Type text columns as long, double, boolean or string, by aggregates over some columns a scan.

    A whole-number column with gaps becomes double and a column without any value is
    numeric, as a dataframe library that stores gaps as NaN would have it.
    """
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not strings:
        return df

    def stats(c: str) -> dict[str, Column]:
        trimmed = F.trim(col(c))
        return {
            "rows": F.count(F.lit(1)),
            "n": F.count(col(c)),
            "whole": F.count(F.when(trimmed.rlike(r"^[+-]?\d+$"), trimmed.try_cast("bigint"))),
            "number": F.count(F.when(~trimmed.rlike(r"[dDfF]$"), trimmed.try_cast("double"))),
            "truth": F.count(F.when(col(c).isin("True", "False", "true", "false", "TRUE", "FALSE"), 1)),
        }

    out: dict[str, Column] = {}
    for seen in per_column(df, strings, stats).collect():
        c, n = seen["column"], seen["n"]
        if n == 0:
            out[c] = F.lit(None).cast("double")
        elif seen["whole"] == n:
            out[c] = F.trim(col(c)).try_cast("bigint" if n == seen["rows"] else "double")
        elif seen["number"] == n:
            out[c] = F.trim(col(c)).try_cast("double")
        elif seen["truth"] == n == seen["rows"]:
            out[c] = F.lower(col(c)).try_cast("boolean")
    return df.select(*[out.get(c, col(c)).alias(c) for c in df.columns])


def json_files(spark: SparkSession, path: str) -> list[tuple[bool, str | list[str]]]:
    """Files whose every line is a document, and files that are one document each."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("line")).where("line <> ''")
    whole = F.col("line").rlike(r"^\{.*\}$") | F.col("line").rlike(r"^\[.*\]$")
    facts = lines.groupBy("file").agg((F.bool_and(whole) & (F.count("*") > 1)).alias("by_line"))
    return [(g["by_line"], paths) for g, paths in _grouped(facts, ["by_line"], path)]


def load_json(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    filters: Mapping[str, object] | None = None,
    row_limit: int | None = None,
    order_by: Sequence[str] | None = None,
    schema: T.StructType | str | None = None,
    lines: bool | None = None,
) -> DataFrame:
    """JSON records: lists of objects, wrapped lists or single objects, nested or flat.

    With ``lines`` every line is a document, so big files are split over tasks; with
    ``lines=False`` every file is one document. If not said, each file shows it: where all
    lines are whole objects or lists, and there are several, every line is a document.
    Nested objects become columns with dotted names, lists stay arrays. Unknown columns
    are passed over.
    """
    if lines is None:
        frames = [
            load_json(spark, paths, schema=schema, lines=by_line) for by_line, paths in json_files(spark, path)
        ]
        if not frames:
            raise ValueError(f"no records in {path}")
        return limit_rows(where_equals(project(union_all(frames), columns, strict=False), filters), row_limit, order_by)
    df = spark.read.json(path, schema=schema, multiLine=not lines)
    types = {f.name: f.dataType for f in df.schema.fields}
    for key in WRAPPER_KEYS:
        t = types.get(key)
        if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType):
            df = df.select(F.explode(col(key)).alias("_record")).select("_record.*")
            break
    df = project(flatten_structs(df), columns, strict=False)
    return limit_rows(where_equals(df, filters), row_limit, order_by)


def flatten_structs(df: DataFrame) -> DataFrame:
    """Every struct leaf as a top-level column named by its dotted path."""

    def leaves(t: T.StructType, path: list[str]):
        for f in t.fields:
            here = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, here)
            else:
                yield here

    picked = []
    for path in leaves(df.schema, []):
        quoted = ".".join("`" + p.replace("`", "``") + "`" for p in path)
        picked.append(F.col(quoted).alias(".".join(path)))
    return df.select(*picked)


def load_table(
    spark: SparkSession,
    source: str,
    table: str | None = None,
    columns: Sequence[str] | None = None,
    filters: Mapping[str, object] | None = None,
    row_limit: int | None = None,
    order_by: Sequence[str] | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """A catalog table, a Parquet or ORC path, or (``jdbc:`` address) a database table."""
    kind = detect_source_kind(source)
    if kind == "jdbc":
        if not table:
            raise ValueError("a database source needs a table name")
        df = spark.read.format("jdbc").options(url=source, dbtable=table, **(options or {})).load()
    elif kind == "table":
        df = spark.table(source)
    else:
        df = spark.read.format("orc" if kind == "orc" else "parquet").load(source)
    df = project(where_equals(df, filters), columns, strict=True)
    return limit_rows(df, row_limit, order_by)
