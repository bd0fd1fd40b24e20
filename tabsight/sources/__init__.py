"""Reading tables: delimited text, JSON records, catalog tables, JDBC and columnar files."""

from .dates import promote_datetimes
from .files import detect_source_kind, load_csv, load_json, load_table
from .shaping import limit_rows, project, where_equals

__all__ = [
    "detect_source_kind",
    "limit_rows",
    "load_csv",
    "load_json",
    "load_table",
    "project",
    "promote_datetimes",
    "where_equals",
]
