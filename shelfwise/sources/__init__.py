"""Sources, sinks and fixture views."""

from shelfwise.sources.fixtures import (
    LINE_KEY,
    dirty_sales_view,
    number_text_view,
    sales_view,
    table,
    texts_view,
)
from shelfwise.sources.io import (
    HEADERS,
    ROW_KEY,
    clean_columns,
    keep,
    logical_names,
    preview,
    read_all,
    read_table,
    read_yearly,
    write_csv,
    write_merged,
)

__all__ = [
    "HEADERS",
    "LINE_KEY",
    "ROW_KEY",
    "clean_columns",
    "dirty_sales_view",
    "keep",
    "logical_names",
    "number_text_view",
    "preview",
    "read_all",
    "read_table",
    "read_yearly",
    "sales_view",
    "table",
    "texts_view",
    "write_csv",
    "write_merged",
]
