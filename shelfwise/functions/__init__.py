"""Column-expression helpers: no Python in the row path."""

from shelfwise.functions.parse import (
    find_repeat_column,
    norm_key,
    parse_kmb,
    parse_kmb_strict,
    py_strip,
    repeat_flag_expr,
    to_number,
    to_ts,
)
from shelfwise.functions.text import clean_text, collapse_ws, pad, word_tokens

__all__ = [
    "clean_text",
    "collapse_ws",
    "find_repeat_column",
    "norm_key",
    "pad",
    "parse_kmb",
    "parse_kmb_strict",
    "py_strip",
    "repeat_flag_expr",
    "to_number",
    "to_ts",
    "word_tokens",
]
