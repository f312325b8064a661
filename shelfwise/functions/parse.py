"""Column expressions for messy sales values.

All helpers return ``Column`` expressions, so they stay inside whole-stage
codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the dashboard's own rules for equal results.
# ---------------------------------------------------------------------------
# Text removed before a number is read: thousands separator, taka sign, "tk".
NUMBER_NOISE = [",", "৳", "tk"]
# "<number><k|m|b>" with optional blanks before the suffix.
KMB_PATTERN = r"^([0-9]*\.?[0-9]+)\s*([kKmMbB])$"
# Strict variant: digits, commas and dots before the suffix.
KMB_PATTERN_STRICT = r"^([0-9,.]+)\s*([kKmMbB])$"
# First signed decimal number anywhere in the text.
FIRST_NUMBER = r"[-+]?[0-9]*\.?[0-9]+"
# Strict variant fallback: first unsigned run of digits and dots in the raw text.
FIRST_DIGITS = r"[0-9.]+"
SUFFIX_MULTIPLIER = {"k": 1_000.0, "m": 1_000_000.0, "b": 1_000_000_000.0}
# yes/no spellings of the repeated-customer answer (English and Bangla).
YES_WORDS = ["yes", "y", "true", "1", "হ্যাঁ"]
NO_WORDS = ["no", "n", "false", "0", "না"]
YES_WORDS_EN = ["yes", "y", "true", "1"]
NO_WORDS_EN = ["no", "n", "false", "0"]
# ---------------------------------------------------------------------------

# Python's str.strip()/\s treat every Unicode blank as whitespace; Java's \s does
# not, so the class is spelled out (works in Java regex and RE2 alike).
WS_CLASS = r"[\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


# The suffix patterns as the JVM (and RE2) must run them: Python's \s is the
# Unicode blank class, theirs is ASCII only.
KMB_REGEX = KMB_PATTERN.replace(r"\s", WS_CLASS)
KMB_REGEX_STRICT = KMB_PATTERN_STRICT.replace(r"\s", WS_CLASS)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# The same blanks as one string, for character-set trimming (no regex needed).
WS_CHARS = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"


def py_strip(col: Column | str) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace (a character-set
    trim, cheaper than a regex)."""
    return F.trim(_c(col), F.lit(WS_CHARS))


def _is_numeric(df: DataFrame | None, col: Column | str) -> bool:
    if df is None or not isinstance(col, str):
        return False
    return isinstance(df.schema[col].dataType, T.NumericType)


def _suffix_value(num_text: Column, suffix: Column) -> Column:
    s = F.lower(suffix)
    mult = F.when(s == "k", F.lit(SUFFIX_MULTIPLIER["k"]))
    mult = mult.when(s == "m", F.lit(SUFFIX_MULTIPLIER["m"])).when(s == "b", F.lit(SUFFIX_MULTIPLIER["b"]))
    return num_text.try_cast("double") * mult


def _strip_noise(s: Column) -> Column:
    for token in NUMBER_NOISE:
        s = F.replace(s, F.lit(token), F.lit(""))
    return py_strip(s)


def parse_kmb(col: Column | str, df: DataFrame | None = None) -> Column:
    """Human-written number -> double.

    ``'100.088k'`` -> 100088, ``'৳1,200'`` -> 1200, ``'2.5 M'`` -> 2.5e6,
    otherwise the first signed number in the text, blank or junk -> NULL.
    Numeric input columns (pass ``df`` to detect them) are cast directly.
    """
    if _is_numeric(df, col):
        return _c(col).cast("double")
    raw = _c(col).cast("string")
    s = py_strip(raw)
    cleaned = _strip_noise(s)
    suffix = F.regexp_extract(cleaned, KMB_REGEX, 2)
    first = F.regexp_extract(cleaned, FIRST_NUMBER, 0)
    return (
        F.when(raw.isNull() | (s == ""), F.lit(None).cast("double"))
        .when(suffix != "", _suffix_value(F.regexp_extract(cleaned, KMB_REGEX, 1), suffix))
        .otherwise(F.nullif(first, F.lit("")).try_cast("double"))
    )


def parse_kmb_strict(col: Column | str, df: DataFrame | None = None) -> Column:
    """Variant (P1b): the cleaned text as a float first; on failure the first run
    of digits and dots of the *original* text (so ``'1,200 BDT'`` -> 1)."""
    if _is_numeric(df, col):
        return _c(col).cast("double")
    raw = _c(col).cast("string")
    s = py_strip(raw)
    cleaned = _strip_noise(s)
    suffix = F.regexp_extract(cleaned, KMB_REGEX_STRICT, 2)
    suffix_num = F.regexp_extract(cleaned, KMB_REGEX_STRICT, 1).try_cast("double")
    fallback = F.nullif(F.regexp_extract(raw, FIRST_DIGITS, 0), F.lit("")).try_cast("double")
    direct = py_strip(cleaned).try_cast("double")
    return (
        F.when(raw.isNull() | (s == ""), F.lit(None).cast("double"))
        .when((suffix != "") & suffix_num.isNotNull(), suffix_num * _suffix_value(F.lit("1"), suffix))
        .when((suffix == "") & direct.isNotNull(), direct)
        .otherwise(fallback)
    )


#: Text that reads as a decimal number (Spark's own cast also takes a trailing d or f).
NUMBER_TEXT = r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$|^(?i)[-+]?(inf|infinity|nan)$"


def number_of(col: Column | str) -> Column:
    """Text -> double if it is spelled as a number; other types are cast. The type test is folded by the planner."""
    c = _c(col)
    text = py_strip(c.cast("string"))
    return F.when((F.typeof(c) != "string") | text.rlike(NUMBER_TEXT), c.try_cast("double"))


def to_number(col: Column | str, default: float | None = None) -> Column:
    """``pd.to_numeric(errors='coerce')`` with an optional fill value (P2); the text ``nan`` is a missing value."""
    v = number_of(col)
    v = F.when(~F.isnan(v), v)
    return F.coalesce(v, F.lit(float(default))) if default is not None else v


# Date spellings of the sheets that read alike in every column.
DATE_FORMATS = [
    "yyyy-MM-dd[[' ']['T']HH:mm[:ss[.SSSSSS]]]", "yyyy/M/d[ H:mm[:ss]]", "d-MMM-yyyy", "d-MMM-yy", "d MMM yyyy", "MMM d, yyyy",
    "MMMM d, yyyy", "d MMMM yyyy", "d.M.yyyy[ H:mm[:ss]]",
]
#: The two orders of day and month in numbers; which one holds is a property of the column.
MONTH_FIRST, DAY_FIRST = "M/d/yyyy[ H:mm[:ss]]", "d/M/yyyy[ H:mm[:ss]]"
#: Years a sheet can mean; dates beyond are junk.
FIRST_YEAR, LAST_YEAR = 1900, 2100
#: A date as spreadsheets store it: days since DAY_ZERO, the time of day as a fraction.
SERIAL_TEXT = r"^[0-9]{5}(\.[0-9]+)?$"
DAY_ZERO = "1899-12-30"


# What a text must look like for a pattern to read it. Trying a pattern in vain costs an exception, many times a parse,
# so each is tried only on text of its shape; a shape takes all that its pattern reads, and only years within reach.
_YEAR = r"\+?0*(?:19[0-9]{2}|20[0-9]{2}|2100)(?![0-9])"  # FIRST_YEAR to LAST_YEAR
_MONTH, _DAY = r"0*(?:1[0-2]|[1-9])", r"0*(?:3[01]|[12][0-9]|[1-9])"
SHAPES = {
    "yyyy-MM-dd[[' ']['T']HH:mm[:ss[.SSSSSS]]]": f"^{_YEAR}-", "yyyy/M/d[ H:mm[:ss]]": f"^{_YEAR}/",
    "d-MMM-yyyy": f"^[0-9]+-[^0-9-]+-{_YEAR}", "d-MMM-yy": "^[0-9]+-[^0-9-]+-[0-9]{2}$",
    "d MMM yyyy": f"^[0-9]+ [^0-9]+ {_YEAR}", "d MMMM yyyy": f"^[0-9]+ [^0-9]+ {_YEAR}",
    "MMM d, yyyy": f"^[^0-9]+ [0-9]+, {_YEAR}", "MMMM d, yyyy": f"^[^0-9]+ [0-9]+, {_YEAR}",
    "d.M.yyyy[ H:mm[:ss]]": rf"^[0-9]+\.[0-9]+\.{_YEAR}",
    MONTH_FIRST: f"^{_MONTH}/{_DAY}/{_YEAR}", DAY_FIRST: f"^{_DAY}/{_MONTH}/{_YEAR}",
}


def _read(text: Column, fmt: str) -> Column:
    """A date within reach spelled in the pattern, parsed once; NULL for all other text."""
    return F.when(text.rlike(SHAPES[fmt]), F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz"))


def _in_reach(ts: Column) -> Column:
    return F.when(F.year(ts).between(FIRST_YEAR, LAST_YEAR), ts)


def _serial(text: Column) -> Column:
    n = F.when(text.rlike(SERIAL_TEXT), text.cast("double"))
    days, seconds = F.floor(n).cast("int"), F.round((n - F.floor(n)) * 86400)
    return F.lit(DAY_ZERO).cast("timestamp_ntz") + F.make_dt_interval(days, F.lit(0), F.lit(0), seconds)


def numeric_date(col: Column | str, day_first: bool) -> Column:
    """A date in numbers, parted by slashes or dashes, read in one of the two orders; NULL if it is none."""
    return _read(F.translate(py_strip(_c(col).cast("string")), "-", "/"), DAY_FIRST if day_first else MONTH_FIRST)


def to_ts(col: Column | str, day_first: bool | None = None) -> Column:
    """``pd.to_datetime(errors='coerce')`` (P3): junk, and years no sheet means, -> NULL instead of an error.

    Five-digit numbers are spreadsheet serial days. ``day_first`` is the order of day and month
    in numbers, which ``operators.clean.date_orders`` finds for a column; without it every value is
    read by itself, month first where both orders fit. The result is a wall-clock ``timestamp_ntz``.
    """
    c = py_strip(_c(col).cast("string"))
    orders = [False, True] if day_first is None else [day_first]
    tries = [_read(c, f) for f in DATE_FORMATS[:1]] + [numeric_date(c, o) for o in orders]
    tries += [_in_reach(_serial(c))] + [_read(c, f) for f in DATE_FORMATS[1:]]
    return F.coalesce(*tries)


def norm_key(col: Column | str) -> Column:
    """Join-key normalisation (P4): trim, lower-case."""
    return F.lower(py_strip(_c(col).cast("string")))


def repeat_flag_expr(col: Column | str, bangla: bool = True) -> Column:
    """yes/no answer -> 1/0 (P5). Unknown text that reads as a number keeps that
    number (truncated); anything else, including NULL, is 0."""
    s = F.lower(py_strip(_c(col).cast("string")))
    yes, no = (YES_WORDS, NO_WORDS) if bangla else (YES_WORDS_EN, NO_WORDS_EN)
    numeric = number_of(s).try_cast("int")
    return (
        F.when(s.isin(*yes), F.lit(1))
        .when(s.isin(*no), F.lit(0))
        .otherwise(F.coalesce(numeric, F.lit(0)))
        .cast("int")
    )


def find_repeat_column(df: DataFrame) -> str | None:
    """First column whose name contains 'repeated' and 'customer' (case-insensitive)."""
    for c in df.columns:
        low = c.lower()
        if "repeated" in low and "customer" in low:
            return c
    return None
