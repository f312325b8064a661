"""DuckDB SQL for each registered query (the value oracle).

The same sales/text views are written here a second time, in plain SQL, from
FIXTURES.md, so the check compares two independent formulations. Tables
``lineitem orders part customer documents labels ...`` are views the checker
registers over the same parquet files.
"""

from __future__ import annotations

SALES = """sales AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey,
         o.o_orderdate AS order_date,
         o.o_custkey AS customer,
         lower(trim(p.p_name)) AS book,
         p.p_type AS category,
         c.c_mktsegment AS gender,
         CAST(18 + o.o_custkey % 60 AS DOUBLE) AS age,
         o.o_orderpriority AS delivery,
         l.l_quantity AS unit,
         l.l_extendedprice / l.l_quantity AS sell_price,
         0.7 * p.p_retailprice AS buying_price,
         l.l_extendedprice * (1 - l.l_discount) AS sell,
         0.7 * p.p_retailprice * l.l_quantity AS cost,
         100 * l.l_discount AS discount_pct,
         CASE l.l_returnflag WHEN 'R' THEN ' Yes ' WHEN 'A' THEN 'no' ELSE 'না' END AS repeated_customer,
         CAST(CASE WHEN l.l_linenumber <= 5 THEN l.l_linenumber END AS DOUBLE) AS review,
         CAST(year(o.o_orderdate) AS INTEGER) AS year
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN customer c ON o.o_custkey = c.c_custkey)"""

FLAG_SQL = """CASE WHEN lower(trim(repeated_customer)) IN ('yes', 'y', 'true', '1', 'হ্যাঁ') THEN 1
       WHEN lower(trim(repeated_customer)) IN ('no', 'n', 'false', '0', 'না') THEN 0
       ELSE coalesce(TRY_CAST(trunc(TRY_CAST(lower(trim(repeated_customer)) AS DOUBLE)) AS INTEGER), 0) END"""

PREPARED = f"""prepared AS (
  SELECT *, sell - cost AS profit,
         {FLAG_SQL} AS repeated_customer_flag,
         CAST(month(order_date) AS INTEGER) AS month
  FROM sales)"""

FILTERED = """filtered AS (
  SELECT * FROM prepared
  WHERE year IS NOT NULL AND category IS NOT NULL AND gender IS NOT NULL AND delivery IS NOT NULL)"""

UNIQ = """uniq AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY order_date, customer, book
                                 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
                                          category, gender, age, delivery, unit, sell_price, buying_price,
                                          sell, cost, discount_pct) AS rn
    FROM filtered) t
  WHERE rn = 1)"""

BASE = [SALES, PREPARED, FILTERED]


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def monthly_series_sql(src: str, value: str, name: str = "v") -> str:
    """Calendar-complete monthly sums of ``value`` over ``src`` (CTEs m, cal, s)."""
    return f"""m AS (SELECT CAST(date_trunc('month', order_date) AS DATE) AS ps, sum({value}) AS v FROM {src} GROUP BY 1),
cal AS (SELECT CAST(unnest(generate_series(CAST(min(ps) AS TIMESTAMP), CAST(max(ps) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS ps FROM m),
s AS (SELECT cal.ps, last_day(cal.ps) AS period_end, coalesce(m.v, 0.0) AS {name} FROM cal LEFT JOIN m USING (ps))"""


ORACLE: dict[str, str] = {}

ORACLE["w1_monthly_rolling"] = with_(*BASE, UNIQ, monthly_series_sql("uniq", "sell * unit", "sell")) + """
SELECT period_end, round(sell, 0) AS sell,
       round(CASE WHEN count(sell) OVER w3 = 3 THEN avg(sell) OVER w3 END, 0) AS rolling_3,
       round(CASE WHEN count(sell) OVER w6 = 6 THEN avg(sell) OVER w6 END, 0) AS rolling_6
FROM s
WINDOW w3 AS (ORDER BY ps ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
       w6 AS (ORDER BY ps ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"""

ORACLE["g1_kpis"] = with_(*BASE, UNIQ) + """
SELECT round(sum(sell * unit), 0) AS total_sell,
       round(sum(greatest((sell_price - buying_price) * unit, 0.0)), 0) AS total_profit,
       count(*) AS total_orders,
       count(DISTINCT book) AS unique_books,
       round(avg(repeated_customer_flag) * 100, 6) AS repeat_pct
FROM uniq"""

ORACLE["g1b_kpis_raw"] = with_(*BASE) + """
SELECT round(coalesce(sum(sell), 0), 0) AS total_sell,
       round(coalesce(sum(profit), 0), 0) AS total_profit,
       count(*) AS total_orders,
       count(DISTINCT book) AS unique_books,
       round(avg(repeated_customer_flag) * 100, 6) AS repeat_pct
FROM filtered"""

ORACLE["g1c_customer_counts"] = with_(*BASE[:2]) + """
SELECT round(coalesce(sum(sell), 0), 0) AS total_sales,
       count(*) AS total_customers,
       CAST(coalesce(sum(repeated_customer_flag), 0) AS BIGINT) AS repeated_customers,
       count(*) - CAST(coalesce(sum(repeated_customer_flag), 0) AS BIGINT) AS new_customers
FROM prepared"""

ORACLE["g2_sell_by_category"] = with_(*BASE) + """
SELECT category, round(sum(sell), 0) AS total_sell FROM filtered
WHERE category IS NOT NULL GROUP BY category"""

ORACLE["g2_profit_by_category"] = with_(*BASE) + """
SELECT category, round(sum(profit), 0) AS total_profit FROM filtered
WHERE category IS NOT NULL GROUP BY category"""

ORACLE["g2_sell_by_gender"] = with_(*BASE[:2]) + """
SELECT gender, round(sum(sell), 0) AS total_sell FROM prepared
WHERE gender IS NOT NULL GROUP BY gender"""

ORACLE["g3_top_books"] = with_(*BASE, UNIQ) + """
SELECT book, round(sum(unit), 0) AS units_sold FROM uniq
WHERE book IS NOT NULL GROUP BY book ORDER BY sum(unit) DESC, book LIMIT 10"""

ORACLE["g4_delivery_counts"] = with_(*BASE) + """
SELECT delivery, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share_pct
FROM filtered WHERE delivery IS NOT NULL GROUP BY delivery"""

ORACLE["g5_retention_by_gender"] = with_(*BASE) + """
SELECT gender, round(avg(repeated_customer_flag) * 100, 6) AS repeated_pct
FROM filtered WHERE gender IS NOT NULL GROUP BY gender"""

ORACLE["g6_repeat_by_year"] = with_(*BASE[:2]) + """
SELECT year, CAST(coalesce(sum(repeated_customer_flag), 0) AS BIGINT) AS repeated_customers
FROM prepared WHERE year IS NOT NULL GROUP BY year"""

ORACLE["g7_age_histogram"] = with_(*BASE) + """,
b AS (SELECT min(age) AS lo, max(age) AS hi FROM filtered),
p AS (SELECT lo, CASE WHEN hi > lo THEN (hi - lo) / 20 ELSE 1.0 END AS width FROM b),
c AS (SELECT CAST(least(floor((age - p.lo) / p.width), 19) AS INTEGER) AS bin, count(*) AS n
      FROM filtered, p WHERE age IS NOT NULL GROUP BY 1)
SELECT CAST(r.bin AS INTEGER) AS bin,
       round(p.lo + r.bin * p.width, 6) AS bin_start,
       round(p.lo + (r.bin + 1) * p.width, 6) AS bin_end,
       coalesce(c.n, 0) AS count
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(20)) r CROSS JOIN p
LEFT JOIN c ON c.bin = r.bin"""

ORACLE["g8_rating_distribution"] = with_(*BASE) + """
SELECT review AS rating, count(*) AS count,
       round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percent
FROM filtered WHERE review IS NOT NULL GROUP BY review"""

ORACLE["g9_rfm"] = with_(*BASE) + """,
a AS (SELECT max(order_date) AS as_of FROM filtered)
SELECT customer, count(order_date) AS frequency, round(sum(sell), 0) AS monetary,
       max(order_date) AS last_order,
       CAST(datediff('day', CAST(max(order_date) AS DATE), CAST(any_value(a.as_of) AS DATE)) AS INTEGER) AS recency_days
FROM filtered, a WHERE customer IS NOT NULL
GROUP BY customer ORDER BY sum(sell) DESC, customer LIMIT 20"""

ORACLE["g10_season"] = with_(*BASE) + """
SELECT year, CAST(month(order_date) AS INTEGER) AS month, round(sum(sell), 0) AS total_sell
FROM filtered WHERE year IS NOT NULL AND order_date IS NOT NULL GROUP BY 1, 2"""

ORACLE["g11_year_month_pivot"] = with_(*BASE) + """
SELECT CAST(year(order_date) AS INTEGER) AS year,
""" + ",\n".join(
    f"       round(coalesce(sum(CASE WHEN month(order_date) = {m} THEN sell END), 0), 0) AS m{m}" for m in range(1, 13)
) + """
FROM filtered WHERE order_date IS NOT NULL GROUP BY 1"""

ORACLE["g12_month_of_year"] = with_(*BASE) + """
SELECT CAST(r.m AS INTEGER) AS month, round(coalesce(t.total, 0), 0) AS total_sell
FROM (SELECT range AS m FROM range(1, 13)) r
LEFT JOIN (SELECT month(order_date) AS m, sum(sell) AS total FROM filtered
           WHERE order_date IS NOT NULL GROUP BY 1) t ON t.m = r.m"""

ORACLE["w2_yoy"] = with_(*BASE) + """,
y AS (SELECT year, sum(sell) AS total_sell FROM filtered WHERE year IS NOT NULL GROUP BY year)
SELECT year, round(total_sell, 0) AS total_sell,
       round(CASE WHEN lag(total_sell) OVER (ORDER BY year) <> 0
                  THEN (total_sell - lag(total_sell) OVER (ORDER BY year)) / lag(total_sell) OVER (ORDER BY year) * 100 END, 6) AS yoy_pct
FROM y"""

ORACLE["w3_mom"] = with_(*BASE, monthly_series_sql("filtered", "sell", "sell")) + """
SELECT period_end, round(sell, 0) AS sell,
       round(CASE WHEN lag(sell) OVER (ORDER BY ps) <> 0
                  THEN (sell - lag(sell) OVER (ORDER BY ps)) / lag(sell) OVER (ORDER BY ps) * 100 END, 6) AS mom_pct
FROM s"""


def _calendar_sql(src: str, date_col: str, value: str, trunc: str, step: str, end: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    kjoin = f" USING ({keys}, ps)" if keys else " USING (ps)"
    by = f"GROUP BY {keys}" if keys else ""
    return f"""m AS (SELECT {k}{trunc} AS ps, sum({value}) AS v FROM {src} WHERE {date_col} IS NOT NULL GROUP BY ALL),
cal AS (SELECT {k}CAST(unnest(generate_series(CAST(min(ps) AS TIMESTAMP), CAST(max(ps) AS TIMESTAMP), {step})) AS DATE) AS ps FROM m {by}),
s AS (SELECT {k}cal.ps, {end} AS period_end, coalesce(m.v, 0.0) AS v FROM cal LEFT JOIN m{kjoin})"""


ORACLE["t1_resample_week"] = with_(*BASE, _calendar_sql(
    "filtered", "order_date", "sell", "CAST(date_trunc('week', order_date) AS DATE)", "INTERVAL 7 DAY",
    "CAST(cal.ps + INTERVAL 6 DAY AS DATE)")) + "SELECT period_end, round(v, 0) AS sell FROM s"

ORACLE["t1_resample_day"] = with_(*BASE, _calendar_sql(
    "filtered", "order_date", "sell", "CAST(order_date AS DATE)", "INTERVAL 1 DAY", "cal.ps")) + \
    "SELECT period_end, round(v, 0) AS sell FROM s"

ORACLE["t1_resample_year"] = with_(*BASE, _calendar_sql(
    "filtered", "order_date", "sell", "CAST(date_trunc('year', order_date) AS DATE)", "INTERVAL 1 YEAR",
    "CAST(cal.ps + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE)")) + "SELECT period_end, round(v, 0) AS sell FROM s"

ORACLE["t1_events_daily_by_type"] = with_(_calendar_sql(
    "events", "ts", "value", "CAST(ts AS DATE)", "INTERVAL 1 DAY", "cal.ps", keys="event_type")) + \
    "SELECT event_type, period_end, round(v, 6) AS value FROM s"


def _decompose_sql(extrapolate: bool, keys: str = "") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    k = f"{keys}, " if keys else ""
    on = " AND ".join([f"t.{c} = ph2.{c}" for c in keys.split(", ")] + ["t.idx % 12 = ph2.phase"]) if keys else "t.idx % 12 = ph2.phase"
    w = f"OVER ({part}ORDER BY ps"
    sql = f"""s2 AS (SELECT *, row_number() {w}) - 1 AS idx, count(*) OVER ({part.strip()}) AS n FROM s),
t0 AS (SELECT *, (sum(v) {w} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
                  + (lag(v, 6) {w}) + lead(v, 6) {w})) / 2) / 12 AS trend FROM s2 WHERE n >= 24)"""
    if extrapolate:
        sql += f""",
f AS (SELECT {k}min(idx) FILTER (WHERE trend IS NOT NULL) AS front, max(idx) FILTER (WHERE trend IS NOT NULL) AS back
      FROM t0 {'GROUP BY ' + keys if keys else ''}),
fit AS (SELECT {k}
          regr_slope(CASE WHEN idx >= front AND idx < least(front + 12, back) THEN trend END, CAST(idx AS DOUBLE)) AS kf,
          regr_intercept(CASE WHEN idx >= front AND idx < least(front + 12, back) THEN trend END, CAST(idx AS DOUBLE)) AS nf,
          regr_slope(CASE WHEN idx >= greatest(front, back - 12) AND idx < back THEN trend END, CAST(idx AS DOUBLE)) AS kb,
          regr_intercept(CASE WHEN idx >= greatest(front, back - 12) AND idx < back THEN trend END, CAST(idx AS DOUBLE)) AS nb,
          any_value(front) AS front, any_value(back) AS back
        FROM t0 {'JOIN f USING (' + keys + ')' if keys else ', f'} {'GROUP BY ' + keys if keys else ''}),
t AS (SELECT t0.* REPLACE (CASE WHEN idx < front THEN kf * idx + nf WHEN idx > back THEN kb * idx + nb ELSE trend END AS trend)
      FROM t0 {'JOIN fit USING (' + keys + ')' if keys else ', fit'})"""
    else:
        sql += ",\nt AS (SELECT * FROM t0)"
    sql += f""",
ph AS (SELECT {k}idx % 12 AS phase, avg(v - trend) AS pm FROM t GROUP BY ALL),
ph2 AS (SELECT {k}phase, pm - avg(pm) OVER ({part.strip()}) AS seasonal FROM ph)
SELECT {', '.join('t.' + c for c in keys.split(', ')) + ', ' if keys else ''}t.period_end, round(t.v, 0) AS sell, round(t.trend, 0) AS trend,
       round(ph2.seasonal, 0) AS seasonal, round(t.v - t.trend - ph2.seasonal, 0) AS resid
FROM t JOIN ph2 ON {on}"""
    return sql


ORACLE["t2_decompose"] = with_(*BASE, monthly_series_sql("filtered", "sell", "v"), _decompose_sql(False))
ORACLE["t2b_decompose_extrapolated"] = with_(*BASE, monthly_series_sql("filtered", "sell", "v"), _decompose_sql(True))
ORACLE["t2_decompose_by_category"] = with_(*BASE, _calendar_sql(
    "filtered", "order_date", "sell", "CAST(date_trunc('month', order_date) AS DATE)", "INTERVAL 1 MONTH",
    "last_day(cal.ps)", keys="category"), _decompose_sql(False, keys="category"))


# --- P: projections and cleaning -------------------------------------------------------
from shelfwise.functions.parse import FIRST_DIGITS, FIRST_NUMBER, WS_CLASS  # noqa: E402
from shelfwise.functions.parse import KMB_REGEX as KMB_PATTERN  # noqa: E402
from shelfwise.functions.parse import KMB_REGEX_STRICT as KMB_PATTERN_STRICT  # noqa: E402

STRIP = f"^{WS_CLASS}+|{WS_CLASS}+$"
KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _strip(e: str) -> str:
    return f"regexp_replace({e}, '{STRIP}', '', 'g')"


NUMS = """nums AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CASE (l_orderkey + l_linenumber) % 12
           WHEN 0 THEN th || '.' || rest || 'k'
           WHEN 1 THEN '৳' || th || ',' || rest
           WHEN 2 THEN q || ' M'
           WHEN 3 THEN '-' || q
           WHEN 4 THEN '-' || q || 'k'
           WHEN 5 THEN 'tk ' || q
           WHEN 6 THEN ''
           WHEN 7 THEN 'abc'
           WHEN 8 THEN th || ',' || rest || ' BDT'
           WHEN 9 THEN ' ' || q || 'b '
           WHEN 10 THEN NULL
           ELSE q || '.5' END AS raw
  FROM (SELECT *, CAST(CAST(unit AS BIGINT) AS VARCHAR) AS q,
               CAST(CAST(floor(sell) AS BIGINT) // 1000 AS VARCHAR) AS th,
               lpad(CAST(CAST(floor(sell) AS BIGINT) % 1000 AS VARCHAR), 3, '0') AS rest
        FROM sales) t)"""

CLEANED = f"""cl AS (
  SELECT *, {_strip("replace(replace(replace(s, ',', ''), '৳', ''), 'tk', '')")} AS c
  FROM (SELECT *, {_strip('raw')} AS s FROM nums) t)"""

MULT = "CASE lower({suf}) WHEN 'k' THEN 1000.0 WHEN 'm' THEN 1000000.0 WHEN 'b' THEN 1000000000.0 END"

ORACLE["p1_parse_kmb"] = with_(SALES, NUMS, CLEANED) + f"""
SELECT {KEYS}, raw,
  round(CASE WHEN raw IS NULL OR s = '' THEN NULL
       WHEN regexp_extract(c, '{KMB_PATTERN}', 2) <> ''
         THEN TRY_CAST(regexp_extract(c, '{KMB_PATTERN}', 1) AS DOUBLE) * {MULT.format(suf=f"regexp_extract(c, '{KMB_PATTERN}', 2)")}
       ELSE TRY_CAST(NULLIF(regexp_extract(c, '{FIRST_NUMBER}', 0), '') AS DOUBLE) END, 6) AS value
FROM cl"""

ORACLE["p1b_parse_kmb_strict"] = with_(SALES, NUMS, CLEANED) + f""",
st AS (SELECT *, regexp_extract(c, '{KMB_PATTERN_STRICT}', 2) AS suf,
              TRY_CAST(regexp_extract(c, '{KMB_PATTERN_STRICT}', 1) AS DOUBLE) AS sufnum,
              TRY_CAST({_strip('c')} AS DOUBLE) AS direct,
              TRY_CAST(NULLIF(regexp_extract(raw, '{FIRST_DIGITS}', 0), '') AS DOUBLE) AS fallback
       FROM cl)
SELECT {KEYS}, raw,
  round(CASE WHEN raw IS NULL OR s = '' THEN NULL
       WHEN suf <> '' AND sufnum IS NOT NULL THEN sufnum * {MULT.format(suf='suf')}
       WHEN suf = '' AND direct IS NOT NULL THEN direct
       ELSE fallback END, 6) AS value
FROM st"""

DIRTY = """dirty AS (
  SELECT *,
    CASE l_linenumber % 4 WHEN 0 THEN '1.5k' WHEN 1 THEN '৳1,200' WHEN 2 THEN '' ELSE 'n/a' END AS sell_text,
    CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE unit END AS unit_missing,
    CASE WHEN customer % 11 = 0 THEN NULL ELSE gender END AS gender_missing,
    CASE WHEN l_orderkey % 13 = 0 THEN 'bad' ELSE CAST(order_date AS VARCHAR) END AS order_date_text,
    sell * CASE WHEN l_partkey % 50 = 0 THEN 100.0 ELSE 1.0 END AS sell_outlier
  FROM sales)"""

ORACLE["p2_to_number"] = with_(SALES, DIRTY) + f"""
SELECT {KEYS}, round(TRY_CAST(sell_text AS DOUBLE), 6) AS sell_num,
       round(coalesce(TRY_CAST(unit_missing AS DOUBLE), 1.0), 6) AS unit_filled FROM dirty"""

ORACLE["p3_to_ts"] = with_(SALES, DIRTY) + f"""
SELECT {KEYS}, order_date_text, TRY_CAST(order_date_text AS TIMESTAMP) AS order_ts FROM dirty"""

ORACLE["p2_number_spellings"] = with_(SALES) + f"""
SELECT {KEYS}, cell, CASE WHEN lower(cell) NOT LIKE '%nan' THEN TRY_CAST(cell AS DOUBLE) END AS value,
       coalesce(CASE WHEN lower(cell) NOT LIKE '%nan' THEN TRY_CAST(cell AS DOUBLE) END, 1.0) AS filled
FROM (SELECT *, CASE (l_orderkey + l_linenumber) % 8 WHEN 0 THEN 'nan' WHEN 1 THEN ' ' || n WHEN 2 THEN n || 'e1' WHEN 3 THEN n || 'd'
                     WHEN 4 THEN '' WHEN 5 THEN '-NaN' WHEN 6 THEN '-' || n || '.5' END AS cell
      FROM (SELECT *, CAST(CAST(unit AS INTEGER) AS VARCHAR) AS n FROM sales) a) b"""


def _spelled(order: str) -> str:
    return f"""CASE WHEN k < 4 THEN strftime(order_date, '{order}') WHEN k = 4 THEN ' ' || strftime(order_date, '{order.replace("/", "-")}')
    WHEN k = 5 THEN strftime(order_date, '%Y-%m-%d') WHEN k = 6 THEN serial WHEN k = 7 THEN strftime(order_date, '%-d-%b-%Y')
    WHEN k = 8 THEN ['n/a', '', '13/13/2024', '2024', '99999', '01/02/3024', 'nan'][l_linenumber % 7 + 1] ELSE serial || '.5' END"""


def _dates(col: str, day_first: str) -> str:
    """One column's values by the column's order; the other spellings by their look."""
    t = f"trim({col})"
    return f"""CASE WHEN {t} SIMILAR TO '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}' THEN TRY_CAST({t} AS TIMESTAMP)
    WHEN {t} SIMILAR TO '[0-9]{{5}}([.][0-9]+)?' THEN TIMESTAMP '1899-12-30' + to_seconds(round(CAST({t} AS DOUBLE) * 86400))
    WHEN {t} SIMILAR TO '[0-9]+-[A-Z][a-z]+-[0-9]+' THEN try_strptime({t}, '%d-%b-%Y')
    WHEN {day_first} THEN try_strptime(replace({t}, '-', '/'), '%d/%m/%Y') ELSE try_strptime(replace({t}, '-', '/'), '%m/%d/%Y') END"""


ORACLE["p3_column_dates"] = with_(SALES, f"""spelt AS (
  SELECT {KEYS}, {_spelled('%-d/%-m/%Y')} AS ordered, {_spelled('%m/%d/%Y')} AS shipped
  FROM (SELECT *, (l_orderkey + l_linenumber) % 10 AS k, CAST(datediff('day', DATE '1899-12-30', CAST(order_date AS DATE)) AS VARCHAR) AS serial FROM sales) a),
n AS (SELECT count(*) FILTER (WHERE year(try_strptime(replace(trim(ordered), '-', '/'), '%d/%m/%Y')) <= 2100)
             > count(*) FILTER (WHERE year(try_strptime(replace(trim(ordered), '-', '/'), '%m/%d/%Y')) <= 2100) AS day1,
             count(*) FILTER (WHERE year(try_strptime(replace(trim(shipped), '-', '/'), '%d/%m/%Y')) <= 2100)
             > count(*) FILTER (WHERE year(try_strptime(replace(trim(shipped), '-', '/'), '%m/%d/%Y')) <= 2100) AS day2 FROM spelt),
read AS (SELECT {KEYS}, {_dates('ordered', 'day1')} AS o, {_dates('shipped', 'day2')} AS s FROM spelt, n)""") + f"""
SELECT {KEYS}, CASE WHEN year(o) BETWEEN 1900 AND 2100 THEN o END AS ordered, CASE WHEN year(s) BETWEEN 1900 AND 2100 THEN s END AS shipped FROM read"""

ORACLE["p4_norm_key"] = f"SELECT p_partkey, lower({_strip('p_name')}) AS book FROM part"

ORACLE["p5_repeat_flag"] = with_(SALES, PREPARED) + f"SELECT {KEYS}, repeated_customer, repeated_customer_flag FROM prepared"

ORACLE["p6_date_parts"] = with_(SALES, DIRTY) + f"""
SELECT {KEYS}, CAST(coalesce(year(TRY_CAST(order_date_text AS TIMESTAMP)), year) AS INTEGER) AS year,
       CAST(month(TRY_CAST(order_date_text AS TIMESTAMP)) AS INTEGER) AS month FROM dirty"""

ORACLE["p7_profit"] = with_(SALES) + f"""
SELECT {KEYS}, round(sell - cost, 6) AS profit, round(coalesce(sell_price - buying_price, 0.0), 6) AS profit_fallback FROM sales"""

ORACLE["p8_clipped_profit"] = with_(SALES) + f"""
SELECT {KEYS}, round(greatest((coalesce(sell_price, 0.0) - coalesce(buying_price, 0.0)) * coalesce(unit, 1.0), 0.0), 6) AS clipped_profit
FROM sales"""

ORACLE["p9_fill_unknown"] = with_(SALES, DIRTY) + f"SELECT {KEYS}, coalesce(gender_missing, 'Unknown') AS gender_missing FROM dirty"

ORACLE["p10_fill_zero"] = with_(SALES, DIRTY) + f"""
SELECT {KEYS}, coalesce(unit_missing, 0.0) AS unit_missing, coalesce(gender_missing, '0') AS gender_missing FROM dirty"""

ORACLE["p11_fill_median"] = with_(SALES, DIRTY) + f""",
med AS (SELECT quantile_cont(unit_missing, 0.5) AS m FROM dirty)
SELECT {KEYS}, round(coalesce(unit_missing, med.m), 6) AS unit_missing FROM dirty, med"""

ORACLE["p11_fill_median_whole"] = with_(SALES, DIRTY) + f""",
w AS (SELECT {KEYS}, CASE WHEN l_orderkey % 2 <> 0 THEN l_orderkey // 2 % 2 * 3 END AS whole, CAST(unit_missing AS INTEGER) AS units FROM dirty),
med AS (SELECT quantile_cont(whole, 0.5) AS m, quantile_cont(units, 0.5) AS u FROM w)
SELECT {KEYS}, round(coalesce(CAST(whole AS DOUBLE), m), 6) AS whole, round(coalesce(CAST(units AS DOUBLE), u), 6) AS units FROM w, med"""

ORACLE["p12_fill_mode"] = with_(SALES, DIRTY) + f""",
md AS (SELECT gender_missing AS m FROM dirty WHERE gender_missing IS NOT NULL
       GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT {KEYS}, coalesce(gender_missing, (SELECT m FROM md)) AS gender_missing FROM dirty"""

ORACLE["p13_standardize_category"] = with_(SALES, DIRTY) + f"""
SELECT {KEYS}, CASE WHEN lower({_strip('gender_missing')}) IN ('automobile', 'building')
                    THEN lower({_strip('gender_missing')}) ELSE 'unknown' END AS segment FROM dirty"""

ORACLE["p14_high_value_flag"] = with_(SALES, PREPARED) + f""",
thr AS (SELECT quantile_cont(profit, 0.8) AS t FROM prepared)
SELECT {KEYS}, round(profit, 6) AS profit, CASE WHEN profit >= thr.t THEN 1 ELSE 0 END AS high_value_customer
FROM prepared, thr"""


def _iqr_steps(cols: list[str], src: str) -> str:
    parts, prev = [], src
    for i, c in enumerate(cols):
        parts.append(f"""b{i} AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {prev}),
k{i} AS (SELECT {prev}.* FROM {prev}, b{i}
        WHERE {c} >= q1 - 1.5 * (q3 - q1) AND {c} <= q3 + 1.5 * (q3 - q1))""")
        prev = f"k{i}"
    return ",\n".join(parts)


ORACLE["p15_iqr_filter"] = with_(SALES, DIRTY, f"""d2 AS (SELECT {KEYS}, sell_price, sell_outlier, cost, sell - cost AS profit FROM dirty)""",
                                 _iqr_steps(["sell_price", "sell_outlier", "cost", "profit"], "d2")) + f"""
SELECT {KEYS}, round(sell_price, 6) AS sell_price, round(sell_outlier, 6) AS sell_outlier,
       round(cost, 6) AS cost, round(profit, 6) AS profit FROM k3"""


def _codes(col: str) -> str:
    return f"""c_{col} AS (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS code
             FROM (SELECT DISTINCT CAST({col} AS VARCHAR) AS v FROM sales WHERE {col} IS NOT NULL) t)"""


ORACLE["p16_label_encode"] = with_(SALES, _codes("category"), _codes("gender"), _codes("delivery")) + f"""
SELECT {', '.join('s.' + k for k in KEYS.split(', '))}, s.category, s.gender, s.delivery,
       a.code AS category_code, b.code AS gender_code, c.code AS delivery_code
FROM sales s LEFT JOIN c_category a ON s.category = a.v
LEFT JOIN c_gender b ON s.gender = b.v LEFT JOIN c_delivery c ON s.delivery = c.v"""

ORACLE["p17_standardize"] = with_(SALES, PREPARED) + f"""
SELECT {KEYS},
""" + ",\n".join(
    f"  round(({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1.0), 6) AS {c}_z"
    for c in ["age", "unit", "sell", "profit"]
) + "\nFROM prepared"

ORACLE["p18_drop_cols"] = with_(SALES) + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, order_date, customer, book, category, gender,
       round(age, 6) AS age, delivery, round(unit, 6) AS unit, round(sell_price, 6) AS sell_price,
       round(sell, 6) AS sell, round(discount_pct, 6) AS discount_pct, repeated_customer,
       round(review, 6) AS review, year
FROM sales"""

ORACLE["p19_total_amount"] = with_(SALES) + f"SELECT {KEYS}, round(unit * sell_price, 6) AS total_amount FROM sales"

_NULL_COLS = [("l_orderkey", "bigint"), ("l_linenumber", "int"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
              ("sell_text", "string"), ("unit_missing", "double"), ("gender_missing", "string"),
              ("order_date_text", "string")]
ORACLE["p20_null_summary"] = with_(SALES, DIRTY) + "\n UNION ALL\n".join(
    f"SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) FILTER (WHERE {c} IS NULL) AS null_count, "
    f"count(*) AS row_count FROM dirty"
    for c, t in _NULL_COLS
)

ORACLE["p21_non_numeric"] = with_(SALES, DIRTY) + "\n UNION\n".join(
    f"SELECT DISTINCT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM dirty "
    f"WHERE {c} IS NOT NULL AND TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) IS NULL"
    for c in ["sell_text", "order_date_text", "unit_missing"]
)

ORACLE["p22_one_hot"] = with_(SALES) + f"""
SELECT {KEYS},
""" + ",\n".join(
    f"""  CAST(delivery = '{v}' AS INTEGER) AS "delivery_{v}\"""" for v in ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
) + "\nFROM sales"

# --- F / J / S ---------------------------------------------------------------------------
ORACLE["f1_apply_filters"] = with_(SALES, PREPARED) + f"""
SELECT {KEYS}, year, category FROM prepared
WHERE year IN (1996, 1997, 1998) AND category IN ('PROMO', 'SMALL') AND delivery IS NOT NULL"""

ORACLE["f1_year_of_order_date"] = with_(SALES) + f"""
SELECT {KEYS}, order_date, CAST(year(order_date) AS INTEGER) AS year FROM sales
WHERE year(order_date) IN (1996, 1998) AND gender IS NOT NULL"""

ORACLE["f2_filter_options"] = with_(SALES, PREPARED) + """
SELECT DISTINCT 'year' AS dimension, CAST(year AS VARCHAR) AS value FROM prepared WHERE year IS NOT NULL
UNION SELECT DISTINCT 'category', category FROM prepared WHERE category IS NOT NULL
UNION SELECT DISTINCT 'gender', gender FROM prepared WHERE gender IS NOT NULL
UNION SELECT DISTINCT 'delivery', delivery FROM prepared WHERE delivery IS NOT NULL"""

ORACLE["f3_drop_nulls"] = with_(SALES, DIRTY) + f"""
SELECT {KEYS}, round(unit_missing, 6) AS unit_missing, gender_missing FROM dirty
WHERE unit_missing IS NOT NULL AND gender_missing IS NOT NULL"""

ORACLE["f4_dedup_orders"] = with_(*BASE, UNIQ) + f"SELECT {KEYS}, order_date, customer, book FROM uniq"

ORACLE["f5_distinct_rows"] = with_(SALES) + "SELECT DISTINCT order_date, customer, book, round(unit, 6) AS unit FROM sales"

ORACLE["j1_join_books"] = with_(SALES, f"""books AS (
  SELECT book, p_partkey, p_brand, p_size FROM (
    SELECT lower({_strip('p_name')}) AS book, p_partkey, p_brand, p_size,
           row_number() OVER (PARTITION BY lower({_strip('p_name')}) ORDER BY p_partkey) AS rn
    FROM part) t WHERE rn = 1)""") + f"""
SELECT {', '.join('s.' + k for k in KEYS.split(', '))}, lower({_strip('s.book')}) AS book, b.p_partkey, b.p_brand, b.p_size
FROM sales s LEFT JOIN books b ON lower({_strip('s.book')}) = b.book"""

ORACLE["s4_clean_columns"] = with_(SALES) + f"""
SELECT {KEYS}, order_date AS Order_Date, customer AS Customer_Phone, book AS Name_of_Books,
       category AS Category_Of_Books, repeated_customer AS Repeated_Customers? FROM sales""".replace(
    "Repeated_Customers?", '"Repeated_Customers?"')

ORACLE["s7_preview"] = with_(SALES) + f"""
SELECT {KEYS}, book, round(sell, 6) AS sell FROM sales ORDER BY {KEYS} LIMIT 5"""


def _unround(sql: str, digits: str = "6") -> str:
    """Drop ``round(expr, digits)`` wrappers: row-level doubles are computed by the
    same IEEE operations in both engines, and rounding only adds tie flips."""
    out, i, tag = [], 0, "round("
    while True:
        j = sql.find(tag, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:j])
        depth, k = 1, j + len(tag)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = sql[j + len(tag):k - 1]
        head, _, last = inner.rpartition(",")
        out.append(_unround(head) if last.strip() == digits else tag + _unround(inner) + ")")
        i = k


for _k in ['p1_parse_kmb', 'p1b_parse_kmb_strict', 'p2_to_number', 'p7_profit', 'p8_clipped_profit', 'p14_high_value_flag', 'p15_iqr_filter', 'p18_drop_cols', 'p19_total_amount', 'f3_drop_nulls', 'f5_distinct_rows', 's7_preview']:
    ORACLE[_k] = _unround(ORACLE[_k])


# --- X: text ----------------------------------------------------------------------------
from shelfwise.functions.text import EMAIL_PATTERN, PUNCT_PATTERN, WORD_FILTERS  # noqa: E402


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


CLEANED_TEXTS = f"""t AS (
  SELECT d.doc_id, d.text, l.quality AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  WHERE d.text IS NOT NULL AND l.quality IS NOT NULL),
u AS (SELECT doc_id, text, label FROM (
        SELECT *, row_number() OVER (PARTITION BY label, text ORDER BY doc_id) AS rn FROM t) x WHERE rn = 1),
cleaned AS (
  SELECT doc_id, label,
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''),
             {_lit(EMAIL_PATTERN)}, '', 'g'), {_lit(PUNCT_PATTERN)}, '', 'g'),
             {_lit(WS_CLASS + '+')}, ' ', 'g'), '^ | $', '', 'g') AS text
  FROM u)"""

_LABELLED = CLEANED_TEXTS
# X1 to X5 run over every document; the language stands in for the label
CLEANED_TEXTS = _LABELLED.replace(
    "SELECT d.doc_id, d.text, l.quality AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id\n  WHERE d.text IS NOT NULL AND l.quality IS NOT NULL",
    "SELECT d.doc_id, d.text, d.lang AS label FROM documents d WHERE d.text IS NOT NULL AND d.lang IS NOT NULL")

ORACLE["x1_clean_texts"] = with_(CLEANED_TEXTS) + "SELECT doc_id, label, text FROM cleaned"

ORACLE["x2_char_tfidf"] = with_(CLEANED_TEXTS) + f""",
c AS (SELECT doc_id, regexp_replace(lower(text), {_lit(WS_CLASS + WS_CLASS + '+')}, ' ', 'g') AS t FROM cleaned),
g AS (SELECT doc_id, substring(t, i, n) AS term FROM (
        SELECT doc_id, t, n, unnest(range(1, length(t) - n + 2)) AS i
        FROM c, (SELECT unnest([1, 2, 3]) AS n) ns WHERE length(t) >= n) x),
tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL),
st AS (SELECT term, sum(tf) AS cc, count(*) AS df FROM tf GROUP BY term),
voc AS (SELECT term, df, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS feature_index
        FROM (SELECT * FROM st ORDER BY cc DESC, term LIMIT 20000) x),
nd AS (SELECT count(DISTINCT doc_id) AS n FROM cleaned),
w AS (SELECT tf.doc_id, tf.term, voc.feature_index, tf.tf,
             tf.tf * (ln((1.0 + nd.n) / (1.0 + voc.df)) + 1.0) AS raw
      FROM tf JOIN voc ON tf.term = voc.term, nd)
SELECT doc_id, term, feature_index, tf, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 8) AS tfidf FROM w"""

ORACLE["m7c_fixed_scores"] = ORACLE["x2_char_tfidf"].replace(CLEANED_TEXTS, _LABELLED).replace(
    "SELECT doc_id, term, feature_index, tf, round(raw", "SELECT doc_id, feature_index, (raw", 1).replace(", 8) AS tfidf FROM w", ") AS tfidf FROM w", 1)
_HEAD, _, _LAST = ORACLE["m7c_fixed_scores"].rpartition("SELECT doc_id, feature_index")
ORACLE["m7c_fixed_scores"] = _HEAD.rstrip() + f""",
z AS (SELECT doc_id, feature_index{_LAST}),
s AS (SELECT doc_id, sum(tfidf * (feature_index::BIGINT * 7919 % 2001 - 1000) / 1000.0::DOUBLE) + 0.05::DOUBLE AS margin FROM z GROUP BY doc_id)
SELECT doc_id, round(margin, 6) AS margin, CAST(margin > 0 AS INTEGER) AS prediction FROM s"""

_TOKENS = f"""toks AS (
  SELECT doc_id, unnest(arr) AS word, unnest(range(len(arr))) AS pos FROM (
    SELECT doc_id, list_filter(string_split(translate(lower(text), {_lit(WORD_FILTERS)}, {_lit(' ' * len(WORD_FILTERS))}), ' '),
                               lambda x: x <> '') AS arr
    FROM cleaned) a),
vocab AS (SELECT word, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, word) + 1 AS index
          FROM toks GROUP BY word)"""

ORACLE["x3_fit_vocab"] = with_(CLEANED_TEXTS, _TOKENS) + """
SELECT word, count, index FROM vocab
UNION ALL SELECT '<OOV>', CAST(NULL AS BIGINT), CAST(1 AS BIGINT)"""

ORACLE["x3_long_words"] = with_(CLEANED_TEXTS, _TOKENS.replace("FROM cleaned)", "FROM (SELECT doc_id, replace(text, ' ', '') || ' ' || text AS text FROM cleaned) c)")) + """
SELECT md5(word) AS word_md5, length(word) AS chars, count FROM vocab WHERE length(word) > 1000"""

_SEQS = """ids AS (SELECT t.doc_id, t.pos, coalesce(v.index, 1) AS tok FROM toks t
        LEFT JOIN vocab v ON t.word = v.word AND v.index < 15000),
seqs AS (SELECT c.doc_id, list(i.tok ORDER BY i.pos) FILTER (WHERE i.tok IS NOT NULL) AS seq
         FROM cleaned c LEFT JOIN ids i ON c.doc_id = i.doc_id GROUP BY c.doc_id)"""

ORACLE["x4_to_sequences"] = with_(CLEANED_TEXTS, _TOKENS, _SEQS) + """
SELECT doc_id, coalesce(array_to_string(seq, ' '), '') AS seq_text FROM seqs"""

ORACLE["x5_pad_sequences"] = with_(CLEANED_TEXTS, _TOKENS, _SEQS) + """
SELECT doc_id, array_to_string(list_resize(coalesce(seq, []), 100, 0), ' ') AS seq_text FROM seqs"""


# --- M: exact model pieces -----------------------------------------------------------------
_P = 2147483647


def mix_hash_sql(cols: list[str], seed: int = 42) -> str:
    h = f"CAST({seed % _P} AS BIGINT)"
    for c in cols:
        h = f"((({h}) * 1000003 + ({c} % {_P})) % {_P})"
        h = f"(({h}) * 48271 % {_P})"
    return f"(({h}) * 69621 % {_P})"


ORACLE["m1_split"] = with_(SALES) + f""",
h AS (SELECT {KEYS}, {mix_hash_sql(KEYS.split(', '))} AS h FROM sales),
n AS (SELECT CAST(ceil(CAST(0.2 AS DOUBLE) * count(*)) AS BIGINT) AS nt FROM sales)
SELECT {KEYS}, CAST(row_number() OVER (ORDER BY h, {KEYS}) <= nt AS INTEGER) AS is_test FROM h, n"""

ORACLE["m2_stratified_split"] = with_(_LABELLED) + f""",
h AS (SELECT doc_id, label, {mix_hash_sql(['doc_id'])} AS h FROM cleaned)
SELECT doc_id, label,
       CAST(row_number() OVER (PARTITION BY label ORDER BY h, doc_id)
            <= ceil(CAST(0.2 AS DOUBLE) * count(*) OVER (PARTITION BY label)) AS INTEGER) AS is_test
FROM h"""

ORACLE["m3_prepare_xy"] = with_(SALES, DIRTY) + f""",
med AS (SELECT quantile_cont(unit_missing, 0.5) AS m FROM dirty)
SELECT {KEYS}, coalesce(CAST(unit_missing AS DOUBLE), med.m) AS unit_missing, CAST(discount_pct AS DOUBLE) AS discount_pct,
""" + ",\n".join(
    f"""       CAST(CAST(delivery = '{v}' AS INTEGER) AS DOUBLE) AS "delivery_{v}\""""
    for v in ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
) + ", sell\nFROM dirty, med"

ORACLE["m4b_fit_linear"] = with_(SALES) + """
SELECT round(regr_slope(sell, unit), 6) AS slope, round(regr_intercept(sell, unit), 6) AS intercept,
       round(regr_r2(sell, unit), 6) AS r2, CAST(regr_count(sell, unit) AS BIGINT) AS n FROM sales"""

def _two_feature_fit(target: str, f1: str, f2: str, where: str, alpha: str = "0") -> str:
    """Least squares (with an L2 penalty) of two features in closed form on the hash split's training rows."""
    return f"""d AS (SELECT {KEYS}, CAST({f1} AS DOUBLE) AS x, CAST({f2} AS DOUBLE) AS z, CAST({target} AS DOUBLE) AS y,
      {mix_hash_sql(KEYS.split(', '))} AS h FROM filtered WHERE {where}),
sp AS (SELECT *, row_number() OVER (ORDER BY h, {KEYS}) <= ceil(CAST(0.2 AS DOUBLE) * count(*) OVER ()) AS is_test FROM d),
tr AS (SELECT * FROM sp WHERE NOT is_test),
mo AS (SELECT count(*) AS n, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, count(*) * var_pop(x) + {alpha} AS sxx, count(*) * var_pop(z) + {alpha} AS szz,
              count(*) * covar_pop(x, z) AS sxz, count(*) * covar_pop(x, y) AS sxy, count(*) * covar_pop(z, y) AS szy FROM tr),
co AS (SELECT *, (szz * sxy - sxz * szy) / (sxx * szz - sxz * sxz) AS b1, (sxx * szy - sxz * sxy) / (sxx * szz - sxz * sxz) AS b2 FROM mo),
fit AS (SELECT *, my - b1 * mx - b2 * mz AS b0 FROM co)"""


ORACLE["m4_linear_coefficients"] = with_(*BASE, _two_feature_fit("sell", "unit", "sell_price", "unit IS NOT NULL AND sell_price IS NOT NULL AND sell IS NOT NULL")) + """
SELECT round(any_value(b0), 2) AS intercept, round(any_value(b1), 3) AS unit, round(any_value(b2), 3) AS sell_price,
       round(1 - sum((y - b0 - b1 * x - b2 * z) ** 2) / (var_pop(y) * count(*)), 6) AS r2,
       round(sqrt(avg((y - b0 - b1 * x - b2 * z) ** 2)), 2) AS rmse, count(*) AS n
FROM sp, fit WHERE is_test"""

ORACLE["m7b_ridge_classifier"] = with_(*BASE, _two_feature_fit("CASE WHEN discount_pct >= 8.5 THEN 1 ELSE -1 END", "unit", "age", "unit IS NOT NULL AND age IS NOT NULL", "1000")) + """
SELECT round(any_value(b1), 6) AS unit, round(any_value(b2), 6) AS age, round(any_value(b0), 6) AS intercept,
       round(avg(CASE WHEN (b0 + b1 * x + b2 * z > 0) = (y > 0) THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM sp, fit WHERE is_test"""

def _boosted(label: str, x: str, z: str, bins: int, depth: int, trees: int, classify: bool, step: float = 0.3, penalty: float = 1.0) -> str:
    """Second-order boosting of two features written out tree by tree and level by level."""
    cut = lambda c: "list_sort(list_distinct([" + ", ".join(f"quantile_cont({c}, CAST({i} AS DOUBLE) / {bins})" for i in range(1, bins)) + "]))"
    base = "ln(avg(y) / (1 - avg(y)))" if classify else "avg(y)"
    parts = [f"src AS (SELECT CAST({x} AS DOUBLE) AS x, CAST({z} AS DOUBLE) AS z, CAST({label} AS DOUBLE) AS y FROM filtered WHERE {label} IS NOT NULL)",
             f"cuts AS (SELECT {cut('x')} AS cx, {cut('z')} AS cz, {base} AS base FROM src)",
             "m0 AS (SELECT len(list_filter(cx, lambda c: c < x)) AS bx, len(list_filter(cz, lambda c: c < z)) AS bz, y, base AS m FROM src, cuts)"]
    out = []
    for t in range(trees):
        p = "1 / (1 + exp(-m))"
        g, h = (f"{p} - y", f"({p}) * (1 - {p})") if classify else ("m - y", "CAST(1 AS DOUBLE)")
        parts.append(f"n{t}_0 AS (SELECT *, {g} AS g, {h} AS h, CAST(1 AS INTEGER) AS node, TRUE AS live FROM m{t})")
        for d in range(depth):
            parts.append(f"""s{t}_{d} AS (
  SELECT *, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl, sum(g) OVER a AS ga, sum(h) OVER a AS ha, sum(n) OVER a AS na
  FROM (SELECT node, 0 AS f, bx AS bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM n{t}_{d} WHERE live GROUP BY ALL
        UNION ALL SELECT node, 1, bz, sum(g), sum(h), count(*) FROM n{t}_{d} WHERE live GROUP BY ALL) u
  WINDOW w AS (PARTITION BY node, f ORDER BY bin), a AS (PARTITION BY node, f)),
c{t}_{d} AS (SELECT *, gl * gl / (hl + {penalty}) + (ga - gl) ** 2 / (ha - hl + {penalty}) - ga * ga / (ha + {penalty}) AS gain
             FROM s{t}_{d} WHERE na > nl AND hl >= 1 AND ha - hl >= 1),
b{t}_{d} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, bin) AS r FROM c{t}_{d} WHERE gain > 0) q WHERE r = 1),
n{t}_{d + 1} AS (
  SELECT o.* REPLACE (CASE WHEN o.live AND b.node IS NOT NULL THEN 2 * o.node + CAST(CASE b.f WHEN 0 THEN o.bx ELSE o.bz END > b.bin AS INTEGER) ELSE o.node END AS node,
                      o.live AND b.node IS NOT NULL AS live)
  FROM n{t}_{d} o LEFT JOIN b{t}_{d} b ON o.node = b.node)""")
            out.append(f"""SELECT CAST({t} AS INTEGER) AS tree, node, CASE f WHEN 0 THEN '{x}' ELSE '{z}' END AS feature,
       round(CASE f WHEN 0 THEN cx[CAST(bin AS INTEGER) + 1] ELSE cz[CAST(bin AS INTEGER) + 1] END, 6) AS cut, round(ln(gain), 5) AS log_gain, CAST(NULL AS DOUBLE) AS value, CAST(na AS BIGINT) AS rows
FROM b{t}_{d}, cuts""")
        parts.append(f"v{t} AS (SELECT node, -sum(g) / (sum(h) + {penalty}) * {step} AS v, count(*) AS n FROM n{t}_{depth} GROUP BY node)")
        parts.append(f"m{t + 1} AS (SELECT bx, bz, y, m + v AS m FROM n{t}_{depth} JOIN v{t} USING (node))")
        out.append(f"SELECT {t}, node, NULL, NULL, NULL, round(v, 4), n FROM v{t}")
    return ",\n".join(parts) + "\n" + "\nUNION ALL ".join(out)


ORACLE["m4_boosted_trees"] = with_(*BASE, _boosted("sell", "unit", "sell_price", 8, 3, 2, False))
ORACLE["m5_boosted_trees"] = with_(*BASE, _boosted("repeated_customer_flag", "discount_pct", "age", 6, 2, 2, True))

_COMPLETE = "unit IS NOT NULL AND sell_price IS NOT NULL AND age IS NOT NULL AND sell IS NOT NULL"
ORACLE["m13_linear_board"] = with_(*BASE) + " UNION ALL ".join(
    f"""SELECT * FROM (WITH {_two_feature_fit("sell", "unit", f2, _COMPLETE)}
SELECT '{name}' AS model, round(1 - sum((y - b0 - b1 * x - b2 * z) ** 2) / (var_pop(y) * count(*)), 6) AS r2,
       round(sqrt(avg((y - b0 - b1 * x - b2 * z) ** 2)), 2) AS rmse FROM sp, fit WHERE is_test)"""
    for name, f2 in (("price", "sell_price"), ("age", "age")))

ORACLE["m15_score_sell_profit"] = with_(*BASE) + " UNION ALL ".join(
    f"""SELECT * FROM (WITH {_two_feature_fit(t, a, b, f"{a} IS NOT NULL AND {b} IS NOT NULL AND {t} IS NOT NULL")}
SELECT '{t}' AS target, round(i1, 2) AS input_1, round(i2, 2) AS input_2, round(b0 + b1 * i1 + b2 * i2, 1) AS expected
FROM fit, (SELECT quantile_cont(x, 0.5) AS i1, quantile_cont(z, 0.5) AS i2 FROM tr) m)"""
    for t, a, b in (("sell", "unit", "sell_price"), ("profit", "sell", "unit")))

#: The penalised logistic fit of two features by Newton steps; the gradient is 0 after a few of them.
_RETENTION = f"""d AS (SELECT {KEYS}, CAST(sell AS DOUBLE) AS x, CAST(unit AS DOUBLE) AS z, CAST(repeated_customer_flag AS DOUBLE) AS y,
      {mix_hash_sql(KEYS.split(', '))} AS h FROM filtered),
sp AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY h, {KEYS}) <= ceil(CAST(0.2 AS DOUBLE) * count(*) OVER (PARTITION BY y)) AS is_test FROM d),
tr AS (SELECT x, z, y FROM sp WHERE NOT is_test),
it AS (
  SELECT 0 AS k, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS u, CAST(0 AS DOUBLE) AS v
  UNION ALL
  SELECT k + 1, b - (g0 * (h11 * h22 - h12 * h12) - g1 * (h01 * h22 - h02 * h12) + g2 * (h01 * h12 - h02 * h11)) / det,
         u - (h00 * (g1 * h22 - g2 * h12) - h01 * (g0 * h22 - g2 * h02) + h02 * (g0 * h12 - g1 * h02)) / det,
         v - (h00 * (h11 * g2 - h12 * g1) - h01 * (h01 * g2 - h02 * g1) + g0 * (h01 * h12 - h02 * h11)) / det
  FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h02 * h12) + h02 * (h01 * h12 - h02 * h11) AS det FROM (
    SELECT k, b, u, v, sum(p - y) AS g0, sum((p - y) * x) + u AS g1, sum((p - y) * z) + v AS g2, sum(s) AS h00, sum(s * x) AS h01, sum(s * z) AS h02,
           sum(s * x * x) + 1 AS h11, sum(s * x * z) AS h12, sum(s * z * z) + 1 AS h22
    FROM (SELECT *, p * (1 - p) AS s FROM (SELECT it.*, tr.*, 1 / (1 + exp(-(b + u * x + v * z))) AS p FROM it, tr WHERE k < 10) a) c
    GROUP BY k, b, u, v) e) f),
fit AS (SELECT * FROM it WHERE k = 10)"""
ORACLE["m5_logistic_coefficients"] = "WITH RECURSIVE " + with_(*BASE, _RETENTION)[5:] + """
SELECT round(any_value(b), 3) AS intercept, round(any_value(u) * 1000, 4) AS sell_thousands, round(any_value(v), 4) AS unit,
       round(avg(CASE WHEN (b + u * x + v * z > 0) = (y > 0) THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       round(avg(1 / (1 + exp(-(b + u * x + v * z)))), 4) AS mean_probability, count(*) AS n
FROM sp, fit WHERE is_test"""
ORACLE["m15_score_retention"] = "WITH RECURSIVE " + with_(*BASE, _RETENTION)[5:] + """,
q AS (SELECT quantile_cont(x, 0.5) AS x, quantile_cont(z, 0.5) AS z FROM tr)
SELECT round(x, 2) AS sell, z AS unit, CASE WHEN b + u * x + v * z > 0 THEN 1.0 ELSE 0.0 END AS prediction,
       round(1 / (1 + exp(-(b + u * x + v * z))), 4) AS probability_1,
       CASE WHEN b + u * x + v * z > 0 THEN 'LIKELY TO RETURN' ELSE 'NOT LIKELY TO RETURN' END AS outcome
FROM q, fit"""

ORACLE["m9_segment_checks"] = with_(*BASE) + """
SELECT count(*) AS rows, CAST(3 AS BIGINT) AS clusters, CAST(0 AS BIGINT) AS misplaced, 0.0 AS centre_gap FROM filtered
WHERE age IS NOT NULL AND unit IS NOT NULL AND sell IS NOT NULL AND profit IS NOT NULL"""

ORACLE["t4_normal_equations"] = with_(*BASE) + """
SELECT category, CAST(datediff('month', min(order_date), max(order_date)) + 1 AS BIGINT) AS periods, round(sum(sell), 0) AS total,
       0.0 AS level, 0.0 AS trend, 0.0 AS sin_1, 0.0 AS cos_1, 0.0 AS sin_2, 0.0 AS cos_2, 0.0 AS sin_3, 0.0 AS cos_3
FROM filtered GROUP BY category"""

def _grid_search(series: str, keys: str) -> str:
    """The two grid searches for all series of ``s`` at once: every triple walks all months side by side."""
    grid = "(SELECT CAST(0.05 + 0.1 * i AS DOUBLE) AS {0} FROM range(10) r(i))"
    fine = "(SELECT {k}, round({0}0 + o * CAST(0.01 AS DOUBLE), 4) AS {0} FROM best1, range(-5, 6) r(o))"

    def walk(name: str, trials: str) -> str:
        up = "a * (y[t + 1] - se[t % 12 + 1]) + (1 - a) * (l + tr)"
        return f"""{name} AS (
  SELECT {keys}, a, b, g, 12 AS t, l0 AS l, b0 AS tr, list_transform(y[1:12], lambda x: x - l0) AS se, CAST(0 AS DOUBLE) AS sse, y, n, last_pe
  FROM i2 JOIN {trials} USING ({keys})
  UNION ALL
  SELECT {keys}, a, b, g, t + 1, {up}, b * (({up}) - l) + (1 - b) * tr,
         list_transform(range(12), lambda i: CASE WHEN i = t % 12 THEN g * (y[t + 1] - l - tr) + (1 - g) * se[t % 12 + 1] ELSE se[i + 1] END),
         sse + (y[t + 1] - (l + tr + se[t % 12 + 1])) * (y[t + 1] - (l + tr + se[t % 12 + 1])), y, n, last_pe
  FROM {name} WHERE t < n)"""

    first = f"(SELECT {keys}, round(a, 2) AS a, round(b, 2) AS b, round(g, 2) AS g FROM i2, {grid.format('a')}, {grid.format('b')}, {grid.format('g')})"
    second = " JOIN ".join(fine.format(c, k=keys) + f" f{c}" + (f" USING ({keys})" if c != "a" else "") for c in "abg")
    return f"""{series},
s2 AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY ps) - 1 AS idx, period_end, v FROM s),
ys AS (SELECT {keys}, list(v ORDER BY idx) AS y, CAST(count(*) AS INTEGER) AS n, max(period_end) AS last_pe FROM s2 GROUP BY {keys}),
i1 AS (SELECT *, list_reduce(list_prepend(CAST(0.0 AS DOUBLE), y[1:12]), lambda a, x: a + x) AS s1,
              list_reduce(list_prepend(CAST(0.0 AS DOUBLE), y[13:24]), lambda a, x: a + x) AS s2 FROM ys WHERE n >= 24),
i2 AS (SELECT *, s1 / 12 AS l0, (s2 - s1) / 12 / 12 AS b0 FROM i1),
{walk('r1', first + ' q')},
best1 AS (SELECT {keys}, arg_min(a, sse) AS a0, arg_min(b, sse) AS b0, arg_min(g, sse) AS g0 FROM r1 WHERE t = n GROUP BY {keys}),
near AS (SELECT {keys}, a, b, g FROM {second} WHERE a > 0 AND a < 1 AND b > 0 AND b < 1 AND g > 0 AND g < 1),
{walk('r2', 'near')},
fin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY sse) AS rk FROM r2 WHERE t = n) z WHERE rk = 1)"""


ORACLE["t3_holt_winters"] = "WITH RECURSIVE " + with_(*BASE, "one AS (SELECT 1 AS k, * FROM filtered)", _grid_search(_calendar_sql(
    "one", "order_date", "sell", "CAST(date_trunc('month', order_date) AS DATE)", "INTERVAL 1 MONTH", "last_day(cal.ps)", keys="k"), "k"))[5:] + """
SELECT CAST(last_day(last_pe + to_months(CAST(q AS INTEGER))) AS DATE) AS period_end, CAST(NULL AS DOUBLE) AS actual,
       round(l + q * tr + se[(n - 1 + q) % 12 + 1], 0) AS fitted FROM fin, range(1, 7) AS qq(q)"""
ORACLE["t3_holt_winters_by_category"] = "WITH RECURSIVE " + with_(*BASE, _grid_search(_calendar_sql(
    "filtered", "order_date", "sell", "CAST(date_trunc('month', order_date) AS DATE)", "INTERVAL 1 MONTH", "last_day(cal.ps)", keys="category"), "category"))[5:] + """
SELECT category, round(a, 4) AS alpha, round(b, 4) AS beta, round(g, 4) AS gamma, round(ln(sse), 6) AS log_sse FROM fin"""

ORACLE["t5_history_guard"] = with_(*BASE, monthly_series_sql("filtered", "sell", "sell")) + "SELECT period_end, round(sell, 0) AS sell FROM s"

_MONTHS = "CAST(datediff('month', min(order_date), max(order_date)) + 1 AS BIGINT) AS periods, round(sum(sell), 0) AS total, CAST(6 AS BIGINT) AS forecasts"
ORACLE["t3_fit_checks"] = with_(*BASE) + f"""
SELECT category, {_MONTHS}, 0.0 AS replay_gap, CAST(0 AS BIGINT) AS better_nearby FROM filtered GROUP BY category"""

ORACLE["t4_changepoint_checks"] = with_(*BASE) + f"""
SELECT category, {_MONTHS}, CAST(0 AS BIGINT) AS outside, 0.0 AS level, 0.0 AS slope, 0.0 AS sin_1, 0.0 AS cos_3, 0.0 AS subgradient_gap
FROM filtered GROUP BY category"""

ORACLE["m8_hard_vote"] = with_(SALES) + f""",
v AS (SELECT {KEYS}, unit, sell, CAST(discount_pct >= 5 AS INTEGER) + CAST(unit >= 25 AS INTEGER)
                      + CAST(sell_price >= 1500 AS INTEGER) + CAST(age >= 48 AS INTEGER) AS ones FROM sales)
SELECT {KEYS}, unit, sell, CASE WHEN ones > 4 - ones THEN 1 ELSE 0 END AS prediction FROM v"""

ORACLE["m10_regression_metrics"] = with_(SALES) + """,
m AS (SELECT avg(sell) AS mu FROM sales)
SELECT round(1.0 - sum((sell - unit * sell_price) * (sell - unit * sell_price)) / sum(pow(sell - mu, 2)), 6) AS r2,
       round(sqrt(avg((sell - unit * sell_price) * (sell - unit * sell_price))), 6) AS rmse,
       count(*) AS n
FROM sales, m"""

RULE_PREDS = """preds AS (SELECT repeated_customer_flag AS label, CAST(discount_pct >= 5 AS INTEGER) AS prediction,
                  discount_pct / 10 AS score FROM filtered)"""

ORACLE["m11_classification_metrics"] = with_(*BASE, RULE_PREDS) + """,
cls AS (SELECT label AS c FROM preds UNION SELECT prediction FROM preds),
pc AS (SELECT c, count(*) FILTER (WHERE p.label = c) AS support,
              count(*) FILTER (WHERE p.prediction = c) AS predicted,
              count(*) FILTER (WHERE p.label = c AND p.prediction = c) AS tp
       FROM cls, preds p GROUP BY c),
m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS pr,
                CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rc FROM pc),
f AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1c FROM m)
SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(sum(pr * support) / sum(support), 6) AS precision,
       round(sum(rc * support) / sum(support), 6) AS recall, round(sum(f1c * support) / sum(support), 6) AS f1 FROM f"""

ORACLE["m11b_binary_metrics"] = with_(*BASE, RULE_PREDS) + """,
c AS (SELECT count(*) FILTER (WHERE score > 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE score > 0.5 AND label <> 1) AS fp,
             count(*) FILTER (WHERE score <= 0.5 AND label = 1) AS fn, count(*) AS n,
             count(*) FILTER (WHERE CAST(score > 0.5 AS INTEGER) = CAST(label = 1 AS INTEGER)) AS hits FROM preds),
m AS (SELECT hits / n AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS pr,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS rc FROM c)
SELECT round(accuracy, 6) AS accuracy, round(pr, 6) AS precision, round(rc, 6) AS recall,
       round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END, 6) AS f1 FROM m"""

ORACLE["m12_confusion"] = with_(*BASE, RULE_PREDS) + """
SELECT label, count(*) FILTER (WHERE prediction = 0) AS pred_0, count(*) FILTER (WHERE prediction = 1) AS pred_1
FROM preds GROUP BY label"""

ORACLE["m16_feature_medians"] = with_(SALES) + """
SELECT round(quantile_cont(unit, 0.5), 6) AS unit, round(quantile_cont(sell_price, 0.5), 6) AS sell_price,
       round(quantile_cont(age, 0.5), 6) AS age FROM sales"""


# --- T3: Holt-Winters with fixed smoothing (recursive CTE) ----------------------------------------
ORACLE["t3_holt_winters_fixed"] = "WITH RECURSIVE " + with_(*BASE, monthly_series_sql("filtered", "sell", "v"))[5:] + """,
s2 AS (SELECT row_number() OVER (ORDER BY ps) - 1 AS idx, period_end, v FROM s),
ys AS (SELECT list(v ORDER BY idx) AS y, CAST(count(*) AS INTEGER) AS n, max(period_end) AS last_pe FROM s2),
i1 AS (SELECT *, list_reduce(list_prepend(CAST(0.0 AS DOUBLE), y[1:12]), lambda a, x: a + x) AS s1,
              list_reduce(list_prepend(CAST(0.0 AS DOUBLE), y[13:24]), lambda a, x: a + x) AS s2 FROM ys),
i2 AS (SELECT *, s1 / 12 AS l0, (s2 - s1) / 12 / 12 AS b0 FROM i1),
r AS (
  SELECT 12 AS t, l0 AS l, b0 AS b, list_transform(y[1:12], lambda x: x - l0) AS se,
         CAST(NULL AS DOUBLE) AS fit, y, n, last_pe FROM i2
  UNION ALL
  SELECT t + 1,
         CAST(0.3 AS DOUBLE) * (y[t + 1] - se[t % 12 + 1]) + CAST(0.7 AS DOUBLE) * (l + b),
         CAST(0.1 AS DOUBLE) * ((CAST(0.3 AS DOUBLE) * (y[t + 1] - se[t % 12 + 1]) + CAST(0.7 AS DOUBLE) * (l + b)) - l)
           + CAST(0.9 AS DOUBLE) * b,
         list_transform(range(12), lambda i: CASE WHEN i = t % 12
             THEN CAST(0.2 AS DOUBLE) * (y[t + 1] - l - b) + CAST(0.8 AS DOUBLE) * se[t % 12 + 1]
             ELSE se[i + 1] END),
         l + b + se[t % 12 + 1], y, n, last_pe
  FROM r WHERE t < n),
fitted AS (SELECT CAST(last_day(last_pe + to_months(CAST(t - n AS INTEGER))) AS DATE) AS period_end,
                  y[t] AS actual, fit AS fitted FROM r WHERE fit IS NOT NULL),
fin AS (SELECT * FROM r WHERE t = n),
future AS (SELECT CAST(last_day(last_pe + to_months(CAST(k AS INTEGER))) AS DATE) AS period_end,
                  CAST(NULL AS DOUBLE) AS actual, l + k * b + se[(n - 1 + k) % 12 + 1] AS fitted
           FROM fin, range(1, 7) AS kk(k))
SELECT period_end, round(actual, 0) AS actual, round(fitted, 0) AS fitted FROM fitted
UNION ALL
SELECT period_end, actual, round(fitted, 0) FROM future"""


# --- M6: brute-force k nearest neighbours on the small embeddings table ---------------------------
ORACLE["m6_knn_regress"] = with_(SALES) + f""",
c AS (SELECT customer, CAST(count(*) AS DOUBLE) AS lines, CAST(sum(unit) AS DOUBLE) AS units, sum(sell) AS revenue FROM sales GROUP BY customer),
e AS (SELECT *, {mix_hash_sql(['customer'])} AS h FROM c),
sp AS (SELECT *, row_number() OVER (ORDER BY h, customer) <= ceil(CAST(0.2 AS DOUBLE) * count(*) OVER ()) AS is_test FROM e),
pairs AS (SELECT q.customer AS qid, t.customer AS tid, t.revenue, (q.lines - t.lines) ** 2 + (q.units - t.units) ** 2 AS d2
          FROM sp q, sp t WHERE q.is_test AND NOT t.is_test),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, tid) AS rn FROM pairs) x WHERE rn <= 5)
SELECT qid AS customer, round(avg(revenue), 0) AS prediction FROM top GROUP BY qid"""

ORACLE["m6_knn_classify"] = f"""WITH e AS (SELECT vec_id, embedding, label, {mix_hash_sql(['vec_id'])} AS h FROM embeddings),
sp AS (SELECT *, row_number() OVER (ORDER BY h, vec_id) <= ceil(CAST(0.2 AS DOUBLE) * count(*) OVER ()) AS is_test FROM e),
pairs AS (SELECT q.vec_id AS qid, t.vec_id AS tid, t.label,
                 list_sum(list_transform(list_zip(q.embedding, t.embedding),
                          lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))) AS d2
          FROM sp q, sp t WHERE q.is_test AND NOT t.is_test),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, tid) AS rn FROM pairs) x WHERE rn <= 5),
votes AS (SELECT qid, label, count(*) AS c FROM top GROUP BY ALL)
SELECT qid AS vec_id, CAST(label AS INTEGER) AS prediction
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c DESC, label) AS r FROM votes) y WHERE r = 1"""


# --- S: round trips through written files equal the view -----------------------------------------
ORACLE["s1_read_yearly"] = with_(SALES) + f"SELECT {KEYS}, book, sell, year FROM sales"
ORACLE["s1_sales_sheets"] = with_(SALES, """sheet AS (
  SELECT *, 'He said "hi", ' || book || chr(10) || 'vol. 2' AS title FROM sales),
f AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, title AS folder_book,
             CASE WHEN year(order_date) >= 1996 THEN CAST(customer AS VARCHAR) END AS folder_customer FROM sheet)""") + f"""
SELECT {KEYS}, CAST(order_date AS DATE) AS order_date, title AS book, sell,
       CAST(year(order_date) AS INTEGER) AS year,
       {FLAG_SQL} AS repeated_customer_flag, folder_book, folder_customer
FROM sheet JOIN f USING (l_orderkey, l_linenumber, l_partkey, l_suppkey)"""

ORACLE["s2_read_all_merged"] = with_(SALES) + f"SELECT {KEYS}, sell, year, 1 AS from_file FROM sales"

_NUMERIC_SALES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "customer", "age", "unit", "sell_price",
                  "buying_price", "sell", "cost", "discount_pct", "review", "year"]
ORACLE["p23_numeric_cols"] = with_(SALES) + "\n UNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count({c}) AS non_null FROM sales" for c in _NUMERIC_SALES)
