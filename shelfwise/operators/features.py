"""Model inputs (M1-M3, M16, M4b): splits, feature assembly, medians, one-feature fit.

Splits are exact and repeatable: rows are ordered by a hash of their key (and
the seed), and the first ceil(frac * n) rows of each stratum form the test
part. The cut is found as an exact order statistic of the hash (no sort or
numbering of the whole input); no ``randomSplit`` (its result moves when the
input is re-partitioned) and no one-partition window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.operators.clean import numeric_cols, one_hot
from shelfwise.operators.stats import exact_medians, order_statistics
from shelfwise.session import drop_shared, shared_table

PRIME = 2147483647  # 2^31 - 1


def mix_hash(cols: list[str], seed: int = 42) -> Column:
    """Integer-key hash in plain modular arithmetic (the same value in any SQL
    engine), for splits that must be checkable outside Spark."""
    h = F.lit(seed % PRIME).cast("long")
    for c in cols:
        # a missing key part counts as a value of its own, so its row still gets a hash
        h = (h * 1000003 + F.coalesce(F.pmod(F.col(c).cast("long"), F.lit(PRIME)), F.lit(PRIME - 1).cast("long"))) % PRIME
        h = (h * 48271) % PRIME
    return (h * 69621) % PRIME


def split_order(cols: list[str], seed: int = 42, sql_hash: bool = False) -> Column:
    return mix_hash(cols, seed) if sql_hash else F.xxhash64(*[F.col(c) for c in cols], F.lit(seed))


def _first_by_hash(df: DataFrame, key: list[str], n_take: int, name: str) -> DataFrame:
    """Flag the ``n_take`` rows that come first in (``_h``, key) order, without
    sorting or numbering the whole input: the exact ``n_take``-th smallest hash
    is an order statistic (sketch bracket, bounded collect), which also gives
    the rows below it and the rows tied on it. Usually one row holds that hash
    and the flag is ``_h <= cut``; otherwise only the tied rows (one hash
    value's collision set) are ranked by key."""
    if n_take <= 0:
        return df.withColumn(name, F.lit(0)).drop("_h")
    ((h_star, below, ties),) = order_statistics(df, "_h", [n_take - 1], with_counts=True)
    take_tied = n_take - below
    if take_tied >= ties:
        return df.withColumn(name, (F.col("_h") <= F.lit(h_star)).cast("int")).drop("_h")
    # rows tied on one hash value are one key's copies: any of them serve alike, so each distinct
    # key of the tie gets a quota, and rows beyond it stay out
    tied = df.where(F.col("_h") == F.lit(h_star)).groupBy(*key).agg(F.count(F.lit(1)).alias("_copies"))
    w = Window.orderBy(*[F.col(k) for k in key])
    before = F.sum("_copies").over(w.rowsBetween(Window.unboundedPreceding, -1))
    quota = tied.withColumn("_quota", F.lit(take_tied) - F.coalesce(before, F.lit(0))).where("_quota > 0").drop("_copies")
    rest = [c for c in df.columns if c not in key and c != "_h"]
    mine = df.where(F.col("_h") == F.lit(h_star))
    for k in key:
        quota = quota.withColumnRenamed(k, f"_q_{k}")
    same = None
    for k in key:
        term = F.col(k).eqNullSafe(F.col(f"_q_{k}"))
        same = term if same is None else same & term
    mine = mine.join(quota, same, "left")
    order = Window.partitionBy(*key).orderBy(*[F.col(c) for c in rest]) if rest else Window.partitionBy(*key).orderBy(F.lit(1))
    mine = mine.withColumn(name, (F.row_number().over(order) <= F.coalesce("_quota", F.lit(0))).cast("int"))
    others = df.where(F.col("_h") != F.lit(h_star)).withColumn(name, (F.col("_h") < F.lit(h_star)).cast("int"))
    cols = [c for c in df.columns if c != "_h"]
    return others.select(*cols, name).unionByName(mine.select(*cols, name))


def split(df: DataFrame, key: list[str], test_frac: float = 0.2, seed: int = 42, sql_hash: bool = False,
          name: str = "is_test") -> DataFrame:
    """M1: exactly ceil(test_frac * n) rows flagged as test: the first ones in
    (key hash, key) order. Repeatable under any partitioning."""
    n = df.count()
    return _first_by_hash(df.withColumn("_h", split_order(key, seed, sql_hash)), key, math.ceil(test_frac * n), name)


def _hash_digits(h: Column, bits: int) -> list[Column]:
    """Growing prefixes of the hash in its own order, 16 bits at a time: equal prefixes sort by the next one."""
    if bits == 64:
        h = h.bitwiseXOR(F.lit(-(1 << 63)))  # signed order as unsigned
    return [F.shiftrightunsigned(h, s) for s in range((bits - 1) // 16 * 16, -1, -16)]


def class_cuts(df: DataFrame, label: str, h: str, shares: list[float], bits: int = 64) -> DataFrame:
    """``(label_, share_, cut_, quota_, ties_)`` for each class and number of a share: the rows with a hash below ``cut_``
    and ``quota_`` of the ``ties_`` rows at it are the first ceil(share * class size) in hash order.

    A grouped radix selection: counts by (class, prefix) show, for all classes and shares together, which
    prefix holds a cut; only rows with it are counted by the next 16 bits. Counts are summed in the
    tasks first, so a class of any size is no burden, and only labels and hashes move.
    """
    rows = df.select(F.col(label).alias("label_"), F.col(h).alias("h_"))
    state = None
    for digit in _hash_digits(F.col("h_"), bits):
        counts = rows.groupBy("label_", digit.alias("p_")).agg(F.count(F.lit(1)).alias("n_"), F.min("h_").alias("least_"))
        counts = counts.withColumn("before_", F.shiftrightunsigned("p_", 16) if state is not None else F.lit(0).cast("long"))
        group = Window.partitionBy("label_", "before_")
        upto = F.sum("n_").over(group.orderBy("p_").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        counts = counts.withColumn("upto_", upto)
        if state is None:
            wanted = F.array(*[F.struct(F.lit(i).alias("share_"), F.ceil(F.lit(x) * F.col("all_")).alias("need_")) for i, x in enumerate(shares)])
            counts = counts.withColumn("all_", F.sum("n_").over(group)).select("*", F.inline(wanted))
        else:
            of = state.select(F.col("label_").alias("of_"), F.col("p_").alias("prefix_"), "share_", "need_")
            counts = counts.join(of, F.col("label_").eqNullSafe(F.col("of_")) & (F.col("before_") == F.col("prefix_")))
        here = (F.col("upto_") >= F.col("need_")) & (F.col("upto_") - F.col("n_") < F.col("need_"))
        held = counts.where(here).select("label_", "share_", "p_", "n_", "least_", (F.col("need_") - F.col("upto_") + F.col("n_")).alias("need_"))
        state = shared_table(held)
        mine = state.select(F.col("label_").alias("of_"), F.col("p_").alias("prefix_"))
        inside = rows.join(mine, F.col("label_").eqNullSafe(F.col("of_")) & (digit == F.col("prefix_")), "left_semi")
        rows, spent = shared_table(inside), rows  # from the second round on a 65,536th of the rows, or those that share a hash
        drop_shared(spent)
    drop_shared(rows)
    return state.select("label_", "share_", F.col("least_").alias("cut_"), F.col("need_").alias("quota_"), F.col("n_").alias("ties_"))


def stratified_folds(df: DataFrame, label: str, key: list[str], folds: int = 5, seed: int = 42, sql_hash: bool = False,
                     name: str = "fold") -> DataFrame:
    """``df`` with a fold number: each class dealt to ``folds`` parts of equal size (to a row) in hash order, without a
    sort; copies of one key share a fold."""
    hashed = df.withColumn("_h", split_order(key, seed, sql_hash))
    cuts = class_cuts(hashed, label, "_h", [i / folds for i in range(1, folds)], 31 if sql_hash else 64)
    ends = shared_table(cuts.groupBy("label_").agg(F.array_sort(F.collect_list("cut_")).alias("ends_")))
    met = hashed.join(ends, F.col(label).eqNullSafe(F.col("label_")), "left")
    fold = F.size(F.filter(F.coalesce("ends_", F.array().cast("array<long>")), lambda e: e < F.col("_h")))
    return met.withColumn(name, fold).drop("_h", "label_", "ends_")


def stratified_split(df: DataFrame, label: str, key: list[str], test_frac: float = 0.2, seed: int = 42,
                     sql_hash: bool = False, name: str = "is_test") -> DataFrame:
    """M2: per class, exactly ceil(test_frac * class size) rows flagged as test: the first ones in
    (key hash, key) order. A missing label is a class of its own.

    The cuts of all classes are selected together (:func:`class_cuts`), whatever their number; the input is
    not sorted or copied, its rows meet their class's cut in a join that the planner broadcasts
    while the cuts are small. Only rows that tie on a cut and do not all fit are ranked by key.
    """
    hashed = df.withColumn("_h", split_order(key, seed, sql_hash))
    cuts = class_cuts(hashed, label, "_h", [test_frac], 31 if sql_hash else 64).drop("share_")
    met = hashed.join(cuts, F.col(label).eqNullSafe(F.col("label_")), "left")
    short = (F.col("_h") == F.col("cut_")) & (F.col("quota_") < F.col("ties_"))
    flag = F.coalesce((F.col("_h") <= F.col("cut_")).cast("int"), F.lit(0))
    drop = ["_h", "label_", "cut_", "quota_", "ties_"]
    if cuts.where("quota_ < ties_").isEmpty():
        return met.withColumn(name, flag).drop(*drop)
    tied = met.where(short)
    order = Window.partitionBy("label_", "_h").orderBy(*[F.col(k) for k in key])
    tied = tied.withColumn(name, (F.row_number().over(order) <= F.col("quota_")).cast("int"))
    return met.where(~F.coalesce(short, F.lit(False))).withColumn(name, flag).drop(*drop).unionByName(tied.drop(*drop))


def feature_medians(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row holding each column's exact median (default inputs for scoring)."""
    med = exact_medians(df, cols)
    return df.sparkSession.createDataFrame([tuple(float(med[c]) if med[c] is not None else None for c in cols)],
                                           ", ".join(f"`{c}` double" for c in cols))


def prepare_xy(df: DataFrame, target: str, features: list[str] | None = None, keep: list[str] | None = None,
               vector: str | None = "features") -> tuple[DataFrame, list[str]]:
    """M3: X from the numeric columns (or the given ones), text columns one-hot
    encoded with the first level dropped, missing values filled with each
    column's median; y = ``target``. Returns the frame and the feature names."""
    keep = keep or []
    features = features or [c for c in numeric_cols(df) if c != target and c not in keep]
    text_feats = [c for c in features if c not in numeric_cols(df)]
    x = df.select(*keep, *features, target)
    if text_feats:
        x = one_hot(x, text_feats)
    names = [c for c in x.columns if c not in keep and c != target]
    meds = exact_medians(x, names)
    x = x.select(*keep, *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(meds[c])).alias(c) if meds[c] is not None
                          else F.col(f"`{c}`").cast("double").alias(c) for c in names], target)
    if vector:
        from pyspark.ml.feature import VectorAssembler

        x = VectorAssembler(inputCols=names, outputCol=vector, handleInvalid="keep").transform(x)
    return x, names


def fit_linear(df: DataFrame, x: str, y: str) -> DataFrame:
    """M4b (one feature): least-squares slope, intercept and R², one aggregate."""
    return df.agg(
        F.regr_slope(F.col(y), F.col(x)).alias("slope"),
        F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
        F.regr_r2(F.col(y), F.col(x)).alias("r2"),
        F.regr_count(F.col(y), F.col(x)).alias("n"),
    )
