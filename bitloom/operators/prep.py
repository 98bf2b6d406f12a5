"""Preparation of tables and series: profiles, splits, caps, imputation, scaling, drift. All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.plans.order import numbered, ranged
from bitloom.plans.profile import quantiles


def finite(x: Column) -> Column:
    """x, or 0 where it is NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(0.0)).otherwise(x)


def padded(series: Column, length: int) -> Column:
    """A series filled up to the length with its last value (0.0 if it is empty)."""
    last = F.coalesce(F.try_element_at(series, F.lit(-1)), F.lit(0.0))
    return F.concat(series, F.array_repeat(last, F.greatest(F.lit(0), F.lit(length) - F.size(series))))


def decimated(series: Column, most: int = 512) -> Column:
    """A longer series cut to so many points, evenly placed and rounded half to even."""
    n = F.size(series)
    places = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.rint(i * (n - 1) / F.lit(most - 1)).cast("int"))
    return F.when(n > most, F.transform(places, lambda i: F.get(series, i))).otherwise(series)


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once a row (a lambda's free expressions are worked out for every element)."""
    return F.get(F.transform(F.array(value), use), 0)


def normalised(series: Column) -> Column:
    """A series less its mean, over its population deviation (1 where that is 0)."""
    total = lambda a, v: a + v
    mean = F.aggregate(series, F.lit(0.0), total) / F.greatest(F.size(series), F.lit(1))
    centred = _let(mean, lambda m: F.transform(series, lambda v: v - m))
    var = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v * v) / F.greatest(F.size(c), F.lit(1))
    return _let(centred, lambda c: _let(F.sqrt(var(c)), lambda sd: F.transform(c, lambda v: v / F.when(sd == 0, F.lit(1.0)).otherwise(sd))))


def drop_rare(df: DataFrame, label: str, least: int = 2) -> DataFrame:
    """Rows whose class has ``least`` rows or more."""
    common = df.groupBy(F.col(label).alias("__l")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least)
    return df.join(common, F.col(label) == F.col("__l"), "left_semi")


def _lowest(df: DataFrame, label: str, order: list, quota) -> DataFrame:
    """df (with ``__b``, a number that rises with the order) and ``__in``: whether a row is among the first ``quota(n)`` of its class of n.

    Classes are counted by ``__b``; only in the one cell of a class where the quota ends are rows numbered, so no task holds a class."""
    cells = df.groupBy(F.col(label).alias("__l"), "__b").agg(F.count(F.lit(1)).alias("__n"))
    line = Window.partitionBy("__l").orderBy("__b")
    cells = cells.withColumns({"__to": F.sum("__n").over(line), "__k": quota(F.sum("__n").over(Window.partitionBy("__l")))})
    edge = cells.where((F.col("__to") >= F.col("__k")) & (F.col("__to") - F.col("__n") < F.col("__k")))
    edge = edge.select("__l", F.col("__b").alias("__edge"), (F.col("__k") - F.col("__to") + F.col("__n")).alias("__left"))  # a row a class
    place = F.row_number().over(Window.partitionBy(label, "__b").orderBy(*order))
    out = df.withColumn("__at", place).join(edge, F.col(label).eqNullSafe(F.col("__l")), "left")
    inside = (F.col("__b") < F.col("__edge")) | ((F.col("__b") == F.col("__edge")) & (F.col("__at") <= F.col("__left")))
    return out.withColumn("__in", F.coalesce(inside, F.lit(False))).drop("__l", "__edge", "__left", "__at", "__b")


def split(df: DataFrame, label: str, key: str, test: float = 0.3, seed: int = 42) -> DataFrame:
    """df with ``is_test``: of each class the rows with the smallest hashes, ``test`` of them rounded half to even."""
    h = F.xxhash64(F.col(key), F.lit(seed))
    rows = df.withColumn("__b", F.shiftright(h, 54).cast("int"))  # 1024 ranges of hashes
    return _lowest(rows, label, [h, key], lambda n: F.bround(n * F.lit(test))).withColumnRenamed("__in", "is_test")


def stratified_cap(df: DataFrame, label: str, key: str, most: int) -> DataFrame:
    """At most about ``most`` rows, classes in proportion, each with one at least; the smallest keys (numbers or times) stay."""
    n = df.count()
    if n <= most:
        return df
    quota = lambda c: F.greatest(F.lit(1.0), F.bround(F.lit(most) * c / F.lit(n)))
    return _lowest(ranged(df, key), label, [key], quota).where("__in").drop("__in")


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows in order."""
    return df.orderBy(order).limit(n)


def class_numbers(df: DataFrame, label: str, name: str = "y") -> DataFrame:
    """df with the class's place (from 0) among the sorted distinct classes."""
    classes = df.select(F.col(label).alias("__l")).distinct()
    numbered = classes.withColumn(name, (F.row_number().over(Window.orderBy("__l")) - 1).cast("long"))  # a row a class
    return df.join(numbered, F.col(label) == F.col("__l")).drop("__l")


def impute_median(df: DataFrame, features: list[str]) -> DataFrame:
    """Null and non-finite cells as the column's median over finite ones (0 where there is none)."""
    ok = lambda f: F.when(~F.isnan(f) & (F.abs(F.col(f)) != F.lit(float("inf"))), F.col(f))
    m = quantiles(df.select(*(ok(f).alias(f) for f in features)), features, [0.5])
    return df.withColumns({f: F.coalesce(ok(f), F.lit(m[f][0] if m[f] else 0.0)) for f in features})


def winsorised(df: DataFrame, features: list[str], skew: float = 3.0, low: float = 0.005) -> DataFrame:
    """Columns of a skewness beyond the bound clipped to their outer percentiles."""
    s = df.agg(*(F.skewness(f).alias(f) for f in features)).first()
    heavy = [f for f in features if s[f] is not None and abs(s[f]) > skew]
    if not heavy:
        return df
    q = quantiles(df, heavy, [low, 1 - low])
    return df.withColumns({f: F.greatest(F.lit(q[f][0]), F.least(F.lit(q[f][1]), F.col(f))) for f in heavy})


def standardised(df: DataFrame, features: list[str]) -> DataFrame:
    """Columns less their mean over their population deviation (1 where that is 0)."""
    s = df.agg(*(F.avg(f).alias(f"{f}|m") for f in features), *(F.stddev_pop(f).alias(f"{f}|s") for f in features)).first()
    return df.withColumns({f: (F.col(f) - F.lit(s[f"{f}|m"] or 0.0)) / F.lit(s[f"{f}|s"] or 1.0) for f in features})


def drifted(df: DataFrame, order: str, feature: str, slope: float = 2.5) -> DataFrame:
    """The ordered column stretched and shifted more and more: x (1 + slope t) + slope t sd, t from 0 to 1.

    Places come from counts of ranges and a number within each, not from one global window."""
    s = df.agg(F.stddev_pop(feature).alias("s"), F.count(F.lit(1)).alias("n")).first()
    ranked = numbered(df, order)
    t = F.col("__at") / F.lit(float(max(s["n"] - 1, 1)))
    return ranked.withColumn(feature, F.col(feature) * (1 + slope * t) + slope * t * F.lit((s["s"] or 0.0) + 1e-9)).drop("__at")


def bad_cells(df: DataFrame, features: list[str]) -> Column:
    """How many cells of the features are null, NaN or infinite, as an aggregate."""
    bad = [F.count_if(F.col(f).isNull() | F.isnan(F.col(f).cast("double")) | (F.abs(F.col(f).cast("double")) == F.lit(float("inf")))) for f in features]
    return sum(bad[1:], bad[0])


def verified(before: DataFrame, after: list[DataFrame], features: list[str]) -> DataFrame:
    """One row that says whether preparation did its work: bad cells before and after (in all the tables prepared), whether each
    table still has every feature, and OK or FAIL."""
    whole = all(set(features) <= set(t.columns) for t in after)
    there = [f for f in features if all(f in t.columns for t in after)]
    count = lambda t, fs: t.agg(bad_cells(t, fs).alias("n"))
    rows = [count(before, features).withColumn("what", F.lit("b")), *(count(t, there).withColumn("what", F.lit("a")) for t in after if there)]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    total = lambda w: F.coalesce(F.sum(F.when(F.col("what") == w, F.col("n"))), F.lit(0))
    out = every.agg(total("b").alias("bad_before"), total("a").alias("bad_after"), F.lit(whole).alias("width_kept"))
    return out.withColumn("status", F.when((F.col("bad_after") == 0) & F.col("width_kept"), "OK").otherwise("FAIL"))


def ingest_profile(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """One row: rows, classes, imbalance, missing and infinite cells, constant features, status."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("c")).agg(F.count(F.lit(1)).alias("n_classes"), F.max("c").alias("hi"), F.min("c").alias("lo"), F.sum("c").alias("n_rows"))
    inf = lambda f: F.abs(F.col(f)) == F.lit(float("inf"))
    total = lambda e: sum((e(f) for f in features[1:]), e(features[0]))
    cells = df.agg(total(lambda f: F.count_if(F.col(f).isNull() | F.isnan(f))).alias("n_missing"), total(lambda f: F.count_if(inf(f))).alias("n_infinite"), total(lambda f: (F.stddev_pop(f) == 0).cast("long")).alias("n_constant"))
    row = counts.crossJoin(cells)  # one row with one row
    status = F.when(F.col("n_classes") < 2, "FAIL").when((F.col("n_missing") + F.col("n_infinite") > 0) | (F.col("hi") > 10 * F.col("lo")), "WARN").otherwise("OK")
    return row.select("n_rows", "n_classes", (F.col("hi") / F.col("lo")).alias("imbalance"), "n_missing", "n_infinite", "n_constant", status.alias("status"))
