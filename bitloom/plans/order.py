"""Places, running sums and neighbours in a global order, without a window over all rows.

Rows are split into ranges by literal bounds (approximate quantiles, found once), so that a row's range is a function of
its value: it doesn't change when a stage is run again, unlike the partitions of a range exchange, whose bounds come from
samples. One row a range goes to the driver. The order column is numeric, a date or a timestamp; null and NaN come last.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranged(df: DataFrame, order: str, parts: int = 1000) -> DataFrame:
    """df with ``__b``, the number of the row's range."""
    c, kind = F.col(order), dict(df.dtypes)[order]
    if kind.startswith(("timestamp", "date")):  # by the fields as they are shown, in order for times without a zone too
        of_day = F.lit(0) if kind == "date" else F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
        c = F.unix_date(c.cast("date")) * F.lit(86400.0) + of_day
        if kind == "timestamp":
            c = F.unix_micros(order)
    x = df.withColumn("__x", c.cast("double"))
    probs = F.array(*(F.lit(i / parts) for i in range(1, parts)))
    found = x.where("not isnan(__x)").agg(F.percentile_approx("__x", probs, 10 * parts)).first()[0]
    bounds = sorted(set(found or [0.0]))
    cut = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol="__x", outputCol="__b", handleInvalid="keep")
    return cut.transform(x).withColumn("__b", F.col("__b").cast("int")).drop("__x")


def running(df: DataFrame, order: str, sums: dict[str, Column], parts: int = 1000) -> DataFrame:
    """df with each of ``sums`` added up over all rows up to and with this one; ``order`` must be unique."""
    x = ranged(df, order, parts)
    ends = x.groupBy("__b").agg(*(F.sum(e).alias(n) for n, e in sums.items())).orderBy("__b").collect()  # a row a range
    total, rows = dict.fromkeys(sums, 0), []
    for r in ends:
        rows.append((r["__b"], *total.values()))
        total = {n: total[n] + (r[n] or 0) for n in sums}
    kinds = dict(x.select(*(e.alias(n) for n, e in sums.items())).dtypes)
    kind = {n: "double" if kinds[n] in ("double", "float") else "long" for n in sums}
    before = df.sparkSession.createDataFrame([(b, *(float(v) if kind[n] == "double" else int(v) for n, v in zip(sums, vs, strict=True))) for b, *vs in rows], ", ".join(["__q int", *(f"`__before_{n}` {kind[n]}" for n in sums)]))
    w = Window.partitionBy("__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = x.withColumns({f"__in_{n}": F.sum(e).over(w) for n, e in sums.items()})
    out = local.join(F.broadcast(before), F.col("__b") == F.col("__q"))
    return out.withColumns({n: F.col(f"__before_{n}") + F.col(f"__in_{n}") for n in sums}).drop("__b", "__q", *(f"__{k}_{n}" for n in sums for k in ("before", "in")))


def numbered(df: DataFrame, order: str, parts: int = 1000) -> DataFrame:
    """df with ``__at``, the row's place from 0 in the order (unique)."""
    return running(df, order, {"__at": F.lit(1)}, parts).withColumn("__at", F.col("__at") - 1)


def neighbours(df: DataFrame, value: str, parts: int = 1000) -> DataFrame:
    """(value, before) for each distinct value but the smallest, ``before`` the next smaller one."""
    x = ranged(df.select(value).where(F.col(value).isNotNull()).distinct(), value, parts)
    last, rows = None, []
    for r in x.groupBy("__b").agg(F.max(value).alias("m")).orderBy("__b").collect():  # a row a range
        rows.append((r["__b"], last))
        last = r["m"]
    if not rows:
        return x.select(value, F.col(value).alias("before"))
    ends = df.sparkSession.createDataFrame(rows, "__q int, __end double")
    inner = x.withColumn("__lag", F.lag(value).over(Window.partitionBy("__b").orderBy(value)))
    both = inner.join(F.broadcast(ends), F.col("__b") == F.col("__q"))
    return both.select(value, F.coalesce("__lag", "__end").alias("before")).where("before is not null")
