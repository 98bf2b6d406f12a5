"""Scores and reports as plain aggregations: confusion counts, F1, rankings, group summaries, bit quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """precision, recall, f1 and support of each class, 0 where there is nothing to divide by."""
    c = confusion(df, truth, predicted)
    hit = F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0))
    rows = c.groupBy(F.col("truth").alias("label")).agg(hit.alias("tp"), F.sum("n").alias("support"))
    cols = c.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("given"))
    both = rows.join(cols, "label", "full").na.fill(0)
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("given")), F.lit(0.0))
    return both.select("label", F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("given")), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0)).alias("recall"), f1.alias("f1"), "support", "tp")


def summary(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """accuracy, macro and weighted F1, macro precision and recall, the majority share, the lowest F1."""
    s = class_scores(df, truth, predicted)
    n = F.sum("support")
    return s.agg((F.sum("tp") / n).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), (F.max("support") / n).alias("majority"), F.min("f1").alias("lowest_f1"))


def learning_check(train: DataFrame, test: DataFrame, truth: str, predicted: str, margin: float = 0.02) -> DataFrame:
    """train_accuracy, test_accuracy, majority (of the test rows), gap (train less test), and whether training beat the majority
    by more than the margin."""
    a = summary(train, truth, predicted).select(F.col("accuracy").alias("train_accuracy"))
    b = summary(test, truth, predicted).select(F.col("accuracy").alias("test_accuracy"), "majority")
    both = a.crossJoin(b)  # one row with one row
    return both.withColumns({"gap": F.col("train_accuracy") - F.col("test_accuracy"), "learned": F.col("train_accuracy") > F.col("majority") + margin})


def joined(results: DataFrame, meta: DataFrame, extra: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Results whose key the meta rows have, with those and, where there are any, the extra columns; else the defaults."""
    return results.join(meta, key).join(extra, key, "left").na.fill(defaults)


def pace(model, df: DataFrame) -> dict[str, float]:
    """Rows a second and microseconds a row of encoding the whole table, the width of its bits and the bytes of the model's
    thresholds. The table is counted first, so that its own reading is warm; bits are made, not kept."""
    import time

    n = df.count()
    began = time.perf_counter()
    model.transform(df).write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - began
    return {"rows": n, "seconds": took, "rows_per_second": n / took, "microseconds_per_row": 1e6 * took / max(n, 1), "width": model.width, "state_bytes": 8 * model.width}


def clause_budget(classes: Column, width: Column) -> Column:
    """Clauses for so many classes and bits: even, within 256 to 2000."""
    half = F.bround(50 * classes + F.lit(0.3) * width).cast("long")
    return F.least(F.lit(2000), F.greatest(F.lit(256), 2 * F.ceil(half / F.lit(2)).cast("long")))


def best(df: DataFrame, group: list[str], score: str, name: str) -> DataFrame:
    """The row of the highest score in each group, ties to the smaller name."""
    return top(df, group, score, name, 1)


def top(df: DataFrame, group: list[str], score: str, name: str, k: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(F.desc(score), name)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def scores_of(df: DataFrame, key: str, column: str) -> DataFrame:
    """A map of scores as rows (key, name, score), without nulls and failures (-1)."""
    return df.select(key, F.explode(column).alias("name", "score")).where("score is not null and score <> -1")


def newest(frames: list[DataFrame], key: str) -> DataFrame:
    """All frames together; of rows with one key that of the last frame stays."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("__i", F.lit(i))
        out = f if out is None else out.unionByName(f)
    w = Window.partitionBy(key).orderBy(F.desc("__i"))
    return out.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__i", "__r")


def leaderboard(df: DataFrame, group: str, score: str, name: str, cost: str | None = None) -> DataFrame:
    """Mean score and wins (ties to the smaller name) of each name; with ``cost`` its mean too."""
    wins = best(df, [group], score, name).groupBy(name).agg(F.count(F.lit(1)).alias("wins"))
    mean = df.groupBy(name).agg(F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("n"), *([F.avg(cost).alias("mean_cost")] if cost else []))
    return mean.join(wins, name, "left").na.fill(0, ["wins"])


def bit_quality(ones: DataFrame, n: int) -> DataFrame:
    """From (feature, bit, ones) over n rows: width, dead bits, duplicate bits (nested bits of equal counts), entropy."""
    p = F.col("ones") / F.lit(float(n))
    h = F.when((p > 0) & (p < 1), -p * F.log2(p) - (1 - p) * F.log2(1 - p)).otherwise(0.0)
    per = ones.withColumn("__h", h).groupBy("feature").agg(F.count(F.lit(1)).alias("width"), F.count_if((F.col("ones") == 0) | (F.col("ones") == n)).alias("dead"), (F.count(F.lit(1)) - F.count_distinct("ones")).alias("duplicate"), F.avg("__h").alias("entropy"))
    return per.select("feature", "width", "dead", "duplicate", "entropy")


def training_plan(df: DataFrame, rows: str, width: str, classes: str) -> DataFrame:
    """df with clauses, target, specificity and epochs for a clause learner of these rows, bits and classes."""
    clauses = clause_budget(F.col(classes), F.col(width))
    target = F.least(F.lit(120), F.greatest(F.lit(8), F.bround(clauses / 16).cast("long")))
    epochs = F.least(F.lit(35), F.greatest(F.lit(12), F.bround(120000 / F.greatest(F.col(rows), F.lit(1))).cast("long") + 8))
    return df.withColumns({"clauses": clauses, "target": target, "specificity": F.lit(5.0), "epochs": epochs})


def root_causes(df: DataFrame) -> DataFrame:
    """df with ``tags``, why a score is low, from accuracy, macro_f1, gap (train less test), majority, imbalance, n_missing,
    n_infinite and n_constant. ``moderate`` stands only where none of the three before it does."""
    main = F.array_compact(
        F.array(
            F.when((F.col("imbalance") > 20) & (F.col("accuracy") - F.col("macro_f1") > 0.15), "imbalance"),
            F.when(F.col("gap") > 0.15, "overfit"),
            F.when(F.col("accuracy") <= F.col("majority") + 0.05, "weak"),
        )
    )
    more = F.array_compact(
        F.array(
            F.when((F.col("macro_f1") < 0.7) & (F.size(main) == 0), "moderate"),
            F.when(F.col("n_missing") + F.col("n_infinite") > 0, "dq"),
            F.when(F.col("n_constant") > 0, "const"),
        )
    )
    return df.withColumn("tags", F.concat(main, more))


def suspects(df: DataFrame, accuracy: str, majority: str) -> DataFrame:
    """Rows of near-perfect accuracy where the majority class alone doesn't explain it: the labels may leak."""
    return df.where((F.col(accuracy) >= 0.999) & (F.col(majority) < 0.95))


def successes(df: DataFrame, score: str, name: str, least: float = 0.9) -> DataFrame:
    """Rows of at least this score, best first."""
    return df.where(F.col(score) >= least).orderBy(F.desc(score), name)


def head_to_head(ours: DataFrame, theirs: DataFrame, key: str, score: str, names: tuple[str, str] = ("ours", "theirs")) -> DataFrame:
    """(key, both scores, delta, winner) for keys that both have; a tie goes to the first side."""
    a, b = (d.select(key, F.col(score).alias(n)) for d, n in zip((ours, theirs), names, strict=True))
    delta = F.col(names[0]) - F.col(names[1])
    return a.join(b, key).withColumn("delta", delta).withColumn("winner", F.when(delta >= 0, names[0]).otherwise(names[1]))


def group_summary(df: DataFrame, group: Column, names: tuple[str, str]) -> DataFrame:
    """From ``head_to_head`` rows: by group the count, how often the first side is at least level, and both means."""
    a, b = names
    return df.groupBy(group.alias("group")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("delta") >= 0).alias("level_or_above"), F.avg(a).alias(f"mean_{a}"), F.avg(b).alias(f"mean_{b}"))


def most_common(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n commonest values with their counts, ties to the smaller value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(n)


def sequence_credit(gains: Column, gamma: float = 0.9, most: int = 8) -> Column:
    """The discounted sum of the latest ``most`` gains, the newest undiscounted."""
    last = F.reverse(F.slice(gains, -F.least(F.size(gains), F.lit(most)), most))
    return F.when(F.size(gains) == 0, 0.0).otherwise(F.aggregate(F.transform(last, lambda v, i: v * F.pow(F.lit(gamma), i)), F.lit(0.0), lambda a, v: a + v))


def trimmed(bits: Column, width: int) -> Column:
    """Values as bits (anything but 0 is 1), cut to a width that two tables share."""
    return F.transform(F.slice(bits, 1, width), lambda v: (v != 0).cast("tinyint"))
