"""Evaluation of scores by rank formulas, resampling by group, and folds in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_sums(per: DataFrame, by: list[str], score: str, sums: list[str], descending: bool = False, ranges: int = 500) -> DataFrame:
    """per, which has a row for each score of a group, with upto_<c>: the sums over the scores up to and with this one, in their order.

    Scores are put into ranges by quantiles; sums within a range are added to those of the ranges before, so that no task holds all
    scores, also where there are no groups.
    """
    x = F.col(score).cast("double")
    edges = sorted(set(per.agg(F.percentile_approx(x, [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or []))
    slot = F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e < x)) if edges else F.lit(0)
    sign = -1 if descending else 1
    per = per.withColumn("_slot", sign * slot)
    inside = Window.partitionBy(*by, "_slot").orderBy(F.col(score).desc() if descending else F.col(score)).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = per.groupBy(*by, "_slot").agg(*(F.sum(c).alias(f"_{c}") for c in sums)).select(*(F.col(k).alias(f"_b_{k}") for k in (*by, "_slot")), *(F.coalesce(F.sum(f"_{c}").over(ahead), F.lit(0)).alias(f"_before_{c}") for c in sums))
    both = per.withColumns({f"_in_{c}": F.sum(c).over(inside) for c in sums}).join(before, [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in (*by, "_slot")])
    return both.select(*(c for c in per.columns if c != "_slot"), *((F.col(f"_before_{c}") + F.col(f"_in_{c}")).alias(f"upto_{c}") for c in sums))


def auc(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """by with n, n_pos and auc (ties half), null where a class is missing. Rows are summed by score first; then see running_sums()."""
    d = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    ones = F.sum((F.col(label) == 1).cast("long"))
    per = d.groupBy(*by, score).agg(F.count("*").alias("_n"), F.sum(F.col(label).cast("long")).alias("_p"), ones.alias("_one")).withColumn("_zero", F.col("_n") - F.col("_one"))
    per = running_sums(per, by, score, ["_zero"])
    wins = F.sum(F.col("_one") * (F.col("upto__zero") - F.col("_zero") / 2))
    out = per.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum("_p").alias("n_pos"), wins.alias("_s"))
    pairs = F.col("n_pos") * (F.col("n") - F.col("n_pos"))
    return out.select(*by, "n", "n_pos", F.when(pairs > 0, F.col("_s")).alias("wins"), pairs.alias("pairs"), F.when(pairs > 0, F.col("_s") / pairs).alias("auc"))


def pooled_auc(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """The AUC within groups: wins over pairs, both summed over the groups."""
    return auc(df, by, score, label).where("pairs > 0").agg(F.count("*").alias("n_groups"), F.sum("pairs").alias("n_pairs"), (F.sum("wins") / F.sum("pairs")).alias("within_auc"))


def average_precision(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Area under the step curve of precision and recall, tied scores taken together (running_sums())."""
    per = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count("*").alias("_n"), F.sum(F.col(label).cast("long")).alias("_p"))
    curve = running_sums(per, by, score, ["_n", "_p"], descending=True)
    return curve.groupBy(*by).agg((F.sum(F.col("_p") * F.col("upto__p") / F.col("upto__n")) / F.sum("_p")).alias("average_precision"))


def ndcg(df: DataFrame, by: list[str], score: str, gain: str, k: int, tie: str) -> DataFrame:
    """NDCG of the first k by score (ties by the column tie), null where nothing can be gained."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie)))
    ideal = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(gain).desc(), F.col(tie)))
    d = df.select(*by, F.col(gain).cast("double").alias("_g"), place.alias("_a"), ideal.alias("_b"))
    total = lambda p: F.sum(F.when(F.col(p) <= k, F.col("_g") / F.log2(F.col(p) + F.lit(1.0))))
    return d.groupBy(*by).agg(F.when(total("_b") > 0, total("_a") / total("_b")).alias("ndcg"))


def group_bootstrap(df: DataFrame, group: str, value: str, draws: int, seed: int = 0) -> DataFrame:
    """draw and mean: means of value over groups drawn with replacement, each group's weight a Poisson(1) count from a hash.

    Groups are summed first, so that only sums of groups are repeated for each draw.
    """
    sums = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.sum(value).alias("_s"), F.count("*").alias("_n"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col(group).cast("string"))), 1, 12), 16, 10).cast("long").cast("double") / float(1 << 48)
    limits, total, term = [], 0.0, 2.718281828459045**-1
    for i in range(12):
        total += term
        limits.append(total)
        term /= i + 1
    count = sum(((u >= t).cast("int") for t in limits), F.lit(0))
    drawn = sums.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_w", count)
    return drawn.groupBy("draw").agg((F.sum(F.col("_w") * F.col("_s")) / F.sum(F.col("_w") * F.col("_n"))).alias("mean"))


def walk_forward(days: DataFrame, on: str, first_test: str, months: int, folds: int, embargo_days: int) -> DataFrame:
    """fold, test_from, test_to (without), train_to (without): expanding training that ends embargo_days before each test."""
    start = F.add_months(F.lit(first_test).cast("date"), F.col("fold") * months)
    grid = days.sparkSession.range(folds).select(F.col("id").cast("int").alias("fold"))
    plan = grid.select("fold", start.alias("test_from"), F.add_months(start, months).alias("test_to"), F.date_sub(start, embargo_days).alias("train_to"))
    d = days.select(F.col(on).alias("_d"))
    side = d.join(F.broadcast(plan), (F.col("_d") < F.col("train_to")) | ((F.col("_d") >= F.col("test_from")) & (F.col("_d") < F.col("test_to"))))
    return side.groupBy("fold", "test_from", "test_to", "train_to").agg(F.count_if(F.col("_d") < F.col("train_to")).alias("n_train"), F.count_if(F.col("_d") >= F.col("test_from")).alias("n_test"))


def wilson(df: DataFrame, by: list[str], label: str, z: float = 1.96) -> DataFrame:
    """Share of label 1 in each group with Wilson's interval."""
    g = df.where(F.col(label).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("p"))
    centre, half = (F.col("p") + z * z / (2 * F.col("n"))) / (1 + z * z / F.col("n")), z * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n") + z * z / (4 * F.col("n") * F.col("n"))) / (1 + z * z / F.col("n"))
    return g.select(*by, "n", "p", (centre - half).alias("low"), (centre + half).alias("high"))
