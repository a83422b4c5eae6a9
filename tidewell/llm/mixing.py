"""Mixing sources to target weights by Poisson replication, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import materialise

#: The largest mean that one Poisson variable has; larger means are split into equal parts, each with its own hash.
LARGEST_MEAN = 16.0
#: Values of the distribution function that are tabled: beyond these lies less than a double can tell.
TERMS = 72
#: A table of sources is broadcast up to so many; beyond, it is joined by shuffling.
BROADCAST_SOURCES = 50_000
TEMPERATURE = 0.5


def _uniform(*parts: Column | str) -> Column:
    """A hash of the parts as a number in [0, 1) of 52 bits."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long").cast("double") / float(1 << 52)


def rates(docs: DataFrame, source_col: str = "source", weights: dict[str | None, float] | DataFrame | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """source, n (its rows) and rate: how often a row of it is repeated on average, so that as many rows as there are come out.

    Shares are ``weights`` (a dict, or rows of source and weight, of which a source's largest holds) scaled to sum 1 over the sources that
    occur (a source without a weight has 0), or else the sources' rows to the power ``temperature``. Nulls are one source.
    """
    counts = materialise(docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n")))
    if weights is None:
        counts = counts.withColumn("share", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        if isinstance(weights, dict):
            weights = docs.sparkSession.createDataFrame([(None if k is None else str(k), float(w)) for k, w in weights.items()], "source string, weight double")
        given = weights.groupBy(F.col("source").cast("string").alias("named")).agg(F.max("weight").cast("double").alias("share"))
        counts = materialise(counts.join(given, F.col("source").cast("string").eqNullSafe(F.col("named")), "left").select("source", "n", F.coalesce("share", F.lit(0.0)).alias("share")))
    total = counts.agg(F.sum("n").alias("rows"), F.sum("share").alias("shares")).first()
    scale = float(total.rows) / total.shares if total.shares else 0.0
    return counts.select("source", "n", (F.col("share") * F.lit(scale) / F.col("n")).alias("rate"))


def mix(docs: DataFrame, seed: str = "tidewell", weights: dict[str | None, float] | DataFrame | None = None, temperature: float = TEMPERATURE, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of docs, each repeated by a Poisson variable with its source's rate as mean, in a global random order.

    Adds mix_rate, mix_copies, mix_replica (from 1) and mix_key, which orders each partition, in place of columns of these names. The variable
    comes from inverting the distribution function at a hash of seed, id and text, so that it is the same in every run; rows of one
    id draw by themselves where their texts differ, and so do rows without an id. Rows of one id and one text get equal counts.
    Null sources are one source; null texts and other columns are passed on. Without a column ``text_col`` the id alone is hashed. No
    rows give no rows. Rows are dealt out by a hash of seed, id, text and replica, which no hot source or key can skew.
    """
    new = ("mix_rate", "mix_copies", "mix_replica", "mix_key")
    docs = docs.drop(*new)
    table = rates(docs, source_col, weights, temperature)
    parts = F.greatest(F.ceil(F.col("rate") / LARGEST_MEAN), F.lit(1)).cast("int")
    table = table.select("source", "rate", parts.alias("parts"), (F.col("rate") / parts).alias("mean"))
    p0 = F.exp(-F.col("mean"))
    more = lambda a, k: F.struct((a["p"] * F.col("mean") / k).alias("p"), (a["c"] + a["p"] * F.col("mean") / k).alias("c"), F.concat(a["all"], F.array(a["c"] + a["p"] * F.col("mean") / k)).alias("all"))
    table = table.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), F.struct(p0.alias("p"), p0.alias("c"), F.array(p0).alias("all")), more, lambda a: a["all"]))
    table = materialise(table.select(F.col("source").alias("mix_source"), F.col("rate").alias("mix_rate"), F.col("parts").alias("mix_parts"), F.col("cdf").alias("mix_cdf")))
    if table.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    if text_col in docs.columns:
        name = F.concat_ws(":", name, F.md5(F.col(text_col).cast("string")))
    held = docs.select(F.struct(*docs.columns).alias("row"), F.col(source_col).alias("source"), name.alias("name"))
    name = F.col("name")
    one = lambda j: F.size(F.filter("mix_cdf", lambda c: c <= _uniform(F.lit(seed), name, j.cast("string"))))
    copies = F.when(F.col("mix_parts") == 1, _count(_uniform(F.lit(seed), name, F.lit("1")))).otherwise(F.aggregate(F.sequence(F.lit(1), "mix_parts"), F.lit(0), lambda a, j: a + one(j)))
    out = held.join(table, F.col("source").eqNullSafe(F.col("mix_source"))).withColumn("mix_copies", copies.cast("long")).where("mix_copies > 0")
    out = out.withColumn("mix_replica", F.explode(F.sequence(F.lit(1).cast("long"), "mix_copies")))
    order = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), name, F.col("mix_replica").cast("string"), F.lit("order"))), 1, 15), 16, 10).cast("long")
    out = out.withColumn("mix_key", order).select("row.*", *new)
    return out.repartition("mix_key").sortWithinPartitions("mix_key")


def _count(u: Column) -> Column:
    """How many values of the distribution function u reaches: the inverse at u, which is hashed once."""
    return F.aggregate(F.transform(F.array(u), lambda x: F.size(F.filter("mix_cdf", lambda c: c <= x))), F.lit(0), lambda a, n: a + n)
