"""Positions from a log of buys and sells, and what becomes of them from day to day."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidewell.operators.asof import asof_join
from tidewell.session import ship


def without_cancelled(log: DataFrame, kind: str, ref: str, key: str) -> DataFrame:
    """The log less the entries that a cancel entry refers to, and less these."""
    gone = log.where(F.col(kind) == "cancel").select(F.col(ref).alias(key)).distinct()
    return log.where(F.col(kind) != "cancel").join(gone, key, "left_anti").select(log.columns)


def matched_positions(log: DataFrame, key: str, on: str, kind: str, entry: str, price: str) -> DataFrame:
    """key, entry, bought, price, sold and sold_price of each buy: a sell closes the newest buy of its key that is still open; one without any is dropped.

    The log's buys and sells, in the order of day, buys first, then entry: a stack for each key, whose length is its trades.
    """
    schema = StructType([log.schema[key], log.schema[entry], StructField("bought", log.schema[on].dataType), log.schema[price], StructField("sold", log.schema[on].dataType), StructField("sold_price", log.schema[price].dataType)])

    def work(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group[on].to_pylist(), [k != "buy" for k in group[kind].to_pylist()], group[entry].to_pylist(), group[price].to_pylist(), strict=True))
        held, out = [], []
        for day, sells, name, paid in rows:
            if not sells:
                held.append([name, day, paid, None, None])
                out.append(held[-1])
            elif held:
                held.pop()[3:] = [day, paid]
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = [group.schema.field(c).type for c in (entry, on, price, on, price)]
        names = [entry, "bought", price, "sold", "sold_price"]
        first = pa.array([group[key][0].as_py()] * len(out), group.schema.field(key).type)
        return pa.Table.from_arrays([first, *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=[key, *names])

    ship(log.sparkSession)
    return log.where(F.col(kind).isin("buy", "sell") & F.col(on).isNotNull()).select(key, on, kind, entry, price).groupBy(key).applyInArrow(work, schema)


#: The shares of a buy that names none, the least length of a reference, the largest limit in percent.
SHARES, LEAST_REF, MOST_PERCENT = 100.0, 8, 50.0


def settled_log(log: DataFrame) -> DataFrame:
    """Every entry of a log of trades, settled: what became of each, with the issue where it fits nothing.

    log: entry, seq (its order), kind (buy, sell, target, cancel), key, pick (the day of the prediction that it goes by, or null), day, price,
    shares, percent, ref. Columns: entry, kind, key, issue, and for buys that stand pick, bought, price, shares, sold, sold_price, targets (day and
    percent, in the order of the log) and entries (what was settled with them).

    A cancel takes off the entries that begin with its ref, of LEAST_REF characters or more. A buy needs a key and a pick or day; of several of
    one key, pick and day the first counts. A sell closes the newest open buy of its key that began by its day (and of its pick, if
    it names one); a target goes to the newest that began by its day, closed or not. A buy begins on its day, or else on its pick.
    Issues: unknown_kind, short_ref, buy_incomplete, buy_repeated, sell_unmatched, target_incomplete, target_unmatched, cancelled.

    Entries meet references by the first LEAST_REF characters. A key's entries are settled in one group, whose size is its trades.
    """
    plain = log.select("entry", F.col("seq").cast("long"), "kind", "key", F.col("pick").cast("date"), F.col("day").cast("date"), F.col("price").cast("double"), F.col("shares").cast("double"), F.col("percent").cast("double"), F.lower(F.trim("ref")).alias("ref"))
    refs = plain.where(F.col("kind").eqNullSafe("cancel") & (F.length("ref") >= LEAST_REF)).select(F.substring("ref", 1, LEAST_REF).alias("_r"), F.col("ref").alias("_ref")).distinct()
    name = F.lower(F.trim(F.col("entry").cast("string")))
    gone = plain.select("entry", name.alias("_n"), F.substring(name, 1, LEAST_REF).alias("_r")).join(refs, "_r").where(F.startswith("_n", "_ref")).select("entry").distinct().withColumn("_gone", F.lit(True))
    rows = plain.join(gone, "entry", "left")
    known = F.coalesce(F.col("kind").isin("buy", "sell", "target", "cancel"), F.lit(False))
    early = F.when(~known, "unknown_kind").when((F.col("kind") == "cancel") & (F.coalesce(F.length("ref"), F.lit(0)) < LEAST_REF), "short_ref").when((F.col("kind") != "cancel") & F.col("_gone"), "cancelled")
    early = F.coalesce(early, F.when((F.col("kind") == "buy") & (F.col("key").isNull() | (F.col("pick").isNull() & F.col("day").isNull())), "buy_incomplete").when((F.col("kind") == "target") & (F.col("day").isNull() | F.col("percent").isNull() | ~F.col("percent").between(1e-12, MOST_PERCENT)), "target_incomplete").when((F.col("kind") == "sell") & (F.col("key").isNull() | F.col("day").isNull()), "sell_unmatched").when((F.col("kind") == "target") & F.col("key").isNull(), "target_unmatched"))
    rows = rows.withColumn("issue", early).drop("_gone", "ref")
    shape = "entry {0}, kind string, key {1}, issue string, pick date, bought date, price double, shares double, sold date, sold_price double, targets array<struct<day: date, percent: double>>, entries array<{0}>".format(*(log.schema[c].dataType.simpleString() for c in ("entry", "key")))
    kinds = pa.schema([pa.field("targets", pa.list_(pa.struct([("day", pa.date32()), ("percent", pa.float64())])))])

    def settle(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["seq"], str(r["entry"])))
        out = {r["entry"]: {"entry": r["entry"], "kind": r["kind"], "key": r["key"], "issue": None} for r in rows}
        buys, seen = [], set()
        for r in (r for r in rows if r["kind"] == "buy"):
            place = (r["pick"], r["day"])
            if place in seen:
                out[r["entry"]]["issue"] = "buy_repeated"
                continue
            seen.add(place)
            buys.append(out[r["entry"]] | {"pick": r["pick"], "bought": r["day"], "price": r["price"], "shares": r["shares"] if (r["shares"] or 0) > 0 else SHARES, "sold": None, "sold_price": None, "targets": [], "entries": [r["entry"]]})
            out[r["entry"]] = buys[-1]
        began = lambda b: b["bought"] or b["pick"]
        for kind in ("sell", "target"):
            for r in (r for r in rows if r["kind"] == kind):
                fits = [b for b in buys if began(b) <= r["day"] and (r["pick"] is None or b["pick"] == r["pick"]) and (kind == "target" or b["sold"] is None)]
                if not fits:
                    out[r["entry"]]["issue"] = f"{kind}_unmatched"
                    continue
                held = max(fits, key=began)
                held["entries"].append(r["entry"])
                if kind == "sell":
                    held["sold"], held["sold_price"] = r["day"], r["price"]
                else:
                    held["targets"].append({"day": r["day"], "percent": r["percent"]})
        every = list(out.values())
        types = {"entry": group.schema.field("entry").type, "kind": pa.string(), "key": group.schema.field("key").type, "issue": pa.string(), "pick": pa.date32(), "bought": pa.date32(), "price": pa.float64(), "shares": pa.float64(), "sold": pa.date32(), "sold_price": pa.float64(), "targets": kinds.field("targets").type, "entries": pa.list_(group.schema.field("entry").type)}
        return pa.table({c: pa.array([r.get(c) for r in every], t) for c, t in types.items()})

    ship(log.sparkSession)
    settled = rows.where("issue IS NULL AND kind <> 'cancel'").drop("issue").groupBy("key").applyInArrow(settle, shape)
    others = rows.where("issue IS NOT NULL OR kind = 'cancel'").select("entry", "kind", "key", "issue")
    return settled.unionByName(others, allowMissingColumns=True)


def paths(positions: DataFrame, bars: DataFrame, limits: DataFrame, key: str, entry: str, bought: str, paid: str, horizon: int) -> DataFrame:
    """A row for each position and session that it is held: the limit in force (the last one set up to then), and close, gain and whether the high met it.

    bars: key, day, o, h, l, c; limits: entry, day, limit. A position ends with the session that meets its limit, or after ``horizon``. Bars meet
    positions by the number of the session, so that each position takes ``horizon`` rows at most.
    """
    number = F.row_number().over(Window.partitionBy(key).orderBy("day"))
    b = bars.select(key, "day", "h", "c", number.alias("_i"))
    first = b.select(key, F.col("day").alias("_d"), F.col("_i").alias("_f"))
    p = positions.join(first, (positions[key] == first[key]) & (F.col("_d") == F.col(bought))).drop(first[key]).drop("_d")
    spread = p.select(key, entry, bought, paid, F.explode(F.sequence(F.col("_f") + 1, F.col("_f") + horizon)).alias("_i"), "_f")
    held = spread.join(b, [key, "_i"])
    held = asof_join(held, limits, [entry], "day", "day", ["limit"], prefix="_l_").drop("_l_day").withColumnRenamed("_l_limit", "limit")
    by = Window.partitionBy(entry).orderBy("_i")
    meets = F.coalesce(F.col("h") >= F.col("limit"), F.lit(False))
    held = held.withColumn("met", meets).withColumn("_over", F.coalesce(F.max(meets).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    price: Column = F.when(F.col("met"), F.col("limit")).otherwise(F.col("c"))
    return held.where("NOT _over").select(key, entry, "day", (F.col("_i") - F.col("_f")).cast("long").alias("age"), "limit", "met", ((price / F.col(paid) - 1) * 100).alias("gain"))
