"""Row frames within a key, with a rule on how many values a frame must hold.

Aggregates of the last n rows are put together from those of the last 1, 4, 16, 64, ... rows: log n steps for a row however large n is, each
of a few lags in the order that the rows are in already. Nothing is subtracted, so that a value spoils no frame that doesn't hold it.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

Agg = Callable[[Column], Column]


class Frames:
    """Frames over rows of one key in the order of time; ``order`` may hold further columns that break ties."""

    def __init__(self, *key: str, order: str | list[str]):
        self.key, self.by = key, Window.partitionBy(*key).orderBy(*([order] if isinstance(order, str) else order))

    def trailing(self, n: int) -> WindowSpec:
        return self.by.rowsBetween(-(n - 1), 0)

    def rolls(self) -> Rolls:
        return Rolls(self)

    def roll(self, df: DataFrame, **wanted: tuple) -> DataFrame:
        """df with the named aggregates of trailing rows: each (x, n), (x, n, agg), (x, n, agg, least) or (x, n, agg, least, head), see Rolls."""
        rolls = self.rolls()
        made = {name: rolls(*each) for name, each in wanted.items()}
        return rolls.off(rolls.onto(df).withColumns(made))

    def ahead(self, x: Column, n: int, agg: Agg = F.max) -> Column:
        """agg of the next n rows, null unless all of them are there and hold a value: an open outcome is not a false one."""
        w = self.by.rowsBetween(1, n)
        return F.when(F.count(x).over(w) >= n, agg(x).over(w))

    def lag(self, x: Column, k: int = 1) -> Column:
        return F.lag(x, k).over(self.by)

    def lead(self, x: Column, k: int = 1) -> Column:
        return F.lead(x, k).over(self.by)

    def row(self) -> Column:
        return F.row_number().over(self.by)

    def after(self, x: Column, k: int) -> Column:
        """x, null in the first k rows of a key."""
        return F.when(self.row() > k, x)

    def total(self, x: Column) -> Column:
        """Running sum; nulls count as 0."""
        return F.sum(F.coalesce(x, F.lit(0))).over(self.by.rowsBetween(Window.unboundedPreceding, 0))

    def last_value(self, x: Column, strict: bool = False, within: int | None = None) -> Column:
        """The last non-null x up to this row (before it if strict, at most ``within`` rows back)."""
        return F.last(x, ignorenulls=True).over(self.by.rowsBetween(Window.unboundedPreceding if within is None else -within, -1 if strict else 0))

    def rows_since(self, event: Column) -> Column:
        """Rows since the last earlier row with the event, null if there is none."""
        return self.row() - self.last_value(F.when(event, self.row()), strict=True)


def trend(x: Column) -> Column:
    """For Rolls: the population covariance of x with the number of the row. (As an aggregate of its own it has no meaning.)"""
    raise TypeError("trend is an aggregate of Rolls")


def _no(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def _counted(a: dict, b: dict, m: int) -> dict:
    return {"c": a["c"] + F.coalesce(b["c"], F.lit(0))}


def _summed(a: dict, b: dict, m: int) -> dict:
    return {"s": a["s"] + _no(b["s"])}


def _largest(a: dict, b: dict, m: int) -> dict:
    return {"x": F.greatest(a["x"], b["x"])}


def _smallest(a: dict, b: dict, m: int) -> dict:
    return {"x": F.least(a["x"], b["x"])}


def _spread(a: dict, b: dict, m: int) -> dict:
    """Count, mean and squared deviations of two parts together, by the update of Chan, Golub and LeVeque."""
    other, n = F.coalesce(b["k"], F.lit(0)), a["k"] + F.coalesce(b["k"], F.lit(0))
    gap, share = b["mean"] - a["mean"], other / F.greatest(n, F.lit(1))
    both = (a["k"] > 0) & (other > 0)
    return {"k": n, "mean": F.when(both, a["mean"] + gap * share).otherwise(F.coalesce(a["mean"], b["mean"])), "dev": F.when(both, a["dev"] + b["dev"] + gap * gap * a["k"] * share).otherwise(F.coalesce(a["dev"], b["dev"]))}


def _weighted(a: dict, b: dict, m: int) -> dict:
    """Sums of x and of x times the rows that it is back; the older part lies m rows further back."""
    return {"s": a["s"] + _no(b["s"]), "l": a["l"] + _no(b["l"]) + m * _no(b["s"])}


#: What is kept of some rows of x, and how two stretches are put together: a the m rows up to this one, b what comes before.
_FAMILIES: dict[str, tuple[Callable[[Column], dict], Callable[[dict, dict, int], dict]]] = {
    "count": (lambda x: {"c": x.isNotNull().cast("int")}, _counted),
    "sum": (lambda x: {"s": _no(x.cast("double"))}, _summed),
    "max": (lambda x: {"x": x}, _largest),
    "min": (lambda x: {"x": x}, _smallest),
    "spread": (lambda x: {"k": x.isNotNull().cast("int"), "mean": x.cast("double"), "dev": F.when(x.isNotNull(), F.lit(0.0))}, _spread),
    "trend": (lambda x: {"s": _no(x.cast("double")), "l": F.lit(0.0)}, _weighted),
}
_OVERLAP = ("max", "min")
#: How many stretches are put together in one step: a step is a pass over the rows, but what is put together must not grow too long.
_RADIX = {"count": 4, "sum": 4, "max": 4, "min": 4, "trend": 4, "spread": 2}


def _power(m: int, radix: int) -> bool:
    """Whether m, a power of 2, is one of the radix, 2 or 4."""
    return radix == 2 or m.bit_length() % 2 == 1


#: The family of an aggregate and its value, of the family's fields, the count c and the rows n.
_AGGREGATES: dict[Agg, tuple[str, Callable[[dict, Column, int], Column]]] = {
    F.sum: ("sum", lambda f, c, n: f["s"]),
    F.avg: ("sum", lambda f, c, n: f["s"] / F.nullif(c, F.lit(0))),
    F.max: ("max", lambda f, c, n: f["x"]),
    F.min: ("min", lambda f, c, n: f["x"]),
    F.var_pop: ("spread", lambda f, c, n: f["dev"] / F.nullif(c, F.lit(0))),
    F.stddev_pop: ("spread", lambda f, c, n: F.sqrt(f["dev"] / F.nullif(c, F.lit(0)))),
    F.stddev_samp: ("spread", lambda f, c, n: F.when(c > 1, F.sqrt(f["dev"] / (c - 1)))),
    trend: ("trend", lambda f, c, n: (f["s"] * ((n - 1) / 2) - f["l"]) / n),
}

_NUMBERS = count()


class Rolls:
    """Aggregates of trailing rows: named first, by calling this, then added to a DataFrame all at once, by onto().

    A call gives the column that will hold agg (sum, avg, max, min, var_pop, stddev_pop, stddev_samp of pyspark.sql.functions, or trend) of the
    last n rows of x: null unless ``least`` of them (all, by default) hold a value, and null where it is not a number. Nulls count
    for nothing, but trend takes them for 0: it needs all rows. x must be made of columns that the DataFrame has before onto().
    head: x is known to be null in so many first rows of a key and nowhere else, so that its values need not be counted.
    """

    def __init__(self, frames: Frames):
        self.frames, self.values, self.frame_names, self.name = frames, {}, {}, f"_roll{next(_NUMBERS)}"

    def __call__(self, x: Column, n: int, agg: Agg = F.avg, least: int | None = None, head: int | None = None) -> Column:
        of = self.values.setdefault(str(x), (f"{self.name}x{len(self.values)}", x))[0]
        family, value = _AGGREGATES[agg]
        held = self._frame(of, family, n)
        fields = {field: F.col(f"{held}_{field}") for field in _FAMILIES[family][0](x)}
        c = F.col(f"{self._frame(of, 'count', n)}_c") if head is None else F.greatest(F.least(F.col(f"{self.name}row") - head, F.lit(n)), F.lit(0))
        made = value(fields, c, n)
        return F.when(c >= (n if least is None else least), made if family in _OVERLAP else F.nanvl(made, F.lit(None).cast("double")))

    def _frame(self, of: str, family: str, n: int) -> str:
        return self.frame_names.setdefault((of, family, n), f"{self.name}n{len(self.frame_names)}")

    def onto(self, df: DataFrame) -> DataFrame:
        """df with what the columns given so far are made of; off() takes it away again."""
        by = self.frames.by
        lag = lambda fields, k: fields if k == 0 else {name: F.lag(c, k).over(by) for name, c in fields.items()}
        named = lambda prefix, fields: {f"{prefix}_{name}": c for name, c in fields.items()}
        at = lambda prefix, kind: {name: F.col(f"{prefix}_{name}") for name in _FAMILIES[kind][0](F.lit(0))}
        longest: dict[tuple[str, str], int] = {}
        for of, kind, n in self.frame_names:
            longest[of, kind] = max(n, longest.get((of, kind), 0))
        # the last 2**k rows of each x are in columns of one name, made anew in each step
        steps = {(of, kind): f"{of}_{kind}" for of, kind in longest}
        values = {of: x for of, x in self.values.values()}
        df = df.withColumns({f"{self.name}row": self.frames.row()} | {k: c for (of, kind), prefix in steps.items() for k, c in named(prefix, _FAMILIES[kind][0](values[of])).items()})
        m = 1
        while m <= max(longest.values(), default=0):
            new = {}
            for (of, kind, n), out in self.frame_names.items():
                radix, now = _RADIX[kind], at(steps[of, kind], kind)
                if not _power(m, radix):
                    continue
                if kind in _OVERLAP:
                    starts = [*range(0, n - m, m), n - m] if m <= n < radix * m else []
                    held = now
                else:
                    held, r = at(out, kind), n % m
                    starts = range(r, r + n // m % radix * m, m)
                for start in starts:  # stretches of m rows, the last ones of which may overlap
                    held = _FAMILIES[kind][1](held, lag(now, start), start) if start else now
                if starts:
                    new |= named(out, held)
            for (of, kind), prefix in steps.items():
                radix = _RADIX[kind]
                if _power(m, radix) and radix * m <= longest[of, kind]:
                    held = now = at(prefix, kind)
                    for i in range(1, radix):
                        held = _FAMILIES[kind][1](held, lag(now, i * m), i * m)
                    new |= named(prefix, held)
            df = df.withColumns(new) if new else df
            m *= 2
        return df.drop(*(name for prefix, kind in ((p, k) for (_, k), p in steps.items()) for name in named(prefix, at(prefix, kind))))

    def off(self, df: DataFrame) -> DataFrame:
        return df.drop(f"{self.name}row", *(f"{out}_{field}" for (_, kind, _), out in self.frame_names.items() for field in _FAMILIES[kind][0](F.lit(0))))
