"""Comparison of a query's rows with those of its SQL twin."""

from __future__ import annotations

import math
from collections import Counter


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.isoformat() if hasattr(v, "isoformat") else float(v) if hasattr(v, "as_tuple") else v


def assert_same(df, relation) -> None:
    columns = sorted(df.columns)
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    ours = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in relation.fetchall())
    assert sum(ours.values()) == sum(theirs.values())
    assert not ours - theirs, list((ours - theirs).items())[:3] + list((theirs - ours).items())[:3]
