"""Small hand-made inputs for the micro tests."""

from __future__ import annotations

import datetime as dt

from affinity import schema

T0 = dt.datetime(2024, 1, 1)


def ts(sec: int) -> dt.datetime:
    return T0 + dt.timedelta(seconds=sec)


def log(spark, rows):
    """rows: (event, user, target_type, item, rating, sec); event_id = position."""
    data = [(i, ev, u, tt, it, r, ts(sec)) for i, (ev, u, tt, it, r, sec) in enumerate(rows)]
    return spark.createDataFrame(data, schema.LOG)


def items(spark, rows):
    """rows: (item_id, item_type, categories, brand, cosmetics)."""
    return spark.createDataFrame([(a, b, c, d, e, None) for a, b, c, d, e in rows], schema.ITEMS)


def users(spark, ids):
    return spark.createDataFrame([(u,) for u in ids], schema.USERS)


def requests(spark, rows):
    """rows: dicts with REQUEST fields (missing ones NULL)."""
    names = [f.name for f in schema.REQUEST.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema.REQUEST)


def as_dict(df, key_cols, val_col):
    out = {}
    for r in df.collect():
        k = tuple(r[c] for c in key_cols)
        out[k[0] if len(k) == 1 else k] = r[val_col]
    return out
