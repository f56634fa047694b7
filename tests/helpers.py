"""Small frames and comparisons."""

from __future__ import annotations

import numpy as np
import pandas as pd

from linewatch.schemas import READING


def make_readings(spark, rows):
    """Readings from ``(ts, src, dst, address, values)`` tuples, in arrival order."""
    full = [
        {"ts": ts, "src": src, "dst": dst, "address": address, "response_values": values, "seq": i}
        for i, (ts, src, dst, address, values) in enumerate(rows)
    ]
    return spark.createDataFrame([{f: r.get(f) for f in READING.names} for r in full], READING)


def same(left, right, keys, tolerance=1e-9):
    """Both Spark frames hold the same rows up to rounding noise."""
    a = left.toPandas().sort_values(keys, ignore_index=True)
    b = right.toPandas().sort_values(keys, ignore_index=True)
    same_pandas(a, b, tolerance)


def same_pandas(a: pd.DataFrame, b: pd.DataFrame, tolerance=1e-9):
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    for c in a.columns:
        if a[c].dtype.kind in "fiu":
            np.testing.assert_allclose(
                a[c].astype(float), b[c].astype(float), rtol=tolerance, atol=tolerance, err_msg=c, equal_nan=True
            )
        else:
            assert list(a[c]) == list(b[c]), c
