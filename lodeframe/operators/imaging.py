"""Measures of decoded pictures (arrays of grey levels) and of their hashes.

Decoding needs an image library, which is not part of the library: callers hand in grey levels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .matching import hamming


def _square(values) -> np.ndarray:
    side = int(len(values) ** 0.5)
    return np.asarray(values[: side * side], dtype=np.float64).reshape(side, side)


def sharpness(values) -> float | None:
    """Variance of the Laplacian: low for a blurred picture."""
    if values is None or len(values) < 9:
        return None
    p = _square(values)
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
    return float(lap.var())


def grey_entropy(values, levels: int = 16) -> float | None:
    """Shannon entropy in bits of the histogram of grey levels."""
    if values is None or not len(values):
        return None
    counts = np.histogram(np.asarray(values, dtype=np.float64), bins=levels)[0]
    share = counts[counts > 0] / counts.sum()
    return float(-(share * np.log2(share)).sum())


def truncated(values, rows: int = 2) -> bool:
    """The last rows of a picture hold one level only: its file ended early."""
    p = _square(values)
    return bool(len(p) > rows and np.ptp(p[-rows:]) == 0)


_QUALITY = T.StructType([T.StructField("sharpness", T.DoubleType()), T.StructField("entropy", T.DoubleType()), T.StructField("truncated", T.BooleanType())])


def measured(fields: list, levels: int = 16) -> pd.DataFrame:
    """(sharpness, entropy, truncated) of many fields, those of one size as one matrix."""
    out = np.full((len(fields), 3), np.nan)
    sizes = np.array([-1 if v is None else len(v) for v in fields])
    for size in np.unique(sizes[sizes > 0]):
        own = np.flatnonzero(sizes == size)
        values = np.stack([fields[k] for k in own]).astype(np.float64)
        side = int(size**0.5)
        p = values[:, : side * side].reshape(-1, side, side)
        if size >= 9:
            out[own, 0] = (p[:, :-2, 1:-1] + p[:, 2:, 1:-1] + p[:, 1:-1, :-2] + p[:, 1:-1, 2:] - 4 * p[:, 1:-1, 1:-1]).var(axis=(1, 2))
        low, high = values.min(1, keepdims=True), values.max(1, keepdims=True)
        flat = high == low
        low, high = np.where(flat, low - 0.5, low), np.where(flat, high + 0.5, high)
        edges = np.stack([np.linspace(a, b, levels + 1) for a, b in zip(low[:, 0], high[:, 0], strict=True)])
        # Bins are closed below and open above, but for the last, as those of a histogram.
        at = np.minimum((values[:, :, None] >= edges[:, None, 1:-1]).sum(2), levels - 1)
        share = np.stack([(at == k).sum(1) for k in range(levels)], 1) / size
        out[own, 1] = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
        out[own, 2] = np.ptp(p[:, -2:], axis=(1, 2)) == 0 if side > 2 else 0
    return pd.DataFrame({"sharpness": out[:, 0], "entropy": out[:, 1], "truncated": np.nan_to_num(out[:, 2]) > 0}).astype({"sharpness": object, "entropy": object}).where(lambda d: d.notna(), None)


def quality(levels: Column) -> Column:
    """(sharpness, entropy, truncated) of arrays of grey levels, in Arrow batches."""
    return F.pandas_udf(lambda values: measured(list(values)), _QUALITY)(levels)


def nearest_window(hashes: Column, wanted: Column) -> Column:
    """(distance, position) of the window hash that is nearest to the wanted hash; the first of equals."""
    scored = F.transform(hashes, lambda h, k: F.struct(hamming(h, wanted).alias("distance"), k.alias("position")))
    return F.array_min(scored)


def merged_versions(old: Column, new: Column) -> Column:
    """Extractor versions of a row after another run: the new ones win, the others stay (null counts as none)."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    new = F.coalesce(new, none)
    return F.map_concat(F.map_filter(F.coalesce(old, none), lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)


def governed(loads: Column, start: int, ceiling: float) -> Column:
    """Width of a worker pool after a series of load samples: one more after a quiet one, halved after a loud one, at least 1."""
    return F.aggregate(loads, F.lit(float(start)), lambda w, x: F.when(x > ceiling, F.greatest(F.lit(1.0), F.floor(w / 2).cast("double"))).otherwise(w + 1.0))


def batch_size(memory_mb: Column, row_mb: Column, budget_s: Column, row_s: Column, most: int) -> Column:
    """Rows of a batch that neither memory nor duration forbids."""
    return F.greatest(F.lit(1), F.least(F.floor(memory_mb / row_mb), F.floor(budget_s / row_s), F.lit(most))).cast("long")
