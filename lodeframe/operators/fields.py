"""Two-dimensional fields: arrays of levels, row behind row, as decoded pictures give them.

A crop, its reduction to a grid and its cosine transform are linear, so a hash takes one matrix
product a batch.  Bands and edges are array expressions in the JVM.
"""

from __future__ import annotations

from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .matching import hamming

# Geometry in shares or millimetres, and thresholds of levels.
ART_BOX = (0.07, 0.10, 0.93, 0.58)
SYMBOL_BOX = (0.78, 0.55, 1.0, 0.80)
WINDOW_SHARE, STEP_SHARE = 0.09, 0.02
SYMBOL_DISTANCE, SYMBOL_MARGIN = 6, 6
TRIM_MM = (63.0, 88.0)
BANDS_MM = {"left": (0.0, 10.9775, 1.387, 77.0225), "right": (61.613, 10.9775, 63.0, 77.0225), "top": (7.2275, 0.0, 55.7725, 1.415), "bottom": (7.2275, 86.585, 55.7725, 88.0)}
UNIFORM_BELOW = 18
BLACK_TO, WHITE_FROM, SILVER, SILVER_SPREAD = 60, 210, (140, 200), 20
LINES, LINES_FROM, LINES_TO, SEARCHED = 9, 0.15, 0.85, 0.20
SMOOTHED, SUSTAINED, FAR, BLACK_EDGE = 4, 5, 28, 32
LEAST_BAND = 4

#: Cosines are taken as whole numbers of this many steps, so sums of levels are exact (below 2**53) and every engine finds the same bits.
COSINE_STEPS = 1 << 12

Box = tuple[float, float, float, float]  # left, top, right, bottom
Cells = tuple[int, int, int, int]


PLANES = ("red", "green", "blue")


def cells_of(box: Box, height: int, width: int) -> Cells:
    """A box of shares as cells, cut off as pixels are."""
    left, top, right, bottom = box
    return int(left * width), int(top * height), int(right * width), int(bottom * height)


def cosines(low: int, side: int) -> np.ndarray:
    u, x = np.arange(low)[:, None], np.arange(side)[None, :]
    return np.rint(COSINE_STEPS * np.cos(np.pi * (2 * x + 1) * u / (2 * side)))


def frequencies(first: int, end: int, length: int, side: int, low: int) -> np.ndarray:
    """low x length weights: cells first to end as a grid of ``side`` means, then their low frequencies."""
    n = end - first
    cell, grid = np.arange(n) * side, np.arange(side) * n
    overlap = np.minimum(cell[None, :] + side, grid[:, None] + n) - np.maximum(cell[None, :], grid[:, None])
    out = np.zeros((low, length))
    out[:, first:end] = cosines(low, side) @ (np.maximum(overlap, 0) // gcd(n, side))
    return out


def crop_weights(height: int, width: int, cells: Cells, side: int, low: int = 8) -> np.ndarray:
    """low^2 x (height * width) weights of a crop's low frequencies."""
    left, top, right, bottom = cells
    if not (0 <= left < right <= width and 0 <= top < bottom <= height):
        raise ValueError(f"the crop {cells} holds no cell of {height} x {width}")
    return np.kron(frequencies(top, bottom, height, side, low), frequencies(left, right, width, side, low))


def _hashed(levels: pd.Series, size: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices of fields of the right size without nulls, their hashes: one for each 64 weights)."""
    good = [k for k, v in enumerate(levels) if v is not None and len(v) == size and not (v.dtype.kind == "f" and np.isnan(v).any())]
    out = np.zeros((len(good), len(weights) // 64), np.int64)
    step = max(1, (1 << 22) // size)
    for a in range(0, len(good), step):
        block = np.stack([levels.iloc[k] for k in good[a : a + step]]).astype(np.float64)
        found = (block @ weights.T).reshape(len(block), -1, 64)
        bits = found > np.median(found, axis=2, keepdims=True)
        out[a : a + step] = np.packbits(bits, axis=2).view(">i8")[:, :, 0]
    return np.array(good, int), out


def perceptual_hash(levels: Column, height: int, width: int, box: Box = (0.0, 0.0, 1.0, 1.0), side: int = 32) -> Column:
    """The 64-bit hash (signed) of a crop: which of its 8 x 8 low frequencies exceed their median, the lowest in the highest bit.

    Null for a field that is null, of another size, or with a null or NaN level.
    """
    weights, size = crop_weights(height, width, cells_of(box, height, width), side), height * width

    def hashed(values: pd.Series) -> pd.Series:
        good, found = _hashed(values, size, weights)
        out = np.full(len(values), None, object)
        out[good] = found[:, 0]
        return pd.Series(out)

    return F.pandas_udf(hashed, T.LongType())(levels)


def symbol_windows(height: int, width: int) -> tuple[int, int]:
    """(size, step) in cells of the windows that slide down a symbol strip."""
    size = max(8, min(width, int(height * WINDOW_SHARE / (SYMBOL_BOX[3] - SYMBOL_BOX[1]))))
    return size, max(1, int(size * STEP_SHARE / WINDOW_SHARE))


def window_hashes(strips: Column, height: int, width: int, size: int, step: int, side: int = 32) -> Column:
    """Hashes of all square windows that slide down a strip, first to last; none where the strip is shorter than a window."""
    tops = range(0, height - size + 1, step)
    weights = np.concatenate([crop_weights(height, width, (0, y, min(width, size), y + size), side) for y in tops]) if tops else np.zeros((0, height * width))

    def hashed(values: pd.Series) -> pd.Series:
        good, found = _hashed(values, height * width, weights)
        out = np.full(len(values), None, object)
        for k, row in zip(good, found, strict=True):
            out[k] = row
        return pd.Series(out)

    return F.pandas_udf(hashed, T.ArrayType(T.LongType()))(strips)


def symbol_matches(windows: DataFrame, candidates: DataFrame, glyphs: DataFrame, key: str, distance: int = SYMBOL_DISTANCE, margin: int = SYMBOL_MARGIN) -> DataFrame:
    """(key, candidate, distance) of the candidates whose set's glyph alone lies near a window.

    windows: (key, hashes); candidates: (key, candidate, set_code); glyphs: (set_code, glyph).  A set
    is compared once a row, its distance is that of the nearest window.  Sets without a glyph take no
    part.  No rows where the best set is farther than ``distance`` or not more than ``margin`` ahead
    of the next one: ties have no winner.
    """
    near = F.array_min(F.transform("hashes", lambda h: hamming(h, F.col("glyph"))))
    sets = candidates.select(key, "set_code").distinct().join(glyphs.where("glyph is not null"), "set_code").join(windows, key)
    scored = sets.select(key, "set_code", near.alias("distance")).where("distance is not null")
    place = F.row_number().over(Window.partitionBy(key).orderBy("distance", "set_code"))
    two = scored.withColumn("place", place).where("place <= 2").groupBy(key).agg(F.min_by("set_code", "place").alias("set_code"), F.min("distance").alias("distance"), F.max(F.when(F.col("place") == 2, F.col("distance"))).alias("next"))
    won = two.where((F.col("distance") <= distance) & (F.col("next").isNull() | (F.col("next") - F.col("distance") > margin)))
    return candidates.join(won.select(key, "set_code", "distance"), [key, "set_code"]).select(key, "candidate", "distance")


def rectangle(levels: Column, width: int, cells: Cells) -> Column:
    """The levels of a rectangle, row behind row."""
    left, top, right, bottom = cells
    return F.flatten(F.transform(F.sequence(F.lit(top), F.lit(bottom - 1)), lambda y: F.slice(levels, y * width + (left + 1), right - left)))


def moments(values: Column) -> Column:
    """(n, sum, squares) of an array of whole numbers, exactly, in one pass: what ``values`` stands for is computed once."""
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("n", "sum", "squares")])
    return F.aggregate(values, zero, lambda a, v: F.struct((a["n"] + 1).alias("n"), (a["sum"] + v).alias("sum"), (a["squares"] + v.cast("long") * v).alias("squares")))


def mean_of(m: Column) -> Column:
    return m["sum"] / m["n"]


def deviation_of(m: Column) -> Column:
    """Population deviation."""
    return F.sqrt((m["n"] * m["squares"] - m["sum"] * m["sum"]).cast("double")) / m["n"]


def border_bands(height: int, width: int, thickness: float = 1.0, bleed_mm: float = 0.0, least: int = LEAST_BAND) -> dict[str, Cells]:
    """Bands along the trim's edges in cells, ``thickness`` times their usual depth; bands of under ``least`` cells either way are left out."""
    out = {}
    for name, (left, top, right, bottom) in BANDS_MM.items():
        more = (thickness - 1) * (right - left if name in ("left", "right") else bottom - top)
        left, right = left - more * (name == "right"), right + more * (name == "left")
        top, bottom = top - more * (name == "bottom"), bottom + more * (name == "top")
        share = lambda mm, trim: min(1.0, max(0.0, (mm + bleed_mm) / (trim + 2 * bleed_mm)))
        cells = cells_of((share(left, TRIM_MM[0]), share(top, TRIM_MM[1]), share(right, TRIM_MM[0]), share(bottom, TRIM_MM[1])), height, width)
        if cells[2] - cells[0] >= max(1, least) and cells[3] - cells[1] >= max(1, least):
            out[name] = cells
    return out


def border_color(pictures: DataFrame, key: str, width: int, bands: dict[str, Cells]) -> DataFrame:
    """(key, border): black, white, silver, borderless or null of each picture with planes ``red``, ``green``, ``blue``.

    A border is named if the mean deviation of the side bands, or that of the top band, is low (in
    red); if neither is, the picture is borderless.  The bottom band, which holds small print on every
    picture, has no say in that, but its mean counts as the others'.  Null where the colour is of no
    class, and without side and top bands or without pictures.
    """
    measured = pictures.select(key, *[moments(rectangle(F.col(p), width, c)).alias(f"{p}_{b}") for b, c in bands.items() for p in PLANES])
    average = lambda columns: sum(columns[1:], columns[0]) / len(columns)
    sides = [deviation_of(F.col(f"red_{b}")) for b in ("left", "right") if b in bands]
    calm = average(sides) < UNIFORM_BELOW if sides else F.lit(False)
    if "top" in bands:
        calm = calm | (deviation_of(F.col("red_top")) < UNIFORM_BELOW)
    means = measured.select(key, calm.alias("calm"), *[average([mean_of(F.col(f"{p}_{b}")) for b in bands]).alias(p) for p in PLANES]) if bands else measured.select(key, F.lit(None).cast("boolean").alias("calm"), *[F.lit(None).cast("double").alias(p) for p in PLANES])
    brightness = (F.col("red") + F.col("green") + F.col("blue")) / 3
    spread = F.greatest(*PLANES) - F.least(*PLANES)
    named = F.when(brightness <= BLACK_TO, "black").when(brightness >= WHITE_FROM, "white").when(brightness.between(*SILVER) & (spread <= SILVER_SPREAD), "silver")
    judged = bool(sides) or "top" in bands
    return means.select(key, (F.when(~F.col("calm"), "borderless").when(F.col("calm"), named) if judged else F.lit(None).cast("string")).alias("border"))


SIDES = ("top", "bottom", "left", "right")


def line_places(length: int) -> list[int]:
    """Where the sample lines of an edge start."""
    return [int(length * f) for f in np.linspace(LINES_FROM, LINES_TO, LINES)]


def _lines(side: str, height: int, width: int, n: int) -> Column:
    """The first n levels inwards of each sample line of a side, in three colours."""
    at = {
        "top": lambda p, j: j * width + p,
        "bottom": lambda p, j: (height - 1 - j) * width + p,
        "left": lambda p, j: p * width + j,
        "right": lambda p, j: p * width + (width - 1 - j),
    }[side]
    places = F.array(*[F.lit(p) for p in line_places(width if side in ("top", "bottom") else height)])

    def levels(plane: str, p: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.get(F.col(plane), at(p, j))).alias(plane)

    return F.transform(places, lambda p: F.struct(*[levels(c, p) for c in PLANES]))


def _scanned(lines: Column, last: int) -> Column:
    """Each line with the place from which ``SUSTAINED`` cells lie far from its outer colour (``at``; null without one up to ``last``)."""
    outer = F.transform(lines, lambda l: F.struct(l.alias("line"), *[F.aggregate(F.slice(l[p], 1, SMOOTHED), F.lit(0).cast("long"), lambda a, v: a + v).alias(p) for p in PLANES]))

    def apart(x: Column, j: Column) -> Column:
        steps = [x["line"][p][j] * SMOOTHED - x[p] for p in PLANES]
        return steps[0] * steps[0] + steps[1] * steps[1] + steps[2] * steps[2] > (FAR * SMOOTHED) ** 2

    far = F.transform(outer, lambda x: F.struct(x["line"].alias("line"), F.transform(F.sequence(F.lit(0), F.lit(last + SUSTAINED - 1)), lambda j: apart(x, j)).alias("far")))
    lasting = lambda x: F.filter(F.sequence(F.lit(SMOOTHED), F.lit(last)), lambda i: F.forall(F.slice(x["far"], i + 1, SUSTAINED), lambda y: y))
    return F.transform(far, lambda x: F.struct(x["line"].alias("line"), F.get(lasting(x), F.lit(0)).alias("at")))


def _calm_zone(line: Column, i: Column) -> Column:
    """The i outer cells deviate little in every colour."""
    parts = [moments(F.slice(line[p], 1, i)) for p in PLANES]
    return F.forall(F.array(*parts), lambda m: m["n"] * m["squares"] - m["sum"] * m["sum"] < UNIFORM_BELOW**2 * m["n"] * m["n"])


def _insets(lines: Column, last: int) -> Column:
    """Where the lines that find an end of a uniform border find it."""
    if last < SMOOTHED:
        return F.array().cast("array<int>")
    return F.transform(F.filter(_scanned(lines, last), lambda x: x["at"].isNotNull() & _calm_zone(x["line"], x["at"])), lambda x: x["at"])


def _black(lines: Column) -> Column:
    """The outer cells of all lines are nearly black in every colour."""
    zero = F.lit(0).cast("long")
    total = lambda plane: F.aggregate(lines, zero, lambda a, l: a + F.aggregate(F.slice(l[plane], 1, SMOOTHED), zero, lambda b, v: b + v))
    return F.greatest(*[total(p) for p in PLANES]) < BLACK_EDGE * SMOOTHED * LINES


def _median(values: Column) -> Column:
    n = F.size(values)
    ordered = F.sort_array(values)
    return F.when(n > 0, (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2)


def inset(pictures: DataFrame, key: str, height: int, width: int) -> DataFrame:
    """(key, for each side ``<side>_inset`` and ``<side>_call``, inset, verdict): how far in from each edge the border ends.

    Each side is scanned inwards along ``LINES`` lines, over a share of the picture; its inset is the
    median of the lines that find a uniform zone and then a lasting change of colour, as a share of
    the picture.  A side without such a line is ``indeterminate_black`` where its edge is nearly black,
    else ``no_transition``, and has no inset.  Three black sides make the picture indeterminate, two
    measured ones measured, all else is ambiguous.  ``inset`` is the mean of the measured sides where
    they agree within a tenth of the picture, else null.  All is null for a picture of another size or
    without planes.
    """
    reach = {s: height if s in ("top", "bottom") else width for s in SIDES}
    last = {s: min(int(n * SEARCHED), n - SUSTAINED) - 1 for s, n in reach.items()}
    deep = {s: last[s] + SUSTAINED if last[s] >= SMOOTHED else min(SMOOTHED, n) for s, n in reach.items()}
    # All sides in one step: a plane that a single expression reads would be computed anew for each of its cells.
    fits = F.greatest(*[F.size(p) for p in PLANES]).eqNullSafe(height * width) & F.least(*[F.size(p) for p in PLANES]).eqNullSafe(height * width)
    found = pictures.select(key, fits.alias("fits"), *[_lines(s, height, width, deep[s]).alias(f"{s}_lines") for s in SIDES])
    found = found.select(key, "fits", *[_insets(F.col(f"{s}_lines"), last[s]).alias(f"{s}_at") for s in SIDES], *[_black(F.col(f"{s}_lines")).alias(f"{s}_black") for s in SIDES])
    call = lambda s: F.when(F.size(f"{s}_at") > 0, "measured").when(F.col(f"{s}_black"), "indeterminate_black").otherwise("no_transition")
    found = found.select(key, "fits", *[c for s in SIDES for c in ((_median(F.col(f"{s}_at")) / reach[s]).alias(f"{s}_inset"), call(s).alias(f"{s}_call"))])
    calls = [F.col(f"{s}_call") for s in SIDES]
    count = lambda call: sum(((c == call).cast("int") for c in calls[1:]), (calls[0] == call).cast("int"))
    insets = F.filter(F.array(*[F.col(f"{s}_inset") for s in SIDES]), lambda x: x.isNotNull())
    agree = F.array_max(insets) - F.array_min(insets) <= 0.1
    mean = F.aggregate(insets, F.lit(0.0), lambda a, x: a + x) / F.size(insets)
    verdict = F.when(count("indeterminate_black") >= 3, "indeterminate").when(count("measured") >= 2, "measured").otherwise("ambiguous")
    columns = [c for s in SIDES for c in (f"{s}_inset", f"{s}_call")]
    out = {**{c: F.col(c) for c in columns}, "verdict": verdict, "inset": F.when((verdict == "measured") & agree, mean)}
    return found.select(key, *[F.when(F.col("fits"), v).alias(c) for c, v in out.items()])
