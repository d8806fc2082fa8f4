"""Queries of two-dimensional fields: pictures of 56 x 40 cells that are drawn from ``embeddings``, row by row.

A picture has a border of 4 to 7 cells in a colour of its kind (black, white, silver, gold, none at
all, grey, art up to the sides, black far inwards), small print below, and its vector's components as art.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fields as P
from .registry import Inputs, query

H, W = 56, 40
BANDS = P.border_bands(H, W, thickness=4.0, least=1)
STRIP_H, STRIP_W = 24, 8

LEVEL = "least(255, greatest(0, cast(floor(128 + 400 * cast({} as double)) as int)))"
_SHIFTS = {"red": 0, "green": 21, "blue": 42}


def _by_kind(*values: int) -> str:
    """A value by kind of picture, for Spark and DuckDB alike."""
    return f"case vec_id % 8 {' '.join(f'when {k} then {v}' for k, v in enumerate(values))} end"


_T = "4 + vec_id % 4"
#: What a picture is drawn with: the art's bounds and the border's colours.
_DRAWN = (
    f"case vec_id % 8 when 4 then 0 when 7 then 20 else {_T} end as y0",
    f"case vec_id % 8 when 4 then {H} when 7 then 36 else {H} - ({_T}) end as y1",
    f"case vec_id % 8 when 4 then 0 when 6 then 0 when 7 then 16 else {_T} end as x0",
    f"case vec_id % 8 when 4 then {W} when 6 then {W} when 7 then 24 else {W} - ({_T}) end as x1",
    f"{_by_kind(10, 240, 170, 200, 0, 100, 20, 5)} as border_red",
    f"{_by_kind(10, 240, 170, 160, 0, 100, 20, 5)} as border_green",
    f"{_by_kind(10, 240, 172, 40, 0, 100, 20, 5)} as border_blue",
)


def _cell(plane: str, y: str, x: str, level: str) -> str:
    """The level of one cell; ``level`` takes a place of the vector from 0."""
    art = level.format(f"cast(({y} * 7 + {x} * 3 + {_SHIFTS[plane]}) % 64 as int)")
    return f"case when {y} >= y0 and {y} < y1 and {x} >= x0 and {x} < x1 then {art} when {y} >= 53 and vec_id % 3 = 0 then 255 * ({x} % 2) else border_{plane} end"


def _painted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Planes of rows (vec_id, g and what ``_DRAWN`` gives), by array indices and few rows at a time; -1 stands for a null level."""
    y, x = np.arange(H * W) // W, np.arange(H * W) % W
    art = {p: (y * 7 + x * 3 + s) % 64 for p, s in _SHIFTS.items()}
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            whole = {c: part[c].fill_null(-1).to_numpy(zero_copy_only=False) for c in part.schema.names if c not in ("vec_id", "g")}
            y0, y1, x0, x1 = (whole[c][:, None] for c in ("y0", "y1", "x0", "x1"))
            inside = (y >= y0) & (y < y1) & (x >= x0) & (x < x1)  # nowhere between bounds of -1
            print_ = (y >= 53) & (whole["small"] == 1)[:, None]
            levels = part["g"].flatten().fill_null(-1).to_numpy(zero_copy_only=False).reshape(-1, 64)
            planes = []
            for p in P.PLANES:
                cells = np.where(inside, levels[:, art[p]], np.where(print_, 255 * (x % 2), whole[f"border_{p}"][:, None])).astype(np.int32).ravel()
                missing = cells < 0
                planes.append(pa.ListArray.from_arrays(np.arange(part.num_rows + 1, dtype=np.int32) * (H * W), pa.array(cells, mask=missing if missing.any() else None)))
            yield pa.RecordBatch.from_arrays([part["vec_id"], *planes], names=["vec_id", *P.PLANES])


def pictures(i: Inputs) -> DataFrame:
    """(vec_id, red, green, blue): three planes of cells, row behind row."""
    drawn = i.embeddings.selectExpr("vec_id", f"transform(embedding, e -> {LEVEL.format('e')}) as g", *_DRAWN, "cast(vec_id % 3 = 0 as int) as small").where("size(g) = 64")
    wide = drawn.select("vec_id", "g", *[F.col(c).cast("int").alias(c) for c in drawn.columns[2:]])
    kind = wide.schema["vec_id"].dataType.simpleString()
    return wide.mapInArrow(_painted, f"vec_id {kind}, {', '.join(f'{p} array<int>' for p in P.PLANES)}")


#: Cells of all pictures in SQL.
CELLS = f"""d as (select vec_id, list_transform(embedding, lambda e: {LEVEL.format('e')}) as g, {', '.join(_DRAWN)}, unnest(range({H * W})) as k from embeddings where len(embedding) = 64),
p as (select *, k // {W} as y, k % {W} as x from d),
c as (select vec_id, y, x, {", ".join(f"{_cell(p, 'y', 'x', 'list_extract(g, {} + 1)')} as {p}" for p in P.PLANES)} from p)"""
#: Weights of a cosine transform of 8 x 8 cells; hash of a table ``f`` (id, j, level) of such fields.
HASHES = """w as (select k, j, cast(round(4096 * cos(pi() * (2 * (j // 8) + 1) * (k // 8) / 16)) * round(4096 * cos(pi() * (2 * (j % 8) + 1) * (k % 8) / 16)) as bigint) as w from range(64) a(k), range(64) b(j)),
q as (select id, k, sum(level * w) as d from f join w using (j) group by id, k),
m as (select id, median(d) as m from q group by id),
u as (select id, sum(case when d > m then cast(1 as hugeint) << cast(63 - k as hugeint) else 0 end) as u from q join m using (id) group by id),
h as (select id, cast(case when u >= 9223372036854775808 then u - 18446744073709551616 else u end as bigint) as h from u)"""


@query(
    "img_1_perceptual_hash",
    f"""with e as (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as j from embeddings where len(embedding) = 64), {CELLS},
f as (select concat('w', vec_id) as id, j, {LEVEL.format('x')} as level from e union all select concat('c', vec_id), (y - 24) * 8 + x - 16, red from c where y between 24 and 31 and x between 16 and 23), {HASHES}
select a.vec_id, b.h, g.h as crop from embeddings a join h b on b.id = concat('w', a.vec_id) join h g on g.id = concat('c', a.vec_id)""",
)
def _(i):
    """The vectors as fields of 8 x 8 levels, and a crop of the pictures."""
    levels = F.expr(f"transform(embedding, x -> {LEVEL.format('x')})")
    whole = i.embeddings.where("size(embedding) = 64").select("vec_id", P.perceptual_hash(levels, 8, 8, side=8).alias("h"))
    crop = pictures(i).select("vec_id", P.perceptual_hash(F.col("red"), H, W, (16 / W, 24 / H, 24 / W, 32 / H), side=8).alias("crop"))
    return whole.join(crop, "vec_id")


_BAND = " or ".join(f"(b = '{b}' and x >= {l} and x < {r} and y >= {t} and y < {e})" for b, (l, t, r, e) in BANDS.items())


@query(
    "img_5_border_color",
    f"""with {CELLS}, m as (select vec_id, b, avg(red) as r, avg(green) as g, avg(blue) as bl, stddev_pop(red) as dev from c, (values ('left'), ('right'), ('top'), ('bottom')) s(b) where {_BAND} group by 1, 2),
s as (select vec_id, avg(dev) filter (b in ('left', 'right')) < 18 or max(dev) filter (b = 'top') < 18 as calm, avg(r) as r, avg(g) as g, avg(bl) as b from m group by 1)
select vec_id, case when not calm then 'borderless' when (r + g + b) / 3 <= 60 then 'black' when (r + g + b) / 3 >= 210 then 'white' when (r + g + b) / 3 between 140 and 200 and greatest(r, g, b) - least(r, g, b) <= 20 then 'silver' end as border from s""",
)
def _(i):
    return P.border_color(pictures(i), "vec_id", W, BANDS)


def _lines_sql() -> str:
    down, across = P.line_places(W), P.line_places(H)
    listed = lambda places: ", ".join(map(str, places))
    return f"""l as (select vec_id, 'top' as side, x as line, y as j, {H} as reach, 10 as last, red, green, blue from c where x in ({listed(down)}) and y < 15
    union all select vec_id, 'bottom', x, {H - 1} - y, {H}, 10, red, green, blue from c where x in ({listed(down)}) and y > {H - 16}
    union all select vec_id, 'left', y, x, {W}, 7, red, green, blue from c where y in ({listed(across)}) and x < 12
    union all select vec_id, 'right', y, {W - 1} - x, {W}, 7, red, green, blue from c where y in ({listed(across)}) and x > {W - 13}),
o as (select vec_id, side, line, avg(red) as r, avg(green) as g, avg(blue) as b from l where j < 4 group by 1, 2, 3),
a as (select *, (red - r) * (red - r) + (green - g) * (green - g) + (blue - b) * (blue - b) > 784 as far from l join o using (vec_id, side, line)),
z as (select *, bool_and(far) over (partition by vec_id, side, line order by j rows between current row and 4 following) as lasting from a),
i as (select vec_id, side, line, reach, min(j) filter (lasting and j between 4 and last) as i from z group by 1, 2, 3, 4),
v as (select vec_id, side, line, max(reach) as reach, case when max(greatest(d1, d2, d3)) < 18 then any_value(i) end as i from (select vec_id, side, line, i.reach, i, stddev_pop(red) filter (j < i) as d1, stddev_pop(green) filter (j < i) as d2, stddev_pop(blue) filter (j < i) as d3 from i join l using (vec_id, side, line) group by 1, 2, 3, 4, 5) group by 1, 2, 3),
k as (select vec_id, side, avg(r) as r, avg(g) as g, avg(b) as b from o group by 1, 2),
e as (select vec_id, side, median(i) / any_value(reach) as inset from v group by 1, 2),
s as (select vec_id, side, inset, case when inset is not null then 'measured' when greatest(r, g, b) < 32 then 'indeterminate_black' else 'no_transition' end as call from e join k using (vec_id, side))"""


@query(
    "img_7_border_inset",
    f"""with {CELLS}, {_lines_sql()},
r as (select vec_id, {", ".join(f"max(inset) filter (side = '{s}') as {s}_inset, max(call) filter (side = '{s}') as {s}_call" for s in P.SIDES)},
    case when count(*) filter (call = 'indeterminate_black') >= 3 then 'indeterminate' when count(*) filter (call = 'measured') >= 2 then 'measured' else 'ambiguous' end as verdict, avg(inset) as mean, max(inset) - min(inset) as apart from s group by 1)
select * exclude (mean, apart), case when verdict = 'measured' and apart <= 0.1 then mean end as inset from r""",
)
def _(i):
    return P.inset(pictures(i), "vec_id", H, W)


_STRIP = "case when vec_id % 3 = 0 and k >= 8 * (vec_id % 17) and k < 8 * (vec_id % 17) + 64 then {glyph} + 3 * (k % 2) else {own} end"


@query(
    "img_10_symbol_windows",
    f"""with e as (select vec_id, list_transform(embedding, lambda x: {LEVEL.format('x')}) as g from embeddings where len(embedding) = 64),
y as (select cast(range as bigint) as s, g from range(9), e where vec_id = range % 8),
t as (select e.vec_id, list_transform(range(192), lambda k: {_STRIP.replace('vec_id', 'e.vec_id').format(glyph='y.g[cast(k - 8 * (e.vec_id % 17) as int) + 1]', own='e.g[cast((k * 11 + e.vec_id) % 64 as int) + 1]')}) as strip from e join y on y.s = e.vec_id // 3 % 8),
n as (select concat(vec_id, '/', o) as id, vec_id, strip[o * 8 + 1:o * 8 + 64] as win from t, range(17) r(o)),
f as (select id, unnest(win) as level, generate_subscripts(win, 1) - 1 as j from n union all select concat('glyph', s), unnest(g), generate_subscripts(g, 1) - 1 from y), {HASHES},
x as (select n.vec_id, h from n join h using (id)), l as (select s, h as glyph from y join h on id = concat('glyph', s)),
b as (select vec_id, c as candidate, (vec_id // 3 + c * (1 + vec_id % 4)) % 10 as s from e, range(3) r(c)),
g as (select vec_id, s, min(bit_count(xor(h, glyph))) as distance from (select distinct vec_id, s from b) join l using (s) join x using (vec_id) group by 1, 2),
r as (select *, row_number() over (partition by vec_id order by distance, s) as place, lead(distance) over (partition by vec_id order by distance, s) as next from g)
select vec_id, candidate, cast(distance as int) as distance from b join r using (vec_id, s) where place = 1 and distance <= 6 and (next is null or next - distance > 6)""",
)
def _(i):
    """Strips of 24 x 8 cells, a third of them with a set's glyph at some height; set 8 has the glyph of set 0, set 9 has none."""
    fields = i.embeddings.where("size(embedding) = 64").select("vec_id", F.expr(f"transform(embedding, x -> {LEVEL.format('x')})").alias("g"))
    sets = fields.where("vec_id < 8").select(F.explode(F.when(F.col("vec_id") == 0, F.array(F.lit(0), F.lit(8))).otherwise(F.array(F.col("vec_id").cast("int")))).alias("s"), F.col("g").alias("glyph"))
    strip = _STRIP.format(glyph="element_at(glyph, cast(k - 8 * (vec_id % 17) as int) + 1)", own="element_at(g, cast((k * 11 + vec_id) % 64 as int) + 1)")
    strips = fields.withColumn("s", F.expr("cast(vec_id div 3 % 8 as int)")).join(sets, "s").selectExpr("vec_id", f"transform(sequence(0, {STRIP_H * STRIP_W - 1}), k -> {strip}) as strip")
    size, step = P.symbol_windows(STRIP_H, STRIP_W)
    windows = strips.select("vec_id", P.window_hashes(F.col("strip"), STRIP_H, STRIP_W, size, step, side=8).alias("hashes"))
    code = F.expr("cast((vec_id div 3 + candidate * (1 + vec_id % 4)) % 10 as int)")
    candidates = i.embeddings.where("size(embedding) = 64").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("candidate")).withColumn("set_code", code).withColumn("candidate", F.col("candidate").cast("long"))
    glyphs = sets.select(F.col("s").alias("set_code"), P.perceptual_hash(F.col("glyph"), 8, 8, side=8).alias("glyph"))
    return P.symbol_matches(windows, candidates, glyphs, "vec_id")
