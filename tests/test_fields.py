"""Fields of levels against plain loops."""

import math
import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from lodeframe.operators import fields as P

SF = "/root/testdata/sf0.001"


def plain_hash(field, side):
    """Mean over a grid, cosine transform and median of a list of rows, cell by cell."""
    h, w = len(field), len(field[0])

    def grid(values, n):
        """``n`` sums over equal stretches, each value being as long as n of len(values) parts."""
        out = []
        for j in range(n):
            a, b = j * len(values), (j + 1) * len(values)
            out.append(sum(v * max(0, min(b, (i + 1) * n) - max(a, i * n)) for i, v in enumerate(values)) // math.gcd(len(values), n))
        return out

    rows = [grid(r, side) for r in field]
    cells = list(zip(*[grid(c, side) for c in zip(*rows, strict=True)], strict=True))
    c = [[round(4096 * math.cos(math.pi * (2 * x + 1) * u / (2 * side))) for x in range(side)] for u in range(8)]
    low = [sum(cells[y][x] * c[u][y] * c[v][x] for y in range(side) for x in range(side)) for u in range(8) for v in range(8)]
    middle = statistics.median(low)
    bits = sum(1 << (63 - k) for k, d in enumerate(low) if d > middle)
    assert h and w
    return bits - (1 << 64) if bits >> 63 else bits


@pytest.mark.parametrize("height,width,box,side", [(8, 8, (0, 0, 1, 1), 8), (20, 12, (0.1, 0.1, 0.9, 0.7), 8), (9, 7, (0, 0, 1, 1), 32), (30, 40, P.ART_BOX, 16)])
def test_hash_equals_a_plain_transform(spark, height, width, box, side):
    rng = random.Random(side)
    fields = [[rng.randrange(256) for _ in range(height * width)] for _ in range(6)] + [[7] * (height * width), None, [1, 2], [None] + [3] * (height * width - 1)]
    rows = spark.createDataFrame(list(enumerate(fields)), "k int, f array<int>")
    left, top, right, bottom = P.cells_of(box, height, width)
    crop = lambda f: [[f[y * width + x] for x in range(left, right)] for y in range(top, bottom)]
    found = {r.k: r.h for r in rows.select("k", P.perceptual_hash(F.col("f"), height, width, box, side).alias("h")).collect()}
    assert found == {k: plain_hash(crop(f), side) if k < 7 else None for k, f in enumerate(fields)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_vectors_as_fields(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: F.floor(128 + 400 * x.cast("double"))).alias("f"))
    for r in rows.withColumn("h", P.perceptual_hash(F.col("f"), 8, 8, side=8)).collect():
        assert r.h == plain_hash([list(r.f[8 * y : 8 * y + 8]) for y in range(8)], 8)


def test_empty_crops_raise():
    with pytest.raises(ValueError):
        P.perceptual_hash(F.col("f"), 8, 8, (0.5, 0.5, 0.51, 1.0))


def test_windows_ties_and_no_winner(spark):
    rng = random.Random(10)
    field = lambda n: [rng.randrange(256) for _ in range(n)]
    glyphs = {"a": field(64), "b": field(64)}
    glyphs["twin"] = glyphs["a"]
    strips = {}
    for k in range(12):
        strip = field(20 * 8)
        if k % 3:
            strip[8 * k : 8 * k + 64] = glyphs["ab"[k % 2]]
        strips[k] = strip
    strips[50], strips[51] = None, strips[1][:-1]
    windows = spark.createDataFrame(list(strips.items()), "k int, s array<int>").select("k", P.window_hashes(F.col("s"), 20, 8, 8, 1, side=8).alias("hashes"))
    hashed = {r.k: r.hashes for r in windows.collect()}
    own = lambda k, y: plain_hash([strips[k][8 * (y + r) : 8 * (y + r) + 8] for r in range(8)], 8)
    assert all(hashed[k] == [own(k, y) for y in range(13)] for k in range(12)) and hashed[50] is None and hashed[51] is None
    g = {s: plain_hash([f[8 * y : 8 * y + 8] for y in range(8)], 8) for s, f in glyphs.items()}
    table = spark.createDataFrame([*g.items(), ("none", None)], "set_code string, glyph long")

    def won(options):
        rows = [(k, c, s) for k in strips for c, s in options.items()]
        out = P.symbol_matches(windows, spark.createDataFrame(rows, "k int, candidate string, set_code string"), table, "k")
        return sorted((r.k, r.candidate, r.distance) for r in out.collect())

    def expected(options):
        out = []
        for k, s in strips.items():
            if hashed[k] is None:
                continue
            near = {code: min((h ^ g[code]).bit_count() if h >= 0 and g[code] >= 0 else ((h ^ g[code]) & (2**64 - 1)).bit_count() for h in hashed[k]) for code in set(options.values()) & set(g)}
            ranked = sorted(near.items(), key=lambda x: (x[1], x[0]))
            if ranked and ranked[0][1] <= 6 and (len(ranked) == 1 or ranked[1][1] - ranked[0][1] > 6):
                out += [(k, c, ranked[0][1]) for c, code in options.items() if code == ranked[0][0]]
        return sorted(out)

    plain = {"p1": "a", "p2": "b", "p3": "a", "p4": "none"}
    assert won(plain) == expected(plain) and {c for _, c, _ in won(plain)} == {"p1", "p2", "p3"}
    tied = {"p1": "a", "p2": "twin", "p3": "b"}
    assert won(tied) == expected(tied) and {c for _, c, _ in won(tied)} == {"p3"}
    assert won({"p1": "none"}) == []


def test_strip_shorter_than_a_window(spark):
    row = spark.range(1).select(P.window_hashes(F.array(*[F.lit(1)] * 32), 4, 8, 8, 1).alias("h")).first()
    assert list(row.h) == []


def picture(border, art, t=5, height=60, width=40, foot=None):
    """Rows of (r, g, b): art, a list of colours, inside a border of t cells; foot: colours of the lowest rows."""
    rng = random.Random(str((border, t)))
    cell = lambda y, x: foot[x % len(foot)] if foot and y >= height - 3 else border if y < t or y >= height - t or x < t or x >= width - t else rng.choice(art)
    return [[cell(y, x) for x in range(width)] for y in range(height)]


ART = [(200, 30, 40), (20, 220, 60), (90, 90, 250), (250, 250, 250), (0, 0, 0)]


def table(spark, cases):
    planes = lambda p, c: [x[c] for row in p for x in row] if p is not None else None
    return spark.createDataFrame([(k, *[planes(p, c) for c in range(3)]) for k, p in cases.items()], "k string, red array<int>, green array<int>, blue array<int>")


def cases():
    dark, light = [(0, 0, 0), (5, 5, 5)], [(255, 255, 255), (0, 0, 0)]
    out = {
        "black": picture((10, 10, 10), ART),
        "white": picture((240, 240, 240), ART),
        "silver": picture((170, 172, 168), ART),
        "gold": picture((200, 160, 40), ART),
        "grey": picture((100, 100, 100), ART),
        "borderless": picture((0, 0, 0), ART, t=0),
        "small print": picture((10, 10, 10), ART, foot=light),
        "thick": picture((30, 30, 200), ART, t=9),
        "all black": picture((3, 3, 3), dark, t=20),
        "all blue": picture((3, 3, 200), [(3, 3, 200)], t=20),
    }
    extended = picture((12, 12, 12), [(0, 0, 0), (40, 0, 0), (90, 10, 10)], t=6)
    rng = random.Random(2)
    out["extended art"] = [[rng.choice(dark + [(120, 0, 0)]) if 6 <= y < 54 and not 6 <= x < 34 else c for x, c in enumerate(row)] for y, row in enumerate(extended)]
    uneven = picture((10, 10, 10), ART)
    out["uneven"] = [[(10, 10, 10) if y < 11 else c for c in row] for y, row in enumerate(uneven)]
    return out


def plain_border(p, bands):
    stats = {}
    for name, (l, t, r, b) in bands.items():
        cells = [p[y][x] for y in range(t, b) for x in range(l, r)]
        stats[name] = [statistics.mean(c[k] for c in cells) for k in range(3)], statistics.pstdev([c[0] for c in cells])
    sides = [stats[b][1] for b in ("left", "right") if b in stats]
    if not sides and "top" not in stats:
        return None
    if not (sides and statistics.mean(sides) < 18) and not ("top" in stats and stats["top"][1] < 18):
        return "borderless"
    rgb = [statistics.mean(m[k] for m, _ in stats.values()) for k in range(3)]
    brightness = sum(rgb) / 3
    return "black" if brightness <= 60 else "white" if brightness >= 210 else "silver" if 140 <= brightness <= 200 and max(rgb) - min(rgb) <= 20 else None


@pytest.mark.parametrize("left_out", [(), ("top",), ("left", "right"), ("left", "right", "top"), ("bottom",)])
def test_border_colours(spark, left_out):
    bands = {b: c for b, c in P.border_bands(60, 40, thickness=4.0, least=1).items() if b not in left_out}
    found = {r.k: r.border for r in P.border_color(table(spark, {**cases(), "none": None}), "k", 40, bands).collect()}
    assert found == {k: plain_border(p, bands) for k, p in cases().items()} | {"none": None}
    if not left_out:
        assert set(found.values()) == {"black", "white", "silver", "borderless", None}
        assert found["extended art"] == "black" and found["small print"] == "black" and found["gold"] is None


def test_bands_in_cells():
    assert P.border_bands(880, 630) == {"left": (0, 109, 13, 770), "right": (616, 109, 630, 770), "top": (72, 0, 557, 14), "bottom": (72, 865, 557, 880)}
    assert P.border_bands(88, 63) == {}  # too few cells to mean anything


def plain_inset(p):
    h, w = len(p), len(p[0])
    out, insets = {}, []
    for side in P.SIDES:
        lines = {
            "top": [[p[y][x] for y in range(h)] for x in P.line_places(w)],
            "bottom": [[p[h - 1 - y][x] for y in range(h)] for x in P.line_places(w)],
            "left": [p[y] for y in P.line_places(h)],
            "right": [p[y][::-1] for y in P.line_places(h)],
        }[side]
        reach = h if side in ("top", "bottom") else w
        cap, found, edges = int(reach * 0.2), [], []
        for line in lines:
            outer = [statistics.mean(c[k] for c in line[:4]) for k in range(3)]
            edges.append(outer)
            for i in range(4, min(cap, reach - 5)):
                if all(sum((c[k] - outer[k]) ** 2 for k in range(3)) > 28**2 for c in line[i : i + 5]):
                    if all(statistics.pstdev([c[k] for c in line[:i]]) < 18 for k in range(3)):
                        found.append(i)
                    break
        dark = max(statistics.mean(e[k] for e in edges) for k in range(3)) < 32
        inset = statistics.median(found) / reach if found else None
        out[side] = inset, "measured" if found else "indeterminate_black" if dark else "no_transition"
        insets += [inset] if found else []
    calls = [c for _, c in out.values()]
    verdict = "indeterminate" if calls.count("indeterminate_black") >= 3 else "measured" if calls.count("measured") >= 2 else "ambiguous"
    agreed = verdict == "measured" and max(insets) - min(insets) <= 0.1
    return out, verdict, sum(insets) / len(insets) if agreed else None


def test_insets(spark):
    found = {r.k: r for r in P.inset(table(spark, {**cases(), "small": [[(1, 2, 3)] * 4] * 4, "none": None}), "k", 60, 40).collect()}
    for k, p in cases().items():
        sides, verdict, inset = plain_inset(p)
        assert {s: (found[k][f"{s}_inset"], found[k][f"{s}_call"]) for s in P.SIDES} == sides, k
        assert found[k].verdict == verdict and found[k].inset == pytest.approx(inset), k
    assert {r.verdict for r in found.values()} == {"measured", "indeterminate", "ambiguous", None}
    assert all(v is None for k in ("small", "none") for v in list(found[k])[1:])
    assert found["uneven"].verdict == "measured" and found["uneven"].top_inset != found["uneven"].left_inset
