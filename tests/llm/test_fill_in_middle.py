import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lodeframe.llm import fill_in_middle as M

from .helpers import docs


def brute(i, text):
    """n, form, lengths and output by lists of code points."""
    units = list(text or "")
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    whole = "".join(units)
    if not units or any(m in whole for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, whole
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def fixture():
    rng = random.Random(13)
    pieces = ["a", "é", "é", "日本", "\U0001f600", "\n", "\r\n", "<", ">", "<P", "S>", "<M", "P>", "\x00", " ", "ß"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    return rows + [(400, None), (401, ""), (None, "no id here"), (-5, "negative id"), (402, "has <M> in it"), (7, "twice"), (7, "twice"), (403, "x")]


def test_rows_equal_brute_force_and_are_restored(spark):
    rows = fixture()
    out = M.transformed(docs(spark, rows)).withColumn("back", M.restored(F.col("output"), F.col("form")))
    found = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect()), key=str)
    assert found == sorted(((i, t or "", *brute(i, t)) for i, t in rows), key=str)
    assert {r[3] for r in found} == {"plain", "psm", "spm"}
    assert out.where("not (back <=> text)").count() == 0


def test_other_units(spark):
    """Words with the space behind them; what is before the first or behind the last unit stays with prefix or suffix."""
    rows = [(i, f"  one two, three{' four' * i} \n") for i in range(60)]
    out = M.transformed(docs(spark, rows), unit=r"\w+\W*", plain=100, spm=50)
    forms = set()
    for r in out.withColumn("back", M.restored(F.col("output"), F.col("form"))).collect():
        text = r.text
        ends = [0, *(m.end() for m in re.finditer(r"\w+\W*", text))]
        assert r.n == len(ends) - 1 and r.back == text and r.prefix_chars in ends and r.prefix_chars + r.middle_chars in ends
        forms.add(r.form)
    assert forms == {"psm", "spm"}
    with pytest.raises(ValueError):
        M.transformed(docs(spark, rows), unit="x*")


def test_very_long_text_clashing_columns_and_empty_table(spark):
    long = "é日" * 1_500_000
    table = docs(spark, [(1, long), (2, None)]).selectExpr("doc_id", "text", "7 as N", "8 as output", "9 as key")
    out = M.transformed(table)
    assert out.columns == ["doc_id", "text", "N", "output", "key", "n_", "form", "prefix_chars", "middle_chars", "output_"]
    row = out.where("doc_id = 1").withColumn("same", M.restored(F.col("output_"), F.col("form")) == F.col("text")).drop("text").first()
    assert (row.n_, row.N, row.output, row.key, row.same) == (3_000_000, 7, 8, 9, True)
    assert brute(1, long) == (row.n_, row.form, row.prefix_chars, row.middle_chars, row.output_)
    assert M.transformed(docs(spark, [])).count() == 0


def test_passes_hold_no_units():
    """Both passes take matches one by one."""

    class Seen:
        alive = most = 0

        def __init__(self, k):
            self.k = k
            Seen.alive += 1
            Seen.most = max(Seen.most, Seen.alive)

        def __del__(self):
            Seen.alive -= 1

        def end(self):
            return self.k + 1

    assert M.counted(Seen(k) for k in range(10_000)) == 10_000
    matches = (Seen(k) for k in range(10_000))
    assert M.end_of(matches, 7_000, 0) == 7_000 and M.end_of(matches, 0, 7_000) == 7_000 and M.end_of(matches, 1_000, 7_000) == 8_000
    assert Seen.most <= 3
