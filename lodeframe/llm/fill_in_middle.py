"""Fill-in-middle: texts cut at two units and put together anew, so that a model learns to fill gaps.

A text is read twice by a lazy iterator over the matches of a unit's pattern.  The first pass counts
the units, the second advances to the two ranks where the text is cut; no list of units is ever held,
so a text takes no more memory than itself.  Ranks and form come from a hash of the row's id alone.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum as X
from .scratch import free

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CODE_POINT = r"(?s)."


def counted(matches: Iterator) -> int:
    """How many matches an iterator has; none is kept."""
    n = count()
    deque(zip(matches, n), maxlen=0)
    return next(n)


def end_of(matches: Iterator, ahead: int, at: int) -> int:
    """Where the match so many ahead ends; ``at`` for none ahead."""
    return next(islice(matches, ahead - 1, ahead)).end() if ahead else at


def drawn(key: str) -> tuple[int, ...]:
    """Four unsigned 32-bit numbers of a key's sha256."""
    digest = hashlib.sha256(key.encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def cut(text: str, unit: re.Pattern, key: str, plain: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix and of the middle, output) of a text."""
    n = counted(unit.finditer(text))
    h1, h2, h3, h4 = drawn(key)
    if not text or h3 % 100 >= plain or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    matches = unit.finditer(text)
    a = end_of(matches, first, 0)
    b = end_of(matches, second - first, a)
    if h4 % 100 < spm:
        return n, "spm", a, b - a, "".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))
    return n, "psm", a, b - a, "".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))


def transformed(docs: DataFrame, unit: str = CODE_POINT, plain: int = 90, spm: int = 20, seed: str = "1") -> DataFrame:
    """docs with five columns more: n (units of the text), form, prefix_chars, middle_chars and output.

    unit: a pattern whose matches, from left to right, are what texts are cut behind; it must not
    match nothing.  ``plain`` of 100 rows are cut, ``spm`` of 100 of these begin with the suffix.  A
    null text counts as empty; an empty text, or one that holds a mark, stays plain, with null
    lengths.  Rows with equal ids are cut by equal numbers; a null id is the empty string.  Very long
    texts are cut whole; an empty table gives no rows.  Where docs has a column of one of these names,
    the new one gets an underscore behind.
    """
    if re.match(unit, "") or re.fullmatch(unit, ""):
        raise ValueError("a unit must not match nothing")
    names = free(docs.columns, "n", "form", "prefix_chars", "middle_chars", "output")
    docs = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    at_text, (key,) = docs.columns.index("text"), free([*docs.columns, *names], "key")
    keyed = docs.withColumn(key, F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(unit)
        for batch in X.slices(batches):
            rows = [cut(t.as_py(), pattern, k.as_py(), plain, spm) for t, k in zip(batch.column(at_text), batch.column(batch.num_columns - 1), strict=True)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            new = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*batch.schema.names[:-1], *names])

    schema = keyed.drop(key).schema
    for name, kind in zip(names, ("long", "string", "long", "long", "string"), strict=True):
        schema = schema.add(name, kind)
    return keyed.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of.

    A text that holds a mark is plain, and no two marks overlap, so the first of each kind is the one put in.
    """

    def pieces(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, len(first) + 1, 1 << 30)
        one = F.substring_index(body, second, 1)
        rest = F.substring(body, F.length(one) + len(second) + 1, F.lit(1 << 30))
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substring(rest, F.length(two) + len(MIDDLE) + 1, F.lit(1 << 30))

    prefix, suffix, middle = pieces(PREFIX, SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = pieces(SUFFIX, PREFIX)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(prefix, middle, suffix))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = transformed(docs)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
