"""Table functions for SQL: decks to lines, and names to candidate printings.

After ``register(spark, printings)``::

    SELECT * FROM deck_lines(TABLE(SELECT id, deck FROM decks))
    SELECT c.pk, k.* FROM cards c, LATERAL candidates_of(c.name) k

``deck_lines`` takes a table in Arrow batches, as lateral calls of Arrow functions are not to be had;
``candidates_of`` is a SQL function, so its lateral call becomes a join by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What ``deck_lines`` gives.
DECK_LINES = "id bigint, line int, quantity int, front string, back string"


class DeckLines:
    """Numbered lines of the decks of a table (id, deck) with quantity (1 by default), front and back (null without ``//`` or ``|``).

    Blank lines have no row, but a number; a null deck has no lines, lines of a null id keep it.
    """

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        lists = pc.split_pattern_regex(pc.fill_null(batch.column(1).cast(pa.string()), ""), r"\r?\n")
        owner = pc.list_parent_indices(lists)
        first = pc.subtract(lists.offsets, lists.offsets[0]).take(owner)
        number = pc.add(pc.subtract(pa.array(range(len(owner)), pa.int32()), first), 1)
        bare = pc.utf8_trim_whitespace(lists.flatten())
        filled = pc.not_equal(bare, "")
        bare, number, owner = bare.filter(filled), number.filter(filled), owner.filter(filled)
        parts = pc.extract_regex(bare, r"^(?:(?P<quantity>[0-9]{1,9})\s*[xX]?\s+)?(?P<rest>\S.*)$")
        quantity, rest = pc.struct_field(parts, "quantity"), pc.struct_field(parts, "rest")
        count = pc.cast(pc.if_else(pc.equal(quantity, ""), "1", quantity), pa.int32())
        faces = pc.extract_regex(rest, r"^(?P<front>.*?)\s*(?://|\|)\s*(?P<back>.*)$")
        back = pc.struct_field(faces, "back")
        yield pa.table({"id": batch.column(0).take(owner), "line": number, "quantity": count, "front": pc.coalesce(pc.struct_field(faces, "front"), rest), "back": pc.if_else(pc.equal(back, ""), None, back)})


def register(spark: SparkSession, printings: DataFrame | None = None) -> None:
    """Offer the functions to the session's SQL; ``candidates_of`` only with printings (pk, name, popularity)."""
    spark.udtf.register("deck_lines", F.arrow_udtf(DeckLines, returnType=DECK_LINES))
    if printings is not None:
        printings.select("pk", "name", "popularity").createOrReplaceTempView("known_printings")
        spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION candidates_of(wanted STRING) RETURNS TABLE (candidate BIGINT, popularity BIGINT) RETURN SELECT pk, popularity FROM known_printings WHERE name = wanted")
