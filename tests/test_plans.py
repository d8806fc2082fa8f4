"""Plans: filters and columns reach the scan, no join is a product, and expressions stay in the JVM."""

import os
import re

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")

#: Queries that attach a single row (a total or a number of outcomes) to all rows.
ONE_ROW = {"agg_21_deviation", "agg_22_information_gain", "srt_3_page_with_total", "srt_3_sort_modes", "stm_2_conveyor_ledger", "dml_6_warmed_stats"}
#: Queries whose semantics need Python (similarity of texts, pictures, a Python data source).
PYTHON = {"str_11_fuzzy_alias", "str_12_similarity_ranking", "str_13_sequence_match", "str_18_window_recovery", "str_19_margin_recogniser", "drv_12_artist_candidates", "img_1_perceptual_hash", "img_4_picture_quality", "img_10_symbol_windows", "ver_11_engines_on_pictures", "udf_2_listing_source", "udtf_1_deck_lines_in_sql"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_are_pushed(spark):
    from lodeframe.plans import QUERIES

    text = plan(QUERIES["win_2_newest_three"](spark, SF))
    assert re.search(r"PushedFilters: \[.*Not\(EqualTo\(event_type,view\)\)", text)
    assert "props" not in re.search(r"ReadSchema: (\S+)", text)[1]
    text = plan(QUERIES["agg_1_contributions"](spark, SF))
    assert "p_name" not in text


def test_no_products_and_no_stray_python(spark):
    from lodeframe.plans import QUERIES

    for name, q in QUERIES.items():
        if name.startswith(("stm_1_", "stm_2_", "stm_4_", "stm_6_streamed", "win_7_streamed", "src_13_indexed", "src_14_reindexed", "src_1_scanned", "src_12_csv_files", "udf_2_", "drv_16_resumed", "drv_16_run", "drv_16_channel", "ext_tumbling")):
            continue  # these run streams or write to plan
        text = plan(q(spark, SF))
        assert name in ONE_ROW or not re.search("CartesianProduct|BroadcastNestedLoopJoin", text), name
        assert name in PYTHON or not re.search("ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroups", text), name


def test_every_broadcast_is_of_a_known_size(spark):
    """Hints stand only where a table has a fixed number of rows (one, or a list in the query)."""
    import pathlib

    import lodeframe

    allowed = {"now", "d.where(\"doc_id = 0\")", "one", "wanted", "k)"}
    for path in pathlib.Path(lodeframe.__file__).parent.glob("[!l]*/*.py"):
        for found in re.findall(r"broadcast\(([^\n]*)", path.read_text()):
            assert any(found.startswith(a) for a in allowed), (path, found)
