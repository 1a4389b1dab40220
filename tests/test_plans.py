"""Plan properties that keep the queries usable on large data."""

import contextlib
import io
import os

import pytest

from __spark_entry__ import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize(
    "name", ["extract_blocks", "tm_lookup", "anonymize", "restore_sentences", "script_profile", "apply_consent"]
)
def test_no_python_in_text_and_event_queries(spark, name):
    text = plan(queries()[name](spark, SF))
    assert "EvalPython" not in text and "InPandas" not in text


def test_history_limits_rows_before_the_shuffle(spark):
    text = plan(queries()["recent_history"](spark, SF))
    assert text.index("WindowGroupLimit") < text.index("Exchange") < text.rindex("WindowGroupLimit")


def test_metadata_columns_only(spark):
    text = plan(queries()["current_state"](spark, SF))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in text
    routed = plan(queries()["route_adapter"](spark, SF))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in routed


def test_filters_reach_the_scan(spark):
    from glossweave.catalog import derived as d

    text = plan(d.consent(spark, SF))
    assert "PushedFilters: [In(event_type, [error,signup])]" in text
