"""Every registered query against its SQL on whole tables."""

import pytest
from check_oracles import compare, connect

from __spark_entry__ import entry, oracle_sql, queries
from foldline.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, con, sf, name):
    text, _, _, good = compare(spark, con, name, sf)
    assert good, text


BY_HAND = {"tokenize_subwords", "trunc_subwords", "segments_subwords", "label_spans_subwords"}  # tests/test_tokenisers.py


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) | BY_HAND and set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())


def test_entry_has_a_stable_schema(spark):
    assert entry(spark).columns == ["example_id", "seg_idx", "sim", "rank", "keep"]
