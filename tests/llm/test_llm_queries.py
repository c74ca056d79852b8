import pytest

from tests.helpers import same
from textlathe.llm.queries import ORACLES, QUERIES

FOUND = {"p1_found": "row_id seg_no lang", "p3_found": "item_table item_key field unbroken", "p4_found": "group_id field record_id", "p5_found": "response_id defect", "p6_ids": "doc_id ids", "p7_found": "doc_id item_id", "p8_found": "doc_id pii_type pii_text"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    same(spark, name, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(FOUND))
def test_columns(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.columns == FOUND[name].split() and df.count() >= (0 if name == "p7_found" else 1)  # no item leaks into the smallest table
