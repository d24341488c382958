import pytest

import __spark_entry__ as entry
from contactweave.llm import queries
from oracle import compare

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "p3_found": ["src_table", "rec_id", "ref_key"], "p4_found": ["listing_id_a", "listing_id_b"], "p5_found": ["page_id"], "p6_found": ["rec_id_a", "rec_id_b"],
    "p7_found": ["listing_id", "field_name"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.R.sql))
def test_equals_sql(spark, name):
    assert compare(spark, entry.queries()[name], queries.R.sql[name], SF) == ""


@pytest.mark.parametrize("name", sorted(queries.R.queries))
def test_columns(spark, name):
    df = entry.queries()[name](spark, SF)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = df.count()
    assert rows == df.distinct().count() if name != "p8_ids" else rows == spark.read.parquet(f"{SF}/documents.parquet").count()
