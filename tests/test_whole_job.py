import json

import __spark_entry__ as entry


def test_all_checked_addresses_keep_their_status(spark, tmp_path):
    many = {f"m{i}@x.example": {"valid": i % 2 == 0, "confidence": "low"} for i in range(10)}
    rows = [(1, json.dumps(many)), (2, '{"a@b.test": {"valid": false, "confidence": "high"}}'), (3, None), (4, "{}")]
    spark.createDataFrame(rows, "id long, emails_validated string").write.parquet(f"{tmp_path}/zen_contacts.parquet")
    got = {r["id"]: r for r in entry.queries()["wide_validated_all"](spark, str(tmp_path)).collect()}
    assert [(got[1][f"v_{i}"], got[1][f"v_{i}_status"]) for i in range(1, 11)] == [(f"m{i}@x.example", "invalid" if i % 2 else "valid") for i in range(10)]
    assert (got[2]["v_1"], got[2]["v_1_status"], got[2]["v_2"]) == ("a@b.test", "invalid", "")
    assert set(got) == {1, 2, 3, 4} and got[3]["v_1"] == got[4]["v_1"] == ""
