import pytest
from pyspark.sql import functions as F

from contactweave.operators import merging
from contactweave.sources import sinks


@pytest.mark.parametrize("n", [0, 1, 1_500_000])
def test_row_numbers_lose_no_row(spark, n):
    """Wide rows, a third of them with one key: every number from 1 once, in order."""
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.format_string("k%09d", (F.col("id") * 7919) % 1_000_003)).alias("k"), "id",
        *[F.sha2(F.concat(F.lit(str(i)), F.col("id").cast("string")), 256).alias(f"c{i}") for i in range(4)],
    )
    out = merging.row_numbers(df, ["k"])
    got = out.agg(F.count("*"), F.countDistinct("rn"), F.min("rn"), F.max("rn"), F.countDistinct("id")).first()
    assert tuple(got) == ((n, n, 1, n, n) if n else (0, 0, None, None, 0))
    if n > 1:
        hot = out.filter("k = 'hot'").agg(F.min("rn"), F.max("rn")).first()
        assert tuple(hot) == (1, n // 3)  # ties are numbered together
        parts = merging.fixed_split(df, 100_000, ["k"]).groupBy("part").count().collect()
        assert sum(r["count"] for r in parts) == n and max(r["count"] for r in parts) == 100_000
        sizes = [r["count"] for r in merging.even_split(df, 7, ["k"]).groupBy("part").count().collect()]
        assert sum(sizes) == n and len(sizes) == 7 and max(sizes) - min(sizes) <= 1


SCHEMA = (
    "id long, source_link string, business_name string, country_code string, emails array<string>, phones array<string>, whatsapp array<string>, social_facebook string, social_instagram string, "
    "social_tiktok string, social_youtube string, scrape_final_url string, scrape_was_redirected boolean, scrape_status string, scrape_error string, scrape_time_seconds double, scrape_pages_count int, "
    "last_scrape_server string, scrape_count int, updated_at timestamp_ntz"
)


def row(i, link, mails, name=None, facebook=None, status="success", n=0):
    return (i, link, name, "DE", mails, None, [], facebook, None, None, None, None, None, status, None, None, None, None, n, None)


def test_upsert_keeps_every_column_and_takes_the_latest(spark):
    old = spark.createDataFrame([row(1, "a", ["x"], "Old", "fb", n=4)], SCHEMA)
    new = spark.createDataFrame([row(2, "a", ["y"], "New"), row(3, "a", ["z"], "Newer", status="failed"), row(4, "b", None, "Only"), row(5, None, ["q"])], SCHEMA)
    got = {r["source_link"]: r for r in merging.upsert(old, new).collect()}
    assert set(got) == {"a", "b"} and set(old.columns) < set(got["a"].asDict())
    assert (got["a"]["business_name"], got["a"]["id"], got["a"]["emails"], got["a"]["scrape_status"], got["a"]["scrape_count"], got["a"]["social_facebook"]) == ("Old", 1, ["x", "z"], "failed", 5, "fb")
    assert (got["b"]["business_name"], got["b"]["id"], got["b"]["country_code"], got["b"]["emails_count"], got["b"]["scrape_count"]) == ("Only", 4, "DE", 0, 1)
    assert merging.upsert(old.limit(0), new.limit(0)).count() == 0


def test_generations_fold_as_they_were_merged(spark):
    rows = [row(1, "a", ["x", "y"], "One", "f1", n=2), row(2, "a", ["y", None, ""], "Two", None, "failed"), row(3, "a", ["w"], "Three", "f3"), row(4, "b", None, "B")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["source_link"]: r for r in merging.fold_generations(df, ["id"]).collect()}
    assert (got["a"]["emails"], got["a"]["business_name"], got["a"]["social_facebook"], got["a"]["scrape_status"], got["a"]["scrape_count"]) == (["x", "y", "w"], "One", "f3", "success", 4)
    step = merging.upsert(merging.upsert(df.filter("id = 1"), df.filter("id = 2")), df.filter("id = 3")).first()
    assert (step["emails"], step["scrape_count"], step["social_facebook"]) == (["x", "y", "w"], 4, "f3")
    assert got["b"]["emails"] == []


def test_merge_into_rewrites_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_contacts(spark.createDataFrame([row(i, f"l{i}", [f"m{i}"], f"N{i}") for i in range(200)], SCHEMA), path)
    before = {f.name: f.stat().st_mtime_ns for d in (tmp_path / "t").glob("partition_key=*") for f in d.glob("*.parquet")}
    sinks.merge_into(spark, path, spark.createDataFrame([row(900, "l7", ["z"], "X"), row(901, "new", ["n"], "Y")], SCHEMA), str(tmp_path / "s"))
    got = {r["source_link"]: r for r in spark.read.parquet(path).collect()}
    assert len(got) == 201 and got["l7"]["business_name"] == "N7" and got["l7"]["emails"] == ["m7", "z"] and got["new"]["business_name"] == "Y" and got["l8"]["country_code"] == "DE"
    after = {f.name for d in (tmp_path / "t").glob("partition_key=*") for f in d.glob("*.parquet")}
    assert len(set(before) & after) >= len(before) - 2
