import json

from pyspark.sql import functions as F

from contactweave import cli
from contactweave.sources import readers, sinks


def test_batch_merge_report_and_table(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "build_session", lambda app: spark)
    (tmp_path / "a.csv").write_text("name,url,street,phone\nA,shop.org,S 1,+4930123456\nB,none.org,S 2,\nA,shop.org,S 1,\n", encoding="utf-8")
    (tmp_path / "b.csv").write_bytes("name,url,city\nCafé Ü,café.org,Köln\nD,shop.org,\n".encode("cp1252"))
    pages = [("shop.org", '<p>jo@shop.org</p><a href="https://wa.me/491512345678">w</a>'), ("none.org", "<p>nothing</p>")]
    spark.createDataFrame(pages, "url string, html string").write.parquet(str(tmp_path / "pages"))
    out = str(tmp_path / "out")
    args = ["batch", str(tmp_path / "a.csv"), str(tmp_path / "b.csv"), "--pages", str(tmp_path / "pages"), "--out", out, "--dedupe", "--merge", "--report", "--output-format", "wide", "--max-contacts", "2", "--workers", "9"]
    assert cli.main(args) == 0
    first = spark.read.csv(f"{out}/file0/processed", header=True, escape='"').orderBy("No").collect()
    assert [(r["No"], r["name"], r["scraping_status"]) for r in first] == [("1", "A", "success"), ("2", "B", "no_contacts_found")]
    merged = spark.read.csv(f"{out}/merged", header=True, escape='"')
    assert merged.count() == 4 and {r["name"] for r in merged.collect()} == {"A", "B", "Café Ü", "D"}
    assert "email_2" in spark.read.csv(f"{out}/merged_results/wide", header=True).columns
    assert readers.read_marker(spark, f"{out}/file0/marker")["status"] == "complete"
    said = capsys.readouterr().out
    assert "total_rows: 4" in said and "files: 2" in said and "rows_with_contacts: 2" in said


def test_source_table_into_contact_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "build_session", lambda app: spark)
    rec = lambda link, site, title, country="DE": json.dumps({"link": link, "web_site": site, "title": title, "complete_address": {"country": country, "city": "Köln"}})
    rows = [(1, rec("L1", "shop.org", "A")), (2, rec("L2", "none.org", "B")), (3, rec("L3", "shop.org", "C", "FR")), (4, "{broken"), (5, rec("", "x.org", "D"))]
    spark.createDataFrame(rows, "id long, data string").write.parquet(str(tmp_path / "results"))
    spark.createDataFrame([("shop.org", "<p>jo@shop.org</p>")], "url string, html string").write.parquet(str(tmp_path / "pages"))
    run = lambda n, *more: cli.main(["single", "--source", str(tmp_path / "results"), "--table", str(tmp_path / "table"), "--pages", str(tmp_path / "pages"), "--out", str(tmp_path / f"o{n}"), "--server-id", "s1", *more])
    assert run(1, "--country", "de", "--limit", "1") == 0
    assert [r["source_link"] for r in spark.read.parquet(str(tmp_path / "table")).collect()] == ["L1"]
    assert run(2) == 0
    got = {r["source_link"]: r for r in spark.read.parquet(str(tmp_path / "table")).collect()}
    assert set(got) == {"L1", "L2", "L3"} and got["L1"]["emails"] == ["jo@shop.org"] and got["L1"]["scrape_count"] == 1 and got["L3"]["country_name"] == "France" and got["L2"]["scrape_status"] == "no_contacts_found"


def test_single_result_has_thirteen_columns(spark, tmp_path):
    row = spark.range(1).select(*[F.lit("x").alias(c) for c in sinks.SINGLE_COLUMNS], F.lit(1).alias("more"))
    sinks.write_single(row, str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s"), header=True).columns == list(sinks.SINGLE_COLUMNS) and len(sinks.SINGLE_COLUMNS) == 13
