import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from contactweave.engine import Engine
from contactweave.operators import merging, postprocess, rates
from contactweave.sources import readers, sinks
from contactweave.streaming import jobs

OLD = "source_link string, emails array<string>, phones array<string>, whatsapp array<string>, social_facebook string, social_instagram string, social_tiktok string, social_youtube string, scrape_final_url string, scrape_was_redirected boolean, scrape_status string, scrape_error string, scrape_time_seconds double, scrape_pages_count int, last_scrape_server string, scrape_count int, updated_at timestamp_ntz"


def contact(link, mails, facebook=None, status="pending", n=0):
    return (link, mails, None, [], facebook, None, None, None, None, None, status, None, None, None, None, n, None)


def test_upsert(spark):
    old = spark.createDataFrame([contact("a", ["x", None, ""], "fb", n=2), contact("b", ["y"])], OLD)
    new = spark.createDataFrame([contact("a", ["z", "x"], None, "success"), contact("c", None, None, "failed")], OLD)
    got = {r["source_link"]: r for r in merging.upsert(old, new).collect()}
    assert got["a"]["emails"] == ["x", "z"] and got["a"]["emails_count"] == 2 and got["a"]["social_facebook"] == "fb"
    assert got["a"]["scrape_status"] == "success" and got["a"]["scrape_count"] == 3
    assert got["b"]["emails"] == ["y"] and got["c"]["emails_count"] == 0 and got["c"]["scrape_count"] == 1
    again = merging.upsert(spark.createDataFrame(old.rdd, OLD), new.limit(0))
    assert again.count() == 2


def test_keep_first_and_splits(spark):
    rows = [(i, f"n{i % 3}", None if i % 2 else "s") for i in range(20)]
    df = spark.createDataFrame(rows, "id long, name string, street string")
    kept = merging.keep_first(df, ["name", "street"], ["id"])
    assert sorted(r["id"] for r in kept.collect()) == [0, 1, 2, 3, 4, 5]
    assert merging.keep_first(kept, ["name", "street"], ["id"]).count() == 6
    sizes = [r["n"] for r in merging.even_split(df, 7, ["id"]).groupBy("part").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 20 and max(sizes) - min(sizes) <= 1 and len(sizes) == 7
    assert merging.even_split(df.limit(0), 3, ["id"]).count() == 0
    assert max(r["part"] for r in merging.fixed_split(df, 6, ["id"]).collect()) == 4
    parts = rates.packed_by_bytes(df.withColumn("line", F.repeat(F.lit("x"), 10)), "id", "line", 30).collect()
    by = {}
    for r in parts:
        by[r["part"]] = by.get(r["part"], 0) + 11
    assert max(by.values()) <= 30 and sum(by.values()) == 220


def test_trailing_and_average_against_brute_force(spark):
    random.seed(3)
    base = dt.datetime(2025, 1, 1, 23, 50)
    rows = [(i, "k" if i % 3 else "h", base + dt.timedelta(seconds=random.randrange(4000))) for i in range(120)] + [(999, "k", None)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz")
    got = {r["id"]: r["n_recent"] for r in rates.trailing_counts(df, "k", "ts", 180, chunk=600).collect()}
    live = [r for r in rows if r[2]]
    assert got == {i: sum(1 for j, k2, t2 in live if k2 == k and 0 <= (t - t2).total_seconds() <= 180) for i, k, t in live}
    cum = rates.cumulative_rates(df, "k", "ts", "id", chunk=600)
    ema = {r["id"]: (r["n_done"], r["smoothed"]) for r in rates.smoothed_rates(cum, "k", "ts", "id", chunk=600).collect()}
    for key in ("k", "h"):
        mine = sorted((t, i) for i, k, t in live if k == key)
        s = None
        for n, (t, i) in enumerate(mine, 1):
            rate = min(n / max((t - mine[0][0]).total_seconds() / 60, 1 / 60), 1000.0)
            s = rate if s is None else 0.2 * rate + 0.8 * s
            assert ema[i][0] == n and abs(ema[i][1] - s) < 1e-6


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('No,name,url,phone,Unnamed: 3\n1,"A, ""B""",https://a.example,+49,x\n2,C,,+1,y\n', encoding="utf-8")
    df = readers.read_listing(spark, [str(tmp_path / "a.csv")])
    assert [tuple(r) for r in df.select("name", "phone", "source_file").collect()] == [('A, "B"', "+49", "a.csv")]
    assert readers.is_readable_csv(spark, str(tmp_path / "a.csv")) and not readers.is_readable_csv(spark, str(tmp_path / "none.csv"))
    assert readers.header_of(spark, str(tmp_path / "a.csv"))[1] == "name"
    (tmp_path / "w.csv").write_bytes("name,url\nCafé Ål,https://w.example\n".encode("cp1252"))
    (tmp_path / "j.csv").write_bytes("name,url\n日本語の店,https://j.example\n".encode("shift_jis"))
    with pytest.warns(UserWarning):
        both = readers.read_listing(spark, [str(tmp_path / "w.csv"), str(tmp_path / "j.csv"), str(tmp_path / "none.csv")])
    assert {r["name"] for r in both.collect()} == {"Café Ål", "日本語の店"}
    (tmp_path / "p.txt").write_text("# c\n\n10.0.0.1:80\nhttp://u:p@h.example:81\nh.example:82:u2:p2\nbad\n10.0.0.1:99999\n")
    ends = {r["server"]: r for r in readers.parse_endpoints(readers.read_lines(spark, str(tmp_path / "p.txt"))).collect()}
    assert set(ends) == {"10.0.0.1:80", "h.example:81", "h.example:82"} and ends["h.example:82"]["password"] == "p2"
    (tmp_path / "x.html").write_bytes('<meta charset="cp1252">é'.encode("cp1252"))
    assert readers.read_pages(spark, str(tmp_path / "x.html")).first()["text"].endswith("é")
    files = spark.createDataFrame([("a.csv",), ("b.csv",)], "name string")
    done = spark.createDataFrame([("a_processed.csv",)], "name string")
    assert [r["name"] for r in readers.unprocessed(files, done).collect()] == ["b.csv"]
    sinks.write_marker(files, str(tmp_path / "m"), expected=3)
    assert readers.read_marker(spark, str(tmp_path / "m"))["status"] == "partial" and readers.read_marker(spark, str(tmp_path / "nope")) is None


def test_model_two(spark):
    df = spark.createDataFrame(
        [("T", "w.example", "+1", "cat", '{"street":"S 1","city":"","state":"St","country":"DE"}'), ("U", "", None, None, "{bad")],
        "title string, website string, phone string, category string, complete_address string",
    )
    a, b = postprocess.standard_listing(df).collect()
    assert (a["name"], a["url"], a["street"], a["city"], a["country_code"]) == ("T", "w.example", "S 1", "St", "DE")
    assert b["street"] == "" and b["phone_number"] == ""


def test_engine_and_table(spark, tmp_path):
    listings = spark.createDataFrame([("A", "http://shop.org", "s", "+1", ""), ("B", "https://www.facebook.com/b", "", "", ""), ("C", "", "", "", "")], "name string, url string, street string, phone_number string, facebook string")
    pages = spark.createDataFrame([("shop.org", '<a href="mailto:jo@shop.org">x</a> <a href="https://facebook.com/shop">f</a>')], "url string, html string")
    rows = {r["name"]: r for r in Engine(spark).enrich(listings, pages).collect()}
    assert rows["A"]["emails"] == ["jo@shop.org"] and rows["A"]["facebook"] == "https://facebook.com/shop" and rows["A"]["scraping_status"] == "success"
    assert rows["B"]["scraping_status"] == "skipped_social" and rows["C"]["scraping_status"] == "error"
    several = spark.createDataFrame(
        [(3, "shop.org", "<p>late@shop.org</p>", None), (1, "shop.org", '<a href="tel:0151 2345678">t</a><p>b@shop.org</p>', None), (2, "shop.org", None, "timeout")], "page_id long, url string, html string, fetch_error string"
    )
    r = Engine(spark).enrich(listings.filter("name = 'A'").withColumn("country_code", F.lit("DE")), several).first()
    assert r["emails"] == ["b@shop.org", "late@shop.org"] and r["phones"] == ["+491512345678"] and r["scraping_status"] == "success" and r["pages_scraped"] == 3
    out = postprocess.output_rows(Engine(spark).enrich(listings, pages.withColumn("html", F.concat("html", F.lit('<a href="https://wa.me/491512345678">w</a>')))), F.lit(1)).filter("name = 'A'").first()
    assert out["validated_emails"] == "jo@shop.org (reason:not_probed, conf:unknown, big:False)" and out["validated_emails_count"] == 1
    assert out["validated_whatsapp"] == "+491512345678 (valid:True, type:mobile, country:DE, reason:valid)" and out["validated_whatsapp_count"] == 1 and out["whatsapp_found"] == 1
    old = spark.createDataFrame([contact("a", ["x"])], OLD)
    sinks.write_contacts(old, str(tmp_path / "t"))
    sinks.merge_into(spark, str(tmp_path / "t"), spark.createDataFrame([contact("a", ["y"], None, "success")], OLD), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "t")).first()["emails"] == ["x", "y"]


def test_streams(spark, tmp_path):
    t = dt.datetime(2025, 1, 1, 10)
    rows = [("k", float(i), t + dt.timedelta(minutes=i), "success", 1) for i in range(6)]
    spark.createDataFrame(rows, "k string, v double, ts timestamp, scrape_status string, emails_count int").write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("k string, v double, ts timestamp, scrape_status string, emails_count int").parquet(str(tmp_path / "in"))
    ema = jobs.run_once(jobs.smoothed(read(), "k", "v", "ts"), "ema", str(tmp_path / "c1"))
    assert [round(r["smoothed"], 6) for r in ema.orderBy("ts").collect()] == [round(x, 6) for x in rates.ema_of([r[1] for r in rows], None, 0.2)]
    hours = jobs.run_once(jobs.hourly(read(), "ts"), "hours", str(tmp_path / "c2"), "complete")
    assert hours.first()["rows_processed"] == 6
    assert jobs.run_once(jobs.without_repeats(read(), "ts", ["k"]), "once", str(tmp_path / "c3")).count() >= 1
    assert jobs.run_once(jobs.rolling_rate(read(), "ts", "k"), "roll", str(tmp_path / "c4"), "complete").count() > 0


def test_sheet_width_follows_the_rows(spark):
    df = spark.createDataFrame([(1, "a@x.org; b@x.org; nan"), (2, "=cmd"), (3, None)], "id long, emails string")
    assert postprocess.sheet_export(df, ["id"]).columns == ["id", "email_1", "email_2"] and postprocess.sheet_export(df, ["id"], width=4).columns[-1] == "email_4"
    assert postprocess.sheet_export(df.limit(0), ["id"]).columns == ["id", "email_1"]


def test_turns_and_usable_endpoints(spark):
    jobs, ends = spark.createDataFrame([(i,) for i in range(7)], "id long"), spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "server string")
    got = {r["id"]: r["server"] for r in merging.round_robin(jobs, ["id"], ends, "server").collect()}
    assert [got[i] for i in range(7)] == list("abcabca")
    assert merging.round_robin(jobs, ["id"], ends.limit(0), "server").filter("server IS NULL").count() == 7
    assert {r["server"] for r in merging.still_usable(ends, ends.filter("server = 'a'"), "server").collect()} == {"b", "c"}
    assert merging.still_usable(ends, ends, "server").count() == 4


def test_prepared_contacts(spark):
    df = spark.createDataFrame(
        [("L1", "https://s.org", "T", "DE", "a@x.org; b@x.org", "true", "success", "3"), ("", "", "T2", "DE", None, None, None, None), ("L3", "u", None, "Malta", "", "no", None, "x")],
        "link string, url string, title string, country string, emails string, was_redirected string, status string, pages_scraped string",
    ).withColumn("pages_scraped", F.when(F.col("pages_scraped").rlike("^[0-9]+$"), F.col("pages_scraped")))
    a, b = sorted(merging.prepared_contacts(df).collect(), key=lambda r: r["source_link"])
    assert (a["emails"], a["emails_count"], a["country_name"], a["scrape_was_redirected"], a["scrape_status"], a["scrape_pages_count"], a["latitude"]) == (["a@x.org", "b@x.org"], 2, "Germany", True, "success", 3, None)
    assert (b["country_code"], b["country_name"], b["emails"], b["scrape_status"], b["scrape_was_redirected"]) == ("XX", "", [], "unknown", False)
    assert merging.prepared_contacts(df.limit(0)).count() == 0


def test_health_and_refresh(spark, tmp_path):
    t = dt.datetime(2025, 1, 1, 10)
    beat = lambda name, rows: spark.createDataFrame(rows, "server_id string, last_heartbeat timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / name))
    read = lambda: spark.readStream.schema("server_id string, last_heartbeat timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    beat("a", [("s1", t), ("s2", t)])
    beat("b", [("s1", t + dt.timedelta(minutes=30))])
    beat("c", [("s1", t + dt.timedelta(minutes=31))])
    got = jobs.run_once(jobs.server_health(read()), "health", str(tmp_path / "c")).collect()
    assert sorted((r["server_id"], r["health"]) for r in got) == [("s1", "healthy"), ("s2", "critical"), ("s2", "healthy")]
    count = lambda: spark.read.parquet(str(tmp_path / "in"), recursiveFileLookup=True).agg(F.count("*").alias("n"))
    q = jobs.refreshed(read(), count, str(tmp_path / "report"), str(tmp_path / "c2"), "1 second")
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "report")).first()["n"] == 4
