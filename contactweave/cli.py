"""Command line: python -m contactweave.cli single|batch|url ..."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactweave.engine import Engine
from contactweave.operators import merging, postprocess
from contactweave.session import build_session
from contactweave.sources import readers, sinks

#: Options of fetching programs that say nothing about data; they are taken and have no effect.
FETCH_OPTIONS = (
    "workers", "timeout", "batch-size", "cf-wait-timeout", "proxy-file", "normal-budget", "challenge-budget", "dead-site-budget", "min-retry-threshold", "batch-size-dsn",
)
FETCH_FLAGS = ("light-load", "no-light-load", "disable-resources", "skip-on-challenge", "no-report")
log = logging.getLogger("contactweave")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="contactweave", description="Enrich listings with contacts from fetched pages.")
    sub = p.add_subparsers(dest="command", required=True)
    for name, what in (("single", "one listing file, or the source table"), ("batch", "several listing files"), ("url", "one address")):
        s = sub.add_parser(name, help=what)
        s.add_argument("input", nargs={"batch": "+", "single": "?", "url": None}[name])
        s.add_argument("--pages", required=True, help="fetched pages (parquet: url, html, ...)")
        s.add_argument("--out", "--output-dir", "--output", dest="out", required=True)
        s.add_argument("--limit", "--limit-dsn", dest="limit", type=int, default=0, help="first rows only, for a trial")
        s.add_argument("--fast", action="store_true", help="four addresses, one phone, one messenger number")
        s.add_argument("--dedupe", action="store_true")
        s.add_argument("--dedup-by", nargs="+", metavar="COLUMN", help="columns that tell rows apart (default: found by their names)")
        s.add_argument("--output-format", choices=("wide", "long"), default="long")
        s.add_argument("--wide", action="store_true", help="the same as --output-format wide")
        s.add_argument("--report", action="store_true")
        s.add_argument("--max-contacts", type=int, default=10)
        s.add_argument("--chunk-size", type=int, default=0, help="rows per output file")
        s.add_argument("--encoding", help="of the listing files (default: found in each)")
        s.add_argument("--country", help="only rows of this country code")
        s.add_argument("--source", "--dsn", dest="source", help="source table (parquet path or jdbc:...) instead of files")
        s.add_argument("--table", "--export-db", dest="table", help="contact table to merge the result into; rows it holds are skipped with --source")
        s.add_argument("--server-id", default="unknown")
        s.add_argument("--log-level", choices=("DEBUG", "INFO", "WARNING", "ERROR"), default="INFO")
        if name == "batch":
            s.add_argument("--merge", action="store_true", help="one merged result of all files beside one per file")
            s.add_argument("--merge-strategy", choices=("union", "intersection"), default="union")
        for o in FETCH_OPTIONS:
            s.add_argument(f"--{o}", help=argparse.SUPPRESS)
        for o in FETCH_FLAGS:
            s.add_argument(f"--{o}", action="store_true", help=argparse.SUPPRESS)
    return p


def listing_of(spark: SparkSession, a: argparse.Namespace, path: str | None) -> DataFrame:
    """Listing rows in the order of their source (`__i`), filtered and cut as asked for."""
    if a.source:
        rows = readers.parse_results(readers.read_table(spark, a.source, "results"))
        if a.table and readers.table_there(spark, a.table):
            done = spark.read.parquet(a.table).select(F.col("source_link").alias("link")).distinct()
            rows = rows.join(done, "link", "left_anti")
        rows = rows.select("*", F.col("title").alias("name"), F.col("country").alias("country_code"), F.col("phone").alias("phone_number"), F.col("category").alias("google_business_categories"), F.col("result_id").alias("__i"))
    else:
        source = readers.single_url(spark, path) if a.command == "url" else readers.read_listing(spark, path, a.encoding)
        rows = postprocess.standard_listing(source).withColumn("__i", F.monotonically_increasing_id())
    if a.country:
        rows = rows.filter(F.upper(F.substring(F.trim("country_code"), 1, 2)) == a.country.upper())
    return rows.orderBy("__i").limit(a.limit) if a.limit else rows


def process(spark: SparkSession, a: argparse.Namespace, path: str | None, out: str) -> DataFrame:
    """Enrich one source into `out`; returns the processed rows as written."""
    engine = Engine(spark)
    rows = engine.enrich(listing_of(spark, a, path), spark.read.parquet(a.pages), fast=a.fast)
    if a.dedupe or a.dedup_by:
        rows = engine.dedupe(rows, a.dedup_by or merging.dedupe_columns(rows.columns), ["__i"])
    numbered = merging.row_numbers(rows, ["__i"])
    sinks.write_listing(postprocess.output_rows(numbered, numbered["rn"]), f"{out}/processed", a.chunk_size or None)
    done = spark.read.csv(f"{out}/processed", header=True, escape='"')
    sinks.write_marker(done, f"{out}/marker", expected=numbered.count())
    if a.table:
        ready = merging.prepared_contacts(numbered.withColumn("server_id", F.lit(a.server_id)))
        if readers.table_there(spark, a.table):
            sinks.merge_into(spark, a.table, ready, f"{out}/staged")
        else:
            sinks.write_contacts(merging.latest_per_key(ready, "source_link", ["scrape_pages_count", "business_name"]), a.table)
    finish(a, done, out)
    return done


def finish(a: argparse.Namespace, done: DataFrame, out: str) -> None:
    """Wide form and reports of processed rows."""
    if a.wide or a.output_format == "wide":
        sinks.export_csv(postprocess.wide_form(done, a.max_contacts), f"{out}/wide")
    if a.report:
        print(sinks.write_report(postprocess.report(done), f"{out}/report"))
        if a.wide or a.output_format == "wide":
            print(sinks.write_report(postprocess.wide_report(done, a.max_contacts), f"{out}/wide_report"))


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=a.log_level)
    if a.command == "single" and not a.input and not a.source:
        raise SystemExit("single needs a listing file or --source")
    idle = [o for o in (*FETCH_OPTIONS, *FETCH_FLAGS) if getattr(a, o.replace("-", "_"))]
    if idle:
        log.info("pages are read, not fetched; without effect: %s", ", ".join(idle))
    spark = build_session("contactweave-cli")
    if a.command != "batch":
        process(spark, a, a.input, a.out)
        return 0
    parts = {path: process(spark, a, path, f"{a.out}/file{i}") for i, path in enumerate(a.input)}
    named = [df.withColumn("source_file", F.lit(path.rsplit("/", 1)[-1])) for path, df in parts.items()]
    if a.report:
        per_file = postprocess.file_stats(merging.union_all(named), "source_file")
        print(sinks.write_report(postprocess.overall_stats(per_file), f"{a.out}/overall"))
    if a.merge:
        merged = merging.union_all(named) if a.merge_strategy == "union" else merging.union_common(named)
        sinks.export_csv(merged, f"{a.out}/merged")
        finish(a, spark.read.csv(f"{a.out}/merged", header=True, escape='"'), f"{a.out}/merged_results")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
