import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contactweave.operators import quarantine as q

GOOD = '1,A,"5, X Road",B,DE,https://www.a-b.example/,+49 555 12345,,x,,'


def strict(line: str) -> tuple[bool, int]:
    """Brute force: does the record follow the grammar, and how many fields has it."""
    state, n = "start", 1
    for c in line:
        if state == "start":
            state = "quoted" if c == '"' else "start" if c == "," else "plain"
            n += c == ","
        elif state == "plain":
            if c == '"':
                return False, n
            if c == ",":
                state, n = "start", n + 1
        elif state == "quoted":
            state = "closed" if c == '"' else "quoted"
        else:
            if c == '"':
                state = "quoted"
            elif c == ",":
                state, n = "start", n + 1
            else:
                return False, n
    return state != "quoted", n


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='a",\n ', max_size=24), st.integers(1, 5))
def test_repair_agrees_with_brute_force(line, columns):
    clean, n = strict(line)
    quotes, delims, ops = q.repair(line, columns)
    assert (quotes == 0) == clean
    if clean:
        assert delims == abs(n - columns)
    assert len(ops) == quotes + delims


def rows(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "line_id long, raw_line string")


def reasons(spark, lines):
    got = q.rejects(q.error_parse(rows(spark, lines))).collect()
    out = {}
    for r in got:
        out.setdefault(r["line_id"], set()).add(r["reason"])
    return out


def test_reasons(spark):
    lines = [
        GOOD,
        GOOD.replace('"5, X Road"', '"5, X Road'),
        GOOD.replace('"5, X Road"', '"5, X"Road'),
        GOOD.replace("1,A", '1,A "B" C'),
        GOOD.replace(",B,", ","),
        GOOD + ",",
        GOOD.replace("https://www.a-b.example/", "a b").replace("+49 555 12345", "call us"),
        GOOD.replace("+49 555 12345", "+49 555-12345 ext. 12"),
        GOOD.replace('"5, X Road"', '"5, X\nRoad ""Y"""'),
        None,
        "",
    ]
    assert reasons(spark, lines) == {
        1: {"quoting"}, 2: {"quoting"}, 3: {"quoting"}, 4: {"column_count"}, 5: {"column_count"}, 6: {"url", "phone_number"}, 9: {"null_record"}, 10: {"column_count"},
    }


def test_loaded_values_and_clashing_columns(spark):
    df = rows(spark, [GOOD.replace("A", '"The ""A"""')]).withColumn("parse", F.lit(1)).withColumn("name", F.lit("clash"))
    got = q.loaded(q.error_parse(df)).first()
    assert got["name"] == 'The "A"' and got["street"] == "5, X Road" and got["phone_number"] == "+49 555 12345"


def test_long_and_empty_input(spark):
    long = '1,"' + "x, " * 200_000 + '",' + ",".join([""] * 9)
    assert reasons(spark, [long]) == {}
    assert reasons(spark, ['"' + "a," * 3000]) == {0: {"quoting"}}
    empty = spark.createDataFrame([], "line_id long, raw_line string")
    assert q.rejects(q.error_parse(empty)).count() == 0 and q.loaded(q.error_parse(empty)).count() == 0


@pytest.mark.parametrize(
    ("url", "ok"),
    [("http://a.example", True), ("//a.example", True), ("a.example/x y", True), ("http://", False), ("a b.example", False), ("x@a.example", False), ("ftp://a.example", False), ("https://.a.example", False), ("..", False), ("javascript:void(0)", False), ("a.example:8080/x", True)],
)
def test_web_address(spark, url, ok):
    assert spark.range(1).select(q.web_address_ok(F.lit(url)).alias("x")).first()["x"] is ok
