import math
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from strata.functions.parsing import TYPES, blank_to_null, check_types, parse, strip
from strata.operators.cleaning import bad_value_counts, band_select, clean, clean_json, clean_report, read_clean, write_clean
from strata.sources.csv import scan_csv, validate_payloads
from strata.sources.json import scan_json
from strata.sources.parquet import parquet_glob, scan_clean
from tests.conftest import STAR_HEADER, gaps, stars_csv

TRAMS = {"open": "bool", "line": "int", "stop": "string", "since": "timestamp", "km": "float"}
TRAMS_CSV = ("since,stop,colour,line,km,open\n"
             "1999-12-31T23:59:00+02:00,\"Mill \"\"A\"\", north\",red,  12,0.75,TRUE\n"
             "soon,\tHarbour\t,,4b,1e-1,1\n"
             ",,blue,,far,perhaps\n"
             "2001-02-03,Park,green,-1,  ,0\n")


def _py(type_name, text):
    """What Python's own parsers say, None if they refuse."""
    try:
        if type_name == "timestamp":
            when = datetime.fromisoformat(text.replace("Z", "+00:00"))
            return when if when.tzinfo else when.replace(tzinfo=timezone.utc)
        if type_name == "bool":
            return {"true": True, "1": True, "false": False, "0": False}[text.lower()]
        return {"int": int, "float": float, "string": str}[type_name](text)
    except (ValueError, KeyError):
        return None


CASES = {
    "int": ["5", "+5", "-7", "12.5", "3L", "1_000", "1__0", "_1", "0x10", "1e3"],
    "float": ["1.5", "1.5d", "1.5f", ".5", "5.", "1e5", "nan", "-NaN", "inf", "-Infinity", "+inf", "0x1p3", "1_0.5", "1e", "."],
    "bool": ["True", "T", "yes", "1", "0", "FALSE", "n"],
    "timestamp": ["2022-01-05T00:00:00Z", "2022-01-05", "20220105", "2022-01-05T05", "2022-01-05 05:06", "2022-01-05T05:06+02:00",
                  "2022-01-05T050607.25-0330", "2022", "2022-01", "05:00", "garbage", "2022-13-01", "2022-01-05T05:06:07,5Z",
                  "2022-01-05T05:06:07.123456+00:00", "2022-02-30", "2022-01-05T25:00:00"],
}


@pytest.mark.parametrize("type_name", sorted(CASES))
def test_parsers_agree_with_python(spark, type_name):
    rows = spark.createDataFrame(list(enumerate(CASES[type_name])), "i int, s string")
    value = parse(blank_to_null(F.col("s")), type_name)
    if type_name == "timestamp":
        value = F.unix_micros(value)
    for row in rows.select("s", value.alias("v")).collect():
        want = _py(type_name, row["s"])
        if type_name == "timestamp" and want is not None:
            want = int(want.timestamp() * 1_000_000)
        if isinstance(want, float) and math.isnan(want):
            assert math.isnan(row["v"]), row
        else:
            assert row["v"] == want, row


def test_overflow_is_bad_not_fatal(spark):
    df = spark.createDataFrame([("99999999999999999999",)], "n string")
    row = clean(df, {"n": "int"}).first()
    assert row["n"] is None and row["_bad"] == ["n"]


def test_strip_takes_every_kind_of_white_space(spark):
    df = spark.createDataFrame([("   \x1c x y\t\r\n",)], "s string")
    assert df.select(strip(F.col("s"))).first()[0] == "x y"


def test_unknown_types_are_refused(spark):
    with pytest.raises(ValueError, match="unknown column types"):
        check_types(["decimal"])
    assert set(TYPES) == {"string", "bool", "int", "float", "timestamp"}


def test_csv_values_are_typed_or_counted(spark, lake):
    path = lake.land("city", "trams", "trams.csv", TRAMS_CSV)
    rows = clean(scan_csv(spark, str(path), list(TRAMS)), TRAMS)
    typed = {r["stop"]: (r["open"], r["line"], r["km"], r["since"] is not None) for r in rows.collect()}
    assert typed == {'Mill "A", north': (True, 12, 0.75, True), "Harbour": (True, None, 0.1, False), None: (None, None, None, False), "Park": (False, -1, None, True)}
    bad = {"open": 1, "line": 1, "stop": 0, "since": 1, "km": 1}
    assert bad_value_counts(rows, TRAMS).first().asDict() == {"rows_in": 4, "rows_out": 4, **{f"bad_{c}": n for c, n in bad.items()}}
    assert {r["column"]: r["bad"] for r in clean_report(rows, TRAMS).collect()} == {c: n for c, n in bad.items() if n}
    assert "colour" not in rows.columns


def test_each_file_follows_its_own_header(spark, lake):
    lake.land("demo", "ab", "one.csv", "a,b\n1,2\n")
    lake.land("demo", "ab", "two.csv", "﻿b,x,a\n4,9,3\n")
    rows = scan_csv(spark, f"{lake}/raw/demo/ab/*/*.csv", ["a", "b"])
    assert sorted((r["a"], r["b"]) for r in rows.collect()) == [("1", "2"), ("3", "4")]


def test_missing_column_fails_and_names_the_file(spark, lake):
    lake.land("demo", "ab", "one.csv", "a,b\n1,2\n")
    lake.land("demo", "ab", "two.csv", "a\n1\n")
    with pytest.raises(ValueError, match="two.csv.*b"):
        scan_csv(spark, f"{lake}/raw/demo/ab/*/*.csv", ["a", "b"])


def test_line_breaks_inside_quotes_and_short_rows(spark, lake):
    path = lake.land("demo", "q", "q.csv", 'a,b,c\n"x\ny","say ""hi""",3\n1\n1,2,3,4\n')
    rows = scan_csv(spark, str(path), ["a", "b", "c"]).orderBy("_row_pos").collect()
    assert [(r["a"], r["b"], r["c"]) for r in rows] == [("x\ny", 'say "hi"', "3"), ("1", None, None), ("1", "2", "3")]


def test_row_positions_follow_the_file_over_many_splits(spark, lake):
    path = lake.land("demo", "long", "long.csv", "n\n" + "".join(f"{i}\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = scan_csv(spark, str(path), ["n"])
        assert rows.rdd.getNumPartitions() > 4
        assert [int(r["n"]) for r in rows.orderBy("_row_pos").select("n").collect()] == list(range(20000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


JSON = {"vid": ("string", "vessel.id"), "hours": ("float", "gap.duration_hours"), "dark": ("bool", "gap.dark"),
        "start": ("timestamp", "start"), "n": ("int", "n")}


def test_json_flattening_null_missing_and_bad(spark, lake):
    path = lake.land("demo", "ev", "e.json", [
        {"start": "2022-01-01T00:00:00.000Z", "vessel": {"id": " A "}, "gap": {"duration_hours": "20", "dark": True}, "n": 20},
        {"start": "2022-01-02T00:00:00Z", "vessel": {"id": "B"}, "gap": {"duration_hours": None, "dark": False}, "n": 20.0},
        {"start": "garbage", "vessel": {"id": {"oops": 1}}, "gap": {"duration_hours": "abc"}},
        {"vessel": {}},
        {"vessel": {"id": True}, "gap": {"duration_hours": 1.5}, "n": "7"},
        {"vessel": {"id": 20.0}, "gap": []},
    ])
    rows = clean_json(scan_json(spark, str(path)), JSON).orderBy("_row_pos").collect()
    assert [(r["vid"], r["hours"], r["dark"], r["n"]) for r in rows] == [
        ("A", 20.0, True, 20), ("B", None, False, None), (None, None, None, None), (None, None, None, None),
        ("True", 1.5, None, 7), ("20.0", None, None, None)]
    counts = bad_value_counts(clean_json(scan_json(spark, str(path)), JSON), JSON).first()
    assert [counts[f"bad_{c}"] for c in JSON] == [1, 1, 0, 1, 1]
    assert counts["rows_in"] == counts["rows_out"] == 6


def test_json_must_be_a_list_of_objects(spark, lake):
    for i, bad in enumerate([{"not": "a list"}, [1, {"a": 2}], "{broken"]):
        path = lake.land("demo", "bad", f"{i}.json", bad)
        with pytest.raises(Exception, match="list of records"):
            scan_json(spark, str(path)).count()
    empty = lake.land("demo", "bad", "empty.json", [])
    assert scan_json(spark, str(empty)).count() == 0


def test_clean_files_mirror_raw_and_rerun_in_place(spark, lake):
    lake.land("city", "trams", "a.csv", TRAMS_CSV)
    lake.land("city", "trams", "a.txt", TRAMS_CSV.replace("Park", "Zoo"))
    rows = clean(scan_csv(spark, f"{lake}/raw/city/trams/*/a.[ct][sx][vt]", list(TRAMS)), TRAMS)
    types = {n: TYPES[t] for n, t in TRAMS.items()}
    for _ in range(2):
        target = write_clean(rows, str(lake), "city", "trams")
    back = read_clean(spark, str(lake), "city", "trams", types)
    assert back.count() == 8
    assert {(r["raw_file"], r["_source_file"]) for r in back.collect()} == {("a.csv", "a.parquet"), ("a.txt", "a.parquet")}
    only = clean(scan_csv(spark, f"{lake}/raw/city/trams/*/a.csv", list(TRAMS)), TRAMS).filter("stop = 'Park'")
    write_clean(only, str(lake), "city", "trams")
    assert read_clean(spark, str(lake), "city", "trams", types).groupBy("raw_file").count().orderBy("raw_file").collect()[0]["count"] == 1
    assert read_clean(spark, str(lake), "city", "trams", types).count() == 5
    scanned = scan_clean(spark, f"{target}/*/*")
    assert {"_file_row", "_file_name"} <= set(scanned.columns)
    assert spark.sql(f"SELECT count(*) AS n FROM {parquet_glob(target + '/*/*')}").first()["n"] == 5


def test_payloads_are_tables_only_with_the_key_column(spark, lake):
    lake.land("gaia", "nearby-stars", "good.csv", stars_csv((1, 5.0), (2, 6.0)))
    lake.land("gaia", "nearby-stars", "none.csv", "﻿" + STAR_HEADER + "\n")
    lake.land("gaia", "nearby-stars", "error.csv", "<?xml version='1.0'?>\n<error>source_id, unknown</error>\n")
    rows = validate_payloads(spark, f"{lake}/raw/gaia/nearby-stars/*/*.csv", "source_id").collect()
    got = {r["path"].split("/")[-1]: (r["ok"], r["rows"]) for r in rows}
    assert got == {"good.csv": (True, 2), "none.csv": (True, 0), "error.csv": (False, None)}
    assert [r["head"] for r in rows if not r["ok"]][0].startswith("<?xml")


def test_band_selection_is_half_open_and_checks_its_arguments(spark):
    df = spark.createDataFrame([(1, 50.0, 1.0), (2, 55.0, 1.0), (3, 60.0, 1.0), (4, 56.0, 5.6), (5, 58.0, 0.0)], "id int, p double, e double")
    assert [r["id"] for r in band_select(df, "p", 50.0, 60.0, "e").collect()] == [3, 2]
    assert [r["id"] for r in band_select(df, "p", 50.0, limit=2).collect()] == [3, 5]
    for bad in ({"lo": 5, "hi": 5}, {"lo": 5, "limit": 0}):
        with pytest.raises(ValueError):
            band_select(df, "p", **bad)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_paths_are_spelled_without_a_pattern_match(spark):
    """One, two and three slashes become three; what is no local path stays. It runs for every row of a file."""
    from strata.sources.files import normal_path

    said = {"file:/a/b": "file:///a/b", "file://a/b": "file:///a/b", "file:///a/b": "file:///a/b", "file:////a": "file:////a", "file:/": "file:///",
            "file://": "file:///", "hdfs://n/a": "hdfs://n/a", "file:a": "file:a", None: None}
    rows = spark.createDataFrame([(p,) for p in said], "path string").select("path", normal_path(F.col("path")).alias("normal"))
    assert {r["path"]: r["normal"] for r in rows.collect()} == said
    assert "regexp" not in plan_of(rows)


def test_lines_are_not_sorted_to_find_headers(spark, tmp_path):
    """Headers and split quotes come from a hash aggregation; a byte-order mark, blank lines first and names with odd letters make no difference."""
    from strata.sources.csv import csv_layouts

    for name, text in {"plain.csv": "a,b\n1,2\n", "marked.csv": "\ufeff\n \na,c\n1,2\n", "split lines+%.csv": 'a,b\n1,"x\ny"\n', "quoted.csv": 'a,b\n1,"x"\n',
                       "blank.csv": "\n\n"}.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    layouts = csv_layouts(spark, str(tmp_path))
    found = {r["path"].rpartition("/")[2]: (r["header"], r["multiline"]) for r in layouts.collect()}
    assert found == {"plain.csv": ("a,b", False), "marked.csv": ("a,c", False), "split lines+%.csv": ("a,b", True), "quoted.csv": ("a,b", False),
                     "blank.csv": (None, False)}
    assert "Sort" not in plan_of(layouts)


def test_lineage_is_named_per_file(spark, lake, warehouse):
    """The pattern match for a row's source file works on the list of files, below the join, not on every row."""
    from strata.plans.ingest import clean_files, new_files
    from strata.plans.registry import GAP_EVENTS

    lake.land("gfw", "gap-events", "a.b.json", gaps(("K", "2023-01-02", 3)), day="2023-01-02")
    rows = clean_files(spark, str(lake), GAP_EVENTS, new_files(spark, str(lake), warehouse, GAP_EVENTS))
    assert {(r["_source_file"], r["_path"]) for r in rows.collect()} == {("a.b.parquet", "2023-01-02/a.b.json")}
    plan = plan_of(rows)
    assert plan.index("regexp_replace") > plan.index("Join")


ODD = ["", " ", " 5", "5 ", "\x005", "5\x00", "\x00", "-0", "+0", "007", "9223372036854775807", "9223372036854775808", "5L", "1.0", "-0.0", "1.50", "12345678.5", "1.0E7", "1.0E10",
       "NaN", "Infinity", "-Infinity", "1.0d", "1.0f", "0x1.0p3", "٣", "+", "-", ".", "0000-01-01", "0001-01-01", "9999-12-31", "10000-01-01", "-001-01-01", "2022-1-005",
       "2022-01-5T", "2022-01-5\x00", "2022-01-05\n", "2023-02-29", "1582-10-10", "1500-02-28", "٢٠٢٢-01-05"]


@pytest.mark.parametrize("type_name", sorted(set(TYPES) - {"string", "bool"}))
def test_usual_spellings_have_the_value_that_parse_gives(spark, type_name):
    """What is read at once is read as after stripping and taking apart, in any time zone; odd spellings are left to that."""
    from strata.functions.parsing import usual

    texts = ODD + [c for cases in CASES.values() for c in cases]
    rows = spark.createDataFrame([(s,) for s in texts], "s string")
    quick, full = usual(F.col("s"), type_name), parse(blank_to_null(F.col("s")), type_name)
    shown = [F.unix_micros(c) if type_name == "timestamp" else c.cast("string") for c in (quick, full)]
    spark.conf.set("spark.sql.session.timeZone", "America/Lima")
    try:
        got = rows.select("s", shown[0].alias("quick"), shown[1].alias("full")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    read = [r for r in got if r["quick"] is not None]
    assert len(read) >= 5 and all(r["quick"] == r["full"] for r in read)


def test_long_rows_are_written_by_code_that_is_compiled(spark, lake, monkeypatch):
    """While clean rows are written, Spark's limit on a generated method is the JVM's; afterwards it is what it was."""
    from pyspark.sql import DataFrameWriter

    seen, name, write = [], "spark.sql.codegen.hugeMethodLimit", DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: (seen.append(int(spark.conf.get(name))), write(self, path))[1])
    path = lake.land("city", "trams", "a.csv", TRAMS_CSV)
    before = spark.conf.get(name)
    write_clean(clean(scan_csv(spark, str(path), list(TRAMS)), TRAMS), str(lake), "city", "trams")
    assert seen == [8000] and spark.conf.get(name) == before
