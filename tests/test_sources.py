"""Review files: headers, casts, deduplication, merging, streaming and exports."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import SMALL, rows
from echotide import schemas, tables
from echotide.operators.merge import upsert
from echotide.plans.pipeline import ingest_files
from echotide.sources import exports, review_files, taxonomy
from echotide.sources.event_reviews import event_reviews
from echotide.streaming import review_stream

HEADER = "reviewId,userName,content,score,thumbsUpCount,reviewCreatedVersion,at,appVersion,category"
OTHER = "ID,User,Review Text,Star-Rating,helpful_count,Review Version,Created At,Version,Topic"


def write(folder, name, header, *lines):
    path = folder / name
    path.write_text("\n".join([header, *lines]) + "\n", encoding="utf-8")
    return str(path)


@pytest.fixture
def files(tmp_path):
    one = write(
        tmp_path, "one.csv", HEADER,
        'a,ann,"two\nlines, ""quoted""",4.5,1e1,1.0,2024-01-02 03:04:05,1.0,Login',
        " b ,, padded ,abc, 7 ,,2024-1-2 3:04,,", ",nokey,x,1,1,1,2024-01-01,1,x",
    )
    two = write(
        tmp_path, "two.csv", OTHER,
        "a,ann,newer,2,0,1.0,2024-02-01,1.1,Crash", "b,bob,undated,3,0,1.0,not a date,1.1,x", "c,cy,only,,,,,,",
    )
    return {"one": one, "two": two}


def read(spark, files):
    return ingest_files(spark, files, quoted_newlines=True)


def test_cast_and_dedupe(spark, files):
    staged = read(spark, files)
    first = staged.filter("source = 'one' and review_id = 'a'").first()
    assert (first["content"], first["score"], first["thumbs_up"]) == ('two\nlines, "quoted"', 5, 10)
    assert first["at_ts"] == dt.datetime(2024, 1, 2, 3, 4, 5)
    kept = {r["review_id"]: r for r in review_files.latest_per_review(staged).collect()}
    assert set(kept) == {"a", "b", "c"}
    assert kept["a"]["content"] == "newer"
    assert (kept["b"]["content"], kept["b"]["score"], kept["b"]["thumbs_up"]) == ("padded", None, 7)
    assert kept["b"]["at_ts"] == dt.datetime(2024, 1, 2, 3, 4)
    counters = dict(rows(review_files.ingest_counters(staged, list(files))))
    assert counters == {"loaded:one": 3, "loaded:two": 3, "combined": 6, "deduped_out": 3, "inserted": 3}


def test_times_do_not_depend_on_the_session_zone(spark):
    cases = {"2024-03-10 02:30:00": dt.datetime(2024, 3, 10, 2, 30), "2024-11-03 01:30": dt.datetime(2024, 11, 3, 1, 30),
             "2024-1-5": dt.datetime(2024, 1, 5), "2024-01-05T01:02:03": None, "2024-02-30": None, "": None,
             "2024-01-05 01:02:03.5": None}
    frame = spark.createDataFrame([(c,) for c in cases], "t string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        found = {r[0]: r[1] for r in frame.select("t", review_files.to_timestamp(F.col("t"))).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert found == cases


def test_header_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="score, app_version"):
        review_files.resolve_headers(["id", "user", "text", "helpful_count", "reviewversion", "date", "topic"])
    with pytest.raises(FileNotFoundError):
        review_files.scan_csv(spark, str(tmp_path / "absent.csv"))
    # The later of two headers that read alike is used, and the first alias wins over later ones.
    found = review_files.resolve_headers(HEADER.split(",") + ["review_id", "date"])
    assert (found["review_id"], found["at_ts"]) == ("review_id", "at")


def test_repeated_headers(spark, tmp_path):
    header = "reviewId,score,userName,content,SCORE,thumbsUpCount,reviewCreatedVersion,at,appVersion,category,,score"
    for name, lines in (("1.csv", ["a,1,u,one,2,0,1,2024-01-05,1,x,?,3"]), ("2.csv", ['b,1,u,"two, too",2,0,1,2024-01-05,1,x,?,4'])):
        write(tmp_path, name, header, *lines)
    for quoted in (True, False):
        found = review_files.typed_reviews(review_files.scan_csv(spark, str(tmp_path), quoted)).collect()
        assert sorted((r["review_id"], r["content"], r["score"]) for r in found) == [("a", "one", 3), ("b", "two, too", 4)]
    assert review_files.column_names(["A b", None, "a_B", "", "c"]) == ["_c0", "_c1", "a_B", "_c3", "c"]
    wide = [*HEADER.split(","), "Rating", "id"]
    assert review_files.resolve_headers(wide)["score"] == "score" and review_files.resolve_headers(wide)["review_id"] == "reviewId"


def test_equal_times_and_hot_key_are_settled_before_the_shuffle(spark):
    hot = event_reviews(spark, SMALL)
    plan = review_files.latest_per_review(hot)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2
    tie = spark.createDataFrame(
        [("k", 1, "b"), ("k", 5, "a"), ("k", 5, "c")], "review_id string, score int, content string"
    ).selectExpr(
        "review_id", "'u' user_name", "content", "score", "0 thumbs_up", "'1' review_created_version",
        "timestamp_ntz'2024-01-01' at_ts", "'1' app_version", "'x' category_raw",
    )
    assert [r["content"] for r in review_files.latest_per_review(tie).collect()] == ["c"]


def test_upsert_replaces_and_keeps(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([(3, "b"), (4, "c"), (5, None)], "v int, k string")
    assert rows(upsert(old, new, "k")) == [("a", 1), ("b", 3), ("c", 4)]


def test_taxonomy_rules(tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps({" Login ": " Sign in ", "a": " ", "b": 3, "__fallback__": "", "  ": "x"}))
    assert taxonomy.load_taxonomy(str(path)) == {"__fallback__": "Other", "login": "Sign in", "a": "Other"}
    with pytest.raises(ValueError):
        taxonomy.clean_taxonomy(["login"])


def test_tables_are_empty_only_before_the_first_run(spark, tmp_path):
    for name in schemas.TABLES:
        assert tables.read_table(spark, None, name).count() == 0
        with pytest.raises(FileNotFoundError):
            tables.read_table(spark, str(tmp_path / "typo"), name)
    spark.range(1).write.parquet(str(tmp_path / "reviews_raw"))
    with pytest.raises(ValueError, match="lacks columns"):
        tables.read_table(spark, str(tmp_path), "reviews_raw")


def test_numbers_with_suffixes_or_hexadecimals_are_null(spark):
    frame = spark.createDataFrame([(v,) for v in ("5d", "5f", "4.5D", "0x1p3", "NaN", "Infinity", " 4.5 ", "1e1", ".5", "-3")], "t string")
    found = [r[0] for r in frame.select(review_files.to_int(F.col("t"))).collect()]
    assert found == [None] * 6 + [5, 10, 1, -3]


def test_other_separators(spark, tmp_path):
    path = write(tmp_path, "semi.csv", HEADER.replace(",", ";"), "a;u;one, two;1;0;1;2024-01-05;1;x")
    assert ingest_files(spark, {"s": path}, quoted_newlines=False, sep=";").first()["content"] == "one, two"


def test_exports(spark, tmp_path):
    frame = spark.createDataFrame([(1, '  a "b"\nc  ', None)], "id int, t string, n string")
    assert exports.export_csv(frame, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.first()["t"] == '  a "b"\nc  '
    assert not exports.export_csv(frame.limit(0), str(tmp_path / "none"))
    assert not os.path.exists(tmp_path / "none")
    exports.export_json(frame, str(tmp_path / "json"))
    assert '"n":null' in "".join(p.read_text() for p in (tmp_path / "json").glob("*.json"))


def test_stream_follows_new_files(spark, tmp_path):
    folder, log, checkpoint = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "cp")
    folder.mkdir()
    write(folder, "1.csv", HEADER, "a,u,one,1,0,1,2024-01-05,1,x", "b,u,two,2,0,1,2024-01-01,1,x")
    follow = lambda: review_stream.follow_review_files(
        spark, str(folder), HEADER.split(","), log, checkpoint).awaitTermination(120)
    follow()
    write(folder, "2.csv", HEADER, "a,u,replaced,3,0,1,2024-01-02,1,x")
    follow()
    follow()
    current = {r["review_id"]: r["content"] for r in review_stream.current_reviews(spark, log).collect()}
    assert current == {"a": "replaced", "b": "two"}


def test_staging_follows_changed_input(spark, tmp_path):
    source = str(tmp_path / "events.parquet")
    load = lambda: tables.stage(spark, source, "probe", lambda: spark.read.parquet(source)).count()
    spark.range(3).write.parquet(source)
    assert (load(), load()) == (3, 3)
    spark.range(5).write.mode("overwrite").parquet(source)
    assert load() == 5
