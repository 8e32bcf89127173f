"""Batches applied to stored tables: same content as a rebuild, and only touched partitions written."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from echotide.operators import aggregates, churn, dashboards, drilldown
from echotide.operators.enrich import enrich
from echotide.plans import incremental
from echotide.sources.review_files import latest_per_review
from echotide.streaming import review_stream
from echotide.tables import read_table

STAGED = ("review_id string, user_name string, content string, score int, thumbs_up int, review_created_version string, "
          "at_ts timestamp_ntz, app_version string, category_raw string, source string")


def review(key, user, day, score=1, version="1.0", content="payment failed again, I will uninstall"):
    at = None if day is None else datetime.datetime(2024, 1, day, 8)
    return key, user, content, score, 2, "1.0", at, version, "login", "s"


FIRST = [review(f"a{i}", f"u{i % 7}", 1 + i % 12, 1 + i % 5, f"1.{i % 3}") for i in range(60)] + [
    review("moves", "mover", 3), review("only", "solo", 20, version="9.0"), review("newest", "u1", 25, version="2.0"),
    review("older", "u1", 5, version="2.0"), review("nobody", None, 4), review("nowhen", "u2", None), review(None, "u3", 6),
    review("calm", "calm", 8, 5, content="Great app, love it"), review("calm2", "calm", 9, 5, content="Great app, love it"),
]
SECOND = [
    review("moves", "mover", 9, 5, content="Great, love it"),       # another day
    review("only", "solo", 21, version="9.0"),                      # its old day keeps no review
    review("newest", "u1", 5, version="1.0"),                       # the newest day of version 2.0 loses its last review
    review("calm", "calm", 8, 1), review("nowhen", "u2", 7), review("nobody", None, None), review(None, "u3", 6), review("fresh", None, 8),
    review("fresh2", "new user", 2), review("fresh2", "new user", 3),
]
THIRD = [review("calm", None, 8, 1)]


def frame(spark, data):
    return spark.createDataFrame(data, STAGED)


def files(root, name):
    """Files of each partition."""
    found = {}
    for folder, _, names in os.walk(os.path.join(root, name)):
        parquet = {n for n in names if n.endswith(".parquet")}
        if parquet:
            found[os.path.relpath(folder, os.path.join(root, name))] = parquet
    return found


def expected(spark, batches):
    """All batches at once, by brute force: the last row of each key."""
    current = {}
    for batch in batches:
        found = latest_per_review(frame(spark, batch)).collect()
        current.update({r["review_id"]: r for r in found})
    schema = latest_per_review(frame(spark, [])).schema
    return enrich(spark.createDataFrame(list(current.values()), schema))


def same_tables(spark, root, batches):
    wanted = expected(spark, batches).cache()
    plain = [c for c in wanted.columns if c != "processed_at"]
    users = churn.user_churn(wanted)
    found = incremental.read_reviews(spark, root)
    assert rows(found.select(plain)) == rows(wanted.select(plain))
    assert rows(found.select("review_id", "churn_user_score", "churn_user_tier")) == rows(
        churn.with_churn(wanted, users).select("review_id", "churn_user_score", "churn_user_tier"))
    assert rows(incremental.read_reviews(spark, root, "reviews_raw").select("review_id", "content")) == rows(
        latest_per_review(frame(spark, [r for b in batches for r in b])).select("review_id", F.col("content"))
        .join(found.select("review_id", F.col("content").alias("tidy")), "review_id").select("review_id", "tidy"))
    assert rows(incremental.churn_table(spark, root)) == rows(users)
    daily = dashboards.daily_aggregates(wanted).filter("day is not null")
    stored = read_table(spark, root, "daily_aggregates")
    assert rows(stored) == rows(daily.select(stored.columns))
    versions = aggregates.version_kpis(wanted).filter("app_version is not null")
    stored = read_table(spark, root, "version_aggregates")
    assert rows(stored) == rows(versions.select(stored.columns))
    assert rows(drilldown.listed_options(incremental.facets(spark, root))) == rows(drilldown.filter_options(wanted))
    wanted.unpersist()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    incremental.apply_batch(spark, root, 0, frame(spark, FIRST), buckets=2)
    return root


def test_batches_equal_a_rebuild_and_touch_little(spark, stored):
    same_tables(spark, stored, [FIRST])
    before = files(stored, "reviews_enriched"), files(stored, "reviews_raw")
    places = {r.review_id: r for r in incremental.read_log(spark, stored, "review_places").collect()}
    homes = {r.review_id: r.user_name for r in incremental.read_reviews(spark, stored).collect()}

    incremental.apply_batch(spark, stored, 1, frame(spark, SECOND), buckets=2)
    same_tables(spark, stored, [FIRST, SECOND])
    after = files(stored, "reviews_enriched"), files(stored, "reviews_raw")
    now = {r.review_id: r for r in incremental.read_log(spark, stored, "review_places").where("batch = 1").collect()}
    folder = lambda r: f"day={r.day or '__HIVE_DEFAULT_PARTITION__'}/bucket={r.bucket}"
    keys = {r[0] for r in SECOND if r[0]}
    moved = {folder(places[k]) for k in keys if k in places} | {folder(r) for r in now.values()}
    users = {r[1] for r in SECOND if r[0] and r[1]} | {homes[k] for k in keys if k in homes}
    theirs = {folder(places[k]) for k, user in homes.items() if user in users}
    for part, names in before[1].items():
        assert (after[1][part] == names) == (part not in moved), part
    for part, names in before[0].items():
        if part not in moved | theirs:
            assert after[0][part] == names, part
    assert any(part not in moved for part in before[0])
    versions = {r.app_version: r for r in read_table(spark, stored, "version_aggregates").collect()}
    assert versions["2.0"].last_seen_day == datetime.date(2024, 1, 5)

    incremental.apply_batch(spark, stored, 2, frame(spark, THIRD), buckets=2)
    same_tables(spark, stored, [FIRST, SECOND, THIRD])
    names = files(stored, "reviews_enriched")
    incremental.apply_batch(spark, stored, 2, frame(spark, FIRST), buckets=2)  # known by its number
    assert files(stored, "reviews_enriched") == names
    with pytest.raises(ValueError, match="older"):
        incremental.apply_batch(spark, stored, 1, frame(spark, FIRST), buckets=2)


def test_totals_and_facets_open_no_review(spark, stored):
    for table in (incremental.facets, incremental.daily_table, incremental.version_table):
        assert {f.split("/")[-3] for f in table(spark, stored).inputFiles()} <= {"review_state", "high_days"}


@pytest.mark.parametrize("step", ["_high_days", "_rewrite_reviews"])
def test_a_failed_batch_is_applied_again(spark, tmp_path, monkeypatch, step):
    root = str(tmp_path / "tables")
    incremental.apply_batch(spark, root, 0, frame(spark, FIRST[::3]), buckets=1)
    real = getattr(incremental, step)

    def fail(*args):
        if step == "_rewrite_reviews":
            real(*args)
        raise OSError("executor lost")

    monkeypatch.setattr(incremental, step, fail)
    with pytest.raises(OSError):
        incremental.apply_batch(spark, root, 1, frame(spark, SECOND), buckets=1)
    monkeypatch.setattr(incremental, step, real)
    incremental.apply_batch(spark, root, 1, frame(spark, SECOND), buckets=1)
    same_tables(spark, root, [FIRST[::3], SECOND])


def test_empty_batches(spark, tmp_path):
    root = str(tmp_path / "tables")
    incremental.apply_batch(spark, root, 0, frame(spark, []))
    assert incremental.read_reviews(spark, root).count() == 0
    incremental.apply_batch(spark, root, 1, frame(spark, FIRST[:3]), buckets=1)
    incremental.apply_batch(spark, root, 2, frame(spark, [review(None, "u", 3)]), buckets=1)
    same_tables(spark, root, [FIRST[:3]])


def test_stream_keeps_tables(spark, tmp_path):
    folder, root, checkpoint = tmp_path / "in", str(tmp_path / "tables"), str(tmp_path / "cp")
    folder.mkdir()
    header = "reviewId,userName,content,score,thumbsUpCount,reviewCreatedVersion,at,appVersion,category"
    follow = lambda: review_stream.keep_tables(
        spark, str(folder), header.split(","), root, checkpoint, buckets=1).awaitTermination(120)
    (folder / "1.csv").write_text(f"{header}\na,u,one,1,0,1,2024-01-05,1,x\nb,u,two,2,0,1,2024-01-01,1,x\n")
    follow()
    (folder / "2.csv").write_text(f"{header}\na,u,replaced,3,0,1,2024-01-02,1,x\n")
    follow()
    follow()
    assert {(r.review_id, r.content, str(r.day)) for r in incremental.read_reviews(spark, root).collect()} == {
        ("a", "replaced", "2024-01-02"), ("b", "two", "2024-01-01")}
    assert sorted(str(r.day) for r in read_table(spark, root, "daily_aggregates").collect()) == ["2024-01-01", "2024-01-02"]


def test_the_plan_of_a_partition_test_does_not_grow_with_days(spark):
    days = [datetime.date(2000, 1, 1) + datetime.timedelta(i) for i in range(3000)]
    parts = [(d, i % 2) for i, d in enumerate(days)] + [(days[1], 0), (None, 1)]
    every = [(d, b) for d in [*days[:6], days[-1], datetime.date(1999, 1, 1), None] for b in (0, 1, 2)]
    kept = spark.createDataFrame(every, "day date, bucket int").where(incremental.in_parts(parts))
    assert {tuple(r) for r in kept.collect()} == set(every) & set(parts)
    assert kept.where(~incremental.in_parts(parts)).count() == 0
    tree = kept._jdf.queryExecution().optimizedPlan().treeString()
    assert tree.count(" OR ") <= 4
    assert spark.createDataFrame(every, "day date, bucket int").where(incremental.in_parts([])).count() == 0
