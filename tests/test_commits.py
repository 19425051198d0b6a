"""The commit log: who wins between two writers, what readers see, and how much stays on disk."""

import threading
from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strata.plans import warehouse as plans
from strata.plans.commits import CommitLog, LogState, Published, WriteConflict
from strata.plans.warehouse import Warehouse

KEY = ("vid",)


def frame(spark, *rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "vid string, hours double, _row_pos bigint")


def held(wh, name="o.g"):
    return {r["vid"]: r["hours"] for r in wh.table(name).collect()}


def version_folders(wh, name="o/g"):
    return sorted(p.name for p in Path(f"{wh.root}/tables/{name}").iterdir())


def interleave(monkeypatch, writer, other):
    """`other` runs after `writer` has read the state and written its rows, right before it would publish."""
    commit = writer.log.commit

    def late(*args, **options):
        monkeypatch.setattr(writer.log, "commit", commit)
        other()
        return commit(*args, **options)

    monkeypatch.setattr(writer.log, "commit", late)


@pytest.mark.parametrize("loads", ["first upsert", "upsert", "publish", "publish_all"])
def test_of_two_writers_exactly_one_wins(spark, tmp_path, monkeypatch, loads):
    a, b = (Warehouse(spark, str(tmp_path / "wh"), catalog=False) for _ in range(2))
    if loads != "first upsert":
        a.upsert("o.g", frame(spark, ("x", 1.0)), KEY, parts=2)
    interleave(monkeypatch, a, lambda: b.upsert("o.g", frame(spark, ("x", 2.0), ("y", 2.0)), KEY, parts=2))
    with pytest.raises(WriteConflict, match="another writer"):
        if loads == "publish":
            a.publish("o.g", frame(spark, ("z", 3.0)).drop("_row_pos"))
        elif loads == "publish_all":
            a.publish_all({"o.h": (frame(spark, ("z", 3.0)), (), None)}, drop_others=True)
        else:
            a.upsert("o.g", frame(spark, ("x", 3.0), ("z", 3.0)), KEY, parts=2)
    assert held(a) == held(b) == {"x": 2.0, "y": 2.0} and a.tables() == ["o.g"]
    assert a.state("o.g") == b.state("o.g") == Warehouse(spark, a.root, catalog=False).state("o.g")
    # the loser's rows are not left behind, and its next try takes the winner's rows in
    assert len([v for v in version_folders(a) if v.startswith("v=")]) == (1 if loads == "first upsert" else 2)
    report = a.upsert("o.g", frame(spark, ("x", 3.0), ("z", 3.0)), KEY)
    assert (report.new, report.updated, report.total) == (1, 1, 3) and held(b) == {"x": 3.0, "y": 2.0, "z": 3.0}


def test_writers_of_different_tables_do_not_disturb_each_other(spark, tmp_path, monkeypatch):
    a, b = (Warehouse(spark, str(tmp_path / "wh"), catalog=False) for _ in range(2))
    interleave(monkeypatch, a, lambda: b.publish("o.other", frame(spark, ("q", 9.0))))
    a.upsert("o.g", frame(spark, ("x", 1.0)), KEY)
    assert a.tables() == b.tables() == ["o.g", "o.other"] and held(b) == {"x": 1.0}


def fake(version, *folders):
    return Published("o.t", version, folders or (f"v={version}",), (), "", version, "{}")


def test_the_log_stays_small_over_a_thousand_loads(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"), every=20)
    for n in range(1, 1001):
        state = log.commit(log.state(), [fake(n)], removed=[("o.t", f"v={n - 1}")] if n > 1 else [])
        assert state.number == n
    assert len(list((tmp_path / "log").glob("[0-9]*"))) <= 42
    fresh = CommitLog(spark, str(tmp_path / "log"), every=20)
    assert fresh.state().tables == {"o.t": fake(1000)} and fresh.state().number == 1000
    # what was superseded and removed is forgotten
    assert fresh.state().retired == ()


def test_a_writer_that_slept_through_checkpoints_is_refused(spark, tmp_path):
    slow, quick = (CommitLog(spark, str(tmp_path / "log"), every=3) for _ in range(2))
    base = slow.commit(slow.state(), [fake(1)])
    for n in range(2, 12):
        quick.commit(quick.state(), [fake(n)])
    frozen = slow._numbers
    seen = iter([([1], [])])  # its first listing is as old as its state
    slow._numbers = lambda: next(seen, None) or frozen()
    with pytest.raises(WriteConflict):
        slow.commit(base, [fake(2, "mine")])
    assert CommitLog(spark, str(tmp_path / "log")).state().tables["o.t"] == fake(11)


@pytest.mark.parametrize("local", [True, False])
def test_a_name_is_given_once(spark, tmp_path, monkeypatch, local):
    log = CommitLog(spark, str(tmp_path / "log"))
    if not local:  # the way of other file systems, which refuse the second name themselves
        monkeypatch.setattr("strata.plans.commits.os.link", lambda *_: pytest.fail("not the local way"))
        real = log.files._at

        def elsewhere(path):
            fs, at = real(path)
            return type("Fs", (), {"getScheme": lambda _: "other", "__getattr__": lambda _, name: getattr(fs, name)})(), at

        monkeypatch.setattr(log.files, "_at", elsewhere)
    assert log.files.create(f"{tmp_path}/one.json", "ä") and not log.files.create(f"{tmp_path}/one.json", "b")
    assert log.files.read(f"{tmp_path}/one.json") == "ä" and log.files.read(f"{tmp_path}/two.json") is None
    assert [n for n, _ in log.files.names(str(tmp_path)) if "one" in n] == ["one.json"] and log.files.names(f"{tmp_path}/nothing") == []


def test_threads_racing_for_numbers_lose_no_commit(spark, tmp_path):
    def load(name):
        log = CommitLog(spark, str(tmp_path / "log"), every=7)
        for n in range(1, 16):
            log.commit(log.state(), [Published(f"o.{name}", n, (f"v={n}",), (), "", n, "{}")])

    threads = [threading.Thread(target=load, args=(f"t{i}",)) for i in range(4)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    state = CommitLog(spark, str(tmp_path / "log")).state()
    assert state.number == 60 and {t.version for t in state.tables.values()} == {15}


def test_superseded_folders_stay_for_readers_and_then_go(spark, tmp_path):
    wh = Warehouse(spark, str(tmp_path / "wh"), catalog=False, checkpoint_every=4)
    for n in range(3):
        wh.publish("o.g", frame(spark, ("x", float(n))).drop("_row_pos"))
        if n == 0:
            early = wh.table("o.g")
    assert len(version_folders(wh)) == 3 and early.collect()[0]["hours"] == 0.0
    assert wh.clean_up() == 0 and len(version_folders(wh)) == 3
    assert wh.clean_up(timedelta(0)) == 2 and len(version_folders(wh)) == 1 and held(wh) == {"x": 2.0}
    brief = Warehouse(spark, wh.root, catalog=False, retain=timedelta(0), checkpoint_every=2)
    for n in range(6):
        brief.upsert("o.g", frame(spark, ("x", float(n)), ("y", 0.0)), KEY, parts=2)
    assert held(brief) == {"x": 5.0, "y": 0.0} and len(version_folders(brief)) <= 3


def test_an_upsert_is_one_join_and_counts_what_it_wrote(spark, tmp_path, monkeypatch):
    wh = Warehouse(spark, str(tmp_path / "wh"), catalog=False)
    cols = "vid string, hours double, _fetched_at timestamp, _row_pos bigint"

    def timed(*rows):
        return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "vid string, hours double, t string, _row_pos bigint").selectExpr(
            "vid", "hours", "CAST(t AS timestamp) AS _fetched_at", "_row_pos")

    wh.upsert("o.g", timed(("a", 1.0, "2024-01-02"), ("b", 1.0, "2024-01-02"), ("c", 1.0, "2024-01-05")), KEY, parts=1)
    plans_seen = []
    real = plans.merge
    monkeypatch.setattr(plans, "merge", lambda *a, **k: plans_seen.append(real(*a, **k)) or plans_seen[-1])
    report = wh.upsert("o.g", timed(("b", 2.0, "2024-01-03"), ("c", 2.0, "2024-01-03"), ("d", 2.0, "2024-01-03"), ("d", 3.0, "2024-01-04"), (None, 1.0, "2024-01-03")), KEY)
    assert (report.new, report.updated, report.stale, report.skipped_no_key, report.duplicates_in_file, report.total) == (1, 1, 1, 1, 1, 4)
    assert held(wh) == {"a": 1.0, "b": 2.0, "c": 1.0, "d": 3.0} and cols.split(",")[0] == "vid string"
    text = plans_seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join ") == 1 and "FullOuter" in text and set(wh.table("o.g").columns) == {"vid", "hours", "_fetched_at", "_source_file"}


def test_merge_equals_a_dictionary_also_where_old_rows_repeat(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), (None, 4)], "k string, v int")
    batch = spark.createDataFrame([("a", 10), ("c", 11)], "k string, v int")
    got = sorted(map(tuple, plans.merge(old, batch, ("k",), unique=False).collect()), key=repr)
    assert got == sorted([("a", 10, "updated"), ("b", 3, "kept"), ("c", 11, "new"), (None, 4, "kept"), (None, 4, "kept")], key=repr)
    odd = spark.createDataFrame([(float("nan"), 1), (-0.0, 2)], "k double, v int")
    got = plans.merge(odd, odd.withColumn("v", F.col("v") + 5).withColumn("k", F.col("k") + 0.0), ("k",))
    assert sorted((r["v"], r["_change"]) for r in got.collect()) == [(6, "updated"), (7, "updated")]


def test_states_add_up(spark):
    state = LogState().with_commit(1, {"at": "2024-01-01T00:00:00+00:00", "tables": [{**vars(fake(1)), "folders": ["a", "b"], "key": []}], "removed": []})
    state = state.with_commit(2, {"at": "2024-01-02T00:00:00+00:00", "tables": [{**vars(fake(2)), "folders": ["b", "c"], "key": []}], "removed": []})
    assert state.retired == (("o.t", "a", "2024-01-02T00:00:00+00:00"),) and state.tables["o.t"].folders == ("b", "c")
