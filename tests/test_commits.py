"""Appends as commits: seen whole or not at all, ids recorded once, only the divisions written to are opened."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tidewatch.session import scratch_path
from tidewatch.sources import commits as C

SCHEMA = "prediction_id string, as_of_date string, run string"


def _new(spark, ids, run, date="2020-01-05"):
    return spark.createDataFrame([(i, date, run) for i in ids], SCHEMA)


def _rows(spark, path):
    return sorted((r.prediction_id, r.run) for r in C.read(spark, path, SCHEMA).collect())


def test_lost_race_checks_the_winner_and_takes_the_next_number(spark, monkeypatch):
    """Another append takes the number between this one's write and its manifest."""
    path, real = scratch_path(spark, "ledger"), C.publish
    C.append(_new(spark, ["a"], "0"), path)

    def slow(session, where, manifest):
        monkeypatch.setattr(C, "publish", real)
        C.append(_new(spark, ["b", "c"], "winner"), path)
        return real(session, where, manifest)

    monkeypatch.setattr(C, "publish", slow)
    C.append(_new(spark, ["a", "b", "d"], "loser"), path)
    assert _rows(spark, path) == [("a", "0"), ("b", "winner"), ("c", "winner"), ("d", "loser")]
    assert [m.number for m in C.manifests(spark, path)] == [1, 2, 3]


def test_concurrent_appends_leave_one_record_each(spark):
    path = scratch_path(spark, "ledger")
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda k: C.append(_new(spark, ["a", "b", f"own{k}"], str(k)), path), range(3)))
    assert [i for i, _ in _rows(spark, path)] == ["a", "b", "own0", "own1", "own2"]


def test_killed_append_leaves_nothing_visible(spark, monkeypatch):
    path = scratch_path(spark, "ledger")
    C.append(_new(spark, ["a"], "1"), path)
    with monkeypatch.context() as m:
        m.setattr(C, "publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            C.append(_new(spark, ["b"], "killed"), path)
    assert _rows(spark, path) == [("a", "1")]
    C.append(_new(spark, ["b"], "2"), path)
    assert _rows(spark, path) == [("a", "1"), ("b", "2")]


def test_append_opens_only_its_divisions(spark, monkeypatch):
    """Commits of other months are not opened, and a commit of several months is read in the month at hand only."""
    path, opened, real = scratch_path(spark, "ledger"), [], C._open
    monkeypatch.setattr(C, "_open", lambda s, p, names, *rest: opened.append(names) or real(s, p, names, *rest))
    C.append(_new(spark, ["a"], "1", "2020-01-05").unionByName(_new(spark, ["b"], "1", "2020-02-05")), path)
    C.append(_new(spark, ["c"], "2", "2020-03-05"), path)
    assert opened == []
    C.append(_new(spark, ["a", "d"], "3", "2020-01-09"), path)
    first = C.manifests(spark, path)[0].commit
    assert opened == [[first]]
    scan = real(spark, path, [first], C.read(spark, path, SCHEMA).schema.add(C.MONTH, "string"), "json").filter(F.col(C.MONTH).isin(["2020-01"]))
    assert "PartitionFilters: [isnotnull(as_of_month" in scan._jdf.queryExecution().executedPlan().toString()
    assert [i for i, _ in _rows(spark, path)] == ["a", "b", "c", "d"]


def test_replayed_batch_reads_nothing_and_writes_nothing(spark, monkeypatch):
    path = scratch_path(spark, "ledger")
    C.append(_new(spark, ["a"], "1"), path, app="s", batch=7)
    monkeypatch.setattr(C, "_open", lambda *_: pytest.fail("a known batch opens no records"))
    C.append(_new(spark, ["a", "z"], "2"), path, app="s", batch=7)
    assert len(C.manifests(spark, path)) == 1


def test_missing_dates_empty_appends_and_empty_ledgers(spark):
    path = scratch_path(spark, "ledger")
    assert C.read(spark, path, SCHEMA).isEmpty()
    C.append(_new(spark, [], "0"), path)
    assert C.read(spark, path, SCHEMA).isEmpty()
    for run in "12":
        C.append(_new(spark, ["a", "b", "a"], run, None), path)
    assert _rows(spark, path) == [("a", "1"), ("b", "1")]
