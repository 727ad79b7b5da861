"""Results appended by runs that stop, start again and overlap."""

import pytest

from tessera.sources.runs import RunLog


def test_each_id_is_appended_once(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "run"), "id long, answer string", "id")
    rows = lambda *ids: spark.createDataFrame([(i, f"a{i}") for i in ids], "id long, answer string")
    assert log.read().count() == 0 and log.append(rows(1, 2, 2, 3)) == 3
    assert sorted(r["id"] for r in log.pending(rows(2, 3, 4)).collect()) == [4]
    # A run that is cut off halfway leaves a part that nobody reads.
    fails = spark.createDataFrame([(4, "x")], "id long, answer string").selectExpr("id", "raise_error('stopped') AS answer")
    with pytest.raises(Exception, match="stopped"):
        log.append(fails)
    again = RunLog(spark, str(tmp_path / "run"), "id long, answer string", "id")
    assert sorted(map(tuple, again.read().collect())) == [(1, "a1"), (2, "a2"), (3, "a3")]
    assert again.append(rows(3, 4, 5)) == 2 and again.append(rows(1, 5)) == 0
    assert sorted(map(tuple, log.read().collect())) == [(i, f"a{i}") for i in range(1, 6)]
    again.recover()
    assert again.recover() == [] and again.read().count() == 5


def test_two_writers(spark, tmp_path, monkeypatch):
    one, two = (RunLog(spark, str(tmp_path / "run"), "id long, answer string", "id") for _ in range(2))
    rows = spark.createDataFrame([(i, "a") for i in range(5)], "id long, answer string")
    publish, first = two.folder.publish, []

    def late(*args):
        if not first:
            first.append(one.append(rows.where("id < 3")))
        return publish(*args)

    monkeypatch.setattr(two.folder, "publish", late)
    assert two.append(rows) == 2 and first == [3]
    assert sorted(r["id"] for r in one.read().collect()) == list(range(5))
