"""Streams that are stopped and go on: the same tables as in one run, with late rows beside their windows."""

from datetime import datetime, timedelta

import pytest

from evalspark.streaming import labels as L

DAY = datetime(2024, 3, 1)
ANSWERS = "ts timestamp, source string, gold string, prediction string"


def at(hours):
    return DAY + timedelta(hours=hours)


BATCHES = [
    [(at(1), "a", "5", "5"), (at(2), "a", "5", "6"), (at(30), "b", "x", "x")],
    [(at(3), "a", "5", "5"), (at(80), "a", "1", "1"), (None, "a", "1", "1")],
    [(at(4), "a", "5", "5"), (at(26), "b", "x", "y"), (at(29), "c", "x", "x"), (at(81), "a", "1", "2")],
    [(at(200), "b", "1", "1")],
]


def table(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("stops", [(4,), (1, 1, 2), (2, 2)])
def test_late_answers_are_counted_beside_their_windows(spark, tmp_path, stops):
    source, target, state = (str(tmp_path / x) for x in ("log", "windows", "state"))
    written = 0
    for files in stops:
        for rows in BATCHES[written : written + files]:
            spark.createDataFrame(rows, ANSWERS).coalesce(1).write.mode("append").parquet(source)
        written += files
        L.windowed_accuracy(L.label_stream(spark, source, ANSWERS), target, state, late="6 hours").awaitTermination()
    day = lambda k: DAY + timedelta(days=k)
    # After the first batch the mark is at 24 hours: the first day is closed, and the next rows for it are late. The second mark, at 74 hours, closes the second day too.
    assert table(L.finished_windows(spark, target)) == [(day(0), "a", 2, 1, 2), (day(1), "b", 1, 1, 1), (day(1), "c", 0, 0, 1), (day(3), "a", 2, 1, 0)]
    assert table(L.open_windows(spark, target)) == [(day(8), "b", 1, 1)]
    assert len(L.numbers(spark, f"{target}/open")) <= 2 and len(L.numbers(spark, f"{target}/mark")) <= 2


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("log", "windows", "state"))
    for rows in BATCHES:
        spark.createDataFrame(rows, ANSWERS).coalesce(1).write.mode("append").parquet(source)
    L.windowed_accuracy(L.label_stream(spark, source, ANSWERS), target, state, late="6 hours").awaitTermination()
    before = table(L.finished_windows(spark, target)), table(L.open_windows(spark, target))
    commits = sorted((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for file in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):  # as if it had failed after its last write
        file.unlink(missing_ok=True)
    L.windowed_accuracy(L.label_stream(spark, source, ANSWERS), target, state, late="6 hours").awaitTermination()
    assert (table(L.finished_windows(spark, target)), table(L.open_windows(spark, target))) == before


@pytest.mark.parametrize("compact", [1, 3, 100])
def test_labels_are_kept_in_few_folders(spark, tmp_path, compact):
    """Ordered by (ts, seq); the number of folders is bounded by how often the table is written anew."""
    source, target, state = (str(tmp_path / x) for x in ("log", "table", "state"))
    schema = "rater string, item_id int, ts long, seq long, label string"
    rows = [("r", i % 3, (i * 7) % 5, i, f"l{i}") for i in range(24)]
    for k in range(8):
        spark.createDataFrame(rows[3 * k : 3 * k + 3], schema).coalesce(1).write.mode("append").parquet(source)
        L.upsert_labels(L.label_stream(spark, source, schema), target, state, ("ts", "seq"), compact).awaitTermination()
        assert len(L.numbers(spark, f"{target}/new")) + len(L.numbers(spark, f"{target}/base")) <= min(8, 2 * compact + 2)
    want = {}
    for r, i, ts, seq, label in rows:
        want[r, i] = max(want.get((r, i), (-1, -1, "")), (ts, seq, label))
    got = L.current_labels(spark, target, ("ts", "seq")).select("rater", "item_id", "ts", "seq", "label").collect()
    assert {(r["rater"], r["item_id"]): (r["ts"], r["seq"], r["label"]) for r in got} == want
