"""What a stream's catalog takes as changes, batch by batch, against a plain loop; no Python runs for its keys."""

import datetime
import os
import random

import pytest

from ledgerloom.streaming import catalog as C

START = datetime.datetime(2024, 1, 2)  # a stretch ends a day later
HOUR = datetime.timedelta(hours=1)


def place(row):
    return row[2], (row[3] is not None, row[3] or ""), (row[4] is not None, row[4] or 0)


@pytest.mark.parametrize(("late", "step", "span"), [("1 day", 12, 20), ("12 days", 0, 240), ("0 seconds", 48, 0)])
def test_changes_are_the_newer_rows(spark, tmp_path, late, step, span):
    r, new, folder = random.Random(span), str(tmp_path / "new"), str(tmp_path / "catalog")
    os.makedirs(new)
    held, rows, numbers = {}, [], set()
    for batch in range(5):
        again = rows[:20] if step else random.Random(batch).sample(rows, min(20, len(rows)))  # seen before
        rows = [(r.choice("ab"), f"k{r.randrange(25)}", START + (batch * step + r.randint(0, span)) * HOUR, r.choice(["x", "y", "", None]), r.choice([1, 2, None])) for _ in range(60)]
        rows += again if span else []
        want = {}
        for row in rows:
            if row[:2] not in held or place(row) > place(held[row[:2]]):
                held[row[:2]] = want[row[:2]] = row
        spark.createDataFrame(rows, C.SEEN).coalesce(1).write.mode("append").parquet(new)
        C.follow(spark.readStream.schema(C.SEEN).parquet(new), folder, late).awaitTermination()
        fresh = set(C._numbers(spark, folder)) - numbers
        numbers |= fresh
        got = [tuple(x) for n in fresh for x in spark.read.schema(C.SEEN).parquet(f"{folder}/changes/batch={n}").collect()]
        assert sorted(map(str, got)) == sorted(map(str, want.values()))
    assert sorted(str(tuple(x)) for x in C.current(spark, folder).collect()) == sorted(map(str, held.values()))


def test_keys_cost_no_python(spark, tmp_path, capsys):
    C.changes(spark.readStream.schema(C.SEEN).parquet(str(tmp_path))).explain(True)
    plan = capsys.readouterr().out
    assert "StateStoreSave" in plan and "Pandas" not in plan and "Python" not in plan
