"""Visible histories and framed streams against plain folds."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quern.operators import log
from quern.sources import readers, writers

ROW = "session string, id string, role string, parent string, summary boolean, finished boolean, failed boolean, compacts boolean, tail_start string"


def plain_history(rows):
    rows = sorted(rows, key=lambda r: r["id"])
    answered = {r["parent"] for r in rows if r["role"] == "assistant" and r["summary"] and r["finished"] and not r["failed"]}
    start, tail, stop = 0, None, None
    for i in range(len(rows) - 1, -1, -1):
        r = rows[i]
        if r["role"] == "user" and r["compacts"] and r["id"] in answered and any(x["parent"] == r["id"] for x in rows[i + 1 :]):
            start, stop, tail = i, i, r["tail_start"]
            if tail is not None:
                start = next((j for j in range(i + 1) if rows[j]["id"] == tail), 0)
            break
    shown = rows[start:]
    if tail is not None and stop is not None and start < stop:
        at = stop - start
        answer = next((j for j in range(at + 1, len(shown)) if shown[j]["role"] == "assistant" and shown[j]["summary"] and shown[j]["parent"] == shown[at]["id"]), None)
        if answer is not None:
            shown = shown[at : answer + 1] + shown[:at] + shown[answer + 1 :]
    return [r["id"] for r in shown]


def test_histories_match_a_plain_fold(spark):
    rng, rows = random.Random(11), []
    for s in range(700):
        n = rng.randrange(1, 14)
        names = [f"m{i:02}" for i in range(n)]
        for i, name in enumerate(names):
            assistant = rng.random() < 0.5
            rows.append((f"s{s}", name, "assistant" if assistant else "user", rng.choice([None, *names[max(0, i - 4) : i + 2]]), rng.choice([True, True, False, None]) if assistant else None, rng.choice([True, True, False]), rng.choice([False, False, True, None]), not assistant and rng.random() < 0.6, rng.choice([None, "gone", *names[max(0, i - 5) : i + 2]])))
    columns = [c.split()[0] for c in ROW.split(", ")]
    want = {}
    for s in {r[0] for r in rows}:
        want[s] = plain_history([dict(zip(columns, r, strict=True)) for r in rows if r[0] == s])
    got = {}
    for r in log.visible_history(spark.createDataFrame(rows, ROW).repartition(3)).orderBy("session", "position").collect():
        assert r.position == len(got.setdefault(r.session, []))
        got[r.session].append(r.id)
    assert got == want and sum(v != sorted(v) for v in want.values()) > 10


@pytest.mark.parametrize("size", [1, 2, 5, 50])
def test_frames_do_not_depend_on_chunks(spark, size):
    rng, rows, want = random.Random(size), [], []
    for k in [None, *range(6)]:
        text = "".join(rng.choice(["data: a", "data:b", "data:  c ", "event: x", "\n", "\r\n", "\n\n", "\r\n\r\n", "data: [DONE]", "\n\n", "é🙂"]) for _ in range(40))
        frames = re.split(r"\r?\n\r?\n", text)
        data = ["\n".join(x[5:].lstrip(" ") for x in re.split(r"\r?\n", f) if x.startswith("data:")) for f in frames]
        want += [(k, i, d) for i, d in enumerate(data) if d not in ("", "[DONE]")]
        rows += [(k, i, text[i * size : (i + 1) * size]) for i in range(-(-len(text) // size))] + [(k, 10**6, None)]
    rng.shuffle(rows)
    got = [tuple(r) for r in readers.sse_events(spark.createDataFrame(rows, "k int, o int, x string"), "k", "o", "x").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert readers.sse_events(spark.createDataFrame([], "k int, o int, x string"), "k", "o", "x").count() == 0


def test_a_swap_that_was_cut_short_is_put_right(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    make = lambda *r: spark.createDataFrame(r, "id int, n int")
    writers.merge_overwrite(make((1, 1), (2, 2)), path, ["id"])
    (tmp_path / "t").rename(tmp_path / "t._old")  # as after the first of the two renames
    writers.merge_columns(make((2, 5)), path, ["id"], ["n"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, 1), (2, 5)] and not (tmp_path / "t._old").exists()


def test_history_lines_replace_the_file(spark, tmp_path):
    path = f"file://{tmp_path}/h.md"
    for day, n in (("2024-01-01", 1_000), ("2024-01-02", 1_500)):
        writers.append_history(spark, path, "Title", day, {"All": n})
    rows = [r.value for r in spark.read.text(path).filter(F.col("value").rlike(writers.HISTORY_ROW)).collect()]
    assert rows == ["| 2024-01-01 | 1,000 (+1,000) |", "| 2024-01-02 | 1,500 (+500) |"]
