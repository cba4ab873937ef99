"""Saved answers: byte ranges and growing segments; results of a stream are those of a batch, also over a restart."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta, timezone

import pytest

from tallyforge.sources import saved_answers as A
from tallyforge.streaming import answers as S

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def answer(run, entity, family, priority, second, n=0, error="", label=None):
    entries = [{"href": f"https://a.com/{i}", "title": "t", "body": "b"} for i in range(n)]
    return {"run": run, "entity": entity, "family": family, "priority": priority, "label": label or ("primary", "fallback", "plain")[priority], "query": f"q{priority}", "at": (T0 + timedelta(seconds=second)).isoformat(), "entries": entries, "error": error}


def put(where, n, lines, end="\n"):
    where.mkdir(exist_ok=True)
    (where / A.segment_name(n)).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + end)


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 1 << 20])
def test_ranges_read_each_line_once(tmp_path, size):
    rng = random.Random(size)
    want = []
    for n in range(3):
        lines = ["x" * rng.choice([1, 2, 6, 7, 8, 63, 64, 300]) + "é" for _ in range(20)]
        put(tmp_path / "a", n, lines, "" if n == 1 else "\n\n")
        want += [(n, x) for x in lines]
    folder = A._Folder(f"file://{tmp_path}/a", size)
    got = []
    for part in folder.ranges({"segment": 0, "byte": 0}, folder.newest(0)):
        for b in folder.read(part):
            got += list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
    assert [(s, x) for s, _, x in got] == want
    raw = {n: (tmp_path / "a" / A.segment_name(n)).read_bytes() for n in range(3)}
    assert all(raw[s][at:].startswith(x.encode()) for s, at, x in got)


def test_a_growing_segment_is_read_to_its_last_whole_line(tmp_path):
    folder = A._Folder(f"file://{tmp_path}/a", 1 << 20)
    (tmp_path / "a").mkdir()
    assert folder.newest(0) == {"segment": 0, "byte": 0}
    put(tmp_path / "a", 0, ["one", "tw"], "")
    first = folder.newest(0)
    assert first == {"segment": 0, "byte": 4}
    put(tmp_path / "a", 0, ["one", "two"], "")
    put(tmp_path / "a", 1, ["three"])
    then = folder.newest(first["segment"])
    assert [x for p in folder.ranges(first, then) for b in folder.read(p) for x in b.column(2).to_pylist()] == ["two", "three"]
    for n in range(2, 70):
        put(tmp_path / "a", n, ["z"])
    assert folder.newest(0) == {"segment": 69, "byte": 2}


CASES = [
    answer("r", "won", "f", 0, 0, 2), answer("r", "won", "f", 1, 5, 3),
    answer("r", "fell", "f", 1, 3, 1), answer("r", "fell", "f", 0, 8, 0, "http 500"),
    answer("r", "late", "f", 1, 0, 1), answer("r", "late", "f", 0, 61, 4),
    answer("r", "edge", "f", 1, 0, 1), answer("r", "edge", "f", 0, 60, 4),
    answer("r", "none", "f", 0, 1, 0, "a"), answer("r", "none", "f", 1, 2, 0, "b"), answer("r", "none", "f", 2, 3, 0),
    answer("r", "twice", "f", 0, 9, 3), answer("r", "twice", "f", 0, 2, 0), answer("r", "twice", "f", 0, 2, 0),
    answer("s", "won", "f", 0, 50, 0),
    answer("r", "won", "g", 2, 40, 1),
]


def shown(rows):
    return sorted((r.run, r.entity, r.family, int(r.first_at.timestamp()), r.priority, r.label, len(r.entries), tuple((a.label, a.result_count, a.error) for a in r.attempts), tuple(r.warnings), r.error) for r in rows.collect())


def test_results_by_hand(spark, tmp_path):
    put(tmp_path / "a", 0, [*CASES, "no json", "{}", {"run": "r", "entity": "x", "at": "no time", "priority": 0}])
    rows = A.parsed(A.read_lines(spark, f"{tmp_path}/a", range_bytes=300))
    assert rows.filter("unreadable IS NOT NULL").count() == 3
    got = {r[:3]: r[4:] for r in shown(S.first_answers(rows, 60))}
    one = ("primary", 0, "http 500")
    assert got == {
        ("r", "won", "f"): (0, "primary", 2, (("primary", 2, ""),), (), ""),
        ("r", "fell", "f"): (1, "fallback", 1, (one, ("fallback", 1, "")), ("primary query failed; trying fallback", "used fallback query fallback"), ""),
        ("r", "late", "f"): (1, "fallback", 1, (("fallback", 1, ""),), ("used fallback query fallback",), ""),
        ("r", "edge", "f"): (0, "primary", 4, (("primary", 4, ""),), (), ""),
        ("r", "none", "f"): (None, "", 0, (("primary", 0, "a"), ("fallback", 0, "b"), ("plain", 0, "")), ("primary query failed; trying fallback", "fallback query failed; trying fallback"), "b"),
        ("r", "twice", "f"): (None, "", 0, (("primary", 0, ""),), (), ""),
        ("s", "won", "f"): (None, "", 0, (("primary", 0, ""),), (), ""),
        ("r", "won", "g"): (2, "plain", 1, (("plain", 1, ""),), ("used plain query fallback",), ""),
    }


def test_a_stream_equals_a_batch_over_restarts(spark, tmp_path):
    rng = random.Random(5)
    every = [answer(f"r{s // 400}", f"e{rng.randrange(4)}", "f", rng.randrange(3), s, rng.choice([0, 0, 1, 2]), rng.choice(["", "x"])) for s in range(0, 1200, 3)]
    # out of order by less than what counts as late
    every = [x for _, x in sorted(((i + rng.uniform(0, 6)), x) for i, x in enumerate(every))]
    where, out, at = tmp_path / "a", f"{tmp_path}/out", f"{tmp_path}/at"
    stream = S.first_answers_stream(A.parsed(A.read_lines(spark, str(where), stream=True)), 60, "30 seconds", 3600)
    for n, (a, b) in enumerate([(0, 90), (90, 91), (91, 260), (260, 400)]):
        put(where, n, every[a:b])
        if n % 2:
            # the newest segment grows between two runs
            text = (where / A.segment_name(n)).read_text()
            (where / A.segment_name(n)).write_text(text[: len(text) // 2])
            S.run_available(stream, out, at)
            (where / A.segment_name(n)).write_text(text)
        S.run_available(stream, out, at)
    # a search that begins last ends with the clock alone
    put(where, 4, [answer("r9", "e9", "f", 0, 2000, 1), answer("", "", "", 0, 9000)])
    S.run_available(stream, out, at)
    want = shown(S.first_answers(A.parsed(A.read_lines(spark, str(where))), 60))
    assert len(want) == 13
    assert shown(spark.read.parquet(out)) == want


def test_calls_for_state_do_not_grow_with_the_searches(spark):
    """A bucket of 3,000 searches: one read, one write and one timer for its rows, and as many when they end."""
    from pyspark.sql import Row

    calls, held = [], [None]

    class Handle:
        def getValueState(self, *a):
            return self

        def get(self):
            calls.append("get")
            return held[0]

        def update(self, v):
            calls.append("update")
            held[0] = v

        def clear(self):
            calls.append("clear")
            held[0] = None

        def registerTimer(self, at):
            calls.append("timer")

        def deleteTimer(self, at):
            calls.append("no timer")

    class Clock:
        def getCurrentWatermarkInMs(self):
            return 70_000

        def getExpiryTimeInMs(self):
            return 60_001

    made = S._Searches(60, 3600)
    made.init(Handle())
    rows = [Row(run="r", entity=f"e{i}", family="f", priority=p, at_us=i + 5 * p, label="", query=f"{p}", error="", entries="[]") for i in range(3_000) for p in (1, 0)]
    assert list(made.handleInputRows((7,), iter(rows), Clock())) == [] and calls == ["get", "timer", "update"]
    calls.clear()
    got = list(made.handleExpiredTimer((7,), Clock(), Clock()))
    assert len(got) == 3_000 and all([a[0] for a in r.answers] == [0, 1] for r in got) and calls == ["get", "timer", "update"]
    # an answer to a search that has ended counts no more
    assert list(made.handleInputRows((7,), iter(rows[:2]), Clock())) == [] and json.loads(held[0][1]) == []
