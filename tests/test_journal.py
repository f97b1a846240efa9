"""Answers of a lost task are not asked for again."""

from __future__ import annotations

import json
import os
from collections import Counter

import pytest

from corpusloom.operators import ask, journal


def test_a_task_that_dies_half_way(spark, tmp_path):
    """Two attempts over the same journal: no request but those of the open file is sent twice."""
    log, dead = str(tmp_path / "log"), str(tmp_path / "dead")
    os.mkdir(log)

    def model(prompts):
        for p in prompts:
            with open(f"{log}/{os.getpid()}", "a") as f:
                f.write(p + "\n")
        with open(f"{log}/{os.getpid()}") as f:
            if not os.path.exists(dead) and sum(1 for _ in f) > 47:
                open(dead, "w").close()
                os._exit(1)  # the worker is lost, not the request
        return [json.dumps({"said": p}) for p in prompts]

    df = spark.createDataFrame([(i, f"p{i}") for i in range(100)], "id long, prompt string").coalesce(1)
    calls = {"qps": 0, "concurrency": 1, "backoff_s": 0, "journal": f"file:{tmp_path}/journal"}
    with pytest.raises(Exception):
        ask.call_model(df, "prompt", model, **calls).collect()
    got = ask.call_model(df, "prompt", model, **calls).collect()
    assert sorted((r.id, json.loads(r.response)["said"], r.attempts) for r in got) == [(i, f"p{i}", 1) for i in range(100)]
    sent = Counter(line.strip() for name in os.listdir(log) for line in open(f"{log}/{name}"))
    assert set(sent) == {f"p{i}" for i in range(100)}
    twice = [p for p, n in sent.items() if n > 1]
    assert 1 <= len(twice) <= journal.EVERY and max(sent.values()) == 2


def test_failures_are_asked_again(spark, tmp_path):
    path = str(tmp_path / "j")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, prompt string").coalesce(1)
    calls = {"qps": 0, "concurrency": 1, "backoff_s": 0, "max_attempts": 1, "journal": path}
    first = ask.call_model(df, "prompt", lambda ps: ['{"x": 1}' if p == "a" else None for p in ps], **calls).collect()
    again = ask.call_model(df, "prompt", lambda ps: ['{"x": 2}'] * len(ps), **calls).collect()
    assert {r.id: r.response for r in first} == {1: '{"x": 1}', 2: None}
    assert {r.id: (r.response, r.error) for r in again} == {1: ('{"x": 1}', None), 2: ('{"x": 2}', None)}


def test_half_written_files_do_not_count(tmp_path):
    one = journal.Journal(str(tmp_path), 3, every=2)
    for i in range(5):
        one.add(f"p{i}", f"r{i}", 1)
    (tmp_path / "task-3" / "x.part").write_text('[["lost')
    two = journal.Journal(f"file://{tmp_path}", 3)
    assert [two.get(f"p{i}") for i in range(5)] == [("r0", 1), ("r1", 1), ("r2", 1), ("r3", 1), None]
    assert journal.Journal(str(tmp_path), 4).known == {}


def test_stores_that_are_not_known():
    kept = journal.Journal("unknown://bucket/x", 0)
    kept.add("p", "r", 1)
    kept.flush()
    assert kept.get("p") is None and journal.Journal(None, 0).get("p") is None
