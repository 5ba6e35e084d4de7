import hashlib
import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators.references import Reference, key_number, key_runs, orphans
from tessella.operators.skew import copied, dealt, hot_keys
from tessella.runner import main, run_steps
from tessella.sources import archives, shared, sinks, staging
from tessella.streaming import commits


def test_files_appear_whole_or_not_at_all(tmp_path):
    target = f"file://{tmp_path}/a/b.bin"
    assert shared.put(target, [b"x", b"y"]) == hashlib.sha256(b"xy").hexdigest() and shared.content(target) == b"xy"
    with pytest.raises(ZeroDivisionError):
        shared.put(target, (bytes([1 // n]) for n in (1, 0)))
    with pytest.raises(ValueError, match="digest"):
        shared.put(target, [b"z"], expected="0" * 64)
    assert shared.content(target) == b"xy" and [p.name for p in (tmp_path / "a").iterdir()] == ["b.bin"]


def test_locations(tmp_path):
    assert shared.opened("file:/a/b")[1] == shared.opened("file:///a/b")[1] == shared.opened("/a/b")[1] == "/a/b"
    assert shared.listed(str(tmp_path / "none")) == [] and not shared.exists(str(tmp_path / "none"))
    shared.remove(str(tmp_path / "none"))
    shared.put(f"file://{tmp_path}/deep/k=1/r=2/f.x", [b"1"])
    assert shared.listed_below(f"file://{tmp_path}/deep") == [f"file://{tmp_path}/deep/k=1/r=2/f.x"] and shared.listed_below(str(tmp_path / "none")) == []
    (tmp_path / "x").mkdir()
    (tmp_path / "y").mkdir()
    with pytest.raises(FileExistsError):
        shared.rename(str(tmp_path / "x"), str(tmp_path / "y"))


def test_commits_are_seen_by_uri_and_by_path(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "unit string, v int")
    data, done = f"file://{tmp_path}/data", f"file://{tmp_path}/done"
    assert commits.process_waiting(spark, rows, "unit", data, done) == 2
    assert commits.committed(spark, done).count() == commits.committed(spark, str(tmp_path / "done")).count() == 2
    assert commits.process_waiting(spark, rows, "unit", data, done) == 0 and commits.visible(spark, data, done, "unit").count() == 3
    commits.lock_settings(f"file://{tmp_path}/locked", {"a": 1})
    with pytest.raises(ValueError):
        commits.lock_settings(str(tmp_path / "locked"), {"a": 2})


def test_small_archives_share_a_task(monkeypatch):
    monkeypatch.setattr(archives, "TASK_BYTES", 10)
    monkeypatch.setattr(archives, "TASK_FILES", 3)
    assert [t.paths for t in archives._tasks([("a", 4), ("b", 4), ("c", 4), ("d", 90), ("e", 0), ("f", 0), ("g", 0), ("h", 0)])] == [["a", "b"], ["c"], ["d"], ["e", "f", "g"], ["h"]]


def test_zip_files_depend_on_contents_only(tmp_path):
    one = sinks.put_zip(str(tmp_path / "1.zip"), [("b", b"2"), ("a", b"1")])
    assert one == sinks.put_zip(str(tmp_path / "2.zip"), [("a", b"1"), ("b", b"2")])
    assert zipfile.ZipFile(io.BytesIO(shared.content(str(tmp_path / "1.zip")))).namelist() == ["a", "b"]


def pages_of(tree):
    def pages(folder, token):
        at = int(token or 0)
        return tree[folder][at : at + 2], str(at + 2) if at + 2 < len(tree[folder]) else None

    return pages


def entry(name, data=b"x"):
    return {"id": name, "name": name, "size": len(data), "md5": hashlib.md5(data).hexdigest()}


@pytest.mark.parametrize("bad,match", [({"id": "d", "name": "d", "folder": True}, "reached twice"), (entry("a/b"), "unsafe"), (entry(".."), "unsafe"), (entry("f1"), "twice"), ({"id": "q", "name": "q", "size": None, "md5": "0"}, "no size")])
def test_remote_listings_are_checked(bad, match):
    tree = {"": [entry("f1"), {"id": "d", "name": "dir", "folder": True}, bad], "d": [entry("g1"), entry("g2"), entry("g3")]}
    with pytest.raises(ValueError, match=match):
        list(staging.remote_files(pages_of(tree), ""))
    tree[""].pop()
    assert sorted(f["path"] for f in staging.remote_files(pages_of(tree), "")) == ["dir/g1", "dir/g2", "dir/g3", "f1"]


def test_downloads_are_compared(tmp_path):
    files = [entry("a", b"1") | {"path": "k/a"}]
    with pytest.raises(ValueError, match="expected"):
        staging.download(files, lambda _: [b"2"], str(tmp_path), times=2, wait=0)
    assert list((tmp_path / "k").iterdir()) == []
    assert staging.download(files, lambda _: [b"1"], str(tmp_path)) == {"kept": 0, "fetched": 1}
    assert staging.download(files, lambda _: 1 / 0, str(tmp_path)) == {"kept": 1, "fetched": 0}


def test_a_damaged_built_archive_is_built_anew(tmp_path):
    calls = []

    def members():
        calls.append(1)
        return [("m", b"data")]

    path, _ = staging.built_once(str(tmp_path), "f", members)
    good = shared.digest(path)
    shared.put(path, [b"broken"])
    again, reused = staging.built_once(str(tmp_path), "f", members)
    assert not reused and shared.digest(again) == good and len(calls) == 2 and staging.built_once(str(tmp_path), "f", members)[1]


def test_steps_stop_at_the_first_failure(tmp_path):
    steps = [{"name": n, "command": ["python", "-c", code]} for n, code in (("one", "pass"), ("two", "raise SystemExit(3)"), ("three", "pass"))]
    said = []
    assert run_steps(steps, say=said.append) == 3 and not any("three" in s for s in said)
    assert run_steps(steps, dry_run=True, say=said.append) == 0 and run_steps(steps, first=3, say=said.append) == 0
    shared.put(str(tmp_path / "steps.json"), [json.dumps(steps).encode()])
    assert main([str(tmp_path / "steps.json"), "--to", "1", "--log", str(tmp_path / "log")]) == 0
    assert [line.split(" ", 1)[1].split(":")[0] for line in (tmp_path / "log").read_text().splitlines()] == ["1/3 one", "one"]


def test_errors_are_tried_again_so_many_times():
    seen = []

    def call():
        seen.append(1)
        if len(seen) < 3:
            raise OSError("not yet")
        return "done"

    assert staging.retried(call, wait=0) == "done" and len(seen) == 3
    with pytest.raises(OSError):
        staging.retried(lambda: (_ for _ in ()).throw(OSError("never")), times=2, wait=0)


def test_arrays_are_stored_whole_and_compared(tmp_path):
    path = str(tmp_path / "w.npz")
    sha = sinks.put_arrays(path, weights=np.arange(5.0), step=np.array(7))
    got = sinks.get_arrays(path, sha)
    assert (got["weights"] == np.arange(5.0)).all() and got["step"] == 7
    with pytest.raises(ValueError, match="digest"):
        sinks.get_arrays(path, "0" * 64)


def test_hot_keys_are_few_and_split_evenly(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 600, "a").when(F.col("id") < 900, "b").otherwise(F.col("id").cast("string")).alias("k"), "id")
    table, n = hot_keys(rows, ["k"], 100)
    assert n == 2 and {(r.k, r.parts) for r in table.collect()} == {("a", 6), ("b", 3)}
    parts = dealt(rows, (table, n), ["k"], "id").groupBy("k", "part").count().collect()
    assert max(r["count"] for r in parts) < 160 and sum(r["count"] for r in parts) == 1000
    assert copied(spark.createDataFrame([("a",), ("x",)], "k string"), (table, n), ["k"]).count() == 7
    assert [r.k for r in hot_keys(rows, ["k"], 100, most=1)[0].collect()] == ["a"]
    assert hot_keys(rows, ["k"], 5000)[1] == 0


def test_key_runs(spark):
    rows = spark.createDataFrame([(0, n) for n in (3, 4, 4, 5, 9, 1023, 1024, 1025)] + [(1, 4)], "rel int, number long")
    assert sorted((r.rel, r.first, r.last) for r in key_runs(rows).collect()) == [(0, 3, 5), (0, 9, 9), (0, 1023, 1023), (0, 1024, 1025), (1, 4, 4)]
    keys = spark.createDataFrame([("a-007",), ("x123456789012345678901",), ("plain",)], "k string").select(key_number(F.col("k")).alias("n")).collect()
    assert keys[0].n == 7 and keys[1].n == 456789012345678901 - 456789012345678901 + int("123456789012345678901"[-18:]) and keys[2].n is not None


def test_keys_with_equal_numbers_are_told_apart(spark):
    names = [f"{stem}{n:0{w}d}" for stem in ("a", "b") for n in range(0, 40, 3) for w in (2, 4)] + ["none", "other"]
    parents = [(k, 10 * i, None if i % 3 else 10 * i + 15) for i, k in enumerate(names) if i % 4]
    refs = [(i * 1000 + t, k, t) for i, k in enumerate([*names, "a05", "c03", "unknown", "a0", "a99"]) for t in (0, 100, 400)]
    p = spark.createDataFrame(parents, "k string, s int, e int").selectExpr("k", "timestamp_micros(s) AS s", "timestamp_micros(e) AS e")
    r = spark.createDataFrame(refs, "no long, k string, t int").selectExpr("no", "k", "timestamp_micros(t) AS t")
    known = {k: (s, e) for k, s, e in parents}
    want = sorted(no for no, k, t in refs if k not in known or t < known[k][0] or (known[k][1] is not None and t >= known[k][1]))
    for hot in (50_000, 20):
        got = orphans([Reference("t", "c", r, F.col("no"), F.col("k"), F.col("t"), p, F.col("k"), F.col("s"), F.col("e"))], hot_rows=hot)
        assert sorted(x.record_no for x in got.collect()) == want
