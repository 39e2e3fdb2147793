"""The timeline: creation, listing, differences, restores, pruning, bisecting, sessions and streams."""

import datetime as dt
import os
import random
import socket
import time

import pytest

from tessera import cli
from tessera.api import RestoreRefused, Workspace
from tessera.operators import bisect as B
from tessera.operators import timeline as TL
from tessera.operators.ordered import with_previous
from tessera.sources import files as FS
from tessera.sources.timeline_store import ConcurrentUpdate, TimelineStore
from tessera.streaming import watch as W


def versions(spark, trees, repo="r"):
    rows = [(repo, i, t, 1000 + 10 * i, f"l{i}", "manual" if i % 2 else "watch") for i, t in enumerate(trees)]
    return spark.createDataFrame(rows, "repo string, seq long, tree string, ts long, label string, source string")


def test_previous_rows_across_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abcd" + "z" * 6), i, rng.choice("xy")) for i in range(2000)]
    got = with_previous(spark.createDataFrame(rows, "k string, i long, v string").repartition(7), "k", ["i"], ["i", "v"]).collect()
    last, expected = {}, {}
    for k, i, v in rows:
        expected[i] = last.get(k)
        last[k] = (i, v)
    assert {r.i: tuple(r.prev) if r.prev else None for r in got} == expected and len(got) == 2000


def test_snapshots_skip_unchanged_trees(spark):
    made = TL.create_snapshots(versions(spark, ["a", "a", "b", "b", "a", None, None, "a"])).orderBy("seq").collect()
    assert [r.seq for r in made] == [0, 2, 4, 5, 7]
    assert [r.parent for r in made] == [None, *(r.id for r in made[:-1])] and all(r.short == r.id[:8] for r in made)


def test_log_limits_before_the_source(spark):
    s = TL.create_snapshots(versions(spark, list("abcdef")))
    assert [r.seq for r in TL.log(s, 3).collect()] == [5, 4, 3]
    assert [r.seq for r in TL.log(s, 3, source="watch").collect()] == [4]
    assert [r.seq for r in TL.log(s, None, since_ms=1_040_999).collect()] == [5, 4]
    with pytest.raises(TL.SnapshotNotFound):
        TL.resolve(s, "nothing")
    one = s.first()
    assert TL.resolve(s, one.id[:16]).id == one.id


ENTRIES = [("t1", "a", "1"), ("t1", "b", "2"), ("t1", "d/x", "7"), ("t2", "a", "1"), ("t2", "b", "3"), ("t2", "c", "7")]


def test_changes_and_restores(spark):
    e = spark.createDataFrame(ENTRIES, "tree string, path string, blob string")
    found = {r.path: r.status for r in TL.diff(e, "t1", "t2").collect()}
    assert found == {"b": "M", "c": "A", "d/x": "D"}
    assert {r.path for r in TL.diff(e, "t1", "t2", ["d", "b"]).collect()} == {"b", "d/x"}
    assert [tuple(r) for r in TL.renames(TL.diff(e, "t1", "t2")).collect()] == [("7", "d/x", "c")]
    plan = {r.path: (r.action, r.blob) for r in TL.restore_plan(e, "t2", "t1").collect()}
    assert plan == {"b": ("write", "2"), "c": ("delete", None), "d/x": ("write", "7")}
    s = TL.create_snapshots(versions(spark, ["t1", "t2"]))
    counts = {r.seq: r.files for r in TL.change_counts(s, e).collect()}
    assert counts == {0: 3, 1: 3}


def test_pruning_links_survivors_anew(spark):
    s = TL.create_snapshots(versions(spark, list("abcd")))
    kept = TL.prune(s, 1020, keep_labeled=True).orderBy("seq").collect()
    assert [r.seq for r in kept] == [1, 2, 3] and kept[0].parent is None and kept[1].parent == kept[0].id
    assert TL.prune(s, 0).count() == 4 and TL.prune(s, 9999).count() == 0
    before = {r.seq: r.id for r in s.collect()}
    assert kept[0].id != before[1]  # another parent, another id


def verdict_chain(goods):
    return B.bisect(list(range(len(goods))), lambda i: goods[i])


@pytest.mark.parametrize("goods,first,last", [([1, 1, 1, 0, 0, 0, 0, 0, 0, 0], 3, 2), ([1] * 5, None, 4), ([0] * 5, 0, None), ([1], None, None), ([], None, None), ([1, 0], 1, 0)])
def test_bisect(goods, first, last):
    got = verdict_chain(goods)
    assert (got.first_bad, got.last_good) == (first, last) and got.tested <= len(goods)


def test_bisect_of_all_keys_at_once(spark):
    rng = random.Random(2)
    chains = {f"k{k}": [rng.random() < 0.7 for _ in range(rng.randrange(1, 40))] for k in range(60)}
    rows = [(k, i, g) for k, c in chains.items() for i, g in enumerate(c)]
    for limit in (8, 200):
        got = B.bisect_verdicts(spark.createDataFrame(rows, "repo string, seq int, good boolean"), limit=limit).collect()
        for r in got:
            chain = list(enumerate(chains[r.repo]))[-limit:]
            want = B.bisect(chain, lambda v: v[1])
            assert (r.first_bad, r.last_good, r.tested, r.candidates) == (want.first_bad and want.first_bad[0], want.last_good and want.last_good[0], want.tested, want.candidates)


def test_probes_fail_on_bad_commands(tmp_path):
    assert B.command_probe(["true"], str(tmp_path)) and not B.command_probe(["false"], str(tmp_path)) and not B.command_probe([], str(tmp_path))
    assert not B.command_probe(["no-such-command"], str(tmp_path)) and not B.command_probe(["sleep", "5"], str(tmp_path), 0.1)


def test_sessions_merge_at_exactly_the_gap(spark):
    at = [0, 300, 600, 901, 5000]
    rows = [("r", dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=m)) for m in at]
    got = TL.sessions(spark.createDataFrame(rows, "k string, ts timestamp"), "k", "ts", "300 milliseconds").orderBy("first").collect()
    assert [r.n for r in got] == [3, 1, 1]


def test_workspace(spark, tmp_path):
    root = tmp_path / "project"
    (root / "src").mkdir(parents=True)
    (root / "src/__init__.py").write_text("")
    (root / "src/login.py").write_text('def login():\n    """Signs in."""\n    return check()\n')
    (root / "src/check.py").write_text("from .login import login\ndef check():\n    return 1\n")
    (root / ".gitignore").write_text("# none\nbuilt/\n")
    (root / "built").mkdir()
    (root / "built/x.py").write_text("def unseen(): pass\n")
    w = Workspace(spark, str(root))
    assert w.init().parsed == 3 and w.index().reused == 3
    assert w.find_feature("login").first().name == "login" and w.outline("none.py") is None and w.outline("src/__init__.py").count() == 0
    assert w.get_symbol("src/check.py", "check").body.startswith("def check") and w.references("check").count() == 2
    assert "src/login.py" in w.repo_map() and w.status()["snapshots"] == 0
    w.feature_add("sign", ["src/**"], ["giriş"])
    assert w.find_feature("giriş").count() == 2 and w.feature_list() == [("sign", ["src/**"], ["giriş"])]
    w.feature_rm("sign")
    assert w.features == {} and w.feature_suggest().count() == 1

    assert w.find_text("login").splitlines()[0].startswith("src/login.py:1-3 login [function] (tam ad+") and w.outline_text("none.py") is None
    assert w.outline_text("src/check.py") == "2-3 export function check — def check()" and "src/login.py:3 (login)  return check()" in w.references_text("check")
    cheap, all_of_it = w.measure_tokens(["login"])
    assert cheap.matched == 2 and cheap.top == "src/login.py:1" and all_of_it.naive_chars == cheap.naive_chars > 0

    assert w.git_state() == ("unknown", None)
    (root / ".git/refs/heads").mkdir(parents=True)
    (root / ".git/HEAD").write_text("ref: refs/heads/main\n")
    (root / ".git/refs/heads/main").write_text("abc123\n")
    first = w.snap("one")
    assert (first.branch, first.head) == ("main", "abc123")
    assert first.label == "one" and w.snap("same") is None
    (root / "src/check.py").write_text("def check():\n    return 2\n")
    (root / "src/new.py").write_text("x = 1\n")
    second, changed = w.checkpoint_end("two", turn="t1")
    assert {r.path: r.status for r in changed} == {"src/check.py": "M", "src/new.py": "A"} and second.parent == first.id
    assert [(r.label, r.files) for r in w.log().collect()] == [("end: two", 2), ("one", 4)]
    assert "+    return 2" in {r.path: r.patch for r in w.diff(first.short, second.short).collect()}["src/check.py"]
    assert {r.label for r in w.log(file="src/new.py").collect()} == {"end: two"}
    assert [line.split("] ", 1)[1] for line in w.list_text().splitlines()] == ["end: two", "one"] and w.log_text().splitlines()[1].endswith("4 dosya  one")

    (root / "src/new.py").write_text("x = 2\n")
    with pytest.raises(RestoreRefused):
        w.checkpoint_restore(first.id)
    dry = w.restore(first.id, dry_run=True)
    assert not dry.applied and (root / "src/new.py").read_text() == "x = 2\n"
    done = w.restore(first.id)
    assert done.applied and not (root / "src/new.py").exists() and "return 1" in (root / "src/check.py").read_text()
    assert w.restore(first.id).noop
    w.restore(done.pre_restore, ["src/new.py"])
    assert (root / "src/new.py").read_text() == "x = 2\n" and "return 1" in (root / "src/check.py").read_text()

    found = w.bisect(lambda folder: "return 1" in open(f"{folder}/src/check.py").read(), limit=2)
    assert found.candidates == 2
    total = w.status()["snapshots"]
    assert w.prune("1h") == (0, total) and w.status()["size_kib"] == 0
    newest = w.store.tip().seq
    time.sleep(1.1)
    removed, kept = w.prune("1s", keep_labeled=True)
    assert removed + kept == total and {r.source for r in w.store.snapshots.collect()} == {"manual"} and w.store.tip().seq <= newest


def test_files_come_back_byte_for_byte(spark, tmp_path):
    root = tmp_path / "project"
    (root / "deep").mkdir(parents=True)
    every = bytes(range(256))
    (root / "every.bin").write_bytes(every)
    (root / "odd.txt").write_bytes(b"\xff\xfe\xfd")
    (root / "run.sh").write_text("#!/bin/sh\n")
    (root / "run.sh").chmod(0o755)
    (root / "deep/plain").write_bytes(b"")
    (root / "to").symlink_to("deep/plain")
    (root / "folder").symlink_to("deep")
    w = Workspace(spark, str(root))
    first = w.snap("one")
    assert w.snap("same") is None and {r.path for r in w.changed(first.id).collect()} == {"every.bin", "odd.txt", "run.sh", "deep/plain", "to", "folder"}
    (root / "odd.txt").write_bytes(b"\xfa\xfb\xfc")  # equal once decoded
    second = w.snap("two")
    assert [r.path for r in w.changed(second.id).collect()] == ["odd.txt"]
    (root / "run.sh").chmod(0o644)
    third = w.snap("three")
    assert [(r.path, r.status) for r in w.changed(third.id).collect()] == [("run.sh", "M")]
    (root / "every.bin").write_bytes(every[::-1])
    (root / "to").unlink()
    (root / "to").mkdir()
    (root / "to/inside").write_text("in the way")
    assert "Binary files" in {r.path: r.patch for r in w.diff(third.id).collect()}["every.bin"]
    assert w.restore(first.id).applied
    assert (root / "every.bin").read_bytes() == every and (root / "odd.txt").read_bytes() == b"\xff\xfe\xfd" and (root / "run.sh").stat().st_mode & 0o777 == 0o755
    assert (root / "to").is_symlink() and (root / "to").readlink().name == "plain" and (root / "folder").is_symlink() and (root / "deep/plain").read_bytes() == b""
    found = w.bisect(lambda folder: open(f"{folder}/every.bin", "rb").read() == every)
    assert found.first_bad.source == "pre-restore" or found.reason is not None


def test_two_writers_on_one_tip(spark, tmp_path):
    store = TimelineStore(spark, str(tmp_path))
    files = lambda text: spark.createDataFrame([("a", text)], "path string, text string")
    assert store.create(files("1")).seq == 1
    store._claim(2)  # another writer is at it
    with pytest.raises(ConcurrentUpdate):
        store.create(files("2"))
    store.clear()
    assert store.create(files("2")).seq == 1


def test_bisect_tells_what_the_first_bad_snapshot_changed(spark, tmp_path):
    w = Workspace(spark, str(tmp_path))
    for k in range(3):
        for j in range(25 if k == 2 else 1):
            (tmp_path / f"f{j:02}.txt").write_text(str(k))
        w.snap(str(k))
    found = w.bisect(lambda folder: open(f"{folder}/f00.txt").read() != "2")
    assert found.first_bad.label == "2" and found.last_good.label == "1" and [r.path for r in found.changed] == [f"f{j:02}.txt" for j in range(B.CHANGED)]


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "a.py").write_text('def login():\n    """Signs in."""\n    return 1\n')

    def run(*arguments):
        code = cli.main(["--root", str(tmp_path), *arguments])
        said = capsys.readouterr()
        return said.out.strip() if code == 0 else said.err.strip()

    assert run("init").startswith("1 parsed, 0 reused") and run("index", "--stats").count("py") >= 2
    assert run("find", "login").startswith("a.py:1-3 login") and "login" in run("map") and "login" in run("outline", "a.py") and run("outline", "b.py").startswith("no such")
    assert run("feature", "add", "sign", "**/*.py", "-a", "giriş") == "sign: **/*.py (also giriş)" and run("feature", "rm", "sign") == ""
    first = run("snap", "-m", "one").split()[0]
    assert run("snap") == "nothing has changed" and run("log").endswith("one")
    (tmp_path / "a.py").write_text("def login(): return 2\n")
    second = run("snap", "-m", "two").split()[0]
    assert run("diff", first, second, "--stat") == "M a.py" and "+def login(): return 2" in run("diff", first, second)
    found = run("bisect", "--", "grep", "-q", "return 1", "a.py")
    assert found.splitlines()[0] == f"first bad: {second} [manual] two" and "    M a.py" in found
    assert run("restore", first, "--dry-run") == "write  a.py" and run("restore", first).startswith("write  a.py\nundo: restore")
    assert run("restore", "none").startswith("tessera:") and run("prune", "--older-than", "1h") == "0 removed, 2 kept" and run("status").startswith("2 snapshots, 0 KiB, not watched")


def test_watching_a_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1")
    w = Workspace(spark, str(tmp_path))
    FS.save_config(f"{w.state}/config.json", FS.Config(index_on_watch=False))
    assert w.status()["watching"] is None
    watching = w.watch()
    try:
        assert w.status()["watching"] == os.getpid() and watching.flush().seq == 1
        with pytest.raises(RuntimeError):
            w.watch()
        end = time.time() + 120
        while time.time() < end and w.status()["snapshots"] < 2:
            (tmp_path / "b.txt").write_text("2")
            time.sleep(4)
        assert w.store.tip().seq == 2 and {r.path for r in w.changed(w.store.tip().id).collect()} == {"b.txt"}
    finally:
        watching.close()
    assert w.status()["watching"] is None
    (tmp_path / ".tessera/watch.pid").write_text("999999999 " + socket.gethostname())
    assert w.status()["watching"] is None and not (tmp_path / ".tessera/watch.pid").exists()


def test_stream_of_changes(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    burst = [("r", f"src/f{i}.py", "change", start + dt.timedelta(milliseconds=30 * i)) for i in range(8)]
    noise = [("r", "node_modules/x.js", "change", start + dt.timedelta(seconds=2))]
    late = [("r", "src/z.py", "change", start + dt.timedelta(seconds=60))]
    for k, rows in enumerate([burst + noise, late, [("r", "src/z.py", "change", start + dt.timedelta(seconds=120))]]):
        spark.createDataFrame(rows, "repo string, path string, op string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        time.sleep(0.05)
    events = spark.readStream.schema("repo string, path string, op string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    seen, flushed, errors = [], [], []

    def flush(batch, batch_id):
        rows = batch.collect()
        seen.extend((r.n, r.source) for r in rows)
        if rows[0].n == 1:
            raise ValueError("broken flush")
        return True

    bursts = W.debounced(W.watched(events), "300 milliseconds", "1 second")
    q = W.watch(bursts, flush, str(tmp_path / "c"), flushed.append, errors.append, {"availableNow": True})
    q.awaitTermination(120)
    assert seen[0] == (8, "watch") and len(flushed) == 1
    assert all(isinstance(e, ValueError) for e in errors)


def test_stream_keeps_versions_that_differ(spark, tmp_path):
    for k, rows in enumerate([[("r", 1, "a"), ("r", 2, "a"), ("s", 1, "x")], [("r", 3, "a"), ("r", 4, "b"), ("s", 2, "x"), ("r", 5, "a")]]):
        spark.createDataFrame(rows, "repo string, seq long, tree string").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        time.sleep(0.05)
    stream = spark.readStream.schema("repo string, seq long, tree string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = W.changed_versions(stream).writeStream.format("memory").queryName("kept_versions").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert sorted(tuple(r) for r in spark.table("kept_versions").collect()) == [("r", 1, "a"), ("r", 4, "b"), ("r", 5, "a"), ("s", 1, "x")]
