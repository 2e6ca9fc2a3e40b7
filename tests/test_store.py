import json
import os
import socket
import time

import pytest

from memloom import cli
from memloom.api import Memory
from memloom.config import MemoryConfig, list_profiles, load_config, set_value
from memloom.operators import sync as sy
from memloom.operators.facts import Facts, best_entry, find_by_text
from memloom.operators.store import Conflict, Store
from memloom.sources import files as fi
from memloom.sources import sessions as ss
from memloom.streaming.sync import apply_changes, run_sync, stream_changes
from tests.seed import vector


def listing(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, source string, mtime_ms double, size long, text string")


def embed(texts):
    return [vector(len(t) % 7 + 1, 8) if "skip" not in t else None for t in texts]


def test_sync_scenarios(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    a, b = ("memory/a.md", "memory", 1.0, 5, "# one\nalpha beta"), ("memory/b.yaml", "memory", 1.0, 9, "x: 1\ny: 2")
    assert s.sync(listing(spark, a, b)) == {"indexed": 2, "skipped": 0, "deleted": 0}
    assert s.table("chunks").count() == 3
    assert s.sync(listing(spark, a, b)) == {"indexed": 0, "skipped": 2, "deleted": 0}
    touched = (a[0], a[1], 9.0, 5, a[4])
    assert s.sync(listing(spark, touched, b)) == {"indexed": 0, "skipped": 2, "deleted": 0}
    assert s.table("files").where("path = 'memory/a.md'").first()["mtime_ms"] == 9.0
    changed = (a[0], a[1], 10.0, 6, "# one\ngamma")
    assert s.sync(listing(spark, changed, b)) == {"indexed": 1, "skipped": 1, "deleted": 0}
    assert {r["term"] for r in s.table("postings").collect()} == {"one", "gamma", "x", "y", "1", "2"}
    unread = (a[0], a[1], 11.0, 7, None)
    assert s.sync(listing(spark, unread, b)) == {"indexed": 0, "skipped": 2, "deleted": 0}
    session = ("sessions/s.jsonl", "sessions", 1.0, 1, "User: hi")
    assert s.sync(listing(spark, session), "sessions")["indexed"] == 1
    assert s.sync(listing(spark, session[:2] + (2.0, 2, None)), "sessions") == {"indexed": 0, "skipped": 0, "deleted": 1}
    assert s.sync(listing(spark, b)) == {"indexed": 0, "skipped": 1, "deleted": 1}
    assert s.table("files").count() == 1 and s.table("chunks").count() == 2
    assert s.sync(spark.createDataFrame([], listing(spark, b).schema)) == {"indexed": 0, "skipped": 0, "deleted": 1}
    assert s.vacuum() > 0 and s.status()["files"] == 0


def test_backfill_reuses_and_sweeps(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    s.sync(listing(spark, ("a.jsonl", "memory", 1.0, 1, "one\ntwo\nskip"), ("b.jsonl", "memory", 1.0, 1, "one")))
    assert s.backfill(embed)
    assert s.table("vectors").count() == 3 and s.table("cache").count() == 2
    s.sync(listing(spark, ("a.jsonl", "memory", 2.0, 2, "zero\none")))
    assert s.backfill(None)  # without a model cached content still serves
    assert s.table("vectors").count() == 1
    assert sy.orphan_vectors(s.table("chunks"), s.table("vectors")).count() == 0
    assert [r["text"] for r in sy.missing_vectors(s.table("chunks"), s.table("vectors")).collect()] == ["zero"]
    assert s.lock() and not s.backfill(embed)
    s.unlock()
    assert s.lock(1) and s.lock()  # an old lock is taken over
    s.unlock()


def test_rebuild_keeps_the_cache(spark, tmp_path):
    at = f"file://{tmp_path}/store"
    s = Store(spark, at)
    s.sync(listing(spark, ("a.jsonl", "memory", 1.0, 1, "one")))
    s.backfill(embed)
    again = Store(spark, at, chunk_size=256)
    assert again.table("chunks").count() == 0 and again.table("cache").count() == 1


def test_streamed_sync(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    s.sync(listing(spark, ("old.md", "memory", 1.0, 1, "stays")))
    folder = tmp_path / "changes"
    folder.mkdir()
    rows = [{"path": "a.md", "source": "memory", "mtime_ms": 1.0, "size": 3, "text": "first"}, {"path": "a.md", "source": "memory", "mtime_ms": 2.0, "size": 4, "text": "second"}]
    (folder / "1.json").write_text("\n".join(map(json.dumps, rows)))
    query = run_sync(s, stream_changes(spark, str(folder)), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert query.exception() is None
    assert {r["text"] for r in s.table("chunks").collect()} == {"stays", "second"}
    apply_changes(s, spark.createDataFrame([("a.md", "memory", 3.0, 0, None, True)], "path string, source string, mtime_ms double, size long, text string, deleted boolean"))
    assert {r["path"] for r in s.table("files").collect()} == {"old.md"}


def test_files(tmp_path, spark):
    w, extra = tmp_path / "w", tmp_path / "x" / "vault"
    for p, t in (("MEMORY.md", "root"), ("memory/a.TXT", "a"), ("memory/sub/b.md", "b"), ("memory/c.png", "no")):
        (w / p).parent.mkdir(parents=True, exist_ok=True)
        (w / p).write_text(t)
    extra.mkdir(parents=True)
    (extra / "n.md").write_text("l1\nl2\nl3")
    os.symlink(w / "MEMORY.md", w / "memory" / "link.md")
    found, links = fi.list_files(str(w), (str(extra), str(w / "memory")))
    assert [f.path for f in found] == ["MEMORY.md", "memory/a.TXT", "memory/sub/b.md", "extra:vault/n.md"] and len(links) == 2
    assert fi.aliases(["/a/vault", "/b/vault", "/c"]) == {"/a/vault": "a-vault", "/b/vault": "b-vault", "/c": "c"}
    assert fi.listing(spark, found).where("text = 'root'").count() == 1
    assert fi.read_range("extra:vault/n.md", str(w), (str(extra),), 2, 1) == "l2"
    for bad in ("memory/../secret.md", "/etc/passwd", "extra:none/n.md", "memory/c.png"):
        with pytest.raises(PermissionError):
            fi.read_range(bad, str(w), (str(extra),))
    tree = fi.scan_tree(spark, str(w), content=False)
    assert {r["path"] for r in tree.collect()} >= {"MEMORY.md", "memory/sub/b.md", "memory/a.TXT"}


def test_sessions(spark, tmp_path):
    rec = [
        '{"type": "user", "timestamp": "2024-05-06T01:02:03Z", "cwd": "/home/me/proj", "message": {"role": "user", "content": " hello "}}',
        "", "broken {", "null", '{"no": "type"}',
        '{"type": "user", "message": {"content": "<command-name>x"}}', '{"type": "user", "message": {"content": "/clear"}}',
        '{"type": "assistant", "message": {"content": [{"type": "text", "text": "a"}, {"type": "tool", "text": "no"}, {"type": "text", "text": "b"}]}}',
        '{"type": "user.message", "data": {"content": "/cmd"}}', '{"type": "assistant.message", "data": {"content": " done "}}',
    ]
    p = tmp_path / "proj" / "s1.jsonl"
    p.parent.mkdir()
    p.write_text("\n".join(rec))
    (tmp_path / "proj" / "empty.jsonl").write_text('{"type": "other"}')
    q = tmp_path / "uuid" / "events.jsonl"
    q.parent.mkdir()
    q.write_text('{"type": "user.message", "data": {"content": "hey"}}')
    stats = ss.list_sessions(((str(tmp_path), "claude"),), 30)
    rows = {r["path"]: r["text"] for r in ss.listing(spark, stats).collect()}
    assert rows["sessions/s1.jsonl"] == "Project: proj | Date: 2024-05-06\nUser: hello\nAssistant: a\nb\nAssistant: done"
    assert rows["sessions/empty.jsonl"] is None
    assert rows["sessions/uuid.jsonl"] == "User: hey"
    assert [x.path for x in ss.list_sessions(((str(tmp_path), "copilot"),), 30)] == ["sessions/uuid.jsonl"]
    assert ss.list_sessions(((str(tmp_path), "claude"),), 30, 0) == [] and len(ss.list_sessions(((str(tmp_path), "claude"),), 30, 1)) == 1
    assert ss.list_sessions(((str(tmp_path), "claude"),), 30, now=time.time() + 40 * 86400) == []
    assert {r["path"]: r["text"] for r in ss.scan_tree(spark, str(tmp_path), "claude").collect()} == rows


def test_facts(tmp_path):
    hits = []
    f = Facts(str(tmp_path), lambda q, n, s: hits)
    assert f.write("Use tabs", "Code Style", "chat", "because")["path"] == "memory/code-style.md"
    place = tmp_path / "memory" / "code-style.md"
    assert place.read_text().startswith("# Code-style\n\n- Use tabs [ref:memory/evidence/")
    assert f.write("use  TABS", "code style")["reason"] == "duplicate"
    hits.append({"source": "memory", "score": 0.9, "snippet": "prefer green tea daily", "path": "memory/x.md", "start_line": 1, "end_line": 3})
    assert f.write("green tea daily")["reason"] == "semantic_duplicate"
    hits.clear()
    assert f.write("Likes walks")["stored"]
    assert find_by_text([place], "tabs") == (place, 2) and find_by_text([place], "always use tabs please") == (place, 2)
    assert f.update("Use tabs", "Use spaces", evidence="new")["updated"]
    assert len(list((tmp_path / "memory" / "evidence").iterdir())) == 1
    assert f.forget("spaces")["forgotten"] and not list((tmp_path / "memory" / "evidence").iterdir())
    assert f.forget("nothing such") == {"forgotten": False, "reason": "not_found"}
    assert best_entry(["- a b", "- c d", "x"], 1, 3, "c x d") == 1 and best_entry(["x"], 1, 1, "a") is None and best_entry(["- a", "- b"], 1, 2, "z") == 0


def test_config(tmp_path):
    c = MemoryConfig(fts_weight=-0.5, min_score=5, max_results=5.7, chunk_size=10, token_max=99999)
    assert (c.fts_weight, c.min_score, c.max_results, c.chunk_size, c.token_max) == (0, 1, 6, 64, 16384)
    assert MemoryConfig(chunk_size=None).chunk_size == 512 and MemoryConfig(max_results=200).max_results == 100
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"workspace": "/shared", "minScore": 1, "min_score": 0.2, "profiles": {"work": {"workspace": "/w", "token_max": 50}}}))
    assert load_config(p, "work").workspace == "/w" and load_config(p, "work").token_max == 100 and load_config(p, "work").min_score == 0.2
    assert load_config(p).workspace.endswith("default") and load_config(p, overrides={"workspace": "/o"}).workspace == "/o"
    p.write_text(json.dumps({"workspace": "/flat"}))
    assert load_config(p).workspace == "/flat" and list_profiles(p) == ["default"]
    set_value(p, "max_results", 7, "home")
    assert load_config(p, "home").max_results == 7
    for key, bad in (("max_results", 0), ("max_results", 1.5), ("fts_weight", 2), ("nope", 1)):
        with pytest.raises((ValueError, KeyError)):
            set_value(p, key, bad)


def test_memory_end_to_end(spark, tmp_path):
    (tmp_path / "w" / "memory").mkdir(parents=True)
    (tmp_path / "w" / "MEMORY.md").write_text("# Notes\nUse TypeScript for backends\n")
    for i in range(4):
        (tmp_path / "w" / "memory" / f"n{i}.md").write_text(f"# Note {i}\nsomething about topic{i}\n")
    m = Memory(spark, MemoryConfig(workspace=str(tmp_path / "w"), store=f"file://{tmp_path}/s"))
    assert m.ensure_synced()["memory"]["indexed"] == 5 and m.ensure_synced() == {}
    first = m.search("TypeScript").collect()
    assert [r["path"] for r in first] == ["MEMORY.md"] and m.store.table("access").count() == 1
    assert m.facts.write("Prefers dark mode", "ui")["stored"]
    assert m.search("dark mode", record=False).first()["snippet"].endswith("Prefers dark mode")
    assert m.get("memory/ui.md", 3, 1).startswith("- Prefers dark mode")
    status = m.status()
    assert status["files"] == 6 and status["warnings"] == [] and status["last_sync_at"]


def test_two_writers(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/store"
    a, b = Store(spark, at), Store(spark, at)
    row = lambda name: listing(spark, (name, "memory", 1.0, 1, name))
    a.sync(row("a.md"))
    since, files = b.state, b.table("files")
    a.record(spark.createDataFrame([("a.md", 1, 5)], "path string, start_line int, accessed_at long"))
    with pytest.raises(Conflict):
        b.commit({"files": files}, since=since)
    b.commit({}, {"access": spark.createDataFrame([("a.md", 1, 6)], "path string, start_line int, accessed_at long")}, since=since)
    assert a.table("access").count() == 2  # rows that are only added meet in the latest version
    put, turns = Store._put, iter([True])

    def late(self, state):
        if self is b and next(turns, False):
            a.record(spark.createDataFrame([("a.md", 1, 7)], "path string, start_line int, accessed_at long"))
        put(self, state)

    monkeypatch.setattr(Store, "_put", late)
    assert b.sync(row("b.md")) == {"indexed": 1, "skipped": 0, "deleted": 1}
    assert a.table("access").count() == 3 and [r["path"] for r in a.table("files").collect()] == ["b.md"]
    assert not os.path.exists(tmp_path / "store" / "work" / "x") and not list((tmp_path / "store" / "work").iterdir())
    a.vacuum()
    assert len(list((tmp_path / "store" / "log").glob("0*"))) == 1 and a.table("access").count() == 3


def test_access_log_is_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("memloom.operators.store.LOG_FOLDERS", 3)
    s = Store(spark, f"file://{tmp_path}/store")
    for i in range(5):
        s.record(spark.createDataFrame([("a.md", 1, i)], "path string, start_line int, accessed_at long"))
    assert len(s.state["tables"]["access"]) <= 3 and sorted(r["accessed_at"] for r in s.table("access").collect()) == list(range(5))


def test_lock_is_a_lease(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    own = {"id": "x", "host": "elsewhere", "pid": 1 << 30, "started_at": int(time.time() * 1000)}
    assert s._write_once("LOCK", own) and not s._write_once("LOCK", own)
    assert not s.lock() and not s.backfill(embed)  # another host's process can't be seen from here
    s.unlock()
    assert (tmp_path / "store" / "LOCK").exists()  # not this store's to give back
    assert s.lock(own["started_at"] + 3_600_001)
    s.unlock()
    assert not (tmp_path / "store" / "LOCK").exists()
    assert s._write_once("LOCK", own | {"host": socket.gethostname()}) and s.lock()  # its process has ended
    s.unlock()


def test_unchanged_files_are_not_read(spark, tmp_path, monkeypatch):
    w = tmp_path / "w" / "memory"
    w.mkdir(parents=True)
    logs = tmp_path / "logs" / "p"
    logs.mkdir(parents=True)
    for i in range(3):
        (w / f"n{i}.md").write_text(f"text {i}")
        (logs / f"s{i}.jsonl").write_text(json.dumps({"type": "user", "message": {"content": f"hi {i}"}}))
    m = Memory(spark, MemoryConfig(workspace=str(tmp_path / "w"), store=f"file://{tmp_path}/s", session_dirs=((str(tmp_path / "logs"), "claude"),)))
    assert m.sync()["sessions"]["indexed"] == 3
    read, plain = [], fi.Path.read_text
    monkeypatch.setattr(fi.Path, "read_text", lambda self, *a, **k: read.append(self.name) or plain(self, *a, **k))
    (w / "n1.md").write_text("other text")
    assert m.sync() == {"memory": {"indexed": 1, "skipped": 2, "deleted": 0}, "sessions": {"indexed": 0, "skipped": 3, "deleted": 0}}
    assert read == ["n1.md"]


def test_only_evidence_is_dropped(tmp_path):
    f = Facts(str(tmp_path), lambda q, n, s: [])
    f.write("other", "decisions")
    assert f.write("see the plan [ref:memory/decisions.md]", "notes")["stored"] and f.forget("see the plan")["forgotten"]
    assert f.write("climb [ref:memory/evidence/../decisions.md]", "notes")["stored"] and f.forget("climb")["forgotten"]
    assert (tmp_path / "memory" / "decisions.md").exists()


def test_config_commands(tmp_path, capsys):
    at = ["--config", str(tmp_path / "c.json")]
    assert cli.main([*at, "config", "set", "max_results", "7"]) == 0 and cli.main([*at, "config", "set", "max_results", "700"]) == 1
    assert cli.main([*at, "--profile", "work", "config", "set", "workspace", "/w"]) == 0
    capsys.readouterr()
    assert cli.main([*at, "--profile", "work", "config", "show"]) == 0
    shown = json.loads(capsys.readouterr().out)
    assert (shown["workspace"], shown["max_results"]) == ("/w", 7)
    cli.main([*at, "config", "profiles"])
    assert json.loads(capsys.readouterr().out) == {"profiles": ["default", "work"]}
    cli.main([*at, "config", "drop", "work"])
    assert json.loads(capsys.readouterr().out) == {"dropped": True}


def held(s):
    return {name: sorted(map(str, s.table(name).drop("updated_at").collect())) for name in ("chunks", "postings", "doc_stats")}


def test_a_sync_writes_only_what_changed(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    rows = [(f"memory/{i}.jsonl", "memory", 1.0, 1, f"line {i}\nmore") for i in range(150)]
    s.sync(listing(spark, *rows))
    (first,) = s.state["tables"]["chunks"]
    assert s.sync(listing(spark, ("memory/0.jsonl", "memory", 2.0, 3, "new"), *rows[2:])) == {"indexed": 1, "skipped": 148, "deleted": 1}
    kept, added = s.state["tables"]["chunks"]
    assert kept == first and spark.read.parquet(f"{s.root}/{added}").count() == 1
    assert not {"postings", "doc_stats"} & set(os.listdir(tmp_path / "store"))
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("chunks", "postings", "doc_stats"):  # what is gone goes to the chunks, which stay where they are
            plan = s.table(name)._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        plan = sy.classify(listing(spark, *rows), s.table("files"))._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Sort " not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)


def test_many_syncs_leave_what_one_would(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("memloom.operators.store.SYNC_FOLDERS", 4)
    s, folders = Store(spark, f"file://{tmp_path}/many"), []
    row = lambda i, n: (f"memory/{i}.jsonl", "memory", float(n), n, f"file {i}\nas of {n}\n...")
    at = {i: 0 for i in range(140)}
    # a third changes; most change; few change and some go; all go but one; another one comes
    for n, (changed, left) in enumerate([(range(0), 140), (range(0, 140, 3), 140), (range(10, 140), 140), (range(5), 100), (range(1), 1), (range(200, 201), 201)]):
        at = {i: n if i in changed else at[i] for i in {*at, *changed} if i < left}
        s.sync(listing(spark, *(row(i, k) for i, k in at.items())))
        folders.append(len(s.state["tables"]["chunks"]))
        one = Store(spark, f"file://{tmp_path}/one{n}")
        one.sync(listing(spark, *(row(i, k) for i, k in at.items())))
        assert held(s) == held(one)
        assert {r["id"] for r in s.table("doc_stats").collect()} == {r["id"] for r in s.table("chunks").collect()}
    assert folders[:2] == [1, 2] and 1 in folders[2:] and max(folders) < 4
    s.vacuum()
    assert held(s) == held(one)


def test_a_file_listed_twice(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    s.sync(listing(spark, ("a.jsonl", "memory", 1.0, 1, "one\ntwo"), ("a.jsonl", "memory", 1.0, 2, "one\nthree"), ("b.jsonl", "memory", 1.0, 1, "one")))
    assert sorted(r["text"] for r in s.table("chunks").collect()) == ["one", "one", "three", "two"]
    s.sync(listing(spark, ("a.jsonl", "memory", 1.0, 2, "one\nthree"), ("b.jsonl", "memory", 1.0, 1, "one")))  # as one of both was
    assert sorted(r["text"] for r in s.table("chunks").collect()) == ["one", "one", "three"]
