"""The store: Parquet tables in versioned folders and a log of versions.

A commit writes the changed tables beside the old ones and then adds one file to the log, `log/<version>`, which names
the folders of all tables.  The file is complete before it gets that name, and the name can be given once only, so
readers see either all of a commit or none, and of two writers that started from the same version one fails.  Syncs start
again then, and rows that are only added are added to the newer version.  A version also holds the schema version and
chunk size; a store made with others is rebuilt from the sources, which keeps only the embedding cache.

A sync adds the chunks of new and changed files, each with its part of the index, and the numbers of what it replaces or
removes; readers leave out chunks whose number is gone.  So chunks and index are written once and never dealt out.  They
are written anew, without what is gone, after `SYNC_FOLDERS` syncs or when more is gone than left.

The lock of the one embedding writer is a lease with the holder's host: it counts until it is given back or runs out; on
the holder's own host also no longer than its process.
"""

from __future__ import annotations

import contextlib
import json
import os
import socket
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from memloom.operators import index as ix
from memloom.operators import sync as sy
from memloom.operators.chunkers import chunked
from memloom.operators.search import Index, counted_accesses
from memloom.operators.status import counts, warnings
from memloom.schemas import SCHEMA_VERSION, STORED, TABLES
from memloom.session import spread

LOG, LOCK, LOCK_MS = "log", "LOCK", 3_600_000
TRIES = 5
LOG_FOLDERS = 64  # of the access log, before they are put together
SYNC_FOLDERS = 64  # of chunks, likewise


class Conflict(RuntimeError):
    """Another writer committed first."""


class Store:
    def __init__(self, spark: SparkSession, root: str, chunk_size: int = 512):
        self.spark, self.root, self.chunk_size = spark, root.rstrip("/"), int(chunk_size)
        jvm = spark._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        self._fs = self._path("x").getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("x").toUri(), spark._jsc.hadoopConfiguration())
        self._held: str | None = None
        state = self._latest()
        if state and (state["schema_version"], state["chunk_size"]) != (SCHEMA_VERSION, self.chunk_size):
            self._put({"version": state["version"] + 1, "tables": {k: v for k, v in state["tables"].items() if k == "cache"}})

    # files of the store

    def _read(self, name: str) -> dict | None:
        if not self._fs.exists(self._path(name)):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write_once(self, name: str, data: dict) -> bool:
        """A file with all of its content, unless there is one of this name already; False then."""
        new = self._path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(new, False)
        stream.write(bytearray(json.dumps(data).encode()))
        stream.close()
        try:
            if self._fs.getScheme() == "file":  # renaming would replace the other file here, linking doesn't
                os.link(new.toUri().getPath(), self._path(name).toUri().getPath())
            else:
                self._context.rename(new, self._path(name), self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception:
            if self._fs.exists(self._path(name)):
                return False
            raise
        finally:
            self._fs.delete(new, False)
        return True

    def _versions(self) -> list[str]:
        if not self._fs.exists(self._path(LOG)):
            return []
        return sorted(n for s in self._fs.listStatus(self._path(LOG)) if (n := s.getPath().getName()).isdigit())

    def _latest(self) -> dict | None:
        found = self._versions()
        return self._read(f"{LOG}/{found[-1]}") if found else None

    def _put(self, state: dict) -> None:
        if not self._write_once(f"{LOG}/{state['version']:012d}", state | {"schema_version": SCHEMA_VERSION, "chunk_size": self.chunk_size}):
            raise Conflict("the store changed meanwhile")

    @property
    def state(self) -> dict:
        return self._latest() or {"version": 0, "tables": {}}

    def table(self, name: str) -> DataFrame:
        state = self.state
        if name == "postings":
            return ix.postings_of(self._chunks(state))
        if name == "doc_stats":
            return ix.lengths_of(self._chunks(state))
        rows = self._chunks(state) if name == "chunks" else self._stored(name, state)
        return rows.select(*_columns(TABLES[name]))

    def _stored(self, name: str, state: dict) -> DataFrame:
        at = state["tables"].get(name)
        if not at:
            return self.spark.createDataFrame([], STORED[name]).where("false")
        return self.spark.read.schema(STORED[name]).parquet(*(f"{self.root}/{x}" for x in at))

    def _chunks(self, state: dict) -> DataFrame:
        """Chunks that are not gone, with their part of the index."""
        rows = self._stored("chunks", state)
        return sy.left_of(rows, self._stored("gone", state)) if state["tables"].get("gone") else rows

    def _write(self, rows: DataFrame, at: str) -> None:
        rows.write.option("compression", "zstd").parquet(f"{self.root}/{at}")

    def commit(self, tables: dict[str, DataFrame], append: dict[str, DataFrame] | None = None, since: dict | None = None, marks: dict | None = None) -> int:
        """New contents of some tables, rows to add to others; the rest stays.

        `since` is the state that the new contents were made from (by default what is there now): raises `Conflict` where
        another writer was faster.  Rows that are only added don't depend on it and go to whatever is the latest version.
        `marks` are what else the version's file says.
        """
        state, made = since or self.state, {}
        for name, rows in {**tables, **(append or {})}.items():
            made[name] = f"{name}/v={state['version'] + 1}-{uuid.uuid4().hex[:8]}"
            self._write(rows.select(*_columns(STORED[name])), made[name])
        for left in reversed(range(TRIES)):
            places = dict(state["tables"])
            for name, at in made.items():
                places[name] = [*places.get(name, []), at] if name not in tables else [at]
            try:
                self._put({**state, **(marks or {}), "version": state["version"] + 1, "tables": places})
                return state["version"] + 1
            except Conflict:
                if tables or not left:
                    raise
                state = self.state
        raise AssertionError

    def vacuum(self, work: bool = True) -> int:
        """Removes table folders that the latest version doesn't name, older versions, and what stopped writers left in work/."""
        kept, gone = {x for v in self.state["tables"].values() for x in v}, 0
        for name in STORED:
            if self._fs.exists(self._path(name)):
                for s in self._fs.listStatus(self._path(name)):
                    if f"{name}/{s.getPath().getName()}" not in kept:
                        gone += self._fs.delete(s.getPath(), True)
        for name in self._versions()[:-1]:
            self._fs.delete(self._path(f"{LOG}/{name}"), False)
        if work:
            self._fs.delete(self._path("work"), True)
        return gone

    # one writer

    def lock(self, now_ms: int | None = None) -> bool:
        now = now_ms or int(time.time() * 1000)
        own = {"id": uuid.uuid4().hex, "host": socket.gethostname(), "pid": os.getpid(), "started_at": now}
        held = self._read(LOCK)
        if held:
            if now - held["started_at"] < LOCK_MS and (held["host"] != own["host"] or _alive(held["pid"])):
                return False
            old = f"{LOCK}.{own['id']}.old"
            if not self._fs.rename(self._path(LOCK), self._path(old)):
                return False
            moved = self._read(old)
            if moved["id"] != held["id"]:  # another writer took over between the two calls: give it back
                self._write_once(LOCK, moved)
                self._fs.delete(self._path(old), False)
                return False
            self._fs.delete(self._path(old), False)
        if not self._write_once(LOCK, own):
            return False
        self._held = own["id"]
        return True

    def unlock(self) -> None:
        held = self._read(LOCK)
        if held and held["id"] == self._held:
            self._fs.delete(self._path(LOCK), False)
        self._held = None

    # operations

    def stats(self, source: str) -> dict[str, tuple[float, int]]:
        """Time and size of each file of a workspace source, so that only what changed has to be read."""
        return {r["path"]: (r["mtime_ms"], r["size"]) for r in self.table("files").where(F.col("source") == source).select("path", "mtime_ms", "size").collect()}

    def sync(self, listing: DataFrame, source: str = "memory", force: bool = False, now_ms: int | None = None) -> dict:
        """Brings one source's files up to date: {indexed, skipped, deleted}. Starts again where another writer was faster."""
        return self._again(lambda work: self._sync(listing, source, force, now_ms or int(time.time() * 1000), work))

    def _again(self, write: Callable[[str], dict | bool]) -> dict | bool:
        for left in reversed(range(TRIES)):
            work = f"work/{uuid.uuid4().hex}"
            try:
                return write(work)
            except Conflict:
                if not left:
                    raise
            finally:
                self._fs.delete(self._path(work), True)
        raise AssertionError

    def _sync(self, listing: DataFrame, source: str, force: bool, now: int, work: str) -> dict:
        since = self.state
        files = self.table("files")
        protect = source != "sessions"
        number = F.when(F.col("action") == "index", F.lit(since.get("next", 0)) + F.monotonically_increasing_id()).otherwise(F.col("no"))
        found = sy.classify(listing, files.where(F.col("source") == source), force, protect).withColumn("was", F.col("no")).withColumn("no", number)
        self._write(found, f"{work}/plan")
        plan = self.spark.read.schema(found.schema).parquet(f"{self.root}/{work}/plan")
        done = sy.outcome(plan).first().asDict()
        if done["indexed"] or done["deleted"] or plan.where("action = 'touch'").limit(1).count():
            new, old = plan.where("action = 'index'"), plan.where("was is not null and action in ('index', 'delete')").count()
            tables, append = {"files": files.where(F.col("source") != source).unionByName(sy.next_files(plan))}, {}
            marks = {"dead": since.get("dead", 0) + old}
            if done["indexed"]:
                fresh = chunked(spread(new), self.chunk_size, numbered=True)
                # only a file that is listed twice can have a chunk twice
                name = F.concat_ws(":", F.coalesce("source", F.lit("None")), F.coalesce("path", F.lit("None")))
                if not new.groupBy(name.alias("name")).count().where("count > 1").isEmpty():
                    fresh = fresh.dropDuplicates(["id"])
                append["chunks"] = ix.with_index(fresh, fresh.columns).withColumn("updated_at", F.lit(now).cast("long"))
                marks["next"] = new.agg(F.max("no")).first()[0] + 1
            if old:
                append["gone"] = sy.gone(plan)
            self.commit(tables, append, since, marks)
            self._put_together()
        return {k: int(v or 0) for k, v in done.items()}

    def _put_together(self) -> None:
        state = self.state
        dead = state.get("dead", 0)
        if (dead and dead > self.table("files").count()) or len(state["tables"].get("chunks", [])) >= SYNC_FOLDERS:
            with contextlib.suppress(Conflict):  # the next sync does it
                self.commit({"chunks": self._chunks(state), "gone": self._stored("gone", state).where("false")}, since=state, marks={"dead": 0})

    def backfill(self, embed_fn: sy.EmbedFn | None, now_ms: int | None = None) -> bool:
        """Vectors of all chunks that lack one. False where another writer holds the lock."""
        if not self.lock():
            return False
        try:
            return self._again(lambda work: self._backfill(embed_fn, now_ms or int(time.time() * 1000), work))
        finally:
            self.unlock()

    def _backfill(self, embed_fn: sy.EmbedFn | None, now: int, work: str) -> bool:
        n = iter(range(1000))

        def materialize(df: DataFrame) -> DataFrame:
            at = f"{work}/{next(n)}"
            self._write(df, at)
            return self.spark.read.schema(df.schema).parquet(f"{self.root}/{at}")

        since = self.state
        cache = sy.salvaged(self.table("vectors"), self.table("chunks"), self.table("cache"))
        vectors, cache = sy.backfill(self.table("chunks"), self.table("vectors"), cache, embed_fn, now, materialize)
        self.commit({"vectors": vectors, "cache": cache}, since=since)
        return True

    def record(self, accesses: DataFrame) -> None:
        """Adds to the access log; from `LOG_FOLDERS` folders on it becomes one again."""
        state = self.state
        if len(state["tables"].get("access", [])) < LOG_FOLDERS:
            self.commit({}, {"access": accesses})
            return
        try:
            self.commit({"access": self.table("access").unionByName(accesses).coalesce(1)}, since=state)
        except Conflict:
            self.commit({}, {"access": accesses})

    def index(self) -> Index:
        """For search. Accesses from before a chunk's last indexing don't count."""
        chunks, log = self.table("chunks"), self.table("access")
        access = counted_accesses(chunks, log)
        has = self.state["tables"]
        return Index(chunks, self.table("postings"), self.table("doc_stats"), self.table("vectors") if "vectors" in has else None, self.table("files"), access)

    def status(self) -> dict:
        files, chunks = self.table("files"), self.table("chunks")
        return counts(files, chunks, self.table("vectors"), self.table("cache")).first().asDict() | {"warnings": warnings(files, chunks)}


def _columns(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        return True
    return True
