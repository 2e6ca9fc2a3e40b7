"""One workspace: sync, search, status, reading and facts."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from memloom.config import MemoryConfig
from memloom.operators import search as se
from memloom.operators.facts import Facts
from memloom.operators.store import Store
from memloom.operators.sync import EmbedFn
from memloom.sources import files as fi
from memloom.sources import sessions as ss


# Seconds for which files and sessions count as up to date.
COOLDOWN = {"memory": 5, "sessions": 60}


class Memory:
    def __init__(self, spark: SparkSession, config: MemoryConfig, embed_fn: EmbedFn | None = None):
        self.spark, self.config, self.embed_fn = spark, config, embed_fn
        self.store = Store(spark, config.store, int(config.chunk_size))
        self.synced: dict[str, float] = {}  # seconds since the epoch
        self.facts = Facts(config.workspace, self._fact_search, lambda: self.sync() and None)

    def sync(self, force: bool = False, sources: tuple[str, ...] = ("memory", "sessions")) -> dict[str, dict]:
        c, done = self.config, {}
        if "memory" in sources:
            known = {} if force else self.store.stats("memory")
            done["memory"] = self.store.sync(fi.listing(self.spark, fi.list_files(c.workspace, c.extra_dirs)[0], known=known), "memory", force)
        if "sessions" in sources and c.session_dirs:
            known = {} if force else self.store.stats("sessions")
            done["sessions"] = self.store.sync(ss.listing(self.spark, ss.list_sessions(c.session_dirs, c.session_days, c.session_max), known), "sessions", force)
        if self.embed_fn is not None:
            self.store.backfill(self.embed_fn)
        self.synced |= dict.fromkeys(sources, time.time())
        return done

    def ensure_synced(self) -> dict[str, dict]:
        """Syncs what was last synced longer ago than its cooldown."""
        due = tuple(s for s, seconds in COOLDOWN.items() if time.time() - self.synced.get(s, 0) >= seconds)
        return self.sync(sources=due) if due else {}

    def search(self, query: str, record: bool = True, **options) -> DataFrame:
        c = self.config
        o = se.SearchOptions(**({"max_results": c.max_results, "min_score": c.min_score, "token_max": c.token_max, "fts_weight": c.fts_weight, "record_access": record} | options))
        got = self.embed_fn([query]) if self.embed_fn is not None and query.strip() else None
        out = se.search_one(self.spark, query, self.store.index(), o, got[0] if got else None)
        if record:
            rows = out.collect()  # max_results rows at most
            out = self.spark.createDataFrame(rows, out.schema)
            if rows:
                self.store.record(se.accesses(out, int(time.time() * 1000)))
        return out

    def _fact_search(self, query: str, results: int, least: float) -> list:
        return self.search(query, max_results=results, min_score=least, fts_weight=0.5).orderBy("rank").collect()

    def get(self, path: str, first: int | None = None, count: int | None = None) -> str:
        return fi.read_range(path, self.config.workspace, self.config.extra_dirs, first, count)

    def status(self) -> dict:
        return self.store.status() | {"workspace": self.config.workspace, "store": self.config.store, "last_sync_at": max(self.synced.values(), default=None)}
