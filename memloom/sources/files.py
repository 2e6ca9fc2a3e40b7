"""Finding and reading memory files.

A workspace is a small tree whose listing is driver work (`list_files`); a large tree in any store that Spark reads is
listed and read by `scan_tree`.
"""

from __future__ import annotations

import os
from collections import Counter
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from memloom.functions import text as tx
from memloom.functions.scores import ROOT_FILES
from memloom.schemas import LISTING

# The extensions that are indexed.
EXTENSIONS = (".md", ".txt", ".json", ".jsonl", ".yaml", ".yml")
ALIAS_ROUNDS = 10


@dataclass(frozen=True)
class FileStat:
    path: str  # as stored: relative to the workspace, or extra:<alias>/<relative>
    place: str
    mtime_ms: float
    size: int


def aliases(dirs: list[str]) -> dict[str, str]:
    """A short unique name for each directory: its last part, with parents in front where names meet, then numbers."""
    parts = {d: [p for p in d.split(os.sep) if p] or [d] for d in dirs}
    depth = dict.fromkeys(dirs, 1)
    name = lambda d: "-".join(parts[d][-depth[d] :])
    for _ in range(ALIAS_ROUNDS):
        count = Counter(map(name, depth))
        if not (meeting := [d for d in depth if count[name(d)] > 1]):
            break
        for d in meeting:
            depth[d] = min(depth[d] + 1, len(parts[d]))
    used: Counter = Counter()
    out = {}
    for d in depth:
        out[d] = f"{name(d)}-{used[name(d)]}" if used[name(d)] else name(d)
        used[name(d)] += 1
    return out


def _walk(top: Path, links: list[str]) -> list[Path]:
    found = []
    for entry in sorted(os.scandir(top), key=lambda e: e.name) if top.is_dir() else []:
        if entry.is_symlink():
            links.append(entry.path)
        elif entry.is_dir():
            found += _walk(Path(entry.path), links)
        elif entry.is_file() and os.path.splitext(entry.name)[1].lower() in EXTENSIONS:
            found.append(Path(entry.path))
    return found


def stored_path(place: str | Path, workspace: str, extra: dict[str, str]) -> str:
    relative = os.path.relpath(place, workspace)
    if not relative.startswith(".."):
        return relative.replace(os.sep, "/")
    for top, alias in extra.items():
        inside = os.path.relpath(place, top)
        if not inside.startswith(".."):
            return f"extra:{alias}/{inside}".replace(os.sep, "/")
    return str(place)


def list_files(workspace: str, extra_dirs: tuple[str, ...] = ()) -> tuple[list[FileStat], list[str]]:
    """Stats of root files, memory/ and the extra directories, each real file once; and the links that were passed over."""
    links: list[str] = []
    roots = [p for n in ROOT_FILES if (p := Path(workspace, n)).is_file() and not p.is_symlink()]
    places = roots + _walk(Path(workspace, "memory"), links)
    for d in extra_dirs:
        if os.path.islink(d):
            links.append(d)
        else:
            places += [Path(d)] if os.path.isfile(d) and os.path.splitext(d)[1].lower() in EXTENSIONS else _walk(Path(d), links)
    named, seen, out = aliases(list(extra_dirs)), set(), []
    for p in places:
        if (real := os.path.realpath(p)) not in seen:
            seen.add(real)
            s = p.stat()
            out.append(FileStat(stored_path(p, workspace, named), str(p), s.st_mtime_ns / 1e6, s.st_size))
    return out, links


def changed(s: FileStat, known: dict[str, tuple[float, int]]) -> bool:
    """Whether a file has another time or size than when it was last indexed, so that it has to be read."""
    old = known.get(s.path)
    return old is None or abs(s.mtime_ms - old[0]) >= 1 or s.size != old[1]


def listing(spark: SparkSession, stats: list[FileStat], source: str = "memory", known: dict[str, tuple[float, int]] | None = None) -> DataFrame:
    """path, source, mtime_ms, size, text (null where a file can't be read, or needn't be: its time and size are as `known`)."""
    rows = []
    for s in stats:
        try:
            text = Path(s.place).read_text(encoding="utf-8", errors="replace") if changed(s, known or {}) else None
        except OSError:
            text = None
        rows.append((s.path, source, s.mtime_ms, s.size, text))
    return spark.createDataFrame(rows, LISTING)


def scan_tree(spark: SparkSession, top: str, source: str = "memory", prefix: str = "", content: bool = True) -> DataFrame:
    """All files of the known extensions below `top`; without content only their metadata is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(top)
    base = F.concat(F.lit(prefix), F.regexp_replace("path", "^.*?" + _quoted(top.rstrip("/").split(":")[-1].lstrip("/")) + "/", ""))
    kept = files.where(tx.extension(F.col("path")).isin(*EXTENSIONS))
    text = F.decode("content", "UTF-8") if content else F.lit(None).cast("string")
    mtime = F.unix_micros("modificationTime") / 1000
    return kept.select(base.alias("path"), F.lit(source).alias("source"), mtime.alias("mtime_ms"), F.col("length").alias("size"), text.alias("text"))


def _quoted(x: str) -> str:
    return "\\Q" + x + "\\E"


def authorized(path: str, workspace: str, extra_dirs: tuple[str, ...] = ()) -> str | None:
    """The real place of a stored path that may be read, or None."""
    named = aliases(list(extra_dirs))
    if path.startswith("extra:"):
        alias, _, inside = path.removeprefix("extra:").partition("/")
        top = next((d for d, a in named.items() if a == alias), None)
        if top is None:
            return None
        place = os.path.realpath(os.path.join(top, inside))
        allowed = [os.path.realpath(top)]
    else:
        place = os.path.realpath(os.path.join(workspace, path))
        allowed = [os.path.realpath(d) for d in (os.path.join(workspace, "memory"), *extra_dirs)]
    root = place in {os.path.realpath(os.path.join(workspace, n)) for n in ROOT_FILES}
    inside_one = any(place == a or place.startswith(a + os.sep) for a in allowed)
    known = os.path.splitext(place)[1].lower() in EXTENSIONS
    return place if (root or inside_one) and known and os.path.isfile(place) else None


def read_range(path: str, workspace: str, extra_dirs: tuple[str, ...] = (), first: int | None = None, count: int | None = None) -> str:
    """Lines of one file; the whole file where neither bound is given."""
    place = authorized(path, workspace, extra_dirs)
    if place is None:
        raise PermissionError(path)
    text = Path(place).read_text(encoding="utf-8", errors="replace")
    if not first and not count:
        return text
    lines, start = text.split("\n"), max(1, int(first or 1)) - 1
    return "\n".join(lines[start : start + max(1, int(count))] if count else lines[start:])
