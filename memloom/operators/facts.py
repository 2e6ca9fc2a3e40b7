"""Facts in Markdown: writing, finding, replacing and forgetting entries.

One fact's files are driver work and its search is a Spark job; the same rules over tables of entries are DataFrame operators.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window, functions as F

from memloom.functions.scores import ROOT_FILES
from memloom.operators.chunkers import TRIM, WS
from memloom.sources.files import EXTENSIONS

# The patterns of entries and references, and the limits of the duplicate test.
ENTRY = re.compile(f"- (.+?)(?:[{WS}]+\\[ref:.*?\\])?(?:[{WS}]+_\\(source:.*?\\)_)?(?:[{WS}]+—[{WS}]+[0-9]{{4}}.*)?")
REF = re.compile(r"\[ref:(memory/evidence/[^\]\n]+)\]")
BLANKS = re.compile(f"[{WS}]+")
NOT_WORD = re.compile(f"[^a-z0-9一-鿿{WS}-]")
SAME_SCORE, SAME_WORDS, LEAST_WORDS = 0.6, 0.5, 2
#: Called with a query, a number of results and a least score: search results as rows.
SearchFn = Callable[[str, int, float], list[Row]]


def normalized(text: str) -> str:
    return BLANKS.sub(" ", text.lower()).strip(TRIM)


def content_words(text: str) -> set[str]:
    return {w for w in BLANKS.sub(" ", NOT_WORD.sub(" ", text.lower())).split(" ") if len(w) > 1}


def fact_of(line: str) -> str | None:
    return m[1] if (m := ENTRY.fullmatch(line)) else None


def slug(category: str | None) -> str:
    return re.sub("[^a-z0-9_-]", "-", (category or "general").lower())


def stamp(now: datetime | None = None) -> str:
    return (now or datetime.now(UTC)).astimezone(UTC).strftime("%Y-%m-%d %H:%M:%S UTC")


def entry(fact: str, source: str | None = None, ref: str | None = None, now: datetime | None = None) -> str:
    return f"- {fact}" + f" [ref:{ref}]" * bool(ref) + f" _(source: {source})_" * bool(source) + f" — {stamp(now)}"


def targets(workspace: str, category: str | None = None) -> list[Path]:
    """One category's file, or root files and those directly in memory/."""
    memory = Path(workspace, "memory")
    if category:
        return [p] if (p := memory / f"{slug(category)}.md").is_file() else []
    roots = [p for n in ROOT_FILES if (p := Path(workspace, n)).is_file()]
    return roots + [p for p in sorted(memory.iterdir() if memory.is_dir() else []) if p.is_file() and p.suffix.lower() in EXTENSIONS]


def find_by_text(places: list[Path], wanted: str) -> tuple[Path, int] | None:
    """The first entry, in order of files and lines, that equals the normalised text, contains it or lies in it."""
    for place in places:
        for i, line in enumerate(place.read_text(encoding="utf-8").split("\n")):
            fact = fact_of(line)
            if fact is not None and ((have := normalized(fact)) in wanted or wanted in have):
                return place, i
    return None


def best_entry(lines: list[str], first: int, last: int, wanted: str) -> int | None:
    """Of the entries in a line range (from 1) the one that shares the most words; the first of equals."""
    words = set(wanted.split(" "))
    found = [(sum(w in words for w in normalized(f).split(" ")), -i) for i in range(max(0, first - 1), min(len(lines), last)) if (f := fact_of(lines[i])) is not None]
    return -max(found)[1] if found else None


def exact_duplicates(entries: DataFrame) -> DataFrame:
    """entries: path, start_line, fact (normalised). Those whose fact stands in their file already, with `first_line`."""
    first = F.min("start_line").over(Window.partitionBy("path", "fact"))
    return entries.where("fact is not null").withColumn("first_line", first).where("start_line > first_line")


def first_matches(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """path, wanted, start_line: in each file the first entry that equals a normalised text, contains it or lies in it."""
    have, text = F.col("fact"), F.col("wanted")
    return entries.join(wanted, "path").where(F.contains(have, text) | F.contains(text, have)).groupBy("path", "wanted").agg(F.min("start_line").alias("start_line"))


def best_matches(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """path, wanted, shared, start_line: in each file the entry that shares the most words with a text; the first of equals.

    An entry costs as many steps as it and the text have words: the text's are looked up in a set.
    """
    rows = entries.where("fact is not null").join(wanted, "path").select("path", "wanted", F.col("start_line").cast("int"), "fact")
    best = rows.mapInArrow(_shared, "path string, wanted string, start_line int, shared int")
    # one number that is largest for most words, and of equals for the least line
    rank = F.max(F.shiftleft(F.col("shared").cast("long"), 32) - F.col("start_line")).alias("m")
    shared = F.shiftright(F.col("m") + (1 << 31), 32)
    return best.groupBy("path", "wanted").agg(rank).select("path", "wanted", shared.cast("int").alias("shared"), (F.shiftleft(shared, 32) - F.col("m")).cast("int").alias("start_line"))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces `fact` by the number of its words, repeats included, that are among the wanted ones."""
    last, words = None, frozenset()
    for b in batches:
        counts = []
        for wanted, fact in zip(b.column("wanted").to_pylist(), b.column("fact").to_pylist(), strict=True):
            if wanted != last:
                last, words = wanted, frozenset(wanted.split(" ")) if wanted is not None else frozenset()
            counts.append(sum(map(words.__contains__, fact.split(" "))))
        kept = ["path", "wanted", "start_line"]
        yield pa.record_batch([*(b.column(k) for k in kept), pa.array(counts, pa.int32())], names=[*kept, "shared"])


class Facts:
    def __init__(self, workspace: str, search: SearchFn, resync: Callable[[], None] = lambda: None):
        self.workspace, self.search, self.resync = workspace, search, resync

    def _try_resync(self) -> str | None:
        try:
            self.resync()
        except Exception as e:  # a failed sync is told, the change is still made
            return str(e)
        return None

    def _evidence(self, fact: str, text: str | None) -> str | None:
        if not text:
            return None
        name = hashlib.sha256(fact.encode()).hexdigest()[:12]
        place = Path(self.workspace, "memory", "evidence", f"{name}.md")
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_text(f"# {fact}\n\n{text}\n", encoding="utf-8")
        return f"memory/evidence/{name}.md"

    def _drop_evidence(self, line: str) -> None:
        """Removes the evidence file of an entry; what else a reference may name is the user's own."""
        if m := REF.search(line):
            place = os.path.realpath(os.path.join(self.workspace, m[1].strip()))
            if place.startswith(os.path.realpath(os.path.join(self.workspace, "memory", "evidence")) + os.sep) and os.path.isfile(place):
                os.remove(place)

    def similar(self, fact: str) -> dict | None:
        words = content_words(fact)
        for hit in self.search(fact, 3, 0.3):
            if hit["source"] != "memory":
                continue
            for line in hit["snippet"].split("\n"):
                other = content_words(line)
                if len(other) >= LEAST_WORDS and words and hit["score"] > SAME_SCORE and len(words & other) / min(len(words), len(other)) > SAME_WORDS:
                    return {"similar_entry": line.strip(TRIM), "path": hit["path"]}
        return None

    def write(self, fact: str, category: str | None = None, source: str | None = None, evidence: str | None = None, now: datetime | None = None) -> dict:
        name = slug(category)
        place = Path(self.workspace, "memory", f"{name}.md")
        path = f"memory/{name}.md"
        old = place.read_text(encoding="utf-8") if place.is_file() else None
        if old is not None and any(f is not None and normalized(f) == normalized(fact) for f in map(fact_of, old.split("\n"))):
            return {"stored": False, "reason": "duplicate", "path": path}
        problem = self._try_resync()
        told = {"sync_warning": problem} if problem else {}
        if found := self.similar(fact):
            return {"stored": False, "reason": "semantic_duplicate"} | found | told
        place.parent.mkdir(parents=True, exist_ok=True)
        line = entry(fact, source, self._evidence(fact, evidence), now)
        place.write_text((f"# {name.capitalize()}\n\n" if old is None else old if old.endswith("\n") or not old else old + "\n") + line + "\n", encoding="utf-8")
        problem = self._try_resync()
        return {"stored": True, "path": path} | ({"sync_warning": problem} if problem else told)

    def find(self, text: str, category: str | None = None) -> tuple[Path, int] | None:
        """By text, else by search; the search doesn't look at the category."""
        wanted = normalized(text)
        if not wanted:
            return None
        if found := find_by_text(targets(self.workspace, category), wanted):
            return found
        self._try_resync()
        for hit in self.search(text, 5, 0.3):
            place = Path(self.workspace, hit["path"])
            if hit["source"] == "memory" and place.is_file():
                at = best_entry(place.read_text(encoding="utf-8").split("\n"), hit["start_line"], hit["end_line"], wanted)
                if at is not None:
                    return place, at
        return None

    def _replace(self, place: Path, at: int, new: list[str]) -> str:
        lines = place.read_text(encoding="utf-8").split("\n")
        old = lines[at]
        place.write_text("\n".join(lines[:at] + new + lines[at + 1 :]), encoding="utf-8")
        return old

    def forget(self, text: str, category: str | None = None) -> dict:
        if not (found := self.find(text, category)):
            return {"forgotten": False, "reason": "not_found"}
        old = self._replace(*found, [])
        self._drop_evidence(old)
        problem = self._try_resync()
        return {"forgotten": True, "entry": old} | ({"sync_warning": problem} if problem else {})

    def update(self, old_text: str, new_fact: str, category: str | None = None, source: str | None = None, evidence: str | None = None, now: datetime | None = None) -> dict:
        if not (found := self.find(old_text, category)):
            return {"updated": False, "reason": "not_found"}
        line = found[0].read_text(encoding="utf-8").split("\n")[found[1]]
        self._drop_evidence(line)
        new = entry(new_fact, source, self._evidence(new_fact, evidence), now)
        self._replace(*found, [new])
        problem = self._try_resync()
        return {"updated": True, "old": line, "new": new} | ({"sync_warning": problem} if problem else {})
