"""Chat transcripts: JSON lines become one text document a session."""

from __future__ import annotations

import os
import time
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from memloom.functions import text as tx
from memloom.sources.files import FileStat, changed

COMMAND = "^(?:/|<command-|<local-command-)"


def session_path(place: str) -> str:
    """sessions/<id>.jsonl; the id is the folder of an events.jsonl, else the file's stem."""
    p = Path(place)
    return f"sessions/{p.parent.name if p.name == 'events.jsonl' else p.stem}.jsonl"


def session_path_column(place: Column) -> Column:
    folder = F.regexp_extract(place, "([^/]*)/events\\.jsonl\\z", 1)
    stem = F.regexp_extract(place, "([^/]*?)(?:\\.[^./]*)?\\z", 1)
    return F.concat(F.lit("sessions/"), F.when(place.rlike("(^|/)events\\.jsonl\\z"), folder).otherwise(stem), F.lit(".jsonl"))


def list_sessions(dirs: tuple[tuple[str, str], ...], max_days: float = 30, max_count: float = -1, now: float | None = None) -> list[FileStat]:
    """Transcripts of the last days (0: all), the latest first, at most so many (-1: all, 0: none). kinds: copilot, claude."""
    if max_count == 0:
        return []
    oldest = ((now or time.time()) - max_days * 86400) * 1000 if max_days > 0 else 0
    found = []
    for top, kind in dirs:
        for p in sorted(Path(top).glob("*/events.jsonl" if kind == "copilot" else "*/*.jsonl")):
            s = p.stat()
            if p.is_file() and s.st_size > 0 and s.st_mtime_ns / 1e6 >= oldest:
                found.append(FileStat(session_path(str(p)), str(p), s.st_mtime_ns / 1e6, s.st_size))
    found.sort(key=lambda x: -x.mtime_ms)
    return found if max_count < 0 else found[: int(max_count)]


def recent(stats: DataFrame, oldest_ms: float, count: int | None) -> DataFrame:
    """The same choice over a table of path, mtime_ms, size."""
    rows = stats.where((F.col("size") > 0) & (F.col("mtime_ms") >= oldest_ms))
    return rows if count is None else rows.orderBy(F.col("mtime_ms").desc(), "path").limit(count)


def flattened(content: Column) -> Column:
    """A message's content (variant): a string trimmed, or the text blocks of an array joined by new lines."""
    blocks = F.try_variant_get(content, "$", "array<variant>")
    kind = lambda b: F.try_variant_get(b, "$.type", "string")
    texts = F.transform(F.filter(blocks, lambda b: kind(b) == "text"), lambda b: F.try_variant_get(b, "$.text", "string"))
    joined = F.array_join(F.filter(texts, lambda t: t.isNotNull()), "\n")
    is_text = F.schema_of_variant(content) == "STRING"
    return tx.trim(F.when(blocks.isNotNull(), joined).when(is_text, F.try_variant_get(content, "$", "string")))


def messages(lines: DataFrame) -> DataFrame:
    """lines: path, at, value (a JSON line). path, at, stamp, cwd, message (null for records without one to keep).

    Lines that are blank, broken, or not objects with a type are skipped.
    """
    v = F.col("v")
    rows = lines.withColumn("v", F.try_parse_json("value")).withColumn("type", F.try_variant_get(v, "$.type", "string")).where("type is not null")
    raw = F.try_variant_get(v, "$.data.content", "string")
    content = flattened(F.try_variant_get(v, "$.message.content", "variant"))
    user, assistant = F.lit("User: "), F.lit("Assistant: ")
    said = (
        F.when(F.col("type") == "user.message", F.when(~raw.startswith("/"), F.concat(user, tx.trim(raw))))
        .when(F.col("type") == "assistant.message", F.concat(assistant, tx.trim(raw)))
        .when(F.col("type") == "user", F.when(~content.rlike(COMMAND), F.concat(user, content)))
        .when(F.col("type") == "assistant", F.concat(assistant, content))
    )
    said = F.when(~said.isin("User: ", "Assistant: "), said)
    return rows.select("path", "at", F.try_variant_get(v, "$.timestamp", "string").alias("stamp"), F.try_variant_get(v, "$.cwd", "string").alias("cwd"), said.alias("message"))


def documents(rows: DataFrame) -> DataFrame:
    """path, text: each session's messages in order below a line with project and date. Sessions without messages are left out."""
    first = lambda c: F.min_by(F.col(c), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("at")))
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("message").isNotNull(), F.struct("at", "message")))), lambda x: x["message"])
    one = rows.groupBy("path").agg(first("stamp").alias("stamp"), first("cwd").alias("cwd"), lines.alias("lines")).where(F.size("lines") > 0)
    project = F.regexp_extract(F.regexp_replace("cwd", "/+\\z", ""), "([^/]*)\\z", 1)
    date = F.substring("stamp", 1, 10)
    head = F.concat_ws(" | ", F.when(project != "", F.concat(F.lit("Project: "), project)), F.when(date != "", F.concat(F.lit("Date: "), date)))
    return one.select("path", F.concat(F.when(head != "", F.concat(head, F.lit("\n"))).otherwise(""), F.array_join("lines", "\n")).alias("text"))


def listing(spark: SparkSession, stats: list[FileStat], old: dict[str, tuple[float, int]] | None = None) -> DataFrame:
    """path, source, mtime_ms, size, text (null where a transcript has no message, or needn't be read: it is as in `old`)."""
    known = spark.createDataFrame([(s.path, s.place, s.mtime_ms, s.size) for s in stats], "path string, place string, mtime_ms double, size long")
    lines = []
    for s in (s for s in stats if changed(s, old or {})):
        try:
            text = Path(s.place).read_text(encoding="utf-8", errors="replace")
        except OSError:
            text = ""
        lines += [(s.path, i, x) for i, x in enumerate(text.split("\n"))]
    made = documents(messages(spark.createDataFrame(lines, "path string, at int, value string")))
    return known.join(made, "path", "left").select("path", F.lit("sessions").alias("source"), "mtime_ms", "size", "text")


def scan_tree(spark: SparkSession, top: str, kind: str, oldest_ms: float = 0.0) -> DataFrame:
    """The same listing for a large tree in any store that Spark reads."""
    glob = "*/events.jsonl" if kind == "copilot" else "*/*.jsonl"
    files = spark.read.format("binaryFile").load(f"{top.rstrip('/')}/{glob}")
    stats = files.select(session_path_column(F.col("path")).alias("path"), (F.unix_micros("modificationTime") / 1000).alias("mtime_ms"), F.col("length").alias("size"), "content")
    stats = recent(stats, oldest_ms, None)
    lines = stats.select("path", F.posexplode(F.split(F.decode("content", "UTF-8"), "\n", -1)).alias("at", "value"))
    return stats.drop("content").join(documents(messages(lines)), "path", "left").select("path", F.lit("sessions").alias("source"), "mtime_ms", "size", "text")


def exists(place: str) -> bool:
    return os.path.isfile(place)
