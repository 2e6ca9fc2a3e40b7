"""Chunkers: one file becomes line-addressed chunks.

Plain functions from a text to (first line, last line, text), and `chunked`, which runs them over Arrow batches.
Lengths are UTF-16 code units throughout.  A chunk size below 64 tokens is refused, because long lines would then
never end.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from memloom.functions import text as tx

Chunk = tuple[int, int, str]
LEAST_TOKENS = 64
# The characters that ECMAScript counts as white space, as a regular expression's set.
WS = "\\t\\n\\x0b\\f\\r \\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
TRIM = "".join(chr(c) for c in range(0x10000) if re.match(f"[{WS}]", chr(c)))
# The patterns of headings, keys and separators.
HEADING = re.compile(f"#{{1,6}}[{WS}]")
JSON_KEY = re.compile(f'[{WS}]*"([^"]+)"[{WS}]*:')
YAML_KEY = re.compile(f"[A-Za-z_][A-Za-z0-9_.\\-]*[{WS}]*:")
YAML_BREAK = re.compile(f"---[{WS}]*\\Z")
LAST_COMMA = re.compile(f",[{WS}]*\\Z")
BRACKET = re.compile(r"[{}\[\]]")


def units(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def unit_slice(text: str, start: int, end: int) -> str:
    if text.isascii():
        return text[start:end]
    return text.encode("utf-16-le", "surrogatepass")[2 * start : 2 * end].decode("utf-16-le", "replace")


def _cut_line(line: str, number: int, width: int) -> Iterator[Chunk]:
    step = width - max(64, width >> 3)
    yield from ((number, number, unit_slice(line, at, at + width)) for at in range(0, units(line), step))


def _lines(lines: list[str], first: int, end: int) -> Chunk:
    return first + 1, end, "\n".join(lines[first:end])


def whole(text: str) -> list[Chunk]:
    return [(1, text.count("\n") + 1, text)] if text.strip(TRIM) else []


def markdown(text: str, tokens: int = 512, overlap: int = 64) -> list[Chunk]:
    """Line windows of at most 4 * tokens units; headings start a new one, full ones repeat their last lines."""
    most, back = max(32, 4 * tokens), max(0, 4 * overlap)
    if most <= 64:
        raise ValueError("chunks of 16 tokens or less can't hold a long line's overlap")
    lines = text.split("\n")
    before = [0, *accumulate(units(x) + 1 for x in lines)]  # units before each line
    out: list[Chunk] = []
    long = [i for i in range(len(lines)) if before[i + 1] - before[i] > most]
    starts = sorted({0, len(lines), *long, *(i + 1 for i in long), *(i for i, x in enumerate(lines) if HEADING.match(x))})
    for first, end in zip(starts, starts[1:]):
        if before[first + 1] - before[first] > most:
            out += _cut_line(lines[first], first + 1, most)
            continue
        at, reach = first, first + 1  # a window from `at` that has to take the lines before `reach`
        while True:
            stop = min(end, max(reach, bisect.bisect_right(before, before[at] + most) - 1))
            out.append(_lines(lines, at, stop))
            if stop == end:
                break
            at = max(at, bisect.bisect_right(before, before[stop] - back) - 1) if back else stop
            reach = stop + 1
    return out


def json_chunks(text: str) -> list[Chunk]:
    """An object by its top-level keys, an array by its elements; anything else is one chunk."""

    def refuse(x: str):
        raise ValueError(x)

    try:
        value = json.loads(text, parse_constant=refuse)
    except (ValueError, RecursionError):
        return whole(text)
    if isinstance(value, list):
        return (_elements(text) if len(value) > 1 else []) or whole(text)
    if not isinstance(value, dict):
        return whole(text)
    lines = text.split("\n")
    depth = [0, *accumulate(len(re.findall(r"[{\[]", x)) - len(re.findall(r"[}\]]", x)) for x in lines)]
    found: dict[str, int] = {}
    for i, line in enumerate(lines):
        if depth[i] == 1 and (m := JSON_KEY.match(line)) and m[1] in value:
            found.setdefault(m[1], i)
    bounds = [*sorted(found.values()), len(lines)]
    parts = (_lines(lines, a, b) for a, b in zip(bounds, bounds[1:]))
    return [(a, b, t) for a, b, x in parts if (t := LAST_COMMA.sub("", x)).strip(TRIM)] or whole(text)


def _elements(text: str) -> list[Chunk]:
    lines = text.split("\n")
    line_starts = [0, *accumulate(len(x) + 1 for x in lines)]
    line_of = lambda at: bisect.bisect_right(line_starts, at) - 1
    depth, opened, out = 0, None, []
    for m in BRACKET.finditer(text):
        if m[0] in "{[":
            depth += 1
            if depth == 2 and opened is None:
                opened = line_of(m.start())
        else:
            depth -= 1
            if depth == 1 and opened is not None:
                a, b, x = _lines(lines, opened, line_of(m.start()) + 1)
                if (x := LAST_COMMA.sub("", x)).strip(TRIM):
                    out.append((a, b, x))
                opened = None
    return out


def jsonl(text: str) -> list[Chunk]:
    return [(i, i, x) for i, line in enumerate(text.split("\n"), 1) if (x := line.strip(TRIM))]


def yaml(text: str) -> list[Chunk]:
    """Several documents by their separators, else one by its top-level keys."""
    lines = text.split("\n")
    breaks = [i for i, x in enumerate(lines) if YAML_BREAK.match(x)]
    if len(breaks) >= 2:
        parts = [_lines(lines, a, b) for a, b in zip(breaks, [*breaks[1:], len(lines)])]
        return [p for p in parts if "".join(x for x in p[2].split("\n") if not YAML_BREAK.match(x)).strip(TRIM)]
    keys = [i for i, x in enumerate(lines) if YAML_KEY.match(x)]
    if len(keys) < 2:
        return whole(text)
    return [_lines(lines, a, b) for a, b in zip(keys, [*keys[1:], len(lines)])]


def split_oversized(chunks: list[Chunk], most: int) -> list[Chunk]:
    """Chunks over `most` units as packs of whole lines; lines over it are cut."""
    out: list[Chunk] = []
    for first, last, text in chunks:
        if units(text) <= most:
            out.append((first, last, text))
            continue
        lines = text.split("\n")
        cost = [units(x) + 1 for x in lines]
        at = 0
        while at < len(lines):
            if cost[at] - 1 > most:
                out += _cut_line(lines[at], first + at, most)
                at += 1
                continue
            end, held = at + 1, cost[at]
            while end < len(lines) and cost[end] - 1 <= most and held + cost[end] <= most:
                held += cost[end]
                end += 1
            a, b, x = _lines(lines, at, end)
            out.append((first + a - 1, first + b - 1, x))
            at = end
    return out


def chunk_file(text: str, path: str, chunk_size: int = 512) -> list[Chunk]:
    """By the path's extension. Chunks of blanks only are left out, and so are exact repeats of a chunk at its place."""
    if chunk_size < LEAST_TOKENS:
        raise ValueError(f"a chunk has {LEAST_TOKENS} tokens or more")
    ext = m[0].lower() if (m := re.search(r"\.[^./]*\Z", path)) else ""
    kinds = {".json": json_chunks, ".jsonl": jsonl, ".yaml": yaml, ".yml": yaml}
    got = split_oversized(kinds[ext](text), 4 * chunk_size) if ext in kinds else markdown(text, int(chunk_size), int(chunk_size) // 8)
    return list(dict.fromkeys(c for c in got if c[2].strip(TRIM)))


CHUNKED = "path string, source string, start_line int, end_line int, text string, hash string, id string"


def chunk_id(source: str, path: str, start: int, end: int, content_hash: str) -> str:
    return hashlib.sha256(f"{source}:{path}:{start}:{end}:{content_hash}".encode()).hexdigest()


def chunked(files: DataFrame, chunk_size: int = 512, sessions_as_markdown: bool = True, numbered: bool = False) -> DataFrame:
    """files: path, source, text, and their number `no` if `numbered`. One row a chunk, with its content hash and id (and its file's number)."""
    if chunk_size < LEAST_TOKENS:
        raise ValueError(f"a chunk has {LEAST_TOKENS} tokens or more")

    made = CHUNKED + ", no long" * numbered

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in made.split(", ")]
        kinds = [{"int": pa.int32(), "long": pa.int64()}.get(f.split()[1], pa.string()) for f in made.split(", ")]
        for b in batches:
            for i in range(0, b.num_rows, 256):
                rows = []
                for path, source, text, *no in zip(*(c.slice(i, 256).to_pylist() for c in b.columns), strict=True):
                    route = "session.md" if sessions_as_markdown and source == "sessions" else path or ""
                    for first, last, piece in chunk_file(text or "", route, chunk_size):
                        h = hashlib.sha256(piece.encode()).hexdigest()
                        rows.append((path, source, first, last, piece, h, chunk_id(source, path, first, last, h), *no))
                cols = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return files.select("path", "source", "text", *["no"] * numbered).mapInArrow(run, made)


def jsonl_chunked(files: DataFrame) -> DataFrame:
    """The line chunker alone, without leaving the JVM."""
    lines = files.select("path", "source", F.posexplode_outer(F.split("text", "\n", -1)).alias("at", "line"))
    rows = lines.select("path", "source", (F.col("at") + 1).alias("start_line"), (F.col("at") + 1).alias("end_line"), tx.trim(F.col("line")).alias("text")).where("text <> ''")
    hashed = rows.withColumn("hash", tx.content_hash(F.col("text")))
    return hashed.withColumn("id", F.sha2(F.concat_ws(":", "source", "path", "start_line", "end_line", "hash"), 256))
