"""Substring dedup by recompression.

Levels of naming shorten every document's word sequence: maximal runs of one symbol get a name, then each pair of a
"left" and a "right" symbol (a coin flipped on the symbol) gets a name.  A name is a hash of what it stands for, so that
equal passages carry equal symbols everywhere except near their ends.  With each symbol goes its context: the words that
alone decide that it arises there.

1. A Spark round names `LEVELS` levels of runs and pairs.  Every window of `window` words picks, of the highest symbols
   whose context lies inside it, the one with the least hash.  The choice depends on the window's words only, so equal
   windows pick equal symbols.  A window without such a symbol (long runs of one word) stands for itself.
2. Picked names meet in a table of all names of the round, by their context's hash.  Windows under names that occur once
   are done with; the next round names the next levels over the windows that are left, whose symbols are longer and
   rarer.  Rounds go on while they tell windows apart, up to the level that outgrows a window.
3. Windows under repeated symbols of the last round are verified by 96-bit hashes of all their words.  The first in
   order of (document, position) stays; the words of every other one are removed.

Equal symbols of one task are merged before each exchange, so a passage that half of all documents share costs one row
a task.  Exact copies of a whole text are found beforehand and need no windows.

Defined cases: a null or blank text has no words and nothing to remove; a document with fewer words than a window
keeps them all; rows that repeat an id share its place in the order, so that only the start decides between them, equal
rows don't remove each other's words, and different texts have verdicts of their own; rows with a null id are texts of
their own that come last and don't remove each other's words, only those that they repeat of themselves or of texts with
an id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from memloom.llm.shared import cut, drop
from memloom.llm.textblocks import buckets_for, exchange, mix, pack, packed_batches, running_sequence, span_hash, texts_of, unpack, word_blocks

WINDOW = 20
LEVELS = 2  # named in a round
WORTH = 0.9  # a round that leaves more than this of the windows is the last
FLUSH = 4_000_000  # symbols that a task merges at a time
LAST = (1 << 63) - 1  # the largest number for a row


class Symbols:
    """A block's symbols: name, context [low, high) in words, and document. `edge`: the document's first word and its end."""

    def __init__(self, words: np.ndarray, doc: np.ndarray, first: np.ndarray):
        at = np.arange(len(words))
        self.name, self.low, self.high, self.doc = words, at, at + 1, doc
        self.begin, self.end = first[:-1], first[1:]

    def _take(self, keep: np.ndarray, name: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.name, self.low, self.high, self.doc = name[keep], low[keep], high[keep], self.doc[keep]

    def _beside(self) -> tuple[np.ndarray, np.ndarray]:
        """The low of each one's left and the high of its right neighbour; a document's edge lies outside all windows."""
        low, high = self.begin[self.doc] - 1, self.end[self.doc] + 1
        together = self.doc[1:] == self.doc[:-1]
        low[1:][together] = self.low[:-1][together]
        high[:-1][together] = self.high[1:][together]
        return low, high

    def name_runs(self, salt: int) -> None:
        if not len(self.name):
            return
        low, high = self._beside()
        fresh = np.concatenate([[True], (self.name[1:] != self.name[:-1]) | (self.doc[1:] != self.doc[:-1])])
        start = np.flatnonzero(fresh)
        size = np.diff(np.append(start, len(fresh)))
        with np.errstate(over="ignore"):
            run = mix(self.name[start] * np.uint64(0x9FB21C651E98DF25) + size.astype(np.uint64), salt)
        name = self.name.copy()
        name[start] = np.where(size > 1, run, self.name[start])
        high[start] = high[start + size - 1]
        self._take(fresh, name, low, high)

    def name_pairs(self, salt: int) -> None:
        if not len(self.name):
            return
        near_low, near_high = self._beside()
        left = (mix(self.name, salt) & np.uint64(1)).astype(bool)
        heads = np.zeros(len(left), bool)
        heads[:-1] = left[:-1] & ~left[1:] & (self.doc[1:] == self.doc[:-1])
        tails = np.zeros(len(left), bool)
        tails[1:] = heads[:-1]
        low = np.where(left, self.low, near_low)  # a lone right symbol is one because of what stands before it
        high = np.where(left, near_high, self.high)
        at, name = np.flatnonzero(heads), self.name.copy()
        with np.errstate(over="ignore"):
            name[at] = mix(self.name[at] * np.uint64(0xC2B2AE3D27D4EB4F) + self.name[at + 1], salt + 1)
        high[at] = self.high[at + 1]
        self._take(~tails, name, low, high)


def pick(words: np.ndarray, doc: np.ndarray, first: np.ndarray, window: int = WINDOW, depth: int = LEVELS, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over the windows of a block (or those at `starts`): key, first window start, number of windows, and level of each picked symbol."""
    total = running_sequence(words, 41)
    if starts is None:
        starts = np.flatnonzero(np.arange(len(words)) + window <= first[1:][doc])
    none = np.zeros(0, int)
    if not len(starts):
        return np.zeros(0, np.uint64), none, none, none
    levels, symbols = [], Symbols(words, doc, first)
    for r in range(depth):
        symbols.name_runs(100 + 4 * r)
        symbols.name_pairs(101 + 4 * r)
        levels.append((symbols.name, symbols.low, symbols.high))
    key, owner = np.zeros(len(starts), np.uint64), np.full(len(starts), -1)
    todo = np.arange(len(starts))
    for level, (name, low, high) in reversed(list(enumerate(levels))):
        p = starts[todo]
        lo, hi = np.searchsorted(low, p, "left"), np.searchsorted(high, p + window, "right")
        some = hi > lo
        todo_now, lo, hi = todo[some], lo[some], hi[some]
        best = _least(name, lo, hi)
        key[todo_now] = span_hash(total, low[best], high[best])
        owner[todo_now] = best * depth + level
        todo = todo[~some]
        if not len(todo):
            break
    if len(todo):
        key[todo] = span_hash(total, starts[todo], starts[todo] + window)
        owner[todo] = -2 - todo
    change = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    of = owner[change]
    return key[change], starts[change], np.diff(np.append(change, len(starts))), np.where(of < 0, -1, of % depth)


def _least(name: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Where the least name of [lo, hi) stands, the first of equals, by doubling minima."""
    bits = max(1, int(len(name) - 1).bit_length())
    rank = ((mix(name, 77) >> np.uint64(bits)) << np.uint64(bits)) | np.arange(len(name), dtype=np.uint64)
    out, width = np.zeros(len(lo), np.uint64), hi - lo
    table, size = rank, 1
    while True:
        now = (width >= size) & (width < 2 * size)
        out[now] = np.minimum(table[lo[now]], table[hi[now] - size])
        if not (width >= 2 * size).any():
            return (out & np.uint64((1 << bits) - 1)).astype(np.int64)
        table, size = np.minimum(table[:-size], table[size:]), 2 * size


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before it; the first does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _later(h: np.ndarray, g: np.ndarray, doc: np.ndarray, at: np.ndarray, sub: np.ndarray, border: int) -> tuple[np.ndarray, ...]:
    """The windows in order, which of them go (those whose words start earlier), and which to ask about elsewhere.

    Documents beyond `border` don't see each other.
    """
    order = np.lexsort((sub, at, doc, g, h))
    h, g, doc, at, sub = h[order], g[order], doc[order], at[order], sub[order]
    fresh = _changes(h, g)
    head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    enters = fresh | _changes(doc)
    later = ((doc != doc[head]) | (at != at[head])) & ~(enters & (doc[head] > border))
    return h, g, doc, at, sub, later, ~later & (fresh | _changes(doc, at, sub))


def _per_document(replies: DataFrame, columns: tuple) -> DataFrame:
    """doc_id, sub, spots, windows: the replies to each document, as one packed value, and how many windows they name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(x, np.int64, np.uint32, *columns) for b in batches for x in b.column(1).to_pylist()]
        if not parts:
            return
        doc, sub, *cols = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((sub, doc))
        doc, sub, cols = doc[order], sub[order], [c[order] for c in cols]
        at = np.flatnonzero(_changes(doc, sub))
        ends = np.append(at[1:], len(doc))
        count = np.add.reduceat(cols[1].astype(np.int64), at) if len(cols) > 1 else ends - at
        for i in range(0, len(at), 4096):
            spots = [np.int64(e - s).tobytes() + b"".join(c[s:e].tobytes() for c in cols) for s, e in zip(at[i : i + 4096], ends[i : i + 4096], strict=True)]
            own = at[i : i + 4096]
            yield pa.record_batch([pa.array(doc[own]), pa.array(sub[own].astype(np.int64)), pa.array(spots, pa.binary()), pa.array(count[i : i + 4096])], names=["doc_id", "sub", "spots", "windows"])

    return exchange(replies).mapInArrow(run, "doc_id long, sub long, spots binary, windows long")


def _by_document(doc: np.ndarray, sub: np.ndarray, n: int) -> np.ndarray:
    return (mix(doc.view(np.uint64) ^ mix(sub, 52), 51) % np.uint64(n)).astype(np.int64)


def _starts(spots: list[bytes], block, i: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows that a block's spots (first window, number of windows) name: where they start in the block, and their rows."""
    starts, rows = [], []
    for k in range(block.rows):
        at, size = unpack(spots[i + k], np.int32, np.uint16)
        size = size.astype(np.int64)
        own = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())
        own.sort()
        starts.append(own + block.first[k])
        rows.append(np.full(len(own), k))
    return np.concatenate(starts), np.concatenate(rows)


def _repeated_symbols(texts: DataFrame, n: int, window: int, depth: int) -> DataFrame:
    """A round: doc_id, sub, spots (first window, number of windows) under symbols of up to `depth` levels that occur more than once.

    texts: doc_id, text, sub, and from the second round on the spots that the last one left, of which those under
    symbols that were named before stay as they are.
    """
    known = depth - LEVELS if "spots" in texts.columns else -1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: list) -> Iterator[tuple[int, bytes]]:
            key, doc, at, sub, size, level = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((sub, at, doc, key))
            key, doc, at, sub, size, level = key[order], doc[order], at[order], sub[order], size[order], level[order]
            stays = level < known
            yield from ((n + b, x) for b, x in pack(_by_document(doc[stays], sub[stays], n), n, doc[stays], sub[stays], at[stays], size[stays].astype(np.uint16)))
            key, doc, at, sub, size = (c[~stays] for c in (key, doc, at, sub, size))
            if not len(key):
                return
            fresh = _changes(key)
            count = np.diff(np.append(np.flatnonzero(fresh), len(key)))
            often = np.repeat(count > 1, count)
            # a symbol repeated here is announced once, without windows; its windows need no answer
            yield from pack((key[fresh] % np.uint64(n)).astype(np.int64), n, key[fresh], doc[fresh], at[fresh], sub[fresh], np.where(often, 0, size)[fresh].astype(np.uint16))
            yield from ((n + b, x) for b, x in pack(_by_document(doc[often], sub[often], n), n, doc[often], sub[often], at[often], size[often].astype(np.uint16)))

        def pairs() -> Iterator[tuple[int, bytes]]:
            parts, held = [], 0
            for b in batches:
                ids, subs = np.asarray(b.column(0), np.int64), np.asarray(b.column(2), np.int64).astype(np.uint32)
                for i, block in word_blocks(b.column(1)):
                    row, left = block.row, None if known < 0 else _starts(b.column(3).slice(i, block.rows).to_pylist(), block, 0)[0]
                    key, start, size, level = pick(block.hashes(), row, block.first, window, depth, left)
                    parts.append((key, ids[i + row[start]], (start - block.first[row[start]]).astype(np.int32), subs[i + row[start]], size, level))
                    held += len(key)
                    if held > FLUSH:
                        yield from flush(parts)
                        parts, held = [], 0
            if parts:
                yield from flush(parts)

        yield from packed_batches(pairs())

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[int, bytes]]:
            parts = []
            for b in batches:
                for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if k >= n:
                        yield k - n, x
                    else:
                        parts.append(unpack(x, np.uint64, np.int64, np.int32, np.uint32, np.uint16))
            if parts:
                key, doc, at, sub, size = (np.concatenate(c) for c in zip(*parts, strict=True))
                order = np.lexsort((sub, at, doc, key))
                group = np.cumsum(_changes(key[order])) - 1
                known = np.bincount(group, weights=np.where(size[order] == 0, 2, 1)) > 1
                own = order[known[group] & (size[order] > 0)]
                yield from pack(_by_document(doc[own], sub[own], n), n, doc[own], sub[own], at[own], size[own])

        yield from packed_batches(pairs())

    sent = exchange(texts.mapInArrow(send, "bucket int, data binary"))
    return _per_document(sent.mapInArrow(answer, "bucket int, data binary"), (np.int32, np.uint16))


def _later_windows(rows: DataFrame, n: int, window: int, border: int) -> DataFrame:
    """rows: doc_id, text, sub, spots. doc_id, sub, spots (window starts) whose words also start earlier."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: list) -> Iterator[tuple[int, bytes]]:
            h, g, doc, at, sub, later, asks = _later(*(np.concatenate(c) for c in zip(*parts, strict=True)), border)
            own = np.flatnonzero(asks)
            own = own[np.lexsort((at[own], sub[own], doc[own]))]
            yield from pack((h[own] % np.uint64(n)).astype(np.int64), n, h[own], g[own], doc[own], at[own], sub[own])
            own = np.flatnonzero(later)
            own = own[np.lexsort((at[own], sub[own], doc[own]))]
            yield from ((n + b, x) for b, x in pack(_by_document(doc[own], sub[own], n), n, doc[own], sub[own], at[own]))

        def pairs() -> Iterator[tuple[int, bytes]]:
            parts, held = [], 0
            for b in batches:
                ids, subs, spots = np.asarray(b.column(0), np.int64), np.asarray(b.column(2), np.int64).astype(np.uint32), b.column(3).to_pylist()
                for i, block in word_blocks(b.column(1)):
                    words = block.hashes()
                    total, second = running_sequence(words, 43), running_sequence(words, 47)
                    p, row = _starts(spots, block, i)
                    parts.append((span_hash(total, p, p + window), span_hash(second, p, p + window).astype(np.uint32), ids[i + row], (p - block.first[row]).astype(np.int32), subs[i + row]))
                    held += len(p)
                    if held > FLUSH:
                        yield from flush(parts)
                        parts, held = [], 0
            if parts:
                yield from flush(parts)

        yield from packed_batches(pairs())

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[int, bytes]]:
            parts = []
            for b in batches:
                for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if k >= n:
                        yield k - n, x
                    else:
                        parts.append(unpack(x, np.uint64, np.uint32, np.int64, np.int32, np.uint32))
            if parts:
                _, _, doc, at, sub, later, _ = _later(*(np.concatenate(c) for c in zip(*parts, strict=True)), border)
                own = np.flatnonzero(later)
                own = own[np.lexsort((at[own], sub[own], doc[own]))]
                yield from pack(_by_document(doc[own], sub[own], n), n, doc[own], sub[own], at[own])

        yield from packed_batches(pairs())

    sent = exchange(rows.mapInArrow(send, "bucket int, data binary"))
    return _per_document(sent.mapInArrow(answer, "bucket int, data binary"), (np.int32,))


def _copies(texts: DataFrame, border: int) -> DataFrame:
    """doc_id and sub of every text that a smaller id, up to `border`, has as well."""
    named = texts.where("text is not null").select("doc_id", "sub", F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b"), F.length("text").alias("c"))
    first = cut(named.groupBy("a", "b", "c").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("first") <= border)).drop("n"), "copies")
    return named.join(first, ["a", "b", "c"]).where("doc_id > first").select("doc_id", "sub").distinct()


def _keyed(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows with a number of its own for each null id, and the largest id, beyond which these numbers begin."""
    found = rows.agg(F.max("doc_id").alias("largest"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    border = -1 if found["largest"] is None else found["largest"]
    if not found["nulls"]:
        return rows, border
    if border + found["nulls"] > LAST:
        raise ValueError("ids leave no numbers for the rows without one")
    # in the order of what they hold; equal rows are told apart by their place, and may be spread over tasks
    nulls = rows.where("doc_id is null").orderBy(F.xxhash64("text"), F.xxhash64(*rows.columns[1:]), F.monotonically_increasing_id())
    nulls = cut(nulls.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "null-ids")
    before, total = {}, border + 1
    for r in nulls.groupBy("_part").count().orderBy("_part").collect():  # one row a task
        before[r["_part"]], total = total, total + r["count"]
    first = F.element_at(F.array(*(F.lit(before.get(k, 0)).cast("long") for k in range(max(before) + 1))), F.col("_part") + 1)
    return rows.where("doc_id is not null").unionByName(nulls.withColumn("doc_id", first + F.col("_at")).drop("_part", "_at")), border


def _rounds(texts: DataFrame, copies: DataFrame, n: int, window: int) -> DataFrame:
    """doc_id, sub, spots: the windows that no round of naming has told apart from all others."""
    key, depth = ["doc_id", "sub"], LEVELS
    spots = cut(_repeated_symbols(texts, n, window, depth).join(copies, key, "left_anti"), "symbols")
    left = spots.agg(F.sum("windows")).first()[0] or 0
    # a pair in four is named at each level, so symbols grow by a third
    while left and (4 / 3) ** (depth + LEVELS) < window:
        depth, before = depth + LEVELS, left
        last, spots = spots, cut(_repeated_symbols(texts.join(spots, key).select("doc_id", "text", "sub", "spots"), n, window, depth), "symbols")
        drop(last)
        left = spots.agg(F.sum("windows")).first()[0] or 0
        if left > WORTH * before:
            break
    return spots


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), unchanged: bool = False) -> DataFrame:
    """doc_id, keep columns, n_words, n_removed, kept_text: the words that are left, joined by one space.

    With `unchanged`, a text of which nothing is removed comes back as it was.
    """
    spark = docs.sparkSession
    n = buckets_for(spark)
    own = [F.col(c).alias(f"_{i}") for i, c in enumerate(keep)]
    rows, border = _keyed(texts_of(docs, id_col, text_col, *own))
    # texts under one id are told apart by 32 bits of their hash
    rows = rows.withColumn("sub", F.coalesce(F.xxhash64("text"), F.lit(0)).bitwiseAND(0xFFFFFFFF))
    texts, key = rows.select("doc_id", "text", "sub"), ["doc_id", "sub"]
    copies = cut(_copies(texts, border), "copies")
    spots = _rounds(texts, copies, n, window)
    later = cut(_later_windows(texts.join(spots, key).select("doc_id", "text", "sub", "spots"), n, window, border), "windows")
    marks = later.select(*key, "spots", F.lit(False).alias("copy")).union(copies.select(*key, F.lit(None).cast("binary"), F.lit(True)))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                total, gone, kept = [], [], []
                for text, spots, copy in zip(*(part.column(k).to_pylist() for k in (1, -2, -1)), strict=True):
                    words = (text or "").encode().split()
                    left = words
                    if copy and len(words) >= window:
                        left = []
                    elif spots:
                        (at,) = unpack(spots, np.int32)
                        cover = np.zeros(len(words) + 1, np.int64)
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + window, -1)
                        left = list(compress(words, (np.cumsum(cover)[:-1] == 0).tolist()))
                    total.append(len(words))
                    gone.append(len(words) - len(left))
                    kept.append(text if unchanged and text and len(left) == len(words) else b" ".join(left).decode())
                yield pa.record_batch([part.column(0), *part.columns[2:-2], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", *part.schema.names[2:-2], "n_words", "n_removed", "kept_text"])

    joined = rows.join(marks, key, "left").select(*rows.drop("sub").columns, "spots", "copy")
    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in joined.schema[2:-2])
    out = joined.mapInArrow(finish, f"doc_id long{more}, n_words long, n_removed long, kept_text string")
    named = [F.col(f"_{i}").alias(c) for i, c in enumerate(keep)]
    return out.select(F.when(F.col("doc_id") <= border, F.col("doc_id")).alias("doc_id"), *named, "n_words", "n_removed", "kept_text")
