"""Near-duplicate vectors by cross-polytope hashing.

A hash function turns a vector by three rounds of random signs and a fast Hadamard transform and names the signed axis
that it then lies nearest to.  A table joins several such names to a bucket.  Every vector is stored under its own
bucket and asks in the buckets where one of its names gives way to the second nearest axis (multiprobe).  All pairs of
a bucket of which one is stored there are verified by cosine in double precision.

Equal vectors collapse to a class first.  Vectors are only sent for buckets that hold a pair; a large bucket is dealt
out as pairs of blocks.  A pair counts in the first of the buckets where it meets, which both sides' names tell, so
links are counted where they are found and never listed: a bucket gives each vector's number of links and no more
connecting links than vectors.

The number of names a table follows the number of classes, the number of tables follows from that and the chance
`MEET` that one name agrees at cosine 0.95 (measured, probes included).  No bucket is capped.

Defined cases: a vector that is null, zero, or has null or non-finite components is linked with nothing and kept;
vectors of different lengths are never linked; a null id takes part in nothing; rows that repeat an id are one vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from memloom.llm.graph import components
from memloom.llm.minhash import Unions, _groups
from memloom.llm.shared import cut
from memloom.llm.textblocks import buckets_for, deal, exchange, hot_keys, mix, pack, packed_batches, parallelism, running_hash, span_hash, unpack_all

MEET, MISS = 0.72, 1e-4
PART = 512  # vectors turned at a time
BLOCK = 512


def unit_vectors(rows: list) -> list[np.ndarray | None]:
    """Each row in double precision with length 1; None where it can't be compared."""
    out = []
    for r in rows:
        if r is None or any(x is None for x in r) or not len(r):
            out.append(None)
            continue
        x = np.asarray(r, np.float64)
        big = np.abs(x).max()
        out.append(None if not np.isfinite(big) or big == 0 else (y := x / big) / math.sqrt(float(y @ y)))
    return out


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.float32(math.sqrt(n))


def axis_names(x: np.ndarray, tables: int, names: int) -> tuple[np.ndarray, np.ndarray]:
    """Of unit rows: rows x tables x names nearest axes, and the second nearest; an axis is 2 * index + (1 where negative)."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    near = np.zeros((len(x), tables, names), np.uint16)
    next_ = near.copy()
    wide = np.zeros((len(x), width), np.float32)
    wide[:, : x.shape[1]] = x
    for t in range(tables):
        for k in range(names):
            signs = np.random.default_rng([width, t, k]).choice(np.array([-1, 1], np.float32), (3, width))
            for i in range(0, len(x), PART):
                y = wide[i : i + PART]
                for s in signs:
                    y = hadamard(y * s)
                line, size = np.arange(len(y)), np.abs(y)
                for to in (near, next_):
                    at = size.argmax(axis=1)
                    to[i : i + PART, t, k] = 2 * at + (y[line, at] < 0)
                    size[line, at] = -1
    return near, next_


def bucket_keys(near: np.ndarray, next_: np.ndarray, width: int) -> np.ndarray:
    """rows x tables x (1 + names): the own bucket and the probed ones."""
    n, tables, names = near.shape
    out = np.zeros((n, tables, 1 + names), np.uint64)
    for p in range(1 + names):
        key = np.broadcast_to(mix(np.arange(tables, dtype=np.uint64) + np.uint64(width << 20), 61), (n, tables)).copy()
        for k in range(names):
            with np.errstate(over="ignore"):
                key = mix(key * np.uint64(0x9FB21C651E98DF25) + (next_ if k == p - 1 else near)[:, :, k].astype(np.uint64), 62)
        out[:, :, p] = key
    return out.view(np.int64)


def _classes(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, k1 and k2 (the direction's name; null where it can't be compared), unit (its bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units = unit_vectors(b.column(1).to_pylist())
            data = [None if u is None else (u + 0.0).astype("<f8").tobytes() for u in units]
            raw = np.frombuffer(b"".join(d or b"" for d in data), np.uint8)
            end = np.cumsum([len(d or b"") for d in data])
            start = np.concatenate([[0], end[:-1]]).astype(int)
            names = [span_hash(running_hash(raw), start, end), span_hash(running_hash(raw ^ np.uint8(0x5A)), start, end)] if len(data) else [np.zeros(0, np.uint64)] * 2
            null = np.array([d is None for d in data], bool)
            yield pa.record_batch([b.column(0), *(pa.array(k.view(np.int64), mask=null) for k in names), pa.array(data, pa.binary())], names=["vec_id", "k1", "k2", "unit"])

    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, k1 long, k2 long, unit binary")


def _coded(reps: DataFrame, tables: int, names: int) -> DataFrame:
    """vec_id, m, unit, codes (near and next names), keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units = [np.frombuffer(u, "<f8") for u in b.column(2).to_pylist()]
            for width in sorted({len(u) for u in units}):
                own = np.flatnonzero([len(u) == width for u in units])
                near, next_ = axis_names(np.stack([units[i] for i in own]), tables, names)
                keys = bucket_keys(near, next_, width)
                part = b.take(pa.array(own))
                codes = np.stack([near, next_], axis=1)
                yield pa.record_batch([*part.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([k.tobytes() for k in keys], pa.binary())], names=["vec_id", "m", "unit", "codes", "keys"])

    return reps.select("vec_id", "m", "unit").mapInArrow(run, "vec_id long, m long, unit binary, codes binary, keys binary")


def _busy_buckets(coded: DataFrame, tables: int, names: int) -> DataFrame:
    """vec_id, key, slot (table and whether stored), n: of buckets with a stored vector and another one."""
    spark = coded.sparkSession
    n_buckets, per = buckets_for(spark), tables * (1 + names)
    hot = hot_keys(coded, BLOCK)
    slot = np.repeat(np.arange(tables), 1 + names) * 2 + np.tile(np.arange(1 + names) == 0, tables)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs():
            for b in batches:
                keys = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64)
                ids = np.repeat(np.asarray(b.column(0), np.int64), per)
                yield from pack(deal(keys, ids, hot, n_buckets), n_buckets, keys, ids, np.tile(slot, b.num_rows).astype(np.int32))

        yield from packed_batches(pairs())

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, slots = unpack_all(batches, np.int64, np.int64, np.int32)
        order = np.argsort(keys, kind="stable")
        keys, ids, slots = keys[order], ids[order], slots[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        n = np.diff(np.append(at, len(keys)))
        stored = np.add.reduceat(slots & 1, at) if len(at) else n
        n[np.isin(keys[at], hot)] = 0  # only a part of them is here
        size = np.diff(np.append(at, len(keys)))
        keep = np.repeat((n == 0) | ((n > 1) & (stored > 0)), size)
        n = np.repeat(n, size)
        yield pa.record_batch([pa.array(ids[keep]), pa.array(keys[keep]), pa.array(slots[keep]), pa.array(n[keep].astype(np.int64))], names=["vec_id", "key", "slot", "n"])

    packed = coded.select("vec_id", "keys").mapInArrow(split, "bucket int, data binary")
    rows = exchange(packed).mapInArrow(meet, "vec_id long, key long, slot int, n long")
    if not len(hot):
        return rows
    rows = cut(rows, "buckets")
    whole = rows.where("n = 0").groupBy("key").agg(F.count("*").alias("whole"))  # few keys
    return rows.join(F.broadcast(whole), "key", "left").select("vec_id", "key", "slot", F.when(F.col("n") == 0, F.col("whole")).otherwise(F.col("n")).alias("n"))


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Each row once a pair of blocks (i <= j) of its bucket that it belongs to, with `side`: 0 in i, 1 in j only.

    Links are counted, so every pair of a bucket has to be looked at; blocks of `BLOCK` vectors keep copies few.
    """
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("vec_id"), parts).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j"), F.when(own <= o, 0).otherwise(1).alias("side")))
    return rows.select("*", F.inline(pairs))


def meeting(near_a, next_a, near_b, next_b) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (a the smaller id): the first table where they meet, and how: 0 both stored, 1 where a is stored, 2 where b is."""
    apart = near_a != near_b
    count = apart.sum(axis=2)
    way = np.full(count.shape, 3)
    way[(count == 1) & (apart & (near_b == next_a)).any(axis=2)] = 2
    way[(count == 1) & (apart & (near_a == next_b)).any(axis=2)] = 1
    way[count == 0] = 0
    table = (way < 3).argmax(axis=1)
    return table, way[np.arange(len(way)), table]


def _link(rows: DataFrame, least: float, tables: int, names: int) -> DataFrame:
    """a, b, n: either a connecting link, or (b null) n links of a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        col = lambda k: np.concatenate([np.asarray(b.column(k), np.int64) for b in got])
        ids, keys, slots, i, j, side, m = map(col, range(7))
        units, codes = ([x for b in got for x in b.column(k).to_pylist()] for k in (7, 8))
        order, cut_at = _groups(keys, i, j)
        link_a, link_b, count_of, counts = [], [], [], []
        for s, e in zip(cut_at[:-1], cut_at[1:], strict=True):
            own = order[s:e]
            own = own[np.argsort(ids[own], kind="stable")]
            x = np.stack([np.frombuffer(units[k], "<f8") for k in own])
            stored, table, across = (slots[own] & 1).astype(bool), int(slots[own[0]] >> 1), i[own[0]] != j[own[0]]
            a, b = np.nonzero(np.triu(x @ x.T >= least, 1))
            fit = (stored[a] | stored[b]) & (ids[own[a]] != ids[own[b]])
            if across:
                fit &= side[own[a]] != side[own[b]]
            a, b = a[fit], b[fit]
            if not len(a):
                continue
            c = np.stack([np.frombuffer(codes[k], np.uint16).reshape(2, tables, names) for k in own])
            known = Unions(len(own))
            for p in range(0, len(a), 1 << 14):
                pa_, pb = a[p : p + (1 << 14)], b[p : p + (1 << 14)]
                first, way = meeting(c[pa_, 0], c[pa_, 1], c[pb, 0], c[pb, 1])
                here = (first == table) & (way == np.where(stored[pa_] & stored[pb], 0, np.where(stored[pa_], 1, 2)))
                pa_, pb = pa_[here], pb[here]
                count_of += [ids[own[pa_]], ids[own[pb]]]
                counts += [m[own[pb]], m[own[pa_]]]
                for q in np.unique(pa_):
                    new = known.join(q, pb[pa_ == q])
                    link_a += [int(ids[own[q]])] * len(new)
                    link_b += ids[own[new]].tolist()
        if count_of:
            who, at = np.unique(np.concatenate(count_of), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
            yield pa.record_batch([pa.array(who), pa.array([None] * len(who), pa.int64()), pa.array(n)], names=["a", "b", "n"])
        yield pa.record_batch([pa.array(link_a, pa.int64()), pa.array(link_b, pa.int64()), pa.array([0] * len(link_a), pa.int64())], names=["a", "b", "n"])

    spark = rows.sparkSession
    dealt = rows.select("vec_id", "key", "slot", "i", "j", "side", "m", "unit", "codes").repartition(parallelism(spark), "key", "i", "j")
    return dealt.mapInArrow(run, "a long, b long, n long")


def table_count(names: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - MEET**names))


def near_duplicate_vectors(rows: DataFrame, least: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    every = cut(_classes(rows, id_col, vec_col), "vectors")
    usable = every.where("k1 is not null and vec_id is not null").select("vec_id", "k1", "k2").distinct()
    classes = cut(usable.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")), "classes")
    weights = classes.groupBy(F.col("rep").alias("vec_id")).agg(F.sum("m").alias("m"))
    number = classes.count()
    names = max(2, math.ceil(math.log(max(2, number)) / math.log(128)))
    tables = table_count(names)
    reps = every.where("k1 is not null").join(weights, "vec_id").dropDuplicates(["vec_id"])
    coded = cut(_coded(reps, tables, names), "coded")
    busy = _busy_buckets(coded, tables, names).join(coded.select("vec_id", "m", "unit", "codes"), "vec_id")
    found = cut(_link(_in_blocks(busy), least, tables, names), "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    comps = components(found.where("b is not null")).withColumnRenamed("id", "rep")
    named = classes.join(counts, "rep", "left").join(comps, "rep", "left")
    named = cut(named.select("k1", "k2", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component")), "named")
    out = every.select("vec_id", "k1", "k2").join(named, ["k1", "k2"], "left")
    own = F.when(F.col("vec_id").isNotNull() & F.col("component").isNotNull(), F.col("component")).otherwise(F.col("vec_id"))
    links = F.when(F.col("vec_id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(0)
    return out.select("vec_id", links.cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("vec_id"), F.lit(True)).alias("kept"))
