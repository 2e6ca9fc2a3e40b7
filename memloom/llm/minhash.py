"""Near-duplicate documents by SuperMinHash, banding, verification on full sets, and components of the links.

A document is the set of its distinct k-word shingles.  SuperMinHash gives every element one random permutation of the
slots and offers it the ranks 0, 1, 2, ... with a random fraction each; a slot keeps the least value offered.  Ranks of
one element never share a slot, which lowers the variance, and a document stops as soon as no slot can still improve.

1. Equal sets collapse to a class, named by its smallest id, so that exact copies cost nothing further.
2. Classes that agree on all rows of a band share a bucket.  Signatures are only sent for buckets of two or more.  Pairs
   whose signatures agree enough join candidate clusters.  A band's key that many classes have is dealt to all tasks.
3. Within a cluster full shingle sets are compared.
4. The links' components are the result.

In both comparisons classes already known to be connected need no further one, so a group gives at most one link a class
instead of all its pairs.  A large group is dealt out in blocks.  A few pivots sit in every block, which connects most of
a group of near copies at once, and costs a row a member; who is left outside its largest component is compared with all
others.  With 32 bands of 4 rows a pair at similarity 0.8 shares no bucket with probability 5e-8.  No bucket is capped.

Defined cases: a null or blank text has the empty set, is linked with nothing and is kept; a text with fewer than k
words is one shingle of all its words; a null id takes part in nothing; rows that repeat an id are one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from memloom.llm.graph import components
from memloom.llm.shared import cut
from memloom.llm.textblocks import Block, buckets_for, deal, exchange, hot_keys, mix, pack, packed_batches, parallelism, texts_of, unpack_all, word_blocks

BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS
FRACTION = 25  # bits below the rank in a slot's value
BLOCK = 1024
SET_BLOCK = 128
PIVOTS = 6
AGREE = 0.62  # of the slots: 0.8 less five standard deviations


def shingles(block: Block, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row of a block."""
    h = block.hashes()
    with np.errstate(over="ignore"):
        if len(h) >= k:
            s = np.zeros(len(h) - k + 1, np.uint64)
            for i in range(k):
                s = mix(s * np.uint64(0xD6E8FEB86659FD93) + h[i : len(h) - k + 1 + i], 3)
        else:
            s = np.zeros(0, np.uint64)
        out = []
        for i, j in zip(block.first[:-1], block.first[1:], strict=True):
            if j - i >= k:
                x = np.sort(s[i : j - k + 1])
                out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
            elif j > i:
                x = np.zeros(1, np.uint64)
                for v in h[i:j]:
                    x = mix(x * np.uint64(0xD6E8FEB86659FD93) + v, 3)
                out.append(mix(x, 100 + int(j - i)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def superminhash(sets: list[np.ndarray], part: int = 1 << 15) -> np.ndarray:
    """len(sets) x SLOTS values, rank above fraction; all ones where the set is empty."""
    sizes = np.array([len(s) for s in sets])
    best = np.full((len(sets), SLOTS), 0xFFFFFFFF, np.uint32)
    flat, el = best.reshape(-1), np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    if not len(el):
        return best

    def offer(elements: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
        u = mix(elements, 1000 + rank)
        step = ((u >> np.uint64(32)) * np.uint64(SLOTS - rank)) >> np.uint64(32)
        return step.astype(np.int64) + rank, (u & np.uint64((1 << FRACTION) - 1)).astype(np.uint32) + np.uint32(rank << FRACTION)

    row = np.repeat(np.arange(len(sets)), sizes)
    first, value = offer(el, 0)
    np.minimum.at(flat, row * SLOTS + first, value)
    todo = np.flatnonzero((sizes > 0) & (best.max(axis=1) >> FRACTION >= 1))
    start = np.concatenate([[0], np.cumsum(sizes)])
    while len(todo):  # some documents at a time, for the permutations' memory
        n = max(1, int(np.searchsorted(np.cumsum(sizes[todo]), part, "right")))
        now, todo = todo[:n], todo[n:]
        own = np.concatenate([np.arange(start[d], start[d + 1]) for d in now])
        x, r = el[own], row[own]
        slot = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(own), 1))
        line = np.arange(len(own))
        slot[line, 0], slot[line, first[own]] = first[own], 0
        for rank in range(1, SLOTS):
            k, value = offer(x, rank)
            got = slot[line, k]
            slot[line, k] = slot[:, rank]
            slot[:, rank] = got
            np.minimum.at(flat, r * SLOTS + got, value)
            more = best[now].max(axis=1) >> FRACTION >= rank + 1
            if not more.all():
                stay = np.repeat(more, sizes[now])
                now, x, r, slot = now[more], x[stay], r[stay], slot[stay]
                line = np.arange(len(x))
                if not len(now):
                    break
    return best


def band_keys(best: np.ndarray) -> np.ndarray:
    """len(best) x BANDS."""
    with np.errstate(over="ignore"):
        v = best.reshape(len(best), BANDS, ROWS).astype(np.uint64)
        key = np.arange(BANDS, dtype=np.uint64)[None, :].repeat(len(best), axis=0)
        for i in range(ROWS):
            key = mix(key * np.uint64(0x9FB21C651E98DF25) + v[:, :, i], 5)
    return key.view(np.int64)


def signatures(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, k1 and k2 (the set's name), short (one byte a slot), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, block in word_blocks(b.column(1), lower=True):
                sets = shingles(block, k)
                n = np.array([len(s) for s in sets], np.int64)
                with np.errstate(over="ignore"):
                    names = [np.array([mix(s, salt).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for salt in (21, 22)]
                best = superminhash(sets)
                short = mix(best.astype(np.uint64), 9).astype(np.uint8)
                yield pa.record_batch([b.column(0).slice(i, block.rows), pa.array(n), *map(pa.array, names), pa.array([x.tobytes() for x in short], pa.binary()), pa.array([x.tobytes() for x in band_keys(best)], pa.binary())], names=["doc_id", "n", "k1", "k2", "short", "bands"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n long, k1 long, k2 long, short binary, bands binary")


class Unions:
    """Union-find over 0..n-1 that keeps whole label arrays, for vectorised questions."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: int, others: np.ndarray) -> np.ndarray:
        """Connects a with others; one of `others` for each component that was new to a."""
        labels, at = np.unique(self.label[others], return_index=True)
        at = at[labels != self.label[a]]
        if len(at):
            self.label[np.isin(self.label, labels)] = self.label[a]
        return others[at]


def _shared_buckets(table: DataFrame) -> DataFrame:
    """doc_id, key, size: of the buckets of two or more classes."""
    spark = table.sparkSession
    n_buckets = buckets_for(spark)
    hot = hot_keys(table, BLOCK, "bands")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs():
            for b in batches:
                ids = np.repeat(np.asarray(b.column(0), np.int64), BANDS)
                keys = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64)
                yield from pack(deal(keys, ids, hot, n_buckets), n_buckets, keys, ids)

        yield from packed_batches(pairs())

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids = unpack_all(batches, np.int64, np.int64)
        order = np.argsort(keys, kind="stable")
        keys, ids = keys[order], ids[order]
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        n = np.diff(np.append(edge, len(keys)))
        n = np.repeat(n, n)
        n[np.isin(keys, hot)] = 0  # only a part of them is here
        keep = n != 1
        yield pa.record_batch([pa.array(ids[keep]), pa.array(keys[keep]), pa.array(n[keep].astype(np.int64))], names=["doc_id", "key", "size"])

    packed = table.select("doc_id", "bands").mapInArrow(split, "bucket int, data binary")
    rows = exchange(packed).mapInArrow(meet, "doc_id long, key long, size long")
    if not len(hot):
        return rows
    rows = cut(rows, "buckets")
    whole = rows.where("size = 0").groupBy("key").agg(F.count("*").alias("whole"))  # few keys
    return rows.join(F.broadcast(whole), "key", "left").select("doc_id", "key", F.when(F.col("size") == 0, F.col("whole")).otherwise(F.col("size")).alias("size"))


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each group starts in it (with the end)."""
    order = np.lexsort(keys[::-1])
    if not len(order):
        return order, np.zeros(1, int)
    change = np.zeros(len(order), bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[order][1:] != k[order][:-1]
    return order, np.append(np.flatnonzero(change), len(order))


def _candidates(table: DataFrame) -> DataFrame:
    """a, b: links between classes whose signatures agree, enough to connect all that agree within a bucket."""
    rows = _shared_buckets(table).join(table.select("doc_id", F.col("short").alias("data")), "doc_id")
    return _linked(cut(rows.withColumnRenamed("key", "cluster"), "buckets"), BLOCK, link_signatures).distinct()


def link_signatures(ids: np.ndarray, data: list[bytes], side: np.ndarray, known: Unions) -> tuple[list[int], list[int]]:
    """Links that connect all members whose signatures agree in `AGREE` of the slots. Members of side 0 ask; side 1 only answers."""
    x = np.frombuffer(b"".join(data), np.uint8).reshape(-1, SLOTS)
    a, b = [], []
    asked = np.zeros(len(ids), bool)
    for p in np.flatnonzero(side == 0):
        asked[p] = True
        rest = np.flatnonzero((known.label != known.label[p]) & ~asked)
        if not len(rest):
            if (known.label == known.label[0]).all():
                break
            continue
        new = known.join(p, rest[(x[rest] == x[p]).sum(axis=1) >= AGREE * SLOTS])
        a += [int(ids[p])] * len(new)
        b += ids[new].tolist()
    return a, b


def link_sets(ids: np.ndarray, data: list[bytes], side: np.ndarray, known: Unions, percent: int) -> tuple[list[int], list[int]]:
    """Links that connect all members whose Jaccard similarity is percent or more. Members of side 0 ask; side 1 only answers."""
    sets = [np.frombuffer(x, np.uint64) for x in data]
    sizes = np.array([len(s) for s in sets])
    start = np.concatenate([[0], np.cumsum(sizes)])
    _, word = np.unique(np.concatenate(sets), return_inverse=True)
    flag = np.zeros(int(word.max()) + 1, bool) if len(word) else np.zeros(1, bool)
    a, b = [], []
    asked = np.zeros(len(ids), bool)
    for p in np.flatnonzero(side == 0):
        asked[p] = True
        rest = np.flatnonzero((known.label != known.label[p]) & ~asked & (100 * np.minimum(sizes, sizes[p]) >= percent * np.maximum(sizes, sizes[p])))
        if not len(rest):
            continue
        own = word[start[p] : start[p + 1]]
        flag[own] = True
        n = sizes[rest]
        at = np.repeat(start[rest] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.add.reduceat(flag[word[at]], np.concatenate([[0], np.cumsum(n)[:-1]]), dtype=np.int64)
        flag[own] = False
        new = known.join(p, rest[100 * both >= percent * (n + sizes[p] - both)])
        a += [int(ids[p])] * len(new)
        b += ids[new].tolist()
    return a, b


Link = Callable[[np.ndarray, list[bytes], np.ndarray, Unions], tuple[list[int], list[int]]]


def _compare(rows: DataFrame, keys: list[str], link: Link) -> DataFrame:
    """a, b: links. rows: keys, doc_id, side, comp (known components), data; one task has all rows of its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        width = len(keys)
        col = lambda k: np.concatenate([np.asarray(b.column(k), np.int64) for b in got])
        cols = [col(k) for k in range(width + 3)]
        data = [x for b in got for x in b.column(width + 3).to_pylist()]
        order, cut_at = _groups(*cols[:width])
        ids, side, comp = cols[width:]
        for s, e in zip(cut_at[:-1], cut_at[1:], strict=True):
            own = order[s:e]
            own = own[np.lexsort((ids[own], side[own]))]
            known = Unions(len(own))
            known.label = np.unique(comp[own], return_inverse=True)[1]
            a, b = link(ids[own], [data[k] for k in own], side[own], known)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    spark = rows.sparkSession
    return rows.select(*keys, "doc_id", "side", "comp", "data").repartition(parallelism(spark), *keys).mapInArrow(run, "a long, b long")


def _linked(rows: DataFrame, block: int, link: Link) -> DataFrame:
    """a, b: links that connect what `link` connects within each cluster. rows: cluster, doc_id, size (of the cluster), data."""
    parts = F.ceil(F.col("size") / block).cast("int")
    # within blocks first: most of a large cluster is connected there
    blocks = rows.select("*", F.pmod(F.xxhash64("doc_id"), parts).cast("int").alias("i"))
    large = rows.where(F.col("size") > block)
    picks = [F.min_by("doc_id", F.xxhash64("doc_id", F.lit(k))) for k in range(PIVOTS - 1)] + [F.min("doc_id")]
    chosen = large.groupBy("cluster").agg(F.array_distinct(F.array(*picks)).alias("p")).select("cluster", F.explode("p").alias("doc_id"))
    pivots = large.join(chosen, ["cluster", "doc_id"]).select(*rows.columns, F.explode(F.sequence(F.lit(0), parts - 1)).alias("i"))
    links = cut(_compare(blocks.unionByName(pivots).withColumn("side", F.lit(0)).withColumn("comp", F.col("doc_id")), ["cluster", "i"], link), "links")
    return links if large.isEmpty() else cut(links.union(_across(large, links, block, link)), "links")


def _full_sets(docs: DataFrame, members: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """members' columns and data, their full sets."""
    own = members.select(F.col("doc_id").alias("_m"), *[c for c in members.columns if c != "doc_id"])
    rows = texts_of(docs, id_col, text_col).join(own, F.col("doc_id") == F.col("_m")).drop("_m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, block in word_blocks(b.column(1), lower=True):
                grams = [s.tobytes() for s in shingles(block, k)]
                yield pa.record_batch([b.column(0).slice(i, block.rows), *(c.slice(i, block.rows) for c in b.columns[2:]), pa.array(grams, pa.binary())], names=["doc_id", *b.schema.names[2:], "data"])

    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema[2:])
    return rows.mapInArrow(run, f"doc_id long{more}, data binary").dropDuplicates(["doc_id"])


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: links are pairs with 100 * intersection >= percent * union."""
    every = cut(signatures(docs, k, id_col, text_col), "signatures")
    classes = cut(every.where("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    table = every.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    clusters = cut(components(_candidates(cut(table.select("doc_id", "short", "bands"), "reps"))), "clusters")
    sizes = clusters.groupBy("component").agg(F.count("*").alias("size"))
    members = cut(clusters.join(sizes, "component").select(F.col("id").alias("doc_id"), F.col("component").alias("cluster"), "size"), "members")
    full = cut(_full_sets(docs, members, k, id_col, text_col), "sets")
    found = components(_linked(full, SET_BLOCK, partial(link_sets, percent=percent)))
    named = cut(classes.join(found, classes["rep"] == found["id"], "left").select("k1", "k2", F.coalesce("component", "rep").alias("component")), "named")
    filled = every.where("n > 0 and doc_id is not null").select("doc_id", "n", "k1", "k2").join(named, ["k1", "k2"])
    # blank texts have one name all together and no component: they stay where they are
    blank = every.where("not (n > 0 and doc_id is not null)").select("doc_id", "n", F.col("doc_id").alias("component"))
    out = filled.select("doc_id", "n", "component").unionByName(blank)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"))


def _across(large: DataFrame, links: DataFrame, block: int, link: Link) -> DataFrame:
    """Links between the blocks of large clusters: whoever is outside a cluster's largest component asks all others."""
    found = components(links)
    known = cut(large.join(found, F.col("doc_id") == F.col("id"), "left").select("doc_id", "cluster", "size", "data", F.coalesce("component", "doc_id").alias("comp")), "known")
    main = known.groupBy("cluster", "comp").count().groupBy("cluster").agg(F.max(F.struct("count", "comp")).alias("m"), F.sum("count").alias("all"))
    main = cut(main.select("cluster", F.col("m.comp").alias("main"), (F.col("all") - F.col("m.count")).alias("outside")).where("outside > 0"), "main")
    rows = known.join(main, "cluster")
    ask_parts, all_parts = F.ceil(F.col("outside") / block).cast("int"), F.ceil(F.col("size") / block).cast("int")
    asks = rows.where("comp <> main").select("*", F.pmod(F.xxhash64("doc_id"), ask_parts).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), all_parts - 1)).alias("j"), F.lit(0).alias("side"))
    answers = rows.select("*", F.explode(F.sequence(F.lit(0), ask_parts - 1)).alias("i"), F.pmod(F.xxhash64("doc_id"), all_parts).cast("int").alias("j"), F.lit(1).alias("side"))
    return _compare(asks.unionByName(answers), ["cluster", "i", "j"], link)
