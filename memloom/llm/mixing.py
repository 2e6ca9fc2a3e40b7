"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the copy rate of its documents; its fraction is rounded document by document.
Two fractional documents of a source form a pair, and a random share of mass (in words) moves from one to the other
until one of the two is integral.  Groups of bounded size do this in parallel; each leaves at most one fractional
document, and these residuals meet in the groups of the next level of a reduction tree until one a source is left,
which is rounded at random with its fraction as probability.  So the words taken of a source differ from its target
by less than one document.

A row's group follows from a hash of what it holds and, for equal rows, its number among them, so that reruns decide
alike however the input is partitioned, and neither null nor repeated ids, nor equal rows, fill a group.

Defined cases: a null text has size 0; a null source is a source (ordered last); a document of size 0 is copied like
any other and takes 0 words; rows that repeat an id are documents of their own; equal rows are told apart by number only,
so which of them is taken how often may change; an empty table gives an empty result.
The number of distinct sources is metadata and is taken to fit the driver; documents never meet there.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from memloom.llm.shared import cut
from memloom.llm.textblocks import texts_of, word_blocks

GROUP = 2048
WEIGHTS = (1, 2, 3)
MOST = 3.0


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", identity: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size (words of the whole text), h1 and h2 (of what the row holds), part (the task), local (its number among equal rows there).

    What a row holds are the three columns, and those of `identity`.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), Counter()
        for b in batches:
            sizes = [block.counts for _, block in word_blocks(b.column(1))]
            local = []
            for key in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                local.append(seen[key])
                seen[key] += 1
            yield pa.record_batch([b.column(0), b.column(2), pa.array(np.concatenate(sizes) if sizes else [], pa.int64()), b.column(3), b.column(4), pa.array([part] * b.num_rows, pa.int32()), pa.array(local, pa.int64())], names=["doc_id", "source", "size", "h1", "h2", "part", "local"])

    held = [F.col(c) for c in (id_col, text_col, source_col, *identity)]
    hashes = [F.xxhash64(F.lit(salt), *held).alias(f"h{salt}") for salt in (1, 2)]
    rows = texts_of(docs, id_col, text_col, F.col(source_col).cast("string").alias("source"), *hashes)
    return rows.mapInArrow(count, "doc_id long, source string, size long, h1 long, h2 long, part int, local long")


def numbered(sized: DataFrame) -> DataFrame:
    """sized with `number`: 0, 1, 2, ... among equal rows of all tasks."""
    key = ["h1", "h2"]
    # those that occur in several tasks; there is one row a key and task, and a task's own numbers go after the others'
    shared = sized.groupBy(*key).agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select(*key)
    counts = sized.join(shared, key, "left_semi").groupBy(*key, "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*key).orderBy("part")) - F.col("n")
    return sized.join(counts.select(*key, "part", before.alias("before")), [*key, "part"], "left").withColumn("number", F.coalesce("before", F.lit(0)) + F.col("local")).drop("before", "local", "part")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """Each source's words: shares of the total by weight, none above `most` times its size, the excess shared again."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    left, open_, out = float(sum(n for _, n in order)), dict(order), {}
    while open_:
        per = left / sum(weight[s] for s in open_)
        full = [s for s, n in open_.items() if weight[s] * per > most * n]
        if not full:
            return out | {s: weight[s] * per for s in open_}
        for s in full:
            out[s] = most * open_.pop(s)
            left -= out[s]
    return out


def _pivot(rows: pd.DataFrame, seed: int) -> pd.DataFrame:
    """rows of one group in a fixed order: part (0 to 1) becomes 0 or 1 but for one row at most. The sum of part * size stays."""
    part, size = rows["part"].to_numpy(float).copy(), rows["size"].to_numpy(float)
    rng = np.random.default_rng(seed & (2**63 - 1))
    draws, open_, eps = rng.random(2 * len(part) + 2), -1, 1e-9
    for i in range(len(part)):
        if size[i] == 0:  # its copies move no words
            part[i] = float(draws[2 * i] < part[i])
            continue
        if part[i] <= eps or part[i] >= 1 - eps:
            part[i] = round(part[i])
            continue
        if open_ < 0:
            open_ = i
            continue
        a, b = open_, i
        up = min((1 - part[a]) * size[a], part[b] * size[b])  # words that can move from b to a
        down = min(part[a] * size[a], (1 - part[b]) * size[b])
        move = up if draws[2 * i] * (up + down) < down else -down
        part[a] += move / size[a]
        part[b] -= move / size[b]
        for k in (a, b):
            if part[k] <= eps or part[k] >= 1 - eps:
                part[k] = round(part[k])
        open_ = a if 0 < part[a] < 1 else b if 0 < part[b] < 1 else -1
    return rows.assign(part=part)


def _merge(depth: int, seed: int):
    """The pivot of a group of residuals, `depth` levels up the tree."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["g", "k"]).reset_index(drop=True)
        name = "" if pd.isna(rows["source"].iloc[0]) else str(rows["source"].iloc[0])
        return _pivot(rows, seed ^ hash_text(f"{name}/{depth}/{int(rows['at'].iloc[0])}"))

    return merge


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: how often the mix takes each document."""
    return _mixed(cut(word_counts(docs, id_col, text_col, source_col), "mix-sizes"), weights, most, seed).drop("h1", "h2")


def taken_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs' rows, with their own columns, as often as the mix takes them. Texts are shuffled once."""
    sized = cut(word_counts(docs, id_col, text_col, source_col, tuple(docs.columns)), "mix-sizes")
    mixed = _mixed(sized, options.get("weights", WEIGHTS), options.get("most", MOST), options.get("seed", 17))
    times = mixed.groupBy("h1", "h2").agg(F.sum("copies").alias("times")).where("times > 0")
    # the caller's columns go in one struct, so that none can clash; equal rows are one that is taken as often as they are together
    held = [F.col(c) for c in (id_col, text_col, source_col, *docs.columns)]
    rows = docs.select(F.struct(*docs.columns).alias("row"), *[F.xxhash64(F.lit(salt), *held).alias(f"h{salt}") for salt in (1, 2)])
    one = rows.groupBy("h1", "h2").agg(F.first("row").alias("row")).join(times, ["h1", "h2"])
    return one.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")


def _mixed(sized: DataFrame, weights: tuple[float, ...], most: float, seed: int) -> DataFrame:
    """sized: doc_id, source, size, h1, h2, part, local (a written table). doc_id, source, size, source_size, target, copies, h1, h2."""
    found = [tuple(r) for r in sized.groupBy("source").agg(F.sum("size").cast("long"), F.count("*")).collect()]
    want = targets([(s, n) for s, n, _ in found], weights, most)
    spark = sized.sparkSession
    plan = spark.createDataFrame([(s, n, float(want[s]), want[s] / n if n else 0.0, -(-k // GROUP)) for s, n, k in found], "name string, source_size long, target double, rate double, groups int")
    rows = numbered(sized)
    keyed = rows.join(F.broadcast(plan), rows["source"].eqNullSafe(plan["name"])).select(
        "doc_id", "source", "size", "h1", "h2", "number", "source_size", "target", F.floor("rate").cast("int").alias("whole"), (F.col("rate") - F.floor("rate")).alias("part"),
        F.pmod(F.xxhash64("h1", "h2", "number", F.lit(seed)), F.col("groups")).cast("int").alias("g"),
    )

    def first(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h1", "h2", "number"], kind="stable").reset_index(drop=True)
        rows["k"] = np.arange(len(rows))
        name = "" if pd.isna(rows["source"].iloc[0]) else str(rows["source"].iloc[0])
        return _pivot(rows, seed ^ hash_text(f"{name}/{int(rows['g'].iloc[0])}"))

    schema = "doc_id long, source string, size long, h1 long, h2 long, number long, source_size long, target double, whole int, part double, g int, k long"
    level = cut(keyed.groupBy("source", "g").applyInPandas(first, schema), "mix-level")
    rest = level.where("part > 0 and part < 1").select("source", "g", "k", F.col("size").cast("double").alias("size"), "part", F.col("g").alias("at"))
    depth, groups = 0, max([1, *(-(-k // GROUP) for _, _, k in found)])
    while groups > 1:
        groups, depth = -(-groups // GROUP), depth + 1
        rest = rest.withColumn("at", F.floor(F.col("at") / GROUP).cast("int")).groupBy("source", "at").applyInPandas(_merge(depth, seed), "source string, g int, k long, size double, part double, at int")
    last = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    settled = rest.select(F.col("source").alias("s"), F.col("g").alias("sg"), F.col("k").alias("sk"), F.when((F.col("part") > 0) & (F.col("part") < 1), (last < F.col("part")).cast("double")).otherwise(F.col("part")).alias("end"))
    done = level.join(settled, level["source"].eqNullSafe(settled["s"]) & (level["g"] == settled["sg"]) & (level["k"] == settled["sk"]), "left")
    return done.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.round(F.coalesce("end", "part"))).cast("int").alias("copies"), "h1", "h2")


def hash_text(x: str) -> int:
    """A 63-bit number from a text, the same in every process."""
    out = 1469598103934665603
    for b in x.encode():
        out = ((out ^ b) * 1099511628211) & (2**63 - 1)
    return out
