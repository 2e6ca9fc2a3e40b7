"""Toxicity by multiple-instance learning.

Only documents are labelled.  A sentence's score is a logistic function of its words and word beginnings (hashed), a document's score is
the noisy-or of its sentences: it is toxic if any sentence is.  Training maximises the likelihood of the document
labels through the noisy-or, so blame settles on the sentences that tell toxic documents from others; the same
sentence scores then locate the offence.

Fitted on a bounded, hash-chosen sample of labelled rows (`MAX_TRAIN` rows, `TRAIN_BYTES` of text, of texts of up to
`TEXT_BYTES`); every text is scored whole.  Defined cases: a null or empty text has no sentence and scores 0; without
labels of both kinds every text scores the share of label 1; several labels of one document count as their largest; a
null id or text teaches nothing, and a null id is not held out; rows that repeat an id are scored one by one, and all
teach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from memloom.llm.langid import LETTERS
from memloom.llm.textblocks import Block, mix, texts_of, word_blocks

DIMS = 1 << 18
MAX_TRAIN = 6000
TRAIN_BYTES, TEXT_BYTES = 32 << 20, 1 << 20
MIN_DOCS = 4
APART = 5.0  # standard deviations between a feature's share of label 1 and all documents'
KINDS = (None, 4, 5)  # a word's features: itself and its first bytes, which inflected forms share
BREAKS = ~LETTERS
ENDS = np.zeros(256, dtype=bool)
ENDS[[0x0A, 0x0D, 0x21, 0x2E, 0x3F]] = True  # new lines and ! . ?


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    base: float | None = None  # the score of everything, where nothing could be learned


def sentences(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots of each word (words x KINDS); of each sentence with words: its first word, its row, and its last word + 1."""
    kinds = [mix(h, k) & np.uint64(DIMS - 1) for k, h in enumerate(block.prefix_hashes(*KINDS))]
    slot = np.stack(kinds, axis=1).astype(np.int32)
    if not len(slot):
        return slot, np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
    row = block.row
    part = np.cumsum(ENDS[block.buf])[block.start]
    first = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (row[1:] != row[:-1])]))
    return slot, first, row[first], np.append(first[1:], len(slot))


def train_on(words: list[np.ndarray], starts: list[np.ndarray], labels: np.ndarray, rounds: int = 150, rate: float = 0.2, sparse: float = 2e-5) -> Model:
    """Of each document: the slots of its words, the first word of each sentence, and its label.

    Features whose documents differ too little between the labels are left out beforehand, so that rare words can't
    explain single documents; what is left is a small part of the words.
    """
    n, pos = len(labels), float(labels.mean()) if len(labels) else 0.0
    if not 0 < pos < 1 or not any(map(len, words)):
        return Model(np.zeros(DIMS, np.float32), 0.0, pos)
    seen, bad = np.zeros(DIMS), np.zeros(DIMS)
    for x, label in zip(words, labels, strict=True):
        own = np.unique(x)
        seen[own] += 1
        bad[own] += label
    keep = (seen >= MIN_DOCS) & (np.abs(bad - seen * pos) / np.sqrt(np.maximum(seen, 1) * pos * (1 - pos)) >= APART)
    slots, sentence, base = [], [], 0
    for x, s in zip(words, starts, strict=True):
        at, kind = np.nonzero(keep[x])
        slots.append(x[at, kind])
        sentence.append((np.searchsorted(s, at, "right") - 1 + base).astype(np.int32))
        base += len(s)
    slots, sentence = np.concatenate(slots), np.concatenate(sentence)
    doc = np.repeat(np.arange(n, dtype=np.int32), [len(s) for s in starts])
    w, bias = np.zeros(DIMS), -6.0
    m, v, mb, vb = np.zeros(DIMS), np.zeros(DIMS), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.clip(np.bincount(sentence, weights=w[slots], minlength=base) + bias, -30, 30)
        a = np.bincount(doc, weights=np.logaddexp(0, z), minlength=n)
        da = np.where(labels == 1, -1 / np.expm1(np.clip(a, 1e-9, 50)), 1.0)
        dz = da[doc] / (1 + np.exp(-z)) / n
        g, gb = np.bincount(slots, weights=dz[sentence], minlength=DIMS), dz.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        scale = rate / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        w = w - scale * m / (1 - 0.9**t)
        w = np.sign(w) * np.maximum(np.abs(w) - scale * sparse / 10, 0)  # the proximal step of an absolute-value penalty
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-7)
    return Model(w.astype(np.float32), float(bias))


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> Model:
    """`train` is a condition on the labels' id; at most about max_train labelled documents teach."""
    known = labels.where(train & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    share = max_train / max(1, known.count())
    draw = F.pmod(F.xxhash64("_id", F.lit(13)), F.lit(1 << 30)).cast("double") / float(1 << 30)
    few = known.where(draw < share)  # about max_train rows, so that they may be sent to all executors
    texts = texts_of(docs, id_col, text_col).where(F.octet_length("text") <= TEXT_BYTES)
    chosen = texts.join(F.broadcast(few), F.col("doc_id") == F.col("_id"))
    size = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sample = chosen.where(draw < share * min(1.0, TRAIN_BYTES / max(1, size))).select("doc_id", "text", "_label")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, block in word_blocks(b.column(1), lower=True, breaks=BREAKS):
                slot, first, row, _ = sentences(block)
                at = np.searchsorted(row, np.arange(block.rows + 1))
                words = [slot[block.first[k] : block.first[k + 1]].tobytes() for k in range(block.rows)]
                starts = [(first[at[k] : at[k + 1]] - block.first[k]).astype(np.int32).tobytes() for k in range(block.rows)]
                yield pa.record_batch([b.column(0).slice(i, block.rows), b.column(2).slice(i, block.rows), pa.array(words, pa.binary()), pa.array(starts, pa.binary())], names=["doc_id", "label", "words", "starts"])

    got = sample.mapInArrow(features, "doc_id long, label int, words binary, starts binary").toPandas().sort_values("doc_id", kind="stable")
    words = [np.frombuffer(x, np.int32).reshape(-1, len(KINDS)) for x in got["words"]]
    starts = [np.frombuffer(x, np.int32) for x in got["starts"]]
    return train_on(words, starts, got["label"].to_numpy())


def _judge(model: Model, block: Block) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Each row's probability, each sentence's log odds, and the sentences."""
    found = slot, first, row, _ = sentences(block)
    z = np.zeros(0)
    if model.base is not None:
        p = np.full(block.rows, model.base)
    elif len(slot):
        z = np.clip(np.add.reduceat(model.weights[slot].sum(axis=1, dtype=float), first) + model.bias, -30, 30)
        p = -np.expm1(-np.bincount(row, weights=np.logaddexp(0, z), minlength=block.rows))
    else:
        p = np.zeros(block.rows)
    return np.clip(p, 0, 1), z, found


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs' rows, with all their columns, that score below 0.5."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = [_judge(model, block)[0] for _, block in word_blocks(b.column(at), lower=True, breaks=BREAKS)]
            yield b.filter(pa.array(np.concatenate(p) < 0.5)) if p else b

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *keep: str) -> DataFrame:
    """doc_id, score, predicted, and the offending sentences as byte ranges of the UTF-8 text with their own scores."""
    texts = texts_of(docs, id_col, text_col, *keep)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, block in word_blocks(b.column(1), lower=True, breaks=BREAKS):
                p, z, (_, first, row, last) = _judge(model, block)
                spans: list[list[dict]] = [[] for _ in range(block.rows)]
                if len(z):
                    best = np.full(block.rows, -np.inf)
                    np.maximum.at(best, row, z)
                    for k in np.flatnonzero((z >= 0) | ((z == best[row]) & (p[row] >= 0.5))):
                        at = block.off[row[k]]
                        spans[row[k]].append({"start": int(block.start[first[k]] - at), "end": int(block.end[last[k] - 1] - at), "score": float(1 / (1 + np.exp(-z[k])))})
                yield pa.record_batch([b.column(0).slice(i, block.rows), *(c.slice(i, block.rows) for c in b.columns[2:]), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(spans, pa.list_(span))], names=["doc_id", *b.schema.names[2:], "score", "predicted", "offending"])

    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in texts.schema[2:])
    return texts.mapInArrow(run, f"doc_id long{more}, score double, predicted int, offending array<struct<start: long, end: long, score: double>>")
