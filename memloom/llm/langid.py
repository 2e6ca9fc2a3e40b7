"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector of hashed byte n-grams (orders 2 and 3 over letters, everything else one blank).
Each language has a few centroids, found by spherical k-means over a bounded sample of its labelled texts, and a text
gets the language of the centroid with the largest cosine.  A text further from its centroid than nearly all of that
centroid's own training texts is rejected.

The classifier is fitted on a bounded sample (`PER_LANGUAGE` texts a language, by a hash of the id); everything else
sees whole tables and whole texts.  Defined cases: a null text, or one without a letter, is `und` with score 0; with
no labelled text everything is `und`; rows with a null language teach nothing; a null id teaches nothing and is not held
out; rows that repeat an id are predicted one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from memloom.llm.shared import cut
from memloom.llm.textblocks import LOWER, blocks, texts_of, utf8_column

DIMS = 1 << 13
PER_LANGUAGE = 600
CENTROIDS = 4
ROWS = 256  # texts whose counts are held at a time
UNKNOWN = "und"
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(0x80, 256)]] = True
ASCII_LETTERS = LETTERS & (np.arange(256) < 0x80)


def gram_counts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """rows x DIMS counts of hashed bigrams and trigrams within each text."""
    b = np.where(LETTERS[buf], LOWER[buf], 0x20).astype(np.uint32)
    if len(b) > 1:  # upper-case Latin-1 letters
        up = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)
        b[1:][up] += 0x20
    rows, n = len(off) - 1, len(b)
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(off)) * DIMS
    left = np.repeat(off[1:], np.diff(off)) - np.arange(n)  # bytes of the text from here on
    out = np.zeros(rows * DIMS, dtype=np.int64)
    code = b.copy()
    for order in (2, 3):
        if n < order:
            break
        code = code[:-1] * np.uint32(257) + b[order - 1 :]
        slot = (code * np.uint32(2654435761)) >> np.uint32(32 - 13)
        inside = left[: len(slot)] >= order
        out += np.bincount((row[: len(slot)] + slot)[inside], minlength=rows * DIMS)
    return out.reshape(rows, DIMS)


def tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts, dtype=np.float32) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart starts: unit centroids and each row's cosine with its own."""
    picked = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[picked[0]]
    while len(picked) < min(k, len(x)):
        picked.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[picked[-1]])
    c = x[picked].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c, x @ c.T


@dataclass
class Model:
    langs: list[str]  # of each centroid
    centroids: np.ndarray  # centroids x DIMS
    least: np.ndarray  # the cosine below which a text is rejected
    idf: np.ndarray


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS) -> Model:
    """docs' rows for which `train` holds and the language is known teach; at most about per_language texts of each."""
    known = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit(11)), F.lit(1 << 30)).cast("double") / float(1 << 30)
    counted = known.groupBy(F.col(lang_col).cast("string").alias("l")).count().collect()
    share = {r["l"]: per_language / r["count"] for r in counted}
    if not share:
        return Model([], np.zeros((0, DIMS), np.float32), np.zeros(0), np.ones(DIMS, np.float32))
    limit = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])
    sample = texts_of(known.where(draw < limit[F.col(lang_col).cast("string")]), id_col, text_col, F.col(lang_col).cast("string").alias("lang"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = utf8_column(b.column(1))
            for i, j in blocks(off, 1 << 20, ROWS):
                counts = gram_counts(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                at = [np.flatnonzero(c) for c in counts]
                yield pa.record_batch([b.column(2).slice(i, j - i), pa.array([x.astype(np.int32) for x in at], pa.list_(pa.int32())), pa.array([c[x].astype(np.int32) for c, x in zip(counts, at, strict=True)], pa.list_(pa.int32()))], names=["lang", "slot", "n"])

    rows = cut(sample.mapInArrow(features, "lang string, slot array<int>, n array<int>"), "languages")
    if total := rows.count():
        seen = rows.select(F.explode("slot").alias("slot")).groupBy("slot").count().toPandas()
        df = np.zeros(DIMS)
        df[seen["slot"].to_numpy(int)] = seen["count"].to_numpy()
        idf = (np.log((1 + total) / (1 + df)) + 1e-3).astype(np.float32)

        def centre(part: pd.DataFrame) -> pd.DataFrame:
            counts = np.zeros((len(part), DIMS), np.float32)
            for k, (slot, n) in enumerate(zip(part["slot"], part["n"], strict=True)):
                counts[k, np.asarray(slot, int)] = n
            x = tfidf(counts, idf)
            x = x[np.lexsort(np.round(x @ x.sum(axis=0), 6)[None])]  # an order of its own, whatever order rows come in
            c, cos = cluster(x, centroids)
            own = np.argmax(cos, axis=1)
            least = [float(np.quantile(cos[own == j, j], 0.01)) * 0.7 if (own == j).any() else 0.0 for j in range(len(c))]
            return pd.DataFrame({"lang": part["lang"].iloc[0], "k": range(len(c)), "c": [v.astype("<f4").tobytes() for v in c], "least": least})

        got = rows.groupBy("lang").applyInPandas(centre, "lang string, k int, c binary, least double").toPandas().sort_values(["lang", "k"])
    else:
        return Model([], np.zeros((0, DIMS), np.float32), np.zeros(0), np.ones(DIMS, np.float32))
    return Model(got["lang"].tolist(), np.stack([np.frombuffer(c, "<f4") for c in got["c"]]), got["least"].to_numpy(float), idf)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", reject: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, rejected; with reject, rejected texts become `und`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = np.ascontiguousarray(model.centroids.T)
        for b in batches:
            buf, off = utf8_column(b.column(1))
            for i, j in blocks(off, 1 << 20, ROWS):
                own, edge = buf[off[i] : off[j]], off[i : j + 1] - off[i]
                letters = np.diff(np.concatenate([[0], np.cumsum(ASCII_LETTERS[own])])[edge]) > 0
                for k in np.flatnonzero(~letters & (np.diff(edge) > 0)):
                    letters[k] = any(map(str.isalpha, own[edge[k] : edge[k + 1]].tobytes().decode("utf-8", "replace")))
                if model.langs:
                    cos = tfidf(gram_counts(own, edge), model.idf) @ matrix
                    best = np.argmax(cos, axis=1)
                    score = np.where(letters, np.clip(cos[np.arange(j - i), best].astype(float), 0, 1), 0.0)
                    far = ~letters | (score < model.least[best])
                    lang = [UNKNOWN if not ok or (reject and f) else model.langs[m] for ok, f, m in zip(letters, far, best, strict=True)]
                else:
                    score, far, lang = np.zeros(j - i), np.ones(j - i, bool), [UNKNOWN] * (j - i)
                yield pa.record_batch([b.column(0).slice(i, j - i), pa.array(lang, pa.string()), pa.array(score), pa.array(far)], names=["doc_id", "lang_pred", "score", "rejected"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
