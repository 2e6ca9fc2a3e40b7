"""Byte-level BPE with the tokenizers library over Arrow batches.

The vocabulary is given, never trained.  Pre-tokens can't cross a blank that follows a visible character, so a text is
cut before each such run of blanks and every different piece is encoded once a worker; a document's ids are its pieces'
ids in order.  Where the character before the blank is not surely visible (it may be Unicode white space), no cut is
made.  Decoding reverses the printable alphabet in which the vocabulary writes bytes; bytes of one character that
several ids share come together again because ids are joined as bytes before they are read as UTF-8.

Defined cases: null and empty texts have no ids; strings that look like special tokens are ordinary text; very long
texts are encoded whole.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from memloom.llm.textblocks import blocks, running_hash, span_hash, texts_of, utf8_column

MEMORY_PIECES = 1_700_000  # about 35 bytes each
ROWS = 2048  # texts answered at a time
#: Blanks start a piece only after an ASCII visible character or a two-byte character other than U+0085 and U+00A0.
PIECE_CUT = re.compile(rb"(?:(?<=[!-~])|(?<=[\xc3-\xdf][\x80-\xbf]))(?=[ \n])")
#: A piece of one blank and surely visible characters.
PLAIN = re.compile(rb"[ \n](?:[!-~]|[\xc3-\xdf][\x80-\xbf])+")
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x0A]] = True
#: A text without these bytes, and without two blanks in a row, has single blanks between surely visible characters only.
UNUSUAL = np.zeros(256, bool)
UNUSUAL[[*range(0x0A), *range(0x0B, 0x20), 0x7F, 0xC0, 0xC1, 0xC2, *range(0xE0, 0x100)]] = True


def piece_starts(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, bool]:
    """Where pieces start in the texts buf[off[i]:off[i + 1]], and whether all of these are usual."""
    blank = BLANK[buf]
    bad = UNUSUAL[buf]
    bad[1:] |= blank[1:] & blank[:-1]
    odd = np.unique(np.searchsorted(off, np.flatnonzero(bad), "right") - 1)
    blank[off[:-1][off[:-1] < off[1:]]] = True
    for i in odd:
        blank[off[i] : off[i + 1]] = False
        blank[off[i]] = True
        blank[[off[i] + m.start() for m in PIECE_CUT.finditer(buf[off[i] : off[i + 1]].tobytes())]] = True
    return np.flatnonzero(blank), not len(odd)


@functools.cache
def byte_alphabet() -> dict[str, int]:
    """Printable character -> byte: visible Latin-1 stands for itself, the others follow from U+0100 in byte order."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """ids of texts and texts of ids, with a bounded memory of encoded pieces."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has its core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.unit = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        alphabet = byte_alphabet()
        self.bytes_of = [bytes(alphabet[c] for c in t) if (t := self.tokenizer.id_to_token(i)) is not None and all(c in alphabet for c in t) else (t or "").encode() for i in range(size)]
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self._forget()

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_column(pa.array([text], pa.string()))[0]

    def encode_column(self, column) -> list[np.ndarray]:
        """ids of each text of an Arrow array."""
        buf, off = utf8_column(column)
        out = []
        for i, j in blocks(off, 8 << 20):
            out += self._block(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        return out

    def _block(self, buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        start, usual = piece_starts(buf, off)
        if not len(start):
            return [np.zeros(0, self.unit)] * (len(off) - 1)
        ends = np.append(start, len(buf)).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(buf)]).dictionary_encode()
        at, size = self._find(coded.dictionary, usual)
        which = np.asarray(coded.indices)
        n = size[which]
        done = np.concatenate([[0], np.cumsum(n)])
        flat = self.pool[np.repeat(at[which] - done[:-1], n) + np.arange(done[-1])]
        cut = done[np.searchsorted(start, off)]
        return [flat[s:e] for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def _forget(self) -> None:
        self.runs: list[tuple[np.ndarray, ...]] = []
        self.pool = np.zeros(0, self.unit)

    def _remember(self, *new: np.ndarray) -> None:
        """Adds names, checks, places and sizes. Runs are sorted by name, and each is over twice as long as the next."""
        order = np.argsort(new[0], kind="stable")
        self.runs.append(tuple(x[order] for x in new))
        while len(self.runs) > 1 and len(self.runs[-2][0]) <= 2 * len(self.runs[-1][0]):
            last, before = self.runs.pop(), self.runs.pop()
            order = np.argsort(np.concatenate([before[0], last[0]]), kind="stable")
            self.runs.append(tuple(np.concatenate([a, b])[order] for a, b in zip(before, last, strict=True)))

    def _find(self, pieces: pa.Array, usual: bool) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool each piece's ids are, and how many. A piece is known by 128 bits of hash; new ones are encoded."""
        if sum(len(r[0]) for r in self.runs) > MEMORY_PIECES:
            self._forget()
        buf, off = utf8_column(pieces)
        name, check = (span_hash(running_hash(x), off[:-1], off[1:]) for x in (buf, buf ^ np.uint8(0x5A)))
        at, size = np.zeros(len(name), np.int64), np.zeros(len(name), np.int64)
        new = np.argsort(name)  # in order, so that looking up walks each run once
        for names, checks, places, sizes in self.runs:
            near = np.minimum(np.searchsorted(names, name[new]), len(names) - 1)
            known = (names[near] == name[new]) & (checks[near] == check[new])
            at[new[known]], size[new[known]] = places[near[known]], sizes[near[known]]
            new = new[~known]
        if len(new):
            new.sort()
            ids, where, n = self._encode_pieces(pieces.take(pa.array(new)).to_pylist(), usual)
            at[new], size[new] = len(self.pool) + where, n
            self.pool = np.concatenate([self.pool, ids])
            self._remember(name[new], check[new], at[new].astype(np.uint32), n.astype(np.int32))
        return at, size

    def _encode_pieces(self, pieces: list[bytes], usual: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An array of ids, and where in it each piece's are, and how many."""
        plain = np.array([len(p) > 1 and p[0] in b" \n" for p in pieces] if usual else [PLAIN.fullmatch(p) is not None for p in pieces], bool)
        parts, n = [], np.zeros(len(pieces), np.int64)
        got = self._encode_plain([p for p, ok in zip(pieces, plain.tolist(), strict=True) if ok]) if self.line is not None and plain.any() else None
        if got is None:
            plain[:] = False
        else:
            parts.append(got[0])
            n[plain] = got[1]
        rest = np.flatnonzero(~plain)
        for i in range(0, len(rest), 4096):
            for k, e in zip(rest[i : i + 4096].tolist(), self.tokenizer.encode_batch_fast([pieces[k].decode() for k in rest[i : i + 4096].tolist()], add_special_tokens=False), strict=True):
                parts.append(np.array(e.ids, self.unit))
                n[k] = len(e.ids)
        order = np.concatenate([np.flatnonzero(plain), rest])
        where = np.zeros(len(pieces), np.int64)
        where[order] = np.cumsum(n[order]) - n[order]
        return np.concatenate(parts), where, n

    def _encode_plain(self, pieces: list[bytes], run: int = 128) -> tuple[np.ndarray, np.ndarray] | None:
        """Pieces of one blank and visible characters, many in one text with a new line before each: that is a pre-token of its own."""
        own_line = np.array([p[0] == 0x0A for p in pieces])
        flat = []
        for i in range(0, len(pieces), 512 * run):
            lines = [b"".join(p if p[0] == 0x0A else b"\n" + p for p in pieces[j : j + run]).decode() for j in range(i, min(len(pieces), i + 512 * run), run)]
            flat += [np.array(e.ids, self.unit) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        flat = np.concatenate(flat)
        at = np.flatnonzero(flat == self.line)
        if len(at) != len(pieces):
            return None  # this vocabulary joins the new line to something
        keep = np.ones(len(flat), bool)
        keep[at[~own_line]] = False
        return flat[keep], np.diff(np.append(at, len(flat))) - ~own_line

    def encode_with_offsets(self, text: str | None) -> tuple[list[int], list[tuple[int, int]]]:
        """ids, and for each the characters [start, end) that its bytes touch; parts of one character share its span."""
        e = self.tokenizer.encode(text or "", add_special_tokens=False)
        return e.ids, e.offsets

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids) -> str:
        """Text of ids; a character of which bytes are missing becomes U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@functools.cache
def codec(path: str) -> Codec:
    """One a worker process."""
    return Codec(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """doc_id, ids (array of int), and with offsets also starts and ends in characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                cols, texts = [b.column(0).slice(i, ROWS)], b.column(1).slice(i, ROWS)
                if offsets:
                    both = [c.encode_with_offsets(t) for t in texts.to_pylist()]
                    cols += [pa.array([x for x, _ in both], pa.list_(pa.int32())), *(pa.array([[o[k] for o in y] for _, y in both], pa.list_(pa.int32())) for k in (0, 1))]
                else:
                    cols.append(pa.array([x.astype(np.int32) for x in c.encode_column(texts)], pa.list_(pa.int32())))
                yield pa.record_batch(cols, names=["doc_id", "ids", "starts", "ends"][: len(cols)])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>" + ", starts array<int>, ends array<int>" * offsets)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, data (the bytes), text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            data = [c.decode_bytes(x or ()) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(data, pa.binary()), pa.array([d.decode("utf-8", "replace") for d in data], pa.string())], names=["doc_id", "data", "text"])

    return encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, data binary, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded and its ids decoded in the same pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        names = [str(i) for i in range(len(c.bytes_of))]
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                n, ids_sha, text_sha = [], [], []
                for ids in map(np.ndarray.tolist, c.encode_column(b.column(1).slice(i, ROWS))):
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(c.decode_bytes(ids)).hexdigest())
                yield pa.record_batch([b.column(0).slice(i, ROWS), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_checked(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids, round_trip: whether the ids decode to exactly the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                texts = b.column(1).slice(i, ROWS)
                ids = c.encode_column(texts)
                same = [c.decode_bytes(x.tolist()) == (t or "").encode() for x, t in zip(ids, texts.to_pylist(), strict=True)]
                flat = pa.array(np.concatenate(ids).astype(np.int32))
                off = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32))
                yield pa.record_batch([b.column(0).slice(i, ROWS), pa.array([len(x) for x in ids], pa.int64()), pa.ListArray.from_arrays(off, flat), pa.array(same)], names=["doc_id", "n_tokens", "ids", "round_trip"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")
