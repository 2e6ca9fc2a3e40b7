"""Media columns: signature sniffing of binary values.

An Aho-Corasick automaton finds every magic byte string of a value in one pass; a validator of the format then walks
the structure from there (chunk lengths, checksums, trailers) and says where the media ends.  A value whose start is
valid media has that type, whatever was declared; media that starts further inside is carved.  A byte string that
merely looks like a signature fails its validator and is not reported.

`store_wave` keeps any payload losslessly as 8-bit mono samples of a RIFF/WAVE file; `read_media` finds it again by
its signature and lengths alone.

Defined cases: a null value has type null and no parts; an empty value is `application/octet-stream`; media inside
media (from its first byte to its end) is not reported twice; rows that repeat an id are stored and described one by one.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from memloom.llm.textblocks import texts_of

UNKNOWN = "application/octet-stream"
# Magic bytes as published for each format; the offset says where in the media they stand.
SIGNATURES = {
    b"\x89PNG\r\n\x1a\n": ("image/png", 0),
    b"GIF87a": ("image/gif", 0),
    b"GIF89a": ("image/gif", 0),
    b"\xff\xd8\xff": ("image/jpeg", 0),
    b"BM": ("image/bmp", 0),
    b"RIFF": ("riff", 0),
    b"%PDF-": ("application/pdf", 0),
    b"PK\x03\x04": ("application/zip", 0),
    b"\x1f\x8b\x08": ("application/gzip", 0),
    b"OggS": ("audio/ogg", 0),
    b"fLaC": ("audio/flac", 0),
    b"ID3": ("audio/mpeg", 0),
    b"ftyp": ("video/mp4", 4),
}
RIFF_KINDS = {b"WAVE": "audio/wav", b"AVI ": "video/x-msvideo", b"WEBP": "image/webp"}


@functools.cache
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic, (kind, at) in SIGNATURES.items():
        a.add_word(magic.decode("latin-1"), (len(magic), kind, at))
    a.make_automaton()
    return a


class Marks:
    """Where byte strings stand in a value, each looked for once however many signatures ask."""

    def __init__(self, data: bytes):
        self.data, self.found = data, {}

    def __call__(self, mark: bytes) -> list[int]:
        if mark not in self.found:
            self.found[mark] = [m.start() for m in re.finditer(re.escape(mark), self.data)]
        return self.found[mark]

    def next(self, mark: bytes, at: int) -> int | None:
        """The first one from `at` on."""
        found = self(mark)
        return found[k] if (k := bisect.bisect_left(found, at)) < len(found) else None

    def last(self, mark: bytes, at: int, end: int) -> int | None:
        """The last one from `at` on, before `end`."""
        found = self(mark)
        return found[k] if (k := bisect.bisect_left(found, end) - 1) >= 0 and found[k] >= at else None


def _png(d: bytes, s: int, marks: Marks) -> int | None:
    at = s + 8
    while at + 12 <= len(d):
        size, kind = struct.unpack_from(">I4s", d, at)
        if at + 12 + size > len(d) or zlib.crc32(d[at + 4 : at + 8 + size]) != struct.unpack_from(">I", d, at + 8 + size)[0] or (at == s + 8) != (kind == b"IHDR"):
            return None
        at += 12 + size
        if kind == b"IEND":
            return at
    return None


def _blocks(d: bytes, at: int) -> int:
    """After a GIF's data sub-blocks; IndexError where they run out."""
    while d[at]:
        at += d[at] + 1
    return at + 1


def _gif(d: bytes, s: int, marks: Marks) -> int | None:
    try:
        at = s + 13 + (3 << (d[s + 10] & 7) + 1 if d[s + 10] & 0x80 else 0)
        while True:
            if d[at] == 0x3B:
                return at + 1
            if d[at] == 0x21:
                at = _blocks(d, at + 2)
            elif d[at] == 0x2C:
                at = _blocks(d, at + 11 + (3 << (d[at + 9] & 7) + 1 if d[at + 9] & 0x80 else 0))
            else:
                return None
    except IndexError:
        return None


def _jpeg(d: bytes, s: int, marks: Marks) -> int | None:
    at = s + 2
    while at + 4 <= len(d) and d[at] == 0xFF and d[at + 1] not in (0xD8, 0xD9, 0x00):
        kind, size = d[at + 1], struct.unpack_from(">H", d, at + 2)[0]
        if size < 2 or at + 2 + size > len(d):
            return None
        at += 2 + size
        if kind == 0xDA:
            end = at
            while (end := d.find(b"\xff", end)) >= 0 and end + 1 < len(d):
                if d[end + 1] == 0xD9:
                    return end + 2
                if d[end + 1] and not 0xD0 <= d[end + 1] <= 0xD7:
                    at = end
                    break
                end += 2
            else:
                return None
    return None


def _bmp(d: bytes, s: int, marks: Marks) -> int | None:
    if s + 30 > len(d):
        return None
    size, spare, start, head, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", d, s + 2)
    ok = spare == 0 and head in (12, 40, 52, 56, 108, 124) and 14 + head <= start <= size <= len(d) - s and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and width > 0 and height
    return s + size if ok else None


def _riff(d: bytes, s: int) -> tuple[int, str] | None:
    if s + 12 > len(d) or (kind := RIFF_KINDS.get(bytes(d[s + 8 : s + 12]))) is None:
        return None
    end = s + 8 + struct.unpack_from("<I", d, s + 4)[0]
    at = s + 12
    if end > len(d) or end < at + 8:
        return None
    while at + 8 <= end:
        at += 8 + (n := struct.unpack_from("<I", d, at + 4)[0]) + n % 2
    return (end, kind) if at == end else None


def _pdf(d: bytes, s: int, marks: Marks) -> int | None:
    """To the last end mark before another PDF: updates of a file are written after its first one."""
    limit = marks.next(b"%PDF-", s + 5)
    end = marks.last(b"%%EOF", s, len(d) if limit is None else limit)
    start = None if end is None else marks.next(b"startxref", s)
    return end + 5 if start is not None and start < end else None


def _zip(d: bytes, s: int, marks: Marks) -> int | None:
    end = marks.next(b"PK\x05\x06", s)
    if end is None or end + 22 > len(d):
        return None
    size, start, note = struct.unpack_from("<IIH", d, end + 12)
    ok = s + start + size == end and (size == 0 or d[s + start : s + start + 4] == b"PK\x01\x02") and end + 22 + note <= len(d)
    return end + 22 + note if ok else None


def _gzip(d: bytes, s: int, marks: Marks) -> int | None:
    work, at = zlib.decompressobj(31), s
    try:
        while at < len(d) and not work.eof:
            work.decompress(d[at : at + 65536])
            at += 65536
    except zlib.error:
        return None
    return min(at, len(d)) - len(work.unused_data) if work.eof else None


def _ogg(d: bytes, s: int, marks: Marks) -> int | None:
    at, pages = s, 0
    while d[at : at + 4] == b"OggS" and at + 27 <= len(d) and d[at + 4] == 0:
        n = d[at + 26]
        if (to := at + 27 + n + sum(d[at + 27 : at + 27 + n])) > len(d) or (pages == 0 and not d[at + 5] & 2):
            break
        at, pages = to, pages + 1
    return at if pages else None


def _crc_table(poly: int, bits: int) -> list[int]:
    out = []
    for x in range(256):
        x <<= bits - 8
        for _ in range(8):
            x = (x << 1 ^ (poly if x >> bits - 1 else 0)) & (1 << bits) - 1
        out.append(x)
    return out


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _flac_header(d: bytes, s: int) -> int | None:
    """The end of a frame header: its number's length, optional sizes, and a checksum over all of it."""
    if s + 6 > len(d) or d[s] != 0xFF or d[s + 1] not in (0xF8, 0xF9) or d[s + 3] & 1:
        return None
    size, rate, lead = d[s + 2] >> 4, d[s + 2] & 15, d[s + 4]
    number = 1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
    if size == 0 or rate == 15 or d[s + 3] >> 4 > 10 or not 1 <= number <= 7 or 0x80 <= lead < 0xC0:
        return None
    end = s + 4 + number + {6: 1, 7: 2}.get(size, 0) + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    crc = 0
    for x in d[s:end]:
        crc = CRC8[crc ^ x]
    return end + 1 if end < len(d) and d[end] == crc else None


def _flac_frame(d: bytes, s: int, least: int) -> int | None:
    """The end of a frame, where its checksum closes: before another frame's header if there is one, else at the first such place."""
    if (at := _flac_header(d, s)) is None:
        return None
    crc, first = 0, None
    for i in range(s, len(d)):
        crc = (crc << 8 & 0xFFFF) ^ CRC16[crc >> 8 ^ d[i]]
        # over a frame and its own checksum it is 0
        if crc == 0 and i + 1 >= max(at + 2, s + least):
            first = first or i + 1
            if i + 1 == len(d) or _flac_header(d, i + 1) is not None:
                return i + 1
        if first and i > first + FLAC_FAR:
            break
    return first


FLAC_FAR = 1 << 16  # bytes after a possible end in which another frame may still show that it was none


def _flac(d: bytes, s: int, marks: Marks) -> int | None:
    at, last, least = s + 4, False, 0
    while not last:
        if at + 4 > len(d):
            return None
        last, kind, size = d[at] >> 7, d[at] & 127, int.from_bytes(d[at + 1 : at + 4], "big")
        if (at == s + 4) != (kind == 0) or (kind == 0 and size != 34) or at + 4 + size > len(d):
            return None
        if kind == 0:
            least = int.from_bytes(d[at + 8 : at + 11], "big")
        at += 4 + size
    end = None
    while (to := _flac_frame(d, at, least)) is not None:
        at = end = to
    return end


# Kilobits a second of MPEG audio by version 1 or 2 and layer, and samples a second of version 1.
MPEG_RATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
MPEG_SAMPLES = (44100, 48000, 32000)


def _mpeg_frame(d: bytes, s: int) -> int | None:
    """The end of a frame, which its header tells."""
    if s + 4 > len(d) or d[s] != 0xFF or d[s + 1] & 0xE0 != 0xE0:
        return None
    version, layer, rate, sample, pad = d[s + 1] >> 3 & 3, 4 - (d[s + 1] >> 1 & 3), d[s + 2] >> 4, d[s + 2] >> 2 & 3, d[s + 2] >> 1 & 1
    if version == 1 or layer == 4 or rate in (0, 15) or sample == 3:
        return None
    kbits = MPEG_RATES[1 if version == 3 else 2, layer][rate - 1]
    hertz = MPEG_SAMPLES[sample] // {3: 1, 2: 2, 0: 4}[version]
    size = (12000 * kbits // hertz + pad) * 4 if layer == 1 else (72000 if layer == 3 and version != 3 else 144000) * kbits // hertz + pad
    return s + size if s + size <= len(d) else None


def _mp3(d: bytes, s: int, marks: Marks) -> int | None:
    if s + 10 > len(d) or d[s + 3] not in (2, 3, 4) or any(x & 0x80 for x in d[s + 6 : s + 10]):
        return None
    at, end = s + 10 + sum(x << 7 * (3 - i) for i, x in enumerate(d[s + 6 : s + 10])), None
    while (to := _mpeg_frame(d, at)) is not None:
        at = end = to
    return end + 128 if end and d[end : end + 3] == b"TAG" and end + 128 <= len(d) else end


def _mp4(d: bytes, s: int, marks: Marks) -> int | None:
    at, seen = s, set()
    while at + 8 <= len(d):
        size, kind = struct.unpack_from(">I4s", d, at)
        if size < 8 or at + size > len(d) or not kind.isalnum():
            break
        seen.add(kind)
        at += size
    return at if b"ftyp" in seen and seen & {b"moov", b"moof", b"mdat"} else None


CHECKS = {
    "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "application/pdf": _pdf, "application/zip": _zip,
    "application/gzip": _gzip, "audio/ogg": _ogg, "audio/flac": _flac, "audio/mpeg": _mp3, "video/mp4": _mp4,
}


def find_media(data: bytes) -> list[tuple[str, int, int]]:
    """(type, start, end) of all valid media in data, in order, none inside another."""
    found: list[tuple[str, int, int]] = []
    free, marks = 0, Marks(data)
    for end, (size, kind, at) in automaton().iter(data.decode("latin-1")):
        start = end + 1 - size - at
        if start < free:
            continue
        if kind == "riff":
            got = _riff(data, start)
            stop, kind = got if got else (None, kind)
        else:
            stop = CHECKS[kind](data, start, marks)
        if stop is not None:
            found.append((kind, start, stop))
            free = stop
    return found


def pad(payload: bytes, unit: int = 64) -> bytes:
    """payload with bytes 0 appended up to a positive multiple of unit."""
    return payload + bytes(max(unit, -(-len(payload) // unit) * unit) - len(payload))


def wave(payload: bytes, rate: int = 8000) -> bytes:
    """A RIFF/WAVE file of 8-bit mono samples; an odd payload gets the pad byte that RIFF asks for."""
    odd = len(payload) % 2
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + odd, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload + bytes(odd)


def wave_samples(data: bytes, start: int, end: int) -> bytes | None:
    """The data chunk of a valid WAVE file at data[start:end]."""
    at = start + 12
    while at + 8 <= end:
        kind, size = struct.unpack_from("<4sI", data, at)
        if kind == b"data":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return None


def store_wave(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media, declared: each text's padded UTF-8 as a sound file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                raw = [(t or "").encode() for t in b.column(1).slice(i, 512).to_pylist()]
                yield pa.record_batch([b.column(0).slice(i, 512), pa.array([len(x) for x in raw], pa.int64()), pa.array([wave(pad(x)) for x in raw], pa.binary()), pa.array([UNKNOWN] * len(raw))], names=["doc_id", "n_bytes", "media", "declared"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary, declared string")


SNIFFED = "detected string, corrected boolean, parts array<struct<type: string, start: long, end: long>>"


def sniff(media: DataFrame, data_col: str = "media", declared_col: str = "declared", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, detected type, whether the declared type was wrong, and the parts carved out of the value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            found = [None if d is None else find_media(d) for d in b.column(0).to_pylist()]
            types = [None if f is None else f[0][0] if f and f[0][1] == 0 else UNKNOWN for f in found]
            wrong = [t is not None and t != d for t, d in zip(types, b.column(1).to_pylist(), strict=True)]
            parts = [None if f is None else [{"type": t, "start": s, "end": e} for t, s, e in f] for f in found]
            yield pa.record_batch([*b.columns[2:], pa.array(types, pa.string()), pa.array(wrong), pa.array(parts, kind)], names=[*b.schema.names[2:], "detected", "corrected", "parts"])

    read = media.select(F.col(data_col).alias("_data"), F.col(declared_col).alias("_declared"), *keep)
    return read.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in read.schema[2:]) + ", " + SNIFFED)


def feature(data: bytes, found: list[tuple[str, int, int]], samples: bytes) -> str:
    """A value's structure and the first moments of its samples, as text."""
    x = np.frombuffer(samples, np.uint8)
    kinds = ",".join(sorted({t for t, _, _ in found})) or UNKNOWN
    # media embedded in the samples themselves, which the outer file hides
    inner = ",".join(f"{t}@{s}+{e - s}" for t, s, e in find_media(samples)) or "-"
    return f"type={kinds};samples={len(x)};mean={x.mean():.4f};std={x.std():.4f};crossings={int(np.count_nonzero(np.diff(x > 127)))};inner={inner}"


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored by `store_wave`, found again by its signature, and described from the stored bytes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "detected", "corrected"]
        for b in batches:
            rows = []
            for n, data, declared in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                found = find_media(data)
                whole = found and found[0][1] == 0 and found[0][2] == len(data) and wave_samples(data, 0, len(data))
                if not whole:
                    raise ValueError("a stored sound file can't be read back")
                rows.append((n, len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(data, found, whole), found[0][0], found[0][0] != declared))
            cols = list(zip(*rows, strict=True)) or [()] * 9
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
            yield pa.record_batch([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return store_wave(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, detected string, corrected boolean")
