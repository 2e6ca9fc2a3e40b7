"""Schemas of the store's tables."""

#: `no` numbers what a file held when it was indexed; its chunks have the same number.
FILES = "path string, source string, hash string, mtime_ms double, size long, no long"
CHUNKS = "id string, path string, source string, start_line int, end_line int, hash string, text string, updated_at long"
#: Chunks as they are stored, with their part of the index.
INDEXED = CHUNKS + ", no long, terms array<string>, positions array<array<int>>, dl int"
#: Numbers that are gone, 64 in a row: bit b of word w stands for 64 * w + b.
GONE = "word long, bits long"
POSTINGS = "id string, term string, positions array<int>, dl int"
DOC_STATS = "id string, dl int"
VECTORS = "id string, embedding array<float>"
CACHE = "hash string, embedding array<float>, updated_at long"
ACCESS = "path string, start_line int, accessed_at long"
#: What a scan of sources hands to `sync`: text is null where a file could not be read.
LISTING = "path string, source string, mtime_ms double, size long, text string"
TABLES = {"files": FILES, "chunks": CHUNKS, "postings": POSTINGS, "doc_stats": DOC_STATS, "vectors": VECTORS, "cache": CACHE, "access": ACCESS}
#: What the store keeps in folders: postings and lengths are read from its chunks.
STORED = {"files": FILES, "chunks": INDEXED, "gone": GONE, "vectors": VECTORS, "cache": CACHE, "access": ACCESS}
SCHEMA_VERSION = 3
