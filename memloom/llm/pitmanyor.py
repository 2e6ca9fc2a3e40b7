"""A hierarchical Pitman-Yor language model over words, fitted by Gibbs sampling.

Tokens are lower-cased words and one end a text.  Every word is a context with a restaurant of its own, which serves the
words that follow it; its tables are customers of the root, whose base is uniform over the training vocabulary and one
unknown word.  A context without training text passes everything on to the root.

Seating is sampled dish by dish: all customers of a dish leave and sit down again one after the other (large dishes in
batches of a sixteenth), and the new seating is accepted with the Metropolis ratio of the two seatings' weights, which
makes each step leave the posterior as it is.  Each dish draws its own random numbers, by its words' names, so scores
don't depend on tasks or partitions.  All dishes of a sweep move at once given the last sweep's totals, which
are those of the whole corpus.  A dish with one customer always has one table and needs no sampling.  Predictive
probabilities are averaged over the kept sweeps.

1. Words are counted (all training texts); N, V and the words whose pairs one task could not take follow.
2. Each block of documents sends its different pairs (context, word), with their number of times in training texts, to
   the pair's task: that of the word, or of both words where the word has `SHARE` of all tokens.
3. Sweeps: pairs' tasks seat the customers of contexts and send each word's tables (as context and as dish), one row a
   word, to the word's task; that one adds them up, seats the root's customers and answers with the new totals.
4. Pairs' and words' tasks answer each block in the order of what it sent, and the block adds up its documents' tokens.

Defined cases: a null or empty text is one end; a null id is scored but neither taught from nor held out; without
training text every token has probability 1, as in the add-one base; rows that repeat an id are texts of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from memloom.llm.shared import cut, drop, free
from memloom.llm.textblocks import Block, buckets_of, exchange, give_back, mix, pack, packed_batches, texts_of, unpack_all, word_blocks

SHARE = 1 / 2048  # from this share of all tokens on, a word's pairs are spread over tasks by context
DISCOUNT, STRENGTH = 0.75, 1.0
SWEEPS, KEPT = 5, 3
END = np.uint64(0x454E442D4F462D54)  # the end token's hash; words' hashes are 64-bit as well
BUCKET_BYTES = 5 << 20  # of input a bucket, as a task holds a bucket's pairs whole
OWNERS = 8  # words' totals are light
BLOCK_TOKENS, BLOCK_DOCS = 1_200_000, 30_000


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a block's tokens, their rows, and those of the tokens before (an end before the first)."""
    at = block.first[1:] + np.arange(block.rows)
    out = np.empty(len(block.start) + block.rows, np.uint64)
    keep = np.ones(len(out), bool)
    keep[at] = False
    out[keep] = block.hashes()
    out[at] = END
    row = np.repeat(np.arange(block.rows), block.counts + 1)
    before = np.concatenate([[END], out[:-1]])
    return out, row, before


def teaches(ids: list, rest: int, of: int) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % of != rest for i in ids], bool)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    """Buckets are ranges of hashes, so rows in the order of their hash are in the order of their bucket."""
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def count_words(texts: DataFrame, rest: int, of: int, n: int) -> DataFrame:
    """word, n, all, distinct, once, twice: the most frequent words; with a null word, totals of one task."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
            h, c = np.unique(np.concatenate(parts), return_counts=True)
            yield from pack(_bucket(h, n), n, h, c.astype(np.int64))

        def pairs() -> Iterator[tuple[int, bytes]]:
            parts, held = [], 0
            for b in batches:
                known = teaches(b.column(0).to_pylist(), rest, of)
                for i, block in word_blocks(b.column(1), lower=True):
                    h, row, _ = tokens(block)
                    parts.append(h[known[i + row]])
                    held += len(parts[-1])
                    if held > BLOCK_TOKENS:
                        yield from flush(parts)
                        parts, held = [], 0
            if held:
                yield from flush(parts)

        yield from packed_batches(pairs())
        give_back()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, c = unpack_all(batches, np.uint64, np.int64)
        h, at = np.unique(h, return_inverse=True)
        n = np.bincount(at, weights=c, minlength=len(h)).astype(np.int64)
        often = n >= SHARE * n.sum()  # whoever has its share of all tokens has it of this task's
        words, counts = h[often].view(np.int64), n[often]
        none = [0] * len(words)
        yield pa.record_batch([pa.array([*words.tolist(), None], pa.int64()), pa.array([*counts.tolist(), 0], pa.int64()), *(pa.array([*none, int(x)], pa.int64()) for x in (n.sum(), len(n), (n == 1).sum(), (n == 2).sum()))], names=["word", "n", "all", "distinct", "once", "twice"])

    return exchange(texts.mapInArrow(send, "bucket int, data binary"), n=n).mapInArrow(meet, "word long, n long, all long, distinct long, once long, twice long")


STATIC, CODES, ASKED, STREAM, PAIRS, FIXED, TABLES, TOTALS, SEATS, WORDS, SUMS, PAIR_ANSWER, WORD_ANSWER = range(13)
ROW = pa.schema([("kind", pa.int32()), ("to", pa.int64()), ("src", pa.int64()), ("data", pa.binary())])
ROW_TEXT = "kind int, to long, src long, data binary"
ONCE, NEVER = -2, -1  # codes of pairs that aren't sampled
WORD_STATE = (np.uint64, *[np.int64] * 4, np.float64, *[np.int64] * 3)


def _blob(*columns: np.ndarray) -> bytes:
    """Columns as planes of bytes, compressed: most numbers are small."""
    out = []
    for c in columns:
        c = np.ascontiguousarray(c).reshape(-1)
        planes = np.ascontiguousarray(c.view(np.uint8).reshape(-1, c.itemsize).T).tobytes()
        packed = pa.compress(planes, "zstd", asbytes=True)
        out += [np.array([c.size, len(packed)], np.int64).tobytes(), packed]
    return b"".join(out)


def _columns(blob: bytes, *types) -> list[np.ndarray]:
    at, out = 0, []
    for t in map(np.dtype, types):
        n, size = np.frombuffer(blob, np.int64, 2, at).tolist()
        planes = np.frombuffer(pa.decompress(blob[at + 16 : at + 16 + size], n * t.itemsize, "zstd"), np.uint8) if n else np.zeros(0, np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(t.itemsize, n).T).reshape(-1).view(t))
        at += 16 + size
    return out


def _rows(found: Iterator[tuple[int, int, int, bytes]], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches (kind, to, src, data) of bounded bytes."""

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ROW, strict=True)], schema=ROW)

    rows, size = [], 0
    for r in found:
        rows.append(r)
        size += len(r[3])
        if size >= limit:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    for b in batches:
        yield from zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """A task's buckets one after the other, each with its rows (kind, src, data) in an order of their own."""
    rows: dict[int, list] = {}
    for kind, to, src, data in _each(batches):
        rows.setdefault(to, []).append((kind, src, data))
    for to in sorted(rows):
        yield to, sorted(rows.pop(to), key=lambda r: r[:2])


def _home(block: int) -> int:
    """What deals a block of documents to a task."""
    return (block >> 24) + 31 * (block & 0xFFFFFF)


def _by_owner(words: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """Words in order, cut by the task that they belong to: one task in `OWNERS`, so that fewer messages are sent."""
    owners = -(-n // OWNERS)
    at = np.searchsorted(_bucket(words, owners), np.arange(owners + 1))
    for b in np.flatnonzero(np.diff(at)):
        yield int(b) * OWNERS, slice(at[b], at[b + 1])


def _deal(words: np.ndarray, pair: np.ndarray, often: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (word's number << 32 | context's) in order: words and contexts by bucket, where each bucket begins, and the order."""
    w, u = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
    spread = np.isin(words, often)[w]
    to = words[w]
    to[spread] = mix(to[spread] ^ mix(words[u[spread]], 61), 62)
    to = _bucket(to, n)
    order = np.argsort(to, kind="stable")
    return w[order], u[order], np.searchsorted(to[order], np.arange(n + 1)), order


def _before(at: np.ndarray, size: np.ndarray, end: int) -> np.ndarray:
    """The number of the token before each one; an end before the first of a document."""
    out = np.empty_like(at)
    out[1:] = at[:-1]
    out[np.cumsum(size) - size] = end
    return out


def _blocks(texts: DataFrame, often: np.ndarray, rest: int, of: int, n: int, stream: bool) -> DataFrame:
    """A block's words (ASKED) and its pairs (PAIRS); with `stream`, its documents (STREAM)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def flush(number: int, h: list, known: list, ids: list, sizes: list) -> Iterator[tuple[int, int, int, bytes]]:
            block = (part << 24) | number
            words, at = np.unique(np.concatenate(h), return_inverse=True)
            end, size = int(np.searchsorted(words, END)), np.array(sizes, np.int64)
            if stream:
                null = np.array([i is None for i in ids], np.uint8)
                yield STREAM, _home(block), block, _blob(np.array([0 if i is None else i for i in ids], np.int64), null, size, np.array([end]), words, at.astype(np.uint32))
                return
            before = _before(at, size, end)
            key = np.sort((at.astype(np.uint64) << np.uint64(33)) | (before.astype(np.uint64) << np.uint64(1)) | np.concatenate(known).astype(np.uint64))
            start = np.flatnonzero(np.concatenate([[True], key[1:] >> np.uint64(1) != key[:-1] >> np.uint64(1)]))
            times = np.add.reduceat(key & np.uint64(1), start).astype(np.uint32)
            w, u, edge, order = _deal(words, key[start] >> np.uint64(1), often, n)
            times = times[order]
            for b in np.flatnonzero(np.diff(edge)):
                s = slice(edge[b], edge[b + 1])
                fresh = np.flatnonzero(np.concatenate([[True], w[s][1:] != w[s][:-1]]))
                contexts, place = np.unique(u[s], return_inverse=True)
                yield PAIRS, int(b), block, _blob(words[w[s][fresh]], np.diff(np.append(fresh, s.stop - s.start)).astype(np.uint32), words[contexts], place.astype(np.uint32), times[s])
            for b, s in _by_owner(words, n):
                yield ASKED, b, block, _blob(words[s])

        def found() -> Iterator[tuple[int, int, int, bytes]]:
            number, held = 0, 0
            h, known, ids, sizes = [], [], [], []
            for b in batches:
                names = b.column(0).to_pylist()
                taught = teaches(names, rest, of)
                for i, block in word_blocks(b.column(1), lower=True):
                    own, row, _ = tokens(block)
                    for r in range(0, block.rows, BLOCK_DOCS):  # 2 MB may hold more texts than a block's documents
                        last = min(block.rows, r + BLOCK_DOCS)
                        fit = slice(*np.searchsorted(row, [r, last]))
                        if ids and (held + fit.stop - fit.start > BLOCK_TOKENS or len(ids) + last - r > BLOCK_DOCS):
                            yield from flush(number, h, known, ids, sizes)
                            number, held = number + 1, 0
                            h, known, ids, sizes = [], [], [], []
                        h.append(own[fit])
                        known.append(taught[i + row[fit]])
                        ids += names[i + r : i + last]
                        sizes += (block.counts[r:last] + 1).tolist()
                        held += fit.stop - fit.start
            if ids:
                yield from flush(number, h, known, ids, sizes)

        yield from _rows(found())
        give_back()

    return texts.mapInArrow(send, ROW_TEXT)


def _meet(sent: DataFrame, n: int) -> DataFrame:
    """Pairs with several customers (STATIC), what each block's pairs are (CODES), words' counts (FIXED) and first tables (TABLES); the rest as it came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(bucket: int, rows: list) -> Iterator[tuple[int, int, int, bytes]]:
            blocks, parts = [], []
            for kind, block, data in rows:
                if kind == PAIRS:
                    w, size, u, place, times = _columns(data, np.uint64, np.uint32, np.uint64, np.uint32, np.uint32)
                    parts.append((np.repeat(w, size), u[place], times))
                    blocks.append(block)
                else:
                    yield kind, bucket, block, data
            if not parts:
                return
            lengths = [len(p[1]) for p in parts]
            w, u, times = (np.concatenate([p[k] for p in parts]) for k in range(3))
            del parts
            names, at = np.unique(np.concatenate([w, u]), return_inverse=True)
            pair, own = np.unique((at[: len(w)].astype(np.uint64) << np.uint64(32)) | at[len(w) :].astype(np.uint64), return_inverse=True)
            del w, u, at
            count = np.bincount(own, weights=times, minlength=len(pair)).astype(np.int64)
            several = count > 1
            code = np.where(several, np.cumsum(several) - 1, np.where(count == 1, ONCE, NEVER)).astype(np.int32)[own]
            yield CODES, bucket, 0, _blob(np.array(blocks, np.int64), np.array(lengths, np.int64), code)
            w, u = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
            total = np.bincount(w, weights=count, minlength=len(names)).astype(np.int64)
            one_u, one_w = (np.bincount(x[count == 1], minlength=len(names)) for x in (u, w))
            some = np.flatnonzero((total > 0) | (np.bincount(u, weights=count, minlength=len(names)) > 0))
            for b, s in _by_owner(names[some], n):
                yield FIXED, b, bucket, _blob(names[some[s]], *(x[some[s]].astype(np.int64) for x in (total, one_u, one_w)))
            w, u, count = w[several], u[several], count[several]
            used, at = np.unique(np.concatenate([w, u]), return_inverse=True)
            w, u = at[: len(w)], at[len(w) :]
            yield STATIC, bucket, 0, _blob(names[used], w.astype(np.uint32), u.astype(np.uint32), count)
            yield from _tables(bucket, names[used], w, u, np.ones(len(w)), n)

        yield from _rows(r for bucket, rows in _by_bucket(batches) for r in found(bucket, rows))
        give_back()

    return exchange(sent, "to", n).mapInArrow(run, ROW_TEXT)


def _uniform(key: np.ndarray, draw: np.ndarray | int) -> np.ndarray:
    """Numbers in [0, 1) by what is drawn for and the draw's number, the same in whatever task they are drawn."""
    with np.errstate(over="ignore"):
        return (mix(key + np.asarray(draw).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 63) >> np.uint64(11)) * 2.0**-53


def seat(customers: np.ndarray, fresh: np.ndarray, discount: float, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tables of dishes whose customers sit down one after the other, and the log weight of what was chosen from.

    fresh: the weight of a new table, (strength + discount * tables) * the parent's probability.  key: of each dish, for
    its customers' draws.
    """
    tables = (customers > 0).astype(np.float64)
    log_z = np.zeros(len(customers))
    own, k = np.flatnonzero(customers > 1), 1
    while len(own):
        step = max(1, k // 16)
        m = np.minimum(step, customers[own] - k).astype(np.int64)
        z = k - discount * tables[own] + fresh[own]
        p = fresh[own] / z
        if step > 1:
            who = np.repeat(np.arange(len(own)), m)
            new = np.bincount(who, weights=_uniform(key[own][who], k + np.arange(len(who)) - (np.cumsum(m) - m)[who]) < p[who], minlength=len(own))
        else:
            new = _uniform(key[own], k) < p
        tables[own] = np.minimum(tables[own] + new, customers[own])
        log_z[own] += m * np.log(z)
        k += step
        own = own[customers[own] > k]
    return tables, log_z


def _tables(bucket: int, names: np.ndarray, w: np.ndarray, u: np.ndarray, t: np.ndarray, n: int) -> Iterator[tuple[int, int, int, bytes]]:
    as_context, as_dish = (np.bincount(x, weights=t, minlength=len(names)).astype(np.uint32) for x in (u, w))
    for b, s in _by_owner(names, n):
        yield TABLES, b, bucket, _blob(names[s], as_context[s], as_dish[s])


def pair_keys(words: np.ndarray, contexts: np.ndarray, sweep: int) -> np.ndarray:
    return mix(words ^ mix(contexts, 61), 200 + sweep)


def word_keys(words: np.ndarray, sweep: int) -> np.ndarray:
    return mix(words, 300 + sweep)


def seat_pairs(customers: np.ndarray, t: np.ndarray, z: np.ndarray, fresh: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sweep's step over the contexts' dishes: tables and their log weight."""
    new, new_z = seat(customers, fresh, DISCOUNT, key)
    take = np.log(_uniform(key, 0)) < new_z - z
    return np.where(take, new, t), np.where(take, new_z, z)


def seat_root(customers: np.ndarray, t: np.ndarray, z: np.ndarray, fresh: float, discount: float, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sweep's step over the root's dishes."""
    new, new_z = seat(customers, np.full(len(t), fresh), discount, key)
    take = (np.log(_uniform(key, 0)) < new_z - z) | (t > customers) | ((t == 0) & (customers > 0))
    return np.where(take, new, t), np.where(take, new_z, z)


def sample(pair_word: np.ndarray, pair_ctx: np.ndarray, pair_n: np.ndarray, words: int, context_n: np.ndarray, vocabulary: int, root_discount: float, seed: int = 0, names: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sweeps over a corpus that one task holds; context 0 is the root itself. names: hashes of words and contexts, for their draws.

    Of pairs with training counts: mean tables; of words and kept sweeps: customers and tables at the root; of contexts and kept sweeps: tables, in row 0 the root's, and in a last row the root's customers.
    """
    words_at, contexts_at = names or (mix(np.arange(k, dtype=np.uint64), salt + 100 * seed) for k, salt in ((words, 1), (len(context_n), 2)))
    own = np.flatnonzero((pair_ctx > 0) & (pair_n > 0))
    w, u, c = pair_word[own], pair_ctx[own], pair_n[own]
    direct = np.bincount(pair_word[pair_ctx == 0], weights=pair_n[pair_ctx == 0], minlength=words)
    base = 1 / (vocabulary + 1)
    t, z = np.ones(len(own)), np.full(len(own), -np.inf)
    root_c = direct + np.bincount(w, weights=t, minlength=words)
    root_t, root_z = (root_c > 0).astype(float), np.full(words, -np.inf)
    mean, root, totals = np.zeros(len(pair_n)), np.zeros((2, words, KEPT)), np.zeros((len(context_n) + 1, KEPT))
    for sweep in range(SWEEPS):
        new_at_root = (STRENGTH + root_discount * root_t.sum()) * base
        parent = ((root_c - root_discount * root_t).astype(np.float32).astype(float) + new_at_root) / (STRENGTH + root_c.sum())
        tables = np.bincount(u, weights=t, minlength=len(context_n))
        t, z = seat_pairs(c, t, z, (STRENGTH + DISCOUNT * tables)[u] * parent[w], pair_keys(words_at[w], contexts_at[u], sweep))
        root_c = direct + np.bincount(w, weights=t, minlength=words)
        root_t, root_z = seat_root(root_c, root_t, root_z, new_at_root, root_discount, word_keys(words_at, sweep))
        if (k := sweep - (SWEEPS - KEPT)) >= 0:
            mean[own] += t / KEPT
            root[:, :, k] = root_c, root_t
            totals[:-1, k] = np.bincount(u, weights=t, minlength=len(context_n))
            totals[0, k], totals[-1, k] = root_t.sum(), root_c.sum()
    return mean, root[0], root[1], totals


def _seat_contexts(rows: DataFrame, n: int, sweep: int, sums: tuple[float, float], base: float, root_discount: float) -> DataFrame:
    """STATIC, TOTALS and SEATS of the last sweep: SEATS and TABLES of this one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(bucket: int, rows: list) -> Iterator[tuple[int, int, int, bytes]]:
            static, seats, totals = None, None, {}
            for kind, src, data in rows:
                if kind == STATIC:
                    static = _columns(data, np.uint64, np.uint32, np.uint32, np.int64)
                elif kind == SEATS:
                    seats = _columns(data, np.uint32, np.float64, np.uint32)
                else:
                    totals[src] = _columns(data, np.uint32, np.float32)
            if static is None or not len(static[0]):
                return
            names, w, u, count = static
            tables, root = (np.concatenate([totals[b][k] for b in sorted(totals)]).astype(float) for k in range(2))  # words' tasks are ranges of hashes
            t, z, kept = seats if seats is not None else (np.ones(len(w)), np.full(len(w), -np.inf), np.zeros(len(w), np.uint32))
            parent = (root + (STRENGTH + root_discount * sums[0]) * base) / (STRENGTH + sums[1])
            t, z = seat_pairs(count, t, z, (STRENGTH + DISCOUNT * tables)[u] * parent[w], pair_keys(names[w], names[u], sweep))
            if sweep >= SWEEPS - KEPT:
                kept = kept + t
            yield SEATS, bucket, 0, _blob(t.astype(np.uint32), z, kept.astype(np.uint32))
            yield from _tables(bucket, names, w, u, t, n)

        yield from _rows(r for bucket, rows in _by_bucket(batches) for r in found(bucket, rows))
        give_back()

    return exchange(rows, "to", n).mapInArrow(run, ROW_TEXT)


def _seat_words(rows: DataFrame, n: int, sweep: int, sums: tuple[float, float], base: float, root_discount: float) -> DataFrame:
    """FIXED or WORDS, and TABLES: WORDS, the TOTALS for each task that sent tables, and SUMS at the root; the rest as it came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(bucket: int, rows: list) -> Iterator[tuple[int, int, int, bytes]]:
            fixed, tables, state = [], [], None
            for kind, src, data in rows:
                if kind == FIXED:
                    fixed.append(_columns(data, np.uint64, np.int64, np.int64, np.int64))
                elif kind == WORDS:
                    state = _columns(data, *WORD_STATE)
                elif kind == TABLES:
                    tables.append((src, *_columns(data, np.uint64, np.uint32, np.uint32)))
                else:
                    yield kind, bucket, src, data
            if state is None and not fixed:
                return
            if state is None:
                h, at = np.unique(np.concatenate([f[0] for f in fixed]), return_inverse=True)
                total, one_u, one_w = (np.bincount(at, weights=np.concatenate([f[k] for f in fixed]), minlength=len(h)).astype(np.int64) for k in (1, 2, 3))
                kept = [np.zeros((len(h), KEPT), np.int64) for _ in range(3)]
            else:
                h, total, one_u, one_w, root_t, root_z, *kept = state
                kept = [x.reshape(-1, KEPT).copy() for x in kept]
            here, root_c = one_u.astype(float), one_w.astype(float)
            for _, names, as_context, as_dish in tables:
                at = np.searchsorted(h, names)
                here[at] += as_context
                root_c[at] += as_dish
            if state is None:
                root_t, root_z = (root_c > 0).astype(float), np.full(len(h), -np.inf)
            else:
                root_t, root_z = seat_root(root_c, root_t, root_z, (STRENGTH + root_discount * sums[0]) * base, root_discount, word_keys(h, sweep))
            if (k := sweep - (SWEEPS - KEPT)) >= 0:
                for x, now in zip(kept, (here, root_c, root_t), strict=True):
                    x[:, k] = now
            for src, names, _, _ in tables:
                at = np.searchsorted(h, names)
                yield TOTALS, src, bucket, _blob(here[at].astype(np.uint32), (root_c - root_discount * root_t)[at].astype(np.float32))
            yield WORDS, bucket, 0, _blob(h, total, one_u, one_w, root_t.astype(np.int64), root_z, *kept)
            yield SUMS, bucket, 0, _blob(np.array([root_t.sum(), root_c.sum()]))

        yield from _rows(r for bucket, rows in _by_bucket(batches) for r in found(bucket, rows))
        give_back()

    return exchange(rows, "to", n).mapInArrow(run, ROW_TEXT)


def _sums(state: DataFrame) -> tuple[float, float]:
    """Tables and customers at the root; one row a task."""
    found = [_columns(r["data"], np.float64)[0] for r in state.where(F.col("kind") == SUMS).select("data").collect()]
    return tuple(np.sum(found, axis=0).tolist()) if found else (0.0, 0.0)


def _answers(rows: DataFrame, n: int) -> DataFrame:
    """To each block: its pairs' customers and tables (PAIR_ANSWER); its words' counts, tables as a context, and customers and tables at the root (WORD_ANSWER).

    Tables come as a sum over the kept sweeps in the first, in the second as the first kept sweep's and the others' differences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(bucket: int, rows: list) -> Iterator[tuple[int, int, int, bytes]]:
            codes, asked = [], []
            words = [np.zeros(0, t) for t in WORD_STATE]
            count, kept = np.zeros(0, np.int64), np.zeros(0, np.uint32)
            for kind, src, data in rows:
                if kind == CODES:
                    blocks, lengths, code = _columns(data, np.int64, np.int64, np.int32)
                    codes += zip(blocks.tolist(), np.split(code, np.cumsum(lengths)[:-1]), strict=True)
                elif kind == ASKED:
                    asked.append((src, _columns(data, np.uint64)[0]))
                elif kind == STATIC:
                    count = _columns(data, np.uint64, np.uint32, np.uint32, np.int64)[3]
                elif kind == SEATS:
                    kept = _columns(data, np.uint32, np.float64, np.uint32)[2]
                else:
                    words = _columns(data, *WORD_STATE)
            count, kept = np.append(count, [1, 0]), np.append(kept, [KEPT, 0]).astype(np.uint32)  # ONCE and NEVER are the last two
            for block, code in codes:
                yield PAIR_ANSWER, _home(block), block, _blob(np.array([bucket]), count[code], kept[code])
            h, total = words[0], np.append(words[1], 0)
            kept_words = [np.vstack([x.reshape(-1, KEPT), np.zeros((1, KEPT), np.int64)]) for x in words[6:]]
            for x in kept_words:
                x[:, 1:] -= x[:, :1]
                x[:, 1:] = (x[:, 1:] << 1) ^ (x[:, 1:] >> 63)
            for block, names in asked:
                at = np.minimum(np.searchsorted(h, names), max(0, len(h) - 1))
                at = np.where(h[at] == names, at, len(h)) if len(h) else np.zeros(len(names), int)
                yield WORD_ANSWER, _home(block), block, _blob(np.array([bucket]), total[at], *(x[at].T for x in kept_words))

        yield from _rows(r for bucket, rows in _by_bucket(batches) for r in found(bucket, rows))
        give_back()

    return exchange(rows, "to", n).mapInArrow(run, ROW_TEXT)


def score(docs: DataFrame, rest: int = 2, of: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Texts whose crc32(id as text) modulo `of` is not `rest` teach; all are scored (log10 of the text's probability).
    """
    n = buckets_of(docs, BUCKET_BYTES)
    texts = texts_of(docs, id_col, text_col)
    counted = cut(count_words(texts, rest, of, n), "words")
    total = counted.where("word is null").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("all", "distinct", "once", "twice")]).first()
    n_all, vocabulary = int(total["all"]), int(total["distinct"])
    often = np.array([r["word"] for r in counted.where(F.col("word").isNotNull() & (F.col("n") >= SHARE * n_all)).select("word").collect()], np.int64).view(np.uint64)  # 1 / SHARE rows at most
    once, twice = int(total["once"]), int(total["twice"])
    root_discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once and twice else 0.5
    base = 1 / (vocabulary + 1)

    def of_kinds(rows: DataFrame, *kinds: int) -> DataFrame:
        return rows.where(F.col("kind").isin(*kinds))

    pairs = cut(_meet(_blocks(texts, often, rest, of, n, False), n), "pairs")
    free(docs.sparkSession)
    state = cut(_seat_words(of_kinds(pairs, FIXED, TABLES), n, -1, (0.0, 0.0), base, root_discount), "seating")
    sums = [_sums(state)]
    free(docs.sparkSession)
    met, pairs = pairs, cut(of_kinds(pairs, STATIC, CODES, ASKED), "pairs")
    drop(met)
    for sweep in range(SWEEPS):
        seated = _seat_contexts(of_kinds(pairs, STATIC).union(of_kinds(state, TOTALS, SEATS)), n, sweep, sums[-1], base, root_discount)
        last, state = state, cut(_seat_words(seated.union(of_kinds(state, WORDS)), n, sweep, sums[-1], base, root_discount), "seating")
        sums.append(_sums(state))
        del seated
        drop(last)
    answers = _answers(pairs.union(of_kinds(state, SEATS, WORDS)), n)
    root_t, root_n = (np.array(x) for x in zip(*sums[-KEPT:], strict=True))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams, by_pair, by_word = {}, {}, {}
        for kind, _, block, data in _each(batches):
            if kind == STREAM:
                streams[block] = data
            elif kind == PAIR_ANSWER:
                bucket, count, kept = _columns(data, np.int64, np.int64, np.uint32)
                by_pair.setdefault(block, {})[int(bucket[0])] = count - DISCOUNT * kept / KEPT
            else:
                bucket, *found = _columns(data, *[np.int64] * 5)
                by_word.setdefault(block, {})[int(bucket[0])] = found
        for block in list(streams):
            ids, null, size, end, words, at = _columns(streams.pop(block), np.int64, np.uint8, np.int64, np.int64, np.uint64, np.uint32)
            at = at.astype(np.int64)
            found = by_word.pop(block)
            count = np.concatenate([found[b][0] for b in sorted(found)])
            here, root_c, root_tables = (np.hstack([found[b][k].reshape(KEPT, -1) for b in sorted(found)]).T for k in (1, 2, 3))
            for x in (here, root_c, root_tables):
                x[:, 1:] = (x[:, 1:] >> 1) ^ -(x[:, 1:] & 1)
                x[:, 1:] += x[:, :1]
            new_at = (STRENGTH + DISCOUNT * here) / (STRENGTH + count[:, None])
            parent = (root_c - root_discount * root_tables + (STRENGTH + root_discount * root_t) * base) / (STRENGTH + root_n)
            pair, own = np.unique((at.astype(np.uint64) << np.uint64(32)) | _before(at, size, int(end[0])).astype(np.uint64), return_inverse=True)
            w, u, _, order = _deal(words, pair, often, n)
            found = by_pair.pop(block)
            inside = np.concatenate([found[b] for b in sorted(found)])
            if len(inside) != len(pair) or len(count) != len(words):
                raise RuntimeError("the texts were dealt to tasks in another way when they were read again")
            log_p = np.empty(len(pair))
            log_p[order] = np.log10(inside / (STRENGTH + count[u]) + (new_at[u] * parent[w]).mean(axis=1))
            first = np.cumsum(size) - size
            value = np.add.reduceat(log_p[own], first)
            plain = np.add.reduceat(np.log10(count + 1.0)[at], first) - size * np.log10(n_all + vocabulary + 1)
            known = np.add.reduceat((count > 0).astype(np.int64)[at], first)
            null = null.astype(bool)
            out = np.array([not m and zlib.crc32(str(i).encode()) % of == rest for i, m in zip(ids.tolist(), null, strict=True)], bool)
            yield pa.record_batch([pa.array(ids, mask=null), pa.array(out), pa.array(size), pa.array(known), pa.array(np.full(len(ids), n_all)), pa.array(plain), pa.array(value), pa.array(10 ** (-value / size))], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])
        give_back()

    return exchange(_blocks(texts, often, rest, of, n, True).union(answers), "to", n).mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
