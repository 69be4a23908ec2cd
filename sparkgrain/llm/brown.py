"""Brown class-based bigrams: exchange clustering, then smoothed perplexity of every document."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import takewhile
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgrain.llm.common import BROADCAST_ROWS, arrow_map, c, forget, slices, strings, tokens, word_hash, written

CLASSES = 64
#: Exchange goes on until a full round (odd, then even words) raises the log likelihood by less than this share of it;
#: ROUNDS half-rounds are a safety bound, and a warning tells when it is hit.
TOLERANCE, ROUNDS = 1e-4, 100
#: A word is clustered if it is said so often, at every size of the corpus; all others together are one more class.
MIN_COUNT = 2
#: A caller may besides ask for a least share of all tokens; the default asks for none.
MIN_SHARE = 0.0
#: Smoothing mass of a class's transitions, spread as the classes are; count added to each word's emission.
TRANSITION_MASS, EMISSION_ADD = 10.0, 0.5
#: Words, and tokens of them, whose neighbours one task holds (a single word may have more).
WORDS_IN_TASK, TOKENS_IN_TASK = 4096, 4 << 20
#: Pairs that are merged at once.
MERGED_PAIRS = 4 << 20
#: Counts up to which a word's gain from meeting a class is read off a table.
SMALL = 16
#: Times BROADCAST_ROWS words that a mapped file may hold, as no process copies it and classes take a byte a word; words
#: in one part of it.
FILED, FILED_PART = 16, 1 << 16
#: Where a half-round's moves together lower the likelihood, every 2nd, 4th, ... word's are tried, so many times.
TRIES = 8


@dataclass
class Vocabulary:
    """hashes of the clustered words, sorted; their ids (1 the most frequent); counts by id (0: all rare words)."""

    hashes: np.ndarray
    ids: np.ndarray
    counts: np.ndarray
    rare_types: int


@dataclass
class Mapped:
    """The hashes and ids of a Vocabulary in a file that Spark gives every executor: workers map it and share its pages."""

    name: str
    words: int

    @property
    def value(self) -> Vocabulary:
        raw = np.memmap(SparkFiles.get(self.name), np.uint8, "r")
        return Vocabulary(raw[: 8 * self.words].view(np.uint64), raw[8 * self.words :].view(np.int32), np.zeros(0, np.int64), 0)


@dataclass
class Classes:
    """of: the class of each id. Class CLASSES holds the rare words, the next one stands for a text's start."""

    of: np.ndarray
    transitions: np.ndarray
    log_likelihood: float


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        arr = strings(batch.column(0))
        for a, b in slices(arr):
            codes, _, words = tokens(arr.slice(a, b - a))
            k = np.bincount(codes, minlength=len(words)) if len(codes) else np.zeros(len(words), int)
            some = k > 0
            yield pa.RecordBatch.from_arrays([pa.array(word_hash(words)[some].view(np.int64)), pa.array(k[some].astype(np.int64))], ["h", "k"])


def _words(docs: DataFrame, text: str, min_share: float) -> tuple[DataFrame, dict, int]:
    """Counts of all words of all documents as a written table; totals; the least count of a clustered word."""
    every = written(arrow_map(docs.where(c(text).isNotNull()).select(c(text)), _count, "h bigint, k bigint").groupBy("h").agg(F.sum("k").alias("k")), "lm-words")
    total = every.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.count("*").alias("types")).first().asDict()
    least = max(MIN_COUNT, int(np.ceil(total["n"] * min_share)))
    return every, total | {"clustered": every.where(F.col("k") >= least).count()}, least


def _collected(every: DataFrame, total: dict, least: int) -> Vocabulary:
    got = every.where(F.col("k") >= least).toArrow()
    forget(every)
    h, k = (got["h"].to_numpy().view(np.uint64), got["k"].to_numpy()) if got.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((h, -k))] = np.arange(1, len(h) + 1)
    counts = np.zeros(len(h) + 1, np.int64)
    counts[rank] = k
    counts[0] = total["n"] - k.sum()
    order = np.argsort(h)
    return Vocabulary(h[order], rank[order].astype(np.int32), counts, max(1, total["types"] - len(h)))


def _part(group: pa.Table) -> pa.Table:
    h, ids = group["h"].to_numpy().view(np.uint64), group["id"].to_numpy().astype(np.int32)
    order = np.argsort(h)
    return pa.table({"part": group["part"][:1], "blob": pa.array([h[order].tobytes() + ids[order].tobytes()], pa.binary())})


def _filed(every: DataFrame, total: dict, least: int, classes: int) -> tuple[Mapped, Vocabulary]:
    """_collected() for words that are too many to broadcast: ids come from a sort by Spark, counts from how many words
    have each; the driver writes the file part by part. It lies there until Spark ends, as executors come late."""
    words, n = _ranked(every, least, classes), total["clustered"]
    part = F.shiftrightunsigned("h", 63 - max(0, (n // FILED_PART).bit_length())).alias("part")  # in the order of unsigned hashes
    parts = written(words.select("h", "id", part).groupBy("part").applyInArrow(_part, "part bigint, blob binary"), "lm-parts", "none")
    name, folder, at = f"words-{uuid.uuid4().hex}", tempfile.mkdtemp(prefix="sparkgrain-"), 0
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    raw = np.memmap(f"{folder}/{name}", np.uint8, "w+", shape=12 * n)
    for row in parts.orderBy("part").select("blob").toLocalIterator():
        m = len(row.blob) // 12
        raw[8 * at : 8 * (at + m)] = np.frombuffer(row.blob, np.uint8, 8 * m)
        raw[8 * n + 4 * at : 8 * n + 4 * (at + m)] = np.frombuffer(row.blob, np.uint8, 4 * m, 8 * m)
        at += m
    raw.flush()
    every.sparkSession.sparkContext.addFile(f"{folder}/{name}")
    ks = words.groupBy("k").agg(F.count("*").alias("n")).orderBy(F.col("k").desc()).toArrow()
    counts = np.repeat(np.concatenate([[0], ks["k"].to_numpy()]), np.concatenate([[1], ks["n"].to_numpy()]))
    counts[0] = total["n"] - counts.sum()
    forget(words, parts, every)
    return Mapped(name, n), Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int32), counts, max(1, total["types"] - n))


def vocabulary(docs: DataFrame, text: str, min_share: float = MIN_SHARE) -> Vocabulary:
    """Counts of all words of all documents; those frequent enough go to the driver."""
    return _collected(*_words(docs, text, min_share))


def _encode(vocab):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        for batch in batches:
            arr = strings(batch.column(1))
            for a, b in slices(arr):
                codes, offsets, words = tokens(arr.slice(a, b - a))
                h = word_hash(words)
                if len(v.hashes) and len(h):
                    at = np.minimum(np.searchsorted(v.hashes, h), len(v.hashes) - 1)
                    ids = np.where(v.hashes[at] == h, v.ids[at], 0).astype(np.int32)
                else:
                    ids = np.zeros(len(h), np.int32)
                flat = ids[codes] if len(codes) else np.zeros(0, np.int32)
                blob = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer((offsets * 4).astype(np.int64)), pa.py_buffer(flat.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), blob.cast(pa.binary())], ["doc_id", "ids"])

    return job


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ids of a batch, each text's first marked, and row numbers."""
    col = batch.column(batch.schema.get_field_index("ids"))
    col = col.cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    flat = np.frombuffer(col.buffers()[2], np.int32)[offsets[0] // 4 : offsets[-1] // 4] if col.buffers()[2] and offsets[-1] > offsets[0] else np.zeros(0, np.int32)
    n = np.diff(offsets) // 4
    first = np.zeros(len(flat), bool)
    starts = (offsets[:-1] - offsets[0]) // 4
    first[starts[n > 0]] = True
    return flat, first, n


def _before(cls: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    prev = np.empty_like(cls)
    prev[1:] = cls[:-1]
    prev[first] = start
    return prev


def _pairs(told):
    """Neighbours of words with their counts, by word bucket: those before (the start sign is the last id) and after."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of = told.value
        span = len(bucket_of) + 1
        for batch in batches:
            flat, first, _ = _ids(batch)
            if not len(flat):
                continue
            key, n = np.unique(_before(flat.astype(np.int64), first, span - 1) * span + flat, return_counts=True)
            before, word = key // span, key % span
            some = (before > 0) & (before < span - 1)
            for side, at, key, n_ in ((0, word, word * span + before, n), (1, before[some], key[some], n[some])):
                order = np.lexsort((key, bucket_of[at]))
                key, n_, bucket = key[order], n_[order], bucket_of[at][order]
                cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
                rows = [(int(bucket[a]), _packed(key[a:b], n_[a:b])) for a, b in zip(cut[:-1], cut[1:]) if b > a]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([side] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "side", "blob"])

    return job


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    start = np.flatnonzero(np.diff(key, prepend=-1))
    return key[start], np.add.reduceat(n, start) if len(start) else n


def _merged(group: pa.Table) -> pa.Table:
    """One row of a bucket's pairs, each counted once, some MERGED_PAIRS at a time."""
    sides = group["side"].to_pylist()
    blobs = []
    for side in (0, 1):
        held, more = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        for i, s in enumerate(sides):
            if s == side:
                held.append(_unpacked(group["blob"][i].as_py()))
                more += len(held[-1][0])
                if more > MERGED_PAIRS:
                    held, more = [_summed(*map(np.concatenate, zip(*held)))], 0
        blobs.append(_packed(*_summed(*map(np.concatenate, zip(*held)))))
    bucket = group["bucket"][0].as_py()
    return pa.table({"bucket": pa.array([bucket], pa.int32()), "turn": pa.array([bucket % 2], pa.int32()), "before": pa.array(blobs[:1], pa.binary()), "after": pa.array(blobs[1:], pa.binary())})


def _transitions(of, k: int):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sums = of.value, np.zeros(k * k, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                key, n = _unpacked(blob.as_py())
                word, near = np.divmod(key, len(table))
                cell = table[near].astype(np.int64) * k + table[word]
                sums += np.bincount(cell, weights=n, minlength=k * k).astype(np.int64)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["cell", "k"])

    return job


def _changes(held, k: int, levels: range):
    """What moves change in the cells: all of them at level 0, those of every 2nd, 4th, ... word at level 1, 2, ..."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, to = held.value
        change, sums = table != to, np.zeros((len(levels), k * k), np.int64)
        for batch in batches:
            for blob in batch.column(0):
                key, n = _unpacked(blob.as_py())
                word, near = np.divmod(key, len(table))
                goes, comes = change[word], change[near]
                for i, level in enumerate(levels):
                    goes &= (word >> 1) & ((1 << level) - 1) == 0
                    comes &= (near >> 1) & ((1 << level) - 1) == 0
                    some = np.flatnonzero(goes | comes)  # a level's moves are among those of the levels before
                    word, near, n, goes, comes = word[some], near[some], n[some], goes[some], comes[some]
                    was = table[near].astype(np.int64) * k + table[word]
                    now = np.where(comes, to[near], table[near]).astype(np.int64) * k + np.where(goes, to[word], table[word])
                    sums[i] += (np.bincount(now, weights=n, minlength=k * k) - np.bincount(was, weights=n, minlength=k * k)).astype(np.int64)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums.ravel()[at])], ["cell", "k"])

    return job


def _packed(key: np.ndarray, n: np.ndarray) -> bytes:
    raw = np.concatenate([np.diff(key, prepend=0), n]).astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(key).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    m = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(pa.decompress(blob[8:], 16 * m, codec="zstd", asbytes=True), np.uint8).reshape(8, 2 * m).T.copy().view(np.int64).ravel()
    return np.cumsum(raw[:m]), raw[m:]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def gains(left: np.ndarray, right: np.ndarray, twice: np.ndarray, own: np.ndarray, matrix: np.ndarray, classes: int) -> np.ndarray:
    """Change of the bigram classes' log likelihood when a word moves from its own class to each class; 0 for its own.

    left[w, c], right[w, c]: how often class c is before and after w, twice[w]: how often w follows itself. First each
    class's gain counts every cell as if it had no part in the other class; then the four cells in which the old and
    the new class meet are put right. Only the classes that a word really meets are read.
    """
    m = matrix.astype(float)
    out = np.zeros((len(own), classes))
    for met, cells, total in ((right, m.T, m.sum(1)), (left, m, m.sum(0))):
        cells = np.ascontiguousarray(cells[:, :classes])  # by the class met, then by the class joined
        base = _xlogx(cells)
        small = np.concatenate([_xlogx(cells + x) - base for x in range(SMALL + 1)])  # by the count, then as cells
        d = np.count_nonzero(met, axis=1)
        order = np.argsort(-d, kind="stable")
        w, j = np.nonzero(met[order])
        x, o = met[order][w, j].astype(float), own[order]
        mine = np.maximum(cells[j, o[w]] - x, 0)
        stays = np.bincount(w, weights=_xlogx(mine + x) - _xlogx(mine), minlength=len(own))
        code, start, many = np.minimum(x, SMALL).astype(np.int64) * len(cells) + j, np.cumsum(d[order]) - d[order], x > SMALL
        for a in range(0, len(own), 512):  # the words that meet most classes first: the pth class of each, one p at a time
            far = -d[order[a : a + 512]]
            acc = np.zeros((len(far), classes))
            for k in range(-int(far[0])):
                at = start[a : a + np.searchsorted(far, -k)] + k
                rows = small.take(code[at], axis=0)
                if many[at].any():
                    big = at[many[at]]
                    rows[many[at]] = _xlogx(cells[j[big]] + x[big, None]) - base[j[big]]
                acc[: len(at)] += rows
            acc[np.arange(len(far)), o[a : a + 512]] = stays[a : a + 512]
            n = met[order[a : a + 512]].sum(1).astype(float)
            t = np.repeat(total[None, :classes], len(far), axis=0)
            t[np.arange(len(far)), o[a : a + 512]] -= n
            out[order[a : a + 512]] += acc - (_xlogx(t + n[:, None]) - _xlogx(t))
    for a in range(0, len(own), 4096):
        o, i, x = own[a : a + 4096], np.arange(len(own[a : a + 4096])), _xlogx
        r, le, same = right[a : a + 4096, :classes], left[a : a + 4096, :classes], twice[a : a + 4096].astype(float)
        ro, lo, oo = r[i, o].astype(float), le[i, o].astype(float), m[o, o]
        stays = out[a + i, o] - (x(oo) - x(oo - ro) - x(oo - lo) + x(oo - ro - lo + same))
        delta = out[a + i] - stays[:, None]
        # where a word neither meets a class nor follows itself, what is put right cancels out
        w, c_ = np.nonzero((r > 0) | (le > 0) | (same[:, None] > 0))
        r, le, ro, lo, same, ow = r[w, c_].astype(float), le[w, c_].astype(float), ro[w], lo[w], same[w], o[w]
        cc, oc, co = m[c_, c_], m[ow, c_], m[c_, ow]
        delta[w, c_] += x(oc) - x(oc - r) + x(co) - x(co - le) + x(cc) - x(cc + r) - x(cc + le) + x(cc + r + le + same)
        delta[w, c_] += x(oc - r + lo - same) - x(oc + lo) + x(co - le + ro - same) - x(co + ro)
        delta[i, o] = 0.0
        out[a + i] = delta
    return out


def _better(both: np.ndarray, twice: np.ndarray, own: np.ndarray, matrix: np.ndarray, k: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words gain by moving, and the class that each would best be in."""
    g = gains(both[:, :k], both[:, k:], twice, own, matrix, classes)
    to = g.argmax(1)
    return g[np.arange(len(own)), to] > 1e-9, to


def _exchange(of, matrix: np.ndarray, k: int, classes: int):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = of.value
        for batch in batches:
            for before, after in zip(batch.column(0), batch.column(1)):
                (b, nb), (a, na) = _unpacked(before.as_py()), _unpacked(after.as_py())
                (wb, b), (wa, a) = np.divmod(b, len(table)), np.divmod(a, len(table))  # either is in order of words
                words = np.union1d(wb[np.flatnonzero(np.diff(wb, prepend=-1))], wa[np.flatnonzero(np.diff(wa, prepend=-1))])
                ib, ia = np.searchsorted(words, wb), np.searchsorted(words, wa)
                size = len(words) * k
                both = np.concatenate([np.bincount(i * k + table[x], weights=n, minlength=size).reshape(-1, k) for i, x, n in ((ib, b, nb), (ia, a, na))], axis=1)
                own = wb == b
                twice = np.bincount(ib[own], weights=nb[own], minlength=len(words))
                words, both, twice = words[words > 0], both[words > 0], twice[words > 0]
                move, to = _better(both, twice, table[words].astype(np.int64), matrix, k, classes)
                yield pa.RecordBatch.from_arrays([pa.array(words[move].astype(np.int32)), pa.array(to[move].astype(np.int32))], ["word", "cls"])

    return job


def _counts_term(counts: np.ndarray) -> float:
    """What the words' counts give to the likelihood; equal counts of ids that follow each other are taken at once."""
    edge = np.flatnonzero(np.diff(counts, prepend=-1))
    return float((_xlogx(counts[edge].astype(float)) * np.diff(edge, append=len(counts))).sum())


def likelihood(matrix: np.ndarray, counts: np.ndarray, of: np.ndarray) -> float:
    """Log likelihood of the corpus under the classes, without smoothing (rare words as one)."""
    m = matrix.astype(float)
    size = np.bincount(of, weights=counts, minlength=len(matrix))
    return float(_xlogx(m).sum() - _xlogx(m.sum(1)).sum() + _xlogx(counts.astype(float)).sum() - _xlogx(size).sum())


def _settled(state: Any, measured: Callable, proposed: Callable, moved: Callable, rounds: int, tolerance: float) -> tuple[Any, np.ndarray, float]:
    """Half-rounds over odd and even words until a full round gains less than tolerance, relative to the likelihood.

    Words are judged in parallel against the same counts; where their moves together don't raise the likelihood, part
    of them is made, so that it never falls.
    """
    _, matrix, value = next(measured(iter([state]), None, None))
    for _ in range(0, rounds, 2):
        began = value
        for turn in (1, 0):
            moves = proposed(state, matrix, turn)
            tries = (moved(state, moves, 1 << thin) for thin in range(TRIES))
            for to, m, v in measured(takewhile(lambda x: x is not None, tries), state, matrix):
                if v > value:
                    state, matrix, value = to, m, v
                    break
        if value - began <= tolerance * abs(value):
            return state, matrix, value
    if rounds:
        warnings.warn(f"exchange clustering stopped at its bound of {rounds} half-rounds; the last full round still gained {value - began:.6g} on a log likelihood of {value:.6g}", stacklevel=3)
    return state, matrix, value


def cluster(encoded: DataFrame, vocab: Vocabulary, classes: int, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Classes:
    """Exchange clustering: rounds in which the odd, then the even words each go where the likelihood gains most.

    All bigrams are counted once and written by word bucket, both ways; the rounds read these.
    """
    sc, k, size = encoded.sparkSession.sparkContext, classes + 2, len(vocab.counts)
    start = np.concatenate([[classes], np.arange(size - 1) % classes, [k - 1]]).astype(np.min_scalar_type(k - 1))
    load = vocab.counts / TOKENS_IN_TASK
    load += 1 / WORDS_IN_TASK
    load[0] = 0.0
    load = np.cumsum(load, out=load).astype(np.int32) * 2
    load[1::2] += 1
    told, counts_term = sc.broadcast(load), _counts_term(vocab.counts)
    del load
    pairs = written(arrow_map(encoded.select("ids"), _pairs(told), "bucket int, side int, blob binary").groupBy("bucket").applyInArrow(_merged, "bucket int, turn int, before binary, after binary"), "lm-pairs", "none")

    def cells(held, job: Callable, tables: int) -> np.ndarray:
        rows = arrow_map(pairs.select("before"), job, "cell int, k bigint").groupBy("cell").agg(F.sum("k").alias("k")).toArrow()
        held.unpersist()
        m = np.zeros(tables * k * k, np.int64)
        m[rows["cell"].to_numpy()] = rows["k"].to_numpy()
        return m.reshape(tables, k, k)

    def valued(m: np.ndarray) -> float:
        f = m.astype(float)
        return float(_xlogx(f).sum() - _xlogx(f.sum(1)).sum() + counts_term - _xlogx(f.sum(0)).sum())

    def measured(states: Iterator[np.ndarray], base: np.ndarray | None, matrix: np.ndarray | None) -> Iterator[tuple]:
        """All moves alone, as they mostly raise the likelihood; else all parts of them in one pass."""
        if (to := next(states, None)) is None:
            return
        if base is None:
            held = sc.broadcast(to)
            m = cells(held, _transitions(held, k), 1)[0]
            yield to, m, valued(m)
            return
        held = sc.broadcast((base, to))
        m = matrix + cells(held, _changes(held, k, range(1)), 1)[0]
        yield to, m, valued(m)
        if parts := list(states):
            for part, change in zip(parts, cells(held, _changes(held, k, range(1, 1 + len(parts))), len(parts))):
                yield part, matrix + change, valued(matrix + change)

    def proposed(of: np.ndarray, matrix: np.ndarray, turn: int) -> pa.Table:
        held = sc.broadcast(of)
        moves = arrow_map(pairs.where(F.col("turn") == turn).select("before", "after"), _exchange(held, matrix, k, classes), "word int, cls int").toArrow()
        held.unpersist()
        return moves

    def moved(of: np.ndarray, moves: pa.Table, every: int) -> np.ndarray | None:
        word, cls = moves["word"].to_numpy(), moves["cls"].to_numpy()
        some = (word >> 1) % every == 0
        if not some.any():
            return None
        of = of.copy()
        of[word[some]] = cls[some]
        return of

    of, matrix, value = _settled(start, measured, proposed, moved, rounds if size > 1 else 0, tolerance)
    forget(pairs)
    told.unpersist()
    return Classes(of[:size], matrix, value)


def _log_transitions(matrix: np.ndarray) -> np.ndarray:
    m = matrix.astype(float)
    k = len(m)
    to = (m.sum(0) + 1.0) / (m.sum() + k)
    to[k - 1] = 0.0  # nothing goes to a text's start
    to /= to.sum()
    return np.log((m + TRANSITION_MASS * to) / (m.sum(1, keepdims=True) + TRANSITION_MASS) + 1e-300)


def model(vocab: Vocabulary, found: Classes) -> tuple[np.ndarray, np.ndarray]:
    """Log transition probabilities between classes and log emission probabilities of word ids, both smoothed."""
    return _log_transitions(found.transitions), _emissions(found.of, *_emission_parts(vocab, found))


def _emission_parts(vocab: Vocabulary, found: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Counts and how many ids that follow each other have each, classes' sizes, and rare words: few numbers to broadcast."""
    edge = np.flatnonzero(np.diff(vocab.counts, prepend=-1))
    size = found.transitions.sum(0) + EMISSION_ADD * np.bincount(found.of, minlength=len(found.transitions))
    return vocab.counts[edge], np.diff(edge, append=len(vocab.counts)), size, vocab.rare_types


def _emissions(of: np.ndarray, counts: np.ndarray, times: np.ndarray, size: np.ndarray, rare_types: int) -> np.ndarray:
    with np.errstate(divide="ignore"):
        emit = np.repeat(np.log(counts + EMISSION_ADD), times)
        emit -= np.log(size)[of]
    emit[0] = -np.log(rare_types)
    return emit


def _score(held, k: int):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, trans, *parts = held.value
        emit = _emissions(of, *parts)
        for batch in batches:
            flat, first, n = _ids(batch)
            lp = np.zeros(len(n))
            if len(flat):
                cls = of[flat]
                lp = np.bincount(np.repeat(np.arange(len(n)), n), weights=trans[_before(cls, first, k - 1), cls] + emit[flat], minlength=len(n))
            ppl = pa.array(np.exp(-lp / np.maximum(n, 1)), mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(lp), ppl], ["doc_id", "n_tokens", "log_prob", "perplexity"])

    return job


def _said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bigrams of each row by the words' hashes: no word before at a text's start, no word at all in an empty text."""
    for batch in batches:
        arr = strings(batch.column(2))
        for a, b in slices(arr):
            codes, offsets, words = tokens(arr.slice(a, b - a))
            h = word_hash(words).view(np.int64)
            n = np.diff(offsets)
            w = h[codes] if len(codes) else np.zeros(0, np.int64)
            first = np.zeros(len(w), bool)
            first[offsets[:-1][n > 0]] = True
            v, none = _before(w, first, 0), np.flatnonzero(n == 0)
            at = pa.array(np.concatenate([np.repeat(np.arange(len(n)), n), none]) + a)
            pad = np.zeros(len(none), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate([v, pad]), mask=np.concatenate([first, pad == 0])), pa.array(np.concatenate([w, pad]), mask=np.concatenate([np.zeros(len(w), bool), pad == 0]))], ["row", "doc_id", "v", "w"])


def _exchange_rows(matrix: np.ndarray, k: int, classes: int):
    def job(group: pa.Table) -> pa.Table:
        h, at, inv = np.unique(group["h"].to_numpy(), return_index=True, return_inverse=True)
        both = np.bincount(inv * (2 * k) + group["met"].to_numpy(), weights=group["n"].to_numpy(), minlength=len(h) * 2 * k).reshape(len(h), 2 * k)
        twice = np.bincount(inv, weights=group["twice"].to_numpy(), minlength=len(h))
        move, to = _better(both, twice, group["own"].to_numpy()[at].astype(np.int64), matrix, k, classes)
        return pa.table({"h": h[move], "to": to[move].astype(np.int32)})

    return job


def _ranked(every: DataFrame, least: int, classes: int) -> DataFrame:
    """Clustered words with ids by falling count, as _collected gives them, and the classes they start in."""
    sort = every.where(F.col("k") >= least).orderBy(F.col("k").desc(), F.col("h").bitwiseXOR(F.lit(-(2**63))))
    sort = written(sort.withColumn("m", F.monotonically_increasing_id()), "lm-ranks")
    part = F.shiftright("m", 33)
    sizes = sorted(sort.groupBy(part.alias("p")).count().collect())
    before = every.sparkSession.createDataFrame([(p, sum(n for q, n in sizes if q < p)) for p, _ in sizes], "p bigint, past bigint")
    id_ = F.col("past") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    words = written(sort.join(F.broadcast(before), part == F.col("p")).select("h", "k", id_.alias("id"), ((id_ - 1) % classes).cast("int").alias("cls")), "lm-classes")
    forget(sort)
    return words


def _joined(docs: DataFrame, key: str, text: str, classes: int, rounds: int, tolerance: float, every: DataFrame, total: dict, least: int) -> DataFrame:
    """perplexity() where the vocabulary is too large even for a mapped file: words meet their classes in shuffled joins."""
    spark, k = docs.sparkSession, classes + 2
    kind = docs.select(c(key)).schema[0].dataType.simpleString()
    base = written(arrow_map(docs.select(F.monotonically_increasing_id().alias("row"), c(key).alias("doc_id"), c(text).alias("text")), _said, f"row bigint, doc_id {kind}, v bigint, w bigint"), "lm-said")
    pairs = written(base.where(F.col("w").isNotNull()).groupBy("v", "w").agg(F.count("*").alias("n")), "lm-pairs")
    xlogx = every.where(F.col("k") >= least).agg(F.coalesce(F.sum(F.col("k") * F.log("k")), F.lit(0.0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    rare = float(total["n"] - xlogx[1])
    counts_term = xlogx[0] + float(_xlogx(np.array(rare)))
    buckets = max(1, -(-total["clustered"] // WORDS_IN_TASK))

    def told(words: DataFrame) -> DataFrame:
        side = lambda x: words.select(F.col("h").alias(x), F.col("cls").alias(f"c{x}"), F.col("id").alias(f"i{x}"), F.col("k").alias(f"k{x}"))
        got = pairs.join(side("v"), "v", "left").join(side("w"), "w", "left")
        return got.select("v", "w", "n", F.when(F.col("v").isNull(), k - 1).otherwise(F.coalesce("cv", F.lit(classes))).alias("cv"), F.coalesce("cw", F.lit(classes)).alias("cw"), "iv", "iw", "kw")

    def measured(states: Iterator[tuple], *_: Any) -> Iterator[tuple]:
        for state in states:
            m = np.zeros((k, k), np.int64)
            for r in state[1].groupBy("cv", "cw").agg(F.sum("n").alias("n")).collect():
                m[r.cv, r.cw] = r.n
            f = m.astype(float)
            yield state, m, float(_xlogx(f).sum() - _xlogx(f.sum(1)).sum() + counts_term - _xlogx(f.sum(0)).sum())

    def proposed(state: tuple, matrix: np.ndarray, turn: int) -> DataFrame:
        left = state[1].where(F.col("iw") % 2 == turn).select(F.col("w").alias("h"), F.col("cw").alias("own"), F.col("cv").alias("met"), "n", F.when(F.col("v") == F.col("w"), F.col("n")).otherwise(0).alias("twice"))
        right = state[1].where(F.col("iv") % 2 == turn).select(F.col("v").alias("h"), F.col("cv").alias("own"), (F.col("cw") + k).alias("met"), "n", F.lit(0).cast("bigint").alias("twice"))
        met = left.unionByName(right).groupBy("h", "own", "met").agg(F.sum("n").alias("n"), F.sum("twice").alias("twice"))
        return written(met.groupBy(F.pmod("h", F.lit(buckets))).applyInArrow(_exchange_rows(matrix, k, classes), "h bigint, to int"), "lm-moves")

    def moved(state: tuple, moves: DataFrame, every_: int) -> tuple | None:
        some = moves.join(state[0].where(F.shiftright("id", 1) % every_ == 0).select("h"), "h")
        if some.isEmpty():
            return None
        words = written(state[0].join(some, "h", "left").select("h", "k", "id", F.coalesce("to", "cls").alias("cls")), "lm-classes")
        return words, written(told(words), "lm-told")

    words = _ranked(every, least, classes)
    (words, met), matrix, _ = _settled((words, written(told(words), "lm-told")), measured, proposed, moved, rounds, tolerance)
    size = matrix.sum(0).astype(float)
    for r in words.groupBy("cls").count().collect():
        size[r.cls] += EMISSION_ADD * r["count"]
    trans = _log_transitions(matrix)
    cells = spark.createDataFrame([(a, b, float(trans[a, b]), float(np.log(size[b])) if size[b] else 0.0) for a in range(k) for b in range(k)], "cv int, cw int, t double, s double")
    emit = F.when(F.col("kw").isNull(), -float(np.log(max(1, total["types"] - total["clustered"])))).otherwise(F.log(F.col("kw") + EMISSION_ADD) - F.col("s"))
    scored = met.join(F.broadcast(cells), ["cv", "cw"]).select(F.col("v").alias("v_"), F.col("w").alias("w_"), (F.col("t") + emit).alias("lp"))
    got = base.join(scored, F.col("v").eqNullSafe(F.col("v_")) & (F.col("w") == F.col("w_")), "left")
    got = got.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.count("w").alias("n_tokens"), F.coalesce(F.sum("lp"), F.lit(0.0)).alias("log_prob"))
    return got.select("doc_id", "n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.exp(-F.col("log_prob") / F.col("n_tokens"))).alias("perplexity"))


def perplexity(docs: DataFrame, key: str = "doc_id", text: str = "text", classes: int = CLASSES, rounds: int = ROUNDS, min_share: float = MIN_SHARE, tolerance: float = TOLERANCE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Score every document under a class bigram trained on all of them: doc_id, n_tokens, log_prob, perplexity.

    P(w | v) = P(class of w | class of v) P(w | class of w). Words of all documents are counted; those said MIN_COUNT
    times (and, if asked, min_share of all tokens) are clustered by exchange over all their bigrams until a full round
    gains less than tolerance; all rarer ones share a class with equal emissions. Texts are tokenised twice (to count,
    and to write word ids, some 2 bytes a token); the rounds read counted bigrams. A vocabulary of more than
    broadcast_rows words is not broadcast: workers map a file of it, and only a class a word is told to all; beyond
    FILED times as many the same model is made by shuffled joins. log_prob is natural; a text
    starts from a start sign.

    Nulls: a null or empty text, or one of signs alone, has 0 tokens, log_prob 0 and a null perplexity; a null key
    is carried. Repeated rows each count and are each scored. Texts are taken whole. Other columns are not carried,
    so none clash. No rows give no rows.
    """
    sc, k = docs.sparkSession.sparkContext, classes + 2
    every, total, least = _words(docs, text, min_share)
    if total["clustered"] > broadcast_rows * FILED:
        return _joined(docs, key, text, classes, rounds, tolerance, every, total, least)
    if total["clustered"] > broadcast_rows:
        told, vocab = _filed(every, total, least, classes)
    else:
        vocab = _collected(every, total, least)
        told = sc.broadcast(vocab)
    kind = docs.select(c(key)).schema[0].dataType.simpleString()
    encoded = written(arrow_map(docs.select(c(key).alias("doc_id"), c(text).alias("text")), _encode(told), f"doc_id {kind}, ids binary"), "lm-ids")
    if not isinstance(told, Mapped):
        told.unpersist()
    found = cluster(encoded, vocab, classes, rounds, tolerance)
    held = sc.broadcast((found.of, _log_transitions(found.transitions), *_emission_parts(vocab, found)))
    return arrow_map(encoded, _score(held, k), f"doc_id {kind}, n_tokens bigint, log_prob double, perplexity double")
