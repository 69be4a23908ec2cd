"""An exact n-gram Jaccard self-join with adaptive multi-match prefixes, and groups of near copies."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgrain.llm.common import BROADCAST_ROWS, SLICE_BYTES, arrow_map, c, forget, mix, plan_bytes, ship, slices, strings, tokens, word_hash, written

N_GRAM, THRESHOLD = 3, 0.6
#: A prefix asks for at most so many shared tokens.
MOST_MATCHES = 24
#: Work of verifying a candidate, in postings read: so much, and this share of the set's size, as the set travels.
VERIFY_COST, VERIFY_SHARE = 20.0, 0.7
#: An n-gram is frequent when a slice of texts holds it this often and such slices together this often; at most so
#: many are kept, the most frequent. They order tokens and estimate costs; results don't depend on them.
SLICE_DF, HOT_DF, HOT_MOST = 2, 4, 1 << 20
#: Bytes of input behind a token bucket; documents of a block that are verified together; n-gram sets in a task.
BUCKET_BYTES, BLOCK_DOCS, SETS_IN_TASK = 8 << 20, 256, 2000
#: Prefix tokens that a document carries to settle where a pair is proposed: so many frequent ones, or one that isn't.
ANCHORS = 6
#: Tokens travel without so many low bits: 48 are left. In buckets that can only add candidates, which are verified.
CUT = np.uint64(16)
#: A set's key has the upper 40 bits of its fingerprint, and its size in the rest.
SIZE_BITS = 24
#: A set of which half the n-grams occur this often may lie in a crowd of near copies; one of so many documents is asked
#: for such sets, the pivots; a set is of the crowd of its nearest pivot if they are this similar. Results don't depend
#: on them: pairs of one crowd are compared there, all others meet in token buckets.
CROWD, CROWD_SAMPLE, CROWD_NEAR = 64, 8, 0.4
#: Pivots at most, and their n-grams together; sets in a block of a crowd at most, and their n-grams together.
PIVOTS, PIVOT_GRAMS, CROWD_SETS, CROWD_GRAMS = 4096, 1 << 21, 2048, 1 << 22

_P = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


_K = np.arange(MOST_MATCHES)
_LOG_FACTORIAL = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, MOST_MATCHES)))])


@dataclass
class Hot:
    """What the survey of all texts tells the cost estimates.

    Frequent n-grams, sorted by hash, with their counts; how likely any other n-gram of one set and one of another
    are the same; and sets by size: upper sizes and how many sets there are up to each.
    """

    hashes: np.ndarray
    counts: np.ndarray
    chance: float
    sizes: np.ndarray
    upto: np.ndarray
    _plain: dict = field(default_factory=dict)

    def plain(self, n: int, t: float) -> int:
        """Matches that the prefix of a set of n grams asks for if none of them is frequent."""
        if (n, t) not in self._plain:
            need = int(required(n, t))
            base, most = n - need + 1, min(MOST_MATCHES, need)
            costs = base + np.arange(most) + (VERIFY_COST + VERIFY_SHARE * n) * self.by_chance(n, base, t)[:most]
            self._plain[n, t] = int(np.argmin(costs)) + 1
        return self._plain[n, t]

    def by_chance(self, size: int, tokens: int, t: float) -> np.ndarray:
        """How many sets of a fitting size share at least 1, 2, ... prefix tokens by chance alone (Poisson)."""
        if not len(self.sizes):
            return np.zeros(MOST_MATCHES)
        lo, hi = np.interp([size * t, size / t], self.sizes, self.upto)
        rate = self.chance * tokens * tokens
        pmf = np.exp(-rate + _K * np.log(max(rate, 1e-300)) - _LOG_FACTORIAL)
        return max(hi - lo, 0.0) * np.maximum(1 - np.cumsum(pmf), 0.0)


class Crowds:
    """Crowds by their pivots, from 1 on: which a set is of, and which cells its blocks meet in."""

    def __init__(self, pivots: list[np.ndarray], held: list[float]):
        self.pivots, self.size = pivots, np.array([len(g) for g in pivots], np.int64)
        every = np.concatenate([np.zeros(0, np.uint64), *pivots])
        order = np.argsort(every, kind="stable")
        self.owner = np.repeat(np.arange(len(pivots)), self.size)[order]
        self.tokens, n = np.unique(every, return_counts=True)
        self.starts = np.concatenate([[0], np.cumsum(n)])
        block = np.clip(CROWD_GRAMS // np.maximum(self.size, 1), 1, CROWD_SETS)
        self.blocks = np.maximum(1, -(-np.array(held, np.int64) // block)) if pivots else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.blocks**2)])

    def of(self, grams: np.ndarray, count: np.ndarray) -> int:
        """The crowd of a set, 0 if it is of none. count: the known counts of its n-grams."""
        if not len(self.tokens) or np.count_nonzero(count) < CROWD_NEAR * len(grams):
            return 0
        at = np.minimum(np.searchsorted(self.tokens, grams), len(self.tokens) - 1)
        at = at[self.tokens[at] == grams]
        both = np.bincount(self.owner[_spread(self.starts[at], self.starts[at + 1] - self.starts[at])], minlength=len(self.size))
        near = both / (len(grams) + self.size - both)
        best = int(np.argmax(near))
        return best + 1 if near[best] >= CROWD_NEAR else 0

    def block(self, crowd: int, sig: np.ndarray) -> np.ndarray:
        return (mix(sig.view(np.uint64)) % np.uint64(self.blocks[crowd - 1])).astype(np.int64)

    def cells(self, crowd: int, block: int) -> np.ndarray:
        """Numbers of the cells where a block meets the others and itself."""
        k = int(self.blocks[crowd - 1])
        x = np.arange(k)
        return self.first[crowd - 1] + np.minimum(x, block) * k + np.maximum(x, block)

    def meet(self, cell: int) -> tuple[int, int, int]:
        """A cell's crowd and the two blocks that meet there."""
        crowd = int(np.searchsorted(self.first, cell, side="right"))
        return crowd, *divmod(int(cell - self.first[crowd - 1]), int(self.blocks[crowd - 1]))


def _spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The positions lo, lo + 1, ... of each range, n of them."""
    return np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _distinct(x: np.ndarray) -> np.ndarray:
    """The values of an array in order, each once: for few values a sort is quicker than a table."""
    s = np.sort(x)
    keep = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=keep[1:])
    return s[keep]


def gram_sets(arr: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text its distinct word n-grams as sorted 64-bit hashes; shorter texts are one gram, wordless none."""
    codes, offsets, words = tokens(arr)
    h = word_hash(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    many = max(len(h) - n + 1, 0)
    acc = np.zeros(many, np.uint64)
    for j in range(n):
        acc = mix(acc * _P[1] + h[j : j + many] + _P[j % 4])
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a >= n:
            yield _distinct(acc[a : b - n + 1])
        elif b > a:
            x = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for v in h[a:b]:
                    x = mix(np.array([x * _P[2] + v]))[0]
            yield np.array([x], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def fingerprint(grams: np.ndarray) -> int:
    """64 bits that stand for a set."""
    with np.errstate(over="ignore"):
        return int((mix(grams ^ _P[3]).sum(dtype=np.uint64) * _P[0]).astype(np.int64))


def required(size: np.ndarray | int, t: float) -> np.ndarray:
    """Overlap that any partner of a set of this size shares with it: the least integer >= t * size."""
    return np.ceil(np.asarray(size) * t - 1e-9).astype(np.int64)


def adaptive_prefix(grams: np.ndarray, count: np.ndarray, t: float, hot_: Hot) -> tuple[np.ndarray, np.ndarray, int]:
    """Prefix tokens of a set, places in it of the frequent ones that are its anchors, and the matches l asked for.

    Tokens are in one global order, by (known count, hash). The l-prefix is the first |x| - T + l tokens with
    T = ceil(t |x|). If neither set's overlap falls short of its T, then prefixes of matches l and m share at least
    min(l, m) tokens. l has the least estimated cost: postings read for the prefix, plus verification of each
    candidate. Candidates with l matches are estimated by the l-th largest count in the prefix, as texts that share
    a passage share all of it, and by those that sets of a fitting size share by chance.
    """
    n = len(grams)
    need = int(required(n, t))
    base = n - need + 1
    if not count.any():
        pick = hot_.plain(n, t)
        head = grams[: base + pick - 1]
        return head, np.zeros(0, np.int64), pick
    order = np.lexsort((grams, count))
    most = min(MOST_MATCHES, need)
    df = count[order[: base + most - 1]].astype(float)
    pick = 1
    if most > 1:
        read = np.cumsum(np.where(df > 0, df, 1.0))
        found = hot_.by_chance(n, base - np.count_nonzero(df[:base]), t)[:most]
        if df.any():
            found = found + [np.sort(df[: base + m - 1])[-m] if m <= base + m - 1 else 0.0 for m in range(1, most + 1)]
        costs = read[base - 1 : base + most - 1] + (VERIFY_COST + VERIFY_SHARE * n) * found
        pick = int(np.argmin(costs)) + 1
    head = order[: base + pick - 1]
    return grams[head], head[count[head] > 0][:ANCHORS], pick


def _scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.where(c(key).isNotNull() & c(text).isNotNull()).select(c(key).cast("bigint").alias("doc_id"), c(text).alias("text"))


_DOC, _GRAM, _SLICE = 0, 1, 2


def _survey(n: int):
    schema = pa.schema([("doc_id", pa.int64()), ("sig", pa.int64()), ("size", pa.int32()), ("kind", pa.int8())])

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, arr = batch.column(0).to_numpy(), strings(batch.column(1))
            for a, b in slices(arr):
                sigs, sizes, seen, held = [], [], set(), []
                for g in gram_sets(arr.slice(a, b - a), n):
                    s = fingerprint(g)
                    sigs.append(s)
                    sizes.append(len(g))
                    if s not in seen:
                        seen.add(s)
                        held.append(g)
                grams, k = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, int))
                some = k >= SLICE_DF
                m, f = b - a, int(some.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([pa.array(ids[a:b], pa.int64()), pa.nulls(f + 1, pa.int64())]),
                        pa.array(np.concatenate([np.array(sigs, np.int64), grams[some].view(np.int64), [0]]).astype(np.int64)),
                        pa.array(np.concatenate([sizes, k[some], [0]]).astype(np.int32)),
                        pa.array(np.concatenate([np.full(m, _DOC), np.full(f, _GRAM), [_SLICE]]).astype(np.int8)),
                    ],
                    schema=schema,
                )

    return job


def _hot(survey: DataFrame) -> Hot:
    sums = survey.where(F.col("kind") == _GRAM).groupBy("sig").agg(F.sum("size").alias("k"), F.sum(F.col("size").cast("double") * (F.col("size") - 1)).alias("pairs"))
    rare = sums.where(F.col("k") < HOT_DF).agg(F.sum("pairs")).first()[0] or 0.0
    each = survey.agg(F.sum(F.when(F.col("kind") == _DOC, F.col("size")).cast("double")).alias("n"), F.count_if(F.col("kind") == _SLICE).alias("slices")).first()
    rows = sums.where(F.col("k") >= HOT_DF).orderBy(F.desc("k"), "sig").limit(HOT_MOST).select("sig", "k").toArrow()
    h, k = rows["sig"].to_numpy().view(np.uint64) if rows.num_rows else np.zeros(0, np.uint64), rows["k"].to_numpy()
    order = np.argsort(h)
    each_n = float(each["n"] or 0)
    step = F.ceil(F.log2("size") * 8)
    sizes = survey.where((F.col("kind") == _DOC) & (F.col("size") > 0)).groupBy(step.alias("s")).agg(F.count("*").alias("k")).orderBy("s").toPandas()
    # pairs inside a slice stand for as many times more across slices as there are slices
    chance = rare * each["slices"] / each_n**2 if each_n else 0.0
    return Hot(h[order], k[order].astype(np.int64), chance, 2 ** (sizes["s"].to_numpy(float) / 8), sizes["k"].cumsum().to_numpy(float))


def _known(grams: np.ndarray, hot: Hot) -> tuple[np.ndarray, np.ndarray]:
    """Known counts of n-grams, 0 if they aren't frequent, and their numbers among the frequent ones."""
    if not len(hot.hashes):
        return np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)
    at = np.minimum(np.searchsorted(hot.hashes, grams), len(hot.hashes) - 1)
    return np.where(hot.hashes[at] == grams, hot.counts[at], 0), at


def _pivots(n: int, hot):
    """Rows of sets that lie in crowds: of those with one label, the least changed. Most copies of a text share it."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arr = strings(batch.column(0))
            for a, b in slices(arr):
                best: dict[int, tuple[float, np.ndarray]] = {}
                for g in gram_sets(arr.slice(a, b - a), n):
                    count, _ = _known(g, hot.value)
                    if 2 * np.count_nonzero(count >= CROWD) <= len(g):
                        continue
                    label, score = int(g[2 * count >= np.median(count)][0].astype(np.int64)), float(count.mean())
                    if label not in best or score > best[label][0]:
                        best[label] = score, g
                sets = [g for _, g in best.values()]
                columns = [pa.array(list(best), pa.int64()), pa.array([x for x, _ in best.values()], pa.float64()), pa.array([len(g) for g in sets], pa.int32()), pa.array([g.tobytes() for g in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["label", "score", "size", "grams"])

    return job


def _crowds(scan: DataFrame, n: int, hot) -> Crowds:
    """The crowds of a table, those with the most sets first, as far as their pivots' bounds go."""
    if not (hot.value.counts >= CROWD).any():
        return Crowds([], [])
    some = scan.where(F.pmod(F.xxhash64("doc_id"), F.lit(CROWD_SAMPLE)) == 0).select("text")
    found = arrow_map(some, _pivots(n, hot), "label bigint, score double, size int, grams binary")
    best = written(found.groupBy("label").agg(F.max(F.struct("score", "size", "grams")).alias("p")).select("label", "p.*"), "dup-pivots")
    top = best.orderBy(F.desc("score"), "label").limit(PIVOTS).select("label", "size").toArrow()
    labels = top["label"].to_numpy()[np.cumsum(top["size"].to_numpy()) <= PIVOT_GRAMS].tolist()
    got = best.where(F.col("label").isin(labels)).orderBy(F.desc("score"), "label").select("grams").toArrow()
    forget(best)
    pivots: list[np.ndarray] = []
    have: dict[int, list[int]] = {}
    for blob in got["grams"]:
        g = np.frombuffer(blob.as_py(), np.uint64)
        near = Counter(i for x in g.tolist() for i in have.get(x, ()))
        if all(k < CROWD_NEAR * (len(g) + len(pivots[i]) - k) for i, k in near.items()):
            for x in g.tolist():
                have.setdefault(x, []).append(len(pivots))
            pivots.append(g)
    return Crowds(pivots, [1.1 * np.quantile(_known(g, hot.value)[0], 0.75) for g in pivots])


def _key(sig: int, size: int) -> int:
    """What stands for a set in the buckets: sets that share a key are only told apart when they are verified."""
    most = (1 << SIZE_BITS) - 1
    return sig & ~most | min(size, most)


_KEY = f"sig & {~((1 << SIZE_BITS) - 1)}L | least(size, {(1 << SIZE_BITS) - 1})"


def _postings(n: int, t: float, hot, crowds, buckets: int):
    """Rows (bucket, blob): a slice's prefix tokens for one bucket, and the nodes that they are of.

    Buckets from `buckets` on are cells of crowds: their blobs are sets of a block.
    """

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, arr = batch.column(0).to_numpy(), strings(batch.column(1))
            for a, b in slices(arr):
                nodes, toks, lens, seen, crowded = [], [], [], set(), {}
                for doc, g in zip(ids[a:b], gram_sets(arr.slice(a, b - a), n)):
                    s = fingerprint(g)
                    if s in crowded:
                        crowded[s][2].append(doc)
                    if not len(g) or s in seen:
                        continue
                    seen.add(s)
                    count, at = _known(g, hot.value)
                    if crowd := crowds.value.of(g, count):
                        crowded[s] = crowd, g, [doc]
                    head, anchors, pick = adaptive_prefix(g, count, t, hot.value)
                    rare = 0 if len(anchors) else int(head[0] >> CUT)
                    nodes.append((_key(s, len(g)), pick, crowd, rare, (*(at[anchors] + 1).tolist(), *[0] * (ANCHORS - len(anchors)))))
                    toks.append(head)
                    lens.append(len(head))
                if not nodes:
                    continue
                tok, own = np.concatenate(toks), np.repeat(np.arange(len(nodes)), lens)
                node = np.array(nodes, _NODE)
                order = np.argsort(tok, kind="stable")  # buckets are ranges of tokens, so this orders them too
                tok, own = tok[order], own[order]
                bucket = ((tok >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                edge = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(tok)]])
                at, blobs = bucket[edge[:-1]].astype(np.int64), []
                for x, y in zip(edge[:-1], edge[1:]):
                    local, idx = np.unique(own[x:y], return_inverse=True)
                    blobs.append(_packed(_steps(tok[x:y] >> CUT), idx.astype(np.uint32), *(node[local][f] for f in _NODE.names)))
                for cells, blob in _blocks(crowded, crowds.value):
                    at = np.concatenate([at, buckets + cells])
                    blobs += [blob] * len(cells)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return job


def _blocks(crowded: dict[int, tuple[int, np.ndarray, list[int]]], crowds: Crowds) -> Iterator[tuple[np.ndarray, bytes]]:
    """A slice's sets by crowd and block: the cells they go to, and which of the pivot's n-grams they have, others, and ids."""
    by: dict[tuple[int, int], list[int]] = {}
    for s, (crowd, _, _) in crowded.items():
        by.setdefault((crowd, int(crowds.block(crowd, np.array([s], np.int64))[0])), []).append(s)
    for (crowd, block), sigs in by.items():
        pivot = crowds.pivots[crowd - 1]
        sets, docs = [crowded[s][1] for s in sigs], [crowded[s][2] for s in sigs]
        bits = np.concatenate([np.packbits(np.isin(pivot, g, assume_unique=True)) for g in sets])
        rest = [np.setdiff1d(g, pivot, assume_unique=True) for g in sets]
        size, more, held = (np.array([len(x) for x in xs], np.int32) for xs in (sets, rest, docs))
        yield crowds.cells(crowd, block), _packed(np.array(sigs, np.int64), size, bits, more, np.concatenate(rest), held, np.concatenate(docs).astype(np.int64))


_U64, _U32 = np.dtype(np.uint64), np.dtype(np.uint32)
_CELL = tuple(np.dtype(x) for x in (np.int64, np.int32, np.uint8, np.int32, np.uint64, np.int32, np.int64))
#: crowd: the set's, 0 if none. hot: numbers (from 1) of a set's anchors among the frequent n-grams; rare: its anchor where none is frequent.
_NODE = np.dtype([("key", np.int64), ("need", np.uint8), ("crowd", np.uint16), ("rare", np.uint64), ("hot", np.uint32, (ANCHORS,))])


def _steps(x: np.ndarray) -> np.ndarray:
    """A sorted array as its first value and the steps to the next ones."""
    return np.diff(x, prepend=np.uint64(0)).astype(np.uint64)


def _packed(*columns: np.ndarray) -> bytes:
    """Arrays in one blob, byte planes one after another, so that small steps and repeated bytes pack well."""
    raw = b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes() for x in columns)
    sizes = np.array([len(raw), *(len(x) for x in columns)], np.int32).tobytes()
    return sizes + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes, *kinds: np.dtype) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, np.int32, len(kinds) + 1)
    raw, at, out = np.frombuffer(pa.decompress(blob[sizes.nbytes :], int(sizes[0]), codec="zstd", asbytes=True), np.uint8), 0, []
    for n, kind in zip(sizes[1:], kinds):
        whole = kind.itemsize * int(n)
        flat = raw[at : at + whole].reshape(kind.base.itemsize, -1).T.copy().view(kind.base).ravel()
        out.append(flat.reshape(int(n), *kind.shape))
        at += whole
    return out


def _pairs_of_runs(starts: np.ndarray, ends: np.ndarray, crowd: np.ndarray, most: int = 250_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i < j) of all pairs inside each run, in pieces, without pairs of one crowd. Runs are in order of crowds."""
    # a row of work is one position with all later ones of its run, or all of later crowds
    row = np.concatenate([np.arange(a, b - 1) for a, b in zip(starts, ends)]) if len(starts) else np.zeros(0, int)
    end = np.repeat(ends, ends - starts - 1)
    edge = np.flatnonzero(np.concatenate([crowd[1:] != crowd[:-1], [True]])) + 1
    low = np.where(crowd[row] > 0, np.minimum(edge[np.searchsorted(edge, row, side="right")], end), row + 1) if len(row) else row
    todo = end - low
    row, low, todo = row[todo > 0], low[todo > 0], todo[todo > 0]
    cum = np.cumsum(todo)
    at = 0
    while at < len(row):
        upto = max(at + 1, int(np.searchsorted(cum, (cum[at - 1] if at else 0) + most, side="right")))
        k = todo[at:upto]
        yield np.repeat(row[at:upto], k), _spread(low[at:upto], k)
        at = upto


#: met: shared tokens and those asked for, or what else a row is: the links of a set in a cell of its crowd, or a pair.
_FOUND = "a bigint, sa int, b bigint, sb int, met int, near bigint, jaccard double"
_NEAR, _PAIR = -1, -2


def _rows(a, sa=0, b=0, sb=0, met=0, near=0, jaccard=0.0) -> pa.Table:
    return pa.table({k: np.broadcast_to(np.asarray(x, kind), len(a)) for k, x, kind in (("a", a, np.int64), ("sa", sa, np.int32), ("b", b, np.int64), ("sb", sb, np.int32), ("met", met, np.int32), ("near", near, np.int64), ("jaccard", jaccard, np.float64))})


def _cell(blobs: pa.ChunkedArray, cell: int, crowds: Crowds, t: float, every: bool, strip: int = 1024, wide: int = 512) -> pa.Table:
    """Compare the sets of two blocks of a crowd, each with each.

    Gives all pairs that reach t if every, else what is read of them: for each set how many ids its partners have here,
    and pairs that hold together what all of them hold together.
    """
    crowd, x, y = crowds.meet(cell)
    sig, size, bits, more, rest, held, ids = (np.concatenate(z) for z in zip(*(_unpacked(blob.as_py(), *_CELL) for blob in blobs)))
    width = len(crowds.pivots[crowd - 1])
    # a set may come from several slices
    order = np.lexsort((size, sig))
    new = np.concatenate([[True], (sig[order][1:] != sig[order][:-1]) | (size[order][1:] != size[order][:-1])])
    to = np.empty(len(sig), np.int64)
    to[order] = np.cumsum(new) - 1
    one = order[new]
    who = np.repeat(to, held)
    by = np.lexsort((ids, who))
    once = np.concatenate([[True], (who[by][1:] != who[by][:-1]) | (ids[by][1:] != ids[by][:-1])])
    held = np.bincount(who[by][once], minlength=len(one)).astype(float)
    own = np.repeat(np.arange(len(one)), more[one])
    rest = rest[_spread((np.cumsum(more) - more)[one], more[one])]
    sig, size, bits = sig[one], size[one].astype(np.int64), np.unpackbits(bits.reshape(len(to), -1)[one], axis=1, count=width)
    block = crowds.block(crowd, sig)
    left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
    if not len(left) or not len(right):
        return _rows(sig[:0])
    names, tok = np.unique(rest, return_inverse=True)
    place = np.full(len(one), -1)
    place[right] = np.arange(len(right))
    there = place[own] >= 0
    order = np.argsort(tok[there], kind="stable")
    at, df = place[own[there]][order], np.bincount(tok[there], minlength=len(names))
    ahead = np.cumsum(df) - df
    # n-grams beside the pivot's that many sets have are columns too, others are counted one by one
    column = np.cumsum(dense := df * 16 >= len(right)) - 1
    many = int(dense.sum())
    near, label, out = np.zeros(len(one)), np.arange(len(one)), []
    for top in range(0, len(left), strip):
        mine = left[top : top + strip]
        row = np.full(len(one), -1)
        row[mine] = np.arange(len(mine))
        both = np.zeros((len(mine), len(right)), np.float32)  # sums of at most `wide` ones are exact, as are sets below 2^24
        for z in range(0, width, wide):
            both += bits[mine, z : z + wide].astype(np.float32) @ bits[right, z : z + wide].astype(np.float32).T
        for z in range(0, many, wide):
            part = dense[tok] & (column[tok] >= z) & (column[tok] < z + wide)
            sides = []
            for pos, k in ((row, len(mine)), (place, len(right))):
                sides.append(np.zeros((k, wide), np.float32))
                e = part & (pos[own] >= 0)
                sides[-1][pos[own[e]], column[tok[e]] - z] = 1
            both += sides[0] @ sides[1].T
        few = np.flatnonzero((row[own] >= 0) & ~dense[tok] & (df[tok] > 0))
        cum = np.cumsum(df[tok[few]])
        for part in np.split(few, np.searchsorted(cum, np.arange(1 << 20, cum[-1] if len(cum) else 0, 1 << 20))):
            k = df[tok[part]]
            np.add.at(both.reshape(-1), np.repeat(row[own[part]], k) * len(right) + at[_spread(ahead[tok[part]], k)], 1)
        union = size[mine][:, None] + size[right][None, :] - both.astype(np.float64)
        ok = both >= t * union - 1e-9
        if x == y:
            ok[np.arange(len(mine)), place[mine]] = False
        if every:
            i, j = np.nonzero(ok & (place[mine][:, None] < np.arange(len(right))) if x == y else ok)
            out.append(_rows(sig[mine[i]], size[mine[i]], sig[right[j]], size[right[j]], _PAIR, 0, both[i, j] / union[i, j]))
            continue
        near[mine] += ok @ held[right]
        if x != y:
            near[right] += held[mine] @ ok
        for i, links in zip(mine, ok):
            found = right[links]
            away = found[label[found] != label[i]]
            if len(away):
                heads, first = np.unique(label[away], return_index=True)
                out.append(_rows(np.full(len(first), sig[i]), size[i], sig[away[first]], size[away[first]], _PAIR))
                label[np.isin(label, heads)] = label[i]
    some = np.flatnonzero(near)
    return pa.concat_tables([*out, _rows(sig[some], size[some], met=_NEAR, near=near[some])])


def _propose(t: float, hot, crowds, buckets: int, every: bool):
    """Pairs of a bucket that share a prefix token: their shared tokens here, and how many are asked for; and _cell().

    Pairs of one crowd are left to its cells. Another pair with as many common anchors as it needs matches is settled, and proposed only where the least of them
    is: near copies with a hundred common prefix tokens don't come from every bucket. Others are counted.
    """

    def job(group: pa.Table) -> pa.Table:
        if (bucket := group["bucket"][0].as_py()) >= buckets:
            return _cell(group["blob"], bucket - buckets, crowds.value, t, every)
        nodes, toks, owners, base = [], [], [], 0
        for blob in group["blob"]:
            steps, idx, *cols = _unpacked(blob.as_py(), _U64, _U32, *(_NODE[f] for f in _NODE.names))
            node = np.empty(len(cols[0]), _NODE)
            for f, x in zip(_NODE.names, cols):
                node[f] = x
            toks.append(np.cumsum(steps, dtype=np.uint64))
            owners.append((idx + np.uint32(base)).astype(np.uint32))
            base += len(node)
            nodes.append(node)
        node, key, own = np.concatenate(nodes), np.concatenate(toks), np.concatenate(owners)
        del nodes, toks, owners, cols
        order = np.lexsort((node["need"], node["rare"], node["key"]))
        s = node[order]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        to = np.empty(len(node), np.uint32)
        to[order] = np.cumsum(new) - 1
        node, own = s[new], to[own]
        del s, to, order
        order = np.lexsort((own, node["crowd"][own], key))
        key, own = key[order], own[order]
        once = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
        key, own = key[once], own[once]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        starts, ends = edge[:-1], edge[1:]
        long = ends - starts > 1
        size, need, rare, known = node["key"] & ((1 << SIZE_BITS) - 1), node["need"], node["rare"], node["hot"]
        none = np.iinfo(np.uint64).max
        token = np.concatenate([[none], hot.value.hashes >> CUT])
        once_, many_ = [], []
        for i, j in _pairs_of_runs(starts[long], ends[long], node["crowd"][own]):
            a, b = own[i], own[j]
            fits = np.minimum(size[a], size[b]) >= required(np.maximum(size[a], size[b]), t)
            i, a, b = i[fits], a[fits], b[fits]
            m = np.minimum(need[a], need[b])
            met = (rare[a] == rare[b]) & (rare[a] > 0)
            first, common = np.where(met, rare[a], none), met.astype(np.uint8)
            both = np.flatnonzero((known[a, 0] > 0) & (known[b, 0] > 0))
            if len(both):
                ka, kb = known[a[both]], known[b[both]]
                least, met = np.zeros(len(both), np.uint32), np.zeros(len(both), np.uint8)
                for x in range(ANCHORS):
                    va = ka[:, x]
                    hit = (va[:, None] == kb).any(1) & (va > 0)
                    met += hit
                    least = np.where(hit & ((va < least) | (least == 0)), va, least)  # hashes, so numbers, are in order
                common[both] += met
                first[both] = np.minimum(first[both], token[least])
            settled = common >= m
            code = a.astype(np.int64) * len(node) + b
            once_.append(np.unique(code[settled & (first == key[i])]))
            many_.append(code[~settled])
        one = np.unique(np.concatenate(once_)) if once_ else np.zeros(0, np.int64)
        rest, k = np.unique(np.concatenate(many_), return_counts=True) if many_ else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        code, k = np.concatenate([one, rest]), np.concatenate([np.full(len(one), MOST_MATCHES), k])
        a, b = code // max(len(node), 1), code % max(len(node), 1)
        asked = np.minimum(need[a], need[b]).astype(np.int32)
        return _rows(node["key"][a], b=node["key"][b], met=k.astype(np.int32) << 8 | asked)

    return job


def _texts(wanted):
    """Rows (grp, blob) of the texts that candidates need, packed by group. wanted: sorted ids and their groups."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, groups = wanted.value
        for batch in batches:
            own = batch.column(0).to_numpy()
            lo, hi = np.searchsorted(ids, own), np.searchsorted(ids, own, side="right")
            n = hi - lo
            yield from _grouped(groups[_spread(lo, n)], np.repeat(np.arange(len(own)), n), batch.column(1))

    return job


def _texts_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for rows that already carry their groups: (text, groups)."""
    for batch in batches:
        groups = batch.column(1)
        yield from _grouped(groups.flatten().to_numpy(), np.repeat(np.arange(len(groups)), np.diff(groups.offsets.to_numpy())), batch.column(0))


def _grouped(grp: np.ndarray, row: np.ndarray, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    order = np.argsort(grp, kind="stable")
    grp, row = grp[order], row[order]
    arr = strings(texts)
    edge = np.concatenate([[0], np.flatnonzero(np.diff(grp)) + 1, [len(grp)]]) if len(grp) else np.zeros(1, int)
    at, blobs, held = [], [], 0
    for x, y in zip(edge[:-1], edge[1:]):
        part = arr.take(pa.array(np.unique(row[x:y])))
        for a, b in slices(part):
            at.append(int(grp[x]))
            blobs.append(_squeezed(part.slice(a, b - a)))
            held += len(blobs[-1])
        if held > SLICE_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(blobs, pa.binary())], ["grp", "blob"])
            at, blobs, held = [], [], 0
    if at:
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(blobs, pa.binary())], ["grp", "blob"])


def _squeezed(arr: pa.Array) -> bytes:
    body = "".join(arr.to_pylist()).encode()
    size = pc.binary_length(arr).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.array([len(size), len(body)], np.int64).tobytes() + pa.compress(size.tobytes() + body, codec="zstd", asbytes=True)


def _loosened(blob: bytes) -> pa.Array:
    n, body = (int(x) for x in np.frombuffer(blob, np.int64, 2))
    raw = pa.decompress(blob[16:], 8 * n + body, codec="zstd", asbytes=True)
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.int64, n))])
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw[8 * n :]))


def _verify(n: int, t: float):
    def job(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        cols = {x: pairs[x].to_numpy() for x in "ab"}
        wanted, of, sigs, sets = {*cols["a"].tolist(), *cols["b"].tolist()}, {}, [], []
        held = pa.concat_arrays([_loosened(blob.as_py()) for blob in texts["blob"]]) if texts.num_rows else pa.array([], pa.large_string())
        for x, y in slices(held):
            for g in gram_sets(held.slice(x, y - x), n):
                s = fingerprint(g)
                if (k := _key(s, len(g))) in wanted and all(sigs[i] != s for i in of.get(k, ())):
                    of.setdefault(k, []).append(len(sets))
                    sigs.append(s)
                    sets.append(g)
        sig, size = np.array(sigs, np.int64), np.array([len(g) for g in sets], np.int64)
        names, ids = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
        parts, marked = np.split(ids.astype(np.int32), np.cumsum(size)[:-1]), np.zeros(len(names), np.int32)
        out: list[tuple[np.ndarray, ...]] = []
        order = np.lexsort((cols["b"], cols["a"]))
        a, b = cols["a"][order], cols["b"][order].tolist()
        edge = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]])) if len(a) else np.zeros(1, int)
        for x, y in zip(edge[:-1], edge[1:]):
            key = int(a[x])
            for i in of[key]:
                near = np.array([j for k in b[x:y] for j in of[k] if k != key or sigs[i] < sigs[j]], np.int64)
                if not len(near):
                    continue
                marked[parts[i]] = 1
                both = np.add.reduceat(marked[np.concatenate([parts[j] for j in near])], np.cumsum(size[near]) - size[near])
                marked[parts[i]] = 0
                union = size[i] + size[near] - both
                ok = both >= t * union - 1e-9
                m = int(ok.sum())
                out.append((np.full(m, sig[i]), np.full(m, size[i]), sig[near][ok], size[near][ok], (both / union)[ok]))
        cat = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 4 + [np.zeros(0)]
        return pa.table({"a": cat[0], "sa": cat[1].astype(np.int32), "b": cat[2], "sb": cat[3].astype(np.int32), "jaccard": cat[4]})

    return job


@dataclass
class Joined:
    """members: (doc_id, sig, size) of every text with words; pairs: (a, sa, b, sb, jaccard) of distinct sets.

    Pairs inside a crowd are counted instead of listed, unless every pair was asked for: near: (a, sa, near), how many
    ids the partners of a set in its crowd have, in parts; ties: (a, sa, b, sb), so many of its links as hold it together.
    """

    members: DataFrame
    pairs: DataFrame
    near: DataFrame
    ties: DataFrame


def join_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N_GRAM, t: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS, every: bool = False) -> Joined:
    """The join over distinct n-gram sets; see similar_pairs() and, for every, Joined."""
    spark = docs.sparkSession
    ship(spark)
    scan = _scan(docs, key, text)
    survey = written(arrow_map(scan, _survey(n), "doc_id bigint, sig bigint, size int, kind tinyint"), "dup-survey")
    members = survey.where((F.col("kind") == _DOC) & (F.col("size") > 0)).select("doc_id", "sig", "size").distinct()
    hot = spark.sparkContext.broadcast(_hot(survey))  # HOT_MOST bounds it
    held = plan_bytes(docs)
    buckets = max(1, -(-held // BUCKET_BYTES)) if held < 1 << 60 else int(spark.conf.get("spark.sql.shuffle.partitions"))
    crowds = spark.sparkContext.broadcast(_crowds(scan, n, hot))  # PIVOTS and PIVOT_GRAMS bound it
    posted = arrow_map(scan, _postings(n, t, hot, crowds, buckets), "bucket bigint, blob binary")
    found = written(posted.groupBy("bucket").applyInArrow(_propose(t, hot, crowds, buckets, every), _FOUND), "dup-found")
    met = F.sum(F.shiftright("met", 8))
    cand = found.where("met > 0").groupBy("a", "b").agg(met.alias("k"), F.max(F.col("met").bitwiseAND(F.lit(255))).alias("need")).where(F.col("k") >= F.col("need")).select("a", "b")
    cand = written(cand, "dup-candidates")

    # candidates of one neighbourhood are verified in one place: each text goes there once, not once a pair
    ends = cand.select(F.col("a").alias("x"), F.col("b").alias("y")).unionAll(cand.select(F.col("b"), F.col("a")))
    label = ends.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("label"))
    blocks = cand.join(label.withColumnsRenamed({"x": "a", "label": "la"}), "a").join(label.withColumnsRenamed({"x": "b", "label": "lb"}), "b")
    blocks = written(blocks.select("a", "b", F.least("la", "lb").alias("block")), "dup-blocks")
    sizes = blocks.groupBy("block").agg(F.ceil(F.sqrt(2.0 * F.count("*")) / BLOCK_DOCS).cast("int").alias("k"))
    cell = [F.pmod(F.xxhash64(x), F.col("k")) for x in ("a", "b")]
    tasks = max(1, -(-(2 * cand.count()) // (SETS_IN_TASK * 8)))
    cells = blocks.join(sizes, "block").withColumn("cell", F.xxhash64("block", F.least(*cell), F.greatest(*cell)))
    cells = written(cells.select("a", "b", F.pmod("cell", F.lit(tasks)).alias("grp")), "dup-cells")
    forget(cand)
    forget(blocks)
    reps = members.groupBy("sig", "size").agg(F.min("doc_id").alias("doc_id")).select(F.expr(_KEY).alias("key"), "doc_id")
    ends = cells.select("grp", F.explode(F.array("a", "b")).alias("key")).distinct()
    want = written(ends.join(reps, "key").select("doc_id", "grp").distinct(), "dup-wanted")
    if want.count() <= broadcast_rows:
        w = want.toArrow()
        order = np.argsort(w["doc_id"].to_numpy(), kind="stable") if w.num_rows else np.zeros(0, int)
        told = spark.sparkContext.broadcast(tuple(w[x].to_numpy()[order] for x in ("doc_id", "grp")))
        texts = arrow_map(scan, _texts(told), "grp bigint, blob binary")
    else:
        by = want.groupBy("doc_id").agg(F.collect_list("grp").alias("groups"))
        texts = arrow_map(scan.join(by, "doc_id").select("text", "groups"), _texts_joined, "grp bigint, blob binary")
    pairs = written(cells.groupBy("grp").cogroup(texts.groupBy("grp")).applyInArrow(_verify(n, t), "a bigint, sa int, b bigint, sb int, jaccard double"), "dup-pairs")
    for done in (cells, want):
        forget(done)
    near, ties = (found.where(F.col("met") == k) for k in (_NEAR, _PAIR))
    if every:
        pairs = pairs.unionAll(ties.select(*pairs.columns))
    return Joined(members, pairs, near.select("a", "sa", "near"), ties.select("a", "sa", "b", "sb"))


def _rep_pairs(j: Joined) -> tuple[DataFrame, DataFrame]:
    """(sig, size, rep, held): each set's lowest id and how many ids have it; and pairs and ties of different sets by these ids."""
    reps = j.members.groupBy("sig", "size").agg(F.min("doc_id").alias("rep"), F.count("*").alias("held"))
    ra, rb = (reps.select(F.col("sig").alias(x), F.col("size").alias(f"s{x}"), F.col("rep").alias(f"r{x}")) for x in "ab")
    across = j.pairs.unionByName(j.ties, allowMissingColumns=True).join(ra, ["a", "sa"]).join(rb, ["b", "sb"])
    return reps, across.select(F.least("ra", "rb").alias("doc_id_a"), F.greatest("ra", "rb").alias("doc_id_b"), "jaccard")


def similar_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N_GRAM, t: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Documents whose sets of word n-grams have a Jaccard similarity of at least t: doc_id_a < doc_id_b, jaccard.

    Documents with one and the same set are represented by their lowest id: all pairs of representatives that reach
    t are listed, and each other member with its representative at 1.0; the pairs of members of two sets follow from
    these. That keeps thousands of copies from giving millions of rows.

    Two passes over the texts: one for set fingerprints and n-grams that are frequent, one for prefix tokens by
    token bucket, packed, and their nodes; a third picks the texts that candidates name, which travel compressed to be
    verified. Tokens and sets stand as hashes: n-grams of 64 bits are the same if their hashes are, a set goes by its
    size and a 64-bit fingerprint. Two different similar sets are taken for one in the buckets, and so missed, if
    40 bits of their fingerprints, their sizes and their anchors agree: odds below 2^-40 a pair.

    Defined cases: ids are integers; rows with a null id or text, or with no word, take part in no pair. A text
    shorter than n words is one gram, so it pairs with its equals. Repeated rows count once; an id on rows with
    different texts stands for each, and is not paired with itself. Very long texts are taken whole. Ties don't
    arise, and other columns are not carried. No rows give no rows.
    """
    j = join_sets(docs, key, text, n, t, broadcast_rows, every=True)
    reps, across = _rep_pairs(j)
    copies = j.members.join(reps, ["sig", "size"]).select(F.col("rep").alias("doc_id_a"), F.col("doc_id").alias("doc_id_b"), F.lit(1.0).alias("jaccard"))
    return across.unionAll(copies).where("doc_id_a < doc_id_b").groupBy("doc_id_a", "doc_id_b").agg(F.max("jaccard").alias("jaccard"))


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N_GRAM, t: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Every document with its class and its links: doc_id, class_id, n_copies, n_links.

    The join is that of similar_pairs(). class_id is the lowest id of the connected component that links make;
    n_copies counts the other documents with the very same set of n-grams, n_links all that reach t, those included.
    So no link between different texts is lost, and a group of m copies gives m rows instead of its m (m - 1) / 2.

    Defined cases: one row for each id; rows with a null id are left out. An id with a null or
    wordless text is its own class without links. Repeated rows count once; an id on rows with different texts has
    the links of each of them (its own texts' among themselves too) and joins their classes. Other columns are not
    carried, so none clash. No rows give no rows.
    """
    j = join_sets(docs, key, text, n, t, broadcast_rows)
    reps, across = _rep_pairs(j)
    reps = written(reps, "dup-reps")
    ends = j.pairs.select("a", "sa", F.col("b").alias("sig"), F.col("sb").alias("size")).unionAll(j.pairs.select("b", "sb", "a", "sa"))
    links = ends.join(reps, ["sig", "size"]).select("a", "sa", "held").unionAll(j.near).groupBy("a", "sa").agg(F.sum("held").alias("near"))
    held = reps.join(links, (F.col("a") == F.col("sig")) & (F.col("sa") == F.col("size")), "left").select("sig", "size", "rep", F.col("held") - 1, F.coalesce("near", F.lit(0)).alias("near"))
    held = held.toDF("sig", "size", "rep", "more", "near")
    own = j.members.join(held, ["sig", "size"]).groupBy("doc_id").agg(F.min("rep").alias("rep"), F.sum("more").alias("more"), F.sum("near").alias("near"))
    heads = groups(across.unionByName(_knots(j, reps), allowMissingColumns=True)).withColumnRenamed("doc_id", "rep")
    every = docs.where(c(key).isNotNull()).select(c(key).cast("bigint").alias("doc_id")).distinct()
    got = every.join(own, "doc_id", "left").join(heads, "rep", "left")
    zero = F.lit(0).cast("bigint")
    return got.select("doc_id", F.coalesce("head", "rep", "doc_id").alias("class_id"), F.coalesce("more", zero).alias("n_copies"), F.coalesce(F.col("more") + F.col("near"), zero).alias("n_links"))


def _knots(j: Joined, reps: DataFrame) -> DataFrame:
    """Pairs that tie the sets of an id with several texts together."""
    many = j.members.groupBy("doc_id").agg(F.count("*").alias("texts")).where("texts > 1").select("doc_id")
    tied = j.members.join(many, "doc_id").join(reps, ["sig", "size"]).select("doc_id", "rep")
    return tied.join(tied.groupBy("doc_id").agg(F.min("rep").alias("low")), "doc_id").where("low < rep").select(F.col("low").alias("doc_id_a"), F.col("rep").alias("doc_id_b"))


def groups(pairs: DataFrame) -> DataFrame:
    """Connected components of pairs: (doc_id, head), the lowest id of each group; every member has a row.

    Each round hooks a node on the least of its neighbours and follows hooks to their end, then contracts the
    edges, which leaves none of a group whose members are all alike. Every table is written.
    """
    edges = pairs.select(F.col("doc_id_a").alias("x"), F.col("doc_id_b").alias("y")).where("x <> y")
    edges, heads = written(edges.unionAll(edges.select("y", "x")), "dup-edges"), None
    while heads is None or edges.limit(1).count():
        hook = written(edges.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("h")), "dup-hooks")
        while True:
            up = hook.select(F.col("x").alias("h"), F.col("h").alias("top"))
            nxt = written(hook.join(up, "h", "left").select("x", F.coalesce("top", "h").alias("h"), (F.col("top") < F.col("h")).alias("moved")), "dup-hooks")
            forget(hook)
            hook = nxt.select("x", "h")
            if not nxt.where("moved").limit(1).count():
                break
        top = hook.select(F.col("x").alias("head"), F.col("h").alias("top"))
        was = heads
        heads = written(hook.select("x", F.col("h").alias("head")) if heads is None else heads.join(top, "head", "left").select("x", F.coalesce("top", "head").alias("head")), "dup-heads")
        hx, hy = (hook.select(F.col("x").alias(k), F.col("h").alias(f"h{k}")) for k in "xy")
        ahead = written(edges.join(hx, "x").join(hy, "y").where("hx <> hy").select(F.col("hx").alias("x"), F.col("hy").alias("y")).distinct(), "dup-edges")
        for done in (edges, hook, *([was] if was is not None else [])):
            forget(done)
        edges = ahead
    return heads.withColumnRenamed("x", "doc_id")


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N_GRAM, t: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One document of each group of near copies, the one with the lowest id, with all its columns.

    Groups are the classes of near_copies(). A document in no pair stays, as do rows with a null id. Rows repeated
    under one id are cut to one of each text. Columns may have any names, those used within (they begin with __sg_)
    excepted.
    """
    j = join_sets(docs, key, text, n, t, broadcast_rows)
    reps, across = _rep_pairs(j)
    heads = groups(across.unionByName(_knots(j, reps), allowMissingColumns=True)).withColumnRenamed("doc_id", "rep")
    own = j.members.join(reps, ["sig", "size"]).join(heads, "rep", "left").select("doc_id", F.coalesce("head", "rep").alias("head"))
    gone = written(own.where("head < doc_id").select(F.col("doc_id").alias("__sg_gone")).distinct(), "dup-gone")
    few = gone.count() <= broadcast_rows
    kept = docs.join(F.broadcast(gone) if few else gone, c(key).cast("bigint") == F.col("__sg_gone"), "left_anti")
    again = written(docs.where(c(key).isNotNull()).groupBy(c(key).alias("__sg_again")).count().where("count > 1").select("__sg_again"), "dup-repeated")
    if not again.limit(1).count():
        return kept
    on = c(key) == F.col("__sg_again")
    return kept.join(again, on, "left_anti").unionAll(kept.join(again, on, "left_semi").dropDuplicates([key, text]))


#: All pairs that share an n-gram, and classes by reachability: for small tables.
SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\s+'), lambda x: regexp_replace(lower(x), '^[^\pL\pN]+|[^\pL\pN]+$', '', 'g')), lambda x: x <> '') AS ws
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), g AS (
  SELECT DISTINCT doc_id, gram FROM (SELECT doc_id, unnest(CASE
    WHEN len(ws) >= {N_GRAM} THEN list_transform(range(1, len(ws) - {N_GRAM} + 2), lambda i: array_to_string(ws[i : i + {N_GRAM} - 1], chr(1)))
    WHEN len(ws) > 0 THEN [array_to_string(ws, chr(1)) || chr(2)] ELSE [] END) AS gram FROM w)
), s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM g x JOIN g y USING (gram) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
p AS (SELECT a, b, m = x.n AND m = y.n AS same FROM o JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE m >= {THRESHOLD} * (x.n + y.n - m) - 1e-9),
r AS (SELECT DISTINCT a AS doc_id, a AS seen FROM p UNION SELECT r.doc_id, p.b FROM r JOIN p ON p.a = r.seen),
k AS (SELECT doc_id, min(seen) AS head FROM r GROUP BY 1),
l AS (SELECT a, count(*) AS n_links, count(*) FILTER (same) AS n_copies FROM p GROUP BY 1)
SELECT d.doc_id, coalesce(head, d.doc_id) AS class_id, coalesce(n_copies, 0) AS n_copies, coalesce(n_links, 0) AS n_links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN k USING (doc_id) LEFT JOIN l ON l.a = d.doc_id
"""
