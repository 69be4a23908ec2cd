"""A quality classifier with hierarchical empirical-Bayes site priors."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrain.llm.common import arrow_map, c, ship, slices, strings, tokens, word_hash, written

#: Labelled rows that the classifier is fitted on, those whose ids hash lowest.
TRAIN_ROWS = 12_000
#: Words and beginnings of words in the model: at most so many by |z|, each in so many training texts and at least so
#: telling. Beginnings tell of inflected words that training never saw.
MAX_WORDS, MIN_TEXTS, MIN_Z, STEMS = 512, 6, 4.0, (4, 5, 6)
#: Weight of the penalty on squared weights.
RIDGE = 1.0
KEEP_AT = 0.5
#: Bytes of text that are judged at once.
PART_BYTES = 2 << 20
#: Of so many labelled rows one is kept from the fit; these tell how much of a site's shift to believe.
HELD_OUT = 5
#: The prior strength that stands for sites which don't differ beyond chance.
NO_SPREAD = 1e12

_UPPER, _LOWER, _DIGIT, _SPACE, _SIGN, _HIGH = range(6)
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("a") : ord("z") + 1], _CLASS[ord("0") : ord("9") + 1] = _UPPER, _LOWER, _DIGIT
_CLASS[[9, 10, 13, 32]], _CLASS[128:] = _SPACE, _HIGH


@dataclass
class Model:
    """Two logistic heads (good quality, not toxic) over shape statistics and telling words."""

    words: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    weights: np.ndarray
    base: float
    #: Whether any labelled text was found; else every text with a word has even odds.
    fitted: bool = True

    def log_odds(self, texts: pa.Array) -> np.ndarray:
        """Log odds that a text is good and clean; an empty or null one has nothing for it."""
        out = np.full(len(texts), -8.0)
        arr = strings(texts)
        for a, b in slices(arr, PART_BYTES):
            part = arr.slice(a, b - a)
            stats, rows, cols, n = _features(part, self.words)
            z = ((stats - self.mean) / self.sd) @ self.weights[1 : 1 + stats.shape[1]] + self.weights[0]
            for h in range(2):
                z[:, h] += np.bincount(rows, weights=self.weights[1 + stats.shape[1] + cols, h], minlength=b - a)
            p = np.prod(1 / (1 + np.exp(-np.clip(z, -30, 30))), axis=1).clip(1e-9, 1 - 1e-9)
            out[a:b] = np.where(n > 0, np.log(p / (1 - p)).clip(-8, 8) if self.fitted else 0.0, -8.0)
        return out


def _shape(arr: pa.Array, n_tokens: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    """Shares of kinds of bytes, log length, mean word length and share of words said twice running, for each text."""
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    body = arr.buffers()[2]
    raw = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body else np.zeros(0, np.uint8)
    kinds, at = _CLASS[raw], offsets - offsets[0]
    size = np.diff(at)
    counts = np.zeros((len(arr), 6))
    for k in range(6):
        if len(kinds):
            upto = np.concatenate([[0], np.flatnonzero(kinds == k)])
            counts[:, k] = np.diff(np.searchsorted(upto[1:], at))
    some = np.maximum(size, 1)
    words = np.maximum(n_tokens, 1)
    return np.column_stack([counts[:, [_UPPER, _DIGIT, _SPACE, _SIGN]] / some[:, None], np.log1p(size), np.minimum(size / words, 60), counts[:, _SIGN] / words, repeats / words])


def _spellings(words: pa.Array) -> list[np.ndarray]:
    """Hashes of words, and of their beginnings of each length in STEMS; a shorter word is no stem."""
    out = [word_hash(words)]
    for k in STEMS:
        stems = pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, k), *(pa.scalar(x, words.type) for x in ("*", ""))).dictionary_encode()
        h = word_hash(stems.dictionary)[stems.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)
        out.append(np.where(pc.utf8_length(words).to_numpy(zero_copy_only=False) >= k, h, np.uint64(0)))
    return out


def _features(arr: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Statistics, (row, known word or stem) pairs without repeats, and token counts."""
    codes, offsets, words = tokens(arr)
    n = np.diff(offsets)
    found = [np.zeros(0, int)]
    if len(known) and len(codes):
        spelt = _spellings(words)
        ats = [np.minimum(np.searchsorted(known, h), len(known) - 1) for h in spelt]
        hits = [known[at] == h for at, h in zip(ats, spelt)]
        some = np.flatnonzero(np.logical_or.reduce(hits)[codes])
        rows, word = np.searchsorted(offsets, some, side="right") - 1, codes[some]
        found += [(rows * len(known) + at[word])[hit[word]] for at, hit in zip(ats, hits)]
    pairs = np.unique(np.concatenate(found))
    same = np.concatenate([[0], np.cumsum(codes[1:] == codes[:-1]), [0]])[: len(codes)] if len(codes) else np.zeros(1, int)
    last, first = np.maximum(offsets[1:] - 1, 0), np.minimum(offsets[:-1], max(len(codes) - 1, 0))
    return _shape(arr, n, np.where(n > 0, same[last] - same[first], 0)), pairs // max(len(known), 1), pairs % max(len(known), 1), n


def fit(texts: list[pa.Array], quality: np.ndarray, toxic: np.ndarray) -> Model:
    """Pick words by their association with a label, then fit both heads by Newton's method with a ridge."""
    good, clean = (quality > 0).astype(float), (toxic <= 0).astype(float)
    m = len(good)
    uniq, counts, at = np.zeros(0, np.uint64), np.zeros((0, 3)), 0
    for arr in texts:
        for a, b in slices(arr, PART_BYTES):
            codes, offsets, words = tokens(arr.slice(a, b - a))
            texts_of = np.repeat(np.arange(b - a), np.diff(offsets))
            met, sums = [], []
            for spelt in _spellings(words):
                names, to = np.unique(spelt, return_inverse=True)
                n = max(len(names), 1)
                pairs = np.unique(texts_of * n + to[codes]) if len(codes) else np.zeros(0, int)
                own, word = at + pairs // n, pairs % n
                met.append(names)
                sums.append(np.column_stack([np.bincount(word, weights=y, minlength=len(names)) for y in (None, good[own], clean[own])]))
            here = np.concatenate(sums)
            uniq, inv = np.unique(np.concatenate([uniq, *met]), return_inverse=True)
            both = np.concatenate([counts, here])
            counts = np.column_stack([np.bincount(inv, weights=both[:, i], minlength=len(uniq)) for i in range(3)])
            at += b - a
    df, z = counts[:, 0], np.zeros(len(uniq))
    for i, y in enumerate((good, clean)):
        p = float(np.clip(y.mean() if m else 0.5, 1e-3, 1 - 1e-3))
        z = np.maximum(z, np.abs(counts[:, 1 + i] - df * p) / np.sqrt(np.maximum(df * p * (1 - p), 1e-9)))
    ok = np.flatnonzero((df >= MIN_TEXTS) & (z >= MIN_Z) & (uniq > 0))
    chosen = np.sort(ok[np.argsort(-z[ok], kind="stable")[:MAX_WORDS]])  # uniq is sorted, so the hashes are too
    known = uniq[chosen]
    stats, x = [], []
    for arr in texts:
        for a, b in slices(arr, PART_BYTES):
            s, rows, cols, _ = _features(arr.slice(a, b - a), known)
            d = np.zeros((b - a, len(known)), np.float32)
            d[rows, cols] = 1
            stats.append(s)
            x.append(d)
    s = np.concatenate(stats) if stats else np.zeros((0, 8))
    mean, sd = (s.mean(0), s.std(0) + 1e-6) if m else (np.zeros(8), np.ones(8))
    full = np.concatenate([np.ones((m, 1), np.float32), ((s - mean) / sd).astype(np.float32), np.concatenate(x) if x else np.zeros((0, len(known)), np.float32)], axis=1)
    x.clear()
    weights = np.zeros((full.shape[1], 2))
    for head, y in enumerate((good, clean)):
        # words are held back by how little they tell alone: a word that one class never has may weigh much at once
        yes, no = counts[chosen, 1 + head], df[chosen] - counts[chosen, 1 + head]
        tells = np.log((yes + 1) / (y.sum() + 2)) - np.log((no + 1) / (m - y.sum() + 2))
        ridge = np.full(full.shape[1], RIDGE)
        ridge[0], ridge[1 + s.shape[1] :] = 1e-3, RIDGE / np.maximum(np.abs(tells), 0.3) ** 2
        w = np.zeros(full.shape[1])
        for _ in range(12 if m else 0):
            p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
            bend = np.diag(ridge)
            for i in range(0, m, 1024):
                part = full[i : i + 1024].astype(float)
                bend += (part * np.maximum(p[i : i + 1024] * (1 - p[i : i + 1024]), 1e-4)[:, None]).T @ part
            step = np.linalg.solve(bend, full.T @ (y - p) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-4:
                break
        weights[:, head] = w
    return Model(known, mean, sd, weights, float(np.clip((good * clean).mean() if m else 0.5, 0.01, 0.99)), bool(m))


def labelled(labels: DataFrame, key: str = "doc_id", quality: str = "quality", toxic: str = "toxic", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """key, q, t and held of at most train_rows labels, those whose keys hash lowest; one of HELD_OUT is held out.

    Rows of labels with a null key or no label are left out; a missing head of a label counts as the good value.
    """
    lab = labels.where(c(key).isNotNull() & (c(quality).isNotNull() | c(toxic).isNotNull())).select(
        c(key).alias("key"), F.coalesce(c(quality), F.lit(1)).cast("int").alias("q"), F.coalesce(c(toxic), F.lit(0)).cast("int").alias("t")
    )
    lab = lab.orderBy(F.xxhash64("key"), "key", "q", "t").limit(train_rows)
    return lab.withColumn("held", F.pmod(F.xxhash64("key", F.lit("held")), F.lit(HELD_OUT)) == 0)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality", toxic: str = "toxic", train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most train_rows labelled documents, in one task; the driver gets the fitted model alone.

    Labels are those of labelled() that aren't held out. An id on several texts is fitted on the least of them.
    """
    lab = labelled(labels, key, quality, toxic, train_rows).where("not held")
    rows = docs.select(c(key).alias("key"), c(text).alias("text")).join(F.broadcast(lab), "key")  # train_rows bounds it
    rows = rows.groupBy("key", "q", "t").agg(F.min("text").alias("text")).select("text", "q", "t")

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, q, t = [], [np.zeros(0)], [np.zeros(0)]
        for b in batches:
            texts.append(strings(b.column(0)))
            q.append(b.column(1).to_numpy())
            t.append(b.column(2).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, np.concatenate(q), np.concatenate(t)))], pa.binary())], ["model"])

    got = arrow_map(rows.repartition(1), job, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else fit([], np.zeros(0), np.zeros(0))


def scorer(model: Model) -> Callable[[Column], Column]:
    """The log odds of a text, as an Arrow function of the text column alone."""

    @F.arrow_udf("double")
    def log_odds(text: pa.Array) -> pa.Array:
        return pa.array(model.log_odds(text), pa.float64())

    return log_odds


def site_shifts(scored: DataFrame, base: float) -> DataFrame:
    """By host and path: texts, both posteriors, and the shift of log odds that the site gives.

    A host's rate is its summed evidence shrunk toward the global rate, a path's toward its host's; the weight
    of each prior in texts comes from the spread between groups beyond what sampling explains (moments of the
    beta-binomial), so sparse sites stay at their parent.
    """
    p = 1 / (1 + F.exp(-F.col("odds")))
    sites = written(scored.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum(p).alias("s")), "quality-sites")
    hosts = sites.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    top = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.count("*").alias("g")).first()
    total = float(top["n"] or 0)
    rate = float((top["s"] / total) if total else base)

    def strength(frame: DataFrame, n: str, s: str, mean: Column, groups: float) -> float:
        spread = frame.agg(F.sum(F.col(n) * F.pow(F.col(s) / F.col(n) - mean, 2)).alias("v")).first()["v"] or 0.0
        between = spread / total - rate * (1 - rate) * groups / total if total else 0.0
        return max(rate * (1 - rate) / between - 1, 0.0) if between > rate * (1 - rate) / NO_SPREAD else NO_SPREAD

    kh = strength(hosts, "hn", "hs", F.lit(rate), float(top["g"]))
    hosts = hosts.withColumn("host_rate", (F.col("hs") + F.lit(kh * rate)) / (F.col("hn") + F.lit(kh)))
    both = sites.join(hosts.withColumnRenamed("host", "_h"), F.col("host").eqNullSafe(F.col("_h")))
    kp = strength(both, "n", "s", F.col("host_rate"), float(both.count()))
    both = both.withColumn("path_rate", (F.col("s") + F.lit(kp) * F.col("host_rate")) / (F.col("n") + F.lit(kp)))
    shift = F.log(F.col("path_rate") / (1 - F.col("path_rate"))) - F.lit(float(np.log(rate / (1 - rate))))
    return written(both.withColumn("shift", shift).select("host", "path", "n", "host_rate", "path_rate", "shift"), "quality-shifts")


def site_weight(scored: DataFrame, sites: DataFrame, lab: DataFrame) -> float:
    """The share of a site's shift that held-out labels bear out, from 0 to 1.

    Added to a text's own log odds in full, the shift counts what the site's texts share with this one twice. The
    weight has the greatest posterior under the held-out labels (train_rows bounds them) and a normal prior about 1.
    """
    rows = scored.select(F.col("doc_id").alias("key"), "host", "path", "odds").join(F.broadcast(lab.where("held")), "key")
    near = sites.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "shift")
    rows = rows.join(near, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")))
    got = rows.groupBy("key", "q", "t").agg(F.avg("odds").alias("odds"), F.avg("shift").alias("shift")).toPandas()
    y = ((got["q"] > 0) & (got["t"] <= 0)).to_numpy(float)
    odds, shift, w = got["odds"].to_numpy(float), got["shift"].to_numpy(float), 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(odds + w * shift, -30, 30)))
        step = (((y - p) * shift).sum() - (w - 1)) / ((p * (1 - p) * shift**2).sum() + 1)
        w += step
        if abs(step) < 1e-9:
            break
    return float(np.clip(w, 0.0, 1.0))


def _sites(host: str, path: str | None) -> tuple[Column, Column]:
    return c(host).cast("string"), (c(path) if path else F.lit("")).cast("string")


def evidence(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", host: str = "source", path: str | None = "lang") -> DataFrame:
    """doc_id, host, path and the text's log odds, written: the one pass over the texts."""
    ship(docs.sparkSession)
    h, p = _sites(host, path)
    return written(docs.select(c(key).alias("doc_id"), h.alias("host"), p.alias("path"), scorer(model)(c(text)).alias("odds")), "quality-evidence")


def _judged(scored: DataFrame, model: Model, lab: DataFrame) -> DataFrame:
    """scored with its site's rates (host_rate, path_rate) and p_good."""
    sites = site_shifts(scored, model.base)
    weight = site_weight(scored, sites, lab) if model.fitted else 0.0
    near = sites.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "host_rate", "path_rate", "shift")
    both = scored.join(near, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")))
    return both.withColumn("p_good", 1 / (1 + F.exp(-(F.col("odds") + F.lit(weight) * F.col("shift")))))


def classify(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT, train_rows: int = TRAIN_ROWS, key: str = "doc_id", text: str = "text", host: str = "source", path: str | None = "lang") -> DataFrame:
    """Judge every document: doc_id, host, path, p_text, host_rate, path_rate, p_good, keep.

    p_text is the classifier's chance that the text is of good quality and not toxic; p_good has the site's
    shift of log odds added, by the weight that held-out labels bear out; keep is p_good >= keep_at. The table has
    no addresses, so the site is the source, and its path level the language within it; both are parameters.

    Nulls: a null host or path is a site of its own. A null or empty text scores the least evidence and is not
    kept; long texts are read whole. Repeated rows are judged alike. Without labels every text with a word
    scores even odds and no site shifts them (so it is kept at 0.5). Other columns are not carried, so none clash. No rows give no rows.
    """
    model = train(docs, labels, key, text, train_rows=train_rows)
    both = _judged(evidence(docs, model, key, text, host, path), model, labelled(labels, key, train_rows=train_rows))
    return both.select("doc_id", "host", "path", (1 / (1 + F.exp(-F.col("odds")))).alias("p_text"), "host_rate", "path_rate", "p_good", (F.col("p_good") >= keep_at).alias("keep"))


def filter_documents(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT, train_rows: int = TRAIN_ROWS, key: str = "doc_id", text: str = "text", host: str = "source", path: str | None = "lang") -> DataFrame:
    """The documents that classify() keeps, with all their columns.

    Texts are scored once: rows are written with their log odds, from which sites and decisions come. No text is
    shuffled, and rows need no unique key.

    Nulls, empty and long texts and missing labels are treated as classify() does: a null or empty text goes, a null
    host or path is a site of its own. Repeated rows stay or go together, each of them; ties at keep_at stay. Columns
    may have any names, those used within too: they come back as they were. No rows give no rows.
    """
    model = train(docs, labels, key, text, train_rows=train_rows)
    ship(docs.sparkSession)
    h, p = _sites(host, path)
    names = [f"_{i}" for i in range(len(docs.columns))]
    row = F.struct(*[c(x).alias(n) for x, n in zip(docs.columns, names)]).alias("row")
    scored = written(docs.select(row, c(key).alias("doc_id"), h.alias("host"), p.alias("path"), scorer(model)(c(text)).alias("odds")), "quality-rows")
    both = _judged(scored, model, labelled(labels, key, train_rows=train_rows))
    return both.where(F.col("p_good") >= keep_at).select(*[F.col(f"row.{n}").alias(x) for x, n in zip(docs.columns, names)])
