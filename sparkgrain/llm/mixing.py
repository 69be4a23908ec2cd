"""Entropy balancing of sources to target token weights."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrain.llm.common import c, forget, written
from sparkgrain.llm.packing import word_count

#: Targets are the natural token shares to these powers, made to sum to 1.
TEMPERATURES = {"source": 0.5, "lang": 0.7}
#: Exponent past which a tilt only shows that targets can't be met: no step goes on from there.
CLIP = 30.0
#: Combinations of groups that the driver holds a row of, and broadcasts an exponent for; more raise an error.
MOST_COMBINATIONS = 1_000_000
#: Where no weights meet the targets: weight of the penalty on squared multipliers that finds the nearest ones.
SOFT = 1e-4
#: Residual, as a share of all tokens, at which targets count as met.
MET = 1e-6
T = "__sg_t"


@dataclass
class Balance:
    """What the dual's optimum came to.

    met: "all" constraints; "targets" where the mean length had to be given up; "nearest" where targets contradict
    each other, and residual says by how much of all tokens the worst of them is missed.
    """

    rates: DataFrame
    iterations: int
    residual: float
    met: str
    #: Adds __sg_rate and __sg_copies to documents with all their columns.
    weigh: Callable[[DataFrame], DataFrame]

    @property
    def converged(self) -> bool:
        return self.met != "nearest"


def _targets(shares: dict, own: dict | float) -> dict:
    if isinstance(own, dict):
        total = sum(own.get(k, 0.0) for k in shares)
        return {k: own.get(k, 0.0) / total if total else 1 / len(shares) for k in shares}
    powered = {k: v**own for k, v in shares.items()}
    return {k: v / sum(powered.values()) for k, v in powered.items()}


class _Dual:
    """The dual problem over combinations of groups: what the driver knows between two aggregates.

    of[d][i]: which multiplier of grouping column d combination i has. The multipliers of the column with the most
    values come first; their block of the Hessian is diagonal and is eliminated, so that a step costs the cube of
    the other columns' values alone. The last multiplier is that of the length.
    """

    def __init__(self, of: list[np.ndarray], sizes: list[int], want: np.ndarray, length: bool, soft: float):
        self.of, self.want, self.length, self.soft = of, want, length, soft
        self.start = np.cumsum([0, *sizes])
        self.many = int(np.argmax(sizes)) if sizes else 0

    def exponents(self, lam: np.ndarray) -> np.ndarray:
        return sum((lam[self.start[d] + x] for d, x in enumerate(self.of)), np.zeros(len(self.of[0]) if self.of else 0))

    def value(self, lam: np.ndarray, m: np.ndarray) -> float:
        return float(m[:, 0].sum() - lam @ self.want + self.soft / 2 * (lam @ lam))

    def missed(self, m: np.ndarray) -> np.ndarray:
        """Tokens over the targets, as shares of all, for each multiplier."""
        held = [np.bincount(x, weights=m[:, 0], minlength=self.start[d + 1] - self.start[d]) for d, x in enumerate(self.of)]
        return np.concatenate([*held, [m[:, 1].sum() if self.length else 0.0]]) - self.want

    def step(self, lam: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Newton's step from the moments (weight, weighted length, weighted squared length) of each combination."""
        grad = self.missed(m) + self.soft * lam
        a, b = self.start[self.many], self.start[self.many + 1]
        own, rest = self.of[self.many], np.concatenate([np.arange(a), np.arange(b, len(lam))])
        place = np.full(len(lam), -1)
        place[rest] = np.arange(len(rest))
        others = [place[self.start[d] + x] for d, x in enumerate(self.of) if d != self.many]
        p = len(rest)
        small = np.zeros((p, p))
        for i, x in enumerate(others):
            small[np.arange(p), np.arange(p)] += np.bincount(x, weights=m[:, 0], minlength=p)
            small[p - 1] += self.length * np.bincount(x, weights=m[:, 1], minlength=p)
            for y in others[i + 1 :]:
                both = np.bincount(x * p + y, weights=m[:, 0], minlength=p * p).reshape(p, p)
                small += both + both.T
        small[:, p - 1] = small[p - 1]
        small[p - 1, p - 1] = m[:, 2].sum() if self.length else 1.0
        small += self.soft * np.eye(p)
        diag = np.maximum(np.bincount(own, weights=m[:, 0], minlength=b - a), 1e-300) + self.soft
        rhs = grad[rest].copy()
        cross: list[tuple[int, np.ndarray]] = []
        order = np.argsort(own, kind="stable")
        for first in range(0, b - a, 4096):  # some values at a time: the whole block may be wide
            n = min(4096, b - a - first)
            lo, hi = np.searchsorted(own[order], [first, first + n])
            part = order[lo:hi]
            rows = own[part] - first
            c_ = np.zeros((n, p))
            for x in others:
                c_ += np.bincount(rows * p + x[part], weights=m[part, 0], minlength=n * p).reshape(n, p)
            if self.length:
                c_[:, p - 1] += np.bincount(rows, weights=m[part, 1], minlength=n)
            d = diag[first : first + n]
            small -= c_.T @ (c_ / d[:, None])
            rhs -= c_.T @ (grad[a + first : a + first + n] / d)
            cross.append((first, c_))
        out = np.zeros(len(lam))
        out[rest] = -np.linalg.pinv(small, rcond=1e-12, hermitian=True) @ rhs
        for first, c_ in cross:
            n = len(c_)
            out[a + first : a + first + n] = -(grad[a + first : a + first + n] + c_ @ out[rest]) / diag[first : first + n]
        if not self.length:
            out[-1] = 0.0
        return out


def _solve(dual: _Dual, moments: Callable[[np.ndarray, float], np.ndarray], tolerance: float, most: int) -> tuple[np.ndarray, int, float]:
    """Damped Newton's steps until the gradient is within tolerance, or no step helps. The multipliers, steps, residual."""
    lam, steps = np.zeros(len(dual.want)), 0
    m = moments(dual.exponents(lam), 0.0)
    while steps < most and np.abs(dual.missed(m) + dual.soft * lam).max() > tolerance:
        steps += 1
        step, scale, value = dual.step(lam, m), 1.0, dual.value(lam, m)
        slope = float((dual.missed(m) + dual.soft * lam) @ step)
        while True:
            to = lam + scale * step
            if (np.abs(dual.exponents(to)) < CLIP).all() and abs(to[-1]) < CLIP:
                got = moments(dual.exponents(to), float(to[-1]))
                if dual.value(to, got) <= value + 1e-4 * scale * slope + 1e-12:
                    break
            scale /= 2
            if scale < 1e-4:
                return lam, steps, float(np.abs(dual.missed(m)).max())
        lam, m = to, got
    return lam, steps, float(np.abs(dual.missed(m)).max())


def balance(docs: DataFrame, targets: dict[str, dict | float] | None = None, key: str = "doc_id", text: str = "text", n_tokens: Column | None = None, budget: float = 1.0, tolerance: float = 1e-9, most: int = 60) -> Balance:
    """Rates for documents so that token totals meet targets, as near to 1 as can be in relative entropy.

    targets: for each grouping column either wanted shares by value, or a power of the natural token shares.
    budget: wanted tokens as a multiple of those there. A document i with t_i tokens and indicators z_i of its
    groups, and u_i its standardised log length, gets w_i = exp(lambda . (z_i, u_i)): it minimises
    sum t_i (w_i log w_i - w_i) under sum t_i w_i z_i = targets and an unchanged mean of u (so that rates
    are not bought by changing the length distribution). Newton's steps on the convex dual, halved where they
    would not lower it. Each step is one aggregate over a written table of distinct (groups, tokens) cells; the driver
    holds a row for each combination of groups that occurs, at most MOST_COMBINATIONS (more are a ValueError).

    Targets that can't be met: where no rates keep the mean length too, it is given up. Where targets contradict each
    other (a source that is all of one language, say), the rates are those that a small penalty on the multipliers
    gives, the nearest of moderate size. Either warns, and Balance.met and residual tell; nothing is dropped for it.

    Result columns: doc_id, the grouping columns, n_tokens, rate, copies. copies is floor(rate) or one more,
    the fraction decided by a hash of key, tokens and groups, so that the expected tokens are the exact ones.

    Nulls: a null group is a group of its own. Null or empty texts have no tokens and rate 0. A value with a
    target but no tokens is left out and the rest are scaled to sum to 1; a value whose target is 0 gets rate
    0. Repeated rows round alike. Other columns are not carried, so none clash. No rows give no rows.
    """
    if not (targets := TEMPERATURES if targets is None else targets):
        raise ValueError("no grouping column has targets")
    dims = list(targets)
    g = [f"__sg_g{i}" for i in range(len(dims))]
    spark = docs.sparkSession

    def grouped(frame: DataFrame) -> DataFrame:
        n = (word_count(c(text)) if n_tokens is None else n_tokens).cast("bigint")
        return frame.withColumns({**{x: c(d).cast("string") for d, x in zip(dims, g)}, T: n})

    found = written(grouped(docs).select(*g, F.col(T).alias("t")).where("t > 0").groupBy(*g, "t").agg(F.count("*").cast("double").alias("k")), "mix-found")
    raw, mass = F.log2(F.col("t") + 1.0), F.col("k") * F.col("t")
    base = found.groupBy(*g).agg(F.sum(mass).alias("m"), F.sum(mass * raw).alias("mu"), F.sum(mass * raw * raw).alias("muu"))
    if (n := base.count()) > MOST_COMBINATIONS:
        raise ValueError(f"{n} combinations of {dims} occur; at most {MOST_COMBINATIONS} are balanced")
    base = base.toPandas()
    base[g] = base[g].astype(object).where(base[g].notna(), None)
    total = float(base["m"].sum())
    mean = float(base["mu"].sum() / total) if total else 0.0
    sd = float(np.sqrt(max(base["muu"].sum() / total - mean**2, 0.0))) if total else 0.0
    u = (raw - F.lit(mean)) / F.lit(sd or 1.0)

    want: list[float] = []
    at: list[dict] = []
    for d, name in enumerate(dims):
        shares = {k: float(v) / total for k, v in base.groupby(g[d], dropna=False)["m"].sum().items()} if total else {}
        shares = {None if k != k else k: v for k, v in shares.items()}
        wanted = {k: v for k, v in sorted(_targets(shares, targets[name]).items(), key=lambda kv: (kv[0] is not None, kv[0] or "")) if v > 0}
        at.append({k: i for i, k in enumerate(wanted)})
        want += [v * budget for v in wanted.values()]
    live = base[np.logical_and.reduce([[k in at[d] for k in base[x]] for d, x in enumerate(g)])].reset_index(drop=True)
    of = [np.array([at[d][k] for k in live[x]], np.int64) for d, x in enumerate(g)]
    names = [live[x].astype("string") for x in g]
    numbered = spark.createDataFrame(pa.table({**{x: pa.array(v, pa.string()) for x, v in zip(g, names)}, "i": pa.array(np.arange(len(live)), pa.int32())}))
    cells = written(tilted(found, numbered, g, "inner").select("i", "t", "k"), "mix-cells")
    forget(found)

    def tilts(a: np.ndarray) -> DataFrame:
        return spark.createDataFrame(pa.table({"i": pa.array(np.arange(len(a)), pa.int32()), "a": pa.array(a, pa.float64())}))

    def moments(a: np.ndarray, by_length: float) -> np.ndarray:
        w = F.exp(F.least(F.col("a") + F.lit(by_length) * u, F.lit(2 * CLIP)))
        got = cells.join(F.broadcast(tilts(a)), "i").groupBy("i").agg(F.sum(mass * w).alias("w"), F.sum(mass * w * u).alias("wu"), F.sum(mass * w * u * u).alias("wuu")).toPandas()
        out = np.zeros((len(live), 3))
        out[got["i"].to_numpy()] = got[["w", "wu", "wuu"]].to_numpy()
        return out / total

    lam, steps, residual, met = np.zeros(len(want) + 1), 0, 0.0, "all"
    if len(live):
        sizes, b = [len(x) for x in at], np.append(want, 0.0)
        for met, length, soft in (("all", sd > 0, 0.0), ("targets", False, 0.0), ("nearest", False, SOFT)):
            dual = _Dual(of, sizes, b, length, soft)
            lam, more, residual = _solve(dual, moments, tolerance, most)
            steps += more
            if residual <= max(tolerance, MET):
                break
        if met != "all":
            warnings.warn({"targets": "no rates meet the targets at an unchanged mean length: it is given up", "nearest": f"no rates meet all targets: the nearest miss one by {residual:.3g} of all tokens"}[met], stacklevel=2)
        exponent = dual.exponents(lam)
    else:
        exponent = np.zeros(len(live))
    forget(cells)
    tilt = spark.createDataFrame(pa.Table.from_pandas(pd.DataFrame({**dict(zip(g, names)), "__sg_a": exponent}), schema=pa.schema([*[(x, pa.string()) for x in g], ("__sg_a", pa.float64())]), preserve_index=False))

    def weigh(frame: DataFrame) -> DataFrame:
        own = (F.log2(F.col(T) + 1.0) - F.lit(mean)) / F.lit(sd or 1.0)
        rate = F.when(F.col(T) > 0, F.coalesce(F.exp(F.least(F.col("__sg_a") + F.lit(float(lam[-1])) * own, F.lit(CLIP))), F.lit(0.0))).otherwise(F.lit(0.0))
        coin = F.xxhash64(c(key), T, *g).bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / F.lit(float(1 << 53))
        placed = tilted(grouped(frame), tilt, g, "left").withColumn("__sg_rate", rate)
        return placed.withColumn("__sg_copies", F.floor(F.col("__sg_rate") + coin).cast("bigint"))

    rates = weigh(docs).select(c(key).alias("doc_id"), *[F.col(x).alias(d) for d, x in zip(dims, g)], F.col(T).alias("n_tokens"), F.col("__sg_rate").alias("rate"), F.col("__sg_copies").alias("copies"))
    return Balance(rates, steps, residual, met, weigh)


def resample(docs: DataFrame, **kw) -> DataFrame:
    """Documents repeated as often as balance() says, with all their columns; those with no copy are gone.

    Nulls, empty texts, ties and repeated rows are treated as balance() does: a null or empty text has rate 0 and
    goes, a null group is a group, equal rows get equal copies, each of them. Columns may have any names, those used
    within too: they come back as they were. Targets that can't be met warn, as told there. No rows give no rows.
    """
    names = [f"__sg_own{i}" for i in range(len(docs.columns))]
    needed = dict.fromkeys([kw.get("key", "doc_id"), kw.get("text", "text"), *(kw.get("targets") or TEMPERATURES)])
    n = kw.pop("n_tokens", None)
    held = docs.select(F.struct(*[c(x).alias(y) for x, y in zip(docs.columns, names)]).alias("__sg_row"), *[c(x) for x in needed], (F.lit(None) if n is None else n).cast("bigint").alias("__sg_n"))
    kept = balance(held, n_tokens=None if n is None else F.col("__sg_n"), **kw).weigh(held).where("__sg_copies > 0")
    copies = kept.select("__sg_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__sg_copies"))))
    return copies.select(*[F.col(f"__sg_row.{y}").alias(x) for x, y in zip(docs.columns, names)])


def tilted(rows: DataFrame, tilt: DataFrame, g: list[str], how: str) -> DataFrame:
    """Rows with what a table of at most MOST_COMBINATIONS rows says of their groups; null groups match null ones."""
    tilt = tilt.withColumnsRenamed({x: f"_{x}" for x in g})
    return rows.join(F.broadcast(tilt), [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in g], how).drop(*[f"_{x}" for x in g])
