"""Operators against brute force, exact round trips and held-out rows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkgrain.llm import brown, jpeg, jpeg_source, mixing, neardup, packing, quality, template, vafile

SF = "/root/testdata/sf0.01"
WORDS = [f"w{i}" for i in range(400)]


def words(t):
    return [x for x in (re.sub(r"^[\W_]+|[\W_]+$", "", w.lower()) for w in (t or "").split()) if x]


def grams(t, n=3):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def copies(seed, groups=12, alone=60):
    r = random.Random(seed)
    out = []
    for _ in range(groups):
        base = [r.choice(WORDS) for _ in range(r.randint(8, 120))]
        for _ in range(r.randint(1, 7)):
            mine = list(base)
            for _ in range(r.randint(0, max(1, len(mine) // 12))):
                mine[r.randrange(len(mine))] = r.choice(WORDS)
            out.append(" ".join(mine))
    shared = " ".join(r.choice(WORDS) for _ in range(60))
    out += [" ".join(r.choice(WORDS) for _ in range(r.randint(1, 90))) + (" " + shared if i % 3 == 0 else "") for i in range(alone)]
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("seed,t,n,broadcast", [(1, 0.6, 3, 4_000_000), (2, 0.6, 3, 0), (3, 0.4, 2, 4_000_000), (4, 0.8, 5, 0)])
def test_join_is_exact(spark, seed, t, n, broadcast):
    rows = copies(seed)
    sets = {i: grams(x, n) for i, x in rows}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] and sets[b]}
    rep = {i: min(j for j in sets if sets[j] == s) for i, s in sets.items()}
    want = {p: j for p, j in want.items() if j >= t and (all(rep[x] == x for x in p) or rep[p[1]] == p[0])}
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {(r.doc_id_a, r.doc_id_b): r.jaccard for r in neardup.similar_pairs(df, n=n, t=t, broadcast_rows=broadcast).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)


def test_registered_join_counts_every_link(spark, tmp_path):
    from sparkgrain.llm import queries

    rows = copies(6, 5, 20)
    rows += [(1000 + i, rows[j][1]) for i, j in enumerate([0, 0, 0, 1, 2, 2, 9, 40])] + [(2000, None), (2001, " ... "), (None, rows[0][1])]
    sets = {i: grams(x, neardup.N_GRAM) for i, x in rows if i is not None}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] and sets[b]}
    want = [p for p, j in want.items() if j >= neardup.THRESHOLD]
    head = components(want)
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op7_ngram_jaccard_join(spark, str(tmp_path)).collect()
    assert len(got) == len(sets)
    for r in got:
        mine = [a + b - r.doc_id for a, b in want if r.doc_id in (a, b)]
        assert (r.class_id, r.n_links, r.n_copies) == (head.get(r.doc_id, r.doc_id), len(mine), sum(sets[x] == sets[r.doc_id] for x in mine)), r


def crowd(seed):
    """Two texts in hundreds of changed copies each, texts half way between them, some that share a part of one, and others."""
    r = random.Random(seed)
    bases = [[r.choice(WORDS) + str(r.randrange(40)) for _ in range(k)] for k in (60, 90)]
    out = []
    for base, many in zip(bases, (260, 150)):
        for _ in range(many):
            mine = list(base)
            for _ in range(r.randint(0, len(mine) // 10)):
                mine[r.randrange(len(mine))] = r.choice(WORDS)
            out.append(" ".join(mine))
    for _ in range(20):
        out.append(" ".join(bases[0][: r.randint(20, 60)] + bases[1][: r.randint(0, 90)]))
        out.append(" ".join(bases[0][: r.randint(25, 45)] + [r.choice(WORDS) for _ in range(r.randint(0, 40))]))
    return [(i, t) for i, t in enumerate(out + out[:9] + [out[0]] * 5)] + [(3, out[300]), (0, out[0]), (1, out[0])] + [(10_000 + i, t) for i, t in copies(seed, 20, 20)]


def test_a_crowd_is_counted_not_listed(spark):
    rows = crowd(11)
    texts = {}
    for i, x in rows:
        if g := frozenset(grams(x, neardup.N_GRAM)):
            texts.setdefault(i, set()).add(g)
    own = [(i, g) for i, gs in texts.items() for g in gs]
    want = [(i, j, g == h) for i, g in own for j, h in own if (i, g) != (j, h) and len(g & h) >= neardup.THRESHOLD * len(g | h) - 1e-9]
    links, same = Counter(i for i, _, _ in want), Counter(i for i, _, eq in want if eq)
    head = components([(i, j) for i, j, _ in want if i < j])
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: (r.class_id, r.n_copies, r.n_links) for r in neardup.near_copies(df).collect()}
    assert got == {i: (head.get(i, i), same[i], links[i]) for i, _ in rows}
    sets = {g for gs in texts.values() for g in gs}
    pairs = sum(len(g & h) >= neardup.THRESHOLD * len(g | h) - 1e-9 for g in sets for h in sets if g != h) // 2
    # links of a crowd are no rows on the way, unless all pairs are asked for
    assert neardup.join_sets(df).pairs.count() < 0.1 * pairs
    assert neardup.join_sets(df, every=True).pairs.count() == pairs


@pytest.mark.parametrize("many,t,every", [(1, 0.6, True), (3, 0.6, False), (4, 0.45, True), (4, 0.75, False)])
def test_cells_of_a_crowd_are_exact(many, t, every):
    sets = [(i, np.sort(np.fromiter(next(neardup.gram_sets(pa.array([x], pa.large_string()), 3)), np.uint64))) for i, x in crowd(5)[:450]]
    crowds = neardup.Crowds([sets[0][1]], [many])
    crowds.blocks[:], crowds.first = many, np.array([0, many * many])
    crowded = {}
    for i, g in sets:
        crowded.setdefault(neardup.fingerprint(g), (1, g, []))[2].append(i)
    cells = {}
    for s, x in crowded.items():
        for at, blob in neardup._blocks({s: x}, crowds):
            for k in at.tolist():
                cells.setdefault(k, []).append(pa.scalar(blob, pa.binary()))
    got = [r for k, blobs in cells.items() for r in neardup._cell(blobs, k, crowds, t, every, strip=100, wide=13).to_pylist()]
    want = {}
    for a, (_, g, _) in crowded.items():
        for b, (_, h, ids) in crowded.items():
            both = len(np.intersect1d(g, h))
            if a != b and both >= t * (len(g) + len(h) - both) - 1e-9:
                want[a, b] = both / (len(g) + len(h) - both), len(ids)
    pairs = [tuple(sorted((r["a"], r["b"]))) for r in got if r["met"] == neardup._PAIR]
    if every:
        assert sorted(pairs) == sorted(p for p in want if p[0] < p[1])
        assert all(r["jaccard"] == want[r["a"], r["b"]][0] for r in got)
        return
    near = Counter()
    for r in got:
        near[r["a"]] += r["near"]
    full = Counter()
    for (a, _), (_, k) in want.items():
        full[a] += k
    assert +near == +full and {*pairs} <= {*want}
    assert components([(min(p), max(p)) for p in pairs]) == components([p for p in want if p[0] < p[1]])


def components(pairs):
    head = {}

    def find(x):
        while head.setdefault(x, x) != x:
            x = head[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        head[max(a, b)] = min(a, b)
    return {x: find(x) for x in head}


def test_one_of_each_group_stays(spark):
    rows = copies(7)
    sets = {i: grams(x) for i, x in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])]
    heads = components(pairs)
    got = sorted(r.doc_id for r in neardup.drop_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [i for i, _ in rows if heads.get(i, i) == i]


def test_groups_of_long_chains(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 777)]
    got = {r.doc_id: r.head for r in neardup.groups(spark.createDataFrame(pairs, "doc_id_a bigint, doc_id_b bigint")).collect()}
    assert got == components(pairs)


def nearest_by_force(ids, m, asked, k):
    out = {}
    for i in asked:
        d = np.sqrt(((m - m[i]) ** 2).sum(1))
        d[ids == ids[i]] = np.inf
        out[int(ids[i])] = ids[np.lexsort((ids, d))[: min(k, (ids != ids[i]).sum())]].tolist()
    return out


def test_nearest_is_exact(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    ids, v = zip(*[(r.vec_id, np.array(r.embedding, float)) for r in rows.collect()])
    ids, m = np.array(ids), np.stack(v)
    for asked in (None, F.col("vec_id") % 3 == 0):
        got = {}
        for r in vafile.nearest(rows, asked, k=7, block_rows=90, query_rows=40).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.neighbor_id))
        want = nearest_by_force(ids, m, [i for i in range(len(ids)) if asked is None or ids[i] % 3 == 0], 7)
        assert {q: [n for _, n in sorted(x)] for q, x in got.items()} == want
        assert all(sorted(r for r, _ in x) == list(range(1, 8)) for x in got.values())


@pytest.mark.parametrize("offset,spread", [(0.0, 1.0), (1e4, 1.0), (1e6, 1.0), (1e6, 0.01), (1e5, 0.001), (1e7, 1.0), (1e8, 1.0), (0.0, 1e-9), (-1e9, 1e6)])
def test_bounds_hold_at_any_origin(offset, spread):
    r = np.random.default_rng(8)
    m = offset + spread * r.normal(size=(400, 16))
    m[7:12], m[:, 3] = m[7], offset  # ties, and a dimension without extent
    ids = r.permutation(400) * 5
    lo, step = m.min(0), (m.max(0) - m.min(0)) / 256
    code, want = vafile.cells(m, lo, step, 8), nearest_by_force(ids, m, range(400), 10)
    low, high = vafile.bounds(m, code, lo, step, 8)
    true = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
    assert (low <= true).all() and (true <= high).all()
    qi, j, low, _ = vafile.scan(ids, m, ids, code, lo, step, 10)
    assert len(qi) < 400 * 60
    for i in range(400):
        mine = qi == i
        n, d, _ = vafile.settle(m[i], low[mine], ids[j[mine]], m[j[mine]], 10)
        assert n.tolist() == want[ids[i]] and (np.diff(d) >= 0).all()


def test_few_exact_vectors_are_read():
    r = np.random.default_rng(0)
    v = r.normal(size=(3000, 16))
    lo, step = v.min(0), (v.max(0) - v.min(0)) / 256
    ids = np.arange(3000)
    qi, j, low, _ = vafile.scan(ids[:50], v[:50], ids, vafile.cells(v, lo, step, 8), lo, step, 10)
    reads = sum(vafile.settle(v[i], low[qi == i], ids[j[qi == i]], v[j[qi == i]], 10)[2] for i in range(50))
    assert len(qi) < 50 * 60 and reads < 50 * 40


def test_boundaries_are_optimal():
    r = random.Random(3)

    def cost(lengths, counts, cuts):
        return sum(k * (min(c for c in cuts if c >= x) - x) for x, k in zip(lengths, counts))

    from itertools import combinations

    for _ in range(60):
        m = r.randint(1, 8)
        lengths = sorted(r.sample(range(1, 60), m))
        counts = [r.randint(1, 20) for _ in lengths]
        b = r.randint(1, m)
        best = min(cost(lengths, counts, [*c, lengths[-1]]) for k in range(b) for c in combinations(lengths[:-1], k))
        assert cost(lengths, counts, packing.optimal_boundaries(np.array(lengths), np.array(counts), b)) == best


def test_batches_are_full_and_complete(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    for lane in (200_000, 50):
        monkeypatch.setattr(packing, "LANE_ROWS", lane)
        rows = packing.pack(df).toPandas()
        n = {r.doc_id: len((r.text or "").split()) for r in df.collect()}
        assert sorted(rows["doc_id"]) == sorted(i for i, k in n.items() if k) and (rows["n_tokens"] <= rows["bucket_len"]).all()
        for (_, length), part in rows.groupby(["bucket", "bucket_len"]):
            cap = max(1, packing.TOKEN_BUDGET // length)
            sizes = part.groupby("batch").size()
            assert sizes.index.tolist() == list(range(len(sizes))) and (sizes.iloc[:-1] == cap).all() and sizes.iloc[-1] <= cap
            assert not part.duplicated(["batch", "slot"]).any()


def test_targets_are_met(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.balance(df)
    rows = got.rates.toPandas()
    assert got.converged and got.iterations < 40
    rows["w"] = rows["n_tokens"] * rows["rate"]
    total = rows["n_tokens"].sum()
    for dim, power in mixing.TEMPERATURES.items():
        natural = rows.groupby(dim)["n_tokens"].sum() / total
        natural = natural[natural > 0]
        want = natural**power / (natural**power).sum()
        assert np.allclose((rows.groupby(dim)["w"].sum() / total).reindex(want.index), want, atol=1e-6)
    u = np.log2(rows["n_tokens"] + 1.0)
    assert abs((u * rows["w"]).sum() / rows["w"].sum() - (u * rows["n_tokens"]).sum() / total) < 1e-5
    assert ((rows["copies"] - rows["rate"]).abs() < 1).all()


def dense_rates(t, groups, targets, length):
    """Rates by Newton's method over one row a document and one column a constraint."""
    total = t.sum()
    u = np.log2(t + 1.0)
    mean = (t * u).sum() / total
    u = (u - mean) / np.sqrt((t * (u - mean) ** 2).sum() / total)
    cols, want = [], []
    for g, share in zip(groups, targets):
        for k, v in share.items():
            cols.append((g == k).astype(float))
            want.append(v)
    if length:
        cols.append(u)
        want.append(0.0)
    z, b, lam = np.column_stack(cols), np.array(want), np.zeros(len(cols))
    for _ in range(200):
        w = np.exp(z @ lam) * t / total
        lam -= 0.7 * np.linalg.lstsq(z.T @ (z * w[:, None]), z.T @ w - b, rcond=1e-12)[0]
    return np.exp(z @ lam)


def test_optimum_is_that_of_a_dense_solver(spark):
    r = np.random.default_rng(1)
    n = 90
    src, lang, t = r.choice(["a", "b", "c", "d"], n), r.choice(["x", "y", "z"], n), r.integers(1, 40, n)
    rows = [(i, " ".join(["w"] * int(t[i])), str(lang[i]), str(src[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    want = {"source": {"a": 0.4, "b": 0.3, "c": 0.2, "d": 0.1}, "lang": {"x": 0.5, "y": 0.3, "z": 0.2}}
    got = mixing.balance(df, want)
    assert got.met == "all" and got.residual < 1e-8
    rates = np.array([x.rate for x in got.rates.orderBy("doc_id").collect()])
    assert np.allclose(rates, dense_rates(t.astype(float), (src, lang), want.values(), True), rtol=1e-5)


def test_targets_that_cannot_be_met(spark):
    """Where the mean length can't be kept it is given up; where targets contradict each other the nearest rates come."""
    df = spark.createDataFrame([(1, "w " * 10, "x", "A"), (2, "w " * 1000, "x", "B")], "doc_id bigint, text string, lang string, source string")
    with pytest.warns(UserWarning, match="mean length"):
        got = mixing.balance(df, {"source": {"A": 0.9, "B": 0.1}})
    assert got.met == "targets" and got.converged and got.residual < 1e-6
    assert np.allclose([r.rate for r in got.rates.orderBy("doc_id").collect()], [90.9, 0.101], rtol=1e-6)
    df = spark.createDataFrame([(i, "w " * (5 + i % 3), "x" if i % 2 else "y", "A" if i % 2 else "B") for i in range(40)], "doc_id bigint, text string, lang string, source string")
    with pytest.warns(UserWarning, match="nearest"):
        got = mixing.balance(df, {"source": {"A": 0.9, "B": 0.1}, "lang": {"x": 0.5, "y": 0.5}})
    rows = got.rates.collect()
    share = sum(r.rate * r.n_tokens for r in rows if r.source == "A") / sum(r.n_tokens for r in rows)
    assert got.met == "nearest" and not got.converged and 0.15 < got.residual < 0.25 and 0.65 < share < 0.75
    assert all(0 < r.rate < 3 and r.copies in (0, 1, 2, 3) for r in rows)


def test_many_sources_need_no_dense_hessian(spark):
    """5,000 sources: their block of the Hessian is diagonal; the targets are met all the same."""
    rows = [(i, "w " * (1 + i * 7 % 13), "xyz"[i % 3], f"s{i % 5000}") for i in range(15_000)]
    got = mixing.balance(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"))
    assert got.met == "all" and got.residual < 1e-6


def test_gains_are_those_of_the_likelihood():
    """Each word to each class against recounting, words that follow themselves and border on their class included."""
    r = random.Random(5)
    text = [r.choice([r.randrange(1, 13), 3, 3, 7]) for _ in range(1500)]
    of, k = np.array([4, *[i % 4 for i in range(12)]]), 6
    counts = np.bincount(text, minlength=13)

    def value(of):
        m, cls = np.zeros((k, k), int), [k - 1, *of[text]]
        np.add.at(m, (cls[:-1], cls[1:]), 1)
        return brown.likelihood(m, counts, of), m

    base, m = value(of)
    words = np.arange(1, 13)
    left, right, twice = np.zeros((12, k)), np.zeros((12, k)), np.zeros(12)
    for i, w in enumerate(text):
        left[w - 1, of[text[i - 1]] if i else k - 1] += 1
        twice[w - 1] += i > 0 and text[i - 1] == w
        if i + 1 < len(text):
            right[w - 1, of[text[i + 1]]] += 1
    got = brown.gains(left, right, twice, of[words], m, 4)
    for w in words:
        for c in range(4):
            to = of.copy()
            to[w] = c
            assert abs(got[w - 1, c] - (value(to)[0] - base)) < 1e-6, (w, c)


def test_clustering_gains_as_much_as_one_word_at_a_time(spark):
    """Exchange in parallel half-rounds against the plain algorithm, which moves a word after recounting everything."""
    from sparkgrain.llm.common import arrow_map

    r = random.Random(11)
    kinds = [[f"{k}{i}" for i in range(9)] for k in "abcd"]
    rows = [(i, " ".join(r.choice(kinds[(j + r.randint(0, 1)) % 4]) for j in range(r.randint(5, 60)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    vocab = brown.vocabulary(df, "text")
    enc = arrow_map(df.select("doc_id", "text"), brown._encode(spark.sparkContext.broadcast(vocab)), "doc_id bigint, ids binary")
    texts, k = [np.frombuffer(x.ids, np.int32) for x in enc.collect()], 4 + 2
    before, after = np.concatenate([np.concatenate([[-1], x[:-1]]) for x in texts if len(x)]), np.concatenate(texts)

    def value(of):
        m = np.zeros((k, k))
        np.add.at(m, (np.where(before < 0, k - 1, of[before]), of[after]), 1)
        return brown.likelihood(m, vocab.counts, of)

    start = np.concatenate([[4], np.arange(len(vocab.counts) - 1) % 4])
    of, moved = start.copy(), True
    while moved:
        moved = False
        for w in range(1, len(of)):
            found = []
            for cl in range(4):
                to = of.copy()
                to[w] = cl
                found.append(value(to))
            if max(found) > found[of[w]] + 1e-9:
                of[w], moved = int(np.argmax(found)), True
    got = brown.cluster(enc, vocab, 4)
    assert abs(value(got.of) - got.log_likelihood) < 1e-6 * abs(got.log_likelihood)
    assert got.log_likelihood - value(start) > 0.9 * (value(of) - value(start)) > 0


def test_perplexity_matches_plain_python(spark):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice(["the", "a"]) + " " + r.choice(["cat", "dog", "cow"]) + " " + r.choice(["ran", "sat"]) for _ in range(r.randint(1, 30)))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    vocab = brown.vocabulary(df, "text", brown.MIN_SHARE)
    from sparkgrain.llm.common import arrow_map

    enc = arrow_map(df.select("doc_id", "text"), brown._encode(spark.sparkContext.broadcast(vocab)), "doc_id bigint, ids binary")
    found = brown.cluster(enc, vocab, 3, 4)
    trans, emit = brown.model(vocab, found)
    k = len(trans)
    for i in range(k - 1):
        assert abs(np.exp(trans[i]).sum() - 1) < 1e-6
    for c in set(found.of[1:].tolist()):
        assert abs(np.exp(emit[1:][found.of[1:] == c]).sum() - 1) < 1e-9
    ids = {r.doc_id: np.frombuffer(r.ids, np.int32) for r in enc.collect()}
    got = {r.doc_id: r for r in brown.perplexity(df, classes=3).collect()}
    for i, x in ids.items():
        cls = [k - 1, *found.of[x].tolist()]
        lp = sum(trans[a, b] for a, b in zip(cls[:-1], cls[1:])) + emit[x].sum()
        assert abs(got[i].log_prob - lp) < 1e-6 and got[i].n_tokens == len(x)
    mean = lambda of: -sum(got[i].log_prob for i in ids) / sum(len(x) for x in ids.values())
    assert mean(found) < 1.35  # log 12 / 3 is the text's own entropy, 0.83 a word; one class alone gives 1.9


def test_twice_said_words_keep_their_counts(spark):
    """A word said twice among 12 million tokens is clustered; a share of 2e-7 would ask for three times."""
    rows = [(i, "the cat " * 300_000) for i in range(10)] + [(90, "seldom"), (91, "seldom"), (92, "once")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    df = df.unionAll(df.where("doc_id < 10"))
    vocab = brown.vocabulary(df, "text", brown.MIN_SHARE)
    assert sorted(vocab.counts.tolist()) == [1, 2, 6_000_000, 6_000_000] and vocab.rare_types == 1


def test_exchange_goes_on_until_it_settles(spark):
    from sparkgrain.llm.common import arrow_map, written

    df = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 5 = 0")
    vocab = brown.vocabulary(df, "text", brown.MIN_SHARE)
    enc = written(arrow_map(df.select("doc_id", "text"), brown._encode(spark.sparkContext.broadcast(vocab)), "doc_id bigint, ids binary"), "test-ids")
    with pytest.warns(UserWarning, match="bound of 4 half-rounds"):
        few = brown.cluster(enc, vocab, 8, 4)
    settled = brown.cluster(enc, vocab, 8, brown.ROUNDS)
    assert settled.log_likelihood > few.log_likelihood


def test_joined_model_is_the_broadcast_one(spark):
    rows = copies(1, 4, 20)
    rows += [rows[0], (rows[1][0], rows[2][1]), (None, "w1 w2 zz w1 w2"), (900, None), (901, " ... "), (902, "w1"), (903, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.log_prob)
    a, b = (sorted(brown.perplexity(df, classes=6, rounds=4, broadcast_rows=m).collect(), key=key) for m in (4_000_000, 0))
    assert len(a) == len(b) == len(rows)
    for x, y in zip(a, b):
        assert (x.doc_id, x.n_tokens, x.perplexity is None) == (y.doc_id, y.n_tokens, y.perplexity is None)
        assert abs(x.log_prob - y.log_prob) < 1e-6 and (x.perplexity is None or abs(x.perplexity - y.perplexity) < 1e-6 * x.perplexity)


def test_filed_model_is_the_broadcast_one(spark, monkeypatch):
    """past the bound on broadcasts, words are looked up in a mapped file; only far beyond it do joins take over."""
    df = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 3 = 0")
    a = sorted(brown.perplexity(df, classes=6, rounds=4).collect(), key=lambda r: r.doc_id)
    n = len(brown.vocabulary(df, "text").hashes)
    monkeypatch.setattr(brown, "_joined", None)
    monkeypatch.setattr(brown, "FILED_PART", 256)
    b = sorted(brown.perplexity(df, classes=6, rounds=4, broadcast_rows=n // 8).collect(), key=lambda r: r.doc_id)
    assert n > 1000 and [(r.doc_id, r.n_tokens) for r in a] == [(r.doc_id, r.n_tokens) for r in b]
    assert all(abs(x.log_prob - y.log_prob) < 1e-6 for x, y in zip(a, b))


def test_changes_are_those_of_the_whole_count():
    r, k, size = np.random.default_rng(2), 6, 400
    key, n = np.unique(r.integers(0, size * size, 5000), return_counts=True)
    was, to = r.integers(0, k, size).astype(np.uint8), r.integers(0, k, size).astype(np.uint8)
    batch = pa.RecordBatch.from_arrays([pa.array([brown._packed(key, n)], pa.binary())], ["before"])
    held = lambda x: type("Held", (), {"value": x})
    counted = lambda job, m: np.bincount((b := next(job(iter([batch])))).column(0).to_numpy(), weights=b.column(1).to_numpy(), minlength=m * k * k).reshape(m, -1)
    base = counted(brown._transitions(held(was), k), 1)[0]
    for levels in (range(1), range(1, 5)):
        for level, change in zip(levels, counted(brown._changes(held((was, to)), k, levels), len(levels))):
            part = np.where((np.arange(size) >> 1) % (1 << level) == 0, to, was)
            assert (base + change == counted(brown._transitions(held(part), k), 1)[0]).all()


def test_classifier_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    kept = {r.doc_id: r.keep for r in quality.classify(docs, labels.where("doc_id % 2 = 0")).select("doc_id", "keep").collect()}
    held = labels.where("doc_id % 2 = 1").collect()
    good = [kept[r.doc_id] for r in held if r.quality == 1 and r.toxic == 0]
    bad = [kept[r.doc_id] for r in held if r.toxic == 1]
    junk = [kept[r.doc_id] for r in held if r.quality == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.2 and np.mean(junk) < 0.2


def test_sites_shrink_to_their_parents(spark):
    rows = [("a", "x", 2.0)] * 300 + [("a", "y", 2.0)] + [("b", "x", -2.0)] * 300 + [("c", "z", -2.0)]
    got = {(r.host, r.path): r for r in quality.site_shifts(spark.createDataFrame(rows, "host string, path string, odds double"), 0.5).collect()}
    assert got["a", "x"].path_rate > 0.8 > 0.2 > got["b", "x"].path_rate
    assert abs(got["a", "y"].path_rate - got["a", "x"].path_rate) < 0.1 and got["c", "z"].host_rate > got["b", "x"].host_rate


def test_site_rates_match_plain_numpy(spark):
    r = np.random.default_rng(3)
    rows = [(h, p, float(o)) for h, base in (("a", 2.0), ("b", -1.5), ("c", 0.3), ("d", 0.0)) for p, more in (("x", 0.8), ("y", -0.8), (None, 0.0)) for o in r.normal(base + more, 1.0, int(r.integers(1, 60)))]
    got = {(x.host, x.path): x for x in quality.site_shifts(spark.createDataFrame(rows, "host string, path string, odds double"), 0.5).collect()}
    p = np.array([1 / (1 + np.exp(-o)) for _, _, o in rows])
    total, rate = len(p), p.mean()

    def held(key):
        names = [key(x) for x in rows]
        return {k: (names.count(k), sum(v for n, v in zip(names, p) if n == k)) for k in set(names)}

    def strength(groups, mean):
        spread = sum(n * (s / n - mean(k)) ** 2 for k, (n, s) in groups.items())
        between = spread / total - rate * (1 - rate) * len(groups) / total
        return rate * (1 - rate) / between - 1

    hosts, sites = held(lambda x: x[0]), held(lambda x: x[:2])
    kh = strength(hosts, lambda _: rate)
    host_rate = {h: (s + kh * rate) / (n + kh) for h, (n, s) in hosts.items()}
    kp = strength(sites, lambda k: host_rate[k[0]])
    assert kh > 0 and kp > 0 and set(got) == set(sites)
    for k, (n, s) in sites.items():
        path_rate = (s + kp * host_rate[k[0]]) / (n + kp)
        assert abs(got[k].host_rate - host_rate[k[0]]) < 1e-9 and abs(got[k].path_rate - path_rate) < 1e-9
        assert abs(got[k].shift - (np.log(path_rate / (1 - path_rate)) - np.log(rate / (1 - rate)))) < 1e-9


def test_site_weight_is_the_best_of_a_grid(spark):
    r = np.random.default_rng(5)
    for true in (0.0, 0.4, 1.0):
        shift = {h: float(v) for h, v in zip("abcdef", r.normal(0, 2, 6))}
        rows = [(i, str(r.choice(list(shift))), None, float(r.normal(0, 1.5))) for i in range(900)]
        y = {i: int(r.random() < 1 / (1 + np.exp(-(o + true * shift[h])))) for i, h, _, o in rows}
        scored = spark.createDataFrame(rows, "doc_id bigint, host string, path string, odds double")
        sites = spark.createDataFrame([(h, None, s) for h, s in shift.items()], "host string, path string, shift double")
        lab = spark.createDataFrame([(i, v, 0, i % 3 == 0) for i, v in y.items()], "key bigint, q int, t int, held boolean")
        held = [(o, shift[h], y[i]) for i, h, _, o in rows if i % 3 == 0]

        def worth(w, held=held):
            z = np.array([o + w * s for o, s, _ in held])
            return sum(-np.log1p(np.exp(-v)) if q else -np.log1p(np.exp(v)) for v, (_, _, q) in zip(z, held)) - (w - 1) ** 2 / 2

        best = max(np.linspace(0, 1, 201), key=worth)
        assert abs(quality.site_weight(scored, sites, lab) - best) < 0.01


def test_templates_leave_what_varies(spark):
    r = random.Random(2)
    rows, want = [], {}
    for i in range(40):
        items = [r.choice(WORDS) + str(r.random()) for _ in range(r.randint(1, 6))]
        title, body = f"T{r.random()}", " ".join(r.choice(WORDS) + str(r.random()) for _ in range(9))
        rows.append((i, "http://s.example/p", f"<html><head><title>{title}</title></head><body><nav class=top>Home About</nav><h1>Site</h1><ul>{''.join(f'<li>{x}</li>' for x in items)}</ul><p class=body>{body}</p><footer>Copyright Us</footer></body></html>"))
        want[i] = [title, *items, *body.split()]
    for chunk in (1024, 10):
        df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
        rows_ = df.select("page_id", F.xxhash64("page_id", "url").alias("key"), F.lit("s.example").alias("host"), "html")
        made = template.deduce(rows_.select("key", "host", "html"), chunk_pages=chunk).first()
        import json

        t = json.loads(made.template)
        for i, _, html in rows:
            got = template.extract(*template.page_tokens(html), t)
            assert " ".join(x[2] for x in got).split() == want[i], (chunk, t)


def test_occurrence_vectors_in_plain_python():
    """Classes of a chunk against vectors counted token by token."""
    r = random.Random(4)
    pages = [[w for _ in range(r.randint(1, 4)) for w in ("<li> 0", "x 1", "</li> 0")] + r.sample(["a 0", "b 0", "c 0"], 3) + ["<f> 0"] * (i % 3 > 0) for i in range(30)]
    got = template.chunk_classes(np.arange(30), pages, 0.8)
    vector = {t: tuple(p.count(t) for p in pages) for t in {t for p in pages for t in p}}
    often = {t for t, v in vector.items() if sum(x > 0 for x in v) >= 12}
    assert set(got["token"]) == often
    for _, x in got.iterrows():
        v = vector[x["token"]]
        assert (x["pages"], x["met"], x["once"]) == (sum(k > 0 for k in v), sum(v), max(v) == 1)
        assert set(got[got["sig"] == x["sig"]]["token"]) == {t for t in often if vector[t] == v}
    li = got.set_index("token")
    assert [li.place[t] for t in ("<li> 0", "x 1", "</li> 0")] == [0, 1, 2]
    assert sum(li.place[t] >= 0 for t in "abc" for t in [f"{t} 0"]) == 1  # in no order, so one of them stands alone


def shop(r, i):
    """A page with a list of lists: departments, their goods, and prices."""
    rows, html = [], []
    for d in range(r.randint(1, 4)):
        name = f"dept{r.random()}"
        goods = [(f"good{r.random()}", f"{r.random()}") for _ in range(r.randint(1, 4))]
        rows += [(name,), *goods]
        html.append(f"<section class=d><h2>{name}</h2><ul>" + "".join(f"<li><b>{g}</b> costs <i>{p}</i></li>" for g, p in goods) + "</ul></section>")
    return f"<html><body><div class=top><h1>Shop</h1></div><div class=main>{''.join(html)}</div><div class=end><p>Bye {i}</p></div></body></html>", rows


@pytest.mark.parametrize("chunk", [1024, 12])
def test_classes_nest_in_nested_classes(spark, chunk):
    r = random.Random(6)
    pages = [shop(r, i) for i in range(60)]
    df = spark.createDataFrame([(i, "shop.example", html) for i, (html, _) in enumerate(pages)], "key bigint, host string, html string")
    import json

    t = json.loads(template.deduce(df, chunk_pages=chunk).first().template)
    depth = {}
    for k, x in enumerate(t["classes"]):
        depth[k] = 0 if x["in"] < 0 else depth[x["in"]] + 1
    assert max(depth.values()) == 2
    for i, (html, rows) in enumerate(pages):
        got = template.extract(*template.page_tokens(html), t)
        assert [x for x in " ".join(y[2] for y in got).split()] == [*[x for row in rows for x in row], str(i)]
        found = iter(got)
        dept = good = 0
        for row in rows:
            if len(row) == 1:
                dept, good = dept + 1, 0
                assert next(found)[1][0] == dept
            else:
                good += 1
                a, b = next(found), next(found)
                assert a[1][0] == b[1][0] == dept and a[1][2] == b[1][2] == good and a[1][3] < b[1][3]


def test_chunks_may_disagree_on_their_roots(spark):
    """In one chunk all pages have a part that others lack, so that its largest class isn't that of the host."""
    rows = []
    for i in range(48):
        more = "".join(f"<p class=m{j}>More{j}</p>" for j in range(6)) if i < 24 else ""
        rows.append((i, "h.example", f"<html><head><title>t{i}</title></head><body><h1>Top</h1>{more}<ul>{''.join(f'<li>item{i}x{j}</li>' for j in range(1 + i % 3))}</ul><hr class=e></body></html>"))
    df = spark.createDataFrame(rows, "key bigint, host string, html string")
    whole = [template.chunk_classes(np.array([k for k, _, _ in part]), [template.page_tokens(h)[0] for _, _, h in part], template.SUPPORT).assign(chunk=c) for c, part in enumerate((rows[:24], rows[24:]))]
    import pandas as pd

    got = template.assemble(pd.concat(whole), 48, 2)
    want = template.assemble(template.chunk_classes(np.arange(48), [template.page_tokens(h)[0] for _, _, h in rows], template.SUPPORT).assign(chunk=0), 48, 1)
    assert got == want and len(got["classes"]) >= 2 and df.count() == 48


def test_templates_outlive_empty_chunks(spark):
    html = "<html><head><title>T</title></head><body><h1>Site</h1><p class=a>Home</p><footer>Us</footer></body></html>"
    one = spark.createDataFrame([(5, "s.example", html)] * 13, "key bigint, host string, html string")
    null = spark.createDataFrame([(i, "s.example", None) for i in range(60)], "key bigint, host string, html string")
    want = template.deduce(one, chunk_pages=1024).first()
    assert want is not None
    for rows in (one, one.unionAll(null)):
        got = template.deduce(rows, chunk_pages=4).first()
        assert got is not None and (got.template, got.n_template) == (want.template, want.n_template)


def kept_blocks(shape, blocks):
    """Which blocks a scan of one component alone holds: those that the picture covers."""
    across, wide, high = shape
    keep = np.zeros((len(blocks) // across, across), bool)
    keep[:high, :wide] = True
    return keep.ravel()


@pytest.mark.parametrize("chroma", [1, 2])
@pytest.mark.parametrize("scans", [jpeg_source.SCANS, jpeg_source.SPECTRAL])
@pytest.mark.parametrize("size,restart,runs", [((41, 45), 0, True), ((16, 16), 0, False), ((9, 40), 3, True), ((33, 17), 1, True), ((100, 75), 7, False), ((1, 1), 0, True)])
def test_images_round_trip_and_agree_with_the_jvm(spark, chroma, scans, size, restart, runs):
    """Coefficients come back as they were written, and pixels as the JVM's decoder gives them."""
    r = np.random.default_rng(4)
    jvm = spark._jvm
    rgb = np.kron(r.integers(0, 255, (size[0] // 9 + 1, size[1] // 7 + 1, 3)), np.ones((9, 7, 1)))[: size[0], : size[1]].astype(np.uint8)
    rgb[: size[0] // 2] = 90  # flat blocks, for runs
    data = jpeg_source.encode(rgb, chroma, scans, restart, runs)
    blocks, shape = jpeg_source.quantised(rgb, chroma)
    _, comps, _, _ = jpeg.coefficients(data)
    for x, want, held in zip(comps, blocks, shape):
        got, want, covered = np.array(x.coef), np.array(want), kept_blocks(held, want)
        assert got.shape == want.shape and np.array_equal(got[:, 0], want[:, 0]) and np.array_equal(got[covered], want[covered])
    mine = jpeg.decode(data).astype(int)
    img = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    assert img is not None and (img.getHeight(), img.getWidth()) == mine.shape[:2] == size
    flat = np.array(list(img.getRGB(0, 0, img.getWidth(), img.getHeight(), None, 0, img.getWidth())), np.int64).reshape(mine.shape[:2])
    theirs = np.stack([flat >> 16 & 255, flat >> 8 & 255, flat & 255], -1)
    # chroma is upsampled by different filters, which shows at edges alone
    assert np.abs(mine - theirs).mean() < 1.5 and np.abs(mine - theirs).max() <= (4 if chroma == 1 else 40)
    assert data == jpeg_source.encode(rgb, chroma, scans, restart, runs)


def test_pictures_go_round_all_forms(spark):
    forms = [jpeg_source.written_as(i) for i in range(60)]
    assert len({f["height"] for f in forms}) == 32 and {f["restart"] for f in forms} == {0, 3} and {f["runs"] for f in forms} == {True, False} and {f["chroma"] for f in forms} == {1, 2}
    rows = [(i, np.random.default_rng(i).normal(size=64).tolist()) for i in range(1, 40)]
    got = jpeg.tensors(jpeg_source.pictures(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))).collect()
    assert len(got) == 39 and all(x.error is None and len(x.rgb) == 3 * x.height * x.width for x in got) and len({(x.height, x.width) for x in got}) > 15
