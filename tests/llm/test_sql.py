"""Queries against their SQL, and the pipeline against its stages in plain Python."""

import math

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from sparkgrain.llm import mixing, packing, quality, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    rows = con.execute(queries.ORACLES[name])
    cols = [d[0] for d in rows.description]
    assert sorted(cols) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*cols).collect()), key=str) == sorted(rows.fetchall(), key=str)


def test_pipeline(spark):
    """Each stage on what its predecessor kept: decisions judged by the operators' results and by brute force."""
    from test_brute import components, grams

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    assert 4 <= len(stages) <= 5

    one = stages[0](spark, docs, SF).cache()
    judged = {r.doc_id: r.keep for r in quality.classify(docs, labels).collect()}
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(i for i, k in judged.items() if k)

    two = stages[1](spark, one, SF).cache()
    sets = {r.doc_id: grams(r.text) for r in one.collect()}
    ids = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])]
    head = components(pairs)
    assert pairs and sorted(r.doc_id for r in two.collect()) == [i for i in ids if head.get(i, i) == i]

    three = stages[2](spark, two, SF).cache()
    copies = {r.doc_id: r.copies for r in mixing.balance(two).rates.collect()}
    got = [r.doc_id for r in three.collect()]
    assert three.columns == docs.columns and {i: got.count(i) for i in set(got)} == {i: k for i, k in copies.items() if k}

    four = stages[3](spark, three, SF).toPandas()
    lengths = {r.doc_id: len(r.text.split()) for r in three.collect()}
    assert sorted(four["doc_id"]) == sorted(i for i in got if lengths[i])
    assert (four["n_tokens"] == four["doc_id"].map(lengths)).all() and not four.duplicated(["bucket", "batch", "slot"]).any()
    hist = np.unique(four["n_tokens"], return_counts=True)
    assert sorted(four["bucket_len"].unique()) == packing.optimal_boundaries(*hist, packing.BUCKETS)
    assert math.isclose(corpus_pipeline.run(spark, SF).count(), len(four))
