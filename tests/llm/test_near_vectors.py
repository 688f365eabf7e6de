"""Sorted projection passes against comparing all vectors."""

import math

import numpy as np

from llm.near_vectors import near_vectors, op5_embedding_near_dedup, passes_for
from tests.conftest import SF_SMALL


def brute(rows, cosine=0.93):
    usable = [(k, i, label, np.array(v, float) / max(map(abs, v))) for k, (i, v, label) in enumerate(rows)
              if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    n = [0] * len(rows)
    for a, (k, _, label, x) in enumerate(usable):
        for j, _, other, y in usable[:a]:
            if label == other and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                n[k] += 1
                n[j] += 1
                root[find(k)] = find(j)
    least = {}
    for k, i, _, _ in usable:
        least[find(k)] = min(least.get(find(k), i), i)
    out = []
    for k, (i, _, _) in enumerate(rows):
        c = least.get(find(k), i)
        out.append((i, n[k], c, i is not None and i == c))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def test_sample_tables(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    assert rows_of(op5_embedding_near_dedup(spark, SF_SMALL)) == brute(rows)


def test_dense_groups_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows, centre = [], rng.standard_normal((6, 16))
    for i in range(400):
        c = centre[i % 6] if i % 3 else rng.standard_normal(16)
        rows.append((i, (c + rng.standard_normal(16) * .1).tolist(), i % 2))
    rows += [(1000 + i, rows[1][1], 1) for i in range(30)] + [rows[4], rows[4], (2000, [2 * x for x in rows[4][1]], 0)]
    rows += [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, rows[1][1][:8], 1), (3003, [math.nan] + [1.0] * 15, 1), (3004, [math.inf] * 16, 1),
             (3005, rows[1][1], None), (None, rows[1][1], 1), (3006, [], 1), (3007, [None] + [1.0] * 15, 1), (3008, [1e300] * 16, 1), (3009, [1e-300] * 16, 1)]
    df = spark.createDataFrame([(i, v, label, 1, 0) for i, v, label in rows], "vec_id long, embedding array<double>, label int, cls int, n int")
    want, got = brute(rows), rows_of(near_vectors(df))
    assert len(got) == len(want)
    links = sum(w[1] for w in want)
    assert sum(min(g[1], w[1]) for g, w in zip(got, want)) >= 0.9 * links and all(g[1] <= w[1] for g, w in zip(got, want))
    assert near_vectors(df.limit(0)).count() == 0


def test_passes_grow_slowly():
    assert passes_for(10) <= passes_for(10_000) < passes_for(10_000_000) < 100


def test_pairs_of_one_label_that_shares_a_direction(spark):
    rng = np.random.default_rng(11)
    shared = np.full(64, 0.125)

    def unit(x):
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    v = unit(2 * shared + unit(rng.standard_normal((6000, 64))))              # mean cosine 0.8
    w = rng.standard_normal((400, 64))
    w = unit(w - (w * v[:400]).sum(1, keepdims=True) * v[:400])
    v = np.concatenate([v, 0.935 * v[:400] + math.sqrt(1 - 0.935 ** 2) * w])
    near = v @ v.T >= 0.93
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(k, x.tolist(), "hot") for k, x in enumerate(v)], "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: r.n_links for r in near_vectors(df).select("vec_id", "n_links").collect()}
    assert all(got[k] <= n for k, n in enumerate(near.sum(1)))
    assert sum(got[k] > 0 for k in range(400)) >= 0.95 * 400
