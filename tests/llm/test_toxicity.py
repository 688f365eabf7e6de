"""Conditional random field: exact marginals, held-out accuracy and odd rows."""

import itertools
import random

import numpy as np

from llm.toxicity import _lattice, held_out, marginals, op8_toxicity, score
from pyspark.sql import functions as F


def test_marginals_equal_summing_all_taggings():
    r = np.random.default_rng(1)
    s, move = r.standard_normal((3, 6)), r.standard_normal(4)
    got = _lattice(s, np.array([6, 6, 6]), move)
    for row in range(3):
        total, toxic = 0.0, np.zeros(6)
        for tags in itertools.product((0, 1), repeat=6):
            w = np.exp(sum(s[row, t] for t in range(6) if tags[t]) + sum(move[2 * tags[t - 1] + tags[t]] for t in range(1, 6)) + move[tags[0]])
            total += w
            toxic += w * np.array(tags)
        assert np.allclose(got[row], toxic / total)
    assert len(marginals(np.zeros(0), np.zeros(3, np.int64), move)) == 0


def test_spans_scores_and_odd_rows(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("etaoinshrlu") for _ in range(r.randrange(2, 8)))
    rows, labels = [], []
    for i in range(900):
        w = [word() for _ in range(r.randrange(20, 400))]
        toxic = r.random() < .2
        for _ in range(4 if toxic else 0):
            w[r.randrange(len(w))] = r.choice(("scumbag", "wretchö", "Vermin,", "vermink"))
        rows.append((i, " ".join(w), 1.0))
        if i % 3:
            labels += [(i, int(toxic), 1)]
    rows += [(2000, None, 1.0), (2001, "", 1.0), (None, "ü scumbag!  x", 1.0), (2002, "the word " * 30_000, 1.0), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5000, None, 0)], "doc_id long, toxic int, quality int")
    got = score(docs, lab).collect()
    assert len(got) == len(rows) and all(0 <= g.score <= 1 for g in got)
    truth = {i: any(x in t for x in ("scumbag", "wretch", "ermin")) for i, t, _ in rows if i is not None and i < 900}
    unseen = [g for g in got if g.doc_id in truth and (g.held_out or g.doc_id % 3 == 0)]
    assert sum(bool(g.predicted) == truth[g.doc_id] for g in unseen) >= 0.95 * len(unseen)
    assert next(g for g in got if g.doc_id is None).spans == "2:10"
    assert all(g.predicted == 0 and g.spans == "" for g in got if g.doc_id in (2000, 2001))
    assert len({g.score for g in score(docs, lab.limit(0)).collect()}) >= 1 and score(docs.limit(0), lab).count() == 0
    kept = spark.createDataFrame([(k,) for k in range(50)], "doc_id long").select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()
    import zlib
    assert all(x.h == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in kept)


def test_sample_tables(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = op8_toxicity(spark, d).join(labels, "doc_id").filter("held_out").collect()
    tp = sum(g.predicted and g.toxic for g in got)
    assert tp >= 0.7 * sum(g.toxic for g in got) and tp >= 0.8 * sum(g.predicted for g in got)


def test_chains_go_on_over_pieces():
    """A long text is one chain: pieces side by side give the marginals of a single pass over the whole."""
    r = np.random.default_rng(4)
    move = np.array([2.0, -2.0, -1.5, 1.5])
    length = np.array([1, 0, 127, 128, 129, 256, 1000, 3000])
    first = np.concatenate([[0], np.cumsum(length)])
    s = r.standard_normal(first[-1]) * 2 - 0.5
    got = marginals(s, first, move)
    for d, n in enumerate(length):
        if n:
            assert np.allclose(got[first[d]: first[d + 1]], _lattice(s[None, first[d]: first[d + 1]], np.array([n]), move)[0])


def test_a_toxic_run_across_the_end_of_a_piece():
    move = np.array([3.0, -3.0, -3.0, 3.0])
    s = np.full(400, -2.0)
    s[120:136] = 1.0                                   # words 120 .. 135 lean to toxic, over word 128
    s[130] = -0.5
    p = marginals(s, np.array([0, 400]), move)
    assert (p[121:135] > 0.5).all() and (p[:110] < 0.1).all() and (p[150:] < 0.1).all()
    shifted = marginals(np.roll(s, 40), np.array([0, 400]), move)
    assert np.allclose(np.roll(p, 40)[60:380], shifted[60:380], atol=1e-6)
