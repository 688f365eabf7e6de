"""Quality classifier: held-out accuracy, shrinkage and odd rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from llm.quality import fit, judge, op1_quality_classifier, site_rates

DOCS = "doc_id long, text string, lang string, source string, llr string, path string"


def corpus(n, seed=1):
    r = random.Random(seed)
    good = lambda: " ".join("".join(r.choice("etaoinshr") for _ in range(r.randrange(2, 9))) for _ in range(40)) + "."
    bad = lambda: " | ".join(r.choice(("xx", "%%", "##")) + str(r.randrange(99)) for _ in range(40))
    rows = []
    for i in range(n):
        y = int(r.random() < .8)
        rows.append((i, good() if y else bad(), "en", f"s{i % 3}" if i % 10 else f"rare{i}", "x", "y", y))
    return rows


def test_held_out_documents(spark):
    rows = corpus(400)
    docs = spark.createDataFrame([r[:6] for r in rows], DOCS)
    labels = spark.createDataFrame([(r[0], r[6], 0) for r in rows if r[0] % 2], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept__ for r in judge(docs, labels).select("doc_id", "kept__").collect()}
    unseen = [r for r in rows if r[0] % 2 == 0]
    assert len(got) == 400 and sum(got[r[0]] == bool(r[6]) for r in unseen) >= 0.97 * len(unseen)


def test_rates_shrink_sparse_sites(spark):
    counts = spark.createDataFrame([("a", "1", 1000.0, 900.0), ("a", "2", 1000.0, 100.0), ("b", "1", 1.0, 0.0), ("c", "1", 500.0, 480.0)],
                                   "host string, path string, n double, s double")
    rate = {(r.host, r.path): r.path_rate for r in site_rates(counts).collect()}
    assert rate["a", "1"] > 0.85 and rate["a", "2"] < 0.15 and 0.05 < rate["b", "1"] < 0.9 and rate["c", "1"] > 0.9


def test_odd_rows_and_no_labels(spark):
    rows = [(1, None, None, None, "", ""), (1, None, None, None, "", ""), (2, "", "en", "a", "", ""), (None, "some text", "en", None, "", ""), (3, "w " * 40_000, "en", "a", "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = judge(docs, none)
    assert got.count() == 5 and got.filter("kept__").count() == 5
    some = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    assert judge(docs, some).filter(F.col("score__").between(0, 1)).count() == 5
    assert judge(docs.limit(0), some).count() == 0


def test_one_class_gives_no_evidence():
    model = fit(np.ones((5, 3)), np.ones(5))
    assert not model["weight"].any() and model["odds"] == 0.0


def test_sample_tables(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = op1_quality_classifier(spark, d)
    assert got.count() == spark.read.parquet(f"{d}/documents.parquet").count()
    wrong = got.join(labels, "doc_id").filter("kept <> (quality = 1)").count()
    assert wrong <= 0.03 * labels.count()


def test_rates_and_scores_equal_the_formulas(spark):
    """Moments, shrunk rates and posteriors of some sites, computed row by row."""
    r = random.Random(8)
    rows = [(f"h{k % 5}", f"p{k % 3}", float(r.randrange(1, 400)), 0.0) for k in range(15)]
    rows = [(h, p, n, round(n * r.random(), 3)) for h, p, n, _ in {(h, p): (h, p, n, s) for h, p, n, s in rows}.values()]
    got = {(x.host, x.path): (x.host_rate, x.path_rate) for x in site_rates(spark.createDataFrame(rows, "host string, path string, n double, s double")).collect()}

    n_all, s_all = sum(n for *_, n, _ in rows), sum(s for *_, s in rows)
    mean = (s_all + 1) / (n_all + 1)

    def strength(groups):
        """Moment estimate of a prior's weight from (n, s) of groups."""
        ss = sum(n * (s / n - mean) ** 2 for n, s in groups)
        v = max((ss - len(groups) * mean * (1 - mean)) / max(sum(n for n, _ in groups), 1.0), 1e-7)
        return min(max(mean * (1 - mean) / v - 1, 1.0), 1e6)

    hosts = {}
    for h, _, n, s in rows:
        a, b = hosts.get(h, (0.0, 0.0))
        hosts[h] = (a + n, b + s)
    k_host, k_path = strength(list(hosts.values())), strength([(n, s) for *_, n, s in rows])
    for h, p, n, s in rows:
        rate = (hosts[h][1] + k_host * mean) / (hosts[h][0] + k_host)
        assert np.allclose(got[h, p], (rate, (s + k_path * rate) / (n + k_path)))
    docs = corpus(200, 3)
    labels = spark.createDataFrame([(r[0], r[6], 0) for r in docs if r[0] % 3], "doc_id long, quality int, toxic int")
    for x in judge(spark.createDataFrame([r[:6] for r in docs], DOCS), labels).collect():
        odds = x.llr__ + np.log(max(x.path_rate, 1e-6) / max(1 - x.path_rate, 1e-6))
        assert np.isclose(x.score__, 1 / (1 + np.exp(-odds)))
