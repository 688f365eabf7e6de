"""Mixing sources: targets, flow and selection."""

import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from llm.mixture import _taken, mix_sources, mixing_stage, op6_mixing_sources, route, targets


def test_targets_reshare_the_excess():
    got = targets({"a": 10, "b": 100, "c": 1000}, {"a": 3, "b": 1, "c": 2}, 600.0)
    assert got["a"] == 20 and got["b"] == pytest.approx(580 / 3) and got["c"] == pytest.approx(1160 / 3)
    assert targets({"a": 1, "b": 1}, {"a": 3, "b": 1}, 100.0) == {"a": 2.0, "b": 2.0}


def test_flow_costs_the_least():
    """Integral small cases against every way to share the rounds."""
    r = random.Random(4)
    for _ in range(60):
        supply = [(("a",), r.randrange(3)), (("b",), r.randrange(3)), (("a", "b"), r.randrange(3))]
        quota = {"a": r.randrange(5), "b": r.randrange(5)}
        flow = route(supply, quota)
        for (_, n), rounds in zip(supply, flow):
            assert all(sum(x.values()) <= n + 1e-6 for x in rounds)
        got = {s: sum(x.get(s, 0) for rounds in flow for x in rounds) for s in quota}
        cost = sum(k * k * sum(x.values()) for rounds in flow for k, x in enumerate(rounds))
        best = None
        units = [(m, k) for m, n in supply for k in range(2) for _ in range(n)]
        for give in itertools.product(*[[None, *m] for m, _ in units]):
            have = Counter(give)
            if all(have[s] <= quota[s] for s in quota):
                score = (-sum(have[s] for s in quota), sum(k * k for (_, k), g in zip(units, give) if g))
                best = score if best is None or score < best else best
        if len(units) <= 8:
            assert (-round(sum(got.values())), round(cost)) == best


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def check(rows, taken):
    """Sizes, targets and closeness by source; rows: (doc_id, text, source)."""
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = targets(dict(sizes), {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(sizes.values()))
    got, largest = defaultdict(int), defaultdict(int)
    for r in taken:
        assert r.taken in (0, r["size"], 2 * r["size"]) and r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
        got[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for s in sizes:
        assert abs(got[s] - goal[s]) <= largest[s] + 1


def test_sources_come_near_their_targets(spark):
    r = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(r.randrange(1, 60))), r.choice(("a", "a", "a", "b", "ß", None, "c"))) for i in range(900)]
    rows += [(1, None, "a"), (2, "", "b"), (3, "x " * 3000, "c"), (None, "one two", "b"), rows[0], rows[0], (4, "", "only empty")]
    df = spark.createDataFrame([(*x, 5) for x in rows], "doc_id long, text string, source string, size long")
    out = lambda: _taken(*mix_sources(df)).select("doc_id", "source", F.col("size__").alias("size"), F.col("source_size__").alias("source_size"),
                                                  F.col("target__").alias("target"), (F.col("size__") * F.col("times__")).alias("taken")).collect()
    first = out()
    assert len(first) == len(rows)
    check(rows, first)
    assert sorted(map(str, first)) == sorted(map(str, out()))
    again = _taken(*mix_sources(df)).select(F.sum("times__")).first()[0]
    assert mixing_stage(spark, df, "").count() == again


def test_shared_documents_and_empty_table(spark):
    rows = [(i, "w " * 10, "a", ["a"] if i % 2 else ["a", "b"]) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, members array<string>")
    taken = _taken(*mix_sources(df, F.col("members"))).groupBy(F.size("members").alias("k")).agg(F.sum(F.col("size__") * F.col("times__")).alias("t")).collect()
    assert abs(sum(r.t for r in taken) - 1500) <= 10
    assert mixing_stage(spark, df.limit(0).select("doc_id", "text", "source"), "").count() == 0


def test_targets_of_very_many_sources(spark):
    """200,000 sources: shares by steps over a table equal those of a list; each group of sources is a task of its own."""
    from llm.mixture import source_targets
    r = random.Random(6)
    sizes = {f"0s{k:06d}": r.randrange(0, 500) for k in range(200_000)}
    table = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {x.source: x.target for x in source_targets(table, (3, 1, 2), 1.5 * sum(sizes.values())).toLocalIterator()}
    want = targets(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes))}, 1.5 * sum(sizes.values()))
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_a_source_for_each_document(spark):
    rows = [(k, "w " * (1 + k % 7), f"site{k}") for k in range(3000)] + [(9000 + k, "v " * 4, None) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = _taken(*mix_sources(df)).select("doc_id", "source", F.col("size__").alias("size"), F.col("source_size__").alias("source_size"),
                                            F.col("target__").alias("target"), (F.col("size__") * F.col("times__")).alias("taken")).collect()
    assert len(taken) == len(rows)
    check(rows, taken)


def test_the_query_goes_through_the_flow(monkeypatch):
    import pandas as pd
    from llm import mixture
    calls = []
    plain = mixture.route
    monkeypatch.setattr(mixture, "route", lambda *a: calls.append(a) or plain(*a))
    out = mixture._planned(pd.DataFrame({"pattern__": ["0a", "0b", "0a\x010b", "0a\x010b"], "source": ["0a", "0b", "0a", "0b"],
                                         "words": [10, 10, 30, 30], "target": [35.0, 25.0, 35.0, 25.0], "group": "0a"}))
    assert calls and dict(zip(out["pattern__"], out["full"])) == {"0a": 1, "0b": 1, "0a\x010b": 1} and abs(out["rest"].sum() - 10) < 1e-3


def test_sample_tables(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    check(rows, op6_mixing_sources(spark, d).join(docs.select("doc_id", "source"), "doc_id").collect())
