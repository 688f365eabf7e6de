"""The pipeline, each stage held against plain versions on its own input."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline as P
from llm.mixture import targets
from tests.conftest import SF_SMALL
from tests.llm.test_mixture import words
from tests.llm.test_ngram_join import brute as classes


def rows_of(df):
    return sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    assert [len(x) for x in P.STAGES] == [2] * 5
    seen = [docs]
    for _, stage in P.STAGES[:-1]:
        seen.append(P.save(stage(spark, seen[-1], SF_SMALL), "test"))
        assert seen[-1].columns == docs.columns
    first, good, apart, clean, mixed = map(rows_of, seen)
    # Quality: all labelled good rows stay, most labelled bad ones go.
    kept = {r[0] for r in good}
    assert all(i in kept for i, q in labels.items() if q == 1)
    assert sum(i in kept for i, q in labels.items() if q == 0) <= 0.3 * sum(q == 0 for q in labels.values())
    # Near duplicates: one of each component.
    component = classes([(r[0], r[1]) for r in good])
    assert [r for r in good if component[r[0]][1] == r[0]] == apart
    # Benchmark: what holds a whole item goes, and nothing else here.
    assert [r for r in apart if not any(i in " ".join(r[1].split()) for i in items)] == clean
    # Mixing: whole documents, once or twice, near the targets.
    times = {r[0]: 0 for r in clean}
    for r in mixed:
        times[r[0]] += 1
    assert set(mixed) <= set(clean) and max(times.values()) <= 2
    sizes, taken = {}, {}
    for r in clean:
        sizes[r[3]] = sizes.get(r[3], 0) + words(r[1])
        taken[r[3]] = taken.get(r[3], 0) + words(r[1]) * times[r[0]]
    goal = targets(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes))}, 1.5 * sum(sizes.values()))
    assert all(abs(taken[s] - goal[s]) <= max(words(r[1]) for r in clean if r[3] == s) for s in sizes)
    # Tokens: the ids of the documents that came through, in order.
    t, at, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for r in mixed:
        ids = np.array(t.encode(r[1], add_special_tokens=False).ids + [2], "<u4")
        want.append((r[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = P.STAGES[-1][1](spark, seen[-1], SF_SMALL)
    assert sorted(map(tuple, got.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


def test_registered():
    q = E.queries()
    assert "pipeline" in q and all(sum(name.startswith(f"op{n}_") for name in q) == 1 for n in range(1, 14))


def test_odd_documents(spark, tmp_path):
    """Null ids and texts, one id for different texts, rows that repeat, a text in two forms, an empty table: the run ends, and clean rows stay."""
    import shutil
    d = tmp_path / "sf"
    d.mkdir()
    for t in ("labels", "benchmark"):
        shutil.copy(f"{SF_SMALL}/{t}.parquet", d)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    text = next(r.text for r in docs.orderBy("doc_id").collect() if r.text and len(r.text) > 2000)
    clean = [" ".join(f"{w}{k}" for w in text.split()[:120]) for k in range(4)]
    odd = [(None, clean[0], "en", "src1", 1), (900001, None, None, None, None), (900002, clean[1], "en", "src1", 2), (900002, clean[2], "en", "src1", 2),
           (900003, clean[3], "en", None, 3), (900003, clean[3], "en", None, 3), (900004, "", "en", "src2", 0)]
    more = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    more.write.parquet(str(d / "documents.parquet"))
    stages = dict(P.STAGES)
    apart = P.save(stages["n-gram Jaccard join"](spark, more, str(d)), "test")
    kept = {(r.doc_id, r.text) for r in apart.filter("doc_id >= 900000 OR doc_id IS NULL").collect()}
    assert kept == {(i, t) for i, t, *_ in odd}
    assert apart.filter("doc_id = 900003").count() == 1
    out = P.run(spark, str(d))
    assert out.filter("n_tokens < 1").count() == 0 and out.count() > 0
    (d / "empty").mkdir()
    for t in ("labels", "benchmark"):
        shutil.copy(f"{SF_SMALL}/{t}.parquet", d / "empty")
    docs.limit(0).write.parquet(str(d / "empty" / "documents.parquet"))
    assert P.run(spark, str(d / "empty")).count() == 0
