"""De Bruijn substring dedup against looking at every window."""

import hashlib
import random
import re

from llm.debruijn import digest, op9_substring_dedup
from tests.conftest import SF_SMALL


def brute(rows, window=50):
    split = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    least = {}
    for i, w in split:
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k:k + window])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k:k + window])] < i:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def test_sample_tables(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert rows_of(op9_substring_dedup(spark, SF_SMALL)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_shared_passages_branches_loops_and_odd_rows(spark):
    r = random.Random(5)
    word = lambda: f"w{r.randrange(400)}"
    passages = [[word() for _ in range(r.choice((12, 49, 50, 51, 80, 140)))] for _ in range(8)]
    rows = [(None, " ".join(passages[3])), (1, None), (2, ""), (3, " \n "), (4, "a " * 300), (5, "a " * 120), (6, "a b " * 90), (7, "a b " * 60)]
    for i in range(10, 70):
        w = []
        for _ in range(r.randrange(1, 6)):
            w += r.choice(passages)[r.choice((0, 0, 3)):] if r.random() < .6 else [word() for _ in range(r.randrange(1, 60))]
        rows.append((i, r.choice((" ", "\n", "  \t")).join(w)))
    rows += [(10, rows[12][1]), rows[13], rows[13], (100, rows[14][1]), (101, rows[14][1] + " end"), (102, "start " + rows[14][1])]
    r.shuffle(rows)
    df = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id long, text string, at int, node string")
    assert rows_of(digest(df)) == brute(rows)
    assert rows_of(digest(df, window=12, node=5)) == brute(rows, 12)
    assert digest(df.limit(0)).count() == 0


def test_very_long_texts(spark):
    """Texts longer than a slice, one inside the other."""
    words = [f"w{k * 7919 % 65537}" for k in range(300_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[1000:2000]) + " end"), (3, " ".join(words[::-1])), (4, " ".join(words))]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # The reversed text shares no window with the first.
    assert got == {1: (300_000, 0), 2: (1001, 1000), 3: (300_000, 0), 4: (300_000, 300_000)}
