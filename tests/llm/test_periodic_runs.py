"""Periodic runs against the definition, tried for every period."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm.periodic_runs import no_mismatch, op12_periodic_runs, periodic_runs, runs_of
from tests.conftest import SF_SMALL


def brute(w):
    """{(start, length, period)}: maximal stretches of every period, the smallest period of each."""
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(6, 4 * q):
                out.setdefault((i, length), q)
            i = max(i + 1, j)
    return sorted((s, length, q) for (s, length), q in out.items())


def kept(w, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def planted(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def digest(doc_id, text):
    w = planted(doc_id, text)
    runs = brute(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept(w, runs)), len(w))


def as_rows(found):
    return sorted((int(s), int(e - s), int(q)) for s, e, q in found)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90), st.integers(1, 30), st.integers(0, 150))
def test_runs_of_random_words(w, period, tail):
    w = np.array(w + [w[k % min(period, len(w))] for k in range(tail)] if w else w, np.int64)
    assert as_rows(runs_of(w)) == brute(w.tolist())


@pytest.mark.parametrize("word", ["a", "ab", "aab", "abaab", "abcabcabd"])
def test_powers_and_broken_powers(word):
    for times in (4, 5, 8, 33, 200):
        whole = word * times
        for w in (whole, "x" + whole + "yz", whole[:-1] + "q" + whole[1:], whole + whole[::-1] + "z" * 7):
            codes = np.array([ord(c) for c in w], np.int64)
            assert as_rows(runs_of(codes)) == brute(w)


def test_transform_is_exact():
    rng = np.random.default_rng(5)
    for b, reach, most in ((2, 3, 5), (8, 11, 2), (64, 80, 1 << 20), (256, 300, 3)):
        windows = rng.integers(0, most, (20, b + reach - 1)).astype(np.uint64)
        windows[5:] = windows[5:] % 2
        blocks = windows[:, :b]
        want = np.array([[bool((x[:b] == x[d: d + b]).all()) for d in range(reach)] for x in windows])
        assert (no_mismatch(blocks, windows) == want).all()


def test_sample_tables(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in op12_periodic_runs(spark, SF_SMALL).collect())
    assert got == sorted(digest(r.doc_id, r.text) for r in docs)
    assert sum(r[1] for r in got) > 10


def test_odd_rows(spark):
    texts = [None, "", " \t\n", "a", "a a a a a a", "a  a\na a a", "é É é É é É é É", "x y " * 30000, "w", "tick tock\x0b" * 9 + "end",
             " ".join(str(k) for k in range(30000)), "　 　 　 　 　 　"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "b b b b b b b"), (None, None), (3, "a"), (3, "c c c c c c")]
    df = spark.createDataFrame([(i, t, "r", 1) for i, t in rows], "doc_id long, text string, runs string, w int")
    got = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(df).collect())
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = brute(w) if len(w) < 3000 else [(0, len(w), 2)] if w[0] == "x" else []
        want.append((i or 0, len(w), runs, kept(w, runs)))
    assert got == sorted(want)
    assert periodic_runs(df.limit(0)).count() == 0
