"""Alignment against plain loops over the tokens of both tokenizers."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm.token_align import Tokens, _frames, _run, _with_best, align, merged, op13_token_alignment, pairs, token_groups
from tests.conftest import SF_SMALL

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def plain_sides():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in printable)}
    b = sentencepiece.SentencePieceProcessor(model_file=B)

    def bytes_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    return (lambda t: [(i, bytes(letter[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids],
            lambda t: [(i, bytes_b(i)) for i in b.encode(t)])


def brute(rows):
    """Sorted digest rows, groups as text and {(b, a): links} by walking the tokens."""
    enc_a, enc_b = plain_sides()
    docs, count = [], Counter()
    for i, text in rows:
        x, y = (enc_a(text), enc_b(text)) if text else ([], [])
        want = (" " + text).encode() if text else b""
        if b"".join(t for _, t in x) != want or b"".join(t for _, t in y) != want:
            x = y = []
        ends = []
        for side in (x, y):
            at, own = 0, defaultdict(list)
            for k, t in side:
                at += len(t)
                own[at].append(k)
            ends.append(own)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        links = [(b, a) for c in cuts for a in ends[0][c] for b in ends[1][c]]
        count.update(links)
        groups, low = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(k) for e in sorted(own) if low < e <= c for k in own[e]) for own in ends))
            low = c
        docs.append((i, len(x), len(y), len(cuts), links, ";".join(groups)))
    most = defaultdict(int)
    for (b, _), n in count.items():
        most[b] = max(most[b], n)
    key = lambda r: (r[0] is None, r)
    out = [(i, na, nb, g, len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links),
            hashlib.sha256(s.encode()).hexdigest() if s else "") for i, na, nb, g, links, s in docs]
    return sorted(out, key=key), [(i, s) for i, *_, s in docs], count


ODD = [None, "", " ", "  ", "\n", "a", "<|endoftext|> and <s> </s> <unk>", "café naïve 中文 \U0001f600\U0001f600", "▁low", "tab\tand\x0bvt\x00nul",
       "é    x ﬁ Ａ", "a" * 5000, "word " * 3000, "don't we'll I'VE 1234567 x1y2", "²¼ªº­ ٠١", "  lead and trail  ", "\x85\x1c\x1d"]


def test_sample_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in op13_token_alignment(spark, SF_SMALL).collect())
    assert got == brute(rows)[0]


@pytest.mark.parametrize("spill, fan, parts", [(1 << 21, 64, 1), (400, 3, 5), (50, 2, 3)])
def test_odd_rows_in_sets_of_any_size(spark, spill, fan, parts):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "null id"), (None, None), (3, "a b c"), (3, "a b c")] + [(100 + k, "a hot line, " * k) for k in range(40)]
    random.Random(7).shuffle(rows)
    want, groups, count = brute(rows)
    df = spark.createDataFrame([(i, t, "x", 2) for i, t in rows], "doc_id long, text string, a string, radix int").repartition(parts)
    found, totals = align(df, A, B, spill, fan)
    assert sorted((tuple(r) for r in found.collect()), key=lambda r: (r[0] is None, r)) == want
    got = pairs(totals).collect()
    assert {(r.b, r.a): r.links for r in got} == count and len(got) == len(count)
    assert {r.b for r in got if r.best} == {b for b, _ in count}
    if parts == 1:
        text = sorted((-1 if r.doc_id is None else r.doc_id, r.groups) for r in token_groups(df, A, B).collect())
        assert text == sorted((-1 if i is None else i, s) for i, s in groups)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    found, totals = align(df, A, B)
    assert found.count() == 0 and pairs(totals).count() == 0


def test_both_encoders_of_the_byte_level_file_agree(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(A)
    plain.encode_special_tokens = True
    rng = random.Random(3)
    letters = [chr(c) for c in [*range(9, 14), *range(32, 127), *range(0xa1, 0x250)]]
    texts = ["".join(rng.choices(letters, k=60)) for _ in range(3000)] + [f"x{a}{b} y" for a in letters for b in " a1'\n"]
    texts += [t for t in ODD if t]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r.text]
    want = [x.ids for x in plain.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert Tokens(A).encode(texts) == want


def test_heap_merge_of_runs_and_best(monkeypatch):
    import llm.token_align as t

    monkeypatch.setattr(t, "FRAME", 7)
    rng = np.random.default_rng(2)
    runs, want = [], Counter()
    for _ in range(20):
        keys = np.unique(rng.integers(0, 12, rng.integers(0, 60)).astype(np.uint64) << np.uint64(16) | rng.integers(0, 30, 1).astype(np.uint64))
        keys = np.unique(np.concatenate([keys, (rng.integers(0, 12, 40).astype(np.uint64) << np.uint64(16)) | rng.integers(0, 30, 40).astype(np.uint64)]))
        sums = rng.integers(1, 9, len(keys))
        want.update(dict(zip(keys.tolist(), sums.tolist())))
        runs.append(_run(keys, sums))
        assert [k for f, _ in _frames(runs[-1]) for k in f.tolist()] == keys.tolist()
    got = [x for part in _with_best(merged(runs)) for x in zip(*(p.tolist() for p in part))]
    assert [(k, n) for k, n, _ in got] == sorted(want.items())
    most = defaultdict(int)
    for k, n in want.items():
        most[k >> 16] = max(most[k >> 16], n)
    assert all(best == (n == most[k >> 16]) for k, n, best in got)
