"""Sanitisation: base spans against the plain patterns, and words that disclose."""

import hashlib
import random
import re

from llm.privacy import base_spans, luhn, op3_pii, sanitise
from tests.conftest import SF_SMALL

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end(), "card") for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return [(s, k, e) for s, _, e, k in sorted(out)]


def test_base_spans_equal_the_patterns():
    r = random.Random(1)
    for _ in range(30_000):
        text = "".join(r.choice("ab@@..--  +(019123456é%") for _ in range(r.randrange(60)))
        assert base_spans(text) == brute(text), text
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def test_long_runs_take_linear_time():
    for piece in ("a", "1", "1.", "a@", "+1", "- ", "1 ", "@"):
        base_spans(piece * 200_000)


def test_sample_tables(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = op3_pii(spark, SF_SMALL).collect()
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        line = ",".join(f"{k}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in want) for x in ("email", "ip", "card", "phone")]
        assert set(line.split(",")) - {""} <= set(r.spans.split(","))


def test_words_that_give_an_entity_away(spark):
    mail = "jo.doe@mail.example.com"
    rows = [(k, f"text number{'abcdefgh'[k]} about the gardener Zebulon, {mail} and the rest ü", 1) for k in range(8)]
    rows += [(1000 + k, f"the rest is about a garden {'xyz'[k % 3]}{k}", 1) for k in range(900)]
    rows += [(200, "Zebulon. met the gardener", 1), (201, None, 1), (202, "", 1), (203, "x " * 50_000, 1), (None, "call Zebulon now", 1), (200, "Zebulon. met the gardener", 1)]
    got = {(r.doc_id, r.clean_text): r for r in sanitise(spark.createDataFrame(rows, "doc_id long, text string, n_email int")).collect()}
    first = next(r for r in got.values() if r.doc_id == 0)
    assert "<EMAIL>" in first.clean_text and "Zebulon" not in first.clean_text and "about the" in first.clean_text
    assert next(r for r in got.values() if r.doc_id == 200).n_term >= 1
    assert any(i is None and r.n_term == 1 for (i, _), r in got.items())
    assert all(r.n_term == 0 for r in got.values() if r.doc_id is not None and r.doc_id >= 1000)
    assert sanitise(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_account_names_short_names_and_apostrophes(spark):
    mail = "someone@mail.example.com"
    words = ("O'Neil", "Li", "ab-1234x7", "Jean-Luc")
    rows = [(k, f"intro{k} {' '.join(words)} wrote from {mail}, as text {k} says") for k in range(6)]
    rows += [(100 + k, f"nothing here but words {k} wrote from home as text says") for k in range(300)]
    rows += [(50, "Later O'Neil. and LI, met ab-1234x7; (Jean-Luc"), (51, f"{'x' * 700} O'Neil {mail}")]
    got = {r.doc_id: r for r in sanitise(_docs(spark, rows)).collect()}
    for k in range(6):
        assert not any(w in got[k].clean_text for w in words) and "<EMAIL>" in got[k].clean_text and f"intro{k}" in got[k].clean_text
    assert got[50].n_term == 3 and "O'Neil" not in got[50].clean_text and "met" in got[50].clean_text
    assert all(got[100 + k].spans == "" for k in range(300))


def test_neighbours_are_counted_by_place_beside_long_words(spark):
    """Eight words on either side, whatever their length; a ninth is none."""
    mail, long = "a.b@c.de", "u" * 3000
    rows = [(k, f"ninth{'xyz'[k % 3]} Zed {long} {long} {long} {long} {long} {long} {long} {mail} end{k}") for k in range(5)]
    rows += [(20 + k, f"plain words only {k}") for k in range(100)] + [(9, "Zed is here, ninthx too")]
    r = {x.doc_id: x for x in sanitise(_docs(spark, rows)).collect()}
    assert r[9].n_term == 1 and "ninthx" in r[9].clean_text and "Zed" not in r[9].clean_text


def test_posteriors_equal_counting_by_hand(spark):
    from llm.privacy import BITS, GENERALISE_FROM, NEAR, TEXTS, disclosing_words
    import math
    from collections import defaultdict
    r = random.Random(9)
    mails = ["p@q.org", "r.s@t.net", "u@v.com"]
    names = [f"n{k}" for k in range(30)]
    rows = []
    for k in range(1200):
        own = [r.choice(names) for _ in range(r.randrange(1, 14))]
        if r.random() < 0.06:
            m = r.randrange(3)
            own.insert(r.randrange(len(own) + 1), mails[m] + r.choice(["", ",", "."]))
            own.insert(r.randrange(len(own) + 1), f"K{m}" + r.choice(["", "!"]))
        rows.append((k, " ".join(own)))
    rows += rows[:40]
    core = lambda w: w.rstrip(".,;:!?").lower()
    both, holds, has = defaultdict(list), defaultdict(set), defaultdict(int)
    for _, text in rows:
        w = text.split()
        for x in {core(x) for x in w if "@" not in x}:
            has[x] += 1
        met = set()
        for i, x in enumerate(w):
            if "@" in x:
                e = f"email:{core(x)}"
                holds[e].add(text)
                met |= {(e, core(y)) for y in w[max(0, i - NEAR): i] + w[i + 1: i + 1 + NEAR] if "@" not in y}
        for p in met:
            both[p].append(text)
    want = {}
    for (e, t), texts in both.items():
        p = min(1.0, len(texts) / has[t])
        bits = math.log2(p * len(rows) / len(holds[e]))
        if len(set(texts)) >= TEXTS and p >= GENERALISE_FROM and bits >= BITS:
            want[t] = max(want.get(t, 0.0), p)
    got = {x.term: x.posterior for x in disclosing_words(_docs(spark, rows)).collect()}
    assert want and got == want


def test_word_lists_of_several_blocks(spark, monkeypatch):
    from llm import privacy
    rows = [(k, f"acct{k % 7}zq number{k} mail u{k % 7}@site.org of text{k}") for k in range(70)] + [(200 + k, f"plain {k} acct{k}zq") for k in range(400)]
    rows += [(None, "acct1zq"), (201, "acct1zq"), (201, "acct1zq")]
    key = lambda r: (r.doc_id or -1, r.spans, r.clean_text)
    one = sorted(map(key, sanitise(_docs(spark, rows)).collect()))
    monkeypatch.setattr(privacy, "WORDS_A_PASS", 2)
    assert sorted(map(key, sanitise(_docs(spark, rows)).collect())) == one
    assert any("term" in s for _, s, _ in one)


def test_secrets(spark):
    token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [f'token = "{token}"', f'TOKEN = "{token.upper()}"', "a" * 60 + "1" * 30, "12345678901234567890123", "Internationalisierungsbemuehungen 2024",
             f"{token}@mail.example.com", "id 550e8400e29b41d4a716446655440000."]
    got = [r for r in sorted(sanitise(_docs(spark, list(enumerate(texts)))).collect())]
    assert [r.n_secret for r in got] == [1, 1, 0, 0, 0, 0, 1]
    assert got[0].spans == f"secret:9:{9 + 40}" and got[0].clean_text == 'token = "<SECRET>"' and got[5].spans.startswith("email:0:")
    assert got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
