"""Benchmark decontamination: re-parameterised items, inconsistent slots, decoys and odd rows."""

from llm import decontaminate
from llm.decontaminate import leaks, op4_benchmark_decontamination

ITEM = "In a field Zoe has 3 apples and 5 g of rice, while Zoe eats 3 pears per day."


def pairs(spark, docs, items=((9, ITEM),)):
    d = spark.createDataFrame([(i, t, 7, "h") for i, t in docs], "doc_id long, text string, item_id long, hash string")
    return sorted((r.doc_id, r.item_id) for r in leaks(d, spark.createDataFrame(list(items), "item_id long, text string")).collect())


def test_slots(spark):
    docs = [(1, "x In a field Anna has 12 apples and 4 kg of rice, while Anna eats 12 pears per day. end"),
            (2, ITEM.replace("Zoe", "Bob").replace("3", "7").replace("5 g", "9 lb")),
            (3, "In a field Bob has 7 apples and 9 lb of rice, while Carl eats 8 pears per day."),       # one value, two fillings
            (4, "He has 3 apples and 5 g of rice, and that is all there is to say about it."),           # too little
            (5, "before " * 30_000 + ITEM), (6, None), (7, ""), (None, ITEM), (2, ITEM), (2, ITEM)]
    assert pairs(spark, docs) == [(1, 9), (2, 9), (5, 9)]


def test_odd_items_and_passes(spark, monkeypatch):
    items = [(9, ITEM), (9, ITEM), (10, None), (11, ""), (12, "too short"), (None, ITEM), (13, ITEM.upper())]
    assert pairs(spark, [(1, ITEM)], items) == [(1, 9)]
    monkeypatch.setattr(decontaminate, "WINDOWS_A_PASS", 4)
    assert pairs(spark, [(1, ITEM)], items[:2]) == [(1, 9)]
    assert pairs(spark, [], items) == [] and pairs(spark, [(1, ITEM)], [(12, "too short")]) == []


def test_whole_items_in_the_sample_tables(spark):
    d = "/root/testdata/sf0.01"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    flat = lambda t: " ".join(t.split())
    want = {(r.doc_id, i) for r in spark.read.parquet(f"{d}/documents.parquet").collect() for i, t in items if flat(t) in flat(r.text)}
    got = {(r.doc_id, r.item_id) for r in op4_benchmark_decontamination(spark, d).collect()}
    assert want and want <= got and len(got - want) <= 0.05 * len(want)


SHORT = "What is 12 + 7 * 3 - 4?"
SOLVE = "Solve 3x + 5 = 20 for x."


def test_short_and_slot_dense_items(spark):
    items = [(1, SHORT), (2, SOLVE), (3, "Name the capital."), (4, "Yes"), (5, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20")]
    docs = [(1, f"First of all: {SHORT} Then more."), (2, f"{SOLVE} And so on, {SOLVE}"),
            (3, "Solve 4x + 7 = 31 for x. That was easy."),                        # asked again with other numbers: literals enough
            (4, "What is 13 + 8 * 2 - 1? Hm."),                                    # too few literals: other numbers are another question
            (5, "now name the capital"), (6, "name the cat"), (7, "Yes"), (8, "Yes, it is so"), (9, "yes."),
            (10, "count 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 done"), (11, "count 1 2 3 4 5 done, 16 17 18")]
    assert pairs(spark, docs, items) == [(1, 1), (2, 2), (3, 2), (5, 3), (7, 4), (9, 4), (10, 5)]


def test_a_long_quote_of_a_longer_item(spark):
    item = " ".join(f"word{k}" for k in range(90))
    docs = [(1, " ".join(f"word{k}" for k in range(20, 50))), (2, " ".join(f"word{k}" for k in range(20, 40))), (3, " ".join(f"word{k}" for k in range(0, 90, 2)))]
    assert pairs(spark, docs, [(7, item)]) == [(1, 7)]


def test_windows_equal_a_plain_walk(spark):
    """Leaks of random token texts against walking all alignments."""
    import random
    from llm.decontaminate import LEAK_FROM, LITERALS, RUN, WIDTH
    r = random.Random(3)
    vocabulary = [f"w{c}" for c in "abcdefgh"] + [str(k) for k in range(4)]
    vocabulary = [v.replace("w", "word") if v[0] == "w" else v for v in vocabulary]
    items = [(k, " ".join(r.choices(vocabulary, k=r.randrange(17, 24)))) for k in range(12)]
    docs = []
    for k in range(60):
        text = items[r.randrange(12)][1].split()
        for _ in range(r.randrange(0, 5)):
            text[r.randrange(len(text))] = r.choice(vocabulary)
        docs.append((k, " ".join(r.choices(vocabulary, k=5) + text + r.choices(vocabulary, k=5))))
    number = lambda w: w.isdigit()
    want = set()
    for i, text in docs:
        d = text.split()
        for j, item in items:
            t = item.split()
            covered, run = set(), 0
            for shift in range(-len(t), len(d)):
                here, slots = set(), {}
                bad = False
                for a in range(len(t) - WIDTH + 1):
                    if not 0 <= a + shift <= len(d) - WIDTH:
                        continue
                    x, y = t[a: a + WIDTH], d[a + shift: a + shift + WIDTH]
                    literal = sum(not number(w) for w in x)
                    same = x == y if literal < LITERALS else all(u == v or (number(u) and number(v)) for u, v in zip(x, y))
                    if same and sum(not number(w) for w in y) == literal:
                        here |= set(range(a, a + WIDTH))
                        for u, v in zip(x, y):
                            if number(u):
                                bad |= slots.setdefault(u, v) != v
                if here and not bad:
                    covered |= here
                    run = max(run, len(here))
            if len(covered) >= LEAK_FROM * len(t) or run >= RUN:
                want.add((i, j))
    assert pairs(spark, docs, items) == sorted(want) and want
