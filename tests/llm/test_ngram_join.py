"""N-gram Jaccard join against comparing all pairs."""

import re

import pytest

from llm.ngram_join import jaccard_classes, op10_ngram_jaccard_join
from tests.conftest import SF_SMALL


def brute(rows, similarity=80, width=5):
    """{doc_id: (set size, component)} by comparing every pair of documents."""
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= similarity * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_sample_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert found(op10_ngram_jaccard_join(spark, SF_SMALL)) == brute(rows)


def test_near_copies_chains_and_odd_texts(spark):
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(40):                                    # a chain: each is near the next, the ends are not
        rows.append((100 + k, " ".join(base[k * 3:] + [f"x{j}" for j in range(k * 3)])))
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\x0btwo"), (6, "One two three"),
             (7, "É a b c d"), (8, "é a b c d"), (9, " ".join(base).upper()), (10, "w " * 5000), (11, "w " * 9)]
    rows += [(200 + k, " ".join(base[:60] + [f"y{k}_{j}" for j in range(k % 8)])) for k in range(60)]   # a group of near copies
    df = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, cls string, n long")
    assert found(jaccard_classes(df)[0]) == brute(rows)


def test_repeated_rows_null_ids_and_empty_table(spark):
    schema = "doc_id long, text string"
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (None, "q r s"), (1, "other words")]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard_classes(spark.createDataFrame(rows, schema))[0].collect())
    assert got == [(-1, 1, -1), (-1, 2, 1), (1, 1, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert jaccard_classes(spark.createDataFrame([], schema))[0].count() == 0


@pytest.mark.parametrize("similarity", [50, 95])
def test_other_similarities(spark, similarity):
    rows = [(k, " ".join(f"w{(k * 7 + j * (1 + k % 3)) % 23}" for j in range(10 + k % 5))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(jaccard_classes(df, similarity, 2)[0]) == brute(rows, similarity, 2)


def test_near_copies_without_an_id(spark):
    base = [f"w{k}" for k in range(60)]
    copies = [(None, " ".join(base[2:])), (5, " ".join(base)), (None, " ".join(base[2:]))]                  # without an id: the smaller set
    copies += [(None, " ".join(base[::-1])), (3, " ".join(base[:1:-1]))]                                    # the larger one
    copies += [(None, " ".join(f"v{k}" for k in range(30))), (None, " ".join(f"v{k}" for k in range(29)))]  # both, and no id at all
    got = jaccard_classes(spark.createDataFrame(copies, "doc_id long, text string"))[0].collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in got) == [
        (-1, 25, -1), (-1, 26, -1), (-1, 54, 5), (-1, 54, 5), (-1, 56, 3), (3, 54, 3), (5, 56, 5)]


def test_one_row_of_each_component_stays(spark):
    """Unrelated texts that share an id stay; copies go by text, also where another row of the id is no copy."""
    from llm.ngram_join import jaccard_stage
    base = " ".join(f"w{k}" for k in range(40))
    other, third, near = ("u " + base[::-1], "quite another text of eight words it is", base + " w40")
    rows = [(1, base, "a"), (2, base, "b"), (2, other, "c"), (5, third, "d"), (5, "and one that has nothing to do with it", "e"), (3, near, "f"),
            (1, base, "g"), (4, base.upper(), "h"), (None, base, "i"), (7, None, "j"), (7, "", "k"), (8, third, "l"), (8, third, "m"), (2, other, "n")]
    docs = spark.createDataFrame([(i, t, s, 3) for i, t, s in rows], "doc_id long, text string, source string, cls int")
    got = jaccard_stage(spark, docs, "")
    assert got.columns == docs.columns
    kept = sorted(((r.doc_id or 0), r.text or "") for r in got.collect())
    assert kept == sorted([(1, base), (2, other), (5, third), (5, "and one that has nothing to do with it"), (0, base), (7, ""), (7, "")])
    assert jaccard_stage(spark, docs.limit(0), "").count() == 0


def test_frequent_columns_and_many_ranges(spark, monkeypatch):
    """Texts made of frequent shingles alone; entries dealt over many hash ranges, packed a few at a time."""
    import llm.ngram_join as j
    monkeypatch.setattr(j, "FREQUENT_LEAST", 3)
    monkeypatch.setattr(j, "RANGE_ENTRIES", 8)
    monkeypatch.setattr(j, "PACK", 50)
    monkeypatch.setattr(j, "SORTED", 5)
    monkeypatch.setattr(j, "CACHE", 4)
    monkeypatch.setattr(j, "PAIRS_A_COPY", 3)
    common = [f"c{k}" for k in range(30)]
    rows = [(k, " ".join(common[k % 3:] + common[: k % 4])) for k in range(60)]
    rows += [(100 + k, " ".join([f"r{k}"] * (k % 3) + common + [f"s{k}_{i}" for i in range(k % 9)])) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(jaccard_classes(df)[0]) == brute(rows)
    monkeypatch.setattr(j, "BROADCAST_IDS", 0)
    assert found(jaccard_classes(df)[0]) == brute(rows)


def test_very_long_texts(spark):
    long = " ".join(f"w{k}" for k in range(300_000))
    rows = [(1, long), (2, long + " and more"), (3, " ".join(f"w{k}" for k in range(0, 300_000, 2))), (4, "x " * 200_000)]
    got = found(jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))[0])
    assert got == {1: (299_996, 1), 2: (299_998, 1), 3: (149_996, 3), 4: (1, 4)}


def test_a_group_of_copies_not_near_enough_is_told_apart_by_maps(spark, monkeypatch):
    import random

    from llm import ngram_join
    pick = random.Random(5)
    base = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(60):                                    # each pair is some 0.74 alike
        own = list(base)
        for j in pick.sample(range(400), 6):
            own[j] = f"x{k}_{j}"
        rows.append((k, " ".join(own)))
    made = []
    meeting = ngram_join._meeting
    monkeypatch.setattr(ngram_join, "_meeting", lambda part, similarity: made.append(meeting(part, similarity).count()) or meeting(part, similarity))
    assert found(jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))[0]) == brute(rows)
    assert sum(made) < 60 * 100                            # 1,770 pairs, most with some 20 columns in common
