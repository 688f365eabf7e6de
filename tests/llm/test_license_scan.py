"""License scan against its DuckDB twin and against plain loops over words."""

import re

import duckdb
import pytest

from llm.license_scan import PHRASES, TEMPLATES, op11_license_scans, oracle_sql, scan
from tests.conftest import SF_SMALL


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def places(text):
    w = words(text)
    return sorted((label, k) for label, p in PHRASES for k in range(len(w)) if w[k: k + len(p.split())] == p.split())


def test_equals_the_sql_twin(spark):
    got = op11_license_scans(spark, SF_SMALL)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS FROM '{SF_SMALL}/documents.parquet'")
    want = c.execute(oracle_sql()).fetchall()
    assert got.columns == [x[0] for x in c.description]
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    assert any(r[5] for r in want)


def test_places_equal_plain_loops(spark):
    line = "Released UNDER the MIT-License"
    rows = [(1, None), (2, ""), (3, " \t\n--"), (4, "cc by"), (5, "CC BY-NC"), (6, f"{line}. {line}, {line}"),
            (7, "É under the mit licence; under the mit license!"), (7, "É under the mit licence; under the mit license!"),
            (None, "apache license version 2.0"), (None, "x"), (8, "cc by nc " * 20000), (9, "under the mıt license K"),
            (10, "z " * 30000 + line), (11, "apache\x00license_version2 apache license version 2")]
    df = spark.createDataFrame([(i, t, "x", 7, "y") for i, t in rows], "doc_id long, text string, label string, pos int, row string")
    got = sorted((r.doc_id or 0, r.n_words, [(p.label, p.start) for p in r.places]) for r in scan(df).collect())
    assert got == sorted((i or 0, len(words(t)), places(t)) for i, t in rows)
    assert scan(df.limit(0)).count() == 0


@pytest.mark.parametrize("k", range(len(TEMPLATES)))
def test_every_notice_is_found_whole_and_changed(spark, k):
    label, text = TEMPLATES[k]
    w = text.split()
    more = w[:2] + ["very"] + w[2:]
    less = w[:3] + w[4:]
    rows = [(1, f"Some words. {text.title()}, and more."), (2, " ".join(more)), (3, " ".join(less)), (4, " ".join(w[: len(w) // 2])), (5, " ".join(w[::-1]))]
    got = {r.doc_id: r for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    names = {i: {s.label for s in r.spans} for i, r in got.items()}
    assert label in names[1] and got[1].score == 1.0
    assert [(s.start, s.end) for s in got[1].spans if s.label == label] == [(2, 2 + len(w))]
    if len(w) >= 10:
        assert label in names[2] and got[2].score >= 0.8
        assert label in names[3] and got[3].score >= 0.8
    assert not names[4] - {label} and label not in names[5]


def test_siblings_are_told_apart(spark):
    rows = [(1, "This work is licensed under the GNU General Public License, version 3."),
            (2, "This work is licensed under the GNU General Public License, version 2."),
            (3, "Licensed under CC BY-NC 4.0."), (4, "Licensed under CC BY 4.0 and released under the MIT License")]
    got = {r.doc_id: sorted({s.label for s in r.spans}) for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["gpl-3"], 2: ["gpl-2"], 3: ["cc-by-nc"], 4: ["cc-by", "mit"]}


def test_plan_has_no_python_and_one_shuffle_of_votes(spark):
    plan = op11_license_scans(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert plan.count("Exchange hashpartitioning") == 1
