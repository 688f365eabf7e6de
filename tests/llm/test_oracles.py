"""The SQL twins give the operators' rows."""

import duckdb
import pytest

from llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) - {"op11_license_scans"}))     # that one has tests of its own
def test_query_equals_its_sql(spark, name):
    got = QUERIES[name](spark, SF_SMALL)
    c = duckdb.connect()
    for table in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {table} AS FROM '{SF_SMALL}/{table}.parquet'")
    want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_twins_on_odd_rows():
    """Repeated rows, null ids and texts, chains, overlaps: the twins' own rules, tried by hand."""
    c = duckdb.connect()
    w = [f"w{k}" for k in range(120)]
    rows = [(1, " ".join(w[:60])), (2, " ".join(w[:55] + ["x"])), (3, None), (3, ""), (None, " ".join(w[:60])), (4, " ".join(w[:60])), (4, " ".join(w[:60]))]
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = {(r[0], r[1], r[2]) for r in c.execute(ORACLE_SQL["op9_substring_dedup"]).fetchall()}
    assert got == {(1, 60, 0), (2, 56, 55), (3, 0, 0), (None, 60, 0), (4, 60, 60)}
    spans = {(r[0], r[2], r[3]) for r in c.execute(ORACLE_SQL["op7_suffix_array_dedup"]).fetchall()}
    size = len(" ".join(w[:60]))
    assert {(1, 0, 0), (3, 0, 0), (None, 0, 0), (4, size, 1)} <= spans and {s for i, _, s in spans if i == 2} == {1}
    comp = sorted((r[0] or 0, r[1], r[2] or 0) for r in c.execute(ORACLE_SQL["op10_ngram_jaccard_join"]).fetchall())
    assert comp == [(0, 56, 1), (1, 56, 1), (2, 52, 1), (3, 0, 3), (3, 0, 3), (4, 56, 1), (4, 56, 1)]
    c.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label VARCHAR)")
    c.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [(1, [1.0, 0.0], "a"), (2, [1.0, 0.3], "a"), (3, [1.0, 0.65], "a"), (4, [1.0, 0.0], "b"), (5, [0.0, 0.0], "a"),
                                                              (6, None, "a"), (7, [1.0, None], "a"), (8, [1.0, 0.0], None)])
    assert sorted(c.execute(ORACLE_SQL["op5_embedding_near_dedup"]).fetchall()) == [
        (1, 1, 1, True), (2, 2, 1, False), (3, 1, 1, False), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True)]
