"""Every registered query that has SQL agrees with DuckDB on the smallest tables; the others run."""

import datetime
from pathlib import Path

import duckdb
import pytest

from factloom.plans.queries import ORACLES, QUERIES

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.6f}".replace("-0.000000", "0.000000")
    return str(v)[:26] if isinstance(v, datetime.datetime) else str(v)


def table(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in at], sorted(tuple(plain(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, duck, name):
    got = QUERIES[name](spark, str(SF))
    cur = duck.execute(ORACLES[name])
    want = table([c[0] for c in cur.description], cur.fetchall())
    assert table(got.columns, [tuple(r) for r in got.collect()]) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    QUERIES[name](spark, str(SF)).collect()


def test_annotations_see_whole_texts_and_all_facts(spark, duck, monkeypatch):
    import numpy as np

    from factloom.plans import queries as plans
    from factloom.plans.fixtures import with_tables

    seen, annotate = [], plans.reports.annotate
    monkeypatch.setattr(plans.reports, "annotate", lambda *a, **k: seen.extend(a) or annotate(*a, **k))
    got = sorted((r.report_id, r.idx, r.fact_id, round(r.score, 6)) for r in QUERIES["t32_annotations"](spark, str(SF)).collect())
    rows, vectors, facts, own, _ = seen
    texts = {(c, t): s for c, t, s in duck.execute("select conv_id, turn, text from conversations").fetchall()}
    assert {(r.report_id, r.idx): r.text for r in rows.collect()} == {k: s.ljust(40, ".") for k, s in texts.items()}
    ids = {i for (i,) in duck.execute(with_tables("facts") + "select fact_id from facts").fetchall()}
    own = sorted((r.id, r.embedding) for r in own.collect())
    assert {r.fact_id for r in facts.collect()} == ids == {i for i, _ in own}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    items, want = unit(np.array([e for _, e in own], float)), []
    for r in vectors.collect():  # no text cites a fact, and numeric hits have a higher bound than the nearest facts
        score = unit(np.array([r.embedding], float))[0] @ items.T
        near = [k for k in np.lexsort((np.arange(len(own)), -score.round(9)))[:5] if score[k] >= plans.NEAR]
        want += [(r.report_id, r.idx, own[k][0], round(float(score[k]), 6)) for k in near]
    assert [x[:3] for x in got] == [x[:3] for x in sorted(want)] and np.allclose([x[3] for x in got], [x[3] for x in sorted(want)], atol=2e-6)
