"""Every query with SQL gives the same rows as DuckDB; the others are checked by rule."""

import duckdb
import pytest

from vigil.operators.sequence import Fold
from vigil.plans import ORACLE, QUERIES

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


def rounded(row):
    return tuple(round(x, 9) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, D)
    got = duck.execute(ORACLE[name])
    columns = [x[0] for x in got.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((rounded(x) for x in got.fetchall()), key=repr)
    assert sorted((rounded(x) for x in df.select(*columns).collect()), key=repr) == want


def test_strict_parse(spark):
    rows = QUERIES["S01_strict_parse"](spark, D).collect()
    assert all(r.valid == (r.event_id % 3 != 0) for r in rows)


def test_admission_follows_the_fold(spark):
    from vigil.plans.lifecycle import arrivals

    rows = QUERIES["T05_admission"](spark, D).collect()
    assert len(rows) >= arrivals(spark, D).count() - sum(r.status == "BUFFERED" for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r.source, r.seq), []).append(r.status)
    assert all(x.count("ACCEPTED") <= 1 for x in by.values())


def test_rate_limit(spark):
    told = QUERIES["T15_rate_limit"](spark, D).groupBy("refused_by").count().collect()
    assert {r.refused_by for r in told} <= {None, "KEY", "FLEET"} and sum(r["count"] for r in told) == spark.read.parquet(f"{D}/events.parquet").count()


def test_fold_rules():
    f = Fold(gap=4)
    assert f.step(1, "a", "", False) == [(1, "ACCEPTED")]
    assert f.step(1, "a", "", False) == [(1, "DUPLICATE")]
    assert f.step(3, "c", "b", False) == [(3, "BUFFERED")] and f.s["state"] == "GAPPED"
    assert f.step(6, "f", "e", False) == [(6, "GAP_LIMIT")]
    assert f.step(2, "b", "a", False) == [(2, "ACCEPTED"), (3, "ACCEPTED")] and f.s["state"] == "ACTIVE"
    assert f.step(4, "d", "wrong", False) == [(4, "CHAIN_INVALID")]
    g = Fold()
    g.step(1, "a", "", False)
    assert g.step(1, "x", "", False) == [(1, "FORK")] and g.step(2, "b", "a", False) == [(2, "SOURCE_FORKED")]
    h = Fold()
    h.step(1, "a", "", False), h.step(3, "c", "b", False)
    assert h.step(2, "b", "a", True) == [(2, "TERMINAL_SUFFIX")]


def test_fast_path_equals_the_fold(spark):
    """On sources without forks the relational acceptance times are the fold's."""
    import random

    from vigil.operators import sequence as S

    r, rows = random.Random(1), []
    for s in range(30):
        seqs = list(range(1, r.randint(3, 12)))
        r.shuffle(seqs)
        if s % 4 == 0:
            seqs.pop()
        rows += [(f"s{s}", q, f"h{q}", f"h{q - 1}", 1000 + i * 10, i, False) for i, q in enumerate(seqs)]
    df = spark.createDataFrame(rows, "source string, seq long, hash string, prev string, arrival_ms long, arrival long, terminal boolean")
    fold = {(x.source, x.seq, x.at_ms) for x in S.admit(df).where("status = 'ACCEPTED'").collect()}
    assert fold == {(x.source, x.seq, x.accept_ms) for x in S.accepted_times(df).collect()}
    assert fold == {(x.source, x.seq, x.at_ms) for x in S.admit(df.repartition(7)).where("status = 'ACCEPTED'").collect()}


def test_fold_without_history_equals_the_fold(spark):
    """The distributed fold, which keeps no slots up to the head, against the fold that keeps all."""
    import random

    from vigil.functions.params import Params
    from vigil.operators import sequence as S

    r, rows, want = random.Random(5), [], []
    for s in range(60):
        fold, arrival = Fold(gap=4), 0
        n = r.randint(1, 14)
        for at in range(r.randint(1, 40)):
            seq = r.choice([at // 2 + 1, r.randint(0, n), r.randint(1, n)])
            wrong, last = r.random() < 0.04, r.random() < 0.02
            row = (f"s{s}" if s else None, seq, "x" if wrong else f"h{seq}", "y" if r.random() < 0.03 else f"h{seq - 1}", at * 10, at, last)
            rows.append(row)
            want += [(row[0], at, q, status, fold.s["state"], at * 10) for q, status in fold.step(*row[1:4], last)]
    df = spark.createDataFrame(rows, "source string, seq long, hash string, prev string, arrival_ms long, arrival long, terminal boolean").repartition(5)
    got = S.admit(df, Params(gap=4)).select("source", "arrival", "seq", "status", "state", "at_ms").collect()
    key = lambda x: (x[0] or "", *x[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {"FORK", "SOURCE_FORKED", "DUPLICATE", "TERMINAL_SUFFIX", "SOURCE_TERMINAL", "CHAIN_INVALID", "GAP_LIMIT"} <= {x[3] for x in want}


def test_token_buckets_against_brute_force(spark):
    import random

    from vigil.operators.votes import buckets

    r = random.Random(6)
    rows = [(r.choice([None, 1, 1, 1, 2]), i, r.randint(0, 400)) for i in range(900)]
    want, state = set(), {}
    for k, i, t in sorted(rows, key=lambda x: (x[2], x[1])):
        tokens, last = state.get(k, (8.0, t))
        tokens = min(8.0, tokens + (t - last) * 20 / 1000)
        state[k] = (tokens - (tokens >= 1), t)
        want.add((k, i, t, tokens >= 1))
    df = spark.createDataFrame(rows, "key_id long, request long, at_ms long").repartition(4)
    assert set(map(tuple, buckets(df, 20, 8).collect())) == want
    assert buckets(df.limit(0)).count() == 0
