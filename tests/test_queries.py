"""Every registered query with SQL against DuckDB over the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from rankweave.plans import oracles, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, values):
    return sorted(str([f"{x:.6f}" if isinstance(x, float) else str(x) for x in row]) for row in values), names


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_oracle(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = [tuple(r) for r in df.select(*names).collect()]
    cursor = duck.execute(oracles.ORACLES[name])
    there = [c[0] for c in cursor.description]
    assert sorted(there) == names
    want = [tuple(r[there.index(c)] for c in names) for r in cursor.fetchall()]
    assert rows(names, got) == rows(names, want)


@pytest.mark.parametrize("name", ["candidates_full", "scale_complete_all", "topk_all_candidates"])
def test_no_table_of_all_pairs_is_made(spark, name):
    """No step has more rows than ratings and lists: all pairs of these tables are over 20,000."""
    tracker = spark.sparkContext._jsc.sc().listenerBus()
    df = queries.QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    tracker.waitUntilEmpty()
    most, nodes = 0, [plan]
    while nodes:
        node = nodes.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            nodes.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            nodes.append(node.plan())
            continue
        counts = [node.metrics().apply(c).value() for c in ("numOutputRows", "pythonNumRowsReceived") if node.metrics().contains(c)]
        most = max([most, *counts])
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    assert 0 < most < 20_000


def test_entry_has_a_row(spark):
    one = __spark_entry__.entry(spark).collect()
    assert len(one) == 1 and one[0]["users"] > 100


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_known_values(spark):
    """The flagship, long-tail and rank-distance figures of the blueprint, at sf0.01."""
    sf = "/root/testdata/sf0.01"
    row = queries.precision_recall_ndcg(spark, sf).first()
    assert (row["users"], row["precision"], row["recall"], row["ndcg"]) == (1472, 0.001086957, 0.005400815, 0.002621388)
    assert queries.long_tail_items(spark, sf).count() == 1461
    k = queries.kendall_global(spark, sf).first()
    assert (k["concordant"], k["discordant"], k["ties"]) == (67553, 36449, 103946)
