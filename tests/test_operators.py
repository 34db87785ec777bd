"""Hand-made cases and properties of the operators."""

import itertools
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pyspark.sql import functions as F

from rankweave.functions import hashing, measures, permutation, ranges, storage
from rankweave.operators import blocks, candidates, filters, ranking, sampling, scaling, scoring, stats, svd
from rankweave.plans import experiments
from rankweave.sources import matrix
from rankweave.sources import rating_blocks as blocks_of_ratings
from rankweave.sources import ratings as sources
from rankweave.sources import sinks

SCHEMA = "user_id long, item_id long, rating double"


def frame(spark, rows):
    return spark.createDataFrame([(int(u), int(i), float(r)) for u, i, r in rows], SCHEMA)


@pytest.mark.parametrize(
    "gt, pred, strict, lenient",
    [((1, 5), (1, 2), 0, 0), ((1, 5), (2, 1), 1, 1), ((1, 5), (2, 2), 1, 0), ((5, 5), (1, 2), 0, 1), ((5, 5), (2, 2), 0, 0)],
)
def test_pair_truth_table(spark, gt, pred, strict, lenient):
    args = [F.lit(float(x)) for x in (*gt, *pred)]
    row = spark.range(1).select(scoring.pair_score(*args, "strict").alias("s"), scoring.pair_score(*args, "lenient").alias("l")).first()
    assert (row["s"], row["l"]) == (strict, lenient)


def test_ndcg(spark):
    top = spark.createDataFrame([(1, 2, 1), (1, 9, 2), (1, 1, 3)], "user_id long, item_id long, rank int")
    test = frame(spark, [(1, 1, 4), (1, 2, 5)])
    row = ranking.ranking_metrics(top, test, 3).first()
    assert row["ndcg"] == pytest.approx(0.951464291) and row["precision"] == pytest.approx(2 / 3) and row["recall"] == 1
    assert ranking.ranking_metrics(top, test, 3, binary=True).first()["ndcg"] == pytest.approx(1.5 / 1.630929754)


@pytest.mark.parametrize("side", ["user", "item"])
def test_completion(spark, side):
    own = frame(spark, [(0, 0, 1), (0, 1, 2), (1, 0, 2)])
    fit = scaling.fit_until(own, first_side=side)
    cells = spark.createDataFrame([(1, 1), (0, 1)], "user_id long, item_id long")
    got = {(r["user_id"], r["item_id"]): r["value"] for r in scaling.complete(cells, own, fit).collect()}
    assert fit.converged and got[1, 1] == pytest.approx(4.0, abs=1e-3) and got[0, 1] == 2.0


def test_cold_item_order_depends_on_the_first_side(spark):
    own = frame(spark, [(0, 0, 5), (0, 1, 4), (1, 0, 4), (1, 1, 5), (1, 2, 4), (2, 2, 5), (2, 0, 5)])
    items = {side: {r["item_id"]: r["factor"] for r in scaling.factors(scaling.fit_until(own, 1e-12, side))[1].collect()} for side in ("user", "item")}
    assert [items["user"][i] for i in range(3)] == pytest.approx([1.012833, 1.028012, 0.954322], abs=1e-4)
    assert [items["item"][i] for i in range(3)] == pytest.approx([4.602299, 4.671276, 4.336428], abs=1e-3)
    cells = spark.createDataFrame([(0, 3)], "user_id long, item_id long")
    fit = scaling.fit_until(own, 1e-12, "user")
    user = {r["user_id"]: r["factor"] for r in scaling.factors(fit)[0].collect()}
    assert scaling.score_cells(cells, fit).first()["score"] == pytest.approx(user[0])


def test_scaling_a_user_scales_only_their_products(spark):
    rows = [(0, 0, 5), (0, 1, 4), (1, 0, 4), (1, 2, 3), (2, 1, 2), (2, 2, 5), (2, 3, 1)]
    cells = spark.createDataFrame([(u, i) for u in range(3) for i in range(4)], "user_id long, item_id long")

    def products(own):
        return {(r["user_id"], r["item_id"]): r["score"] for r in scaling.score_cells(cells, scaling.fit_until(frame(spark, own), 1e-14)).collect()}

    a, b = products(rows), products([(u, i, r * 3 if u == 1 else r) for u, i, r in rows])
    for key in a:
        assert b[key] == pytest.approx(a[key] * (3 if key[0] == 1 else 1), rel=1e-3)


def test_fixed_sweeps_follow_the_grouped_means(spark):
    rng = np.random.default_rng(1)
    cells = {(int(rng.integers(12)), int(rng.integers(9))): float(rng.integers(1, 6)) for _ in range(60)}
    a, b = np.zeros(12), np.zeros(9)
    for _ in range(3):
        b = np.array([np.mean([math.log(r) - a[u] for (u, i), r in cells.items() if i == j] or [0]) for j in range(9)])
        a = np.array([np.mean([math.log(r) - b[i] for (u, i), r in cells.items() if u == v] or [0]) for v in range(12)])
    fit = scaling.fit_sweeps(frame(spark, [(u, i, r) for (u, i), r in cells.items()]), 3)
    for row in fit.items.collect():
        assert row["b"] == pytest.approx(b[row["item_id"]])
    for row in fit.users.collect():
        assert row["a"] == pytest.approx(a[row["user_id"]])


def test_kendall(spark):
    own = spark.createDataFrame([(1, 1, 5.0, 3.0), (1, 2, 4.0, 2.0), (1, 3, 4.0, 3.0)], SCHEMA + ", score double")
    row = ranking.kendall(own).first()
    assert (row["concordant"], row["discordant"], row["ties"], row["distance"]) == (1, 0, 1, 0)
    many = spark.createDataFrame([(1, i, float(i), float(i)) for i in range(230)], SCHEMA + ", score double")
    assert ranking.kendall(many).first()["total_pairs"] == 200 * 199 // 2


def test_long_tail(spark):
    rows = [(u, i, 3) for i, n in enumerate((5, 3, 1, 1)) for u in range(n)]
    got = filters.long_tail(frame(spark, rows)).orderBy("item_id").collect()
    assert [r["item_id"] for r in got] == [0, 1, 2, 3] and [r["cum_share"] for r in got] == pytest.approx([0.5, 0.8, 0.9, 1.0])


def test_macro_stats_and_rmse(spark):
    own = spark.createDataFrame([(x,) for x in (0, 1, 1, 0, 1)], "s int")
    row = stats.macro_stats(own, "s").first()
    assert row["mean"] == pytest.approx(0.6) and row["std_error"] == pytest.approx(0.219089023)
    cells = spark.createDataFrame([(5.0, 4.5), (4.0, 3.0)], "rating double, score double")
    assert stats.rmse(cells).first()["rmse"] == pytest.approx(0.790569415)
    assert stats.macro_stats(own.where("s > 5"), "s").first()["n"] == 0


def test_bootstrap_surrounds_the_mean(spark):
    own = spark.createDataFrame([(int(i % 3 == 0),) for i in range(300)], "s int")
    row = stats.bootstrap(own, "s", 300).first()
    assert row["low"] < 1 / 3 < row["high"] and row["mean"] == pytest.approx(1 / 3, abs=0.02)


def test_holdout_parts_the_positives(spark):
    own = frame(spark, [(u, i, 1 + (u + i) % 5) for u in range(8) for i in range(20)] + [(99, i, 5) for i in range(5)] + [(98, i, 5) for i in range(4)])
    both = sampling.holdout(own)
    assert both.count() == own.where("rating >= 4 AND user_id <> 98").count()
    sizes = {r["user_id"]: r["n"] for r in both.where("is_test").groupBy("user_id").agg(F.count("*").alias("n")).collect()}
    assert sizes[99] == 1 and 98 not in sizes


def test_duplicates(spark):
    own = spark.createDataFrame([(1, 1, 2.0, 5), (1, 1, 4.0, 3)], SCHEMA + ", ts long")
    assert {p: sources.deduplicate(own, p).first()["rating"] for p in ("sum", "max", "last")} == {"sum": 6.0, "max": 4.0, "last": 2.0}
    with pytest.raises(Exception, match="rated twice"):
        sources.deduplicate(own, "error").collect()
    with pytest.raises(ValueError):
        sources.deduplicate(own, "?")


def test_users_with_all_items_are_not_dense(spark):
    own = frame(spark, [(1, i, 1 + i % 5) for i in range(6)] + [(2, i, 1 + i % 5) for i in range(5)])
    assert {r["user_id"] for r in filters.users_with_levels(own).collect()} == {1, 2}
    assert {r["user_id"] for r in filters.users_with_levels(own, dense=True).collect()} == {2}


def test_sampled_only_rating_takes_its_item_along(spark):
    own = frame(spark, [(1, i, 1 + i % 5) for i in range(5)] + [(2, i, 1 + i % 5) for i in range(4)] + [(2, 7, 5)])
    train, test = sampling.qualified_pairs(own, (1.0, 5.0))
    assert {(r["user_id"], r["item_id"]) for r in test.collect()} == set()  # items 4 and 7 are gone, both levels of item 0 too
    assert train.count() == own.count() - 4


def test_candidates(spark):
    train, test = frame(spark, [(1, 1, 5), (1, 2, 3), (2, 3, 5)]), frame(spark, [(1, 3, 5)])
    full = {(r["user_id"], r["item_id"]) for r in candidates.full_ranking(train).collect()}
    assert full == {(1, 2), (1, 3), (2, 1), (2, 2)}  # the low rating stays a candidate
    negative = candidates.negative_sampling(train, test, 5).collect()
    assert {(r["user_id"], r["item_id"], r["is_test"]) for r in negative} == {(1, 3, True), (1, 2, False)}
    assert candidates.full_ranking(train, negatives=1).count() == 2


def test_draws_are_whole_unseen_and_differ_by_user(spark):
    rng = np.random.default_rng(8)
    rows = {(int(u), int(i)) for u, i in rng.integers(0, 40, (500, 2))} | {(99, i) for i in range(38)}
    train = frame(spark, [(u, i, 1 + (u + i) % 5) for u, i in rows])
    items = {i for _, i in rows}
    for n in (1, 7, 100):
        got = [(r["user_id"], r["item_id"]) for r in candidates.full_ranking(train, negatives=n).collect()]
        assert len(set(got)) == len(got) and not set(got) & rows
        for u in {u for u, _ in rows}:
            assert sum(x == u for x, _ in got) == min(n, len(items) - sum(x == u for x, _ in rows))
        assert got and (n > 1 or len({i for _, i in got}) > 10)
    counts = {r["user_id"]: r["n_candidates"] for r in candidates.full_ranking_counts(train).collect()}
    assert counts == {r["user_id"]: r["count"] for r in candidates.full_ranking(train).groupBy("user_id").count().collect()}


def test_counts_and_sums_of_candidates_equal_those_of_pairs(spark):
    rng = np.random.default_rng(9)
    train = frame(spark, [(u, i, 1 + (u * i) % 5) for u, i in {(int(a), int(b)) for a, b in rng.integers(0, 20, (150, 2))}] + [(77, i, 5) for i in range(20)])
    want = {tuple(r) for r in candidates.full_ranking(train).groupBy("user_id").agg(F.count("*"), F.sum("item_id")).collect()}
    found = candidates.full_ranking_counts(train)
    assert {tuple(r) for r in found.select("user_id", "n_candidates", "item_sum").collect()} == want and 77 not in {u for u, _, _ in want}
    missing = spark.createDataFrame([(1, None, 5.0), (2, 4, 5.0)], SCHEMA)  # SQL's anti-join leaves a missing item to all
    assert {tuple(r) for r in candidates.full_ranking_counts(missing).select("user_id", "n_candidates", "item_sum").collect()} == {(1, 2, 4), (2, 1, None)}


def test_top_lists_equal_those_of_all_candidates(spark):
    rng = np.random.default_rng(3)
    train = frame(spark, [(u, i, 5) for u, i in {(int(a), int(b)) for a, b in rng.integers(0, 25, (200, 2))}])
    items = spark.createDataFrame([(i, float(i % 7)) for i in range(30)], "item_id long, score double")
    users = train.select("user_id").distinct()
    cells = users.join(items).join(train, ["user_id", "item_id"], "left_anti")
    want = {(r["user_id"], r["item_id"], r["rank"]) for r in ranking.top_scored(cells, 5).collect()}
    assert {(r["user_id"], r["item_id"], r["rank"]) for r in ranking.top_items(items, train, 5).collect()} == want


def test_svd_against_numpy(spark):
    rng = np.random.default_rng(5)
    table = rng.integers(0, 6, (9, 7)).astype(float)
    own = frame(spark, [(u, i, table[u, i]) for u in range(9) for i in range(7) if table[u, i]])
    found = svd.truncated_svd(own, 3)
    u, s, v = np.linalg.svd(table)
    want = (u[:, :3] * s[:3]) @ v[:3]
    cells = spark.createDataFrame([(a, b) for a in range(9) for b in range(7)], "user_id long, item_id long")
    for r in svd.score_cells(cells, found, [3]).collect():
        assert r["score"] == pytest.approx(want[r["user_id"], r["item_id"]], abs=1e-3)
    assert found.values == pytest.approx(s[:3].tolist(), rel=1e-4)


def test_blocked_products_against_numpy(spark, monkeypatch):
    """Many small blocks, several slices, partial sums that are sent early; repeated pairs add up."""
    for name, x in {"USER_BLOCK": 3, "ITEM_BLOCK": 4, "STEP": 5, "HELD_BYTES": 300, "DEALT": 1}.items():
        monkeypatch.setattr(blocks, name, x)
    rng = np.random.default_rng(8)
    pairs = [(int(u) * 7, int(i) * 5 - 20, float(x)) for u, i, x in zip(rng.integers(0, 14, 90), rng.integers(0, 11, 90), rng.integers(1, 6, 90), strict=True)]
    m = blocks.blocked(frame(spark, pairs))
    users, items = ({r[0]: r[1] for r in d.collect()} for d in (m.users, m.items))
    table = np.zeros((m.n_users, m.n_items))
    for u, i, x in pairs:
        table[users[u], items[i]] += x
    start = np.vstack([np.random.default_rng([42, b]).standard_normal((min(4, m.n_items - 4 * b), 2)) for b in range(-(-m.n_items // 4))])
    turn = np.array([[1.0, 2.0, 0.0], [0.5, 0.0, -1.0]])

    def whole(df, size, rows, n):
        out = np.zeros((rows + size, n))
        for r in df.collect():
            out[np.frombuffer(r["places"], "<i4") + r["block"] * size] += np.frombuffer(r["data"]).reshape(-1, n)
        return out[:rows]

    first = blocks.times(m, blocks.random_items(m, 2, 42), 2, turn)
    assert whole(first, 3, m.n_users, 3) == pytest.approx(table @ start @ turn)
    second = blocks.times(m, first, 3, transposed=True)
    assert whole(second, 4, m.n_items, 3) == pytest.approx(table.T @ table @ start @ turn)
    r = blocks.triangle(blocks.added(second, 4, 3), 3)
    want = table.T @ table @ start @ turn
    assert r.T @ r == pytest.approx(want.T @ want)


def test_vectors_are_sent_once_or_by_slices_of_many_ratings(spark, monkeypatch):
    """One row of vectors a block, though there are many blocks on the far side; a block with many ratings goes to several tasks, with the same product."""
    for name, x in {"USER_BLOCK": 1, "ITEM_BLOCK": 4}.items():
        monkeypatch.setattr(blocks, name, x)
    rows = [(u, i, 1 + (u * i) % 5) for u in range(40) for i in range(12) if (u + i) % 3 or i < 4]
    table = np.zeros((40, 12))
    for u, i, x in rows:
        table[u, i] = x
    start = np.vstack([np.random.default_rng([42, b]).standard_normal((4, 2)) for b in range(3)])
    for most, slices in ((1 << 19, {}), (120, {0: 2})):
        monkeypatch.setattr(blocks, "SLICE_RATINGS", most)
        m = blocks.blocked(frame(spark, rows))
        vectors = blocks.random_items(m, 2, 42)
        assert m.item_slices == slices and blocks.dealt(m, vectors, 2)[0].where("kind = 0").count() == 3 + len(slices)
        out = np.zeros((40, 2))
        for r in blocks.times(m, vectors, 2).collect():
            out[np.frombuffer(r["places"], "<i4") + r["block"]] += np.frombuffer(r["data"]).reshape(-1, 2)
        assert out == pytest.approx(table @ start)


def test_vectors_of_a_block_go_in_small_rows(spark, monkeypatch):
    """Rows of vectors are bounded in bytes, and batches in rows while the rounds run; products, triangles and settings stay what they are."""
    for name, x in {"USER_BLOCK": 16, "ITEM_BLOCK": 16, "PIECE_BYTES": 64}.items():
        monkeypatch.setattr(blocks, name, x)
    rng = np.random.default_rng(4)
    table = rng.integers(0, 6, (40, 30)).astype(float)
    own = frame(spark, [(u, i, table[u, i]) for u in range(40) for i in range(30) if table[u, i]])
    m = blocks.blocked(own)
    vectors = blocks.added(blocks.times(m, blocks.random_items(m, 3, 42), 3), 16, 3)
    rows = vectors.collect()
    assert len(rows) > 20 and max(len(r["data"]) for r in rows) <= 64
    out = np.zeros((48, 3))
    for r in rows:
        out[np.frombuffer(r["places"], "<i4") + 16 * r["block"]] += np.frombuffer(r["data"]).reshape(-1, 3)
    start = np.vstack([np.random.default_rng([42, b]).standard_normal((min(16, 30 - 16 * b), 3)) for b in range(2)])
    assert out[:40] == pytest.approx(table @ start)
    r = blocks.triangle(vectors, 3)
    assert r.T @ r == pytest.approx(out.T @ out)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None)
    assert svd.truncated_svd(own, 2).values == pytest.approx(np.linalg.svd(table)[1][:2].tolist(), rel=1e-4)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) == before


def test_tables_and_shuffles_of_earlier_rounds_are_gone(spark):
    rng = np.random.default_rng(19)
    own = frame(spark, [(u, i, rng.integers(1, 6)) for u in range(12) for i in range(9)])
    paths, new_path = [], storage.new_path
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(storage, "new_path", lambda s, name: paths.append((name, new_path(s, name))) or paths[-1][1])
        files = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
        storage.written(own.groupBy("user_id").count(), "counts")
        before = files.size()
        storage.written(own.groupBy("item_id").count(), "counts")
        assert files.size() <= before
        found = svd.truncated_svd(own, 2, rounds=5, settled=0.0)
    there = [os.path.exists(path.removeprefix("file://")) for name, path in paths if name == "block"]
    assert found.rounds == 5 and len(there) == 7 and sum(there) == 1  # the last items'


def test_svd_of_a_share_and_the_projector(spark):
    rng = np.random.default_rng(9)
    table = rng.integers(0, 6, (12, 8)).astype(float)
    own = frame(spark, [(u, i, table[u, i]) for u in range(12) for i in range(8) if table[u, i]])
    found = svd.truncated_svd(own, percent=0.5)
    assert len(found.values) == svd.rank_of(0.5, 12, 8) == 4
    v = np.linalg.svd(table)[2][:4]
    other = np.zeros((3, 8))  # users that the decomposition has not seen, one of them with an unknown item
    for u, i, x in ((0, 1, 5.0), (0, 6, 2.0), (1, 3, 4.0), (2, 0, 1.0)):
        other[u, i] = x
    more = frame(spark, [(100, 1, 5), (100, 6, 2), (101, 3, 4), (102, 0, 1), (102, 55, 3)])
    got = svd.project_cells(spark.createDataFrame([(100 + u, i) for u in range(3) for i in range(8)] + [(999, 1), (100, 55)], "user_id long, item_id long"), more, found)
    want = other @ v.T @ v
    for r in got.collect():
        inside = r["user_id"] < 999 and r["item_id"] < 8
        assert r["score"] == pytest.approx(want[r["user_id"] - 100, r["item_id"]] if inside else 0.0, abs=1e-4)
    with pytest.raises(ValueError):
        svd.truncated_svd(own, percent=0.01)


def test_sweep_against_numpy(spark):
    rng = np.random.default_rng(6)
    cells = {(int(u), int(i)): float(rng.integers(1, 6)) for u, i in rng.integers(0, 30, (420, 2))}
    keys = sorted(cells)
    test = {c: cells[c] for c in keys[::5]} | {(3, 77): 4.0}
    train = {c: cells[c] for c in keys if c not in test}
    items = sorted({i for _, i in train} | {77})
    table = np.zeros((30, len(items)))
    for (u, i), x in train.items():
        table[u, items.index(i)] = x
    a, s, b = np.linalg.svd(table)
    got = {r["k"]: r for r in svd.sweep(frame(spark, [(*c, x) for c, x in train.items()]), frame(spark, [(*c, x) for c, x in test.items()]), [1, 4, 30], (2, 5)).collect()}
    for k in (1, 4, 30):
        full = (a[:, :k] * s[:k][None, : a.shape[1]]) @ b[: min(k, len(s))] if k <= len(s) else (a[:, : len(s)] * s) @ b[: len(s)]
        assert got[k]["rmse"] == pytest.approx(np.sqrt(np.mean([(full[u, items.index(i)] - x) ** 2 for (u, i), x in test.items()])), abs=2e-2)
        for top in (2, 5):
            gains = []
            for u in sorted({u for u, _ in test}):
                own = {i for v, i in test if v == u}
                listed = sorted((i for i in items if (u, i) not in train), key=lambda i: (-round(full[u, items.index(i)], 9), i))[:top]
                ideal = sum(1 / math.log2(r + 2) for r in range(min(top, len(own))))
                gains.append(sum(1 / math.log2(r + 2) for r, i in enumerate(listed) if i in own) / ideal)
            if k < 30:
                assert got[k][f"ndcg_{top}"] == pytest.approx(np.mean(gains), abs=1e-6)


def test_ranks_of_test_items_equal_those_of_all_pairs(spark, monkeypatch):
    """Many ties and several turns, few items at first; no user's list of all items is made."""
    for name, x in {"FIRST_ITEMS": 8, "STRONG_ITEMS": 24, "BOUND_USERS": 5, "TEST_ROWS": 7, "SCORE_BYTES": 300}.items():
        monkeypatch.setattr(svd, name, x)
    monkeypatch.setattr(svd, "top_lists", None)
    rng = np.random.default_rng(11)
    u, v = rng.integers(-2, 3, (30, 3)).astype(float), rng.integers(-1, 2, (90, 3)).astype(float) / 2
    cells = {(int(a), int(b)): float(x) for a, b, x in zip(rng.integers(0, 30, 700), rng.integers(0, 90, 700), rng.integers(1, 6, 700), strict=True)}
    train, test = ({c: x for n, (c, x) in enumerate(sorted(cells.items())) if (n % 2 > 0) == kind} for kind in (True, False))
    test |= {(99, 3): 2.0, (4, 200): 5.0}  # an unknown user, an unknown item
    users = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(u)], "user_id long, us array<double>")
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_id long, v array<double>")
    found = svd.Svd(users, items, [3.0, 2.0, 1.0], items, np.eye(3), items, 90, 1)
    ranks, errors = svd.ranks_of_tests(found, *(frame(spark, [(*c, x) for c, x in rows.items()]) for rows in (train, test)), [1, 2, 5], 6, 1000)
    every = sorted({i for _, i in train} | {i for _, i in test})
    score = lambda a, b, k: float(u[a, :k] @ v[b, :k]) if a < 30 and b < 90 else 0.0
    want = set()
    for k in (1, 2, 5):
        for a in {a for a, _ in test}:
            best = sorted((b for b in every if (a, b) not in train), key=lambda b: (-score(a, b, k), b))[:6]
            want |= {(k, a, b, n) for n, b in enumerate(best, 1) if (a, b) in test}
    assert {(r["k"], r["user_id"], r["item_id"], r["rank"]) for r in ranks.collect()} == want and len(want) > 50
    for r in errors.collect():
        assert r["rmse"] == pytest.approx(np.sqrt(np.mean([(score(*c, r["k"]) - x) ** 2 for c, x in test.items()]))) and r["seconds"] > 0


def test_best_items_of_blocks_equal_those_of_all_pairs(spark):
    rng = np.random.default_rng(7)
    u, v = rng.integers(-2, 3, (17, 3)).astype(float), rng.integers(-2, 3, (23, 3)).astype(float)
    users = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(u)], "user_id long, us array<double>")
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_id long, v array<double>")
    gone = {(int(a), int(b)) for a, b in rng.integers(0, 17, (60, 2))} | {(0, i) for i in range(21)}
    pairs = spark.createDataFrame(sorted(gone), "user_id long, item_id long")
    got = {(r["k"], r["user_id"], r["rank"]): r["item_id"] for r in svd.top_lists(users, items, pairs, [1, 3], 4, 300).collect()}
    want = {}
    for k in (1, 3):
        for a in range(17):
            best = sorted((b for b in range(23) if (a, b) not in gone), key=lambda b: (-float(u[a, :k] @ v[b, :k]), b))[:4]
            want |= {(k, a, rank): b for rank, b in enumerate(best, 1)}
    assert got == want


def test_readers(spark, tmp_path):
    (tmp_path / "movielens_100k_u1.base").write_text("1\t2\t3\t4\n")
    (tmp_path / "movielens_100k_u1.test").write_text("5\t6\t1\t8\n")
    (tmp_path / "movielens_1m_dataset.dat").write_text("1::2::3::4\n2::2::0::4\n")
    (tmp_path / "ratings.csv").write_text("userId,movieId,rating,timestamp\n1,2,3.5,4\n")
    d = str(tmp_path)
    assert {tuple(r) for r in sources.load_ratings(spark, "ML-100K", d).collect()} == {(1, 2, 3.0, 4), (5, 6, 1.0, 8)}
    assert [tuple(r) for r in sources.load_ratings(spark, "ML-1M", d).collect()] == [(1, 2, 3.0, 4)]
    assert [tuple(r) for r in sources.load_ratings(spark, "ML-20M", d).collect()] == [(1, 2, 3.5, 4)]
    assert {r["part"] for r in sources.read_ml100k_split(spark, d).collect()} == {"train", "test"}
    with pytest.raises(ValueError):
        sources.load_ratings(spark, "?", d)
    assert {tuple(r) for r in sources.load_ratings(spark, "ML-100K", d, "last").collect()} == {(1, 2, 3.0), (5, 6, 1.0)}
    assert [tuple(r) for r in sources.load_ratings(spark, "ML-20M", d, "sum").collect()] == [(1, 2, 3.5)]


def test_blocks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("7:\n11,5\n12,3\n9:\n11,4\n")
    (tmp_path / "b.txt").write_text("2:\n13,1\n")
    got = sources.read_blocks(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")])
    assert {(r["user_id"], r["item_id"], r["rating"], r["source_item_id"]) for r in got.collect()} == {(11, 1, 5, 7), (12, 1, 3, 7), (11, 2, 4, 9), (13, 3, 1, 2)}


@pytest.mark.parametrize("split", [1, 3, 7, 64, 10_000])
def test_blocks_by_byte_ranges(spark, tmp_path, split):
    """Ranges that begin and end anywhere, files without a last line end, empty lines, spaces, dates on some lines, a block that goes on in the next file."""
    texts = ["7:\n11,5,2005-01-01\n12,3\n\n9: \r\n11,4\r\n", "13,1\n2:\n14,2.5", "", "15,4\n7:\n16,1\n"]
    want, item, source = [], 0, -1
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.txt").write_bytes(text.encode())
        for line in filter(None, (x.strip() for x in text.splitlines())):
            if line.endswith(":"):
                item, source = item + 1, int(line[:-1])
            else:
                want.append((int(line.split(",")[0]), item, float(line.split(",")[1]), source))
    got = blocks_of_ratings.read_blocks(spark, [str(tmp_path)], split)
    assert sorted((r["user_id"], r["item_id"], r["rating"], r["source_item_id"]) for r in got.collect()) == sorted(want)


def test_one_large_block_is_written_and_read_by_ranges(spark, tmp_path):
    own = spark.range(20_000).selectExpr("id AS user_id", "CASE WHEN id % 50 = 0 THEN id ELSE 17 END AS item_id", "CAST(1 + id % 5 AS DOUBLE) AS rating")
    blocks_of_ratings.write_blocks(own, str(tmp_path / "blocks"))
    back = blocks_of_ratings.read_blocks(spark, [str(tmp_path / "blocks")], 5_000)
    same = back.selectExpr("user_id", "source_item_id AS item_id", "rating")
    assert same.exceptAll(own).count() == own.exceptAll(same).count() == 0
    assert back.rdd.getNumPartitions() > 20


@pytest.mark.parametrize("split", [1, 5, 1000])
def test_matrix_files(spark, tmp_path, split):
    rng = np.random.default_rng(4)
    table = rng.integers(1, 6, (9, 13)) * (rng.random((9, 13)) < 0.3)
    table[:, [0, 5, 6, 12]] = 0  # empty columns
    table[:, 7] = 3  # and a full one
    rows = sorted((u, i, float(table[u, i])) for u in range(9) for i in range(13) if table[u, i])
    row, col = np.nonzero(table.T)[::-1]
    folder = tmp_path / "columns"
    folder.mkdir()
    np.save(folder / "jc.npy", np.concatenate([[0], np.cumsum((table != 0).sum(axis=0))]))
    np.save(folder / "ir.npy", row.astype(np.uint32))
    np.save(folder / "data.npy", table[row, col].astype(np.float32))
    np.save(tmp_path / "dense.npy", table.astype(np.int16))
    np.save(tmp_path / "turned.npy", np.asfortranarray(table.astype(float)))
    for path in (folder, tmp_path / "dense.npy", tmp_path / "turned.npy"):
        got = matrix.read_matrix_ratings(spark, str(path), split_entries=split)
        assert sorted((r["user_id"], r["item_id"], r["rating"]) for r in got.collect()) == rows
        assert split == 1000 or got.rdd.getNumPartitions() > 3
    swapped = matrix.read_matrix_ratings(spark, str(folder), swap_axes=True)
    assert sorted((r["item_id"], r["user_id"], r["rating"]) for r in swapped.collect()) == rows
    assert sources.load_ratings(spark, "Douban_monti", str(folder)).count() == len(rows)
    np.save(folder / "jc.npy", np.zeros(1, np.int64))
    np.save(folder / "data.npy", np.zeros(0))
    assert matrix.read_matrix(spark, str(folder)).count() == 0
    (folder / "ir.npy").unlink()
    with pytest.raises(Exception, match="lacks ir.npy"):
        matrix.read_matrix(spark, str(folder)).count()


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 100, 1000])
def test_permutations_are_whole_and_invertible(spark, n):
    key = F.col("key")
    rows = spark.range(n).join(spark.createDataFrame([(0,), (12345,), (2147483646,)], "key long"))
    got = rows.select("id", "key", permutation.permuted(F.col("id"), key, n).alias("place")).select("*", permutation.position(F.col("place"), key, n).alias("back")).collect()
    assert all(r["back"] == r["id"] for r in got)
    for k in (0, 12345, 2147483646):
        assert sorted(r["place"] for r in got if r["key"] == k) == list(range(n))
    assert n < 100 or len({tuple(r["place"] for r in got if r["key"] == k) for k in (0, 12345, 2147483646)}) == 3


def test_draws_are_uniform_over_a_large_catalogue(spark):
    """Chi-square of places and of pairs of draws, at 300,000 items."""
    n, users, draws = 300_000, 3_000, 4
    keys = spark.range(users).select("id", hashing.pair_hash("id", F.lit(0), 42).alias("key"))
    own = keys.select("id", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("t"), "key").select("id", "t", permutation.permuted(F.col("t"), F.col("key"), n).alias("place"))
    table = np.zeros((users, draws))
    for r in own.collect():
        table[r["id"], r["t"]] = r["place"]
    bound = lambda cells: cells - 1 + 5 * math.sqrt(2 * (cells - 1))
    for t in range(draws):
        seen = np.bincount((table[:, t] * 50 // n).astype(int), minlength=50)
        assert ((seen - users / 50) ** 2 / (users / 50)).sum() < bound(50)
        other = (t + 1) % draws
        pairs = np.bincount((table[:, t] * 10 // n).astype(int) * 10 + (table[:, other] * 10 // n).astype(int), minlength=100)
        assert ((pairs - users / 100) ** 2 / (users / 100)).sum() < bound(100)
        steps = np.bincount((((table[:, other] - table[:, t]) % n) * 50 // n).astype(int), minlength=50)
        assert ((steps - users / 50) ** 2 / (users / 50)).sum() < bound(50)
    assert len(np.unique(table)) > 0.97 * users * draws


@pytest.mark.parametrize("n", [1, 4, None])
def test_described_candidates_answer_as_the_listed_ones(spark, n):
    rng = np.random.default_rng(12)
    rows = {(int(u), int(i) * 3) for u, i in rng.integers(0, 15, (90, 2))} | {(77, i * 3) for i in range(15)}  # one has rated all
    train = frame(spark, [(u, i, 5) for u, i in rows])
    users, items = train.select("user_id").distinct(), train.select("item_id").distinct()
    own = candidates.sampled(users, items, train, n)
    listed = {(r["user_id"], r["item_id"]) for r in candidates.listed(own).collect()}
    every = spark.createDataFrame([(u, i) for u in (*range(15), 77, 999) for i in (*range(0, 45, 3), 1000)], "user_id long, item_id long")
    assert {(r["user_id"], r["item_id"]) for r in candidates.contains(own, every).where("contained").collect()} == listed
    assert candidates.contains(own, every).count() == 17 * 16
    sizes = {r["user_id"]: r["n_candidates"] for r in candidates.lengths(own).collect()}
    assert set(sizes) == {u for u, _ in rows} and sizes[77] == 0
    assert all(x == sum(u == v for v, _ in listed) for u, x in sizes.items())
    assert not listed & rows


def test_rank_distance_against_all_pairs(spark):
    rng = np.random.default_rng(13)
    rows = [(int(u), int(i), float(a), float(b)) for u, i, a, b in zip(rng.integers(0, 9, 300), range(300), rng.integers(1, 6, 300), rng.integers(0, 4, 300), strict=True)]
    rows += [(50, i, 3.0, 1.0) for i in range(20)] + [(51, 0, 1.0, 1.0)]
    p = q = t = 0
    for a, b in itertools.combinations(rows, 2):
        if a[0] == b[0]:
            x, y = np.sign(a[2] - b[2]), np.sign(a[3] - b[3])
            p, q, t = p + (x != 0 and x == y), q + (x * y < 0), t + (x == 0)
    own = spark.createDataFrame(rows, "user_id long, item_id long, rating double, score double")
    got = ranking.kendall(own, None).first()
    assert (got["concordant"], got["discordant"], got["ties"]) == (p, q, t)
    assert ranking.kendall(own.where("user_id > 99")).first()["total_pairs"] == 0


def test_bootstrap_of_any_scores(spark):
    rng = np.random.default_rng(14)
    for scores in (rng.integers(0, 2, 300).astype(float), np.where(rng.random(200) < 0.3, -2.5, 7.0), rng.integers(1, 6, 400) / 2, rng.normal(3, 2, 6000)):
        own = spark.createDataFrame([(float(x),) for x in scores] + [(None,), (float("nan"),)], "s double")
        got = stats.bootstrap(own, "s").first()
        means = rng.choice(scores, (1000, len(scores))).mean(axis=1)
        error = scores.std() / math.sqrt(len(scores))
        assert got["mean"] == pytest.approx(scores.mean(), abs=0.15 * error)
        assert got["low"] == pytest.approx(np.percentile(means, 2.5), abs=0.4 * error)
        assert got["high"] == pytest.approx(np.percentile(means, 97.5), abs=0.4 * error)
        assert stats.bootstrap(own, "s").first() == got
    same = stats.bootstrap(spark.createDataFrame([(2.0,)] * 5, "s double"), "s").first()
    assert (same["mean"], same["low"], same["high"]) == (2, 2, 2)
    assert stats.bootstrap(spark.createDataFrame([], "s double"), "s").first()["mean"] is None


def test_ranges_of_a_level_are_split(spark):
    """Half of all items have one rating: their places and sums come from many ranges."""
    own = spark.range(4_000).selectExpr("id AS item_id", "CASE WHEN id % 2 = 0 THEN 1 ELSE 2 + id % 7 END AS n")
    got = ranges.running_sum(own, [F.col("n").desc(), F.col("item_id")], "n", "reached", "every").orderBy(F.col("n").desc(), "item_id").collect()
    total = 0
    for r in got:
        total += r["n"]
        assert r["reached"] == total and r["every"] == sum(x["n"] for x in got)
    places = ranges.numbered(own, [F.col("n").desc(), F.col("item_id")], "place").orderBy("place").collect()
    assert [r["place"] for r in places] == list(range(4_000)) and [(r["n"], r["item_id"]) for r in places] == [(r["n"], r["item_id"]) for r in got]


def test_users_with_one_candidate_and_discordant_share(spark):
    test = frame(spark, [(1, 10, 5), (1, 11, 4), (2, 10, 5)])
    lists = spark.createDataFrame([(1, 10, 1.0, 1), (2, 10, 1.0, 1)], "user_id long, item_id long, score double, rank int")
    some = spark.createDataFrame([(1, 2), (2, 1)], "user_id long, n_candidates long")
    assert [r["user_id"] for r in ranking.ranking_metrics(lists, test, 2, candidates=some).collect()] == [1]
    scored = spark.createDataFrame([(1, 10, 5.0, 1.0), (1, 11, 4.0, 2.0), (2, 10, 5.0, 1.0), (3, 1, 1.0, 1.0), (3, 2, 5.0, 2.0)], "user_id long, item_id long, rating double, score double")
    got = scoring.discordant_share(scored).first()
    assert (got["users"], got["scored"], got["discordant"], got["share"]) == (3, 2, 1, pytest.approx(1 / 3))


def test_whole_experiments_and_sinks(spark, tmp_path):
    rng = np.random.default_rng(2)
    own = frame(spark, [(u, i, int(rng.integers(1, 6))) for u in range(25) for i in range(30) if rng.random() < 0.8])
    metrics, users = experiments.run_ranking(own, (3, 5))
    values = {r["metric"]: r["value"] for r in metrics.collect()}
    assert 0 <= values["ndcg@3"] <= 1 and 0 <= values["distance"] <= 1 and {r["k"] for r in users.collect()} == {3, 5}
    sinks.write_summary(metrics, str(tmp_path / "summary"))
    assert spark.read.option("header", True).csv(str(tmp_path / "summary")).count() == 1
    tail = experiments.run_long_tail(own)
    sinks.write_json(tail, str(tmp_path / "x.json"))
    assert "long_tail_1_5" in (tmp_path / "x.json").read_text()
    assert experiments.run_strong_and_subtle(own, "lenient").where("metric = 'n'").count() == 2
    rows, best = experiments.run_sweep(own, [1, 3])
    assert rows.count() == 2 and best.first()["k_rmse"] in (1, 3)


def test_scores_of_cold_cells(spark):
    train = spark.createDataFrame([(1, 1, 5.0), (1, 2, 3.0), (2, 1, 4.0), (2, 2, 1.0)], "user_id long, item_id long, rating double")
    cells = spark.createDataFrame([(1, 1, 5.0), (1, 9, 2.0), (8, 1, 3.0)], "user_id long, item_id long, rating double")
    got = {(r["user_id"], r["item_id"]): r["score"] for r in svd.score_cells(cells, svd.truncated_svd(train, 2), [2]).collect()}
    assert got[1, 9] == got[8, 1] == 0.0 and got[1, 1] == pytest.approx(5.0, abs=1e-6)


def test_full_completion_equals_that_of_all_cells(spark, monkeypatch, tmp_path):
    for name, x in {"USER_BLOCK": 4, "ITEM_BLOCK": 3}.items():
        monkeypatch.setattr(blocks, name, x)
    monkeypatch.setattr(scaling, "OUTER_ROWS", 5)
    rng = np.random.default_rng(15)
    train = frame(spark, [(u, i, 1 + (u * i) % 5) for u, i in {(int(a) * 3, int(b) + 100) for a, b in rng.integers(0, 11, (50, 2))}] + [(500, 100, 0)])
    fit = scaling.fit_sweeps(train, 3)
    known = train.where("rating > 0")
    cells = known.select("user_id").distinct().join(known.select("item_id").distinct())
    want = {(r["user_id"], r["item_id"]): r["value"] for r in scaling.complete(cells, train, fit).collect()}
    every = scaling.complete_all(train, fit)
    assert "Cartesian" not in every._jdf.queryExecution().toString() and "NestedLoop" not in every._jdf.queryExecution().toString()
    got = {(r["user_id"], r["item_id"]): r["value"] for r in every.collect()}
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c]) for c in want)
    scaling.write_completed(train, fit, str(tmp_path / "grid"))
    one = spark.read.parquet(str(tmp_path / "grid")).where("user_block = 1 AND item_block = 0")
    assert one.count() == 4 * 3 and one.inputFiles()


def test_sums_of_the_completion_equal_those_of_its_cells(spark):
    rng = np.random.default_rng(16)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 15, (90, 2))} | {(40, i) for i in range(15)}  # a user without unrated items
    train = frame(spark, [(u, i, 1 + (u * i) % 5) for u, i in pairs] + [(500, 3, 0)])
    fit = scaling.fit_sweeps(train, 3)
    want = {r[0]: tuple(r[1:]) for r in scaling.complete_all(train, fit).groupBy("user_id").agg(F.count("*"), F.sum("value"), F.max("value")).collect()}
    got = {r[0]: tuple(r[1:]) for r in scaling.completed_sums(train, fit).select("user_id", "n", "total", "greatest").collect()}
    assert got.keys() == want.keys() and 500 not in got and all(got[u] == pytest.approx(want[u], rel=1e-12) for u in want)


def test_parts_are_measured(spark):
    with measures.measured(spark, "part") as part:
        spark.range(200_000).repartition(3).selectExpr("sum(id * id)").collect()
        spark.range(10).count()
    assert part.jobs >= 2 and part.seconds > 0 and part.task_seconds > 0 and part.peak_mb >= 0
    with measures.measured(spark, "nothing") as part:
        pass
    assert (part.jobs, part.task_seconds) == (0, 0.0)


def test_sweep_times_grow_with_k(spark):
    rng = np.random.default_rng(16)
    own = frame(spark, [(u, i, 1 + (u + i) % 5) for u, i in {(int(a), int(b)) for a, b in rng.integers(0, 30, (600, 2))}])
    rows, best = experiments.run_sweep(own, [1, 3, 6])
    times = [r["Time(s)"] for r in rows.orderBy("k").collect()]
    assert times == sorted(times) and times[0] > 0
    assert set(rows.columns) >= {"k", "rmse", "ndcg_10", "ndcg_20", "Time(s)", "sweep_s", "sweep_task_s", "peak_mb"} and best.count() == 1
