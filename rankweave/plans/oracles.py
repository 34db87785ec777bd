"""SQL for the registered queries, in DuckDB's dialect."""

from __future__ import annotations

from rankweave.functions.hashing import pair_hash_sql
from rankweave.functions.permutation import permuted_sql

H = pair_hash_sql("user_id", "item_id")

_VIEW = """
  SELECT o_custkey AS user_id, l_partkey AS item_id,
         CAST(max(1 + (CAST(l_quantity AS BIGINT) - 1) % 5) AS DOUBLE) AS rating
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"""


def _sweeps(source: str, n: int, first: str, tag: str = "") -> str:
    """CTEs a<tag>1, b<tag>1, ... of alternating means of ln(rating)."""
    parts = []
    order = (("item_id", "b"), ("user_id", "a")) if first == "item" else (("user_id", "a"), ("item_id", "b"))
    before: tuple[str, str] | None = None
    for s in range(1, n + 1):
        for key, name in order:
            if before is None:
                body = f"SELECT {key}, avg(ln(rating)) AS {name} FROM {source} GROUP BY 1"
            else:
                table, far = before
                body = f"SELECT t.{key}, avg(ln(t.rating) - x.{far}) AS {name} FROM {source} t JOIN {table} x ON t.{'item_id' if far == 'b' else 'user_id'} = x.{'item_id' if far == 'b' else 'user_id'} GROUP BY 1"
            parts.append(f"{name}{tag}{s} AS MATERIALIZED ({body})")
            before = (f"{name}{tag}{s}", name)
    return ",\n".join(parts)


def _pairs(low: int) -> str:
    """CTEs q (ratings of users with all levels), pt (one rating of each of two levels), pn (the rest), pk (known items only)."""
    return f"""
lv AS (SELECT user_id FROM r WHERE rating IN (1, 2, 3, 4, 5) GROUP BY 1 HAVING count(DISTINCT rating) = 5),
q AS (SELECT r.* FROM r SEMI JOIN lv ON r.user_id = lv.user_id),
pp AS (SELECT *, row_number() OVER (PARTITION BY user_id, rating ORDER BY {H}, item_id) AS place FROM q WHERE rating IN ({low}, 5)),
pt AS (SELECT user_id, item_id, rating FROM pp WHERE place = 1),
pn AS MATERIALIZED (SELECT q.* FROM q ANTI JOIN pt ON q.user_id = pt.user_id AND q.item_id = pt.item_id),
pk AS (SELECT pt.* FROM pt SEMI JOIN pn ON pt.item_id = pn.item_id)"""


_SPLIT = f"""
pos AS (SELECT * FROM r WHERE rating >= 4),
ok AS (SELECT user_id FROM pos GROUP BY 1 HAVING count(*) >= 5),
sp AS MATERIALIZED (
  SELECT pos.*, row_number() OVER (PARTITION BY user_id ORDER BY {H}, item_id)
         <= greatest(1, CAST(floor(count(*) OVER (PARTITION BY user_id) * CAST(0.2 AS DOUBLE)) AS INTEGER)) AS is_test
  FROM pos SEMI JOIN ok ON pos.user_id = ok.user_id),
train AS (SELECT user_id, item_id, rating FROM sp WHERE NOT is_test),
test AS (SELECT user_id, item_id, rating FROM sp WHERE is_test)"""


def _scores(b: str) -> str:
    return f"""SELECT i.item_id, round(coalesce({b}.b, 0), 9) AS score FROM (SELECT DISTINCT item_id FROM sp) i LEFT JOIN {b} ON i.item_id = {b}.item_id"""


def _top(score: str, tag: str = "") -> str:
    return f"""
top{tag} AS MATERIALIZED (
  SELECT * FROM (
    SELECT u.user_id, s.item_id, s.score, row_number() OVER (PARTITION BY u.user_id ORDER BY s.score DESC, s.item_id) AS rank
    FROM (SELECT DISTINCT user_id FROM train) u CROSS JOIN {score} s
    ANTI JOIN train t ON u.user_id = t.user_id AND s.item_id = t.item_id)
  WHERE rank <= 10)"""


def _metrics(binary: bool, tag: str = "") -> str:
    gain = "1.0" if binary else "(power(2, {x}.rating) - 1)"
    return f"""
m{tag} AS MATERIALIZED (
  SELECT z.user_id, coalesce(h.hits, 0) / 10.0 AS precision, coalesce(h.hits, 0) / CAST(z.n AS DOUBLE) AS recall,
         coalesce(h.dcg / i.idcg, 0) AS ndcg, CASE WHEN coalesce(h.hits, 0) > 0 THEN 1 ELSE 0 END AS hit
  FROM (SELECT user_id, count(*) AS n FROM test GROUP BY 1) z
  LEFT JOIN (SELECT x.user_id, count(*) AS hits, sum({gain.format(x="t")} / (ln(x.rank + 1.0) / ln(2.0))) AS dcg
             FROM top{tag} x JOIN test t ON x.user_id = t.user_id AND x.item_id = t.item_id GROUP BY 1) h ON z.user_id = h.user_id
  LEFT JOIN (SELECT w.user_id, sum({gain.format(x="w")} / (ln(w.place + 1.0) / ln(2.0))) AS idcg
             FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, item_id) AS place FROM test) w
             WHERE w.place <= 10 GROUP BY 1) i ON z.user_id = i.user_id)"""


def _sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([f"r AS MATERIALIZED ({_VIEW})", *ctes]) + "\n" + body


_FIT = _sweeps("train", 4, "item")
_SCORED = f"sc AS MATERIALIZED ({_scores('b4')})"
_BASIC = (_SPLIT, _FIT, _SCORED)
_PAIR_FIT = _sweeps("pn", 3, "user")
_PAIR_SCORED = "ps AS (SELECT pk.user_id, pk.item_id, pk.rating, round(x.b, 9) AS score FROM pk JOIN b3 x ON pk.item_id = x.item_id)"
_TWO = """
two AS (SELECT user_id, min_by(rating, (rating, item_id)) AS r1, max_by(rating, (rating, item_id)) AS r2,
               min_by(score, (rating, item_id)) AS s1, max_by(score, (rating, item_id)) AS s2 FROM ps GROUP BY 1 HAVING count(*) = 2)"""
_STRICT = "st AS MATERIALIZED (SELECT user_id, CAST(CASE WHEN r1 = r2 THEN 0 WHEN sign(r1 - r2) <> sign(s1 - s2) THEN 1 ELSE 0 END AS BIGINT) AS contradicts FROM two)"
_STRONG = (_pairs(1), _PAIR_FIT, _PAIR_SCORED, _TWO, _STRICT)
_RAW = "SELECT o_custkey AS user_id, l_partkey AS item_id, l_quantity AS rating, o_orderdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
_TAIL = """
pop AS (SELECT item_id, count(*) AS n_ratings FROM r GROUP BY 1),
cum AS (SELECT item_id, n_ratings, CAST(sum(n_ratings) OVER (ORDER BY n_ratings DESC, item_id ROWS UNBOUNDED PRECEDING) AS DOUBLE)
               / sum(n_ratings) OVER () AS cum_share FROM pop),
tail AS (SELECT * FROM cum WHERE cum_share > CAST(0.33 AS DOUBLE))"""
_CANDIDATES = """
cand AS (SELECT u.user_id, i.item_id FROM (SELECT DISTINCT user_id FROM train) u CROSS JOIN (SELECT DISTINCT item_id FROM train) i
         ANTI JOIN train t ON u.user_id = t.user_id AND i.item_id = t.item_id)"""


def _drawn(cells: str, source: str) -> str:
    """CTE drawn: the free cells of a user with their place k in the user's own order of all items."""
    return f"""
it AS MATERIALIZED (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS place FROM (SELECT DISTINCT item_id FROM {source})),
gr AS MATERIALIZED (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM it)),
us AS (SELECT user_id, {pair_hash_sql("user_id", "0")} AS key FROM (SELECT DISTINCT user_id FROM {cells})),
dr AS MATERIALIZED (SELECT user_id, t, {permuted_sql("t", "key", "n", "a", "b")} AS place FROM (SELECT user_id, key, n, a, b, unnest(range(n)) AS t FROM us, gr)),
drawn AS (SELECT dr.user_id, it.item_id, row_number() OVER (PARTITION BY dr.user_id ORDER BY t) AS k
          FROM dr JOIN it ON dr.place = it.place SEMI JOIN {cells} c ON dr.user_id = c.user_id AND it.item_id = c.item_id)"""


_TOP_SELECT = "SELECT user_id, item_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM top"

ORACLES = {
    "ratings_view": _sql("SELECT * FROM r"),
    "ratings_summed": f"SELECT user_id, item_id, sum(rating) AS rating FROM ({_RAW}) GROUP BY 1, 2",
    "ratings_last": f"SELECT user_id, item_id, rating FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, rating DESC) AS k FROM ({_RAW})) WHERE k = 1",
    "item_popularity": _sql("SELECT item_id, count(*) AS n_ratings FROM r GROUP BY 1"),
    "user_counts": _sql("SELECT user_id, count(*) AS n_ratings, sum(rating) AS rating_sum FROM r GROUP BY 1"),
    "distinct_counts": _sql("SELECT count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items, count(*) AS ratings FROM r"),
    "rating_pivot": _sql("SELECT user_id, " + ", ".join(f"count(*) FILTER (rating = {v}) AS r{v}" for v in range(1, 6)) + " FROM r GROUP BY 1"),
    "threshold_filter": _sql("SELECT * FROM r WHERE rating >= 4"),
    "clean_matrix": _sql(
        """SELECT g.* FROM g SEMI JOIN (SELECT user_id FROM g GROUP BY 1 HAVING count(*) >= 10) u ON g.user_id = u.user_id
           SEMI JOIN (SELECT item_id FROM g GROUP BY 1 HAVING count(*) >= 12) i ON g.item_id = i.item_id""",
        "g AS (SELECT * FROM r WHERE rating >= 4)",
    ),
    "min_user_filter": _sql("SELECT pos.* FROM pos SEMI JOIN ok ON pos.user_id = ok.user_id", _SPLIT),
    "users_all_levels": _sql("SELECT user_id FROM r GROUP BY 1 HAVING count(DISTINCT rating) FILTER (rating IN (1, 2, 3, 4, 5)) = 5"),
    "users_all_levels_dense": _sql("""SELECT user_id FROM r GROUP BY 1 HAVING count(DISTINCT rating) FILTER (rating IN (1, 2, 3, 4, 5)) = 5
                                      AND count(DISTINCT item_id) < (SELECT count(DISTINCT item_id) FROM r)"""),
    "pair_qualified_users": _sql("SELECT user_id FROM r GROUP BY 1 HAVING bool_or(rating = 1) AND bool_or(rating = 5)"),
    "long_tail_items": _sql("SELECT item_id, n_ratings, round(cum_share, 9) AS cum_share FROM tail", _TAIL),
    "long_tail_ratings": _sql("SELECT r.* FROM r SEMI JOIN tail ON r.item_id = tail.item_id", _TAIL),
    "dense_index": _sql("SELECT user_id, item_id, dense_rank() OVER (ORDER BY user_id) - 1 AS user_idx, dense_rank() OVER (ORDER BY item_id) - 1 AS item_idx FROM r"),
    "holdout_train": _sql("SELECT * FROM train", _SPLIT),
    "holdout_test": _sql("SELECT * FROM test", _SPLIT),
    "pair_sample_strong": _sql("SELECT * FROM pk", _pairs(1)),
    "pair_sample_subtle": _sql("SELECT * FROM pk", _pairs(4)),
    "train_minus_pairs": _sql("SELECT * FROM pn", _pairs(1)),
    "long_tail_pairs": _sql(
        "SELECT lt.* FROM lt SEMI JOIN (SELECT r.* FROM r ANTI JOIN lt ON r.user_id = lt.user_id AND r.item_id = lt.item_id) n ON lt.item_id = n.item_id",
        _TAIL,
        "lv AS (SELECT user_id FROM r GROUP BY 1 HAVING count(DISTINCT rating) = 5)",
        "li AS (SELECT r.* FROM r SEMI JOIN lv ON r.user_id = lv.user_id SEMI JOIN tail ON r.item_id = tail.item_id)",
        "lb AS (SELECT user_id FROM li GROUP BY 1 HAVING bool_or(rating = 1) AND bool_or(rating = 5))",
        f"""lt AS (SELECT user_id, item_id, rating FROM (
              SELECT li.*, row_number() OVER (PARTITION BY user_id, rating ORDER BY {H}, item_id) AS place
              FROM li SEMI JOIN lb ON li.user_id = lb.user_id WHERE rating IN (1, 5)) WHERE place = 1)""",
    ),
    "nonempty_item_compaction": _sql("SELECT test.* FROM test SEMI JOIN train ON test.item_id = train.item_id", _SPLIT),
    "scale_item_factors": _sql("SELECT item_id, round(exp(b), 6) AS factor FROM b4", _SPLIT, _FIT),
    "scale_user_factors": _sql("SELECT user_id, round(exp(a), 6) AS factor FROM a4", _SPLIT, _FIT),
    "scale_residuals": _sql("""SELECT t.user_id, t.item_id, round(exp(ln(rating) - a - b), 6) AS residual
                               FROM train t JOIN a4 ON t.user_id = a4.user_id JOIN b4 ON t.item_id = b4.item_id""", _SPLIT, _FIT),
    "scale_complete": _sql("""SELECT s.user_id, s.item_id, round(CASE WHEN is_test THEN exp(coalesce(a, 0) + coalesce(b, 0)) ELSE rating END, 6) AS value
                              FROM sp s LEFT JOIN a4 ON s.user_id = a4.user_id LEFT JOIN b4 ON s.item_id = b4.item_id""", _SPLIT, _FIT),
    "scale_complete_all": _sql(
        """SELECT u.user_id, count(*) AS n, round(sum(coalesce(t.rating, exp(a + b))), 4) AS total, round(max(coalesce(t.rating, exp(a + b))), 6) AS greatest
           FROM a4 u CROSS JOIN b4 i LEFT JOIN train t ON u.user_id = t.user_id AND i.item_id = t.item_id GROUP BY 1""",
        _SPLIT, _FIT,
    ),
    "candidates_full": _sql("SELECT user_id, count(*) AS n_candidates, CAST(sum(item_id) AS BIGINT) AS item_sum FROM cand GROUP BY 1", _SPLIT, _CANDIDATES),
    "candidates_sampled": _sql("SELECT user_id, item_id FROM drawn WHERE k <= 10", _SPLIT, _CANDIDATES, _drawn("cand", "train")),
    "candidate_contains": _sql(
        """SELECT s.user_id, s.item_id, d.user_id IS NOT NULL AS contained FROM (SELECT user_id, item_id FROM r) s
           LEFT JOIN (SELECT * FROM drawn WHERE k <= 100) d ON s.user_id = d.user_id AND s.item_id = d.item_id""",
        _SPLIT, _CANDIDATES, _drawn("cand", "train"),
    ),
    "candidate_lengths": _sql("SELECT u.user_id, least(count(c.item_id), 100) AS n_candidates FROM (SELECT DISTINCT user_id FROM train) u LEFT JOIN cand c ON u.user_id = c.user_id GROUP BY 1", _SPLIT, _CANDIDATES),
    "candidates_negative": _sql(
        "SELECT user_id, item_id, true AS is_test FROM test UNION ALL SELECT user_id, item_id, false FROM drawn WHERE k <= 100",
        _SPLIT,
        """free AS (SELECT u.user_id, i.item_id FROM (SELECT DISTINCT user_id FROM test) u CROSS JOIN (SELECT DISTINCT item_id FROM sp) i
                    ANTI JOIN sp t ON u.user_id = t.user_id AND i.item_id = t.item_id)""",
        _drawn("free", "sp"),
    ),
    "candidates_rerank": _sql("SELECT DISTINCT user_id, item_id FROM test", _SPLIT),
    "candidate_totals": _sql("SELECT CAST(sum(n) AS BIGINT) AS total, round(avg(n), 6) AS average FROM (SELECT user_id, count(*) AS n FROM cand GROUP BY 1)", _SPLIT, _CANDIDATES),
    "array_candidates": _sql("SELECT user_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items FROM test GROUP BY 1", _SPLIT),
    "predictions_dict_explode": _sql("SELECT t.user_id, t.item_id, round(score, 6) AS score FROM test t JOIN sc ON t.item_id = sc.item_id", *_BASIC),
    "topk_items": _sql(_TOP_SELECT, *_BASIC, _top("sc")),
    "topk_all_candidates": _sql(
        "SELECT user_id, item_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM top", *_BASIC,
        "seen AS (SELECT sc.* FROM sc SEMI JOIN train ON sc.item_id = train.item_id)", _top("seen"),
    ),
    "precision_recall_ndcg": _sql("SELECT count(*) AS users, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(ndcg), 9) AS ndcg FROM m", *_BASIC, _top("sc"), _metrics(False)),
    "ndcg_per_user": _sql("SELECT user_id, round(precision, 9) AS precision, round(recall, 9) AS recall, round(ndcg, 9) AS ndcg FROM m", *_BASIC, _top("sc"), _metrics(False)),
    "ranking_binary": _sql("SELECT count(*) AS users, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(ndcg), 9) AS ndcg FROM m", *_BASIC, _top("sc"), _metrics(True)),
    "hit_rate": _sql("SELECT count(*) AS users, round(avg(hit), 9) AS hit_rate FROM m", *_BASIC, _top("sc"), _metrics(True)),
    "pair_scores_strict": _sql("SELECT * FROM st", *_STRONG),
    "pair_scores_lenient": _sql(
        "SELECT user_id, CAST(CASE WHEN s1 = s2 THEN 0 WHEN sign(r1 - r2) <> sign(s1 - s2) THEN 1 ELSE 0 END AS BIGINT) AS contradicts FROM two",
        _pairs(4), _PAIR_FIT, _PAIR_SCORED, _TWO,
    ),
    "tied_predictions": _sql("SELECT CAST(count(*) FILTER (n = 2 AND a = b) AS BIGINT) AS ties, count(*) AS users FROM (SELECT user_id, count(*) AS n, min(score) AS a, max(score) AS b FROM ps GROUP BY 1)", *_STRONG),
    "macro_stats": _sql("SELECT count(*) AS n, round(avg(contradicts), 9) AS mean, round(stddev_pop(contradicts) / sqrt(count(*)), 9) AS std_error FROM st", *_STRONG),
    "bootstrap_ci": _sql(
        f"""SELECT round(avg(k / CAST(n AS DOUBLE)), 9) AS mean, round(quantile_cont(k / CAST(n AS DOUBLE), 0.025), 9) AS low, round(quantile_cont(k / CAST(n AS DOUBLE), 0.975), 9) AS high
            FROM (SELECT b, n, coalesce(min(k), max(n)) AS k FROM un LEFT JOIN cdf ON cdf.reach >= un.u GROUP BY 1, 2)""",
        *_STRONG,
        "tot AS (SELECT count(*) AS n, CAST(sum(contradicts) AS BIGINT) AS ones, CAST(sum(contradicts) AS DOUBLE) / count(*) AS p FROM st)",
        f"""un AS (SELECT b, n, (({(x := '((b * 1000003 + 42 * 104729) % 2147483647)')} * {x} % 2147483647 * {x} + 12345) % 2147483647 + 0.5::DOUBLE) / 2147483647 AS u FROM tot, range(1000) AS y(b))""",
        """ks AS (SELECT n, p, unnest(range(CAST(greatest(0, floor(n * p - (12 * sqrt(n * p * (1 - p)) + 10))) AS BIGINT), CAST(least(n, ceil(n * p + (12 * sqrt(n * p * (1 - p)) + 10))) AS BIGINT) + 1)) AS k FROM tot)""",
        """lw AS (SELECT k, sum(step) OVER (ORDER BY k) AS w FROM (SELECT k, CASE WHEN k = min(k) OVER () THEN 0 ELSE ln((n - k + 1) / CAST(k AS DOUBLE) * (p / (1 - p))) END AS step FROM ks))""",
        "cdf AS MATERIALIZED (SELECT k, sum(exp(w - m)) OVER (ORDER BY k) / sum(exp(w - m)) OVER () AS reach FROM (SELECT *, max(w) OVER () AS m FROM lw))",
    ),
    "discordant_share": _sql(
        "SELECT count(*) AS users, count(contradicts) AS scored, CAST(sum(contradicts) AS BIGINT) AS discordant, round(sum(contradicts) / CAST(count(*) AS DOUBLE), 9) AS share FROM (SELECT DISTINCT user_id FROM ps) u LEFT JOIN st USING (user_id)",
        *_STRONG,
    ),
    "rerank_metrics": _sql(
        """SELECT count(*) AS users, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(ndcg), 9) AS ndcg FROM m
           SEMI JOIN (SELECT user_id FROM test GROUP BY 1 HAVING count(DISTINCT item_id) > 1) x ON m.user_id = x.user_id""",
        *_BASIC,
        """top AS MATERIALIZED (SELECT * FROM (SELECT t.user_id, t.item_id, s.score, row_number() OVER (PARTITION BY t.user_id ORDER BY s.score DESC, t.item_id) AS rank
           FROM (SELECT DISTINCT user_id, item_id FROM test) t JOIN sc s ON t.item_id = s.item_id) WHERE rank <= 10)""",
        _metrics(False),
    ),
    "train_plus_test": _sql("SELECT user_id, item_id, sum(rating) AS rating FROM sp GROUP BY 1, 2", _SPLIT),
    "kendall_global": _sql(
        """SELECT p AS concordant, q AS discordant, t AS ties, p + q AS total_pairs, round(coalesce(q / nullif(CAST(p + q AS DOUBLE), 0), 0), 9) AS distance FROM (
             SELECT count(*) FILTER (x.rating <> y.rating AND sign(x.rating - y.rating) = sign(x.score - y.score)) AS p,
                    count(*) FILTER (x.rating <> y.rating AND x.score <> y.score AND sign(x.rating - y.rating) <> sign(x.score - y.score)) AS q,
                    count(*) FILTER (x.rating = y.rating) AS t
             FROM k x JOIN k y ON x.user_id = y.user_id AND x.item_id < y.item_id)""",
        *_BASIC,
        """k AS MATERIALIZED (SELECT * FROM (SELECT s.user_id, s.item_id, s.rating, sc.score,
             row_number() OVER (PARTITION BY user_id ORDER BY abs(rating) DESC, s.item_id) AS place FROM sp s JOIN sc ON s.item_id = sc.item_id) WHERE place <= 200)""",
    ),
    "rmse": _sql("""SELECT round(sqrt(avg(power(exp(coalesce(a, 0) + coalesce(b, 0)) - rating, 2))), 9) AS rmse
                    FROM test t LEFT JOIN a4 ON t.user_id = a4.user_id LEFT JOIN b4 ON t.item_id = b4.item_id""", _SPLIT, _FIT),
    "best_sweep": _sql(
        """SELECT (SELECT k FROM e ORDER BY rmse, k LIMIT 1) AS k_rmse, (SELECT k FROM e ORDER BY ndcg DESC, k LIMIT 1) AS k_ndcg""",
        _SPLIT, _FIT,
        *(x for k in (1, 2, 3) for x in (f"sc{k} AS MATERIALIZED ({_scores(f'b{k}')})", _top(f"sc{k}", str(k)), _metrics(False, str(k)))),
        "e AS (" + " UNION ALL ".join(
            f"""SELECT CAST({k} AS BIGINT) AS k, round((SELECT avg(ndcg) FROM m{k}), 9) AS ndcg,
                (SELECT round(sqrt(avg(power(exp(coalesce(a, 0) + coalesce(b, 0)) - rating, 2))), 9)
                 FROM test t LEFT JOIN a{k} x ON t.user_id = x.user_id LEFT JOIN b{k} y ON t.item_id = y.item_id) AS rmse""" for k in (1, 2, 3)
        ) + ")",
    ),
    "netflix_blocks": _sql("SELECT user_id, dense_rank() OVER (ORDER BY item_id) AS item_id, rating, item_id AS source_item_id FROM r"),
}
