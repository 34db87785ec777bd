"""URL filtering by host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm.rows import named, packed, unpacked
from rankweave.llm.scratch import Scratch

#: The most rules that are sent to every executor; larger rule sets are shuffled.
BROADCAST_RULES = 100_000
#: A place that holds more than this share of the pages is judged by a broadcast row; there are at most as many such places as shares.
HOT_SHARES = 1000

RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules as rows (host, path, verdict)."""
    shape = "array<struct<host:string,path:string,verdict:string>>"
    parts = [F.struct(*(F.lit(x).alias(c) for x, c in zip(r, ("host", "path", "verdict"), strict=True))) for r in rules]
    return spark.range(1).select(F.inline(F.array(*parts).cast(shape)))


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(raw, upper, upper.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    # the NUL keeps ("a.b", "/") and ("a", ".b/") apart
    return F.sha2(F.concat(host, F.lit("\u0000"), path), 256)


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    url_col: str = "url",
    default: str = "allow",
    prefix_hex: int = 8,
    broadcast_rules: int = BROADCAST_RULES,
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``pages``.

    Each distinct (host, path) becomes expressions: its host suffixes with as
    many labels as some rule has, times its path prefixes as long as some
    rule's path.  They meet the rules in an equi-join on a short prefix of the
    expression's SHA-256, the whole digest confirms, and the longest rule
    (host and path together; then the longer host; then block) wins.

    A null url, or one without ``://``, has an empty host and path and fits no
    rule; rows without a rule get ``default``.  Repeated rows stay, no rows give
    no rows.  Columns of ``pages`` named host, path, rule or verdict (in any
    case) are replaced, all others stay.  A rule with a null part is ignored;
    repeated rules count once.
    """
    scratch = Scratch(pages.sparkSession)
    labels = lambda host: F.size(F.split(host, r"\."))
    usable = rules.select("host", "path", "verdict").dropna().distinct()
    shape = usable.agg(
        F.collect_set(labels(F.col("host"))).alias("labels"),
        F.collect_set(F.length("path")).alias("lengths"),
        F.count("*").alias("n"),
    ).first()  # two small integer sets: label counts and path lengths that occur
    coded = usable.select(
        _digest(F.col("host"), F.col("path")).alias("rule_digest"),
        F.concat("host", "path").alias("rule"),
        F.length("host").alias("rule_host_len"),
        "verdict",
    ).withColumn("short", F.substring("rule_digest", 1, prefix_hex))
    if shape["n"] <= broadcast_rules:
        coded = F.broadcast(coded)

    located = pages.select(
        packed(pages, ("host", "path", "rule", "verdict")).alias("row"),
        url_host(named(url_col)).alias("host"),
        url_path(named(url_col)).alias("path"),
    )
    places = scratch.keep(located.groupBy("host", "path").agg(F.count("*").alias("n")), "places")
    parts = F.split("host", r"\.")
    counts = F.array(*(F.lit(n) for n in sorted(shape["labels"]))) if shape["labels"] else F.array().cast("array<int>")
    lengths = F.array(*(F.lit(n) for n in sorted(shape["lengths"]))) if shape["lengths"] else F.array().cast("array<int>")
    suffixes = F.transform(
        F.filter(counts, lambda n: n <= F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."),
    )
    prefixes = F.transform(
        F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)
    )
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: _digest(h, p))))
    hits = (
        places.select("host", "path", F.explode(pairs).alias("digest"))
        .withColumn("short", F.substring("digest", 1, prefix_hex))
        .join(coded, "short")
        .where(F.col("digest") == F.col("rule_digest"))
    )
    best = hits.groupBy("host", "path").agg(
        F.max(
            F.struct(
                F.length("rule").alias("len"),
                F.col("rule_host_len"),
                (F.col("verdict") == "block").alias("blocks"),
                F.col("rule"),
                F.col("verdict"),
            )
        ).alias("best")
    )
    best = scratch.keep(best, "best")
    # rows of hot places get their rule by a broadcast, and are spread over slots that match nothing in the shuffled join
    total = places.agg(F.sum("n")).first()[0] or 0
    hot = places.where(F.col("n") > max(64, total // HOT_SHARES)).select("host", "path").join(best, ["host", "path"], "left")
    hot = F.broadcast(hot.select("host", "path", F.col("best").alias("own"), F.lit(True).alias("hot")))
    told = located.join(hot, ["host", "path"], "left").withColumn("slot", F.when(F.col("hot"), F.pmod(F.xxhash64("row"), F.lit(HOT_SHARES)) + 1).otherwise(0))
    judged = told.join(best.withColumn("slot", F.lit(0).cast("long")), ["host", "path", "slot"], "left")
    rule = F.coalesce("best", "own")
    return judged.select(
        *unpacked(judged), "host", "path", rule["rule"].alias("rule"), F.coalesce(rule["verdict"], F.lit(default)).alias("verdict")
    )


ORACLE = """
WITH split AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(h, p, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
judged AS (
  SELECT page_id, host, path, h || p AS rule, verdict,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || p) DESC) AS k
  FROM split JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p))
SELECT s.page_id, s.host, s.path, j.rule, coalesce(j.verdict, 'allow') AS verdict
FROM split s LEFT JOIN judged j ON s.page_id = j.page_id AND s.host = j.host AND s.path = j.path AND j.k = 1
"""
