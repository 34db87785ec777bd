"""The registered queries over the smallest tables, against SQL or plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rankweave.llm import queries, token_counts, toxicity
from tests.llm import brute

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels".split()


def rows(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def result(spark, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, SF).collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    there = [c[0] for c in cursor.description]
    want = sorted(str(dict(sorted(zip(there, r, strict=True)))) for r in cursor.fetchall())
    assert sorted(str(dict(sorted(r.items()))) for r in result(spark, name)) == want


def test_main_text(spark):
    got = {r["page_id"]: r for r in result(spark, "op1_main_text")}
    assert set(got) == {p["page_id"] for p in rows("pages")}
    for r in got.values():
        assert r["n_chars"] == len(r["text"])
        assert all(line == " ".join(line.split()) and line for line in r["text"].split("\n")) or not r["text"]
        assert not any(x in r["text"] for x in ("<p>", "</", "&amp;", "<script"))
    assert sum(r["n_chars"] > 0 for r in got.values()) > 0.8 * len(got)


def test_warc_round_trip(spark):
    want, least = {}, {}
    for p in rows("pages"):
        size, label = brute.digest(p["html"])
        want[p["page_id"]] = (size, label)
        least[label] = min(least.get(label, p["page_id"]), p["page_id"])
    got = result(spark, "op2_warc_round_trip")
    assert len(got) == len(want)
    for r in got:
        owner = least[want[r["page_id"]][1]]
        assert (r["payload_bytes"], r["payload_digest"]) == want[r["page_id"]]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if owner == r["page_id"] else ("revisit", owner))


def test_token_counts(spark):
    first, later = token_counts.byte_level_pieces(queries.VOCABULARY)
    known = {}
    for d in rows("documents"):
        words = brute.space_words(d["text"])
        for w in words:
            known.setdefault(w, None)
        known[d["doc_id"]] = words
    count = {w: brute.pieces(w.encode(), first, later) for w in known if isinstance(w, str)}
    for r in result(spark, "op4_token_counts"):
        words = known[r["doc_id"]]
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(count[w] for w in words))


def test_personal_data(spark):
    texts = {d["doc_id"]: d["text"] for d in rows("documents")}
    some = 0
    for r in result(spark, "op7_personal_data"):
        want = brute.base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        for kind in ("email", "ip", "card", "phone"):
            assert r[f"n_{kind}"] == sum(x.startswith(kind) for x in want)
        assert set(want) <= set(r["spans"].split(","))
        some += bool(want)
    assert some > 10


def test_mix(spark):
    docs = {d["doc_id"]: d for d in rows("documents")}
    size = {i: len(brute.space_words(d["text"])) for i, d in docs.items()}
    of = defaultdict(list)
    for i, d in docs.items():
        of[d["source"]].append(i)
    order = sorted(of, key=lambda s: (s is None, s))
    total = {s: sum(size[i] for i in of[s]) for s in order}
    target = dict(zip(order, brute.targets([total[s] for s in order]), strict=True))
    got = result(spark, "op8_mix_sources")
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    taken = defaultdict(int)
    for r in got:
        s = docs[r["doc_id"]]["source"]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], total[s])
        assert r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in order:  # what is missing or over is less than any document that could still be added or left out
        gap = target[s] - taken[s]
        assert abs(gap) < 0.05 * target[s] + 1
        own = [r for r in got if docs[r["doc_id"]]["source"] == s and r["size"] > 0]
        assert not any(r["size"] <= abs(gap) - 1 and (r["copies"] < 3 if gap > 0 else r["copies"] > 0) for r in own)
    assert {r["doc_id"]: r["taken"] for r in got} == {r["doc_id"]: r["taken"] for r in result(spark, "op8_mix_sources")}


def test_toxicity_held_out(spark):
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pylist()}
    got = queries.op10_toxicity(spark, "/root/testdata/sf0.1").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [(r["score"], labels[r["doc_id"]]) for r in got if r["held_out"] and labels.get(r["doc_id"]) is not None]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    area = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert len(good) >= 50 and area > 0.85, (len(good), area)


def test_toxicity_with_letters_put_in(spark):
    """Words that 50 toxic and no clean documents hold get one letter, or two, anywhere inside, in all held-out documents."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(docs, labels)
    rows = docs.join(labels, "doc_id").where("text IS NOT NULL").select("doc_id", "toxic", "text", toxicity.held_out(F.col("doc_id")).alias("held")).collect()
    held = [Counter(), Counter()]
    for r in rows:
        held[r["toxic"]].update(set(re.findall(r"[a-z]+", r["text"].lower())))
    insults = [w for w, n in held[1].items() if n >= 50 and not held[0][w]]
    assert len(insults) >= 5
    pattern = re.compile(r"\b(" + "|".join(insults) + r")\b", re.IGNORECASE)

    def put(rng, word, n):
        for _ in range(n):
            i = rng.randrange(1, len(word))
            word = word[:i] + rng.choice("abcdefghijklmnopqrstuvwxyz") + word[i:]
        return word

    for n, least in ((0, 0.85), (1, 0.8), (2, 0.6)):
        changed = []
        for r in rows:
            if r["held"]:
                rng = random.Random(r["doc_id"])
                changed.append((r["doc_id"], r["toxic"], bool(pattern.search(r["text"])), pattern.sub(lambda m: put(rng, m[0], n), r["text"])))
        got = toxicity.score_documents(spark.createDataFrame(changed, "doc_id long, toxic int, insulting boolean, text string"), model).collect()
        toxic = [r for r in got if r["toxic"] == 1]
        insulting = [r for r in toxic if r["insulting"]]
        false = [r for r in got if r["toxic"] == 0 and r["predicted"] == 1]
        print(n, len(toxic), sum(r["predicted"] for r in toxic), len(insulting), sum(r["predicted"] for r in insulting), len(false), len(got) - len(toxic))
        assert sum(r["predicted"] for r in toxic) >= least * len(toxic)
        assert len(insulting) >= 50 and sum(r["predicted"] for r in insulting) >= (0.9 if n < 2 else 0.8) * len(insulting)
        assert len(false) <= 0.01 * (len(got) - len(toxic))
