"""The corpus pipeline: every stage on small tables and edge cases, and the whole of it."""

import os
import random
import subprocess
import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
CLASHES = ["size", "score", "predicted", "items", "spans", "base", "kept", "row", "doc", "text_key", "n_hit"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Tables with toxic, copied, leaked and personal texts, nulls, empty and long ones."""
    rng = random.Random(3)
    vocabulary = [f"{a}{b}{c}" for a in "bdfg" for b in ("ola", "eni", "uro") for c in ("", "st", "m", "ndu", "ka")]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    rows = [(i, text(rng.randrange(30, 80))) for i in range(260)]
    for i in range(0, 120, 3):
        rows[i] = (i, rows[i][1][:50] + " you grobnak snurfle grobnak " + rows[i][1][50:])
    long = text(20_000)
    items = [("q1", text(14)), ("q2", text(30))]
    rows += [(300, rows[200][1]), (301, rows[200][1] + " x"), (302, text(30) + " " + items[1][1] + " " + text(20)), (303, text(20) + " mail jo@ab.org or +1 (555) 010-2030"), (304, None), (305, ""), (306, long), (306, long), (None, text(20))]
    out = tmp_path_factory.mktemp("tables")
    docs = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "lang": ["en"] * len(rows), "source": [rng.choice(["a", "b", None]) for _ in rows], "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64())})
    pq.write_table(docs, out / "documents.parquet")
    pq.write_table(pa.table({"item_id": [i for i, _ in items], "text": [t for _, t in items]}), out / "benchmark.parquet")
    labelled = range(240)
    pq.write_table(pa.table({"doc_id": pa.array(labelled, pa.int64()), "quality": [1] * 240, "toxic": [int(i < 120 and i % 3 == 0) for i in labelled]}), out / "labels.parquet")
    return str(out), dict(items)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "mixing"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_edge_rows(spark, folder, name):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").where("doc_id IS NULL OR doc_id >= 300").withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    got = stage(name)(spark, docs, path)
    new = {"size", "source_size", "target", "copies", "taken"} if name == "mixing" else set()
    assert set(got.columns) == set(docs.columns) | new and len(set(got.columns)) == len(got.columns)
    found = got.collect()
    assert all(r[c] == f"own {c}" for r in found for c in CLASHES if c not in new)
    ids = sorted(r["doc_id"] or 0 for r in found)
    assert ids == {"near_duplicates": [0, 300, 302, 303, 304, 305, 306, 306], "decontamination": [0, 300, 301, 303, 304, 305, 306, 306]}.get(name, [0, 300, 301, 302, 303, 304, 305, 306, 306])
    if name == "personal_data":
        assert [r["text"][-27:] for r in found if r["doc_id"] == 303] == [" mail <email> or <phone>"[-27:]] or any(r["text"].endswith("mail <email> or <phone>") for r in found)
        assert all(r["n_chars"] == len(r["text"] or "") for r in found)
    assert stage(name)(spark, docs.limit(0), path).count() == 0


def test_whole_pipeline(spark, folder):
    path, items = folder
    before = {r["doc_id"]: r for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    got = corpus_pipeline.run(spark, path).collect()
    ids = {r["doc_id"] for r in got}
    toxic = {i for i in range(0, 120, 3)}
    assert len(toxic & ids) <= 2 and len(set(before) - toxic - ids) <= 8
    assert not {301, 302} & ids and {303, 304, 305, 306} <= ids and len(ids & {200, 300}) == 1
    known = list(items.items())
    assert all(brute.leaks(before[i]["text"], known)[1] == 0 for i in ids)
    # what is left has no near copies, by comparison of all pairs
    texts = {i: before[i]["text"] for i in ids if i is not None}
    assert all(c == i for i, (_, c) in brute.groups(texts, 5, 80).items())
    for r in got:
        assert "jo@ab.org" not in (r["text"] or "") and 0 <= r["taken"] <= 3 * r["size"]
        assert r["size"] == len(brute.space_words(r["text"]))


def test_toxicity_sends_texts_once(spark, folder):
    """A text goes to the workers inside its row or beside it, not both."""
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    plan = stage("toxicity")(spark, docs, path)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    sent = plan[next(i for i, x in enumerate(plan) if "MapInArrow" in x) + 1]
    assert "Project" in sent and "AS row#" in sent and "AS text#" not in sent and ", text#" not in sent.split(" AS row#")[1]


KEPT = r"""
import re
import numpy as np
from rankweave.llm import scratch, toxicity
def held():
    return int(re.search(r"\nPss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read())[1]) // 1024
def grow(batches):
    for n in batches:
        blocks = [np.ones(25_000) for _ in range(n)]  # 200 kB each: on the C library's heap
        keep.append(blocks[-1])
        yield held()
keep = []
before = held()
full = list(scratch.lean(grow)(iter([1000])))[0]
print(full - before, held() - before)
before = held()
kernel = toxicity.mapped_file((50_000, 1000))
kernel[:] = 1
print(held() - before, int(kernel.sum(dtype=float)))
"""


def test_worker_gives_memory_back():
    """What a task of the toxicity or near-duplicate stage took is free for the later stages of the same worker."""
    out = subprocess.run([sys.executable, "-c", KEPT], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": os.path.dirname(corpus_pipeline.__file__)}).stdout.split()
    full, kept, kernel, total = map(int, out)
    assert full > 150 and kept < 40 and kernel < 20 and total == 50_000_000
