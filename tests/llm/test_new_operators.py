"""Token shards, resampling, ranked search and foreign archives: edge rows and brute force."""

import gzip
import hashlib
import itertools
import math
import os
import random
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankweave.llm import importance, main_text, order, queries, search, token_shards, warc
from rankweave.llm.scratch import Scratch, new_path
from tests.llm import brute

DOCS = "doc_id long, text string, N_Words string, `odd.name` int, Rank int"
WORDS = "the a of river stone House über naïve 東京 x1 42 lamp".split()


def texts(n, seed=0):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) + rng.choice(["", ",", ".\n", "  "]) for _ in range(rng.choice([0, 1, 5, 30, 200]))) for _ in range(n)]


def edge_docs(spark, n=40):
    rows = [(i, t, "w", i, 1) for i, t in enumerate(texts(n))]
    rows += [(5, "same id, another text of river", "w", 1, 1)] * 2 + [(None, "no id the river", None, None, None), (101, None, "w", 1, None), (102, "", "w", 1, 1)]
    rows += [(103, "river stone " * 30_000, "w", 1, 1), (104, ". , !", "w", 1, 1)]
    return rows, spark.createDataFrame(rows, DOCS)


# --- token shards ---


@pytest.fixture(scope="module")
def tokenizer():
    own = Tokenizer.from_file(queries.TOKENIZER)
    own.encode_special_tokens = True
    return own


def test_pieces_put_together_are_the_tokenizers_own(tokenizer):
    with open(queries.TOKENIZER, encoding="utf-8") as f:
        encoder = token_shards.Encoder(f.read(), 2)
    rng = random.Random(1)
    parts = [" ", "  ", "\n", " \n", "\t", "\x1c", "\x85", " ", "　", " ", "a", "Bc", "don't", "'s", "é", " wörd,", " naïve.", "12", "3.5", "...", "''", "--", "<|endoftext|>", "漢字", "🙂", "(", ")", "_", "́", "Ⅷ", "ª", " Ελ"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert encoder([text])[0] == array("H", [*tokenizer.encode(text, add_special_tokens=False).ids, 2]).tobytes(), repr(text)


def test_shards_hold_every_document(spark, tokenizer):
    rows, docs = edge_docs(spark)
    folder = new_path(spark, "shards")
    token_shards.write_shards(docs, folder, queries.TOKENIZER, end_id=2, shard_bytes=2000)
    got = token_shards.read_shards(spark, folder).collect()
    want = Counter((r[0], tuple(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2])) for r in rows)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    got.sort(key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids[-1] is None and ids[:-1] == sorted(ids[:-1])
    at = 0
    for r in got:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4")))
        at += r["n_tokens"]
    assert len({r["start"] for r in got}) == len(got)
    some = token_shards.read_shards(spark, folder).where("doc_id IN (5, 101)").collect()
    assert sorted(r["doc_id"] for r in some) == [5, 5, 5, 101] and {str(r) for r in some} <= {str(r) for r in got}
    assert token_shards.read_shards(spark, folder, ids=False).where("ids IS NULL AND doc_id = 103").first()["n_tokens"] == [r for r in got if r["doc_id"] == 103][0]["n_tokens"]


def test_shards_share_a_dictionary_and_tell_damage(spark):
    _, docs = edge_docs(spark, 300)
    folder = new_path(spark, "shards")
    token_shards.write_shards(docs, folder, queries.TOKENIZER, end_id=2)
    fs, root = token_shards.open_fs(folder)
    with fs.open_input_stream(f"{root}/{token_shards.DICTIONARY}") as f:
        dictionary = f.read()
    assert dictionary
    names = [f"{root}/{x}" for x in os.listdir(root) if x.endswith(".tok")]
    for name in names:
        with fs.open_input_file(name) as f:
            head = f.read(41)
            assert head[:8] == token_shards.MAGIC and head[9:] == hashlib.sha256(dictionary).digest()
            lengths = token_shards.read_index(f)[2]
            f.seek(41)
            frame = f.read(int(lengths[0]))
        zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress(frame, max_output_size=1 << 22)  # one document by its offset alone
    with open(names[0], "r+b") as f:
        f.seek(41 + int(lengths[0]) // 2)
        byte = f.read(1)
        f.seek(-1, 1)
        f.write(bytes([byte[0] ^ 255]))
    with pytest.raises(Exception, match="damaged|ZstdError|zstd"):
        token_shards.read_shards(spark, folder).collect()


def test_empty_table_of_shards(spark):
    folder = new_path(spark, "shards")
    token_shards.write_shards(spark.createDataFrame([], DOCS), folder, queries.TOKENIZER, end_id=2)
    assert token_shards.read_shards(spark, folder).count() == 0


# --- resampling ---


def test_crcs_are_composed():
    shift, rng = importance.Shift(), random.Random(2)
    for _ in range(200):
        a, b = (bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 2, 7, 300, 70_000]))) for _ in "ab")
        got = shift.joined(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]))
        assert int(got[0]) == zlib.crc32(a + b)


@pytest.mark.parametrize(("max_n", "buckets"), [(1, 10_000), (2, 50), (4, 997)])
def test_resampling_against_strings(spark, max_n, buckets):
    rows, docs = edge_docs(spark)
    target = spark.createDataFrame([(1, "the RIVER of stone"), (2, None), (3, "lamp lamp, lamp")], "item_id long, text string")
    features = lambda t: [" ".join(w[i : i + n]) for w in [brute.alnum_words(t or "")] for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = (Counter(bucket(x) for text in own for x in features(text)) for own in ([r[1] for r in rows], ["the RIVER of stone", None, "lamp lamp, lamp"]))
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1.0) * all_s) / ((s[b] + 1.0) * all_t)))
    want = []
    for r in rows:
        own = features(r[1])
        h = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(x)) for x in own)
        want.append((r[0], len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(brute.alnum_words(r[1] or ""))))
    got = importance.resample(docs, target, percent=30, min_words=5, max_n=max_n, buckets=buckets).collect()
    assert got[0].__fields__ == ["doc_id", "text", "odd.name", "n_words", "n_features", "weight", "score", "rank"]
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["n_words"]) for r in got) == Counter(want)
    fit = sorted((x for x in want if x[4] >= 5), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, 30 * len(fit) // 100 + 1))
    assert [(r["score"], r["doc_id"]) for r in drawn] == [(x[3], x[0]) for x in fit[: len(drawn)]]


def test_resampling_without_rows_or_target(spark):
    _, docs = edge_docs(spark, 10)
    none = spark.createDataFrame([], "text string")
    assert importance.resample(spark.createDataFrame([], DOCS), none).count() == 0
    assert importance.resample(docs, none, percent=100, min_words=0).where("rank IS NULL").count() == 0


def test_places_of_many_equal_rows(spark):
    rows = Scratch(spark).keep(spark.range(5000).selectExpr("id % 3 AS k", "1 AS x"), "rows")
    got = order.numbered(rows, [F.col("k")], Scratch(spark), "place").collect()
    assert sorted(r["place"] for r in got) == list(range(5000))
    assert [r["k"] for r in sorted(got, key=lambda r: r["place"])] == sorted(r["k"] for r in got)


# --- ranked search ---


def ranked(rows, items, k):
    docs = [(r[0], brute.alnum_words(r[1] or "")) for r in rows]
    n, total = sum(bool(w) for _, w in docs), sum(len(w) for _, w in docs)
    tf = [(i, len(w), Counter(w)) for i, w in docs]
    df = Counter(t for _, _, c in tf for t in c)
    out = []
    for item, text in items:
        terms = dict.fromkeys(brute.alnum_words(text or ""))
        found = []
        for i, size, c in tf:
            m = 10 + 90 * size * n // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, None if missing else i, -s) for rank, (s, missing, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(map(str, out))


ITEMS = [(1, "The river, the STONE"), (2, "naïve 東京 42"), (3, "unknown words"), (4, None), (5, ""), (6, "a a a a"), (6, "lamp"), (None, "house of x1"), (8, " ".join(WORDS))]


@pytest.mark.parametrize(("k", "limits"), [(1, {}), (3, {"SHARD_DOCS": 4}), (10, {"SHARD_PAIRS": 30, "FIRST_RUN": 1, "LONGEST_RUN": 3}), (500, {"FIRST_RUN": 2})])
def test_search_against_all_scores(spark, monkeypatch, k, limits):
    for name, x in limits.items():
        monkeypatch.setattr(search, name, x)
    rows, docs = edge_docs(spark, 60)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = search.search(docs.repartition(3), items, k, block=4).collect()
    assert sorted(str((r["item_id"], r["rank"], r["doc_id"], r["score"])) for r in got) == ranked(rows, ITEMS, k)


def test_search_of_equal_documents_and_empty_tables(spark):
    rows = [(i, "river stone", "", 0, 0) for i in range(200)] + [(i, "river", "", 0, 0) for i in range(200, 260)]
    docs, items = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(1, "stone river")], "item_id long, text string")
    got = search.search(docs, items, 10).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == list(range(10)) and len({r["score"] for r in got}) == 1
    assert search.search(spark.createDataFrame([], DOCS), items).count() == 0
    assert search.search(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_numbers_are_packed():
    rng = np.random.default_rng(3)
    values = np.concatenate([[0, 1, 127, 128, 16383, 16384, 2**31, 2**62], rng.integers(0, 2**40, 100)])
    data, begins = search.pack(values)
    assert search.unpack(data).tolist() == values.tolist()
    assert all(search.unpack(data[a:b]).tolist() == [v] for a, b, v in zip(begins, begins[1:], values.tolist(), strict=False))
    assert search.pack(np.zeros(0, np.int64))[0] == b"" and search.unpack(b"").tolist() == []


def test_search_puts_lists_aside(monkeypatch):
    """A common term is looked up, not merged, once the rare one has set the bar; the best are the same as by adding all up."""
    rng = np.random.default_rng(4)
    shard = search.Shard.__new__(search.Shard)
    shard.lists = {}
    for t, (n, top) in {"common": (9000, 5), "middle": (3000, 9), "rare": (200, 90)}.items():
        at = np.sort(rng.choice(10_000, n, replace=False))
        score = rng.integers(1, top, n)
        shard.lists[t] = at, score, int(score.max())
    total = np.zeros(10_000, np.int64)
    for at, score, _ in shard.lists.values():
        total[at] += score
    want = sorted(((-int(s), d) for d, s in enumerate(total) if s))[:10]
    merged = []
    own = search.merged
    monkeypatch.setattr(search, "merged", lambda lists: merged.append(sum(map(len, lists))) or own(lists))
    assert search.search_shard(shard, ["common", "middle", "rare", "absent"], 10) == [(-s, d) for s, d in want]
    assert merged[-1] < 4000


# --- foreign archives ---


def foreign(n):
    out = []
    for i in range(n):
        body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>page {i}</p>{'x' * (i * 3000)}".encode()
        payload = body.split(b"\r\n\r\n", 1)[1]
        digest = warc.sha1_label(hashlib.sha1(payload if i != 2 else b"another").digest())
        out.append((f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:{i}>\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Type: application/http\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n", payload))
    return out


@pytest.mark.parametrize("cut", [None, 1, 2, 977])
def test_foreign_gzip_archives(spark, tmp_path, cut):
    """All records in one member, one or two in each, and members that end inside a record."""
    records = foreign(9)
    data = b"".join(r for r, _ in records)
    if cut in (1, 2):
        members = [gzip.compress(b"".join(r for r, _ in own)) for own in itertools.batched(records, cut)]
    else:
        members = [gzip.compress(data[a : a + (cut or len(data))]) for a in range(0, len(data), cut or len(data))]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members))
    got = {r["record_id"]: r for r in warc.read_archive(spark, str(tmp_path)).collect()}
    assert len(got) == 9 and all(bytes(got[f"urn:x:{i}"]["payload"]) == p and got[f"urn:x:{i}"]["digest_ok"] == (i != 2) for i, (_, p) in enumerate(records))
    assert warc.read_archive(spark, str(tmp_path), payload=False).count() == 9


def test_filters_on_digest_and_length_follow_what_is_reported(spark, tmp_path):
    records = foreign(5)
    (tmp_path / "a.warc").write_bytes(b"".join(r for r, _ in records))
    own = lambda raw: warc.sha1_label(hashlib.sha1(raw).digest())
    read = warc.read_archive(spark, str(tmp_path))
    assert [r["record_id"] for r in read.where(F.col("payload_digest") == own(records[2][1])).collect()] == ["urn:x:2"]
    assert read.where(F.col("payload_digest") == own(b"another")).count() == 0
    assert [r["record_id"] for r in read.where(F.col("payload_bytes") == len(records[3][1])).collect()] == ["urn:x:3"]
    told = warc.read_archive(spark, str(tmp_path), payload=False)
    assert [r["record_id"] for r in told.where(F.col("payload_digest") == own(b"another")).collect()] == ["urn:x:2"]


# --- main text in forms ---


@pytest.mark.parametrize(("inside", "outside"), [(18, 2), (17, 3), (12, 8)])
def test_a_form_around_the_text_is_no_furniture(inside, outside):
    """Density decides, not the form's share of the page; a small form beside the text is still one."""
    part = lambda n, mark="": "".join(f"<p>Paragraph {mark}{i} has some plain words that make up an ordinary text of a page, as it is.</p>" for i in range(n))
    text = main_text.main_text(f"<body><form action=/x><div>{part(inside)}</div></form><div>{part(outside, 'o')}</div></body>")
    assert all(f"Paragraph {i} " in text for i in range(inside))
    text = main_text.main_text(f"<body><div>{part(inside)}</div><form action=/x>{part(2, 'f')}</form></body>")
    assert text.count("Paragraph") == inside and "Paragraph f" not in text


@pytest.mark.parametrize("name", ["ad-content", "sidebar-content", "footer-content", "main-nav"])
def test_the_content_of_furniture_is_furniture(name):
    part = "".join(f"<p>Paragraph {i} has some plain words that make up an ordinary text of a page, as it is.</p>" for i in range(6))
    text = main_text.main_text(f"<body><div class='post content'>{part}</div><div class='{name}'><p>This is not a part of the text, and nobody reads it here.</p></div></body>")
    assert text.count("Paragraph") == 6 and "nobody" not in text
