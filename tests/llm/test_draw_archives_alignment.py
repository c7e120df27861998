"""Resampling, WARC archives and token alignment against brute force, with nulls, long texts, ties and repeated rows."""

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vigil.llm import alignment, resampling, warc
from vigil.llm.common import scratch

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def texts(seed=5, n=90):
    r = random.Random(seed)
    words = ["".join(r.choice("abcDEÉñ9") for _ in range(r.randint(1, 6))) for _ in range(200)]
    out = [r.choice([" ", ", ", "\n", "-", "\x7f"]).join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(n)]
    return out + [None, "", " \n", "x", out[0], "日本語　raum", "wort " * 900, "ein" + "lang" * 500 + " " + "ende " * 40]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "chunk", i % 3) for i, t in enumerate(texts())]
    rows += [rows[3], rows[3], (4, "anders " * 25, "weight", 1), (None, "ohne nummer " * 15, None, None), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, carry string, score int").repartition(3)


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(1, "wort wort a b c"), (2, None), (3, "Ziel abc " * 30)], "item_id long, text string")


def runs(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)], len(w)


def drawn(docs, target, n, buckets, seed, least, share):
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = (Counter(bucket(x) for (text,) in df.select("text").collect() for x in runs(text, n)[0]) for df in (docs, target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for r in docs.collect():
        found, words = runs(r.text, n)
        h = int(hashlib.sha256(f"{seed}:{'null' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(x)) for x in found)
        rows.append((r.doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words))
    fit = sorted((x for x in rows if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0]))
    ranks = {}
    for i, x in enumerate(fit[: len(fit) * share // 100]):
        ranks.setdefault(x, []).append(i + 1)
    return Counter((*x[:4], ranks[x].pop(0) if ranks.get(x) else None) for x in rows)


@pytest.mark.parametrize("n,size,buckets,share", [(1, resampling.CHUNK, 10_000, 10), (1, 40, 10_000, 60), (3, 64, 97, 100), (2, 1, 50, 35)])
def test_resampling(docs, target, n, size, buckets, share):
    got = Counter(tuple(r) for r in resampling.resample(docs, target, n, buckets, size=size, share=share).collect())
    want = drawn(docs, target, n, buckets, resampling.SEED, resampling.LEAST, share)
    assert got == want


def test_chunks_own_every_start(spark):
    r = random.Random(1)
    for n in (1, 2, 4):
        for text in texts(9, 30):
            data, hashed = (text or "").encode(), resampling.Hashed(1 << 31)
            size = r.choice([1, 7, 50, 10**6])
            parts = list(resampling.cut(data, n, size))
            whole, words = resampling.features(data, n, 0, hashed)
            each = [resampling.features(part, n, carry, hashed) for part, carry in parts]
            assert sorted(x for found, _ in each for x in found.tolist()) == sorted(whole.tolist())
            assert sum(own for _, own in each) == words and all(carry < n for _, carry in parts)


def test_resampling_of_nothing(docs, target):
    assert resampling.resample(docs.where("false"), target).count() == 0
    assert resampling.resample(docs, target.where("false")).count() == docs.count()
    kept = resampling.drawn(docs, target, share=50)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


PAGES = "page_id long, url string, html string, size int, first string"


@pytest.fixture(scope="module")
def pages(spark):
    r = random.Random(2)
    bodies = ["<p>eins</p>", "", None, "<p>é 日本</p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc", "x" * 300_000, "HTTP/1.1 200 OK\r\n\r\n", "\r\n\r\n\r\n", "a\x00b"]
    rows = [(i, f"https://a.example/{i} x\n", r.choice(bodies), i, "c") for i in range(60)] + [(100 + i, None, f"allein {i}", None, None) for i in range(5)]
    rows += [rows[5], rows[5], (None, "u", "<p>eins</p>", 1, ""), (None, "u", "nur ohne nummer", 1, "")]
    return spark.createDataFrame(rows, PAGES).repartition(4)


@pytest.mark.parametrize("least", [0, 12])
def test_archives(pages, least):
    every = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for i, body in every:
        if len(body) >= least and i is not None:
            first[body] = min(i, first.get(body, i))
    want = Counter()
    for i, body in every:
        to = first.get(body)
        again = to is not None and i != to
        want[(i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", to if again else None)] += 1
    assert Counter(tuple(r) for r in warc.round_trip(pages, "page_id", "url", "html", least).collect()) == want


def test_archives_are_plain_warc(spark, pages):
    path = scratch(spark, "plain")
    warc.write(pages, path, "page_id", "url", "html", codec="none")
    found = warc.records(spark, path).collect()
    assert len(found) == pages.count() and {r.type for r in found} == {"response", "revisit"}
    assert all(r.payload == b"" and r.refers_to for r in found if r.type == "revisit") and all(r.digest == r.declared for r in found if r.type == "response")
    assert {r.uri for r in found if r.key == "7"} == {"https://a.example/7%20x"} and {r.uri for r in found if r.key == "102"} == {None}
    name = {r.file for r in found}.pop().removeprefix("file:")
    assert open(name, "rb").read().startswith(b"WARC/1.1\r\nWARC-Type: ")


def member(kind, record, block, **fields):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{record}>\r\nContent-Length: {len(block)}\r\n" + "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items())
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


def test_other_archives(spark, tmp_path):
    """Members of their own, records of other kinds, revisits by digest alone and of what isn't there; rewritten and read again."""
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    kind = {"Content_Type": "application/http; msgtype=response"}
    one = [
        member("warcinfo", "i", b"software: x"), member("response", "a", http + b"body", WARC_Payload_Digest=sha(b"body"), WARC_Date="2024-01-02T00:00:00Z", **kind),
        member("response", "b", http + b"body", WARC_Payload_Digest=sha(b"body"), WARC_Date="2024-01-01T00:00:00Z", **kind), member("resource", "r", b"plain"),
    ]
    two = [
        member("revisit", "c", http, WARC_Payload_Digest=sha(b"body"), **kind), member("revisit", "d", http, WARC_Payload_Digest=sha(b"body"), WARC_Refers_To="<a>", **kind),
        member("revisit", "e", http, WARC_Payload_Digest=sha(b"gone"), **kind), member("response", "f", http + b"wrong", WARC_Payload_Digest=sha(b"right"), **kind),
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.warc.gz").write_bytes(b"".join(map(gzip.compress, one)))
    (tmp_path / "in/two.warc").write_bytes(b"".join(two))
    got = {r.record_id: r for r in warc.resolved(warc.headers(spark, f"file://{tmp_path}/in")).collect()}
    assert {k: (r.full_size, r.intact, r.original) for k, r in got.items()} == {
        "<i>": (11, True, None), "<a>": (4, True, None), "<b>": (4, True, None), "<r>": (5, True, None), "<c>": (4, True, "<b>"), "<d>": (4, True, "<a>"), "<e>": (None, False, None), "<f>": (5, False, None),
    }
    warc.rewrite(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    again = warc.resolved(warc.headers(spark, f"file://{tmp_path}/out")).collect()
    assert Counter((r.type, r.full_size) for r in again) == {("response", 4): 1, ("revisit", 4): 3, ("response", 5): 1} and all(r.intact for r in again)
    (tmp_path / "in/three.warc").write_bytes(one[1][:-6])
    with pytest.raises(Exception, match="three.warc"):
        warc.headers(spark, f"file://{tmp_path}/in").count()


def test_archives_of_nothing(pages):
    assert warc.round_trip(pages.where("false"), "page_id", "url", "html").count() == 0


A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def aligned(text):
    """Token spans of both tokenizers by the libraries on the whole text, or None."""
    if not text:
        return None
    left, right, of_a, of_b = alignment.tokenizers(A, B)
    a, b = Tokenizer.from_file(A), right
    a.encode_special_tokens = True
    ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
    spans = []
    for x, of in zip(ids, (of_a, of_b)):
        if b"".join(of[i] for i in x) != (" " + text).encode():
            return None
        at, out = 0, []
        for i in x:
            out.append((at, at + len(of[i]), i))
            at += len(of[i])
        spans.append(out)
    return spans


def test_alignment(spark):
    rows = [(i, t) for i, t in enumerate(texts(11, 50))] + [(1000, "a▁b"), (1001, "  zwei  räume \n  x\t y  "), (1002, "<|endoftext|> <s> hi</s> <0x41> é é 🙂🙃   x"), (1003, "\x00a \x1c b\x85 c"), (1004, "it's 12,000.50 don't"), (None, "ohne nummer"), (7, "noch einmal 7")]
    rows += [(3, rows[3][1]), (2**60 + 1, "gross" + " und" * 2000)]
    docs = spark.createDataFrame([(*r, "n_a", 1) for r in rows], "doc_id long, text string, pairs string, block int").repartition(3)
    spans = [aligned(t) for _, t in rows]
    links = [[(x[2], y[2]) for x in s[0] for y in s[1] if x[0] < y[1] and y[0] < x[1]] if s else [] for s in spans]
    count = Counter(pair for some in links for pair in set(some))
    most = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    want = Counter()
    for (i, _), s, some in zip(rows, spans, links):
        groups = []
        if s:
            ends = sorted({x[1] for x in s[0]} & {y[1] for y in s[1]})
            for lo, hi in zip([0, *ends], ends):
                groups.append("|".join(",".join(str(x[2]) for x in side if lo < x[1] <= hi) for side in s))
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if s else ""
        want[(i, len(s[0]) if s else 0, len(s[1]) if s else 0, len(groups), len(some), sum(count[p] == most[p[0]] for p in some), sum(count[p] for p in some), digest)] += 1
    assert Counter(tuple(r) for r in alignment.align(docs, A, B).collect()) == want
    assert {(r.a, r.b): r.n for r in alignment.links(docs, A, B).collect()} == dict(count)
    assert alignment.align(docs.where("false"), A, B).count() == 0


def test_packed_positions():
    import numpy as np

    for held, times in [([], []), ([0], [1]), ([5, 70_000, 70_001, 400_000], [1, 300, 2, 255]), ([65_535, 131_070], [256, 1000])]:
        at, n = alignment.unpacked(*alignment.packed(np.array(held, np.int64), np.array(times, np.int64)))
        total = Counter()
        for a, t in zip(at.tolist(), n.tolist()):
            total[a] += t
        assert {a: t for a, t in total.items() if t} == dict(zip(held, times))


def test_blocks_and_forgotten_segments(spark, monkeypatch):
    """Small blocks, and segments that are forgotten between them, give what large ones give."""
    import pandas as pd

    values = [t for t in texts(12, 40) if t]
    whole = alignment.Block(alignment.Segments(A, B))
    whole.add([str(i) for i in range(len(values))], values)
    want = whole.rows(0).set_index("doc_id")[["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]]
    known, parts = alignment.Segments(A, B), []
    for i in range(0, len(values), 7):
        block = alignment.Block(known)
        block.add([str(j) for j in range(i, min(i + 7, len(values)))], values[i : i + 7])
        parts.append(block.rows(i))
        known = alignment.Segments(A, B) if i % 14 else known
    got = pd.concat(parts).set_index("doc_id")[["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]]
    assert got[got.index.notna()].sort_index().astype(str).equals(want[want.index.notna()].sort_index().astype(str))
