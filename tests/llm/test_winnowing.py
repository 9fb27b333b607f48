import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from framewise.llm import winnowing as w


def brute(h, width):
    h, out = [x & (1 << 36) - 1 for x in h], []
    for i in range(max(1, len(h) - width + 1)) if h else []:
        win = h[i : i + width]
        at = i + max(q for q, x in enumerate(win) if x == min(win))
        if not out or out[-1] != at:
            out.append(at)
    return out


def tokens_of(text):
    return [xxhash.xxh64_intdigest(t.encode(), seed=42) for t in re.findall(r"[^ \t-\r]{1,8}", text or "")]


def rolled(text, k):
    """Cyclic polynomial of each window of k tokens, taken from that of the window before."""
    h, word = tokens_of(text), (1 << 64) - 1
    turn = lambda x, n: (x << n % 64 | x >> (64 - n % 64)) & word
    now, out = 0, []
    for i, x in enumerate(h):
        now = turn(now, 1) ^ x ^ (turn(h[i - k], k) if i >= k else 0)
        if i >= k - 1:
            out.append(now)
    return out


def test_rolling(spark, docs, odd):
    for df in (docs.limit(60), odd):
        for k in (1, 2, 3, 5, 8):
            for r in df.select("text", w.gram_hashes(F.col("text"), k).alias("g")).collect():
                want, n = rolled(r.text, k), len(tokens_of(r.text))
                assert [x % (1 << 64) for x in r.g] == want if n >= k else len(r.g) == min(1, n)


def test_minima(spark, docs, odd):
    for df in (docs.limit(60), odd):
        for r in df.select(w.gram_hashes(F.col("text")).alias("g"), w.places(w.winnow(F.col("text"))).alias("p")).collect():
            assert list(r.p) == brute(r.g, w.W)


def test_match_guarantee(spark):
    shared = " ".join(f"t{i}" for i in range(w.K + w.W - 1))
    df = spark.createDataFrame([(f"alpha beta {shared} gamma", f"{shared} delta epsilon zeta eta theta iota kappa")], "a string, b string")
    a, b = w.hashes(w.winnow(F.col("a"))), w.hashes(w.winnow(F.col("b")))
    assert df.select(F.size(F.array_intersect(a, b))).first()[0] > 0


def test_short_texts(spark):
    """From 60 characters of such words on, three quarters hold K + W - 1 tokens: something is shared."""
    words = "river lamp seven orange cloud paper stone music garden winter".split()
    texts = [" ".join(words[i:] + words[:i])[: 60 + i] for i in range(8)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert all(r.near_edited > 0 for r in w.op3(spark, table).collect())


def test_likeness(spark, docs):
    """near_edited and near_next against sets of kept hashes, made from the texts in plain Python."""

    def kept(text):
        h = rolled(text, w.K)
        return {h[i] & (1 << 36) - 1 for i in brute(h, w.W)} if h else None

    alike = lambda a, b: len(a & b) / len(a | b)
    texts = {r.doc_id: r.text for r in docs.collect()}
    order = sorted(texts)
    checked = 0
    for r in w.op3(spark, docs).collect():
        t, n = texts[r.doc_id], texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        own, edited, following = kept(t), kept(t[: len(t) - len(t) // 4] + n[: len(t) // 4]), kept(n)
        if own and edited and following:
            checked += 1
            assert abs(r.near_edited - alike(own, edited)) < 1e-12 and abs(r.near_next - alike(own, following)) < 1e-12
    assert checked > 100


def test_op3(spark, docs, odd, empty):
    texts = {r.doc_id: r.text for r in docs.collect()}
    order = sorted(texts)
    for r in w.op3(spark, docs).collect():
        t, n = texts[r.doc_id], texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(t)
        assert 0 <= r.near_next <= 1 and (len(t) < 200 or r.near_edited > r.near_next)
    rows = w.op3(spark, odd).collect()
    assert len(rows) == odd.count() and w.op3(spark, empty).count() == 0
    assert len({r.fingerprint for r in rows if r.doc_id in (0, 1)}) == 1
