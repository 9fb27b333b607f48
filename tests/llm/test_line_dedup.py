import random
import time

from framewise.llm import line_dedup as d


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    s, t = sorted((a, b), key=len)
    return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def brute(texts):
    seen, out = {}, []
    lines = [(i, j, line, line.split()) for i, t in enumerate(texts) if t is not None for j, line in enumerate(t.split("\n"))]
    keep = {i: [] for i, t in enumerate(texts) if t is not None}
    distinct = []
    for i, _, line, w in lines:
        gone = False
        if len(w) >= d.MIN_WORDS:
            key = tuple(w)
            if key in seen:
                gone = True
            else:
                gone = len(w) >= d.NEAR_WORDS and any(near(w, x) for x in distinct)
                seen[key] = True
                distinct.append(w)
        if not gone:
            keep[i].append(line)
    for i, t in enumerate(texts):
        out.append(None if t is None else "\n".join(keep[i]))
    return out


def test_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(30)]
    bases = [[rng.choice(words) for _ in range(rng.choice((2, 3, 7, 8, 9, 15, 16, 17, 18, 33, 40)))] for _ in range(25)]

    def line():
        w = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 1, 2))):
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice(([rng.choice(words)], [], [w[i], w[i]], [rng.choice(words), w[i]]))
        return " ".join(w)

    texts = ["\n".join(line() for _ in range(rng.randint(0, 6))) for _ in range(90)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.text for r in d.dedup_lines(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_odd_tables(spark, odd, empty):
    out = d.dedup_lines(odd)
    assert out.count() == odd.count() and set(odd.columns) <= set(out.columns)
    assert d.dedup_lines(empty).count() == 0 and d.op10(spark, odd).count() == odd.count()
    assert out.where("text is null").count() == odd.where("text is null").count()


def test_many_dropped_lines(spark):
    """The time for a text follows its lines, however many of them go."""
    text = "\n".join(["the same line of more than eight words stands here again"] * 80_000)
    start = time.time()
    row = d.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_exact == 79_999 and row.text == text.split("\n")[0]
    assert time.time() - start < 40  # array_contains for each line took more than a minute
