"""Quality classifier by co-training of two views of a document.

The text view sees the wording: hashed word and character n-grams. The metadata view sees what a page's
record tells without its wording: language, source, length, and the layout of its lines. Both are logistic
regressions, first trained on a bounded set of labelled rows. Then, over some rounds, both views score all
unlabelled documents, and each hands the ones it is most sure of, with its verdict as their label, to the
other view's training rows, as many of either class; their number in a round is bounded, the documents
that compete for it are not. The views are calibrated on one part of the labelled rows and combined on another by logistic
regression on their log odds; neither part is trained on. Then every document is scored.

Null texts are empty texts and are scored as such; missing or null metadata is a value of its own. With no
labelled rows of both classes every document has probability 1. Repeated rows are scored alike, and ties
for the places handed over go to the smallest hash of the id. An empty table gives an empty result. A very
long text is scored whole, alone in its slice. Columns that clash with the scores are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, give_back, parts, per_process, slices, table, text_bytes
from .quality_rules import BUCKETS, Logistic, csr, features, gram_buckets, platt, rows_of

#: Most labelled rows, chosen by a hash of the id.
LABELLED = 3000
#: Rounds of exchange, the least certainty, and most rows that a view hands over of each class in a round.
ROUNDS, SURE, HANDED = 2, 0.95, 100
#: Documents of a lower combined probability are rejected.
KEEP_FROM = 0.35
META_BUCKETS = 1 << 12
METADATA = ("lang", "source")


def metadata_features(raw: bytes, values: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed indicators of the metadata and of the layout in coarse steps."""
    step = lambda x: int(np.log2(x + 1) * 2)
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
    sizes = np.diff(np.concatenate(([-1], ends, [len(raw)]))) - 1
    twice = len(sizes) - len(np.unique(sizes)) if len(sizes) > 1 else 0
    layout = [
        ("length", step(len(raw))), ("lines", step(len(sizes))), ("mean line", step(float(sizes.mean()))), ("longest line", step(int(sizes.max()))),
        ("short lines", int(10 * (sizes < 20).mean())), ("lines of equal length", int(10 * twice / len(sizes))), ("spread", step(float(sizes.std()))),
    ]
    keys = [f"{k}={v}" for k, v in layout] + [f"{k}={v}" for k, v in zip(METADATA, values, strict=True)]
    keys += [f"{values[0]}|{k}={v}" for k, v in layout]
    at = np.array([_bucket(k) for k in keys], np.int16)
    return at, np.full(len(at), 1 / np.sqrt(len(at)), np.float32)


def _bucket(key: str) -> int:
    known = per_process("cotraining buckets", dict)
    if key not in known:
        if len(known) > 100_000:
            known.clear()
        known[key] = int.from_bytes(hashlib.blake2b(key.encode(), digest_size=4).digest(), "big") % META_BUCKETS
    return known[key]


@dataclass
class Views:
    text: Logistic
    meta: Logistic
    weights: tuple[float, float, float] = (0.5, 0.5, 0.0)

    def combine(self, p_text: float | np.ndarray, p_meta: float | np.ndarray) -> float | np.ndarray:
        a, b, c = self.weights
        return 1 / (1 + np.exp(-np.clip(a * _odds(p_text) + b * _odds(p_meta) + c, -30, 30)))


def _odds(p: float | np.ndarray) -> float | np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


Rows = list[tuple[np.ndarray, np.ndarray]]


@dataclass
class Training:
    """Labelled rows of both views: a quarter calibrates, a quarter combines, the rest and what is handed over trains."""

    text: Rows
    meta: Rows
    y: np.ndarray

    def __post_init__(self) -> None:
        part = np.arange(len(self.y)) % 4
        self.calibrate, self.combine, self.own = (np.flatnonzero(x) for x in (part == 0, part == 1, part > 1))
        self.given: dict[str, tuple[Rows, list[float]]] = {"text": ([], []), "meta": ([], [])}

    def possible(self) -> bool:
        return all(len(np.unique(self.y[x])) == 2 for x in (self.calibrate, self.combine, self.own))

    def _fitted(self, view: str, rows: Rows, buckets: int) -> Logistic:
        more, labels = self.given[view]
        model = Logistic(buckets).fit([rows[i] for i in self.own] + more, np.concatenate((self.y[self.own], np.array(labels))))
        return model.calibrate(np.array([model.raw(*rows[i]) for i in self.calibrate]), self.y[self.calibrate])

    def views(self) -> Views:
        out = Views(self._fitted("text", self.text, BUCKETS), self._fitted("meta", self.meta, META_BUCKETS))
        p, q = (np.array([m.probability(m.raw(*rows[i])) for i in self.combine]) for m, rows in ((out.text, self.text), (out.meta, self.meta)))
        out.weights = _stack(p, q, self.y[self.combine])
        return out


def _stack(p: np.ndarray, q: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Weights of the views' log odds and an intercept, by regularised Newton steps."""
    x, prior = np.stack([_odds(p), _odds(q), np.ones_like(p)], 1), np.array([0.5, 0.5, 0.0])
    w = prior.copy()
    for _ in range(50):
        z = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (z * (1 - z))[:, None]).T @ x + np.eye(3), x.T @ (z - y) + (w - prior))
        w = w - step * min(1.0, 1.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1]), float(w[2])


def _with_metadata(docs: DataFrame) -> DataFrame:
    return docs.withColumns({f"_m{i}": (F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")) for i, c in enumerate(METADATA)})


def _features_of(docs: DataFrame, ids: DataFrame) -> tuple[Rows, Rows, dict[int, int]]:
    """Both views' features of the documents whose ids (doc_id, y) are given, and the place of each id; ids are bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole)):
            texts = text_bytes(batch.column(1))
            values = list(zip(*(batch.column(2 + i).to_pylist() for i in range(len(METADATA))), strict=True))
            for lo, hi in slices(texts):
                one = csr([features(g) for g in gram_buckets(texts[lo:hi])])
                two = csr([metadata_features(texts[i], list(values[i])) for i in range(lo, hi)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *one, *two], names=["doc_id", "at", "value", "meta_at", "meta_value"])
        give_back()

    own = _with_metadata(docs.withColumn("doc_id", F.col("doc_id").cast("long"))).join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi")
    own = own.select("doc_id", "text", *[f"_m{i}" for i in range(len(METADATA))]).dropDuplicates(["doc_id"])
    got = own.mapInArrow(run, "doc_id long, at array<short>, value array<float>, meta_at array<short>, meta_value array<float>").toArrow()
    found = got.column("doc_id").to_numpy()
    order = np.argsort(found)
    rows = [rows_of(got.column(a), got.column(v), order) for a, v in (("at", "value"), ("meta_at", "meta_value"))]
    return rows[0], rows[1], {int(found[i]): n for n, i in enumerate(order)}


def surest(docs: DataFrame, labels: DataFrame, views: Views, handed: list[int]) -> list:
    """(doc_id, giver, y): of all documents without a label, those that each view is surest of, by class."""
    p = cut(score(docs.select("doc_id", "text", *[c for c in METADATA if c in docs.columns]), views, narrow=True).where("doc_id is not null").join(labels.select("doc_id"), "doc_id", "left_anti"))
    p = p.where(~F.col("doc_id").isin(handed)) if handed else p
    best = []
    for giver in ("text", "meta"):
        for y, sure in ((1, F.col(f"p_{giver}")), (0, 1 - F.col(f"p_{giver}"))):
            ranked = p.where(sure >= SURE).groupBy("doc_id").agg(F.max(sure).alias("sure")).orderBy(F.desc("sure"), F.xxhash64(F.lit(9), "doc_id"), "doc_id").limit(HANDED)
            best.append(ranked.select("doc_id", F.lit(giver).alias("giver"), F.lit(y).alias("y"), "sure"))
    rows = sorted(reduce(DataFrame.union, best).collect(), key=lambda r: (r.giver, r.y, -r.sure, r.doc_id))
    # As many of either class: a view that is sure of the frequent class alone teaches nothing.
    of = {g: [[r for r in rows if (r.giver, r.y) == (g, y)] for y in (0, 1)] for g in ("text", "meta")}
    return [r for both in of.values() for one in both for r in one[: min(map(len, both))]]


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> Views | None:
    """Views trained on labelled rows and, by each other's sure labels, on documents without a label."""
    y = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("y"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    some = cut(y.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64(F.lit(9), "doc_id"), "doc_id").limit(labelled))
    text, meta, place = _features_of(docs, some)
    goal = {r.doc_id: float(r.y) for r in some.collect()}
    training = Training(text, meta, np.array([goal[i] for i in place]))
    if not training.possible():
        return None
    handed: list[int] = []
    for _ in range(rounds):
        chosen = surest(docs, y, training.views(), handed)
        if not chosen:
            break
        spark = docs.sparkSession
        text, meta, place = _features_of(docs, spark.createDataFrame([(i,) for i in sorted({r.doc_id for r in chosen})], "doc_id long"))
        for r in chosen:
            taker, rows = ("meta", meta) if r.giver == "text" else ("text", text)
            training.given[taker][0].append(rows[place[r.doc_id]])
            training.given[taker][1].append(float(r.y))
        handed += sorted({r.doc_id for r in chosen})
    return training.views()


SCORES = ("p_text", "p_meta", "probability")


def score(docs: DataFrame, views: Views | None, narrow: bool = False) -> DataFrame:
    """docs with p_text, p_meta and the combined probability of good quality; if narrow, doc_id alone with them."""
    names = [c for c in docs.columns if c not in SCORES]
    kept = ["doc_id"] if narrow else names
    shared = docs.sparkSession.sparkContext.broadcast((vars(views.text), vars(views.meta), views.weights) if views else None)  # a fixed number of weights
    source = _with_metadata(docs.select(*names))
    place, width = names.index("text"), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Views(Logistic.of(shared.value[0]), Logistic.of(shared.value[1]), shared.value[2]) if shared.value else None
        for batch in (part for whole in batches for part in parts(whole)):
            texts = text_bytes(batch.column(place))
            values = list(zip(*(batch.column(width + i).to_pylist() for i in range(len(METADATA))), strict=True))
            for lo, hi in slices(texts):
                p, q, both = np.ones((3, hi - lo))
                if own:
                    p = own.text.probability(np.array([own.text.raw_of(g) for g in gram_buckets(texts[lo:hi])]))
                    q = own.meta.probability(np.array([own.meta.raw(*metadata_features(texts[i], list(values[i]))) for i in range(lo, hi)]))
                    both = own.combine(p, q)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(names.index(c)) for c in kept), *map(pa.array, (p, q, both))], names=[*kept, *SCORES])
        give_back()

    schema = docs.select(*kept).schema
    for c in SCORES:
        schema = schema.add(c, "double")
    return source.mapInArrow(run, schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text", *METADATA), train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", *SCORES, (F.col("probability") >= KEEP_FROM).alias("kept"))
