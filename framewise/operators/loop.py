"""A scorer that sees each window with a cache of earlier speakers' frames and a queue of recent ones, as one loop.

The scorer gives probabilities of all rows that it sees (cache, queue, window) and embeddings of the window's. The
queue takes the window's core and, from every call, new probabilities. What leaves it goes to the cache, which
is compressed above its capacity by the ranking of compress_cache; frames without speech go into a mean that fills
the slots kept for silence. Left context is seen, but neither told nor kept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .cache import CacheConfig, compress
from .folds import fold

#: (window, cache, queue) -> (probs of all rows in the order cache, queue, window; embeddings of the window's rows)
CachedScorer = Callable[[np.ndarray, np.ndarray, np.ndarray], "tuple[np.ndarray, np.ndarray]"]
TOLD_REST = "window long, part string, place long, probs array<double>, embedding array<double>"
TOLD = f"rec string, {TOLD_REST}"


@dataclass(frozen=True)
class LoopConfig:
    """dims: of an embedding; queue: frames that it holds; period: frames that leave it at a time; silence: a frame whose probabilities sum to less is silent."""

    cache: CacheConfig
    dims: int
    queue: int
    period: int
    silence: float = 0.2


@dataclass
class Memory:
    cache: np.ndarray
    queue: np.ndarray
    queue_probs: np.ndarray
    mean: np.ndarray
    cache_probs: np.ndarray | None = None  # none until the cache is compressed first; the scorer's are taken until then
    quiet: int = 0
    frames: int = 0

    @classmethod
    def of(cls, cfg: LoopConfig) -> Memory:
        return cls(np.zeros((0, cfg.dims)), np.zeros((0, cfg.dims)), np.zeros((0, cfg.cache.tracks)), np.zeros(cfg.dims))

    @staticmethod
    def held(frames: np.ndarray, probs: np.ndarray | None) -> list[tuple]:
        return [(e.tolist(), None if probs is None else probs[i].tolist()) for i, e in enumerate(frames)]

    def hold(self, cache: list[tuple], queue: list[tuple]) -> None:
        """Takes in what held() gave."""
        if cache:
            self.cache = np.array([list(e) for e, _ in cache], float)
            self.cache_probs = None if cache[0][1] is None else np.array([list(p) for _, p in cache], float)
        if queue:
            self.queue, self.queue_probs = np.array([list(e) for e, _ in queue], float), np.array([list(p) for _, p in queue], float)


def _leave(own: Memory, cfg: LoopConfig, count: int, seen: np.ndarray) -> bool:
    """Moves frames from the queue's front to the cache; seen: the scorer's probabilities of the cache. Whether it was compressed."""
    frames, probs = own.queue[:count], own.queue_probs[:count]
    own.queue, own.queue_probs = own.queue[count:], own.queue_probs[count:]
    silent = frames[probs.sum(axis=1) < cfg.silence]
    if len(silent):
        own.mean = (own.mean * own.quiet + silent.sum(axis=0)) / (own.quiet + len(silent))
        own.quiet += len(silent)
    known = seen if own.cache_probs is None else own.cache_probs
    own.cache, known = np.concatenate((own.cache, frames)), np.concatenate((known, probs))
    if len(own.cache) <= cfg.cache.capacity:
        own.cache_probs = None if own.cache_probs is None else known
        return False
    slots = compress(known, cfg.cache)
    pick = np.array([len(own.cache) if i is None else i for i in slots])
    own.cache = np.concatenate((own.cache, own.mean[None]))[pick]
    own.cache_probs = np.concatenate((known, np.zeros((1, known.shape[1]))))[pick]
    return True


def advance(own: Memory, cfg: LoopConfig, scorer: CachedScorer, rec: Any, window: int, values: Any, left: int, right: int) -> list[tuple]:
    """One window: rows of TOLD. confirmed: core frames; tentative: right context; cache: all slots, where it was compressed."""
    x = np.stack([np.asarray(r, float) for r in values])
    probs, embeddings = (np.asarray(v, float) for v in scorer(x, own.cache, own.queue))
    old, end = len(own.cache) + len(own.queue), len(x) - int(right)
    core = slice(int(left), end)
    seen, told = probs[: len(own.cache)], probs[old:]
    own.queue_probs = np.concatenate((probs[len(own.cache) : old], told[core]))
    own.queue = np.concatenate((own.queue, embeddings[core]))
    over = len(own.queue) - cfg.queue
    packed = over > 0 and _leave(own, cfg, min(max(cfg.period, over), len(own.queue)), seen)
    out = [(rec, window, "confirmed", own.frames + i, p.tolist(), None) for i, p in enumerate(told[core])]
    own.frames += len(out)
    out += [(rec, window, "tentative", own.frames + i, p.tolist(), None) for i, p in enumerate(told[end:])]
    return out + ([(rec, window, "cache", i, p, e) for i, (e, p) in enumerate(own.held(own.cache, own.cache_probs))] if packed else [])


def contents(own: Memory, rec: Any) -> list[tuple]:
    """What cache and queue hold at the end, as rows of TOLD without a window."""
    parts = (("cache", own.held(own.cache, own.cache_probs)), ("queue", own.held(own.queue, own.queue_probs)))
    return [(rec, None, part, i, p, e) for part, held in parts for i, (e, p) in enumerate(held)]


def score_with_cache(windows: DataFrame, scorer: CachedScorer, cfg: LoopConfig) -> DataFrame:
    """rec, window, part, place, probs, embedding: the loop over windows (rec, window, values, left, right) in order.

    part: confirmed and tentative frames (place: the frame), the cache's slots after each window that
    compressed it, and (window null) cache and queue at the end.
    """
    names = [c.split(" ")[0] for c in TOLD.split(", ")]

    def take(own: Memory, batch: pd.DataFrame) -> pd.DataFrame:
        rows = zip(batch["rec"], batch["window"], batch["values"], batch["left"], batch["right"], strict=True)
        return pd.DataFrame([t for rec, *r in rows for t in advance(own, cfg, scorer, rec, *r)], columns=names).astype({"window": "Int64"})

    def close(own: Memory, rec: Any) -> pd.DataFrame:
        return pd.DataFrame(contents(own, rec), columns=names).astype({"window": "Int64"})

    kind = dict(windows.dtypes)["rec"]
    return fold(windows.select("rec", "window", "values", "left", "right"), "window", f"rec {kind}, {TOLD_REST}", lambda: Memory.of(cfg), take, close)
