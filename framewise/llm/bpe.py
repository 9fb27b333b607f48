"""BPE encoding and decoding with content-defined chunks.

A rolling hash of the text's characters cuts it into chunks, so that a passage which many documents share
falls into the same chunks wherever it stands. The inner part of a chunk is encoded once for each task and
taken from a cache after that. Between two inner parts lies a join: it is encoded again from the last
word border that the left chunk settles, and the join is accepted only once the words read from there have
a border exactly where the right inner part begins; until then it grows by a word of the right chunk. As
BPE never merges across word borders, the ids are those of the whole text.

The cache is bounded in bytes and per task: a dictionary of all shared chunks would have to be shuffled
with the texts. Special strings of the tokenizer's file become their own ids, as in the tokenizers library.

Null is an empty text, which has no ids and decodes to the empty string. Long texts go through chunk by
chunk. Rows that repeat give equal rows. An empty table gives an empty result. Columns that clash with ids, n_tokens
or round_trip are replaced.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, per_process

#: The word pattern of the tokenizer's byte-level step.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that the rolling hash sees, the mask that sets the mean chunk (1024 characters), least and most.
ROLL, MASK, LEAST, MOST = 16, (1 << 10) - 1, 256, 8192
#: Bytes of ids and texts in a task's cache.
CACHE_BYTES = 32 << 20


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """Encoder and decoder of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        self.core = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = special
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pieces = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for b, i in [*ranks.items(), *((s.encode(), i) for s, i in special.items())]:
            self.pieces[i] = b
        self.words = regex.compile(PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.blank = regex.compile(r"\p{White_Space}")
        self.sure, self.sure_last = (regex.compile(r + r"(?<=\p{L})(?=\P{L})") for r in ("", "(?r)"))
        self.cache: OrderedDict[str, tuple[array, array, int]] = OrderedDict()
        self.held = self.hits = self.misses = 0

    def inner(self, chunk: str) -> tuple[array, array, int]:
        """Ids of the chunk's inner part, the word borders that it may begin at, with its end, and the chunk's length.

        Where no letter ends a word, borders come from reading the chunk: without its first word and its last
        two, which the neighbours may change, and without borders after a blank, as what follows decides how
        far blanks reach.
        """
        if (found := self.cache.get(chunk)) is not None:
            self.cache.move_to_end(chunk)
            self.hits += 1
            return found
        self.misses += 1
        # A letter before anything else always ends a word, whatever stands around it.
        first = self.sure.search(chunk)
        if first:
            borders = [first.end(), self.sure_last.search(chunk).end()]
        else:
            ends = [m.end() for m in self.words.finditer(chunk)]
            borders = [e for e in ends[1:-2] if not self.blank.match(chunk, e - 1)]
        part = chunk[borders[0] : borders[-1]] if borders else ""
        found = (array("I", self.core.encode_ordinary(part)), array("I", borders), len(chunk))
        self.cache[chunk] = found
        self.held += self.weight(found)
        while self.held > CACHE_BYTES and len(self.cache) > 1:
            self.held -= self.weight(self.cache.popitem(last=False)[1])
        return found

    def forget(self) -> None:
        """Drops the cache at a task's end: the next one may be another query's."""
        self.cache.clear()
        self.held = 0

    @staticmethod
    def weight(entry: tuple[array, array, int]) -> int:
        return 4 * (len(entry[0]) + len(entry[1])) + 2 * entry[2] + 300

    def plain(self, text: str) -> list[int]:
        """Ids of a text without special strings."""
        cuts = chunk_borders(text)
        ids: list[int] = []
        settled = at = 0  # settled: all before it is encoded; at: how far words have been read on from there
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            own, borders, _ = self.inner(text[lo:hi])
            for n, b in enumerate(borders[:-1]):
                while at < lo + b:
                    at = self.words.match(text, at).end()
                if at == lo + b:  # the text's own words and the chunk's agree from here to the part's end
                    end = lo + borders[-1]
                    ids += self.core.encode_ordinary(text[settled:at])
                    ids += own if n == 0 else self.core.encode_ordinary(text[at:end])
                    settled = at = end
                    break
        return ids + self.core.encode_ordinary(text[settled:])

    def encode(self, text: str) -> list[int]:
        if self.split is None or not any(s in text for s in self.special):
            return self.plain(text)
        out: list[int] = []
        for part in self.split.split(text):
            out += [self.special[part]] if part in self.special else self.plain(part)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.pieces[i] for i in ids]).decode("utf-8", "replace")


def chunk_borders(text: str) -> list[int]:
    """0, the borders that the text's own characters choose, and its length."""
    n = len(text)
    if n <= max(LEAST, ROLL):
        return [0, n] if n else [0]
    hashed = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) * np.uint32(0x9E3779B1)
    hashed ^= hashed >> np.uint32(15)
    reach = 1
    while reach < ROLL:  # of the windows of `reach` characters to those of twice as many, at every place
        hashed = hashed[:-reach] * np.uint32(0x85EBCA77 + 2 * reach) + hashed[reach:]
        reach *= 2
    hits = np.flatnonzero((hashed >> np.uint32(12)) & np.uint32(MASK) == 0) + ROLL
    out = [0]
    for at in hits.tolist():
        while at - out[-1] > MOST:
            out.append(out[-1] + MOST)
        if at - out[-1] >= LEAST and at < n:
            out.append(at)
    while n - out[-1] > MOST:
        out.append(out[-1] + MOST)
    return [*out, n]


def codec(path: str) -> Codec:
    return per_process(f"bpe:{path}", lambda: Codec(path))


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with ids array<int> of each text, and round_trip: whether they decode to it."""
    return _mapped(docs, path, text, True)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and round_trip of every row; ids are encoded, then decoded."""
    return _mapped(docs, path, "text", False)


def _mapped(docs: DataFrame, path: str, text: str, with_ids: bool) -> DataFrame:
    names = [c for c in docs.columns if c not in ("ids", "round_trip")] if with_ids else ["doc_id"]
    # The text goes to the workers once, in its own place where it is kept.
    place = names.index(text) if text in names else len(names)
    source = docs.select(*names) if text in names else docs.select(*names, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = batch.column(place)
            for lo in range(0, len(texts), 256):
                ids, counts, id_sha, text_sha, same = [], [], [], [], []
                for x in texts.slice(lo, 256).to_pylist():
                    got = own.encode(x or "")
                    back = own.decode(got)
                    if with_ids:
                        ids.append(got)
                        same.append(back == (x or ""))
                        continue
                    counts.append(len(got))
                    id_sha.append(hashlib.sha256(np.array(got, "<u4").tobytes()).hexdigest())
                    text_sha.append(hashlib.sha256(back.encode("utf-8", "replace")).hexdigest())
                    same.append(back == (x or ""))
                left = [batch.column(i).slice(lo, 256) for i in range(len(names))]
                if with_ids:
                    yield pa.RecordBatch.from_arrays([*left, pa.array(ids, pa.list_(pa.int32())), pa.array(same)], names=[*names, "ids", "round_trip"])
                else:
                    yield pa.RecordBatch.from_arrays([*left, pa.array(counts, pa.int64()), pa.array(id_sha), pa.array(text_sha), pa.array(same)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])
        own.forget()
        give_back()

    if with_ids:
        schema = docs.select(*names).schema.add("ids", T.ArrayType(T.IntegerType())).add("round_trip", "boolean")
    else:
        schema = source.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string").add("round_trip", "boolean")
    return source.mapInArrow(run, schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return digests(docs.select("doc_id", "text"), default_path())
