"""Operator: evaluation texts leaking into training text.

Spaced-seed hashing: at each word position of an item or document, fixed masks pick eight of the twelve next words and
hash them. Hits that follow each other make a passage of a document; passages and items with an equal hash are joined, and
the words of the passage and of a margin around it are compared with the item's, with substitutions allowed. Every position of a window is ignored by one of the masks, so an overlap of twelve words with
one word replaced still hits.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.runtime import broadcast_if_small, cut

SPAN = 12
#: Positions of the window that each mask reads.
MASKS = tuple(tuple(i for i in range(SPAN) if i % 3 != r) for r in range(3))
#: Bits of the filter over the items' hashes for each of them, and as powers of two the fewest and most it may have: 64 megabytes.
FILTER_SHARE, LEAST_BITS, MOST_BITS = 256, 24, 29
#: Words around a passage that are compared too.
MARGIN = SPAN
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Longest runs of letters and digits, in lower case."""
    return _WORD.findall(text.lower()) if text else []


_codes: dict[str, int] = {}


def _numbers(words: list[str]) -> np.ndarray:
    """64-bit numbers of words, equal in every process."""
    if len(_codes) > 500_000:
        _codes.clear()
    out = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        n = _codes.get(w)
        if n is None:
            raw = w.encode("utf-8", "replace")
            n = _codes[w] = (zlib.crc32(raw) << 32 | zlib.adler32(raw[::-1] + b"#")) ^ len(raw) << 7
        out[i] = n
    return out


def seeds(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of all windows under all masks."""
    n = len(words) - SPAN + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x = _numbers(words)
    out = []
    with np.errstate(over="ignore"):
        for k, mask in enumerate(MASKS):
            h = np.full(n, 0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1, np.uint64)
            for i in mask:
                h = (h ^ x[i : i + n]) * np.uint64(0xFF51AFD7ED558CCD)
                h ^= h >> np.uint64(32)
            out.append(h.view(np.int64))
    return np.tile(np.arange(n), len(MASKS)), np.concatenate(out)


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, hashes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            h = np.unique(seeds(words_of(t))[1])
            ids.append(np.full(len(h), i, np.int64))
            hashes.append(h)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (ids, hashes)], names=["item_id", "seed"])


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    slot = h.view(np.uint64) >> np.uint64(64 - bits)
    return slot >> np.uint64(3), (slot & np.uint64(7)).astype(np.uint8)


def _filter_of(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    out = np.zeros(1 << bits - 3, np.uint8)
    for b in batches:
        at, bit = _slots(b.column("seed").to_numpy(zero_copy_only=False), bits)
        np.bitwise_or.at(out, at, (1 << bit).astype(np.uint8))
    yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["bits"])


def passages(words: list[str], positions: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, str, np.ndarray]]:
    """(begin, words with a margin, seeds) of each run of hits that overlap or touch, from the positions of all hits."""
    order = np.argsort(positions, kind="stable")
    positions, hashes = positions[order], hashes[order]
    edges = np.flatnonzero(np.diff(positions) > SPAN) + 1
    for part, h in zip(np.split(positions, edges), np.split(hashes, edges)):
        begin = max(int(part[0]) - MARGIN, 0)
        yield begin, " ".join(words[begin : int(part[-1]) + SPAN + MARGIN]), np.unique(h)


def _passage_rows(batches: Iterator[pa.RecordBatch], kept: np.ndarray) -> Iterator[pa.RecordBatch]:
    bits = (len(kept) * 8).bit_length() - 1
    for b in batches:
        rows = []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            w = words_of(t)
            at, h = seeds(w)
            if len(h):
                byte, bit = _slots(h, bits)
                hit = (kept[byte] >> bit) & 1 > 0
                if hit.any():
                    rows += [(i, *p) for p in passages(w, at[hit], h[hit])]
        cols = list(zip(*rows)) or [(), (), (), ()]
        types = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=["doc_id", "begin", "passage", "seeds"])


def longest_run(item: list[str], doc: list[str]) -> int:
    """Words of the longest common run."""
    at: dict[str, list[int]] = {}
    for i, w in enumerate(item):
        at.setdefault(w, []).append(i)
    best, last = 0, {}
    for w in doc:
        now = {i: last.get(i - 1, 0) + 1 for i in at.get(w, ())}
        if now:
            best = max(best, max(now.values()))
        last = now
    return best


def tolerant_overlap(item: list[str], doc: list[str], patience: int = 2) -> tuple[int, int]:
    """(words, substitutions) of the best overlap on one diagonal; patience different words in a row end it, and each
    different word must be paid for by five equal ones."""
    at: dict[str, list[int]] = {}
    for i, w in enumerate(item):
        at.setdefault(w, []).append(i)
    diagonals: dict[int, list[int]] = {}
    for j, w in enumerate(doc):
        for i in at.get(w, ()):
            diagonals.setdefault(j - i, []).append(j)
    best = (0, 0)
    for js in diagonals.values():
        if len(js) < 8:
            continue
        same, diff, first, prev = 1, 0, js[0], js[0]
        for j in js[1:]:
            gap = j - prev - 1
            if gap >= patience or (diff + gap) * 5 > same + 5:
                same, diff = 0, 0
                gap = 0
            same, diff, prev = same + 1, diff + gap, j
            if same >= 8 and (same + diff, -diff) > (best[0], -best[1]):
                best = (same + diff, diff)
    return best


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "item_id", "exact_words", "overlap_words", "substitutions"]
    for b in batches:
        items: dict[str, list[str]] = {}
        cols: list[list[int]] = [[] for _ in names]
        for d, i, passage, it in zip(*(b.column(c).to_pylist() for c in ("doc_id", "item_id", "passage", "item_text"))):
            if it not in items:
                items[it] = words_of(it)
            w = passage.split(" ")
            for c, v in zip(cols, (d, i, longest_run(items[it], w), *tolerant_overlap(items[it], w))):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, exact_words, overlap_words, substitutions) for docs (doc_id, text) and items (item_id, text) that share a seed:
    the longest common run of words, and the longest overlap with substitutions and how many it has.

    Null texts, texts of under twelve words and rows without an id share none. The documents are read once by a map that finds
    their passages by a filter of the items' seeds, sized by their number up to 64 megabytes; beyond some 2 million seeds it
    sorts out less, and the join still decides. Only passages, not texts, leave that map; their narrow seeds are joined with
    the items' by hash (broadcast only if estimated small, else a shuffle that adaptive execution splits where an item has
    leaked widely), and then the passages that have an item are compared.
    """
    item_rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text")).where("item_id IS NOT NULL AND item_text IS NOT NULL").distinct()
    item_seeds = cut(item_rows.mapInArrow(_seed_rows, "item_id long, seed long").distinct())
    n = item_seeds.count()
    bits = min(max((max(n, 1) * FILTER_SHARE - 1).bit_length(), LEAST_BITS), MOST_BITS)
    (kept,) = item_seeds.select("seed").coalesce(1).mapInArrow(lambda it: _filter_of(it, bits), "bits binary").collect() or [None]
    shared = docs.sparkSession.sparkContext.broadcast(np.frombuffer(bytes(kept["bits"]), np.uint8) if kept else np.zeros(1 << bits - 3, np.uint8))
    doc_rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("doc_text")).where("doc_id IS NOT NULL AND doc_text IS NOT NULL")
    found = cut(doc_rows.mapInArrow(lambda it: _passage_rows(it, shared.value), "doc_id long, begin long, passage string, seeds array<long>"))
    # rows may repeat a document id with other texts: a passage is known by its words too
    found = found.withColumn("place", F.xxhash64("doc_id", "begin", "passage"))
    pairs = found.select("place", F.explode("seeds").alias("seed")).join(broadcast_if_small(item_seeds), "seed").select("place", "item_id").distinct()
    full = pairs.join(found.select("place", "doc_id", "passage"), "place").join(broadcast_if_small(item_rows), "item_id").select("doc_id", "item_id", "passage", "item_text")
    best = F.max(F.struct("overlap_words", (-F.col("substitutions")).alias("less"))).alias("best")
    out = full.mapInArrow(_verify, "doc_id long, item_id long, exact_words long, overlap_words long, substitutions long").groupBy("doc_id", "item_id").agg(F.max("exact_words").alias("exact_words"), best)
    return out.select("doc_id", "item_id", "exact_words", F.col("best.overlap_words").alias("overlap_words"), (-F.col("best.less")).alias("substitutions"))


def leaked(docs: DataFrame, items: DataFrame, least: int = SPAN) -> DataFrame:
    """(doc_id, item_id): documents that repeat at least that many consecutive words of the item, twelve or more."""
    if least < SPAN:
        raise ValueError(f"seeds find runs of {SPAN} words and more")
    return overlaps(docs, items).where(F.col("exact_words") >= least).select("doc_id", "item_id")
