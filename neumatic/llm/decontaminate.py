"""Benchmark decontamination by spaced-seed hashing.

A mask keeps some positions of a token window and ignores the others, so a
window whose substitutions fall on ignored positions still hashes alike.  The
hashes of every benchmark position under every mask form a table; training
texts look their own positions up in it, and around each hit the two token
sequences are compared on that alignment: an overlap is a window of WINDOW
tokens (or the whole item, if shorter) of which at least SIMILAR agree.
The masks hit every such window of 12 or 13 tokens; shorter items have masks of
their own length, so that every overlap has a hit.

Benchmark items go out in blocks of bounded size, and the documents are read
once for each block.  Documents are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Positions that count are 1.
MASKS = ("1101100101", "111010011", "1011010011", "100111101")
#: Items of so many tokens at least need no masks beside MASKS.
MASKED = 12
#: Items of fewer tokens than this are too short to be told from chance; they match nothing.
SHORTEST = 5
WINDOW = 13
SIMILAR = 0.8
#: Characters of benchmark text in one block at most (one longer item is a block of its own).
BLOCK_CHARS = 16_000_000
#: Characters of documents whose tokens are held at once.
SLICE_CHARS = 4_000_000
TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores."""
    return TOKEN.findall(text.lower()) if text else []


def short_masks(n: int) -> list[np.ndarray]:
    """Positions of masks of ``n`` tokens, one of which every allowed set of substitutions leaves alone.

    With so many substitutions allowed, two more groups of positions are made,
    and a mask leaves out as many groups as substitutions can meet.
    """
    wrong = next(k for k in range(n, -1, -1) if n - k >= SIMILAR * n - 1e-9)
    groups = np.array_split(np.arange(n), wrong + 2)
    return [np.concatenate([g for i, g in enumerate(groups) if i not in out]) for out in combinations(range(len(groups)), wrong)]


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20_011).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


@dataclass
class Index:
    """Seeds of one block of items."""

    item_ids: list[list]
    items: list[np.ndarray]
    vocab: dict[str, int]
    masks: list[np.ndarray]
    hashes: np.ndarray
    owner: np.ndarray
    at: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple], masks: tuple[str, ...] = MASKS, shortest: int = SHORTEST) -> Index:
        vocab: dict[str, int] = {}
        same: dict[tuple, list] = {}  # items of equal tokens are one
        for item_id, text in rows:
            words = tokens(text)
            if len(words) >= max(shortest, 1):
                same.setdefault(tuple(vocab.setdefault(w, len(vocab) + 1) for w in words), []).append(item_id)
        items, ids = [np.array(x, np.int64) for x in same], list(same.values())
        shapes = [np.flatnonzero([c == "1" for c in m]) for m in masks]
        own = [(n, shape) for n in sorted({len(x) for x in items if len(x) < MASKED}) for shape in short_masks(n)]
        lengths = [0] * len(shapes) + [n for n, _ in own]
        shapes += [shape for _, shape in own]
        found = []
        for k, shape in enumerate(shapes):
            for i, item in enumerate(items):
                if lengths[k] not in (0, len(item)):
                    continue
                h = seeds(item, shape, k)
                found.append((h, np.full(len(h), i), np.arange(len(h))))
        hashes, owner, at = (np.concatenate([f[j] for f in found]) if found else np.empty(0, np.int64) for j in range(3))
        order = np.argsort(hashes, kind="stable")
        bits = np.zeros(1 << 22, bool)
        bits[(hashes.astype(np.uint64) >> np.uint64(42)).astype(np.int64)] = True
        return cls(ids, items, vocab, shapes, hashes[order].astype(np.uint64), owner[order], at[order], bits)


def seeds(ids: np.ndarray, shape: np.ndarray, k: int) -> np.ndarray:
    """Hash of the positions in ``shape`` from every start in ``ids``; ``k`` tells masks apart."""
    n = len(ids) - int(shape[-1])
    if n <= 0:
        return np.empty(0, np.uint64)
    factors = multipliers(int(shape[-1]) + 2)
    h = np.full(n, k * 2 + 1, np.uint64) * factors[-1]
    for offset in shape:
        h += (ids[offset : offset + n].astype(np.uint64) + np.uint64(1)) * factors[offset]
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """(start in doc, tokens, agreeing tokens) of the best window with doc position = item position + shift."""
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    width = min(WINDOW, len(item))
    if high - low < width:
        return None
    same = np.concatenate([[0], np.cumsum(item[low:high] == doc[low + shift : high + shift])])
    sums = same[width:] - same[:-width]
    good = np.flatnonzero(sums >= SIMILAR * width - 1e-9)
    if not len(good):
        return None
    first, last = int(good[0]), int(good[-1]) + width
    return low + first + shift, last - first, int(same[last] - same[first])


def matches(index: Index, texts: list[str | None]) -> Iterator[list[tuple]]:
    """For each text: (item_id, start, tokens, agreeing), one for each item that it overlaps (its longest overlap)."""
    get = index.vocab.get
    gap = max([1, *(int(s[-1]) + 1 for s in index.masks)])
    at = 0
    while at < len(texts):
        parts, chars = [], 0
        while at < len(texts) and (not parts or chars < SLICE_CHARS):
            parts.append(np.array([get(w, 0) for w in tokens(texts[at])] + [0] * gap, np.int64))
            chars += len(texts[at] or "")
            at += 1
        ids = np.concatenate(parts)
        ends = np.cumsum([len(p) for p in parts])
        where = []
        for k, shape in enumerate(index.masks):
            h = seeds(ids, shape, k)
            pos = np.flatnonzero(index.bits[(h >> np.uint64(42)).astype(np.int64)])
            low, high = np.searchsorted(index.hashes, h[pos], "left"), np.searchsorted(index.hashes, h[pos], "right")
            n = high - low
            hit = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            start = np.repeat(pos, n)
            where.append(np.stack([np.searchsorted(ends, start, "right"), index.owner[hit], start - index.at[hit]]))
        doc_item_shift = np.unique(np.concatenate(where, 1), axis=1)
        best: list[dict[int, tuple]] = [{} for _ in parts]
        for d, i, shift in doc_item_shift.T.tolist():
            own = parts[d][: len(parts[d]) - gap]
            found = overlap(own, index.items[i], shift - (int(ends[d]) - len(parts[d])))
            if found and (i not in best[d] or (found[2], found[1], -found[0]) > (best[d][i][2], best[d][i][1], -best[d][i][0])):
                best[d][i] = found
        for found in best:
            yield [(item_id, *found[i]) for i in sorted(found) for item_id in index.item_ids[i]]


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS, shortest: int = SHORTEST) -> Iterator[Index]:
    """The items of ``benchmark`` (item_id, text), in blocks."""
    rows, chars = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        size = len(row.text or "")
        if rows and chars + size > block_chars:
            yield Index.of(rows, shortest=shortest)
            rows, chars = [], 0
        rows.append((row.item_id, row.text))
        chars += size
    if rows:
        yield Index.of(rows, shortest=shortest)


def overlaps(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS, shortest: int = SHORTEST) -> DataFrame:
    """A row per (doc_id, item_id) that overlap: start and tokens of the overlap in the document, tokens that agree.

    Null and empty texts on either side overlap nothing, and neither do items
    of fewer than ``shortest`` tokens, which ordinary prose holds by chance; 1
    takes all.  Repeated documents and items each give their rows, but items
    of equal tokens are looked up once.  Of several overlaps of one document
    and item the one with most agreeing tokens is told, then the longer, then
    the first.  Other columns are ignored; an empty table on either side gives
    an empty result.
    """
    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", benchmark.schema["item_id"].dataType), *(T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "n_agree"))])
    item_type = T.StructType([out["item_id"]])
    spark, found = docs.sparkSession, None
    for index in blocks(benchmark, block_chars, shortest):
        shared = spark.sparkContext.broadcast(index)  # at most BLOCK_CHARS of text

        def look(batches, shared=shared):
            from pyspark.sql.pandas.types import to_arrow_schema

            kind = to_arrow_schema(item_type).field(0).type
            for batch in batches:
                rows, values = [], []
                for i, hits in enumerate(matches(shared.value, batch.column(1).to_pylist())):
                    rows += [i] * len(hits)
                    values += hits
                cols = [pa.array([v[0] for v in values], kind), *(pa.array([v[j] for v in values], pa.int64()) for j in (1, 2, 3))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *cols], names=out.names)

        part = docs.select("doc_id", "text").mapInArrow(look, out)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], out) if found is None else found


def clean(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS, shortest: int = SHORTEST) -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item, with all their columns."""
    at = docs.columns.index("text")
    for index in blocks(benchmark, block_chars, shortest):
        shared = docs.sparkSession.sparkContext.broadcast(index)  # at most BLOCK_CHARS of text

        def choose(batches, shared=shared):
            for batch in batches:
                free = [not hits for hits in matches(shared.value, batch.column(at).to_pylist())]
                yield batch.filter(pa.array(free, pa.bool_()))

        docs = docs.mapInArrow(choose, docs.schema)
    return docs
