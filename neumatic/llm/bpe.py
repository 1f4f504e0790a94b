"""Token ids of whole texts, computed column-wise.

Texts are split into words by Arrow, each distinct word of a slice is encoded
once, and the ids are put back in text order with NumPy.  Words that are one run
of Latin-1 letters, with up to four of SIGNS behind it, go through the
tokenizer's own merge table, applied to all of them at once; every other word
goes through the tokenizers library.  The library's result on a set of probe words is
compared when an encoder is made, and a difference sends all words to the library.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Signs that may follow a letter run; the tokenizer takes a run of signs as one unit.
SIGNS = ".,!?;:#$%&*|"
SIMPLE = "^[A-Za-zÀ-ÖØ-öø-ÿ]{1,60}[.,!?;:#$%&*|]{0,4}$"
NONE = np.uint32(0xFFFFFFFF)
#: Bytes of text that are split into words at once.
SLICE_BYTES = 8_000_000


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class MergeTable:
    """Pairs of symbol ids -> rank and merged id, in an open-addressing table of NumPy arrays."""

    BITS = 18

    def __init__(self, vocab: dict[str, int], merges: list):
        if len(vocab) >= 1 << 16 or len(merges) >= 1 << self.BITS - 1:
            raise ValueError("too large a vocabulary")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.keys = np.full(1 << self.BITS, NONE, np.uint32)
        self.ranks = np.full(1 << self.BITS, NONE, np.uint32)
        for rank, (slot, key) in enumerate(zip(self.slot(keys).tolist(), keys.tolist())):
            while self.keys[slot] != NONE:
                slot = (slot + 1) & (1 << self.BITS) - 1
            self.keys[slot], self.ranks[slot] = key, rank
        symbols = byte_symbols()
        self.inner = np.array([vocab[symbols[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[symbols[b] + "</w>"] for b in range(256)], np.int32)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435761)) >> np.uint32(32 - self.BITS)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)
        slot = self.slot(keys)
        found = self.keys[slot]
        ranks = np.where(found == keys, self.ranks[slot], NONE)
        open_ = np.nonzero((found != keys) & (found != NONE))
        while len(open_[0]):
            slot[open_] = (slot[open_] + np.uint32(1)) & np.uint32((1 << self.BITS) - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            ranks[open_] = np.where(hit, self.ranks[slot[open_]], NONE)
            more = ~hit & (found != NONE)
            open_ = tuple(x[more] for x in open_)
        return ranks

    def encode(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of one length as a byte matrix -> matrix of ids and how many of each row count."""
        ids = self.inner[codes]
        ids[:, -1] = self.final[codes[:, -1]]
        size = np.full(len(ids), ids.shape[1], np.int64)
        if ids.shape[1] < 2:
            return ids, size
        ranks = self.rank(ids[:, :-1], ids[:, 1:])
        rows = np.arange(len(ids))
        work, work_ranks = ids.copy(), ranks
        while len(rows):
            at = work_ranks.argmin(1)
            line = np.arange(len(rows))
            best = work_ranks[line, at]
            going = best != NONE
            if not going.all():
                done = ~going
                ids[rows[done], : work.shape[1]] = work[done]
                rows, work, work_ranks, at, best = rows[going], work[going], work_ranks[going], at[going], best[going]
                line = np.arange(len(rows))
                if not len(rows):
                    break
            size[rows] -= 1
            width = work.shape[1]
            cols = np.arange(width - 1)
            moved = work[line[:, None], cols + (cols > at[:, None])]
            moved[line, at] = self.merged[best]
            if width == 2:
                ids[rows, :1] = moved
                break
            cols = np.arange(width - 2)
            new = work_ranks[line[:, None], cols + (cols >= at[:, None])]
            left = np.nonzero(at > 0)[0]
            new[left, at[left] - 1] = self.rank(moved[left, at[left] - 1], moved[left, at[left]])
            right = np.nonzero(at < width - 2)[0]
            new[right, at[right]] = self.rank(moved[right, at[right]], moved[right, at[right] + 1])
            # beyond a row's own end there are leftovers of merged symbols; no pair starts there
            new[cols >= (size[rows] - 1)[:, None]] = NONE
            work, work_ranks = moved, new
        return ids, size


def ragged(values: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    flat = [ids[np.arange(ids.shape[1]) < size[:, None]] for ids, size in values]
    return np.concatenate(flat) if flat else np.empty(0, np.int32), np.concatenate([s for _, s in values]) if values else np.empty(0, np.int64)


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``index`` of a ragged array, joined; and the size of each."""
    own = sizes[index]
    ends = np.cumsum(own)
    where = np.repeat((starts[index] - (ends - own)).astype(np.int32), own)
    where += np.arange(len(where), dtype=np.int32)
    return flat[where], own


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.inner = Tokenizer.from_file(path)
        self.table = None
        try:
            if spec["model"].get("end_of_word_suffix") == "</w>" and "Lowercase" in str(spec.get("normalizer")):
                self.table = MergeTable(spec["model"]["vocab"], spec["model"]["merges"])
        except (KeyError, ValueError):
            pass
        if self.table is not None:
            probe = pa.array(["a", "The", "theation", "Éçbleing,", "straßen.", "x" * 60, "thththandedingly", "onea***", "IT.!!", *(w[:-4] for w in list(spec["model"]["vocab"])[600:49000:37] if w.endswith("</w>"))])
            flat, sizes = self.words(probe)
            if flat.tolist() != np.concatenate(self.library(probe.to_pylist())).tolist():
                self.table = None

    def library(self, words: list[str]) -> list[np.ndarray]:
        out = []
        for i in range(0, len(words), 10_000):
            part = words[i : i + 10_000]
            encoded = self.inner.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids = np.asarray(encoded.ids, np.int32)
            owner = np.asarray(encoded.word_ids, np.int64) if len(ids) else np.empty(0, np.int64)
            out += np.split(ids, np.searchsorted(owner, np.arange(1, len(part))))
        return out

    def words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word, joined, and how many each has."""
        simple = pc.match_substring_regex(words, SIMPLE) if self.table is not None else pa.array(np.zeros(len(words), bool))
        is_simple = simple.to_numpy(zero_copy_only=False)
        rest = words.filter(pc.invert(simple)).to_pylist()
        rest_ids = self.library(rest)
        rest_sizes = np.array([len(x) for x in rest_ids], np.int64)
        rest_flat = np.concatenate(rest_ids) if rest_ids else np.empty(0, np.int32)
        lower = pc.utf8_lower(words.filter(simple))
        stems = pc.utf8_rtrim(lower, characters=SIGNS).dictionary_encode()
        stem_bytes = pc.binary_length(stems.dictionary).take(stems.indices)
        tailed = pc.greater(pc.binary_length(lower), stem_bytes).to_numpy(zero_copy_only=False)
        tails = pc.replace_substring_regex(lower.filter(pa.array(tailed)), "^[^" + SIGNS + "]+", "").dictionary_encode()
        tail_ids = self.library(tails.dictionary.to_pylist())
        flat, starts, sizes = self.stems(stems.dictionary)
        tail_sizes = np.array([len(x) for x in tail_ids], np.int64)
        starts = np.concatenate([starts, len(flat) + np.cumsum(tail_sizes) - tail_sizes])
        sizes = np.concatenate([sizes, tail_sizes])
        flat = np.concatenate([flat, *tail_ids])
        # each simple word is its stem and then perhaps a tail
        n = len(lower)
        index = np.repeat(stems.indices.to_numpy(zero_copy_only=False).astype(np.int64), 1 + tailed)
        ends = np.cumsum(1 + tailed) - 1
        index[ends[tailed]] = len(stems.dictionary) + tails.indices.to_numpy(zero_copy_only=False)
        simple_flat, parts = gather(flat, starts, sizes, index)
        simple_sizes = np.add.reduceat(parts, np.concatenate([[0], ends[:-1] + 1])) if n else np.empty(0, np.int64)
        # both kinds back in the order of ``words``
        both = np.concatenate([simple_flat, rest_flat])
        all_sizes = np.empty(len(words), np.int64)
        all_sizes[is_simple], all_sizes[~is_simple] = simple_sizes, rest_sizes
        begin = np.empty(len(words), np.int64)
        begin[is_simple] = np.cumsum(simple_sizes) - simple_sizes
        begin[~is_simple] = len(simple_flat) + np.cumsum(rest_sizes) - rest_sizes
        out, _ = gather(both, begin, all_sizes, np.arange(len(words)))
        return out, all_sizes

    def stems(self, stems: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(stems):
            return np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        lengths = pc.binary_length(stems).to_numpy(zero_copy_only=False)
        data = np.frombuffer(stems.buffers()[2], np.uint8)
        begin = np.frombuffer(stems.buffers()[1], np.int32)[stems.offset : stems.offset + len(stems)].astype(np.int64)
        order = np.argsort(lengths, kind="stable")
        parts, cuts = [], np.flatnonzero(np.diff(lengths[order])) + 1
        for group in np.split(order, cuts):
            width = int(lengths[group[0]])
            parts.append(self.table.encode(data[begin[group][:, None] + np.arange(width)]))
        flat, sizes = ragged(parts)
        starts = np.empty(len(stems), np.int64)
        starts[order] = np.cumsum(sizes) - sizes
        out = np.empty(len(stems), np.int64)
        out[order] = sizes
        return flat, starts, out

    def texts(self, texts: pa.StringArray) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit bytes; null texts have none."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, "right")))
            lists = pc.ascii_split_whitespace(pc.fill_null(texts.slice(at, upto - at), ""))
            words = lists.flatten().dictionary_encode()
            flat, each = self.words(words.dictionary)
            index = words.indices.to_numpy(zero_copy_only=False)
            ids, counts = gather(flat, np.cumsum(each) - each, each, index)
            ids = ids.astype("<u4", copy=False)
            upon = np.concatenate([[0], np.cumsum(counts)])
            offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = upon[offsets - offsets[0]].tolist()
            for a, b in zip(cuts, cuts[1:]):
                yield ids[a:b].tobytes()
            at = upto


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
