"""Katz backoff language model, counted over all training texts.

Counts of n-grams up to ``order`` are discounted by Good-Turing; the mass that
this frees is given to the next lower order by backoff weights that make every
distribution sum to one, and a token's probability is found by the recursion

    p(w | h) = d(c(hw)) * c(hw) / c(h)      if c(hw) > 0
             = alpha(h) * p(w | h')         otherwise

down to words, whose freed mass is the probability of all words never seen.
Where no count is small enough to be discounted, nothing would be freed; then one
count is added to the context for all unseen words, so no probability is zero.

Texts are kept as blocks: token numbers, and the 64-bit keys of the block's own
words.  A block asks the partition that owns a key (an n-gram or a context) for
its totals over all blocks; questions and answers are sorted, compressed arrays,
one for each pair of block and partition, so nothing the size of the model is
held in one place, and a very frequent n-gram costs one number a block.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neumatic.llm.common import release, remainder, written

ORDER = 2
#: Good-Turing discounts counts up to this one; larger counts are trusted.
TRUSTED = 7
#: Tokens of one block (a longer text is a block of its own).
BLOCK_TOKENS = 1_500_000
#: Tokens of the corpus for each partition of an exchange.
PART_TOKENS = 1_500_000
#: A context whose n-grams free less than this share is given one count for unseen words.
EVEN = 1e-9
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
#: Keys of the end and the begin of a text; no word has them, since words hold no such byte.
END, BEGIN = b" e", b" b"


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def squeeze(values: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(values).tobytes(), 1)


def expand(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def planes(values: np.ndarray) -> np.ndarray:
    """The bytes of 64-bit numbers, plane by plane."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T)


def squeeze_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys: the bytes of their differences, plane by plane."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return zlib.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def expand_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Words between the white space characters 0x20 and 0x09 to 0x0D, with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Block:
    """Tokens of some texts; texts are BEGIN, words, END in a row."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, train: np.ndarray, keys: np.ndarray):
        self.tokens, self.sizes, self.train, self.keys = tokens, sizes, train, keys
        self.starts = np.cumsum(sizes) - sizes

    def grams(self, order: int):
        """For each order: (keys of the distinct n-grams, sorted; training counts; context row; suffix row; row of each token).

        Rows refer to the order below; tokens without a full n-gram (the first
        ones of a text) have the row of the longest that they do have, marked
        by ``length``.  BEGIN itself is predicted by nothing.
        """
        n = len(self.tokens)
        place = np.arange(n) - np.repeat(self.starts, self.sizes)
        train = np.repeat(self.train, self.sizes)
        found = []
        order_of = np.argsort(self.keys, kind="stable")
        rank = np.empty(len(order_of), np.int64)
        rank[order_of] = np.arange(len(order_of))
        row = rank[self.tokens]
        counted = train & (place > 0)
        found.append({"keys": self.keys[order_of], "count": np.bincount(row[counted], minlength=len(order_of)), "row": row, "at": np.arange(n)[place > 0]})
        unigram = row
        for k in range(2, order + 1):
            at = np.flatnonzero(place >= k - 1)
            code = found[-1]["row"][at - 1] * np.int64(len(self.keys)) + unigram[at]
            values, back = np.unique(code, return_inverse=True)
            context, word = values // len(self.keys), values % len(self.keys)
            h = mix(found[-1]["keys"][context] * MULTIPLY + found[0]["keys"][word] + np.uint64(k))
            by_key = np.argsort(h, kind="stable")
            rank = np.empty(len(by_key), np.int64)
            rank[by_key] = np.arange(len(by_key))
            row = np.full(n, -1, np.int64)
            row[at] = rank[back.ravel()]
            lower = np.empty(len(values), np.int64)
            lower[row[at]] = found[-1]["row"][at]
            found.append({"keys": h[by_key], "count": np.bincount(row[at][train[at]], minlength=len(values)), "row": row, "at": at, "context": context[by_key], "suffix": lower})
        return found

    def pack(self) -> tuple:
        return squeeze(self.tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T), squeeze(self.sizes.astype(np.int64)), squeeze(self.train), squeeze(self.keys)

    @classmethod
    def unpack(cls, tokens, sizes, train, keys) -> Block:
        planes = expand(tokens, np.uint8).reshape(4, -1)
        return cls(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64), expand(sizes, np.int64), expand(train, bool), expand(keys, np.uint64))


STATE = "block string, tokens binary, sizes binary, train binary, keys binary"


def blocks(docs: DataFrame, block_tokens: int) -> DataFrame:
    """Blocks of ``docs`` (doc_id, text, train), each with the list of its doc_ids."""
    id_field = docs.schema["doc_id"]
    schema = T.StructType([*T._parse_datatype_string(STATE).fields, T.StructField("doc_ids", T.ArrayType(id_field.dataType))])

    def build(batches):
        import uuid

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        ids, parts, train, numbers, total = [], [], [], {BEGIN: 0, END: 1}, 0

        def flush():
            keys = np.array([xxhash.xxh3_64_intdigest(w) for w in numbers], np.uint64)
            block = Block(np.concatenate(parts), np.array([len(p) for p in parts]), np.array(train), keys)
            row = (uuid.uuid4().hex, *block.pack(), list(ids))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, kinds)], schema=kinds)

        for batch in batches:
            for doc_id, text, is_train in zip(*(c.to_pylist() for c in batch.columns)):
                words = [numbers.setdefault(w, len(numbers)) for w in words_of(text)]
                ids.append(doc_id)
                parts.append(np.array([0, *words, 1], np.int32))
                train.append(bool(is_train))
                total += len(words) + 2
                if total >= block_tokens:
                    yield flush()
                    ids, parts, train, numbers, total = [], [], [], {BEGIN: 0, END: 1}, 0
        if parts:
            yield flush()

    return docs.select("doc_id", "text", "train").mapInArrow(build, schema)


def cut(keys: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """Ranges of sorted keys, one for each partition that owns some."""
    width = (1 << 64) // parts + 1
    edges = np.array([k * width for k in range(1, parts)], np.uint64)
    bounds = [0, *np.searchsorted(keys, edges, "left").tolist(), len(keys)]
    for part, (low, high) in enumerate(zip(bounds, bounds[1:])):
        if high > low:
            yield part, slice(low, high)


def ask_counts(state: DataFrame, order: int, parts: int) -> DataFrame:
    """Each block's n-grams and their training counts, for the partitions that own them."""
    def ask(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                grams = Block.unpack(row.tokens, row.sizes, row.train, row.keys).grams(order)
                out = [(k + 1, part, row.block, squeeze_keys(g["keys"][s]), squeeze(g["count"][s].astype("<u4"))) for k, g in enumerate(grams) for part, s in cut(g["keys"], parts)]
                yield pd.DataFrame(out, columns=["n", "part", "block", "keys", "values"])

    return state.select("block", "tokens", "sizes", "train", "keys").mapInPandas(ask, "n int, part int, block string, keys binary, values binary")


ANSWER = "n int, part int, block string, answer binary, stats array<double>"


def count_answers(asked: DataFrame) -> DataFrame:
    """Total counts, per asking block; bit 0 marks the block that speaks for an n-gram.

    ``stats`` rows hold n-gram types and tokens of the partition and how many types have count 1, 2, ...
    """
    def answer(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        keys = [expand_keys(x) for x in frame["keys"]]
        counts = [expand(x, "<u4").astype(np.int64) for x in frame["values"]]
        every, back = np.unique(np.concatenate(keys), return_inverse=True)
        back = back.ravel()
        total = np.bincount(back, np.concatenate(counts), len(every)).astype(np.int64)
        first = np.unique(back, return_index=True)[1]
        speaks = np.zeros(len(back), np.int64)
        speaks[first] = 1
        coded = (total[back] << 1 | speaks).astype("<u8")
        ends = np.cumsum([len(k) for k in keys])
        rows = [(key[0], key[1], b, squeeze(planes(coded[e - len(k) : e])), None) for b, k, e in zip(frame["block"], keys, ends)]
        seen = total[total > 0]
        rows.append((key[0], key[1], None, None, [float(len(seen)), float(seen.sum()), *np.bincount(np.minimum(seen, TRUSTED + 2), minlength=TRUSTED + 3)[1 : TRUSTED + 2].astype(float)]))
        return pd.DataFrame(rows, columns=["n", "part", "block", "answer", "stats"])

    return asked.groupBy("n", "part").applyInPandas(answer, ANSWER)


def good_turing(types_with: list[float]) -> np.ndarray:
    """Factors d(0..TRUSTED + 1) for counts; d is 1 from TRUSTED + 1 on.

    Where counts of counts are too few or not falling, a factor can leave
    (0, 1); the absolute discount of one half takes its place.
    """
    n = [0.0, *types_with]
    d = np.ones(TRUSTED + 2)
    rest = (TRUSTED + 1) * n[TRUSTED + 1] / n[1] if n[1] else 1.0
    for r in range(1, TRUSTED + 1):
        value = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if n[r] and rest < 1 else 0.0
        d[r] = value if 0 < value < 1 else (r - 0.5) / r
    return d


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * d[np.minimum(counts, TRUSTED + 1)]


class Model:
    """What all blocks share: totals and discounts (a few numbers for each order)."""

    def __init__(self, stats: dict[int, list[float]], texts: int):
        self.texts = texts
        self.types = {n: s[0] for n, s in stats.items()}
        self.tokens = {n: s[1] for n, s in stats.items()}
        self.d = {n: good_turing(s[2:]) for n, s in stats.items()}
        mass = (stats[1][1] - sum((1 - self.d[1][r]) * r * c for r, c in enumerate(stats[1][2 : 2 + TRUSTED], 1))) / stats[1][1] if stats[1][1] else 0.0
        self.scale = 1.0 if mass < 1 - EVEN else stats[1][1] / (stats[1][1] + 1)
        self.words_mass = mass * self.scale

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """A word's probability; all words never seen share what is left, as one class."""
        if not self.tokens[1]:
            return np.ones(len(counts))
        return np.where(counts > 0, self.scale * discounted(counts, self.d[1]) / self.tokens[1], 1 - self.words_mass)


class Known:
    """A block with the answers it got: counts by order and the backoff weights of contexts by order."""

    def __init__(self, state, answers: pd.DataFrame, order: int, parts: int, model: Model):
        self.block = Block.unpack(state.tokens, state.sizes, state.train, state.keys)
        self.grams = self.block.grams(order)
        self.model = model
        self.counts, self.speaks, self.alpha = {}, {}, {}
        for n, own in answers.groupby("n"):
            data = []
            for value in own.sort_values("part")["answer"]:
                raw = zlib.decompress(value)
                data.append(np.frombuffer(raw, np.float64) if n < 0 else np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel())
            data = np.concatenate(data)
            if n < 0:
                self.alpha[-n] = data
            else:
                self.counts[n], self.speaks[n] = (data >> np.uint64(1)).astype(np.int64), (data & np.uint64(1)).astype(bool)
        self.p = {1: model.unigram(self.counts[1])}

    def context_counts(self, n: int) -> np.ndarray:
        """How often each (n-1)-gram was a context; BEGIN is one at every training text's start."""
        counts = self.counts[n - 1].copy()
        if n == 2:
            begin = np.searchsorted(self.grams[0]["keys"], self.block.keys[0])
            counts[begin] = self.model.texts
        return counts

    def probability(self, n: int) -> np.ndarray:
        """p of each distinct n-gram's last word given the rest."""
        if n not in self.p:
            gram = self.grams[n - 1]
            lower = self.probability(n - 1)[gram["suffix"]]
            seen = self.counts[n] > 0
            of = np.maximum(self.context_counts(n)[gram["context"]], 1)
            told = self.alpha[n][gram["context"]]  # below zero: the context frees nothing by itself
            scale = np.where(told < 0, of / (of + 1), 1.0)
            alpha = np.where(told < 0, -told / (of + 1), told)
            self.p[n] = np.where(seen, scale * discounted(self.counts[n], self.model.d[n]) / of, alpha * lower)
        return self.p[n]

    def sums(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each context, over the seen n-grams that this block speaks for: their mass, and their mass one order below."""
        gram = self.grams[n - 1]
        mine = self.speaks[n] & (self.counts[n] > 0)
        context = gram["context"][mine]
        size = len(self.grams[n - 2]["keys"])
        high = discounted(self.counts[n][mine], self.model.d[n]) / self.context_counts(n)[context]
        low = self.probability(n - 1)[gram["suffix"][mine]]
        return np.bincount(context, high, size), np.bincount(context, low, size)

    def scores(self, order: int) -> np.ndarray:
        """log10 probability of every token but BEGIN, summed by text."""
        block = self.block
        log = np.zeros(len(block.tokens))
        for n in range(1, order + 1):  # a longer n-gram takes the place of a shorter one
            gram = self.grams[n - 1]
            log[gram["at"]] = np.log10(self.probability(n))[gram["row"][gram["at"]]]
        log[block.starts] = 0
        return np.add.reduceat(log, block.starts)


def with_answers(state: DataFrame, answers: DataFrame, columns: list[str], function, schema) -> DataFrame:
    """Apply ``function(state row, answers frame)`` to every block with the answers it got."""
    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([function(row, right) for row in left.itertuples(index=False)], ignore_index=True)

    got = answers.where("block is not null").select("n", "part", "block", "answer")
    return state.select("block", "tokens", "sizes", "train", "keys", *columns).groupBy("block").cogroup(got.groupBy("block")).applyInPandas(both, schema)


def alpha_answers(sums: DataFrame, n: int) -> DataFrame:
    """Backoff weights of contexts, from the sums of all blocks, per asking block."""
    def answer(key, frame: pd.DataFrame) -> pd.DataFrame:
        keys = [expand_keys(x) for x in frame["keys"]]
        every, back = np.unique(np.concatenate(keys), return_inverse=True)
        back = back.ravel()
        high, low = (np.bincount(back, np.concatenate([expand(x, np.float64) for x in frame[c]]), len(every)) for c in ("high", "low"))
        free = np.where(high < 1 - EVEN, 1 - high, -1.0)
        alpha = np.where(high > 0, free / np.maximum(1 - low, 1e-300), 1.0)[back]
        ends = np.cumsum([len(k) for k in keys])
        rows = [(-n, key[0], b, squeeze(alpha[e - len(k) : e]), None) for b, k, e in zip(frame["block"], keys, ends)]
        return pd.DataFrame(rows, columns=["n", "part", "block", "answer", "stats"])

    return sums.groupBy("part").applyInPandas(answer, ANSWER)


def score(docs: DataFrame, folds: int = 5, held_out_fold: int = 1, order: int = ORDER, block_tokens: int = BLOCK_TOKENS, part_tokens: int = PART_TOKENS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows that are not held out.  ``score`` is the
    text's log10 probability, its end included; ``base_score`` is that of an
    add-half unigram model on the same counts.  Null and empty texts are their
    end alone.  Repeated rows count and are scored each; other columns are
    ignored; an empty table gives an empty result.  Without training texts every
    score is 0.
    """
    spark = docs.sparkSession
    fold = remainder("doc_id", folds)
    state = written(blocks(docs.select("doc_id", "text", (fold != held_out_fold).alias("train")), block_tokens), "blocks")
    held = {"doc_id": docs.schema["doc_id"].dataType}
    size = spark.read.parquet(*state.inputFiles()).count() if state.inputFiles() else 0
    parts = max(1, math.ceil(size * block_tokens / part_tokens))
    answers = written(count_answers(ask_counts(state, order, parts)), "counts")
    stats = {n: [0.0] * (TRUSTED + 3) for n in range(1, order + 1)}
    for row in answers.where("block is null").groupBy("n").agg(*(F.sum(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(TRUSTED + 3))).collect():
        stats[row[0]] = list(row[1:])
    train_texts = docs.where(fold != held_out_fold).count()
    model = Model(stats, train_texts)
    release(spark)

    for n in range(2, order + 1):
        def sums(row, got, n=n):
            known = Known(row, got, order, parts, model)
            keys = known.grams[n - 2]["keys"]
            high, low = known.sums(n)
            out = [(part, row.block, squeeze_keys(keys[s]), squeeze(high[s]), squeeze(low[s])) for part, s in cut(keys, parts)]
            return pd.DataFrame(out, columns=["part", "block", "keys", "high", "low"])

        asked = with_answers(state, answers, [], sums, "part int, block string, keys binary, high binary, low binary")
        answers = answers.unionByName(written(alpha_answers(asked, n), "weights"))
        release(spark)

    out = T.StructType([T.StructField("doc_id", held["doc_id"]), T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score"))])

    def final(row, got):
        known = Known(row, got, order, parts, model)
        block, words = known.block, known.grams[0]
        counts = known.counts[1][words["row"]]
        total, types = model.tokens[1], model.types[1]
        base = np.log10((counts + 0.5) / (total + 0.5 * (types + 1)))
        seen = counts > 0
        base[block.starts], seen[block.starts] = 0, False
        return pd.DataFrame({"doc_id": list(row.doc_ids), "held_out": ~block.train, "n_tokens": block.sizes - 1, "n_known": np.add.reduceat(seen.astype(np.int64), block.starts), "train_tokens": int(total), "base_score": np.add.reduceat(base, block.starts), "score": known.scores(order)})

    return with_answers(state, answers, ["doc_ids"], final, out)
