"""Best-fit packing by minimum bin slack.

Texts become token pieces; pieces are packed into sequences.  The packer works
on the histogram of piece lengths: a bin takes the longest length that is left
and then, by a bitset subset-sum dynamic programme over the lengths available,
the combination that fills it best.  That combination is removed as often as
the histogram allows, so the plan's size depends on the capacity (at most 4096
lengths), not on the number of pieces, and one driver-side plan serves any
input.  Pieces then find their places by their rank within their length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neumatic.llm.bpe import encoder
from neumatic.llm.common import shuffle_partitions, written

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of every row of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32 [, ids].

    A text is its ids and then END_ID; null and empty texts are END_ID alone.
    Texts of more than ``capacity`` tokens are cut into pieces of that length.
    """
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType())]
    fields += [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    last = np.asarray([END_ID], "<u4").tobytes()

    def cut(batches):
        import pyarrow as pa

        enc = encoder(path)
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, data in enumerate(enc.texts(batch.column(1))):
                data += last
                for k, begin in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[begin : begin + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(begin // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            arrays = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select("doc_id", "text").mapInArrow(cut, T.StructType(fields))


def fullest(counts: np.ndarray, lengths: list[int], room: int) -> list[int]:
    """Lengths (with repeats, no more than ``counts`` allow) whose sum is the largest one up to ``room``.

    Bit s of ``reach`` says that sum s can be made.  Lengths are taken in the
    order given; the sets before each step are kept to walk back.
    """
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int]] = []
    for length in lengths:
        left = min(int(counts[length]), room // length)
        for _ in range(left):
            grown = (reach | (reach << length)) & mask
            if grown == reach:
                break
            steps.append((length, reach))
            reach = grown
            if reach >> room:
                break
        if reach >> room:
            break
    at, taken = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> at & 1:
            taken.append(length)
            at -= length
    return taken


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(number of equal bins, lengths in one of them), from the histogram of lengths 0..capacity."""
    counts = counts.astype(np.int64).copy()
    bins: list[tuple[int, list[int]]] = []
    top = capacity
    while True:
        while top > 0 and not counts[top]:
            top -= 1
        if not top:
            return bins
        counts[top] -= 1
        room = capacity - top
        left = np.flatnonzero(counts[: room + 1])[::-1].tolist()
        chosen = [top, *(fullest(counts, left, room) if room and left else [])]
        counts[top] += 1
        used = {x: chosen.count(x) for x in set(chosen)}
        times = min(int(counts[x]) // n for x, n in used.items())
        for x, n in used.items():
            counts[x] -= times * n
        bins.append((times, chosen))


def slots(bins: list[tuple[int, list[int]]]) -> pd.DataFrame:
    """Places of each length in order of rank: rank ``first`` on, ``each`` a bin, bins from ``sequence`` on, at ``offset``."""
    rows, used, sequence = [], {}, 0
    for times, chosen in bins:
        at = 0
        for length in sorted(set(chosen), reverse=True):
            each = chosen.count(length)
            rows.append((length, used.get(length, 0), each, sequence, at))
            used[length] = used.get(length, 0) + times * each
            at += each * length
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "each", "sequence", "offset"]).sort_values(["length", "first"], ignore_index=True)


def ranked(items: DataFrame) -> DataFrame:
    """``items`` with ``rank``: 0, 1, ... within each length, whatever share of rows one length holds.

    Rows are dealt by (length, salt); a small table of group sizes gives where
    each group's ranks begin.
    """
    spark = items.sparkSession
    salts = max(64, 2 * shuffle_partitions(spark))
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begins"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("at", F.row_number().over(within) - 1)
    return numbered.join(begins, ["length", "salt"]).withColumn("rank", F.col("begins") + F.col("at")).drop("salt", "at", "begins")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pack every row of ``docs`` into as few sequences of ``capacity`` tokens as the method finds.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset (and ids where asked for).  Null and empty texts are
    one token; repeated rows are packed each; other columns are ignored; an
    empty table gives an empty result.  Driver memory: the histogram and the
    plan, both bounded by ``capacity``.
    """
    spark = docs.sparkSession
    items = written(pieces(docs, path or tokenizer_path(), capacity, with_ids), "pieces")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in items.groupBy("length").count().collect():  # at most ``capacity`` rows
        histogram[row[0]] = row[1]
    table = slots(plan(histogram, capacity))
    key = table["length"].to_numpy(np.int64) * (1 << 40) + table["first"].to_numpy(np.int64)
    cols = [table[c].to_numpy(np.int64) for c in ("length", "first", "each", "sequence", "offset")]
    shared = spark.sparkContext.broadcast((key, cols))  # a few rows per length, at most ``capacity`` lengths
    numbered = ranked(items)
    out = T.StructType([f for f in numbered.schema.fields if f.name != "rank"] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = [f.name for f in out.fields]

    def place(batches):
        import pyarrow as pa

        key, (length, first, each, sequence, offset) = shared.value
        for batch in batches:
            size = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("rank").to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.searchsorted(key, size * (1 << 40) + rank, "right") - 1
            assert not len(row) or (length[row] == size).all(), "a piece has no place"
            inside = rank - first[row]
            own = {"sequence_id": pa.array(sequence[row] + inside // each[row], pa.int64()), "offset": pa.array(offset[row] + inside % each[row] * size, pa.int64())}
            yield pa.RecordBatch.from_arrays([own[n] if n in own else batch.column(n) for n in names], names=names)

    return numbered.mapInArrow(place, out)
