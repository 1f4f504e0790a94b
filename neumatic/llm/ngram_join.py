"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct word shingles.  Shingles have a global
order, rare ones first.  Two sets with enough overlap must share tokens in
their prefixes; tokens of frequent classes are indexed as pairs, and the
prefix is extended so that sharing a pair is still certain:

    a prefix is long enough when
    (rare tokens in it) + sum over classes of max(0, tokens of that class - 1)
    >= n - ceil(t * n) + 1

since sets that share no signature share at most one token of each class, and
no rare one, in their prefixes.  Candidates are verified on the shingles of
their whole texts.

Candidates are thinned before any text is fetched.  A signature of a single
token tells the token's position in its set's order: with one in common at
positions i and j, two sets of n and m tokens share at most
min(i, j) + 1 + min(n - 1 - i, m - 1 - j) tokens, and with all c that they have
in common counted, the last at i and j, at most c + min(n - 1 - i, m - 1 - j).
And each set has parity bits, four or more for each token: every token that
only one of two sets holds flips at most one of them, so the bits that differ
bound how far the sets are apart.  256 of them, folded, travel with the
signatures; all of them decide on the pairs that those leave.

Equal sets are one node.  Groups of a common signature are first compared with
a few pivots each, in rounds, which settles groups of near copies in linear
work; what is then left in different components of a group is compared pair by
pair, so no link that could join two components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neumatic.llm.common import WORD_RE, discard, release, written
from neumatic.llm.components import components

WIDTH = 4
PERCENT = 85
#: A shingle in so many documents is frequent; at most so many are listed (others count as rare, which costs time, not links).
FREQUENT_FROM = 40
FREQUENT_MOST = 200_000
#: A task reports a shingle from so many of its documents on: a share of them, and at least two.
LOCAL_SHARE = 1 / 1500
#: (set size from which the scheme holds, classes of frequent shingles; 0: single tokens only).
SCHEMES = ((0, 0), (128, 32), (1024, 256))
#: Pivots that a group of near copies has in each round (by the signature's hash); close groups need few, loose ones more.
PIVOTS = (8, 64, 64)
#: Parity bits that travel with signatures; sets have four bits a token at least, as a power of two.
FOLDED = 256
#: Characters of texts that are held as words at once.
SLICE_CHARS = 3_000_000
FOLDS = tuple(f"c{i}" for i in range(1, FOLDED // 64 + 1))
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles.

    Words are what stands between the white space characters 0x20 and 0x09 to
    0x0D, with A-Z in lower case.  A text of fewer than ``width`` words is one
    shingle, and one without words has none.
    """
    at = 0
    while at < len(texts):
        ids: dict[bytes, int] = {}
        parts, chars = [], 0
        while at < len(texts) and (not parts or chars < SLICE_CHARS):
            text = texts[at] or ""
            words = text.encode("utf-8", "surrogatepass").lower().split()
            parts.append(np.array([ids.setdefault(w, len(ids)) for w in words], np.int64))
            chars += len(text)
            at += 1
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in ids], np.uint64)
        for part in parts:
            n = len(part)
            if not n:
                yield np.empty(0, np.uint64)
                continue
            w = hashes[part]
            size = min(width, n)
            h = np.full(n - size + 1, size, np.uint64)
            for k in range(size):
                h = h * MULTIPLY + w[k : n - size + 1 + k]
            yield np.unique(mix(h))


def set_key(shingles: np.ndarray) -> int:
    """64-bit key of a set, as a signed number."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def signatures(shingles: np.ndarray, frequent: np.ndarray, counts: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """64-bit signatures of one set, and the position of each that is a single token (else -1).

    ``frequent`` is sorted and ``counts`` goes with it.
    """
    n = len(shingles)
    need = n + (-percent * n // 100) + 1  # n - ceil(percent * n / 100) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        known = frequent[at] == shingles
        rare, common = shingles[~known], shingles[known]
        common = common[np.lexsort((common, counts[at[known]]))]
    else:
        rare, common = shingles, shingles[:0]
    out = [mix(rare[:need] + np.uint64(1))]
    at = [np.arange(len(out[0]))]
    if len(rare) < need:
        low, high = percent * n / 100, 100 * n / percent
        for k, (start, classes) in enumerate(SCHEMES):
            upto = SCHEMES[k + 1][0] if k + 1 < len(SCHEMES) else float("inf")
            if not (start <= high and low < upto):  # neither it nor a possible partner falls under this scheme
                continue
            if not classes:
                out.append(mix(common[: need - len(rare)] + np.uint64(1)))
                at.append(len(rare) + np.arange(len(out[-1])))
                continue
            own = (common >> np.uint64(17)) % np.uint64(classes)
            order = np.argsort(own, kind="stable")
            first = np.zeros(len(own), bool)
            first[order[np.concatenate([[True], own[order][1:] != own[order][:-1]])]] = True
            gained = np.cumsum(~first)
            end = int(np.searchsorted(gained, need - len(rare))) + 1
            chosen, own = common[:end], own[:end]
            for c in np.unique(own):
                x = np.sort(chosen[own == c])
                i, j = np.triu_indices(len(x), 1)
                out.append(mix(x[i] * MULTIPLY + x[j] + np.uint64(2 + k)))
                at.append(np.full(len(i), -1))
    found, first = np.unique(np.concatenate(out), return_index=True)
    return found, np.concatenate(at)[first]


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def parity(shingles: np.ndarray) -> np.ndarray:
    """Parity bits of a set as bytes: bit i tells whether the number of tokens that are i modulo the number of bits is odd."""
    size = max(FOLDED, 1 << (4 * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Parity bits as they would be with only ``size`` bytes."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def apart(a: bytes, b: bytes) -> int:
    """So many tokens, at least, are in one of the two sets only."""
    size = min(len(a), len(b))
    return int(np.bitwise_count(folded(np.frombuffer(a, np.uint8), size) ^ folded(np.frombuffer(b, np.uint8), size)).sum())


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """Per row its doc_id, n (set size), k (set key), h (hash of its text), and at a set's first row in a task its parity bits (bits, and folded c1 to c4); and per task the shingles it saw often (frequent: k, n)."""
    id_field = docs.schema["doc_id"]
    numbers = [T.StructField(c, T.LongType()) for c in ("n", "k", "h", *FOLDS)]
    schema = T.StructType([T.StructField("doc_id", id_field.dataType), *numbers, T.StructField("bits", T.BinaryType()), T.StructField("frequent", T.BooleanType())])

    def scan(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(T.StructType([id_field])).field(0).type
        seen: set[int] = set()
        held, size = [], 0

        def often():
            values, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            least = max(2, len(held) * LOCAL_SHARE)
            values, counts = values[counts >= least], counts[counts >= least]
            none = pa.nulls(len(values), pa.int64())
            return pa.RecordBatch.from_arrays([pa.nulls(len(values), kind), pa.array(counts, pa.int64()), pa.array(values.view(np.int64)), none, *[none] * len(FOLDS), pa.nulls(len(values), pa.binary()), pa.array(np.ones(len(values), bool))], names=schema.names)

        for batch in batches:
            n, k, bits, folds = [], [], [], []
            for shingles in shingle_sets(batch.column(1).to_pylist(), width):
                n.append(len(shingles))
                k.append(set_key(shingles))
                bits.append(None)
                folds.append([None] * len(FOLDS))
                if len(shingles) and k[-1] not in seen:
                    seen.add(k[-1])
                    own = parity(shingles)
                    bits[-1], folds[-1] = own.tobytes(), folded(own, FOLDED // 8).view("<i8").tolist()
                    held.append(shingles)
                    size += len(shingles)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), pa.array(n, pa.int64()), pa.array(k, pa.int64()), batch.column(2), *(pa.array([f[i] for f in folds], pa.int64()) for i in range(len(FOLDS))), pa.array(bits, pa.binary()), pa.array(np.zeros(len(n), bool))], names=schema.names)
            if size > 6_000_000:
                yield often()
                held, size = [], 0
        yield often()

    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(scan, schema)


def signed(docs: DataFrame, width: int, percent: int, frequent: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(sig, at, k, n): signatures of every set, once for each task that meets it."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, counts))  # at most FREQUENT_MOST

    def scan(batches):
        frequent, counts = shared.value
        seen: set[int] = set()
        for batch in batches:
            sigs, at, k, n = [], [], [], []
            for shingles in shingle_sets(batch.column(0).to_pylist(), width):
                if not len(shingles) or (key := set_key(shingles)) in seen:
                    continue
                seen.add(key)
                found, places = signatures(shingles, frequent, counts, percent)
                sigs.append(found.view(np.int64))
                at.append(places)
                k.append(np.full(len(found), key))
                n.append(np.full(len(found), len(shingles)))
            for i in range(0, len(sigs), 500):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x[i : i + 500]).astype(kind)) for x, kind in ((sigs, np.int64), (at, np.int32), (k, np.int64), (n, np.int32))], names=["sig", "at", "k", "n"])

    return docs.select("text").mapInArrow(scan, "sig long, at int, k long, n int")


def plausible(percent: int) -> str:
    """SQL condition on two sets x and y of one signature: sizes, folded parity bits and the token's positions allow a link."""
    sizes = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
    differ = " + ".join(f"bit_count(x.{c} ^ y.{c})" for c in FOLDS)
    places = f"(x.at < 0 or y.at < 0 or {100 + percent} * (least(x.at, y.at) + 1 + least(x.n - 1 - x.at, y.n - 1 - y.at)) >= {percent} * (x.n + y.n))"
    return f"{sizes} and {100 + percent} * ({differ}) <= {100 - percent} * (x.n + y.n) and {places}"


def near(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) that all parity bits allow."""
    x = nodes.select(F.col("k").alias("a"), F.col("n").alias("m"), F.col("bits").alias("bits_a"))
    y = nodes.select(F.col("k").alias("b"), "n", F.col("bits").alias("bits_b"))

    def check(batches):
        for batch in batches:
            a, b, m, n, bits_a, bits_b = (c.to_pylist() for c in batch.columns)
            good = pa.array([(100 + percent) * apart(*both) <= (100 - percent) * (i + j) for i, j, *both in zip(m, n, bits_a, bits_b)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    return pairs.join(x, "a").join(y, "b").select("a", "b", "m", "n", "bits_a", "bits_b").mapInArrow(check, "a long, b long")


def texts_of(docs: DataFrame, nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """(k, text) of the row that ``chosen`` (k, first) names for each of ``nodes`` (k)."""
    wanted = nodes.distinct().join(chosen, "k").select("k", "first.*")
    return rows_at(docs.select("doc_id", "text"), wanted).select("k", "text").dropDuplicates(["k"])


def rows_at(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id (null like any other) and text stand in ``wanted`` (doc_id, h, more), with its columns."""
    d, w = docs.withColumn("__h", F.xxhash64("text")).alias("d"), wanted.alias("w")
    return d.join(w, F.expr("d.doc_id <=> w.doc_id and d.__h = w.h")).select("d.*", *(F.col(f"w.{c}") for c in wanted.columns if c != "doc_id"))


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("k")).unionByName(pairs.select(F.col("b").alias("k")))


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose texts' sets are similar enough, as edges (u, v)."""
    left = texts.select(F.col("k").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("k").alias("b"), F.col("text").alias("text_b"))

    def check(batches):
        last: tuple = (None, None)
        for batch in batches:
            keys, ours, good = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
            for key, own, other in zip(keys, ours, shingle_sets(batch.column(3).to_pylist(), width)):
                if last[0] != key:  # rows of one a stand together
                    last = key, next(shingle_sets([own], width))
                good.append(linked(last[1], other, percent))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good, pa.bool_())), batch.column(1).filter(pa.array(good, pa.bool_()))], names=["u", "v"])

    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(check, "u long, v long")


def links_of(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges (u, v) of those ``pairs`` (a, b) that link: by parity bits first, then by the whole texts."""
    spark = docs.sparkSession
    pairs = written(pairs, "pairs")
    release(spark)
    close = written(near(pairs, nodes, percent), "close")
    discard(pairs)
    release(spark)
    texts = written(texts_of(docs, ends(close), nodes.select("k", "first")), "texts")
    release(spark)
    links = written(verified(close, texts, width, percent), "links")
    discard(close, texts)
    release(spark)
    return links


def mixed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The signature ``rows`` with the components that they now have, of signatures that still hold several."""
    named = rows.drop("label").join(labels.withColumnRenamed("node", "k"), "k", "left").withColumn("label", F.coalesce("label", "k"))
    several = named.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("sig")
    return written(named.join(several, "sig", "left_semi"), "mixed")


def pivoted(rows: DataFrame, number: int, percent: int) -> DataFrame:
    """Pairs (a, b) of the pivot of a signature's sets, new in each round, and one in another component."""
    rank = F.xxhash64(F.lit(number), F.pmod("sig", F.lit(PIVOTS[number])), "k").alias("rank")
    own = ("k", "n", "at", "label", *FOLDS)
    pivots = rows.groupBy("sig").agg(F.min(F.struct(rank, *own)).alias("p")).select("sig", *(F.col(f"p.{c}").alias(c) for c in own))
    both = pivots.alias("x").join(rows.alias("y"), F.expr(f"x.sig = y.sig and x.label <> y.label and {plausible(percent)}"))
    return both.select(F.least("x.k", "y.k").alias("a"), F.greatest("x.k", "y.k").alias("b")).distinct()


def crossing(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets that share a signature and are in different components.

    Of each signature only the sets outside its largest component meet all its sets.
    """
    sizes = rows.groupBy("sig", "label").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("sig").agg(F.max(F.struct("size", "label")).alias("l")).select("sig", F.col("l.label").alias("main"))
    marked = rows.join(largest, "sig").withColumn("outside", F.col("label") != F.col("main")).drop("main")
    both = marked.alias("x").join(marked.where("outside").alias("y"), F.expr(f"x.sig = y.sig and x.label <> y.label and (not x.outside or x.k < y.k) and {plausible(percent)}"))
    ahead = "x.k < y.k"
    both = both.selectExpr("least(x.k, y.k) as a", "greatest(x.k, y.k) as b", *(f"if({ahead}, x.{c}, y.{c}) as {c}_a" for c in ("n", "at")), *(f"if({ahead}, y.{c}, x.{c}) as {c}_b" for c in ("n", "at")))
    # all signatures that a pair shares are counted here: those of different components are mixed, and what one position rules out can go
    once = both.groupBy("a", "b").agg(F.first("n_a").alias("m"), F.first("n_b").alias("n"), F.count_if((F.col("at_a") >= 0) & (F.col("at_b") >= 0)).alias("c"), F.max("at_a").alias("i"), F.max("at_b").alias("j"))
    return once.where(f"c = 0 or {100 + percent} * (c + least(m - 1 - i, n - 1 - j)) >= {percent} * (n + m)").select("a", "b")


def linked_sets(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Per row doc_id, n, k and h; and per set that is not empty k, first (its first row: unnamed, doc_id, h) and label (of its component).

    Rows with a doc_id come before those without; then the smaller doc_id.
    """
    spark = docs.sparkSession
    sketch = written(sketches(docs, width), "sketches")
    own = sketch.where("not frequent").select("doc_id", "n", "k", "h")
    often = sketch.where("frequent").groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_FROM)
    rows = often.orderBy(F.desc("n"), "k").limit(FREQUENT_MOST).toPandas()
    values = rows["k"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h")).alias("first")
    nodes = written(sketch.where("not frequent and n > 0").groupBy("k").agg(first, *(F.max(c).alias(c) for c in ("n", "bits", *FOLDS))), "nodes")
    release(spark)

    sigs = written(signed(docs, width, percent, values[order], rows["n"].to_numpy(np.int64)[order]), "signatures")
    shared = sigs.groupBy("sig").agg(F.min("k").alias("low"), F.max("k").alias("high")).where("low < high").select("sig")
    groups = sigs.join(shared, "sig", "left_semi").distinct().join(nodes.select("k", *FOLDS), "k").withColumn("label", F.col("k"))
    groups = written(groups, "groups")
    discard(sigs)
    release(spark)

    links = None
    for number in range(len(PIVOTS) + 1):
        pairs = pivoted(groups, number, percent) if number < len(PIVOTS) else crossing(groups, percent)
        more = links_of(pairs, docs, nodes, width, percent)
        links = more if links is None else links.unionByName(more)
        labels = written(components(links), "labels")
        if number < len(PIVOTS):
            old, groups = groups, mixed(groups, labels)
            discard(old, labels)
            release(spark)
    discard(groups)
    named = nodes.select("k", "first").join(labels.withColumnRenamed("node", "k"), "k", "left")
    return own, named.withColumn("label", F.coalesce("label", "k"))


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Two documents link when 100 * intersection >= percent * union of their
    shingle sets; component_id is the smallest doc_id reachable.  Null texts,
    and texts without words, have no shingles and link with nothing: their
    component is their own doc_id.  Rows that repeat a doc_id each get a row,
    by their own text.  Rows without a doc_id keep their links and never name a
    component (one of such rows only has a null component_id).  Other columns
    are ignored; an empty table gives an empty result.
    """
    own, sets = linked_sets(docs, width, percent)
    reached = sets.groupBy("label").agg(F.min("first.doc_id").alias("component"))
    out = own.join(sets.join(reached, "label").select("k", "component"), "k", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def distinct(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: that of the smallest doc_id.

    A row without a doc_id stays only where its component has no other; of rows
    that share doc_id and text any one stays.  Rows without words link with
    nothing and all stay.
    """
    _, sets = linked_sets(docs, width, percent)
    kept = sets.groupBy("label").agg(F.min("first").alias("first")).select("first.doc_id", "first.h")
    worded = F.coalesce(F.col("text").rlike(WORD_RE), F.lit(False))
    one = rows_at(docs.where(worded), kept).dropDuplicates(["doc_id", "h"])
    return one.select(*docs.columns).unionByName(docs.where(~worded))


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for ``join`` with its defaults: all pairs that share a shingle are counted."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}),
s AS (SELECT r, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WIDTH} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {WIDTH - 2}), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' ')) END) AS s FROM d),
x AS (SELECT r, len(s) AS n, unnest(s) AS x FROM s),
links AS (SELECT a.r AS a, b.r AS b FROM x a JOIN x b ON a.x = b.x AND a.r <> b.r GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
reach AS (SELECT r, r AS c FROM s UNION SELECT l.b, reach.c FROM reach JOIN links l ON reach.r = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, o.component_id FROM s JOIN (SELECT reach.r, min(t.doc_id) AS component_id FROM reach JOIN s t ON reach.c = t.r GROUP BY reach.r) o ON s.r = o.r"""
