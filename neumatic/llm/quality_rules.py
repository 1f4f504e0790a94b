"""Quality rules as a short-circuit cascade.

Each rule is a predicate on one whole text.  A bounded hash sample of the rows
gives every rule's cost (seconds a text) and selectivity (share rejected); the
rules then run in descending order of rejections per second, and a text leaves
the cascade at its first failure.  The verdict is a conjunction, so the order
changes the cost and never the result.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
LOWER = bytes(range(97, 123))
UPPER = bytes(range(65, 91))
#: Rows, about, that the cascade's order is estimated on.
SAMPLE_ROWS = 2000


@dataclass
class Text:
    """One text with the features that rules share; each is computed when first asked for."""

    raw: str
    data: bytes = b""
    words: list[bytes] = field(default_factory=list)
    cache: dict = field(default_factory=dict)

    @classmethod
    def of(cls, raw: str | None) -> Text:
        raw = raw or ""
        data = raw.encode("utf-8", "surrogatepass")
        return cls(raw, data, data.split())

    def get(self, name: str):
        if name not in self.cache:
            self.cache[name] = FEATURES[name](self)
        return self.cache[name]


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words inside ``width``-word windows that occur twice or more, first ones included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i:] for i in range(width))))
    counts = Counter(windows)
    if len(counts) == n:
        return 0
    total, covered = 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            total += i + width - max(i, covered)
            covered = i + width
    return total


def dup_lines(text: Text) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.data.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    lines = [x for x in lines if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def _letters(text: Text) -> tuple[int, int]:
    n = len(text.data)
    return n - len(text.data.translate(None, UPPER)), n - len(text.data.translate(None, LOWER))


FEATURES: dict[str, Callable[[Text], object]] = {
    "n_words": lambda t: len(t.words),
    "word_chars": lambda t: len(t.raw) - (len(t.data) - len(t.data.translate(None, SPACES))),
    "n_symbols": lambda t: sum(map(t.data.count, (bytes([c]) for c in SYMBOLS))),
    "n_dup_lines": dup_lines,
    "n_lines": lambda t: t.data.count(b"\n") + 1,
    "n_repeat_words": lambda t: repeat_words(t.words),
    "letters": _letters,
    "n_bangs": lambda t: t.data.count(b"!"),
    "top_word": lambda t: max(Counter(t.words).values(), default=0),
}

#: The four counts and the word count that the report always holds.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: name -> text fails.  All are integer comparisons, so SQL can repeat them exactly.
RULES: dict[str, Callable[[Text], bool]] = {
    "symbols": lambda t: 10 * t.get("n_symbols") > t.get("n_words"),
    "dup_lines": lambda t: 100 * t.get("n_dup_lines") > 50 * t.get("n_lines"),
    "short_words": lambda t: t.get("word_chars") < 2 * t.get("n_words"),
    "long_words": lambda t: t.get("word_chars") > 20 * t.get("n_words"),
    "upper_case": lambda t: t.get("letters")[0] > t.get("letters")[1],
    "exclamations": lambda t: 5 * t.get("n_bangs") > t.get("n_words"),
    "one_word": lambda t: 100 * t.get("top_word") > 40 * t.get("n_words"),
}


#: The base rules, which a report always evaluates; where only the verdict counts they stand in the cascade like the others.
BASE_RULES: dict[str, Callable[[Text], bool]] = {
    "few_words": lambda t: t.get("n_words") < 50,
    "repeat_words": lambda t: 100 * t.get("n_repeat_words") > 50 * t.get("n_words"),
}
ALL_RULES = BASE_RULES | RULES


def base_failed(text: Text) -> bool:
    return any(rule(text) for rule in BASE_RULES.values())


def passes(text: Text, order: list[str]) -> bool:
    """The cascade: stop at the first rule that rejects."""
    return not any(ALL_RULES[name](text) for name in order)


def measure(docs: DataFrame, rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """name -> (seconds a text, share rejected), from a sample of about ``rows`` texts.

    Each rule is timed by itself, from a text that only has its words.
    """
    share = min(1.0, rows / max(docs.count(), 1))
    picked = docs.select("text").sample(share, 20_011) if share < 1 else docs.select("text")

    def time_rules(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spent, failed, seen = Counter(), Counter(), 0
        for frame in frames:
            for raw in frame["text"]:
                text = Text.of(raw if isinstance(raw, str) else None)
                seen += 1
                for name, rule in ALL_RULES.items():
                    text.cache = {}
                    began = time.perf_counter()
                    failed[name] += rule(text)
                    spent[name] += time.perf_counter() - began
        yield pd.DataFrame([(n, spent[n], failed[n], seen) for n in ALL_RULES], columns=["rule", "s", "failed", "seen"])

    found = picked.mapInPandas(time_rules, "rule string, s double, failed long, seen long")
    sums = found.groupBy("rule").agg(F.sum("s").alias("s"), F.sum("failed").alias("failed"), F.sum("seen").alias("seen")).collect()
    return {r.rule: (r.s / max(r.seen, 1), r.failed / max(r.seen, 1)) for r in sums}


def ordered(costs: dict[str, tuple[float, float]], rules: dict[str, Callable[[Text], bool]] = ALL_RULES) -> list[str]:
    """Rules by rejections per second, highest first; ties and unmeasured rules by name."""
    def gain(name: str) -> float:
        cost, share = costs.get(name, (0.0, 0.0))
        return share / max(cost, 1e-9)

    return sorted(rules, key=lambda name: (-gain(name), name))


def assess(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, more): its doc_id, the base counts, base_failed and kept.

    A null or empty text has no words, so it fails the base rule.  Repeated
    rows each get a row.  Other columns are ignored; an empty table gives an
    empty result.  Memory: one batch of texts and one text's windows a task.
    """
    order = ordered(measure(docs, sample_rows), RULES)
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType)]
    fields += [T.StructField(n, T.LongType()) for n in BASE]
    fields += [T.StructField(n, T.BooleanType()) for n in ("base_failed", "kept")]

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            out = {n: [] for n in (*BASE, "base_failed", "kept")}
            for raw in batch.column(1).to_pylist():
                text = Text.of(raw)
                for name in BASE:
                    out[name].append(text.get(name))
                failed = base_failed(text)
                out["base_failed"].append(failed)
                out["kept"].append(not failed and passes(text, order))
            arrays = [batch.column(0), *(pa.array(out[n], pa.int64()) for n in BASE), *(pa.array(out[n], pa.bool_()) for n in ("base_failed", "kept"))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *out])

    return docs.select("doc_id", "text").mapInArrow(score, T.StructType(fields))


def keep(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns (names are kept as they are).

    The cascade, base rules in it, runs beside each row, so rows need no key
    and no join.  Null and empty texts fail; an empty table gives an empty
    result.
    """
    order = ordered(measure(docs, sample_rows))
    at = docs.columns.index("text")

    def choose(batches):
        import pyarrow as pa

        for batch in batches:
            good = []
            for raw in batch.column(at).to_pylist():
                text = Text.of(raw)
                good.append(passes(text, order))
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(choose, docs.schema)


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for ``assess``."""
    spaces, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM {table}),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{word}') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{word}')) AS l FROM d),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM w),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, x, x2, x3) AS n FROM (SELECT r, i, x, lead(x) OVER o AS x2, lead(x, 2) OVER o AS x3 FROM words WINDOW o AS (PARTITION BY r ORDER BY i)) WHERE x3 IS NOT NULL),
again AS (SELECT r, count(DISTINCT i + k) AS n FROM windows, range(0, 3) s(k) WHERE n > 1 GROUP BY r),
top AS (SELECT r, max(n) AS n FROM (SELECT r, count(*) AS n FROM words GROUP BY r, x) GROUP BY r),
f AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '{spaces}', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words, len(string_split(t, chr(10))) AS n_lines,
  length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower, length(regexp_replace(t, '[^!]', '', 'g')) AS n_bangs, coalesce(top.n, 0) AS n_top
  FROM w LEFT JOIN again USING (r) LEFT JOIN top USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 50 * n_lines OR word_chars < 2 * n_words
  OR word_chars > 20 * n_words OR n_upper > n_lower OR 5 * n_bangs > n_words OR 100 * n_top > 40 * n_words) AS kept FROM b"""
