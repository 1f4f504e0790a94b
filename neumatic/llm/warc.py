"""WARC archives: gzip member per record, and a splittable reader.

Writing goes through Spark's text writer (a binary value cast to string keeps
its bytes), with an empty gzip member as the line separator, so archives are plain
concatenated gzip members on any store that Spark reaches.

Reading goes through Spark's text reader with the gzip magic as the line
separator.  It deals out byte ranges of every file; a task gets the stretches
that start inside its range, each up to the next magic.  A stretch is a
candidate member: it counts if it inflates to its end with the right checksum
and starts with a WARC header.  The magic can also occur inside compressed data;
then the stretches are joined again, and the few that straddle two ranges are
joined in a second, small step.

Archives must not carry a name that Hadoop takes for a compressed file (such as
``.gz``), or it would inflate them as one piece.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neumatic.llm.common import fresh_path

MAGIC = b"\x1f\x8b\x08"
EMPTY = gzip.compress(b"", mtime=0)
ENCODING = "ISO-8859-1"
URN = "urn:page:"
DATE = "2020-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Copies of each repeated digest, so that one digest's pages spread over so many tasks.
SALTS = 64
RECORD = "record_id string, record_type string, target_uri string, refers_to_id string, payload_bytes long, payload_digest string, payload binary"
PART = "path string, start long, at long, part binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def member(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, date: str = DATE) -> bytes:
    """One record as a gzip member; a record that refers to another holds headers only."""
    revisit = refers_to is not None
    target = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if target:
        head.append(f"WARC-Target-URI: {target}")
    if revisit:
        head += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def write(pages: DataFrame, path: str | None = None, revisit_from_bytes: int = 0) -> str:
    """Write a record per row of ``pages`` (page_id, url, html) under ``path``; returns the path.

    A null html is an empty payload.  Of rows with equal payloads of at least
    ``revisit_from_bytes`` bytes, the one with the largest page_id is a
    response and the others are revisits of it; rows without a page_id, and
    rows that repeat the largest page_id, are responses.  Other columns are
    ignored.  An empty table gives an archive without records.
    """
    path = path or fresh_path(pages.sparkSession, "warc")
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", F.encode(html, "UTF-8").alias("payload"), F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).alias("size"))
    groups = rows.where(F.col("size") >= revisit_from_bytes).groupBy("sha1").agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
    groups = groups.where("n > 1 and largest is not null").select("sha1", "largest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    marked = salted.join(groups, ["sha1", "salt"], "left")
    refers = F.when(F.col("page_id").isNotNull() & (F.col("page_id") != F.col("largest")), F.col("largest"))
    marked = marked.select("page_id", "url", "payload", "sha1", refers.alias("refers_to"))

    def encode(batches):
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            out = [member(i, u, p, base64.b32encode(bytes.fromhex(s)).decode(), r) for i, u, p, s, r in zip(*cols)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    members = marked.mapInArrow(encode, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", EMPTY.decode(ENCODING)).option("encoding", ENCODING).text(path)
    return path


def number(text: str | bytes | None) -> int | None:
    """A header's number of bytes, or None if it has none."""
    return int(text) if text is not None and text.strip().isdigit() else None


def parse(data: bytes) -> tuple | None:
    """A record's values from an inflated member, or None if it isn't a record.

    A record without a valid length, or whose payload does not have the digest
    that its header tells, is of type ``damaged``; its bytes and digest are
    those found.
    """
    if not data.startswith(b"WARC/"):
        return None
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length, kind = number(fields.get("content-length")), fields.get("warc-type", "")
    block = rest if length is None else rest[:length]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    size = len(payload)
    if kind == "revisit":
        payload = b""
        lengths = [x.split(b":", 1)[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size = number(lengths[0]) if lengths else None
    elif kind == "response":
        found = base32_sha1(payload)
        kind = "damaged" if digest not in ("", found) else kind
        digest = found
    kind = "damaged" if length is None or length > len(rest) else kind
    return (fields.get("warc-record-id", "").strip("<>"), kind, fields.get("warc-target-uri"), fields.get("warc-refers-to", "").strip("<>") or None, size, digest, payload)


class Joiner:
    """Puts consecutive stretches of one file together into members."""

    def __init__(self):
        self.inflate, self.chunks, self.held, self.first = None, [], [], True

    def feed(self, key: tuple[int, int], stretch: bytes) -> list[bytes]:
        """Inflated members that end with this stretch. ``held`` keeps the stretches not yet used."""
        self.held.append((key, stretch))
        data = MAGIC + stretch
        if self.inflate is not None:
            try:
                return self._more(data)
            except zlib.error:
                self.inflate = None
        self.inflate, self.chunks, self.opened = zlib.decompressobj(31), [], len(self.held) - 1
        try:
            return self._more(data)
        except zlib.error:
            self.inflate = None
            return []

    def _more(self, data: bytes) -> list[bytes]:
        self.chunks.append(self.inflate.decompress(data))
        if not self.inflate.eof:
            return []
        whole, self.inflate = b"".join(self.chunks), None
        lead = self.held[: self.opened] if self.first else []
        self.lead, self.first, self.held = (lead if lead else getattr(self, "lead", [])), False, []
        return [whole]

    def loose(self) -> list[tuple[tuple[int, int], bytes]]:
        """Stretches that no member here used: those before the first member, and an open end."""
        if self.first:
            return self.held
        tail = self.held[self.opened :] if self.inflate is not None else []
        return [*getattr(self, "lead", []), *tail]


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of the archives under ``path``: the columns of RECORD.

    A task holds one Arrow batch of stretches and one record's.  A response's
    digest is computed from its payload, and a record whose header disagrees
    with it is of type ``damaged``; a revisit's are its headers'.
    """
    lines = spark.read.option("lineSep", MAGIC.decode(ENCODING)).option("encoding", ENCODING).text(path)
    source = lines.select(F.col("value").cast("binary").alias("stretch"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    names = [x.split()[0] for x in RECORD.split(", ")]

    def batch_of(rows, kinds):
        types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        fields = [x.split() for x in kinds.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])

    def values(members):
        for data in members:
            if (record := parse(data)) is not None:
                yield record if with_payload else (*record[:-1], None)

    def scan(batches, want):
        at, joiner, count = None, None, 0
        for batch in batches:
            rows = []
            for stretch, path, start in zip(*(c.to_pylist() for c in batch.columns)):
                if (path, start) != at:
                    if joiner and want == "parts":
                        rows += [(at[0], *key, part) for key, part in joiner.loose()]
                    at, joiner, count = (path, start), Joiner(), 0
                    if start == 0:  # what stands before the first magic
                        count = 1
                        continue
                count += 1
                members = joiner.feed((start, count), stretch)
                if want == "records":
                    rows += values(members)
            yield batch_of(rows, RECORD if want == "records" else PART)
        if joiner and want == "parts":
            yield batch_of([(at[0], *key, part) for key, part in joiner.loose()], PART)

    def stitch(key, table):
        joiner, rows = Joiner(), []
        for row in table.sort_by([("start", "ascending"), ("at", "ascending")]).to_pylist():
            rows += values(joiner.feed((row["start"], row["at"]), row["part"]))
        return pa.Table.from_batches([batch_of(rows, RECORD)])

    whole = source.mapInArrow(lambda b: scan(b, "records"), RECORD)
    parts = source.mapInArrow(lambda b: scan(b, "parts"), PART)
    return whole.unionByName(parts.groupBy("path").applyInArrow(stitch, RECORD)).select(*names)


def report(records: DataFrame, id_type: str = "long") -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to (page ids as ``id_type``)."""
    def page(column):
        return F.when(F.col(column) != URN, F.substring(column, len(URN) + 1, 1 << 20)).cast(id_type)

    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to_id").alias("refers_to"))


def oracle(table: str = "pages") -> str:
    """DuckDB SQL for what ``report`` tells of a table with distinct page_ids, written with revisits of any size."""
    value = "CAST('0x' || substr(sha1(h), CAST(5 * (k // 4) + 1 AS INTEGER), 5) AS BIGINT)"
    digest = f"array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (({value} >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '')"
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM {table}), g AS (SELECT h, max(page_id) AS largest FROM p GROUP BY h)
SELECT page_id, octet_length(encode(h)) AS payload_bytes, {digest} AS payload_digest, CASE WHEN page_id < largest THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < largest THEN largest END AS refers_to FROM p JOIN g USING (h)"""
