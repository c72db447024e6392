"""WARC: Merkle fixity audit.

Each page becomes a WARC resource record. Records are dealt into archives by a hash of their key and content, so no
page_id can make one archive large; within an archive they stand in the order of (page_id, url, digest). An archive's bytes are
stored in segments of whole records, each with its index (offset, length and digest of every record). A replica's leaves are
taken from its own bytes: each record is read back at its offset and hashed. A leaf is the hash of a record's offset,
length and digest; a node covers ``fanout`` ordered neighbours and hashes their digests with the offset range they span; the archive's root
covers all of it. An audit compares roots first and joins the children of mismatching nodes only; every level is a table of its own.

Defined results: null url or html are empty; equal records collapse into one with a count (copies); an empty table
gives no rows; other columns are not looked at. A record missing in one replica has the status missing
or extra, one with other bytes changed, and one with the same bytes at another place moved; bytes that a replica lacks (a
segment cut short) make the records there missing.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphstream.llm._common import Scratch, lean, read_table

FANOUT = 16
PER_ARCHIVE = 2048
LEVELS = 3  # of nodes above the records: 16, 256 and 4096 records wide
FAULT_EVERY = 97
#: Bytes of an archive to a stored row, about: a segment ends with the record that passes this.
SEGMENT = 1 << 20
DATE = "2024-01-01T00:00:00Z"

_ENTRY = "struct<page_id:bigint,url:string,seq:bigint,offset:bigint,length:bigint,digest:string,copies:bigint>"
STORED = f"archive long, segment long, base long, data binary, entries array<{_ENTRY}>"
_ENTRY_TYPE = pa.struct([("page_id", pa.int64()), ("url", pa.string()), ("seq", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("digest", pa.string()), ("copies", pa.int64())])
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(_ENTRY_TYPE)]
_NAMES = ["archive", "segment", "base", "data", "entries"]


def record_bytes(page_id: Column, url: Column, html: Column) -> Column:
    """The record's bytes: WARC headers, blank line, content, two line ends."""
    body = F.encode(F.coalesce(html, F.lit("")), "utf-8")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Date: " + DATE + "\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(F.encode(head, "utf-8"), body, F.encode(F.lit("\r\n\r\n"), "utf-8"))


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, content) of one record's bytes; ValueError if they aren't exactly one record."""
    head, mark, body = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("no record header")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(headers.get("Content-Length", "-1"))
    if n < 0 or body[n:] != b"\r\n\r\n":
        raise ValueError("the content's length or end is wrong")
    return headers, body[:n]


def records(pages: DataFrame) -> DataFrame:
    """(page_id, url, record) of pages (page_id, url, html)."""
    url, html, page = F.col("url").cast("string"), F.col("html").cast("string"), F.col("page_id").cast("long")
    return pages.select(page.alias("page_id"), F.coalesce(url, F.lit("")).alias("url"), record_bytes(page, url, html).alias("record"))


def archives(pages: DataFrame, per_archive: int = PER_ARCHIVE, segment_bytes: int = SEGMENT) -> DataFrame:
    """STORED rows of the archives: each task writes whole archives in order, one segment at a time. One shuffle of the records."""
    n = max(1, -(-pages.count() // per_archive))
    r = records(pages).withColumn("digest", F.sha2("record", 256))
    key = F.sha2(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "url", "digest"), 256)
    r = r.withColumn("archive", F.conv(F.substring(key, 1, 12), 16, 10).cast("long") % n)
    ordered = r.repartition("archive").sortWithinPartitions("archive", "page_id", "url", "digest")

    def write(batches):
        archive, segment, seq, base, offset, last, parts, entries = None, 0, 0, 0, 0, None, [], []

        def row():
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((archive, segment, base, b"".join(parts), entries), _TYPES)], names=_NAMES)

        for b in batches:
            for a, page, url, digest, record in zip(*(c for c in b.columns)):
                a, record_key = a.as_py(), (page.as_py(), url.as_py(), digest.as_py())
                if a != archive:
                    if entries:
                        yield row()
                    archive, segment, seq, base, offset, last, parts, entries = a, 0, 0, 0, 0, None, [], []
                if record_key == last:
                    entries[-1]["copies"] += 1
                    continue
                if offset - base >= segment_bytes:
                    yield row()
                    segment, base, parts, entries = segment + 1, offset, [], []
                parts.append(record.as_py())
                size = len(parts[-1])
                entries.append({"page_id": record_key[0], "url": record_key[1], "seq": seq, "offset": offset, "length": size, "digest": record_key[2], "copies": 1})
                seq, offset, last = seq + 1, offset + size, record_key
        if entries:
            yield row()

    return ordered.select("archive", "page_id", "url", "digest", "record").mapInArrow(lean(write), STORED)


def manifest(stored: DataFrame) -> DataFrame:
    """(page_id, url, archive, seq, offset, length, digest, copies) from the index of STORED rows; their bytes aren't read."""
    return stored.select("archive", F.inline("entries")).select("page_id", "url", "archive", "seq", "offset", "length", "digest", "copies")


def replica(stored: DataFrame, fault_every: int = FAULT_EVERY) -> DataFrame:
    """A second copy of the archives' bytes with planted bit rot: the last byte of records with page_id mod fault_every = 0 is zero."""

    def rot(batches):
        for b in batches:
            for row in b.to_pylist():
                data = bytearray(row["data"])
                for e in row["entries"]:
                    if e["page_id"] is not None and e["page_id"] % fault_every == 0:
                        data[e["offset"] + e["length"] - 1 - row["base"]] = 0
                yield pa.RecordBatch.from_arrays([pa.array([row[k] if k != "data" else bytes(data)], t) for k, t in zip(_NAMES, _TYPES)], names=_NAMES)

    return stored.mapInArrow(lean(rot), STORED)


def read_back(stored: DataFrame, content: bool = False) -> DataFrame:
    """Leaves (archive, seq, offset, length, digest, problem[, record]) of the records read at their offsets from STORED bytes.

    digest is that of the bytes found; problem tells why they aren't a whole record; records whose bytes aren't there give no row.
    """

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                data, out = memoryview(row["data"]), []
                for e in row["entries"]:
                    at = e["offset"] - row["base"]
                    record = bytes(data[at : at + e["length"]])
                    if at < 0 or len(record) < e["length"]:
                        continue
                    try:
                        problem = parse_record(record) and None
                    except ValueError as wrong:
                        problem = str(wrong)
                    out.append((row["archive"], e["seq"], e["offset"], e["length"], hashlib.sha256(record).hexdigest(), problem, record)[: 6 + content])
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.binary()] * content
                columns = zip(*out) if out else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["archive", "seq", "offset", "length", "digest", "problem", "record"][: 6 + content])

    return stored.mapInArrow(lean(run), "archive long, seq long, offset long, length long, digest string, problem string" + ", record binary" * content)


def _parent(k: int, fanout: int, levels: int) -> Column:
    """The node above a node of level k; all nodes of the last level but one have the root above them."""
    return F.floor(F.col("node") / fanout).cast("long") if k < levels else F.lit(0).cast("long")


def tree(leaves: DataFrame, scratch: Scratch, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """Kept levels (side, archive, node, digest, own) from leaves (side, archive, seq, offset, length, digest) up to one root an archive; own is a record's digest."""
    text = lambda *parts: F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)
    leaf = text(F.col("offset").cast("string"), F.col("length").cast("string"), "digest")
    at = [scratch.keep(leaves.select("side", "archive", F.col("seq").alias("node"), leaf.alias("digest"), F.col("digest").alias("own"), F.col("offset").alias("first"), (F.col("offset") + F.col("length")).alias("last")))]
    for k in range(levels + 1):
        kids = F.array_sort(F.collect_list(F.struct("node", "digest")))
        up = at[-1].groupBy("side", "archive", _parent(k, fanout, levels).alias("up")).agg(F.concat_ws("", F.transform(kids, lambda x: x.digest)).alias("kids"), F.min("first").alias("first"), F.max("last").alias("last"))
        at.append(scratch.keep(up.select("side", "archive", F.col("up").alias("node"), text(F.col("first").cast("string"), F.col("last").cast("string"), "kids").alias("digest"), F.lit(None).cast("string").alias("own"), "first", "last")))
    return at


def audit(left: DataFrame, right: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(archive, seq, status, left_digest, right_digest) of leaves that differ between two replicas' leaves.

    status: changed, moved (the same digest with another offset or length), missing (in right) or extra (only there). Only children of mismatching nodes are compared.
    """
    scratch = Scratch(left.sparkSession)
    leaf = lambda d, side: d.select(F.lit(side).alias("side"), "archive", "seq", "offset", "length", "digest")
    nodes = tree(leaf(left, 0).unionByName(leaf(right, 1)), scratch, fanout, levels)
    bad = None
    for k in range(levels + 1, -1, -1):
        t = nodes[k].withColumn("up", _parent(k, fanout, levels))
        if bad is not None:
            t = t.join(bad, ["archive", "up"], "left_semi")
        of = lambda side, c, name: F.max(F.when(F.col("side") == side, F.col(c))).alias(name)
        both = t.groupBy("archive", "node").agg(of(0, "digest", "l"), of(1, "digest", "r"), of(0, "own", "left_digest"), of(1, "own", "right_digest")).where(~F.col("l").eqNullSafe(F.col("r")))
        if k == 0:
            status = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "extra").when(F.col("left_digest") == F.col("right_digest"), "moved").otherwise("changed")
            found = scratch.keep(both.select("archive", F.col("node").alias("seq"), status.alias("status"), "left_digest", "right_digest"))
        else:
            above, bad = bad, scratch.keep(both.select("archive", F.col("node").alias("up")))
            scratch.drop(nodes[k], above)
    scratch.drop(nodes[0], bad)
    return found


def op10_warc_fixity(spark, sf_dir: str) -> DataFrame:
    """One row a record: where it stands, its digest, the copy's digest and whether the audit found it damaged."""
    scratch = Scratch(spark)
    first = scratch.keep(archives(read_table(spark, sf_dir, "pages")))
    second = scratch.keep(replica(first))
    index = scratch.keep(manifest(first))
    found = audit(read_back(first), read_back(second))
    scratch.drop(first, second)
    out = index.join(found, ["archive", "seq"], "left")
    return out.select("page_id", "url", "archive", "seq", F.col("offset").alias("record_offset"), "length", "digest", "copies", F.coalesce("status", F.lit("ok")).alias("status"), F.coalesce("right_digest", "digest").alias("copy_digest"))
