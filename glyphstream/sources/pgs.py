"""Presentation-graphic streams as tables: files to segments, segments to display sets and timed items."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphstream.functions import rle
from glyphstream.functions.binary import be_uint, byte_or, ticks_to_ms
from glyphstream.operators import timeline

#: Fixed values of the format.
TYPES = {0x14: "PDS", 0x15: "ODS", 0x16: "PCS", 0x17: "WDS", 0x80: "END"}
STATES = {0x00: "NORMAL_CASE", 0x40: "ACQUISITION_POINT", 0x80: "EPOCH_START"}
SEQUENCES = {0x40: "LAST", 0x80: "FIRST", 0xC0: "FIRST_AND_LAST"}
HEADER = 13
#: What follows the two letters: times, type, size.
_HEAD = struct.Struct(">IIBH")
REPAIR_MS = 10_000

SEGMENTS = "track_id string, seq int, byte_offset long, stype int, pts long, dts long, size int, payload binary, error string"


def split(content: bytes, strict: bool = False):
    """(offset, type, pts, dts, size, payload, error) of each segment, by one cursor.

    Reading stops at the first bytes that aren't a segment; a short last payload is kept. An unknown type is an error row, the last one, as the rest of
    the stream can't be trusted; ValueError if strict.
    """
    at = 0
    while at + HEADER <= len(content) and content[at : at + 2] == b"PG":
        pts, dts, kind, size = _HEAD.unpack_from(content, at + 2)
        error = None if kind in TYPES else f"unknown segment type 0x{kind:02x}"
        if error and strict:
            raise ValueError(error)
        yield at, kind, pts, dts, size, content[at + HEADER : at + HEADER + size], error
        if error:
            return
        at += HEADER + size


def encoded(kind: int, pts: int, payload: bytes, dts: int = 0) -> bytes:
    """A segment's bytes."""
    return b"PG" + pts.to_bytes(4, "big") + dts.to_bytes(4, "big") + bytes([kind]) + len(payload).to_bytes(2, "big") + payload


def display_set(pts: int, state: int, number: int, x: int, y: int, image: bytes | None = None, palette: dict[int, int] | None = None, windows: int = 1) -> bytes:
    """The bytes of a whole display set: composition, one window, and with an image its palette (luma by entry) and object."""
    two = lambda n: n.to_bytes(2, "big")
    out = [encoded(0x16, pts, two(1920) + two(1080) + b"\x10" + two(number) + bytes([state, 0, 0, 0])), encoded(0x17, pts, bytes([windows, 0]) + two(x) + two(y) + two(2) + two(2))]
    if image is not None:
        out.append(encoded(0x14, pts, b"\0\0" + b"".join(bytes([k, v, 128, 128, 255]) for k, v in (palette or {}).items())))
        out.append(encoded(0x15, pts, two(0) + b"\0\xc0" + (len(image) + 4).to_bytes(3, "big") + two(2) + two(2) + image))
    return b"".join([*out, encoded(0x80, pts, b"")])


def segments(tracks: DataFrame, strict: bool = False) -> DataFrame:
    """SEGMENTS of tracks (track_id, content[, error]); null content has none, or the error as its one row."""

    def run(batches):
        names = [c.split()[0] for c in SEGMENTS.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.string()]
        for b in batches:
            for track, content, error in zip(b.column(0), b.column(1), b.column(2)):
                rows = [(track.as_py(), k, *x) for k, x in enumerate(split(content.as_py() or b"", strict))]
                if error.as_py() is not None:
                    rows.append((track.as_py(), len(rows), None, None, None, None, None, None, error.as_py()))
                for k in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 1000]), kinds)], names=names)

    error = F.col("error").cast("string") if "error" in tracks.columns else F.lit(None).cast("string").alias("error")
    return tracks.select(F.col("track_id").cast("string"), F.col("content").cast("binary"), error).mapInArrow(run, SEGMENTS)


def _named(code: Column, names: dict[int, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def with_headers(segs: DataFrame) -> DataFrame:
    """Segments with stype_name and the nullable structs pcs, wds, pds and ods."""
    p, n = F.col("payload"), lambda a, b: be_uint(F.col("payload"), a, b - a).cast("int")
    last = byte_or(p, 3) == 0x40
    fragment = last | (byte_or(p, 3) == 0)  # a middle fragment is laid out like a last one
    pcs = F.struct(n(0, 2).alias("width"), n(2, 4).alias("height"), n(4, 5).alias("frame_rate"), n(5, 7).alias("composition_number"), n(7, 8).alias("state"), _named(n(7, 8), STATES).alias("composition_state"), (n(8, 9) == 0x80).alias("palette_update"), n(9, 10).alias("palette_id"), n(10, 11).alias("num_objects"))
    wds = F.struct(n(0, 1).alias("num_windows"), n(1, 2).alias("window_id"), n(2, 4).alias("x_offset"), n(4, 6).alias("y_offset"), n(6, 8).alias("width"), n(8, 10).alias("height"))
    pds = F.struct(n(0, 1).alias("palette_id"), n(1, 2).alias("version"))
    whole = lambda c: F.when(~fragment, c)
    ods = F.struct(n(0, 2).alias("id"), n(2, 3).alias("version"), _named(n(3, 4), SEQUENCES).alias("sequence_type"), whole(n(4, 7)).alias("data_len"), whole(n(7, 9)).alias("width"), whole(n(9, 11)).alias("height"), F.when(fragment, F.expr("substring(payload, 5)")).otherwise(F.expr("substring(payload, 12)")).alias("img_data"))
    s = F.col("stype")
    return segs.withColumns({"stype_name": _named(s, TYPES), "pcs": F.when(s == 0x16, pcs), "wds": F.when(s == 0x17, wds), "pds": F.when(s == 0x14, pds), "ods": F.when(s == 0x15, ods)})


def display_sets(segs: DataFrame) -> DataFrame:
    """Segments with headers and ds_index; those after a track's last END are left out, but for a row that tells why reading ended."""
    ended = F.coalesce(F.col("stype") == 0x80, F.lit(False)) & F.col("error").isNull()
    d = timeline.end_delimited(segs, ["track_id"], ["seq"], ended)
    # One sort of segments as they were split does for both windows; fields of headers are taken from them afterwards.
    last = F.max(F.when(ended, F.col("seq"))).over(Window.partitionBy("track_id"))
    d = d.withColumn("_last", last).where("seq <= _last OR error IS NOT NULL").drop("_last")
    names = [*segs.columns, "stype_name", "pcs", "wds", "pds", "ods", "ds_index"]
    return with_headers(d).select(*dict.fromkeys(names))


def display_set_report(sets: DataFrame) -> DataFrame:
    """Segment counts by type, and whether a set has one PCS, WDS and END each."""
    n = lambda t: F.count_if(F.col("stype_name") == t)
    valid = (n("PCS") == 1) & (n("WDS") == 1) & (n("END") == 1)
    return sets.groupBy("track_id", "ds_index").agg(*(n(t).alias(f"n_{t.lower()}") for t in TYPES.values()), valid.alias("is_valid"))


def sets_json(sets: DataFrame) -> DataFrame:
    """(track_id, ds_index, json) for debugging; nulls are left out."""
    ods = F.when(F.col("ods").isNotNull(), F.struct("ods.id", "ods.version", "ods.sequence_type", "ods.data_len", "ods.width", "ods.height"))
    row = F.struct("seq", "stype_name", "pts", "dts", "size", "pcs", "wds", "pds", ods.alias("ods"))
    return sets.groupBy("track_id", "ds_index").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("json"))


def items(sets: DataFrame, zero_is_null: bool = False) -> DataFrame:
    """Timed items (track_id, item_id, start_ms, end_ms, x_offset, y_offset, image_data, palette): one for each epoch, ends repaired.

    A set begins an item if its composition is an epoch start or an acquisition point. The image is that of the item's first such set: all its object
    data joined, and its first palette. Items without image, offsets or start, and those whose end can't be repaired, are dropped (rejected() tells them). A
    track that can't be read to its end, or that has a composition of no known state, has an item with its error, so that it isn't taken for whole.
    """
    d = _candidates(sets, zero_is_null)
    fixed = timeline.repair_ends(d.where("error IS NULL"), ["track_id"], "item_id", "start_ms", "end_ms", F.lit(REPAIR_MS), F.lit(1))
    good = fixed.where("image IS NOT NULL AND x_offset IS NOT NULL AND y_offset IS NOT NULL")
    return good.unionByName(d.where("error IS NOT NULL")).select("track_id", "item_id", "start_ms", "end_ms", "x_offset", "y_offset", "image.image_data", "image.palette", "error")


def rejected(sets: DataFrame, zero_is_null: bool = False) -> DataFrame:
    """(track_id, item_id, start_ms, reason) of what items() drops."""
    d = _candidates(sets, zero_is_null).where("error IS NULL")
    d = d.withColumn("next_ms", F.lead("start_ms").over(Window.partitionBy("track_id").orderBy("item_id")))
    open_end = ~F.coalesce(F.col("end_ms") > F.col("start_ms"), F.lit(False)) & ~F.coalesce(F.col("start_ms") + REPAIR_MS >= F.col("next_ms"), F.lit(False))
    reason = F.when(F.col("image").isNull(), "no image").when(F.col("x_offset").isNull() | F.col("y_offset").isNull(), "no place").when(F.col("start_ms").isNull(), "no start").when(open_end, "no end")
    return d.select("track_id", "item_id", "start_ms", reason.alias("reason")).where("reason IS NOT NULL")


def _candidates(sets: DataFrame, zero_is_null: bool) -> DataFrame:
    """All items, whole or not: (track_id, item_id, start_ms, end_ms, x_offset, y_offset, image, error)."""
    known = F.col("pcs.state").isin(*STATES)
    wrong = F.when((F.col("stype") == 0x16) & ~F.coalesce(known, F.lit(False)), "a composition of no known state")
    starts = F.coalesce(F.col("pcs.state").isin(0x80, 0x40), F.lit(False))
    kept = {"pts": F.col("pts"), "begins": starts, "pcs": F.col("stype") == 0x16, "wds": F.col("wds"), "data": F.col("ods.img_data"), "pal": F.when(F.col("stype") == 0x14, F.col("payload")), "error": F.coalesce(F.col("error"), wrong)}
    s = sets.select("track_id", "ds_index", "seq", *(c.alias(k) for k, c in kept.items()))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("seq", c.alias("v"))))), lambda x: x["v"])
    ds = s.groupBy("track_id", "ds_index").agg(F.min_by(F.when(F.col("pcs"), F.col("pts")), F.when(F.col("pcs"), F.col("seq"))).alias("pts"), F.max("begins").alias("begins"), F.min_by("wds", F.when(F.col("wds").isNotNull(), F.col("seq"))).alias("wds"), in_order(F.col("data")).alias("data"), F.min_by("pal", F.when(F.col("pal").isNotNull(), F.col("seq"))).alias("pal"), F.min("error").alias("error"))
    g = timeline.start_delimited(ds, ["track_id"], ["ds_index"], F.col("begins"))
    first = F.min_by(F.struct(F.aggregate("data", F.expr("X''"), lambda a, x: F.concat(a, x)).alias("image_data"), F.col("pal").alias("palette")), F.when(F.col("begins"), F.col("ds_index")))
    seen = F.col("wds.num_windows") > 0
    ms = ticks_to_ms(F.col("pts"), zero_is_null)
    return g.groupBy("track_id", "item_id").agg(F.min(ms).alias("start_ms"), F.max(ms).alias("end_ms"), F.min(F.when(seen, F.col("wds.x_offset"))).alias("x_offset"), F.min(F.when(seen, F.col("wds.y_offset"))).alias("y_offset"), first.alias("image"), F.min("error").alias("error"))


def bitmap(data: bytes | None, palette: bytes | None, error: str | None = None) -> tuple[np.ndarray | None, str | None]:
    """(pixels: ink 0, paper 255, or None; error) of an item's coded image and palette."""
    if error is not None:
        return None, error
    try:
        if palette is None and data:
            raise ValueError("an image without a palette")
        return rle.bitmap(data or b"", rle.palette_luma(palette or b"")), None
    except ValueError as e:
        return None, str(e)


def decode(timed: DataFrame, pixels: bool = True) -> DataFrame:
    """items() with height, width, pixels (row-major, ink 0, paper 255) and error in place of the coded image; without pixels, the coded image stays."""

    def run(batches):
        for b in batches:
            rows, seen = [], {}  # equal images of a batch are decoded once
            for coded in zip(*(b.column(c).to_pylist() for c in ("image_data", "palette", "error"))):
                if coded not in seen:
                    m, error = bitmap(*coded)
                    seen[coded] = (*(m.shape if m is not None else (None, None)), m.tobytes() if m is not None and pixels else None, error)
                rows.append(seen[coded])
            height, width, shown, error = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, [pa.int32(), pa.int32(), pa.binary(), pa.string()])]
            own = b.drop_columns(["image_data", "palette", "error"] if pixels else ["error"])
            added = {"height": height, "width": width} | ({"pixels": shown} if pixels else {}) | {"error": error}
            yield pa.RecordBatch.from_arrays([*own.columns, *added.values()], names=[*own.schema.names, *added])

    kept = timed.drop("image_data", "palette", "error") if pixels else timed.drop("error")
    more = "height int, width int, " + "pixels binary, " * pixels + "error string"
    return timed.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema), more]))


def image_key(data: Column, palette: Column) -> Column:
    """A digest of a coded image and its palette; null stands apart from empty."""
    of = lambda c: F.coalesce(F.concat(F.encode(F.concat(F.octet_length(c).cast("string"), F.lit(":")), "utf-8"), c), F.encode(F.lit("-"), "utf-8"))
    return F.sha2(F.concat(of(data), of(palette)), 256)


def distinct_images(timed: DataFrame) -> DataFrame:
    """(key, image_data, palette, error) of items(): each coded image once; those of items with errors not at all."""
    good = timed.where("error IS NULL")
    return good.select(image_key(F.col("image_data"), F.col("palette")).alias("key"), "image_data", "palette", "error").dropDuplicates(["key"])


def decode_once(timed: DataFrame, pixels: bool = True) -> DataFrame:
    """decode(), with each distinct coded image decoded a single time and joined back by its digest."""
    found = decode(distinct_images(timed), pixels=pixels).withColumnRenamed("error", "_wrong").drop("image_data", "palette")
    keyed = timed.withColumn("key", F.when(F.col("error").isNull(), image_key(F.col("image_data"), F.col("palette"))))
    d = keyed.join(found, "key", "left").withColumn("error", F.coalesce("error", "_wrong"))
    own = [c for c in timed.columns if c != "error" and not (pixels and c in ("image_data", "palette"))]
    return d.select(*own, "height", "width", *["pixels"] * pixels, "error")


def image(height: int, width: int, pixels: bytes) -> np.ndarray:
    return np.frombuffer(pixels, np.uint8).reshape(height, width)
