"""Rows of the test tables in the form that the engine's operators take: streams, tracks, words, images."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphstream.functions import rle
from glyphstream.operators import recognise
from glyphstream.sources import matroska, pgs

#: Entries of the event types in made palettes, and their luma: odd ones are bright.
ENTRY = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}
LUMA = {1: 235, 2: 16, 3: 235, 4: 16, 5: 235}


def luma() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(LUMA)] = list(LUMA.values())
    return out


#: Events to a task, about, at any size of the table.
TASK_EVENTS = 1 << 17


def dealt(d: DataFrame, key: str, events: DataFrame) -> DataFrame:
    """d by key in so many tasks that each has some TASK_EVENTS of the events, which adaptive execution doesn't gather, as rows grow much when they are read back."""
    return d.repartition(max(-(-events.count() // TASK_EVENTS), d.sparkSession.sparkContext.defaultParallelism), key)


def contents(events: DataFrame) -> DataFrame:
    """(track_id, content): a stream for each user. The n-th event is a display set at n seconds; a signup begins an epoch; events of odd number have an
    image of three lines, two of them ink; every fifth has no window. The bytes are those of pgs.display_set()."""
    d = dealt(events.select("user_id", "ts", "event_id", "event_type"), "user_id", events)
    d = d.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))))
    number = lambda n, size: F.lpad(F.hex(n), 2 * size, "0")
    at = F.col("n").cast("long") * 90_000
    # A field of four bytes: a longer one would be another stream.
    head = F.concat(F.lit(b"PG".hex()), number(F.when(at < 1 << 32, at), 4), F.lit("0" * 8))
    event = lambda m: F.pmod("event_id", F.lit(m))
    body = lambda kind, payload: pgs.encoded(kind, 0, payload)[10:].hex()
    image = lambda wide: rle.encode([wide, 0, wide, 0, wide, 0], [1, 0, 2, 0, 3, 0])
    whole = [{kind: body(kind, payload) for _, kind, *_, payload, _ in pgs.split(pgs.display_set(0, 0, 0, 0, 0, image(2 + k), LUMA))} for k in range(100)]
    pcs, wds = whole[0][0x16], whole[0][0x17]  # of zeros, two letters a byte
    shown = F.concat(head, F.lit(whole[0][0x14]), head, F.element_at(F.array(*(F.lit(w[0x15]) for w in whole)), event(100).cast("int") + 1))
    parts = [
        *(head, F.lit(pcs[:16]), number(F.pmod("n", F.lit(65536)), 2), F.when(F.col("event_type") == "signup", "80").otherwise("00"), F.lit(pcs[22:])),
        *(head, F.lit(wds[:6]), F.when(event(5) != 0, "01").otherwise("00"), F.lit(wds[8:10]), number(event(1000), 2), number(event(700), 2), F.lit(wds[18:])),
        *(F.when(event(2) == 1, shown).otherwise(""), head, F.lit(whole[0][0x80])),
    ]
    d = d.select("user_id", "n", F.coalesce(F.unhex(F.concat(*parts)), F.raise_error(F.lit("an event without a number, or beyond the stream's time"))).alias("set"))
    return d.groupBy("user_id").agg(F.expr("listagg(set, X'') WITHIN GROUP (ORDER BY n)").alias("content")).select(F.col("user_id").cast("string").alias("track_id"), "content")


def ranges(contents: DataFrame, size: int = 1500) -> DataFrame:
    """(track_id, at, content): each track's bytes in ranges of ``size``, and a row without content where it ends."""
    n = F.octet_length("content")
    parts = F.transform(F.sequence(F.lit(0), n, F.lit(size)), lambda at: F.struct(at.cast("long").alias("at"), F.substring("content", at + 1, size).alias("content")))
    end = F.array(F.struct(n.cast("long").alias("at"), F.lit(None).cast("binary").alias("content")))
    return contents.select("track_id", F.inline(F.concat(parts, end)))


def decoded(events: DataFrame) -> DataFrame:
    return pgs.decode(pgs.items(pgs.display_sets(dealt(pgs.segments(contents(events)), "track_id", events))))


def document_tracks(docs: DataFrame, disabled: Column | None = None) -> DataFrame:
    """(source, track): a document as a graphic subtitle track of its source."""
    off = F.when(disabled, True) if disabled is not None else F.lit(None).cast("boolean")
    return docs.select("source", F.struct(F.col("doc_id").alias("id"), F.lit("subtitles").alias("type"), F.lit("HDMV PGS").alias("codec"), F.col("lang").alias("language"), off.alias("disabled")).alias("track"))


def coded_runs(runs: DataFrame) -> DataFrame:
    """(user_id, run_id, event_type, run_len) as read back from the codes of each user's runs."""
    names = {v: k for k, v in ENTRY.items()}

    def through(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("run_id")
        length, colour = rle.runs(rle.encode(pdf["run_len"].tolist(), [ENTRY[t] for t in pdf["event_type"]]))
        return pd.DataFrame({"user_id": pdf["user_id"].iloc[0], "run_id": np.arange(1, len(length) + 1), "event_type": [names[c] for c in colour.tolist()], "run_len": length})

    return runs.groupBy("user_id").applyInPandas(through, "user_id long, run_id long, event_type string, run_len long")


def bitmaps(events: DataFrame) -> DataFrame:
    """(user_id, height, width, ink, places): each user's events as pixels, seven to a line; places is the sum of the ink's places."""

    def through(pdf: pd.DataFrame) -> pd.DataFrame:
        codes = [ENTRY[t] for t in pdf.sort_values(["ts", "event_id"])["event_type"]]
        lengths, colours = [], []
        for at in range(0, len(codes), 7):
            line = codes[at : at + 7]
            lengths += [1] * len(line) + [0]
            colours += [*line, 0]
        m = rle.bitmap(rle.encode(lengths, colours), luma())
        ink = np.flatnonzero(m.reshape(-1) == rle.INK)
        return pd.DataFrame({"user_id": [pdf["user_id"].iloc[0]], "height": [m.shape[0]], "width": [m.shape[1]], "ink": [len(ink)], "places": [int(ink.sum())]})

    return events.select("user_id", "ts", "event_id", "event_type").groupBy("user_id").applyInPandas(through, "user_id long, height long, width long, ink long, places long")


def ink_sums(vectors: DataFrame) -> DataFrame:
    """(vec_id, s): the sum of the pixels that a vector gives as a palette, bright where it is positive."""

    def run(parts):
        for pdf in parts:
            sums = [int(rle.ink_table(np.where(np.asarray(v) > 0, 255, 0).astype(np.uint8))[: len(v)].sum()) if v is not None else None for v in pdf["embedding"]]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "s": pd.Series(sums, dtype="Int64")})

    return vectors.select("vec_id", "embedding").mapInPandas(run, "vec_id long, s long")


def words(d: DataFrame) -> DataFrame:
    """d (key, line, word, top, left, conf, text) as a recogniser's words."""
    fixed = {"level": recognise.WORD_LEVEL, "page_num": 1, "block_num": 1, "par_num": 1, "width": 0, "height": 0}
    return d.withColumnsRenamed({"line": "line_num", "word": "word_num"}).withColumns({k: F.lit(v) for k, v in fixed.items()})


def placed(docs: DataFrame) -> DataFrame:
    """(source, doc_id, shelf, x0, y0): documents as images one pixel high and as wide as they have characters, 500 ids of a source to a track."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id").reset_index(drop=True)
        items = pd.DataFrame({"y": 0, "h": 1, "w": pdf["n_chars"]})
        place, _ = recognise.layout(items, (45, 115), 20_000)
        shelf = np.empty(len(items), np.int64)
        for k, own in enumerate(recognise.shelves(items, 115, 20_000)):
            shelf[own] = k
        return pd.DataFrame({"source": pdf["source"], "doc_id": pdf["doc_id"], "shelf": shelf, "x0": place["x0"], "y0": place["y0"]})

    d = docs.select("source", F.floor(F.col("doc_id") / 500).alias("part"), "doc_id", "n_chars")
    return d.groupBy("source", "part").applyInPandas(one, "source string, doc_id long, shelf long, x0 long, y0 long")


def element(ident: int, *parts: bytes) -> bytes:
    """A Matroska element with an eight-byte size."""
    body = b"".join(parts)
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + (len(body) | 1 << 56).to_bytes(8, "big") + body


def container(tracks: list[tuple[str, str]], blocks: list[tuple[int, int, bytes]]) -> bytes:
    """A Matroska file of graphic subtitle tracks (language, name) and blocks (milliseconds, track from 1, content), a cluster for each run of one time."""
    number = lambda ident, n: element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))
    entry = lambda k, lang, name: element(matroska.TRACK_ENTRY, number(matroska.NUMBER, k), number(matroska.TYPE, 17), element(matroska.CODEC_ID, matroska.PGS_CODEC.encode()), element(matroska.LANGUAGE_BCP47, lang.encode()), element(matroska.NAME, name.encode()))
    head = element(matroska.TRACKS, *(entry(k, *t) for k, t in enumerate(tracks, 1)))
    clusters = [element(matroska.CLUSTER, number(matroska.TIMESTAMP, at), element(matroska.SIMPLE_BLOCK, bytes([0x80 | track, 0, 0, 0]), data)) for at, track, data in blocks]
    return element(0x1A45DFA3, b"\x42\x86\x81\x01") + element(matroska.SEGMENT, element(matroska.INFO, number(matroska.TIMESTAMP_SCALE, 1_000_000)), head, *clusters)


#: Turns of a conversation to a made container, and bytes of a text to a segment.
TURNS, PIECE = 64, 65_535


def conversation_containers(turns: DataFrame, folder: str) -> DataFrame:
    """(path, content): a container for each TURNS turns of a conversation, what the assistant said in a track called fr, the rest in one called en, each turn at so many seconds."""

    def made(key, pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = []
        for turn, role, text in pdf.sort_values(["turn", "role", "text"])[["turn", "role", "text"]].itertuples(index=False):
            data = text.encode()
            for at in range(0, max(len(data), 1), PIECE):
                piece = data[at : at + PIECE]
                blocks.append((turn * 1000, 2 if role == "assistant" else 1, b"\x80" + len(piece).to_bytes(2, "big") + piece))
        return pd.DataFrame({"path": [f"{folder}/{key[0] % 16}/{key[0]}-{key[1]}.mkv"], "content": [container([("en", "User"), ("fr", "Assistant")], blocks)]})

    d = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.coalesce("text", F.lit("")).alias("text"))
    return d.groupBy("conv_id", F.floor(F.col("turn") / TURNS).alias("part")).applyInPandas(made, "path string, content binary")
