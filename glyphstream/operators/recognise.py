"""Pages of item images, recognition by a pluggable function, acceptance of its words, and the falling confidence cascade.

A recogniser takes (page, options) and returns rows (level, page_num, block_num, par_num, line_num, word_num, left, top, width, height, conf, text).
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphstream.operators import spatial
from glyphstream.sources import pgs
from glyphstream.sources.files import local
from glyphstream.sources.kept import Kept

#: Page border, width limits, first confidence, its step, share that counts as no progress, and the size of a last pass.
BORDER, MIN_WIDTH, MAX_WIDTH = 100, 10 * 1024, 31 * 1024
CONFIDENCE, STEP, STAGNANT, FINAL_BELOW = 65, 5, 0.8, 20
WORD_LEVEL = 5


@dataclass(frozen=True)
class OcrOptions:
    confidence: int | None = None
    width: int | None = None
    oem: int = 1
    psm: int = 6
    language: str | None = None
    #: A folder, mounted on the workers, for each pass's page (PNG) and words (JSON).
    keep: str | None = None
    #: Tracks with more items than this are recognised page by page, so many items to a page at most, by all tasks; smaller ones by one task each.
    page_items: int = 1000

    @property
    def start_confidence(self) -> int:
        return min(max(self.confidence or CONFIDENCE, 0), 100)

    @property
    def page_width(self) -> int:
        return min(max(self.width or MAX_WIDTH, MIN_WIDTH), MAX_WIDTH)


def gaps(heights) -> tuple[int, int]:
    """Vertical and horizontal gap of a track's pages."""
    m = max(heights) // 2
    return m // 2 + 30, m // 2 + 100


def shelves(items: pd.DataFrame, gap_x: int, max_width: int) -> list[list[int]]:
    """Row positions of items (y, h, w) on shelves: those that the lowest remaining item's middle crosses go together, cut where the width is used up.

    An item wider than a page has a shelf of its own.
    """
    left = sorted(range(len(items)), key=lambda i: items["h"].iloc[i])
    y, h, w = (items[c].tolist() for c in "yhw")
    out = []
    while left:
        middle = y[left[0]] + h[left[0]] // 2
        group = [i for k, i in enumerate(left) if k == 0 or y[i] <= middle <= y[i] + h[i]]
        left = [i for i in left if i not in set(group)]
        shelf, used = [], 0
        for i in group:
            used += w[i] + gap_x
            if used > max_width and shelf:
                out.append(shelf)
                shelf, used = [], w[i]
            shelf.append(i)
        out.append(shelf)
    return out


def layout(items: pd.DataFrame, gap: tuple[int, int], max_width: int) -> tuple[pd.DataFrame, tuple[int, int]]:
    """(places (y0, x0, y1, x1) in the order of items, page height and width)."""
    return arranged(items, shelves(items, gap[1], max_width), gap)


def arranged(items: pd.DataFrame, rows: list[list[int]], gap: tuple[int, int]) -> tuple[pd.DataFrame, tuple[int, int]]:
    """layout() of given shelves, which need not hold all items: the others' places are zeros."""
    place, top, widest = np.zeros((len(items), 4), int), BORDER, 0
    for shelf in rows:
        part = items.iloc[shelf]
        y0 = part["y"].min()
        x = BORDER + np.r_[0, np.cumsum(part["w"].to_numpy() + gap[1])]
        place[shelf, 0] = top + part["y"] - y0
        place[shelf, 1] = x[:-1]
        place[shelf, 2] = place[shelf, 0] + part["h"]
        place[shelf, 3] = x[:-1] + part["w"]
        widest = max(widest, x[-1] - gap[1] - BORDER)
        top += (part["y"] + part["h"]).max() - y0 + gap[0]
    return pd.DataFrame(place, columns=["y0", "x0", "y1", "x1"]), (top - gap[0] + BORDER, widest + 2 * BORDER)


def page(items: pd.DataFrame, places: pd.DataFrame, shape: tuple[int, int]) -> np.ndarray:
    out = np.full(shape, 255, np.uint8)
    for pixels, h, w, (y0, x0, y1, x1) in zip(items["pixels"], items["h"], items["w"], places.itertuples(index=False)):
        out[y0:y1, x0:x1] = np.frombuffer(pixels, np.uint8).reshape(h, w)
    return out


ORDER = ["page_num", "block_num", "par_num", "line_num", "word_num"]


def inside(y: np.ndarray, x: np.ndarray, places: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(place, point) for the points (y, x) in the places (y0, x0, y1, x1), edges included; by place, then in the points' order.

    Points are sorted by y once; of each place only those between its top and bottom are looked at.
    """
    order = np.argsort(y, kind="stable")
    rows = y[order]
    first, last = np.searchsorted(rows, places["y0"].to_numpy(), "left"), np.searchsorted(rows, places["y1"].to_numpy(), "right")
    found = []
    for k, (a, b, x0, x1) in enumerate(zip(first.tolist(), last.tolist(), places["x0"].tolist(), places["x1"].tolist())):
        at = order[a:b]
        at = np.sort(at[(x[at] >= x0) & (x[at] <= x1)])
        found.append((np.full(len(at), k), at))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))


def accept(words: pd.DataFrame, places: pd.DataFrame, confidence: int) -> list[str | None]:
    """The text of each place (y0, x0, y1, x1), or None to try again: a word below the confidence must occur on the page with enough of it."""
    places = places.set_axis(["y0", "x0", "y1", "x1"], axis=1)
    words = words.assign(conf=words["conf"].astype(float).astype(int)).sort_values(ORDER, kind="stable")
    known = set(words.loc[(words["conf"] >= confidence) & (words["text"] != ""), "text"])
    words = words[words["level"] == WORD_LEVEL]
    at, of = inside((words["top"] + words["height"] // 2).to_numpy(), (words["left"] + words["width"] // 2).to_numpy(), places)
    hit = words.iloc[of]
    unsure = ((hit["conf"] < confidence) & ~hit["text"].isin(known)).to_numpy()
    again = set(at[unsure].tolist())
    lines: list[list[list[str]]] = [[] for _ in range(len(places))]
    last = [None] * len(places)
    for k, line, text in zip(at.tolist(), zip(*(hit[c].tolist() for c in ORDER[:4])), hit["text"].tolist()):
        if last[k] != line:
            lines[k].append([])
            last[k] = line
        lines[k][-1].append(text)
    return [None if k in again else "\n".join(" ".join(x) for x in own).strip() for k, own in enumerate(lines)]


#: What Python takes for white space.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


#: Pages of at most so many words are judged by one task each; a larger one's places are dealt over all tasks.
PAGE_WORDS = 1 << 17
#: Words to a task, about, where there are more than the session's shuffle partitions hold so.
TASK_WORDS = 1 << 20


def accepted(words: DataFrame, places: DataFrame, page: str, confidence: int | str, vocabulary: str | None = None) -> DataFrame:
    """(page, place, text) of places (page, place, y0, x0, y1, x1) on pages of words (page, and the recogniser's columns); null text: not accepted.

    accept() for any number of pages of any size, without Python: words meet places by grid cells, and unsure words the page's sure ones. Equal places in the reading
    order are ordered by text. confidence: a number, or the words' column that has it. vocabulary: the words' column that tells which pages vouch for one another, if not each for itself.
    Pages that vouch for themselves alone are shuffled once, whole, but for those of over PAGE_WORDS words, whose names the driver gets.
    """
    half = lambda at, size: F.col(at) + F.floor(F.col(size) / 2)
    sure = F.col("conf").cast("double").cast("int") >= (F.col(confidence) if isinstance(confidence, str) else confidence)
    w = words.select(F.col(page).alias("page"), F.col(vocabulary or page).alias("owner"), half("top", "height").alias("y"), half("left", "width").alias("x"), F.struct(*ORDER[:4]).alias("line"), F.col("word_num").alias("nr"), F.coalesce("text", F.lit("")).alias("text"), sure.alias("sure"), (F.col("level") == WORD_LEVEL).alias("word"))
    p = places.select(F.col(page).alias("page"), "place", "y0", "x0", "y1", "x1")
    if vocabulary:
        told = _by_cell(w, p)
    else:
        sizes = words.groupBy(F.col(page).alias("page")).agg(F.count("*").alias("n"))
        total, crowded = sizes.where("page IS NOT NULL").agg(F.sum("n"), F.collect_list(F.when(F.col("n") > PAGE_WORDS, F.col("page")))).first()
        large = F.coalesce(F.col("page").isin(crowded), F.lit(False))
        told = _by_page(w.where(~large), p.where(~large), -(-(total or 0) // TASK_WORDS))
        if crowded:
            told = told.unionByName(_by_cell(w.where(large), p.where(large)))
    return told.select(F.col("page").alias(page), F.col("place").cast("long").alias("place"), F.when(~F.col("again"), F.btrim("text", F.lit(BLANKS))).alias("text"))


def _by_page(w: DataFrame, p: DataFrame, tasks: int) -> DataFrame:
    """(page, place, text, again) of accepted(): words and places are shuffled by page alone, to so many tasks at least, and every later step keeps that partitioning. again: a word isn't vouched for."""
    at = F.struct("place", "y0", "x0", "y1", "x1")
    both = w.where("page IS NOT NULL").drop("owner").unionByName(p.select("page", at.alias("at")), allowMissingColumns=True)
    both = both.repartition(tasks, "page") if tasks > int(w.sparkSession.conf.get("spark.sql.shuffle.partitions")) else both.repartition("page")
    known = F.max(F.col("sure") & (F.col("text") != "")).over(Window.partitionBy("page", "text"))
    d = both.withColumn("unsure", ~F.col("sure") & ~F.coalesce(known, F.lit(False))).where("word OR at IS NOT NULL").drop("word", "sure")
    hit = spatial.contained_by_page(d, "page", "at", spatial.grids(p)).select("page", "at.place", "line", "nr", "text", "unsure")
    own = F.when(F.col("text").isNotNull(), F.struct("line", "nr", "text"))
    whole = hit.groupBy("page", "place").agg(F.sort_array(F.collect_list(own)).alias("own"), F.coalesce(F.max("unsure"), F.lit(False)).alias("again"))
    before = lambda r, k: F.when(k == 0, "").when(r["line"] == F.get("own", k - 1)["line"], " ").otherwise("\n")
    return whole.select("page", "place", F.array_join(F.transform("own", lambda r, k: F.concat(before(r, k), r["text"])), "").alias("text"), "again")


def _by_cell(w: DataFrame, p: DataFrame) -> DataFrame:
    """_by_page() with words shuffled by grid cell, line, place and text, for pages of any size and vocabularies of several pages."""
    hit = spatial.contained(w.where("word").drop("word"), p, "page")
    joined = lambda rows, key, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*rows))), lambda r: r[key]), by)
    lines = hit.groupBy("page", "place", "owner", "line").agg(joined(["nr", "text"], "text", " ").alias("text"), F.collect_set(F.when(~F.col("sure"), F.col("text"))).alias("unsure"))
    whole = lines.groupBy("page", "place", "owner").agg(joined(["line", "text"], "text", "\n").alias("text"), F.flatten(F.collect_list("unsure")).alias("unsure"))
    known = w.where(F.col("sure") & (F.col("text") != "")).select("owner", "text").distinct()
    again = whole.select("page", "place", "owner", F.explode("unsure").alias("text")).join(known, ["owner", "text"], "left_anti").select("page", "place").distinct()
    told = p.select("page", "place").join(whole.select("page", "place", "text"), ["page", "place"], "left").join(again.withColumn("again", F.lit(True)), ["page", "place"], "left")
    return told.select("page", "place", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("again", F.lit(False)).alias("again"))


def cascade(items: pd.DataFrame, recognise: Callable, options: OcrOptions, name: str = "track") -> pd.DataFrame:
    """items (item_id, y, x, h, w, pixels) with text (null: never accepted) and the number of the pass that accepted it."""
    out = items.drop(columns="pixels").assign(text=None, passed=0)
    if items.empty:
        return out
    gap, confidence, width = gaps(items["h"]), options.start_confidence, options.page_width
    left = np.arange(len(items))
    # Every pass either leaves at most STAGNANT of its items, or lowers the confidence; at 0 a pass accepts all.
    final, k = False, 0
    while True:
        k += 1
        now = items.iloc[left]
        places, shape = layout(now, gap, width)
        sheet = page(now, places, shape)
        words = recognise(sheet, options)
        if options.keep:
            kept(options, name, f"{k}-{len(now)}-{options.psm}-{options.oem}-{confidence}", sheet, words)
        texts = accept(words, places, confidence)
        done = np.array([t is not None for t in texts])
        out.iloc[left[done], out.columns.get_loc("text")] = [t for t in texts if t is not None]
        out.iloc[left[done], out.columns.get_loc("passed")] = k
        before, left = len(left), left[~done]
        if not len(left) or final:
            break
        total = int((items["w"].iloc[left] + gap[1]).sum())
        if len(left) < FINAL_BELOW:
            width, confidence, final = min(total, options.page_width), 0, True
        elif len(left) > STAGNANT * before:
            width, confidence = min(total, options.page_width) // 2, max(0, confidence - STEP)
    return out


def png(sheet: np.ndarray) -> bytes:
    """A page as a grey PNG file."""
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.zeros((sheet.shape[0], sheet.shape[1] + 1), np.uint8)
    rows[:, 1:] = sheet
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", sheet.shape[1], sheet.shape[0], 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes(), 1)) + part(b"IEND", b"")


def kept(options: OcrOptions, name: str, what: str, sheet: np.ndarray, words: pd.DataFrame) -> None:
    """Write a pass's page and words to the folder options.keep."""
    at = os.path.join(local(options.keep), re.sub(r"[^\w.-]+", "_", local(name)).strip("_"))
    os.makedirs(at, exist_ok=True)
    with open(os.path.join(at, f"{what}.png"), "wb") as f:
        f.write(png(sheet))
    words.to_json(os.path.join(at, f"{what}.json"), orient="records")


SUBTITLES = "track_id string, item_id long, start_ms long, end_ms long, text string, passed int, error string, language string"


def recognised(items: DataFrame, recognise: Callable, options: OcrOptions = OcrOptions()) -> DataFrame:
    """SUBTITLES of pgs.items(); a track's failure is its rows' error. A column language, if there is one, is told to the recogniser.

    Words of a track vouch for one another. Images travel coded, and are decoded where a page is made. The items are kept in a table, and tracks larger than
    options.page_items go through by_pages().
    """
    if "language" not in items.columns:
        items = items.withColumn("language", F.lit(None).cast("string"))
    tables = Kept(items.sparkSession)
    kept_items = tables.keep(items)
    large = kept_items.groupBy("track_id").agg(F.count("*").alias("n")).where(F.col("n") > options.page_items).select("track_id")
    if large.isEmpty():
        return by_track(kept_items, recognise, options)
    return by_track(kept_items.join(large, "track_id", "left_anti"), recognise, options).unionByName(by_pages(kept_items.join(large, "track_id", "left_semi"), recognise, options, tables))


def by_track(items: DataFrame, recognise: Callable, options: OcrOptions) -> DataFrame:
    """recognised(), a track by one task."""

    def track(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item_id").reset_index(drop=True)
        read = [pgs.bitmap(*x) for x in pdf[["image_data", "palette", "error"]].itertuples(index=False)]
        pdf["error"] = pd.Series([e for _, e in read], dtype=object)
        whole = [k for k, (m, _) in enumerate(read) if m is not None and m.shape[0]]
        good = pd.DataFrame({"item_id": pdf["item_id"].iloc[whole].tolist(), "y": pdf["y_offset"].iloc[whole].tolist(), "x": pdf["x_offset"].iloc[whole].tolist(), "h": [read[k][0].shape[0] for k in whole], "w": [read[k][0].shape[1] for k in whole], "pixels": [read[k][0].tobytes() for k in whole]})
        out = pdf[["track_id", "item_id", "start_ms", "end_ms"]].assign(text=None, passed=0, error=pdf["error"], language=pdf["language"])
        told = replace(options, language=pdf["language"].iloc[0])
        try:
            found = cascade(good, recognise, told, pdf["track_id"].iloc[0]).set_index("item_id")
            out["text"] = out["item_id"].map(found["text"])
            out["passed"] = out["item_id"].map(found["passed"]).fillna(0).astype(int)
        except Exception as e:  # one track's failure must not end the others' job; it is reported in its rows
            out["error"] = f"{type(e).__name__}: {e}"
        # Strings as plain objects: columns of several pieces don't go back to Arrow.
        return out.astype(dict.fromkeys(("track_id", "text", "error", "language"), object))

    return items.groupBy("track_id").applyInPandas(track, SUBTITLES)


WORDS = "track_id string, page string, confidence int, error string, " + ", ".join(f"{c} long" for c in ("level", *ORDER, "left", "top", "width", "height")) + ", conf double, text string"


def by_pages(items: DataFrame, recognise: Callable, options: OcrOptions, tables: Kept) -> DataFrame:
    """recognised(), all tracks at once, a pass after another: pages of options.page_items items each are made and recognised by all tasks.

    A pass lays out what a track has left, as cascade() does; its shelves are dealt over pages in order, and all pages of a track's pass share its vocabulary. Accepted items
    leave, the others' table is the next pass's input. Layouts look at sizes alone; images are joined to their page.
    """
    spark, n = items.sparkSession, 4 * items.sparkSession.sparkContext.defaultParallelism
    base = tables.keep(pgs.decode_once(items, pixels=False))
    sizes = base.where("error IS NULL AND height > 0").select("track_id", "item_id", F.col("y_offset").cast("long").alias("y"), F.col("x_offset").cast("long").alias("x"), F.col("height").cast("long").alias("h"), F.col("width").cast("long").alias("w"))
    half = lambda c, k: F.floor(c / k).cast("long")
    gap = sizes.groupBy("track_id").agg(half(half(F.max("h"), 2), 2).alias("m")).select("track_id", (F.col("m") + 30).alias("gap_y"), (F.col("m") + 100).alias("gap_x"))
    start = {"confidence": F.lit(options.start_confidence), "wide": F.lit(options.page_width).cast("long"), "final": F.lit(False)}
    todo = tables.keep(sizes.join(gap, "track_id").withColumns(start))
    spread = "page string, place long, y0 long, x0 long, y1 long, x1 long, page_h long, page_w long"
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in todo.schema)

    def placed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item_id").reset_index(drop=True)
        gaps_, out = (int(pdf["gap_y"].iloc[0]), int(pdf["gap_x"].iloc[0])), []
        sheets: list[list[list[int]]] = [[]]
        for shelf in shelves(pdf, gaps_[1], int(pdf["wide"].iloc[0])):
            if sheets[-1] and sum(map(len, sheets[-1])) + len(shelf) > options.page_items:
                sheets.append([])
            sheets[-1].append(shelf)
        for number, rows in enumerate(sheets):
            at = [i for shelf in rows for i in shelf]
            places, (h, w) = arranged(pdf, rows, gaps_)
            out.append(pd.concat([pdf.iloc[at], places.iloc[at]], axis=1).assign(page=f"{pdf['track_id'].iloc[0]}#{number}", place=pdf["item_id"].iloc[at], page_h=h, page_w=w))
        return pd.concat(out)

    def words_of(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item_id").reset_index(drop=True)
        confidence, many = int(pdf["confidence"].iloc[0]), not (key[1].endswith("#0") and int(pdf["of_pass"].iloc[0]) == len(pdf))
        try:
            pdf["pixels"] = [pgs.bitmap(*x)[0].tobytes() for x in pdf[["image_data", "palette"]].itertuples(index=False)]
            sheet = page(pdf, pdf[["y0", "x0", "y1", "x1"]], (int(pdf["page_h"].iloc[0]), int(pdf["page_w"].iloc[0])))
            found = recognise(sheet, replace(options, language=pdf["language"].iloc[0]))
            if options.keep:
                kept(options, key[0], f"{int(pdf['pass'].iloc[0])}-{int(pdf['of_pass'].iloc[0])}-{options.psm}-{options.oem}-{confidence}" + f"-page{key[1].rpartition('#')[2]}" * many, sheet, found)
            out = found[["level", *ORDER, "left", "top", "width", "height"]].astype("int64").assign(conf=found["conf"].astype(float), text=found["text"].astype(object), error=None)
        except Exception as e:  # as in by_track
            out = pd.DataFrame([dict.fromkeys(("level", *ORDER, "left", "top", "width", "height")) | {"conf": None, "text": None, "error": f"{type(e).__name__}: {e}"}])
        out = out.assign(track_id=key[0], page=key[1], confidence=confidence)
        return out[[c.split()[0] for c in WORDS.split(", ")]].astype(dict.fromkeys(("track_id", "page", "text", "error"), object))

    done, failed, k = [], [], 0
    while not todo.isEmpty():
        k += 1
        laid = tables.keep(todo.repartition(n, "track_id").groupBy("track_id").applyInPandas(placed, f"{shape}, {spread}"))
        counted = laid.groupBy("track_id").agg(F.count("*").alias("of_pass"))
        pictures = laid.join(base.select("track_id", "item_id", "image_data", "palette", "language"), ["track_id", "item_id"]).join(counted, "track_id").withColumn("pass", F.lit(k))
        words = tables.keep(pictures.repartition(n, "track_id", "page").groupBy("track_id", "page").applyInPandas(words_of, WORDS))
        wrong = tables.keep(words.where("error IS NOT NULL").groupBy("track_id").agg(F.min("error").alias("failure")))
        failed.append(wrong)
        texts = accepted(words.where("error IS NULL"), laid, "page", "confidence", "track_id")
        judged = tables.keep(laid.join(texts, ["page", "place"]).join(wrong.select("track_id"), "track_id", "left_anti"))
        done.append(tables.keep(judged.where("text IS NOT NULL").select("track_id", "item_id", "text", F.lit(k).alias("passed"))))
        over = judged.groupBy("track_id").agg(F.count("*").alias("before"), F.count_if(F.col("text").isNull()).alias("left"), F.sum(F.when(F.col("text").isNull(), F.col("w") + F.col("gap_x"))).alias("total"))
        few, stuck = F.col("left") < FINAL_BELOW, F.col("left") > STAGNANT * F.col("before")
        fits = F.least("total", F.lit(options.page_width)).cast("long")
        follows = {"wide": F.when(few, fits).when(stuck, half(fits, 2)).otherwise(F.col("wide")), "confidence": F.when(few, 0).when(stuck, F.greatest(F.lit(0), F.col("confidence") - STEP)).otherwise(F.col("confidence")).cast("int"), "final": few}
        before, todo = todo, tables.keep(judged.where("text IS NULL AND NOT final").join(over, "track_id").withColumns(follows).select(*todo.columns))
        tables.drop(before, laid, words, judged)
    blank = spark.createDataFrame([], "track_id string, item_id long, text string, passed int")
    told = functools.reduce(DataFrame.unionByName, done, blank)
    failures = functools.reduce(DataFrame.unionByName, failed, spark.createDataFrame([], "track_id string, failure string"))
    d = base.join(told, ["track_id", "item_id"], "left").join(failures, "track_id", "left")
    fine = F.col("failure").isNull()
    return d.select("track_id", "item_id", "start_ms", "end_ms", F.when(fine, F.col("text")).alias("text"), F.when(fine, F.coalesce("passed", F.lit(0))).otherwise(0).alias("passed"), F.coalesce("failure", "error").alias("error"), "language")
