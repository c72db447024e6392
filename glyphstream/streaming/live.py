"""Timed items of streams that are still being written: byte ranges come in, each item goes out as soon as nothing later can change it."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from glyphstream.sources import pgs

CHUNKS = "track_id string, at long, content binary"
ITEMS = "track_id string, item_id long, start_ms long, end_ms long, x_offset long, y_offset long, image_data binary, palette binary, error string"
#: A track's Assembly.values() and the ranges that wait, pickled: fields by name would be converted twice on each way between Python and the JVM.
_STATE = "track binary"
MISSING = "bytes are missing"
LATE = "bytes after the track's end"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Item:
    """An item as far as its display sets are known."""

    item_id: int
    start_ms: int | None = None
    end_ms: int | None = None
    x: int | None = None
    y: int | None = None
    begun: bool = False
    image: bytes | None = None
    palette: bytes | None = None
    error: str | None = None

    def row(self) -> tuple:
        return self.item_id, self.start_ms, self.end_ms, self.x, self.y, self.image, self.palette, self.error


def _least(*values):
    return min((v for v in values if v is not None), default=None)


def _number(payload: bytes, a: int, b: int) -> int | None:
    return int.from_bytes(payload[a:b], "big") if len(payload) > a else None


@dataclass
class Assembly:
    """A track's state: the offset after the bytes read, those of a display set that isn't whole yet, the item that is open, and a closed one whose end the next start tells."""

    at: int = 0
    rest: bytes = b""
    stopped: bool = False
    ended: bool = False
    item: Item | None = None
    waiting: Item | None = None

    def read(self, content: bytes, last: bool = False, zero_is_null: bool = False) -> list[tuple]:
        """Rows that are final after content, the bytes at ``at``; last: there are no more."""
        self.at += len(content)
        done: list[tuple] = []
        if not self.stopped:
            data, own, used = self.rest + content, [], 0
            for at, kind, pts, _, size, payload, error in pgs.split(data):
                if error is None and at + pgs.HEADER + size > len(data) and not last:
                    break
                if error is not None:
                    self._error(error)
                    self.stopped = True
                    break
                own.append((kind, pts, payload))
                if kind == 0x80:
                    done += self._set(own, zero_is_null)
                    own, used = [], at + pgs.HEADER + size
            self.rest = data[used:]
            # A place where no segment begins ends the reading.
            over = sum(pgs.HEADER + len(p) for _, _, p in own)
            if self.stopped or (len(self.rest) >= over + pgs.HEADER and self.rest[over : over + 2] != b"PG"):
                self.stopped, self.rest = True, b""
        if last:
            done += self._close()
            self.rest, self.waiting, self.ended = b"", None, True
        return done

    def failed(self, error: str) -> list[tuple]:
        """The track ends here with an error."""
        self._error(error)
        return self.read(b"", last=True)

    def _error(self, error: str) -> None:
        self.item = self.item or Item(0)
        self.item.error = _least(self.item.error, error)

    def _set(self, own: list[tuple], zero_is_null: bool) -> list[tuple]:
        """A whole display set joins the open item, or closes it and opens the next."""
        states = [_number(p, 7, 8) for kind, _, p in own if kind == 0x16]
        begins, done = any(s in (0x80, 0x40) for s in states), []
        if self.item is None:
            self.item = Item(0)
        elif begins:
            n = self.item.item_id
            done = self._close()
            self.item = Item(n + 1)
        item = self.item
        ticks = next((pts for kind, pts, _ in own if kind == 0x16), None)
        if ticks is not None and (ticks or not zero_is_null):
            ms = ticks // 90
            item.start_ms = _least(item.start_ms, ms)
            item.end_ms = ms if item.end_ms is None else max(item.end_ms, ms)
        window = next((p for kind, _, p in own if kind == 0x17), b"")
        if _number(window, 0, 1):
            item.x, item.y = _least(item.x, _number(window, 2, 4)), _least(item.y, _number(window, 4, 6))
        if begins and not item.begun:
            item.begun = True
            item.image = b"".join(p[4:] if p[3:4] in (b"", b"\0", b"\x40") else p[11:] for kind, _, p in own if kind == 0x15)
            item.palette = next((p for kind, _, p in own if kind == 0x14), None)
        if any(s not in pgs.STATES for s in states):
            self._error("a composition of no known state")
        return done

    def _close(self) -> list[tuple]:
        """The open item is whole: it may tell the end of the one that waits, and goes out or waits itself."""
        item, self.item = self.item, None
        if item is None:
            return []
        if item.error is not None:
            return [item.row()]
        done, before, self.waiting = [], self.waiting, None
        if before and item.start_ms is not None and before.start_ms + pgs.REPAIR_MS >= item.start_ms:
            before.end_ms = max(before.start_ms + 1, item.start_ms - 1)
            done.append(before.row())
        if item.begun and None not in (item.start_ms, item.x, item.y):
            if item.end_ms > item.start_ms:
                done.append(item.row())
            else:
                self.waiting = item
        return done

    def values(self) -> tuple:
        none = (None,) * len(fields(Item))
        of = lambda x: tuple(asdict(x).values()) if x else none
        return self.at, self.rest, self.stopped, self.ended, *of(self.item), *of(self.waiting)

    @classmethod
    def of(cls, values: tuple) -> "Assembly":
        n = len(fields(Item))
        item = lambda v: Item(*v) if v[0] is not None else None
        return cls(*values[:4], item(values[4 : 4 + n]), item(values[4 + n :]))


class Assembler(StatefulProcessor):
    """Assembly of each track, and the ranges that wait for their turn: one value, read once and written once a batch, as each call for state goes to the JVM and back."""

    def __init__(self, idle_ms: int | None, zero_is_null: bool):
        self.idle_ms, self.zero_is_null = idle_ms, zero_is_null

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.track = handle.getValueState("track", _STATE)

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        track, waits = self._read()
        if track.ended:
            if any(r.content is not None and r.at + len(r.content) > track.at for r in rows):
                yield _row(key[0], (*[None] * 7, LATE))
            return
        early = sorted([(a, c is None, c) for a, c in waits] + [(r.at, r.content is None, None if r.content is None else bytes(r.content)) for r in rows], key=lambda x: x[:2])
        left, over = [], False
        for at, end, content in early:
            if at > track.at:
                left.append((at, content))
            elif end:
                over = True
                break
            elif at + len(content) > track.at:
                for row in track.read(content[track.at - at :], zero_is_null=self.zero_is_null):
                    yield _row(key[0], row)
        if over:
            left = []
            for row in track.read(b"", last=True, zero_is_null=self.zero_is_null):
                yield _row(key[0], row)
        self._save(track, left)
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if not track.ended:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        track, waits = self._read()
        if track.ended:
            return
        gap = any(c is not None for _, c in waits)
        for row in track.failed(MISSING) if gap else track.read(b"", last=True, zero_is_null=self.zero_is_null):
            yield _row(key[0], row)
        self._save(track, [])

    def _read(self) -> tuple[Assembly, list[tuple]]:
        own = self.track.get()
        if own is None:
            return Assembly(), []
        values, waits = pickle.loads(own[0])
        return Assembly.of(values), waits

    def _save(self, track: Assembly, left: list[tuple]) -> None:
        self.track.update((pickle.dumps((track.values(), left)),))

    def close(self) -> None:
        pass


_NAMES = [c.split()[0] for c in ITEMS.split(", ")]


def _row(track_id: str, values: tuple) -> Row:
    return Row(**dict(zip(_NAMES, (track_id, *values))))


def prepare(spark: SparkSession) -> None:
    """Queries with such state need RocksDB as the session's state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def items(chunks: DataFrame, idle_ms: int | None = None, zero_is_null: bool = False) -> DataFrame:
    """ITEMS of a stream of CHUNKS: content is the track's bytes from offset ``at`` on; null content says that the track ends at ``at``.

    The rows are those of pgs.items() over each track's whole bytes, however they are cut. An item goes out when the next one begins, or, where its end has
    to be repaired, when the next one is whole; the last ones at the track's end, or after ``idle_ms`` without a byte (by the clock; None: never), from when
    on the track counts as ended. With ``idle_ms`` a query goes on until it is stopped, also under the availableNow trigger, as a time may always be to come. Ranges may come in any order and more than once; those ahead of their turn wait. If some are still awaited when the
    track is given up, or if bytes come after its end, a row has that error. Rows without track_id or ``at`` aren't read. A task holds what a batch
    brings of a track; a track's state a display set that isn't whole, two items at most, and what waits; one that has ended keeps its offset.
    """
    prepare(chunks.sparkSession)
    own = chunks.select(F.col("track_id").cast("string"), F.col("at").cast("long"), F.col("content").cast("binary")).where("track_id IS NOT NULL AND at IS NOT NULL")
    return own.groupBy("track_id").transformWithState(Assembler(idle_ms, zero_is_null), ITEMS, "append", "None" if idle_ms is None else "ProcessingTime")
