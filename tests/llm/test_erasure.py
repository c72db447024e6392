"""The cascading erasure against plain sorting and filtering in memory, file by file."""

import datetime
import glob
import hashlib
import math
import os
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from glyphstream.llm import erasure
from glyphstream.llm._common import Scratch

SCHEMAS = {
    "clients": "client_id long, master_id long, source string, balance double, file_no long, _key string",
    "clicks": "click_id long, ts timestamp_ntz, client_id long, kind string, value double",
    "sales": "sale_id long, client_id long, total double, _of long",
    "sale_lines": "sale_id long, line_no int, amount double, client_id string, own int, salt int",
}
KEY = {"clients": 0, "clicks": 2, "sales": 1}


def crc(key):
    return zlib.crc32(b"" if key is None else str(key).encode())


def plain(tables, files, one_in):
    """{(table, file_no): (rows left, rows erased)} of tables of tuples."""
    of = {r[0]: r[1] for r in tables["sales"] if r[0] is not None}
    key = {t: (lambda r, k=k: r[k]) for t, k in KEY.items()} | {"sale_lines": lambda r: of.get(r[0])}
    clicks, per = Counter(r[2] for r in tables["clicks"] if r[2] is not None), Counter()
    for client, master in {r[:2] for r in tables["clients"] if r[1] is not None}:
        per[master] += clicks.get(client, 0)
    bad = {m for m in per if crc(m) % one_in == 0} | ({min(per, key=lambda m: (-per[m], m))} if per else set())
    people = {r[0] for r in tables["clients"] if r[1] in bad and r[0] is not None}
    gone = {r[0] for r in tables["sales"] if r[1] in people and r[0] is not None}
    victim = {"clients": lambda r: r[1] in bad, "clicks": lambda r: r[2] in people, "sales": lambda r: r[1] in people, "sale_lines": lambda r: r[0] in gone}
    order = lambda v: (v is not None, 0 if v is None else v.encode() if isinstance(v, str) else (math.isnan(v), 0 if math.isnan(v) else v) if isinstance(v, float) else v)
    out = {}
    for t, rows in tables.items():
        rows = sorted(rows, key=lambda r: (crc(key[t](r)), *map(order, r)))
        size = 1 + len(rows) // files
        for f in range(-(-len(rows) // size)):
            part = rows[f * size : (f + 1) * size]
            left = [r for r in part if not victim[t](r)]
            if left:
                out[t, f] = left, len(part) - len(left)
    return out


@pytest.fixture(scope="module")
def rows():
    at = datetime.datetime(2024, 1, 1)
    clients = [(i, i // 2 if i % 5 else None, ("crm", None, "é")[i % 3], None if i % 7 == 0 else i * 1.115, i, "k") for i in range(60)] + [(None, 4, "crm", float("nan"), 1, None), (None, None, None, None, None, None)]
    clicks = [(k, at + datetime.timedelta(seconds=k % 90), (7 if k % 3 == 0 else k % 61 if k % 11 else None), None if k % 4 == 0 else "x", float("inf") if k == 50 else k / 8) for k in range(400)]
    clicks += clicks[:40] + [clicks[3]] * 30  # repeated rows
    sales = [(k, 7 if k % 3 == 0 else None if k % 10 == 1 else k % 70, k / 7, k) for k in range(150)] + [(None, 7, 1.0, 1), (None, 9, None, 2)]
    lines = [(6 if k % 3 == 0 else None if k % 20 == 1 else k % 160, k % 4, None if k % 9 == 0 else k * 2.675, "f", 1, None) for k in range(500)] + [(6, 0, 1.0, "f", 0, 2)] * 25
    return {"clients": clients, "clicks": clicks, "sales": sales, "sale_lines": lines}


def run(spark, rows, files, one_in):
    tables = {t: spark.createDataFrame(r, SCHEMAS[t]).repartition(3) for t, r in rows.items()}
    layout, erased = erasure.erase_people(tables, files, one_in)
    told = [r for t, c in erasure.SUMMED.items() for r in layout.digests(t, c, erased[t]).collect()]
    return layout, told


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b)


@pytest.mark.parametrize("files, one_in, hot", [(30, 5, 256), (7, 3, 4), (400, 2, 256)])
def test_files_are_the_plain_ones(spark, rows, monkeypatch, files, one_in, hot):
    monkeypatch.setattr(erasure.looked_up, "__defaults__", (hot,))
    layout, told = run(spark, rows, files, one_in)
    want = plain(rows, files, one_in)
    got = {(r.table_name, r.file_no): r for r in told}
    assert set(got) == set(want) and len(told) == len(got)
    for k, (left, gone) in want.items():
        r, names = got[k], [f.split()[0] for f in SCHEMAS[k[0]].split(", ")]
        summed = names.index(erasure.SUMMED[k[0]])
        assert (r.n_rows, r.n_erased, r.rewritten, r.columns) == (len(left), gone, gone > 0, ",".join(names))
        assert r.cents == sum(math.floor(100 * x[summed] + 0.5) if x[summed] is not None and math.isfinite(x[summed]) else 0 for x in left)
        assert r.ids_sha256 == hashlib.sha256(",".join("" if x[0] is None else str(x[0]) for x in left).encode()).hexdigest()
        file = pq.ParquetFile(r.path)
        assert file.schema_arrow.names == names and file.metadata.num_rows == len(left)
        held = [tuple(x.values()) for x in file.read().to_pylist()]
        assert all(same(a, b) for x, y in zip(held, left) for a, b in zip(x, y))
        ids = [x[0] for x in left if x[0] is not None]
        stats = [file.metadata.row_group(0).column(0).statistics]
        assert not ids or (stats[0].min, stats[0].max) == (min(ids), max(ids))
    there = glob.glob(layout.root.removeprefix("file:").replace("///", "/") + "/**/*.parquet", recursive=True)
    assert sorted(map(os.path.abspath, there)) == sorted(r.path for r in told)
    assert files == 400 or {r.table_name for r in told if r.rewritten} == set(rows)


def test_untouched_files_are_not_written_again(spark, rows, monkeypatch):
    """What the layout wrote stays, byte for byte, but for marked files; an erased file can be erased from again."""
    scratch, layout = Scratch(spark), erasure.Layout(spark)
    table = spark.createDataFrame(rows["clicks"], SCHEMAS["clicks"])
    layout.lay_out("clicks", table, table.columns, F.col("client_id"), 10, scratch)
    files = lambda: {p: open(p, "rb").read() for p in glob.glob(layout.at("clicks").removeprefix("file:").replace("///", "/") + "/*/*.parquet")}
    before = files()
    mark = layout.read("clicks").where("_file in (2, 4) and (_row % 2 = 0 or _file = 4)").select("_file", "_row")
    assert set(layout.erase("clicks", scratch.keep(mark), scratch)) == {2, 4}
    after = files()
    assert len(before) - len(after) == 1 and sum(after.get(p) == b for p, b in before.items()) == len(before) - 2
    n = layout.read("clicks").where("_file = 2").count()
    assert layout.erase("clicks", scratch.keep(layout.read("clicks").where("_file = 2 and _row = 0").select("_file", "_row")), scratch) == {2: 1}
    assert layout.read("clicks").where("_file = 2").count() == n - 1 and layout.erase("clicks", mark.limit(0), scratch) == {}


def test_empty_tables(spark, rows):
    _, told = run(spark, {t: [] for t in rows}, 30, 5)
    assert told == []
    some = {t: r if t in ("clients", "sale_lines") else [] for t, r in rows.items()}
    _, told = run(spark, some, 30, 10**9)  # nobody has clicks: the smallest master goes
    assert {(r.table_name, r.file_no): (r.n_rows, r.n_erased) for r in told} == {k: (len(a), b) for k, (a, b) in plain(some, 30, 10**9).items()}
    assert sum(r.n_erased for r in told) == sum(r[1] == 0 for r in rows["clients"])


def test_lookup_spreads_hot_keys(spark):
    """No partition of the joined rows holds a hot key's or the null key's rows together, and no row is lost."""
    left = spark.range(4000).selectExpr("CASE WHEN id % 3 = 0 THEN 5 WHEN id % 3 = 1 THEN NULL ELSE id END AS k", "id AS v")
    right = spark.range(3000).selectExpr("id AS k", "id * 2 AS w")
    out = erasure.looked_up(left, "k", right, Scratch(spark))
    assert out.count() == 4000
    assert {(r.k, r.w) for r in out.collect()} == {(k, None if k is None or k >= 3000 else 2 * k) for k in {5 if i % 3 == 0 else None if i % 3 == 1 else i for i in range(4000)}}
