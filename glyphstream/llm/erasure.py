"""Cascading erasure rewrite: files of sorted tables, from which some people's rows are taken wherever they occur.

Laying out: each table is range-partitioned and sorted on its whole order, prefix sums over the partitions' counts give every row its place and
so its file, and rows go to exactly that file's task, sorted there, into a staging folder partitioned by file_no that is then renamed. Erasing: victims' keys cascade
from table to table, their rows are marked by file and row, the survivors of marked files replace those partitions by dynamic partition
overwrite, and partitions without survivors are deleted. Only Spark's own writer makes data files, so that footers tell of the rows within alone.

A key may hold any share of the rows: keys with over 1/HOT of a table's rows, HOT of them at most, are looked up by broadcast, rows without a
key are spread, all others are joined by shuffle; places are by the whole order, with the reading order as the last tie.

Defined results: null keys belong to nobody and sort as the empty string; equal rows keep one place each; an empty table has an empty folder and no files; a table
whose columns include file_no gets partitions of another name; files already rewritten keep their file_no and may be erased from again. Amounts that are null or not finite count 0.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from glyphstream.llm._common import Scratch, lean, parallelism, read_table, shared_dir

FILES = 350
HOT = 256
ONE_IN = 400
#: The tables, in the order of the cascade, and the column of each that is summed.
SUMMED = {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}


def decimal_crc(key: Column) -> Column:
    """CRC-32 of a whole number in decimal; null as the empty string."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def looked_up(left: DataFrame, key: str, right: DataFrame, scratch: Scratch, hot: int = HOT) -> DataFrame:
    """left with the columns of right (key unique, never null, beside others of new names), null where it has none; no key's rows meet in one task."""
    values = [c for c in right.columns if c != key]
    rows = left.select(F.struct("*").alias("row"), F.col(key).alias("k"), F.monotonically_increasing_id().alias("at"))  # left's names can't clash with these
    least = left.count() // hot + 1
    many = [r.k for r in rows.where(F.col("k").isNotNull()).groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") >= least).collect()]  # hot at most
    own = F.when(~F.col("k").isin(many), F.col("k")) if many else F.col("k")
    spread = rows.withColumn("own", own).withColumn("salt", F.when(F.col("own").isNull(), F.col("at") % 65_536).otherwise(0).cast("long"))
    # 0, but not as a constant: the optimiser would take a constant out of the keys, and with it what spreads the rows.
    seldom = right.select(F.col(key).alias("own"), F.pmod(F.hash(key), F.lit(1)).cast("long").alias("salt"), *(F.col(c).alias(f"s{n}") for n, c in enumerate(values)))
    out = spread.join(seldom, ["own", "salt"], "left")
    found = [F.col(f"s{n}") for n in range(len(values))]
    if many:
        often = scratch.keep(right.where(F.col(key).isin(many)).select(F.col(key).alias("k"), *(F.col(c).alias(f"h{n}") for n, c in enumerate(values))))
        out = out.join(F.broadcast(often), "k", "left")
        found = [F.coalesce(f"h{n}", f"s{n}") for n in range(len(values))]
    return out.select("row.*", *(f.alias(c) for f, c in zip(found, values)))


def _free(name: str, columns: list[str]) -> str:
    taken = {c.lower() for c in columns}
    while name in taken:
        name = f"_{name}"
    return name


class Layout:
    """Folders of laid-out tables below one root."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or f"{shared_dir(spark).rstrip('/')}/erasure-{uuid.uuid4().hex}"
        self.part: dict[str, str] = {}
        self.schema, self.files, self.size = {}, {}, {}

    def _fs(self, at: str):
        return Scratch._files(self.spark, at)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _written(self, rows: DataFrame, name: str, order: str, at: str, mode: str) -> None:
        """rows (the table's columns as _0, _1, ..., _file, order) as one file for each _file, in order, by Spark's writer."""
        n = min(self.files[name], parallelism(self.spark))
        dealt = rows.repartitionById(n, F.floor(F.col("_file") * n / self.files[name]).cast("int")).sortWithinPartitions("_file", order)
        columns = [F.col(f"_{k}").alias(f.name) for k, f in enumerate(self.schema[name])]
        dealt.select(*columns, F.col("_file").alias(self.part[name])).write.mode(mode).option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", 0).partitionBy(self.part[name]).parquet(at)

    def lay_out(self, name: str, table: DataFrame, columns: list[str], key: Column, files: int, scratch: Scratch) -> None:
        """Writes the columns of table, sorted by the CRC-32 of key, then by them all, as files of 1 + floor(rows / files) rows."""
        rows = table.select(decimal_crc(key).alias("_key"), *(F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(columns)), F.monotonically_increasing_id().alias("_tie"))
        self.schema[name] = table.select(*(F.col(f"`{c}`") for c in columns)).schema
        self.part[name] = _free("file_no", columns)
        order = [F.col(c).asc_nulls_first() for c in rows.columns]
        ranged = rows.repartitionByRange(parallelism(self.spark), *order).sortWithinPartitions(*order)
        kept = scratch.keep(ranged.drop("_key", "_tie").withColumn("_at", F.monotonically_increasing_id()))  # partition << 33 | row
        part = F.shiftright("_at", 33)
        base, before = [], 0
        for k, n in sorted(map(tuple, kept.groupBy(part).agg(F.count("*")).collect())):  # a row for each partition
            base.append((k, before))
            before += n
        self.size[name] = 1 + before // files
        self.files[name] = -(-before // self.size[name])
        if before:
            placed = kept.join(F.broadcast(self.spark.createDataFrame(base, "_part long, _base long")), part == F.col("_part")).withColumn("_place", F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1))
            staging = f"{self.root}/_staging/{name}"
            self._written(placed.withColumn("_file", F.floor(F.col("_place") / self.size[name]).cast("long")), name, "_place", staging, "errorifexists")
            path, fs = self._fs(staging)
            if not fs.rename(path, self._fs(self.at(name))[0]):
                raise OSError(f"{staging} can't be renamed")
            fs.delete(path.getParent(), True)
        else:
            path, fs = self._fs(self.at(name))
            fs.mkdirs(path)
        scratch.drop(kept)

    def read(self, name: str) -> DataFrame:
        """The table's columns as they are in its files, with _file and _row, the row's place within."""
        if not self.files[name]:
            return self.spark.createDataFrame([], self.schema[name]).withColumns({"_file": F.lit(0).cast("long"), "_row": F.lit(0).cast("long")})
        part = self.part[name]
        rows = self.spark.read.schema(StructType([*self.schema[name], StructField(part, LongType())])).parquet(self.at(name))
        return rows.select(*(F.col(f"`{c}`") for c in self.schema[name].names), F.col(part).alias("_file"), F.col("_metadata.row_index").alias("_row"))

    def erase(self, name: str, marks: DataFrame, scratch: Scratch) -> dict[int, int]:
        """Takes the marked rows (_file, _row) out of their files; returns how many left each file."""
        erased = {r._file: r.n for r in marks.groupBy("_file").agg(F.count("*").alias("n")).collect()}  # a row for each file
        if not erased:
            return {}
        rows = self.read(name).where(F.col("_file").isin(list(erased)))
        numbered = rows.select(*(F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(f.name for f in self.schema[name])), "_file", "_row")
        held = {r._file: r.n for r in rows.groupBy("_file").agg(F.count("*").alias("n")).collect()}
        left = numbered.join(marks, ["_file", "_row"], "left_anti")
        empty = [k for k, n in erased.items() if n == held[k]]
        if len(empty) < len(erased):
            self._written(left, name, "_row", self.at(name), "overwrite")
        for k in empty:
            path, fs = self._fs(f"{self.at(name)}/{self.part[name]}={k}")
            fs.delete(path, True)
        return erased

    def digests(self, name: str, summed: str, erased: dict[int, int]) -> DataFrame:
        """A row for each file: what it holds, digested in its order by one task, streaming."""
        told = "file_no long, n_rows long, n_erased long, cents long, rewritten boolean, table_name string, ids_sha256 string, columns string, path string"
        names = self.schema[name].names
        if not self.files[name]:
            return self.spark.createDataFrame([], told)
        rows = self.read(name)
        n = min(self.files[name], parallelism(self.spark))
        dealt = rows.select("_file", "_row", F.col(f"`{names[0]}`").cast("string").alias("_id"), F.col(f"`{summed}`").cast("double").alias("_x")).repartitionById(n, F.floor(F.col("_file") * n / self.files[name]).cast("int")).sortWithinPartitions("_file", "_row")

        def run(batches):
            file, count, cents, digest = None, 0, 0, None
            row = lambda: pa.RecordBatch.from_arrays([pa.array([file]), pa.array([count]), pa.array([cents]), pa.array([digest.hexdigest()])], names=["file", "n", "cents", "sha"])
            for b in batches:
                files, x = b.column(0).to_numpy(), b.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                x = np.floor(100 * x + 0.5)
                x = np.where(np.isfinite(x), x, 0)
                cut = np.flatnonzero(np.diff(files)) + 1
                for a, e in zip(np.r_[0, cut], np.r_[cut, len(files)]):
                    if e == a:
                        continue
                    if files[a] != file:
                        if digest is not None:
                            yield row()
                        file, count, cents, digest = int(files[a]), 0, 0, hashlib.sha256()
                    ids = ",".join(i or "" for i in b.column(1)[a:e].to_pylist())
                    digest.update((("," if count else "") + ids).encode())
                    count, cents = count + int(e - a), cents + sum(map(int, x[a:e]))
            if digest is not None:
                yield row()

        found = dealt.select("_file", "_id", "_x").mapInArrow(lean(run), "file long, n long, cents long, sha string")
        paths = self.spark.read.parquet(self.at(name)).select(F.col(self.part[name]).cast("long").alias("file"), F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("path")).distinct()
        gone = self.spark.createDataFrame(list(erased.items()), "file long, gone long")
        out = found.join(F.broadcast(paths), "file").join(F.broadcast(gone), "file", "left")  # a row for each file
        return out.select(F.col("file").alias("file_no"), F.col("n").alias("n_rows"), F.coalesce("gone", F.lit(0)).cast("long").alias("n_erased"), "cents", F.col("gone").isNotNull().alias("rewritten"), F.lit(name).alias("table_name"), F.col("sha").alias("ids_sha256"), F.lit(",".join(names)).alias("columns"), "path")


def victim_masters(clients: DataFrame, clicks: DataFrame, one_in: int = ONE_IN) -> Column:
    """The condition on clients' master_id: those whose CRC-32 one_in divides, and the one whose clients have most clicks."""
    counts = clicks.where(F.col("client_id").isNotNull()).groupBy("client_id").agg(F.count("*").alias("n"))
    own = clients.where(F.col("master_id").isNotNull()).select("master_id", "client_id").distinct()
    top = own.join(counts, "client_id", "left").groupBy("master_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n")).orderBy(F.desc("n"), F.asc("master_id")).limit(1).collect()
    master = F.col("master_id")
    return F.coalesce((decimal_crc(master) % one_in == 0) & master.isNotNull(), F.lit(False)) | F.coalesce(master.isin([r.master_id for r in top]), F.lit(False))


def erase_people(tables: dict[str, DataFrame], files: int = FILES, one_in: int = ONE_IN) -> tuple[Layout, dict[str, dict[int, int]]]:
    """Lays out clients, clicks, sales and sale_lines in a new folder and erases the victims; returns it with what left each file."""
    spark = tables["clients"].sparkSession
    scratch, layout = Scratch(spark), Layout(spark)
    columns = {name: t.columns for name, t in tables.items()}
    keyed = dict(tables)
    owner = _free("client_id", columns["sale_lines"])
    of_sale = tables["sales"].where(F.col("sale_id").isNotNull()).groupBy("sale_id").agg(F.min("client_id").alias(owner))
    keyed["sale_lines"] = looked_up(tables["sale_lines"], "sale_id", of_sale, scratch)
    for name, t in keyed.items():
        layout.lay_out(name, t, columns[name], F.col(owner if name == "sale_lines" else "client_id"), files, scratch)
    clients = layout.read("clients")
    bad = victim_masters(clients, layout.read("clicks"), one_in)
    mark = lambda rows: scratch.keep(rows.select("_file", "_row"))
    marks = {"clients": mark(clients.where(bad))}
    people = scratch.keep(clients.where(bad & F.col("client_id").isNotNull()).select("client_id").distinct().withColumn("gone", F.lit(True)))
    of = lambda name, key, keys, *more: looked_up(layout.read(name).select("_file", "_row", key, *more), key, keys, scratch).where("gone")
    marks["clicks"] = mark(of("clicks", "client_id", people))
    sales = scratch.keep(of("sales", "client_id", people, "sale_id"))
    marks["sales"] = mark(sales)
    gone_sales = scratch.keep(sales.where(F.col("sale_id").isNotNull()).select("sale_id").distinct().withColumn("gone", F.lit(True)))
    marks["sale_lines"] = mark(of("sale_lines", "sale_id", gone_sales))
    return layout, {name: layout.erase(name, m, scratch) for name, m in marks.items()}


def op11_erasure(spark, sf_dir: str) -> DataFrame:
    """One row for each file that is left."""
    layout, erased = erase_people({name: read_table(spark, sf_dir, name) for name in SUMMED})
    out = None
    for name, summed in SUMMED.items():
        d = layout.digests(name, summed, erased[name])
        out = d if out is None else out.unionByName(d)
    return out
