"""Command line: scan paths, report what was found, rip it and report what was written."""

from __future__ import annotations

import argparse
import json
import logging
import re
from dataclasses import replace
from datetime import timedelta

from glyphstream import __version__
from glyphstream.functions.srt import DEFAULT_RULES, Rule, chosen, rule

AGE = re.compile(r"(?:(\d+)w)?(?:(\d+)d)?(?:(\d+)h)?")
log = logging.getLogger("glyphstream")


def age(text: str) -> timedelta | None:
    """Weeks, days and hours, as in 1w2d3h; None if they come to nothing."""
    m = AGE.fullmatch(text)
    if m is None:
        raise argparse.ArgumentTypeError(f"not an age: {text!r}")
    weeks, days, hours = (int(x or 0) for x in m.groups())
    return timedelta(weeks=weeks, days=days, hours=hours) or None


def language(text: str) -> str:
    """The canonical tag of a code."""
    from glyphstream.sources.files import CODE, tag

    known = tag(text) if re.fullmatch(CODE, text) else None
    if known is None:
        raise argparse.ArgumentTypeError(f"not a language: {text!r}")
    return known


def rules(path: str) -> list[Rule]:
    """Rules of a JSON file: pairs (pattern, replacement), or objects with pattern, replacement, tags and languages."""
    try:
        with open(path, encoding="utf-8") as f:
            return [rule(x) for x in json.load(f)]
    except (OSError, ValueError, TypeError, KeyError) as e:
        raise argparse.ArgumentTypeError(f"no rules in {path!r}: {e}") from e


def workers(text: str) -> int:
    if not text.isdigit() or not 1 <= int(text) <= 50:
        raise argparse.ArgumentTypeError(f"not a number from 1 to 50: {text!r}")
    return int(text)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glyphstream", description="Rip graphic subtitles to SubRip files.")
    p.add_argument("paths", nargs="+")
    p.add_argument("-l", "--language", type=language, action="append", default=[], help="only these languages")
    p.add_argument("-c", "-r", "--config", "--rules", dest="rules", type=rules, help="JSON file of cleaning rules")
    p.add_argument("-t", "--tag", action="append", default=[], help="only rules with one of these tags")
    p.add_argument("-e", "--encoding", default="utf-8")
    p.add_argument("-a", "--age", type=age, help="only files newer than this, as in 1w2d3h")
    p.add_argument("-A", "--srt-age", type=age, help="with --force: only over subtitle files older than this")
    p.add_argument("-f", "--force", action="store_true", help="overwrite subtitle files")
    p.add_argument("--all", action="store_true", help="all tracks of a language, not only its first")
    p.add_argument("-w", "--max-workers", type=workers, help="tasks that run at a time, where this command starts Spark itself")
    p.add_argument("--keep-temp-files", metavar="FOLDER", nargs="?", const="glyphstream-kept", help="keep each pass's page and words, and the display sets, in a folder")
    p.add_argument("--debug", action="store_true", help="log what is done")
    p.add_argument("-v", "--verbose", action="count", default=0, help="name paths that are left out (twice: also filtered ones)")
    p.add_argument("--version", action="version", version=f"%(prog)s {__version__}")
    return p


def counted(n: int, noun: str) -> str:
    return f"{n} {noun}" if n == 1 else f"{n} {noun}s"


def main(argv: list[str] | None = None, recogniser=None, spark=None) -> int:
    args = parser().parse_args(argv)
    if args.debug:
        logging.basicConfig(level=logging.DEBUG)
    own = chosen(DEFAULT_RULES if args.rules is None else args.rules, args.tag, args.language)
    if args.rules is not None and not own:
        print(f"no rules for {', '.join([*args.tag, *args.language]) or 'the default tag'}")
        return 0
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from glyphstream import api
    from glyphstream.functions.ocr import tesseract
    from glyphstream.operators.recognise import OcrOptions
    from glyphstream.operators.subtitles import write_files
    from glyphstream.sources import files, pgs

    if spark is None:
        builder = SparkSession.builder.appName("glyphstream")
        spark = (builder.master(f"local[{args.max_workers}]") if args.max_workers else builder).getOrCreate()
    options = files.ScanOptions(languages=frozenset(args.language), age=args.age, srt_age=args.srt_age, overwrite=args.force, one_per_lang=not args.all)
    log.debug("options %s", options)
    scanned = api.scan_path(spark, args.paths, options).persist()
    existing = files.made(spark, args.paths)
    found = files.report(scanned).first()
    chosen_tracks = api.tracks(scanned, options, existing).persist()
    said = f"{counted(chosen_tracks.count(), 'subtitle')} collected from {counted(found.collected, 'file')}"
    said += f" / {counted(found.filtered_out, 'file')} filtered out" if found.filtered_out else ""
    print(said + (f" / {counted(found.discarded, 'path')} ignored" if found.discarded else ""))
    bad = 0
    for row in api.unreadable(scanned).toLocalIterator():
        print(f"{row.path}: {row.error}")
        bad += 1
    for status, least in (("discarded", 1), ("filtered_out", 2)):
        if args.verbose >= least:
            for row in scanned.where((F.col("status") == status) & F.col("error").isNull()).select("path").toLocalIterator():
                print(f"{row.path}: {status.replace('_', ' ')}")
    ocr = replace(OcrOptions(), keep=args.keep_temp_files)
    docs = api.rip(spark, scanned, recogniser or tesseract, ocr, own, options, existing, args.tag)
    if args.keep_temp_files:
        pgs.sets_json(pgs.display_sets(pgs.segments(api.contents(spark, chosen_tracks)))).write.mode("overwrite").json(f"{args.keep_temp_files}/display_sets")
    written = write_files(docs, encoding=args.encoding, overwrite=args.force).persist()
    for row in written.where("error IS NOT NULL").toLocalIterator():
        print(f"{row.path}: {row.error}")
    done = written.agg(F.count_if("written").alias("ripped"), F.count("error").alias("failed")).first()
    print(f"{counted(done.ripped, 'subtitle')} ripped from {counted(found.collected, 'file')}, {done.failed} failed")
    for kept in (written, chosen_tracks, scanned):
        kept.unpersist()
    return 1 if done.failed or bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
