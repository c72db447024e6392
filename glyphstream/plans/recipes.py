"""Registered queries: each runs the engine's own operators over rows made of the test tables, and has DuckDB SQL with the same result."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from glyphstream.functions import tracks as metadata
from glyphstream.operators import recognise, spatial, subtitles, timeline
from glyphstream.plans import streams
from glyphstream.sources import containers, files, filewriter, pgs
from glyphstream.sources.kept import shared_dir
from glyphstream.streaming import live

QUERIES, ORACLE_SQL = {}, {}
#: Words between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""WITH s AS (SELECT user_id, ts, event_id, event_type, COALESCE(SUM(CASE WHEN event_type='purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS ds FROM events)
SELECT user_id, CAST(ds AS BIGINT) AS ds_index, COUNT(*) AS n_segments, MIN(ts) AS first_ts FROM s GROUP BY user_id, ds HAVING SUM(CASE WHEN event_type='purchase' THEN 1 ELSE 0 END)=1""")
def displayset_assembly(spark, sf_dir):
    end = F.col("event_type") == "purchase"
    d = timeline.end_delimited(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], end)
    return d.groupBy("user_id", "ds_index").agg(F.count("*").alias("n_segments"), F.min("ts").alias("first_ts"), F.count_if(end).alias("ends")).where("ends = 1").drop("ends")


def _items(spark, sf_dir):
    d = timeline.start_delimited(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", "idx")
    return d.groupBy("user_id", "idx").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n"))


_ITEMS = """WITH f AS (SELECT user_id, ts, event_id, event_type, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
g AS (SELECT user_id, ts, SUM(CASE WHEN event_type='signup' AND rn>1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM f),
i AS (SELECT user_id, CAST(grp AS BIGINT) AS idx, MIN(ts) AS start_ts, MAX(ts) AS end_ts, COUNT(*) AS n FROM g GROUP BY user_id, grp)"""


@query(_ITEMS + " SELECT * FROM i")
def epoch_items(spark, sf_dir):
    return _items(spark, sf_dir)


@query(_ITEMS + """, l AS (SELECT *, LEAD(start_ts) OVER (PARTITION BY user_id ORDER BY idx) AS next_start FROM i)
SELECT user_id, idx, start_ts, CASE WHEN end_ts > start_ts THEN end_ts ELSE GREATEST(start_ts + INTERVAL '1' SECOND, next_start - INTERVAL '1' SECOND) END AS end_ts
FROM l WHERE end_ts > start_ts OR start_ts + INTERVAL '6' HOUR >= next_start""")
def auto_fix_end(spark, sf_dir):
    fixed = timeline.repair_ends(_items(spark, sf_dir), ["user_id"], "idx", "start_ts", "end_ts", F.expr("INTERVAL 6 HOURS"), F.expr("INTERVAL 1 SECOND"))
    return fixed.select("user_id", "idx", "start_ts", "end_ts")


#: Events as display sets of one stream for each user: the n-th at n seconds, a signup begins an epoch, odd events have an image, every fifth has no window.
_SETS = """WITH e AS (SELECT user_id, event_id, event_type, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
g AS (SELECT *, SUM(CASE WHEN event_type='signup' AND rn>1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS grp FROM e),
i AS (SELECT user_id, CAST(grp AS BIGINT) AS item_id, MIN(rn)*1000 AS start_ms, MAX(rn)*1000 AS end_ms, MIN(CASE WHEN event_id%5<>0 THEN event_id%1000 END) AS x, MIN(CASE WHEN event_id%5<>0 THEN event_id%700 END) AS y,
  MIN(CASE WHEN event_type='signup' THEN rn END) AS first_start FROM g GROUP BY user_id, grp),
p AS (SELECT i.*, LEAD(start_ms) OVER (PARTITION BY user_id ORDER BY item_id) AS next_ms FROM i),
v AS (SELECT p.*, CASE WHEN end_ms>start_ms THEN end_ms ELSE GREATEST(start_ms+1, next_ms-1) END AS fixed FROM p WHERE (end_ms>start_ms OR start_ms+10000>=next_ms) AND first_start IS NOT NULL AND x IS NOT NULL)"""


@query(_SETS + """ SELECT CAST(v.user_id AS VARCHAR) AS track_id, v.item_id, CAST(start_ms AS BIGINT) AS start_ms, CAST(fixed AS BIGINT) AS end_ms, CAST(x AS BIGINT) AS x_offset, CAST(y AS BIGINT) AS y_offset,
CAST(CASE WHEN e.event_id%2=1 THEN 3 ELSE 0 END AS BIGINT) AS height, CAST(CASE WHEN e.event_id%2=1 THEN 2+e.event_id%100 ELSE 1 END AS BIGINT) AS width, CAST(CASE WHEN e.event_id%2=1 THEN 2*(2+e.event_id%100) ELSE 0 END AS BIGINT) AS ink
FROM v JOIN e ON e.user_id=v.user_id AND e.rn=v.first_start""")
def stream_items(spark, sf_dir):
    """Streams made of the events, split, assembled into display sets and items, and decoded by the engine."""
    d = streams.decoded(_t(spark, sf_dir, "events"))
    return _shown(d)


def _shown(d):
    ink = F.length("pixels") - F.length(F.translate(F.hex("pixels"), "0", "")) / 2  # a pixel is 00 (ink) or FF
    return d.select("track_id", "item_id", *(F.col(c).cast("long").alias(c) for c in ("start_ms", "end_ms", "x_offset", "y_offset", "height", "width")), ink.cast("long").alias("ink"))


@query(ORACLE_SQL["stream_items"])
def live_items(spark, sf_dir):
    """The same streams in ranges that arrive in two batches and out of turn, assembled by state as they come; the files stay in a folder of this call."""
    at = f"{shared_dir(spark).rstrip('/')}/live-{uuid.uuid4().hex}"
    chunks = streams.ranges(streams.contents(_t(spark, sf_dir, "events")))
    files_in = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks.repartition(files_in, "at").write.parquet(f"{at}/in")
    arriving = spark.readStream.schema(live.CHUNKS).option("maxFilesPerTrigger", max(1, files_in // 2)).parquet(f"{at}/in")
    q = live.items(arriving).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return _shown(pgs.decode(spark.read.schema(live.ITEMS).parquet(f"{at}/out")))


@query("""SELECT CAST(user_id AS VARCHAR) AS track_id, COUNT(*) AS n_sets, SUM(CASE WHEN event_id%2=1 THEN 1 ELSE 0 END)::BIGINT AS n_images, MIN(event_id%1000)::BIGINT AS least_x, MAX(rn)*90000 AS last_pts
FROM (SELECT user_id, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) e GROUP BY user_id""")
def stream_segments(spark, sf_dir):
    """Fields of the segments that the engine splits those streams into."""
    from glyphstream.sources import pgs

    s = pgs.display_sets(pgs.segments(streams.contents(_t(spark, sf_dir, "events"))))
    return s.groupBy("track_id").agg(F.count_if(F.col("stype_name") == "END").alias("n_sets"), F.count("ods").alias("n_images"), F.min("wds.x_offset").cast("long").alias("least_x"), F.max("pts").alias("last_pts"))


@query("SELECT source, lang, doc_id FROM (SELECT source, lang, doc_id, ROW_NUMBER() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rn FROM documents WHERE lang IS NOT NULL) t WHERE rn = 1")
def one_per_lang(spark, sf_dir):
    """A source is a container, a document a subtitle track of it."""
    chosen = metadata.selected(streams.document_tracks(_t(spark, sf_dir, "documents")), "source")
    return chosen.select("source", F.col("track.language").alias("lang"), F.col("track.id").alias("doc_id"))


@query("SELECT source, lang, doc_id, ROW_NUMBER() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS number FROM documents WHERE lang IN ('de', 'es') AND doc_id % 3 <> 0")
def track_numbers(spark, sf_dir):
    """All enabled tracks of two languages, numbered; every third document is a disabled track."""
    options = files.ScanOptions(languages=frozenset({"de", "es"}), one_per_lang=False)
    chosen = metadata.selected(streams.document_tracks(_t(spark, sf_dir, "documents"), F.col("doc_id") % 3 == 0), "source", options)
    return chosen.select("source", F.col("track.language").alias("lang"), F.col("track.id").alias("doc_id"), F.col("number").cast("long").alias("number"))


@query("SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id WHERE l.doc_id IS NULL OR l.quality=0")
def skip_existing(spark, sf_dir):
    """A label is a subtitle file made before, a bad one long ago: with overwrite, files older than a day are made again."""
    now = datetime(2024, 1, 10)
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang", F.concat(F.lit("/m/"), F.col("doc_id").cast("string"), F.lit(".srt")).alias("srt_path"))
    made = _t(spark, sf_dir, "labels").select(F.concat(F.lit("/m/"), F.col("doc_id").cast("string"), F.lit(".srt")).alias("path"), F.when(F.col("quality") == 0, F.lit(datetime(2024, 1, 1))).otherwise(F.lit(now)).alias("modificationTime"))
    return files.not_ripped(d, made, files.ScanOptions(overwrite=True, srt_age=timedelta(days=1), now=now)).select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE lang IN ('en','de')")
def lang_semi(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return d.where(files.matches(files.ScanOptions(languages=frozenset({"en", "de"})), F.lit(None).cast("timestamp"), F.array("lang"))).select("doc_id")


@query("SELECT event_id, CAST('/in/' || event_type || CASE user_id % 3 WHEN 0 THEN '.en' WHEN 1 THEN '.pt-BR' ELSE '' END || '.srt' AS VARCHAR) AS srt_path, CASE user_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'pt-BR' END AS language FROM events")
def path_parts(spark, sf_dir):
    """Names of raw streams taken apart, and the names of their subtitle files."""
    n = F.pmod("user_id", F.lit(3))
    path = F.concat(F.lit("/in/"), F.col("event_type"), F.when(n == 0, ".eng").when(n == 1, ".pt_br").otherwise(""), F.lit(".SUP"))
    d = _t(spark, sf_dir, "events").select("event_id", files.path_parts(path).alias("p"))
    return d.select("event_id", files.render(F.col("p"), "srt").alias("srt_path"), F.col("p.language").alias("language"))


@query("""WITH c AS (SELECT user_id, ts, event_id, event_type, CASE WHEN event_type = LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS chg FROM events),
r AS (SELECT user_id, event_type, SUM(chg) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT user_id, CAST(run AS BIGINT) AS run_id, event_type, COUNT(*) AS run_len FROM r GROUP BY user_id, run, event_type""")
def run_length(spark, sf_dir):
    """Runs of a user's events, coded as a bitmap's runs and read back from the codes."""
    runs = timeline.runs(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return streams.coded_runs(runs)


@query("""WITH e AS (SELECT user_id, event_type, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
SELECT user_id, CAST(CEIL(COUNT(*)/7.0) AS BIGINT) AS height, CAST(LEAST(COUNT(*),7) AS BIGINT) AS width, CAST(SUM(CASE WHEN event_type IN ('click','purchase','view') THEN 1 ELSE 0 END) AS BIGINT) AS ink,
CAST(SUM(CASE WHEN event_type IN ('click','purchase','view') THEN rn-1 ELSE 0 END) AS BIGINT) AS places FROM e GROUP BY user_id""")
def bitmap_decode(spark, sf_dir):
    """A user's events as pixels, seven to a line, coded and decoded; ink is what its palette makes bright."""
    return streams.bitmaps(_t(spark, sf_dir, "events"))


@query("SELECT n.n_nationkey, COUNT(*) AS n_hits FROM lineitem l JOIN nation n ON l.l_quantity BETWEEN n.n_nationkey AND n.n_nationkey + 10 AND l.l_discount * 100 BETWEEN n.n_regionkey AND n.n_regionkey + 2 GROUP BY n.n_nationkey")
def rect_containment(spark, sf_dir):
    """Points in rectangles, on one page. Equal points are counted first."""
    points = _t(spark, sf_dir, "lineitem").groupBy("l_quantity", "l_discount").agg(F.count("*").alias("c"))
    points = points.select(F.lit(0).alias("page"), F.col("l_quantity").alias("y"), (F.col("l_discount") * 100).alias("x"), "c")
    n, r = F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double")
    places = _t(spark, sf_dir, "nation").select("n_nationkey", F.lit(0).alias("page"), n.alias("y0"), r.alias("x0"), (n + 10).alias("y1"), (r + 2).alias("x1"))
    return spatial.contained(points, places, "page").groupBy("n_nationkey").agg(F.sum("c").alias("n_hits"))


@query("SELECT conv_id, trim(string_agg(text, chr(10) ORDER BY turn), ' ' || chr(9) || chr(10) || chr(13)) AS body FROM conversations GROUP BY conv_id")
def line_assembly(spark, sf_dir):
    """A conversation is a page with one place, a turn a line of it."""
    words = streams.words(_t(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("line"), F.lit(0).alias("word"), F.col("turn").alias("top"), F.lit(0).alias("left"), F.lit(100).alias("conf"), "text"))
    places = words.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("place"), *(F.lit(v).cast("long").alias(c) for c, v in (("y0", 0), ("x0", 0), ("y1", 1 << 40), ("x1", 10))))
    return recognise.accepted(words, places, "conv_id", 65).select("conv_id", F.col("text").alias("body"))


@query(r"""WITH s AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents), w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws,1)-1 AS pos FROM s),
c AS (SELECT *, (doc_id*31+pos*7)%100 AS conf, pos//40 AS place, pos//8 AS line FROM w), v AS (SELECT DISTINCT doc_id, word FROM c WHERE conf>=20),
a AS (SELECT c.*, c.conf>=20 OR v.word IS NOT NULL AS ok FROM c LEFT JOIN v ON c.doc_id=v.doc_id AND c.word=v.word),
l AS (SELECT doc_id, place, line, string_agg(word, ' ' ORDER BY pos) AS t, bool_and(ok) AS ok FROM a GROUP BY ALL)
SELECT doc_id, CAST(place AS BIGINT) AS place, CASE WHEN bool_and(ok) THEN string_agg(t, chr(10) ORDER BY line) END AS text FROM l GROUP BY doc_id, place""")
def accept_vocab(spark, sf_dir):
    """A document is a page of eight words to a line and five lines to a place; a place is accepted if each word is sure, or surely elsewhere on the page."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"({WORD})"))).alias("pos", "text"))
    d = d.select("doc_id", F.floor(F.col("pos") / 8).alias("line"), F.col("pos").alias("word"), (F.floor(F.col("pos") / 8) * 20).alias("top"), (F.pmod("pos", F.lit(8)) * 10).alias("left"), F.pmod(F.col("doc_id") * 31 + F.col("pos") * 7, F.lit(100)).alias("conf"), "text")
    words = streams.words(d)
    last = words.groupBy("doc_id").agg(F.max(F.floor(F.col("top") / 100)).alias("n"))
    k = F.col("place")
    places = last.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), "n")).alias("place")).select("doc_id", "place", (k * 100).alias("y0"), F.lit(0).cast("long").alias("x0"), (k * 100 + 99).alias("y1"), F.lit(100).cast("long").alias("x1"))
    return recognise.accepted(words, places, "doc_id", 20)


@query("SELECT doc_id, CAST('0x'||substr(hex(encode(text)),1,8) AS BIGINT) AS be32 FROM documents")
def binary_be_int(spark, sf_dir):
    from glyphstream.functions.binary import be_uint

    return _t(spark, sf_dir, "documents").select("doc_id", be_uint(F.encode("text", "utf-8"), 0, 4).alias("be32"))


@query("SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda x: CASE WHEN x>0 THEN 0 ELSE 255 END)) AS BIGINT) AS s FROM embeddings")
def binarize(spark, sf_dir):
    """A vector is a palette: bright where it is positive."""
    return streams.ink_sums(_t(spark, sf_dir, "embeddings"))


@query("SELECT event_id, strftime(ts,'%H:%M:%S')||','||strftime(ts,'%g') AS t FROM events")
def srt_format(spark, sf_dir):
    from glyphstream.functions.srt import srt_time

    ms = F.expr("(hour(ts) * 3600 + minute(ts) * 60) * 1000L + cast(floor(extract(second from ts) * 1000) as bigint)")
    return _t(spark, sf_dir, "events").select("event_id", srt_time(ms).alias("t"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(CASE WHEN lang = 'en' THEN regexp_replace(text,'[%*#]{2,}','','g') ELSE text END,'\n+',' ','g'),' {2,}',' ','g')) AS t FROM documents")
def clean_rules(spark, sf_dir):
    """Rules of the default tag, one of them for English alone; a rule of another tag isn't used."""
    from glyphstream.functions.srt import Rule, apply_rules, chosen

    rules = [Rule(r"[%*#]{2,}", "", languages=frozenset({"en"})), Rule("e", "", tags=frozenset({"never"})), (r"\n+", " "), (r" {2,}", " ")]
    return _t(spark, sf_dir, "documents").select("doc_id", F.trim(apply_rules(F.col("text"), chosen(rules), F.col("lang"))).alias("t"))


@query("""SELECT event_id, '{"id":' || CAST(event_id AS VARCHAR) || CASE WHEN user_id % 4 = 0 THEN ',"name":"Forced SDH"' WHEN user_id % 4 = 1 THEN ',"name":"French v2"' ELSE '' END || ',"type":"subtitles","codec":"HDMV PGS","language":"' || CASE WHEN user_id % 4 = 1 THEN 'fr' ELSE 'pt-BR' END || '"'
|| CASE WHEN event_id % 2 = 0 THEN ',"disabled":true' ELSE '' END || CASE WHEN event_id % 3 = 0 THEN ',"default":true' ELSE '' END || CASE WHEN user_id % 4 = 0 THEN ',"forced":true,"hearing_impaired":true' WHEN user_id % 4 = 1 THEN ',"version":"2"' ELSE '' END || '}' AS track FROM events""")
def json_extract(spark, sf_dir):
    """Events as tracks of containers' JSON descriptions, parsed and written without nulls."""
    n = F.pmod("user_id", F.lit(4))
    props = F.struct(F.lit("por").alias("language"), F.lit("pt-BR").alias("language_ietf"), F.when(n == 0, "Forced SDH").when(n == 1, "French v2").alias("track_name"), (F.col("event_id") % 3 == 0).alias("default_track"), (F.col("event_id") % 2 == 1).alias("enabled_track"), F.lit(True).alias("forced_track"))
    told = F.to_json(F.struct(F.array(F.struct(F.col("event_id").alias("id"), F.lit("subtitles").alias("type"), F.lit("HDMV PGS").alias("codec"), props.alias("properties"))).alias("tracks")))
    d = metadata.parsed(_t(spark, sf_dir, "events").select("event_id", told.alias("json")))
    return d.select("event_id", metadata.sparse_json(F.col("track")).alias("track"))


@query("SELECT COUNT(*) FILTER (WHERE lang='en' AND n_chars > 100) AS collected, COUNT(*) FILTER (WHERE lang IS NULL OR lang<>'en' OR n_chars <= 100) AS filtered_out, 0::BIGINT AS discarded FROM documents")
def scan_report(spark, sf_dir):
    """Documents as files of one language; short ones are old."""
    now = datetime(2024, 1, 10)
    options = files.ScanOptions(languages=frozenset({"en"}), age=timedelta(days=1), now=now)
    made = F.when(F.col("n_chars") > 100, F.lit(now)).otherwise(F.lit(datetime(2024, 1, 1)))
    status = F.when(files.matches(options, made, F.array("lang")), "collected").otherwise("filtered_out")
    return files.report(_t(spark, sf_dir, "documents").select(status.alias("status")))


_SUBS = """WITH k AS (SELECT user_id, event_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS s, replace(event_type, 'error', '') AS text FROM events),
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY s, event_id) AS idx FROM k WHERE text <> '')"""


def _recognised(spark, sf_dir):
    d = _t(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return d.select(F.col("user_id").cast("string").alias("track_id"), F.col("event_id").alias("item_id"), ms.alias("start_ms"), (ms + 500).alias("end_ms"), F.col("event_type").alias("text"), F.lit(None).cast("string").alias("error"))


@query(_SUBS + " SELECT CAST(user_id AS VARCHAR) AS track_id, CAST(idx AS BIGINT) AS idx, s AS start_ms, text FROM n")
def renumber(spark, sf_dir):
    """Events as recognised items; a rule empties some, the others are numbered."""
    subs = subtitles.subtitles(_recognised(spark, sf_dir), [("error", "")])
    return subs.select("track_id", F.col("idx").cast("long").alias("idx"), "start_ms", "text")


@query(_SUBS + r""", t AS (SELECT *, lpad(CAST(CAST(floor(s/3600000) AS BIGINT) AS VARCHAR), CAST(greatest(2, length(CAST(CAST(floor(s/3600000) AS BIGINT) AS VARCHAR))) AS INTEGER), '0') || ':' || strftime(make_timestamp(s*1000), '%M:%S,%g') AS a,
 lpad(CAST(CAST(floor((s+500)/3600000) AS BIGINT) AS VARCHAR), CAST(greatest(2, length(CAST(CAST(floor((s+500)/3600000) AS BIGINT) AS VARCHAR))) AS INTEGER), '0') || ':' || strftime(make_timestamp((s+500)*1000), '%M:%S,%g') AS b FROM n),
e AS (SELECT user_id, string_agg(idx || chr(10) || a || ' --> ' || b || chr(10) || text || chr(10), chr(10) ORDER BY idx) AS srt FROM t GROUP BY user_id)
SELECT CAST(u.user_id AS VARCHAR) AS track_id, coalesce(srt, '') AS srt FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN e ON e.user_id = u.user_id""")
def srt_documents(spark, sf_dir):
    """Whole subtitle files of the same items."""
    return subtitles.texts(_recognised(spark, sf_dir), [("error", "")]).select("track_id", "srt")


@query("""WITH RECURSIVE o AS (SELECT source, doc_id//500 AS part, doc_id, n_chars, ROW_NUMBER() OVER (PARTITION BY source, doc_id//500 ORDER BY doc_id) AS rn FROM documents),
p AS (SELECT source, part, doc_id, rn, n_chars, n_chars+115 AS w, 0::BIGINT AS shelf, 100::BIGINT AS x FROM o WHERE rn=1
UNION ALL SELECT o.source, o.part, o.doc_id, o.rn, o.n_chars, CASE WHEN p.w+o.n_chars+115>20000 THEN o.n_chars ELSE p.w+o.n_chars+115 END, CASE WHEN p.w+o.n_chars+115>20000 THEN p.shelf+1 ELSE p.shelf END, CASE WHEN p.w+o.n_chars+115>20000 THEN 100 ELSE p.x+p.n_chars+115 END
FROM p JOIN o ON o.source=p.source AND o.part=p.part AND o.rn=p.rn+1)
SELECT source, doc_id, shelf, x AS x0, 100+shelf*46 AS y0 FROM p""")
def shelf_pack(spark, sf_dir):
    """Documents as images one pixel high, 500 ids of a source to a track; their shelves and places on the page."""
    return streams.placed(_t(spark, sf_dir, "documents"))


@query("""WITH t AS (SELECT conv_id, turn // 64 AS part, turn, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(part AS BIGINT) AS part, 'fr' AS language, CAST(sum(greatest(1, (n + 65534) // 65535)) AS BIGINT) AS n_segments, CAST(sum(n) AS BIGINT) AS n_bytes, CAST(max(turn) * 90000 AS BIGINT) AS last_pts FROM t GROUP BY ALL""")
def container_tracks(spark, sf_dir):
    """Containers made of the conversations, written as files, and one language's track read back by the data source, which isn't sent the other one."""
    folder = f"{shared_dir(spark).rstrip('/')}/containers-{uuid.uuid4().hex}"
    filewriter.save(streams.conversation_containers(_t(spark, sf_dir, "conversations"), folder))
    containers.register(spark)
    read = spark.read.format("matroska").option("parts", 4 * spark.sparkContext.defaultParallelism).load(folder).where("type = 'subtitles' AND language = 'fr'")
    content = read.select("path", "id", "start", "content", "error")
    named = lambda c, k: F.regexp_extract(c, r"/(\d+)-(\d+)\.mkv$", k).cast("long")
    segs = pgs.segments(containers.joined(content).select(F.col("path").alias("track_id"), "content", "error"))
    return segs.groupBy(named(F.col("track_id"), 1).alias("conv_id"), named(F.col("track_id"), 2).alias("part")).agg(F.first(F.lit("fr")).alias("language"), F.count("*").alias("n_segments"), F.sum("size").alias("n_bytes"), F.max("pts").alias("last_pts"))
