"""Container track metadata: parsed, defaulted, guessed from names, and selected by type, language and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphstream.sources.files import ScanOptions, language

SCHEMA = "id int, type string, codec string, properties struct<language:string,language_ietf:string,track_name:string,default_track:boolean,enabled_track:boolean,forced_track:boolean>"
#: Words of a track's name that tell its kind.
NAMES = {"forced": r"(?i)\bforced\b", "closed_caption": r"(?i)\bcc\b|closed.caption", "hearing_impaired": r"(?i)\bsdh\b|hearing.impaired", "commentary": r"(?i)\bcommentary\b", "descriptive": r"(?i)\bdescriptive\b|\bdescription\b", "external": r"(?i)\bexternal\b"}
VERSION = r"(?i)\b(?:version|ver\.?|v) ?([0-9]+(?:\.[0-9]+)*)\b"
#: Names of languages in track names, in English and in the languages themselves.
SPOKEN = {
    "brazilian": "pt-BR", "latin american": "es-419", "castilian": "es-ES", "european spanish": "es-ES", "canadian french": "fr-CA", "simplified chinese": "zh-Hans", "traditional chinese": "zh-Hant",
    "arabic": "ar", "bulgarian": "bg", "catalan": "ca", "chinese": "zh", "croatian": "hr", "czech": "cs", "danish": "da", "dutch": "nl", "english": "en", "estonian": "et", "finnish": "fi", "french": "fr",
    "german": "de", "greek": "el", "hebrew": "he", "hindi": "hi", "hungarian": "hu", "icelandic": "is", "indonesian": "id", "italian": "it", "japanese": "ja", "korean": "ko", "latvian": "lv", "lithuanian": "lt",
    "malay": "ms", "norwegian": "no", "persian": "fa", "polish": "pl", "portuguese": "pt", "romanian": "ro", "russian": "ru", "serbian": "sr", "slovak": "sk", "slovenian": "sl", "spanish": "es", "swedish": "sv",
    "thai": "th", "turkish": "tr", "ukrainian": "uk", "vietnamese": "vi",
    "afrikaans": "af", "albanian": "sq", "armenian": "hy", "azerbaijani": "az", "basque": "eu", "belarusian": "be", "bengali": "bn", "bosnian": "bs", "burmese": "my", "cantonese": "yue", "farsi": "fa", "filipino": "fil",
    "flemish": "nl-BE", "galician": "gl", "georgian": "ka", "irish": "ga", "kannada": "kn", "kazakh": "kk", "khmer": "km", "lao": "lo", "latin": "la", "macedonian": "mk", "malayalam": "ml", "mandarin": "cmn", "marathi": "mr",
    "mongolian": "mn", "nepali": "ne", "punjabi": "pa", "sinhala": "si", "swahili": "sw", "tagalog": "tl", "tamil": "ta", "telugu": "te", "urdu": "ur", "uzbek": "uz", "welsh": "cy",
    "العربية": "ar", "български": "bg", "català": "ca", "中文": "zh", "简体中文": "zh-Hans", "繁體中文": "zh-Hant", "hrvatski": "hr", "čeština": "cs", "dansk": "da", "nederlands": "nl", "vlaams": "nl-BE", "eesti": "et", "suomi": "fi",
    "français": "fr", "deutsch": "de", "ελληνικά": "el", "עברית": "he", "हिन्दी": "hi", "magyar": "hu", "íslenska": "is", "bahasa indonesia": "id", "italiano": "it", "日本語": "ja", "한국어": "ko", "latviešu": "lv", "lietuvių": "lt",
    "bahasa melayu": "ms", "norsk": "no", "bokmål": "nb", "nynorsk": "nn", "فارسی": "fa", "polski": "pl", "português": "pt", "română": "ro", "русский": "ru", "српски": "sr", "srpski": "sr", "slovenčina": "sk", "slovenščina": "sl",
    "español": "es", "castellano": "es-ES", "svenska": "sv", "ไทย": "th", "türkçe": "tr", "українська": "uk", "tiếng việt": "vi",
}
#: Places and scripts in track names, what they add, and to which languages; those of PLACE_CODES stand in brackets.
PLACES = {
    "brazil": ("BR", "pt"), "brasil": ("BR", "pt"), "portugal": ("PT", "pt"), "european": ("PT", "pt"), "spain": ("ES", "es"), "españa": ("ES", "es"), "mexico": ("MX", "es"), "méxico": ("MX", "es"), "argentina": ("AR", "es"),
    "latin america": ("419", "es"), "latinoamérica": ("419", "es"), "latino": ("419", "es"), "france": ("FR", "fr"), "canada": ("CA", "en fr"), "canadian": ("CA", "en fr"), "canadien": ("CA", "fr"), "belgium": ("BE", "fr nl"),
    "switzerland": ("CH", "de fr it"), "swiss": ("CH", "de fr it"), "germany": ("DE", "de"), "austria": ("AT", "de"), "american": ("US", "en"), "united states": ("US", "en"), "british": ("GB", "en"), "united kingdom": ("GB", "en"),
    "australia": ("AU", "en"), "australian": ("AU", "en"), "simplified": ("Hans", "zh"), "traditional": ("Hant", "zh"), "hong kong": ("HK", "zh yue"), "taiwan": ("TW", "zh"), "cyrillic": ("Cyrl", "sr"),
}
PLACE_CODES = {"us": ("US", "en"), "uk": ("GB", "en"), "gb": ("GB", "en"), "ca": ("CA", "en fr"), "br": ("BR", "pt"), "pt": ("PT", "pt"), "es": ("ES", "es"), "mx": ("MX", "es"), "hk": ("HK", "zh yue"), "tw": ("TW", "zh")}


def _longest_first(words) -> str:
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


def told_language(name: Column, expected: Column) -> Column:
    """The language that a track's name says, in English or in itself, or else the expected one, which also stands where the name says the same without a region.

    Of several names of languages the first counts, the longest of those that begin there. A place or script that belongs to the language is added to it,
    whether the name says that language or it is expected only.
    """
    low = F.lower(name)
    longer = "|".join(p for p in PLACES if any(p.startswith(f"{w} ") for w in SPOKEN))  # "latin america" isn't Latin
    word = F.regexp_extract(low, rf"(?U)\b(?!(?:{longer})\b)({_longest_first(SPOKEN)})\b", 1)
    place = F.regexp_extract(low, rf"(?U)\b({_longest_first(PLACES)})\b", 1)
    code = F.regexp_extract(low, rf"[(\[]({'|'.join(PLACE_CODES)})[)\]]", 1)
    added = {f"{lang}/{k}": f"{lang}-{more}" for k, (more, langs) in (PLACES | PLACE_CODES).items() for lang in langs.split()}
    table = lambda d: F.str_to_map(F.lit(",".join(f"{k}={v}" for k, v in d.items())), F.lit(","), F.lit("="))  # noqa: E731  a constant
    both = F.struct(expected.alias("expected"), F.try_element_at(table(SPOKEN), word).alias("said"), F.when(place != "", place).otherwise(code).alias("place"))

    # Bound once: the parts are long expressions.
    def told(x):
        base = F.element_at(F.split(F.coalesce(x["said"], x["expected"]), "-"), 1)
        placed = F.when(~F.coalesce(F.contains(x["said"], F.lit("-")), F.lit(False)), F.try_element_at(table(added), F.concat(base, F.lit("/"), x["place"])))
        same = F.when(F.element_at(F.split(x["expected"], "-"), 1) == x["said"], x["expected"])
        return F.coalesce(placed, same, x["said"], x["expected"])

    return F.element_at(F.transform(F.array(both), told), 1)


def described(track: Column) -> Column:
    """Struct of a track (SCHEMA): the IETF code wins over the three-letter one, the name over both; flags are true or null; forced is told by the name alone."""
    p = track["properties"]
    said = lambda pattern: F.when(p["track_name"].rlike(pattern), True)
    expected = F.coalesce(language(p["language_ietf"], tag=True), language(p["language"]))
    return F.struct(
        track["id"].alias("id"),
        p["track_name"].alias("name"),
        track["type"].alias("type"),
        track["codec"].alias("codec"),
        told_language(p["track_name"], expected).alias("language"),
        F.when(F.coalesce(p["enabled_track"], F.lit(False)), F.lit(None)).otherwise(True).alias("disabled"),
        F.when(p["default_track"], True).alias("default"),
        *(said(v).alias(k) for k, v in NAMES.items()),
        F.nullif(F.regexp_extract(p["track_name"], VERSION, 1), F.lit("")).alias("version"),
    )


def parsed(files: DataFrame, json: str = "json") -> DataFrame:
    """files with one row a track of the container's JSON description: track (see described) and all_languages."""
    d = files.withColumn("_t", F.from_json(json, f"tracks array<struct<{', '.join(_fields())}>>")["tracks"])
    d = d.withColumn("_d", F.transform("_t", described))
    return d.withColumn("all_languages", F.array_distinct(F.filter(F.transform("_d", lambda t: t["language"]), lambda x: x.isNotNull()))).select("*", F.explode("_d").alias("track")).drop("_t", "_d")


def _fields() -> list[str]:
    return ["id:int", "type:string", "codec:string", SCHEMA[SCHEMA.index("properties") :].replace("properties ", "properties:")]


def sparse_json(track: Column) -> Column:
    """The track without its null fields."""
    return F.to_json(track)


def left_out(tracks: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """tracks that selected() doesn't look at, with the reason: the first that holds."""
    t = F.col("track")
    reason = F.when(~F.coalesce(t["type"] == "subtitles", F.lit(False)), "no subtitles").when(~F.coalesce(t["codec"] == "HDMV PGS", F.lit(False)), "not graphic").when(t["disabled"].isNotNull(), "disabled").when(t["language"].isNull(), "no known language")
    if options.languages:
        reason = reason.when(~t["language"].isin(*options.languages), "another language")
    return tracks.withColumn("reason", reason).where("reason IS NOT NULL")


def selected(tracks: DataFrame, file: str, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Enabled graphic subtitle tracks in a wanted and known language, numbered within (file, language) from 0; with one_per_lang the first only.

    Filters on existing output come before this: the first of a language is the first that is still to be ripped.
    """
    t = F.col("track")
    d = tracks.where((t["type"] == "subtitles") & (t["codec"] == "HDMV PGS") & t["disabled"].isNull() & t["language"].isNotNull())
    if options.languages:
        d = d.where(t["language"].isin(*options.languages))
    w = Window.partitionBy(file, "track.language").orderBy("track.id")
    d = d.withColumn("number", F.row_number().over(w) - 1)
    return d.where("number = 0") if options.one_per_lang else d
