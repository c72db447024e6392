"""Languages that track names say."""

from pyspark.sql import functions as F

from glyphstream.functions.tracks import PLACES, SPOKEN, told_language

CASES = [
    ("English", None, "en"), ("ENGLISH SDH", "de", "en"), ("Deutsch", "en", "de"), ("Deutsch (Forced)", None, "de"), ("Français", "en", "fr"), ("Français (Canadien)", None, "fr-CA"), ("French (Canada)", "fr", "fr-CA"),
    ("Canadian French", "fr-FR", "fr-CA"), ("English (Canada)", None, "en-CA"), ("English (US)", None, "en-US"), ("English [UK]", "en", "en-GB"), ("British English", None, "en-GB"), ("Português", None, "pt"), ("Português (Brasil)", "pt", "pt-BR"),
    ("Portuguese (Brazil)", "pt-PT", "pt-BR"), ("Brazilian Portuguese", "pt", "pt-BR"), ("Portuguese (Portugal)", "pt", "pt-PT"), ("Portuguese", "pt-BR", "pt-BR"), ("Brazil", "pt", "pt-BR"), ("Brazil", "en", "en"), ("Español", None, "es"), ("Español (Latinoamérica)", "es", "es-419"),
    ("Spanish (Latin America)", "es", "es-419"), ("Latin American Spanish", "es", "es-419"), ("Latino", "es", "es-419"), ("Latin", None, "la"), ("Castellano", "es", "es-ES"), ("European Spanish", None, "es-ES"), ("European Portuguese", None, "pt-PT"), ("Spanish (MX)", None, "es-MX"), ("Chinese", None, "zh"),
    ("Chinese (Simplified)", "zh", "zh-Hans"), ("Simplified Chinese", None, "zh-Hans"), ("Traditional Chinese", "zh", "zh-Hant"), ("简体中文", None, "zh-Hans"), ("繁體中文", "zh", "zh-Hant"), ("中文", None, "zh"), ("Cantonese (Hong Kong)", None, "yue-HK"), ("Chinese [TW]", None, "zh-TW"), ("Simplified", "zh", "zh-Hans"), ("Mandarin", "zh", "cmn"),
    ("日本語", None, "ja"), ("한국어", None, "ko"), ("Русский", "en", "ru"), ("УКРАЇНСЬКА", None, "uk"), ("Ελληνικά", None, "el"), ("עברית", None, "he"), ("العربية", None, "ar"), ("ไทย", None, "th"), ("Tiếng Việt", None, "vi"), ("Türkçe", None, "tr"), ("Čeština", None, "cs"), ("Íslenska", None, "is"),
    ("Vlaams", "nl", "nl-BE"), ("Dutch (Belgium)", "nl", "nl-BE"), ("Bahasa Indonesia", None, "id"), ("Srpski (Cyrillic)", None, "sr-Cyrl"), ("Norsk", None, "no"), ("Nynorsk", "no", "nn"), ("Swiss German", None, "de-CH"),
    ("Englishman", "fr", "fr"), ("Commentary (CC)", "en", "en"), ("French/English", None, "fr"), ("", "en", "en"), (None, "pt-BR", "pt-BR"), (None, None, None), ("Director", None, None), ("Germany", "de", "de-DE"), ("Germany", None, None),
]


def test_names(spark):
    d = spark.createDataFrame([(k, *c) for k, c in enumerate(CASES)], "k int, name string, expected string, wanted string")
    got = d.select("name", "expected", "wanted", told_language(F.col("name"), F.col("expected")).alias("got")).collect()
    assert [(r.name, r.expected, r.got) for r in got if r.got != r.wanted] == []


def test_each_word_alone(spark):
    """Every listed name of a language is found, also between others; a place alone says nothing."""
    d = spark.createDataFrame([(f"x {k.title()} 2", v) for k, v in SPOKEN.items()] + [(k, None) for k in PLACES if k not in SPOKEN], "name string, wanted string")
    got = d.select("name", "wanted", told_language(F.col("name"), F.lit(None).cast("string")).alias("got")).collect()
    assert [tuple(r) for r in got if r.got != r.wanted] == []
