"""Normalizers: total column functions from a string to ``struct<value, ok, note>``.

They are built of SQL functions only, so they can be used inside ``transform`` and stay in generated
code. Unicode composition (NFC) has no SQL function: :func:`composed` does it with an Arrow UDF, for the rows that are not
ASCII; sources apply it once when claims are read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters that count as white space.
SPACES = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

# Month names, words for the present, countries, tracking parameters, skills.
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6,
    "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11,
    "dec": 12, "december": 12,
}
PRESENT = ("present", "current", "now", "ongoing", "till date", "to date")
COUNTRIES = {
    "us": "US", "usa": "US", "united states": "US", "united states of america": "US", "america": "US",
    "uk": "GB", "gb": "GB", "united kingdom": "GB", "great britain": "GB", "britain": "GB", "england": "GB",
    "in": "IN", "india": "IN", "ca": "CA", "canada": "CA", "de": "DE", "germany": "DE", "deutschland": "DE",
    "fr": "FR", "france": "FR", "au": "AU", "australia": "AU", "sg": "SG", "singapore": "SG", "ie": "IE", "ireland": "IE",
    "nl": "NL", "netherlands": "NL", "holland": "NL", "es": "ES", "spain": "ES", "it": "IT", "italy": "IT",
    "jp": "JP", "japan": "JP", "cn": "CN", "china": "CN", "br": "BR", "brazil": "BR", "mx": "MX", "mexico": "MX",
}
TRACKING_PREFIX = "utm_"
TRACKING = ("gclid", "fbclid", "ref", "ref_src", "mc_cid", "mc_eid", "igshid", "_ga")
SKILLS = {
    "python": "Python", "py": "Python", "javascript": "JavaScript", "js": "JavaScript", "typescript": "TypeScript", "ts": "TypeScript",
    "go": "Go", "golang": "Go", "aws": "AWS", "amazon web services": "AWS", "gcp": "Google Cloud", "google cloud": "Google Cloud",
    "google cloud platform": "Google Cloud", "sql": "SQL", "postgres": "PostgreSQL", "postgresql": "PostgreSQL",
    "spark": "Apache Spark", "apache spark": "Apache Spark", "airflow": "Apache Airflow", "apache airflow": "Apache Airflow",
    "kafka": "Apache Kafka", "apache kafka": "Apache Kafka", "k8s": "Kubernetes", "kubernetes": "Kubernetes", "docker": "Docker",
    "react": "React", "reactjs": "React", "react.js": "React", "node": "Node.js", "nodejs": "Node.js", "node.js": "Node.js",
    "tensorflow": "TensorFlow", "tf": "TensorFlow", "pytorch": "PyTorch",
}
YEARS = (1900, 2100)
MOST_YEARS = 80.0


def composed(x: Column) -> Column:
    """``x`` in NFC; ASCII rows never leave the JVM."""

    @F.pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))

    return F.when(F.rlike(x, F.lit(r"[^\x00-\x7F]")), nfc(x)).otherwise(x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once and written once in the plan, however often it is used."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def good(outcome: Column) -> Column:
    """The value of a normalizer's outcome, null when it failed."""
    return let(outcome, lambda r: F.when(r["ok"], r["value"]))


def result(value: Column, ok: Column, note: Column, kind: str = "string") -> Column:
    return F.struct(F.when(ok, value).cast(kind).alias("value"), ok.alias("ok"), note.cast("string").alias("note"))


def clean(x: Column) -> Column:
    """White space as single spaces, control and format characters gone, trimmed."""
    spaced = F.regexp_replace(F.regexp_replace(x, f"[{SPACES}]", " "), r"\p{C}", "")
    return F.trim(F.regexp_replace(spaced, " +", " "))


def lookup(table: dict[str, object], key: Column) -> Column:
    """A fixed table as a literal map; null for what it lacks."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def _or_empty(text: Column) -> Column:
    def body(value: Column) -> Column:
        ok = F.coalesce(value != "", F.lit(False))
        return result(value, ok, F.when(~ok, F.lit("empty")))

    return let(text, body)


def text_unicode(x: Column) -> Column:
    return _or_empty(clean(x))


def name(x: Column) -> Column:
    return _or_empty(clean(F.regexp_replace(clean(x), "^[\"'`]+|[\"'`]+$", "")))


def email(x: Column) -> Column:
    """The scheme goes before the angle brackets do, so a scheme inside brackets stays."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(clean(x)), "^mailto:", ""), "^[<>]+|[<>]+$", "")

    def body(v: Column) -> Column:
        ok = F.coalesce(F.rlike(v, F.lit(rf"^[^@{SPACES}]+@[^@{SPACES}]+\.[^@{SPACES}]+\z")), F.lit(False))
        return result(v, ok, F.when(~ok, F.lit("invalid_email")))

    return let(bare, body)


def _phone_e164(text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    shaped = F.rlike(text, F.lit(r"^[+(]?[0-9(][0-9 ().\-/]*\z"))
    plus = F.startswith(text, F.lit("+"))
    national = F.when(F.length(digits) == 10, digits).when((F.length(digits) == 11) & F.startswith(digits, F.lit("1")), F.substring(digits, 2, 10))
    american = F.when(F.rlike(national, F.lit("^[2-9][0-9]{2}[2-9][0-9]{6}$")), F.concat(F.lit("+1"), national))
    abroad = F.when(F.rlike(digits, F.lit("^[2-9][0-9]{7,14}$")), F.concat(F.lit("+"), digits))
    value = F.when(shaped, F.when(plus & ~F.startswith(digits, F.lit("1")), abroad).otherwise(american))
    note = F.when(text == "", F.lit("empty")).when(~F.coalesce(shaped, F.lit(False)) | (F.length(digits) < 2), F.lit("unparseable_phone")).when(value.isNull(), F.lit("invalid_phone"))
    return result(value, value.isNotNull(), F.coalesce(note, F.when(text.isNull(), F.lit("empty"))))


def phone_e164(x: Column) -> Column:
    """E.164 by shape: North American numbers, or ``+`` and 8 to 15 digits.

    No metadata of numbering plans is at hand, so unassigned area codes pass, and letters or extensions do not.
    """
    return let(clean(x), _phone_e164)


def _date_ym(low: Column) -> Column:

    def group(pattern: str, i: int) -> Column:
        return F.regexp_extract(low, pattern, i)

    year_month, month_year, word_year, year_only = r"^([0-9]{4})[-/.]([0-9]{1,2})\z", r"^([0-9]{1,2})[-/.]([0-9]{4})\z", r"^([a-z]+)\.? +([0-9]{4})\z", r"^([0-9]{4})\z"
    year = F.coalesce(*(F.nullif(group(p, i), F.lit("")) for p, i in ((year_month, 1), (month_year, 2), (word_year, 2), (year_only, 1))))
    number = F.coalesce(*(F.try_to_number(F.nullif(group(p, i), F.lit("")), F.lit("99")).cast("int") for p, i in ((year_month, 2), (month_year, 1))), lookup(MONTHS, group(word_year, 1)))
    in_range = year.cast("int").between(*YEARS)
    only = F.rlike(low, F.lit(year_only))
    present = low.isin(*PRESENT)
    value = F.when(only & in_range, year).when(~only & in_range & number.between(1, 12), F.concat(year, F.lit("-"), F.lpad(number.cast("string"), 2, "0")))
    ok = F.coalesce(present | value.isNotNull(), F.lit(False))
    note = F.when(F.coalesce(low, F.lit("")) == "", F.lit("empty")).when(present, F.lit("present")).when(~ok, F.lit("invalid_date")).when(only, F.lit("year_only"))
    return result(value, ok, note)


def date_ym(x: Column) -> Column:
    """``YYYY-MM``, or ``YYYY`` noted as year_only; words for the present are good and have no value."""
    return let(F.lower(clean(x)), _date_ym)


def _country_iso2(key: Column) -> Column:
    value = lookup(COUNTRIES, key)
    return result(value, value.isNotNull(), F.when(F.coalesce(key, F.lit("")) == "", F.lit("empty")).when(value.isNull(), F.lit("unknown_country")))


def country_iso2(x: Column) -> Column:
    return let(F.trim(F.replace(F.lower(clean(x)), F.lit("."), F.lit(""))), _country_iso2)


def _parameter(x: Column) -> Column:
    """One ``key=value``, decoded and encoded again; null when it only tracks."""

    def decoded(part: Column) -> Column:
        return F.coalesce(F.try_url_decode(part), part)

    def encoded(part: Column) -> Column:
        return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))

    key, value = decoded(F.get(F.split(x, "=", 2), F.lit(0))), decoded(F.coalesce(F.get(F.split(x, "=", 2), F.lit(1)), F.lit("")))
    tracks = F.startswith(F.lower(key), F.lit(TRACKING_PREFIX)) | F.lower(key).isin(*TRACKING)
    return F.when(~tracks, F.concat(encoded(key), F.lit("="), encoded(value)))


def _url_link(text: Column) -> Column:
    full = F.when(F.contains(text, F.lit("://")), text).otherwise(F.concat(F.lit("https://"), text))
    pattern = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    host = F.lower(F.regexp_extract(full, pattern, 1))
    path = F.regexp_replace(F.regexp_extract(full, pattern, 2), "/+$", "")
    kept = F.array_compact(F.transform(F.filter(F.split(F.regexp_extract(full, pattern, 3), "&"), lambda p: p != ""), _parameter))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    ok = F.coalesce(F.contains(host, F.lit(".")) & (F.contains(host, F.lit("[")) == F.contains(host, F.lit("]"))), F.lit(False))
    kind = F.when(F.contains(host, F.lit("linkedin.com")), F.lit("linkedin")).when(F.contains(host, F.lit("github.com")), F.lit("github")).otherwise(F.lit("other"))
    note = F.when(F.coalesce(text, F.lit("")) == "", F.lit("empty")).when(~ok, F.lit("invalid_url")).otherwise(kind)
    return result(F.concat(F.lit("https://"), host, path, query), ok & (text != ""), note)


def url_link(x: Column) -> Column:
    """https, host in lower case, no fragment, no tracking, no closing slashes; noted by kind of host."""
    return let(clean(x), _url_link)


def _skill_canonical(text: Column) -> Column:
    known = lookup(SKILLS, F.lower(text))
    ok = F.coalesce(text != "", F.lit(False))
    return result(F.coalesce(known, text), ok, F.when(~ok, F.lit("empty")).when(known.isNull(), F.lit("non_canonical")))


def skill_canonical(x: Column) -> Column:
    return let(clean(x), _skill_canonical)


def _years_experience(number: Column) -> Column:
    ok = F.coalesce(number.between(0.0, MOST_YEARS), F.lit(False))
    return result(number, ok, F.when(number.isNull(), F.lit("unparseable")).when(~ok, F.lit("out_of_range")), "double")


def years_experience(x: Column) -> Column:
    return let(F.nullif(F.regexp_extract(clean(x), r"-?[0-9]+(?:\.[0-9]+)?", 0), F.lit("")).cast("double"), _years_experience)


REGISTRY: dict[str, Callable[[Column], Column]] = {f.__name__: f for f in (text_unicode, name, email, phone_e164, date_ym, country_iso2, url_link, skill_canonical, years_experience)}

# Short names that configurations use.
TOKENS = {"phone": "phone_e164", "e164": "phone_e164", "canonical": "skill_canonical", "skill": "skill_canonical", "country": "country_iso2", "date": "date_ym", "url": "url_link", "text": "text_unicode", "years": "years_experience"}


def normalizer_name(token: str) -> str:
    """The registered name a token stands for; any other token is itself."""
    return TOKENS.get(token.strip().lower(), token)


def normalize(which: str, x: Column) -> Column:
    """The named normalizer; an unknown name is a failure with a note, not an error."""
    if which not in REGISTRY:
        return result(F.lit(None).cast("string"), F.lit(False), F.lit(f"unknown_normalizer:{which}"))
    return REGISTRY[which](x)
