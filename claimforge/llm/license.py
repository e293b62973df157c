"""License scan: ordered signature rules, gated by keywords, resolved by priority and containment.

The main path is one projection of built-in SQL functions: no shuffle, no Python.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words of a text, after A-Z are lower-cased, and the base phrases with their labels.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A signature over the words of a text joined by single spaces.

    ``keyword`` must occur, in a text with a space at both ends, before the regex is tried: whatever the regex
    matches holds it, so it spares work and loses nothing; smaller ``priority`` wins when two rules
    match the very same words; ``confidence`` is what a surviving detection says, 0 to 1.
    """

    label: str
    keyword: str
    regex: str
    priority: int
    confidence: float


# Hand-written stems. A family is (label, words, versions); its rules are made for every version in the
# ways that notices write them: "version 2.0", "v2.0", "2.0", each also with "or later" and "only".
FAMILIES = (
    ("gpl", r"(?:gnu )?general public licen[sc]e", ("1", "2", "3"), "general public licen"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[sc]e", ("2", "2 1", "3"), "general public licen"),
    ("agpl", r"(?:gnu )?affero general public licen[sc]e", ("1", "3"), "affero"),
    ("gfdl", r"(?:gnu )?free documentation licen[sc]e", ("1 1", "1 2", "1 3"), "free documentation"),
    ("apache", r"apache (?:software )?licen[sc]e", ("1 0", "1 1", "2 0"), "apache"),
    ("mpl", r"mozilla public licen[sc]e", ("1 0", "1 1", "2 0"), "mozilla public"),
    ("epl", r"eclipse public licen[sc]e", ("1 0", "2 0"), "eclipse public"),
    ("eupl", r"european union public licen[sc]e", ("1 0", "1 1", "1 2"), "european union public"),
    ("cddl", r"common development and distribution licen[sc]e", ("1 0", "1 1"), "common development"),
    ("cpl", r"common public licen[sc]e", ("1 0",), "common public"),
    ("osl", r"open software licen[sc]e", ("1 0", "2 0", "2 1", "3 0"), "open software"),
    ("afl", r"academic free licen[sc]e", ("1 1", "1 2", "2 0", "2 1", "3 0"), "academic free"),
    ("artistic", r"(?:perl )?artistic licen[sc]e", ("1 0", "2 0"), "artistic"),
    ("lppl", r"latex project public licen[sc]e", ("1 0", "1 1", "1 2", "1 3"), "latex project"),
    ("zpl", r"zope public licen[sc]e", ("1 1", "2 0", "2 1"), "zope public"),
    ("psf", r"(?:python software foundation|psf) licen[sc]e", ("2",), "licen"),
    ("php", r"php licen[sc]e", ("3 0", "3 01"), "php licen"),
    ("ofl", r"(?:sil )?open font licen[sc]e", ("1 0", "1 1"), "open font"),
    ("bsl", r"boost software licen[sc]e", ("1 0",), "boost software"),
    ("busl", r"business source licen[sc]e", ("1 1",), "business source"),
    ("sspl", r"server side public licen[sc]e", ("1",), "server side public"),
    ("elastic", r"elastic licen[sc]e", ("1", "2 0"), "elastic licen"),
    ("cecill", r"cecill(?: free software)? licen[sc]e", ("1 0", "1 1", "2 0", "2 1"), "cecill"),
    ("odbl", r"open (?:data commons open )?database licen[sc]e", ("1 0",), "database licen"),
)
FORMS = (
    ("", "", r" (?:the )?(?:version |v ?)?{v}(?! \d)", 30, 0.95),
    ("-or-later", "later", r" (?:the )?(?:version |v ?)?{v} (?:of the licen[sc]e )?or (?:at your option )?(?:\(?any )?later(?: version)?", 10, 1.0),
    ("-only", "only", r" (?:the )?(?:version |v ?)?{v} only", 10, 1.0),
)
CC_PARTS = (("by", "attribution"), ("by nc", "attribution non ?commercial"), ("by sa", "attribution share ?alike"), ("by nd", "attribution no ?deriv(?:ative)?s"), ("by nc sa", "attribution non ?commercial share ?alike"), ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s"))
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
# Single rules: label, keyword, regex, priority, confidence.
SINGLES = (
    ("mit", "mit licen", r"(?:the )?mit licen[sc]e", 40, 0.9),
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", 5, 1.0),
    ("mit-0", "mit no attribution", r"mit no attribution(?: licen[sc]e)?", 20, 0.95),
    ("x11", "x11 licen", r"x11 licen[sc]e", 40, 0.9),
    ("isc", "isc licen", r"isc licen[sc]e", 40, 0.9),
    ("isc", "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose", 5, 1.0),
    ("bsd-2-clause", "bsd", r"(?:2|two) clause bsd(?: licen[sc]e)?|(?:simplified|freebsd) bsd licen[sc]e|bsd 2 clause(?: licen[sc]e)?", 20, 0.95),
    ("bsd-3-clause", "bsd", r"(?:3|three) clause bsd(?: licen[sc]e)?|(?:new|modified|revised) bsd licen[sc]e|bsd 3 clause(?: licen[sc]e)?", 20, 0.95),
    ("bsd-4-clause", "bsd", r"(?:4|four) clause bsd(?: licen[sc]e)?|original bsd licen[sc]e|bsd 4 clause(?: licen[sc]e)?", 20, 0.95),
    ("0bsd", "bsd", r"(?:0|zero) clause bsd(?: licen[sc]e)?|0bsd", 20, 0.95),
    ("bsd", "bsd", r"bsd(?: style)? licen[sc]e", 50, 0.8),
    ("bsd", "redistribution and use in source", r"redistribution and use in source and binary forms with or without modification are permitted", 5, 1.0),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e", 40, 0.9),
    ("libpng", "libpng licen", r"libpng licen[sc]e", 40, 0.9),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa (?:open source )?licen[sc]e", 40, 0.9),
    ("unlicense", "unlicen", r"(?:the )?unlicen[sc]e", 40, 0.9),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 5, 1.0),
    ("wtfpl", "wtfpl", r"wtfpl", 40, 0.9),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", 30, 0.95),
    ("cc0-1.0", "creative commons", r"creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?", 20, 1.0),
    ("cc", "creative commons", r"creative commons(?: public)? licen[sc]e", 60, 0.6),
    ("public-domain", "public domain", r"(?:released|dedicated|placed|is) (?:in|into|to) the public domain", 50, 0.7),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e", 40, 0.9),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e", 40, 0.9),
    ("ruby", "ruby licen", r"ruby licen[sc]e", 40, 0.9),
    ("json", "good not evil", r"the software shall be used for good not evil", 5, 1.0),
    ("sleepycat", "sleepycat", r"sleepycat(?: public)? licen[sc]e", 40, 0.9),
    ("openssl", "openssl", r"openssl(?: ssleay)? licen[sc]e", 40, 0.9),
    ("qpl", "public licen", r"q public licen[sc]e", 40, 0.9),
    ("ipl", "ibm public", r"ibm public licen[sc]e", 40, 0.9),
    ("curl", "curl licen", r"curl licen[sc]e", 40, 0.9),
    ("postgresql", "postgresql licen", r"postgresql licen[sc]e", 40, 0.9),
    ("beerware", "beer", r"beer ?ware licen[sc]e", 40, 0.9),
    ("odc-by", "open data commons", r"open data commons attribution licen[sc]e", 30, 0.95),
    ("pddl", "public domain dedication", r"public domain dedication and licen[sc]e", 30, 0.95),
    ("ogl", "open government", r"open government licen[sc]e", 40, 0.9),
    ("commons-clause", "commons clause", r"commons clause(?: licen[sc]e)?(?: condition)?", 30, 0.95),
    ("proprietary", "proprietary and confidential", r"proprietary and confidential", 50, 0.7),
    ("proprietary", "all rights reserved", r"all rights reserved", 70, 0.4),
)
SPDX_IDS = ("mit", "isc", "zlib", "x11", "ncsa", "unlicense", "wtfpl", "apache 2 0", "mpl 2 0", "epl 2 0", "gpl 2 0 only", "gpl 2 0 or later", "gpl 3 0 only", "gpl 3 0 or later", "lgpl 2 1 only", "lgpl 2 1 or later", "lgpl 3 0 only", "lgpl 3 0 or later", "agpl 3 0 only", "agpl 3 0 or later", "bsd 2 clause", "bsd 3 clause", "cc0 1 0", "cc by 4 0", "cc by sa 4 0", "bsl 1 0", "artistic 2 0", "ofl 1 1", "eupl 1 2", "busl 1 1")


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules in order of priority."""
    out = [Rule(*x) for x in ((label, keyword, regex, p, c) for label, keyword, regex, p, c in SINGLES)]
    for label, words, versions, keyword in FAMILIES:
        out.append(Rule(label, keyword, words, 60, 0.6))
        short = label.replace(" ", "")
        for v in versions:
            name = f"{label}-{v.replace(' ', '.')}" + (".0" if " " not in v else "")
            number = v if " " in v else f"{v}(?: 0)?"
            for suffix, _, form, p, c in FORMS:
                out.append(Rule(name + suffix, keyword, words + form.format(v=number), p, c))
            out.append(Rule(name, f" {short} ", rf"{short} (?:v ?)?{number}(?! \d)", 40, 0.8))
            out.append(Rule(name, f"{short}v{v}", rf"{short}v{number}(?! \d)", 40, 0.8))
    for short, words in CC_PARTS:
        for v in CC_VERSIONS:
            name = f"cc-{short.replace(' ', '-')}-{v.replace(' ', '.')}"
            out.append(Rule(name, f"cc {short} {v}", rf"cc {short} {v}", 30, 0.95))
            out.append(Rule(name, "creative commons", rf"creative commons {words}(?: licen[sc]e)? (?:version )?{v}(?: international| unported| generic)?", 20, 1.0))
    for x in SPDX_IDS:
        out.append(Rule(x.replace(" ", "-").replace("-0", ".0").replace("-1-1", "-1.1").replace("-2-1", "-2.1").replace("-1-2", "-1.2"), "spdx license identifier", rf"spdx license identifier {x}", 1, 1.0))
    return tuple(sorted(out, key=lambda r: (r.priority, r.label, r.regex)))


#: Short names that notices write with a version, joined to it or not.
SHORT_NAMES = ("gpl", "lgpl", "agpl", "gfdl", "apache", "mpl", "epl", "eupl", "cddl", "cpl", "osl", "afl", "artistic", "lppl", "zpl", "psf", "php", "ofl", "bsl", "busl", "sspl", "elastic", "cecill", "odbl")
#: What every rule's words hold at least one of; a text without any of these words is not scanned further.
GATE_WORDS = (
    "license", "licence", "unlicense", "unlicence", "spdx", "bsd", "0bsd", "cc", "cc0", "creative", "commons", "hereby", "modify", "redistribution", "unencumbered", "wtfpl", "attribution", "domain",
    "proprietary", "reserved", "evil", *(name + v for name in SHORT_NAMES for v in ("", "v1", "v2", "v3")),
)


def _normalised(text: Column) -> Column:
    """The words of a text, lower-cased and joined, with one space before and after each."""
    return F.regexp_replace(F.concat(F.lit(" "), F.translate(text, UPPER, LOWER), F.lit(" ")), NOT_WORD, " ")


def _gate(phrases, signatures) -> Column:
    if signatures != rules():
        return F.lit(True)
    words = dict.fromkeys([*GATE_WORDS, *(max(p.split(" "), key=len) for p, _ in phrases)])
    return F.arrays_overlap("w", F.array(*map(F.lit, words)))


def _n_words(split: Column) -> Column:
    """Words of a text split between them: what is not the empty string at its ends."""
    return (F.size(split) - (F.get(split, F.lit(0)) == "").cast("int") - ((F.size(split) > 1) & (F.element_at(split, -1) == "")).cast("int")).cast("long")


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _phrases_regex(phrases) -> str:
    return "|".join(sorted((p for p, _ in phrases), key=len, reverse=True))


def _places(norm: Column, rule: Column) -> Column:
    """Every place of one rule: array of (start, end, priority, label, confidence) in characters."""
    pattern = F.concat(F.lit(r"(?s)\G(.*?)(?<= )("), rule["regex"], F.lit(")(?= )"))
    gaps, hits = F.regexp_extract_all(norm, pattern, F.lit(1)), F.regexp_extract_all(norm, pattern, F.lit(2))
    lengths = F.arrays_zip(F.transform(gaps, F.length).alias("g"), F.transform(hits, F.length).alias("h"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,p:int,l:string,c:double>>").alias("out"))
    folded = F.aggregate(
        lengths,
        start,
        lambda acc, x: F.struct(
            (acc["at"] + x["g"] + x["h"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("s"), (acc["at"] + x["g"] + x["h"]).alias("e"), rule["p"].alias("p"), rule["l"].alias("l"), rule["c"].alias("c")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return folded


def _resolved(found: Column) -> Column:
    """What is left when detections inside another, or of the same words at lower priority, go.

    Sorted by start, longer first, then priority: a detection is covered exactly when one before
    it reaches as far.
    """
    by = F.array_sort(F.transform(found, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("n"), x["p"].alias("p"), x["l"].alias("l"), x["c"].alias("c"))))
    start = F.struct(F.lit(0).alias("far"), F.array().cast("array<struct<l:string,c:double>>").alias("out"))
    return F.aggregate(
        by,
        start,
        lambda acc, x: F.when(-x["n"] > acc["far"], F.struct((-x["n"]).alias("far"), F.concat(acc["out"], F.array(F.struct(x["l"].alias("l"), x["c"].alias("c")))).alias("out"))).otherwise(acc),
        lambda acc: acc["out"],
    )


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=BASE_PHRASES, signatures: tuple[Rule, ...] | None = None) -> DataFrame:
    """Find license mentions in every whole text; one row per input row, in one projection.

    A row holds the words of the text (``n_words``), all places of the base ``phrases``
    (``n_base``) with the first and last word at which one starts, the distinct sorted
    ``base_labels``, ``labels`` (base ones and those of the rules that survive) and ``score``,
    the largest confidence of a detection (0.9 for a base phrase, 0 without any).

    Null and empty texts have no words and no labels; a null id stays null; repeated rows stay;
    further columns are ignored, whatever their names. Detections that tie on the same words go
    to the rule of smaller priority, then to the label that sorts first.
    """
    signatures = rules() if signatures is None else signatures
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("x"))
    # Splitting alone may lower-case more than A-Z: it changes no word's bounds, and can only let more texts in.
    split = docs.select("doc_id", "x", F.split(F.lower("x"), NOT_WORD).alias("w"))
    gated = split.select("doc_id", _n_words(F.col("w")).alias("n_words"), F.when(_gate(phrases, signatures), _normalised(F.col("x"))).alias("norm"))
    # One literal: the planner folds it to a constant.
    spelled = json.dumps([{"k": r.keyword, "regex": r.regex, "p": r.priority, "l": r.label, "c": r.confidence} for r in signatures])
    table = F.from_json(F.lit(spelled), "array<struct<k:string,regex:string,p:int,l:string,c:double>>")
    any_phrase = f"(?<= )(?:{_phrases_regex(phrases)})(?= )"
    norm = F.col("norm")
    n_base = sum((F.regexp_count(norm, F.lit(f"(?<= )(?={p} )")) for p, _ in phrases), F.lit(0))
    found = F.flatten(F.transform(F.filter(table, lambda r: F.contains(norm, r["k"])), lambda r: _places(norm, r)))
    scanned = gated.select(
        "doc_id",
        "n_words",
        F.coalesce(n_base, F.lit(0)).cast("long").alias("n_base"),
        F.when(F.regexp_instr(norm, F.lit(any_phrase)) > 0, _spaces(F.substring(norm, F.lit(1), F.regexp_instr(norm, F.lit(any_phrase)) - 1)) - 1).cast("long").alias("first_word"),
        F.when(F.regexp_instr(norm, F.lit(any_phrase)) > 0, _spaces(F.regexp_extract(norm, f"(?s)^(.* )(?:{_phrases_regex(phrases)})(?= )", 1)) - 1).cast("long").alias("last_word"),
        F.array_compact(F.array(*(F.when(F.contains(norm, F.lit(f" {p} ")), F.lit(label)) for p, label in phrases))).alias("b"),
        F.when(norm.isNotNull(), _resolved(found)).alias("kept"),
    )
    named = F.coalesce(F.transform("kept", lambda d: d["l"]), F.array().cast("array<string>"))
    confidence = F.coalesce(F.array_max(F.transform("kept", lambda d: d["c"])), F.lit(0.0))
    return scanned.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort(F.array_distinct("b")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("b", named)), ",").alias("labels"),
        F.greatest(confidence, F.when(F.col("n_base") > 0, F.lit(0.9)).otherwise(F.lit(0.0))).alias("score"),
    )
