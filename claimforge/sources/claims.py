"""The claims table: one row for what one source says of one field."""

from __future__ import annotations

import unicodedata

LOCATION = "struct<city:string,region:string,country:string>"
LINKS = "struct<linkedin:string,github:string,portfolio:string,other:array<string>>"
EXPERIENCE = "struct<company:string,title:string,start:string,end:string,summary:string>"
EDUCATION = "struct<institution:string,degree:string,field:string,end_year:int>"
VALUES = (("v_str", "string"), ("v_num", "double"), ("v_loc", LOCATION), ("v_links", LINKS), ("v_exp", EXPERIENCE), ("v_edu", EDUCATION))
CLAIM = f"field:string,source:string,method:string,raw:string,{','.join(f'{n}:{t}' for n, t in VALUES)}"
CLAIMS = f"array<struct<{CLAIM}>>"
#: record_id: place of the source in the input; claim_seq: place of the claim in its record.
TABLE = "record_id long, claim_seq int, " + ", ".join(x.replace(":", " ", 1) for x in ("field:string", "source:string", "method:string", "raw:string")) + ", " + ", ".join(f"{n} {t}" for n, t in VALUES)

SOURCES = ("ats", "resume", "github", "notes")
METHODS = ("direct_map", "structured_parse", "regex_prose", "ner")


def _composed(value: object) -> object:
    """Every string of a value in NFC, which no SQL function gives; ``raw`` keeps the source's own spelling."""
    if isinstance(value, str):
        return unicodedata.normalize("NFC", value)
    if isinstance(value, dict):
        return {k: _composed(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_composed(v) for v in value]
    return value


def claim(field: str, value: object, raw: str, source: str, method: str) -> dict:
    """A claim as the extractors make it, composed; the value's kind picks its column."""
    value = _composed(value)
    out = {"field": field, "source": source, "method": method, "raw": raw} | {n: None for n, _ in VALUES}
    if isinstance(value, dict):
        out[{"location": "v_loc", "links": "v_links", "experience": "v_exp", "education": "v_edu"}[field]] = value
    elif isinstance(value, str):
        out["v_str"] = value
    else:
        out["v_num"] = float(value)
    return out
