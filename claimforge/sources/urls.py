"""A URL's canonical form in Python, for sources that sort links while they parse."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import parse_qsl, quote_plus

from claimforge.functions.normalize import TRACKING, TRACKING_PREFIX

_PARTS = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?")


def clean_text(raw: str) -> str:
    """NFC, white space as single spaces, without control and format characters."""
    composed = unicodedata.normalize("NFC", raw)
    spaced = (" " if c.isspace() else c for c in composed if c.isspace() or unicodedata.category(c)[0] != "C")
    return " ".join("".join(spaced).split(" ")).strip() if "  " not in composed else re.sub(" +", " ", "".join(spaced)).strip()


def canonical_url(raw: str) -> tuple[str, str] | None:
    """(canonical URL, kind of host), or None for what isn't one."""
    text = clean_text(raw)
    text = re.sub(" +", " ", text)
    m = _PARTS.match(text if "://" in text else f"https://{text}")
    host = m[1].lower() if m else ""
    if "." not in host or ("[" in host) != ("]" in host):
        return None
    kept = [(k, v) for k, v in parse_qsl(m[3] or "", keep_blank_values=True) if not k.lower().startswith(TRACKING_PREFIX) and k.lower() not in TRACKING]
    query = "&".join(f"{quote_plus(k)}={quote_plus(v)}" for k, v in kept)
    kind = next((k for k in ("linkedin", "github") if f"{k}.com" in host), "other")
    return f"https://{host}{m[2].rstrip('/')}{'?' + query if query else ''}", kind
