"""Remote profiles: a handle names an account, an injected fetcher gives its public profile."""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimforge.sources.claims import claim
from claimforge.sources.structured import as_text, raw_json

Fetcher = Callable[[str], dict]

# Fixed values of the public users API.
API = "https://api.github.com/users/{username}"
HEADERS = {"User-Agent": "claimforge/0.1", "Accept": "application/vnd.github+json"}
TIMEOUT_S = 10.0
HOST = "github.com"


def http_fetch(username: str) -> dict:
    """The public profile over HTTP; anything but an object is an error."""
    request = urllib.request.Request(API.format(username=quote(username, safe="")), headers=HEADERS)
    with urllib.request.urlopen(request, timeout=TIMEOUT_S) as response:
        data = json.loads(response.read().decode("utf-8"))
    if not isinstance(data, dict):
        raise ValueError("the profile is not a JSON object")
    return data


def username_of(raw: str) -> str:
    """The account of a bare name, an @handle or a profile URL, from the first line."""
    lines = raw.strip().splitlines()
    text = lines[0].strip() if lines else ""
    if not text:
        raise ValueError("the handle is empty")
    if HOST in text.lower():
        text = re.split(r"[/?]", text.split(HOST, 1)[1].lstrip("/"), maxsplit=1)[0]
    text = text.lstrip("@").strip()
    if not re.fullmatch(r"[A-Za-z0-9-]+", text):
        raise ValueError(f"not a valid username: {raw.strip()!r}")
    return text


def username_column(raw: Column) -> Column:
    """:func:`username_of` as an expression; null where that raises."""
    first = F.trim(F.get(F.split(F.trim(raw), r"\R"), F.lit(0)))
    tail = F.regexp_extract(first, r"^.*?github\.com/*([^/?]*)", 1)
    bare = F.trim(F.regexp_replace(F.when(F.contains(first, F.lit(HOST)), tail).when(F.contains(F.lower(first), F.lit(HOST)), F.lit("")).otherwise(first), "^@+", ""))
    return F.when(F.rlike(bare, F.lit(r"^[A-Za-z0-9-]+\z")), bare)


def stem_of(handle: Column, fallback: str = "github_user") -> Column:
    """A handle as a file name: other characters become _, at most 60 stay."""
    slug = F.regexp_replace(F.regexp_replace(F.trim(handle), "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.substring(slug, 1, 60), F.lit("")), F.lit(fallback))


def split_handles(raw: Column) -> Column:
    """Handles of a free list, parted by white space or commas."""
    return F.filter(F.split(F.coalesce(raw, F.lit("")), r"[\s,]+"), lambda h: h != "")


def profile_claims(data: dict) -> list[dict]:
    """Claims of a public profile; fields that are missing or blank make none."""
    texts = {k: as_text(data.get(k)) for k in ("name", "email", "bio", "location", "html_url", "blog", "twitter_username", "company")}
    out = []

    def say(field: str, value: object, raw: str) -> None:
        out.append(claim(field, value, raw, "github", "direct_map"))

    for field, key in (("full_name", "name"), ("emails", "email"), ("headline", "bio")):
        if texts[key]:
            say(field, texts[key], texts[key])
    places = [p.strip() for p in (texts["location"] or "").split(",") if p.strip()]
    if places:
        say("location", dict(zip(("city", "region", "country"), [*places, None, None][:3], strict=True)), raw_json(data.get("location")))
    other = [f"https://twitter.com/{texts['twitter_username'].lstrip('@')}"] if texts["twitter_username"] else []
    if texts["html_url"] or texts["blog"] or other:
        links = {"linkedin": None, "github": texts["html_url"], "portfolio": texts["blog"], "other": other}
        say("links", links, raw_json({k: data.get(k) for k in ("html_url", "blog", "twitter_username")}))
    if company := texts["company"]:
        entry = {"company": company.lstrip("@").strip() or company, "title": None, "start": None, "end": None, "summary": None}
        say("experience", entry, raw_json(data.get("company")))
    return out


def remote_claims(content: bytes, fetch: Fetcher = http_fetch) -> list[dict]:
    return profile_claims(fetch(username_of(content.decode("utf-8"))))
