"""Free-text documents: readers by suffix and extraction by several strategies."""

from __future__ import annotations

import io
import logging
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

from claimforge.sources import resume_text as R
from claimforge.sources.claims import claim
from claimforge.sources.spans import Tagger, loaded, predicted, span_claims, without_redundant

Strategy = Callable[[str], list[dict]]
log = logging.getLogger(__name__)
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_text(content: bytes, suffix: str) -> str:
    """The text of a document; any suffix but .pdf and .docx is plain text."""
    return {".pdf": _pdf, ".docx": _docx}.get(suffix.lower(), lambda b: b.decode("utf-8", errors="replace"))(content)


def _pdf(content: bytes) -> str:
    import pdfplumber  # optional; without it the document is set aside

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        return "\n".join(page.extract_text() or "" for page in pdf.pages)


def _docx(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in body.findall(f"{_W}p"))


def prose(text: str) -> list[dict]:
    """E-mails, phones and years of experience, anywhere."""
    say = lambda f, v: claim(f, v, v, "resume", "regex_prose")
    years = R.YEARS.search(text)
    return [*(say("emails", e) for e in R.EMAIL.findall(text)), *(say("phones", p) for p in R.phones(text)), *([say("years_experience", years[0])] if years else [])]


def sectioned(text: str) -> list[dict]:
    """The header's name, contacts and links, and the entries of named sections."""
    by = R.sections(R.repaired(text).splitlines())
    header = "\n".join(by[""])
    say = lambda f, v, raw: claim(f, v, raw, "resume", "structured_parse")
    out = [say("full_name", name, name)] if (name := R.header_name(by[""])) else []
    out += [say("emails", e, e) for e in R.EMAIL.findall(header)] + [say("phones", p, p) for p in R.phones(header)]
    if links := R.profile_links(header):
        out.append(say("links", links, header))
    out += [say("skills", s, s) for s in R.skills(by.get("skills", []))]
    out += [say("experience", e, raw) for e, raw in R.experience(by.get("experience", []))]
    return out + [say("education", e, raw) for e, raw in R.education(by.get("education", []))]


def tagged(loader: Callable[[], Tagger] | None) -> Strategy:
    """Claims of labelled spans; without a model, or when it fails, none."""

    def extract(text: str) -> list[dict]:
        if loader is None:
            return []
        try:
            return span_claims(predicted(R.repaired(text), loaded(loader)))
        except Exception:
            log.warning("the span model failed", exc_info=True)
            return []

    return extract


def resume_claims(content: bytes, suffix: str, strategies: tuple[Strategy, ...] = (prose, sectioned, tagged(None))) -> list[dict]:
    """Claims of all strategies in turn; one that fails is left out."""
    text = R.repaired(read_text(content, suffix))
    out: list[dict] = []
    for strategy in strategies:
        try:
            out += strategy(text)
        except Exception:
            log.warning("a strategy failed", exc_info=True)
    return without_redundant(out)
