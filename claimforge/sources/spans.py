"""Labelled text spans: merging, pairing and turning them into claims."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

from claimforge.sources import resume_text as R
from claimforge.sources.claims import claim

# Labels, threshold, the reach of pairing, and technology names that employ nobody.
LABELS = ("person", "organization", "university", "degree", "job title", "certification", "location")
THRESHOLD = 0.5
REACH = 250
NOT_EMPLOYERS = frozenset({"google cloud", "aws", "azure", "docker", "kubernetes", "postgresql", "mongodb", "redis", "fastapi", "python"})
FRAGMENT_CHARS = 4


class Span(dict):
    """text, label, start, end, score."""

    @property
    def label(self) -> str:
        return self["label"].strip().lower()

    @property
    def text(self) -> str:
        return self["text"].strip()


class Tagger(Protocol):
    """A model that labels spans of a text."""

    def predict_entities(self, text: str, labels: list[str], threshold: float) -> list[dict]: ...


_loaded: dict[Callable[[], Tagger], Tagger] = {}


def loaded(loader: Callable[[], Tagger]) -> Tagger:
    """The model of a loader, once per worker process."""
    if loader not in _loaded:
        _loaded[loader] = loader()
    return _loaded[loader]


def predicted(text: str, model: Tagger) -> list[Span]:
    """Spans of a whole text, from overlapping windows, merged."""
    found = []
    for chunk, at in R.chunks(text):
        for e in model.predict_entities(chunk, list(LABELS), threshold=THRESHOLD):
            found.append(Span(e, start=e["start"] + at, end=e["end"] + at))
    return merged(found)


def merged(spans: Sequence[dict]) -> list[Span]:
    """Of spans alike in label and text the best scored stays, then the earliest; blank ones go."""
    best: dict[tuple[str, str], Span] = {}
    for s in map(Span, spans):
        if s.text:
            best[s.label, s.text] = min(best.get((s.label, s.text), s), s, key=lambda x: (-x["score"], x["start"]))
    return sorted(best.values(), key=lambda s: (s["start"], s["end"], s["label"], s["text"]))


def distance(a: dict, b: dict) -> int:
    return max(0, b["start"] - a["end"], a["start"] - b["end"])


def paired(anchors: Sequence[Span], candidates: Sequence[Span], reach: int = REACH) -> list[tuple[Span, Span]]:
    """Each anchor in turn with the nearest candidate within reach that no one took; the first of equals."""
    free, out = dict(enumerate(candidates)), []
    for a in anchors:
        near = min(((distance(a, c), i) for i, c in free.items()), default=(reach + 1, -1))
        if near[0] <= reach:
            out.append((a, free.pop(near[1])))
    return out


def employers(spans: Sequence[Span]) -> list[Span]:
    """Organizations that are neither technologies nor fragments of a longer one."""
    names = {s.text.lower() for s in spans}

    def fragment(name: str) -> bool:
        return any(name != n and name in n and len(n) - len(name) > FRAGMENT_CHARS for n in names)

    return [s for s in spans if s.text and s.text.lower() not in NOT_EMPLOYERS and not fragment(s.text.lower())]


def span_claims(spans: Sequence[dict]) -> list[dict]:
    """Claims of a text's spans: titles with employers, universities with degrees, and single labels."""
    ordered = sorted(map(Span, spans), key=lambda s: (s["start"], s["end"], s["label"]))
    of = lambda label: [s for s in ordered if s.label == label]
    out = []

    def say(field: str, value: object, raw: str) -> None:
        out.append(claim(field, value, raw, "resume", "ner"))

    for title, org in paired(of("job title"), employers(of("organization"))):
        say("experience", {"company": org.text, "title": title.text, "start": None, "end": None, "summary": None}, f"{title.text} @ {org.text}")
    for school, degree in paired(of("university"), of("degree")):
        name, studied = R.degree_and_field(degree.text) if R.looks_like_degree(degree.text) else (degree.text, None)
        say("education", {"institution": school.text, "degree": name, "field": studied, "end_year": R.education_year(degree.text)}, f"{degree.text} @ {school.text}")
    for s in ordered:
        if s.text and s.label == "person":
            say("full_name", s.text, s["text"])
        elif s.text and s.label == "certification":
            say("certifications", s.text, s["text"])
        elif s.text and s.label == "location":
            say("location", R.location_of(s.text), s["text"])
    return out


def _low(entry: dict, key: str) -> str:
    return (entry[key] or "").lower()


def _job_again(ner: dict, told: dict) -> bool:
    title, company, own_title, own_company = _low(ner, "title"), _low(ner, "company"), _low(told, "title"), _low(told, "company")
    if own_title and title != own_title:
        return False
    if company and own_company:
        return company == own_company or (company in own_company and len(own_company) - len(company) > FRAGMENT_CHARS)
    return bool(own_company and not company and title == own_title)


def _study_again(ner: dict, told: dict) -> bool:
    degree, studied, own = _low(ner, "degree"), _low(ner, "field"), _low(told, "field")
    return bool(degree) and degree == _low(told, "degree") and (not studied or not own or studied == own)


def without_redundant(claims: Sequence[dict]) -> list[dict]:
    """Claims without span entries that parsed ones repeat, or that say too little."""
    told = {f: [c[v] for c in claims if c["field"] == f and c["method"] == "structured_parse" and c[v]] for f, v in (("experience", "v_exp"), ("education", "v_edu"))}

    def redundant(c: dict) -> bool:
        if c["method"] != "ner":
            return False
        if c["field"] == "experience" and (e := c["v_exp"]):
            company = (e["company"] or "").strip()
            poor = bool(company) and (company.lower() in NOT_EMPLOYERS or not (e["title"] or "").strip())
            return poor or any(_job_again(e, t) for t in told["experience"])
        if c["field"] == "education" and (e := c["v_edu"]):
            return e["institution"] is None and e["degree"] is not None and any(_study_again(e, t) for t in told["education"])
        return False

    return [c for c in claims if not redundant(c)]
