import json

import pytest
from pyspark.sql import functions as F

from claimforge.sources import remote, resume_text as R
from claimforge.sources.remote import profile_claims, username_of
from claimforge.sources.resume import resume_claims, sectioned, tagged
from claimforge.sources.route import Adapter, claims_of, extracted, quarantine_of, read_files, routed
from claimforge.sources.spans import Span, employers, merged, paired, span_claims, without_redundant
from claimforge.sources.structured import structured_claims

RESUME = """Lena Ortiz
Oslo, Norway | lena@ortiz.example | +1 415 555 0134
linkedin.com/in/lenaortiz, github.com/lortiz |

Skills:
Languages: Python, Go; SQL
Tem-, poral

EXPERIENCE
Data Engineer, Northwind — Mar 2019 to Present
- built pipelines
more notes
Analyst - Initech
Jan 2016 – Feb 2019
Globex
Intern 2014 - 2015

EDUCATION
BSc in Physics, Oslo College, 2013
Bergen University
Master of Science in Data Mining CGPA: 4.0 2015
Trondheim Academy
"""


def values(claims, field):
    return [next(v for k, v in c.items() if k.startswith("v_") and v is not None) for c in claims if c["field"] == field]


def test_structured_aliases():
    data = {"candidatename": None, "name": "hidden", "ContactInfo": {"Email": " a@b.co ", "Mobile": ["1", " ", 2]}, "email": "top@x.io", "Tags": "Go", "links": "https://x.org", "socials": ["github.com/z", "x.org/?ref=1"], "GradYear": 1}
    got = structured_claims(json.dumps(data).encode())
    assert not values(got, "full_name")  # a null first alias hides the rest
    assert values(got, "emails") == ["top@x.io"] and values(got, "phones") == ["1"] and values(got, "skills") == ["Go"]
    assert values(got, "links") == [{"linkedin": None, "github": "https://github.com/z", "portfolio": None, "other": ["https://x.org"]}]


def test_structured_entries_in_order():
    data = {"jobTitle": "CTO", "workHistory": [{"employer": "A", "startDate": "01/2020"}, "junk", {}], "schools": [{"school": "S", "graduationYear": "2011"}, {"year": True}], "address": {"town": "T"}}
    got = structured_claims(json.dumps(data).encode())
    assert [c["field"] for c in got] == ["location", "experience", "experience", "education"]
    assert [e["title"] for e in values(got, "experience")] == ["CTO", None] and values(got, "education")[0]["end_year"] == 2011


@pytest.mark.parametrize("bad", [b"[1]", b'{"a": 1} x', b"", b"\xff"])
def test_structured_errors(bad):
    with pytest.raises(ValueError):
        structured_claims(bad)


@pytest.mark.parametrize(("raw", "name"), [("https://github.com/ada?x=1", "ada"), ("github.com/ada/", "ada"), ("@ada\nx", "ada"), (" ada ", "ada"), ("", None), ("a b", None), ("GitHub.com/ada", None)])
def test_usernames(spark, raw, name):
    if name is None:
        with pytest.raises((ValueError, IndexError)):
            username_of(raw)
    else:
        assert username_of(raw) == name
    assert spark.range(1).select(remote.username_column(F.lit(raw))).first()[0] == name


def test_remote_profile():
    got = profile_claims({"name": "Ada", "bio": " ", "location": "Oslo, , Norway, X, Y", "twitter_username": "@ada", "company": "@Acme"})
    assert values(got, "location") == [{"city": "Oslo", "region": "Norway", "country": "X"}]
    assert values(got, "links")[0]["other"] == ["https://twitter.com/ada"] and values(got, "experience")[0]["company"] == "Acme"
    assert not values(got, "headline") and not profile_claims({})


def test_handles(spark):
    row = spark.range(1).select(remote.split_handles(F.lit(" a, b\n c,,")), remote.stem_of(F.lit("https://github.com/a b")), remote.stem_of(F.lit("//"))).first()
    assert list(row) == [["a", "b", "c"], "https_github_com_a_b", "github_user"]


def test_resume_sections():
    got = sectioned(RESUME)
    assert values(got, "full_name") == ["Lena Ortiz"] and values(got, "emails") == ["lena@ortiz.example"]
    assert values(got, "links") == [{"linkedin": "linkedin.com/in/lenaortiz", "github": "github.com/lortiz", "portfolio": None, "other": []}]
    assert values(got, "skills") == ["Python", "Go", "SQL", "Temporal"]
    jobs = values(got, "experience")
    assert [(j["title"], j["company"], j["start"], j["end"]) for j in jobs] == [("Data Engineer", "Northwind", "Mar 2019", "Present"), ("Analyst", "Initech", "Jan 2016", "Feb 2019"), ("Intern", "Globex", "2014", "2015")]
    assert jobs[0]["summary"] == "built pipelines more notes"
    assert [(e["institution"], e["degree"], e["field"], e["end_year"]) for e in values(got, "education")] == [("Oslo College", "BSc", "Physics", 2013), ("Bergen University", "Master of Science", "Data Mining", 2015), ("Trondheim Academy", None, None, None)]


def test_resume_methods_and_repair():
    got = resume_claims(RESUME.encode() + b"\nover 8 years of experience \xff", ".txt")
    assert {c["method"] for c in got} == {"regex_prose", "structured_parse"} and values(got, "years_experience") == ["8 years of experience"]
    assert R.unglued("SoftwareEngineerAtNorthwind2019") == "Software Engineer At Northwind 2019"
    assert R.phones("card 4111 1111 1111 1111, pin 12345678") == ["4111 1111 1111 1111"]


def test_windows_cover_the_text():
    text = "\n".join("x" * n for n in (500, 600, 900, 1500, 3))
    parts = R.chunks(text)
    assert all(text[at : at + len(c)] == c and len(c) <= R.CHUNK for c, at in parts) and parts[0][1] == 0 and parts[-1][1] + len(parts[-1][0]) == len(text)
    assert all(a[1] + len(a[0]) >= b[1] for a, b in zip(parts, parts[1:], strict=False)) and R.chunks("") == [("", 0)]


def span(text, label, start, score=0.9):
    return Span(text=text, label=label, start=start, end=start + len(text), score=score)


def test_spans():
    assert [s["score"] for s in merged([span("A", "person", 9, 0.6), span(" A ", "Person", 3, 0.8), span(" ", "person", 1)])] == [0.8]
    assert [s.text for s in employers([span("Docker", "organization", 0), span("Acme", "organization", 9), span("Acme Holdings", "organization", 20)])] == ["Acme Holdings"]
    titles, orgs = [span("X", "job title", 100), span("Y", "job title", 110)], [span("P", "organization", 105), span("Q", "organization", 400), span("R", "organization", 330)]
    assert [(a.text, b.text) for a, b in paired(titles, orgs)] == [("X", "P"), ("Y", "R")]
    got = span_claims([*titles, *orgs, span("Oslo, Norway", "location", 0), span("MIT School", "university", 900), span("BSc in Art 2011", "degree", 880)])
    assert [c["field"] for c in got] == ["experience", "experience", "education", "location"] and values(got, "education")[0]["end_year"] == 2011
    told = [c for c in sectioned("A B\nEXPERIENCE\nX, P Industries — 2010 to 2011\n")]
    assert len(without_redundant([*told, *got])) == len(told) + 3


class Model:
    def predict_entities(self, text, labels, threshold):
        return [{"text": "Ada", "label": "person", "start": text.find("Ada"), "end": text.find("Ada") + 3, "score": 0.8}]


def test_tagger_is_optional():
    assert values(tagged(Model)("Dr Ada"), "full_name") == ["Ada"]
    assert tagged(None)("x") == [] and tagged(lambda: 1 / 0)("x") == []


def test_isolation(spark, tmp_path):
    (tmp_path / "a.JSON").write_text('{"name": "Ada"}')
    (tmp_path / "b.json").write_text("{")
    (tmp_path / "c.txt").write_text("")
    (tmp_path / "d.xyz").write_text("?")
    paths = [str(tmp_path / n) for n in ("a.JSON", "b.json", "c.txt", "d.xyz", "gone.json")]
    out = extracted(read_files(spark, paths)).cache()
    assert [(r["record_id"], r["v_str"]) for r in claims_of(out).collect()] == [(0, "Ada")]
    aside = {r["record_id"]: (r["source"], r["reason"]) for r in quarantine_of(out).collect()}
    assert set(aside) == {1, 3, 4} and aside[1][1].startswith("JSONDecodeError: ") and aside[3] == (None, "no_adapter") and aside[4][1].startswith("FileNotFoundError")


def test_first_adapter_that_can(spark):
    def broken(path):
        raise RuntimeError

    adapters = [Adapter("x", broken, None), Adapter("y", lambda p: F.endswith(p, F.lit("t")), None), Adapter("z", lambda p: F.lit(True), None)]
    files = spark.createDataFrame([("a.t",), ("b",)], "path string")
    assert [r["adapter"] for r in routed(files, adapters).orderBy("path").collect()] == [1, 2]
