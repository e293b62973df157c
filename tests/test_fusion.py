import json
import random

import pytest
from pyspark.sql import functions as F

from claimforge.cli import response
from claimforge.operators.components import connected_components
from claimforge.operators.fuse import profiles
from claimforge.operators.resolve import cluster
from claimforge.plans.config import Config, ConfigError, FieldSpec, OnMissing, Segment, parse_config, parse_path
from claimforge.plans.pipeline import run
from claimforge.plans.project import project
from claimforge.sources.claims import TABLE, claim
from claimforge.streaming import ledger


def claims_table(spark, records):
    rows = [{"record_id": r, "claim_seq": i} | c for r, record in enumerate(records) for i, c in enumerate(record)]
    return spark.createDataFrame(rows, TABLE)


def say(field, value, source="ats", method="direct_map"):
    return claim(field, value, "", source, method)


def job(company=None, title=None, start=None, end=None, summary=None):
    return {"company": company, "title": title, "start": start, "end": end, "summary": summary}


def one(spark, *claims):
    rows = claims_table(spark, [claims]).withColumn("cluster_id", F.lit(0))
    return profiles(rows).first().asDict(recursive=True)


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(50)] + [(5, 5), (None, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_clusters(spark):
    records = [
        [say("emails", "A@x.io"), say("phones", "415 555 0100")], [say("full_name", "nobody")], [say("phones", "(415) 555-0100"), say("links", {"linkedin": None, "github": "github.com/z", "portfolio": None, "other": []})],
        [say("links", {"linkedin": None, "github": None, "portfolio": None, "other": ["http://github.com/z/?utm_a=1"]})], [say("emails", "broken")], [say("emails", " a@X.io ")],
    ]
    got = {r["record_id"]: r["cluster_id"] for r in cluster(claims_table(spark, records)).select("record_id", "cluster_id").distinct().collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 0, 4: 4, 5: 0}


def test_scalars(spark):
    p = one(spark, say("full_name", "Ada L"), say("full_name", "Ada Lovelace", "github"), say("headline", "x", "resume", "regex_prose"), say("years_experience", "5 years", "resume", "regex_prose"), say("years_experience", 5.0, "notes", "regex_prose"))
    assert p["full_name"] == "Ada L" and p["headline"] is None and p["years_experience"] is None
    assert p["overall_confidence"] == 0.8  # 0.9 less the penalty for a loser of 0.7
    notes = {(x["field"], x["source"]): x["note"] for x in p["provenance"]}
    assert notes[("full_name", "github")] == "superseded" and notes[("full_name", "ats")] is None and notes[("headline", "resume")] == "withheld_low_confidence"


def test_ties_go_to_source_then_text(spark):
    assert one(spark, say("full_name", "b"), say("full_name", "a"))["full_name"] == "a"
    assert one(spark, say("headline", "z", "resume", "structured_parse"), say("headline", "a", "resume", "structured_parse"))["headline"] == "a"


def test_lists_and_skills(spark):
    p = one(spark, say("emails", "B@x.io"), say("emails", "a@x.io"), say("emails", "bad"), say("skills", "py"), say("skills", "Python", "resume", "structured_parse"), say("skills", "COBOL", "resume", "structured_parse"))
    assert p["emails"] == ["a@x.io", "b@x.io"]
    assert p["skills"] == [{"name": "COBOL", "confidence": 0.6, "sources": ["resume"]}, {"name": "Python", "confidence": 0.96, "sources": ["ats", "resume"]}]
    assert p["candidate_id"] == __import__("hashlib").sha1(b"a@x.io").hexdigest() and p["overall_confidence"] == round((0.9 + 0.78) / 2, 4)


def test_links_with_others_only(spark):
    p = one(spark, say("links", {"linkedin": None, "github": None, "portfolio": None, "other": ["b.io/", "a.io"]}))
    assert p["links"] == {"linkedin": None, "github": None, "portfolio": None, "other": ["https://a.io", "https://b.io"]} and p["overall_confidence"] == 0.0


def test_entries(spark):
    p = one(
        spark,
        say("experience", job("Acme", "Dev", "2019-01")), say("experience", job("ACME", "dev", None, "2020", "did")), say("experience", job(None, None, None, None, "only a summary")), say("experience", job("Beta", "Dev", "2021-05")),
        say("experience", job("Gamma", "Dev", "2022-05"), "resume", "structured_parse"),
        say("education", {"institution": "S", "degree": "BSc", "field": None, "end_year": 2010}, "resume", "structured_parse"), say("education", {"institution": "s", "degree": "bsc", "field": "Art", "end_year": 2010}, "resume", "ner"),
    )
    assert [(e["company"], e["start"], e["end"], e["summary"]) for e in p["experience"]] == [("Beta", "2021-05", None, None), ("Acme", "2019-01", "2020", "did")]
    assert p["education"] == [{"institution": "S", "degree": "BSc", "field": "Art", "end_year": 2010}]
    assert {(x["source"], x["method"], x["note"]) for x in p["provenance"] if x["field"] == "experience"} == {("ats", "direct_map", None), ("resume", "structured_parse", "superseded")}


def test_empty_profile(spark):
    p = one(spark, say("emails", "bad"))
    assert p["emails"] == [] and p["skills"] == [] and p["provenance"] == [] and p["overall_confidence"] == 0.0 and p["full_name"] is None
    assert p["candidate_id"] == __import__("hashlib").sha1(b"").hexdigest()


@pytest.fixture(scope="module")
def profile(spark):
    rows = claims_table(spark, [[say("emails", "b@x.io"), say("emails", "a@x.io"), say("skills", "py"), say("skills", "Zig"), say("full_name", "Ada"), say("phones", "4155550100")]]).withColumn("cluster_id", F.lit(0))
    return profiles(rows).cache()


def view(profile, *fields, **how):
    r = project(profile, Config(tuple(fields), **how)).select(F.to_json("values").alias("v"), F.to_json("meta").alias("m"), "violations").first()
    return json.loads(r["v"]), json.loads(r["m"]), [tuple(x) for x in r["violations"]]


def test_paths(profile):
    got, _, wrong = view(profile, FieldSpec("second", "string", "emails[1]"), FieldSpec("third", "string", "emails[2]"), FieldSpec("skills", "string[]", "skills[].name"), FieldSpec("full", "object", "skills[0]"), FieldSpec("no", "string", "emails[0].x"), FieldSpec("none", "array", "experience[].title"))
    assert got == {"second": "b@x.io", "third": None, "skills": ["Python", "Zig"], "full": {"name": "Python", "confidence": 0.9, "sources": ["ats"]}, "no": None, "none": []} and not wrong


def test_policies_and_violations(profile):
    specs = (FieldSpec("a", "string", "headline"), FieldSpec("b", "string", "headline", required=True), FieldSpec("c", "integer", "full_name"), FieldSpec("d", "string", "full_name", normalize="date"))
    got, _, wrong = view(profile, *specs)
    assert got == {"a": None, "c": "Ada", "d": None}
    assert wrong == [("b", "missing_required", "headline"), ("b", "missing_required", None), ("c", "type_mismatch", "integer")]
    assert view(profile, *specs, on_missing=OnMissing.OMIT)[0] == {"c": "Ada", "d": None}  # a failed normalization still places a null
    assert view(profile, specs[0], on_missing=OnMissing.ERROR)[2] == [("a", "missing", "headline")]
    assert view(profile, FieldSpec("e", "string", "full_name", True, "email"))[2] == [("e", "normalize_failed", "email"), ("e", "missing_required", None)]


def test_normalize_lists_and_unknown_tokens(profile):
    got, _, _ = view(profile, FieldSpec("p", "string[]", "phones", normalize="E164"), FieldSpec("e", "string[]", "emails", normalize="date"), FieldSpec("n", "string", "full_name", normalize="shout"))
    assert got == {"p": ["+14155550100"], "e": [], "n": "Ada"}


def test_duplicate_paths_and_meta(profile):
    got, meta, _ = view(profile, FieldSpec("x", "string", "full_name"), FieldSpec("x", "string", "emails[0]"), FieldSpec("gone", "string", "headline", required=True), include_confidence=True, include_provenance=True)
    assert got == {"x": "a@x.io"} and set(meta) == {"x"} and [p["field"] for p in meta["x"]["provenance"]] == ["emails"] and meta["x"]["confidence"] > 0


def test_specs_that_share_a_path_are_judged_on_the_view(profile):
    # The number placed last stands in the view, for both specs.
    got, _, wrong = view(profile, FieldSpec("x", "string", "full_name"), FieldSpec("x", "number", "overall_confidence"))
    assert isinstance(got["x"], float) and wrong == [("x", "type_mismatch", "string")]
    # A required field that finds nothing is there when a later spec places its path.
    _, _, wrong = view(profile, FieldSpec("y", "string", "headline", required=True), FieldSpec("y", "string", "full_name"), on_missing=OnMissing.OMIT)
    assert ("y", "missing_required", None) not in wrong


def test_spellings_of_one_text_are_one_value(spark):
    p = one(spark, say("full_name", "Jose\u0301 Diaz"), say("full_name", "Jos\u00e9 Diaz", "github"))
    assert p["full_name"] == "Jos\u00e9 Diaz" and p["overall_confidence"] > 0.9  # they agree, so their confidences add up


def test_default_view(profile):
    got, meta, wrong = view(profile)
    assert got["emails"] == ["a@x.io", "b@x.io"] and got["headline"] is None and "cluster_id" not in got and meta == {} and not wrong


def test_config_shapes():
    assert parse_path("a[].b[2]") == (Segment("a", each=True), Segment("b", index=2))
    assert parse_config({"fields": [{"path": "a", "type": "string", "from": "b", "extra": 1}], "on_missing": "omit"}) == Config((FieldSpec("a", "string", "b"),), on_missing=OnMissing.OMIT)
    for bad in ([], {"fields": [{"path": "a"}]}, {"fields": [1]}, {"on_missing": "maybe"}, {"fields": [{"path": 1, "type": "x"}]}):
        with pytest.raises(ConfigError):
            parse_config(bad)


def test_end_to_end(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"name": "Ada", "email": "ada@x.io", "skills": ["py"]}))
    (tmp_path / "b.txt").write_text("Ada\nADA@x.io\n\nSKILLS\npython, rust\n")
    (tmp_path / "c.json").write_text("nope")
    got = response(run(spark, [str(tmp_path / n) for n in ("a.json", "b.txt", "c.json")]))
    assert got["summary"] == {"profiles": 1, "mean_confidence": got["results"][0]["profile"]["overall_confidence"], "quarantined": 1}
    assert got["results"][0]["profile"]["skills"][0] == {"name": "Python", "confidence": 0.96, "sources": ["ats", "resume"]} and got["quarantine"][0]["reason"].startswith("JSONDecodeError")


def test_ledger(spark, tmp_path):
    rows = claims_table(spark, [[say("emails", "a@x.io")], [say("full_name", "x")]])
    ledger.append(rows, str(tmp_path / "l"))
    ledger.append(rows, str(tmp_path / "l"))
    ledger.follow(spark.readStream.schema(TABLE).parquet(str(tmp_path / "l")), str(tmp_path / "c"), str(tmp_path / "m")).awaitTermination()
    assert ledger.read(spark, str(tmp_path / "c")).count() == 4
