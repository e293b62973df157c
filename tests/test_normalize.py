import pytest
from pyspark.sql import functions as F

from claimforge.functions import normalize as N
from claimforge.functions.confidence import claim_confidence, noisy_or

GOOD = [
    ("text_unicode", " a  b​\tc ", "a b c", None),
    ("name", " \"Ada  Lovelace' ", "Ada Lovelace", None),
    ("email", "MAILTO:Ada@Example.ORG", "ada@example.org", None),
    ("email", "<a@b.co>", "a@b.co", None),
    ("phone_e164", "(415) 555-0182", "+14155550182", None),
    ("phone_e164", "+44 20 7946 0958", "+442079460958", None),
    ("date_ym", "2021-3", "2021-03", None),
    ("date_ym", "03/2021", "2021-03", None),
    ("date_ym", "Sept. 2019", "2019-09", None),
    ("date_ym", "2018", "2018", "year_only"),
    ("date_ym", "Present", None, "present"),
    ("country_iso2", "U.S.A.", "US", None),
    ("country_iso2", "deutschland", "DE", None),
    ("url_link", "www.GitHub.com/Ada/", "https://www.github.com/Ada", "github"),
    ("url_link", "http://x.org:80/a//?utm_Source=1&q=a%20b&ref=z#f", "https://x.org:80/a?q=a+b", "other"),
    ("url_link", "https://linkedin.com/in/ada?b&c=1", "https://linkedin.com/in/ada?b=&c=1", "linkedin"),
    ("skill_canonical", "k8s", "Kubernetes", None),
    ("skill_canonical", "COBOL", "COBOL", "non_canonical"),
    ("years_experience", "about 7.5 years", 7.5, None),
]
BAD = [
    ("text_unicode", " ​", "empty"), ("name", "''", "empty"), ("email", "a@b", "invalid_email"), ("email", "<mailto:a@b>", "invalid_email"), ("phone_e164", "call me", "unparseable_phone"),
    ("phone_e164", "111-111-1111", "invalid_phone"), ("phone_e164", "", "empty"), ("date_ym", "13/2020", "invalid_date"), ("date_ym", "1850", "invalid_date"), ("date_ym", "soon", "invalid_date"),
    ("country_iso2", "Narnia", "unknown_country"), ("country_iso2", " . ", "empty"), ("url_link", "no host", "invalid_url"), ("url_link", "http://[bad.x", "invalid_url"), ("url_link", "", "empty"),
    ("years_experience", "-3", "out_of_range"), ("years_experience", "many", "unparseable"), ("skill_canonical", "\t", "empty"), ("nope", "x", "unknown_normalizer:nope"),
]
GARBAGE = ["", " ", "\x00\x01", "​", "😀", "x" * 5000, "<b>&amp;</b>", "a\n\nb\r\n", "%%%", "://", None]


def outcomes(spark, which, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["r"] for r in df.select("i", N.normalize(which, F.col("x")).alias("r")).orderBy("i").collect()]


@pytest.mark.parametrize("which", [*N.REGISTRY, "nope"])
def test_tables(spark, which):
    good = [(raw, value, note) for w, raw, value, note in GOOD if w == which]
    bad = [(raw, note) for w, raw, note in BAD if w == which]
    got = outcomes(spark, which, [raw for raw, *_ in good + bad] or [""])
    for (raw, value, note), r in zip(good, got, strict=False):
        assert (r["value"], r["ok"], r["note"]) == (value, True, note), raw
    for (raw, note), r in zip(bad, got[len(good) :], strict=False):
        assert (r["value"], r["ok"], r["note"]) == (None, False, note), raw


@pytest.mark.parametrize("which", list(N.REGISTRY))
def test_total_and_idempotent(spark, which):
    got = outcomes(spark, which, GARBAGE)
    assert all(r["value"] is None for r in got if not r["ok"])
    once = [str(r["value"]) for r in outcomes(spark, which, [raw for w, raw, v, _ in GOOD if w == which]) if r["value"] is not None]
    again = [str(r["value"]) for r in outcomes(spark, which, once)]
    assert again == once


def test_composed(spark):
    assert spark.createDataFrame([("é",), ("a",), (None,)], "x string").select(N.composed(F.col("x"))).collect() == [("é",), ("a",), (None,)]


def test_confidence(spark):
    row = spark.range(1).select(claim_confidence(F.lit("resume"), F.lit("ner")).alias("a"), noisy_or(F.array(F.lit(0.9), F.lit(0.6))).alias("b"), noisy_or(F.array(F.lit(1.0))).alias("c")).first()
    assert row["a"] == 0.55 * 0.75 and row["b"] == 1 - (1 - 0.9) * (1 - 0.6) and row["c"] == 0.99
