"""Queries over the driver's tables, with SQL that says the same.

The tables hold no candidate records, so :func:`bridge_claims` makes claims of them by fixed rules: customers are
structured exports, their first orders are documents, event users are remote profiles; they meet by e-mail.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimforge.functions import normalize as N
from claimforge.functions.confidence import claim_confidence, source_priority
from claimforge.operators.fuse import adjudicated, cells, normalized_claims, profiles
from claimforge.operators.resolve import claim_keys, cluster, cluster_records
from claimforge.operators.storage import scratch_path
from claimforge.plans.config import Config, FieldSpec, OnMissing
from claimforge.plans.project import project, project_columns
from claimforge.sources.claims import EDUCATION, EXPERIENCE, LINKS, LOCATION
from claimforge.sources.route import claims_of, extracted, routed
from claimforge.streaming import ledger


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _claim(field: str, source: str, method: str, **value):
    null = lambda kind: F.lit(None).cast(kind)
    kinds = {"v_str": "string", "v_num": "double", "v_loc": LOCATION, "v_links": LINKS, "v_exp": EXPERIENCE, "v_edu": EDUCATION}
    cols = [(value[k].cast(t) if k in value else null(t)).alias(k) for k, t in kinds.items()]
    return F.struct(F.lit(field).alias("field"), F.lit(source).alias("source"), F.lit(method).alias("method"), null("string").alias("raw"), *cols)


def _rows(df: DataFrame, record, *claims) -> DataFrame:
    return df.select(record.cast("long").alias("record_id"), F.posexplode(F.array(*claims)).alias("claim_seq", "c")).select("record_id", "claim_seq", "c.*")


def bridge_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims table of a scale."""
    mail = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com"))
    customers = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("mail", mail)
    none = F.lit(None).cast("string")
    ats = _rows(
        customers, F.col("c_custkey") * 10,
        _claim("full_name", "ats", "direct_map", v_str=F.col("c_name")),
        _claim("emails", "ats", "direct_map", v_str=F.col("mail")),
        _claim("skills", "ats", "direct_map", v_str=F.lower("c_mktsegment")),
        _claim("location", "ats", "direct_map", v_loc=F.struct(F.col("n_name"), F.col("r_name"), F.col("n_name"))),
        _claim("years_experience", "ats", "direct_map", v_str=F.concat(F.floor(F.abs("c_acctbal") / 200).cast("string"), F.lit(" years"))),
    )
    first = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.struct("o_orderkey", "o_orderdate", "o_orderpriority")).alias("o"))
    buyers = customers.join(first, F.col("c_custkey") == F.col("o_custkey"))
    job = F.struct(F.col("o.o_orderpriority"), F.lit("Clerk"), F.date_format("o.o_orderdate", "MM/yyyy"), F.lit("Present"), none)
    resume = _rows(
        buyers, F.col("c_custkey") * 10 + 1,
        _claim("full_name", "resume", "structured_parse", v_str=F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit(" Jr"))).otherwise(F.col("c_name"))),
        _claim("emails", "resume", "structured_parse", v_str=F.concat(F.lit("  "), F.upper("mail"))),
        _claim("skills", "resume", "structured_parse", v_str=F.when(F.col("c_custkey") % 2 == 0, F.lit("py")).otherwise(F.lower("c_mktsegment"))),
        _claim("experience", "resume", "structured_parse", v_exp=job),
    )
    events = _t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    users = events.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "event_type")).alias("e"))
    people = users.join(customers, F.col("user_id") == F.col("c_custkey"))
    profile = F.struct(none, F.concat(F.lit("github.com/User"), F.col("user_id"), F.lit("/?utm_source=x")), none, F.array().cast("array<string>"))
    github = _rows(
        people, F.col("user_id") * 10 + 2,
        _claim("emails", "github", "direct_map", v_str=F.concat(F.lit("mailto:"), F.col("mail"))),
        _claim("headline", "github", "direct_map", v_str=F.concat(F.lit(" "), F.col("e.event_type"))),
        _claim("links", "github", "direct_map", v_links=profile),
    )
    return ats.unionByName(resume).unionByName(github)


# One CTE for the bridge: claims with normalized values, confidence and priority, in their clusters.
BRIDGE = """
c AS (SELECT c_custkey AS k, c_name, c_mktsegment, c_acctbal, n_name, r_name, lower(replace(c_name, '#', '.')) || '@example.com' AS mail
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
o AS (SELECT o_custkey AS k, arg_min(o_orderdate, o_orderkey) AS d, arg_min(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1),
e AS (SELECT user_id AS k, arg_min(event_type, (-n, event_type)) AS t FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1),
countries(n, iso) AS (VALUES ('UNITED STATES', 'US'), ('UNITED KINGDOM', 'GB'), ('INDIA', 'IN'), ('CANADA', 'CA'), ('GERMANY', 'DE'), ('FRANCE', 'FR'), ('JAPAN', 'JP'), ('CHINA', 'CN'), ('BRAZIL', 'BR')),
ats AS (SELECT c.*, iso FROM c LEFT JOIN countries ON n_name = n),
claims AS (
  SELECT k * 10 AS record_id, 'full_name' AS field, '' AS part, c_name AS value, 'ats' AS source, 'direct_map' AS method, 0.9::DOUBLE AS conf, 0 AS prio, k FROM ats
  UNION ALL SELECT k * 10, 'emails', '', mail, 'ats', 'direct_map', 0.9, 0, k FROM ats
  UNION ALL SELECT k * 10, 'skills', '', lower(c_mktsegment), 'ats', 'direct_map', 0.9, 0, k FROM ats
  UNION ALL SELECT k * 10, 'location', 'city', n_name, 'ats', 'direct_map', 0.9, 0, k FROM ats
  UNION ALL SELECT k * 10, 'location', 'region', r_name, 'ats', 'direct_map', 0.9, 0, k FROM ats
  UNION ALL SELECT k * 10, 'location', 'country', iso, 'ats', 'direct_map', 0.9, 0, k FROM ats WHERE iso IS NOT NULL
  UNION ALL SELECT k * 10, 'years_experience', '', (floor(abs(c_acctbal) / 200)::DOUBLE)::VARCHAR, 'ats', 'direct_map', 0.9, 0, k FROM ats WHERE floor(abs(c_acctbal) / 200) <= 80
  UNION ALL SELECT k * 10 + 1, 'full_name', '', CASE WHEN k % 3 = 0 THEN c_name || ' Jr' ELSE c_name END, 'resume', 'structured_parse', 0.75::DOUBLE * 0.8::DOUBLE, 2, k FROM c JOIN o USING (k)
  UNION ALL SELECT k * 10 + 1, 'emails', '', mail, 'resume', 'structured_parse', 0.75::DOUBLE * 0.8::DOUBLE, 2, k FROM c JOIN o USING (k)
  UNION ALL SELECT k * 10 + 1, 'skills', '', CASE WHEN k % 2 = 0 THEN 'Python' ELSE lower(c_mktsegment) END, 'resume', 'structured_parse', 0.75::DOUBLE * 0.8::DOUBLE, 2, k FROM c JOIN o USING (k)
  UNION ALL SELECT k * 10 + 2, 'emails', '', mail, 'github', 'direct_map', 0.7, 1, k FROM c JOIN e USING (k)
  UNION ALL SELECT k * 10 + 2, 'headline', '', t, 'github', 'direct_map', 0.7, 1, k FROM c JOIN e USING (k)
  UNION ALL SELECT k * 10 + 2, 'links', 'github', 'https://github.com/User' || k, 'github', 'direct_map', 0.7, 1, k FROM c JOIN e USING (k)),
clustered AS (SELECT *, min(record_id) OVER (PARTITION BY k) AS cluster_id FROM claims),
cell AS (
  SELECT cluster_id, field, part, value, least(0.99, 1 - product(1 - conf)) AS score, min(prio) AS prio, max(conf) AS most
  FROM clustered GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER w AS rn, max(most) OVER (PARTITION BY cluster_id, field, part ORDER BY round(score, 12) DESC, prio, value ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rival
  FROM cell WINDOW w AS (PARTITION BY cluster_id, field, part ORDER BY round(score, 12) DESC, prio, value)),
won AS (
  SELECT cluster_id, field, part, value, CASE WHEN rival >= 0.7 THEN greatest(0, score - 0.1) ELSE score END AS score FROM ranked WHERE rn = 1),
kept AS (SELECT * FROM won WHERE score >= 0.5)
"""

CONFIG = Config(
    (
        FieldSpec("name", "string", "full_name", required=True),
        FieldSpec("mail", "string", "emails[0]"),
        FieldSpec("skill_names", "string[]", "skills[].name", normalize="canonical"),
        FieldSpec("country", "string", "location.country"),
        FieldSpec("years", "number", "years_experience"),
        FieldSpec("twitter", "string", "links.other[0]", required=True),
        FieldSpec("headline", "integer"),
    ),
    include_confidence=True,
)
PER_CLUSTER = """
p AS (
  SELECT r.cluster_id,
    max(value) FILTER (field = 'full_name') AS name, max(value) FILTER (field = 'headline') AS headline, max(value) FILTER (part = 'country') AS country,
    max(value) FILTER (field = 'years_experience') AS years
  FROM (SELECT DISTINCT cluster_id FROM clustered) r LEFT JOIN kept USING (cluster_id) GROUP BY 1),
mails AS (SELECT cluster_id, min(value) AS mail FROM cell WHERE field = 'emails' GROUP BY 1),
skill AS (SELECT cluster_id, string_agg(value, ',' ORDER BY value) AS skills FROM cell WHERE field = 'skills' GROUP BY 1)
"""


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(cluster(bridge_claims(spark, sf_dir)))


def _normalized(df: DataFrame, key, result) -> DataFrame:
    return df.select(key, result.alias("r")).select(key, F.col("r.value").alias("value"), F.col("r.ok").alias("ok"), F.col("r.note").alias("note"))


def norm_text_unicode(spark, sf_dir):
    r = _normalized(_t(spark, sf_dir, "documents"), "doc_id", N.text_unicode(N.composed(F.col("text"))))
    return r.select("doc_id", F.md5("value").alias("value_md5"), "ok", "note")


def norm_name(spark, sf_dir):
    return _normalized(_t(spark, sf_dir, "customer"), "c_custkey", N.name(F.concat(F.lit(" \"'"), F.col("c_name"), F.lit("\t  x'"))))


def norm_email(spark, sf_dir):
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("MAILTO:"), F.replace("c_name", F.lit("#"), F.lit("@")), F.lit(".Org"))).otherwise(F.concat(F.lit("<"), F.col("c_name"), F.lit("@x.io>")))
    return _normalized(_t(spark, sf_dir, "customer"), "c_custkey", N.email(F.when(F.col("c_custkey") % 7 == 0, F.col("c_name")).otherwise(raw)))


def norm_phone_e164(spark, sf_dir):
    raw = F.format_string("(%03d) %03d-%04d", F.col("c_custkey") % 900 + 100, (F.col("c_custkey") * 7) % 900 + 100, (F.col("c_custkey") * 13) % 10000)
    return _normalized(_t(spark, sf_dir, "customer"), "c_custkey", N.phone_e164(raw))


def norm_date_ym(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    raw = F.when(k == 0, F.date_format(d, "yyyy-M")).when(k == 1, F.date_format(d, "M/yyyy")).when(k == 2, F.date_format(d, "MMMM yyyy")).when(k == 3, F.date_format(d, "yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    return _normalized(_t(spark, sf_dir, "orders"), "o_orderkey", N.date_ym(raw))


def norm_years(spark, sf_dir):
    return _normalized(_t(spark, sf_dir, "supplier"), "s_suppkey", N.years_experience(F.concat(F.floor(F.col("s_acctbal") / 50).cast("string"), F.lit(" yrs"))))


def norm_country(spark, sf_dir):
    return _normalized(_t(spark, sf_dir, "nation"), "n_nationkey", N.country_iso2(F.col("n_name")))


def norm_skill(spark, sf_dir):
    return _normalized(_t(spark, sf_dir, "part"), "p_partkey", N.skill_canonical(F.when(F.col("p_partkey") % 3 == 0, F.lit(" k8s ")).otherwise(F.col("p_brand"))))


def norm_url_link(spark, sf_dir):
    return _normalized(_t(spark, sf_dir, "pages"), "page_id", N.url_link(F.col("url")))


def extract_contacts(spark, sf_dir):
    text = F.col("text")
    mails = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"), F.lit(0))
    numbers = F.filter(F.regexp_extract_all(text, F.lit(r"\+?\(?[0-9][0-9\s().\-]{7,}[0-9]"), F.lit(0)), lambda x: F.length(F.regexp_replace(x, "[^0-9]", "")) >= 10)
    years = F.regexp_extract(text, r"(?i)[0-9]+(?:\.[0-9]+)?\+?\s*years?(?:\s+of\s+experience)?", 0)
    link = F.rtrim(F.regexp_extract(text, r"(?i)(?:https?://)?(?:www\.)?github\.com/\S+", 0), F.lit("|,. "))
    return _t(spark, sf_dir, "documents").select("doc_id", F.array_join(mails, ",").alias("emails"), F.array_join(numbers, ",").alias("phones"), years.alias("years"), link.alias("github"))


def resume_document_claims(spark, sf_dir):
    """Claims of every document read as free text, by field and method."""
    files = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.lit("d.txt").alias("path"), F.col("text").cast("binary").alias("content"))
    return claims_of(extracted(files)).groupBy("record_id", "field", "method").agg(F.count("*").alias("n"))


def _exports(spark, sf_dir) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    whole = F.struct(F.col("c_name").alias("ApplicantName"), F.struct(F.concat("c_custkey", F.lit("@x.org")).alias("Email"), F.lit("https://www.LinkedIn.com/in/a/?ref=z").alias("Socials")).alias("ContactInfo"), F.array("c_mktsegment").alias("SystemTags"), F.array(F.struct(F.lit("Acme").alias("EmployerName"), F.lit("01/2020").alias("StartDate"))).alias("EmploymentHistory"))
    content = F.when(F.col("c_custkey") % 10 == 9, F.concat(F.to_json(whole), F.lit(" trailing"))).otherwise(F.to_json(whole))
    return c.select(F.col("c_custkey").alias("record_id"), F.lit("export.json").alias("path"), content.cast("binary").alias("content"))


def structured_source_claims(spark, sf_dir):
    claims = claims_of(extracted(_exports(spark, sf_dir)))
    value = F.coalesce("v_str", "v_links.linkedin", F.concat_ws("|", "v_exp.company", "v_exp.start"))
    return claims.select("record_id", "claim_seq", "field", "source", "method", value.alias("value"))


def quarantine_bad_json(spark, sf_dir):
    return extracted(_exports(spark, sf_dir)).where("error is not null").select("record_id", "source", F.regexp_extract("error", r"^(\w+):", 1).alias("kind"))


def route_sources(spark, sf_dir):
    ending = F.element_at(F.array(*(F.lit(x) for x in (".JSON", ".txt", ".github", ".pdf", ".docx", ".csv", ""))), (F.col("page_id") % 7 + 1).cast("int"))
    return routed(_t(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("in/f"), F.col("page_id"), ending).alias("path"))).select("page_id", "adapter")


def claim_confidences(spark, sf_dir):
    pairs = spark.sql("SELECT * FROM VALUES ('ats','direct_map'),('github','direct_map'),('resume','structured_parse'),('resume','regex_prose'),('resume','ner'),('notes','regex_prose') AS t(source, method)")
    return pairs.select("source", "method", F.round(claim_confidence(F.col("source"), F.col("method")), 6).alias("confidence"), source_priority(F.col("source"), F.col("method")).alias("priority"))


def claim_key_records(spark, sf_dir):
    return claim_keys(bridge_claims(spark, sf_dir))


def cluster_assignment(spark, sf_dir):
    claims = bridge_claims(spark, sf_dir)
    return cluster_records(claim_keys(claims), claims)


def cluster_page_urls(spark, sf_dir):
    """Pages that differ by tracking, fragment or scheme alone are one."""
    url = N.url_link(F.col("url"))
    pages = _t(spark, sf_dir, "pages").select(F.col("page_id").alias("record_id"), F.when(url["ok"], url["value"]).alias("key")).withColumn("kind", F.lit("url"))
    return cluster_records(pages.where("key is not null"), pages)


def fused_cells(spark, sf_dir):
    """Noisy-or scores of every value."""
    c = cells(normalized_claims(cluster(bridge_claims(spark, sf_dir)))).where(~F.col("field").isin("experience", "education") & (F.col("part") != "*"))
    return c.select("cluster_id", "field", "part", "value", F.round("score", 6).alias("score"), "priority")


def scalar_adjudication(spark, sf_dir):
    """Winners of the scalar fields after penalty and gate."""
    c = cells(normalized_claims(cluster(bridge_claims(spark, sf_dir)))).where(F.col("field").isin("full_name", "headline"))
    grouped = c.groupBy("cluster_id", "field").agg(F.collect_list(F.struct("value", "number", "score", "priority", "most", "origins")).alias("cells"))
    d = grouped.withColumn("d", adjudicated(F.col("cells")))
    return d.select("cluster_id", "field", F.col("d.value").alias("value"), F.round("d.confidence", 6).alias("confidence"), F.col("d.withheld").alias("withheld"))


def canonical_profile(spark, sf_dir):
    p = _profiles(spark, sf_dir)
    return p.select(
        "cluster_id", "candidate_id", "full_name", F.array_join("emails", ",").alias("emails"), "headline", "years_experience", F.col("location.city").alias("city"), F.col("location.country").alias("country"),
        F.col("links.github").alias("github"), F.array_join(F.transform("skills", lambda s: F.concat(s["name"], F.lit("="), s["confidence"].cast("string"))), ",").alias("skills"),
        F.get("experience", F.lit(0))["company"].alias("company"), F.get("experience", F.lit(0))["start"].alias("start"), F.size("provenance").alias("n_provenance"), "overall_confidence",
    )


def project_view(spark, sf_dir):
    out = project_columns(_profiles(spark, sf_dir), CONFIG, ("cluster_id",))
    return out.withColumn("skill_names", F.array_join("skill_names", ","))


def _policy(policy: OnMissing):
    def run(spark, sf_dir):
        fields = tuple(FieldSpec(f.path, f.type, f.from_, False if f.path == "twitter" else f.required, None if f.path == "skill_names" else f.normalize) for f in CONFIG.fields if f.path in ("name", "country", "twitter", "skill_names"))
        v = project(_profiles(spark, sf_dir), Config(fields, on_missing=policy), ("cluster_id",))
        return v.select("cluster_id", F.to_json("values").alias("vals"), F.array_join(F.transform("violations", lambda x: F.concat(x["path"], F.lit(":"), x["reason"])), ",").alias("violations"))

    return run


def project_violations(spark, sf_dir):
    v = project(_profiles(spark, sf_dir), CONFIG, ("cluster_id",)).select("cluster_id", F.posexplode("violations").alias("place", "v"))
    return v.select("cluster_id", "place", "v.path", "v.reason", "v.detail")


def run_summary(spark, sf_dir):
    return _profiles(spark, sf_dir).agg(F.count("*").alias("profiles"), F.round(F.avg("overall_confidence"), 6).alias("mean_confidence"))


def ledger_append(spark, sf_dir):
    """The bridge's claims after two batches and a stream were appended to a ledger."""
    path, copied, marks = (scratch_path(spark, n) for n in ("ledger", "ledger-copy", "ledger-marks"))
    claims = bridge_claims(spark, sf_dir)
    ledger.append(claims.where("source = 'ats'"), path)
    ledger.append(claims.where("source <> 'ats'"), path)
    ledger.follow(spark.readStream.schema(ledger.TABLE).parquet(path), copied, marks).awaitTermination()
    return ledger.read(spark, copied).groupBy("field", "source").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        norm_text_unicode, norm_name, norm_email, norm_phone_e164, norm_date_ym, norm_years, norm_country, norm_skill, norm_url_link, extract_contacts, resume_document_claims, structured_source_claims,
        quarantine_bad_json, route_sources, claim_confidences, claim_key_records, cluster_assignment, cluster_page_urls, fused_cells, scalar_adjudication, canonical_profile, project_view,
        project_violations, run_summary, ledger_append,
    )
} | {f"project_on_missing_{p}": _policy(p) for p in OnMissing}

_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _clean(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({x}, '{_WS}', ' ', 'g'), '\p{{C}}', '', 'g'), ' +', ' ', 'g'))"


SQL = {
    "norm_text_unicode": f"SELECT doc_id, CASE WHEN v <> '' THEN md5(v) END AS value_md5, coalesce(v <> '', false) AS ok, CASE WHEN coalesce(v, '') = '' THEN 'empty' END AS note FROM (SELECT doc_id, {_clean('nfc_normalize(text)')} AS v FROM documents)",
    "norm_name": "SELECT c_custkey, c_name || ' x' AS value, true AS ok, NULL::VARCHAR AS note FROM customer",
    "norm_email": """SELECT c_custkey, CASE WHEN ok THEN v END AS value, ok, CASE WHEN NOT ok THEN 'invalid_email' END AS note FROM (
  SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN lower(c_name) WHEN c_custkey % 3 = 0 THEN lower(replace(c_name, '#', '@')) || '.org' ELSE lower(c_name) || '@x.io' END AS v, regexp_matches(v, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') AS ok FROM customer)""".replace("\\\\", "\\"),
    "norm_phone_e164": """SELECT c_custkey, CASE WHEN ok THEN '+1' || d END AS value, ok, CASE WHEN NOT ok THEN 'invalid_phone' END AS note FROM (
  SELECT c_custkey, printf('%03d%03d%04d', c_custkey % 900 + 100, (c_custkey * 7) % 900 + 100, (c_custkey * 13) % 10000) AS d, regexp_matches(d, '^[2-9][0-9]{2}[2-9][0-9]{6}$') AS ok FROM customer)""",
    "norm_date_ym": """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL WHEN 3 THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y-%m') END AS value, o_orderkey % 5 <> 4 AS ok,
  CASE o_orderkey % 5 WHEN 3 THEN 'year_only' WHEN 4 THEN 'invalid_date' END AS note FROM orders""",
    "norm_years": """SELECT s_suppkey, CASE WHEN v BETWEEN 0 AND 80 THEN v END AS value, v BETWEEN 0 AND 80 AS ok, CASE WHEN NOT v BETWEEN 0 AND 80 THEN 'out_of_range' END AS note FROM (SELECT s_suppkey, floor(s_acctbal / 50)::DOUBLE AS v FROM supplier)""",
    "norm_country": """WITH t(n, iso) AS (VALUES ('UNITED STATES', 'US'), ('UNITED KINGDOM', 'GB'), ('INDIA', 'IN'), ('CANADA', 'CA'), ('GERMANY', 'DE'), ('FRANCE', 'FR'), ('JAPAN', 'JP'), ('CHINA', 'CN'), ('BRAZIL', 'BR'))
SELECT n_nationkey, iso AS value, iso IS NOT NULL AS ok, CASE WHEN iso IS NULL THEN 'unknown_country' END AS note FROM nation LEFT JOIN t ON n_name = n""",
    "norm_skill": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Kubernetes' ELSE p_brand END AS value, true AS ok, CASE WHEN p_partkey % 3 <> 0 THEN 'non_canonical' END AS note FROM part",
    "norm_url_link": r"""SELECT page_id, 'https://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || rtrim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/') || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS value, true AS ok, 'other' AS note
FROM (SELECT *, list_aggregate(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT p LIKE 'utm\_%' ESCAPE '\' AND NOT p LIKE 'ref=%'), 'string_agg', '&') AS q0, coalesce(q0, '') AS q FROM pages)""",
    "extract_contacts": r"""SELECT doc_id, array_to_string(regexp_extract_all(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}'), ',') AS emails,
  array_to_string(list_filter(regexp_extract_all(text, '\+?\(?[0-9][0-9\s().\-]{7,}[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) >= 10), ',') AS phones,
  regexp_extract(text, '(?i)[0-9]+(?:\.[0-9]+)?\+?\s*years?(?:\s+of\s+experience)?') AS years, rtrim(regexp_extract(text, '(?i)(?:https?://)?(?:www\.)?github\.com/\S+'), '|,. ') AS github FROM documents""",
    "structured_source_claims": """SELECT c_custkey AS record_id, i AS claim_seq, f AS field, 'ats' AS source, 'direct_map' AS method,
  CASE i WHEN 0 THEN c_name WHEN 1 THEN c_custkey || '@x.org' WHEN 2 THEN c_mktsegment WHEN 3 THEN 'https://www.linkedin.com/in/a' ELSE 'Acme|01/2020' END AS value
FROM customer, (VALUES (0, 'full_name'), (1, 'emails'), (2, 'skills'), (3, 'links'), (4, 'experience')) t(i, f) WHERE c_custkey % 10 <> 9""",
    "quarantine_bad_json": "SELECT c_custkey AS record_id, 'ats' AS source, 'JSONDecodeError' AS kind FROM customer WHERE c_custkey % 10 = 9",
    "route_sources": "SELECT page_id, CASE page_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 2 END AS adapter FROM pages",
    "claim_confidences": "SELECT * FROM (VALUES ('ats','direct_map',0.9::DOUBLE,0),('github','direct_map',0.7::DOUBLE,1),('resume','structured_parse',0.6::DOUBLE,2),('resume','regex_prose',0.33::DOUBLE,3),('resume','ner',0.4125::DOUBLE,3),('notes','regex_prose',0.24::DOUBLE,4)) t(source, method, confidence, priority)",
    "claim_key_records": f"WITH {BRIDGE} SELECT DISTINCT record_id, CASE field WHEN 'emails' THEN 'email' ELSE 'url' END AS kind, value AS key FROM claims WHERE field IN ('emails', 'links')",
    "cluster_assignment": f"WITH {BRIDGE} SELECT DISTINCT record_id, cluster_id FROM clustered",
    "cluster_page_urls": None,
    "fused_cells": f"WITH {BRIDGE} SELECT cluster_id, field, part, value, round(score, 6) AS score, prio AS priority FROM cell",
    "scalar_adjudication": f"WITH {BRIDGE} SELECT cluster_id, field, CASE WHEN score >= 0.5 THEN value END AS value, round(score, 6) AS confidence, score < 0.5 AS withheld FROM won WHERE field IN ('full_name', 'headline')",
    "canonical_profile": f"""WITH {BRIDGE}, {PER_CLUSTER},
scores AS (
  SELECT cluster_id, 1 AS n, score AS s FROM kept WHERE field IN ('full_name', 'headline', 'years_experience')
  UNION ALL SELECT cluster_id, 1, avg(CASE WHEN field = 'skills' THEN round(score, 4) ELSE score END) FROM cell WHERE field IN ('emails', 'skills') GROUP BY cluster_id, field
  UNION ALL SELECT cluster_id, 1, avg(score) FROM kept WHERE field IN ('location', 'links') GROUP BY cluster_id, field),
overall AS (SELECT cluster_id, round(avg(s), 4) AS overall_confidence FROM scores GROUP BY 1),
sk AS (SELECT cluster_id, string_agg(value || '=' || round(score, 4)::DOUBLE::VARCHAR, ',' ORDER BY value) AS skills FROM cell WHERE field = 'skills' GROUP BY 1),
prov AS (
  SELECT cluster_id, count(DISTINCT (field, source, method, note)) AS n FROM (
    SELECT c.cluster_id, c.field, c.source, c.method, CASE WHEN c.field IN ('full_name', 'headline', 'years_experience') AND c.value <> w.value THEN 'superseded' ELSE '' END AS note
    FROM clustered c JOIN won w USING (cluster_id, field, part)
    UNION ALL SELECT k * 10, 'experience', 'resume', 'structured_parse', '' FROM c JOIN o USING (k)) GROUP BY 1)
SELECT p.cluster_id, sha1(mails.mail) AS candidate_id, p.name AS full_name, mails.mail AS emails, p.headline, p.years::DOUBLE AS years_experience, c.n_name AS city, p.country, g.value AS github, sk.skills,
  o.p AS company, strftime(o.d, '%Y-%m') AS start, prov.n::INT AS n_provenance, overall_confidence
FROM p JOIN mails USING (cluster_id) JOIN sk USING (cluster_id) JOIN overall USING (cluster_id) JOIN prov USING (cluster_id) JOIN c ON p.cluster_id = c.k * 10 LEFT JOIN o ON o.k = c.k
LEFT JOIN kept g ON g.cluster_id = p.cluster_id AND g.field = 'links'""",
    "project_view": f"WITH {BRIDGE}, {PER_CLUSTER} SELECT cluster_id, name, mail, skills AS skill_names, country, years::DOUBLE AS years, NULL::VARCHAR AS twitter, headline FROM p JOIN mails USING (cluster_id) JOIN skill USING (cluster_id)",
    "project_violations": f"""WITH {BRIDGE}, {PER_CLUSTER}
SELECT cluster_id, 0 AS place, 'twitter' AS path, 'missing_required' AS reason, 'links.other[0]' AS detail FROM p
UNION ALL SELECT cluster_id, 1, 'twitter', 'missing_required', NULL FROM p
UNION ALL SELECT cluster_id, 2, 'headline', 'type_mismatch', 'integer' FROM p WHERE headline IS NOT NULL""",
    "run_summary": None,
    "ledger_append": None,
}
for _name, _null, _tw in (("null", "'null'", ',"twitter":null'), ("omit", None, ""), ("error", None, "")):
    _country = f""",'"country":' || coalesce('"' || country || '"', {_null})""" if _null else """, '"country":"' || country || '"'"""
    _skills = """'"skill_names":["' || replace(skills, ',', '","') || '"]'"""
    _wrong = "CASE WHEN country IS NULL THEN 'country:missing,' ELSE '' END || 'twitter:missing'" if _name == "error" else "''"
    SQL[f"project_on_missing_{_name}"] = f"""WITH {BRIDGE}, {PER_CLUSTER}
SELECT cluster_id, '{{' || concat_ws(','{_country}, '"name":"' || name || '"', {_skills}) || '{_tw}}}' AS vals, {_wrong} AS violations FROM p JOIN skill USING (cluster_id)"""
SQL["run_summary"] = "WITH x AS (" + SQL["canonical_profile"] + ") SELECT count(*) AS profiles, round(avg(overall_confidence), 6) AS mean_confidence FROM x"
SQL["ledger_append"] = f"""WITH {BRIDGE} SELECT field, source, count(DISTINCT record_id) AS n FROM claims GROUP BY 1, 2 UNION ALL SELECT 'experience', 'resume', count(*) FROM c JOIN o USING (k)"""
SQL["cluster_page_urls"] = "WITH u AS (" + SQL["norm_url_link"] + ") SELECT page_id AS record_id, min(page_id) OVER (PARTITION BY value) AS cluster_id FROM u"
