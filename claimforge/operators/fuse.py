"""Fusion: the claims of an entity are normalized, weighed and merged into one profile with provenance.

Every claim becomes cells (cluster, field, part, value). Cells are aggregated by value, with a partial
aggregation before the shuffle, and then once by cluster; adjudication itself is array expressions on
that one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimforge.functions import normalize as N
from claimforge.functions.confidence import GATE, HIGH_TRUST, PENALTY, claim_confidence, mean, noisy_or, source_priority

SCALARS = ("full_name", "headline", "years_experience")
LISTS = ("emails", "phones", "skills")
FIELD_NORMALIZER = {"full_name": N.name, "emails": N.email, "phones": N.phone_e164, "skills": N.skill_canonical, "headline": N.text_unicode}
PARTS = {"location": ("city", "region", "country"), "links": ("linkedin", "github", "portfolio")}
#: Cell parts that stand for whole claims: good ones, and claims that entries come from or are put aside with.
WHOLE, DIRECT, PARSED = "*", "direct", "parsed"


def _text(x: Column) -> Column:
    return N.good(N.text_unicode(x))


def normalized_claims(claims: DataFrame) -> DataFrame:
    """Claims with n_* columns, ``normalize_ok``, ``confidence`` and ``priority``."""
    loc, links, exp, edu = (F.col(c) for c in ("v_loc", "v_links", "v_exp", "v_edu"))
    text = F.lit(None).cast("string")
    for field, f in FIELD_NORMALIZER.items():
        text = F.when(F.col("field") == field, N.good(f(F.col("v_str")))).otherwise(text)
    number = F.when(F.col("field") == "years_experience", F.coalesce(F.col("v_num"), N.good(N.years_experience(F.col("v_str")))))
    other = F.array_sort(F.array_distinct(F.array_compact(F.transform(F.coalesce(links["other"], F.array().cast("array<string>")), lambda u: N.good(N.url_link(u))))))
    url = lambda part: N.good(N.url_link(links[part])).alias(part)
    date = lambda part: N.good(N.date_ym(exp[part])).alias(part)
    shaped = claims.withColumns({
        "n_str": text,
        "n_num": number,
        "n_loc": F.when(loc.isNotNull(), F.struct(_text(loc["city"]).alias("city"), _text(loc["region"]).alias("region"), N.good(N.country_iso2(loc["country"])).alias("country"))),
        "n_links": F.when(links.isNotNull(), F.struct(url("linkedin"), url("github"), url("portfolio"), other.alias("other"))),
        "n_exp": F.when(exp.isNotNull(), F.struct(_text(exp["company"]).alias("company"), _text(exp["title"]).alias("title"), date("start"), date("end"), _text(exp["summary"]).alias("summary"))),
        "n_edu": F.when(edu.isNotNull(), F.struct(_text(edu["institution"]).alias("institution"), _text(edu["degree"]).alias("degree"), _text(edu["field"]).alias("field"), edu["end_year"].alias("end_year"))),
        "confidence": claim_confidence(F.col("source"), F.col("method")),
        "priority": source_priority(F.col("source"), F.col("method")),
    })
    some = lambda c, *parts: F.coalesce(*(F.col(f"{c}.{p}").cast("string") for p in parts)).isNotNull()
    ok = (
        F.when(F.col("field").isin(*SCALARS, *LISTS), F.coalesce(F.col("n_str"), F.col("n_num").cast("string")).isNotNull())
        .when(F.col("field") == "location", some("n_loc", *PARTS["location"]))
        .when(F.col("field") == "links", some("n_links", *PARTS["links"]) | (F.size("n_links.other") > 0))
        .when(F.col("field") == "experience", some("n_exp", "company", "title", "start", "end"))
        .when(F.col("field") == "education", some("n_edu", "institution", "degree", "field") | (F.coalesce(F.col("n_edu.end_year"), F.lit(0)) != 0))
        .otherwise(F.lit(True))
    )
    return shaped.withColumn("normalize_ok", F.coalesce(ok, F.lit(False)))


def _cell(part, value: Column, number: Column | None = None) -> Column:
    part = F.lit(part) if isinstance(part, str) else part
    return F.struct(part.alias("part"), value.cast("string").alias("value"), (F.lit(None) if number is None else number).cast("double").alias("number"))


def cells(claims: DataFrame) -> DataFrame:
    """One row per (cluster, field, part, value): its noisy-or score, priority, origins and, for entries, merged attributes."""
    field, ok = F.col("field"), F.col("normalize_ok")
    how = F.when(F.col("method") == "direct_map", F.lit(DIRECT)).otherwise(F.lit(PARSED))
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    entry = F.when(field == "experience", F.concat_ws("\x1f", low("n_exp.company"), low("n_exp.title")))
    entry = entry.when(field == "education", F.concat_ws("\x1f", low("n_edu.institution"), low("n_edu.degree"), F.coalesce(F.col("n_edu.end_year"), F.lit(0)).cast("string")))
    parts = lambda f, c: [_cell(p, F.col(f"{c}.{p}")) for p in PARTS[f]]
    none = F.array().cast("array<struct<part:string,value:string,number:double>>")
    made = (
        F.when(field == "years_experience", F.when(ok, F.array(_cell("", F.col("n_num"), F.col("n_num")))))
        .when(field.isin(*SCALARS, *LISTS), F.when(ok, F.array(_cell("", F.col("n_str")))))
        .when(field == "location", F.when(ok, F.array(*parts("location", "n_loc"), _cell(WHOLE, F.lit("")))))
        .when(field == "links", F.when(ok, F.concat(F.array(*parts("links", "n_links"), _cell(WHOLE, F.lit(""))), F.transform("n_links.other", lambda u: _cell("other", u)))))
        # A claim that isn't good still says how its field was found.
        .when(field.isin("experience", "education"), F.concat(F.array(_cell(F.concat(F.lit(WHOLE), how, F.when(ok, F.lit("+")).otherwise(F.lit("-"))), F.lit(""))), F.when(ok, F.array(_cell(how, entry))).otherwise(none)))
    )
    rows = claims.withColumn("order", F.struct("record_id", "claim_seq")).select("*", F.explode(made).alias("c")).where("c.value is not null")
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("order")))
    ordered = F.array_sort(F.collect_list(F.struct("order", "confidence")))
    return rows.groupBy("cluster_id", "field", F.col("c.part").alias("part"), F.col("c.value").alias("value")).agg(
        F.first("c.number").alias("number"),
        noisy_or(F.transform(ordered, lambda x: x["confidence"])).alias("score"),
        F.min("priority").alias("priority"),
        F.max("confidence").alias("most"),
        F.min("order").alias("order"),
        F.collect_set(F.struct("source", "method")).alias("origins"),
        F.struct(*(first(f"n_exp.{p}").alias(p) for p in ("company", "title", "start", "end", "summary"))).alias("exp"),
        F.struct(*(first(f"n_edu.{p}").alias(p) for p in ("institution", "degree", "field")), F.min_by("n_edu.end_year", "order").alias("end_year")).alias("edu"),
    )


def adjudicated(found: Column) -> Column:
    """``struct<value, number, confidence, withheld, winners, losers>`` of the cells of one scalar.

    The best score wins, then the better source, then the smaller text. A losing claim of high trust takes
    a fixed penalty off the winner, and what then stays under the gate is withheld.
    """
    ranked = F.array_sort(F.transform(found, lambda c: F.struct((-c["score"]).alias("s"), c["priority"].alias("p"), c["value"].alias("v"), c["number"].alias("n"), c["most"].alias("m"), c["origins"].alias("o"))))
    return N.let(ranked, _decided)


def _decided(ranked: Column) -> Column:
    best, rest = F.get(ranked, F.lit(0)), F.slice(ranked, 2, F.greatest(F.size(ranked), F.lit(1)))
    penalized = F.when(F.exists(rest, lambda c: c["m"] >= HIGH_TRUST), F.greatest(F.lit(0.0), -best["s"] - PENALTY)).otherwise(-best["s"])
    origins = lambda cells_: F.flatten(F.transform(cells_, lambda c: c["o"]))

    def outcome(score: Column) -> Column:
        withheld = F.coalesce(score < GATE, F.lit(False))
        return F.struct(
            F.when(~withheld, best["v"]).alias("value"),
            F.when(~withheld, best["n"]).alias("number"),
            F.coalesce(score, F.lit(0.0)).alias("confidence"),
            withheld.alias("withheld"),
            F.when(withheld | (F.size(ranked) == 0), F.slice(origins(ranked), 1, 0)).otherwise(best["o"]).alias("winners"),
            F.when(withheld, origins(ranked)).otherwise(origins(rest)).alias("losers"),
        )

    return N.let(penalized, outcome)


def _entries(kind: str, struct: str, sort_by: tuple[Column, ...], found: Column) -> Column:
    """Merged entries, last first; those that tie keep the order in which they were claimed."""
    keyed = F.transform(found, lambda c: F.struct(F.struct(*(F.coalesce(c[struct][k], F.lit(d)).alias(k) for k, d in sort_by)).alias("k"), c["order"].alias("o"), c[struct].alias("e")))
    after = lambda a, b: F.when(a["k"] > b["k"], -1).when(a["k"] < b["k"], 1).when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)
    return F.transform(F.array_sort(keyed, after), lambda x: x["e"])


def profiles(claims: DataFrame) -> DataFrame:
    """One canonical profile per cluster of claims (which have ``cluster_id``)."""
    grouped = cells(normalized_claims(claims)).groupBy("cluster_id").agg(F.collect_list(F.struct("field", "part", "value", "number", "score", "priority", "most", "order", "origins", "exp", "edu")).alias("cells"))
    everyone = claims.select("cluster_id").distinct().join(grouped, "cluster_id", "left")
    all_cells = F.coalesce(F.col("cells"), F.array().cast(grouped.schema["cells"].dataType))
    of = lambda field, part="": F.filter("cells", lambda c: (c["field"] == field) & (c["part"] == part))
    base = everyone.select("cluster_id", all_cells.alias("cells"))

    scalars = {f"{f}.{p}": (f, p) for f, ps in PARTS.items() for p in ps} | {f: (f, "") for f in SCALARS}
    decided = base.withColumns({"d_" + k.replace(".", "_"): adjudicated(of(*v)) for k, v in scalars.items()})
    by_value = lambda field: F.array_sort(F.transform(of(field), lambda c: F.struct(c["value"].alias("value"), c["score"].alias("score"), c["origins"].alias("origins"))))
    listed = decided.withColumns({f"l_{f}": by_value(f) for f in LISTS})
    values = lambda f: F.transform(f"l_{f}", lambda c: c["value"])
    sources = lambda c: F.array_sort(F.array_distinct(F.transform(c["origins"], lambda o: o["source"])))
    skills = F.transform("l_skills", lambda c: F.struct(c["value"].alias("name"), F.round(c["score"], 4).alias("confidence"), sources(c).alias("sources")))
    others = F.array_sort(F.transform(of("links", "other"), lambda c: c["value"]))
    direct = lambda field: F.exists("cells", lambda c: (c["field"] == field) & F.startswith(c["part"], F.lit(WHOLE + DIRECT)))
    entry_cells = lambda field: F.when(direct(field), of(field, DIRECT)).otherwise(of(field, PARSED))
    shaped = listed.withColumns({
        "full_name": F.col("d_full_name.value"),
        "emails": values("emails"),
        "phones": values("phones"),
        "location": F.struct(*(F.col(f"d_location_{p}.value").alias(p) for p in PARTS["location"])),
        "links": F.struct(*(F.col(f"d_links_{p}.value").alias(p) for p in PARTS["links"]), others.alias("other")),
        "headline": F.col("d_headline.value"),
        "years_experience": F.col("d_years_experience.number"),
        "skills": skills,
        "experience": _entries("experience", "exp", (("start", ""), ("company", ""), ("title", "")), entry_cells("experience")),
        "education": _entries("education", "edu", (("end_year", 0), ("institution", "")), entry_cells("education")),
    })
    part_mean = lambda f: mean(F.array_compact(F.array(*(F.when(F.col(f"d_{f}_{p}.value").isNotNull(), F.col(f"d_{f}_{p}.confidence")) for p in PARTS[f]))))
    scalar = lambda f, c: F.when(F.col(c).isNotNull(), F.col(f"d_{f}.confidence"))
    of_list = lambda f: F.when(F.size(f"l_{f}") > 0, mean(F.transform(f"l_{f}", lambda c: F.round(c["score"], 4) if f == "skills" else c["score"])))
    any_part = lambda f: F.coalesce(*(F.col(f"{f}.{p}") for p in PARTS[f])).isNotNull()
    present = F.array_compact(F.array(
        scalar("full_name", "full_name"), scalar("headline", "headline"), scalar("years_experience", "years_experience"),
        of_list("emails"), of_list("phones"), of_list("skills"),
        F.when(any_part("location"), part_mean("location")), F.when(any_part("links") | (F.size("links.other") > 0), part_mean("links")),
    ))
    done = shaped.withColumns({"provenance": _provenance(direct), "overall_confidence": F.round(mean(present), 4), "candidate_id": _candidate_id()})
    return done.select("cluster_id", "candidate_id", "full_name", "emails", "phones", "location", "links", "headline", "years_experience", "skills", "experience", "education", "provenance", "overall_confidence")


def _candidate_id() -> Column:
    """sha1 of the first e-mail, else of the smallest link, else of name and phones."""
    urls = F.array_sort(F.filter(F.concat(F.array(*(F.col(f"links.{p}") for p in PARTS["links"])), F.col("links.other")), lambda u: u.isNotNull()))
    rest = F.array_join(F.array_sort(F.array_compact(F.concat(F.array("full_name"), F.col("phones")))), "|")
    return F.sha1(F.coalesce(F.get("emails", F.lit(0)), F.get(urls, F.lit(0)), rest).cast("binary"))


def _provenance(direct) -> Column:
    def rows(field: str, origins: Column, note: str | None) -> Column:
        return F.transform(origins, lambda o: F.struct(F.lit(field).alias("field"), o["source"].alias("source"), o["method"].alias("method"), F.lit(note).cast("string").alias("note")))

    def origins(keep) -> Column:
        return F.flatten(F.transform(F.filter("cells", lambda c: keep(c)), lambda c: c["origins"]))

    out = []
    for f in SCALARS:
        d = F.col(f"d_{f}")
        out += [rows(f, d["winners"], None), F.when(d["withheld"], rows(f, d["losers"], "withheld_low_confidence")).otherwise(rows(f, d["losers"], "superseded"))]
    out += [rows(f, origins(lambda c, f=f: c["field"] == f), None) for f in LISTS]
    out += [rows(f, origins(lambda c, f=f: (c["field"] == f) & (c["part"] == WHOLE)), None) for f in PARTS]
    for f in ("experience", "education"):
        part = lambda c, f, p: (c["field"] == f) & F.startswith(c["part"], F.lit(WHOLE + p))
        good = F.when(direct(f), origins(lambda c, f=f: (c["field"] == f) & (c["part"] == WHOLE + DIRECT + "+"))).otherwise(origins(lambda c, f=f: (c["field"] == f) & (c["part"] == WHOLE + PARSED + "+")))
        aside = F.when(direct(f), origins(lambda c, f=f: part(c, f, PARSED)))
        out += [rows(f, good, None), F.coalesce(rows(f, aside, "superseded"), F.slice(rows(f, good, None), 1, 0))]
    return F.array_sort(F.array_distinct(F.concat(*out)), lambda a, b: _by_text(a, b))


def _by_text(a: Column, b: Column) -> Column:
    """By field, source and method, then the note with none first."""
    key = lambda x: F.struct(x["field"], x["source"], x["method"], F.coalesce(x["note"], F.lit("")))
    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)
