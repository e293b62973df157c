import math
import re

import duckdb
import numpy as np
import pytest

from claimforge.llm import knn, quality
from claimforge.llm import license as L

VECTORS = "vec_id long, embedding array<float>, label int, score double"


@pytest.mark.parametrize("k", [1, 10])
def test_nearest_is_exact(spark, k):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[100:160] = x[0]
    rows = [(i, [float(v) for v in x[i]], 1, 0.0) for i in range(700)] + [(1000, None, 1, 0.0), (1100, [0.0] * 16, 1, 0.0), (1200, [float("nan")] + [1.0] * 15, 1, 0.0), (1300, [None] + [1.0] * 15, 1, 0.0), (1400, [1.0, 2.0], 1, 0.0), (None, [1.0] * 16, 1, 0.0), (5, [float(v) for v in x[5]], 1, 0.0)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = {}
    for r in knn.nearest(df, df.where("vec_id % 50 = 0"), k=k).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids = np.array([*range(700), 5])
    y = x[ids].astype(np.float64)
    assert set(got) == set(range(0, 700, 50))
    for q, rows in got.items():
        far = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, far)) if ids[i] != q][:k]
        assert [(r, v) for r, v, _ in sorted(rows)] == [(n + 1, int(ids[i])) for n, i in enumerate(order)]
        assert [s for *_, s in sorted(rows)] == [far[i] for i in order]
    none = spark.createDataFrame([], VECTORS)
    assert knn.nearest(none, none).count() == 0


def test_nearest_of_repeated_queries_and_extreme_vectors(spark):
    rows = [(1, None), (1, [1.0, 0.0]), (1, [float("nan"), 0.0]), (2, [1e200, 0.0]), (3, [0.0, 1e200]), (4, [1.5, 0.0]), (5, [1e-200, 0.0]), (6, [3e-200, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in sorted(knn.nearest(table, table, k=2).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    good = {i: v for i, v in rows if v and not any(x != x for x in v)}
    assert got.keys() == good.keys()
    for i, v in good.items():
        far = sorted((math.dist(v, w), j) for j, w in good.items() if j != i)[:2]
        assert [j for j, _ in got[i]] == [j for _, j in far]
        assert all(math.isclose(s, d, rel_tol=1e-12) for (_, s), (d, _) in zip(got[i], far, strict=True))


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0], 0, 0.0), (100, [4.0], 0, 0.0), (1, [2.0], 0, 0.0)], VECTORS)
    assert sorted(tuple(r) for r in knn.nearest(df, df.where("vec_id % 100 = 0")).collect()) == [(0, 1, 1, 1.0), (0, 2, 100, 3.0), (100, 1, 1, 2.0), (100, 2, 0, 3.0)]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def scan(text):
    """The whole scan, one text and one rule at a time."""
    w = words(text)
    base = [(i, label) for p, label in L.BASE_PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    norm = " " + " ".join(w) + " " if w else " "
    found = []
    for r in L.rules():
        if r.keyword in norm:
            found += [(m.start(), -m.end(), r.priority, r.label, r.confidence) for m in re.finditer(f"(?<= )(?:{r.regex})(?= )", norm)]
    kept, far = [], 0
    for f in sorted(found):
        if -f[1] > far:
            kept.append(f)
            far = -f[1]
    labels = {label for _, label in base}
    starts = [i for i, _ in base]
    return len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {f[3] for f in kept})), max([f[4] for f in kept] + [0.9 if base else 0.0])


TEXTS = [
    None, "", "...", "MIT License", "the mit  license, the MIT-License; GNU General Public License v3.0 or later", "general public license version 2 or (at your option) any later version", "Licensed under CC BY-NC 4.0.", "gplv3 x GPL-2.0",
    "Creative Commons Attribution-ShareAlike 3.0 Unported license", "apache license apache license 2.0 apache license", "submit license", "mit licenses", "permission is hereby granted, free of charge, to any person obtaining a copy", "bsd 3-clause; BSD license",
    "SPDX-License-Identifier: Apache-2.0", "released into the public domain", "All rights reserved", "éMIT license", "MIT license" + " word" * 30_000 + " mit license", "İMIT \u212aLICENSE", "license " * 500, "mit license " * 300, "LESSER GENERAL PUBLIC LICENSE 2.1 only",
]


def test_scan_against_brute_force(spark, corpus):
    rows = [(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(None, "mit license", 1, "x")] + [(100 + i, r["text"], 1, "x") for i, r in enumerate(corpus[:30])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, norm string")
    got = {r["doc_id"]: tuple(r)[1:] for r in L.license_scan(df).collect()}
    for doc, text, *_ in rows:
        assert got[doc] == scan(text), text and text[:60]
    assert L.license_scan(df.limit(0)).count() == 0


def test_rules_are_many_and_their_gates_let_them_pass():
    rules = L.rules()
    assert len(rules) > 300 and len({(r.label, r.regex) for r in rules}) == len(rules)
    gate = set(L.GATE_WORDS)
    for text in ("gnu affero general public license version 3 only", "cc by nd 2 5", "odbl 1 0", "elasticv2", "beer ware license", "the software shall be used for good not evil"):
        assert gate & set(text.split()), text


def spelled(regex):
    """All texts that a rule's regex matches, an optional part at most once."""
    import re._parser as parser

    def of(item):
        op, arg = str(item[0]), item[1]
        if op == "LITERAL":
            return [chr(arg)]
        if op == "IN":
            return [chr(a) for _, a in arg]
        if op == "SUBPATTERN":
            return sequence(arg[3])
        if op == "BRANCH":
            return [x for branch in arg[1] for x in sequence(branch)]
        if op == "MAX_REPEAT":
            assert tuple(arg[:2]) == (0, 1)
            return ["", *sequence(arg[2])]
        assert op == "ASSERT_NOT"
        return [""]

    def sequence(items):
        out = [""]
        for item in items:
            out = [a + b for a in out for b in of(item)]
        return out

    return sequence(parser.parse(regex))


def test_no_gate_stops_what_its_rule_matches():
    for r in L.rules():
        for text in spelled(r.regex):
            assert r.keyword in f" {text} " and set(text.split()) & set(L.GATE_WORDS), (r, text)


def ungated(text):
    """Labels and score of a text when every rule's regex is tried."""
    norm = " " + " ".join(words(text)) + " "
    kept, far = [], 0
    for f in sorted((m.start(), -m.end(), r.priority, r.label, r.confidence) for r in L.rules() for m in re.finditer(f"(?<= )(?:{r.regex})(?= )", norm)):
        if -f[1] > far:
            kept.append(f)
            far = -f[1]
    base = {label for p, label in L.BASE_PHRASES if f" {p} " in norm}
    return ",".join(sorted(base | {f[3] for f in kept})), max([f[4] for f in kept] + [0.9 if base else 0.0])


def test_scan_against_all_regexes_without_keywords(spark):
    texts = [t for t in TEXTS if t is None or len(t) < 1000]
    texts += ["released under the GPL v2", "GNU GPL v3", "LGPL v2.1", "Apache v2.0", "MPL v2.0", "PHP v3.01, PHP 3.01", "gpl v 2 and GPL v2.0 or EPL-v1.0", "gpl v9", "a BSD-style license", "BSD style licence"]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in L.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == ungated(text), text
    assert got[texts.index("GNU GPL v3")] == ("gpl-3.0", 0.8) and got[texts.index("LGPL v2.1")] == ("lgpl-2.1", 0.8)


def test_em_recovers_accuracies():
    rng = np.random.default_rng(5)
    truth = rng.random(40_000) < 0.8
    good, bad = rng.uniform(0.9, 0.99, len(quality.LABELLERS)), rng.uniform(0.2, 0.7, len(quality.LABELLERS))
    said = np.where(truth[:, None], rng.random((40_000, len(good))) < good, rng.random((40_000, len(good))) < bad)
    counts = {}
    for row in said:
        key = "".join("g" if x else "b" for x in row)
        counts[key] = counts.get(key, 0) + 1
    right, share, posterior = quality.estimate_accuracies(counts)
    assert abs(share - 0.8) < 0.03 and np.abs(right[:, 1] - good).max() < 0.03 and np.abs(right[:, 0] - (1 - bad)).max() < 0.06
    assert posterior["g" * len(good)] > 0.9 and posterior["b" * len(good)] < 0.01
    assert quality.estimate_accuracies({})[2] == {}


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = quality.fit(docs)
    got = {r["doc_id"]: r["keep"] for r in quality.score(docs, model).collect()}
    labels = duckdb.sql(f"select doc_id, quality from read_parquet('{path}/labels.parquet')").fetchall()  # never seen by the fit
    right = {q: [got[d] == bool(y) for d, y in labels if y == q] for q in (0, 1)}
    assert np.mean(right[1]) >= 0.98 and np.mean(right[0]) >= 0.8
    kept = {r["doc_id"] for r in quality.keep_good(docs, model).select("doc_id").collect()}
    assert kept == {d for d, k in got.items() if k}


def test_quality_of_odd_rows(docs, corpus, empty):
    model = quality.fit(docs)
    got = quality.score(docs, model).collect()
    assert len(got) == len(corpus) and all(not r["keep"] and r["score"] == 0 for r in got if r["doc_id"] in {c["doc_id"] for c in corpus if not (c["text"] or "").strip()})
    assert quality.score(empty, quality.fit(empty)).count() == 0 and quality.keep_good(empty, model).columns == empty.columns
