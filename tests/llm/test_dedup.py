import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from claimforge.llm import cuckoo
from claimforge.llm import jaccard as J


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_groups(docs, corpus):
    got = cuckoo.exact_groups(docs).collect()
    assert len(got) == len(corpus)
    groups = {}
    for r in corpus:
        groups.setdefault(hashlib.sha256(normal(r["text"]).encode()).hexdigest(), []).append(r)
    best = {k: min(rows, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))["doc_id"] for k, rows in groups.items()}
    for r in got:
        assert (r["keep_id"], r["group_size"]) == (best[r["text_sha256"]], len(groups[r["text_sha256"]]))
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept) == set(groups) and set(kept.values()) == {1}


def test_exact_dedup_keeps_one_row_of_each(docs, corpus, empty):
    left = cuckoo.exact_dedup(docs).collect()
    assert sorted(normal(r["text"]) for r in left) == sorted({normal(r["text"]) for r in corpus})
    assert left[0].asDict().keys() == corpus[0].keys()
    assert cuckoo.exact_groups(empty).count() == 0 and cuckoo.exact_dedup(empty).count() == 0


def test_dedup_keeps_columns_of_any_name(spark):
    rows = [(i, "same  text" if i % 2 else f"text {i} of its own with many other words", f"d{i}", i * 3, i, {"k": i}) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _digest string, _id long, id long, row map<string,int>")
    want = {tuple(r.values()) if isinstance(r, dict) else r[:5] for r in rows if r[0] == 1 or not r[0] % 2}
    assert {tuple(r)[:5] for r in cuckoo.exact_dedup(docs).collect()} == want == {tuple(r)[:5] for r in J.keep_one_of_group(docs).collect()}


def test_cuckoo_index_against_a_dict():
    rng, index, live = random.Random(1), cuckoo.CuckooIndex(2), {}
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for step in range(20_000):
        d = rng.choice(digests)
        if d in live and rng.random() < 0.4:
            assert index.delete(d)
            del live[d]
        elif d not in live:
            assert index.get(d) is None and not index.delete(d)
            index.insert(d, step)
            live[d] = step
        else:
            assert index.get(d) == live[d] and index.maybe(d)
    assert dict(index.items()) == live and index.live == len(live) and index.resized > 3


def test_changes_to_the_index(spark):
    d = [hashlib.sha256(bytes([i])).digest() for i in range(4)]
    live = spark.createDataFrame([(d[0], 2), (d[1], 1)], cuckoo.CHANGED)
    changes = spark.createDataFrame([(d[0], 1, -1), (d[1], 2, -1), (d[2], 3, 1), (d[3], 4, -1), (d[1], 5, 1), (d[1], 6, 1), (None, 7, 1)], "digest binary, seq long, delta long")
    assert {bytes(r["digest"]): r["refs"] for r in cuckoo.apply_changes(live, changes).collect()} == {d[0]: 1, d[1]: 2, d[2]: 1}


def brute(corpus, k, percent):
    sets = []
    for r in corpus:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")) if w]
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    names = {}
    for i, r in enumerate(corpus):
        if r["doc_id"] is not None:
            names[find(i)] = min(names.get(find(i), r["doc_id"]), r["doc_id"])
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], len(s), names.get(find(i), -1)) for i, (r, s) in enumerate(zip(corpus, sets, strict=True)))


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_similar_groups_against_all_pairs(docs, corpus, k, percent):
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in J.similar_groups(docs, k=k, percent=percent).collect())
    assert got == brute(corpus, k, percent)


def test_similar_groups_of_long_texts_and_a_hot_passage(spark):
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, base, long = fresh(9), fresh(90), fresh(9000)
    texts = [" ".join(passage + fresh(rng.randrange(0, 4))) for _ in range(60)]
    for i in range(70):
        copy = list(base)
        for at in rng.sample(range(90), i % 6):
            copy[at] = f"x{rng.randrange(40)}"
        texts.append(" ".join(copy + passage * (i % 2)))
    for share in (0, 100, 300, 450, 900):
        copy = list(long)
        for at in rng.sample(range(9000), share):
            copy[at] = f"y{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    corpus = [{"doc_id": i, "text": t} for i, t in enumerate(texts)]
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)
    for k, percent in ((3, 90), (5, 80)):
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.similar_groups(docs, k=k, percent=percent).collect())
        assert got == brute(corpus, k, percent)


def test_near_dedup_keeps_one_of_each_group(docs, corpus, empty):
    left = J.keep_one_of_group(docs).collect()
    component = {d: c for d, _, c in brute(corpus, 5, 80) if d >= 0}
    assert sorted(r["doc_id"] for r in left if r["doc_id"] is not None) == sorted({c for c in component.values()})
    assert J.similar_groups(empty).count() == 0


def test_near_dedup_tells_rows_of_one_id_apart(spark):
    rng = random.Random(3)
    fresh = lambda: [f"u{rng.randrange(10**9)}" for _ in range(60)]
    text = lambda w, tail="": " ".join([*w, tail] if tail else w)
    a, b, c, d, e = (fresh() for _ in range(5))
    rows = [
        (1, text(a), "x"), (None, text(a, "near"), "x"), (None, text(fresh()), "x"), (None, text(fresh()), "x"),  # only the null id's near copy goes
        (2, text(b), "x"), (3, text(b, "near"), "x"), (3, text(fresh()), "x"),  # of id 3 only the near copy goes
        (4, text(fresh()), "x"), (4, text(fresh()), "y"), (4, text(fresh()), "y"),  # unlinked texts of one id all stay
        (None, text(c), "x"), (None, text(c, "near"), "x"), (None, text(c, "other"), "x"),  # null ids alone: one stays
        (5, text(d), "x"), (5, text(d, "longer"), "y"), (5, text(d, "longer"), "x"), (6, text(d), "x"),  # the longest of the smallest id, once
        (7, text(e), "x"), (7, text(b, "again"), "x"), (8, text(e, "near"), "x"),  # id 7 names one group and goes from another
        (9, None, "x"), (9, "", "x"), (9, " ", "x"), (None, None, "x"), (None, " ", "y"),  # without words: all stay
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = Counter(tuple(r) for r in J.keep_one_of_group(docs).collect())
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for _, t, _ in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i, x in enumerate(sets):
            group[i] = min([group[i], *(group[j] for j, y in enumerate(sets) if x and y and 100 * len(x & y) >= 80 * len(x | y))])
    best = {}
    for g, r in zip(group, rows, strict=True):
        rank = (r[0] is None, r[0] or 0, -len(r[1] or ""), r[1] or "", r[2])
        best[g] = min(best.get(g, (rank, r)), (rank, r), key=lambda x: x[0])
    assert got == Counter(r for _, r in best.values()) and len(best) == 16


def test_hashes_stand_for_shingles():
    s = J.Shingler(3)
    assert len(s("a b c a b c")) == 3 and len(s("a b")) == 1 and not len(s(" \n")) and not len(s(None))
    assert (s("A b\x0bC") == s("a B c")).all() and s("a b")[0] != s("b a")[0] and len(s("a\xa0b")) == 1


def test_parity_bits_never_exceed_the_difference(spark):
    """A pair is passed over only where its sets differ by more n-grams than a link allows."""
    rng, sets = np.random.default_rng(5), []
    for n in (1, 2, 5, 40, 700, 5000):
        base = rng.integers(0, 1 << 63, n, np.uint64)
        sets += [np.unique(np.concatenate([base[cut:], rng.integers(0, 1 << 63, cut, np.uint64)])) for cut in {0, 1, n // 20, n // 8, n // 2}]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i)]
    for i, j in pairs:
        flips = int(np.unpackbits((J._parities(sets[i]) ^ J._parities(sets[j])).view(np.uint8)).sum())
        assert flips <= len(np.setxor1d(sets[i], sets[j]))
    classes = spark.createDataFrame([(i, *J._parities(g).tolist()) for i, g in enumerate(sets)], ", ".join(f"{c} long" for c in ["class", *J.BITS]))
    rows = spark.createDataFrame([(i, len(sets[i]), j, len(sets[j])) for i, j in pairs], "p long, pn int, x long, n int")
    for percent in (80, 90):
        left = {(r["p"], r["x"]) for r in J._within(rows, classes, percent).collect()}
        linked = {(i, j) for i, j in pairs if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))}
        assert linked <= left and len(left) < len(pairs) // 2
