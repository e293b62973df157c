import random
import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from claimforge.llm import packing, queries


def test_stages_in_order(spark, docs, empty):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "ngram_jaccard", "mixing", "packing"]
    held = docs.select(corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, held, "")
        assert out.columns == corpus_pipeline.COLUMNS and out.schema == held.schema
        held = out.cache()
        assert 0 < held.count() <= 3 * docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, held, "").select("doc_id").distinct().count() == held.select("doc_id").distinct().count()


def test_every_operator_has_a_query():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{i}" for i in range(1, 11)} and set(queries.SQL) <= set(queries.QUERIES)


def smallest(rows):
    """Of near copies the row that stays: of the smallest id, the longest."""
    return min(rows, key=lambda r: (r[0] is None, r[0] or 0, -len(r[1] or "")))


def test_dedup_and_packing_stages_row_by_row(spark):
    from tokenizers import Tokenizer

    rng = random.Random(9)
    fresh = lambda: " ".join(f"u{rng.randrange(10**6)}" for _ in range(50))
    a, b, c, d = (fresh() for _ in range(4))
    texts = [(1, a), (2, a + "  "), (None, a + " near"), (None, fresh()), (None, b), (3, b), (4, c), (4, c + " near"), (4, fresh()), (5, fresh()), (5, fresh()), (None, d), (None, d + " near it"), (6, None), (7, " "), (8, "x <|endoftext|> y"), (9, c + " far " + fresh())]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(2)
    stages = dict(corpus_pipeline.STAGES)

    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append(r)
    want = [min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for g in groups.values()]
    out = stages["exact_dedup"](spark, docs, "").cache()
    blank = lambda rs: Counter(tuple(r) if (r[1] or "").strip() else "blank" for r in rs)
    assert blank(out.collect()) == blank(want)

    want = [tuple(r) for r in out.collect()]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (r[1] or "").split()) else set() for r in want]
    name = list(range(len(want)))
    for _ in want:
        name = [min([name[i], *(name[j] for j, y in enumerate(sets) if x and y and 100 * len(x & y) >= 80 * len(x | y))]) for i, x in enumerate(sets)]
    want = [smallest([r for r, n in zip(want, name, strict=True) if n == m]) for m in set(name)]
    left = stages["ngram_jaccard"](spark, out, "").cache()
    assert Counter(tuple(r) for r in left.collect()) == Counter(want) and len(want) < out.count()

    t, pieces = Tokenizer.from_file(packing.default_vocabulary()), Counter()
    for r in want:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [0]
        pieces[r[0], 0, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    packed = stages["packing"](spark, left, "").collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == pieces
    at = {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= packing.SEQUENCE_TOKENS
