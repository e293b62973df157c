import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimforge.llm import mixing, packing


def water(sizes, weights, most):
    """Resharing by weight, round by round."""
    total, target, capped = sum(sizes), [0.0] * len(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        if not free:
            return target
        left = total - sum(target[i] for i in capped)
        for i in free:
            target[i] = left * weights[i] / sum(weights[j] for j in free)
        over = [i for i in free if target[i] > most * sizes[i]]
        if not over:
            return target
        for i in over:
            target[i] = float(most * sizes[i])
            capped.add(i)


@pytest.mark.parametrize("sizes", [[100, 100, 100, 100], [1, 1000, 10, 5000, 3, 0], [7], [0, 0], [5, 0, 0, 1]])
def test_targets(spark, sizes):
    rows = [(f"s{i}" if i < len(sizes) - 1 else None, s) for i, s in enumerate(sizes)]
    got = mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()
    by = {r["source"]: r["target"] for r in got}
    want = water(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 3)
    assert [by[s] for s, _ in rows] == pytest.approx(want)


def test_mix(spark, docs, corpus, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(corpus) and sorted(r.asDict().items() for r in got if r["doc_id"] is not None) == sorted(r.asDict().items() for r in mixing.mix(docs.repartition(5)).collect() if r["doc_id"] is not None)
    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in corpus}
    assert all(r["size"] == words[r["doc_id"]] and 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in got)
    for target in {(r["target"], r["source_size"]) for r in got}:
        rows = [r for r in got if (r["target"], r["source_size"]) == target]
        assert abs(sum(r["taken"] for r in rows) - target[0]) <= 3 * max(r["size"] for r in rows)
    assert mixing.mix(empty).count() == 0


def test_mixed_rows(docs):
    taken = {(r["doc_id"], r["source"]): r["c"] for r in mixing.mix(docs, with_source=True).groupBy("doc_id", "source").agg(F.sum("copies").alias("c")).collect() if r["c"]}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert {(r["doc_id"], r["source"]): r["count"] for r in mixed.groupBy("doc_id", "source").count().collect()} == taken


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_bins_hold_all_without_gaps(lengths):
    x = np.array(lengths, np.int64)
    bins, offsets = packing.best_two_fit(x, 64)
    for b in set(bins.tolist()):
        at = 0
        for o, n in sorted(zip(offsets[bins == b].tolist(), x[bins == b].tolist(), strict=True)):
            assert o == at
            at += n
        assert at <= 64
    assert len(set(bins.tolist())) <= 1 + sum(lengths) * 2 // 64


def test_two_documents_fit_tighter():
    bins, _ = packing.best_two_fit(np.array([60, 30, 28, 41, 40]), 100)
    assert len(set(bins.tolist())) == 2 + 0  # 60 + 40, 41 + 30 + 28: greedy filling with two put in for one


def test_pieces_and_places(docs, corpus, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    t.encode_special_tokens = True
    got = packing.pack(docs, most=64).collect()
    held = {}
    for r in got:
        assert 0 < r["length"] <= 64
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for rows in held.values():
        at = 0
        for o, n in sorted(rows):
            assert o == at
            at += n
        assert at <= 64
    total = sum(r["length"] for r in got)
    assert len(held) <= total / 64 * 1.02 + 1
    want = []
    for r in corpus:
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        first = len(ids) - (-(-len(ids) // 64) - 1) * 64
        cuts = [0, *range(first, len(ids) + 1, 64)]
        want += [(str(r["doc_id"]), i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    assert packing.pack(empty).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t  a'sé9.<|endoftext|>")), max_size=40))
def test_words_encode_like_whole_texts(text):
    from tokenizers import Tokenizer

    global _ENCODERS
    if "_ENCODERS" not in globals():
        t = Tokenizer.from_file(packing.default_vocabulary())
        t.encode_special_tokens = True
        _ENCODERS = t, packing.Encoder(packing.default_vocabulary())
    assert np.frombuffer(_ENCODERS[1].encode(text), np.uint32).tolist() == _ENCODERS[0].encode(text, add_special_tokens=False).ids


ADDED = ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>x", "  <|endoftext|>\n \n", "<|endoftext|", "<|ENDOFTEXT|>", "é<|endoftext|>'s 9", "word " * 100 + "<|endoftext|>" + " word" * 100]


def as_loaded(text):
    from tokenizers import Tokenizer

    global _LOADED
    if "_LOADED" not in globals():
        _LOADED = Tokenizer.from_file(packing.default_vocabulary()), packing.Encoder(packing.default_vocabulary())
    return _LOADED[0].encode(text, add_special_tokens=False).ids, np.frombuffer(_LOADED[1].encode(text), np.uint32).tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", " ", "\n", "a", "'s", "é", "<|", "|>", "word word"]), max_size=12).map("".join))
def test_added_tokens_encode_as_in_the_tokenizer_as_loaded(text):
    want, got = as_loaded(text)
    assert got == want


def test_pieces_of_texts_with_added_tokens(spark):
    assert as_loaded("a <|endoftext|> b")[0] == [64, 220, 50256, 275]
    want = []
    for doc, text in enumerate(ADDED):
        ids = as_loaded(text)[0] + [0]
        cuts = [0, *range(len(ids) - (-(-len(ids) // 64) - 1) * 64, len(ids) + 1, 64)]
        want += [(doc, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    got = packing.pack(spark.createDataFrame(list(enumerate(ADDED)), "doc_id long, text string"), most=64).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 700_000, "a" + "\t \n" * 300_000 + "b"])
def test_long_runs_of_white_space(text):
    from tokenizers import Tokenizer

    file = packing.default_vocabulary()
    want = Tokenizer.from_file(file).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.Encoder(file).encode(text), "<u4").tolist() == want


def test_mixed_rows_keep_columns_of_any_name(spark):
    rows = [(i, f"a b c {i}", "s", i * 3, i * 5, "x", {"k": i}) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _id long, size long, row string, held map<string,int>")
    got = mixing.mixed_documents(docs).collect()
    assert got and all(tuple(r) in [tuple(x) for x in rows] for r in got)
