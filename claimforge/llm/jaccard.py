"""N-gram Jaccard join: a global n-gram order cut into fragments whose partial overlaps are summed per pair.

Texts with the same n-gram set are one class. All classes are cut alike: their n-grams in the global order, rarest
first, fall into fragments. Which pairs are worth counting is told by the first n-grams of each set: two
sets can be linked only if the first n-gram that they share lies early enough in both. No bucket of sets
that share an n-gram is expanded into pairs. Its members are first held against one pivot; then only members of
different components whose sizes and places leave room for a link are paired, and these are found by cells of
equal size and place, not member by member. Pairs whose parity bits differ too much for a link are not counted.
Every link comes from a pair whose partial overlaps were summed.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimforge.llm.common import arrow_batches, give_back
from claimforge.llm.presence import bit_filter, first_of_each, holds, maybe_in, summed_slices, whole_rows
from claimforge.operators.components import connected_components
from claimforge.operators.storage import materialize, release

#: Counters of the frequency sketch that orders n-grams: its size bounds what is sent to executors.
SKETCH_BITS = 22
SLICE_BITS = 18
FRAGMENTS = 3
#: Bits of the filter that spares n-grams of one prefix the shuffle; beyond its size it only spares less.
SHARED_BITS = 27
#: Longs of 64 parity bits that stand for a set when a pair is weighed before its sets are fetched.
PARITIES = 8
#: Words whose hashes a worker keeps.
WORDS_KEPT = 60_000
#: Texts that a worker is given at a time.
BATCH_TEXTS = 256

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


class Shingler:
    """Distinct n-gram hashes of a text, sorted: words are split at ASCII white space, A-Z lower-cased.

    A text of fewer than ``k`` words has its whole sequence as one n-gram; without words, none.
    """

    def __init__(self, k: int):
        import xxhash

        self.k, self._hash, self._words = k, xxhash.xxh3_64_intdigest, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(self._words) > WORDS_KEPT:
            self._words = {}
        known = self._words
        try:
            hashes = [known[w] for w in words]
        except KeyError:
            for w in set(words):
                if w not in known:
                    known[w] = self._hash(w)
            hashes = [known[w] for w in words]
        h = np.array(hashes, np.uint64)
        n = min(self.k, len(h))
        out = np.full(len(h) - n + 1, n * 0x632BE59BD9B4E019 % (1 << 64), np.uint64)
        for j in range(n):
            out = (out ^ h[j : len(h) - n + 1 + j]) * _A
            out ^= out >> _B
        return np.unique(out)


@lru_cache(maxsize=4)
def _shingler(k: int) -> Shingler:
    return Shingler(k)


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def frequency_sketch(docs: DataFrame, text_col: str, k: int) -> np.ndarray:
    """How often n-grams of each of ``2**SKETCH_BITS`` slots occur, over all texts.

    Every task sends its counters in compressed slices; slices are summed apart, in two steps. What reaches the driver
    is one counter per slot, whatever the size of the corpus.
    """
    size, slices = 1 << SLICE_BITS, 1 << (SKETCH_BITS - SLICE_BITS)

    def batch_of(counts: dict[int, np.ndarray]) -> pa.RecordBatch:
        rows = [(i, zlib.compress(np.minimum(x, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1)) for i, x in sorted(counts.items())]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["slice", "counts"])

    def counted(batches):
        grams, counts = _shingler(k), np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(counts, _slot(grams(text.as_py())), 1)
        yield batch_of({i: x for i in range(slices) if (x := counts[i * size : (i + 1) * size]).any()})
        del counts
        give_back()

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total.setdefault(i, np.zeros(size, np.uint64))
                total[i] += np.frombuffer(zlib.decompress(x), np.uint32)
        yield batch_of(total)

    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    for row in summed_slices(docs.select(text_col).mapInArrow(counted, "slice int, counts binary"), merge, slices):
        out[row["slice"] * size : (row["slice"] + 1) * size] = np.frombuffer(zlib.decompress(row["counts"]), np.uint32)
    return out


def fragment_cuts(sketch: np.ndarray, fragments: int = FRAGMENTS) -> np.ndarray:
    """Frequencies at which the global order is cut, so that fragments hold about as many n-grams each."""
    by_count = np.sort(sketch[sketch > 0]).astype(np.uint64)
    if not len(by_count):
        return np.zeros(fragments - 1, np.uint32)
    total = np.cumsum(by_count)
    return by_count[np.searchsorted(total, total[-1] * np.arange(1, fragments) // fragments)].astype(np.uint32)


def _signature(grams: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(grams.tobytes())


def _parities(grams: np.ndarray) -> np.ndarray:
    """Bits that tell of each of ``64 * PARITIES`` slots whether an odd number of the n-grams fall in it."""
    odd = np.bincount((grams & np.uint64(64 * PARITIES - 1)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


#: The columns that hold them.
BITS = [f"bits{i}" for i in range(PARITIES)]


def _class(sig: Column) -> Column:
    """The number that stands for a class among candidates: half of its signature, as long as an n-gram's hash."""
    return F.conv(F.hex(F.substring(sig, 1, 8)), 16, -10).cast("long")


def gram_sets(docs: DataFrame, sketch, id_col: str, text_col: str, k: int, percent: int, key: Column | None = None) -> DataFrame:
    """(doc_id, n, sig, central, prefix, bits0, ...) of every row; the prefix is what one of two similar sets must share.

    The prefix is in the global order: a place in it is the n-gram's place in the whole set. With ``key`` (binary) the
    rows carry it as a last column.
    """
    schema = "doc_id long, n long, sig binary, central double, prefix array<long>, " + ", ".join(f"{b} long" for b in BITS)

    def made(batches):
        grams, counts = _shingler(k), sketch.value
        for batch in batches:
            ids, ns, sigs, centrals, prefixes, bits = [], [], [], [], [], np.zeros((batch.num_rows, PARITIES), np.int64)
            for row, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                g = grams(text.as_py())
                bits[row] = _parities(g)
                c = counts[_slot(g)]
                order = np.lexsort((g, c))[: len(g) - -(-percent * len(g) // 100) + 1] if len(g) else []
                ids.append(doc)
                ns.append(len(g))
                sigs.append(_signature(g) if len(g) else None)
                centrals.append(float(np.log2(c[order] + 1.0).mean()) if len(g) else 0.0)
                prefixes.append(g[order].view(np.int64) if len(g) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(sigs, pa.binary()), pa.array(centrals, pa.float64()), pa.array(prefixes, pa.list_(pa.int64())), *map(pa.array, bits.T.copy()), *batch.columns[2:]],
                ["doc_id", "n", "sig", "central", "prefix", *BITS, *batch.schema.names[2:]],
            )
        give_back()

    if key is None:
        return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(made, schema)
    return docs.select(F.col(id_col).cast("long"), text_col, key.alias("key")).mapInArrow(made, schema + ", key binary")


def prefix_rows(sets: DataFrame) -> DataFrame:
    """(gram, x, n, at, central): the n-grams that stand in the prefixes of several classes, one row a class.

    An n-gram whose slot was hit once is in one prefix only and goes before it is shuffled; copies of a class
    are one row after the partial aggregation of their task.
    """
    shared = sets.sparkSession.sparkContext.broadcast(bit_filter(sets.select("prefix"), SHARED_BITS, 2))

    def rows(batches):
        for batch in batches:
            lists = batch.column(3)
            grams = lists.flatten().to_numpy(zero_copy_only=False)
            lengths = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(batch.num_rows), lengths)
            at = np.arange(len(grams)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            keep = holds(shared.value, grams, SHARED_BITS)
            held = batch.select([0, 1, 2]).take(pa.array(owner[keep]))
            yield pa.RecordBatch.from_arrays([pa.array(grams[keep], pa.int64()), *held.columns, pa.array(at[keep], pa.int32())], ["gram", "x", "n", "central", "at"])

    held = sets.where("sig is not null").select(_class(F.col("sig")).alias("x"), F.col("n").cast("int"), F.col("central").cast("float"), "prefix")
    found = held.mapInArrow(rows, "gram long, x long, n int, central float, at int")
    return found.groupBy("gram", "x").agg(F.first("n").alias("n"), F.first("at").alias("at"), F.first("central").alias("central"))


def fragments_of(docs: DataFrame, wanted: DataFrame, sketch, cuts, id_col: str, text_col: str, k: int) -> DataFrame:
    """(class, frag, pivot, member, grams) of the classes ``wanted`` (doc_id, sig, pivot, member): their sets cut at the order's fragments."""

    def cut(batches):
        grams, counts = _shingler(k), sketch.value
        for batch in batches:
            owners, frags, parts = [], [], []
            for i, (text, sig) in enumerate(zip(batch.column(0), batch.column(1).to_pylist(), strict=True)):
                g = grams(text.as_py())
                if _signature(g) != sig:
                    continue
                frag = np.searchsorted(cuts, counts[_slot(g)], side="left")
                owners += [i] * (len(cuts) + 1)
                frags += range(len(cuts) + 1)
                parts += [g[frag == f].view(np.int64) for f in range(len(cuts) + 1)]
            held = batch.select([2, 3, 4]).take(pa.array(owners, pa.int64()))
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array(frags, pa.int32()), pa.array(parts, pa.list_(pa.int64()))], ["class", "pivot", "member", "frag", "grams"])
        give_back()

    # Only texts that may be wanted leave the scan.
    maybe = maybe_in(wanted, "doc_id")
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).where(maybe(F.col("_id")))
    chosen = texts.join(wanted, texts["_id"].eqNullSafe(wanted["doc_id"])).select("_text", "sig", _class(F.col("sig")).alias("class"), "pivot", "member")
    return chosen.mapInArrow(cut, "class long, pivot boolean, member boolean, frag int, grams array<long>")


def overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """(p, pn, x, n, o): the overlap of each pair's sets, counted by fragment and then summed.

    The member's fragments join first and the pivot's after, so those of a pivot with many members are
    shuffled once. A fragment that one of the two has not counts nothing.
    """
    own = segments.where("member").select(F.col("class").alias("x"), "frag", F.col("grams").alias("xg"))
    pivot = segments.where("pivot").select(F.col("class").alias("p"), "frag", F.col("grams").alias("pg"))
    partial = pairs.join(own, "x").join(pivot, ["p", "frag"]).select("p", "pn", "x", "n", F.size(F.array_intersect("pg", "xg")).alias("both"))
    return partial.groupBy("p", "pn", "x", "n").agg(F.sum("both").alias("o"))


def _may(n: Column, at: Column, m: Column, other: Column, percent: int) -> Column:
    """Whether sets of ``n`` and ``m`` n-grams whose first common one lies at these places can be linked."""
    needed = (n.cast("long") + m) * percent
    return ((n.cast("long") - at) * (100 + percent) >= needed) & ((m.cast("long") - other) * (100 + percent) >= needed)


def _within(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` whose sets' parity bits leave room for a link.

    Every n-gram that only one of two sets has flips one bit, so two sets differ by at least as many n-grams as bits.
    No link is lost, and sets that merely share some n-grams need not be fetched.
    """
    own = [classes.select(F.col("class").alias(end), *(F.col(b).alias(end + b) for b in BITS)) for end in "px"]
    flips = sum((F.bit_count(F.col("p" + b).bitwiseXOR(F.col("x" + b))) for b in BITS), F.lit(0))
    met = pairs.join(own[0], "p").join(own[1], "x")
    return met.where(flips * (100 + percent) <= (F.col("pn").cast("long") + F.col("n")) * (100 - percent)).select("p", "pn", "x", "n")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: groups by links of ``100 * overlap >= percent * union``.

    ``component_id`` is the smallest id reachable. No link between different texts is lost: two linked sets share an
    n-gram of their prefixes early enough in both, so they are held against each other or against a pivot
    with which both are linked already.

    Null, empty and blank texts have no n-grams and are linked with nothing. Repeated rows and equal sets are one class.
    A null id is never a component's name where another is there; ids that repeat with different texts are judged apart
    but named alike. Empty tables give no rows; further columns are ignored.
    """
    sets, grouped = _grouped_sets(docs, id_col, text_col, k, percent)
    return sets.select("doc_id", F.col("n").alias("n_shingles"), "sig").join(grouped.select("sig", "component_id"), "sig", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _grouped_sets(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, key: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows' sets, and (sig, component, component_id) of the classes in components of several rows."""
    spark = docs.sparkSession
    with arrow_batches(spark, BATCH_TEXTS):
        counts = frequency_sketch(docs, text_col, k)
        cuts, sketch = fragment_cuts(counts), spark.sparkContext.broadcast(counts)
        made = materialize(gram_sets(docs, sketch, id_col, text_col, k, percent, key), "gram-sets")
        found = materialize(prefix_rows(made), "gram-rows")
        sets = materialize(made.drop("prefix", "central", *BITS), "gram-ids")
        classes = made.where("sig is not null").groupBy("sig").agg(F.count("*").alias("members"), F.min("doc_id").alias("rep"), *(F.first(b).alias(b) for b in BITS))
        classes = materialize(classes.withColumn("class", _class(F.col("sig"))), "gram-classes")
        release(made)
        # What the filter let through of n-grams that one class alone has goes here.
        rows = materialize(_with_pivots(found), "gram-buckets")
        release(found)

        def linked(pairs: DataFrame) -> DataFrame:
            """The pairs that are linked, by fragments cut from the text of one document of each class."""
            ends = pairs.select(F.col("p").alias("class"), F.lit(True).alias("pivot")).union(pairs.select("x", F.lit(False))).groupBy("class")
            wanted = ends.agg(F.max("pivot").alias("pivot"), F.max(~F.col("pivot")).alias("member")).join(classes, "class")
            wanted = materialize(wanted.select(F.col("rep").alias("doc_id"), "sig", "pivot", "member"), "gram-wanted")
            segments = materialize(fragments_of(docs, wanted, sketch, cuts, id_col, text_col, k), "gram-fragments")
            # A document that is there several times gives its fragments as often.
            once = segments if segments.count() <= wanted.count() * FRAGMENTS else segments.dropDuplicates(["class", "frag"])
            enough = F.col("o") * (100 + percent) >= (F.col("pn").cast("long") + F.col("n")) * percent
            links = materialize(overlaps(pairs, once).where(enough).select(F.col("p").alias("a"), F.col("x").alias("b")), "gram-links")
            release(wanted, segments)
            return links

        stars = materialize(_stars(rows, percent), "gram-stars")
        near = materialize(_within(stars, classes, percent), "gram-near")
        links = linked(near)
        done = materialize(connected_components(links), "gram-components")
        pairs = materialize(_within(_across(rows, done, stars, percent), classes, percent), "gram-pairs")
        if not pairs.isEmpty():
            more = linked(pairs)
            if not more.isEmpty():
                # The components so far are stars already, so few rounds are needed.
                joined = more.unionByName(done.select(F.col("node").alias("a"), F.col("component").alias("b")))
                done = materialize(connected_components(joined), "gram-components")
            release(more)
        release(rows, stars, near, links, pairs)
        sketch.destroy()
    components = done.select(F.col("node").alias("class"), "component")
    named = classes.join(components, "class", "left").withColumn("component", F.coalesce("component", "class"))
    names = named.groupBy("component").agg(F.min("rep").alias("component_id"), F.sum("members").alias("all"))
    grouped = materialize(named.join(names.where("all > 1"), "component").select("sig", "component", "component_id"), "gram-groups")
    release(done, classes)
    return sets, grouped


def _with_pivots(rows: DataFrame) -> DataFrame:
    """(gram, x, n, at, p, pn, pat, more): the rows of every bucket of several with its pivot, the class of the most common prefix.

    ``more`` tells whether there are others beside the pivot and one member.
    """
    pivot = F.max(F.struct("central", "x", "n", "at")).alias("pivot")
    pivots = rows.groupBy("gram").agg(F.count("*").alias("members"), pivot).where("members > 1")
    pivots = pivots.select("gram", (F.col("members") > 2).alias("more"), F.col("pivot.x").alias("p"), F.col("pivot.n").alias("pn"), F.col("pivot.at").alias("pat"))
    return rows.drop("central").join(pivots, "gram")


def _stars(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (p, pn, x, n) of members with their bucket's pivot: at most one a row, where the places of its n-gram allow a link."""
    return rows.where("x <> p").where(_may(F.col("n"), F.col("at"), F.col("pn"), F.col("pat"), percent)).select("p", "pn", "x", "n").distinct()


def _across(rows: DataFrame, done: DataFrame, seen: DataFrame, percent: int) -> DataFrame:
    """Pairs (p, pn, x, n) of different components that share an n-gram at places that allow a link, but those ``seen``.

    A bucket of two is one pair, its member's and its pivot's. Members of a bucket that agree in size and place are one cell. Cells are paired in bands of lengths, then a cell's
    components, then their members; so a large component, or many members alike, cost as much as one until
    they meet somebody they might be linked with.
    """
    known = rows.where("more").select("gram", "x", "n", "at").join(done.select(F.col("node").alias("x"), "component"), "x", "left")
    known = known.withColumn("comp", F.coalesce("component", "x")).drop("component")
    mixed = known.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("gram")
    held = materialize(known.join(mixed, "gram", "left_semi"), "gram-mixed")
    cells = held.groupBy("gram", "n", "at").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    # Slightly wider than the ratio of sizes that a link allows: the larger is in the smaller's band or the next.
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent) * 1.001 + 1e-9)).cast("int")
    cells = materialize(cells.withColumn("band", band), "gram-cells")
    # The smaller of two has the n-gram in the first half of its prefix.
    early = cells.where(_may(F.col("n"), F.col("at"), F.col("n"), F.col("at"), percent))
    small = early.select("gram", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), "n", "at", "lo", "hi")
    large = cells.select("gram", "band", F.col("n").alias("m"), F.col("at").alias("other"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    ordered = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("at") <= F.col("other")))
    several = F.least("lo", "lo2") != F.greatest("hi", "hi2")
    fit = small.join(large, ["gram", "band"]).where(ordered & several & _may(F.col("n"), F.col("at"), F.col("m"), F.col("other"), percent))
    fit = materialize(fit.select("gram", "n", "at", "m", "other"), "gram-fit")
    # Few buckets have cells that fit: only their rows go on.
    held = materialize(held.join(fit.select("gram").distinct(), "gram", "left_semi"), "gram-held")
    parts = held.select("gram", "n", "at", "comp").distinct()
    second = parts.select("gram", F.col("n").alias("m"), F.col("at").alias("other"), F.col("comp").alias("comp2"))
    apart = fit.join(parts, ["gram", "n", "at"]).join(second, ["gram", "m", "other"])
    same = (F.col("n") == F.col("m")) & (F.col("at") == F.col("other"))
    apart = apart.where((F.col("comp") != F.col("comp2")) & (~same | (F.col("comp") < F.col("comp2"))))
    theirs = held.select("gram", F.col("n").alias("m"), F.col("at").alias("other"), F.col("comp").alias("comp2"), F.col("x").alias("y"))
    met = apart.join(held, ["gram", "n", "at", "comp"]).join(theirs, ["gram", "m", "other", "comp2"])
    first = F.col("x") < F.col("y")
    pairs = met.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("p"), F.when(first, F.col("n")).otherwise(F.col("m")).alias("pn"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(first, F.col("m")).otherwise(F.col("n")).alias("n")).distinct()
    counted = seen.select(F.least("p", "x").alias("p"), F.greatest("p", "x").alias("x"))
    return pairs.join(counted, ["p", "x"], "left_anti").select("p", "pn", "x", "n")


def keep_one_of_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which each group of linked texts keeps one: its smallest id.

    Rows are told apart by id and text, so an id that repeats with texts of different groups, and a null id, stay once
    for each. Where rows of a group repeat its smallest id, one of them stays: the longest, then the first by its
    columns; a group of null ids alone keeps one likewise. Texts without words are linked with nothing and all stay.

    Rows that the filter of ids rules out stay where they lie; only the others' texts are joined with what goes.
    """
    key = F.unhex(F.md5(docs[text_col].cast("binary")))
    sets, grouped = _grouped_sets(docs, id_col, text_col, k, percent, key)
    # Of each group the rows of its smallest id stay for now; mostly that is one row.
    linked = materialize(sets.select("doc_id", "sig", "key").join(grouped, "sig").select("doc_id", "key", F.col("component").alias("group"), (~F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("other")), "gram-linked")
    release(sets, grouped)
    several = linked.where("not other").groupBy("group").agg(F.count("*").alias("rows")).where("rows > 1").select("group")
    again = linked.where("not other").join(several, "group", "left_semi").select("doc_id", "key", "group", "other")
    judged = materialize(linked.where("other").select("doc_id", "key", F.lit(None).cast("long").alias("group"), "other").unionByName(again).distinct(), "gram-judged")
    release(linked)
    maybe = maybe_in(judged, "doc_id")
    held = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), whole_rows(docs).alias("row"))
    clean = held.where(~maybe(F.col("id"))).select("row")
    near = held.where(maybe(F.col("id"))).withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    told = judged.select(F.col("doc_id").alias("id2"), F.col("key").alias("key2"), "group", "other")
    # A null text has no key and is in no group.
    joined = near.join(told, near["id"].eqNullSafe(told["id2"]) & (near["key"] == told["key2"]), "left")
    one = first_of_each(joined.where("not other"), ["group"], [-F.length("text")])
    return clean.unionByName(joined.where("other is null").select("row")).unionByName(one).select("row.*")
