"""Exact dedup over a cuckoo-filter index of live digests."""

from __future__ import annotations

from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimforge.llm.common import SPACE, parts_for
from claimforge.llm.presence import first_of_each, maybe_in, whole_rows
from claimforge.operators.storage import materialize

#: Digests of one shard of the index, at about.
SHARD_DIGESTS = 100_000
#: Summaries that a task holds before it hands them on.
HELD_SUMMARIES = 100_000
SLOTS = 4
MOST_KICKS = 200


class CuckooIndex:
    """A cuckoo filter of 16-bit fingerprints over live digests, with their content in buckets.

    A miss in the filter is certain; a hit is verified against the full digests stored in the
    bucket of the key. Only a verified digest is deleted, so deletions never harm another.
    When an insertion finds no place after ``MOST_KICKS`` moves, the filter doubles and is made
    again from the stored keys.
    """

    def __init__(self, buckets: int = 1024):
        self.buckets, self.resized, self.false_hits = max(2, 1 << (buckets - 1).bit_length()), 0, 0
        self.stored: dict[int, dict[bytes, object]] = {}
        self._prints = array("H", bytes(2 * SLOTS * self.buckets))
        self.live = 0

    def _place(self, digest: bytes) -> tuple[int, int, int]:
        print_ = int.from_bytes(digest[8:10], "little") or 1
        first = int.from_bytes(digest[:8], "little") & (self.buckets - 1)
        return print_, first, self._other(first, print_)

    def _other(self, bucket: int, print_: int) -> int:
        return bucket ^ ((print_ * 0x5BD1E995) & (self.buckets - 1))

    def _holds(self, bucket: int, print_: int) -> int:
        at = bucket * SLOTS
        for i in range(at, at + SLOTS):
            if self._prints[i] == print_:
                return i
        return -1

    def maybe(self, digest: bytes) -> bool:
        """What the filter alone says."""
        print_, first, second = self._place(digest)
        return self._holds(first, print_) >= 0 or self._holds(second, print_) >= 0

    def get(self, digest: bytes):
        """The value stored for a live digest, else None."""
        if not self.maybe(digest):
            return None
        found = self.stored.get(self._place(digest)[1], {}).get(digest)
        self.false_hits += found is None
        return found

    def insert(self, digest: bytes, value) -> None:
        """Add a digest that is not live."""
        self.stored.setdefault(self._place(digest)[1], {})[digest] = value
        self.live += 1
        if not self._add(digest):
            self._grow()

    def delete(self, digest: bytes) -> bool:
        """Remove a live digest; False if it isn't."""
        if self.get(digest) is None:
            return False
        print_, first, second = self._place(digest)
        at = self._holds(first, print_)
        self._prints[at if at >= 0 else self._holds(second, print_)] = 0
        bucket = self.stored[first]
        del bucket[digest]
        if not bucket:
            del self.stored[first]
        self.live -= 1
        return True

    def items(self):
        for bucket in self.stored.values():
            yield from bucket.items()

    def _add(self, digest: bytes) -> bool:
        print_, first, second = self._place(digest)
        bucket = first
        for bucket in (first, second):
            if (at := self._holds(bucket, 0)) >= 0:
                self._prints[at] = print_
                return True
        for kick in range(MOST_KICKS):
            at = bucket * SLOTS + kick % SLOTS
            print_, self._prints[at] = self._prints[at], print_
            bucket = self._other(bucket, print_)
            if (free := self._holds(bucket, 0)) >= 0:
                self._prints[free] = print_
                return True
        return False

    def _grow(self) -> None:
        """Double and refill from the stored keys, until all have a place."""
        keys = list(self.items())
        while True:
            self.buckets *= 2
            self.resized += 1
            self._prints = array("H", bytes(2 * SLOTS * self.buckets))
            if all(self._add(digest) for digest, _ in keys):
                break
        self.stored = {}
        for digest, value in keys:
            self.stored.setdefault(self._place(digest)[1], {})[digest] = value


def content_digest(text: Column) -> Column:
    """SHA-256 of the text without white space; null counts as empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), SPACE, "").cast("binary"), 256))


def _better(a: tuple, b: tuple) -> tuple:
    """The row that stays: most code points, then smallest id (null last), then first in the table."""
    rank = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    return a if rank(a) <= rank(b) else b


SUMMARY = "digest binary, members long, n long, doc_id long, row long"
_SUMMARY = pa.schema([("digest", pa.binary()), ("members", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_SUMMARY)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _SUMMARY.types, strict=True)], schema=_SUMMARY)


def _summed_before(batches):
    """Rows of a task summed by digest, so that a hot digest leaves it as a few rows."""
    held: dict[bytes, tuple] = {}
    for batch in batches:
        for digest, n, doc, row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            old = held.get(digest)
            held[digest] = (1, (n, doc, row)) if old is None else (old[0] + 1, _better(old[1], (n, doc, row)))
        if len(held) >= HELD_SUMMARIES:
            yield _batch([(d, c, *best) for d, (c, best) in held.items()])
            held = {}
    yield _batch([(d, c, *best) for d, (c, best) in held.items()])


def _indexed(batches):
    """The groups of a shard: every summary goes through the shard's index."""
    index = CuckooIndex()
    for batch in batches:
        for digest, members, n, doc, row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            entry = index.get(digest)
            if entry is None:
                index.insert(digest, [members, (n, doc, row)])
            else:
                entry[0] += members
                entry[1] = _better(entry[1], (n, doc, row))
    out = [(digest, members, *best) for digest, (members, best) in index.items() if members > 1]
    for i in range(0, len(out), 10_000):
        yield _batch(out[i : i + 10_000])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (doc_id, keep_id, group_size, kept, text_sha256, row).

    Texts are equal when they are identical without white space. Of equal texts the row with the most
    code points stays, then the smallest id. The texts are read once; their digests (32 bytes)
    are summed by task, dealt to shards of a cuckoo-filter index, and the groups of more than
    one come back by a join on the digest, which adaptive execution splits for a hot one.

    Null text counts as empty, and all empty texts are one group. A null id sorts after all others. Rows that repeat
    id and text are members like others; of rows that tie in all this the first in the table stays, so exactly one row of a group is kept. An
    empty table gives no rows. Further columns are ignored.
    """
    text = F.col(text_col)
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), content_digest(text).alias("digest"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n"))
    digests = materialize(sized.withColumn("row", F.monotonically_increasing_id()), "digests")
    shards = parts_for(digests.count(), SHARD_DIGESTS)
    summed = digests.select("digest", "n", "doc_id", "row").mapInArrow(_summed_before, SUMMARY)
    groups = summed.repartition(max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64("digest")).mapInArrow(_indexed, SUMMARY)
    groups = materialize(groups.select("digest", "members", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row")), "groups")
    joined = digests.join(groups, "digest", "left")
    alone = F.col("members").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("members", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "row",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns under any names.

    Ids are looked up together with the content, so rows of one id and different texts are judged apart; of
    rows that repeat id and content exactly one stays, that of the most code points, then the first by its columns.
    Null, empty and blank texts are equal, so one row of them stays. A null id stays null. An empty table gives no rows.

    Rows that a filter of the ids of dropped rows rules out stay where they lie; only the others' texts are joined.
    """
    groups = exact_groups(docs, id_col, text_col).select("doc_id", "text_sha256", "kept")
    # How many rows of an id and content stay, where others of them go: none or one.
    judged = groups.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("stays"), F.min("kept").alias("all_stay")).where("not all_stay")
    judged = materialize(judged.select(F.col("doc_id").alias("id2"), F.unhex("text_sha256").alias("digest2"), "stays"), "gone")
    maybe = maybe_in(judged, "id2")
    held = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), whole_rows(docs).alias("row"))
    clean = held.where(~maybe(F.col("id"))).select("row")
    copies = held.where(maybe(F.col("id"))).withColumn("digest", content_digest(F.col("text")))
    joined = copies.join(judged, copies["id"].eqNullSafe(judged["id2"]) & (copies["digest"] == judged["digest2"]), "left")
    one = first_of_each(joined.where("stays"), ["id", "digest"], [-F.coalesce(F.length("text"), F.lit(0))])
    return clean.unionByName(joined.where("stays is null").select("row")).unionByName(one).select("row.*")


CHANGED = "digest binary, refs long"


def apply_changes(index: DataFrame, changes: DataFrame, shard_digests: int = SHARD_DIGESTS) -> DataFrame:
    """The live digests (digest, refs) after insertions and deletions.

    ``index`` has (digest, refs); ``changes`` has (digest, seq, delta) with delta +1 for a document that
    comes and -1 for one that goes, applied in order of ``seq``. A digest leaves the
    index with its last reference; a deletion of what isn't live does nothing. Both are dealt by digest, and each shard
    loads its keys into a cuckoo-filter index before it applies its changes. Null digests are skipped; empty tables are fine.
    """
    live = index.select("digest", F.lit(None).cast("long").alias("seq"), F.col("refs").alias("delta"))
    rows = live.unionByName(changes.select("digest", F.col("seq").cast("long"), F.col("delta").cast("long"))).where("digest is not null")
    shards = parts_for(rows.count(), shard_digests)

    def applied(batches):
        shard = CuckooIndex()
        for batch in batches:
            for digest, delta in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                entry = shard.get(digest)
                if entry is None:
                    if delta > 0:
                        shard.insert(digest, [delta])
                elif entry[0] + delta > 0:
                    entry[0] += delta
                else:
                    shard.delete(digest)
        out = [(d, v[0]) for d, v in shard.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64())], ["digest", "refs"])

    return rows.repartition(shards, F.xxhash64("digest")).sortWithinPartitions(F.col("seq").asc_nulls_first()).mapInArrow(applied, CHANGED)
