"""Tokenising documents and packing them into fixed-length sequences by best-two-fit."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimforge.llm.common import arrow_batches, give_back, parts_for
from claimforge.operators.storage import materialize

SEQUENCE_TOKENS = 2048
SEPARATOR_ID = 0
#: Pieces that one task packs together, at about; a group leaves at most about one sequence half full.
GROUP_PIECES = 50_000
#: Entries of a worker's cache of encoded words before it starts anew.
CACHE_WORDS = 100_000
#: Texts that a worker is given at a time.
BATCH_TEXTS = 256

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Cache(dict):
    """Word -> its ids as packed little-endian 32-bit numbers."""

    def __init__(self, encode, before: str):
        self.encode, self.before = encode, before

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        packed = self.encode(self.before + word)
        if len(word) < 64:
            self[word] = packed
        return packed


class Encoder:
    """Byte-level BPE of a ``tokenizers`` file, word by word, with the words' ids kept.

    The vocabulary and the merge order (a token's id) come from that file. A byte-level BPE
    splits a text before every space that follows a non-space, so the ids of a text are those
    of its space-led words; only where white space stands on both sides of a space (or ends
    the text behind another one) is the text encoded as a whole. A text that holds the string of one of
    the file's added tokens is left to ``tokenizers`` itself, which gives that token's id for it, and so is one with
    a run of white space so long that the word pattern would exhaust its stack.
    """

    #: White space around a space, or a last space after white space.
    RUNS = re.compile(r"\s (?:\s|\Z)")
    #: Fixed value: the pattern by which this family of vocabularies splits words.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, vocabulary: str):
        import tiktoken

        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"] for x in spec.get("added_tokens", ()) if x.get("special")}
        added = [re.escape(x["content"]) for x in spec.get("added_tokens", ()) if x["content"]]
        self._odd = re.compile("|".join([*added, r"\s{5000}"]))
        self._file, self._whole = vocabulary, None
        as_byte = {c: b for b, c in _byte_letters().items()}
        ranks = {bytes(as_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self._bpe = tiktoken.Encoding("byte-level", pat_str=self.SPLIT, mergeable_ranks=ranks, special_tokens={})
        self._first, self._spaced = _Cache(self.packed, ""), _Cache(self.packed, " ")

    def packed(self, text: str) -> bytes:
        return array("I", self._bpe.encode_ordinary(text)).tobytes()

    def _by_file(self, text: str) -> bytes:
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self._file)
        return array("I", self._whole.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as unsigned little-endian 32-bit numbers."""
        if self._odd.search(text):
            return self._by_file(text)
        if self.RUNS.search(text):
            return self.packed(text)
        words = text.split(" ")
        return self._first[words[0]] + b"".join(map(self._spaced.__getitem__, words[1:]))


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def tokenized_pieces(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", most: int = SEQUENCE_TOKENS) -> DataFrame:
    """Documents as pieces of at most ``most`` ids, the separator included, with a checksum of the ids.

    Only a document longer than ``most`` is cut; all its pieces are full but the first.
    """
    vocabulary = vocabulary or default_vocabulary()
    separator = array("I", [SEPARATOR_ID]).tobytes()

    def pieces(batches):
        encoder = Encoder(vocabulary)
        for batch in batches:
            cols = [[] for _ in range(5)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py() or "") + separator
                n = len(ids) // 4
                start, piece, end = 0, 0, n - (-(-n // most) - 1) * most
                while start < n:
                    for col, x in zip(cols, (doc, piece, start, end - start, zlib.crc32(ids[4 * start : 4 * end])), strict=True):
                        col.append(x)
                    start, piece, end = end, piece + 1, end + most
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        del encoder
        give_back()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(pieces, PIECES)


def best_two_fit(lengths: np.ndarray, most: int = SEQUENCE_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """Bins (bin, offset) for ``lengths`` (each 1 to ``most``), of which equal ones are alike.

    The longest unpacked document opens a bin, which is filled greedily with the longest that
    fits. A bin that is then not full gives up its smallest document where two unpacked ones fit
    the gap, so expanded, more tightly; the one given up is unpacked again.
    """
    order = np.argsort(-lengths, kind="stable")
    left = np.bincount(lengths, minlength=most + 1).tolist()
    present = sorted(x for x in range(1, most + 1) if left[x])
    bins: list[list[int]] = []

    def take(x: int) -> None:
        left[x] -= 1
        if not left[x]:
            present.pop(bisect_right(present, x) - 1)

    def put_back(x: int) -> None:
        if not left[x]:
            present.insert(bisect_right(present, x), x)
        left[x] += 1

    while present:
        held, gap = [], most
        while gap and (at := bisect_right(present, gap)):
            x = present[at - 1]
            # As many as fit at once: they stay the longest that fit.
            for _ in range(min(left[x], gap // x)):
                take(x)
                held.append(x)
                gap -= x
        if gap and len(held) > 1 and (pair := _best_pair(present, left, gap + held[-1], held[-1])):
            put_back(held.pop())
            for x in pair:
                take(x)
                held.append(x)
        bins.append(held)

    # Deal the documents of each length to its places, in order.
    places: dict[int, list[tuple[int, int]]] = {}
    for b, held in enumerate(bins):
        at = 0
        for x in held:
            places.setdefault(x, []).append((b, at))
            at += x
    bin_of, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, x in zip(order[::-1].tolist(), lengths[order[::-1]].tolist(), strict=True):
        bin_of[i], offset[i] = places[x].pop()
    return bin_of, offset


def _best_pair(present: list[int], left: list[int], room: int, beat: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum of at most ``room``, if more than ``beat``."""
    best, pair = beat, None
    low, high = 0, bisect_right(present, room - 1) - 1
    while low <= high:
        a, b = present[low], present[high]
        if a + b > room or (low == high and left[a] < 2):
            high -= 1
            continue
        if a + b > best:
            best, pair = a + b, (b, a)
            if best == room:
                break
        low += 1
    return pair


def pack(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", most: int = SEQUENCE_TOKENS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack every document into sequences of at most ``most`` tokens: one row per piece.

    The texts are tokenised where they are read. Only the small rows of pieces move: each is dealt
    at random (by its place in the written table, so a rerun of a task deals alike) to a group of
    about ``group_pieces``, and a group is packed by one task. ``sequence_id`` is the group
    times 2^32 plus the bin; ``offset`` is gapless from 0.

    Null or empty text is the separator alone, one token. A null id stays null; repeated rows are packed each; ties in
    length keep the order of id and piece; an empty table gives no rows. Further columns are ignored.
    """
    with arrow_batches(docs.sparkSession, BATCH_TEXTS):
        pieces = materialize(tokenized_pieces(docs, vocabulary, id_col, text_col, most), "pieces")
    groups = parts_for(pieces.count(), group_pieces)
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def packed(pdf):
        pdf = pdf.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offsets = best_two_fit(pdf["length"].to_numpy(np.int64), most)
        return pdf.assign(sequence_id=pdf["grp"].to_numpy(np.int64) * (1 << 32) + bins, offset=offsets).drop(columns="grp")

    return dealt.groupBy("grp").applyInPandas(packed, PIECES + ", sequence_id long, offset long")
