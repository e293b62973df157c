"""Nearest neighbours by a block matrix join of int8 tiles with quantisation error bounds."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimforge.operators.storage import materialize

BLOCK_ROWS = 2048
#: Queries of one block; what a tile holds is at most BLOCK_ROWS x QUERY_ROWS distances.
QUERY_ROWS = 1024

BLOCKS = "dim int, rows int, ids binary, vectors binary, codes binary, scale binary, error binary, norm binary"
FOUND = "query_id long, vec_id long, score double"


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of each row, their scale, and the length of what the codes leave out."""
    scale = np.abs(x).max(axis=1) / 127.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, lengths(x - codes * scale[:, None])


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths of rows; squares that would overflow or vanish are reckoned after scaling."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        squares = (x**2).sum(axis=1)
        out = np.sqrt(squares)
        odd = ~((squares > 1e-290) & (squares < 1e300))
        if odd.any():
            most = np.abs(x[odd]).max(axis=1)
            safe = np.where(most > 0, most, 1.0)
            out[odd] = most * np.sqrt(((x[odd] / safe[:, None]) ** 2).sum(axis=1))
    return out


def _usable(ids, lists) -> dict[int, list]:
    """Ids and vectors by length, of rows with an id whose vector is whole, finite and not zero."""
    out: dict[int, list] = {}
    for i, v in zip(ids, lists, strict=True):
        if i is None or v is None or not len(v) or any(e is None for e in v):
            continue
        x = np.asarray(v, np.float64)
        if np.isfinite(x).all() and x.any():
            out.setdefault(len(x), []).append((i, x))
    return out


def blocks(vectors: DataFrame, id_col: str, vec_col: str, rows: int) -> DataFrame:
    """Rows packed into blocks of one vector length: original doubles, int8 codes and error bounds."""

    def made(batches):
        def block(dim, held):
            ids, x = np.array([i for i, _ in held], np.int64), np.stack([v for _, v in held])
            codes, scale, error = quantised(x)
            return dim, len(ids), ids.tobytes(), x.tobytes(), codes.tobytes(), scale.tobytes(), error.tobytes(), lengths(x).tobytes()

        waiting: dict[int, list] = {}
        for batch in batches:
            for dim, held in _usable(batch.column(0).to_pylist(), batch.column(1).to_pylist()).items():
                waiting.setdefault(dim, []).extend(held)
                while len(waiting[dim]) >= rows:
                    yield _batch([block(dim, waiting[dim][:rows])])
                    waiting[dim] = waiting[dim][rows:]
        for dim, held in waiting.items():
            if held:
                yield _batch([block(dim, held)])

    types = [pa.int32(), pa.int32()] + [pa.binary()] * 6
    names = [x.split(" ")[0] for x in BLOCKS.split(", ")]

    def _batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return vectors.select(F.col(id_col).cast("long"), vec_col).mapInArrow(made, BLOCKS)


class _Block:
    def __init__(self, row: dict):
        n, dim = row["rows"], row["dim"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.x = np.frombuffer(row["vectors"], np.float64).reshape(n, dim)
        self.codes = np.frombuffer(row["codes"], np.int8).reshape(n, dim)
        self.scale, self.error, self.norm = (np.frombuffer(row[k], np.float64) for k in ("scale", "error", "norm"))


def tile(q: _Block, c: _Block, k: int) -> list[tuple[int, int, float]]:
    """The ``k`` nearest of block ``c`` for each query of block ``q``, exactly.

    The product of the codes is exact in single precision (up to 1,000 dimensions; beyond, in double). It
    differs from the product of the vectors by at most |q||e_c| + |e_q||c| + |e_q||e_c|, so every
    distance has a lower and an upper bound. What lies above the k-th smallest upper bound is out; the rest is
    reckoned from the original vectors. Bounds are reckoned in units of the blocks' largest norm, so they neither
    overflow nor turn into no number.
    """
    unit = max(q.norm.max(), c.norm.max())
    qs, qe, qn, cs, ce, cn = (v / unit for v in (q.scale, q.error, q.norm, c.scale, c.error, c.norm))
    kind = np.float32 if q.codes.shape[1] <= 1000 else np.float64
    product = (q.codes.astype(kind) @ c.codes.astype(kind).T).astype(np.float64) * qs[:, None] * cs[None, :]
    slack = (qn + qe)[:, None] * ce[None, :] + qe[:, None] * (cn + ce)[None, :]
    middle = (qn**2)[:, None] + (cn**2)[None, :] - 2 * product
    slack = 2 * slack + 1e-9 * ((qn**2)[:, None] + (cn**2)[None, :])
    own = q.ids[:, None] == c.ids[None, :]
    upper = np.where(own, np.inf, middle + slack)
    most = np.partition(upper, k - 1, axis=1)[:, k - 1] if upper.shape[1] > k else np.full(len(q.ids), np.inf)
    out = []
    for i, row in enumerate((middle - slack <= most[:, None]) & ~own):
        at = np.flatnonzero(row)
        if len(at):
            far = lengths(c.x[at] - q.x[i])
            best = np.lexsort((c.ids[at], far))[:k]
            out += [(int(q.ids[i]), int(c.ids[at[b]]), float(far[b])) for b in best]
    return out


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest rows of ``vectors`` but itself.

    Query blocks meet candidate blocks in tiles; a tile hands on at most ``k`` rows a query, and bounded
    heaps merge these, first in the task and then by query. All distances that count are reckoned in double
    precision from the original vectors, so the result is exact. The block tables are all that is paired: their rows are
    thousands of vectors each.

    Null ids, null, empty or zero vectors and those with null or non-finite components take no part; vectors of another
    length than the query's are no candidates. Ties go to the smaller id. Rows that repeat an id are each a
    candidate, but none for a query of that id; a repeated query is answered once, for its smallest
    usable vector. Fewer than ``k`` candidates
    give fewer rows, an empty table none. Further columns are ignored.
    """
    vec = F.col(vec_col)
    whole = F.forall(vec, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    usable = queries.where(F.col(id_col).isNotNull() & vec.isNotNull() & whole & F.exists(vec, lambda e: e != 0))
    # A repeated query asks with its smallest usable vector.
    queries = usable.groupBy(F.col(id_col)).agg(F.min(vec_col).alias(vec_col))
    candidates = materialize(blocks(vectors, id_col, vec_col, BLOCK_ROWS), "knn-blocks")
    asked = materialize(blocks(queries.repartition(max(1, -(-queries.count() // QUERY_ROWS))), id_col, vec_col, QUERY_ROWS), "knn-queries")
    left = asked.select("dim", *(F.col(c).alias(f"q_{c}") for c in asked.columns if c != "dim"))
    tiles = candidates.crossJoin(left.withColumnRenamed("dim", "q_dim")).where("dim = q_dim")

    def joined(batches):
        heaps: dict[int, list] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
                q = _Block({**{n[2:]: v for n, v in row.items() if n.startswith("q_")}, "dim": row["dim"]})
                for query, vec, far in tile(q, _Block(row), k):
                    _push(heaps.setdefault(query, []), far, vec, k)
        yield _found(heaps)

    def merged(batches):
        heaps: dict[int, list] = {}
        for batch in batches:
            for query, vec, far in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                _push(heaps.setdefault(query, []), far, vec, k)
        yield _ranked(heaps)

    partial = tiles.mapInArrow(joined, FOUND)
    return partial.repartition(F.col("query_id")).mapInArrow(merged, "query_id long, rank int, vec_id long, score double")


def _push(heap: list, far: float, vec: int, k: int) -> None:
    """Keep the ``k`` smallest (far, vec): the heap's top is the worst."""
    item = (-far, -vec)
    if len(heap) < k:
        heapq.heappush(heap, item)
    elif item > heap[0]:
        heapq.heapreplace(heap, item)


def _found(heaps: dict[int, list]) -> pa.RecordBatch:
    rows = [(q, -v, -d) for q, heap in heaps.items() for d, v in heap]
    cols = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])


def _ranked(heaps: dict[int, list]) -> pa.RecordBatch:
    rows = [(q, r, -v, -d) for q, heap in heaps.items() for r, (d, v) in enumerate(sorted(heap, reverse=True), 1)]
    cols = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], ["query_id", "rank", "vec_id", "score"])
