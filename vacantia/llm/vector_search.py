"""Nearest neighbours by a block matrix join with int8 tiles.

Every vector is scaled to length 1 and rounded to int8 with a scale of its own; the length of what the rounding leaves is kept. With
``x = s q + e`` the product of two vectors differs from the product of their int8 parts by at most
``(1 + |e_x|) |e_y| + |e_x|``. Queries and candidates are dealt over a grid of cells: each cell holds one block of queries and
streams one column of candidates. A tile of int8 products and the bound exclude nearly all pairs against the score that a query's k-th
best pair has so far; only the pairs that survive are computed again from the original vectors in double precision. A heap per query
holds the best of a cell, and the heaps of a query's cells are merged.

Equal vectors are one candidate that carries the smallest ids with that vector, one more than a query wants; no result can need
more of them, as ties go to the smaller id. Equal query vectors are searched once. So a vector that fills a third of the
table costs one row per task in its shuffle and one candidate in the search.

The work of an exact search is queries times candidates; the grid bounds what a task holds: ``QUERY_BLOCK`` queries and one tile.

Defined results: per query row its nearest rows, nearest first, ties to the smaller vec_id (null last); every row but the
query's own is a candidate, so a repeated row is a candidate of the other. Fewer candidates give fewer rows. Rows whose vec_id is null
are candidates but no queries. Vectors that are null, empty, zero or hold null, NaN or infinite components take no part; a vector
meets only those with as many components. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from vacantia.llm.common import written

NEAREST, EVERY = 5, 50
#: Queries of a cell, and queries and candidates of a tile.
QUERY_BLOCK, TILE_QUERIES, TILE = 16_384, 1_024, 1_024
#: Candidates of a cell, about.
COLUMN = 262_144
#: Components whose int8 products a 32-bit float sums without rounding: 1,024 times 127 squared is below 2**24.
EXACT_COMPONENTS = 1_024
#: What products of 32-bit floats may be off by, beside the bound of the int8 parts.
SLACK = 1e-5
#: Pairs that are computed again at once.
PAIRS = 32_768


# --- vectors -----------------------------------------------------------------------------------------------------------------

class Quantised:
    """Unit vectors as int8 codes (held as floats for the matrix product), scales, and lengths of what rounding left."""

    def __init__(self, vectors: np.ndarray):
        # Powers of two change no digit of a cosine, and keep squares of very large and very small numbers in range.
        exponent = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1]
        self.vectors = unit = np.ldexp(vectors, -exponent)
        unit = unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        scale = np.abs(unit).max(axis=1) / 127
        code = np.rint(unit / scale[:, None])
        left = unit - code * scale[:, None]
        self.code, self.scale = code.astype(np.int8), scale
        self.error = np.sqrt((left * left).sum(axis=1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of all pairs of int8 rows, as floats; exact up to ``EXACT_COMPONENTS`` components at a time."""
    out = None
    for at in range(0, a.shape[1], EXACT_COMPONENTS):
        part = a[:, at:at + EXACT_COMPONENTS].astype(np.float32) @ b[:, at:at + EXACT_COMPONENTS].astype(np.float32).T
        out = part if out is None else out + part
    return out


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of equal rows in double precision. Sums run from the first component to the last, so results are the same on
    every machine."""
    out = np.empty(len(a))
    for at in range(0, len(a), PAIRS):
        x, y = a[at:at + PAIRS], b[at:at + PAIRS]
        total = lambda z: z.cumsum(axis=1)[:, -1]
        out[at:at + PAIRS] = total(x * y) / np.sqrt(total(x * x) * total(y * y))
    return np.clip(out, -1.0, 1.0)


# --- cells -------------------------------------------------------------------------------------------------------------------

#: The best of a query in a cell, best first. An entry is (score, id known, id, row).
FOUND = "h1 long, h2 long, scores array<double>, ids array<long>, uids array<long>"


class Cell:
    """The queries of a cell with a heap each."""

    def __init__(self, keys: list[tuple[int, int]], vectors: np.ndarray, wanted: int):
        self.keys, self.queries, self.wanted = keys, Quantised(vectors), wanted
        self.heaps: list[list] = [[] for _ in keys]
        #: Score that a pair must reach: the k-th best so far.
        self.least = np.full(len(keys), -np.inf)

    def meet(self, candidates: Quantised, members: list[list[tuple]]) -> None:
        """Hold a tile of candidates against all queries."""
        q = self.queries
        for at in range(0, len(self.keys), TILE_QUERIES):
            own = slice(at, at + TILE_QUERIES)
            near = products(q.code[own], candidates.code)
            near *= candidates.scale.astype(np.float32)
            near *= q.scale[own, None].astype(np.float32)
            bound = (1 + q.error[own]) * candidates.error.max() + q.error[own] + SLACK
            least = self.least[own].copy()
            open_ = np.flatnonzero(np.isneginf(least))
            if len(open_) and near.shape[1] > self.wanted:
                # No full heap yet: the k-th largest product less its bound is reached by k pairs of this tile.
                kth = np.partition(near[open_], near.shape[1] - self.wanted, axis=1)[:, near.shape[1] - self.wanted]
                least[open_] = kth - bound[open_]
            row, column = np.nonzero(near >= (least - bound)[:, None].astype(np.float32))
            self._take(row + at, column, candidates, members)

    def _take(self, row: np.ndarray, column: np.ndarray, candidates: Quantised, members: list[list[tuple]]) -> None:
        for at in range(0, len(row), PAIRS):
            r, c = row[at:at + PAIRS], column[at:at + PAIRS]
            scores = cosines(self.queries.vectors[r], candidates.vectors[c])
            good = np.flatnonzero(scores >= self.least[r])
            for i, j, score in zip(r[good].tolist(), c[good].tolist(), scores[good].tolist()):
                heap = self.heaps[i]
                for known, minus_id, minus_uid in members[j]:
                    entry = score, known, minus_id, minus_uid
                    if len(heap) < self.wanted:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                    else:
                        break
                if len(heap) == self.wanted:
                    self.least[i] = heap[0][0]

    def results(self) -> Iterator[pa.RecordBatch]:
        yield from found_batches((key, heapq.nlargest(self.wanted, heap)) for key, heap in zip(self.keys, self.heaps))


def found_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of ``FOUND`` from keys and entries, best first."""
    columns: list[list] = [[] for _ in range(5)]

    def batch() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in FOUND.split(", ")])

    for (h1, h2), entries in rows:
        if entries:
            ids = [-e[2] if e[1] else None for e in entries]
            for column, value in zip(columns, (h1, h2, [e[0] for e in entries], ids, [-e[3] for e in entries])):
                column.append(value)
        if len(columns[0]) >= 4096:
            yield batch()
            columns = [[] for _ in range(5)]
    if columns[0]:
        yield batch()


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of vectors of one size as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def search_cells(batches: Iterator[pa.RecordBatch], wanted: int) -> Iterator[pa.RecordBatch]:
    """Rows (row, column, size, side, h1, h2, vector, members) in order of cell and side, queries first, to ``FOUND``."""
    cell, at = None, None
    keys: list[tuple[int, int]] = []
    waiting: list[np.ndarray] = []
    for batch in batches:
        get = lambda name, b=batch: b.column(b.schema.get_field_index(name))
        marks = np.stack([get(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("row", "column", "size", "side")], axis=1)
        edges = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(marks)]
        for start, end in zip(edges, edges[1:]):
            if start == end:
                continue
            here, side = tuple(marks[start, :3].tolist()), marks[start, 3]
            if here != at:
                if cell is not None:
                    yield from cell.results()
                cell, at, keys, waiting = None, here, [], []
            if side == 0:
                keys += zip(get("h1").slice(start, end - start).to_pylist(), get("h2").slice(start, end - start).to_pylist())
                waiting.append(matrix(get("vector").slice(start, end - start)))
                continue
            if not keys:
                continue
            if cell is None:
                cell, waiting = Cell(keys, np.concatenate(waiting), wanted), []
            for first in range(start, end, TILE):
                n = min(TILE, end - first)
                members = [
                    [(m["vec_id"] is not None, -(m["vec_id"] or 0), -m["uid"]) for m in row] for row in get("members").slice(first, n).to_pylist()]
                cell.meet(Quantised(matrix(get("vector").slice(first, n))), members)
    if cell is not None:
        yield from cell.results()


def merge_heaps(batches: Iterator[pa.RecordBatch], wanted: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``FOUND`` in order of query, one per cell, to one per query."""
    def rows() -> Iterator[tuple]:
        key, lists = None, []
        for batch in batches:
            for r in batch.to_pylist():
                here = r["h1"], r["h2"]
                entries = [(s, i is not None, -(i or 0), -u) for s, i, u in zip(r["scores"], r["ids"], r["uids"])]
                if here != key:
                    if key is not None:
                        yield key, lists
                    key, lists = here, entries
                else:
                    lists = heapq.nlargest(wanted, lists + entries)
        if key is not None:
            yield key, lists

    return found_batches(rows())


# --- the job -----------------------------------------------------------------------------------------------------------------

def usable(vector: Column) -> Column:
    """Vectors with a direction: only finite components, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)
    return vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, nearest_k: int = NEAREST, query_block: int = QUERY_BLOCK, column: int = COLUMN) -> DataFrame:
    """query_id, rank, vec_id, score of the ``nearest_k`` rows of ``vectors`` (vec_id, embedding) next to each row with ``is_query``."""
    spark = vectors.sparkSession
    wanted = nearest_k + 1
    vector = F.col("embedding").cast("array<double>")
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"),
        F.monotonically_increasing_id().alias("uid")).where(usable(F.col("vector")) & (F.size("vector") > 0))
    keyed = rows.select("vec_id", "vector", "asks", "uid", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"))
    keyed = written(keyed, "vectors")

    # The ranks are limited in each task before the shuffle, so a frequent vector sends few rows.
    order = Window.partitionBy("h1", "h2").orderBy(F.col("vec_id").asc_nulls_last(), "uid")
    first = keyed.drop("asks").withColumn("n", F.row_number().over(order)).where(F.col("n") <= wanted)
    candidates = first.groupBy("h1", "h2").agg(
        F.any_value("vector").alias("vector"), F.sort_array(F.collect_list(F.struct("n", "vec_id", "uid"))).alias("members"))
    candidates = written(candidates.withColumn("members", F.transform("members", lambda m: F.struct(m["vec_id"].alias("vec_id"), m["uid"].alias("uid")))), "candidates")
    asking = keyed.where("asks").select("uid", "vec_id", "h1", "h2")
    queries = written(keyed.where("asks").groupBy("h1", "h2").agg(F.any_value("vector").alias("vector")), "queries")

    n_queries, n_candidates = queries.count(), candidates.count()
    parallel = max(1, spark.sparkContext.defaultParallelism)
    n_rows = max(1, -(-n_queries // query_block))
    n_columns = max(1, -(-n_candidates // column), min(-(-4 * parallel // n_rows), -(-n_candidates // TILE)))
    side = lambda df, own, dealt, other, n_other, mark, members: df.select(
        F.pmod("h1", F.lit(dealt)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other),
        F.size("vector").alias("size"), F.lit(mark).alias("side"), "h1", "h2", "vector", members.alias("members"))
    none = F.array().cast("array<struct<vec_id:bigint,uid:bigint>>")
    names = ["row", "column", "size", "side", "h1", "h2", "vector", "members"]
    cells = side(queries, "row", n_rows, "column", n_columns, 0, none).select(*names).unionByName(
        side(candidates, "column", n_columns, "row", n_rows, 1, F.col("members")).select(*names))
    # The key of a cell is its number, so that cells are dealt evenly and not by a hash of few values.
    cells = cells.withColumn("cell", F.col("row") * F.lit(n_columns) + F.col("column"))
    ordered = cells.repartitionByRange(n_rows * n_columns, "cell").sortWithinPartitions("cell", "size", "side", "h1", "h2").drop("cell")
    found = written(ordered.mapInArrow(lambda it: search_cells(it, wanted), FOUND), "found")
    # Plain hashes on both sides: a row of found per cell, so no key is large.
    merged = found.repartition("h1", "h2").sortWithinPartitions("h1", "h2").mapInArrow(lambda it: merge_heaps(it, wanted), FOUND)
    merged = written(merged, "merged")
    entries = F.filter(F.arrays_zip("scores", "ids", "uids"), lambda e: e["uids"] != F.col("uid"))
    best = asking.join(merged, ["h1", "h2"]).select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(entries, 1, nearest_k)).alias("rank", "e"))
    return best.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("e.ids").alias("vec_id"), F.col("e.scores").alias("score"))


def every_nth(n: int = EVERY) -> Column:
    """The stated query set: rows whose id is divisible by ``n``."""
    return F.col("vec_id") % n == 0


SQL = """
WITH v AS (
    SELECT row_number() OVER () AS uid, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
    SELECT q.uid, q.vec_id AS query_id, c.vec_id, c.uid AS other, list_cosine_similarity(q.e, c.e) AS score
    FROM v AS q JOIN v AS c ON q.uid <> c.uid AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id NULLS LAST, other) AS rank, vec_id, score FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
