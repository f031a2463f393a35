"""Exact top-k inner products by aggregation without random access.

Components become floor(scale * x). Candidates are cut into blocks; each block
has a list for every dimension, sorted once by value, which is read from the
top for queries with a positive component there and from the bottom for those
with a negative one. All lists are read to the same depth, which doubles. At
each depth a candidate's score lies between what was seen plus the least each
unread list can still add, and what was seen plus the most. Reading stops for a
query when what an unseen candidate can reach lies below the k-th best lower
bound, of this block or of those before it; the scores of the seen candidates
whose upper bound reaches that are then resolved. Ties at the bound stay in
until they are resolved, so the result is exact. Depths at which no query can
stop, since the bound of the unseen is above the k-th largest length times the
query's, are passed over without looking at candidates.

Groups of query blocks meet groups of candidate blocks, each pair of groups in
a task of its own (a cogroup on both group numbers), so both sides are shuffled
evenly whatever their number, a block's lists are sorted once for all queries
of a group, and a query's k best so far go from block to block. A pair of
groups returns k rows for each of its queries, which a window merges. Bounds
are whole numbers in double precision, exact below 2^53; larger vectors are
scaled by powers of two and bounded with a margin above the rounding error,
their last scores are whole numbers of any size.

Defined cases: vectors that are null, or hold a null or a component that is not
finite, take no part; vectors are compared with those of their own length; an
empty vector scores 0; null ids are last among ties; scores beyond a long are
held at its ends; repeated rows are candidates each and queries each, a query's
own id is not its candidate; an empty table gives no row; other columns, texts among them, are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joinwright.llm.workspace import Workspace

QUERY_BLOCK, BLOCK = 256, 4096
#: Blocks of a group at most: of queries, of candidates; the depth at which reading begins.
QUERY_GROUP, GROUP, FIRST = 64, 16, 16
FOUND = ("block", "place", "query_id", "id", "score")
EXACT, LEAST, MOST = float(1 << 53), -(1 << 63), (1 << 63) - 1


def _block_rows(rows: DataFrame, size: int, scale: float) -> DataFrame:
    """(dim, block, kind, ids, vectors): floor(scale * x), packed in the smallest type that holds it, ``size`` rows of one length at most in each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        first, made = TaskContext.get().partitionId() << 32, 0

        def out(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, vectors = held.pop(dim)
            whole = np.floor(np.concatenate(vectors) * scale)
            most = np.abs(whole).max(initial=0)
            kind = "int16" if most < 1 << 15 else "int32" if most < 1 << 31 else "float64"
            made += 1
            values = [[dim], [first + made], [kind], [ids], [whole.astype(kind).tobytes()]]
            types = [pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=["dim", "block", "kind", "ids", "vectors"])

        for batch in batches:
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
                ids, vectors = held.setdefault(len(own), ([], []))
                ids.append(key)
                vectors.append(own)
                if len(ids) == size:
                    yield out(len(own))
        for dim in list(held):
            yield out(dim)

    return rows.mapInArrow(pack, "dim int, block long, kind string, ids array<long>, vectors binary")


def _unpack(dim: int, kind: str, data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(n, dim).astype(np.float64)


class SortedBlock:
    """The sorted lists of a block, and what candidates have at least and at most after each has been read to a depth."""

    def __init__(self, x: np.ndarray, ids: np.ndarray) -> None:
        self.x, self.ids, order = x, ids, np.argsort(x, axis=0, kind="stable")
        self.most = np.abs(x).max(initial=0.0)
        scale = 2.0 ** max(0, int(np.ceil(np.log2(self.most))) if self.most else 0)
        self.scaled = x / scale
        self.scale = scale
        self.values = np.take_along_axis(self.scaled, order, axis=0)  # ascending
        self.rank = np.empty_like(order)
        np.put_along_axis(self.rank, order, np.arange(len(x))[:, None], axis=0)
        self.lengths = -np.sort(-np.sqrt((self.scaled**2).sum(axis=1)))
        self.seen: dict[int, tuple] = {}

    def outside(self, up: np.ndarray, down: np.ndarray, depth: int) -> np.ndarray:
        """What a candidate that no list has shown can have at most, by query."""
        return up @ self.values[len(self.x) - depth] + down @ self.values[depth - 1]

    def read(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """[candidate, dimension]: what is seen, or else the least (the most) that is left, from the top and from the bottom."""
        if depth not in self.seen:
            top, bottom = self.rank >= len(self.x) - depth, self.rank < depth
            pick = lambda seen, rest: np.where(seen, self.scaled, rest)
            v, n = self.values, len(self.x)
            self.seen[depth] = (pick(top, v[0]), pick(bottom, v[-1]), pick(top, v[n - depth]), pick(bottom, v[depth - 1]))
        return self.seen[depth]


def search_block(block: SortedBlock, q: np.ndarray, own: np.ndarray, k: int, known: np.ndarray | None = None) -> list[tuple[int, np.ndarray, list[int], int]]:
    """(query's place, candidates' places, scores, depth read): what of the block can be among the k best of each query, k rows at most, ties to the smaller id.

    ``known``: the k-th best score that is known for each query (-inf where there is none).
    """
    x, ids = block.x, block.ids
    n, dim = x.shape
    out: list[tuple[int, np.ndarray, list[int], int]] = []
    if not n or not len(q):
        return out
    most = np.abs(q).max(initial=0.0)
    exact = block.most * most * max(dim, 1) < EXACT
    scale = 2.0 ** max(0, int(np.ceil(np.log2(most))) if most else 0)
    asks = q / scale
    with np.errstate(over="ignore", under="ignore"):
        unit = 1.0 / block.scale / scale  # of a score; zero where no long can tell scores apart
    low, high = LEAST * unit, MOST * unit
    margin = 0.0 if exact else (dim + 2) * dim * 2.0**-50
    bar = np.full(len(q), -np.inf) if known is None or not exact else known * unit
    up, down = np.maximum(asks, 0), np.minimum(asks, 0)
    ceiling = np.sqrt((asks**2).sum(axis=1)) * (block.lengths[k - 1] if n > k else np.inf) * (1 + 1e-9) + margin

    def resolve(j: int, places: np.ndarray, depth: int) -> None:
        if exact:
            scores = (x[places] @ q[j]).astype(np.int64)
            best = np.lexsort((ids[places], -scores))[:k]
            out.append((j, places[best], scores[best].tolist(), depth))
            return
        whole = [int(v) for v in q[j]]
        scores = [min(max(sum(a * int(b) for a, b in zip(whole, x[i])), LEAST), MOST) for i in places]
        best = sorted(range(len(places)), key=lambda i: (-scores[i], ids[places[i]]))[:k]
        out.append((j, places[best], [scores[i] for i in best], depth))

    open_, depth = np.arange(len(q)), FIRST
    while len(open_):
        depth = min(depth, n)
        outside = block.outside(up[open_], down[open_], depth) if depth < n else np.full(len(open_), -np.inf)
        may = np.clip(outside, low, high) < np.maximum(np.minimum(ceiling[open_], high), bar[open_]) if depth < n else np.ones(len(open_), bool)
        asked = open_[may]
        if len(asked):
            parts = block.read(depth) if depth < n else (block.scaled,) * 4
            mine = ids[:, None] == own[asked][None, :]
            lower = np.clip(parts[0] @ up[asked].T + parts[1] @ down[asked].T, low, high)
            lower[mine] = -np.inf
            own_bar = np.partition(lower, n - k, axis=0)[n - k] if n > k else np.full(len(asked), -np.inf)
            own_bar = np.maximum(own_bar, bar[asked])
            done = np.clip(outside[may] + margin, low, high) < own_bar if depth < n else np.ones(len(asked), bool)
            if done.any():
                upper = np.clip(parts[2] @ up[asked[done]].T + parts[3] @ down[asked[done]].T, low, high)
                can = (upper + 2 * margin >= own_bar[done]) & ~mine[:, done]
                for at, j in enumerate(asked[done].tolist()):
                    resolve(j, np.nonzero(can[:, at])[0], depth)
                open_ = np.setdiff1d(open_, asked[done], assume_unique=True)
        depth *= 2
    return out


def _best_of(queries: pa.Table, blocks: pa.Table, k: int) -> pa.Table:
    """The k best of a group of candidate blocks for each query of a group of query blocks."""
    asked = [(number, _unpack(dim, kind, q, len(own)), np.array(own, np.int64)) for number, dim, kind, own, q in zip(*(queries.column(c).to_pylist() for c in ("block", "dim", "q_kind", "asked", "q")))]
    found: list[list[list[tuple[int, int]]]] = [[[] for _ in own] for *_, own in asked]
    known = [np.full(len(own), -np.inf) for *_, own in asked]
    for at in range(blocks.num_rows):
        dim, kind, ids, data = (blocks.column(c)[at].as_py() for c in ("dim", "kind", "ids", "vectors"))
        block = SortedBlock(_unpack(dim, kind, data, len(ids)), np.array(ids, np.int64))
        for (_, q, own), best, least in zip(asked, found, known):
            for j, places, scores, _ in search_block(block, q, own, k, least):
                best[j] = sorted([*best[j], *zip([-s for s in scores], block.ids[places].tolist())])[:k]
                if len(best[j]) == k:
                    least[j] = float(-best[j][-1][0])
    rows = [(number, j, int(i), c, -s) for (number, _, own), best in zip(asked, found) for j, (i, mine) in enumerate(zip(own, best)) for s, c in mine]
    return pa.table({n: pa.array([r[c] for r in rows], pa.int64()) for c, n in enumerate(FOUND)})


def _groups(asked: int, blocks: int, cores: int) -> tuple[int, int]:
    """Numbers of groups of query blocks and of candidate blocks: as few as their bounds allow, more where cores would idle."""
    g, h = max(1, -(-asked // QUERY_GROUP)), max(1, -(-blocks // GROUP))
    while g * h < cores and (g < asked or h < blocks):
        if h < blocks and (blocks / h >= asked / g or g >= asked):
            h = min(blocks, 2 * h)
        else:
            g = min(asked, 2 * g)
    return g, h


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score) of the ``k`` best candidates of each row where ``is_query``."""
    spark = vectors.sparkSession
    work = Workspace(spark, "topk")
    none = np.iinfo(np.int64).max
    good = F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.where(good).select(F.coalesce(F.col(id_col).cast("long"), F.lit(none)).alias("id"), is_query.alias("is_query"), F.col(vector_col).cast("array<double>").alias("v"))
    n_queries = rows.where("is_query").count()
    asked = rows.where("is_query").select("id", "v").repartition(max(1, n_queries // QUERY_BLOCK), "id", "v")
    asked = work.write(_block_rows(asked, QUERY_BLOCK, scale).toDF("dim", "block", "q_kind", "asked", "q"), "queries")
    blocks = work.write(_block_rows(rows.select("id", "v"), BLOCK, scale), "blocks")
    g, h = _groups(asked.count(), blocks.count(), 4 * spark.sparkContext.defaultParallelism)
    group = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("*", group(g).alias("g"), every(h).alias("h")).groupBy("dim", "g", "h")
    right = blocks.select("*", group(h).alias("h"), every(g).alias("g")).groupBy("dim", "g", "h")
    best = left.cogroup(right).applyInArrow(lambda q, c: _best_of(q, c, k), ", ".join(f"{c} long" for c in FOUND))
    rank = F.row_number().over(Window.partitionBy("block", "place").orderBy(F.desc("score"), "id"))
    real = lambda c: F.when(F.col(c) < none, F.col(c)).alias(c)
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select(real("query_id"), "rank", real("id"), "score")
