"""SimHash near-duplicate groups by tiled exact comparison.

Fingerprints come from XXH64 of word shingles. Distinct fingerprints are cut
into tiles by population count; two tiles are compared only where their counts
can be within the radius. Inside a pair of tiles the same test is made again on
small tiles, with a count for each of the eight bytes (tiles stand in groups,
and a task loads two groups for all pairs of their tiles): the sum of the gaps
between two tiles' byte counts is a lower bound of the distance of any two
members. What is left is compared in full, with exclusive-or and bit counts.

A pair of tiles returns a spanning forest of its links, never all of them, so
a large group of copies costs as many rows as it has members.

Defined cases: a null text counts as empty; no word gives fingerprint zero,
which is linked like any other; null ids keep their row and are ignored when a
group's smallest id is sought; repeated rows are returned repeated; a very long
text is hashed whole in its task; of ids that tie for a component's smallest all
rows have it; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinwright.llm.components import connected_components
from joinwright.llm.filters import build_filter, maybe_in
from joinwright.llm.workspace import Workspace

LANES = np.uint64(0x0101010101010101)
SHIFTS = np.arange(8, dtype=np.uint64)[:, None]
#: Members of a small tile, and of a tile; a tile grows until TILES hold all rows or it is full.
SMALL, TILE_MIN, TILE_MAX, TILES = 256, 2048, 1 << 20, 64
#: Tiles of a group; a square is the pairs of two groups.
SIDE = 8


def shingle_hashes(text: str | None, width: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words; of all words where there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= width:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - width])).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    return np.fromiter([digest(joined[s:e], seed) for s, e in zip(starts, stops)], np.uint64, n - width + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set where over half of the hashes have it set; eight bits are counted in one lane."""
    n = len(hashes)
    if not n:
        return 0
    lanes = np.add.reduceat((hashes[None, :] >> SHIFTS) & LANES, np.arange(0, n, 255), axis=1)
    counts = lanes.view(np.uint8).reshape(8, -1, 8).sum(axis=1, dtype=np.int64)  # [bit in byte, byte]
    return int(np.packbits((2 * counts > n).T[::-1, ::-1]).view(">u8")[0])


def simhash_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp): one row for each row of ``docs``; fp is the fingerprint's bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(shingle_hashes(t.as_py(), width, seed)) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def _byte_counts(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8))


def tile_order(fps: np.ndarray) -> np.ndarray:
    """Order in which each SMALL members are alike in their byte counts: halved again and again by the byte that differs most."""
    counts, out, todo = _byte_counts(fps), [], [np.arange(len(fps))]
    while todo:
        part = todo.pop()
        if len(part) <= SMALL:
            out.append(part)
            continue
        lane = int(np.argmax(counts[part].var(axis=0)))
        part = part[np.argsort(counts[part, lane], kind="stable")]
        middle = max(SMALL, len(part) // 2 // SMALL * SMALL)
        todo += [part[middle:], part[:middle]]
    return np.concatenate(out) if out else np.empty(0, np.int64)


class _Forest:
    """Union-find over the members of a pair of tiles."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            keep = x != y
            a, b, x, y = a[keep], b[keep], x[keep], y[keep]
            if not len(a):
                return
            low, high = np.minimum(x, y), np.maximum(x, y)
            np.minimum.at(self.root, high, low)
            while True:  # shortcut until each member names a root
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def compare_tiles(one: np.ndarray, two: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links within ``radius`` between two tiles: (member, its tree's first member)."""
    cut = [np.arange(0, len(x), SMALL) for x in (one, two)]
    low, high = zip(*[(np.minimum.reduceat(c, k, axis=0).astype(np.int16), np.maximum.reduceat(c, k, axis=0).astype(np.int16)) for c, k in ((_byte_counts(one), cut[0]), (_byte_counts(two), cut[1]))])
    gap = np.zeros((len(cut[0]), len(cut[1])), np.int16)
    for lane in range(8):
        gap += np.maximum(0, np.maximum(low[0][:, None, lane] - high[1][None, :, lane], low[1][None, :, lane] - high[0][:, None, lane]))
    near = gap <= radius
    if same:
        near = np.triu(near)
    members = one if same else np.concatenate([one, two])
    shift = 0 if same else len(one)
    forest = _Forest(len(members))
    cross, count = np.empty((SMALL, SMALL), np.uint64), np.empty((SMALL, SMALL), np.uint8)
    for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
        a, b = one[i * SMALL : (i + 1) * SMALL], two[j * SMALL : (j + 1) * SMALL]
        x, c = cross[: len(a), : len(b)], count[: len(a), : len(b)]
        np.bitwise_xor(a[:, None], b[None, :], out=x)
        np.bitwise_count(x, out=c)
        hit = c <= radius
        if same and i == j:
            np.fill_diagonal(hit, False)
        if hit.any():
            p, q = np.nonzero(hit)
            forest.link(p + i * SMALL, q + j * SMALL + shift)
    tail = np.nonzero(forest.root != np.arange(len(members)))[0]
    return members[tail], members[forest.root[tail]]


def _cut(counts: dict[int, int]) -> tuple[list[int], list[int], list[tuple[int, int]]]:
    """From rows by population count: first tile and number of tiles of each count; lowest and highest count of each tile."""
    full = min(max(sum(counts.values()) // TILES, TILE_MIN), TILE_MAX)
    first, many, bounds, room = [0] * 65, [1] * 65, [], 0
    for pop in range(65):
        n = counts.get(pop, 0)
        if n > full:
            many[pop] = -(-n // full)
            first[pop] = len(bounds)
            bounds += [(pop, pop)] * many[pop]
            room = 0
        elif n:
            if n > room or not bounds:
                bounds.append((pop, pop))
                room = full
            bounds[-1] = (bounds[-1][0], pop)
            first[pop] = len(bounds) - 1
            room -= n
    return first, many, bounds


def _squares(bounds: list[tuple[int, int]], radius: int, cores: int) -> tuple[int, list[tuple[int, int]]]:
    """Side of a square of tile pairs, and the squares that hold a pair within ``radius``: a task loads the tiles of two groups once for all their pairs."""
    side = SIDE
    while True:
        low = [min(b[0] for b in bounds[k : k + side]) for k in range(0, len(bounds), side)]
        high = [max(b[1] for b in bounds[k : k + side]) for k in range(0, len(bounds), side)]
        squares = [(p, q) for p in range(len(low)) for q in range(p, len(low)) if low[q] - high[p] <= radius and low[p] - high[q] <= radius]
        if side == 1 or len(squares) >= cores:
            return side, squares
        side //= 2


def link_fingerprints(work: Workspace, fps: DataFrame, radius: int) -> DataFrame:
    """(u, v): edges that connect just the fingerprints within ``radius``. ``fps`` (fp) are distinct and written."""
    spark = work.spark
    pop = F.bit_count("fp").cast("int")
    counts = {r[0]: r[1] for r in fps.groupBy(pop.alias("pop")).count().collect()}  # 65 rows at most
    first, many, bounds = _cut(counts)
    if not bounds:
        return spark.createDataFrame([], "u long, v long")
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), pop + 1)
    tiles = fps.select("fp", (at(first) + F.pmod(F.xxhash64("fp"), at(many))).cast("int").alias("tile"))

    def pack(group: pa.Table) -> pa.Table:
        own = group.column("fp").to_numpy().view(np.uint64)
        return pa.table({"tile": group.column("tile")[:1].cast(pa.int32()), "fps": [own[tile_order(own)].tobytes()]})

    packed = work.write(tiles.groupBy("tile").applyInArrow(pack, "tile int, fps binary"), "tiles")
    side, squares = _squares(bounds, radius, 4 * spark.sparkContext.defaultParallelism)
    tasks = max(1, min(len(squares), max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), len(squares) // 8)))
    meets = spark.createDataFrame([(g, p, q) for p, q in squares for g in {p, q}], "g int, p int, q int")
    sent = packed.withColumn("g", F.floor(F.col("tile") / side).cast("int")).join(meets, "g").select("p", "q", "tile", "fps")

    def run(square: pa.Table) -> pa.Table:
        p, q = square.column("p")[0].as_py(), square.column("q")[0].as_py()
        held = {t.as_py(): np.frombuffer(f.as_buffer(), np.uint64) for t, f in zip(square.column("tile"), square.column("fps"))}
        u, v = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        for a in sorted(held):
            for b in sorted(held):
                if a <= b and a // side == p and b // side == q and bounds[b][0] - bounds[a][1] <= radius and bounds[a][0] - bounds[b][1] <= radius:
                    x, y = compare_tiles(held[a], held[b], radius, a == b)
                    u.append(x)
                    v.append(y)
        return pa.table({"u": np.concatenate(u).view(np.int64), "v": np.concatenate(v).view(np.int64)})

    return sent.repartition(tasks, "p", "q").groupBy("p", "q").applyInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp, component): component is the smallest id that links of at most ``radius`` bits reach."""
    work = Workspace(docs.sparkSession, "simhash")
    rows = work.write(simhash_fingerprints(docs, id_col, text_col, width, seed), "rows")
    nodes = work.write(rows.groupBy("fp").agg(F.min("id").alias("low")), "nodes")
    edges = work.write(link_fingerprints(work, nodes.select("fp"), radius), "edges")
    roots = work.write(connected_components(work, edges), "roots")
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = work.write(named, "named")
    lowest = work.write(named.groupBy("root").agg(F.min("low").alias("component")), "lowest")
    labelled = work.write(named.join(lowest, "root").select("fp", "component"), "labelled")
    work.drop("edges", "roots", "nodes", "named", "lowest", "tiles")
    return rows.join(labelled, "fp").select("id", "fp", "component")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id is its component's smallest; of repeated ids all rows. Rows with a null id stay.

    An id alone says which rows go, but for ids that stand on texts of several
    components, one of which keeps it: these rows are told apart by their
    fingerprints, which are made again for them alone.
    """
    work = Workspace(docs.sparkSession, "keep")
    found = near_duplicates(docs, id_col, **options)
    gone = work.write(found.where("id <> component").select(F.col("id").alias("_id"), F.col("fp").alias("_fp")).distinct(), "gone")
    n = gone.count()
    if not n:
        return docs
    torn = found.where("id = component").join(gone.select(F.col("_id").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("_id")).distinct()
    torn = work.write(torn, "torn")
    # what the filter of the ids that go does not hold is passed on where it is read; only suspects are shuffled
    chunks, bits = build_filter(gone.select(F.col("_id").cast("string").alias("key")), "key", n)
    chunks = work.write(chunks, "filter")
    key = F.col(id_col).cast("long")
    marked = maybe_in(docs.select(F.struct("*").alias("doc"), key.alias("_id")), F.coalesce(F.col("_id").cast("string"), F.lit("")), chunks, bits)
    stay = marked.where("maybe").join(gone.select("_id").distinct(), "_id", "left_anti").select("doc").unionByName(marked.where("not maybe").select("doc")).select("doc.*")
    if torn.isEmpty():
        return stay
    some = docs.select(F.struct("*").alias("doc"), key.alias("_id"), F.monotonically_increasing_id().alias("row")).join(torn, "_id", "left_semi")
    some = work.write(some, "some")
    said = {k: v for k, v in options.items() if k in ("width", "seed")}
    made = simhash_fingerprints(some.select("row", F.col(f"doc.{options.get('text_col', 'text')}").alias("text")), "row", **said)
    some = some.join(made.select(F.col("id").alias("row"), F.col("fp").alias("_fp")), "row")
    return stay.unionByName(some.join(gone, ["_id", "_fp"], "left_anti").select("doc.*"))


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
