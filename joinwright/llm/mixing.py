"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source gets a target number of words. Its rows are dealt into blocks by a
hash of their id, which is a random permutation that any rerun repeats; the
blocks of each copy of a source stand in an order of their own (an affine
permutation). A source's quota is the number of blocks, over all copies, whose
words come up to its target, and one more that is drawn in part.

The tree halves the output shards again and again. At each node a draw without
replacement (multivariate hypergeometric) says how many of the node's blocks of
each source go left, so each leaf gets an exact quota and the quotas add up. A
leaf's quota of a source is its own stretch of the source's permuted blocks, so
shards draw disjoint blocks. What a row is taken for is the number of its
block's copies that some shard draws. Rows are shuffled inside their shard by a
hash.

The block drawn in part gives its rows in hashed order up to the target; what
is left is closed, for sources that are still off by more than ``NEAR`` of
their target, by the largest rows that still fit, one for each of a few passes
over the sizes, and by one more row where that comes nearer.

Tables grow with the blocks; the driver holds one row for each source and the
upper levels of the tree (a source is a named corpus: a mixture gives each a
weight). Cuts are found top down: sums of stretches of blocks, then the blocks
of one stretch, then the rows of one block. What is broadcast is counted first;
beyond the bounds below it is joined by a shuffle, sources with salted keys.

Defined cases: a null text has size 0; a null id is told apart by its text;
null sources are a source of their own, last in order; a source of no words has
target 0; repeated rows count each (those of one id share a block); of rows
that tie for the last place the one with the smaller hash, then id, is taken; a
very long text is taken whole or not at all; an empty table gives no row; other
columns are ignored, and kept by ``mixed``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joinwright.llm.workspace import Workspace

#: Rows of a block on average, blocks of a stretch, words of an output shard, the least number of shards where none is given.
BLOCK_ROWS, STRETCH, SHARD_WORDS, LEAST_SHARDS = 64, 4096, 50_000_000, 64
#: Subtrees that tasks expand; salts of a join with more than BROADCAST_SOURCES sources; other rows that are broadcast at most.
SUBTREES, SALTS, BROADCAST_SOURCES, BROADCAST_ROWS = 64, 64, 100_000, 200_000
#: Part of a target by which its source may be off; passes that close what is left.
NEAR, PASSES = 1e-3, 3
WORD = "[^\\x20\\x09-\\x0D]+"


def in_order(names) -> list:
    """By code point, null last."""
    names = list(names)
    return sorted((s for s in names if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in names)


def targets(sizes: dict, weights: tuple[float, ...], share: float, most: float) -> dict:
    """Words for each source: by weight, never above ``most`` times its size, the excess dealt again by weight."""
    names = in_order(sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), list(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = most * float(sizes[s])
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def _key(*parts: object) -> int:
    return int.from_bytes(hashlib.sha256("/".join(map(str, parts)).encode("utf-8", "replace")).digest()[:8], "little")


def _split(first: int, n: int, here: np.ndarray, seed: int) -> np.ndarray:
    """How many blocks of each source go to the left half of ``n`` shards."""
    draw = int(here.sum() * (n // 2) // n)
    return np.random.default_rng(_key(seed, first, n)).multivariate_hypergeometric(here, draw, method="marginals") if draw else np.zeros_like(here)


def split_quotas(quotas: np.ndarray, shards: int, seed: int, first: int = 0, stop: int = 1) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first shard, shards, source, start, quota) of the nodes of at most ``stop`` shards: start is the first of a source's permuted blocks that a node draws."""
    own = np.nonzero(quotas)[0]
    todo = [(first, shards, own, np.zeros(len(own), np.int64), quotas[own].astype(np.int64))]
    while todo:
        at, n, source, start, here = todo.pop()
        if n <= stop:
            yield at, n, source, start, here
            continue
        left = _split(at, n, here, seed)
        for a, m, s, q in ((at + n // 2, n - n // 2, start + left, here - left), (at, n // 2, start, left)):
            some = q > 0
            todo.append((a, m, source[some], s[some], q[some]))


def _leaves(batches: Iterator[pd.DataFrame], seed: int) -> Iterator[pd.DataFrame]:
    """(sid, shard, start, n) of the subtrees (first, shards, sids, starts, quotas)."""
    for batch in batches:
        for first, shards, sids, starts, quotas in batch.itertuples(index=False):
            for shard, _, source, start, n in split_quotas(np.asarray(quotas, np.int64), int(shards), seed, int(first)):
                yield pd.DataFrame({"sid": np.asarray(sids, np.int64)[source], "shard": np.full(len(source), shard, np.int64), "start": np.asarray(starts, np.int64)[source] + start, "n": n})


def affine(blocks: int, *key: object) -> tuple[int, int, int]:
    """(a, o, a's inverse) of the permutation b -> a * b + o mod ``blocks``."""
    draw = np.random.default_rng(_key(*key))
    a = int(draw.integers(blocks)) % (1 << 31) or 1
    while math.gcd(a, blocks) != 1:
        a += 1
    return a % blocks, int(draw.integers(blocks)), pow(a, -1, blocks) if blocks > 1 else 0


def _is_source(name: str) -> Column:
    return F.expr(f"source <=> {name}")


class Mixture:
    """Which rows of ``docs`` the mix takes, how often, and into which shard."""

    def __init__(self, docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, shards: int | None = None, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> None:
        self.docs, self.seed, self.spark = docs, seed, docs.sparkSession
        self.work = work = Workspace(self.spark, "mix")
        text = F.coalesce(F.col(text_col), F.lit(""))
        name = F.col(id_col).cast("long")
        turn = F.xxhash64(F.lit(seed), F.when(name.isNull(), F.xxhash64(text)).otherwise(name))
        size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
        self.read = {"id": name, "source": F.col(source_col), "size": size, "turn": turn}
        self.rows = work.write(docs.select(F.monotonically_increasing_id().alias("place"), *[c.alias(k) for k, c in self.read.items()]), "rows")
        totals = {r.source: r for r in self.rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("words")).collect()}  # one row for each source
        goal = targets({s: r.words for s, r in totals.items()}, weights, share, most)
        self.shards = shards or max(-(-int(sum(goal.values())) // SHARD_WORDS), LEAST_SHARDS)
        self.sources = []
        for sid, s in enumerate(in_order(totals)):
            words, blocks = totals[s].words, max(totals[s].n // BLOCK_ROWS, 1)
            whole = int(goal[s] // words) if words else 0
            a, o, back = affine(blocks, seed, s, whole)
            self.sources.append({"sid": sid, "own": s, "source_size": words, "target": float(goal[s]), "blocks": blocks, "whole": whole, "rest": int(round(goal[s] - whole * words)), "a": a, "o": o, "back": back})
        self.plan = self._table(self.sources, "sid long, own string, source_size long, target double, blocks long, whole long, rest long, a long, o long, back long", "plan")
        self._cut()
        self._draw()

    def _table(self, rows: list[dict], schema: str, name: str) -> DataFrame:
        """Driver rows as a table; many are written, so that they are read by tasks and not kept in the plan."""
        names = [c.split()[0] for c in schema.split(", ")]
        made = self.spark.createDataFrame([tuple(r[c] for c in names) for r in rows], schema).coalesce(1)
        return made if len(rows) <= 1000 else self.work.write(made, name)

    def _few(self, df: DataFrame, count: int, bound: int = BROADCAST_ROWS) -> DataFrame:
        return F.broadcast(df) if count <= bound else df

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Rows with their source's plan and their block."""
        if len(self.sources) <= BROADCAST_SOURCES:
            rows = rows.join(F.broadcast(self.plan), _is_source("own"))
        else:
            salted = self.plan.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
            rows = rows.withColumn("_of", F.pmod("turn", F.lit(SALTS))).join(salted, F.expr("source <=> own AND _of = _salt")).drop("_of", "_salt")
        return rows.drop("own").withColumn("block", F.pmod("turn", "blocks"))

    def _cut(self) -> None:
        """Where each source's last copy ends: the block (by its place in the permuted order) and the words left for it."""
        placed = self._placed(self.rows)
        sums = placed.where("rest > 0").groupBy("sid", "rest", F.expr("pmod(a * block + o, blocks)").alias("at")).agg(F.sum("size").alias("words"))
        sums = sums.withColumn("stretch", F.floor(F.col("at") / STRETCH).cast("long"))

        def first_beyond(parts: DataFrame, step: str) -> dict[int, tuple[int, int]]:
            upto = F.sum("words").over(Window.partitionBy("sid").orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow))
            found = parts.withColumn("upto", upto).where("upto > rest").groupBy("sid").agg(F.min(F.struct(F.col(step).alias("at"), (F.col("rest") - F.col("upto") + F.col("words")).alias("left"))).alias("x"))
            return {r.sid: (r.x.at, r.x.left) for r in found.collect()}  # one row for each source

        if all(p["blocks"] <= STRETCH for p in self.sources):
            block = first_beyond(sums, "at")
        else:
            sums = self.work.write(sums, "sums")
            stretch = first_beyond(sums.groupBy("sid", "rest", "stretch").agg(F.sum("words").alias("words")), "stretch")
            edge = self._table([{"sid": s, "stretch": x, "rest": left} for s, (x, left) in stretch.items()], "sid long, stretch long, rest long", "edge")
            block = first_beyond(sums.drop("rest").join(self._few(edge, len(stretch)), ["sid", "stretch"]), "at")
        for p in self.sources:
            p["cut"], p["room"] = block.get(p["sid"], (p["blocks"] if p["rest"] else 0, 0))
            p["partial"] = int(p["room"] > 0 and p["cut"] < p["blocks"])
            p["quota"] = p["whole"] * p["blocks"] + p["cut"] + p["partial"]
        self._fill()

    def _fill(self) -> None:
        """The rows of the blocks that are drawn in part, and what closes the gaps: ``filled`` (place, sid, id, size, turn)."""
        cuts = self._table([p for p in self.sources if p["partial"]], "sid long, cut long, room long", "cuts")
        cuts = self._few(cuts, len(self.sources), BROADCAST_SOURCES)
        rows = self._placed(self.rows).join(cuts, "sid").withColumn("at", F.expr("pmod(a * block + o, blocks)")).where("at >= cut AND size > 0").select("sid", "place", "id", "turn", "size", "at", "cut", "room")
        upto = F.sum("size").over(Window.partitionBy("sid").orderBy("turn", "id", "size", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        begun = self.work.write(rows.where("at = cut").withColumn("upto", upto).where("upto <= room").select("place", "sid", "id", "size", "turn"), "begun")
        counted = begun.groupBy("sid").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()  # one row for each source
        held, n_begun = {r.sid: r.words for r in counted}, sum(r.n for r in counted)
        gap = {p["sid"]: p["room"] - held.get(p["sid"], 0) for p in self.sources if p["partial"]}
        least = {p["sid"]: NEAR * p["target"] for p in self.sources}
        taken: dict[int, list[int]] = {s: [] for s in gap}
        more = []
        for last in [False] * PASSES + [True]:
            open_ = [{"sid": s, "gap": g, "taken": taken[s]} for s, g in gap.items() if g > least[s]]
            if not open_:
                break
            asked = self._table(open_, "sid long, gap long, taken array<long>", f"open-{len(more)}-{last}")
            free = rows.join(self._few(asked, len(open_), BROADCAST_SOURCES), "sid").join(self._few(begun.select("place"), n_begun), "place", "left_anti").where(~F.array_contains("taken", F.col("place")))
            fits = free.where("size < 2 * gap" if last else "size <= gap")  # at last a row may go beyond, where it comes nearer
            best = F.min if last else F.max
            order = F.struct(F.col("size"), (F.col("turn") if last else F.expr("~turn")).alias("t"), F.coalesce("id", F.lit(0)).alias("i"), "place", "id", "turn")
            for r in fits.groupBy("sid").agg(best(order).alias("x")).collect():  # one row for each source
                more.append({"place": r.x.place, "sid": r.sid, "id": r.x.id, "size": r.x.size, "turn": r.x.turn})
                taken[r.sid].append(r.x.place)
                gap[r.sid] -= r.x.size
        self.filled, self.n_filled = begun.unionByName(self._table(more, "place long, sid long, id long, size long, turn long", "more")), n_begun + len(more)

    def _draw(self) -> None:
        """The tree's leaves, and from them (sid, block, copy, shard) of each block that a shard draws whole."""
        quotas = np.array([p["quota"] for p in self.sources], np.int64)
        trees = [(int(at), int(n), source.tolist(), start.tolist(), here.tolist()) for at, n, source, start, here in split_quotas(quotas, self.shards, self.seed, stop=max(1, -(-self.shards // SUBTREES))) if len(source)]
        trees = self.spark.createDataFrame(trees, "first long, shards long, sids array<long>, starts array<long>, quotas array<long>")
        seed = self.seed
        leaves = trees.repartition(max(1, min(SUBTREES, self.shards // 64))).mapInPandas(lambda batches: _leaves(batches, seed), "sid long, shard long, start long, n long")
        orders = []
        for p in self.sources:
            for copy in range(p["whole"] + 1):
                a, o, back = affine(p["blocks"], self.seed, p["own"], copy)
                orders.append({"sid": p["sid"], "copy": copy, "blocks": p["blocks"], "o": o, "back": back, "partial": p["quota"] - 1 if p["partial"] else -1})
        orders = self._table(orders, "sid long, copy long, blocks long, o long, back long, partial long", "orders")
        orders = self._few(orders, len(self.sources), BROADCAST_SOURCES)
        each = leaves.where("n > 0").select("sid", "shard", F.explode(F.expr("sequence(start, start + n - 1)")).alias("p"))
        each = each.join(orders, "sid").where("p div blocks = copy").withColumn("block", F.expr("pmod((p % blocks - o) * back, blocks)"))
        each = self.work.write(each.select("sid", "block", "copy", "shard", (F.col("p") == F.col("partial")).alias("partial")), "each")
        self.draws = each.where("not partial").groupBy("sid", "block").agg(F.array_sort(F.collect_list("shard")).alias("drawn"))  # one entry for each copy
        self.n_draws = int(quotas.sum())
        self.ends = each.where("partial").select("sid", F.col("shard").alias("end_shard"))

    def _shards(self, rows: DataFrame, fits: Column) -> DataFrame:
        """``rows`` (with sid and block) with ``shards``: an entry for each copy that is taken."""
        rows = rows.join(self._few(self.draws, self.n_draws), ["sid", "block"], "left").join(self._few(self.ends, len(self.sources), BROADCAST_SOURCES), "sid", "left")
        none = F.array().cast("array<bigint>")
        return rows.withColumn("shards", F.concat(F.coalesce("drawn", none), F.when(fits, F.array("end_shard")).otherwise(none))).drop("drawn", "end_shard")

    def copies(self) -> DataFrame:
        """(id, source, size, source_size, target, shards): one row for each row; shards has an entry for each copy."""
        filled = self._few(self.filled.select("place", F.lit(True).alias("fits")), self.n_filled)
        rows = self._shards(self._placed(self.rows).join(filled, "place", "left"), F.coalesce("fits", F.lit(False)))
        return rows.select("id", "source", "size", "source_size", "target", "shards")

    def taken(self) -> DataFrame:
        """(id, size, source_size, target, taken, copies, shards)"""
        return self.copies().select("id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), F.size("shards").alias("copies"), "shards")

    def mixed(self) -> DataFrame:
        """The rows of ``docs``, repeated as the mix takes them, dealt to the shards and shuffled inside each."""
        docs = self.docs.select(F.struct("*").alias("doc"), *[c.alias(k) for k, c in self.read.items()])
        docs = self._placed(docs).select("doc", "sid", "block", "id", "turn", "size")
        # rows are told by id, hash and size; of several that share these, as many as were filled
        many = self.filled.groupBy("sid", "id", "turn", "size").agg(F.count("*").alias("many")).withColumnsRenamed({"sid": "s_", "id": "i_", "turn": "t_", "size": "z_"})
        same = F.expr("sid = s_ AND turn = t_ AND size = z_ AND id <=> i_")
        docs = docs.join(self._few(many, self.n_filled), same, "left").drop("s_", "i_", "t_", "z_")
        again = F.row_number().over(Window.partitionBy("sid", "turn", "size").orderBy("id"))
        edge = docs.where("many IS NOT NULL").withColumn("fits", again <= F.col("many"))
        rows = docs.where("many IS NULL").withColumn("fits", F.lit(False)).unionByName(edge)
        rows = self._shards(rows, F.col("fits")).select("doc", "turn", F.posexplode("shards").alias("_copy", "_shard"))
        dealt = rows.repartitionById(self.shards, F.col("_shard").cast("int")).sortWithinPartitions("_shard", F.xxhash64("turn", "_copy"), "turn", "_copy")
        return dealt.select("doc.*")
