"""Exact duplicates by a log-structured merge index of text digests.

A log holds a digest for each row. ``flush`` fills memtables from it, each of at
most ``memtable_rows`` rows of an input task, and writes those of one turn as a
run: one entry for each digest, with the id that stays and the number of rows,
in buckets by hash and sorted inside them. Each run has a filter of its digests.
``compact`` merges the runs two by two, as a sort-merge join that reads both in
order: buckets meet buckets, so nothing is shuffled or sorted again. What more
than one row may have is known before, from the run's own counts and, across
runs, from the filters of earlier runs; only rows that pass a filter of these
hits have their bytes compared, by the smallest and the largest text of each
digest, which Spark combines before it shuffles: a group of copies sends one
row from each task, however large it is. Digests whose texts differ are told
apart by a number behind the digest, so that a collision never joins two texts.

Built-in functions only. Defined cases: a null text counts as empty; rows with
a null id take part, and stay only where their group has no other id; of
repeated rows of one id one stays; a very long text is hashed whole, and only
hits are compared; other columns are ignored; an empty table gives no row.
``keep`` says whether the smallest or the largest id stays.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from joinwright.llm.filters import build_filter, maybe_in
from joinwright.llm.workspace import Workspace

#: Lets a bucket that is one file be read as sorted.
SORTED_SCAN = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def _text_and_digest(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select("*", text.alias("_text"), F.unhex(F.sha2(text, 256)).alias("_sha"))


class DigestIndex:
    """``digest_bytes``: leading bytes of SHA-256 that the index holds (fewer only to provoke collisions in tests)."""

    def __init__(self, work: Workspace, keep: str = "smallest", digest_bytes: int = 32, memtable_rows: int = 1 << 24) -> None:
        if keep not in ("smallest", "largest"):
            raise ValueError("keep is 'smallest' or 'largest'")
        self.work, self.keep, self.digest_bytes, self.memtable_rows = work, keep, digest_bytes, memtable_rows
        self.buckets = int(work.spark.conf.get("spark.sql.shuffle.partitions"))
        self.batches: list[DataFrame] = []
        self.log: DataFrame | None = None
        self.runs: list[DataFrame] = []
        self.paths: dict[DataFrame, str] = {}
        self.level: DataFrame | None = None

    def _sorted_run(self, entries: DataFrame) -> DataFrame:
        """Writes (key, best, n) bucketed and sorted by key; the table's name is given up again, its files stay."""
        name = f"run_{uuid.uuid4().hex}"
        entries.write.format("parquet").bucketBy(self.buckets, "key").sortBy("key").option("path", self.work.path(name)).saveAsTable(name)
        run = self.work.spark.table(name)
        run.schema  # resolved while the name is there
        self.work.spark.sql(f"DROP TABLE {name}")
        self.paths[run] = name
        return run

    def _memtables(self, log: DataFrame) -> list[DataFrame]:
        """A run for each turn of the memtables: the first ``memtable_rows`` rows of each task, then the next."""
        first, pick = (F.col("id").isNull(), F.min) if self.keep == "smallest" else (F.col("id").isNotNull(), F.max)
        best = pick(F.struct(first.alias("first"), "id", "place")).alias("best")
        turns = (log.agg(F.max("turn")).first()[0] or 0) + 1
        return [self._sorted_run(log.where(F.col("turn") == t).groupBy("key").agg(best, F.count("*").alias("n"))) for t in range(turns)]

    def flush(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Logs a batch and writes its runs."""
        k = len(self.batches)
        docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        row = F.monotonically_increasing_id()
        rows = _text_and_digest(docs, "text").select("id", F.col("_sha").alias("sha"), F.substring("_sha", 1, self.digest_bytes).alias("key"), row.alias("row"))
        turn = F.floor(F.col("row").bitwiseAND(F.lit((1 << 33) - 1)) / self.memtable_rows).cast("int")
        rows = self.work.write(rows.select(F.struct(F.lit(k).alias("batch"), "row").alias("place"), "id", "sha", "key", turn.alias("turn")), f"log-{k}")
        self.batches.append(docs)
        self.log = rows if self.log is None else self.log.union(rows)
        self.runs += self._memtables(rows)

    def _merged(self, one: DataFrame, two: DataFrame) -> DataFrame:
        """Two sorted runs as one."""
        pick = F.least if self.keep == "smallest" else F.greatest
        one, two = one.hint("merge"), two.select("key", F.col("best").alias("best_"), F.col("n").alias("n_"))
        both = one.join(two, "key", "full").select("key", pick("best", "best_").alias("best"), (F.coalesce("n", F.lit(0)) + F.coalesce("n_", F.lit(0))).alias("n"))
        return self._sorted_run(both)

    def _ordered(self, action: Callable[[], DataFrame]) -> DataFrame:
        conf = self.work.spark.conf
        before = conf.get(SORTED_SCAN, "false")
        conf.set(SORTED_SCAN, "true")
        try:
            return action()
        finally:
            conf.set(SORTED_SCAN, before)

    def _merge_runs(self) -> None:
        runs = list(self.runs)
        while len(runs) > 1:
            runs = [self._ordered(lambda a=a, b=b: self._merged(a, b)) for a, b in zip(runs[::2], runs[1::2])] + runs[len(runs) // 2 * 2 :]
        self.level = runs[0]

    def _hits(self) -> DataFrame:
        """(digest): what several rows may have: repeated inside a run, or held by the filter of an earlier one."""
        hits, filters = None, []
        for k, run in enumerate(self.runs):
            some = run.where("n > 1").select("key")
            for chunks, bits in filters:
                some = some.union(maybe_in(run.select("key"), F.col("key"), chunks, bits).where("maybe").select("key"))
            hits = some if hits is None else hits.union(some)
            if k + 1 < len(self.runs):
                chunks, bits = build_filter(run.select("key"), "key", run.count())
                filters.append((self.work.write(chunks, f"filter-{k}"), bits))
        return hits

    def compact(self) -> None:
        """Compares the bytes of all hits, and merges the runs."""
        hits = self.work.write(self._hits(), "hits")
        n = hits.count()
        if n:
            chunks, bits = build_filter(hits, "key", n)
            chunks = self.work.write(chunks, "filter")
            texts = None
            for docs in self.batches:
                some = _text_and_digest(docs, "text").select("_text", F.substring("_sha", 1, self.digest_bytes).alias("key"))
                some = maybe_in(some, F.col("key"), chunks, bits).where("maybe").select("key", "_text")
                texts = some if texts is None else texts.union(some)
            seen = texts.groupBy("key").agg(F.min("_text").alias("low"), F.max("_text").alias("high"))
            split = self.work.write(seen.where("low <> high").select("key"), "collisions")
            if not split.isEmpty():
                self._part(texts, split)
        self._merge_runs()

    def _part(self, texts: DataFrame, split: DataFrame) -> None:
        """Gives the texts of one digest different keys, and flushes the log again."""
        names = texts.join(split, "key", "left_semi").distinct()
        names = names.select("key", "_text", F.row_number().over(Window.partitionBy("key").orderBy("_text")).alias("other"))
        names = self.work.write(names.select("key", F.unhex(F.sha2("_text", 256)).alias("sha"), F.concat("key", F.lit("/"), F.col("other").cast("string").cast("binary")).alias("other")), "variants")
        parted = self.log.join(names, ["key", "sha"], "left").select("place", "id", "sha", F.coalesce("other", "key").alias("key"), "turn")
        self.log = self.work.write(parted, "parted")
        self.runs = self._memtables(self.log)

    def lookup(self) -> DataFrame:
        """(id, keep_id, group_size, kept, sha): one row for each row that was flushed.

        The level is read without its buckets: so both sides are shuffled, and
        a key that very many rows of the log have is split where it is met.
        """
        found = self.log.join(self.work.read(self.paths[self.level], self.level.schema), "key")
        return found.select("id", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("place") == F.col("best.place")).alias("kept"), "sha")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest_bytes: int = 32, memtable_rows: int = 1 << 24) -> DataFrame:
    index = DigestIndex(Workspace(docs.sparkSession, "exact"), keep, digest_bytes, memtable_rows)
    index.flush(docs, id_col, text_col)
    index.compact()
    return index.lookup()


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns.

    Rows outside the filter of dropped (id, digest) keys are passed on where
    they are read; only the others are shuffled to be matched.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "drop")
    gone = exact_duplicates(docs, id_col, text_col, keep).where("not kept").select(F.col("id").alias("_id"), F.col("sha").alias("_sha"), F.expr("id <=> keep_id").alias("_again"))
    gone = work.write(gone, "gone")
    n = gone.count()
    if not n:
        return docs
    key = F.concat_ws("/", F.coalesce(F.col("_id").cast("string"), F.lit("null")), F.hex("_sha"))
    chunks, bits = build_filter(gone.select(key.alias("_key")), "_key", n)
    chunks = work.write(chunks, "filter")
    sha = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    marked = docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("_id"), sha.alias("_sha"))
    marked = maybe_in(marked, key, chunks, bits)
    twins = gone.select("_id", "_sha", "_again").distinct()
    one, two = marked.where("maybe").alias("one"), twins.alias("two")
    same = F.expr("one._id <=> two._id and one._sha = two._sha")
    stay = one.join(two.where("not _again"), same, "left_anti")
    again = twins.where("_again")
    if not again.isEmpty():  # rows of one id and text: one of them stays
        some = stay.alias("one").join(again.alias("two"), same, "left_semi")
        stay = stay.alias("one").join(again.alias("two"), same, "left_anti").unionByName(some.dropDuplicates(["_id", "_sha"]))
    return marked.where("not maybe").unionByName(stay).select("doc.*")
