"""Chat formatting with multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once with that
speaker as the assistant and all others as named users; a system turn stays a
system turn. The masks are the spans, in code points of the whole rendering, of
what the assistant of that rendering says with its end marker: what a model is
trained on.

Conversations have no limit of turns. All turns are put in order by one range
sort, which may cut a conversation anywhere; offsets are running sums inside a
range plus what the ranges before hold of the same conversation (one row for
each cut, so never more rows than ranges). A rendering's text is stored in
pieces of about ``part_chars`` code points, most often one: the pieces in order
of ``part`` are the rendering, and masks count from its beginning, so no task
holds more than a piece, however long a conversation is or how many of the
rows are its own.

Defined cases: a null text counts as empty, a null role is the participant
"unknown"; rows with a null turn come last; turns with the same number are in
order of role and digest of the text, repeated rows are rendered repeated; a
conversation of system turns alone has no participant and no row; a very long
text is one piece with what begins before it; markers inside a text or a role
are broken with a backslash; null conversation ids are one conversation; an
empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joinwright.llm.workspace import Workspace

END, ASSISTANT, SYSTEM = "<|end|>\n", "<|assistant|>\n", "<|system|>\n"
#: Counts of roles at cuts that are sent to every task; more are joined by a shuffle.
BROADCAST_ROLES = 100_000


def _broken(said: Column) -> Column:
    return F.replace(F.replace(said, F.lit("<|"), F.lit("<\\|")), F.lit("|>"), F.lit("|\\>"))


def _head(role: Column) -> Column:
    """What stands before a turn that is not the assistant's."""
    return F.when(role == "system", F.lit(SYSTEM)).otherwise(F.concat(F.lit("<|user:"), _broken(role), F.lit("|>\n")))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds what a range holds before each row of its conversation: code points, and turns of the same role."""
    last, chars, turns = object(), 0, Counter()
    for batch in batches:
        before, again = [], []
        for conv, role, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "chars"))):
            if conv != last:
                last, chars, turns = conv, 0, Counter()
            before.append(chars)
            again.append(turns[role])
            chars += n
            turns[role] += 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.int64()), pa.array(again, pa.int64())], names=[*batch.schema.names, "before", "again"])


def ordered_turns(work: Workspace, turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, role, said, chars, bucket, seq, before, again): seq is the order; before and again count inside a range."""
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("late", F.col("turn").isNull()).withColumn("digest", F.sha2("text", 256))
    key = ["conv_id", "late", "turn", "role", "digest", "row"]
    rows = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    said = F.concat(F.replace(F.col("text"), F.lit("<|"), F.lit("<\\|")), F.lit(END))
    rows = rows.select("conv_id", "role", said.alias("said"), F.spark_partition_id().alias("bucket"), F.monotonically_increasing_id().alias("seq"))
    rows = rows.withColumn("chars", (F.length(_head(F.col("role"))) + F.length("said")).cast("long"))
    counted = T.StructType([*rows.schema.fields, T.StructField("before", T.LongType()), T.StructField("again", T.LongType())])
    return work.write(rows.mapInArrow(_running, counted), "turns")


def with_offsets(rows: DataFrame) -> DataFrame:
    """``rows`` with before and again counted in the whole conversation."""
    earlier = lambda key: Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = rows.groupBy("conv_id", "bucket").agg(F.sum("chars").alias("held"))
    cuts = held.select("conv_id", "bucket", F.sum("held").over(earlier(["conv_id"])).alias("carried"), F.count("*").over(Window.partitionBy("conv_id")).alias("ranges")).where("ranges > 1")
    cuts = F.broadcast(cuts.select(F.col("conv_id").alias("_conv"), F.col("bucket").alias("_bucket"), "carried"))  # two rows a range at most
    rows = rows.join(cuts, F.expr("conv_id <=> _conv AND bucket = _bucket"), "left").withColumn("cut", F.col("_conv").isNotNull() | F.col("_bucket").isNotNull())
    roles = rows.where("cut").groupBy("conv_id", "bucket", "role").agg(F.count("*").alias("n"))
    roles = roles.select(F.col("conv_id").alias("conv_"), F.col("bucket").alias("bucket_"), F.col("role").alias("role_"), F.sum("n").over(earlier(["conv_id", "role"])).alias("spoken")).where("spoken > 0")
    roles = F.broadcast(roles) if roles.limit(BROADCAST_ROLES + 1).count() <= BROADCAST_ROLES else roles
    rows = rows.join(roles, F.expr("conv_id <=> conv_ AND bucket = bucket_ AND role = role_"), "left")
    return rows.select("conv_id", "role", "said", "seq", (F.col("before") + F.coalesce("carried", F.lit(0))).alias("before"), (F.col("again") + F.coalesce("spoken", F.lit(0))).alias("again"))


def rotate_perspectives(turns: DataFrame, part_chars: int = 1 << 20, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, speaker, part, n_turns, text, masks). A turn belongs to the part in which it begins, counted as if nobody were the assistant."""
    work = Workspace(turns.sparkSession, "chat")
    rows = with_offsets(ordered_turns(work, turns, conv_col, turn_col, role_col, text_col))
    rows = rows.withColumn("part", F.floor(F.col("before") / part_chars).cast("long"))
    parts = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "said", "before", "again"))).alias("turns"))
    spoken = rows.select("conv_id", "part", "role").distinct()
    speakers = spoken.where("role <> 'system'").select(F.col("conv_id").alias("conv"), F.col("role").alias("speaker")).distinct()
    shown = spoken.select("conv_id", "part").distinct().join(speakers, F.expr("conv_id <=> conv")).select("conv", F.col("part").alias("piece"), "speaker")
    each = parts.join(shown, F.expr("conv_id <=> conv AND part = piece"))
    own = lambda x: x["role"] == F.col("speaker")
    saved = F.lit(len(ASSISTANT)) - F.length(_head(F.col("speaker")))  # by which each earlier turn of the speaker is longer than a user's
    start = lambda x: x["before"] + x["again"] * saved + len(ASSISTANT)
    mask = lambda x: F.struct(start(x).alias("start"), (start(x) + F.length(x["said"])).alias("end"))
    return each.select(
        "conv_id",
        "speaker",
        "part",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda x: F.concat(F.when(own(x), F.lit(ASSISTANT)).otherwise(_head(x["role"])), x["said"])), "").alias("text"),
        F.transform(F.filter("turns", own), mask).alias("masks"),
    )
