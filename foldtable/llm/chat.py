"""Chat formatting with prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are its context and only
its own text is trainable. A conversation's formatted text is kept once, as one segment for each
turn, and an example is two spans of it: the context [0, context_end) and the target
[context_end, target_end). Copying the context into every example would grow with the square of
a conversation's length; `render` does that for the examples a trainer asks for.

Template: `<|im_start|>ROLE\\nTEXT<|im_end|>\\n`. Inside roles and texts a backslash is doubled
and `<|` is written `<\\|`, so no text can open or close a turn, and both can be undone; a line
feed in a role is written `\\n`.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, parts_for, utf8_size

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Code points of a text that ranges of turns are dealt by.
DEALT_BY = 128
PLANTED = "<|im_end|><|im_start|>assistant ok"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Undoes `escape`. A doubled backslash is set aside first, as it may stand before a bar."""
    out = F.replace(text, F.lit("\\\\"), F.lit("\\0"))
    for written, meant in (("<\\|", "<|"), ("\\n", "\n"), ("\\0", "\\")):
        out = F.replace(out, F.lit(written), F.lit(meant))
    return out


def write_examples(turns: DataFrame, path: str, part_bytes: int = 16 << 20) -> None:
    """Write `path`/segments and `path`/examples for turns (conv_id, turn, role, text).

    segments: conv_id, seq (from 0 in order of turn), char_start, n_chars, segment.
    examples: conv_id, seq of the target turn, context_end, target_end, as code points of the
    conversation's formatted text.

    Null text and null role are empty; rows without conv_id form one conversation; rows of equal
    turn are ordered by role and text, and repeated rows are turns like any other. Other columns
    are left out. Turns are dealt by range of (conv_id, turn), so a conversation of any length
    spans as many tasks as it needs, and running positions come from each task's own sums. Ties
    are dealt by role and the text's beginning, and repeated rows of texts that are no longer than
    that by their place in the input, so that any number of them spans several tasks.
    """
    spark = turns.sparkSession
    total = turns.agg(F.sum(utf8_size(F.col("text")) + 64)).first()[0]
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("place"))
    start = F.substring("text", 1, DEALT_BY)
    deal = ["conv_id", "turn", "role", start, F.when(F.length("text") <= DEALT_BY, F.col("place"))]
    head = F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    body = escape(F.col("text"))
    raw = f"{path}/ordered"
    (
        clean.repartitionByRange(parts_for(spark, total, part_bytes), *deal)
        .sortWithinPartitions("conv_id", "turn", "role", "text", "place")
        .select(
            "conv_id", F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("part"),
            (F.col("role") == "assistant").alias("target"), F.length(head).alias("head_chars"),
            F.length(body).alias("body_chars"), F.concat(head, body, F.lit(CLOSE)).alias("segment"),
        )
        .write.option("compression", "zstd").parquet(raw)
    )
    rows = spark.read.parquet(raw).withColumn("n_chars", F.length("segment"))
    # A row for each conversation and task, and a running sum of those: at most a row a task for any conversation.
    sums = rows.groupBy("conv_id", "part").agg(F.count("*").alias("turns"), F.sum("n_chars").alias("chars"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(
        F.col("conv_id").alias("_conv"), F.col("part").alias("_part"),
        F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("turn_base"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("char_base"),
    )
    within = Window.partitionBy("conv_id", "part").orderBy("at")
    local = rows.select(
        "*", F.row_number().over(within).alias("_n"),
        F.coalesce(F.sum("n_chars").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_chars"),
    )
    placed = local.join(bases, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))).select(
        "conv_id", (F.col("turn_base") + F.col("_n") - 1).alias("seq"), (F.col("char_base") + F.col("_chars")).alias("char_start"),
        F.col("n_chars").cast("long").alias("n_chars"), "segment", "target", "head_chars", "body_chars",
    )
    placed.write.option("compression", "zstd").parquet(f"{path}/placed")
    placed = spark.read.parquet(f"{path}/placed")
    placed.drop("target", "head_chars", "body_chars").write.option("compression", "zstd").parquet(f"{path}/segments")
    start = F.col("char_start") + F.col("head_chars")
    examples = placed.where("target").select("conv_id", "seq", start.alias("context_end"), (start + F.col("body_chars")).alias("target_end"))
    examples.write.option("compression", "zstd").parquet(f"{path}/examples")


def read_examples(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/segments"), spark.read.parquet(f"{path}/examples")


def render(segments: DataFrame, examples: DataFrame) -> DataFrame:
    """Whole texts of the given examples: conv_id, seq, text, context_chars, target_chars.

    One row is as long as the example itself; pass those that a trainer is about to read.
    """
    part = F.struct(F.col("s.seq"), F.col("s.segment"))
    joined = examples.alias("e").join(segments.alias("s"), F.col("e.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("s.seq") <= F.col("e.seq")))
    grouped = joined.groupBy("e.conv_id", "e.seq", "e.context_end", "e.target_end").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["segment"]), "")
    return grouped.select(
        "conv_id", "seq", F.substring(text, F.lit(1), F.col("target_end").cast("int")).alias("text"),
        F.col("context_end").alias("context_chars"), (F.col("target_end") - F.col("context_end")).alias("target_chars"),
    )


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _checked(role: str, role_chars: int, start: int, n: int, spoken: int, context_end: int | None, target_end: int | None) -> None:
    """An example's context must be all that stands before its target: `spoken` characters of turns before it, and its own head.

    Every assistant turn has one example, whose target is the inside of its own segment; other turns have none.
    """
    if start != spoken:
        raise ValueError(f"a turn starts at {start}, after {spoken} characters")
    if (context_end is not None) != (role == "assistant"):
        raise ValueError(f"example of a turn of role {role!r}: {context_end}")
    if context_end is not None:
        head = len(OPEN) + role_chars + 1
        if (context_end, target_end) != (spoken + head, spoken + n - len(CLOSE)):
            raise ValueError(f"example ({context_end}, {target_end}) of the turn at {spoken}")


def _digest(batches):
    """Streams turns in order and checks each example; holds the running digests of one conversation only."""
    now, done = None, []

    def row(s):
        return (s["conv_id"], s["turns"], s["all"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["formatted"])

    def out(rows):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in DIGESTS.split(", ")])

    for batch in batches:
        columns = ("conv_id", "role", "text", "loss", "n_chars", "char_start", "context_end", "target_end", "role_chars")
        for conv, role, text, loss, n, start, context_end, target_end, role_chars in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if now is None or now["conv_id"] != conv:
                if now:
                    done.append(row(now))
                now = {"conv_id": conv, "turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0}
            _checked(role, role_chars, start, n, now["formatted"], context_end, target_end)
            now["turns"] += 1
            now["formatted"] += n
            now["all"].update(f"{role}\n{text}\n".encode())
            if loss is not None:
                now["chars"] += len(loss)
                now["loss"].update(loss.encode())
        if done:
            yield out(done)
            done = []
    if now:
        yield out([row(now)])


def format_conversations(spark, conversations: DataFrame) -> DataFrame:
    """Format all conversations and the planted conversation -1; digests of what the files hold.

    A SHA-256 runs over a conversation's turns in order, so each conversation's turns pass
    through one task; they stream, and only the running digests are held.
    """
    planted = spark.createDataFrame([(-1, 0, "user", PLANTED), (-1, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    path = new_path(spark, "chat")
    write_examples(conversations.select("conv_id", "turn", "role", "text").unionByName(planted), path)
    segments, examples = read_examples(spark, path)
    spans = examples.withColumnsRenamed({"conv_id": "_conv", "seq": "_seq"})
    joined = segments.join(spans, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("seq") == F.col("_seq")), "left")
    inner = F.substring("segment", F.lit(len(OPEN) + 1), F.col("n_chars").cast("int") - len(OPEN) - len(CLOSE))
    cut = F.locate("\n", inner)
    lost = F.substring("segment", (F.col("context_end") - F.col("char_start") + 1).cast("int"), (F.col("target_end") - F.col("context_end")).cast("int"))
    turns = joined.select(
        "conv_id", "seq", "n_chars", "char_start", "context_end", "target_end", unescape(lost).alias("loss"), (cut - 1).alias("role_chars"),
        unescape(F.substring(inner, F.lit(1), cut - 1)).alias("role"),
        unescape(F.substring(inner, cut + 1, F.length(inner))).alias("text"),
    )
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(_digest, DIGESTS)
