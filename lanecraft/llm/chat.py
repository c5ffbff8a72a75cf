"""Chat formatting in budgeted windows.

Turns are rows (conversation, turn, role, text).  Prefix sums of the turns' token costs place every turn in
the window ``floor(sum before / SPAN)`` of its conversation: windows are aligned to turns and take SPAN
tokens, plus what is left of the last turn (a longer turn is never cut).  Every window after the first
repeats the conversation's leading system turn at its start and as history the last turn of the conversation's
window before, and those of its turns that begin within its last ``HISTORY`` tokens.  Assistant texts are targets once, where they are new: repeated
history and system turns are masked.

The template marks a turn as

    <s>[INST] role [/INST] text</s>

Inside roles and texts a backslash goes before every backslash and control string, so a control string
without one is a mark, and reading back is exact.  A window is a row: formatted text, loss spans (character
offsets in the formatted text), and how many of its turns repeat.

Running sums are made in two levels (sums over ranges of turns, then inside each range), so a conversation
holding a third of all rows is spread over many tasks.  Null text is empty, null role is the empty role, null turn sorts
first.  Rows of one conversation and turn keep an order by role and text; repeated rows are turns of their
own.  A null conversation id is a conversation.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lanecraft.llm.common import partitions, stage

SPAN = 768
HISTORY = 192
SYSTEM, TARGET = "system", "assistant"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
_ESCAPE = "(" + "|".join([r"\\", *map(re.escape, CONTROL)]) + ")"
_MARKS = re.compile(r"(?s)<s>\[INST\] ((?:\\.|[^\\])*?) \[/INST\] ((?:\\.|[^\\])*?)</s>")


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _ESCAPE, r"\\$1")


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


def read_turns(window: str) -> list[tuple[str, str, int, int]]:
    """(role, text, begin, end of the escaped text) of each turn of a formatted window."""
    out, at = [], 0
    for m in _MARKS.finditer(window):
        if m.start() != at:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    if at != len(window):
        raise ValueError(f"no turn at {at}")
    return out


def token_cost(text: Column) -> Column:
    """Words and single punctuation marks: an estimate that needs no tokenizer."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\w+|[^\w\s]")) + 1


def positions(turns: DataFrame) -> DataFrame:
    """Adds ``before``: the cost of all earlier turns of the conversation, and ``nth``: their number.

    Rows are range-partitioned by conversation and turn (a long conversation spans many partitions),
    staged with their partition number, summed inside it, and each conversation's sums of earlier
    partitions (at most one row per partition and conversation boundary) are added.
    """
    spark = turns.sparkSession
    order = ["conv", "turn", "role", "text"]
    dealt = stage(turns.repartitionByRange(partitions(spark), "conv", "turn").withColumn("part", F.spark_partition_id()), "turns")
    sums = dealt.groupBy("conv", "part").agg(F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("base", F.coalesce(F.sum("cost").over(earlier), F.lit(0))) \
        .withColumn("nbase", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select("conv", "part", "base", "nbase")
    w = Window.partitionBy("conv", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("before", F.coalesce(F.sum("cost").over(w), F.lit(0))).withColumn("nth", F.coalesce(F.count(F.lit(1)).over(w), F.lit(0)))
    base = base.withColumnRenamed("conv", "c").withColumnRenamed("part", "p")
    return inside.join(base, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))) \
        .withColumn("before", F.col("before") + F.col("base")).withColumn("nth", F.col("nth") + F.col("nbase")).drop("base", "nbase", "c", "p", "part")


def windows(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
            span: int = SPAN, history: int = HISTORY, cost=token_cost) -> DataFrame:
    """One row per window: conv, window, n_repeated, n_new, formatted, loss (array of begin, end)."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    turns = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"),
                                 cost(text).cast("long").alias("cost"))
    placed = positions(turns).withColumn("window", F.floor(F.col("before") / span)).withColumn("repeat", F.lit(False))
    # where a window ends the conversation's next one begins, however long its last turn was
    end = F.max(F.col("before") + F.col("cost")).over(Window.partitionBy("conv", "window"))
    placed = placed.withColumn("next", F.floor(end / span)).withColumn("last", F.col("before") + F.col("cost") == end)
    placed = placed.withColumn("body", F.concat(F.lit("<s>[INST] "), escape(F.col("role")), F.lit(" [/INST] "), escape(F.col("text")), F.lit("</s>"))) \
        .withColumn("skip", F.length(F.concat(F.lit("<s>[INST] "), escape(F.col("role")), F.lit(" [/INST] ")))) \
        .select("conv", "window", "next", "last", "nth", "before", "role", "repeat", "body", "skip")
    placed = stage(placed, "placed")
    used = placed.select("conv", "window").distinct()
    leading = (F.col("nth") == 0) & (F.col("role") == SYSTEM)
    kept = placed.where((F.col("last") | (F.col("before") + history >= (F.col("window") + 1) * span)) & ~leading & (F.col("next") > F.col("window"))) \
        .withColumn("window", F.col("next")).withColumn("repeat", F.lit(True))
    system = placed.where(leading).withColumnRenamed("window", "own").withColumnRenamed("conv", "c")
    later = used.where("window > 0")
    again = later.join(system, F.col("conv").eqNullSafe(F.col("c")) & (F.col("own") < F.col("window"))).withColumn("repeat", F.lit(True)).select(*placed.columns)
    l2 = later.withColumnRenamed("conv", "c").withColumnRenamed("window", "w")
    kept = kept.join(l2, F.col("conv").eqNullSafe(F.col("c")) & (F.col("window") == F.col("w")), "left_semi")
    rows = placed.unionByName(again).unionByName(kept.select(*placed.columns))
    packed = rows.groupBy("conv", "window").agg(F.array_sort(F.collect_list(F.struct((~F.col("repeat")).alias("new"), "nth", "role", "body", "skip"))).alias("turns"))
    body = F.transform("turns", lambda t: F.length(t["body"]))
    ends = F.aggregate(body, F.array().cast("array<bigint>"), lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("bigint")) + n)))
    loss = F.filter(F.transform(F.arrays_zip(F.col("turns").alias("t"), F.col("ends").alias("e")), lambda z: F.when(
        z["t"]["new"] & (z["t"]["role"] == TARGET), F.struct((z["e"] - F.length(z["t"]["body"]) + z["t"]["skip"]).alias("begin"), (z["e"] - 4).alias("end")))), lambda x: x.isNotNull())
    out = packed.withColumn("ends", F.when(F.size("turns") > 0, ends)).withColumn("loss", loss)
    return out.select("conv", "window", F.size(F.filter("turns", lambda t: ~t["new"])).alias("n_repeated"), F.size(F.filter("turns", lambda t: t["new"])).alias("n_new"),
                      F.array_join(F.transform("turns", lambda t: t["body"]), "").alias("formatted"), "loss")


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: conv, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars.

    A digest over a whole conversation is sequential, so its windows meet in one task, in order; they are
    streamed with one running digest, never gathered."""
    kind = formatted.schema["conv"].dataType

    def run(batches):
        held, state, conv_type = None, None, None
        done: list = []

        def flush():
            if state is not None:
                done.append((held, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            conv_type = batch.schema.field(0).type
            for conv, text, repeated, loss in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if state is None or conv != held:
                    flush()
                    held, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said, _, _ in read_turns(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    target = unescape(text[span["begin"]:span["end"]])
                    state[2] += len(target)
                    state[3].update(target.encode())
                state[4] += len(text)
            yield _rows(done, conv_type)
            done.clear()
        flush()
        if done:
            yield _rows(done, conv_type)

    ordered = formatted.select("conv", "window", "formatted", "n_repeated", "loss").repartition(partitions(formatted.sparkSession), "conv") \
        .sortWithinPartitions("conv", "window")
    return ordered.mapInArrow(run, f"conv {kind.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def _rows(done: list, conv_type) -> pa.RecordBatch:
    cols = list(zip(*done)) if done else [()] * 6
    types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)],
                                      names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
