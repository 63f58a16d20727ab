"""Chat transcripts rebuilt from event logs, rendered with a reversible template and a loss mask.

An event is (conv_id, seq, kind, msg, role, text). Kinds: `message` and `edit` set the text of
message `msg`; `regenerate` sets it too and drops every later message begun before it; `delta`
appends. Messages of a conversation are ordered by their first event.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, HEAD, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings with a meaning in some chat template; inside texts each gets a backslash after its first character.
CONTROL = (OPEN, HEAD, CLOSE, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    """Backslashes doubled, then a backslash set inside every control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: str) -> str:
    return re.sub(r"\\(\\)?", r"\1", text) if "\\" in text else text


#: Sequence numbers of a stretch of a conversation, which one task reads in order.
STRETCH = 4096


def _dropped(messages: DataFrame) -> DataFrame:
    """(key) of messages (key, conv_id, msg, place, redone) that began before the regeneration of an earlier one.

    A message is dropped if the largest `redone` of those before it reaches its place. Conversations are
    cut to stretches: the largest of a stretch is carried over those behind it, and within one a window
    follows the messages, so no task reads a conversation's messages whole.
    """
    placed = messages.withColumn("stretch", F.floor(F.col("place") / STRETCH))
    stretches = placed.groupBy("conv_id", "stretch").agg(F.max("redone").alias("redone"))
    behind = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = stretches.select("conv_id", "stretch", F.max("redone").over(behind).alias("carried")).where("carried is not null")
    inside = Window.partitionBy("conv_id", "stretch").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
    near = placed.withColumn("near", F.max("redone").over(inside)).where("near >= place").select("key")
    same = F.col("p.conv_id").eqNullSafe(F.col("c.conv_id")) & (F.col("p.stretch") == F.col("c.stretch")) & (F.col("c.carried") >= F.col("p.place"))
    return near.unionByName(placed.alias("p").join(carried.alias("c"), same).select("p.key")).distinct()


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, place (seq of the first event), role, text.

    Each message is folded on its own: among its events by seq, those from the last `message`, `edit` or
    `regenerate` on count, and their texts are joined; events that a later one supersedes are left out
    before that, so that only a message's final text has to fit a task. A null text counts as empty, a
    null role as the empty role; the role is that of the last event which has one. Events with equal seq
    are ordered by kind, role and text.
    """
    keyed = events.select("*", F.md5(F.to_json(F.struct("conv_id", "msg"))).alias("key"), F.struct("seq", "kind", "role", F.md5("text").alias("text")).alias("at"))
    slim = keyed.groupBy("key").agg(
        F.first("conv_id").alias("conv_id"), F.first("msg").alias("msg"), F.min("seq").alias("place"), F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("redone"),
        F.max(F.when(F.col("kind") != "delta", F.col("at"))).alias("set_at"), F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "kind", "role"))).alias("named"),
    )
    live = slim.join(_dropped(slim), "key", "left_anti").select("key", "conv_id", "msg", "place", "set_at", F.coalesce(F.col("named")["role"], F.lit("")).alias("role"))
    said = keyed.select("key", "at", F.coalesce("text", F.lit("")).alias("text")).join(live, "key").where("set_at is null or at >= set_at")
    parts = F.sort_array(F.collect_list(F.struct("at", "text")))
    joined = F.array_join(F.transform(parts, lambda e: e["text"]), "")
    return said.groupBy("key", "conv_id", "msg", "place", "role").agg(joined.alias("text")).select("conv_id", "place", "msg", "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """Messages with `formatted`, their part of the transcript; a transcript is its parts by (place, msg)."""
    return messages.withColumn("formatted", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(HEAD), escape(F.col("text")), F.lit(CLOSE)))


_PART = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(HEAD) + "(.*?)" + re.escape(CLOSE), re.S)


class _Reader:
    """What is read back from one conversation's transcript, part by part."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.turns, self.chars, self.loss_chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, part: str) -> None:
        self.chars += len(part)
        for role, text in _PART.findall(part):
            role, text = unescape(role), unescape(text)
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role == "assistant":
                self.loss_chars += len(text)
                self.loss.update(text.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digest(rendered: DataFrame) -> DataFrame:
    """One row per conversation, read back from its transcript: what the turns and the loss mask hold.

    Columns conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. Conversations
    are hashed as sorted streams: a task holds one batch and the running digests of one
    conversation, however long that is. A null conv_id is a conversation of its own.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for b in batches:
            for conv, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Reader(conv)
                now.read(part)
            if len(done) >= 10_000:
                yield batch(done)
                done = []
        if now is not None:
            done.append(now.row())
        if done:
            yield batch(done)

    streams = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "place", "msg").select("conv_id", "formatted")
    return streams.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def turn_events(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as the event log of a chat client: every row is one message, ordered by turn.

    A message is begun with a draft, which a delta goes on with; it is regenerated, edited to the first
    half of its text, and a last delta brings the rest. Repeated rows and rows of equal turn are messages
    of their own, ordered by role and a digest of the text; a null turn comes first.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    each = turns.groupBy("conv_id", "turn", "role", "text").count().withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))))
    half = F.floor(F.length("text") / 2).cast("int")
    event = lambda step, kind, role, text: F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    none = F.lit(None).cast("string")
    log = F.array(
        event(0, "message", F.col("role"), F.lit("Well")), event(1, "delta", none, F.lit(", let me think")), event(2, "regenerate", none, F.lit("On second thoughts")),
        event(3, "edit", none, F.substring("text", F.lit(1), half)), event(4, "delta", none, F.substring("text", half + 1, F.length("text"))),
    )
    msg = F.struct("turn", "role", F.md5("text").alias("digest"), "nth").alias("msg")
    return each.select("conv_id", msg, F.explode(log).alias("e")).select("conv_id", (F.coalesce(F.col("msg.turn") * 8, F.lit(-(1 << 60))) + F.col("e.step")).alias("seq"), F.col("e.kind").alias("kind"), "msg", F.col("e.role").alias("role"), F.col("e.text").alias("text"))
