"""Chat formatting by event-sourced reconstruction."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The marks of the chat template.
START, END = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"

_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
PART_CHARS = 1 << 20

PARTS = "conv_id long, part int, formatted string, loss array<struct<start:int,end:int>>"


def escaped(text: str) -> str:
    """text without any control string: <| becomes <\\|, and what looks escaped already gets one more backslash."""
    return _ESCAPE.sub(r"<\\\1|", text)


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def _role_out(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


KINDS = ("message", "delta", "edit", "regenerate")


def replayed(events: list[tuple], state: dict, gone: set) -> None:
    """Applies (seq, kind, msg), in order, to the live messages of a conversation: msg -> where it was opened, in that order."""
    for seq, kind, msg in events:
        if kind == "message":
            state.pop(msg, None)
            gone.discard(msg)
            state[msg] = seq
        elif msg not in gone:
            opened = state.setdefault(msg, seq)
            if kind == "regenerate":
                while state:
                    last = next(reversed(state))
                    if opened is None or state[last] is None or state[last] <= opened:
                        break
                    gone.add(last)
                    del state[last]


def _live(events: DataFrame) -> DataFrame:
    """(conv_id, msg, opened) of the messages that are there at the end of each conversation's log. No texts are moved."""
    kinds = {c: events.schema[c].dataType.simpleString() for c in ("conv_id", "msg")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, begun, state, gone = None, False, {}, set()

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([conv] * len(state), types[0]), pa.array(list(state), types[1]), pa.array(list(state.values()), pa.int64())], names=["conv_id", "msg", "opened"])

        for batch in batches:
            types = batch.schema.types[0], batch.schema.types[3]
            convs, *rest = (c.to_pylist() for c in batch.columns)
            at = 0
            while at < len(convs):
                stop = at + 1
                while stop < len(convs) and convs[stop] == convs[at]:
                    stop += 1
                if begun and convs[at] != conv:
                    yield batch_of()
                    state, gone = {}, set()
                conv, begun = convs[at], True
                replayed(list(zip(*(c[at:stop] for c in rest), strict=True)), state, gone)
                at = stop
        if begun:
            yield batch_of()

    light = events.select("conv_id", "seq", "kind", "msg").repartition("conv_id").sortWithinPartitions("conv_id", "seq", "kind", "msg")
    return light.mapInArrow(run, f"conv_id {kinds['conv_id']}, msg {kinds['msg']}, opened long")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, seq, role, text) of an event log (conv_id, seq, kind, msg, role, text).

    Kinds: "message" opens message msg with a text; "delta" adds to its text; "edit" replaces its text; "regenerate" replaces its
    text too and discards the messages that were opened at a later seq than it, up to then. Events apply in order of seq (ties: kind;
    then msg between messages, role and text within one). A message stands where it was opened last, with the role of its first
    event that has one; the first event of a message that was never opened opens it. Events of a discarded message do nothing,
    regenerations included, unless "message" opens it again. A message whose msg is null is complete by itself and is never
    discarded. Null texts and roles are empty; other kinds are ignored.

    Texts are folded message by message, whatever a conversation's length; only light events, without texts, are replayed in order
    of their conversation, by a task that streams them and remembers the live messages.
    """
    rows = events.select("conv_id", F.col("seq").cast("long").alias("seq"), "kind", "msg", "role", F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.where("msg is null and kind = 'message'").select("conv_id", "seq", F.coalesce("role", F.lit("")).alias("role"), "text")
    logged = rows.where(F.col("msg").isNotNull() & F.col("kind").isin(*KINDS))
    # One shuffle of texts by a hash of the message serves the windows, the grouping and the join.
    key = F.xxhash64(F.col("conv_id").isNull(), "conv_id", "msg").alias("key")
    by_message = Window.partitionBy("key", "conv_id", "msg").orderBy("seq", "kind", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = F.array_sort(F.collect_list(F.struct("resets", "n", "text")))
    messages = (
        logged.select(key, "*").repartition("key").withColumn("resets", F.sum((F.col("kind") != "delta").cast("int")).over(by_message))
        .withColumn("n", F.count("*").over(by_message))
        .groupBy("key", "conv_id", "msg")
        .agg(F.min_by("role", F.when(F.col("role").isNotNull(), F.col("n"))).alias("role"), F.max("resets").alias("last"), pieces.alias("pieces"))
        .withColumn("text", F.array_join(F.transform(F.filter("pieces", lambda p: p["resets"] == F.col("last")), lambda p: p["text"]), ""))
        .select("key", "conv_id", "msg", F.coalesce("role", F.lit("")).alias("role"), "text")
        .alias("m")
    )
    live = _live(logged).select(key, "*").alias("l")
    # Not as keys of the join, which would shuffle by them again.
    same = F.when(F.col("m.conv_id").eqNullSafe(F.col("l.conv_id")) & (F.col("m.msg") == F.col("l.msg")), True).otherwise(False)
    both = messages.join(live, (F.col("m.key") == F.col("l.key")) & same)
    return whole.unionByName(both.select("m.conv_id", F.col("l.opened").alias("seq"), "m.role", "m.text"))


def render(messages: DataFrame, *, learned_role: str = LEARNED_ROLE, part_chars: int = PART_CHARS) -> DataFrame:
    """Messages (conv_id, seq, role, text) rendered per conversation, in order of seq (ties: role, text).

    A turn is START role newline text END newline, with control strings in role and text escaped reversibly. loss holds the spans
    (code points of formatted, ends excluded) to learn from: the texts of learned_role. A conversation of more than part_chars goes
    on in further parts, cut between turns, so that no task holds more than a turn beyond that. Rows of a conversation are adjacent
    and in order within a partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        pieces: list[str] = []
        loss: list[dict[str, int]] = []
        conv, part, chars, begun, waiting = None, 0, 0, False, 0

        def close() -> None:
            nonlocal part, chars, waiting
            out.append((conv, part, "".join(pieces), list(loss)))
            waiting += chars
            part, chars = part + 1, 0
            pieces.clear()
            loss.clear()

        def batch_of() -> pa.RecordBatch:
            nonlocal waiting
            cols = list(zip(*out, strict=True))
            out.clear()
            waiting = 0
            spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], spans)], names=["conv_id", "part", "formatted", "loss"]
            )

        for batch in batches:
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not begun or c != conv:
                    if begun:
                        close()
                    conv, part, begun = c, 0, True
                elif chars >= part_chars:
                    close()
                head, body = f"{START}{_role_out(role)}\n", escaped(text)
                if role == learned_role:
                    loss.append({"start": chars + len(head), "end": chars + len(head) + len(body)})
                pieces += (head, body, END, "\n")
                chars += len(head) + len(body) + len(END) + 1
                if len(out) >= 2000 or waiting > 8 * PART_CHARS:
                    yield batch_of()
        if begun:
            close()
        if out:
            yield batch_of()

    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), "role", "text", "seq").repartition("conv_id").sortWithinPartitions("conv_id", "seq", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(run, PARTS)


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of rendered conversations (as render() returns them: adjacent and in order), taken from the output alone.

    Returns conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. Texts are hashed as they stream by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        conv, begun, turns, learned, n, loss_chars, chars = None, False, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        out: list[tuple] = []
        for batch in batches:
            for c, part, text, loss in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if part == 0:
                    if begun:
                        out.append((conv, n, turns.hexdigest(), loss_chars, learned.hexdigest(), chars))
                    conv, begun, turns, learned, n, loss_chars, chars = c, True, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                chars += len(text)
                at = 0
                while at < len(text):
                    start = at + len(START)
                    mid = text.index("\n", start)
                    end = text.index(END, mid)
                    turns.update(f"{_role_in(text[start:mid])}\n{unescaped(text[mid + 1 : end])}\n".encode())
                    n, at = n + 1, end + len(END) + 1
                for span in loss:
                    body = unescaped(text[span["start"] : span["end"]])
                    loss_chars += len(body)
                    learned.update(body.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out.clear()
        if begun:
            out.append((conv, n, turns.hexdigest(), loss_chars, learned.hexdigest(), chars))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return parts.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A turn's events are numbered from so many times its turn on.
STEPS = 8


def turns_as_events(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as the event log that a chat service would have streamed; folding it gives them back.

    By a hash of the row its message is opened whole; streamed in three deltas; drafted, edited and streamed to its end; or begun,
    followed by another message that is discarded as the first one is regenerated, and streamed to its end. Equal rows are messages
    of their own. Rows without a turn come first.
    """
    row = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    row = row.groupBy("conv_id", "turn", "role", "text").count().withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))))
    row = row.withColumn("id", F.xxhash64("conv_id", "turn", "role", "text", "copy")).withColumn("third", F.floor(F.length("text") / 3).cast("int"))
    one, two, three = F.substr("text", F.lit(1), F.col("third")), F.substr("text", F.col("third") + 1, F.col("third")), F.substr("text", 2 * F.col("third") + 1)
    own, other, no_role = F.col("id"), F.bitwise_not("id"), F.lit(None).cast("string")

    def log(*steps: tuple) -> Column:
        return F.array(*[F.struct(F.lit(j).alias("step"), F.lit(kind).alias("kind"), msg.alias("msg"), role.alias("role"), text.alias("text")) for j, (kind, msg, role, text) in enumerate(steps)])

    role = F.col("role")
    logs = F.when(F.pmod("id", F.lit(4)) == 0, log(("message", own, role, F.col("text"))))
    logs = logs.when(F.pmod("id", F.lit(4)) == 1, log(("message", own, role, one), ("delta", own, no_role, two), ("delta", own, no_role, three)))
    logs = logs.when(F.pmod("id", F.lit(4)) == 2, log(("message", own, role, F.concat(three, F.lit(" draft"))), ("edit", own, no_role, F.concat(one, two)), ("delta", own, no_role, three)))
    logs = logs.otherwise(log(("message", own, role, two), ("message", other, F.lit("user"), one), ("delta", other, no_role, F.lit(" lost")), ("regenerate", own, no_role, one), ("delta", own, no_role, F.concat(two, three))))
    begin = F.coalesce(F.col("turn"), F.lit(-(1 << 58))) * STEPS
    return row.select("conv_id", begin.alias("begin"), F.explode(logs).alias("e")).select("conv_id", (F.col("begin") + F.col("e.step")).alias("seq"), "e.kind", "e.msg", "e.role", "e.text")
