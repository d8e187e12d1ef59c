"""Chat formatting from event logs.

A log has events of messages: ``message`` opens one with its role and text, ``delta`` appends,
``edit`` replaces the text, ``regenerate`` starts it anew, ``delete`` takes it out. Logs are
partitioned by conversation, once, and sorted by message and sequence; a stream then folds each
message's events, and the final messages are rendered in order of their position.

The template: ``<s>[INST]`` text ``[/INST]`` for users, text ``</s>`` for assistants and
``<s>[ROLE]`` role ``[TEXT]`` text ``[/TEXT]`` for others. Control strings begin with ``<`` or ``[``;
in texts and roles these become ``<\\`` and ``[\\``, and a backslash becomes two, so no control
string is left in a text and every text comes back exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESETS = ("message", "edit", "regenerate")
EVENTS = (*RESETS, "delta", "delete")
KEY = ("conv_id", "position", "tie")
#: Deltas that a derived log cuts a text into.
PIECES = 4


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "<\\").replace("[", "[\\")


def unescape(text: str) -> str:
    """Undoes ``escape``, last step first: each ``[`` and ``<`` has its own backslash right behind it."""
    return text.replace("[\\", "[").replace("<\\", "<").replace("\\\\", "\\")


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn, and from where to where in it the loss applies (equal: nowhere)."""
    body = escape(text)
    if role == "user":
        return f"<s>[INST]{body}[/INST]", 0, 0
    if role == "assistant":
        return f"<s>{body}</s>", 3, 3 + len(body)
    return f"<s>[ROLE]{escape(role)}[TEXT]{body}[/TEXT]", 0, 0


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a rendered conversation or piece of one.

    Bodies end at the next control string, which no escaped text holds, so a turn of any length is
    found by plain searches.
    """
    out, at = [], 0

    def body(start: int, end: str) -> tuple[str, int]:
        to = formatted.find(end, start)
        found = unescape(formatted[start:to]) if to >= 0 else ""
        if to < 0 or escape(found) != formatted[start:to]:
            raise ValueError(f"not a rendered conversation at {start}")
        return found, to + len(end)

    while at < len(formatted):
        if formatted.startswith("<s>[INST]", at):
            text, at = body(at + 9, "[/INST]")
            out.append(("user", text))
        elif formatted.startswith("<s>[ROLE]", at):
            role, at = body(at + 9, "[TEXT]")
            text, at = body(at, "[/TEXT]")
            out.append((role, text))
        elif formatted.startswith("<s>", at):
            text, at = body(at + 3, "</s>")
            out.append(("assistant", text))
        else:
            raise ValueError(f"not a rendered conversation at {at}")
    return out


def by_conversation(events: DataFrame) -> DataFrame:
    """A conversation's events together; conversations over the partitions by hash."""
    return events.repartition("conv_id")


def fold_events(events: DataFrame, *, together: bool = False) -> DataFrame:
    """Final messages ``(conv_id, position, tie, role, text)`` of a log, each conversation's in order in one partition.

    ``events`` has conv_id, position and tie (the message), seq, event, role, text. Null texts count
    as empty, a null seq sorts first, events of one seq go by kind (``message`` before ``edit``,
    ``regenerate`` and the others) and text. An event that resets a message lets go of what came
    before, so a long history of edits is never held. A message whose last state is ``delete`` is
    dropped; its role is the last one told. An unknown event raises. ``together`` tells that
    each conversation is in one partition already (``by_conversation``).
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        role, parts, gone = None, [], False
        names, kinds = [*KEY, "role", "text"], [*[pa.int64()] * 3, pa.string(), pa.string()]
        for b in batches:
            done, held = [], 0
            for *key, event, told, text in zip(*(b.column(c).to_pylist() for c in (*KEY, "event", "role", "text"))):
                if now != (key := tuple(key)):
                    if now is not None and not gone:
                        done.append((*now, role, "".join(parts)))
                        held += len(done[-1][-1])
                    now, role, parts, gone = key, None, [], False
                if event not in EVENTS:
                    raise ValueError(f"unknown event {event!r}")
                role = role if told is None else told
                if event in RESETS:
                    parts, gone = [], False
                if event == "delete":
                    gone = True
                elif text:
                    parts.append(text)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)
                    done, held = [], 0
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)
        if now is not None and not gone:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*now, role, "".join(parts)), kinds)], names=names)

    rank = F.when(F.col("event") == "message", 0).when(F.col("event") == "edit", 1).when(F.col("event") == "regenerate", 2).otherwise(3)
    whole = events if together else by_conversation(events)
    ordered = whole.select(*[F.col(c).cast("long").alias(c) for c in KEY], "seq", rank.alias("rank"), "event", "role", "text").sortWithinPartitions(*KEY, "seq", "rank", "text")
    return ordered.select(*KEY, "event", "role", "text").mapInArrow(rows, "conv_id long, position long, tie long, role string, text string")


def numbered_turns(turns: DataFrame) -> DataFrame:
    """``(conv_id, position, tie, role, text)`` of turn rows (conv_id, turn, role, text), each conversation in one partition.

    Equal turns stay apart by ``tie``, their order by role and text. Null roles and texts are empty.
    """
    rows = by_conversation(turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("position"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]))
    # the exchange by conversation serves this window too
    tie = F.row_number().over(Window.partitionBy("conv_id", "position").orderBy("role", "text"))
    return rows.withColumn("tie", tie.cast("long"))


def events_of_turns(turns: DataFrame) -> DataFrame:
    """A log whose messages end as the rows of ``turns``, each conversation in one partition.

    Assistants' texts are streamed: the message opens empty, gets some deltas of a first answer, is
    regenerated, and gets the final text in ``PIECES`` deltas. Other messages open with a draft, the
    text's first half, and are edited to the whole.
    """
    n = F.char_length("text")

    def event(seq: int, kind: str, text: Column, role: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("event"), (none if role is None else role).alias("role"), text.alias("text"))

    cut = lambda k: F.substring("text", 1 + F.floor(n * k / PIECES).cast("int"), F.floor(n * (k + 1) / PIECES).cast("int") - F.floor(n * k / PIECES).cast("int"))
    empty, told = F.lit(""), F.col("role")
    streamed = [event(0, "message", empty, told), event(1, "delta", cut(PIECES - 1)), event(2, "delta", F.lit("?")), event(3, "regenerate", empty), *[event(4 + k, "delta", cut(k)) for k in range(PIECES)]]
    edited = [event(0, "message", F.substring("text", 1, F.floor(n / 2).cast("int")), told), event(1, "delta", F.lit("...")), event(2, "edit", F.col("text"))]
    events = F.when(F.col("role") == "assistant", F.array(*streamed)).otherwise(F.array(*edited))
    return numbered_turns(turns).select(*KEY, F.explode(events).alias("e")).select(*KEY, "e.*")


def render_messages(messages: DataFrame) -> DataFrame:
    """``(conv_id, position, tie, formatted, loss_start, loss_end)``: a conversation's text is these in order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [render_turn(r.as_py() or "", t.as_py() or "") for r, t in zip(b.column("role"), b.column("text"))]
            text, lo, hi = zip(*made) if made else ((), (), ())
            arrays = [*(b.column(c) for c in KEY), pa.array(text, pa.string()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*KEY, "formatted", "loss_start", "loss_end"])

    return messages.mapInArrow(rows, "conv_id long, position long, tie long, formatted string, loss_start long, loss_end long")


def digest_rendered(rendered: DataFrame) -> DataFrame:
    """What can be read back from rendered messages, which come in order: one row per conversation.

    Works along the stream and holds one message and running digests, whatever a conversation's length.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now, begun = None, False
        state: list = []

        def closed() -> list:
            n, turns, chars, loss, size = state
            return [now, n, turns.hexdigest(), chars, loss.hexdigest(), size]

        for b in batches:
            done = []
            for conv, text, lo, hi in zip(*(b.column(c) for c in ("conv_id", "formatted", "loss_start", "loss_end"))):
                conv, text, lo, hi = conv.as_py(), text.as_py(), lo.as_py(), hi.as_py()
                if not begun or conv != now:
                    if begun:
                        done.append(closed())
                    now, begun, state = conv, True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, plain in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{plain}\n".encode())
                masked = unescape(text[lo:hi])
                state[2] += len(masked)
                state[3].update(masked.encode())
                state[4] += len(text)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done) if done else [[]] * 6, kinds)], names=names)
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(closed(), kinds)], names=names)

    return rendered.mapInArrow(rows, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_conversations(events: DataFrame, *, together: bool = False) -> DataFrame:
    """Rendered messages of a log, each conversation's in order within one partition.

    A null conversation is one of its own, null roles are the empty role, null texts empty; repeated
    rows of a log are events like others; an empty log gives an empty result; other columns, whatever
    their names, are not read. One exchange, by conversation; none if ``together``. One task folds a
    conversation, along a stream that holds one message, so a conversation's length costs time only.
    """
    return render_messages(fold_events(events, together=together))
