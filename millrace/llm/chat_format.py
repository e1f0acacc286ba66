"""Conversations formatted by a chat template, and read back.

Turns meet in their order by one shuffle and an external sort, then stream through the template's
closures: a conversation is never held as a whole, whatever its length. What is written is a row a turn, with its place in the
formatted conversation and the spans under the loss mask.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from millrace.llm import textarrays as ta
from millrace.llm.carried import Carried
from millrace.llm.chat_template import Template

#: Strings that mark turns; they never stand in a formatted text.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[/TURN]")
INSTRUCTIONS = """
{{- '<s>' }}{% for message in messages %}
    {%- if message.role == 'user' %}[INST] {{ message.text | escape }} [/INST]
    {%- elif message.role == 'assistant' %}{{ ' ' }}{% generation %}{{ message.text | escape }}{% endgeneration %}</s>
    {%- else %}[ROLE]{{ message.role | escape }}[/ROLE]{{ message.text | escape }}[/TURN]
    {%- endif %}
{%- endfor %}"""
_TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]| (?P<assistant>.*?)</s>|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<text>.*?)\[/TURN\]", re.S)

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
MADE = [T.StructField("formatted", T.StringType()), T.StructField("formatted_at", T.LongType()), T.StructField("loss", T.ArrayType(SPAN))]


def format_conversations(df: DataFrame, source: str = INSTRUCTIONS, controls: tuple[str, ...] = CONTROLS, keys: tuple[str, ...] = ("conv_id",), turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``df``, a row a turn, with formatted, formatted_at and loss; in order within partitions.

    formatted: what the turn adds to its conversation, the template's head and tail with the first and the last turn.
    formatted_at: its first code point's place there. loss: the spans of the conversation that the template generates.
    Conversations are the rows of equal keys (null keys are equal to each other), ordered by turn (null first), then by
    role and text. Null roles and texts count as empty. Input columns named like the results are replaced; an empty table gives no rows.
    """
    own = Carried(df, [f.name for f in MADE])
    at = [own.find(c) for c in (*keys, role, text)]
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    given = own.rows.withColumns({"__role": blank(at[-2]), "__text": blank(at[-1])})
    held = own.columns() + [c for c in dict.fromkeys(at[:-2]) if c not in own.columns()]
    by = [held.index(c) for c in at[:-2]]
    order = F.col(own.find(turn)).asc_nulls_first()
    placed = given.repartition(*at[:-2]).sortWithinPartitions(*at[:-2], order, "__role", "__text").select(*held, "__role", "__text")
    schema = T.StructType([own.rows.schema[c] for c in own.columns()] + MADE)
    kept = [held.index(c) for c in own.columns()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(source, controls)
        state = {"key": None, "before": None, "index": 0, "length": 0}
        last: pa.RecordBatch | None = None

        def written(rows: pa.RecordBatch, following: tuple | None) -> pa.RecordBatch:
            """Rows, given the row that follows the last of them."""
            listed = list(zip(*[rows.column(k).to_pylist() for k in by], strict=True))
            messages = [{"role": r, "text": t} for r, t in zip(rows.column(len(held)).to_pylist(), rows.column(len(held) + 1).to_pylist(), strict=True)]
            nexts = [*zip(listed, messages, strict=True)][1:] + [following or (None, None)]
            bodies, places, spans = [], [], []
            for key, message, (next_key, after) in zip(listed, messages, nexts, strict=True):
                if key != state["key"] or state["before"] is None:
                    state.update(key=key, before=None, index=0, length=0)
                at, body, loss = state["length"], [], []
                for piece, mask in template.turn(message, state["before"], after if next_key == key else None, state["index"]):
                    if mask and piece:
                        if loss and loss[-1]["end"] == at:
                            loss[-1]["end"] = at + len(piece)
                        else:
                            loss.append({"start": at, "end": at + len(piece)})
                    body.append(piece)
                    at += len(piece)
                bodies.append("".join(body))
                places.append(state["length"])
                spans.append(loss)
                state.update(before=message if next_key == key else None, index=state["index"] + 1, length=at)
            made = [pa.array(bodies, pa.string()), pa.array(places, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            return pa.RecordBatch.from_arrays([rows.column(k) for k in kept] + made, names=schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            if last is not None:
                first = batch.slice(0, 1)
                following = (tuple(first.column(k)[0].as_py() for k in by), {"role": first.column(len(held))[0].as_py(), "text": first.column(len(held) + 1)[0].as_py()})
                yield written(last, following)
            n = batch.num_rows - 1
            last = batch.take(pa.array([n]))
            if n:
                following = (tuple(last.column(k)[0].as_py() for k in by), {"role": last.column(len(held))[0].as_py(), "text": last.column(len(held) + 1)[0].as_py()})
                yield written(batch.slice(0, n), following)
        if last is not None:
            yield written(last, None)

    ta.limit_batches(df)
    return placed.mapInArrow(run, schema).toDF(*[own.names[i] for i in own.kept], *[f.name for f in MADE])


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn that a text formatted by INSTRUCTIONS holds, escapes undone."""
    _, unescape = _ESCAPING
    at = 3 if formatted.startswith("<s>") else 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not a formatted turn: {formatted[at : at + 40]!r}")
        if m["role"] is not None:
            yield unescape(m["role"]), unescape(m["text"])
        else:
            yield m.lastgroup, unescape(m[m.lastgroup])
        at = m.end()


_ESCAPING = (Template("", CONTROLS).escape, Template("", CONTROLS).unescape)
DIGESTS = [T.StructField(n, T.StringType() if n.endswith("sha256") else T.LongType()) for n in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")]


def read_back(formatted: DataFrame, keys: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """A row a conversation: keys and digests of the turns and of the generated text, read from the formatted rows and their spans.

    ``formatted`` is what ``format_conversations`` returned, in its order. Hashes and counts go on from row to row, so a
    conversation of any length takes the memory of a turn.
    """
    rows = formatted.select(*keys, "formatted", "formatted_at", "loss")
    schema = T.StructType([formatted.schema[k] for k in keys] + DIGESTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unescape = _ESCAPING[1]
        key, now = None, None
        for batch in batches:
            done = []
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                body, at, loss = row[-3:]
                if now is None or row[:-3] != key:
                    if now is not None:
                        done.append((key, now))
                    key, now = row[:-3], {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "all": 0}
                for role, text in read_turns(body):
                    now["n"] += 1
                    now["turns"].update(f"{role}\n{text}\n".encode())
                for span in loss:
                    said = unescape(body[span["start"] - at : span["end"] - at])
                    now["loss"].update(said.encode())
                    now["chars"] += len(said)
                now["all"] += len(body)
            yield _digests(done, batch.schema, schema)
        if now is not None:
            yield _digests([(key, now)], batch.schema, schema)

    return rows.mapInArrow(run, schema)


def _digests(done: list, given: pa.Schema, schema: T.StructType) -> pa.RecordBatch:
    n_keys = len(schema) - 5
    keys = [pa.array([k[i] for k, _ in done], given.field(i).type) for i in range(n_keys)]
    made = [[d["n"] for _, d in done], [d["turns"].hexdigest() for _, d in done], [d["chars"] for _, d in done], [d["loss"].hexdigest() for _, d in done], [d["all"] for _, d in done]]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays(keys + [pa.array(m, k) for m, k in zip(made, kinds, strict=True)], names=schema.names)
