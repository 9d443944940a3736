"""Chat formatting by schema fingerprints.

The nested field paths of a record (or the columns of a table of turns) are hashed; the fingerprint selects a
declarative mapping that turns the layout into canonical turns. A template marks the turns, and its control strings
inside texts are escaped reversibly, so that a reader gets back every turn and the text under the loss mask.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Layouts: ``each`` names a list of messages with fields for role and text (the first there is counts); ``turns`` lists
#: (role, fields whose texts join by a blank line); ``rows`` is a table with one row for each turn.
MAPPINGS = (
    {"name": "messages", "each": "messages", "role": ("role",), "text": ("content", "text")},
    {"name": "conversations", "each": "conversations", "role": ("from", "role"), "text": ("value", "content", "text")},
    {"name": "dialog", "each": "dialog", "role": ("speaker", "role"), "text": ("utterance", "text", "content")},
    {"name": "instruction", "turns": (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))},
    {"name": "instruction-response", "turns": (("system", ("system",)), ("user", ("instruction", "context")), ("assistant", ("response",)))},
    {"name": "prompt-completion", "turns": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))},
    {"name": "prompt-response", "turns": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))},
    {"name": "question-answer", "turns": (("system", ("system",)), ("user", ("context", "question")), ("assistant", ("answer",)))},
    {"name": "turn-rows", "rows": {"conv": ("conv_id", "conversation_id"), "turn": ("turn", "turn_index"), "role": ("role", "speaker"), "text": ("text", "content")}},
)
#: Names of roles in other layouts.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
CONTROL = re.compile(r"\\|<<?/?SYS>>|</?s>|\[/?INST\]|\[/?ROLE")
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<<SYS>>\n", "\n<</SYS>>")}


def paths(value, at: str = "") -> set[str]:
    """Nested field paths with the kind of each leaf; items of a list share a path."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths(v, f"{at}.{k}" if at else k)} or {f"{at}:object"}
    if isinstance(value, list):
        return {p for v in value for p in paths(v, f"{at}[]")} or {f"{at}[]"}
    return {f"{at}:{'null' if value is None else 'text' if isinstance(value, str) else 'number'}"}


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


class Registry:
    """Fingerprint -> mapping; a new fingerprint is matched once, by the fields it has."""

    def __init__(self, mappings=MAPPINGS):
        self.mappings, self.known = mappings, {}

    def select(self, found: set[str]) -> dict | None:
        key = fingerprint(found)
        if key not in self.known:
            names = {p.partition(":")[0] for p in found}
            names |= {n[: m.start()] for n in names for m in re.finditer(r"\.|\[\]", n)}
            self.known[key] = next((m for m in self.mappings if self.fits(m, names)), None)
        return self.known[key]

    @staticmethod
    def fits(mapping: dict, names: set[str]) -> bool:
        if "each" in mapping:
            each = mapping["each"]
            return f"{each}[]" in names or all(any(f"{each}[].{f}" in names for f in mapping[k]) for k in ("role", "text"))
        if "turns" in mapping:
            return all(fields[0] in names or fields[-1] in names for role, fields in mapping["turns"] if role != "system")
        return all(any(f in names for f in fields) for fields in mapping["rows"].values())

    def turns(self, record: dict) -> tuple[str, list[tuple[str, str]]]:
        """(layout, canonical turns) of a record; ``unknown`` and no turns if no mapping fits, or if a message is no object.

        Roles and texts that are no strings are their JSON; nulls are empty, and fields that are null or empty are left
        out where a turn joins several.
        """
        mapping = self.select(paths(record))
        if mapping is None or "rows" in mapping:
            return "unknown", []
        if "each" in mapping:
            items = record.get(mapping["each"])
            if not isinstance(items, list) or not all(isinstance(m, dict) for m in items):
                return "unknown", []
            pick = lambda m, k: next((m[f] for f in mapping[k] if m.get(f) is not None), "")
            out = [(said(pick(m, "role")), said(pick(m, "text"))) for m in items]
        else:
            out = [(role, "\n\n".join(x for f in fields if (x := said(record.get(f))))) for role, fields in mapping["turns"] if role != "system" or said(record.get("system"))]
        return mapping["name"], [(ROLES.get(role, role), text) for role, text in out]


def said(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def escape(text: str) -> str:
    """A text without control strings: a backslash follows the first character of each, and backslashes are doubled."""
    return CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """(a turn as the template has it, begin and end of its loss mask); the mask of other roles is empty."""
    begin, end = MARKS.get(role) or (f"[ROLE {quote(role, safe='')}]\n", "\n[/ROLE]")
    body = escape(text)
    at = len(begin)
    return begin + body + end, at, at + len(body) if role == "assistant" else at


TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|<<SYS>>\n(?P<system>.*?)\n<</SYS>>|\[ROLE (?P<role>[^\]]*)\]\n(?P<other>.*?)\n\[/ROLE\]| (?P<assistant>.*?) </s>", re.S)


class Reader:
    """Reads formatted text that comes in parts: turns, and the text under the loss mask, as the template marks them."""

    def __init__(self):
        self.rest = ""

    def feed(self, part: str) -> Iterator[tuple[str, str, str]]:
        """(role, text, text under the mask as it is formatted) of each turn that ends in this part."""
        text, at = self.rest + part, 0
        while at < len(text) and (m := TURN.match(text, at)) is not None:
            kind = m.lastgroup
            yield (unquote(m["role"]) if kind == "other" else kind), unescape(m[kind]), m["assistant"] or ""
            at = m.end()
        self.rest = text[at:]

    def close(self) -> None:
        if self.rest:
            raise ValueError("formatted text ends inside a turn")


def parsed(output: str) -> Iterator[tuple[str, str]]:
    """The turns of formatted text: (role, text)."""
    reader = Reader()
    for role, text, _ in reader.feed(output):
        yield role, text
    reader.close()


def format_records(records: DataFrame, id_col: str = "conv_id", record_col: str = "record") -> DataFrame:
    """``conv_id, layout, formatted, loss_spans`` of each row's JSON record.

    ``loss_spans`` are [begin, end) in code points of ``formatted``. Records that are null, empty, no JSON object, of an
    unknown layout, or hold messages that are no objects get the layout ``unknown`` and an empty text; long texts are
    whole. Of layouts that fit alike the first of MAPPINGS counts. Repeated rows stay repeated; extra columns are
    ignored, whatever their names; an empty table gives an empty result.
    """

    def run(batches):
        registry = Registry()
        for batch in batches:
            rows = []
            for raw in batch.column(1).to_pylist():
                try:
                    record = json.loads(raw or "null")
                    layout, turns = registry.turns(record) if isinstance(record, dict) else ("unknown", [])
                except (ValueError, RecursionError):  # no JSON, or nested beyond reason
                    layout, turns = "unknown", []
                text, spans = [], []
                at = 0
                for role, said in turns:
                    piece, a, b = formatted(role, said)
                    spans += [{"begin": at + a, "end": at + b}] if b > a else []
                    text.append(piece)
                    at += len(piece)
                rows.append((layout, "".join(text), spans))
            layouts, texts, spans = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(layouts, pa.string()), pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))], names=["conv_id", "layout", "formatted", "loss_spans"])

    rows = records.select(F.col(id_col).alias("conv_id"), F.col(record_col).alias("record"))
    return rows.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, layout string, formatted string, loss_spans array<struct<begin:int,end:int>>")


def turn_rows(table: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` of a table of turns whose columns' fingerprint selects a mapping; null texts and roles are empty. Rows stay as they are, repeated ones too; other columns are dropped."""
    mapping = Registry().select({f"{c}:{t}" for c, t in table.dtypes})
    if mapping is None or "rows" not in mapping:
        raise ValueError(f"no mapping for a table of {table.columns}")
    at = {k: next(f for f in fields if f in table.columns) for k, fields in mapping["rows"].items()}
    role = F.coalesce(F.col(at["role"]), F.lit(""))
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return table.select(F.col(at["conv"]).cast("long").alias("conv_id"), F.col(at["turn"]).cast("long").alias("turn"), F.coalesce(F.element_at(known, role), role).alias("role"), F.coalesce(F.col(at["text"]), F.lit("")).alias("text"))


def format_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, seq, formatted, loss_begin, loss_end``: the formatted piece of each canonical turn, in order of ``seq``.

    Turns go by number, then role and text; the pieces of a conversation, joined, are its formatted text. Pieces leave
    as they come, so that a conversation of any length needs the memory of one turn. Offsets are those of the piece.
    Null turn numbers come first, null conversations form one; repeated rows are turns of their own; long texts are
    whole; an empty table gives an empty result; extra columns are ignored.
    """

    def run(batches):
        last, seq = object(), 0
        for batch in batches:
            rows = []
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                seq = seq + 1 if conv == last else 0
                last = conv
                rows.append((conv, seq, *formatted(role, text)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()))], names=["conv_id", "seq", "formatted", "loss_begin", "loss_end"])

    ordered = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, seq long, formatted string, loss_begin int, loss_end int")


def read_back(pieces: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` of formatted text (conv_id, seq, formatted).

    Everything, the loss mask too, is read from the text itself. Pieces must come as ``format_turns`` leaves them: a
    conversation's in one partition, in order. An empty table gives an empty result; extra columns are ignored.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def run(batches):
        state, out = None, []

        def close():
            if state:
                state["reader"].close()
                out.append((state["conv"], state["turns"], state["all"].hexdigest(), state["loss"], state["mask"].hexdigest(), state["chars"]))

        for batch in batches:
            for conv, seq, text in zip(*(col.to_pylist() for col in batch.columns)):
                if seq == 0:
                    close()
                    state = {"conv": conv, "reader": Reader(), "turns": 0, "all": hashlib.sha256(), "loss": 0, "mask": hashlib.sha256(), "chars": 0}
                state["chars"] += len(text)
                for role, said, masked in state["reader"].feed(text):
                    loss = unescape(masked)
                    state["turns"] += 1
                    state["all"].update(f"{role}\n{said}\n".encode())
                    state["loss"] += len(loss)
                    state["mask"].update(loss.encode())
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)

    return pieces.select("conv_id", "seq", "formatted").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: Escapes add a character for each control string and backslash; marks add a fixed number for each turn.
SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
g AS (SELECT conv_id, count(*) AS n_turns,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
             coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
             sum(length(regexp_replace(text, '\\|<<?/?SYS>>|</?s>|\[/?INST\]|\[/?ROLE', '\0' || chr(1), 'g'))
                 + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 WHEN 'system' THEN 17 ELSE 16 + length(url_encode(role)) END) AS formatted_chars
      FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""
