"""Chat formatting: layouts are recognised by the fingerprint of their field paths and mapped to canonical turns."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The template: a turn is TURN, its role, a new line, its text, END.
TURN, END = "<|turn|>", "<|end|>"
# Strings that steer some model's template; inside a text they are written with a backslash before their first sign.
CONTROL = (
    TURN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
    "<|startoftext|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>",
)
_TO_ESCAPE = re.compile(r"\\|" + "|".join(f"(?={re.escape(c)})" for c in CONTROL))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURNS = re.compile(
    re.escape(TURN) + r"((?:\\.|[^\\\n])*)\n((?:\\.|(?!" + re.escape(END) + r")[^\\])*+)" + re.escape(END), re.DOTALL
)


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda found: "\\\\" if found[0] else "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns.

    ``fields`` lists (role, path) pairs for layouts with one field per turn.  ``turns`` names a list of turns, whose
    role and text are at ``role`` and ``text``; ``roles`` renames roles.
    """

    fields: tuple[tuple[str, str], ...] = ()
    turns: str = ""
    role: str = ""
    text: str = ""
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> tuple[str, ...]:
        if self.turns:
            return (f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}")
        return tuple(path for _, path in self.fields)


_SHARED_ROLES = (("human", "user"), ("gpt", "assistant"))
MAPPINGS = (
    Layout(turns="messages", role="role", text="content"),
    Layout(turns="conversations", role="from", text="value", roles=_SHARED_ROLES),
    Layout(fields=(("user", "prompt"), ("assistant", "response"))),
    Layout(fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout(fields=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout(fields=(("user", "instruction"), ("assistant", "output"))),
    Layout(fields=(("system", "meta.system"), ("user", "dialog.question"), ("assistant", "dialog.answer"))),
)


def field_paths(value: object, prefix: str = "") -> set[str]:
    """The nested field paths of a record; list items share the path of their list with ``[]``."""
    if isinstance(value, Mapping):
        found: set[str] = set()
        for name, inner in value.items():
            found |= field_paths(inner, f"{prefix}.{name}" if prefix else str(name))
        return found
    if isinstance(value, list):
        found = set()
        for inner in value:
            found |= field_paths(inner, prefix + "[]")
        return found or {prefix + "[]"}
    return {prefix}


def schema_fingerprint(paths: Sequence[str] | set[str]) -> int:
    return xxhash.xxh64_intdigest("\n".join(sorted(paths)).encode("utf-8"))


def _table(mappings: Sequence[Layout]) -> dict[int, Layout]:
    table = {schema_fingerprint(m.paths()): m for m in mappings}
    for m in mappings:
        if m.turns:
            table[schema_fingerprint([f"{m.turns}[]"])] = m  # a record without turns
    return table


def _at(record: Mapping, path: str) -> object:
    for name in path.split("."):
        record = record[name]
    return record


def canonical_turns(record: object, table: Mapping[int, Layout]) -> list[tuple[str, str]] | None:
    """(role, text) pairs of a record, or None for a layout that no mapping knows.  Null counts as empty."""
    mapping = table.get(schema_fingerprint(field_paths(record)))
    if mapping is None:
        return None
    if mapping.turns:
        roles = dict(mapping.roles)
        listed = _at(record, mapping.turns)
        # The paths of a list's items are united, so each item is looked at.
        if any(not isinstance(t, Mapping) or set(t) != {mapping.role, mapping.text} for t in listed):
            return None
        pairs = [(t[mapping.role], t[mapping.text]) for t in listed]
        pairs = [(roles.get(role, role), text) for role, text in pairs]
    else:
        pairs = [(role, _at(record, path)) for role, path in mapping.fields]
    return [tuple("" if x is None else x if isinstance(x, str) else json.dumps(x) for x in pair) for pair in pairs]


def render(turns: Sequence[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the (start, end) code points of assistant texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = TURN + escape(role).replace("\n", "\\\n") + "\n"
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that ``render`` was given."""
    return [(unescape(role), unescape(text)) for role, text in _TURNS.findall(formatted)]


FORMATTED = "id long, known boolean, formatted string, mask array<struct<start:long,end:long>>"


def format_records(
    records: DataFrame, id_col: str = "id", record_col: str = "record", mappings: Sequence[Layout] = MAPPINGS
) -> DataFrame:
    """``id``, ``known``, ``formatted`` and ``mask`` (code point spans under the loss) for JSON records of any layout.

    A record's layout is told by the hash of its sorted nested field paths, and a mapping says where its turns are.
    Control strings inside roles and texts are escaped with a backslash, and backslashes doubled, so ``parse`` gives
    back the turns and no text can open or close a turn.  Assistant texts are under the mask.

    Null records, text that is not JSON, layouts without a mapping, lists in which an item lacks a field of its layout,
    lone surrogates and nesting beyond what a parser can follow give ``known`` false and an empty text; null fields
    count as empty.  One pass, no shuffle; ties and repeated rows play no part.
    """
    table = _table(mappings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for rows in batches:
            known, texts, masks = [], [], []
            for text in rows.column(1).to_pylist():
                try:
                    turns = canonical_turns(json.loads(text), table) if text is not None else None
                    formatted, mask = render(turns or [])
                    formatted.encode("utf-8")
                except (ValueError, RecursionError):  # no JSON, a lone surrogate, or nested too deeply
                    turns, formatted, mask = None, "", []
                known.append(turns is not None)
                texts.append(formatted)
                masks.append([{"start": a, "end": b} for a, b in mask])
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(known), pa.array(texts, pa.string()), pa.array(masks, spans)],
                ["id", "known", "formatted", "mask"],
            )

    return records.select(F.col(id_col).cast("long").alias("id"), record_col).mapInArrow(run, FORMATTED)


def conversation_records(turns: DataFrame) -> DataFrame:
    """``id`` and ``record`` (JSON) from rows of conv_id, turn, role, text: each conversation in the layout it fits.

    A question and an answer become a prompt layout, with a system turn before them an instruction layout; other
    conversations list their messages, those with an odd id in the from/value layout.  Turns come in order of turn,
    then role and text; a null turn comes first, null roles and texts are empty.  Rows without a conversation number
    form one conversation.  A conversation is one training record and has to fit a task.
    """
    turn = F.struct(
        F.col("turn").alias("t"), F.coalesce("role", F.lit("")).alias("r"), F.coalesce("text", F.lit("")).alias("x")
    )
    rows = turns.groupBy(F.col("conv_id").alias("id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    roles = F.transform("turns", lambda t: t["r"])
    text = [F.get("turns", F.lit(i))["x"] for i in range(3)]

    def listed(name: str, role: str, value: str):
        items = F.transform("turns", lambda t: F.struct(t["r"].alias(role), t["x"].alias(value)))
        return F.to_json(F.struct(items.alias(name)))

    question = F.array(F.lit("user"), F.lit("assistant"))
    record = (
        F.when(roles == question, F.to_json(F.struct(text[0].alias("prompt"), text[1].alias("response"))))
        .when(
            roles == F.concat(F.array(F.lit("system")), question),
            F.to_json(F.struct(text[0].alias("instruction"), text[1].alias("input"), text[2].alias("output"))),
        )
        .when((F.col("id") % 2 != 0) & ~F.array_contains(roles, "human") & ~F.array_contains(roles, "gpt"),
              listed("conversations", "from", "value"))
        .otherwise(listed("messages", "role", "content"))
    )
    return rows.select("id", record.alias("record"))


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted text and its mask: the turns' and the masked text's sizes and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for text, mask in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
                turns = parse(text)
                whole = "".join([f"{role}\n{said}\n" for role, said in turns])
                loss = "".join([unescape(text[s["start"] : s["end"]]) for s in mask])
                out.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([rows.column(0), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("id", "formatted", "mask").mapInArrow(run, schema)
