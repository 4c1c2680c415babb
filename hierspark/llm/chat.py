"""Chat formatting: records of any known layout become turns, turns become one text with a loss mask.

A record is a JSON object.  The sorted set of its nested field paths is hashed; the hash selects a declarative
mapping, once per layout and task, not once per record.  A layout without a mapping of its own takes the mapping
whose required paths it has; with none, it has no turns and its layout is NULL.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Field names and role names of common public layouts.
# name, required paths, list of turns or None, role of a turn, text of a turn, or (role, fields joined by a blank line)
MAPPINGS = (
    ("messages", ("messages[].content", "messages[].role"), {"list": "messages", "role": "role", "text": "content"}),
    ("share", ("conversations[].from", "conversations[].value"), {"list": "conversations", "role": "from", "text": "value"}),
    ("instruction", ("instruction", "output"), {"fields": (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))}),
    ("completion", ("completion", "prompt"), {"fields": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))}),
    ("response", ("prompt", "response"), {"fields": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))}),
    ("question", ("answer", "question"), {"fields": (("system", ("context",)), ("user", ("question",)), ("assistant", ("answer",)))}),
)
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "chatgpt": "assistant"}
START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def field_paths(value: object, at: str = "") -> set[str]:
    """Nested field paths of a record; list items share the path ``[]``, NULL fields have none."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in field_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, f"{at}[]")}
    return set() if value is None else {at}


def fingerprint(paths: set[str]) -> str:
    return xxhash.xxh64_hexdigest("\n".join(sorted(paths)))


KNOWN = {fingerprint(set(required)): (name, spec) for name, required, spec in MAPPINGS}


def mapping_for(paths: set[str]) -> tuple[str, dict] | None:
    """By the hash of the exact layout, else the first mapping that requires only paths of the record."""
    known = KNOWN.get(fingerprint(paths))
    return known or next(((name, spec) for name, required, spec in MAPPINGS if paths.issuperset(required)), None)


def text_of(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: dict, name: str, spec: dict) -> list[tuple[str, str]]:
    if "list" in spec:
        rows = [x for x in record.get(spec["list"]) or [] if isinstance(x, dict)]
        roles = [text_of(x.get(spec["role"])) for x in rows]
        return [(ROLE_NAMES.get(r, r) if name == "share" else r, text_of(x.get(spec["text"]))) for r, x in zip(roles, rows)]
    found = [(role, "\n\n".join(t for t in (text_of(record.get(f)) for f in fields) if t)) for role, fields in spec["fields"]]
    return [(role, text) for role, text in found if text or role != "system"]


def escape(text: str) -> str:
    """Put one backslash into every ``<|``; one more where backslashes stand there already.  No control string is left."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the code point ranges under the loss: the assistant texts without any marker."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, body = part.partition("\n")
        if not body.endswith(END + "\n"):
            raise ValueError("a turn has no end marker")
        turns.append((unescape_role(role), unescape(body[: -len(END) - 1])))
    return turns


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chosen: dict[str, tuple[str, dict] | None] = {}
    for batch in batches:
        rows: list[tuple] = []
        for raw in batch.column(1).to_pylist():
            try:
                record = json.loads(raw) if raw else None
            except ValueError:
                record = None
            if not isinstance(record, dict):
                rows.append((None, None, "", []))
                continue
            paths = field_paths(record)
            key = fingerprint(paths)
            if key not in chosen:
                chosen[key] = mapping_for(paths)
            name, spec = chosen[key] or (None, None)
            formatted, spans = render(turns_of(record, name, spec)) if spec else ("", [])
            rows.append((key, name, formatted, [{"begin": b, "end": e} for b, e in spans]))
        kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], names=[batch.schema.names[0], "fingerprint", "layout", "formatted", "loss"])


def format_records(records: DataFrame, id_col: str = "conv_id", record_col: str = "record") -> DataFrame:
    """Return (id, fingerprint, layout, formatted, loss ranges), one row per record.

    NULL, invalid JSON and JSON that is no object have no fingerprint, an empty text and no ranges; an unknown layout
    has a fingerprint, but no layout and no text.  Repeated rows stay; other columns are ignored.
    """
    df = records.select(F.col(id_col), F.col(record_col).cast("string").alias("record"))
    schema = T.StructType([df.schema[0], *T.StructType.fromDDL("fingerprint string, layout string, formatted string, loss array<struct<begin: bigint, end: bigint>>").fields])
    return df.mapInArrow(_format, schema)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for formatted, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            turns = parse(formatted)
            loss = "".join(unescape(formatted[s["begin"] : s["end"]]) for s in spans)
            whole = "".join(f"{role}\n{text}\n" for role, text in turns)
            rows.append((len(turns), hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(formatted)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], names=[batch.schema.names[0], "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digests of the turns and of the text under the loss, read from formatted texts."""
    df = formatted.select(F.col(id_col), "formatted", "loss")
    schema = T.StructType([df.schema[0], *T.StructType.fromDDL("n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint").fields])
    return df.mapInArrow(_read, schema)


def records_of(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows by turn as one JSON record per conversation, in the order (turn, role, text); NULL role or text is empty.

    A conversation is one training example, so its turns meet in one row whatever its length.
    """
    rows = turns.select(F.col(id_col), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("content")).alias("row"))
    listed = rows.groupBy(id_col).agg(F.sort_array(F.collect_list("row")).alias("rows"))
    messages = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["content"].alias("content")))
    return listed.select(id_col, F.to_json(F.struct(messages.alias("messages"))).alias("record"))
