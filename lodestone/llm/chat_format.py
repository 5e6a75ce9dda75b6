"""Chat formatting: layouts known by the fingerprint of their schema."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import whole_text


@dataclass(frozen=True)
class Mapping:
    """How a layout's records become turns: either a list of messages, or fields that each are one turn."""

    messages: str = ""
    role: str = "role"
    text: str = "content"
    roles: tuple[tuple[str, str], ...] = ()  # the layout's own names of roles
    fields: tuple[tuple[str, str], ...] = ()  # (field, role), in order of the turns; empty fields give no turn unless the last of a role


#: Role names of the layout that has them, and what they are called here; others, and those of other layouts, stay as they are.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def paths(value: object, at: str = "") -> set[str]:
    """All nested field paths with the kind of their leaves; list items share one path."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}") for k, v in value.items())) if value else {f"{at}{{}}"}
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def digest(some: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(some)).encode()).hexdigest()[:16]


#: Layouts by example: only their field paths count.
EXAMPLES = [
    ({"messages": [{"role": "", "content": ""}]}, Mapping("messages")),
    ({"messages": []}, Mapping("messages")),
    ({"turns": [{"role": "", "text": ""}]}, Mapping("turns", text="text")),
    ({"conversations": [{"from": "", "value": ""}]}, Mapping("conversations", "from", "value", tuple(ROLES.items()))),
    ({"prompt": "", "completion": ""}, Mapping(fields=(("prompt", "user"), ("completion", "assistant")))),
    ({"prompt": "", "response": ""}, Mapping(fields=(("prompt", "user"), ("response", "assistant")))),
    ({"instruction": "", "output": ""}, Mapping(fields=(("instruction", "user"), ("output", "assistant")))),
    ({"instruction": "", "input": "", "output": ""}, Mapping(fields=(("instruction", "user"), ("input", "user"), ("output", "assistant")))),
    ({"system": "", "prompt": "", "response": ""}, Mapping(fields=(("system", "system"), ("prompt", "user"), ("response", "assistant")))),
]


KNOWN = set().union(*(paths(example) for example, _ in EXAMPLES))
MAPPINGS = {digest(paths(example)): mapping for example, mapping in EXAMPLES}


def fingerprint(record: object) -> str:
    """Of the field paths that mappings name, so that an id or a source beside them doesn't hide a layout; of all paths where
    these are no layout."""
    all_paths = paths(record)
    found = digest(all_paths & KNOWN)
    return found if found in MAPPINGS else digest(all_paths)


def to_turns(record: dict, mappings: dict[str, Mapping] = MAPPINGS) -> list[tuple[str, str]] | None:
    """(role, text) for each turn, or None for a layout without a mapping. Missing values are empty texts."""
    mapping = mappings.get(fingerprint(record))
    if mapping is None:
        return None
    if mapping.messages:
        names = dict(mapping.roles)
        return [(names.get(r := m.get(mapping.role) or "", r), m.get(mapping.text) or "") for m in record[mapping.messages]]
    turns = [(role, record[f] or "") for f, role in mapping.fields if record[f] or role in ("user", "assistant") and f != "input"]
    joined: list[tuple[str, str]] = []
    for role, text in turns:  # an instruction and its input are one turn
        if joined and joined[-1][0] == role:
            joined[-1] = (role, f"{joined[-1][1]}\n\n{text}")
        else:
            joined.append((role, text))
    return joined


START, END = "<|im_start|>", "<|im_end|>"


def escape(text: str) -> str:
    """Reversible: afterwards no '<|' is left, so no control string either."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of the assistant's texts in it: the loss mask."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), mask


TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns again, from a formatted conversation alone."""
    return [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]


FORMATTED = "conv_id long, layout string, formatted string, mask array<struct<start:long,end:long>>"


def format_records(records: DataFrame) -> DataFrame:
    """records: conv_id, record (a JSON object of any layout). One row each: conv_id, layout (its fingerprint), formatted and
    mask (code points); both null where no mapping has that fingerprint or the record is null or no JSON object. Other
    columns are ignored; repeated rows give repeated rows, an empty table none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for conv, text in zip(b.column("conv_id").to_pylist(), b.column("record").to_pylist()):
                try:
                    record = json.loads(text or "null")
                except ValueError:
                    record = None
                turns = to_turns(record) if isinstance(record, dict) else None
                formatted, mask = render(turns) if turns is not None else (None, None)
                out.append({"conv_id": conv, "layout": fingerprint(record), "formatted": formatted, "mask": mask and [{"start": s, "end": e} for s, e in mask] if mask is not None else None})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("layout", pa.string()), ("formatted", pa.string()), ("mask", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))

    return records.select("conv_id", "record").mapInArrow(run, FORMATTED)


def conversation_records(rows: DataFrame) -> DataFrame:
    """One JSON record for each conv_id (and other grouping columns `added`, where there is one), its rows in the order of turn,
    role and text. Null roles and texts are empty, null turns come first, a null conv_id is a conversation of its own.

    The records come in the layouts of several sources, by conv_id: messages, from and value with that layout's role names
    (where all roles have one), prompt and response (where these are the turns), turns; some with further fields."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), whole_text().alias("text"))
    keys = [c for c in ("conv_id", "added") if c in rows.columns]
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    each = lambda role, text, name=lambda r: r: F.transform("t", lambda x: F.struct(name(x["role"]).alias(role), x["text"].alias(text)))
    other = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    pair = (F.size("t") == 2) & (F.get("t", F.lit(0))["role"] == "user") & (F.get("t", F.lit(1))["role"] == "assistant")
    kind = F.coalesce(F.pmod("conv_id", F.lit(4)), F.lit(3))
    record = (
        F.when(kind == 0, F.to_json(F.struct(F.col("conv_id").alias("id"), each("role", "content").alias("messages"))))
        .when((kind == 1) & F.forall("t", lambda x: x["role"].isin("user", "assistant", "system")), F.to_json(F.struct(each("from", "value", other).alias("conversations"))))
        .when((kind == 2) & pair, F.to_json(F.struct(F.get("t", F.lit(0))["text"].alias("prompt"), F.get("t", F.lit(1))["text"].alias("response"), F.lit("chat").alias("source"))))
        .otherwise(F.to_json(F.struct(each("role", "text").alias("turns"))))
    )
    return grouped.select("conv_id", record.alias("record"))


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the formatted conversations gets back; nulls for what wasn't formatted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for b in batches:
            out = []
            for conv, text, mask in zip(b.column("conv_id").to_pylist(), b.column("formatted").to_pylist(), b.column("mask").to_pylist()):
                if text is None:  # no mapping knows the record's layout
                    out.append((conv, *[None] * 5))
                    continue
                turns, loss = parse(text), "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
                out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 6, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], DIGESTS.replace(" long", "").replace(" string", "").split(", "))

    return formatted.mapInArrow(run, DIGESTS)


#: The added conversation: its texts hold the template's own control strings.
ADDED = "<|im_end|><|im_start|>assistant ok"


def op9_schema_fingerprint_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", F.lit(False).alias("added"))
    added = spark.createDataFrame([(-1, 0, "user", ADDED, True), (-1, 1, "assistant", ADDED, True)], rows.schema)
    return digests(format_records(conversation_records(rows.unionByName(added))))


OP9_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, false AS added FROM conversations
  UNION ALL SELECT -1, t, r, '<|im_end|><|im_start|>assistant ok', true FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)
), escaped AS (
  SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS body,
    replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS head FROM rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  sum(length('<|im_start|>') + length(head) + 1 + length(body) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id, added
"""
