"""Chat formatting by schema fingerprints.

Records come as JSON in any of several layouts (a prompt with its completion,
an instruction with its input and output, lists of messages under various
names). A record's fingerprint is a hash of its nested field paths; it selects
a declarative mapping, and the mapping turns the record into canonical turns
(role, text). The turns are rendered with a template that marks where each
begins and ends; control strings that occur inside a text or role are escaped
so that they can be read back, and the spans of the assistant's texts are given
as the loss mask.

Edge cases: null texts and roles are empty; a record without turns gives an
empty string; unknown fingerprints give no turns and ``layout`` null (never a
guess), and neither does what is no JSON object or is nested too deep to read.
Messages in parts (a list of texts with types) are joined line by line; a value
that is no text (a number, true) is taken as its JSON; halves of surrogate pairs
are replaced. Repeated records are formatted each; other columns are kept.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, BREAK, END = "<|im_start|>", "\n", "<|im_end|>\n"
#: What no text may hold as it is: the template's own marks and those of other common templates.
CONTROL = re.compile(r"([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|</?SYS>>)")
ESCAPED = re.compile(r"([<\[])\\(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|</?SYS>>)")


def escape(text: str) -> str:
    """Control strings get a backslash after their first character, escaped ones one more."""
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    """A role fits in a line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass(frozen=True)
class Layout:
    """How to read turns from records with certain paths.

    Either ``turns`` names a list of messages with ``role`` and ``text`` fields
    (and ``order`` a field to sort them by), or ``parts`` lists (role, field,
    ...) whose non-empty fields make one turn, joined by blank lines.
    """

    name: str
    paths: tuple[str, ...]
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    order: str | None = None
    parts: tuple[tuple[str, ...], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)


SHARE_ROLES = {"human": "user", "gpt": "assistant", "chatgpt": "assistant", "bing": "assistant"}
LAYOUTS = (
    Layout("turns", ("turns[].role", "turns[].text", "turns[].turn"), "turns", "role", "text", "turn"),
    Layout("messages", ("messages[].content", "messages[].role"), "messages"),
    Layout("message_parts", ("messages[].content[].text", "messages[].content[].type", "messages[].role"), "messages"),
    Layout("mixed_parts", ("messages[].content", "messages[].content[].text", "messages[].content[].type", "messages[].role"), "messages"),
    Layout("shared", ("conversations[].from", "conversations[].value"), "conversations", "from", "value", roles=SHARE_ROLES),
    Layout("completion", ("completion", "prompt"), parts=(("user", "prompt"), ("assistant", "completion"))),
    Layout("response", ("prompt", "response"), parts=(("user", "prompt"), ("assistant", "response"))),
    Layout("question", ("answer", "question"), parts=(("user", "question"), ("assistant", "answer"))),
    Layout("instruction", ("instruction", "output"), parts=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", ("input", "instruction", "output"), parts=(("user", "instruction", "input"), ("assistant", "output"))),
    Layout("system_prompt", ("prompt", "response", "system"), parts=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
)


def paths_of(value, prefix: str = "") -> set[str]:
    """Nested field paths; list levels are marked by ``[]``, empty lists have only that."""
    if isinstance(value, dict):
        return set().union(*(paths_of(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(paths_of(v, f"{prefix}[]") for v in value)) if value else {f"{prefix}[]"}
    return {prefix}


def filled(paths) -> set[str]:
    """Paths with each empty list as what its path stands for elsewhere, or else as a plain value."""
    empty = {p for p in paths if p.endswith("[]")}
    full = set(paths) - empty
    return full | {p.removesuffix("[]") for p in empty if not any(x.startswith(f"{p}.") for x in full)}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def registry(layouts=LAYOUTS) -> dict[str, Layout]:
    """Layouts by fingerprint. A list of messages may be empty."""
    known = {fingerprint(x.paths): x for x in layouts}
    return {fingerprint({f"{x.turns}[]"}): x for x in reversed(layouts) if x.turns} | known


def text_in(value) -> str:
    """A value of a record as text."""
    if value is None:
        return ""
    if isinstance(value, list):
        return "\n".join(text_in(x.get("text") if isinstance(x, dict) else x) for x in value)
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    try:
        text.encode()
    except UnicodeEncodeError:  # halves of surrogate pairs
        text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


def turns_of(record: dict, layout: Layout) -> list[tuple[str, str]]:
    """Canonical turns of a record."""
    if layout.turns is None:
        made = [(role, "\n\n".join(t for f in fields if (t := text_in(record[f])))) for role, *fields in layout.parts]
        return [(role, text) for role, text in made if text or role != "system"]
    found = [(x.get(layout.order) if layout.order else None, text_in(x.get(layout.role)), text_in(x.get(layout.text))) for x in record[layout.turns]]
    if layout.order:
        number = lambda x: isinstance(x, int | float)
        found.sort(key=lambda x: (x[0] is not None, not number(x[0]), x[0] if number(x[0]) else 0, text_in(x[0]), x[1], x[2]))
    return [(layout.roles.get(role, role), text) for _, role, text in found]


def layout_of(record, known: dict[str, Layout], cache: dict) -> Layout | None:
    """The layout of a parsed record, by the fingerprint of its paths."""
    if not isinstance(record, dict):
        return None
    paths = frozenset(paths_of(record))
    if paths not in cache:
        cache[paths] = known.get(fingerprint(paths)) or known.get(fingerprint(filled(paths)))
    layout = cache[paths]
    if layout and layout.turns and not all(isinstance(x, dict) for x in record[layout.turns]):
        return None
    return layout


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and where the assistant's texts are in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = START + escape_role(role) + BREAK, escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that ``render`` made ``formatted`` from."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, text = part.partition(BREAK)
        turns.append((unescape_role(role), unescape(text.removesuffix(END))))
    return turns


def format_chats(records: DataFrame, column: str = "record", layouts=LAYOUTS) -> DataFrame:
    """``records`` with ``layout``, ``formatted`` and ``loss_spans`` in place of the JSON in ``column``.

    ``column`` is parsed once; fields that no layout knows change the
    fingerprint, so pass only the conversation's own fields. Columns of these
    names that ``records`` already has are replaced.
    """
    made_here = ("layout", "formatted", "loss_spans")
    records = records.select(column, *[f"`{f.name}`" for f in records.schema if f.name != column and f.name.lower() not in made_here])

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known, cache = registry(layouts), {}
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            names, formatted, masks = [], [], []
            for x in batch.column(column):
                try:
                    record = json.loads(x.as_py() or "{}")
                    layout = layout_of(record, known, cache)
                except (ValueError, RecursionError):
                    record, layout = {}, None
                made, spans = render(turns_of(record, layout)) if layout else ("", [])
                names.append(layout and layout.name)
                formatted.append(made)
                masks.append([{"start": s, "end": e} for s, e in spans])
            rest = batch.drop_columns([column])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(names, pa.string()), pa.array(formatted, pa.string()), pa.array(masks, spans_type)],
                [*rest.schema.names, "layout", "formatted", "loss_spans"],
            )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema if f.name != column)
    kept += ", " if kept else ""
    return records.mapInArrow(rows, f"{kept}layout string, formatted string, loss_spans array<struct<start:bigint,end:bigint>>")


def records_of_turns(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", mixed: bool = False) -> DataFrame:
    """``key, record``: one JSON record per conversation from a table with a row per turn.

    ``mixed`` writes each conversation in the plainest layout that can hold it:
    a question with its answer as prompt and completion, a talk between the two
    as a list of shared messages, the rest as turns.
    """
    one = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    listed = turns.groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    as_json = lambda x: F.to_json(x, {"ignoreNullFields": "false"})
    record = as_json(F.struct("turns"))
    if mixed:
        user, answer = F.get("turns", 0), F.get("turns", 1)
        pair = (F.size("turns") == 2) & (user["role"] == "user") & (answer["role"] == "assistant") & (user["text"] != "") & (answer["text"] != "")
        shared = F.transform("turns", lambda x: F.struct(F.when(x["role"] == "user", "human").otherwise("gpt").alias("from"), x["text"].alias("value")))
        talk = F.forall("turns", lambda x: F.coalesce(x["role"].isin("user", "assistant"), F.lit(False)))
        record = (
            F.when(F.coalesce(pair, F.lit(False)), as_json(F.struct(user["text"].alias("prompt"), answer["text"].alias("completion"))))
            .when(talk, as_json(F.struct(shared.alias("conversations"))))
            .otherwise(record)
        )
    return listed.select(key, record.alias("record"))


def digests(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """What reading the formatted conversations back gives, as counts and digests."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n, turns_sha, loss_n, loss_sha, chars = [], [], [], [], []
            for made, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
                turns = parse(made)
                loss = "".join(unescape(made[s["start"] : s["end"]]) for s in spans)
                n.append(len(turns))
                turns_sha.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                loss_n.append(len(loss))
                loss_sha.append(hashlib.sha256(loss.encode()).hexdigest())
                chars.append(len(made))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(n, pa.int64()), pa.array(turns_sha, pa.string()), pa.array(loss_n, pa.int64()), pa.array(loss_sha, pa.string()), pa.array(chars, pa.int64())],
                ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    kind = formatted.schema[key].dataType.simpleString()
    return (
        formatted.select(F.col(key).alias("key"), "formatted", "loss_spans")
        .mapInArrow(rows, f"key {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
        .withColumnRenamed("key", key)
    )
