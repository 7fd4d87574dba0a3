"""Chat records of any known layout as canonical turns, and turns as one formatted text."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factdrift.llm.common import map_batches
from factdrift.staging import stage

# The template's control strings.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


# What has a meaning in a path; in a field's name it is escaped.
_SIGNS = re.compile(r"[\\.\[\](){};\n]")


def field_paths(record: object, prefix: str = "") -> set[str]:
    """Nested field paths of a record.

    Items of a list with the same paths share one, which names them all: a list of half
    messages is not one of whole messages.
    """
    if isinstance(record, dict):
        names = ((_SIGNS.sub(r"\\\g<0>", key), value) for key, value in record.items())
        return {p for name, value in names for p in field_paths(value, f"{prefix}.{name}")} or {prefix + ".{}"}
    if isinstance(record, list):
        return {_item_path(prefix, field_paths(value)) for value in record} or {prefix + "[]"}
    return {prefix}


def _item_path(prefix: str, paths: set[str]) -> str:
    return f"{prefix}[]({';'.join(sorted(paths))})"


def fingerprint(paths: set[str]) -> int:
    """A hash of the paths, in no particular order and whatever the values are."""
    return xxhash.xxh64_intdigest("\n".join(sorted(paths)))


@dataclass(frozen=True)
class Layout:
    """A declarative mapping. ``items``: the list of messages, each with ``role`` and ``text``
    fields; without it, ``fields`` lists (field, role) in the order of turns. ``optional``
    fields may lack, and one that is empty or null makes no turn; other fields than those
    named may not be there."""

    items: str | None = None
    role: str | None = None
    text: str | None = None
    fields: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict)

    def paths(self) -> list[set[str]]:
        """The sets of field paths that this layout covers."""
        if self.items:
            return [{_item_path(f".{self.items}", {f".{self.role}", f".{self.text}"})}, {f".{self.items}[]"}]
        if self.role:
            return [{f".{self.role}", f".{self.text}"}]
        sets = [{f".{name}" for name, _ in self.fields if name not in self.optional}]
        for name in self.optional:
            sets += [x | {f".{name}"} for x in sets]
        return sets

    def turns(self, record: dict) -> list[tuple[str, str]]:
        if self.items:
            found = [(x[self.role], x[self.text]) for x in record[self.items]]
        elif self.role:
            found = [(record[self.role], record[self.text])]
        else:
            found = [(role, record[name]) for name, role in self.fields if name not in self.optional or record.get(name)]
        return [(self.roles.get(_plain(role), _plain(role)), _plain(text)) for role, text in found]


def _plain(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


# Layouts that public chat sets use.
LAYOUTS = (
    Layout(role="role", text="text"),
    Layout(role="role", text="content"),
    Layout(items="messages", role="role", text="content"),
    Layout(items="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
    Layout(fields=(("system", "system"), ("prompt", "user"), ("response", "assistant")), optional=("system",)),
    Layout(fields=(("prompt", "user"), ("completion", "assistant"))),
    Layout(fields=(("instruction", "user"), ("input", "user"), ("output", "assistant")), optional=("input",)),
    Layout(fields=(("question", "user"), ("answer", "assistant"))),
)


def registry(layouts: tuple[Layout, ...] = LAYOUTS) -> dict[int, Layout]:
    return {fingerprint(paths): layout for layout in reversed(layouts) for paths in layout.paths()}


def canonical_turns(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """conv_id, position, k, role, text of ``records`` (conv_id, position, record as JSON).

    A record's fingerprint picks its mapping. ``k`` numbers the turns within the record. A
    null text or role is empty. A record that is null, no JSON, or of a layout without a
    mapping gives one row with role null, its fingerprint (null if none) in ``unmapped``
    and the record as text, so that nothing is lost unseen; mapped rows have null there and
    a role. So it is with a record nested too deep to read or with half a surrogate pair.
    Repeated rows stay, an empty table gives none, further columns are ignored.
    """
    plain = records.select(F.col("conv_id").cast("long"), F.col("position").cast("long"), F.col("record").cast("string"))
    known = registry(layouts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, position, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                code, turns = _mapped(raw, known)
                if turns is not None:
                    rows += [(conv, position, k, *turn, None) for k, turn in enumerate(turns)]
                else:
                    rows.append((conv, position, 0, None, raw, None if code is None else f"{code:016x}"))
            yield _batch(rows, ["conv_id", "position", "k", "role", "text", "unmapped"], "lllsss")

    return map_batches(plain, run, "conv_id long, position long, k long, role string, text string, unmapped string")


def _mapped(raw: str | None, known: dict[int, Layout]) -> tuple[int | None, list[tuple[str, str]] | None]:
    """A record's fingerprint, and its turns if it has a mapping."""
    code = None
    try:
        record = json.loads(raw) if raw is not None else None
        if isinstance(record, dict):
            code = fingerprint(field_paths(record))
        if code not in known:
            return code, None
        turns = known[code].turns(record)
        # Half a surrogate pair, which JSON can escape, is no text.
        for turn in turns:
            "".join(turn).encode()
        return code, turns
    except (ValueError, RecursionError):
        return code, None


def _batch(rows: list[tuple], names: list[str], kinds: str) -> pa.RecordBatch:
    arrow = {"l": pa.int64(), "s": pa.string(), "b": pa.binary()}
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, arrow[k]) for c, k in zip(columns, kinds, strict=True)], names)


def escaped(text: Column) -> Column:
    """``text`` without control strings: a backslash is doubled, ``<|`` becomes ``<\\|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


_ESCAPE = re.compile(r"\\(.)", re.DOTALL)


def unescaped(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def format_turns(turns: DataFrame) -> DataFrame:
    """Adds ``formatted`` to ``turns``, and where in it the loss counts (loss_start, loss_end).

    The formatted conversation is its turns' texts joined in order; each is made from its
    row alone. The loss counts over an assistant's text and nothing else: the mask is null
    for other roles. A row without a role, which is a record without a mapping, is no turn:
    its ``formatted`` is null. A null text is empty; further columns are kept.
    """
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT))
    body = escaped(F.coalesce("text", F.lit("")))
    spoken = F.col("role") == "assistant"
    return turns.withColumns(
        {
            "formatted": F.concat(head, body, F.lit(END)),
            "loss_start": F.when(spoken, F.char_length(head)),
            "loss_end": F.when(spoken, F.char_length(head) + F.char_length(body)),
        }
    )


class _Digest:
    """What is read back from formatted turns, in order."""

    def __init__(self, conv: int | None):
        self.conv, self.n, self.chars, self.loss_chars = conv, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int | None, end: int | None) -> None:
        for turn in filter(None, formatted.split(END)):
            role, text = turn.removeprefix(TURN).split(TEXT)
            self.turns.update(f"{unescaped(role)}\n{unescaped(text)}\n".encode())
            self.n += 1
        self.chars += len(formatted)
        if start is not None:
            said = unescaped(formatted[start:end])
            self.loss.update(said.encode())
            self.loss_chars += len(said)

    def row(self) -> tuple:
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """One row for each conv_id of formatted turns, in the order of position and k.

    Rows are dealt by ranges of (conv_id, position), so a long conversation spreads over
    many tasks; each task streams through its sorted rows. The first and last conversation
    of a task may go on in others: their turns are packed and meet in a second step, where
    the digest, sequential by nature, is fed block by block. Ties in position and k are
    ordered by role and text; a null conv_id is a conversation, a null position comes first.
    Rows whose ``formatted`` is null are no turns, and a conversation of such rows alone has
    no row. Repeated rows are turns each, an empty table gives no rows.
    """
    formatted = formatted.where("formatted is not null")
    order = ["conv_id", "position", "k", "formatted"]
    sorted_rows = (
        formatted.select(*order, "loss_start", "loss_end").repartitionByRange(*order).sortWithinPartitions(*order)
    )
    staged = stage(
        map_batches(
            sorted_rows.withColumn("part", F.spark_partition_id().cast("long")),
            _digest_partition,
            DIGESTS + ", part long, packed binary",
        ),
        "conversations",
    ).frame
    whole = staged.where("packed is null").drop("part", "packed")
    cut = staged.where("packed is not null").groupBy("conv_id").applyInPandas(lambda parts: _digest_parts(parts), DIGESTS)
    return whole.unionByName(cut)


_NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "part", "packed"]


def _digest_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the inner conversations, packed turns of the first and the last."""
    digest, inner, part = None, False, None  # inner: a conversation has ended before
    pack, packed = None, b""

    def opened() -> pa.RecordBatch:
        return _batch([(digest.conv, 0, "", 0, "", 0, part, packed + pack.flush())], _NAMES, "llslsllb")

    for batch in batches:
        rows = []
        columns = [batch.column(i).to_pylist() for i in (0, 3, 4, 5, 6)]
        for conv, text, start, end, part in zip(*columns, strict=True):
            if digest is None or conv != digest.conv:
                if digest is not None:
                    if inner:
                        rows.append((*digest.row(), None, None))
                    else:
                        yield opened()
                    inner = True
                digest, pack, packed = _Digest(conv), zlib.compressobj(), b""
            digest.add(text, start, end)
            packed += pack.compress(json.dumps([text, start, end]).encode() + b"\n")
        yield _batch(rows, _NAMES, "llslsllb")
    if digest is not None:
        yield opened()


def _digest_parts(parts: pd.DataFrame) -> pd.DataFrame:
    conv = parts["conv_id"].iloc[0]
    digest = _Digest(None if pd.isna(conv) else int(conv))
    for packed in parts.sort_values("part")["packed"]:
        for line in _lines(packed):
            digest.add(*json.loads(line))
    frame = pd.DataFrame([digest.row()], columns=_NAMES[:6])
    return frame.astype({"conv_id": "Int64"})


def _lines(packed: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    unpack, rest = zlib.decompressobj(), b""
    for at in range(0, len(packed), step):
        *lines, rest = (rest + unpack.decompress(packed[at : at + step])).split(b"\n")
        yield from lines


def as_records(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as records of the layout with one turn each."""
    record = F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"})
    return rows.select("conv_id", F.col("turn").alias("position"), record.alias("record"))
