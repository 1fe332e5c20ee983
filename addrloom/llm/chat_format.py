"""Chat formatting: typed content parts become text with placeholders, a loss mask and a list of attachments.

A visitor walks the parts of a turn (text, image, audio, document) and flattens them in order: text is escaped, anything
else leaves a numbered placeholder, a reference and the number of tokens that it expands to. Turns are marked by a
template whose control strings cannot occur in escaped text, so that the formatted text can be read back.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from addrloom.llm.common import write_table

LEAF = "kind: string, text: string, ref: string, width: int, height: int, seconds: double"
#: Content of a turn; a document's pages are parts themselves.
PARTS = f"array<struct<{LEAF}, pages: array<struct<{LEAF}>>>>"
#: Code points after which a conversation goes on in another row, at the next turn.
PIECE = 1_000_000
#: Rows handed to Python and back at a time.
ROWS = 1024


@dataclass(frozen=True)
class Template:
    """Control strings: an opening ``[`` or ``<``, then neither of them again.

    ``turns`` has the opening and closing string of a role; any other role is written out between the first two of
    ``other``. A placeholder is ``[KIND:n]``, n its number within the turn.
    """

    turns: dict = field(default_factory=lambda: {"user": ("[INST]", "[/INST]"), "assistant": ("[ANSWER]", "</s>"), "system": ("[SYS]", "[/SYS]")})
    other: tuple = ("[ROLE]", "[SAYS]", "[/ROLE]")
    kinds: tuple = ("image", "audio", "document", "file")
    learned: tuple = ("assistant",)
    patch: int = 14
    per_second: float = 25.0
    per_page: int = 256

    def rests(self) -> str:
        fixed = sorted({s[1:] for pair in (*self.turns.values(), self.other) for s in pair})
        return "|".join([*map(re.escape, fixed), rf"/?(?:{'|'.join(k.upper() for k in self.kinds)}):\d+\]"])

    def control(self) -> re.Pattern:
        return re.compile(rf"[\[<](?:{self.rests()})")


class Escape:
    """Puts a backslash behind the first character of each control string in a text; one more where there are some already."""

    def __init__(self, template: Template):
        self._found = re.compile(rf"([\[<])(\\*)({template.rests()})")
        self._escaped = re.compile(rf"([\[<])\\(\\*)({template.rests()})")

    def escape(self, text: str) -> str:
        return self._found.sub(r"\1\\\2\3", text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(r"\1\2\3", text)


class Flatten:
    """Visitor over the parts of one turn: what they become, spans of text in it, and attachments (number, kind, ref, tokens)."""

    def __init__(self, template: Template, escape: Escape):
        self.template, self.escape = template, escape

    def turn(self, parts: list[dict]) -> tuple[str, list[tuple[int, int]], list[tuple]]:
        self.out, self.size, self.spans, self.attached, self.pending = [], 0, [], [], []
        for p in parts:
            self.visit(p)
        self.flush()
        return "".join(self.out), self.spans, self.attached

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{(part.get('kind') or 'text').lower()}", self.visit_file)(part)

    def visit_text(self, part: dict) -> None:
        self.pending.append(part.get("text") or "")  # texts side by side are one: together they may hold a control string

    def visit_image(self, part: dict) -> None:
        p = self.template.patch
        self.attach("image", part, math.ceil((part.get("width") or 0) / p) * math.ceil((part.get("height") or 0) / p))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, math.ceil((part.get("seconds") or 0) * self.template.per_second))

    def visit_document(self, part: dict) -> None:
        pages = part.get("pages")
        k = self.attach("document", part, self.template.per_page if pages is None else 0)
        for p in pages or ():
            self.visit(p)
        self.flush()
        self.put(f"[/DOCUMENT:{k}]")

    def visit_file(self, part: dict) -> None:
        self.attach("file", part, 0)

    def attach(self, kind: str, part: dict, tokens: int) -> int:
        self.flush()
        k = len(self.attached)
        self.attached.append((k, kind, part.get("ref"), tokens))
        self.put(f"[{kind.upper()}:{k}]")
        return k

    def flush(self) -> None:
        if self.pending:
            text = self.escape.escape("".join(self.pending))
            self.spans.append((self.size, self.size + len(text)))
            self.pending = []
            self.put(text)

    def put(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)


_ATTACHED = pa.list_(pa.struct([("turn", pa.int64()), ("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
_SPANS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
_FORMATTED = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("whole", pa.bool_()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", _SPANS), ("attachments", _ATTACHED)])
FORMATTED = "conv_id bigint, piece bigint, whole boolean, n_turns bigint, formatted string, loss array<struct<lo: int, hi: int>>, attachments array<struct<turn: bigint, number: int, kind: string, ref: string, tokens: bigint>>"


class _Piece:
    """A row of the output while it grows."""

    def __init__(self):
        self.turns, self.out, self.size, self.loss, self.attached = 0, [], 0, [], []

    def add(self, turn: int | None, role: str, parts: list[dict], flatten: Flatten, template: Template) -> None:
        body, spans, attached = flatten.turn(parts)
        opened, closed = template.turns.get(role) or (template.other[0] + flatten.escape.escape(role) + template.other[1], template.other[2])
        self.out += [opened, body, closed]
        at = self.size + len(opened)
        if role in template.learned:
            self.loss += [{"lo": at + lo, "hi": at + hi} for lo, hi in spans]
        self.attached += [dict(zip(("turn", "number", "kind", "ref", "tokens"), (turn, *a))) for a in attached]
        self.size = at + len(body) + len(closed)
        self.turns += 1


def _formatter(template: Template, limit: int):
    """A task's turns, sorted, to rows of the output. A conversation is whole if all of it is in one row and neither the task's first nor its last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flatten = Flatten(template, Escape(template))
        done, held, piece, number, split, conv, first = [], 0, None, 0, False, None, True

        def end(whole: bool) -> None:
            nonlocal piece, number, held
            done.append((conv, number, whole, piece.turns, "".join(piece.out), piece.loss, piece.attached))
            held += piece.size
            number, piece = number + 1, None

        def emit() -> pa.RecordBatch:
            nonlocal done, held
            cols = zip(*done)
            done, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FORMATTED)], schema=_FORMATTED)

        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                for r in b.slice(lo, ROWS).to_pylist():
                    if piece is not None and r["conv_id"] != conv:
                        end(whole=not first and not split)
                        first, split = False, False
                    elif piece is not None and piece.size >= limit:
                        end(whole=False)
                        split = True
                    if held >= limit or len(done) >= ROWS:
                        yield emit()
                    conv = r["conv_id"]
                    piece = piece or _Piece()
                    piece.add(r["turn"], r["role"] or "", r["parts"] or [], flatten, template)
        if piece is not None:
            end(whole=False)
        if done:
            yield emit()

    return run


def format_chats(turns: DataFrame, template: Template = Template(), piece: int = PIECE) -> DataFrame:
    """Formats ``turns`` (conv_id, turn, role, parts of type PARTS) and writes the result; other columns are ignored.

    A row for each conversation, or for each ``piece`` of code points of a long one: ``formatted`` text, ``loss`` (spans
    of code points of it that are learned: texts of the template's learned roles), ``attachments`` in order with their
    expanded tokens, and ``part`` and ``piece``, by which the rows of a conversation are in order.

    Turns go by turn, null first, then role, then a hash of their parts; repeated rows are repeated turns. A null
    conv_id is a conversation; a null role is the empty one; null parts and texts are empty. A part without a
    kind is text, one of an unknown kind a file.

    Turns are dealt out by ranges of (conv_id, turn), so a conversation of any length is formatted by many tasks.
    """
    rows = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.coalesce("role", F.lit("")).alias("role"), "parts")
    rows = rows.withColumn("h", F.xxhash64("parts"))
    order = ["conv_id", "turn", "role", "h"]
    made = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("h").mapInArrow(_formatter(template, piece), FORMATTED)
    return write_table(made.withColumn("part", F.spark_partition_id()), "chats")


def parse(formatted: str, template: Template, escape: Escape) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted text; text is that of its text parts, without placeholders."""
    roles = {opened: (role, closed) for role, (opened, closed) in template.turns.items()}
    pieces = re.split(rf"({template.control().pattern})", formatted)  # text and control strings in turn
    role, close, texts = None, None, []
    for text, mark in zip(pieces[::2], [*pieces[1::2], ""]):
        if close:
            texts.append(text)
        if mark == template.other[0]:
            close, texts = template.other[1], []
        elif close == template.other[1] and mark == close:
            role, close, texts = escape.unescape("".join(texts)), template.other[2], []
        elif mark in roles and not close:
            (role, close), texts = roles[mark], []
        elif mark and mark == close:
            yield role, "".join(map(escape.unescape, texts))
            close = None


RESULT = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_attachments bigint, expanded_tokens bigint"


def _reader(template: Template):
    """Rows of the output, those of a conversation one after the other, to a row for each conversation."""
    names = [f.split()[0] for f in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escape, state, conv, done = Escape(template), None, None, []

        def close() -> None:
            n, turns, chars, loss, size, attached, tokens = state
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, attached, tokens))

        def emit() -> pa.RecordBatch:
            cols = list(zip(*done))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k in (2, 4) else pa.int64()) for k, c in enumerate(cols)], names=names)

        for b in batches:
            for k in range(b.num_rows):
                r = {c: b.column(c)[k].as_py() for c in ("conv_id", "formatted", "loss", "attachments")}
                if state is not None and r["conv_id"] != conv:
                    close()
                    state = None
                conv = r["conv_id"]
                state = state or [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, text in parse(r["formatted"], template, escape):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for s in r["loss"]:
                    text = escape.unescape(r["formatted"][s["lo"] : s["hi"]])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(r["formatted"])
                state[5] += len(r["attachments"])
                state[6] += sum(a["tokens"] for a in r["attachments"])
                if len(done) >= ROWS:
                    yield emit()
        if state is not None:
            close()
        if done:
            yield emit()

    return run


def read_chats(written: DataFrame, template: Template = Template()) -> DataFrame:
    """A row for each conversation of format_chats' output: turns and learned text read back from it, as digests.

    Whole conversations are read where they lie. Only the rows of others (long ones, and two at the edges of each
    task) are brought together by conversation; they stream through a task in order, since SHA-256 is sequential.
    """
    cols = ["conv_id", "formatted", "loss", "attachments"]
    rest = written.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    run = _reader(template)
    return written.where("whole").select(*cols).mapInArrow(run, RESULT).union(rest.select(*cols).mapInArrow(run, RESULT))


def text_part(text: Column) -> Column:
    """Parts of a turn that is one text."""
    part = F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *[F.lit(None).alias(c) for c in ("ref", "width", "height", "seconds", "pages")])
    return F.array(part).cast(PARTS)


def op11_chat_format(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """Formats every conversation, and one more (-1) whose texts hold control strings, and reads the written output back.

    Null texts and roles are empty, null turns come first, repeated rows are repeated turns; the rows with a null
    conv_id are one conversation; an empty table gives conversation -1 alone; other columns are ignored.
    """
    says = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], "conv_id bigint, turn bigint, role string, text string")
    turns = conversations.select(*[F.col(c).cast(t).alias(c) for c, t in more.dtypes]).union(more)
    return read_chats(format_chats(turns.select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))))
