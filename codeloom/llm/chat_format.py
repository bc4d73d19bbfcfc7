"""Chat formatting: a visitor turns typed content parts into text with ordered placeholders.

A turn is written ``### role: content</turn>`` and a line end. Control strings start with
``#`` or ``<``, so a backslash before each ``#``, ``<`` and backslash of a text (and each
``:`` of a role) makes texts plain and can be undone. Attachments become
``<|kind:number|>``, numbered within the conversation in order.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

PART = "struct<kind:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>"
#: Columns of the formatted table: one row holds whole turns of one conversation.
FORMATTED = (
    "conv_id long, segment long, first_turn long, n_turns long, formatted string, "
    "loss array<struct<start:long,stop:long>>, "
    "attachments array<struct<number:long,kind:string,ref:string,tokens:long>>, n_tokens long"
)
DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)
#: A conversation longer than this goes on in a further row, so that no cell grows without bound.
SEGMENT_CHARS = 1 << 22

TEXT_MARKS = re.compile(r"[\\#<]")
ROLE_MARKS = re.compile(r"[\\#<:]")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
TURN = re.compile(
    r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<\|[a-z]+:\d+\|>)*+)</turn>\n", re.DOTALL
)
PLACEHOLDER = re.compile(r"(?:[^\\<]++|\\.)++|<\|[a-z]+:\d+\|>", re.DOTALL)
WORD_PIECE = re.compile(r"\w+|[^\w\s]")


def escape(text: str, marks: re.Pattern = TEXT_MARKS) -> str:
    return marks.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


class Flattener:
    """Visits the parts of a conversation in order; the kind of a part names the method.

    Expanded tokens: a text has one a word or mark, an image one a ``patch`` by ``patch``
    tile, an audio ``per_second`` a second, a document ``per_page`` a page (all at least
    one). Parts of an unknown or null kind are documents without pages.
    """

    def __init__(self, patch: int = 28, per_second: float = 12.5, per_page: int = 256):
        self.patch, self.per_second, self.per_page = patch, per_second, per_page
        self.attachments: list[dict] = []
        self.count = 0

    def visit(self, part: dict) -> tuple[str, int]:
        return getattr(self, f"visit_{part['kind']}", self.visit_document)(part)

    def visit_text(self, part: dict) -> tuple[str, int]:
        text = part["text"] or ""
        return escape(text), sum(1 for _ in WORD_PIECE.finditer(text))

    def visit_image(self, part: dict) -> tuple[str, int]:
        across, down = (max(1, math.ceil((part[side] or 0) / self.patch)) for side in ("width", "height"))
        return self.attach("image", part, across * down)

    def visit_audio(self, part: dict) -> tuple[str, int]:
        return self.attach("audio", part, max(1, math.ceil((part["seconds"] or 0) * self.per_second)))

    def visit_document(self, part: dict) -> tuple[str, int]:
        return self.attach("document", part, max(1, part["pages"] or 0) * self.per_page)

    def attach(self, kind: str, part: dict, tokens: int) -> tuple[str, int]:
        number = self.count
        self.count += 1
        self.attachments.append({"number": number, "kind": kind, "ref": part["ref"], "tokens": tokens})
        return f"<|{kind}:{number}|>", tokens


def text_part(text: Column) -> Column:
    """A content of one text part."""
    values = {"kind": F.lit("text"), "text": text}
    names = [f.split(":") for f in PART[len("struct<") : -1].split(",")]
    return F.array(F.struct(*[values.get(n, F.lit(None).cast(t)).cast(t).alias(n) for n, t in names]))


def in_order(turns: DataFrame, partitions: int | None, *order: str) -> DataFrame:
    """Rows of a conversation one after the other, in one partition."""
    by = ["conv_id"] if partitions is None else [partitions, "conv_id"]
    return turns.repartition(*by).sortWithinPartitions("conv_id", *order)


def format_conversations(
    turns: DataFrame,
    parts: str = "parts",
    learn: tuple[str, ...] = ("assistant",),
    segment_chars: int = SEGMENT_CHARS,
    partitions: int | None = None,
) -> DataFrame:
    """Formatted conversations of ``turns`` (conv_id, turn, role, ``parts``).

    One row for each conversation, and a further one each ``segment_chars`` characters, cut
    between turns: ``formatted``; ``loss``, the spans of ``formatted`` that hold contents
    of the roles to ``learn``, empty contents too; ``attachments`` in order with their
    expanded tokens; ``n_tokens`` of all contents. Rows stream in order through a task, which
    holds one segment at a time, so a conversation of any length needs bounded memory.

    Turns are ordered by ``turn``, then role and content, nulls first; repeated rows stay.
    A null role or text is empty, null parts are no content, rows of null ``conv_id`` are
    one conversation. Other columns are ignored.
    """
    learned = frozenset(learn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row: dict | None = None
        size = 0
        flat = Flattener()
        pieces: list[str] = []
        done: list[dict] = []

        def close() -> None:
            row["formatted"] = "".join(pieces)
            row["attachments"] = flat.attachments
            flat.attachments = []
            pieces.clear()
            done.append(row)

        for batch in batches:
            for conv, turn, role, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row is None or conv != row["conv_id"] or size >= segment_chars:
                    segment = 0
                    if row is not None:
                        close()
                        segment = row["segment"] + 1 if conv == row["conv_id"] else 0
                    if not segment:
                        flat.count = 0
                    row = {"conv_id": conv, "segment": segment, "first_turn": turn, "n_turns": 0, "loss": [], "n_tokens": 0}
                    size = 0
                head = f"### {escape(role or '', ROLE_MARKS)}: "
                visited = [flat.visit(p) for p in content or [] if p is not None]
                body = "".join(x for x, _ in visited)
                if role in learned:
                    row["loss"].append({"start": size + len(head), "stop": size + len(head) + len(body)})
                pieces += (head, body, "</turn>\n")
                size += len(head) + len(body) + 8
                row["n_turns"] += 1
                row["n_tokens"] += sum(n for _, n in visited)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
                done = []
        if row is not None:
            close()
            yield pa.RecordBatch.from_pylist(done, schema=schema)

    schema = to_arrow_schema(T.StructType.fromDDL(FORMATTED))
    chosen = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col(f"`{parts}`").cast(f"array<{PART}>").alias("parts"),
    )
    # Contents are ordered as such, not as they would be spelled in JSON.
    return in_order(chosen, partitions, "turn", "role", "parts").mapInArrow(run, FORMATTED)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a formatted text; placeholders stay."""
    at = 0
    while at < len(formatted):
        found = TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at} of a formatted conversation")
        at = found.end()
        body = "".join(x[0] if x[0][0] == "<" else unescape(x[0]) for x in PLACEHOLDER.finditer(found[2]))
        yield unescape(found[1]), body


def digest_formatted(formatted: DataFrame, partitions: int | None = None) -> DataFrame:
    """Digests of what is read back from formatted conversations, one row for each.

    ``turns_sha256`` is over role, line end, text, line end of each turn, ``loss_chars`` and
    ``loss_sha256`` over the unescaped text under the loss mask, ``formatted_chars`` counts
    all of ``formatted``. Segments stream in order; the hash is all that is held.
    """

    def start_row(conv: int | None) -> dict:
        return {"conv_id": conv, "n_turns": 0, "loss_chars": 0, "formatted_chars": 0,
                "turns": hashlib.sha256(), "loss": hashlib.sha256()}

    def finish(row: dict) -> dict:
        return row | {"turns_sha256": row["turns"].hexdigest(), "loss_sha256": row["loss"].hexdigest()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row: dict | None = None
        done: list[dict] = []

        def flush() -> pa.RecordBatch:
            made = [{n: r[n] for n in schema.names} for r in done]
            done.clear()
            return pa.RecordBatch.from_pylist(made, schema=schema)

        for batch in batches:
            for conv, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row is None or conv != row["conv_id"]:
                    if row is not None:
                        done.append(finish(row))
                    row = start_row(conv)
                for role, body in read_turns(text):
                    row["n_turns"] += 1
                    row["turns"].update(f"{role}\n{body}\n".encode())
                for span in spans:
                    learned = unescape(text[span["start"] : span["stop"]])
                    row["loss_chars"] += len(learned)
                    row["loss"].update(learned.encode())
                row["formatted_chars"] += len(text)
            if done:
                yield flush()
        if row is not None:
            done.append(finish(row))
            yield flush()

    schema = to_arrow_schema(T.StructType.fromDDL(DIGEST))
    chosen = formatted.select("conv_id", "segment", "formatted", "loss")
    return in_order(chosen, partitions, "segment").drop("segment").mapInArrow(run, DIGEST)


def write_formatted(formatted: DataFrame, path: str) -> None:
    """Formatted conversations as Parquet, one row a segment."""
    formatted.write.mode("overwrite").parquet(path)


