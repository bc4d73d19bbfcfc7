"""Scopes of source files, told by indentation or by braces.

Files are cut into blocks of lines, which are read side by side. What a block needs to know
of the lines before it is worked out from one small row a block: first whether it begins in
code, a comment or a string, at what depth, and after what unfinished head (``lexing.moves``,
folded over the blocks of a file), then which scopes are open where it begins, and where its own scopes
end in later blocks. Files of one block need none of it, and no text is ever shuffled for them.

A scope has a key: the indentation of its header, or the depth of its brace. It ends at
the first later event whose key is no larger: a line of code indented no more, or a closing
brace. By indentation a header is a line with a keyword (class, function, ...); blank lines,
lines inside strings or brackets and lines that start with a closing bracket or an ``end`` keyword
close nothing; decorators join the scope below; tabs count to the next multiple of eight. By
braces a header is what stands before the brace (``lexing.head_of``), methods without a keyword
included; notes above it join it. This is no parser.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codeloom.functions import lexing
from codeloom.functions.folds import emitting_fold
from codeloom.workspace import materialize, small_batches

# What opens a scope by indentation: keyword and name, after optional modifiers.
HEADER_PATTERN = (
    r"^\s*(?:(?:export|default|public|private|protected|static|final|abstract|async)\s+)*"
    r"(class|def|module|interface|enum|function|func)\s+(?:\([^)]*\)\s*)?((?:[^\W\d]|\$)[\w$]*)"
)
CLOSER_PATTERN = r"^\s*([)\]}]|end\b)"
MODULE = -1
#: Lines of a block.
BLOCK = 2000

MOVES = "array<struct<state:int,depth:int,cut:boolean,rest:string>>"
SCOPE = "struct<key:int,ln:bigint,kind:string,name:string,parent:bigint,level:bigint>"
#: Scopes open where a block begins, ends of its own in later blocks, headers of later blocks that claim its last lines.
AROUND = f"stack array<{SCOPE}>, ends array<struct<ln:bigint,end_ln:bigint>>, claims array<struct<from:bigint,scope:{SCOPE}>>"
LINE = (
    "struct<ln:bigint,line:string,is_header:boolean,kind:string,name:string,first_ln:bigint,end_ln:bigint,owner:bigint,"
    "parent:bigint,depth:bigint,nth:bigint,owner_kind:string,owner_name:string,owner_parent:bigint>"
)


def indentation(line: str) -> int:
    """Columns before the first other sign."""
    lead = line[: len(line) - len(line.lstrip(" \t"))]
    return len(lead.expandtabs(8))


class Block:
    """Lines of a file, with the events that open and close scopes in order.

    ``opened`` and ``closed`` are events at the line where they take effect: (line, whether the
    line itself is affected, key, and for an opening the header, for a closing the line where scopes end).
    """

    def __init__(self, lines: list[str], first: int, language: str, state: int = 0, depth: int = 0, pending: str = ""):
        self.lines, self.first, self.language, self.pending = lines, first, language, pending
        self.code, _, inside = lexing.masked("\n".join(lines), state, language)
        self.starts = [0]
        for line in lines:
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.quoted = [state != lexing.CODE, *[False] * (len(lines) - 1)]
        for low, high in inside:
            for i in range(bisect_right(self.starts, low), len(lines)):
                if self.starts[i] >= high:
                    break
                self.quoted[i] = True
        self.headers: set[int] = set()
        self.events = self._braces(depth) if language in lexing.BRACED else self._indents(depth, state)

    def decorates(self, i: int) -> bool:
        return self.lines[i].lstrip().startswith("@") and not self.quoted[i]

    def _indents(self, depth: int, state: int) -> list[tuple]:
        bracketed = self.language in lexing.BRACKETED
        above = None
        if "@" in self.pending and state == lexing.CODE and depth <= 0:
            above = self.first - self.pending.count("\n", len(self.pending) - len(self.pending.lstrip()))
        events: list[tuple] = []
        for i, line in enumerate(self.lines):
            code = self.code[self.starts[i] : self.starts[i + 1]] if bracketed else line
            plain = not (self.quoted[i] or bracketed and depth > 0) and bool(code.strip())
            if bracketed:
                depth += lexing.depth_change(code, self.language)
            if not plain:
                continue
            ln, key = self.first + i, indentation(line)
            if not re.match(CLOSER_PATTERN, line):
                events.append((ln, True, key, None, ln))
            if line.lstrip().startswith("@"):
                above = ln if above is None else above
                continue
            head = re.match(HEADER_PATTERN, code)
            if head:
                self.headers.add(ln)
                events.append((ln, False, key, (ln, head[1], head[2], ln if above is None else above), ln))
            above = None
        return events

    def _braces(self, depth: int) -> list[tuple]:
        events: list[tuple] = []
        text = self.pending + self.code
        shift = len(self.pending)
        since = 0
        for found in lexing.DELIMITER.finditer(text, shift):
            ln = self._ln(found.start(), shift)
            if found[0] == "{":
                head = text[since : found.start()]
                told = lexing.head_of(head, self.language)
                if told:
                    kind, name, place = told
                    header = self._ln(since + place, shift)
                    # A line is the header of one scope, the first that opens on it.
                    if header not in self.headers:
                        self.headers.add(header)
                        first = self._ln(since + len(head) - len(head.lstrip()), shift)
                        events.append((ln, False, depth, (header, kind, name, first), ln))
                depth += 1
            elif found[0] == "}":
                depth -= 1
                events.append((ln, False, depth, None, ln + 1))
            since = found.end()
        return events

    def _ln(self, at: int, shift: int) -> int:
        """The line of a place in what is pending and the block."""
        if at < shift:
            return self.first - self.pending.count("\n", at)
        return self.first + bisect_right(self.starts, at - shift) - 1

    def summary(self) -> dict:
        """What later and earlier blocks have to know: lows of closing keys, and scopes left open."""
        lows: list[dict] = []
        left: list[dict] = []
        ends: list[dict] = []
        claims: list[tuple] = []
        heads: list[dict] = []
        own_ends: dict[int, int] = {}
        for _, _, key, header, end in self.events:
            if header:
                if header[0] >= self.first:
                    heads.append({"ln": header[0], "kind": header[1], "name": header[2], "first_ln": header[3], "level": len(left),
                                  "parent": left[-1]["ln"] if left else None, "low": lows[-1]["key"] if lows else None})
                left.append({"key": key, "ln": header[0], "kind": header[1], "name": header[2], "first_ln": header[3]})
                if header[3] < self.first:  # the scopes around it are those that nothing has closed so far
                    claims.append((min([key, *(low["key"] for low in lows)]), *header))
                continue
            while left and left[-1]["key"] >= key:
                ends.append({"ln": left.pop()["ln"], "end_ln": end})
                own_ends.setdefault(ends[-1]["ln"], end)
            if not lows or key < lows[-1]["key"]:
                lows.append({"key": key, "end_ln": end})
        named = [dict(zip(("key", "ln", "kind", "name", "first_ln"), c, strict=True)) for c in claims]
        for head in heads:
            head["end_ln"] = own_ends.get(head["ln"])
        # A head may begin in an earlier block than its brace.
        earlier = [e for e in ends if e["ln"] < self.first]
        return {"lows": lows, "left": left, "claims": named, "ends": earlier, "first": self.first,
                "behind": self.first + len(self.lines), "heads": heads}

    def rows(self, n_lines: int, stack: list[dict], ends: list[dict], claims: list[dict]) -> list[dict]:
        """The lines with their scopes."""
        stack = list(stack)
        end_of = {e["ln"]: e["end_ln"] for e in ends}
        owners: list[dict | None] = []
        depths: list[int] = []
        scopes: dict[int, dict] = {}
        first_of: dict[int, int] = {}

        def begin(upto: int) -> None:
            while len(owners) < min(upto, len(self.lines)):
                owners.append(stack[-1] if stack else None)
                depths.append(len(stack))

        for ln, itself, key, header, end in self.events:
            begin(ln - self.first + (not itself))
            if not header:
                while stack and stack[-1]["key"] >= key:
                    end_of.setdefault(stack.pop()["ln"], end)
                continue
            at, kind, name, first = header
            scope = {"key": key, "ln": at, "kind": kind, "name": name, "parent": stack[-1]["ln"] if stack else MODULE, "level": len(stack)}
            stack.append(scope)
            scopes[at], first_of[at] = scope, first
            begin(ln - self.first + 1)
            for i in range(max(first - self.first, 0), ln - self.first + 1):
                if self.first + i == at or self._claimed(i) and self.first + i not in scopes:
                    owners[i] = scope
        begin(len(self.lines))
        for claim in claims:
            for i in range(max(claim["from"] - self.first, 0), len(self.lines)):
                at = self.first + i
                if at == claim["scope"]["ln"]:  # its brace stands in a later block
                    scopes[at], first_of[at] = claim["scope"], claim["from"]
                if at == claim["scope"]["ln"] or self._claimed(i) and at not in scopes:
                    owners[i] = claim["scope"]
        out: list[dict] = []
        numbers: dict[int, int] = {}
        for i, line in enumerate(self.lines):
            ln, owner = self.first + i, owners[i]
            own = scopes.get(ln)
            of = owner["ln"] if owner else MODULE
            numbers[of] = numbers.get(of, -1) + 1
            row = {"ln": ln, "line": line, "is_header": own is not None, "owner": of, "nth": numbers[of]}
            row |= {"depth": own["level"] if own else depths[i]}
            if own:
                row |= {"kind": own["kind"], "name": own["name"], "first_ln": first_of[ln],
                        "end_ln": end_of.get(ln, n_lines), "parent": own["parent"]}
            if owner:
                row |= {"owner_kind": owner["kind"], "owner_name": owner["name"], "owner_parent": owner["parent"]}
            out.append(row)
        return out

    def _claimed(self, i: int) -> bool:
        """Whether a line above a header joins it: all of a head with a brace, or decorators."""
        return self.language in lexing.BRACED or self.decorates(i)


def _blocks(files: DataFrame, id_col: str, text_col: str, language_col: str | None, size: int) -> DataFrame:
    """(id, language, n_lines, n_blocks, block, lines)."""
    language = F.coalesce(F.lower(F.col(language_col)), F.lit("")) if language_col else F.lit("")
    lines = files.select(F.col(id_col), language.alias("language"), F.split(text_col, "\n").alias("lines"))
    cut = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("lines"), F.lit(1)), F.lit(size)), lambda i: F.slice("lines", i, F.lit(size))
    )
    # Counted before the lines are dealt: what stands beside a generator is worked out for each of its rows.
    n_lines = F.size("lines").cast("bigint")
    counted = lines.where("lines IS NOT NULL").select(
        id_col, "language", n_lines.alias("n_lines"), F.ceil(n_lines / size).alias("n_blocks"), "lines"
    )
    return counted.select(id_col, "language", "n_lines", "n_blocks", F.posexplode(cut).alias("block", "lines"))


def _worked(batch: pa.RecordBatch, keep: list[str], work, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, worked and given on as soon as they have ``BLOCK`` lines."""
    kept = batch.select(keep)
    first, made, n_lines = 0, [], 0
    for i, size in enumerate(pc.list_value_length(batch.column("lines")).to_pylist()):
        made.append(work(batch.slice(i, 1).to_pylist()[0]))
        n_lines += size
        if n_lines >= BLOCK or i + 1 == batch.num_rows:
            columns = kept.slice(first, i + 1 - first).columns
            yield pa.RecordBatch.from_arrays([*columns, pa.array(made, arrow.field("made").type)], schema=arrow)
            first, made, n_lines = i + 1, [], 0


def _map_blocks(blocks: DataFrame, keep: list[str], out: str, work) -> DataFrame:
    """``keep`` columns of blocks and the struct that ``work`` makes of each row."""
    small_batches(blocks.sparkSession)
    schema = T.StructType([*blocks.select(*keep).schema.fields, T.StructField("made", T.StructType.fromDDL(out))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _worked(batch, keep, work, arrow)

    return blocks.mapInArrow(run, schema)


def _map_small(rows: DataFrame, keep: list[str], out: str, work) -> DataFrame:
    """As ``_map_blocks``, for ``work`` that makes little of a row. Lines come as one ``text``."""
    small_batches(rows.sparkSession)
    schema = T.StructType([*rows.select(*keep).schema.fields, T.StructField("made", T.StructType.fromDDL(out))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken = {n: batch.column(n) for n in batch.schema.names}
            if "lines" in taken:
                taken["text"] = pc.binary_join(taken.pop("lines"), "\n")
            made = [work(row) for row in pa.RecordBatch.from_pydict(taken).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, pa.array(made, arrow.field("made").type)], schema=arrow)

    return rows.mapInArrow(run, schema)


def _entered(blocks: DataFrame, id_col: str) -> DataFrame:
    """(id, block, state, depth, pending) where each block begins: the moves of the blocks of a
    file, a small row each, are folded in order."""
    told = _map_small(
        blocks, [id_col, "block"], f"moves {MOVES}",
        lambda r: {"moves": [dict(zip(("state", "depth", "cut", "rest"), m, strict=True)) for m in lexing.moves(r["text"], r["language"])]},
    )
    listed = told.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("block", F.col("made.moves").alias("moves")))).alias("items"))
    entry = "struct<block:int,state:int,depth:int,pending:string>"
    step = """named_struct('state', u.moves[acc.state].state, 'depth', acc.depth + u.moves[acc.state].depth,
      'pending', if(u.moves[acc.state].cut, u.moves[acc.state].rest, concat(acc.pending, u.moves[acc.state].rest)),
      'done', concat(acc.done, array(named_struct('block', u.block, 'state', acc.state, 'depth', acc.depth, 'pending', acc.pending))))"""
    folded = emitting_fold("items", {"state": "0", "depth": "0", "pending": "''"}, step, entry, "acc.done")
    return listed.select(id_col, F.explode(folded).alias("e")).select(id_col, "e.*")


SUMMARY = (
    "lows array<struct<key:int,end_ln:bigint>>, left array<struct<key:int,ln:bigint,kind:string,name:string,first_ln:bigint>>, "
    "claims array<struct<key:int,ln:bigint,kind:string,name:string,first_ln:bigint>>, ends array<struct<ln:bigint,end_ln:bigint>>, first bigint"
)
#: Scopes whose header stands in a block, as far as the block knows: the scope of the block around it, how many there are, the lowest
#: key closed before, and the end; and the line behind the block.
HEADS = ", behind bigint, heads array<struct<ln:bigint,kind:string,name:string,first_ln:bigint,level:bigint,parent:bigint,low:int,end_ln:bigint>>"
FOUND = "array<struct<scope:bigint,kind:string,name:string,first_ln:bigint,end_ln:bigint,parent:bigint,depth:bigint>>"


def _found(summary: dict, n_lines: int, stack: list[dict], ends: list[dict], claims: list[dict]) -> list[dict]:
    """The scopes whose header stands in a block, given what is around it, as ``Block.rows`` tells them."""
    keys = [s["key"] for s in stack]
    scopes: dict[int, dict] = {}
    for head in summary["heads"]:
        outer = len(stack) if head["low"] is None else bisect_left(keys, head["low"])
        parent = head["parent"]
        if parent is None:
            parent = stack[outer - 1]["ln"] if outer else MODULE
        scopes[head["ln"]] = {n: head[n] for n in ("kind", "name", "first_ln")} | {"parent": parent, "depth": outer + head["level"]}
    for claim in claims:
        scope = claim["scope"]
        if summary["first"] <= scope["ln"] < summary["behind"]:  # its brace stands in a later block
            told = {"kind": scope["kind"], "name": scope["name"], "parent": scope["parent"], "depth": scope["level"]}
            scopes[scope["ln"]] = told | {"first_ln": claim["from"]}
    end_of = {h["ln"]: h["end_ln"] for h in summary["heads"] if h["end_ln"] is not None}
    end_of |= {e["ln"]: e["end_ln"] for e in ends}
    return [{"scope": ln, "end_ln": end_of.get(ln, n_lines)} | scope for ln, scope in scopes.items()]


def _around(summaries: DataFrame, id_col: str) -> DataFrame:
    """What each block has to know of the others of its file; summaries alone meet here."""
    schema = T.StructType([summaries.schema[id_col], T.StructField("block", T.IntegerType()), *T.StructType.fromDDL(AROUND).fields])
    arrow = to_arrow_schema(schema)

    def follow(rows: pa.Table) -> pa.Table:
        parts = sorted(rows.to_pylist(), key=lambda r: r["block"])
        out = [{id_col: p[id_col], "block": p["block"], "stack": [], "ends": [], "claims": []} for p in parts]
        begins = [p["made"]["first"] for p in parts]
        stack: list[dict] = []
        for i, part in enumerate(parts):
            made = part["made"]
            out[i]["stack"] = [dict(s) for s in stack]
            for end in made["ends"]:
                out[bisect_right(begins, end["ln"]) - 1]["ends"].append(end)
            for low in made["lows"]:
                while stack and stack[-1]["key"] >= low["key"]:
                    closed = stack.pop()
                    out[bisect_right(begins, closed["ln"]) - 1]["ends"].append({"ln": closed["ln"], "end_ln": low["end_ln"]})
            for left in made["left"]:
                scope = {n: left[n] for n in ("key", "ln", "kind", "name")}
                stack.append(scope | {"parent": stack[-1]["ln"] if stack else MODULE, "level": len(stack)})
            for claim in made["claims"]:
                outer = [s for s in out[i]["stack"] if s["key"] < claim["key"]]
                scope = {n: claim[n] for n in ("key", "ln", "kind", "name")}
                scope |= {"parent": outer[-1]["ln"] if outer else MODULE, "level": len(outer)}
                for j in range(bisect_right(begins, claim["first_ln"]) - 1, i):
                    out[j]["claims"].append({"from": claim["first_ln"], "scope": scope})
        return pa.Table.from_pylist(out, schema=arrow)

    return summaries.groupBy(id_col).applyInArrow(follow, schema)


def _block(row: dict, size: int) -> Block:
    entry = [row.get("state") or 0, row.get("depth") or 0, row.get("pending") or ""]
    return Block(row["text"].split("\n") if "text" in row else row["lines"], row["block"] * size, row["language"], *entry)


def _placed(several: DataFrame, id_col: str) -> DataFrame:
    """Blocks of files of several, with the state, depth and unfinished head they are entered with."""
    entered = materialize(_entered(several.repartition(id_col, "block"), id_col), "block-entries")
    return several.join(entered, [id_col, "block"])


def line_scopes(
    files: DataFrame, id_col: str = "path", text_col: str = "text", language_col: str | None = None, block: int = BLOCK
) -> DataFrame:
    """Every line with its scope: (id, ln, line, is_header, kind, name, first_ln, end_ln, owner,
    parent, depth, nth, owner_kind, owner_name, owner_parent).

    ``owner`` is the header line of the innermost scope the line belongs to, or -1 for the
    file itself, and ``nth`` the number of the line among those of its owner. Header lines
    own themselves and carry ``end_ln``, the first line after the scope, ``first_ln``, where its
    decorators, notes or head begin, ``parent``, the header of the enclosing scope, and ``depth``.

    Languages with braces (``lexing.BRACED``) go by braces, others, and files without a language, by indentation.
    A null text has no lines. A scope that nothing closes ends with its file.
    """
    blocks = materialize(_blocks(files, id_col, text_col, language_col, block), "blocks")

    def told(some: DataFrame) -> DataFrame:
        rows = _map_blocks(
            some, [id_col, "block"], f"rows array<{LINE}>",
            lambda r: {"rows": _block(r, block).rows(r["n_lines"], r.get("stack") or [], r.get("ends") or [], r.get("claims") or [])},
        )
        return rows.select(id_col, "block", F.explode("made.rows").alias("l")).select(id_col, "block", "l.*")

    alone = told(blocks.where("n_blocks <= 1")).drop("block")
    several = blocks.where("n_blocks > 1")
    if several.isEmpty():
        return alone
    placed = _placed(several, id_col)
    summaries = _map_small(placed, [id_col, "block"], SUMMARY, lambda r: _block(r, block).summary())
    around = materialize(_around(summaries, id_col), "block-scopes")
    lines = materialize(told(placed.join(around, [id_col, "block"])), "scoped-lines")
    # Lines of an owner are numbered on from block to block: only their counts are summed up in order.
    counts = lines.groupBy(id_col, "owner", "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(id_col, "owner").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(id_col, "owner", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = lines.join(before, [id_col, "owner", "block"]).withColumn("nth", F.col("nth") + F.col("before"))
    return alone.unionByName(numbered.select(*alone.columns))


def code_scopes(
    files: DataFrame, id_col: str = "path", text_col: str = "text", language_col: str | None = None, block: int = BLOCK
) -> DataFrame:
    """(id, scope, kind, name, first_ln, end_ln, parent, depth); ``scope`` is the
    header's line number and ``parent`` that of the enclosing scope, or -1.

    These are the headers of ``line_scopes``. Blocks give what they know of the scopes whose header
    they hold with their summaries, so lines are neither made rows nor read again for it.
    """
    blocks = materialize(_blocks(files, id_col, text_col, language_col, block), "blocks")
    keep = [id_col, "block"]

    def told(rows: DataFrame, work) -> DataFrame:
        return _map_small(rows, [id_col], f"found {FOUND}", lambda r: {"found": work(r)}).select(id_col, F.inline("made.found"))

    alone = told(blocks.where("n_blocks <= 1"), lambda r: _found(_block(r, block).summary(), r["n_lines"], [], [], []))
    several = blocks.where("n_blocks > 1")
    if several.isEmpty():
        return alone
    placed = _placed(several, id_col)
    summaries = materialize(
        _map_small(placed, [*keep, "n_lines"], SUMMARY + HEADS, lambda r: _block(r, block).summary()), "block-summaries"
    )
    small = [F.col("made")[c].alias(c) for c in ("lows", "left", "claims", "ends", "first")]
    around = materialize(_around(summaries.select(*keep, F.struct(*small).alias("made")), id_col), "block-scopes")
    held = summaries.select(*keep, "n_lines", F.struct("made.first", "made.behind", "made.heads").alias("made")).join(around, keep)
    return alone.unionByName(told(held, lambda r: _found(r["made"], r["n_lines"], r["stack"], r["ends"], r["claims"])))


def scope_chunks(
    files: DataFrame,
    max_chars: int = 5000,
    chunk_lines: int = 50,
    id_col: str = "path",
    text_col: str = "text",
    language_col: str | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """(id, chunk_id, scope, parent, kind, name, part, start_line, end_line, text).

    One chunk per scope, of the lines it owns itself; nested scopes are chunks of
    their own, tied by ``parent``. A scope is cut every ``chunk_lines`` of its
    lines, and a cut piece again wherever the next line would exceed ``max_chars``. A line
    longer than that is chunks of its own, cut by offset, which share its line number.
    Scopes are as in ``line_scopes``.
    """
    scoped = line_scopes(files, id_col, text_col, language_col, block)
    pieces = scoped.groupBy(id_col, "owner", F.floor(F.col("nth") / chunk_lines).alias("piece")).agg(
        F.array_sort(F.collect_list(F.struct("ln", "line"))).alias("lines"),
        *[F.max(f"owner_{c}").alias(c) for c in ("kind", "name", "parent")],
    )
    chunk = "struct<first: bigint, last: bigint, text: string>"
    cut = F.expr(
        f"""aggregate(slice(lines, 2, size(lines)),
              named_struct('first', lines[0].ln, 'last', lines[0].ln, 'text', lines[0].line,
                           'done', cast(array() as array<{chunk}>)),
              (acc, l) -> if(length(acc.text) + 1 + length(l.line) > {int(max_chars)},
                  named_struct('first', l.ln, 'last', l.ln, 'text', l.line,
                               'done', concat(acc.done, array(named_struct(
                                   'first', acc.first, 'last', acc.last, 'text', acc.text)))),
                  named_struct('first', acc.first, 'last', l.ln,
                               'text', concat(acc.text, '\\n', l.line), 'done', acc.done)),
              acc -> concat(acc.done, array(named_struct(
                  'first', acc.first, 'last', acc.last, 'text', acc.text))))"""
    )
    # What is still longer is one line alone: it is cut by offset.
    short = F.flatten(
        F.transform(
            cut,
            lambda c: F.transform(
                F.sequence(F.lit(0), F.greatest(F.length(c["text"]) - 1, F.lit(0)), F.lit(max_chars)),
                lambda at: F.struct(
                    c["first"].alias("first"), c["last"].alias("last"),
                    F.substring(c["text"], at + 1, F.lit(max_chars)).alias("text"),
                ),
            ),
        )
    )
    pieces = materialize(pieces.select(id_col, "owner", "piece", "kind", "name", "parent", short.alias("cuts")), "scope-pieces")
    # Parts are numbered on from piece to piece: only the numbers of cuts are summed up in order.
    earlier = Window.partitionBy(id_col, "owner").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = pieces.select(id_col, "owner", "piece", F.size("cuts").alias("n"))
    before = sizes.select(id_col, "owner", "piece", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    cuts = pieces.join(before, [id_col, "owner", "piece"]).select("*", F.posexplode("cuts").alias("cut", "c"))
    return cuts.select(
        id_col,
        F.col("owner").alias("scope"),
        "parent",
        F.coalesce("kind", F.lit("module")).alias("kind"),
        "name",
        (F.col("before") + F.col("cut")).cast("bigint").alias("part"),
        F.col("c.first").alias("start_line"),
        (F.col("c.last") + 1).alias("end_line"),
        F.col("c.text").alias("text"),
    ).withColumn("chunk_id", F.concat_ws(":", id_col, "scope", "part"))


def raw_links(chunks: DataFrame, id_col: str = "path") -> DataFrame:
    """(id, chunk_id, relation, target): links as first stated, dangling ones included.

    Parent links name the first chunk of the enclosing scope, previous and next
    links the neighbours in file order; the ends of these chains have no target.
    """
    in_file = Window.partitionBy(id_col).orderBy("start_line", "part", "chunk_id")

    def link(relation: str, target: Column) -> Column:
        return F.struct(F.lit(relation).alias("relation"), target.alias("target"))

    placed = chunks.select(
        id_col,
        "chunk_id",
        F.when(F.col("parent").isNotNull(), F.concat_ws(":", id_col, "parent", F.lit(0))).alias("up"),
        F.lag("chunk_id").over(in_file).alias("back"),
        F.lead("chunk_id").over(in_file).alias("on"),
    )
    links = F.array(
        link("parent", F.col("up")), link("previous", F.col("back")), link("next", F.col("on"))
    )
    return placed.select(id_col, "chunk_id", F.explode(links).alias("l")).select(id_col, "chunk_id", "l.*")


def clean_links(links: DataFrame, chunks: DataFrame, id_col: str = "path") -> DataFrame:
    """Links whose target is an existing chunk. Matching by file first keeps the
    join on the files' own partitioning.
    """
    known = chunks.select(id_col, F.col("chunk_id").alias("target"))
    return links.where(F.col("target").isNotNull()).join(known, [id_col, "target"], "left_semi")


def with_children(links: DataFrame, id_col: str = "path") -> DataFrame:
    """Adds the child links that mirror the parent links."""
    def link(source: str, relation: Column, target: str) -> Column:
        return F.struct(
            F.col(source).alias("chunk_id"), relation.alias("relation"), F.col(target).alias("target")
        )

    as_is = link("chunk_id", F.col("relation"), "target")
    mirrored = F.when(F.col("relation") == "parent", link("target", F.lit("child"), "chunk_id"))
    both = F.explode(F.array_compact(F.array(as_is, mirrored)))
    return links.select(id_col, both.alias("l")).select(id_col, "l.*")
