"""Conversation repair: the cheapest edits that give turns a sound order of roles.

A dynamic program runs over the rows of a conversation in order. Its states are those of
the role order ``(s?(ua)+)?``; for each it keeps the cheapest edits, ties by the letters of
the edits, as a node of a persistent trail (``edit_trail``). Long conversations are cut
into segments, each solved for every state it may be entered in; segments are then chained.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codeloom.llm.common import release_memory, small_batches
from codeloom.llm.edit_trail import ROOT, Trail
from codeloom.workspace import materialize

#: Rows of a segment.
SEGMENT = 4096
#: Stands for a null conversation or turn, and comes before all others.
NO_ID = -(1 << 63)

# What has been put out so far: nothing, a system row, a user row last, an assistant row last.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: Inserts that bring a state to a sound end.
CLOSING = {EMPTY: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
LEGAL = ("su", "ua", "au")
BLANKS = " \t\n\x0b\x0c\r"
#: Edits cost so much.
REROLE, DELETE, INSERT = 2, 3, 2


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after the damage that the CRC of ``conv_id:turn`` chooses.

    Of 20 remainders 0 drops the row, 1 empties its text, 2 takes its full stops, exclamation
    and question marks, 3 repeats it, 4 makes it a user's. Nulls count as one space.
    """
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    fault = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(fault == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def in_conversation_order(rows: DataFrame) -> DataFrame:
    """(c, t, role, text, copies, late) in order of conversation, turn, role, text, dealt to ranges.

    Rows equal in all are one row with their number. ``late`` tells that an earlier turn has
    the same role and text. A conversation of any length is cut by ranges of its turns.
    """
    c, t = (F.coalesce(n, F.lit(NO_ID)) for n in ("conv_id", "turn"))
    gone = F.col("copies") == 0
    keyed = rows.select(
        c.alias("c"), t.alias("t"), "copies",
        *[F.when(gone, "").otherwise(F.col(n)).alias(n) for n in ("role", "text")],
    ).withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(7), "role", "text")})
    keys = ["c", "t", "h1", "h2"]
    one = keyed.groupBy(*keys).agg(F.max("role").alias("role"), F.max("text").alias("text"), F.sum("copies").alias("copies"))
    present = keyed.where(~gone).select(*keys)
    # Told by the key of the first turn, which no two rows share, so that a text said again and again is no hot key.
    first = present.groupBy("c", "h1", "h2").agg(F.min("t").alias("t")).withColumn("first", F.lit(True))
    marked = one.join(first, keys, "left").withColumn("late", F.col("first").isNull())
    return (
        marked.select("c", "t", "role", "text", "copies", "late")
        .repartitionByRange("c", "t", "role")
        .sortWithinPartitions("c", "t", "role", "text")
    )


def closed(trail: Trail, states: list) -> list:
    """States with inserts before the next row; two at most are ever of use."""
    user = best(trail, [states[USER], *[after(states[s], INSERT, b"I") for s in (EMPTY, SYSTEM, ASSISTANT)]])
    assistant = best(trail, [states[ASSISTANT], after(user, INSERT, b"I")])
    return [states[EMPTY], states[SYSTEM], user, assistant]


def after(state: tuple | None, cost: int, letter: bytes) -> tuple | None:
    """A state and what is to be added to it; None can't be reached."""
    return state and (state[0] + cost, state[1], letter)


def best(trail: Trail, found: list) -> tuple | None:
    """The cheapest of (cost, node, letters to add), ties by the letters of all edits."""
    least = min((f[0] for f in found if f), default=None)
    nodes = [trail.add(f[1], f[2]) if len(f) > 2 else f[1] for f in found if f and f[0] == least]
    if not nodes:
        return None
    first = nodes[0]
    for node in nodes[1:]:
        if trail.less(node, first):
            first = node
    return least, first


def step(trail: Trail, states: list, initial: str, must_go: bool, cut_off: bool) -> list:
    """The states behind a row of this role, which has to go or may end too early."""
    before = closed(trail, states)
    found: list[list] = [[after(s, DELETE, b"D")] for s in before]
    if not must_go:
        extra = int(cut_off)
        if initial == "s":
            found[SYSTEM].append(after(before[EMPTY], extra, b"K"))
        for to, sign, sources in ((USER, "u", (EMPTY, SYSTEM, ASSISTANT)), (ASSISTANT, "a", (USER,))):
            cost, letter = (extra, b"K") if initial == sign else (extra + REROLE, b"R")
            found[to] += [after(before[s], cost, letter) for s in sources]
    return [best(trail, f) for f in found]


def finish(trail: Trail, states: list) -> tuple[int, int, int, bytes]:
    """Cost, node, last state and closing inserts of the cheapest way to a sound end."""
    ways = [(s, b"I" * n) for s, n in CLOSING.items() if states[s]]
    least = min(states[s][0] + INSERT * len(tail) for s, tail in ways)
    found = None
    for s, tail in ways:
        if states[s][0] + INSERT * len(tail) == least:
            node = trail.add(states[s][1], tail)
            if found is None or trail.less(node, found[1]):
                found = least, node, s, tail
    return found


def applied(edits: bytes, rows: list[tuple[str, str]], state: int) -> tuple[list[str], int]:
    """Rows as ``role:text`` after the edits, entered in ``state``, and the state behind them."""
    out: list[str] = []
    at = iter(rows)
    for letter in edits.decode():
        role, text = ("", "") if letter == "I" else next(at)
        if letter == "D":
            continue
        if letter == "K" and role[:1] == "s":
            state = SYSTEM
        else:
            state = ASSISTANT if state == USER else USER
            if letter != "K":
                role = "assistant" if state == ASSISTANT else "user"
        out.append(f"{role}:{text}")
    return out, state


class Segment:
    """Rows of a conversation that follow each other, and what is counted on the way."""

    def __init__(self, conv: int):
        self.conv = conv
        self.rows: list[tuple[str, str]] = []
        self.marks: list[tuple[str, bool, bool]] = []
        self.found = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "n_turns": 0}
        self.turns: list[int] = []
        self.initials: list[str] = []

    def add(self, turn: int, role: str, text: str, duplicate: bool) -> None:
        initial = role[:1]
        said = text.rstrip(BLANKS)
        fault = "blank" if not said else "duplicate" if duplicate else "truncated" if said[-1] not in ".!?" else None
        if fault:
            self.found[fault] += 1
        if self.initials and self.initials[-1] + initial not in LEGAL:
            self.found["illegal"] += 1
        self.initials = [*self.initials[:1], initial]
        if turn != NO_ID:
            if not self.turns or self.turns[-1] != turn:
                self.found["n_turns"] += 1
            self.turns = [*self.turns[:1], turn]
        must_go = fault in ("blank", "duplicate")
        self.rows.append(("", "") if must_go else (role, text))
        self.marks.append((initial, must_go, fault == "truncated"))

    def solve(self, entry: int) -> tuple[Trail, list]:
        trail = Trail()
        states: list = [None] * 4
        states[entry] = (0, ROOT)
        for mark in self.marks:
            states = step(trail, states, *mark)
        return trail, states

    def row(self) -> dict:
        ends = {"min_turn": self.turns[0] if self.turns else None, "max_turn": self.turns[-1] if self.turns else None,
                "first": self.initials[0] if self.initials else None, "last": self.initials[-1] if self.initials else None}
        return {"c": self.conv} | self.found | ends

    def whole(self) -> dict:
        """The result of a conversation that is this segment alone."""
        trail, states = self.solve(EMPTY)
        cost, node, _, _ = finish(trail, states)
        edits = trail.text(node)
        lines, _ = applied(edits, self.rows, EMPTY)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        return self.row() | {"cost": cost, "audit": edits.decode(), "sha256": digest}

    def part(self, number: int) -> dict:
        """What the chaining needs: for each way in and out the cost and the (packed) edits."""
        paths = []
        for entry in range(4):
            trail, states = self.solve(entry)
            paths += [
                {"entry": entry, "exit": end, "cost": s[0], "edits": zlib.compress(trail.text(s[1]), 1)}
                for end, s in enumerate(states) if s
            ]
        return self.row() | {"seg": number, "paths": paths, "rows": [{"role": r, "text": t} for r, t in self.rows]}


COUNTS = "c long, blank long, duplicate long, truncated long, illegal long, n_turns long, min_turn long, max_turn long"
SOLVED = (
    f"{COUNTS}, first string, last string, cost long, audit string, sha256 string, seg long, "
    "paths array<struct<entry:int,exit:int,cost:long,edits:binary>>, rows array<struct<role:string,text:string>>"
)


def solved_segments(ordered: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Results of the conversations that lie within a range, and segments of those that go over
    its ends or are longer than ``segment`` rows."""
    schema = to_arrow_schema(T.StructType.fromDDL(SOLVED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        out: list[dict] = []
        size = 0
        now: Segment | None = None
        cut = True  # whether the conversation may have begun before, or goes on behind
        said: tuple | None = None

        def close(is_cut: bool) -> None:
            nonlocal made, size
            out.append(now.part((TaskContext.get().partitionId() << 32) + made) if is_cut else now.whole())
            made += 1
            size += sum(len(t) for _, t in now.rows) if is_cut else 0

        for batch in batches:
            for conv, turn, role, text, copies, late in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        close(cut)
                        cut = False
                    now = Segment(conv)
                for _ in range(copies):
                    if len(now.rows) >= segment:
                        cut = True
                        close(cut)
                        now = Segment(conv)
                    here = (conv, turn, role, text)
                    now.add(turn, role, text, late or said == here)
                    said = here
                if len(out) >= 2000 or size > 1 << 22:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, size = [], 0
            del batch
        if now is not None:
            close(True)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        release_memory()

    return ordered.mapInArrow(run, SOLVED)


CHAINED = f"{COUNTS}, seg long, entry int, cost long, edits binary"


def chained(segments: DataFrame) -> DataFrame:
    """The edits of each segment of the cheapest way through all segments of a conversation, with
    the counts of the whole. Only edits (packed) and counts meet here, no texts."""

    def chain(rows: pa.Table) -> pa.Table:
        parts = sorted(rows.to_pylist(), key=lambda r: r["seg"])
        trail = Trail()
        states: list = [(0, ROOT), None, None, None]
        came: list[dict[int, tuple[int, bytes]]] = []
        total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "n_turns"), 0)
        last = top = least = None
        for part in parts:
            for name in total:
                total[name] += part[name]
            if part["first"] is not None:
                if last is not None and last + part["first"] not in LEGAL:
                    total["illegal"] += 1
                last = part["last"]
            if part["min_turn"] is not None:
                total["n_turns"] -= int(top == part["min_turn"])
                least = part["min_turn"] if least is None else least
                top = part["max_turn"]
            found: list[list] = [[], [], [], []]
            for path in part["paths"]:
                state = states[path["entry"]]
                if state:
                    found[path["exit"]].append((state[0] + path["cost"], state[1], path["entry"], zlib.decompress(path["edits"])))
            moves: dict[int, tuple[int, bytes]] = {}
            following: list = [None] * 4
            for end, ways in enumerate(found):
                low = min((w[0] for w in ways), default=None)
                for cost, node, entry, edits in ways:
                    if cost == low:
                        to = trail.add(node, edits)
                        if following[end] is None or trail.less(to, following[end][1]):
                            following[end], moves[end] = (cost, to), (entry, edits)
            came.append(moves)
            states = following
        cost, _, end, tail = finish(trail, states)
        out = []
        for part, moves in zip(reversed(parts), reversed(came), strict=True):
            entry, edits = moves[end]
            out.append({"seg": part["seg"], "entry": entry, "edits": edits + tail, "cost": cost,
                        "c": part["c"], "min_turn": least, "max_turn": top} | total)
            end, tail = entry, b""
        return pa.Table.from_pylist(out, schema=schema)

    schema = to_arrow_schema(T.StructType.fromDDL(CHAINED))
    return segments.groupBy("c").applyInArrow(chain, CHAINED)


DIGEST = f"{COUNTS}, cost long, audit string, sha256 string"


def digested(edited: DataFrame) -> DataFrame:
    """Audit and hash of each conversation; its segments stream in order through a task, which
    holds one of them. Nothing but this has to go in order: a SHA-256 can't be put together of parts."""
    schema = to_arrow_schema(T.StructType.fromDDL(DIGEST))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None
        digest = hashlib.sha256()
        audit: list[str] = []
        empty = True

        def closed_row() -> pa.RecordBatch:
            row = {n: now.get(n) for n in schema.names} | {"audit": "".join(audit), "sha256": digest.hexdigest()}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                if now is None or row["c"] != now["c"]:
                    if now is not None:
                        yield closed_row()
                    digest, audit, empty = hashlib.sha256(), [], True
                now = {n: v for n, v in row.items() if n != "rows"}
                lines, _ = applied(row["edits"], [(r["role"], r["text"]) for r in row["rows"]], row["entry"])
                audit.append(row["edits"].decode())
                if lines:
                    digest.update(("" if empty else "\n").encode() + "\n".join(lines).encode())
                    empty = False
        if now is not None:
            yield closed_row()
        release_memory()

    ordered = edited.repartition("c").sortWithinPartitions("c", "seg")
    return ordered.mapInArrow(run, DIGEST)


def repair_conversations(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation
    of ``rows`` (conv_id, turn, role, text and ``copies``, how often a row stands).

    Rows go by turn, nulls first, then role and text. The first fault of a row counts: blank,
    duplicate (an earlier row of this role and text), truncated (its last sign is no full stop,
    exclamation or question mark). ``illegal`` counts neighbours whose roles' first letters
    are not su, ua or au, ``gaps`` the turns missing between the first and the last. ``audit`` has
    the first letters of the cheapest edits (keep 0, rerole 2, delete 3, insert 2, and 1 for each
    truncated row that stays) that leave roles ``(s?(ua)+)?``, of equally cheap ones the least;
    blank and duplicate rows have to go. ``repaired_sha256`` is over ``role:text`` of what is left.

    A conversation without rows (all of ``copies`` 0) has zeros and an empty audit. Rows of null conv_id are one
    conversation. Nulls of role and text count as one space. Other columns are ignored.

    Conversations within a range of the sorted rows are done there. Others, and long ones, are cut
    into segments solved on their own for each state they may be entered in; chaining sees only costs
    and edits, and the edited rows stream once more in order for their hash.
    """
    small_batches(rows.sparkSession)
    some = rows.withColumns({n: F.coalesce(F.col(n).cast("string"), F.lit(" ")) for n in ("role", "text")})
    solved = materialize(solved_segments(in_conversation_order(some), segment), "segments")
    whole = solved.where("seg IS NULL")
    cut = solved.where("seg IS NOT NULL")
    chosen = chained(cut.select(*[c.split()[0] for c in COUNTS.split(", ")], "first", "last", "seg", "paths"))
    edited = chosen.join(cut.select("c", "seg", "rows"), ["c", "seg"])
    columns = [c.split()[0] for c in DIGEST.split(", ")]
    every = whole.select(*columns).unionByName(digested(edited).select(*columns))
    gaps = F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("n_turns"), F.lit(0))
    return every.select(
        F.when(F.col("c") != NO_ID, F.col("c")).alias("conv_id"), gaps.alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha256").alias("repaired_sha256"),
    )


def _plus(state: str, cost: str, letter: str = "''") -> str:
    """SQL: a state (eight digits of cost, then edits) with another edit."""
    return f"(lpad(({state}[1:8]::BIGINT + {cost})::VARCHAR, 8, '0') || {state}[9:] || {letter})"


def repair_sql() -> str:
    """The SQL of ``damage`` and the repair over ``conversations``, a row at a time."""
    crc = """xor(4294967295, list_reduce(list_transform(string_split(tag, ''), lambda ch: ascii(ch)::BIGINT),
      lambda crc, byte: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, bit: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, byte)),
      4294967295::BIGINT))"""

    def into(sign: str, sources: str) -> str:
        letter, cost = f"CASE WHEN initial = '{sign}' THEN 'K' ELSE 'R' END", f"(extra + CASE WHEN initial = '{sign}' THEN 0 ELSE {REROLE} END)"
        ways = [f"CASE WHEN NOT must THEN {_plus(s, cost, letter)} END" for s in sources.split()]
        return f"least({_plus({'u': 'u1', 'a': 'a1'}[sign], str(DELETE), chr(39) + 'D' + chr(39))}, {', '.join(ways)})"

    insert = "'I'"
    closing = f"""least(u, {", ".join(_plus(x, str(INSERT), insert) for x in "esa")}) AS u1"""
    return rf"""
WITH RECURSIVE blanks AS (SELECT ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS b),
chosen AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS fault
  FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS tag FROM conversations)),
damaged AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM chosen),
placed AS (
  SELECT *, substr(role, 1, 1) AS initial, trim(text, (SELECT b FROM blanks)) AS said,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
judged AS MATERIALIZED (
  SELECT *, said = '' AS blank, said <> '' AND dup AS duplicate,
         said <> '' AND NOT dup AND NOT regexp_matches(right(said, 1), '[.!?]') AS truncated,
         said = '' OR dup AS must, CASE WHEN said <> '' AND NOT dup AND NOT regexp_matches(right(said, 1), '[.!?]') THEN 1 ELSE 0 END AS extra,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup FROM placed)),
steps AS (
  SELECT conv_id, 0::BIGINT AS i, '00000000' AS e, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, {_plus("e", str(DELETE), "'D'")},
         least({_plus("s", str(DELETE), "'D'")}, CASE WHEN NOT must AND initial = 's' THEN {_plus("e", "extra", "'K'")} END),
         {into("u", "e s a1")}, {into("a", "u1")}
  FROM (SELECT *, least(a, {_plus("u1", str(INSERT), insert)}) AS a1
        FROM (SELECT t.conv_id, j.i, e, s, u, a, must, extra, initial, {closing}
              FROM steps t JOIN judged j ON j.conv_id IS NOT DISTINCT FROM t.conv_id AND j.i = t.i + 1))),
ended AS (
  SELECT conv_id, least(e, a, {_plus("u", str(INSERT), insert)}, {_plus("s", str(2 * INSERT), "'II'")}) AS best
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS back FROM steps) WHERE back = 1),
letters AS (
  SELECT conv_id, p, letter, count(*) FILTER (letter <> 'I') OVER upto AS i, count(*) FILTER (letter <> 'D') OVER upto AS j
  FROM (SELECT conv_id, unnest(string_split(best[9:], '')) AS letter, unnest(range(len(best) - 8)) AS p FROM ended WHERE len(best) > 8)
  WINDOW upto AS (PARTITION BY conv_id ORDER BY p)),
kept AS (
  SELECT l.conv_id, l.p, l.letter, j.role, j.text, l.j - max(CASE WHEN l.letter = 'K' AND j.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS place
  FROM letters l LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM l.conv_id AND j.i = l.i AND l.letter <> 'I' WHERE l.letter <> 'D'),
told AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''),
                             chr(10) ORDER BY p) AS repaired FROM kept GROUP BY conv_id),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best[1:8]::BIGINT AS cost, best[9:] AS audit,
       sha256(coalesce(repaired, '')) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM e.conv_id"""
