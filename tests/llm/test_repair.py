"""Persistent edit trails, and repaired conversations against a search over all edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from codeloom.llm import conversation_repair as repair
from codeloom.llm.edit_trail import ROOT, Trail

BLANKS = " \t\n\x0b\x0c\r"
ROWS = "conv_id long, turn long, role string, text string, copies long, other string"


@pytest.mark.parametrize("prime", [(1 << 61) - 1, 3])
def test_trails_compare_as_strings(prime):
    """Also where nearly all hashes collide."""
    rng = random.Random(4)
    trail = Trail(prime=prime)
    texts = {ROOT: b""}
    for _ in range(300):
        parent = rng.choice(list(texts)[-12:])
        piece = bytes(rng.choice(b"DK") for _ in range(rng.choice((1, 1, 1, 3, 20))))
        texts[trail.add(parent, piece)] = texts[parent] + piece
    for node, text in texts.items():
        assert trail.text(node) == text
    for _ in range(4000):
        a, b = rng.choice(list(texts)), rng.choice(list(texts))
        assert trail.less(a, b) == (texts[a] < texts[b])


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        said = text.strip(BLANKS)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """By trying all edits up to a cost that surely suffices: (cost, audit, lines)."""
    bad = faults(rows)
    front = {(0, "", "", ())}
    best = None

    def inserted(ways):
        out = set(ways)
        for _ in range(2):
            ways = {(c + 2, a + "I", s + r, (*x, f"{n}:")) for c, a, s, x in ways for r, n in (("u", "user"), ("a", "assistant"))}
            out |= ways
        return {w for w in out if re.fullmatch("s?(ua)*u?", w[2])}

    def pruned(ways):  # states are the same if the roles so far end alike
        kept = {}
        for w in ways:
            kind = (w[2][-1:], w[2] == "s")
            kept[kind] = min(kept.get(kind, w), w, key=lambda x: x[:2])
        return set(kept.values())

    for (_, role, text), fault in zip(rows, bad, strict=True):
        following = set()
        for c, a, s, x in inserted(front):
            following.add((c + 3, a + "D", s, x))
            if fault not in ("blank", "duplicate"):
                more = c + (fault == "truncated")
                following.add((more, a + "K", s + (role[:1] or "?"), (*x, f"{role}:{text}")))
                following |= {(more + 2, a + "R", s + n[0], (*x, f"{n}:{text}")) for n in ("user", "assistant")}
        front = pruned(w for w in following if re.fullmatch("s?(ua)*u?", w[2]))
    best = min((w for w in inserted(front) if re.fullmatch("(s?(ua)+)?", w[2])), key=lambda w: w[:2])
    return best[0], best[1], best[3]


def expected(rows):
    """rows of one conversation: (turn, role, text), copies expanded."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [t for t, _, _ in rows if t is not None]
    bad = faults(rows)
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in itertools.pairwise(rows))
    cost, audit, lines = cheapest(rows)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, *(bad.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest


def conversations(rng, n, longest):
    out = []
    for conv in [None, *range(n)]:
        for _ in range(rng.randrange(longest)):
            role = rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None, "agent"])
            text = rng.choice(["Yes.", "No", "", " \n", "Why?", "Go on.", "é!", None, "long " * 30, f"{rng.random()}."])
            out.append((conv, rng.choice([None, *range(longest)]), role, text, rng.choice([0, 1, 1, 1, 2]), "x"))
    return out


def by_conversation(rows):
    out = {}
    for conv, turn, role, text, copies, _ in rows:
        out.setdefault(conv, []).extend([(turn, " " if role is None else role, " " if text is None else text)] * copies)
    return out


@pytest.mark.parametrize("segment", [1, 3, 4096])
def test_equals_search(spark, segment):
    """Any length of segments gives the same edits."""
    rows = conversations(random.Random(segment), 60, 12)
    found = repair.repair_conversations(spark.createDataFrame(rows, ROWS).repartition(5), segment).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == {c: expected(x) for c, x in by_conversation(rows).items()}
    assert len(found) == len(by_conversation(rows))


def test_hot_conversation(spark):
    """One conversation with most rows, over many ranges, and a text said again and again."""
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["ok.", f"{t}.", f"{t}"]), 1, "x") for t in range(3000)]
    rows += conversations(rng, 20, 6)
    rows = [r for r in rows if r[0] != 1 or r[5] == "x"]
    found = repair.repair_conversations(spark.createDataFrame(rows, ROWS).repartition(6), 100).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == {c: expected(x) for c, x in by_conversation(rows).items()}


def test_damage(spark):
    rows = [(c, t, "assistant", "Why? So. Oh!", 1, "x") for c in (None, *range(30)) for t in (None, 0, 1, 2)]
    damaged = repair.damage(spark.createDataFrame(rows, ROWS)).collect()
    assert len(damaged) == len(rows)
    for r in damaged:
        at = ":".join(" " if x is None else str(x) for x in (r.conv_id, r.turn))
        fault = zlib.crc32(at.encode()) % 20
        assert r.copies == {0: 0, 3: 2}.get(fault, 1)
        assert r.text == {1: "", 2: "Why So Oh"}.get(fault, "Why? So. Oh!")
        assert r.role == ("user" if fault == 4 else "assistant")


def test_nothing_left(spark):
    rows = spark.createDataFrame([(5, 1, "user", "a", 0, "x"), (None, None, None, None, 0, "x")], ROWS)
    empty = hashlib.sha256(b"").hexdigest()
    found = repair.repair_conversations(rows).orderBy(F.col("conv_id").asc_nulls_first()).collect()
    assert [tuple(r) for r in found] == [(c, 0, 0, 0, 0, 0, 0, "", empty) for c in (None, 5)]
    assert repair.repair_conversations(rows.where("conv_id = 6")).count() == 0
