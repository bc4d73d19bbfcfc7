"""Structural chunking against plain recursion on trees."""

import random

import pytest

from codeloom.operators import lines, nodes, packing
from codeloom.operators.nodes import prose_nodes

NODES = "doc_id long, node_id string, parent_id string, depth int, ord int, kind string, start long, end long"


class Node:
    def __init__(self, start, end, children=()):
        self.start, self.end, self.children = start, end, list(children)


def rows_of(doc_id, node, node_id="0", parent=None, depth=0, order=0):
    yield (doc_id, node_id, parent, depth, order, "n", node.start, node.end)
    for i, child in enumerate(node.children):
        yield from rows_of(doc_id, child, f"{node_id}.{i}", node_id, depth + 1, i)


def random_tree(rng, start, end, depth):
    children, at = [], start
    while depth and at < end and len(children) < 9:
        a = at + rng.choice([0, 0, 0, 1, 3])
        b = min(end, a + rng.choice([1, 2, 5, 13, 30, 60]))
        if a >= b:
            break
        children.append(random_tree(rng, a, b, depth - 1))
        at = b
    return Node(start, end, children)


def walk(node, limit):
    """Spans by recursion, child by child."""
    out, here = [], (node.start, node.start)
    for c in node.children:
        if c.end - c.start > limit:
            out.append(here)
            here = (c.end, c.end)
            out += walk(c, limit)
        elif c.end - c.start + here[1] - here[0] > limit:
            out.append(here)
            here = (c.start, c.end)
        else:
            here = (here[0], c.end)
    return [*out, here]


def walk_text(node, text, limit, gaps):
    out, now = [], ""
    for i, c in enumerate(node.children):
        following = node.children[i + 1].start if i + 1 < len(node.children) else node.end
        piece = text[c.start : following if gaps else c.end]
        if c.end - c.start > limit:
            out.append(now)
            now = ""
            out += walk_text(c, text, limit, gaps)
        elif c.end - c.start + len(now) > limit:
            out.append(now)
            now = piece
        else:
            now += piece
    return [*out, now]


def fill(spans):
    return [(a, n[0]) for (a, _), n in zip(spans, spans[1:])] + [spans[-1]]


def merge(spans, text, limit, blanks):
    out, start, end = [], 0, 0
    for _, e in spans:
        end = e
        piece = text[start:end]
        size = len(piece) if blanks else len("".join(piece.split()))
        if size > limit and "\n" in piece:
            out.append((start, end))
            start = end
    return out + ([(start, end)] if end > start else [])


def line_at(text, offset):
    seen = 0
    n = 0
    for n, line in enumerate(text.splitlines(keepends=True), 1):
        seen += len(line)
        if seen > offset:
            return n - 1
    return n


def texts_and_trees(n=60, seed=7):
    rng = random.Random(seed)
    for doc_id in range(n):
        size = rng.choice([0, 1, 20, 90, 200])
        text = "".join(rng.choice("ab é\n") for _ in range(size))
        yield doc_id, text, random_tree(rng, 0, size, 4)


@pytest.fixture(scope="module")
def forest(spark):
    cases = list(texts_and_trees())
    nodes = spark.createDataFrame([r for d, _, t in cases for r in rows_of(d, t)], NODES)
    files = spark.createDataFrame([(d, t) for d, t, _ in cases], "doc_id long, text string")
    return cases, nodes.cache(), files.cache()


def by_doc(rows, *columns):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(tuple(r[c] for c in columns))
    return {d: sorted(v) for d, v in out.items()}


@pytest.mark.parametrize("limit", [4, 12, 40])
def test_greedy_pack_and_gap_fill(forest, limit):
    cases, nodes, _ = forest
    spans = packing.greedy_pack(nodes, limit)
    found = by_doc(spans.collect(), "start", "end")
    filled = by_doc(packing.fill_gaps(spans).collect(), "start", "end")
    for doc_id, _, tree in cases:
        wanted = walk(tree, limit)
        assert wanted == sorted(wanted)
        assert found[doc_id] == wanted
        assert filled[doc_id] == sorted(fill(wanted))


@pytest.mark.parametrize("gaps", [False, True])
def test_greedy_pack_text(forest, gaps):
    cases, nodes, files = forest
    found = by_doc(
        packing.greedy_pack_text(nodes, files, 12, keep_gaps=gaps).collect(), "seq", "text"
    )
    for doc_id, text, tree in cases:
        texts = [t for _, t in found[doc_id]]
        wanted = walk_text(tree, text, 12, gaps)
        assert sorted(texts) == sorted(wanted)
        assert [t for t in texts if t] == [t for t in wanted if t]


@pytest.mark.parametrize("blanks", [False, True])
def test_coalesce(forest, blanks):
    cases, nodes, files = forest
    spans = packing.fill_gaps(packing.greedy_pack(nodes, 12))
    found = by_doc(
        packing.coalesce_spans(spans, files, 6, count_blanks=blanks).collect(), "start", "end"
    )
    for doc_id, text, tree in cases:
        assert found.get(doc_id, []) == merge(fill(walk(tree, 12)), text, 6, blanks)


def test_structural_chunks(forest):
    cases, nodes, files = forest
    rows = packing.structural_chunks(nodes, files, max_chars=12, coalesce=6).collect()
    found = by_doc(rows, "start", "end", "start_line", "end_line", "text")
    for doc_id, text, tree in cases:
        wanted = []
        for a, b in merge(fill(walk(tree, 12)), text, 6, False):
            first, last = line_at(text, a), line_at(text, b)
            if last > first:
                wanted.append((a, b, first, last, text[a:b]))
        assert found.get(doc_id, []) == wanted


def test_line_spans(forest):
    cases, nodes, files = forest
    spans = packing.fill_gaps(packing.greedy_pack(nodes, 12))
    found = by_doc(packing.line_spans(spans, files).collect(), "start_line", "end_line")
    for doc_id, text, tree in cases:
        turned = [(line_at(text, a), line_at(text, b)) for a, b in fill(walk(tree, 12)) if b > a]
        assert found.get(doc_id, []) == sorted((a, b) for a, b in turned if b > a)


def test_hand_worked(spark):
    """A big leaf gives an empty span at its start, which gap filling stretches."""
    trees = {
        0: Node(0, 0),
        1: Node(0, 10, [Node(0, 10)]),
        2: Node(0, 20, [Node(0, 12), Node(12, 15), Node(15, 20)]),
        3: Node(0, 20, [Node(0, 4), Node(6, 20)]),
        4: Node(0, 6, [Node(i, i + 1) for i in range(6)]),
    }
    nodes = spark.createDataFrame([r for d, t in trees.items() for r in rows_of(d, t)], NODES)
    spans = packing.greedy_pack(nodes, 5)
    found = by_doc(spans.collect(), "start", "end")
    assert found[0] == [(0, 0)]
    assert found[1] == [(0, 0), (0, 0), (10, 10)]
    assert found[2] == [(0, 0), (0, 0), (12, 15), (15, 20)]
    assert found[3] == [(0, 4), (6, 6), (20, 20)]
    assert found[4] == [(0, 5), (5, 6)]
    filled = by_doc(packing.fill_gaps(spans).collect(), "start", "end")
    assert filled[3] == [(0, 6), (6, 20), (20, 20)]


def test_prose_nodes_cover_text(spark):
    texts = ["", "a", "One. Two! Three\n\nFour? é. x\n", "no mark", "\n\n", "a. b\nc"]
    files = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = prose_nodes(files).collect()
    for d, text in enumerate(texts):
        mine = [r for r in rows if r["doc_id"] == d]
        assert [(r["start"], r["end"]) for r in mine if r["parent_id"] is None] == [(0, len(text))]
        kinds = {k: sorted((r["start"], r["end"]) for r in mine if r["kind"] == k) for k in ("line", "sentence")}
        assert [text[a:b] for a, b in kinds["line"]] == [x for x in text.split("\n") if x]
        assert "".join("".join(text[a:b].split()) for a, b in kinds["sentence"]) == "".join(text.split())
    packed = packing.structural_chunks(prose_nodes(files), files, max_chars=6, coalesce=2).collect()
    for d, text in enumerate(texts):
        spans = sorted((r["start"], r["end"]) for r in packed if r["doc_id"] == d)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


@pytest.mark.parametrize("limit", [6, 30])
def test_uncut_short_lines_change_no_chunk(spark, limit):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab.? \n") for _ in range(rng.randrange(120))) for _ in range(40)]
    files = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    every = packing.greedy_pack(prose_nodes(files), limit)
    fewer = packing.greedy_pack(prose_nodes(files, sentences_over=limit), limit)
    assert sorted(every.collect()) == sorted(fewer.collect())


def test_offset_to_line(spark):
    texts = ["", "a", "a\n", "ab\ncd", "\n\né\n", "x" * 5]
    files = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = [(d, o) for d, t in enumerate(texts) for o in range(len(t) + 3)]
    offsets = spark.createDataFrame(asked, "doc_id long, offset long")
    found = {(r["doc_id"], r["offset"]): r["line"] for r in lines.offset_to_line(offsets, files).collect()}
    assert found == {(d, o): line_at(texts[d], o) for d, o in asked}


def test_large_nodes_measured_in_their_row(spark):
    """As those measured beside their texts, without a shuffle."""
    texts = ["One. Two is longer than that! " * 9 + "\n\n  x  \n" + "word " * 40, "", "short", "é" * 150 + "\n" + " " * 300]
    files = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = nodes.large_nodes(nodes.prose_nodes(files, measured=True))
    beside = nodes.large_nodes(nodes.prose_nodes(files), files)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, beside.select(found.columns).collect()))
    assert found.count() > 5
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
