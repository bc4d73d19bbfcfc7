"""Hot keys, hot cells and giant files give whole and right results."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_packing import NODES, Node, by_doc, fill, line_at, merge, rows_of, walk
from test_windows import sentence_chunks

from codeloom.functions import text
from codeloom.operators import firsts, packing, windows
from codeloom.operators.nodes import prose_nodes
from codeloom.operators.search import top_k
from codeloom.sources import chunk_store


def giant_text(seed=4, n=40000):
    rng = random.Random(seed)
    return "".join(rng.choice(["word ", "é, ", "x. ", "y! ", "\n", "long" * 9 + " "]) for _ in range(n))


def prose_tree(value):
    """Document, lines and sentences by plain loops."""
    lines, at = [], 0
    for line in value.split("\n"):
        parts, here = [], at
        for part in line.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").split("\n"):
            if part:
                parts.append(Node(here, here + len(part)))
            here += len(part) + 1
        if line:
            lines.append(Node(at, at + len(line), parts))
        at += len(line) + 1
    return Node(0, len(value), lines)


@pytest.fixture(scope="module")
def giant(spark):
    value = giant_text()
    rows = [(0, value), (1, "small. one\n"), (2, value[:700])]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").cache()


@pytest.mark.parametrize("limit", [40, 300])
def test_giant_file_structural(giant, limit):
    rows, files = giant
    tree = prose_nodes(files, sentences_over=limit)
    found = by_doc(
        packing.structural_chunks(tree, files, limit, 30).collect(), "start", "end", "text"
    )
    lined = by_doc(
        packing.line_spans(packing.fill_gaps(packing.greedy_pack(tree, limit)), files).collect(),
        "start_line", "end_line",
    )
    for doc_id, value in rows:
        spans = fill(walk(prose_tree(value), limit))
        merged = merge(spans, value, 30, False)
        wanted = [(a, b, value[a:b]) for a, b in merged if line_at(value, b) > line_at(value, a)] \
            if doc_id else [(a, b, value[a:b]) for a, b in merged if "\n" in value[a:b] or b == len(value)]
        if doc_id:
            assert found.get(doc_id, []) == wanted
        else:
            assert [x for x in found[0] if "\n" in x[2]] == [x for x in wanted if "\n" in x[2]]
            ends = [0]
            for i, c in enumerate(value):
                if c == "\n":
                    ends.append(i + 1)
            at = np.searchsorted(ends, [a for a, _ in spans], "right") - 1
            to = [len(ends) if b >= len(value) and not value.endswith("\n") else int(np.searchsorted(ends, b, "right")) - 1
                  for _, b in spans]
            turned = sorted((int(a), int(b)) for a, b, s in zip(at, to, spans) if s[1] > s[0] and b > a)
            assert lined[0] == turned


def test_fold_over_many_units(spark):
    """Far more units in one group than the fold takes at a time."""
    rng = random.Random(9)
    at, units = 0, []
    for _ in range(4321):
        size = rng.choice([1, 3, 8])
        units.append(Node(at, at + size))
        at += size + rng.choice([0, 1])
    tree = Node(0, at, units)
    nodes = spark.createDataFrame(list(rows_of(0, tree)), NODES)
    for limit in (8, 30, 5000):
        assert by_doc(packing.greedy_pack(nodes, limit).collect(), "start", "end")[0] == walk(tree, limit)


def test_giant_file_windows(giant):
    rows, files = giant
    found = {}
    for r in windows.sentence_windows(files, 64, 10).collect():
        found.setdefault(r["doc_id"], []).append((r["win"], r["n_tokens"], r["text"]))
    for doc_id, value in rows:
        chunks = sentence_chunks(value, 64, 10)
        assert sorted(found[doc_id]) == [
            (i, sum(n for n, _ in c), " ".join(t for _, t in c)) for i, c in enumerate(chunks)
        ]


def test_block_spans(spark):
    value = giant_text(n=2000)
    rng = random.Random(1)
    spans = [(0, 0), (0, len(value)), (1024, 1024), (1023, 1025), (len(value), len(value))]
    spans += [tuple(sorted((rng.randrange(len(value)), rng.randrange(len(value))))) for _ in range(200)]
    df = spark.createDataFrame([(value, a, b) for a, b in spans], "t string, a long, b long")
    blocks = text.text_blocks(F.col("t"))
    found = df.select("a", "b", text.block_span_text(blocks, F.col("a"), F.col("b")).alias("x")).collect()
    assert all(r["x"] == value[r["a"] : r["b"]] for r in found)
    empty = spark.createDataFrame([("", 0, 0)], "t string, a long, b long")
    assert empty.select(text.block_span_text(text.text_blocks(F.col("t")), F.col("a"), F.col("b"))).first()[0] == ""


@pytest.mark.parametrize("broadcast_bytes", [1 << 26, 0])
def test_hot_cell(spark, broadcast_bytes):
    """A third of all vectors in one cell, the rest in thousands of small ones."""
    rng = np.random.default_rng(0)
    vectors = rng.random((9000, 4)).astype(np.float32)
    cells = [0 if i % 3 == 0 else i for i in range(9000)]
    c = spark.createDataFrame(
        [(i, list(map(float, v)), cells[i]) for i, v in enumerate(vectors)], "id long, embedding array<float>, cell_no int"
    ).repartition(3)
    q = spark.createDataFrame([(i, [1.0, 0.5, 0.2, 0.1], cells[i]) for i in range(40)], "q_id long, qv array<double>, cell_no int")
    found = {}
    for r in top_k(c, q, 3, match_on="cell_no", broadcast_bytes=broadcast_bytes).collect():
        found.setdefault(r["q_id"], {})[r["rank"]] = r["id"]
    one = np.array([1.0, 0.5, 0.2, 0.1])
    v = vectors.astype(float)
    scores = np.round(v @ one / np.linalg.norm(v, axis=1) / np.linalg.norm(one), 9)
    for i in range(40):
        mine = [j for j in range(9000) if cells[j] == cells[i]]
        wanted = sorted(mine, key=lambda j: (-scores[j], j))[:3]
        assert [found[i][k + 1] for k in range(len(wanted))] == wanted


def test_hot_repository(spark, tmp_path):
    rows = spark.range(30000).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, "o/hot").otherwise(F.concat(F.lit("o/r"), F.col("id") % 50)).alias("repo"),
    )
    found = {r["repo"]: r["seq"] for r in firsts.first_per_key(rows).collect()}
    assert len(found) == 51 and found["o/hot"] == 0
    chunks = rows.select(F.col("seq").cast("string").alias("chunk_id"), "repo", F.lit("naive").alias("mode"))
    path = str(tmp_path / "store")
    chunk_store.write_chunk_store(chunks, path)
    hot = chunk_store.read_chunk_store(spark, path, "o/hot")
    assert hot.count() == 10000
    # Several writers shared the hot store.
    assert len([f for f in hot.inputFiles() if "hot" in f]) > 1
