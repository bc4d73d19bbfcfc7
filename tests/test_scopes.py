"""Scopes against the line ranges of a parser, and chunks made of them."""

import ast
import textwrap

import pyarrow as pa
import pytest

from codeloom.operators import scopes

SOURCES = {
    "plain.py": '''
        import os

        class A(Base):
            """Doc
        with a line at the margin.
            """
            x = 1

            @staticmethod
            @other(1)
            def f(
                a,
                b,
            ):
                def inner():
                    return 1
                return inner

            def g(self): return 2


        def top():
            if x:
                class Local:
                    y = 1
            return [
                1,
            ]

        async def last():
            pass
    ''',
    "empty.py": "",
    "flat.py": "a = 1\nb = 2\n",
    "tabs.py": "class T:\n\tdef f(self):\n\t\treturn 1\n\n\tdef g(self):\n\t\treturn 2\nz = 1",
}
SOURCES = {path: textwrap.dedent(text).lstrip("\n") for path, text in SOURCES.items()}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(list(SOURCES.items()), "path string, text string").cache()


def parsed(text):
    """header line -> (kind, name, first line, last line, parent header)"""
    out = {}

    def visit(node, parent):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "def"
                first = min([child.lineno, *[d.lineno for d in child.decorator_list]]) - 1
                out[child.lineno - 1] = (kind, child.name, first, child.end_lineno, parent)
                visit(child, child.lineno - 1)
            else:
                visit(child, parent)

    visit(ast.parse(text), -1)
    return out


def test_scopes_equal_parser(files):
    rows = scopes.code_scopes(files).collect()
    for path, text in SOURCES.items():
        wanted = parsed(text)
        found = {r["scope"]: r for r in rows if r["path"] == path}
        assert set(found) == set(wanted)
        lines = text.split("\n")
        for header, (kind, name, first, end, parent) in wanted.items():
            r = found[header]
            assert (r["kind"], r["name"], r["first_ln"], r["parent"]) == (kind, name, first, parent)
            # Only blank lines may lie between the parser's end and ours.
            assert r["end_ln"] >= end
            trailing = lines[end : r["end_ln"]]
            assert all(not x.strip() for x in trailing)


def test_brace_language(spark):
    text = "package x\n\nfunc (s *S) Run(a int) {\n\tif a {\n\t\tgo()\n\t}\n}\n\nfunc Stop() {\n}\n"
    files = spark.createDataFrame([("a.go", text)], "path string, text string")
    rows = {r["name"]: r for r in scopes.code_scopes(files).collect()}
    assert (rows["Run"]["scope"], rows["Run"]["end_ln"]) == (2, 8)
    assert (rows["Stop"]["scope"], rows["Stop"]["parent"]) == (8, -1)


@pytest.mark.parametrize("max_chars,chunk_lines", [(5000, 50), (30, 50), (5000, 2), (10, 3)])
def test_chunks_hold_every_line_once(files, max_chars, chunk_lines):
    chunks = scopes.scope_chunks(files, max_chars, chunk_lines).collect()
    assert len({c["chunk_id"] for c in chunks}) == len(chunks)
    for path, text in SOURCES.items():
        mine = sorted((c for c in chunks if c["path"] == path), key=lambda c: (c["scope"], c["part"]))
        whole = {}
        for c in mine:  # pieces of one long line share where they start
            whole[c["scope"], c["start_line"]] = whole.get((c["scope"], c["start_line"]), "") + c["text"]
        held = sorted(line for text_ in whole.values() for line in text_.split("\n"))
        assert held == sorted(text.split("\n"))
        for c in mine:
            assert len(c["text"].split("\n")) <= chunk_lines
            assert len(c["text"]) <= max_chars


def test_a_long_line_is_cut_by_offset(spark):
    line = "x = '" + "".join(chr(97 + i % 26) for i in range(39_000)) + "'"
    text = f"import a\n{line}\ny = 2"
    cut = scopes.scope_chunks(spark.createDataFrame([("f.py", text)], "path string, text string"))
    rows = sorted(cut.collect(), key=lambda r: r["part"])
    assert len(rows) == 10 and max(len(r["text"]) for r in rows) == 5000
    assert "".join(r["text"] for r in rows if r["start_line"] == 1) == line
    links = {(r["chunk_id"], r["target"]) for r in scopes.raw_links(cut).where("relation = 'next'").collect()}
    assert all((a["chunk_id"], b["chunk_id"]) in links for a, b in zip(rows, rows[1:], strict=False))


def test_links(spark, files):
    chunks = scopes.scope_chunks(files, 30, 50).cache()
    ids = {r["chunk_id"] for r in chunks.collect()}
    links = scopes.with_children(scopes.clean_links(scopes.raw_links(chunks), chunks)).collect()
    found = {(r["chunk_id"], r["relation"], r["target"]) for r in links}
    assert all(a in ids and b in ids for a, _, b in found)
    for a, relation, b in found:
        back = {"parent": "child", "child": "parent", "next": "previous", "previous": "next"}[relation]
        assert (b, back, a) in found
    wrong = spark.createDataFrame(
        [("plain.py", "x", "parent", None), ("plain.py", "x", "parent", "gone")],
        "path string, chunk_id string, relation string, target string",
    )
    assert scopes.clean_links(wrong, chunks).count() == 0


def test_tasks_hold_the_lines_of_a_block_at_most():
    n, size = 40, 500
    batch = pa.RecordBatch.from_pydict({"path": [f"f{i}" for i in range(n)], "lines": [["x"] * size] * n})
    arrow = pa.schema([("path", pa.string()), ("made", pa.struct([("n", pa.int64())]))])
    worked = []

    def work(row):
        worked.append(row["path"])
        return {"n": len(row["lines"])}

    parts = scopes._worked(batch, ["path"], work, arrow)
    first = next(parts)
    assert len(worked) * size == scopes.BLOCK and first.num_rows == len(worked)
    rows = [r for part in [first, *parts] for r in part.to_pylist()]
    assert rows == [{"path": f"f{i}", "made": {"n": size}} for i in range(n)]
