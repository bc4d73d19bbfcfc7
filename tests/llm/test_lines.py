"""Line deduplication against a direct loop."""

import hashlib

from helpers import documents, no_documents, rows_of

from codeloom.llm import joins, line_dedup

BLANKS = " \t\n\x0b\x0c\r"
UPPER = str.maketrans(line_dedup.UPPER, line_dedup.UPPER.lower())


def expected(rows, min_chars, min_docs):
    """rows: (doc_id, text); ids of None are one document before all others."""
    def key(line):
        return line.strip(BLANKS).translate(UPPER)

    least = line_dedup.NO_ID
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(least if i is None else i)
    keeper = {k: max(ids) for k, ids in holders.items() if len(ids) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if keeper.get(key(x), least if i is None else i) == (least if i is None else i)]
        out.append((i, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=repr)


LONG = "This line is far longer than forty letters, and it is shared"
LINES = [
    f"first\n{LONG}\nlast", f"  {LONG.upper()}\t\n{LONG}", f"{LONG}\r", f"\n\n{LONG}\n", f"{LONG} É\nx", f"{LONG} é\n{LONG}",
    f"{LONG}\n{LONG}\n{LONG}", "\n", "only", f"{LONG}\n" * 3000,
]


def test_equals_direct_loop(spark):
    docs = documents(spark, LINES)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for min_chars, min_docs in ((40, 5), (40, 2), (1, 2), (0, 1), (60, 100)):
        found = line_dedup.remove_common_lines(docs, min_chars=min_chars, min_docs=min_docs)
        assert found.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
        assert rows_of(found) == expected(rows, min_chars, min_docs)


def test_text_and_kept_columns(spark):
    docs = documents(spark, LINES)
    found = line_dedup.remove_common_lines(docs, keep=["doc_id", "kept", "text"], with_text=True).collect()
    assert len(found) == docs.count()
    for r in found:
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
        assert r.kept["kept"] == "k"
        if not r.n_dropped:
            assert r.kept_text == (r.kept["text"] or "")


def test_frequent_keys_either_way(spark):
    """Matched by broadcast or by shuffle, the rows are the same."""
    rows = spark.range(300).selectExpr("id", "id % 7 AS h")
    table = spark.range(5).selectExpr("id AS h", "id * 10 AS keeper").join(rows.groupBy("h").count(), "h").withColumnRenamed("count", "n")
    wanted = sorted((i, i % 7, i % 7 * 10) for i in range(300) if i % 7 < 5)
    for share in (1, 7, 10_000):
        found = joins.match_keys(rows, table, ["h"], "n", share).select("id", "h", "keeper")
        assert sorted(map(tuple, found.collect())) == wanted


def test_no_documents(spark):
    assert line_dedup.remove_common_lines(no_documents(spark)).count() == 0
