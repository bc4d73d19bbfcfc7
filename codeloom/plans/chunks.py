"""Queries over lines, nodes, structural chunks, scopes and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text
from codeloom.operators import lines, nodes, packing, scopes, windows
from codeloom.plans import brace_code, views
from codeloom.plans import sql as S
from codeloom.plans.registry import query
from codeloom.workspace import materialize

SMALL = 300
SPAN = 'doc_id, s AS "start", e AS "end"'


@query("line_table", f'WITH {S.LINES} SELECT doc_id, ln, line, s AS "start" FROM doc_lines')
def line_table(spark: SparkSession, sf: str) -> DataFrame:
    return lines.line_table(views.documents(spark, sf))


@query(
    "large_nodes",
    f"""WITH {S.NODES}, sized AS (
      SELECT n.*, length(regexp_replace(substring(text, s + 1, e - s), '\\s', '', 'g')) AS non_blank
      FROM nodes n JOIN documents USING (doc_id))
    SELECT doc_id, node_id, depth, kind || ':' || s || '-' || e AS label, non_blank
    FROM sized WHERE non_blank >= 100""",
)
def large_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return nodes.large_nodes(nodes.prose_nodes(views.documents(spark, sf), measured=True))


@query("greedy_pack", f"WITH RECURSIVE {S.packed(SMALL)} SELECT {SPAN} FROM spans")
def greedy_pack(spark: SparkSession, sf: str) -> DataFrame:
    return packing.greedy_pack(views.document_nodes(spark, sf), SMALL)


def _packed_text_sql(max_chars: int) -> str:
    """Both variants, walked child by child; the text is pieced together on the way."""
    return f"""WITH RECURSIVE {S.NODES},
heads AS (SELECT doc_id, node_id, s, e FROM nodes WHERE parent_id IS NULL OR e - s > {max_chars}),
variants(variant) AS (VALUES ('bare'), ('gaps')),
kids AS MATERIALIZED (
  SELECT k.*, variant, substring(text, s + 1, CASE variant WHEN 'bare' THEN e - s ELSE next_s - s END) AS piece
  FROM (SELECT c.doc_id, c.parent_id, c.node_id, c.s, c.e, c.e - c.s > {max_chars} AS big,
               coalesce(lead(c.s) OVER w, h.e) AS next_s, row_number() OVER w AS i
        FROM nodes c JOIN heads h ON h.doc_id = c.doc_id AND h.node_id = c.parent_id
        WINDOW w AS (PARTITION BY c.doc_id, c.parent_id ORDER BY c.ord)) k
  JOIN documents USING (doc_id) CROSS JOIN variants),
walk AS (
  SELECT doc_id, variant, node_id, 0::BIGINT AS i, '' AS now, NULL::VARCHAR AS done FROM heads, variants
  UNION ALL
  SELECT w.doc_id, w.variant, w.node_id, k.i,
         CASE WHEN k.big THEN '' WHEN k.e - k.s + length(w.now) > {max_chars} THEN k.piece
              ELSE w.now || k.piece END,
         CASE WHEN k.big OR k.e - k.s + length(w.now) > {max_chars} THEN w.now END
  FROM walk w JOIN kids k ON k.doc_id = w.doc_id AND k.variant = w.variant AND k.parent_id = w.node_id
    AND k.i = w.i + 1),
emitted AS (
  SELECT doc_id, variant, done AS text FROM walk WHERE done IS NOT NULL
  UNION ALL
  SELECT doc_id, variant, arg_max(now, i) FROM walk GROUP BY doc_id, variant, node_id)
SELECT doc_id, variant, text, count(*) AS n FROM emitted GROUP BY doc_id, variant, text"""


@query("greedy_pack_text", _packed_text_sql(600))
def greedy_pack_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.documents(spark, sf)
    tree = nodes.prose_nodes(docs)
    both = None
    for variant, keep in (("bare", False), ("gaps", True)):
        found = packing.greedy_pack_text(tree, docs, keep_gaps=keep).withColumn("variant", F.lit(variant))
        both = found if both is None else both.unionByName(found)
    return both.groupBy("doc_id", "variant", "text").agg(F.count("*").alias("n"))


@query("gap_fill", f"WITH RECURSIVE {S.packed(SMALL)},{S.FILLED} SELECT {SPAN} FROM filled")
def gap_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_gaps(packing.greedy_pack(views.document_nodes(spark, sf), SMALL))


@query(
    "coalesce_spans",
    f"WITH RECURSIVE {S.packed(SMALL)},{S.FILLED},{S.coalesced(50, False)} SELECT {SPAN} FROM merged",
)
def coalesce_spans(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.documents(spark, sf)
    filled = packing.fill_gaps(packing.greedy_pack(nodes.prose_nodes(docs), SMALL))
    return packing.coalesce_spans(filled, docs)


@query(
    "coalesce_spans_chars",
    f"WITH RECURSIVE {S.packed(SMALL)},{S.coalesced(50, True, 'spans')} SELECT {SPAN} FROM merged",
)
def coalesce_spans_chars(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.documents(spark, sf)
    spans = packing.greedy_pack(nodes.prose_nodes(docs), SMALL)
    return packing.coalesce_spans(spans, docs, count_blanks=True)


@query(
    "offset_to_line",
    f"""WITH {S.NODES},{S.lined('nodes')}
    SELECT doc_id, s AS "offset", start_line AS line FROM lined
    UNION ALL SELECT doc_id, e, end_line FROM lined""",
)
def offset_to_line(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.documents(spark, sf)
    offsets = nodes.prose_nodes(docs).select("doc_id", F.explode(F.array("start", "end")).alias("offset"))
    return lines.offset_to_line(offsets, docs)


@query(
    "line_spans",
    f"""WITH RECURSIVE {S.packed(SMALL)},{S.FILLED},{S.lined('filled')}
    SELECT doc_id, start_line, end_line FROM lined WHERE e > s AND end_line > start_line""",
)
def line_spans(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.documents(spark, sf)
    filled = packing.fill_gaps(packing.greedy_pack(nodes.prose_nodes(docs), SMALL))
    return packing.line_spans(filled, docs)


@query(
    "span_text",
    f"""WITH {S.LINES}, by_line AS (SELECT doc_id, list(line ORDER BY ln) AS ls FROM doc_lines GROUP BY doc_id),
    thirds AS (SELECT doc_id, text, length(text) // 3 AS a, 2 * length(text) // 3 AS b, ls,
                      len(ls) // 3 AS la, 2 * len(ls) // 3 AS lb FROM documents JOIN by_line USING (doc_id))
    SELECT doc_id, substring(text, a + 1, b - a) AS chars, array_to_string(ls[la + 1 : lb], chr(10)) AS lines,
           b - a AS size, a + 7 AS shifted FROM thirds""",
)
def span_text(spark: SparkSession, sf: str) -> DataFrame:
    """The middle third of each text, by characters and by lines, as joined spans."""
    t = F.col("text")
    n, n_lines = F.length("text"), F.size(F.split("text", "\n"))
    a, b = F.floor(n / 3), F.floor(n * 2 / 3)
    la, lb = F.floor(n_lines / 3), F.floor(n_lines * 2 / 3)
    middle = text.span_concat(text.span(a, a), text.span(b, b))
    cut = views.documents(spark, sf).select(
        "doc_id", "text", middle.alias("m"), la.alias("la"), lb.alias("lb")
    )
    return cut.select(
        "doc_id",
        text.span_text(t, F.col("m.start"), F.col("m.end")).alias("chars"),
        text.span_lines(t, F.col("la"), F.col("lb")).alias("lines"),
        text.span_length(F.col("m")).cast("bigint").alias("size"),
        text.span_shift(F.col("m"), F.lit(7))["start"].cast("bigint").alias("shifted"),
    )


@query(
    "structural_chunks",
    f"""WITH RECURSIVE {S.structural()}
    SELECT doc_id, s AS "start", e AS "end", start_line, end_line, text FROM chunks""",
)
def structural_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.documents(spark, sf)
    tree = nodes.prose_nodes(docs, sentences_over=packing.MAX_CHARS)
    return packing.structural_chunks(tree, docs)


@query("code_scopes", f"WITH {S.SCOPES} SELECT * FROM scopes")
def code_scopes(spark: SparkSession, sf: str) -> DataFrame:
    return scopes.code_scopes(views.code_files(spark, sf))


#: Blocks so small that most scopes of the test files go over several.
SMALL_BLOCK = 50


@query("brace_scopes", f"WITH {brace_code.SCOPES} SELECT path, scope::BIGINT AS scope, kind, name, first_ln::BIGINT AS first_ln, "
       "end_ln::BIGINT AS end_ln, parent::BIGINT AS parent, depth::BIGINT AS depth FROM scopes")  # fmt: skip
def brace_scopes(spark: SparkSession, sf: str) -> DataFrame:
    """Types, functions and methods of files in Java, C, TypeScript, PHP and Go, told by braces."""
    return scopes.code_scopes(brace_code.brace_files(spark, sf), language_col="language", block=SMALL_BLOCK)


# Cut sizes of the registered query, small enough that scopes are cut both ways.
SCOPE_CHARS, SCOPE_LINES = 60, 3

def scope_chunks_sql(chars: int, lines: int, found: str = S.SCOPES) -> str:
    """``scope_chunks``: the scopes that ``found`` has of the code files, cut line by line."""
    return f"""{found},
pieces AS MATERIALIZED (
  SELECT path, owner, ln, line, (row_number() OVER (PARTITION BY path, owner ORDER BY ln) - 1) // {lines} AS piece,
         row_number() OVER (PARTITION BY path, owner ORDER BY ln) AS i
  FROM owned),
cutting AS (
  SELECT path, owner, 0::BIGINT AS i, -1::BIGINT AS piece, '' AS txt, 0::BIGINT AS cut FROM pieces WHERE i = 1
  UNION ALL
  SELECT c.path, c.owner, p.i, p.piece,
         CASE WHEN p.piece <> c.piece OR length(c.txt) + 1 + length(p.line) > {chars} THEN p.line
              ELSE c.txt || chr(10) || p.line END,
         c.cut + CASE WHEN p.piece <> c.piece OR length(c.txt) + 1 + length(p.line) > {chars} THEN 1 ELSE 0 END
  FROM cutting c JOIN pieces p ON p.path = c.path AND p.owner = c.owner AND p.i = c.i + 1),
scope_chunks AS (
  SELECT p.path, p.owner AS scope, s.parent, coalesce(s.kind, 'module') AS kind, s.name, c.cut - 1 AS part,
         min(p.ln) AS start_line, max(p.ln) + 1 AS end_line, string_agg(p.line, chr(10) ORDER BY p.ln) AS text,
         p.path || ':' || p.owner || ':' || (c.cut - 1) AS chunk_id
  FROM cutting c JOIN pieces p ON p.path = c.path AND p.owner = c.owner AND p.i = c.i
  LEFT JOIN scopes s ON s.path = p.path AND s.scope = p.owner
  GROUP BY p.path, p.owner, s.parent, s.kind, s.name, c.cut)"""


SCOPE_CHUNKS = scope_chunks_sql(SCOPE_CHARS, SCOPE_LINES)


@query("brace_chunks", f"""WITH RECURSIVE {scope_chunks_sql(200, 6, brace_code.SCOPES)}
    SELECT path, chunk_id, scope::BIGINT AS scope, parent::BIGINT AS parent, kind, name, part::BIGINT AS part,
           start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, text FROM scope_chunks""")  # fmt: skip
def brace_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of those files."""
    return scopes.scope_chunks(brace_code.brace_files(spark, sf), 200, 6, language_col="language")


LINKS = """
raw_links AS (
  SELECT path, chunk_id, 'parent' AS relation, path || ':' || parent || ':0' AS target FROM scope_chunks
  UNION ALL
  SELECT path, chunk_id, 'previous', lag(chunk_id) OVER w FROM scope_chunks
  WINDOW w AS (PARTITION BY path ORDER BY start_line, chunk_id)
  UNION ALL
  SELECT path, chunk_id, 'next', lead(chunk_id) OVER w FROM scope_chunks
  WINDOW w AS (PARTITION BY path ORDER BY start_line, chunk_id)),
clean_links AS (SELECT * FROM raw_links WHERE target IN (SELECT chunk_id FROM scope_chunks)),
links AS (
  SELECT path, chunk_id, relation, target FROM clean_links
  UNION ALL SELECT path, target, 'child', chunk_id FROM clean_links WHERE relation = 'parent')"""


def small_scope_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return scopes.scope_chunks(views.code_files(spark, sf), SCOPE_CHARS, SCOPE_LINES)


def scope_links(chunks: DataFrame) -> DataFrame:
    return scopes.with_children(scopes.clean_links(scopes.raw_links(chunks), chunks))


@query("scope_chunks", f"WITH RECURSIVE {SCOPE_CHUNKS} SELECT * FROM scope_chunks")
def scope_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return small_scope_chunks(spark, sf)


@query(
    "scope_chunks_whole",
    "SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines, true AS within_limit, md5(text) AS text_md5 FROM documents",
)
def scope_chunks_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Documents cut at the default sizes and put together again from their chunks."""
    cut = scopes.scope_chunks(views.documents(spark, sf), id_col="doc_id")
    pieces = F.array_sort(F.collect_list(F.struct("start_line", "part", "end_line", "text")))
    by_doc = cut.groupBy("doc_id").agg(
        pieces.alias("pieces"), F.max("end_line").alias("n_lines"), (F.max(F.length("text")) <= 5000).alias("within_limit")
    )
    # Pieces of one long line share where they start; others are lines apart.
    joined = F.transform(
        "pieces",
        lambda p, i: F.concat(
            F.when(i == 0, "").when(F.get(F.col("pieces"), i - 1)["start_line"] == p["start_line"], "").otherwise("\n"), p["text"]
        ),
    )
    return by_doc.select("doc_id", "n_lines", "within_limit", F.md5(F.array_join(joined, "")).alias("text_md5"))


@query("chunk_edges", f"WITH RECURSIVE {SCOPE_CHUNKS},{LINKS} SELECT * FROM links")
def chunk_edges(spark: SparkSession, sf: str) -> DataFrame:
    return scope_links(materialize(small_scope_chunks(spark, sf), "scope-chunks"))


@query("token_windows", f"WITH {S.windowed()} SELECT doc_id, win, first_token, n_tokens, text FROM windows")
def token_windows(spark: SparkSession, sf: str) -> DataFrame:
    return windows.token_windows(views.documents(spark, sf))


def _sentence_windows_sql(size: int, overlap: int) -> str:
    token = S.TOKEN
    return rf"""WITH RECURSIVE
pieces AS MATERIALIZED (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sn, pn) AS i, len(piece) AS n,
         rtrim(array_to_string(piece, ''), {S.BLANKS}) AS text
  FROM (SELECT doc_id, sn, unnest(range(ceil(len(toks) / {size}::DOUBLE)::BIGINT)) AS pn,
               toks[pn * {size} + 1 : pn * {size} + {size}] AS piece
        FROM (SELECT doc_id, sn, regexp_extract_all(part, '((?:{token})\s*)', 1) AS toks
              FROM (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS sn
                    FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)) AS parts
                          FROM documents)))
        WHERE len(toks) > 0)),
sums AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS upto,
                max(i) OVER (PARTITION BY doc_id) AS last_i FROM pieces),
cuts AS (
  SELECT doc_id, 1::BIGINT AS a, 1::BIGINT AS must, 0::BIGINT AS win FROM sums WHERE i = 1
  UNION ALL
  SELECT c.doc_id, min(t.i) AS a, any_value(c.b) + 1 AS must, any_value(c.win) + 1
  FROM (SELECT c.doc_id, c.win, max(s.i) AS b, any_value(s.last_i) AS last_i
        FROM cuts c JOIN sums f ON f.doc_id = c.doc_id AND f.i = c.a
        JOIN sums s ON s.doc_id = c.doc_id AND s.i >= c.must
          AND (s.i = c.must OR s.upto - f.upto + f.n <= {size})
        GROUP BY c.doc_id, c.win) c
  JOIN sums e ON e.doc_id = c.doc_id AND e.i = c.b
  JOIN sums t ON t.doc_id = c.doc_id AND t.i <= c.b + 1 AND (t.i = c.b + 1 OR e.upto - t.upto + t.n <= {overlap})
  WHERE c.b < c.last_i
  GROUP BY c.doc_id),
bounds AS (
  SELECT c.doc_id, c.win, c.a, max(s.i) AS b
  FROM cuts c JOIN sums f ON f.doc_id = c.doc_id AND f.i = c.a
  JOIN sums s ON s.doc_id = c.doc_id AND s.i >= c.must AND (s.i = c.must OR s.upto - f.upto + f.n <= {size})
  GROUP BY c.doc_id, c.win, c.a)
SELECT b.doc_id, b.win, sum(s.n)::BIGINT AS n_tokens, string_agg(s.text, ' ' ORDER BY s.i) AS text
FROM bounds b JOIN sums s ON s.doc_id = b.doc_id AND s.i BETWEEN b.a AND b.b GROUP BY b.doc_id, b.win"""


@query("sentence_windows", _sentence_windows_sql(128, 20))
def sentence_windows(spark: SparkSession, sf: str) -> DataFrame:
    return windows.sentence_windows(views.documents(spark, sf), 128, 20)
