"""SQL of the views, as common table expressions to put behind ``WITH RECURSIVE``."""

# Words and tokens, as in functions/text.py.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
WORD = r"[\p{L}\p{N}_]+"
BLANKS = "' ' || chr(9) || chr(13) || chr(10)"

CORPUS = """
corpus AS (
  SELECT doc_id AS seq, 'org' || (doc_id % 3) || '/' || source AS repo,
         CASE lang WHEN 'en' THEN 'python' WHEN 'de' THEN 'java' WHEN 'fr' THEN 'go'
                   WHEN 'es' THEN 'ruby' END AS language,
         CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'test' ELSE 'valid' END AS split,
         'd' || doc_id || CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.java' WHEN 'fr' THEN '.go'
                                    WHEN 'es' THEN '.rb' END AS path,
         text
  FROM documents)"""

URLS = """
urls AS (
  SELECT 'https://github.com/' || repo || '.git' AS url FROM corpus
  UNION ALL SELECT 'https://github.com/' || repo || '/blob/main/' || seq || '.py' FROM corpus
  UNION ALL SELECT url FROM pages)"""

LINES = """
doc_lines AS (
  SELECT doc_id, ln, line,
         coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY ln
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s,
         ln = max(ln) OVER (PARTITION BY doc_id) AS is_last
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               unnest(range(len(string_split(text, chr(10))))) AS ln FROM documents))"""

LINE_ENDS = """
line_ends AS (
  SELECT doc_id, s + length(line) + CASE WHEN is_last THEN 0 ELSE 1 END AS e
  FROM doc_lines WHERE NOT (is_last AND line = ''))"""

NODES = LINES + r""",
doc_parts AS (
  SELECT doc_id, ln, sn, part, line_start +
         coalesce(sum(length(part) + 1) OVER (PARTITION BY doc_id, ln ORDER BY sn
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s
  FROM (SELECT doc_id, ln, s AS line_start,
               unnest(string_split(marked, chr(10))) AS part,
               unnest(range(len(string_split(marked, chr(10))))) AS sn
        FROM (SELECT *, regexp_replace(line, '([.!?]) ', '\1' || chr(10), 'g') AS marked FROM doc_lines))),
nodes AS (
  SELECT doc_id, '0' AS node_id, NULL AS parent_id, 0 AS depth, 0 AS ord, 'document' AS kind,
         0::BIGINT AS s, length(text) AS e FROM documents
  UNION ALL
  SELECT doc_id, '0.' || ln, '0', 1, ln, 'line', s, s + length(line) FROM doc_lines WHERE length(line) > 0
  UNION ALL
  SELECT doc_id, '0.' || ln || '.' || sn, '0.' || ln, 2, sn, 'sentence', s, s + length(part)
  FROM doc_parts WHERE length(part) > 0)"""


def packed(max_chars: int) -> str:
    """``spans``: the recursive walk, child by child, of every node that is entered."""
    return (
        NODES
        + f""",
heads AS (SELECT doc_id, node_id, s, e FROM nodes WHERE parent_id IS NULL OR e - s > {max_chars}),
kids AS MATERIALIZED (
  SELECT c.doc_id, c.parent_id, c.s, c.e, c.e - c.s > {max_chars} AS big,
         row_number() OVER (PARTITION BY c.doc_id, c.parent_id ORDER BY c.ord) AS i
  FROM nodes c JOIN heads h ON h.doc_id = c.doc_id AND h.node_id = c.parent_id),
walk AS (
  SELECT doc_id, node_id, 0::BIGINT AS i, s AS cs, s AS ce, NULL::BIGINT AS es, NULL::BIGINT AS ee FROM heads
  UNION ALL
  SELECT w.doc_id, w.node_id, k.i,
         CASE WHEN k.big THEN k.e WHEN k.e - k.s + w.ce - w.cs > {max_chars} THEN k.s ELSE w.cs END,
         k.e,
         CASE WHEN k.big OR k.e - k.s + w.ce - w.cs > {max_chars} THEN w.cs END,
         CASE WHEN k.big OR k.e - k.s + w.ce - w.cs > {max_chars} THEN w.ce END
  FROM walk w JOIN kids k ON k.doc_id = w.doc_id AND k.parent_id = w.node_id AND k.i = w.i + 1),
spans AS (
  SELECT doc_id, es AS s, ee AS e FROM walk WHERE es IS NOT NULL
  UNION ALL
  SELECT doc_id, arg_max(cs, i), arg_max(ce, i) FROM walk GROUP BY doc_id, node_id)"""
    )


FILLED = """
filled AS (
  SELECT doc_id, s, coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY s, e), e) AS e FROM spans)"""


def coalesced(limit: int, blanks: bool, source: str = "filled") -> str:
    """``merged``: spans of ``source`` merged one by one, in order."""
    size = "length(piece)" if blanks else r"length(regexp_replace(piece, '\s', '', 'g'))"
    return f"""
pieces AS MATERIALIZED (
  SELECT doc_id, i, e, {size} AS size, contains(piece, chr(10)) AS has_nl
  FROM (SELECT f.doc_id, f.i, f.e, substring(d.text, f.prev + 1, f.e - f.prev) AS piece
        FROM (SELECT doc_id, s, e, row_number() OVER (PARTITION BY doc_id ORDER BY s, e) AS i,
                     coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s, e), 0) AS prev
              FROM {source}) f JOIN documents d USING (doc_id))),
merging AS (
  SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS cs, 0::BIGINT AS ce, 0::BIGINT AS size, false AS has_nl,
         NULL::BIGINT AS es, NULL::BIGINT AS ee FROM documents
  UNION ALL
  SELECT m.doc_id, p.i,
         CASE WHEN m.size + p.size > {limit} AND (m.has_nl OR p.has_nl) THEN p.e ELSE m.cs END, p.e,
         CASE WHEN m.size + p.size > {limit} AND (m.has_nl OR p.has_nl) THEN 0 ELSE m.size + p.size END,
         CASE WHEN m.size + p.size > {limit} AND (m.has_nl OR p.has_nl) THEN false ELSE m.has_nl OR p.has_nl END,
         CASE WHEN m.size + p.size > {limit} AND (m.has_nl OR p.has_nl) THEN m.cs END,
         CASE WHEN m.size + p.size > {limit} AND (m.has_nl OR p.has_nl) THEN p.e END
  FROM merging m JOIN pieces p ON p.doc_id = m.doc_id AND p.i = m.i + 1),
merged AS (
  SELECT doc_id, es AS s, ee AS e FROM merging WHERE es IS NOT NULL AND ee > es
  UNION ALL
  SELECT * FROM (SELECT doc_id, arg_max(cs, i) AS s, arg_max(ce, i) AS e FROM merging GROUP BY doc_id) WHERE e > s)"""


def lined(source: str) -> str:
    """``lined``: 0-based lines of both ends of the spans of ``source``."""
    return (
        LINE_ENDS
        + f""",
lined AS (
  SELECT x.doc_id, x.s, x.e, count(*) FILTER (l.e <= x.s) AS start_line, count(*) FILTER (l.e <= x.e) AS end_line
  FROM (SELECT *, row_number() OVER () AS rid FROM {source}) x
  LEFT JOIN line_ends l ON l.doc_id = x.doc_id
  GROUP BY x.doc_id, x.s, x.e, x.rid)"""
    )


def structural(max_chars: int = 1536, limit: int = 50) -> str:
    """``chunks``: the full structural chunker."""
    return (
        f"{packed(max_chars)},{FILLED},{coalesced(limit, False)},{lined('merged')}"
        + """,
chunks AS (
  SELECT l.doc_id, l.s, l.e, l.start_line, l.end_line, substring(d.text, l.s + 1, l.e - l.s) AS text
  FROM lined l JOIN documents d USING (doc_id) WHERE l.end_line > l.start_line)"""
    )


def windowed(size: int = 512, overlap: int = 20, source: str = "documents", key: str = "doc_id") -> str:
    """``windows``: token windows of the texts of ``source``."""
    step = size - overlap
    return f"""
tokenized AS (
  SELECT {key}, regexp_extract_all(text, '((?:{TOKEN})\\s*)', 1) AS toks FROM {source}),
windows AS (
  SELECT {key}, win, win * {step} AS first_token, least({size}, n - win * {step}) AS n_tokens,
         rtrim(array_to_string(toks[win * {step} + 1 : win * {step} + {size}], ''), {BLANKS}) AS text
  FROM (SELECT {key}, toks, len(toks) AS n,
               unnest(range(greatest(ceil((len(toks) - {overlap}) / {step}::DOUBLE)::BIGINT, 1))) AS win
        FROM tokenized WHERE len(toks) > 0))"""


def hashed(name: str, source: str, key: str, text: str, dim: int = 1024) -> str:
    """``name``: non-zero (key, bucket, w) of the built-in embedding of ``text``."""
    return f"""
{name} AS (
  SELECT {key}, bucket, (n / sqrt(sum(n * n) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS w
  FROM (SELECT {key}, bucket, count(*)::DOUBLE AS n
        FROM (SELECT {key}, ('0x' || substr(md5(word), 1, 8))::BIGINT % {dim} AS bucket
              FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '({WORD})', 1)) AS word FROM {source}))
        GROUP BY {key}, bucket))"""


def nearest(name: str, queries: str, collection: str, q: str, c: str, ids: str, k: int = 5) -> str:
    """``name``: (q, id, score, rank) of the k best rows by cosine, of sparse vectors.

    ``ids`` is a table of all ids ``c``, so that rows without a common bucket count
    with a score of 0.
    """
    return f"""
{name}_norms AS (SELECT {c}, sqrt(sum(w * w)) AS norm FROM {collection} GROUP BY {c}),
{name}_qnorms AS (SELECT {q}, sqrt(sum(w * w)) AS norm FROM {queries} GROUP BY {q}),
{name}_dots AS (
  SELECT a.{q}, b.{c}, sum(a.w * b.w) AS d FROM {queries} a JOIN {collection} b USING (bucket)
  GROUP BY a.{q}, b.{c}),
{name} AS (
  SELECT {q}, {c}, score, rank FROM (
    SELECT {q}, {c}, score, row_number() OVER (PARTITION BY {q} ORDER BY score DESC, {c}) AS rank
    FROM (SELECT a.{q}, i.{c}, round(coalesce(d.d / (a.norm * n.norm), 0), 9) AS score
          FROM {name}_qnorms a CROSS JOIN {ids} i
          LEFT JOIN {name}_dots d ON d.{q} = a.{q} AND d.{c} = i.{c}
          LEFT JOIN {name}_norms n ON n.{c} = i.{c}))
  WHERE rank <= {k})"""


def summarized(name: str, source: str, key: str, text: str = "text") -> str:
    """``name``: (key, summary) of the most telling sentences, up to 150 words."""
    return rf"""
{name}_sentences AS (
  SELECT {key}, i, sentence, len(regexp_split_to_array(sentence, '\s+')) AS n,
         regexp_extract_all(lower(sentence), '({WORD})', 1) AS words
  FROM (SELECT {key}, unnest(parts) AS sentence, unnest(range(len(parts))) AS i
        FROM (SELECT {key}, list_filter(list_transform(
                string_split(regexp_replace({text}, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)),
                lambda x: trim(x)), lambda x: x <> '') AS parts FROM {source}))),
{name}_words AS (SELECT {key}, i, unnest(words) AS word FROM {name}_sentences),
{name}_counts AS (SELECT {key}, word, count(*) AS c FROM {name}_words GROUP BY ALL),
{name}_scores AS (
  SELECT {key}, i, sum(c)::DOUBLE / count(*) AS score FROM {name}_words JOIN {name}_counts USING ({key}, word) GROUP BY ALL),
{name}_running AS (
  SELECT *, row_number() OVER ranked AS place, sum(n) OVER ranked AS upto
  FROM {name}_sentences LEFT JOIN {name}_scores USING ({key}, i)
  WINDOW ranked AS (PARTITION BY {key} ORDER BY coalesce(score, 0) DESC, i ROWS UNBOUNDED PRECEDING)),
{name} AS (
  SELECT s.{key}, coalesce(
    string_agg(sentence, ' ' ORDER BY i) FILTER (upto <= 150),
    array_to_string(regexp_split_to_array(max(sentence) FILTER (place = 1), '\s+')[1:150], ' '), '') AS summary
  FROM {source} s LEFT JOIN {name}_running r ON r.{key} = s.{key} GROUP BY s.{key})"""


CODE = """
code_parts AS (
  SELECT 'shop/' || brand AS repo, brand || '_' || (p_partkey // 1000) || '.py' AS path, *
  FROM (SELECT p_partkey, p_type, p_size, lower(replace(p_brand, '#', '_')) AS brand,
               replace(p_name, ' ', '_') || '_' || p_partkey AS fn,
               round(p_retailprice * 100)::BIGINT AS cents FROM part)),
code_lines AS (
  SELECT repo, path, line, row_number() OVER (PARTITION BY path ORDER BY p_type, p_partkey, sub) - 1 AS ln
  FROM (SELECT repo, path, p_type, p_partkey, unnest(range(8)) AS sub, unnest([
          CASE WHEN p_partkey = min(p_partkey) OVER (PARTITION BY path, p_type)
               THEN 'class ' || upper(p_type[1]) || lower(p_type[2:]) || ':' END,
          CASE WHEN p_size % 7 = 0 THEN '    @traced' END,
          '    def ' || fn || '(self, qty):',
          '        \"\"\"Price of one order.\"\"\"',
          '        if qty > ' || p_size || ':',
          '            return qty * ' || cents,
          '',
          '        return 0']) AS line
        FROM code_parts)
  WHERE line IS NOT NULL)"""

# Scopes by comparing every line with every header of its file.
SCOPES = CODE + r""",
marked AS (
  SELECT repo, path, ln, line,
         length(regexp_extract(line, '^ *')) AS ind,
         trim(line) <> '' AS code,
         line LIKE '%def %' OR line LIKE 'class %' AS is_header,
         trim(line) LIKE '@%' AS decorates
  FROM code_lines),
headers AS (
  SELECT m.path, m.ln, m.ind, split_part(trim(m.line), ' ', 1) AS kind,
         regexp_extract(trim(m.line), '^(class|def) (\w+)', 2) AS name,
         (SELECT min(x.ln) FROM marked x WHERE x.path = m.path AND x.code AND x.ln > m.ln
            AND x.ind <= m.ind) AS end_ln,
         c.n
  FROM marked m JOIN (SELECT path, count(*) AS n FROM marked GROUP BY path) c USING (path) WHERE m.is_header),
scopes AS (
  SELECT h.path, h.ln AS scope, h.kind, h.name,
         CASE WHEN d.decorates THEN h.ln - 1 ELSE h.ln END AS first_ln,
         coalesce(h.end_ln, h.n) AS end_ln,
         coalesce(max(p.ln), -1) AS parent, count(p.ln) AS depth
  FROM headers h
  LEFT JOIN headers p ON p.path = h.path AND p.ln < h.ln AND p.ind < h.ind AND coalesce(p.end_ln, p.n) > h.ln
  LEFT JOIN marked d ON d.path = h.path AND d.ln = h.ln - 1
  GROUP BY h.path, h.ln, h.kind, h.name, d.decorates, h.end_ln, h.n),
owned AS (
  SELECT m.path, m.ln, m.line,
         CASE WHEN m.is_header THEN m.ln WHEN m.decorates THEN m.ln + 1
              ELSE coalesce(max(s.ln), -1) END AS owner
  FROM marked m LEFT JOIN headers s ON s.path = m.path AND s.ln < m.ln AND coalesce(s.end_ln, s.n) > m.ln
    AND (NOT m.code OR s.ind < m.ind)
  GROUP BY m.path, m.ln, m.line, m.is_header, m.decorates)"""

CONVERSATIONS = """
turns AS (
  SELECT conv_id, turn, role, text, role = 'user' AS by_user,
         lead(role) OVER in_conv AS next_role,
         last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (in_conv ROWS UNBOUNDED PRECEDING) AS question,
         lag(text) OVER in_role AS back_1, lag(text, 2) OVER in_role AS back_2,
         lead(text) OVER in_role AS on_1, lead(text, 2) OVER in_role AS on_2
  FROM conversations WHERE role IN ('user', 'assistant')
  WINDOW in_conv AS (PARTITION BY conv_id ORDER BY turn, role), in_role AS (PARTITION BY conv_id, role ORDER BY turn)),
eval_long AS (
  SELECT 'proj' || (conv_id // 5) AS repo,
         row_number() OVER (PARTITION BY conv_id // 5 ORDER BY conv_id, turn, role) AS n, question,
         CASE WHEN NOT by_user THEN coalesce(on_1, back_1) END AS reference,
         CASE WHEN NOT by_user THEN text END AS smart_response,
         CASE WHEN NOT by_user THEN coalesce(CASE WHEN on_1 IS NOT NULL THEN back_1 ELSE back_2 END, on_2) END AS naive_response
  FROM turns WHERE NOT by_user OR coalesce(next_role, 'user') = 'user'),
pairs AS (
  SELECT repo, n, 'smart' AS mode, smart_response AS response, reference, question FROM eval_long
  UNION ALL SELECT repo, n, 'naive', naive_response, reference, question FROM eval_long),
full_pairs AS (SELECT * FROM pairs WHERE response IS NOT NULL AND reference IS NOT NULL)"""

LABEL_QUERIES = """
label_means AS (
  SELECT label, pos, avg(v) AS v
  FROM (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS pos FROM embeddings)
  GROUP BY label, pos),
queries AS (
  SELECT label::BIGINT AS q_id, label, list(v ORDER BY pos) AS qv FROM label_means GROUP BY label)"""
