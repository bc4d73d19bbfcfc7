"""Source files of languages with braces, made of parts, and their scopes in SQL.

The lines of a part are templates, expressions that Spark and SQL both understand, with a
tag each. SQL tells scopes by the tags; Spark has to find them in the text, which holds braces in
strings, comments and literals, and lines that begin further left than what they belong to.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.plans import views

# language: extension, kind of the type, whether methods lie in it, and (tag, text). Tags: first and type open a
# type, end closes it; note stands above a method, head opens its head, name has its name, back closes it.
_ALIKE = [
    ("in", "'        if (qty > ' || p_size || ') {'"),
    ("in", "'return qty * ' || cents || ';'"),
    ("in", "'        } else { /* } */ }'"),
    ("in", "''"),
]
LANGUAGES: dict[str, tuple[str, str, bool, list[tuple[str, str]]]] = {
    "java": (".java", "class", True, [
        ("type", "'public final class ' || ty || ' extends Base<Map<String, Long>> {'"),
        ("note", "CASE WHEN p_size % 7 = 0 THEN '    @Traced(\"{\")' END"),
        ("name", "'    public static <T> List<T> ' || fn || '(int qty,'"),
        ("in", "'            String[] names)'"),
        ("in", "'        throws IOException {'"),
        ("in", "'        String s = \"}\" + \\'}\\'; // }'"),
        *_ALIKE, ("back", "'    }'"), ("end", "'}'"),
    ]),
    "c": (".c", "struct", False, [
        ("first", "'struct ' || ty || ' {'"), ("in", "'    int size;'"), ("end", "'};'"),
        ("out", "'#define LIMIT(x) { \\\\'"), ("out", "'    }'"),
        ("head", "'static long'"),
        ("name", "fn || '(int qty)'"),
        ("in", "'{'"),
        ("in", "'    for (int i = 0; i < qty; i++) {'"), ("in", "'        each(item, \"{{\") {'"), ("in", "'        }}'"),
        *_ALIKE, ("back", "'}'"),
    ]),
    "typescript": (".ts", "class", True, [
        ("type", "'export class ' || ty || ' implements Priced {'"),
        ("note", "CASE WHEN p_size % 7 = 0 THEN '    @traced()' END"),
        ("name", "'    private async ' || fn || '(qty: number): Promise<number> {'"),
        ("in", "'        const s = `{'"), ("in", "'$' || '{qty} }`;'"), ("in", "'        items.forEach((x) => {'"), ("in", "'        });'"),
        *_ALIKE, ("back", "'    }'"), ("end", "'}'"),
    ]),
    "php": (".php", "class", True, [
        ("type", "'class ' || ty || ' extends Model {'"),
        ("note", "CASE WHEN p_size % 7 = 0 THEN '    #[Traced(\"}\")]' END"),
        ("name", "'    public function ' || fn || '(array $qty = []): int'"),
        ("in", "'    {'"), ("in", "'        $s = \"several'"), ("in", "'} lines\";  # }'"),
        *_ALIKE, ("back", "'    }'"), ("end", "'}'"),
    ]),
    "go": (".go", "struct", False, [
        ("first", "'type ' || ty || ' struct {'"), ("in", "'\tsize int'"), ("end", "'}'"),
        ("name", "'func (s *Shop) ' || fn || '(qty int) (int, error) {'"),
        ("in", "'\ttext := `}'"), ("in", "'{{`'"),
        *_ALIKE, ("back", "'}'"),
    ]),
}


def _duck(expression: str) -> str:
    """A template for SQL that knows no backslashes in texts."""
    return re.sub(r"\\(.)", lambda m: "''" if m[1] == "'" else m[1], expression)


def brace_files(spark: SparkSession, sf: str) -> DataFrame:
    """(path, language, text): a file for each language, brand and thousand keys."""
    part = views.table(spark, sf, "part").select(
        "p_partkey", "p_type", "p_size", F.initcap(F.lower("p_type")).alias("ty"),
        F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("brand"),
        F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), "p_partkey").alias("fn"),
        F.round(F.col("p_retailprice") * 100).cast("bigint").alias("cents"),
    )
    part = part.withColumn("file", F.concat("brand", F.lit("_"), F.floor(F.col("p_partkey") / 1000)))
    of_type = Window.partitionBy("file", "p_type").orderBy("p_partkey")
    part = part.withColumns({"first": F.row_number().over(of_type) == 1, "last": F.lead("p_partkey").over(of_type).isNull()})
    files = None
    for language, (ext, _, methods, templates) in LANGUAGES.items():
        lines = []
        opening = True
        for tag, expression in templates:
            line = F.expr(expression)
            opening = opening and tag != "end"
            if tag == "type" or tag == "first" or not methods and opening or tag == "end" and not methods:
                line = F.when(F.col("first"), line)
            elif tag == "end":
                line = F.when(F.col("last"), line)
            lines.append(F.struct(line.alias("line")))
        of = part.select("file", "p_type", "p_partkey", F.posexplode(F.array(*lines)).alias("sub", "x")).where("x.line IS NOT NULL")
        ordered = F.array_sort(F.collect_list(F.struct("p_type", "p_partkey", "sub", "x.line")))
        text = F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")
        made = of.groupBy("file").agg(text.alias("text")).select(
            F.concat("file", F.lit(ext)).alias("path"), F.lit(language).alias("language"), "text"
        )
        files = made if files is None else files.unionByName(made)
    return files


def _lines_sql() -> str:
    selects = []
    for language, (ext, kind, methods, templates) in LANGUAGES.items():
        rows = []
        opening = True
        for tag, expression in templates:
            line = _duck(expression)
            opening = opening and tag != "end"
            if tag in ("type", "first") or not methods and (opening or tag == "end"):
                line = f"CASE WHEN is_first THEN {line} END"
            elif tag == "end":
                line = f"CASE WHEN is_last THEN {line} END"
            inner = "type_in" if not methods and opening and tag == "in" else tag
            rows.append(f"{{'tag': '{inner}', 'line': {line}}}")
        selects.append(
            f"SELECT file || '{ext}' AS path, '{language}' AS language, '{kind}' AS type_kind, {str(methods).lower()} AS methods, "
            f"p_type, p_partkey, ty, fn, unnest([{', '.join(rows)}]) AS x, unnest(range({len(rows)})) AS sub FROM brace_parts"
        )
    return " UNION ALL ".join(selects)


#: ``scopes`` and ``owned`` (as for files told by indentation) by the tags of lines.
SCOPES = f"""
brace_parts AS (
  SELECT *, p_partkey = min(p_partkey) OVER (PARTITION BY file, p_type) AS is_first, p_partkey = max(p_partkey) OVER (PARTITION BY file, p_type) AS is_last
  FROM (SELECT p_partkey, p_type, p_size, upper(p_type[1]) || lower(p_type[2:]) AS ty,
               lower(replace(p_brand, '#', '_')) || '_' || (p_partkey // 1000) AS file,
               replace(p_name, ' ', '_') || '_' || p_partkey AS fn, round(p_retailprice * 100)::BIGINT AS cents FROM part)),
brace_lines AS (
  SELECT *, x.tag AS tag, x.line AS line, row_number() OVER (PARTITION BY path ORDER BY p_type, p_partkey, sub) - 1 AS ln
  FROM ({_lines_sql()}) WHERE x.line IS NOT NULL),
types AS (
  SELECT path, p_type, 'type' AS what, any_value(type_kind) AS kind, any_value(ty) AS name, min(ln) FILTER (tag IN ('type', 'first')) AS scope,
         min(ln) FILTER (tag IN ('type', 'first')) AS first_ln, max(ln) FILTER (tag = 'end') + 1 AS end_ln
  FROM brace_lines GROUP BY path, p_type),
functions AS (
  SELECT path, p_type, p_partkey, CASE WHEN any_value(language) = 'go' THEN 'func' ELSE 'function' END AS kind, any_value(fn) AS name,
         min(ln) FILTER (tag = 'name') AS scope, min(ln) FILTER (tag IN ('note', 'head', 'name')) AS first_ln,
         max(ln) FILTER (tag = 'back') + 1 AS end_ln, any_value(methods) AS methods
  FROM brace_lines GROUP BY path, p_type, p_partkey),
scopes AS (
  SELECT path, scope, kind, name, first_ln, end_ln, -1 AS parent, 0 AS depth FROM types
  UNION ALL
  SELECT f.path, f.scope, f.kind, f.name, f.first_ln, f.end_ln, CASE WHEN methods THEN t.scope ELSE -1 END, CASE WHEN methods THEN 1 ELSE 0 END
  FROM functions f JOIN types t USING (path, p_type)),
owned AS (
  SELECT l.path, l.ln, l.line, coalesce(f.scope, t.scope, -1) AS owner
  FROM brace_lines l
  LEFT JOIN functions f ON f.path = l.path AND f.p_partkey = l.p_partkey AND l.ln >= f.first_ln AND l.ln < f.end_ln
  LEFT JOIN types t ON t.path = l.path AND t.p_type = l.p_type AND l.ln >= t.first_ln AND l.ln < t.end_ln)"""
