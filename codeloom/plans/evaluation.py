"""Queries over evaluation sheets, scores and blind pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import enrich, evaluate, metrics
from codeloom.plans import sql as S
from codeloom.plans import flows, views
from codeloom.plans.registry import query
from codeloom.sources import chunk_store
from codeloom.workspace import fresh_dir


@query(
    "eval_unpivot",
    f"WITH {S.CONVERSATIONS}, placed AS (SELECT repo || '-' || ((n - 1) // 5) AS project, (n - 1) % 5 + 1 AS i, * FROM eval_long) "
    "SELECT p.project AS repo, r.i AS n, e.question, e.reference "
    "FROM (SELECT DISTINCT project FROM placed) p CROSS JOIN range(1, 6) r(i) "
    "LEFT JOIN placed e ON e.project = p.project AND e.i = r.i",
)
def eval_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.unpivot_sheet(views.eval_wide(spark, sf))


def answered(spark: SparkSession, sf: str) -> DataFrame:
    """(repo, n, question, reference, mode, response) where both texts are there."""
    long = evaluate.long_responses(views.eval_pairs(spark, sf))
    return long.dropna(subset=["response", "reference"])


_13A = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace("
    "' ' || replace(replace({0}, '-' || chr(10), ''), chr(10), ' ') || ' ', "
    r"'([\{{-~\[-` -&\(-\+:-@/])', ' \1 ', 'g'), "
    r"'([^0-9])([.,])', '\1 \2 ', 'g'), "
    r"'([.,])([^0-9])', ' \1 \2', 'g'), "
    r"'([0-9])(-)', '\1 \2 ', 'g')"
)


def _tokens_13a(column: str) -> str:
    return rf"list_filter(regexp_split_to_array({_13A.format(column)}, '\s+'), lambda t: t <> '')"


BLEU = f"""
tok AS (SELECT repo, n, mode, {_tokens_13a('response')} AS p, {_tokens_13a('reference')} AS r FROM full_pairs),
orders(o) AS (VALUES (1), (2), (3), (4)),
grams AS (
  SELECT repo, n, mode, o, 'p' AS side, unnest(list_transform(range(1, len(p) - o + 2), lambda i: array_to_string(p[i : i + o - 1], ' '))) AS g
  FROM tok, orders WHERE len(p) >= o
  UNION ALL
  SELECT repo, n, mode, o, 'r', unnest(list_transform(range(1, len(r) - o + 2), lambda i: array_to_string(r[i : i + o - 1], ' ')))
  FROM tok, orders WHERE len(r) >= o),
matched AS (
  SELECT repo, n, mode, o, sum(least(np, nr)) AS m
  FROM (SELECT repo, n, mode, o, g, count(*) FILTER (side = 'p') AS np, count(*) FILTER (side = 'r') AS nr
        FROM grams GROUP BY ALL) GROUP BY ALL),
bleu_scores AS (
  SELECT t.repo, t.n, t.mode,
         CASE WHEN count(*) FILTER (m > 0) = 4 THEN
           exp(sum(ln(m / (len(p) - o + 1))) FILTER (m > 0) / 4)
           * CASE WHEN len(p) > len(r) THEN 1.0 ELSE exp(1 - len(r) / len(p)::DOUBLE) END
         ELSE 0.0 END::DOUBLE AS bleu
  FROM tok t LEFT JOIN matched m USING (repo, n, mode) GROUP BY t.repo, t.n, t.mode, p, r)"""

POOLED = """
pooled AS (
  SELECT t.repo, t.mode, o, sum(greatest(len(p) - o + 1, 0)) AS grams, sum(coalesce(m, 0)) AS m
  FROM tok t CROSS JOIN orders LEFT JOIN matched x USING (repo, n, mode, o) GROUP BY t.repo, t.mode, o),
pooled_lengths AS (SELECT repo, mode, sum(len(p)) AS np, sum(len(r)) AS nr FROM tok GROUP BY repo, mode),
pooled_scores AS (
  SELECT repo, mode, CASE WHEN min(m) > 0 THEN exp(sum(ln(m / grams)) FILTER (m > 0) / 4)
           * CASE WHEN any_value(np) > any_value(nr) THEN 1.0 ELSE exp(1 - any_value(nr) / any_value(np)::DOUBLE) END
         ELSE 0.0 END::DOUBLE AS corpus_bleu
  FROM pooled JOIN pooled_lengths USING (repo, mode) GROUP BY repo, mode)"""


def _dp(name: str, tokens_p: str, tokens_r: str, edits: bool) -> str:
    """``name``: (repo, n, mode, v) after a row-by-row dynamic program over whole texts.

    A row of the table is a set of rows (j, v); the running dependence on the cell
    to the left is a prefix maximum (subsequence) or minimum of v - j (edits).
    """
    if edits:
        first = "j"
        cand = "CASE WHEN j = 0 THEN i + 1 ELSE least(v + 1, left_v + CASE WHEN a = b THEN 0 ELSE 1 END) END"
        fold = "j + min(cand - j) OVER (PARTITION BY id ORDER BY j)"
    else:
        first = "0"
        cand = "CASE WHEN j > 0 AND a = b THEN left_v + 1 ELSE v END"
        fold = "max(cand) OVER (PARTITION BY id ORDER BY j)"
    return f"""
{name}_tok AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY repo, n, mode) AS id, repo, n, mode, {tokens_p} AS p, {tokens_r} AS r FROM full_pairs),
{name}_p AS MATERIALIZED (SELECT id, unnest(p) AS a, unnest(range(len(p))) AS i FROM {name}_tok),
{name}_r AS MATERIALIZED (
  SELECT id, 0::BIGINT AS j, NULL::VARCHAR AS b FROM {name}_tok
  UNION ALL SELECT id, unnest(range(1, len(r) + 1)), unnest(r) FROM {name}_tok),
{name}_rows AS (
  SELECT id, 0::BIGINT AS i, j, {first}::BIGINT AS v, b FROM {name}_r
  UNION ALL
  SELECT id, i + 1, j, ({fold})::BIGINT, b
  FROM (SELECT id, i, j, b, {cand} AS cand
        FROM (SELECT w.id, w.i, w.j, w.v, w.b, t.a, lag(w.v) OVER (PARTITION BY w.id ORDER BY w.j) AS left_v
              FROM {name}_rows w JOIN {name}_p t ON t.id = w.id AND t.i = w.i))),
{name} AS (
  SELECT t.repo, t.n, t.mode, w.v, len(t.p) AS np, len(t.r) AS nr
  FROM {name}_tok t JOIN {name}_rows w ON w.id = t.id AND w.i = len(t.p) AND w.j = len(t.r))"""


def _rouge_tokens(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '({metrics.ROUGE_TOKEN})', 1)"


def _ter_tokens(c: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({c}), '\s+'), lambda t: t <> '')"


ROUGE = (
    _dp("lcs", _rouge_tokens("response"), _rouge_tokens("reference"), edits=False)
    + """,
rouge_scores AS (
  SELECT repo, n, mode, CASE WHEN v > 0 THEN 2.0 * (v / np) * (v / nr) / (v / np + v / nr) ELSE 0.0 END::DOUBLE AS rouge_l
  FROM lcs)"""
)
EDITS = (
    _dp("edits", _ter_tokens("response"), _ter_tokens("reference"), edits=True)
    + """,
edit_scores AS (
  SELECT repo, n, mode, v AS edits, CASE WHEN nr > 0 THEN 100.0 * v / nr WHEN v > 0 THEN 100.0 ELSE 0.0 END::DOUBLE AS word_edit_rate
  FROM edits)"""
)


@query("bleu", f"WITH {S.CONVERSATIONS},{BLEU} SELECT repo, n, mode, round(bleu, 6) AS bleu FROM bleu_scores")
def bleu(spark: SparkSession, sf: str) -> DataFrame:
    counts = metrics.bleu_counts(F.col("response"), F.col("reference"))
    return answered(spark, sf).withColumn("c", counts).select(
        "repo", "n", "mode", F.round(metrics.bleu_score(F.col("c")), 6).alias("bleu")
    )


@query(
    "rouge_l",
    f"WITH RECURSIVE {S.CONVERSATIONS},{ROUGE} SELECT repo, n, mode, round(rouge_l, 6) AS rouge_l FROM rouge_scores",
)
def rouge_l(spark: SparkSession, sf: str) -> DataFrame:
    score = metrics.rouge_l(F.col("response"), F.col("reference"))
    return answered(spark, sf).select("repo", "n", "mode", F.round(score, 6).alias("rouge_l"))


@query(
    "word_edit_rate",
    f"WITH RECURSIVE {S.CONVERSATIONS},{EDITS} SELECT repo, n, mode, round(word_edit_rate, 6) AS word_edit_rate FROM edit_scores",
)
def word_edit_rate(spark: SparkSession, sf: str) -> DataFrame:
    score = metrics.word_edit_rate(F.col("response"), F.col("reference"))
    return answered(spark, sf).select("repo", "n", "mode", F.round(score, 6).alias("word_edit_rate"))


BOUNDS = f"""
ter_tok AS (SELECT repo, n, mode, {_ter_tokens('response')} AS p, {_ter_tokens('reference')} AS r FROM full_pairs),
ter_common AS (
  SELECT repo, n, mode, sum(least(np, nr))::BIGINT AS common FROM (
    SELECT repo, n, mode, w, count(*) FILTER (side = 'p') AS np, count(*) FILTER (side = 'r') AS nr FROM (
      SELECT repo, n, mode, unnest(p) AS w, 'p' AS side FROM ter_tok
      UNION ALL SELECT repo, n, mode, unnest(r), 'r' FROM ter_tok) GROUP BY ALL) GROUP BY ALL),
ter_bounds AS (
  SELECT t.repo, t.n, t.mode, greatest(len(p), len(r)) - coalesce(common, 0) AS missing,
         CASE WHEN len(r) > 0 THEN 100.0 * missing / len(r) WHEN len(p) > 0 THEN 100.0 ELSE 0.0 END::DOUBLE AS lowest
  FROM ter_tok t LEFT JOIN ter_common c ON c.repo = t.repo AND c.n = t.n AND c.mode = t.mode)"""


@query(
    "ter",
    f"WITH RECURSIVE {S.CONVERSATIONS},{EDITS},{BOUNDS} SELECT repo, n, mode, round(lowest, 6) AS lowest, "
    "round(word_edit_rate, 6) AS highest, true AS between, "
    "CASE WHEN round(lowest, 6) = round(word_edit_rate, 6) THEN round(lowest, 6) END AS ter_if_certain "
    "FROM ter_bounds JOIN edit_scores USING (repo, n, mode)",
)
def ter(spark: SparkSession, sf: str) -> DataFrame:
    """The rate with block moves, which no SQL gives, between what the words in common
    leave and the rate without moves; and its value where these two agree.
    """
    p, r = F.col("response"), F.col("reference")
    scored = answered(spark, sf).select(
        "repo", "n", "mode", F.round(metrics.bag_error_rate(p, r), 6).alias("lowest"),
        F.round(metrics.word_edit_rate(p, r), 6).alias("highest"), F.round(metrics.ter(p, r), 6).alias("ter"),
    )
    return scored.select(
        "repo", "n", "mode", "lowest", "highest", F.col("ter").between(F.col("lowest"), F.col("highest")).alias("between"),
        F.when(F.col("lowest") == F.col("highest"), F.col("ter")).alias("ter_if_certain"),
    )


SCORES = f"""{BLEU},{ROUGE},{EDITS},
scores AS (
  SELECT p.repo, p.n, p.mode, bleu, rouge_l, word_edit_rate
  FROM pairs p LEFT JOIN bleu_scores USING (repo, n, mode) LEFT JOIN rouge_scores USING (repo, n, mode)
  LEFT JOIN edit_scores USING (repo, n, mode))"""


def all_scores(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.score_responses(evaluate.long_responses(views.eval_pairs(spark, sf)))


@query(
    "score_responses",
    f"WITH RECURSIVE {S.CONVERSATIONS},{SCORES} SELECT repo, n, max(round(bleu, 6)) FILTER (mode = 'smart') AS smart_bleu, "
    "max(round(bleu, 6)) FILTER (mode = 'naive') AS naive_bleu, "
    "max(round(rouge_l, 6)) FILTER (mode = 'smart') AS smart_rouge_l, "
    "max(round(rouge_l, 6)) FILTER (mode = 'naive') AS naive_rouge_l, "
    "count(bleu) FILTER (mode = 'smart') > 0 AS smart_has_ter, count(bleu) FILTER (mode = 'naive') > 0 AS naive_has_ter "
    "FROM scores GROUP BY repo, n",
)
def score_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of both modes as nested metrics, shown flat."""
    nested = evaluate.nested_metrics(all_scores(spark, sf), ["repo", "n"])
    return nested.select(
        "repo",
        "n",
        *[
            F.round(f"metrics.{mode}.{field}", 6).alias(f"{mode}_{name}")
            for mode in evaluate.MODES
            for field, name in (("bleu", "bleu"), ("rougeL", "rouge_l"))
        ],
        *[F.col(f"metrics.{mode}.ter").isNotNull().alias(f"{mode}_has_ter") for mode in evaluate.MODES],
    )


AB = """
ab AS (
  SELECT *, CASE WHEN coin = 0 THEN 'smart' ELSE 'naive' END AS first_mode,
         CASE WHEN coin = 0 THEN smart_response ELSE naive_response END AS response_a,
         CASE WHEN coin = 0 THEN naive_response ELSE smart_response END AS response_b
  FROM (SELECT *, ('0x' || substr(md5(repo || '|' || n || '|0'), 1, 8))::BIGINT % 2 AS coin FROM eval_long
        WHERE question IS NOT NULL AND smart_response IS NOT NULL AND naive_response IS NOT NULL)),
judged AS (
  SELECT *, CASE WHEN length(response_a) >= length(response_b) THEN 'A' ELSE 'B' END AS choice FROM ab),
chosen AS (
  SELECT *, CASE WHEN (choice = 'A') = (first_mode = 'smart') THEN 'smart' ELSE 'naive' END AS chosen_mode FROM judged)"""


def blind_pairs(spark: SparkSession, sf: str) -> DataFrame:
    asked = views.eval_long(spark, sf).dropna(subset=["question", "smart_response", "naive_response"])
    return evaluate.ab_pairs(asked, ["repo", "n"])


def choices(spark: SparkSession, sf: str) -> DataFrame:
    judged = blind_pairs(spark, sf).withColumn(
        "choice", evaluate.longer_response(F.col("response_a"), F.col("response_b"))
    )
    return judged.withColumn("chosen_mode", evaluate.chosen_mode(F.col("choice"), F.col("first_mode")))


@query(
    "ab_pairs",
    f"WITH {S.CONVERSATIONS},{AB} SELECT repo, n, first_mode, response_a, response_b FROM ab",
)
def ab_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return blind_pairs(spark, sf).select("repo", "n", "first_mode", "response_a", "response_b")


@query(
    "ab_choice",
    f"""WITH {S.CONVERSATIONS},{AB}
    SELECT repo, n, CASE n % 4 WHEN 0 THEN ' ' || choice || ' ' WHEN 1 THEN 'both' ELSE choice END AS reply,
           CASE WHEN n % 4 <> 1 THEN chosen_mode END AS chosen_mode FROM chosen""",
)
def ab_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Replies as judges give them: bare, within blanks, or neither A nor B."""
    n = F.col("n") % 4
    reply = F.when(n == 0, F.concat(F.lit(" "), "choice", F.lit(" "))).when(n == 1, "both").otherwise(F.col("choice"))
    return choices(spark, sf).select(
        "repo", "n", reply.alias("reply"), evaluate.chosen_mode(reply, F.col("first_mode")).alias("chosen_mode")
    )


def _unsure(frame: pd.DataFrame) -> pd.Series:
    """A caller's function that fails on long questions."""
    if (frame["question"].str.len() > 120).any():
        raise ValueError("too long")
    return frame["question"].str.len().astype(str)


@query(
    "eval_partial",
    f"WITH {S.CONVERSATIONS} SELECT repo, n, question, CASE WHEN length(question) <= 120 THEN length(question)::VARCHAR END AS answer, "
    "CASE WHEN length(question) > 120 THEN 'ValueError: too long' END AS error FROM eval_long WHERE question IS NOT NULL",
)
def eval_partial(spark: SparkSession, sf: str) -> DataFrame:
    """Every question, with its answer or with what went wrong."""
    asked = views.eval_long(spark, sf).select("repo", "n", "question").dropna(subset=["question"])
    done, failed = enrich.split_errors(enrich.batch_map(asked, _unsure, ["question"], "answer", "string"))
    answers = evaluate.partial_results(asked, done.drop("question"), ["repo", "n"])
    return evaluate.partial_results(answers, failed.select("repo", "n", "error"), ["repo", "n"])


@query(
    "eval_report",
    f"""WITH RECURSIVE {S.CONVERSATIONS},{SCORES},{POOLED},{AB}
    SELECT s.repo, s.mode, count(bleu) AS n_scored, round(avg(bleu), 6) AS bleu, round(any_value(corpus_bleu), 6) AS corpus_bleu,
           round(avg(rouge_l), 6) AS rouge_l,
           round(avg(word_edit_rate), 6) AS word_edit_rate,
           count(bleu) AS n_ter, CASE WHEN count(bleu) > 0 THEN true END AS ter_bounded,
           count(*) FILTER (chosen_mode = s.mode) AS n_preferred,
           round(count(*) FILTER (chosen_mode = s.mode) / nullif(count(chosen_mode), 0)::DOUBLE, 6) AS preference_share
    FROM scores s LEFT JOIN chosen c ON c.repo = s.repo AND c.n = s.n
    LEFT JOIN pooled_scores o ON o.repo = s.repo AND o.mode = s.mode GROUP BY s.repo, s.mode""",
)
def eval_report(spark: SparkSession, sf: str) -> DataFrame:
    judged = choices(spark, sf).select("repo", "n", "chosen_mode")
    scored = evaluate.partial_results(all_scores(spark, sf), judged, ["repo", "n"])
    report = evaluate.eval_report(scored, ["repo"])
    rounded = [F.round(c, 6).alias(c) for c in ("bleu", "corpus_bleu", "rouge_l", "word_edit_rate", "preference_share")]
    # No SQL gives the rate with block moves: shown are its count and its bound.
    bounded = (F.col("ter") <= F.col("word_edit_rate") + 1e-9).alias("ter_bounded")
    return report.select("repo", "mode", "n_scored", "n_ter", "n_preferred", bounded, *rounded)


@query(
    "results_document",
    f"""WITH RECURSIVE {S.CONVERSATIONS},{BLEU},{AB}
    SELECT e.repo, e.n, e.question, e.reference, e.smart_response, e.naive_response,
           round(s.bleu, 6) AS smart_bleu, round(b.bleu, 6) AS naive_bleu, c.chosen_mode,
           s.bleu IS NOT NULL AS smart_has_ter, b.bleu IS NOT NULL AS naive_has_ter
    FROM eval_long e LEFT JOIN bleu_scores s ON s.repo = e.repo AND s.n = e.n AND s.mode = 'smart'
    LEFT JOIN bleu_scores b ON b.repo = e.repo AND b.n = e.n AND b.mode = 'naive'
    LEFT JOIN chosen c ON c.repo = e.repo AND c.n = e.n""",
)
def results_document(spark: SparkSession, sf: str) -> DataFrame:
    """Nested results written as JSON by repository, read back and flattened."""
    long = views.eval_long(spark, sf)
    results = flows.evaluate_answers(
        long.select("repo", "n", "question", "reference"),
        long.select("repo", "n", "smart_response", "naive_response"),
    )
    document = chunk_store.result_document(results)
    path = fresh_dir(spark, "results")
    chunk_store.write_results(document, path)
    back = chunk_store.read_results(spark, path, document.schema)
    return back.withColumns(
        {
            "smart_bleu": F.round("smart_bleu", 6),
            "naive_bleu": F.round("naive_bleu", 6),
            "smart_has_ter": F.col("smart_ter").isNotNull(),
            "naive_has_ter": F.col("naive_ter").isNotNull(),
        }
    ).drop("smart_ter", "naive_ter")
