import random
import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from codeloom.functions import prompts, repos, text
from codeloom.operators import enrich


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_urls(spark):
    urls = [
        ("https://github.com/a/b/blob/main/x/blob/y.py", "https://raw.githubusercontent.com/a/b/main/x/blob/y.py"),
        ("https://github.com/a/b", "https://github.com/a/b"),
        ("https://example.org/a/blob/b", "https://example.org/a/blob/b"),
        ("github.com/a/blob/b", "github.com/a/blob/b"),
        ("", ""),
    ]
    found = values(spark, urls, "u string, w string", repos.raw_url(F.col("u")), "w")
    assert all(a == b for a, b in found)
    names = [("https://github.com/o/proj.x.git", "proj"), ("a/b/repo", "repo"), ("plain", "plain")]
    found = values(spark, names, "u string, w string", repos.repo_name(F.col("u")), "w")
    assert all(a == b for a, b in found)


def test_lengths_and_lines(spark):
    rows = [("",), ("a",), ("a\n",), ("é b\n\tc",), ("\n\n",)]
    t = F.col("t")
    found = values(spark, rows, "t string", text.char_length(t), text.non_blank_length(t), text.line_count(t))
    assert found == [(len(s), len("".join(s.split())), len(s.splitlines())) for (s,) in rows]
    rows = [("ab\ncé", i) for i in range(8)]
    found = values(spark, rows, "t string, i int", text.line_of_offset(t, F.col("i")))
    assert [r[0] for r in found] == [0, 0, 0, 1, 1, 2, 2, 2]
    assert values(spark, [("", 0)], "t string, i int", text.line_of_offset(t, F.col("i"))) == [(0,)]


def test_spans(spark):
    rows = [("aé\nb\nc", 1, 3), ("x", 0, 0)]
    t, a, b = F.col("t"), F.col("a"), F.col("b")
    found = values(spark, rows, "t string, a int, b int", text.span_text(t, a, b), text.span_lines(t, a, b))
    assert found == [("é\n", "b\nc"), ("", "")]


def test_prompts(spark):
    rows = [("why?", "ctx 100%", "s", "n")]
    q, c, s, n = (F.col(x) for x in "qcsn")
    found = values(
        spark, rows, "q string, c string, s string, n string",
        prompts.summary_prompt(c), prompts.answer_prompt(q, c), prompts.choice_prompt(q, s, n),
        prompts.short_answer_prompt(q, F.array(s, c)), prompts.question_prompt(q), prompts.preference_prompt(q, s, n),
    )[0]
    assert found[0].endswith("plain english. \n\nctx 100%")
    assert found[1].endswith("Query: why?\n\nContext: ctx 100%")
    assert found[2].endswith("Query: why?\n\nSmart Context: s\n\nNaive Context: n")
    assert "query: 'why?'\n\ns\n\n---\n\nctx 100%\n\nUsing" in found[3]
    assert found[4] == "Answer the query given below only based on the context provided\n\nQuery: why?\n"
    assert 'A user asked: "why?"' in found[5] and "Response A:\ns\n\nResponse B:\nn\n" in found[5]


def test_telling_sentences(spark):
    long = " ".join(f"w{i}" for i in range(200)) + "."
    rows = [("",), ("One two. Three four! Five",), ("A b c. " + long,), (long,), (None,), (" \n\n x. \n",),
            ("Red fox. Blue cat. The cat saw the cat. Cat.",)]
    found = [r[0] for r in values(spark, rows, "t string", enrich.telling_sentences(F.col("t"), 5))]
    assert found == ["", "One two. Three four! Five", "A b c.", "w0 w1 w2 w3 w4", "", "x.", "Cat."]
    whole = values(spark, [(long,)], "t string", enrich.telling_sentences(F.col("t")))[0][0]
    assert len(whole.split()) == 150


def test_summary_reads_to_the_end(spark):
    filler = [f"Word{i} other{i} thing{i}." for i in range(400)]
    text = " ".join([*filler, "Key point here.", "Key point."])
    summary = values(spark, [(text,)], "t string", enrich.telling_sentences(F.col("t"), 10))[0][0]
    assert summary.endswith("Key point here. Key point.")


def test_summaries_against_a_plain_loop(spark):
    rng = random.Random(9)
    signs = ["a", "b", "Cc", "dé", " ", " ", ". ", "! ", "?", "\n", "\t", "\x0b", "_9", "😀"]
    rows = [("".join(rng.choice(signs) for _ in range(rng.randrange(120))),) for _ in range(1500)]  # more than are counted together

    def told(text, most):
        found = [s.strip(" ") for s in re.sub(r"([.!?]) ", r"\1\n", text).split("\n")]
        found = [(s, re.findall(r"\w+", s.lower()), re.split(r"\s+", s)) for s in found if s]
        counts = Counter(w for _, words, _ in found for w in words)
        best, total = [], 0
        for i in sorted(range(len(found)), key=lambda i: (-sum(counts[w] for w in found[i][1]) / max(1, len(found[i][1])), i)):
            total += len(found[i][2])
            if total > most and best:
                break
            best.append(i)
        if best and len(found[best[0]][2]) > most:  # kept alone
            return " ".join(found[best[0]][2][:most])
        return " ".join(found[i][0] for i in sorted(best))

    for most in (0, 4, 30):
        made = values(spark, rows, "t string", F.col("t"), enrich.telling_sentences(F.col("t"), most))
        assert [s for _, s in made] == [told(t, most) for t, _ in made]


def test_failing_batches_are_halved(spark):
    calls = spark.sparkContext.accumulator(0)

    def shout(frame: pd.DataFrame) -> pd.Series:
        calls.add(1)
        if (frame["text"] == "bad").any():
            raise RuntimeError("no")
        return frame["text"].str.upper()

    rows = [("bad" if i == 700 else f"t{i}",) for i in range(1024)]
    df = spark.createDataFrame(rows, "text string").coalesce(1)
    out = enrich.batch_map(df, shout, ["text"], "loud", "string").collect()
    assert [r["error"] for r in out if r["error"]] == ["RuntimeError: no"] and len(out) == 1024
    assert calls.value <= 2 * 10 + 1


def test_batch_map_keeps_good_rows(spark):
    def shout(frame: pd.DataFrame) -> pd.Series:
        if (frame["text"] == "bad").any():
            raise RuntimeError("no")
        return frame["text"].str.upper()

    df = spark.createDataFrame([(i, "bad" if i == 3 else f"t{i}") for i in range(8)], "i int, text string").repartition(2)
    done = enrich.batch_map(df, shout, ["text"], "value", "string")
    good, failed = enrich.split_errors(done)
    assert sorted((r["i"], r["value"]) for r in good.collect()) == [(i, f"T{i}") for i in range(8) if i != 3]
    assert [(r["i"], r["value"], r["error"]) for r in failed.collect()] == [(3, None, "RuntimeError: no")]


def test_batch_map_takes_long_texts_in_small_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    df = spark.range(40, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    done = enrich.batch_map(df, lambda f: pd.Series([len(f)] * len(f)), ["text"], "rows", "long")
    sizes = [r["rows"] for r in done.select("rows").collect()]
    assert len(sizes) == 40 and max(sizes) <= 10


def test_batch_map_wants_one_value_per_row(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, text string").coalesce(1)
    done = enrich.batch_map(df, lambda f: pd.Series([7]), ["text"], "value", "long")
    # A function that does not answer per batch is asked row by row.
    assert sorted((r["i"], r["value"]) for r in done.collect()) == [(1, 7), (2, 7)]


def test_caller_functions(spark):
    chunks = spark.createDataFrame([("c1", "some text")], "chunk_id string, text string")
    row = enrich.summarize(chunks, fn=lambda f: f["text"].str[:4]).first()
    assert (row["summary"], row["error"]) == ("some", None)
    asked = spark.createDataFrame([(1, "q", "ctx")], "q_id long, question string, context string")
    row = enrich.answer(asked, None, fn=lambda f: f["question"] + "/" + f["context"]).first()
    assert row["answer"] == "q/ctx"


def test_answer_without_hits(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "b")], "q_id long, question string")
    hits = spark.createDataFrame([(1, 1, "best"), (1, 2, "next")], "q_id long, rank long, summary string")
    found = {r["q_id"]: r["answer"] for r in enrich.answer(asked, hits).collect()}
    assert found == {1: "best", 2: None}


def test_import_needs_no_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=str(pytest.importorskip("pathlib").Path(__file__).parent.parent), capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
