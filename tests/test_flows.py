"""Files to collections to answers, with built-in and with caller's functions."""

import uuid

import pandas as pd
import pytest

from codeloom.plans import flows
from codeloom.sources import collection
from codeloom.sources.collection import VECTOR_DIM

CODE = """class Cart:
    def total_price(self, items):
        return sum(i.price for i in items)

    def clear(self):
        self.items = []


def send_mail(address, body):
    connect(address).send(body)
"""


@pytest.fixture(scope="module")
def files(spark):
    rows = [("o/shop", "cart.py", "python", CODE), ("p/other", "cart.py", "python", "x = 1\ny = 2"), ("o/shop", "e.py", "python", "")]
    return spark.createDataFrame(rows, "repo string, path string, language string, text string")


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([(1, "total price of items"), (2, "send mail body address")], "q_id long, question string")


@pytest.fixture(scope="module")
def names(files):
    made = {m: f"c_{m}_{uuid.uuid4().hex}" for m in ("smart", "naive", "structural")}
    for mode, name in made.items():
        assert flows.index_files(files, mode, name).count() == 0
    return made


def test_collections(spark, names):
    smart = {(r["repo_name"], r["chunk_lines"]) for r in collection.read(spark, names["smart"]).collect()}
    # Blank lines go with the scope above them.
    assert {("shop", "1-4"), ("shop", "4-8"), ("shop", "8-11"), ("other", "0-2")} <= smart
    for name in names.values():
        rows = collection.read(spark, name).collect()
        assert len({r["id"] for r in rows}) == len(rows) and all(len(r["embedding"]) == VECTOR_DIM for r in rows)
    assert {r["chunk_lines"] for r in collection.read(spark, names["naive"]).collect()} == {"?-?"}


def test_ask(spark, names, questions):
    found = {r["q_id"]: r for r in flows.ask(spark, questions, names["smart"], "smart", k=2).collect()}
    assert "total_price" in found[1]["answer"] and "send_mail" in found[2]["answer"]
    assert found[1]["context"].startswith(found[1]["answer"] + "\n\n")
    other = flows.ask(spark, questions, names["smart"], "smart", repo_name="other").collect()
    assert all("x = 1" in r["context"] and "def" not in r["context"] for r in other)
    none = flows.ask(spark, questions, names["smart"], "smart", repo_name='no"where').collect()
    assert [r["answer"] for r in none] == [None, None]


def test_ask_with_a_model(spark, names, questions):
    def answer(frame: pd.DataFrame) -> pd.Series:
        return frame["question"] + "|" + frame["context"].str.len().astype(str)

    rows = flows.ask(spark, questions, names["naive"], "naive", answer_fn=answer).collect()
    assert all(r["answer"] == f"{r['question']}|{len(r['context'])}" and r["error"] is None for r in rows)


def test_compare(spark, names, questions):
    rows = flows.compare(spark, questions, names["smart"], names["naive"]).collect()
    assert len(rows) == 2 and all(r["choice"] in ("smart", "naive") and r["smart"] and r["naive"] for r in rows)
    judged = flows.compare(
        spark, questions, names["smart"], names["naive"], judge_fn=lambda f: pd.Series(["Naive!"] * len(f))
    )
    assert {r["choice"] for r in judged.collect()} == {"naive"}


def test_failures_are_reported_not_stored(spark, files):
    def summarize(frame: pd.DataFrame) -> pd.Series:
        if frame["text"].str.contains("send_mail").any():
            raise ValueError("model is down")
        return frame["text"].map(lambda t: "s" * 3000 if "total" in t else t[:10])

    def embed(frame: pd.DataFrame) -> pd.Series:
        return frame["summary"].map(lambda s: [1.0] * (VECTOR_DIM if s and s != "x = 1\ny = 2" else 3))

    name = f"c_{uuid.uuid4().hex}"
    reasons = {r["reason"] for r in flows.index_files(files, "smart", name, summarize_fn=summarize, embed_fn=embed).collect()}
    assert reasons == {"ValueError: model is down", "summary is too long", "embedding has the wrong dimension"}
    kept = [r["chunk_code"] for r in collection.read(spark, name).collect()]
    # A field beyond its width is reported, and stored all the same.
    assert not any("send_mail" in t for t in kept) and any("total" in t for t in kept)
    strict = f"c_{uuid.uuid4().hex}"
    report = flows.index_files(files, "smart", strict, summarize_fn=summarize, embed_fn=embed, reject_wide=True)
    assert not any(r["stored"] for r in report.collect())
    assert not any("total" in r["chunk_code"] for r in collection.read(spark, strict).collect())


@pytest.mark.parametrize("mode", ["smart", "naive", "structural"])
def test_files_without_a_path_stay_apart(spark, mode):
    rows = [("o/r", None, "python", "a = 1\nb = 2"), ("o/r", None, "python", "c = 3\nd = 4"), ("o/r", None, "python", "c = 3\nd = 4"),
            (None, "", "python", "e = 5"), (None, None, "python", "e = 5")]
    files = spark.createDataFrame(rows, "repo string, path string, language string, text string")
    chunks = flows.chunk_files(files, mode).collect()
    assert sorted(r["text"].strip() for r in chunks) == ["a = 1\nb = 2", "c = 3\nd = 4", "e = 5", "e = 5"]
    name = f"c_{uuid.uuid4().hex}"
    flows.index_files(files, mode, name)
    assert collection.read(spark, name).select("id").distinct().count() == 4


def test_errors_reach_the_result(spark, names, questions):
    def embed(frame: pd.DataFrame) -> pd.Series:
        if frame["question"].str.contains("mail").any():
            raise ValueError("no vector")
        return frame["question"].map(lambda q: [1.0] * VECTOR_DIM)

    def judge(frame: pd.DataFrame) -> pd.Series:
        raise RuntimeError("no judge")

    asked = {r["q_id"]: r for r in flows.ask(spark, questions, names["smart"], "smart", embed_fn=embed).collect()}
    assert asked[2]["error"] == "ValueError: no vector" and asked[2]["answer"] is None
    assert asked[1]["error"] is None and asked[1]["answer"]
    compared = flows.compare(spark, questions, names["smart"], names["naive"], judge_fn=judge).collect()
    assert {r["error"] for r in compared} == {"RuntimeError: no judge"}


def test_experiment(spark, names, questions):
    """Answers of both modes, scored against references and judged blind."""
    asked = questions.selectExpr("'shop' AS repo", "q_id AS n", "question", "'sends the mail body' AS reference")

    def answers(mode):
        found = flows.ask(spark, questions.where("q_id < 2 OR 'smart' = '%s'" % mode), names[mode], mode)
        return found.selectExpr("'shop' AS repo", "q_id AS n", f"answer AS {mode}_response")

    both = answers("smart").join(answers("naive"), ["repo", "n"], "left")

    def judge(frame: pd.DataFrame) -> pd.Series:
        return frame["prompt"].map(lambda p: " A " if "Response A:" in p else "?")

    rows = {r["n"]: r for r in flows.evaluate_answers(asked, both, judge).collect()}
    assert rows[1]["chosen_mode"] in ("smart", "naive") and rows[1]["naive_ter"] is not None
    # The question without a naive answer keeps its smart scores.
    assert rows[2]["naive_bleu"] is None and rows[2]["chosen_mode"] is None and rows[2]["smart_rouge_l"] > 0


def test_index_again_skips_what_is_known(spark, files):
    name = f"c_{uuid.uuid4().hex}"
    first = files.where("repo = 'o/shop'")
    flows.index_files(first, "smart", name)
    before = collection.read(spark, name).count()
    flows.index_files(files, "smart", name, skip_known=True)
    ids = [r["id"] for r in collection.read(spark, name).select("id").collect()]
    assert len(set(ids)) == len(ids) == before + 1


@pytest.mark.parametrize("mode", ["naive", "structural"])
def test_files_are_read_once_to_leave_out_what_is_known(spark, mode):
    """Ids are compared with those of the collection without reading and cutting the files again."""
    read = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    name = f"c_{uuid.uuid4().hex}"
    rows = [("o/shop", f"f{i}.py", "python", f"x = {i}\ny = {i}") for i in range(20)]
    for upto in (10, 20):
        schema = "repo string, path string, language string, text string"
        files = spark.createDataFrame(rows[:upto], schema).mapInPandas(counted, schema)
        before, parts = read.value, 1 if mode == "naive" else 2
        flows.index_files(files, mode, name)
        assert read.value - before <= upto * parts
    assert collection.read(spark, name).count() == 20


def test_unknown_mode(files):
    with pytest.raises(ValueError):
        flows.chunk_files(files, "other")
