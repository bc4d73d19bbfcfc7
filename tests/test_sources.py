import json
import os
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.operators import firsts, reports
from codeloom.operators.enrich import chunk_records
from codeloom.sources import chunk_store, collection, corpus, files, languages, tables
from codeloom.workspace import materialize, shared_dir


def write_lines(base, lang, split, name, lines):
    folder = base / lang / "final" / "jsonl" / split / "unzipped"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n", encoding="utf-8")


@pytest.fixture(scope="module")
def corpus_dir(tmp_path_factory):
    base = tmp_path_factory.mktemp("corpus")
    record = lambda r: json.dumps({"repo": r, "code": "x\ny"})
    write_lines(base, "python", "train", "p_0.jsonl", [record("a/x"), "{bad", record("b/x"), "", record("a/x")])
    write_lines(base, "python", "test", "p_0.jsonl", [record("c/y"), '"only a string"', record("b/x")])
    write_lines(base, "go", "valid", "g_0.jsonl", [record("d/z"), record("a/x")])
    write_lines(base, "go", "valid", "notes.txt", ["not part of it"])
    return str(base)


def test_corpus_scan(spark, corpus_dir):
    scanned = corpus.read_corpus(spark, corpus_dir)
    good = corpus.good_records(scanned).collect()
    assert sorted((r["language"], r["split"], r["repo"]) for r in good) == [
        ("go", "valid", "a/x"), ("go", "valid", "d/z"), ("python", "test", "b/x"), ("python", "test", "c/y"),
        ("python", "train", "a/x"), ("python", "train", "a/x"), ("python", "train", "b/x"),
    ]
    assert {r["github_repo"] for r in good if r["repo"] == "a/x"} == {"https://github.com/a/x.git"}
    bad = corpus.quarantined_lines(scanned).collect()
    assert sorted(r[corpus.CORRUPT] for r in bad) == ['"only a string"', "{bad"]


def test_corpus_selection(spark, corpus_dir):
    some = corpus.read_corpus(spark, corpus_dir, languages=["python"], splits=["test", "valid"])
    assert {(r["language"], r["split"]) for r in some.collect()} == {("python", "test")}


def test_scan_order_decides_first_records(spark, corpus_dir):
    placed = corpus.good_records(corpus.scan_corpus(spark, corpus_dir)).select("repo", "split", F.col("at").alias("seq"))
    found = firsts.first_per_key(placed).orderBy("seq").collect()
    assert [(r["repo"], r["split"]) for r in found] == [
        ("a/x", "train"), ("b/x", "train"), ("c/y", "test"), ("d/z", "valid")
    ]
    assert [r["repo"] for r in firsts.first_n_keys(placed, 2).orderBy("seq").collect()] == ["a/x", "b/x"]
    bad = corpus.quarantined_lines(corpus.scan_corpus(spark, corpus_dir)).collect()
    assert sorted(r[corpus.CORRUPT] for r in bad) == ['"only a string"', "{bad"]


def test_line_numbers_hold_for_any_reading(spark, tmp_path):
    """However files are cut into blocks, and whichever blocks a task reads."""
    for f, n in (("a", 700), ("b", 1), ("c", 0), ("d", 350)):
        (tmp_path / f"{f}.txt").write_text("".join(f"{f}{i}{'x' * (i % 37)}\n" if i % 10 else "\n" for i in range(n)))
    readings = []
    for size in ("128m", "1000", "333"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            lines = corpus.numbered_lines(spark, str(tmp_path / "*.txt"))
            readings.append(sorted((r["file"][-5:], r["line_no"], r["line"]) for r in lines.collect()))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    wanted = [(f"{f}.txt", i, f"{f}{i}{'x' * (i % 37)}" if i % 10 else "") for f, n in (("a", 700), ("b", 1), ("d", 350)) for i in range(n)]
    assert readings[0] == wanted and readings[1] == wanted and readings[2] == wanted


def test_limits(spark):
    rows = [(i, f"r{i % 7}" if i % 3 else "hot") for i in range(300)]
    df = spark.createDataFrame(rows, "seq long, repo string")
    keys = list(dict.fromkeys(r for _, r in rows))
    assert firsts.first_n_keys(df, 0).count() == 0
    assert firsts.first_n_keys(df, None).count() == len(keys)
    assert [r["repo"] for r in firsts.first_n_keys(df, 3).orderBy("seq").collect()] == keys[:3]
    assert firsts.batch_rounded_limit(df, 3, 2).count() == 4
    assert firsts.batch_rounded_limit(df, 0, 2).count() == 0
    assert firsts.batch_rounded_limit(df, None, 2).count() == len(keys)


def test_source_tree(spark, tmp_path):
    (tmp_path / "pkg" / "deep").mkdir(parents=True)
    (tmp_path / "a.py").write_text("a = 1\nb = 2")
    (tmp_path / "pkg" / "deep" / "é.py").write_text("é\n", encoding="utf-8")
    (tmp_path / "pkg" / "x.jsx").write_text("x")
    (tmp_path / "pkg" / "y.js").write_text("y")
    (tmp_path / "pkg" / "py").write_text("no extension")
    found = {r["path"].rsplit("/", 1)[-1]: r["text"] for r in files.read_source_tree(spark, str(tmp_path)).collect()}
    assert sorted(found.values()) == ["a = 1\nb = 2", "é\n"]
    scripts = files.read_source_tree(spark, str(tmp_path), language="JavaScript")
    assert sorted(r["text"] for r in scripts.collect()) == ["x", "y"]
    named = files.read_source_files(spark, f"{tmp_path}/a.py , {tmp_path}/pkg/y.js")
    assert [r["text"] for r in named.collect()] == ["a = 1\nb = 2"]
    with pytest.raises(ValueError):
        files.read_source_tree(spark, str(tmp_path), language="cobol")


def test_languages(spark):
    df = spark.createDataFrame(
        [("a.b.PY", "Python"), ("x.tar.cpp", "cpp"), ("d/.hidden/file", "go"), ("a.py", "cobol")], "path string, language string"
    )
    known, unknown = languages.with_known_language(df)
    assert known.count() == 3 and [r["language"] for r in unknown.collect()] == ["cobol"]
    found = {(r["path"], r["language"]) for r in languages.files_of_language(df.select("path")).collect()}
    assert found == {("x.tar.cpp", "cpp"), ("a.py", "python")}


def test_eval_sheet_roundtrip(spark, tmp_path):
    cells = ['say "hi"', "two\nlines", "a,b", "", "\\", "q", None, "é", "1", "2"]
    rows = [("p", "https://github.com/o/p.git", *cells)]
    files.write_eval_sheet(spark.createDataFrame(rows, files.SHEET_SCHEMA), str(tmp_path / "s"))
    back = files.read_eval_sheet(spark, str(tmp_path / "s")).collect()
    assert len(back) == 1
    assert [v or None for v in back[0]] == [v or None for v in rows[0]]


def records(spark, n):
    vector = [0.5] * collection.VECTOR_DIM
    rows = [(f"id{i}", "r", "python", "f.py", "1-2", "code", "sum", vector) for i in range(n)]
    return spark.createDataFrame(rows, collection.COLLECTION_SCHEMA)


def test_collection_life(spark, tmp_path):
    name = f"c_{uuid.uuid4().hex}"
    collection.create_collection(spark, name, str(tmp_path / name))
    collection.create_collection(spark, name, str(tmp_path / "elsewhere"))  # already there
    collection.append(records(spark, 3), name)
    collection.append(records(spark, 5).where("id = 'id4'"), name)
    assert sorted(r["id"] for r in collection.read(spark, name).collect()) == ["id0", "id1", "id2", "id4"]
    collection.delete_where(spark, name, F.col("id").isin("id0", "id4"))
    assert sorted(r["id"] for r in collection.read(spark, name).collect()) == ["id1", "id2"]
    collection.append(records(spark, 1), name)
    collection.delete_where(spark, name, F.col("summary").isNull())
    assert collection.read(spark, name).count() == 3
    collection.drop_collection(spark, name)
    collection.drop_collection(spark, name)
    assert not spark.catalog.tableExists(name)


def test_validate(spark):
    good = records(spark, 1)
    bad = [
        good.withColumn("id", F.lit(None).cast("string")),
        good.withColumn("summary", F.repeat(F.lit("é"), 1001)),
        good.withColumn("chunk_code", F.repeat(F.lit("x"), 10001)),
        good.withColumn("embedding", F.array(F.lit(1.0).cast("float"))),
        good.withColumn("embedding", F.lit(None).cast("array<float>")),
    ]
    every = good
    for b in bad:
        every = every.unionByName(b)
    kept, rejected = collection.validate(every)
    assert kept.count() == 1
    assert sorted(r["reason"] for r in rejected.collect()) == [
        "chunk_code is too long", "embedding has the wrong dimension", "embedding has the wrong dimension",
        "id is missing", "summary is too long",
    ]


def many(spark, n, start=0):
    """Records of forty repositories, of which one has a third."""
    vector = [0.5] * 4
    rows = [(f"id{i:05d}", f"r{i % 40:02d}" if i % 3 else "hot", "go", f"f{i}", None, "x", None, vector) for i in range(start, start + n)]
    return spark.createDataFrame(rows, collection.COLLECTION_SCHEMA).repartition(5)


def files_of(df):
    return {f.rsplit("/", 1)[-1] for f in df.inputFiles()}


def listed(spark, name):
    rows = collection.manifest(spark, name).where("file IS NOT NULL").collect()
    return {r["file"].rsplit("/", 1)[-1]: r["rows"] for r in rows}


def test_one_repository_reads_its_files_alone(spark, tmp_path):
    name = "c_layout"
    collection.create_collection(spark, name, str(tmp_path / name))
    collection.append(many(spark, 4000), name, rows_per_file=100)
    files = listed(spark, name)
    assert sum(files.values()) == 4000 and 35 <= len(files) <= 40 and max(files.values()) < 250
    one = collection.read(spark, name, "r07")
    assert one.count() == sum(1 for i in range(4000) if i % 3 and i % 40 == 7)
    assert len(files_of(one)) <= 3
    assert len(files_of(collection.read(spark, name, "hot"))) <= 18  # a third of all, over many files
    assert collection.read(spark, name, "zzz").count() == 0 and not files_of(collection.read(spark, name, "zzz"))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(repo_name,r07)" in plan
    # Within a file row groups are told apart by statistics and Bloom filters.
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(one.inputFiles()[0].split("file:", 1)[-1].replace("///", "/")).metadata
    assert meta.row_group(0).column(0).statistics.has_min_max
    spark.sql(f"DROP TABLE {name}")


def test_delete_touches_few_files(spark, tmp_path):
    name = "c_delete"
    collection.create_collection(spark, name, str(tmp_path / name))
    collection.append(many(spark, 2000), name, batch="first", rows_per_file=100)
    before = listed(spark, name)
    written = collection.delete_where(spark, name, F.col("id").isin("id00000", "id00003", "id00007") | (F.col("repo_name") == "none"))
    after = listed(spark, name)
    assert written <= 3 and len(set(before) - set(after)) == written
    assert all(after[f] == n for f, n in before.items() if f in after)
    left = {r["id"] for r in collection.read(spark, name).select("id").collect()}
    assert left == {f"id{i:05d}" for i in range(2000)} - {"id00000", "id00003", "id00007"}
    # Nothing to delete: no version. A whole file: no file. Older versions can be read, batches are known.
    versions = collection.versions(spark, name)
    assert collection.delete_where(spark, name, F.col("id") == "nobody") == 0
    assert collection.delete_where(spark, name, F.col("summary") == "x") == 0  # null conditions delete nothing
    assert collection.versions(spark, name) == versions
    assert collection.read(spark, name, version=versions[0]).count() == 2000
    assert not collection.append(many(spark, 5, 9000), name, batch="first")
    collection.delete_where(spark, name, F.lit(True))
    assert collection.read(spark, name).count() == 0 and collection.has_batch(spark, name, "first")
    spark.sql(f"DROP TABLE {name}")


def test_compaction_and_vacuum(spark, tmp_path):
    name = "c_compact"
    collection.create_collection(spark, name, str(tmp_path / name))
    for i in range(6):
        assert collection.append(many(spark, 20, 20 * i), name, batch=f"b{i}")
    assert collection.append(many(spark, 0), name, batch="empty") and collection.has_batch(spark, name, "empty")
    assert len(listed(spark, name)) == 6
    rows = sorted(r["id"] for r in collection.read(spark, name).collect())
    assert collection.compact(spark, name, rows_per_file=100) == 6
    assert len(listed(spark, name)) == 2 and sorted(r["id"] for r in collection.read(spark, name).collect()) == rows
    assert all(collection.has_batch(spark, name, f"b{i}") for i in range(6))
    assert collection.vacuum(spark, name) == 6
    assert len(collection.versions(spark, name)) == 1
    assert sorted(r["id"] for r in collection.read(spark, name).collect()) == rows
    with pytest.raises(ValueError, match="no version"):
        collection.read(spark, name, version=0)
    collection.drop_collection(spark, name, files=True)
    assert not (tmp_path / name).exists()


def test_batch_numbers(spark):
    ids = [i * 7 % 1009 for i in range(1000)]
    df = spark.createDataFrame([(i,) for i in ids], "seq long")
    found = {r["seq"]: r["batch_no"] for r in collection.with_batch_number(df, "seq", 10).collect()}
    assert found == {seq: at // 10 for at, seq in enumerate(sorted(ids))}


def test_chunk_store(spark, tmp_path):
    path = str(tmp_path / "store")
    schema = "chunk_id string, repo string, mode string, text string"
    rows = [(str(i), "o/a" if i % 4 else "o/b", m, "t") for i in range(20) for m in ("smart", "naive")]
    chunk_store.write_chunk_store(spark.createDataFrame(rows, schema), path)
    again = spark.createDataFrame([("new", "o/a", "smart", "t")], schema)
    chunk_store.write_chunk_store(again, path)
    assert [r["chunk_id"] for r in chunk_store.read_chunk_store(spark, path, "o/a", "smart").collect()] == ["new"]
    assert chunk_store.read_chunk_store(spark, path, "o/a", "naive").count() == 15
    assert chunk_store.read_chunk_store(spark, path).count() == 1 + 15 + 10


def test_sorted_store_opens_few_files(spark, tmp_path):
    rows = spark.range(3000).selectExpr("concat('k', lpad(id * 7 % 3001, 5, '0')) AS k", "id").repartition(7)
    path = chunk_store.write_sorted(rows, "k", rows_per_file=200, path=str(tmp_path / "s"))
    assert chunk_store.read_sorted(spark, path).count() == 3000
    keys = spark.createDataFrame([("k00005",), ("k00007",), ("k02999",), ("k00007",), ("a",), ("z",), (None,)], "k string")
    found = chunk_store.fetch(spark, path, keys, "k")
    wanted = {(r["k"], r["id"]) for r in rows.collect() if r["k"] in ("k00005", "k00007", "k02999")}
    assert {(r["k"], r["id"]) for r in found.collect()} == wanted and len(wanted) >= 2
    assert len(found.inputFiles()) <= 2 < len(chunk_store.read_sorted(spark, path).inputFiles())
    assert "In(k" in found._jdf.queryExecution().executedPlan().toString().replace("PushedFilters: [", "")
    many = rows.select("k").where("id < 1500")
    assert chunk_store.fetch(spark, path, many, "k").count() == 1500
    assert chunk_store.fetch(spark, path, keys.where("k = 'a'"), "k").count() == 0


def test_results(spark, tmp_path):
    columns = ["question", "reference", "smart_response", "naive_response"]
    scores = ["smart_bleu", "smart_rouge_l", "smart_ter", "naive_bleu", "naive_rouge_l", "naive_ter"]
    schema = "repo string, n long, " + ", ".join(f"{c} string" for c in columns) + ", " + ", ".join(
        f"{c} double" for c in scores) + ", chosen_mode string"
    rows = [("a", 1, "q", "r", "s", "n", .1, .2, .3, .4, .5, .6, "smart"), ("a", 2, "q2", "r2", None, None, *[None] * 6, None)]
    results = spark.createDataFrame(rows, schema)
    document = chunk_store.result_document(results)
    chunk_store.write_results(document, str(tmp_path / "r"))
    text = next((tmp_path / "r" / "repo=a").glob("*.json")).read_text()
    written = json.loads(text)["queries"]
    assert written["query_1"]["metrics"]["naive"] == {"bleu": 0.4, "rougeL": 0.5, "ter": 0.6}
    assert written["query_1"]["llm_chosen_mode"] == "smart" and written["query_2"]["query"] == "q2"
    back = chunk_store.read_results(spark, str(tmp_path / "r"), document.schema).orderBy("n").collect()
    assert [(r["n"], r["smart_bleu"], r["chosen_mode"]) for r in back] == [(1, 0.1, "smart"), (2, None, None)]


def test_chunk_record_defaults(spark):
    schema = "repo string, language string, path string, part long, start_line long, end_line long, text string"
    rows = [("o/r", "go", None, 0, None, 4, "t"), ("p/r", "go", "f", 0, 1, 4, "t"), ("p/r", "go", "f", 1, 1, 4, "t")]
    df = spark.createDataFrame(rows, schema)
    found = sorted(chunk_records(df, "smart").collect(), key=lambda r: (r["repo"], r["id"]))
    assert [(r["repo_name"], r["chunk_file"], r["chunk_lines"]) for r in found] == [("r", "unknown", "?-4"), ("r", "f", "1-4"), ("r", "f", "1-4")]
    assert len({r["id"] for r in found}) == 3 and all(len(r["id"]) == 36 for r in found)
    again = sorted(chunk_records(df.repartition(3), "smart").collect(), key=lambda r: (r["repo"], r["id"]))
    assert [r["id"] for r in again] == [r["id"] for r in found]


def test_counts(spark):
    rows = [("naive", "a", "f"), ("naive", "a", "g"), ("naive", "b", "f"), ("naive", "a", "f")]
    found = reports.progress_counts(spark.createDataFrame(rows, "mode string, repo string, path string")).first()
    assert (found["n_chunks"], found["n_files"], found["n_repos"]) == (4, 3, 2)


def test_workspace(spark, tmp_path):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    df = materialize(spark.range(10).withColumn("v", F.array(F.col("id"))), "numbers")
    assert df.count() == 10 and df.schema["v"].dataType == T.ArrayType(T.LongType(), True)
    assert df.inputFiles()[0].split("file:", 1)[-1].lstrip("/").startswith(shared_dir(spark).split("file:")[-1].lstrip("/"))
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    assert tables.read_table(spark, str(tmp_path / "t"), "id").rdd.getNumPartitions() == 8
    spark.range(100).repartition(40).write.parquet(str(tmp_path / "u"))
    plan = tables.read_table(spark, str(tmp_path / "u"), "id")._jdf.queryExecution().toString()
    assert "Repartition" not in plan


def test_stores_are_files_by_size(spark, tmp_path):
    """One hot repository is cut into several files, many tiny ones are a file each."""
    schema = "chunk_id string, repo string, mode string, text string"
    rows = [(str(i), "o/hot" if i < 4000 else f"o/tiny{i % 30}", "smart", os.urandom(300).hex()) for i in range(4300)]
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        chunk_store.write_chunk_store(spark.createDataFrame(rows, schema).repartition(8), str(tmp_path / "s"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    count = {p.name: len(list(p.glob("mode=smart/*.parquet"))) for p in (tmp_path / "s").glob("repo=*")}
    hot = count.pop("repo=o%2Fhot")
    assert hot >= 4 and len(count) == 30 and sum(count.values()) <= 45


def test_nothing_is_left_behind(spark):
    from codeloom import workspace
    from codeloom.plans import flows

    files = spark.createDataFrame([("o/r", "a.py", "python", "def f():\n    return 1")], "repo string, path string, language string, text string")
    base = workspace.shared_dir(spark).split("file:")[-1]
    workspace.clear(spark)
    before = set(os.listdir(base))
    flows.index_files(files, "smart", "c_left")
    asked = spark.createDataFrame([(1, "f")], "q_id long, question string")
    assert flows.ask(spark, asked, "c_left", "smart").count() == 1
    assert set(os.listdir(base)) > before
    collection.drop_collection(spark, "c_left", files=True)
    workspace.clear(spark)
    assert set(os.listdir(base)) == before


def test_unknown_languages_are_an_error(spark):
    df = spark.createDataFrame([("Python",), ("cobol",), (None,)], "language string")
    with pytest.raises(ValueError, match="cobol.*python"):
        languages.require_known_language(df)
    assert languages.require_known_language(df.where("language = 'Python'")).first()["language"] == "python"
