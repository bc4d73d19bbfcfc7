"""Streams over a folder give what the batch operators give on the same files."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions import vectors
from codeloom.operators import enrich, firsts
from codeloom.operators.windows import token_windows
from codeloom.plans import flows
from codeloom.sources import collection, corpus
from codeloom.streaming import ingest

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("repo", "path", "text")])


def add_file(base, lang, name, rows, bad=0):
    folder = base / lang / "final" / "jsonl" / "train" / "unzipped"
    folder.mkdir(parents=True, exist_ok=True)
    lines = [json.dumps(dict(zip(("repo", "path", "text"), r))) for r in rows] + ["{bad"] * bad
    (folder / name).write_text("\n".join(lines) + "\n")


@pytest.fixture
def base(tmp_path):
    for f in range(4):
        rows = [(f"o/r{i % 5}" if i % 3 else "o/hot", f"f{f}_{i}.py", f"text number {i} of {f}") for i in range(30)]
        add_file(tmp_path / "c", "python" if f % 2 else "go", f"{f}.jsonl", rows, bad=f)
    return tmp_path


def read(spark, base):
    return corpus.good_records(corpus.read_corpus(spark, str(base / "c"), record_schema=RECORD))


def stream(spark, base, files=1):
    return ingest.stream_corpus(spark, str(base / "c"), record_schema=RECORD, max_files_per_batch=files)


def test_stream_equals_batch_and_picks_up_new_files(spark, base):
    out, progress = str(base / "out"), str(base / "progress")
    drained = ingest.drain_to_table(stream(spark, base), out, progress)
    columns = sorted(drained.columns)
    assert sorted(drained.select(columns).collect()) == sorted(read(spark, base).select(columns).collect())
    add_file(base / "c", "go", "later.jsonl", [("o/new", "n.go", "x")])
    again = ingest.drain_to_table(stream(spark, base), out, progress)
    assert again.count() == 121 and again.where("repo = 'o/new'").count() == 1


def test_first_seen_across_batches(spark, base):
    seen = ingest.first_seen(stream(spark, base).select("repo", "path"))
    out, progress = str(base / "out"), str(base / "progress")
    found = ingest.drain_to_table(seen, out, progress)
    keys = {r["repo"] for r in firsts.first_per_key(read(spark, base).withColumn("seq", F.col("path"))).collect()}
    assert sorted(r["repo"] for r in found.collect()) == sorted(keys)
    add_file(base / "c", "go", "later.jsonl", [("o/new", "n.go", "x"), ("o/hot", "m.go", "x")])
    seen = ingest.first_seen(stream(spark, base).select("repo", "path"))
    found = ingest.drain_to_table(seen, out, progress)
    assert sorted(r["repo"] for r in found.collect()) == sorted(keys | {"o/new"})


def windows_of(batch):
    """Records of a batch: windows, their own text as summary, embedded."""
    no_line = F.lit(None).cast("bigint")
    cut = token_windows(batch, id_col="path", keep=["repo", "language"]).withColumns({"part": F.col("win"), "start_line": no_line, "end_line": no_line})
    return enrich.chunk_records(cut, "naive", embedding=vectors.embed_text(F.col("text")))


COLUMNS = ["id", "repo_name", "chunk_file", "chunk_code", "summary"]


def stored(spark, name):
    return sorted(collection.read(spark, name).select(COLUMNS).collect())


def test_index_stream_stores_every_record_once(spark, base):
    name = f"c_{uuid.uuid4().hex}"
    collection.create_collection(spark, name, str(base / "store"))
    wanted = sorted(windows_of(read(spark, base)).select(COLUMNS).collect())
    ingest.index_stream(stream(spark, base, 2), windows_of, name, str(base / "progress"))
    assert stored(spark, name) == wanted
    versions = collection.versions(spark, name)
    assert len(versions) == 2
    # A run started anew, cut to other batches, has nothing to add.
    whole = ingest.stream_corpus(spark, str(base / "c"), record_schema=RECORD, max_files_per_batch=9)
    ingest.index_stream(whole, windows_of, name, str(base / "progress2"))
    assert stored(spark, name) == wanted
    # A new file adds its records, the run goes on where it was.
    add_file(base / "c", "go", "later.jsonl", [("o/new", "n.go", "x y z")])
    ingest.index_stream(stream(spark, base, 2), windows_of, name, str(base / "progress"))
    assert len(stored(spark, name)) == len(wanted) + 1


def test_a_batch_that_is_run_again_adds_nothing(spark, base):
    """The store was written, but the stream was lost before it noted the batch."""
    name = f"c_{uuid.uuid4().hex}"
    collection.create_collection(spark, name, str(base / "store"))
    progress = base / "progress"
    ingest.index_stream(stream(spark, base, 2), windows_of, name, str(progress))
    before = stored(spark, name), collection.versions(spark, name)
    last = max(int(p.name) for p in (progress / "commits").iterdir() if p.name.isdigit())
    for file in (progress / "commits").glob(f"*{last}*"):
        file.unlink()
    calls = []

    def build(batch):
        calls.append(1)
        return windows_of(batch)

    ingest.index_stream(stream(spark, base, 2), build, name, str(progress))
    assert (stored(spark, name), collection.versions(spark, name)) == before and not calls


def test_a_lost_batch_leaves_nothing(spark, base):
    name = f"c_{uuid.uuid4().hex}"
    collection.create_collection(spark, name, str(base / "store"))
    failing = [True]

    def build(batch):
        made = windows_of(batch)
        if failing[0] and collection.versions(spark, name):
            return made.withColumn("summary", F.raise_error(F.lit("lost")).cast("string"))
        return made

    with pytest.raises(Exception, match="lost"):
        ingest.index_stream(stream(spark, base, 2), build, name, str(base / "progress"))
    assert len(collection.versions(spark, name)) == 1
    failing[0] = False
    ingest.index_stream(stream(spark, base, 2), build, name, str(base / "progress"), compact_after=2)
    assert stored(spark, name) == sorted(windows_of(read(spark, base)).select(COLUMNS).collect())
    # Small files have been put together on the way.
    assert collection.read(spark, name).select(F.col("_metadata.file_path")).distinct().count() <= 2


def test_streamed_files_can_be_asked(spark, base):
    name = f"c_{uuid.uuid4().hex}"
    files = stream(spark, base, 2).select("repo", "path", "language", "text")
    flows.index_stream_files(files, "naive", name, str(base / "progress"), str(base / "store"))
    asked = spark.createDataFrame([(1, "text number 7 of 2")], "q_id long, question string")
    assert "text number 7 of 2" in flows.ask(spark, asked, name, "naive", k=1).first()["answer"]


def test_first_seen_by_order_over_many_batches(spark, tmp_path):
    """Files come last first, so nearly every batch corrects the ones before."""
    folder, schema = str(tmp_path / "in"), "repo string, seq long, path string"

    def add(rows, name, age):
        """One file, as old as told: streams take older files first."""
        loose = tmp_path / f"loose-{name}"
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(loose))
        written = next(loose.glob("part-*.json"))
        (tmp_path / "in").mkdir(exist_ok=True)
        os.utime(written, (10_000 - age, 10_000 - age))
        os.rename(written, tmp_path / "in" / f"{name}.json")

    def drained():
        feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).json(folder)
        corrections = ingest.drain_to_table(ingest.first_seen(feed, order="seq"), str(tmp_path / "out"), str(tmp_path / "progress"))
        return corrections, sorted(tuple(r) for r in ingest.resolve_firsts(corrections).collect())

    rows = [(f"o/{i % 5}" if i % 3 else "o/hot", i, f"p{i}") for i in range(240)]
    for f in range(12):
        add(rows[20 * f : 20 * f + 20] + [("o/none", None, "x")], f"f{f}", age=f)
    firsts_of = {}
    for repo, seq, path in rows:
        firsts_of.setdefault(repo, (repo, seq, path))
    corrections, found = drained()
    assert found == sorted(firsts_of.values())
    # Each of the four batches has an earlier record of nearly every repository.
    assert corrections.count() > 2 * len(firsts_of)
    assert spark.conf.get(ingest.STATE_STORE) == ingest.DEFAULT_STORE
    add([("o/0", -1, "late"), ("o/9", 7, "new"), ("o/hot", 500, "too late")], "late", age=-5)
    firsts_of |= {"o/0": ("o/0", -1, "late"), "o/9": ("o/9", 7, "new")}
    assert drained()[1] == sorted(firsts_of.values())
    progress = {p.name for p in (tmp_path / "progress" / "state" / "0" / "0").iterdir()}
    assert any(name.endswith(".zip") or name.endswith(".changelog") for name in progress), progress
