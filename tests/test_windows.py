import random
import re

import pytest

from codeloom.operators import windows

WORD = re.compile(r"\w+|[^\w\s]")


def make_texts():
    rng = random.Random(3)
    texts = ["", " \n ", "one", "a b c d e f g h", "é. ü! x? y\nz", "x" * 50]
    for _ in range(40):
        n = rng.randrange(1, 120)
        texts.append(" ".join(rng.choice(["ab", "c.", "d!", "é", "f\n", "g,h"]) for _ in range(n)))
    return texts


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(list(enumerate(make_texts())), "doc_id long, text string").cache()


@pytest.mark.parametrize("size,overlap", [(5, 0), (5, 2), (7, 6), (512, 20)])
def test_token_windows(files, size, overlap):
    found = {}
    for r in windows.token_windows(files, size, overlap).collect():
        found.setdefault(r["doc_id"], []).append(r)
    for doc_id, text in enumerate(make_texts()):
        tokens = WORD.findall(text)
        rows = sorted(found.get(doc_id, []), key=lambda r: r["win"])
        covered = 0
        for i, r in enumerate(rows):
            wanted = tokens[r["first_token"] : r["first_token"] + size]
            assert (r["win"], r["first_token"]) == (i, i * (size - overlap))
            assert WORD.findall(r["text"]) == wanted and r["n_tokens"] == len(wanted)
            assert r["text"] in text
            assert i == 0 or len(wanted) > overlap
            covered = r["first_token"] + len(wanted)
        assert covered == len(tokens)


def sentence_chunks(text, size, overlap):
    parts = re.sub(r"([.!?]) ", r"\1\n", text).split("\n")
    sentences = []
    for part in parts:
        tokens = re.findall(r"(?:\w+|[^\w\s])\s*", part)
        for at in range(0, len(tokens), size):
            piece = tokens[at : at + size]
            sentences.append((len(piece), "".join(piece).rstrip()))
    out, now = [], []
    for s in sentences:
        if now and sum(n for n, _ in now) + s[0] > size:
            out.append(now)
            tail = []
            for old in reversed(now):
                if sum(n for n, _ in tail) + old[0] > overlap:
                    break
                tail.insert(0, old)
            now = tail
        now = [*now, s]
    return out + ([now] if now else [])


@pytest.mark.parametrize("size,overlap", [(4, 0), (6, 3), (9, 8), (512, 20)])
def test_sentence_windows(files, size, overlap):
    found = {}
    for r in windows.sentence_windows(files, size, overlap).collect():
        found.setdefault(r["doc_id"], []).append((r["win"], r["n_tokens"], r["text"]))
    for doc_id, text in enumerate(make_texts()):
        wanted = [
            (i, sum(n for n, _ in c), " ".join(t for _, t in c))
            for i, c in enumerate(sentence_chunks(text, size, overlap))
        ]
        assert sorted(found.get(doc_id, [])) == wanted


def test_overlap_must_be_smaller(files):
    with pytest.raises(ValueError):
        windows.token_windows(files, 5, 5)


def test_each_text_is_cut_once(files):
    """A filter on the tokens would be pushed down and repeat the cutting."""
    plan = windows.token_windows(files)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
