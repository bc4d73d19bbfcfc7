"""The classifiers: held-out accuracy, one score whatever the batch, and rows easily got wrong."""

import numpy as np
import pytest
from conftest import SMALL
from helpers import documents, no_documents
from pyspark.sql import functions as F

from codeloom.llm import quality_classifier, toxicity
from codeloom.llm.queries import all_queries

MIDDLE = SMALL.replace("sf0.001", "sf0.1")


@pytest.mark.parametrize(
    ("query", "label", "modulus", "held", "least"),
    [("op6_quality_classifier", "quality", 3, 1, 0.99), ("op4_toxicity", "toxic", 5, 0, 0.97)],
)
def test_held_out_accuracy(spark, query, label, modulus, held, least):
    scored = all_queries()[query](spark, MIDDLE)
    assert scored.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    rows = scored.join(labels, "doc_id").collect()
    assert all(r.held_out == (__import__("zlib").crc32(str(r.doc_id).encode()) % modulus == held) for r in rows)
    out = [r for r in rows if r.held_out]
    assert len(out) > 500
    assert np.mean([r.predicted == r[label] for r in out]) >= least
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    assert scored.count() == spark.read.parquet(f"{MIDDLE}/documents.parquet").count()


def _labels(spark, docs, column):
    return docs.where("doc_id IS NOT NULL").select("doc_id", (F.col("doc_id") % 2).cast("int").alias(column))


@pytest.mark.parametrize(("module", "column"), [(quality_classifier, "quality"), (toxicity, "toxic")])
def test_edge_rows(spark, module, column):
    docs = documents(spark, ["you idiot. " * 30, "IDIOT!!", "é" * 5000])
    labels = _labels(spark, docs, column).union(spark.createDataFrame([(None, 1), (3, None), (999_999, 1)], f"doc_id long, {column} int"))
    model = module.train(docs, labels, column, F.lit(True))
    scored = module.score(docs, model)
    assert scored.columns.count("score") == 1 and "kept" in scored.columns
    rows = scored.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    by_text = {}
    for r in rows:
        by_text.setdefault(r.text or "", set()).add(round(r.score, 9))
    assert all(len(s) == 1 for s in by_text.values())
    alone = module.score(docs.select("text").repartition(40), model).collect()
    assert all(round(r.score, 9) in by_text[r.text or ""] for r in alone)
    none = module.train(docs, labels.where("false"), column, F.lit(True))
    assert none is None and module.score(docs, none).count() == len(rows)
    assert module.score(no_documents(spark), model).count() == 0


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    bags = [rng.normal(size=(n, 5)) for n in (1, 3, 7)]
    y = np.array([1.0, 0.0, 1.0])
    model = quality_classifier.fit(bags, y, hidden=4, gate=3, epochs=1)
    x, starts = np.concatenate(bags), np.array([0, 1, 4])

    def loss():
        p = quality_classifier._forward(model, x, starts)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for weight, grad in zip(model.weights(), quality_classifier._gradients(model, x, starts, y), strict=True):
        at = tuple(rng.integers(0, s) for s in weight.shape)
        weight[at] += 1e-5
        up = loss()
        weight[at] -= 2e-5
        down = loss()
        weight[at] += 1e-5
        assert grad[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_one_bad_passage_can_decide():
    good, bad = [np.zeros((20, 3)) + 0.1 for _ in range(40)], []
    for _ in range(40):
        bag = np.zeros((20, 3)) + 0.1
        bag[7] = 1
        bad.append(bag)
    model = quality_classifier.fit(good + bad, np.array([1.0] * 40 + [0.0] * 40), epochs=60)
    x = np.concatenate([good[0], bad[0]])
    scores = quality_classifier.bag_scores(model, x, np.array([0, 20]))
    assert scores[0] > 0.5 > scores[1]


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("What an idiot.", "insult"),
        ("You are an idiot.", "targeted insult"),
        ("You are not an idiot.", "negated"),
        ("He said she is an idiot.", "reported"),
        ("The idiot said so.", "insult"),
        ("I will kill you.", "targeted threat"),
        ("Not now, nor here or there, idiot", "insult"),
        ("nothing here", None),
    ],
)
def test_clauses(text, kind):
    found = toxicity.clause_reader({"idiot": 1.0}, {})(text.encode())
    assert [k for k, x in zip(toxicity.KINDS, found, strict=True) if x] == ([kind] if kind else [])


def _letters(i):
    """Words that tell texts apart, so that they are no near-copies."""
    return " ".join("".join(chr(97 + (i * k + j * j) % 26) for j in range(5)) for k in (3, 7, 11, 19))


def test_learned_words_cover_and_spare(spark):
    good = [f"the day {i} was fine and calm {_letters(i)}" for i in range(60)]
    bad = [f"the day {i} was {w} and calm {_letters(99 + i)}" for i, w in enumerate(["vile", "grotty", "grottiest"] * 10)]
    rows = [(t, 0) for t in good] + [(t, 1) for t in bad]
    texts = spark.createDataFrame(rows + rows[-5:] * 20, "text string, label int").repartition(3)  # copies count once
    words, prefixes = toxicity.learn_insults(texts)
    assert (words, prefixes) == terms_by_hand(rows)
    assert "vile" in words and not {"the", "day", "was", "calm"} & set(words)
    read = toxicity.clause_reader(words, prefixes)
    assert all(read(t.encode()).sum() > 0 for t in bad) and not any(read(t.encode()).sum() for t in good)


def terms_by_hand(rows):
    """Terms of all texts at once, without Spark."""
    bad = [toxicity.terms_of(t.encode()) for t, label in rows if label]
    good = [toxicity.terms_of(t.encode()) for t, label in rows if not label]
    where = {t: [i for i, x in enumerate(bad) if t in x] for t in set().union(*bad)}
    return toxicity.choose_terms(where, {t: sum(t in x for x in good) for t in where}, len(bad), len(good))


def test_unlike_texts_all_count(spark):
    """Texts that share their common words are no copies of each other."""
    common = "aa ab ac ad ae af ag ah ai aj ak al"
    rows = [(f"{common} plain {_letters(i)}", 0) for i in range(60)]
    rows += [(f"{common} you {'scum' if i % 2 else 'louse'} {_letters(i)}", 1) for i in range(40)]
    words, _ = toxicity.learn_insults(spark.createDataFrame(rows, "text string, label int"))
    assert {"scum", "louse"} <= set(words)


def test_clauses_against_a_direct_loop():
    rng = np.random.default_rng(3)
    vocabulary = ["idiot", "idiots", "kill", "you", "not", "said", "a", "b", "Idiot", "don't", "é", "KILL", "moron", "moronic"]
    words, prefixes = {"idiot": 1.0}, {"moro": 0.5}
    read = toxicity.clause_reader(words, prefixes)
    for _ in range(400):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", ", ", ". ", "!", "\n", "-", ";"]) for _ in range(rng.integers(0, 25)))
        wanted = np.zeros(len(toxicity.KINDS))
        for clause in toxicity.CLAUSE_END.split(text.encode()):
            state, strength = toxicity.GRAMMAR.start, 0.0
            for word in clause.translate(toxicity.LETTERS).decode().split():
                weight = max([words.get(word, 0.0), *(w for p, w in prefixes.items() if word.startswith(p) and len(word) > len(p))])
                kind = toxicity.INSULT if weight else toxicity.CLASS_OF.get(word, toxicity.OTHER)
                state = toxicity.GRAMMAR.moves[state, kind]
                strength += weight or float(kind == toxicity.THREAT)
            if (found := toxicity.kind_of(state)) is not None:
                wanted[found] += strength
        assert np.allclose(read(text.encode()), wanted), text


def test_passage_features_against_a_direct_loop():
    rng = np.random.default_rng(4)
    pieces = ["word", "Word", "12", "!!", "||", "é", "\n", "\t", "$", "same", "same", "."]
    texts = [("".join(rng.choice(pieces) + " " * int(rng.integers(0, 2)) for _ in range(n))).encode() for n in (0, 1, 5, 60, 300, 900)]
    found, starts = quality_classifier.passage_features([*texts, None], size=50)
    rows = []
    firsts = []
    for text in [*texts, b""]:
        firsts.append(len(rows))
        # A passage ends at the first blank from each multiple of the size on; a short rest joins the last.
        cuts = sorted({at for k in range(50, len(text), 50) if (at := next((i for i in range(k, len(text)) if text[i : i + 1] in b" \t\r\x0b\x0c\n"), None)) is not None and at < len(text) - 25})
        bounds = [0, *(cuts if len(text) > 50 else []), len(text)]
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            passage = text[low:high]
            shares = [sum(passage.count(bytes([b])) for b in signs) for signs in quality_classifier.SIGNS.values()]
            shares.append(len(passage) - sum(shares))
            words = passage.split()
            doubled = sum(text[i] == text[i - 1] and text[i : i + 1] not in b" \t\r\x0b\x0c" for i in range(max(low, 1), high))
            # A word that a passage begins inside of belongs to the one before.
            heads = [w for w in words]
            mean = min((len(passage) - sum(passage.count(bytes([b])) for b in b" \t\r\x0b\x0c\n")) / max(1, len(heads)) / 10, 3) if heads else 0.0
            rows.append([*[x / max(1, len(passage)) for x in shares], doubled / max(1, len(passage)), len(set(heads)) / max(1, len(heads)), mean, np.log1p(len(passage)) / 10])
    assert starts.tolist() == firsts
    wanted = np.array(rows)
    assert found.shape == wanted.shape and np.allclose(found, wanted)
