import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.operators import evaluate, metrics

WORDS = st.lists(st.sampled_from("abcde"), max_size=12)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[-1]))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_bit_parallel_distance(a, b):
    distance = metrics._Distances(b)
    assert distance(a) == edit_distance(a, b)
    if b:
        for cut in range(len(a) + 1):
            assert distance(a[cut:], distance.columns(a)[cut]) == edit_distance(a, b)


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_bit_parallel_subsequence(a, b):
    assert metrics._lcs_length(a, b) == lcs(a, b)


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_shifts_never_cost_more(a, b):
    edits = metrics.translation_edits(a, b)
    assert edits <= edit_distance(a, b)
    missing = sum((Counter(b) - Counter(a)).values()), sum((Counter(a) - Counter(b)).values())
    assert edits >= max(missing)


def test_long_distance():
    rng = random.Random(1)
    a, b = ([rng.choice("abcdefgh") for _ in range(n)] for n in (300, 250))
    assert metrics._Distances(b)(a) == edit_distance(a, b)
    assert metrics._lcs_length(a, b) == lcs(a, b)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(WORDS, WORDS), max_size=12))
def test_pairs_moved_together_cost_what_each_costs_alone(pairs):
    together = metrics.translation_edits_of_pairs([a for a, _ in pairs], [b for _, b in pairs])
    assert together == [metrics.translation_edits(a, b) for a, b in pairs]


def test_long_pairs_moved_together(monkeypatch):
    rng = random.Random(5)
    pairs = [tuple([rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(1, 150))] for _ in range(2)) for _ in range(12)]
    alone = [metrics.translation_edits(a, b) for a, b in pairs]
    for cells in (1 << 24, 1 << 19, 1 << 17):  # one group, several, and long pairs on their own
        monkeypatch.setattr(metrics, "GROUP_CELLS", cells)
        assert metrics.translation_edits_of_pairs([a for a, _ in pairs], [b for _, b in pairs]) == alone


def test_most_moves_are_ruled_out_before_they_are_measured(monkeypatch):
    """Columns stepped for moves, of pairs of random words of one language: a bound leaves about half to
    measure. Pairs are moved on together, so rounds are those of the pair with most, not of a group each."""
    rng = random.Random(5)
    words = [[rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(20, 150))] for _ in range(60)]
    hyps, refs = words[:30], words[30:]
    rounds, found, measured = [], [], []
    one_round, possible, after = metrics._round, metrics._moves_of_pairs, metrics._edits_after_moves

    def seen_moves(*args):
        found.append(moves := possible(*args))
        return moves

    def seen_measured(moves, *args):
        measured.append(len(moves))
        return after(moves, *args)

    monkeypatch.setattr(metrics, "_round", lambda *args: rounds.append(1) or one_round(*args))
    monkeypatch.setattr(metrics, "_moves_of_pairs", seen_moves)
    monkeypatch.setattr(metrics, "_edits_after_moves", seen_measured)
    assert metrics.translation_edits_of_pairs(hyps, refs) == [metrics.translation_edits(h, r) for h, r in zip(hyps, refs)]
    assert sum(measured) < 0.6 * sum(map(len, found))
    alone = []
    for h, r in zip(hyps, refs):
        before = len(rounds)
        metrics.translation_edits_of_pairs([h], [r])
        alone.append(len(rounds) - before)
    assert len(rounds) - sum(alone) == max(alone)


def test_a_move_that_gains_all_it_may_ends_the_search(monkeypatch):
    """Of pairs of random words most moves may gain one edit, and most do: the first that does is the best."""
    rng = random.Random(6)
    words = [[rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(60, 120))] for _ in range(12)]
    hyps, refs = words[:6], words[6:]
    found, measured = [], []
    possible, after = metrics._moves_of_pairs, metrics._edits_after_moves

    def seen_moves(*args):
        found.append(moves := possible(*args))
        return moves

    def seen_measured(moves, *args):
        measured.append(len(moves))
        return after(moves, *args)

    monkeypatch.setattr(metrics, "_moves_of_pairs", seen_moves)
    monkeypatch.setattr(metrics, "_edits_after_moves", seen_measured)
    assert metrics.translation_edits_of_pairs(hyps, refs) == [metrics.translation_edits(h, r) for h, r in zip(hyps, refs)]
    assert sum(measured) < 0.25 * sum(map(len, found))


def test_pairs_of_the_next_batch_take_the_room_of_those_done(monkeypatch):
    """Results come batch by batch, empty ones too; batches are read ahead only as far as there is room."""
    rng = random.Random(7)
    pairs = [tuple([rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(20, 40))] for _ in range(2)) for _ in range(600)]
    pairs[5:8] = [([], []), (["a"], []), ([], ["a", "b"])]
    batches = [[], *(pairs[at : at + 30] for at in range(0, 600, 30))]
    rounds, read, ahead = [], [], []
    one_round = metrics._round
    monkeypatch.setattr(metrics, "GROUP_CELLS", 1 << 17)
    monkeypatch.setattr(metrics, "_round", lambda *args: rounds.append(1) or one_round(*args))

    def coming():
        for batch in batches:
            read.append(1)
            yield [a for a, _ in batch], [b for _, b in batch]

    def results():
        for i, edits in enumerate(metrics.translation_edits_of_batches(coming())):
            ahead.append(len(read) - i)
            yield edits

    together = list(results())
    n_together = len(rounds)
    assert together == [metrics.translation_edits_of_pairs([a for a, _ in batch], [b for _, b in batch]) for batch in batches]
    assert len(ahead) == len(read) == 21 and max(ahead) < 16
    assert n_together < (len(rounds) - n_together) / 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(WORDS, WORDS), min_size=1, max_size=8))
def test_ngram_matches_of_many_pairs(pairs):
    sides = [[p for p, _ in pairs], [r for _, r in pairs]]
    numbers = [[ord(w) - 97 for words in side for w in words] for side in sides]
    found = metrics.ngram_matches([*map(np.array, numbers)], [np.array([len(w) for w in side]) for side in sides])
    for i, (p, r) in enumerate(pairs):
        for n in range(1, 5):
            grams = [Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) for w in (p, r)]
            assert found[n - 1, i] == sum((grams[0] & grams[1]).values())


def test_translation_edits_examples():
    # One block moved, counted once, as in the published description of the measure.
    hyp = "this week the saudis denied information published in the new york times".split()
    ref = "saudi arabia denied this week information published in the american new york times".split()
    assert edit_distance(hyp, ref) > metrics.translation_edits(hyp, ref) == 4
    assert metrics.translation_edits("b c a".split(), "a b c".split()) == 1
    assert metrics.translation_edits([], ["a"]) == 1
    assert metrics.translation_edits(["a"], []) == 1


CASES = [
    ("the cat sat on the mat", "the cat sat on the mat"),
    ("the the the the", "the cat is on the mat"),
    ("", "a b c d"),
    ("a b c d", ""),
    ("x y z", "a b c"),
    ("It costs 1,000.50 dollars, doesn't it?", "It costs 1,000.50 dollars, does it?"),
    ("a b c d e f", "a b c d e f g h i j"),
]


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(5)
    words = ["the", "cat", "sat", "on", "mat", "a", "dog."]
    more = [
        tuple(" ".join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(2))
        for _ in range(60)
    ]
    rows = [(i, p, r) for i, (p, r) in enumerate(CASES + more)]
    return rows, spark.createDataFrame(rows, "i int, p string, r string").cache()


def simple_bleu(p, r):
    """Over given tokens."""
    logs = 0.0
    for n in range(1, 5):
        grams = [Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (p, r)]
        match = sum((grams[0] & grams[1]).values())
        if not match:
            return 0.0
        logs += math.log(match / (len(p) - n + 1)) / 4
    return math.exp(logs) * (1.0 if len(p) > len(r) else math.exp(1 - len(r) / len(p)))


def test_bleu(pairs):
    rows, df = pairs
    p, r = F.col("p"), F.col("r")
    found = df.select(
        "i",
        metrics.bleu_tokens(p).alias("pt"),
        metrics.bleu_tokens(r).alias("rt"),
        metrics.bleu_score(metrics.bleu_counts(p, r)).alias("bleu"),
    ).collect()
    for row in found:
        assert row["bleu"] == pytest.approx(simple_bleu(row["pt"], row["rt"]), abs=1e-12)
    by_i = {row["i"]: row for row in found}
    assert by_i[0]["bleu"] == pytest.approx(1.0)
    assert by_i[5]["pt"] == ["It", "costs", "1,000.50", "dollars", ",", "doesn't", "it", "?"]


def test_rouge_l_and_edit_rates(pairs):
    rows, df = pairs
    p, r = F.col("p"), F.col("r")
    found = {
        x["i"]: x
        for x in df.select(
            "i",
            metrics.rouge_l(p, r).alias("rouge"),
            metrics.word_edit_rate(p, r).alias("wer"),
            metrics.ter(p, r).alias("ter"),
        ).collect()
    }
    for i, a, b in rows:
        at, bt = a.lower().split(), b.lower().split()
        n = edit_distance(at, bt)
        assert found[i]["wer"] == pytest.approx(100 * n / len(bt) if bt else 100.0 * (n > 0))
        assert found[i]["ter"] <= found[i]["wer"] + 1e-9
        ap, bp = a.lower().replace(".", " ").split(), b.lower().replace(".", " ").split()
        if i >= len(CASES) or i < 5:
            common = lcs(ap, bp)
            wanted = 2 * common / (len(ap) + len(bp)) if common else 0.0
            assert found[i]["rouge"] == pytest.approx(wanted)


def test_blind_pairs(spark):
    rows = [(f"r{i}", 1, "q", "s", "n") for i in range(40)]
    wide = spark.createDataFrame(rows, "repo string, n int, question string, smart_response string, naive_response string")
    shown = evaluate.ab_pairs(wide, ["repo", "n"]).collect()
    again = evaluate.ab_pairs(wide.repartition(5), ["repo", "n"]).collect()
    assert sorted(shown) == sorted(again)
    assert {r["first_mode"] for r in shown} == {"smart", "naive"}
    for r in shown:
        assert (r["response_a"], r["response_b"]) == (("s", "n") if r["first_mode"] == "smart" else ("n", "s"))
        assert r["prompt"].index(f"Response A:\n{r['response_a']}") < r["prompt"].index("Response B:")


def test_choice_is_by_position(spark):
    rows = [(" A ", "naive"), ("B", "naive"), ("A", "smart"), ("Both", "smart"), ("", "smart")]
    df = spark.createDataFrame(rows, "reply string, first_mode string")
    found = [r[0] for r in df.select(evaluate.chosen_mode(F.col("reply"), F.col("first_mode"))).collect()]
    assert found == ["naive", "smart", "smart", None, None]


def test_missing_responses_score_null(spark):
    rows = [("p", 1, "q", "a b", "a b", None)]
    wide = spark.createDataFrame(
        rows, "repo string, n int, question string, reference string, smart_response string, naive_response string"
    )
    scores = evaluate.score_responses(evaluate.long_responses(wide))
    found = {r["mode"]: r for r in scores.collect()}
    assert found["smart"]["rouge_l"] == 1.0 and found["smart"]["ter"] == 0.0
    assert found["naive"]["bleu"] is None and found["naive"]["ter"] is None
    nested = evaluate.nested_metrics(scores, ["repo", "n"]).first()["metrics"]
    assert nested["smart"]["rougeL"] == 1.0 and nested["naive"]["bleu"] is None
    judged = scores.crossJoin(spark.createDataFrame([("smart",)], "chosen_mode string"))
    report = evaluate.report_by_mode(evaluate.eval_report(judged, ["repo"]), ["repo"]).first()
    assert report["smart_n_preferred"] == 1 and report["naive_preference_share"] == 0.0
    assert report["naive_n_scored"] == 0


def test_long_texts_match_in_linear_time(spark):
    """Copies are not searched for: a hundred thousand words of few kinds are counted in a moment."""
    import time

    rows = [(i, [f"w{j % 50}" for j in range(50_000)], [f"w{j % 70}" for j in range(50_000)]) for i in range(2)]
    df = spark.createDataFrame(rows, "i int, p array<string>, r array<string>")
    began = time.perf_counter()
    found = [r[0] for r in df.select(metrics.clipped_matches(F.col("p"), F.col("r"))).collect()]
    assert time.perf_counter() - began < 20
    left, right = Counter(rows[0][1]), Counter(rows[0][2])
    assert found == [sum((left & right).values())] * 2


def test_pooled_bleu_is_that_of_all_answers(spark):
    """Counts add up: of short answers without a common four-gram each, the group has a score."""
    pairs = [("a b c d e", "a b c d x"), ("f g", "f g"), ("h i j", "h i k l m"), ("", "n")]
    df = spark.createDataFrame(pairs, "p string, r string")
    counted = df.select(metrics.bleu_counts(F.col("p"), F.col("r")).alias("c"))
    found = counted.agg(metrics.pooled_bleu(F.col("c")).alias("b")).first()["b"]
    m, t, p, r = [0] * 4, [0] * 4, 0, 0
    for x, y in ((a.split(), b.split()) for a, b in pairs):
        p, r = p + len(x), r + len(y)
        for n in range(1, 5):
            grams = [Counter(zip(*[z[i:] for i in range(n)], strict=False)) for z in (x, y)]
            m[n - 1] += sum((grams[0] & grams[1]).values())
            t[n - 1] += max(0, len(x) - n + 1)
    wanted = math.exp(sum(math.log(a / b) for a, b in zip(m, t, strict=True)) / 4) * (1 if p > r else math.exp(1 - r / p))
    assert found == pytest.approx(wanted)
    assert counted.where("false").agg(metrics.pooled_bleu(F.col("c")).alias("b")).first()["b"] is None
