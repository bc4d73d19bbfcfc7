"""Toxicity by a weighted finite-state grammar over clauses.

Words become classes (insult, threat, target, negation, reported speech). One small
automaton each follows insults, threats, targets, negation and reported speech; their
composition reads a clause and ends in a state that names the kind of clause. Each kind
has a weight, and a text is scored by its weighted clauses, not by words on their own.
Insults and weights are learned from labels.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import map_rows
from codeloom.workspace import materialize

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

# Closed classes of words in English, German, French and Spanish.
THREATS = "kill hurt destroy beat burn stab shoot töten verletzen schlagen tuer frapper blesser matar golpear herir"
TARGETS = "you your yours youre u they them he she him her dich dir euch ihr sie toi vous tu te ti usted ustedes"
NEGATIONS = "not no never isnt arent dont without nicht kein keine nie niemals pas jamais nunca jamás"
REPORTS = "said says say told wrote writes called claims quoted reported sagte sagt schrieb nannte dit disait écrit dijo dice escribió"
CLASS_OF = {w: k for k, ws in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS)) for w in ws.split()}

#: Kinds of clauses and the weights that fitting starts from and is drawn to.
KINDS = {"insult": 3.0, "targeted insult": 4.0, "negated": 1.0, "reported": 1.5, "targeted threat": 3.0, "threat": 0.0}
#: Words between a negation and what it negates.
REACH = 3


@dataclass(frozen=True)
class Automaton:
    """Moves by (state, class); a class without a move stays in its state, or goes to ``other``."""

    start: tuple
    moves: dict = field(hash=False)

    def step(self, state: tuple, word: int) -> tuple:
        return self.moves.get((state, word), state)


def compose(left: Automaton, right: Automaton) -> Automaton:
    """Both at once: states are the pairs that can be reached."""
    moves, seen, front = {}, {left.start + right.start}, [(left.start, right.start)]
    while front:
        a, b = front.pop()
        for word in range(6):
            to = left.step(a, word), right.step(b, word)
            moves[a + b, word] = to[0] + to[1]
            if to[0] + to[1] not in seen:
                seen.add(to[0] + to[1])
                front.append(to)
    return Automaton(left.start + right.start, moves)


def _flag(word: int) -> Automaton:
    return Automaton((False,), {((False,), word): (True,)})


def _negation() -> Automaton:
    """(words left in reach, whether a hit stood outside of it)."""
    moves = {}
    for plain in (False, True):
        for left in range(REACH + 1):
            for word in range(6):
                hit = word in (INSULT, THREAT) and not left
                to = REACH if word == NEGATION else max(0, left - 1)
                moves[(left, plain), word] = (to, plain or hit)
    return Automaton((0, False), moves)


def _reported() -> Automaton:
    """(whether a report was read, whether a hit came before any)."""
    moves = {}
    for before in (False, True):
        for word in (INSULT, THREAT):
            moves[(False, before), word] = (False, True)
        moves[(False, before), REPORT] = (True, before)
    return Automaton((False, False), moves)


#: State: insult, threat, target, reach, plain, report, before.
GRAMMAR = reduce(compose, (_flag(INSULT), _flag(THREAT), _flag(TARGET), _negation(), _reported()))


def kind_of(state: tuple) -> int | None:
    insult, threat, target, _, plain, report, before = state
    if not insult and not threat:
        return None
    names = list(KINDS)
    if not plain:
        return names.index("negated")
    if report and not before:
        return names.index("reported")
    if insult:
        return names.index("targeted insult" if target else "insult")
    return names.index("targeted threat" if target else "threat")


@dataclass
class Model:
    """Insults (whole words, and beginnings of words) with their weights; weights of kinds; bias."""

    words: dict[str, float]
    prefixes: dict[str, float]
    weights: np.ndarray
    bias: float


WORD = re.compile(rb"[a-z\x80-\xff]+")
CLAUSE_END = re.compile(rb"[.!?;:\n]")
#: Letters stay (A-Z lowered), apostrophes vanish from between them later, the rest becomes a blank.
LETTERS = bytes(
    b if 97 <= b <= 122 or b >= 0x80 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


def clause_reader(words: dict[str, float], prefixes: dict[str, float]) -> Callable[[bytes | None], np.ndarray]:
    """A function from a text to the weight of its matched clauses by kind."""
    import ahocorasick

    hits = ahocorasick.Automaton()
    for word in [*words, *(w for w, k in CLASS_OF.items() if k == THREAT)]:
        hits.add_word(f" {word} ".encode().decode("latin-1"), 1)
    for prefix in prefixes:
        hits.add_word(f" {prefix}".encode().decode("latin-1"), 1)
    hits.make_automaton()
    lengths = sorted({len(p) for p in prefixes})
    classes: dict[bytes, tuple[int, float]] = {}

    def classify(word: bytes) -> tuple[int, float]:
        if word not in classes:
            plain = word.decode("utf-8", "replace")
            weight = max([words.get(plain, 0.0), *(prefixes.get(plain[:n], 0.0) for n in lengths if n < len(plain))])
            kind = INSULT if weight else CLASS_OF.get(plain, OTHER)
            if len(classes) > 100_000:
                classes.clear()
            classes[word] = kind, weight if weight else float(kind == THREAT)
        return classes[word]

    def read(text: bytes | None) -> np.ndarray:
        out = np.zeros(len(KINDS))
        if not text:
            return out
        line = b" " + text.translate(LETTERS) + b" "
        places = [end for end, _ in hits.iter(line.decode("latin-1"))]
        if not places:
            return out
        cuts = [m.start() + 1 for m in CLAUSE_END.finditer(text)]  # places in line
        done = -1
        for place in places:
            place -= 1  # the last sign of a match may be the blank behind it
            clause = bisect_right(cuts, place)
            if clause == done:
                continue
            done = clause
            begin = cuts[clause - 1] if clause else 0
            end = cuts[clause] if clause < len(cuts) else len(line)
            state, strength = GRAMMAR.start, 0.0
            for word in WORD.finditer(line, begin, end):
                kind, weight = classify(word[0])
                state = GRAMMAR.moves[state, kind]
                strength += weight
            found = kind_of(state)
            if found is not None:
                out[found] += strength
        return out

    return read


def terms_of(text: bytes | None, shortest: int = 4, longest: int = 8) -> set[str]:
    """Whole words (marked by a blank behind) and beginnings of longer words."""
    words = set((text or b"").translate(LETTERS).decode("utf-8", "replace").split())
    terms = {f"{w} " for w in words if len(w) >= 3}
    for n in range(shortest, longest + 1):
        terms.update(w[:n] for w in words if len(w) > n)
    return terms


#: Toxic texts that should each hold so many chosen terms, the least share of them that a term must gain, and the least log odds.
COVERS, LEAST, ODDS = 3, 0.01, 1.5


def term_floor(n_bad: int, least: float = LEAST) -> float:
    """Toxic texts that a term must gain: ``least`` of them, three at least (two of few)."""
    return max(3 if n_bad > 30 else 2, least * n_bad)


def choose_terms(
    where: dict[str, list[int]], others: dict[str, int], n_bad: int, n_others: int,
    covers: int = COVERS, least: float = LEAST, odds: float = ODDS,
) -> tuple[dict[str, float], dict[str, float]]:
    """Words, and beginnings of words, that toxic texts have and others hardly, with weights.

    ``where`` has the numbers of the toxic texts of each term, ``others`` how many other texts
    have it. Greedy: always the term that covers most toxic texts still short of ``covers`` terms,
    less twice the others it meets (scaled to as many others as toxic texts), until the gain
    is below ``term_floor``. Terms need log odds of ``odds``; weights are log odds over 6, 1
    at most. Of equal terms whole words go first, then longer beginnings. No term that begins
    another chosen one is taken.
    """
    cost = 2 * n_bad / max(1, n_others)
    floor = term_floor(n_bad, least)

    def log_odds(t: str) -> float:
        return float(np.log((len(counts[t]) + 0.5) / (n_bad + 1) * (n_others + 1) / (others.get(t, 0) + 0.5)))

    counts = where
    where = {t: at for t, at in where.items() if len(at) - cost * others.get(t, 0) >= floor and log_odds(t) >= odds}
    short = np.full(n_bad, covers)
    chosen: list[str] = []
    while where:
        gains = {t: int((short[at] > 0).sum()) - cost * others.get(t, 0) for t, at in where.items()}
        best = max(gains, key=lambda t: (gains[t], t[-1] == " ", len(t), t))
        if gains[best] < floor:
            break
        chosen.append(best)
        short[where.pop(best)] -= 1
        where = {t: at for t, at in where.items() if gains[t] >= floor and not (t.startswith(best) or best.startswith(t))}
    weight = {t: min(log_odds(t), 6.0) / 6 for t in chosen}
    return {t[:-1]: w for t, w in weight.items() if t[-1] == " "}, {t: w for t, w in weight.items() if t[-1] != " "}


def learn_insults(texts: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """``choose_terms`` for ``texts`` (text, label). Equal texts of one label count once. Terms are
    found and counted where the texts lie; only those frequent enough in toxic texts come to the driver."""
    told = texts.select("label", "text", F.xxhash64("text").alias("t"), F.xxhash64(F.lit(7), "text").alias("u"))
    once = told.dropDuplicates(["t", "u", "label"])

    def start() -> Callable:
        return lambda values: {"terms": [sorted(terms_of(v)) for v in values]}

    listed = map_rows(once, "text", "terms array<string>", start, keep=["t", "label"])
    sizes = {r["label"]: r["n"] for r in once.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_bad, n_others = sizes.get(1, 0), sizes.get(0, 0)
    toxic = F.when(F.col("label") == 1, F.col("t"))
    counted = listed.select("t", "label", F.explode("terms").alias("term")).groupBy("term").agg(
        F.collect_set(toxic).alias("where"), F.count_if(F.col("label") == 0).alias("others")
    )
    cost = 2 * n_bad / max(1, n_others)
    often = counted.where(F.size("where") - cost * F.col("others") >= term_floor(n_bad)).collect()
    number: dict[int, int] = {}
    where = {r["term"]: [number.setdefault(t, len(number)) for t in sorted(r["where"])] for r in sorted(often, key=lambda r: r["term"])}
    return choose_terms(where, {r["term"]: r["others"] for r in often}, n_bad, n_others)


def fit_weights(x: np.ndarray, y: np.ndarray, pull: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic weights of the kinds, never negative, drawn to those of KINDS. Newton steps."""
    prior = np.append(list(KINDS.values()), -3.0)
    w = prior.copy()
    x = np.column_stack([np.log1p(x), np.ones(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + pull * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), grad)
        w = w - step
        w[:-1] = np.maximum(w[:-1], 0)
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    usable: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    max_toxic: int = 2000,
    max_others: int = 4000,
    seed: int = 1,
) -> Model | None:
    """A model from texts of ``docs`` whose row in ``labels`` meets ``usable``; None without any.

    Fitted on a bounded sample, the only one here: at most ``max_toxic`` rows of label 1 and
    ``max_others`` of label 0 (of the smallest hashed doc_id), of any length. Null labels, ids and
    texts are not used; a document labelled twice counts twice for the weights of clauses. Texts
    stay with the tasks: terms are counted and clauses read there.
    """
    usable_rows = labels.where(usable & F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("__id"), (F.col(label) == 1).cast("int").alias("label")
    )
    order = [F.xxhash64("__id", F.lit(seed)), F.col("__id")]
    wanted = (
        usable_rows.where("label = 1").orderBy(*order).limit(max_toxic)
        .unionByName(usable_rows.where("label = 0").orderBy(*order).limit(max_others))
    )
    texts = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")
    rows = materialize(texts.join(F.broadcast(wanted), "__id"), "labelled")
    if rows.isEmpty():
        return None
    words, prefixes = learn_insults(rows)

    def start() -> Callable:
        read = clause_reader(words, prefixes)
        return lambda values: {"clauses": [read(v).tolist() for v in values]}

    read = map_rows(rows, "text", "clauses array<double>", start, keep=["__id", "label"]).collect()
    read.sort(key=lambda r: (r["__id"], r["label"], r["clauses"]))
    weights, bias = fit_weights(np.array([r["clauses"] for r in read]), np.array([r["label"] for r in read], float))
    return Model(words, prefixes, weights, bias)


def score(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all, if None) with ``score`` (0 to 1), ``predicted`` (1 if it is at
    least 0.5) and ``clauses``, the weight of matched clauses by kind (as in KINDS).

    Whole texts are read; the text is the only input. Null and empty texts have no clause.
    Without a model there are no insults and the weights are those of KINDS. Columns named
    as the results are replaced. One pass, no shuffle.
    """
    model = model or Model({}, {}, np.array(list(KINDS.values())), -3.0)

    def start() -> Callable:
        read = clause_reader(model.words, model.prefixes)

        def compute(texts: list) -> dict:
            clauses = np.array([read(t) for t in texts])
            scores = 1 / (1 + np.exp(-np.clip(np.log1p(clauses) @ model.weights + model.bias, -30, 30)))
            return {"score": scores, "predicted": (scores >= 0.5).astype(np.int32), "clauses": clauses.tolist()}

        return compute

    return map_rows(docs, text, "score double, predicted int, clauses array<double>", start, keep)
