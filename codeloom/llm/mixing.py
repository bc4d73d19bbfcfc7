"""Mixing documents to target weights by iterative proportional fitting, all in DataFrame
operations.

Tokens are counted by cell (source, language, topic). Raking scales the cells in turn to the
target tokens of each source, language and topic, under a bound: no cell is taken more than
``max_copies`` times (once, for plain sampling). So a cell that is full stays so while the others
are raked on, until all targets that can be met are met. The scaled cells give the
probability, or number of copies, with which their documents are sampled.

A source, language or topic with fewer tokens than its target is taken whole, as often as
allowed, and what it lacks goes to the others in proportion to their targets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.workspace import materialize

#: A text has the first topic of which it holds a part of a word, in lower case.
TOPICS = {
    "legal": ("license", "copyright", "all rights reserved"),
    "contact": ("@", "http", "phone"),
    "technical": ("api_key", "token", "password"),
    "table": (" | ",),
}
OTHER = "other"
GENERAL = "general"
#: Target shares of tokens; languages not named are one, ``other``.
LANG_TARGETS = {"en": 0.55, "de": 0.17, "fr": 0.16, "es": 0.11, OTHER: 0.01}
TOPIC_TARGETS = {GENERAL: 0.87, "legal": 0.05, "contact": 0.03, "technical": 0.03, "table": 0.02}
#: The target of a source is its share of tokens to this power, which lifts small ones.
SOURCE_POWER = 0.7
#: Share of all tokens to sample.
BUDGET = 0.8
#: Raking ends when no sum is off by more than this share of all tokens, or after so many sweeps.
TOLERANCE = 1e-10
MAX_SWEEPS = 24
#: A source that can't reach its target has this factor, which fills all its cells.
ENDLESS = 1e18
SEED = "mix"

WORDS = "[^\\x20\\x09-\\x0D]+"


def token_count(text: Column) -> Column:
    """Words between white space; none in null or empty texts."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def topic_of(text: Column, topics: dict[str, tuple[str, ...]] = TOPICS) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit("")))
    topic = F.lit(GENERAL)
    for name, parts in reversed(topics.items()):
        topic = F.when(reduce(Column.__or__, [F.contains(lowered, F.lit(p)) for p in parts]), F.lit(name)).otherwise(topic)
    return topic


def lang_of(lang: Column, targets: dict[str, float] = LANG_TARGETS) -> Column:
    return F.when(lang.isin(*[x for x in targets if x != OTHER]), lang).otherwise(F.lit(OTHER))


def unit_of(doc_id: Column, seed: str = SEED) -> Column:
    """A number from 0 to below 1 by the hash of an id: 52 bits of its MD5."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _filled(there: dict[str, float], shares: dict[str, float], budget: float) -> tuple[dict[str, float], set[str]]:
    """Target tokens that add up to the budget, by the shares of values that are there, none more
    than there is; and the values that are taken whole."""
    full: set[str] = set()
    known = {v for v, n in there.items() if n > 0}
    while True:
        left = sum(shares.get(v, 0.0) for v in sorted(known - full))
        rate = (budget - sum(there[v] for v in sorted(full))) / left if left > 0 else 0.0
        more = {v for v in known - full if shares.get(v, 0.0) > 0 and rate * shares[v] >= there[v]}
        if not more:
            return {v: there[v] if v in full else max(0.0, rate) * shares.get(v, 0.0) for v in there}, full
        full |= more


def rake(
    cells: DataFrame,
    lang_targets: dict[str, float] = LANG_TARGETS,
    topic_targets: dict[str, float] = TOPIC_TARGETS,
    source_power: float = SOURCE_POWER,
    budget: float = BUDGET,
    max_copies: float = 1.0,
    max_sweeps: int = MAX_SWEEPS,
) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``expected``, how often to take each of the
    cell's tokens, at most ``max_copies``: together ``budget`` of all, in the target shares as far as
    they can be met.

    A sweep fits sources, then languages, then topics. Sources are many, so the factor that
    brings one just to its target is worked out inside the source's row: taken ``a`` times, its cells hold
    a concave sum of pieces, and ``a`` is the largest root of the pieces' lines. Languages
    and topics are those of the targets, so what a sweep brings to the driver is two sums for each
    pair of them, whatever the input. Ends when all sums are met to ``TOLERANCE``. Cells
    without tokens are expected 0 times; targets of absent values are spread over the rest.
    """
    cap = float(max_copies)
    langs, topics = list(lang_targets), list(topic_targets)
    pairs = [(x, y) for x in langs for y in topics]
    sums = [
        F.coalesce(F.sum(F.when((F.col("lang") == x) & (F.col("topic") == y), F.col("tokens"))), F.lit(0)).cast("double")
        for x, y in pairs
    ]
    whole = F.sum("tokens").cast("double")
    # Tokens by pair are an array, and so are factors: what changes from sweep to sweep is data, not code to compile.
    rows = cells.groupBy("source").agg(F.pow(whole, F.lit(source_power)).alias("raw"), whole.alias("n"), F.array(*sums).alias("ns"))
    rows = materialize(rows, "sources")

    def totals(source: DataFrame, amounts: Column) -> dict[tuple[str, str], float]:
        each = source.select(amounts.alias("x"))
        found = each.agg(*[F.sum(F.col("x")[i]) for i in range(len(pairs))]).first()
        return {pair: x or 0.0 for pair, x in zip(pairs, found, strict=True)}

    def margins(by_pair: dict) -> tuple[dict[str, float], dict[str, float]]:
        return {x: sum(by_pair[x, y] for y in topics) for x in langs}, {y: sum(by_pair[x, y] for x in langs) for y in topics}

    there = totals(rows, F.col("ns"))
    total = sum(there.values())
    wanted = budget * total
    by_lang, by_topic = margins(there)
    lang_tokens, full_langs = _filled({x: cap * n for x, n in by_lang.items()}, lang_targets, wanted)
    topic_tokens, full_topics = _filled({y: cap * n for y, n in by_topic.items()}, topic_targets, wanted)
    # Sources that are taken whole: as in _filled, by two sums a step.
    rate, full_source = 0.0, F.lit(False)
    while True:
        taken, left = rows.agg(F.sum(F.when(full_source, cap * F.col("n"))), F.sum(F.when(~full_source, F.col("raw")))).first()
        higher = max(0.0, wanted - (taken or 0.0)) / left if left else 0.0
        if higher <= rate * (1 + 1e-12):
            break
        rate = higher
        full_source = (F.col("n") > 0) & (F.col("raw") * F.lit(rate) >= cap * F.col("n"))
    target = F.when(full_source, cap * F.col("n")).otherwise(F.col("raw") * F.lit(rate))
    rows = rows.withColumns({"full": full_source, "target": target})
    free = [i for i, (x, y) in enumerate(pairs) if x not in full_langs and y not in full_topics]
    sure = F.array(*[F.lit(0.0 if i in free else 1.0) for i in range(len(pairs))])
    sure_of_row = F.aggregate(F.zip_with("ns", sure, lambda n, x: n * x), F.lit(0.0), lambda x, y: x + y)
    rest = F.greatest(F.col("target") - F.lit(cap) * sure_of_row, F.lit(0.0))
    rows = materialize(rows.withColumn("rest", rest), "source-targets")
    # What is left to languages and topics besides cells that are taken whole.
    surely = totals(rows, F.when(F.col("full"), F.col("ns")).otherwise(F.zip_with("ns", sure, lambda n, x: n * x)))
    sure_langs, sure_topics = margins(surely)
    left_langs = {x: max(0.0, lang_tokens[x] - cap * sure_langs[x]) for x in langs}
    left_topics = {y: max(0.0, topic_tokens[y] - cap * sure_topics[y]) for y in topics}
    b, c = dict.fromkeys(langs, 1.0), dict.fromkeys(topics, 1.0)

    def weight(i: int) -> float:
        return b[pairs[i][0]] * c[pairs[i][1]] if i in free else 0.0

    def source_factor() -> Column:
        """From the smallest weight on: the slope of the cells so far, and the tokens of all others, which are full."""
        order = sorted((i for i in free if weight(i) > 0), key=lambda i: (-weight(i), pairs[i]), reverse=True)
        if not order:
            return F.lit(0.0)
        items = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(weight(i)).alias("w")) for i in order])
        tokens = F.aggregate(items, F.lit(0.0), lambda x, item: x + F.get("ns", item["i"]))

        def line(state: Column, item: Column) -> Column:
            n = F.get("ns", item["i"])
            slope, filled = state["slope"] + n * item["w"], state["filled"] - n
            root = F.when(slope > 0, (F.col("rest") - F.lit(cap) * filled) / slope).otherwise(F.lit(0.0))
            return F.struct(slope.alias("slope"), filled.alias("filled"), F.greatest(state["best"], root).alias("best"))

        start = F.struct(F.lit(0.0).alias("slope"), tokens.alias("filled"), F.lit(0.0).alias("best"))
        largest = F.aggregate(items, start, line, lambda state: state["best"])
        return F.when(F.col("rest") >= F.lit(cap) * tokens, F.lit(ENDLESS)).otherwise(largest)

    def taken() -> Column:
        weights = F.array(*[F.lit(weight(i)) for i in range(len(pairs))])
        amounts = F.zip_with("ns", weights, lambda n, w: n * F.least(F.lit(cap), F.col("a") * w))
        return F.when(F.col("full"), F.array_repeat(F.lit(0.0), len(pairs))).otherwise(amounts)

    for _ in range(max_sweeps):
        scaled = rows.withColumn("a", source_factor())
        now_langs, now_topics = margins(totals(scaled, taken()))
        off = [abs(now_langs[x] - left_langs[x]) for x in langs if x not in full_langs]
        off += [abs(now_topics[y] - left_topics[y]) for y in topics if y not in full_topics]
        if max(off, default=0.0) <= TOLERANCE * total:
            break
        b = {x: b[x] * left_langs[x] / now_langs[x] if now_langs[x] > 0 else b[x] for x in langs}
        # The sources' factors are those of before, so that topics see the new languages alone.
        now_topics = margins(totals(scaled, taken()))[1]
        c = {y: c[y] * left_topics[y] / now_topics[y] if now_topics[y] > 0 else c[y] for y in topics}
    factors = rows.select("source", "full", source_factor().alias("a"))
    surely_taken = F.col("full") | F.col("lang").isin(*full_langs) | F.col("topic").isin(*full_topics) if full_langs or full_topics else F.col("full")
    times = F.least(F.lit(cap), F.col("a") * _lookup("lang", b) * _lookup("topic", c))
    expected = F.when(F.col("tokens") > 0, F.when(surely_taken, F.lit(cap)).otherwise(times)).otherwise(F.lit(0.0))
    return cells.join(factors, "source").select("source", "lang", "topic", "tokens", expected.alias("expected"))


def _lookup(column: str, factors: dict[str, float]) -> Column:
    value = F.lit(0.0)
    for name, factor in factors.items():
        value = F.when(F.col(column) == name, F.lit(factor)).otherwise(value)
    return value


def with_cells(
    docs: DataFrame, doc_id: str, text: str, lang: str, source: str, targets: dict[str, float], keep: list[str] | None = None
) -> DataFrame:
    """(doc_id, source, lang, topic, tokens) of each row; further columns only in ``keep``, as ``kept``."""
    own = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")] if keep else []
    return docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.coalesce(F.col(f"`{source}`"), F.lit("")).alias("source"),
        lang_of(F.col(f"`{lang}`"), targets).alias("lang"),
        topic_of(F.col(f"`{text}`")).alias("topic"),
        token_count(F.col(f"`{text}`")).alias("tokens"),
        *own,
    )


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    lang_targets: dict[str, float] = LANG_TARGETS,
    topic_targets: dict[str, float] = TOPIC_TARGETS,
    source_power: float = SOURCE_POWER,
    budget: float = BUDGET,
    seed: str = SEED,
    max_copies: int = 1,
    keep: list[str] | None = None,
) -> DataFrame:
    """Each row's source, lang (``other`` if it has no target), topic, tokens,
    ``probability`` and whether it is ``sampled`` (and the columns ``keep``, in a struct ``kept``).

    With ``max_copies`` above 1 the shares of scarce values are met by repeating rows, no more often than
    that: ``copies`` says how often to take a row, the whole part of what its cell expects, and one
    more by the hash for the rest. Rows without tokens are not taken.

    Sampling is by the hash of the id, so a rerun and a lost task give the same rows, and
    rows of one id go together; rows of null ids are one such group. A null source is the
    empty one, a null or unnamed language ``other``, a null text an empty one of no tokens.
    Texts are read twice and never shuffled unless the cells outgrow a broadcast join.
    """
    rows = with_cells(docs, doc_id, text, lang, source, lang_targets, keep)
    cells = materialize(
        rows.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")), "cells"
    )
    raked = rake(cells, lang_targets, topic_targets, source_power, budget, max_copies)
    known = materialize(raked.drop("tokens"), "mix")
    joined = rows.join(known, ["source", "lang", "topic"])
    unit = unit_of(F.col("doc_id"), seed)
    probability = F.least(F.lit(1.0), F.col("expected"))
    own = []
    if max_copies > 1:
        whole = F.floor("expected").cast("int")
        own = [(whole + (unit < F.col("expected") - whole).cast("int")).alias("copies")]
    return joined.select(
        "doc_id", "source", "lang", "topic", "tokens", probability.alias("probability"), (unit < probability).alias("sampled"),
        *own, *(["kept"] if keep else []),
    )


def _sql_case(column: str, whens: list[tuple[str, str]], rest: str) -> str:
    return "CASE " + " ".join(f"WHEN {w} THEN {t}" for w, t in whens) + f" ELSE {rest} END"


def mix_sql() -> str:
    """The same by unrolled common table expressions, with the defaults above."""
    topic = _sql_case(
        "text",
        [(" OR ".join(f"contains(lower(coalesce(text, '')), '{p}')" for p in parts), f"'{name}'") for name, parts in TOPICS.items()],
        f"'{GENERAL}'",
    )
    named = ", ".join(f"'{x}'" for x in LANG_TARGETS if x != OTHER)
    values = lambda targets: ", ".join(f"('{v}', {t}::DOUBLE)" for v, t in targets.items())
    steps = [
        f"""rows AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source,
          CASE WHEN lang IN ({named}) THEN lang ELSE '{OTHER}' END AS lang, {topic} AS topic,
          len(regexp_extract_all(coalesce(text, ''), '{WORDS}'))::BIGINT AS tokens FROM documents)""",
        "cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS n FROM rows GROUP BY ALL)",
        f"lang_targets(lang, t) AS (VALUES {values(LANG_TARGETS)})",
        f"topic_targets(topic, t) AS (VALUES {values(TOPIC_TARGETS)})",
        "budget AS (SELECT sum(n) AS total, %r * sum(n) AS b FROM cells)" % BUDGET,
    ]
    # Targets by value: the rate at which as many tokens as there are, or as are wanted, add up to the budget.
    for name, column, shares in (
        ("lang", "lang", "SELECT lang AS v, t FROM lang_targets"), ("topic", "topic", "SELECT topic AS v, t FROM topic_targets"),
        ("source", "source", f"SELECT source AS v, pow(sum(n), {SOURCE_POWER}) AS t FROM cells GROUP BY source"),
    ):
        steps += [
            f"""{name}_there AS MATERIALIZED (SELECT v, t, sum(n) AS n FROM ({shares}) JOIN cells ON v = {column} WHERE t > 0 GROUP BY v, t HAVING sum(n) > 0)""",
            f"""{name}_rate AS MATERIALIZED (SELECT greatest(max(CASE WHEN after > 0 THEN ((SELECT b FROM budget) - before) / after ELSE 0 END), 0) AS rate
              FROM (SELECT coalesce(sum(n) OVER (ORDER BY n / t, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                           sum(t) OVER (ORDER BY n / t, v ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM {name}_there))""",
            f"""{name}_goal AS MATERIALIZED (SELECT v, rate * t >= n AS is_full, least(n, rate * t) AS goal FROM {name}_there, {name}_rate)""",
        ]
    steps += [
        """marked AS MATERIALIZED (
          SELECT c.*, coalesce(l.is_full, false) OR coalesce(t.is_full, false) OR coalesce(s.is_full, false) AS sure
          FROM cells c LEFT JOIN lang_goal l ON l.v = lang LEFT JOIN topic_goal t ON t.v = topic LEFT JOIN source_goal s ON s.v = source)""",
    ]
    for name in ("lang", "topic", "source"):
        steps.append(
            f"""{name}_left AS MATERIALIZED (SELECT m.{name} AS v, greatest(0, coalesce(any_value(goal), 0) - coalesce(sum(n) FILTER (sure), 0)) AS goal
              FROM marked m LEFT JOIN {name}_goal g ON g.v = m.{name} GROUP BY m.{name})"""
        )
    steps += ["b0 AS (SELECT v, 1.0::DOUBLE AS f FROM lang_left)", "c0 AS (SELECT v, 1.0::DOUBLE AS f FROM topic_left)"]

    def source_factors(i: int) -> list[str]:
        return [
            f"""w{i} AS MATERIALIZED (SELECT source, lang, topic, n, b.f * c.f AS w FROM marked JOIN b{i} b ON b.v = lang JOIN c{i} c ON c.v = topic
              WHERE NOT sure AND n > 0 AND b.f * c.f > 0)""",
            f"""a{i} AS MATERIALIZED (SELECT source, CASE WHEN any_value(goal) >= sum(n) THEN {ENDLESS!r}
                ELSE greatest(0, max(CASE WHEN slope > 0 THEN (goal - filled) / slope ELSE 0 END)) END AS a
              FROM (SELECT source, goal, n, coalesce(sum(n) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
                           sum(n * w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS slope
                    FROM w{i} JOIN source_left ON v = source WINDOW o AS (PARTITION BY source ORDER BY w DESC, lang, topic))
              GROUP BY source)""",
        ]

    for i in range(MAX_SWEEPS):
        steps += source_factors(i)
        taken = "sum(n * least(1, a * b.f * c.f))"
        for now, old, column, left, pair in ((f"b{i + 1}", f"b{i}", "lang", "lang_left", (f"b{i}", f"c{i}")), (f"c{i + 1}", f"c{i}", "topic", "topic_left", (f"b{i + 1}", f"c{i}"))):
            steps.append(
                f"""{now} AS MATERIALIZED (SELECT o.v, CASE WHEN s > 0 THEN o.f * goal / s ELSE o.f END AS f FROM {old} o JOIN {left} l ON l.v = o.v LEFT JOIN (
                  SELECT {column} AS v, {taken} AS s FROM marked JOIN a{i} USING (source) JOIN {pair[0]} b ON b.v = lang JOIN {pair[1]} c ON c.v = topic
                  WHERE NOT sure GROUP BY {column}) x ON x.v = o.v)"""
            )
    steps += source_factors(MAX_SWEEPS)
    steps.append(
        f"""ratios AS MATERIALIZED (SELECT m.source, m.lang, m.topic, CASE WHEN n <= 0 THEN 0.0 WHEN sure THEN 1.0 ELSE least(1, coalesce(a * b.f * c.f, 0)) END AS p
          FROM marked m LEFT JOIN a{MAX_SWEEPS} USING (source) LEFT JOIN b{MAX_SWEEPS} b ON b.v = lang LEFT JOIN c{MAX_SWEEPS} c ON c.v = topic)"""
    )
    return f"""WITH {", ".join(steps)}
      SELECT doc_id, source, lang, topic, tokens, round(p, 6) AS probability,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{SEED}'), 1, 13))::BIGINT::DOUBLE / {1 << 52}::DOUBLE < p AS sampled
      FROM rows JOIN ratios USING (source, lang, topic)"""
