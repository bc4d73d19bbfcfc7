"""Rows with everything that operators must stand: nulls, empty, very long and repeated texts,
ties, and further columns whose names results have too."""

import random

CLASHING = "score double, component_id string, kept string, row string, n_words string, sampled string, text_ string"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


def documents(spark, extra=()):
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "delta", "the", "of", "été", "x1", "naïve", "zeta", "eta,", "theta."]

    def prose(n):
        return " ".join(rng.choice(words) + str(rng.randrange(60)) for _ in range(n))

    passage = prose(40)
    base = prose(300)
    texts = [
        None, "", "   \n\t ", "one", "two words", base, base, base + " tail", prose(50) + " " + passage + " " + prose(50),
        prose(30) + "\n" + passage, passage, "same same " * 400, "same same " * 400, prose(20_000), *[prose(60) for _ in range(20)], *extra,
    ]
    rows = [(i, t, ["en", "de", None][i % 3], ["s0", None, "s1"][i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base, None, None, None), (None, "no id here", "en", "s0", 10)]
    return spark.createDataFrame([(*r, 0.5, "c", "k", "r", "n", "s", "t") for r in rows], DOCS).repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)
