"""Quotient filters give back what went in; phrases against direct counts."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import documents, no_documents

from codeloom.llm import collocations
from codeloom.llm import quotient_filter as qf


@pytest.mark.parametrize("bits", [2, 4, 12, 20, 22, 42])
@pytest.mark.parametrize("n", [0, 1, 4000])
def test_filters_lose_nothing(bits, n):
    rng = np.random.default_rng(bits + n)
    half = 3 * bits // 2
    ids = [rng.integers(1, min(1 << bits, 60), n) for _ in range(3)]
    ids[2][rng.random(n) < 0.3] = 0
    high, low = qf.pack(ids, bits)
    assert all((a == b).all() for a, b in zip(qf.unpack(high, low, bits), ids, strict=True))
    mixed = qf.permute(high, low, half)
    assert all((a == b).all() for a, b in zip(qf.restore(*mixed, half), (high, low), strict=True))
    for shard_bits in (0, min(3, half)):
        filters = {}
        for part in (slice(0, n // 3), slice(n // 3, n)):
            for shard, data in qf.shards(*qf.tally(mixed[0][part], mixed[1][part], None, half), half, shard_bits):
                filters.setdefault(shard, []).append(data)
        found = Counter()
        for shard, data in filters.items():
            keys, rest, counts = qf.merge(data, half, shard_bits, shard)
            for *key, count in zip(*qf.unpack(*qf.restore(keys, rest, half), bits), counts.tolist(), strict=True):
                found[tuple(map(int, key))] += count
        assert found == Counter(zip(*[x.tolist() for x in ids], strict=True))


def test_filters_are_compact_and_hold_large_counts():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 30, 60_000).astype(np.uint64)
    counts = np.where(np.arange(60_000) % 50 == 0, 10**12, 3)
    high, low, counts = qf.tally(*qf.permute(keys, keys & np.uint64((1 << 18) - 1), 30), counts, 30)
    data = qf.encode(high, low, counts, 30, 0)
    assert len(data) < 10 * len(high)
    back = qf.decode(data, 30, 0, 0)
    assert all((a == b).all() for a, b in zip(back, (high, low, counts), strict=True))


def expected(rows, min_count, covered, top):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, sizes = {}, Counter()
    for lang, text in rows:
        f = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(upper)):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang or "und"] += len(words)
            f.update(tuple(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < min_count:
                continue
            longer = [f[q] for q in f if len(q) > len(p) and f[q] >= min_count and p in (q[:2], q[1:])]
            if any(100 * x >= covered * a for x in longer):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, sizes[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(("min_count", "covered", "top"), [(10, 50, 2000), (2, 50, 7), (1, 101, 300)])
def test_equals_direct_counts(spark, min_count, covered, top):
    rng = random.Random(2)
    words = ["new", "York", "the", "of", "\x1c", "été", "ÉTÉ", "a b", "x y", "to", "be"]
    extra = [
        "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randrange(90)))
        for _ in range(60)
    ]
    docs = documents(spark, extra)
    rows = [(r.lang, r.text) for r in docs.collect() if not r.text or len(r.text) < 20_000]
    some = docs.where("text IS NULL OR length(text) < 20000")
    found = collocations.mine_collocations(some, min_count=min_count, covered=covered, top=top)
    assert sorted(map(tuple, found.collect())) == expected(rows, min_count, covered, top)


def test_products_pass_64_bits(spark):
    big = 3 * 10**12
    counts = spark.createDataFrame([(1, 2, 0, big)], "w1 long, w2 long, w3 long, f long")
    words = spark.createDataFrame([("en", "a", big + 1, 1), ("en", "b", big + 7, 2)], "lang string, word string, f long, id long")
    found = collocations.scored_phrases(counts, words).collect()
    assert [r.score for r in found] == [1_000_000 * big * big // ((big + 1) * (big + 7))]


def test_no_words(spark):
    assert collocations.mine_collocations(no_documents(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, "en"), (2, " .\n", None)], "doc_id long, text string, lang string")
    assert collocations.mine_collocations(blank).count() == 0
