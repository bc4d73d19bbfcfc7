"""Operators on texts against brute force, and on rows that are easily got wrong."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
import xxhash
from conftest import SMALL
from helpers import documents, no_documents, rows_of

from codeloom.llm import fm_index, license_scan, mixing, packing, simhash_dedup, substring_dedup
from codeloom.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


class Sets:
    def __init__(self, n):
        self.root = list(range(n))

    def find(self, i):
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def link(self, i, j):
        x, y = self.find(i), self.find(j)
        self.root[max(x, y)] = min(x, y)


# --- licence scan


def test_license_base(spark):
    extra = [
        "Released under the MIT License.", "cc by nc CC-BY-NC cc, by; nc", "Apache License, Version 2.0",
        "apache license version 20", "under the mit", "x under the mit license under the mit license y",
    ]
    docs = documents(spark, extra)
    found = license_scan.scan_licenses(docs.select("doc_id", "text", "score"), keep=["doc_id", "text", "score"])
    assert found.columns[:2] == ["doc_id", "text"] and found.columns.count("score") == 1
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    for row in found.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(row.text))
        places = [
            (i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()
        ]
        starts = [i for i, _ in places]
        assert (row.n_words, row.n_base) == (len(words), len(places))
        assert (row.first_word, row.last_word) == (min(starts, default=None), max(starts, default=None))
        assert row.base_labels == ",".join(sorted({x for _, x in places}))
        assert 0 <= row.score <= 1 and set(row.base_labels.split(",")) <= set(row.labels.split(","))


@pytest.mark.parametrize(
    ("expression", "labels", "usable"),
    [
        ("MIT", "mit", True),
        ("MIT OR GPL-3.0", "gpl-3.0,mit", True),
        ("MIT AND GPL-3.0", "gpl-3.0,mit", False),
        ("GPL-3.0 AND (MIT OR ISC)", "gpl-3.0,isc,mit", False),
        ("GPL-3.0 OR MIT AND ISC", "gpl-3.0,isc,mit", True),
        ("(GPL-3.0 OR MIT) AND Apache-2.0", "apache-2,gpl-3.0,mit", True),
        ("GPL-2.0 WITH Classpath-exception-2.0 OR MIT", "gpl-2.0-with-classpath-exception-2.0,mit", True),
        ("MIT OR", None, None),
        ("(MIT", None, None),
        ("(MIT OR ISC) WITH Some-exception", None, None),
        ("", None, None),
    ],
)
def test_license_expressions(expression, labels, usable):
    tokens = license_scan.read_expression(expression.lower().encode(), 0)
    postfix = license_scan.to_postfix(tokens)
    value = license_scan.evaluate(postfix, frozenset(license_scan.ALLOWED)) if postfix else None
    if labels is None:
        assert value is None
    else:
        assert (",".join(sorted(value[0])), value[1]) == (labels, usable)


def test_license_tag_in_text(spark):
    text = "/* SPDX-License-Identifier: (MIT OR GPL-2.0)\nmit isc */ and SPDX-License-Identifier: OR"
    row = license_scan.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.labels, row.expressions, row.bad_expressions, row.usable) == ("gpl-2.0,mit", ["( mit or gpl-2.0 )"], 1, True)
    assert license_scan.scan_licenses(no_documents(spark)).count() == 0


# --- SimHash


def fingerprint(text):
    words = WORD.findall(lowered(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark):
    docs = documents(spark)
    found = simhash_dedup.near_duplicates(docs)
    rows = [(r.doc_id, fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    sets = Sets(len(rows))
    for i, (_, x) in enumerate(rows):
        for j, (_, y) in enumerate(rows[:i]):
            if (x ^ y).bit_count() <= 3:
                sets.link(i, j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        ids = [x for x in (least.get(sets.find(i)), doc_id) if x is not None]
        least[sets.find(i)] = min(ids, default=None)
    expected = [(d, f"{x:016x}", least[sets.find(i)]) for i, (d, x) in enumerate(rows)]
    assert rows_of(found) == sorted(expected, key=repr)
    assert simhash_dedup.near_duplicates(no_documents(spark)).count() == 0


@pytest.mark.parametrize("max_bits", [1, 2, 3, 4])
def test_pairs_that_share_enough_bytes_meet(max_bits):
    lists = simhash_dedup.list_positions(max_bits)
    least = simhash_dedup.N_BYTES - max_bits
    assert all(len(x) == least - 1 for x in lists)
    assert all(any(set(x) <= set(c) for x in lists) for c in itertools.combinations(range(simhash_dedup.N_BYTES), least))


def test_the_tally_throws_pairs_out():
    """Members of one list share its four bytes; with no fifth a pair is not even verified."""
    base = np.uint64(0x0102030405060708)
    others = [base ^ np.uint64(0x1111111100000000), base ^ np.uint64(0x0011111100000000), base ^ np.uint64(0x0000000100000000)]
    fps = np.array([base, *others], np.uint64).view(np.int64)
    pairs = {(int(x), int(y)) for xs, ys in simhash_dedup.tallied(fps, 3) for x, y in zip(xs, ys, strict=True)}
    assert pairs == {(0, 2), (1, 2), (0, 3), (2, 3)}  # (0, 1) and (1, 3) share four bytes alone
    links = {frozenset(x) for x in simhash_dedup.links_in_list(fps, 3)}
    assert links == {frozenset(map(int, fps[[1, 2]])), frozenset(map(int, fps[[0, 3]]))}  # the others differ in more bits


def test_fingerprint_links_hold_groups_together():
    rng = np.random.default_rng(3)
    flips = [sum(1 << int(b) for b in rng.choice(24, rng.integers(0, 7), replace=False)) for _ in range(400)]
    fps = np.unique(np.uint64(0x1234567887654321) ^ np.array(flips, np.uint64))
    links = simhash_dedup.links_in_list(fps.view(np.int64), 3)
    assert len(links) < len(fps)
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    found, wanted = Sets(len(fps)), Sets(len(fps))
    for a, b in links:
        assert int(np.bitwise_count(np.uint64(a % (1 << 64)) ^ np.uint64(b % (1 << 64)))) <= 3
        found.link(at[a], at[b])
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[:i]) <= 3):
            wanted.link(i, int(j))
    assert [found.find(i) for i in range(len(fps))] == [wanted.find(i) for i in range(len(fps))]


# --- substring deduplication


def cut(rows, window=13):
    """Brute force: (doc_id, n_words, n_removed, sha256 of the kept words) of each row."""
    first = {}
    big = 1 << 63
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            first[key] = min(first.get(key, big), big if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < (big if doc_id is None else doc_id):
                gone[i : i + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard", [3, 40_000])
def test_substring_dedup_equals_brute_force(spark, shard):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(substring_dedup.remove_repeats(docs, shard=shard)) == cut(rows)


def test_substring_dedup_texts(spark):
    docs = documents(spark)
    out = substring_dedup.remove_repeats(docs, keep=["text", "kept"], with_text=True).collect()
    for r in out:
        if not r.n_removed:
            assert r.kept_text == r.kept.text
        else:
            assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
    assert substring_dedup.remove_repeats(no_documents(spark)).count() == 0


def test_fm_index_finds_all_places():
    rng = np.random.default_rng(2)
    sequence = rng.integers(0, 5, 500)
    index = fm_index.FMIndex(sequence, 5, 4)
    patterns = np.array([sequence[i : i + 4] for i in range(0, 496, 7)] + [[4, 4, 4, 4]])
    low, high = index.search(patterns)
    for pattern, i, j in zip(patterns, low, high, strict=True):
        places = {k for k in range(500) if (np.roll(sequence, -k)[:4] == pattern).all()}
        if len(places) > 1:
            assert set(index.order[i:j].tolist()) == places
        else:
            assert j - i <= 1


# --- packing


def test_packing_is_whole_and_certified(spark):
    from tokenizers import Tokenizer

    docs = documents(spark, ["Σίσυφος ΚΑΙ", "emoji 😀 and \x85 next", "a<|endoftext|>b", "don't WE'LL 3.14"])
    tokenizer = Tokenizer.from_file(tokenizer_path())
    expected = []
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for p, i in enumerate(range(0, len(ids), 2048)):
            part = ids[i : i + 2048]
            expected.append((r.doc_id, p, i, len(part), zlib.crc32(part.tobytes())))
    for group in (16, 16_384):
        packed = packing.pack_documents(docs, tokenizer_path(), group=group)
        rows = packed.collect()
        assert sorted([tuple(r)[:5] for r in rows], key=repr) == sorted(expected, key=repr)
        places = {}
        for r in rows:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for held in places.values():
            upto = 0
            for offset, length in sorted(held):
                assert offset == upto
                upto += length
            assert upto <= 2048
        known = packing.certificate(packed)
        assert known["sequences"] == len(places) >= known["bound"]
        best = len(packing.best_fit(np.array([r.length for r in rows]))[2])
        assert len(places) <= best + (2 if group == 16 else 0)
    assert packing.pack_documents(no_documents(spark), tokenizer_path()).count() == 0


def test_bounds_hold_and_certify():
    rng = np.random.default_rng(4)
    for n in (1, 5, 40):
        for _ in range(30):
            lengths = rng.integers(1, 101, n)
            bins, offsets, fill = packing.best_fit(lengths, 100)
            assert fill.max() <= 100 and np.bincount(bins, weights=lengths).tolist() == fill.tolist()
            assert packing.lower_bound(lengths, 100) <= len(fill)
    assert packing.lower_bound(np.array([51] * 7), 100) == 7
    assert packing.lower_bound(np.array([34] * 6), 100) == 3
    assert packing.lower_bound(np.array([60, 60, 50, 50, 30]), 100) == 3


# --- mixing


CELLS = [(f"s{i % 7}", ["en", "de", "other"][i % 3], ["general", "legal"][i % 2], 50 + 13 * i) for i in range(42)]
CELL = "source string, lang string, topic string, tokens long"


def test_raking_meets_targets(spark):
    """Feasible ones exactly, though some cells are full."""
    df = spark.createDataFrame(CELLS, CELL)
    total = sum(c[3] for c in CELLS)
    langs, topics = {"en": 0.2, "de": 0.55, "other": 0.25, "fr": 0.5}, {"general": 0.6, "legal": 0.4}
    raked = mixing.rake(df, langs, topics, budget=0.5, max_sweeps=60).collect()
    assert max(r.expected for r in raked) == 1 and min(r.expected for r in raked) > 0
    raw = {s: sum(c[3] for c in CELLS if c[0] == s) ** mixing.SOURCE_POWER for s in {c[0] for c in CELLS}}
    sources = {s: x / sum(raw.values()) for s, x in raw.items()}
    for column, targets in (("lang", {"en": 0.2, "de": 0.55, "other": 0.25}), ("topic", topics), ("source", sources)):
        for value, target in targets.items():
            share = sum(r.expected * r.tokens for r in raked if r[column] == value) / total
            assert share == pytest.approx(0.5 * target, rel=1e-3)


def test_raking_fills_what_is_too_small(spark):
    """A language with less than its target is taken whole; the others share what it lacks by their targets."""
    cells = [*CELLS, ("s1", "fr", "general", 40), ("tiny", "en", "legal", 5)]
    df = spark.createDataFrame(cells, CELL)
    total = sum(c[3] for c in cells)
    langs, topics = {"en": 0.3, "de": 0.3, "other": 0.3, "fr": 0.1}, {"general": 0.5, "legal": 0.5}
    for copies in (1, 3):
        raked = mixing.rake(df, langs, topics, budget=0.6, max_copies=copies, max_sweeps=60).collect()
        assert max(r.expected for r in raked) <= copies
        taken = {x: sum(r.expected * r.tokens for r in raked if r.lang == x) for x in langs}
        assert taken["fr"] == pytest.approx(40 * copies)
        for x in ("en", "de", "other"):
            assert taken[x] == pytest.approx((0.6 * total - 40 * copies) / 3, rel=1e-3)
    # More than there is: everything, as often as allowed.
    assert {r.expected for r in mixing.rake(df, langs, topics, budget=1.0).collect()} == {1.0}


def test_no_share_is_worse_than_in_the_input(spark):
    """On the given documents, whose topics are too scarce for their targets."""
    cells = mixing.with_cells(spark.read.parquet(f"{SMALL.replace('0.001', '0.1')}/documents.parquet"), "doc_id", "text", "lang", "source", mixing.LANG_TARGETS)
    cells = cells.groupBy("source", "lang", "topic").agg({"tokens": "sum"}).withColumnRenamed("sum(tokens)", "tokens")
    raked = mixing.rake(cells).collect()
    total, taken = sum(r.tokens for r in raked), sum(r.expected * r.tokens for r in raked)
    assert taken == pytest.approx(mixing.BUDGET * total)
    raw = {}
    for r in raked:
        raw[r.source] = raw.get(r.source, 0) + r.tokens
    raw = {s: x**mixing.SOURCE_POWER for s, x in raw.items()}
    sources = {s: x / sum(raw.values()) for s, x in raw.items()}
    for column, targets in (("source", sources), ("lang", mixing.LANG_TARGETS), ("topic", mixing.TOPIC_TARGETS)):
        for value, target in targets.items():
            before = sum(r.tokens for r in raked if r[column] == value) / total
            after = sum(r.expected * r.tokens for r in raked if r[column] == value) / taken
            # General texts have to stand in for topics that are taken whole.
            assert abs(after - target) <= abs(before - target) + 1e-6, (column, value)


def test_mixing_edge_rows(spark):
    docs = documents(spark)
    mixed = mixing.mix(docs, keep=["doc_id", "text", "sampled"])
    rows = mixed.collect()
    assert len(rows) == docs.count() and mixed.columns.count("sampled") == 1
    for r in rows:
        assert 0 <= r.probability <= 1 and r.tokens == len(WORD.findall(r.kept.text or ""))
        u = int(hashlib.md5(f"{'' if r.doc_id is None else r.doc_id}:mix".encode()).hexdigest()[:13], 16) / (1 << 52)
        assert r.sampled == (u < r.probability)
    assert mixing.mix(no_documents(spark)).count() == 0
    blank = docs.where("length(trim(text)) = 0 OR text IS NULL").select("doc_id", "text", "lang", "source")
    assert mixing.mix(blank).count() == blank.count()


def test_mixing_plan_is_native(spark):
    plan = mixing.mix(documents(spark).select("doc_id", "text", "lang", "source"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
