"""Phrase collocations, counted in quotient filters that are merged across shards.

Texts become blocks of word numbers, with the vocabulary of each block beside it. Words
that are frequent enough for a phrase get ids; a block's numbers are turned into ids, its
runs of two and three ids are counted in filters, and the filters of a shard are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codeloom.llm import quotient_filter as qf
from codeloom.llm.common import release_memory, small_batches
from codeloom.workspace import materialize

MIN_COUNT = 10
#: A phrase goes if a longer one that holds it has at least this percentage of its places.
COVERED = 50
TOP = 2000
#: Ids are dealt in so many rows of their own.
BUCKETS = 256
#: Entries that a task holds before it writes filters, and of a shard, about.
HELD = 1 << 20
SHARD = 1 << 22

#: A-Z lowered, marks that end a piece as a full stop, which no word has then; tabs as blanks.
SIGNS = bytes(
    b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256)
)
BLOCK = "block long, lang string, n_words long, words array<string>, counts array<long>, numbers binary"


def _cut(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Blocks of (lang, text): a batch's texts of one language as numbers into the block's words.
    Number 0 ends a piece."""
    done = 0
    for batch in batches:
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            by_lang.setdefault(lang, [b"."]).append(text or b"")
        for lang, texts in by_lang.items():
            # Split at blanks alone: other signs that Python holds for white space are in words.
            words = b"\n".join(texts).translate(SIGNS).replace(b".", b" . ").split(b" ")
            coded = pa.array(words, pa.binary()).dictionary_encode()
            del words
            names = coded.dictionary.to_pylist()
            numbers = coded.indices.to_numpy(zero_copy_only=False)
            # A full stop goes first, so both "" and "." are among the names.
            numbers = numbers[numbers != names.index(b"")]
            stop = names.index(b".")
            rank = np.cumsum([n not in (b"", b".") for n in names])
            rank[stop] = 0
            numbers = rank[numbers]
            names = [n.decode() for n in names if n not in (b"", b".")]
            counts = np.bincount(numbers, minlength=len(names) + 1)[1:]
            numbers = numbers[(numbers > 0) | np.append(True, numbers[:-1] > 0)]
            block = (TaskContext.get().partitionId() << 32) + done
            done += 1
            row = {"block": block, "lang": lang, "n_words": int(counts.sum()), "words": names, "counts": counts,
                   "numbers": numbers.astype("<u4").tobytes()}
            yield pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()}, schema=schema)
            del coded, numbers, row, names, counts
        del batch, by_lang
    release_memory()


def word_blocks(docs: DataFrame, text: str, lang: str) -> DataFrame:
    small_batches(docs.sparkSession)
    chosen = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    schema = to_arrow_schema(T.StructType.fromDDL(BLOCK))
    return chosen.where("text IS NOT NULL").mapInArrow(lambda batches: _cut(batches, schema), BLOCK)


def frequent_words(blocks: DataFrame, min_count: int, buckets: int = BUCKETS) -> DataFrame:
    """(lang, word, f, id) of the words that stand ``min_count`` times in a language. Blocks have
    counted their words, so the most frequent word is a row a block. Ids start from 1 and leave few gaps."""
    pairs = F.explode(F.arrays_zip("words", "counts")).alias("w")
    counted = blocks.select("lang", pairs).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"))
    bucket = F.pmod(F.xxhash64("lang", "word"), F.lit(buckets))
    frequent = counted.where(F.col("f") >= min_count).withColumn("bucket", bucket)
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("lang", "word"))
    return frequent.select("lang", "word", "f", ((place - 1) * buckets + F.col("bucket") + 1).cast("long").alias("id"))


def with_ids(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """(numbers, known) for each block: its words that have ids, as (number, id)."""
    listed = blocks.select("block", "lang", F.posexplode("words").alias("pos", "word"))
    met = listed.join(words.select("lang", "word", "id"), ["lang", "word"])
    known = met.groupBy("block").agg(F.collect_list(F.struct((F.col("pos") + 1).alias("number"), "id")).alias("known"))
    return blocks.select("block", "numbers").join(known, "block").select("numbers", "known")


def phrase_counts(blocks: DataFrame, bits: int, shard_bits: int, min_count: int) -> DataFrame:
    """(w1, w2, w3, f) of the runs of two (w3 = 0) and three ids that stand ``min_count`` times.

    A task tallies its blocks and writes a filter for each shard; a shard's filters are merged
    in one group. Keys are permuted evenly, so shards are alike and a frequent phrase is one entry a filter.
    """
    half = 3 * bits // 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            made = qf.shards(*qf.tally(*(np.concatenate(x) for x in zip(*held, strict=True)), half), half, shard_bits)
            held.clear()
            return pa.RecordBatch.from_pydict(
                {"shard": pa.array([s for s, _ in made], pa.int64()), "filter": pa.array([f for _, f in made], pa.binary())}
            )

        for batch in batches:
            for i in range(batch.num_rows):
                known = batch.column(1)[i].values
                numbers = np.frombuffer(batch.column(0)[i].as_py(), "<u4")
                id_of = np.zeros(int(numbers.max(initial=0)) + 1, np.int64)
                id_of[known.field(0).to_numpy()] = known.field(1).to_numpy()
                ids = np.append(id_of[numbers], (0, 0))
                for low in range(0, len(numbers), HELD):
                    a, b, c = (ids[low + j : min(low + HELD, len(numbers)) + j] for j in range(3))
                    two = (a > 0) & (b > 0)
                    three = two & (c > 0)
                    runs = (np.concatenate((x[two], x[three])) for x in (a, b))
                    last = np.concatenate((np.zeros(int(two.sum()), np.int64), c[three]))
                    high, low_half, counts = qf.tally(*qf.pack((*runs, last), bits), None, half)
                    high, low_half = qf.permute(high, low_half, half)
                    held.append((high, low_half, counts))
                    size += len(high)
                    if size >= HELD:
                        yield flush()
                        size = 0
            del batch
        if size:
            yield flush()
        release_memory()

    def merged(key: tuple, rows: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        high, low, counts = qf.merge(rows["filter"].to_pylist(), half, shard_bits, shard)
        often = counts >= min_count
        w1, w2, w3 = qf.unpack(*qf.restore(high[often], low[often], half), bits)
        return pa.table({"w1": w1, "w2": w2, "w3": w3, "f": counts[often]})

    filters = blocks.mapInArrow(count, "shard long, filter binary")
    return filters.groupBy("shard").applyInArrow(merged, "w1 long, w2 long, w3 long, f long")


def cut_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exactly, for counts below 10^16."""
    wide = [x.cast("decimal(19,0)") for x in (a, left, right)]
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide[0] * wide[0]), wide[1] * wide[2])


def scored_phrases(counts: DataFrame, words: DataFrame, covered: int = COVERED) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases that no longer one covers."""

    def named(i: int) -> DataFrame:
        return words.select(F.col("id").alias(f"w{i}"), F.col("word").alias(f"word{i}"), F.col("f").alias(f"f{i}"))

    pairs = counts.where("w3 = 0").select("w1", "w2", "f")
    triples = counts.where("w3 > 0")
    inside = triples.select(F.explode(F.array(F.struct("w1", "w2", "f"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "f"))).alias("i"))
    longer = inside.groupBy("i.w1", "i.w2").agg(F.max("i.f").alias("longest"))
    left_pairs = pairs.join(longer, ["w1", "w2"], "left").where(
        F.col("longest").isNull() | (F.col("longest") * 100 < F.col("f") * covered)
    )
    firsts = words.select(F.col("id").alias("w1"), "lang", F.col("word").alias("word1"), F.col("f").alias("f1"))
    two = left_pairs.join(firsts, "w1").join(named(2), "w2")
    two = two.select(
        "lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), F.col("f").alias("a"),
        F.struct(cut_score(F.col("f"), F.col("f1"), F.col("f2")).alias("score"), F.lit(1).alias("k"), F.col("f1").alias("l"), F.col("f2").alias("r")).alias("cut"),
    )
    heads = pairs.select("w1", "w2", F.col("f").alias("f12"))
    tails = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("f23"))
    three = (
        triples.join(heads, ["w1", "w2"]).join(tails, ["w2", "w3"])
        .join(firsts, "w1").join(named(2), "w2").join(named(3), "w3")
    )

    def cut(k: int, left: str, right: str) -> Column:
        score = cut_score(F.col("f"), F.col(left), F.col(right)).alias("score")
        return F.struct(score, F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))

    three = three.select(
        "lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), F.col("f").alias("a"),
        F.least(cut(1, "f1", "f23"), cut(2, "f12", "f3")).alias("cut"),
    )
    return two.unionByName(three).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def best_phrases(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language by score, count, phrase.

    Phrases are dealt to ranges of that order and numbered within them; only the sizes of
    ranges are summed up in order, so a language with most phrases is many tasks.
    """
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    ranged = phrases.repartitionByRange("lang", *order).withColumn("range", F.spark_partition_id())
    ranged = materialize(ranged, "ranked-phrases")
    sizes = ranged.groupBy("lang", "range").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("lang", "range", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("lang", "range").orderBy(*order))
    placed = ranged.join(before.where(F.col("before") < top), ["lang", "range"]).withColumn("rank", F.col("before") + place)
    return placed.where(F.col("rank") <= top).drop("range", "before")


def mine_collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    min_count: int = MIN_COUNT,
    covered: int = COVERED,
    top: int = TOP,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two and three words of each
    language that hold together best.

    Texts are lowered (A-Z), cut into pieces at full stops, commas, other marks and line ends,
    and pieces into words at blanks and tabs. ``a`` counts all places of a phrase within pieces,
    ``n`` all words of the language. A phrase must stand ``min_count`` times. Cut into two
    parts of ``l`` and ``r`` places its score is floor(1000000 a a / (l r)); the cut of least score counts,
    the earlier of equals. A pair that a phrase of three holds goes if that has ``covered``
    percent of its places or more, whether or not that phrase is among the best.

    Null texts count as empty, a null language is ``und``; texts without words and languages without
    phrases leave no row; repeated rows count repeatedly; other columns are ignored. All is
    exact: words have ids of their own, filters give back their keys, and scores are worked out in decimals.
    Whatever a frequent phrase needs (its words and parts) is as frequent, so other words end
    runs and nothing else of them is kept. Texts are never shuffled, only numbers of words.
    """
    blocks = materialize(word_blocks(docs, text, lang), "blocks")
    words = materialize(frequent_words(blocks, min_count), "words")
    last = words.agg(F.max("id")).first()[0] or 1
    bits = max(2, last.bit_length() + last.bit_length() % 2)
    if bits > qf.MAX_BITS:
        raise ValueError(f"ids of {bits} bits")
    n_words = blocks.agg(F.sum("n_words")).first()[0] or 0
    shard_bits = min(3 * bits // 2, max(0, math.ceil(math.log2(max(1, 2 * n_words / SHARD)))))
    counts = materialize(phrase_counts(with_ids(blocks, words), bits, shard_bits, min_count), "phrases")
    best = best_phrases(scored_phrases(counts, words, covered), top)
    sizes = blocks.groupBy("lang").agg(F.sum("n_words").alias("n"))
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine_sql(min_count: int = MIN_COUNT, covered: int = COVERED, top: int = TOP) -> str:
    """The SQL of the operator over ``documents``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH pieces AS (
  SELECT lang, list_filter(string_split(replace(piece, chr(9), ' '), ' '), lambda w: w <> '') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\n\x0b\x0c\r]')) AS piece
        FROM documents)),
grams AS (
  SELECT lang, k, list_slice(ws, i, i + k - 1) AS p
  FROM (SELECT lang, ws, k, unnest(range(1, greatest(len(ws) - k + 2, 1))) AS i FROM pieces, (VALUES (1), (2), (3)) t(k))),
counted AS (SELECT lang, k, array_to_string(p, ' ') AS phrase, p, count(*) AS f FROM grams GROUP BY lang, k, p),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang),
kept AS (SELECT * FROM counted WHERE f >= {min_count}),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.p, c.f AS a, h.k AS cut, h.f AS l, t.f AS r,
         (1000000::HUGEINT * c.f * c.f // (h.f::HUGEINT * t.f))::BIGINT AS score
  FROM kept c JOIN kept h ON h.lang = c.lang AND h.k < c.k AND h.p = c.p[1:h.k]
  JOIN kept t ON t.lang = c.lang AND t.k = c.k - h.k AND t.p = c.p[h.k + 1:]
  WHERE c.k > 1),
lowest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) AS i FROM cuts) WHERE i = 1),
longer AS (
  SELECT lang, p, max(f) AS f FROM (
    SELECT lang, p[1:2] AS p, f FROM kept WHERE k = 3 UNION ALL SELECT lang, p[2:3], f FROM kept WHERE k = 3)
  GROUP BY lang, p)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT lowest.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
      FROM lowest LEFT JOIN longer USING (lang, p) WHERE coalesce(100 * longer.f < {covered} * a, true))
JOIN sizes USING (lang) WHERE rank <= {top}"""
