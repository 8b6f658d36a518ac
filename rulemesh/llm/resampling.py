"""Importance resampling towards a target distribution.

Texts are bags of hashed runs of words. A bucket's gain is the logarithm of how
much more often the target texts have it than the corpus, a document's weight
the sum of its features' gains, and documents are drawn without replacement
by the highest weights after each got noise of its own (Gumbel's).

Equal texts have equal features, so they are grouped by their full text, their
features computed once and counted as often as the text occurs; weights are
joined back to documents before the noise. Texts with many copies, at most
``1 / HOT`` of them, are joined by a broadcast, all others by their digests.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut, map_arrow, read_table, running
from ._text import crc32, slices, terms, text_column

#: Most words of a feature, buckets of features, words that a document needs to be drawn, and the percentage drawn.
RUN_WORDS, BUCKETS, LEAST_WORDS, PERCENT = 1, 10_000, 20, 10
SEED = "2024"
#: A text with more than this share of all documents is joined by a broadcast.
HOT = 1 / 256


def digest(text: Column) -> Column:
    return F.coalesce(F.sha2(text, 256), F.lit(""))


def bag(texts: pa.Array, run_words: int = RUN_WORDS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of each text, and its buckets and their counts with the n + 1 offsets of texts in them."""
    data, starts, ends, first = terms(texts)
    n, n_words = len(texts), np.diff(first)
    owner = np.repeat(np.arange(n), n_words)
    keys = [owner * buckets + crc32(data, starts, ends) % np.uint32(buckets)]
    if run_words > 1:  # words of a text with one blank between them
        size = ends - starts + 1
        begin = np.cumsum(size) - size
        line = np.full(int(size.sum()), 32, np.uint8)
        inside = np.arange(len(line)) - np.repeat(begin, size) < np.repeat(size - 1, size)
        line[inside] = data[(np.repeat(starts - begin, size) + np.arange(len(line)))[inside]]
        for k in range(2, run_words + 1):
            at = np.flatnonzero(owner[k - 1 :] == owner[: max(0, len(owner) - k + 1)])
            keys.append(owner[at] * buckets + crc32(line, begin[at], begin[at + k - 1] + size[at + k - 1] - 1) % np.uint32(buckets))
    found, counts = np.unique(np.concatenate(keys), return_counts=True)
    n_features = sum(np.maximum(n_words - k, 0) for k in range(run_words))
    return n_features, found % buckets, counts, np.searchsorted(found, np.arange(n + 1) * buckets)


def bags(texts: DataFrame, text_col: str, run_words: int = RUN_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """``texts`` with n_words, n_features and its buckets and counts in place of ``text_col``."""
    kept = [c for c in texts.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, text_col):
                column = text_column(rows, text_col)
                n_features, bucket, counts, offs = bag(column, run_words, buckets)
                n_words = n_features if run_words == 1 else np.diff(terms(column)[3])
                lists = [pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(x, pa.int32())) for x in (bucket, counts)]
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(rows.schema.get_field_index(c)) for c in kept), pa.array(n_words), pa.array(n_features), *lists],
                    names=[*kept, "n_words", "n_features", "buckets", "counts"],
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != text_col)
    return map_arrow(texts, run, f"{schema}, n_words long, n_features long, buckets array<int>, counts array<int>")


def totals(bagged: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often the texts of ``bagged`` have each bucket, each text counted ``n`` times. One row a bucket and task is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            lists, times = batch.column(1), batch.column(0).to_numpy()
            owner = np.repeat(np.arange(len(times)), np.diff(lists.offsets.to_numpy()))
            np.add.at(sums, lists.flatten().to_numpy(), times[owner] * batch.column(2).flatten().to_numpy())
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sums[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in map_arrow(bagged.select("n", "buckets", "counts"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, in thousandths, rounded down."""
    s_all, t_all, k = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weigh(bagged: DataFrame, gain: np.ndarray) -> DataFrame:
    """``bagged`` without its lists, with ``weight``."""
    kept = [c for c in bagged.columns if c not in ("buckets", "counts")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, counts = (batch.column(batch.schema.get_field_index(c)) for c in ("buckets", "counts"))
            sums = np.concatenate([[0], np.cumsum(gain[lists.flatten().to_numpy()] * counts.flatten().to_numpy())])
            offs = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(np.diff(sums[offs]), pa.int64())], names=[*kept, "weight"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bagged.schema if f.name in kept)
    return map_arrow(bagged, run, f"{schema}, weight long")


def noise(id_: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, from the id alone; a null id counts as an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, run_words: int = RUN_WORDS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
    percent: int = PERCENT, seed: str = SEED, hot: float = HOT, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(``id_col``, n_features, weight, score, rank) of each document; ``rank`` is null where it isn't drawn.

    Of the documents with ``least_words`` words those ``percent`` per cent
    (rounded down) are drawn whose scores are highest, equal scores by the
    smaller id, null ids last. Null and empty texts have no features and weigh
    0. Repeated rows are documents of their own; equal ones take adjacent
    ranks. Other columns aren't read. Empty tables give empty results; without
    target texts all gains still follow from the formula. A very long text is
    one step of its worker and at most ``buckets`` entries.
    """
    text = F.col(text_col).cast("string")
    same = docs.select(text.alias("text")).groupBy("text").agg(F.count("*").alias("n"))
    same = same.select(digest(F.col("text")).alias("digest"), "n", "text")
    bagged = cut(bags(same, "text", run_words, buckets))
    wanted = bags(target.select(F.lit(1).cast("long").alias("n"), F.col(text_col).cast("string").alias("text")), "text", run_words, buckets)
    gain = gains(totals(bagged, buckets), totals(wanted, buckets))
    weighed = cut(weigh(bagged, gain))
    all_rows, enough = weighed.agg(F.sum("n"), F.sum(F.when(F.col("n_words") >= least_words, F.col("n")))).first()
    often = F.col("n") > F.lit((all_rows or 0) * hot)  # fewer than 1 / hot texts
    named = docs.select(F.col(id_col).alias("id"), digest(text).alias("digest"))
    found = named.join(F.broadcast(weighed.where(often).withColumn("hot", F.lit(True))), "digest", "left")
    columns = ["id", "n_words", "n_features", "weight"]
    rare = found.where("hot is null").select("id", "digest").join(weighed.where(~often).hint("shuffle_hash"), "digest")
    placed = found.where("hot").select(columns).unionByName(rare.select(columns))
    scored = placed.withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    # those with too few words come last, by the same order
    keyed = scored.select("*", (F.col("n_words") < least_words).alias("short"), (-F.col("score")).alias("down"), F.col("id").isNull().alias("nameless"))
    ranked = running(keyed, ["short", "down", "nameless", "id"], [])
    drawn = (enough or 0) * percent // 100
    rank = F.when(F.col("place") < F.lit(drawn), F.col("place") + 1).cast("long")
    return ranked.select(F.col("id").alias(id_col), "n_features", "weight", "score", rank.alias("rank"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each document; nulls, ties, repeated rows and long texts as in ``resample``."""
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


#: The same rows; the checksum goes over the bytes of distinct words by a table of 256 values.
OP11_SQL = r"""
WITH bits AS (
  SELECT n, list_reduce([n::BIGINT] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS entry
  FROM range(256) t(n)
), crc AS (SELECT list(entry ORDER BY n) AS entries FROM bits),
words AS (
  SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT 'b', item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), hashed AS (
  SELECT word, xor(list_reduce([4294967295] || list_transform(range(1, 2 * strlen(word), 2), lambda i: ('0x' || substr(hex(word), i, 2))::BIGINT),
    lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM words), crc
), counted AS (SELECT side, id, bucket, count(*) AS n FROM words JOIN hashed USING (word) GROUP BY ALL),
sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::BIGINT AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::BIGINT AS t FROM counted GROUP BY bucket
), whole AS (SELECT sum(s)::BIGINT AS s_all, sum(t)::BIGINT AS t_all FROM sums),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM sums, whole),
bagged AS (SELECT id AS doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM counted JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN bagged USING (doc_id)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, sum((n_features >= 20)::INT) OVER () AS enough FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= (10 * enough) // 100 THEN place END AS rank FROM ranked
"""
