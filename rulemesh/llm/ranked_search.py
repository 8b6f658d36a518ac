"""Ranked lexical search by Fagin's threshold algorithm.

Documents are dealt out to tasks and, within a task, to blocks. Each block has
two indexes of the queries' terms: for each term a list of its documents by
falling impact, and for each document a row of its terms. A query reads its
lists in turn, from the top, a few entries at a time; a document met for the
first time is scored whole by its row. What no list has shown yet can't score
more than the entries last read together, the threshold; the query is done
with a block when that falls strictly below its k-th score. The k-th score goes on
from block to block, so later blocks end sooner. The best of all tasks are
then ranked together; corpus statistics are counted before, over all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import cut, map_arrow, read_table, running
from ._text import slices, terms, text_column
from .stats import _encoded

#: Best documents of a query.
K = 10
#: Saturation, the share of a document's length in it in hundredths, and the scale of impacts.
SATURATION, LENGTH_SHARE, SCALE = 8, 75, 1_000_000_000
#: Terms of the queries that one pass over the documents takes; more of them are dealt out to several passes.
PASS_TERMS = 200_000
#: Bytes of text in a block.
BLOCK = 1 << 24
#: Entries of each list that a query reads at first; twice as many at each further step.
STEP = 16


def query_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id, number, before_size, terms, size) of each item: its terms one after another and how many they are, numbered by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                data, starts, ends, first = terms(text_column(rows))
                words = _encoded(data, starts, ends).dictionary_decode().cast(pa.string())
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), words)
                yield pa.RecordBatch.from_arrays([rows.column(0), lists, pa.array(np.diff(first))], names=["id", "terms", "size"])

    kind = items.schema[id_col].dataType.simpleString()
    chosen = items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = map_arrow(chosen, run, f"id {kind}, terms array<string>, size long")
    keyed = found.withColumn("nameless", F.col("id").isNull())
    return running(keyed, ["nameless", "id"], ["size"]).withColumnRenamed("place", "number")


class Block:
    """Documents of one block: lengths and, for the terms of ``vocabulary``, the rows of the documents that have any."""

    def __init__(self, texts: pa.Array, vocabulary: pa.Array):
        data, starts, ends, first = terms(texts)
        self.n, self.length = len(texts), np.diff(first)
        words = _encoded(data, starts, ends)
        known = pc.fill_null(pc.index_in(words.dictionary, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        term = known[words.indices.to_numpy(zero_copy_only=False)] if len(starts) else np.zeros(0, np.int64)
        width = max(1, len(vocabulary))
        key = (np.repeat(np.arange(self.n), self.length) * width + term)[term >= 0]
        found, self.tf = np.unique(key, return_counts=True)
        self.doc, self.term = found // width, found % width


class Index:
    """Both indexes of a block; ``norm`` is each document's m."""

    def __init__(self, block: Block, norm: np.ndarray, n_terms: int):
        self.doc, self.term = block.doc, block.term
        self.impact = SCALE * block.tf // (1000 * block.tf + SATURATION * norm[block.doc])
        self.row = np.searchsorted(self.doc, np.arange(block.n + 1))
        order = np.lexsort((-self.impact, self.term))
        self.list_doc, self.list_impact = self.doc[order], self.impact[order]
        self.list_at = np.searchsorted(self.term[order], np.arange(n_terms + 1))
        self.n = block.n

    def score(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Whole scores of ``docs``, each of which has a term, by their rows; ``weight`` has one value a term."""
        size = self.row[docs + 1] - self.row[docs]
        ends = np.cumsum(size)
        at = np.repeat(self.row[docs] - (ends - size), size) + np.arange(ends[-1])
        return np.add.reduceat(self.impact[at] * weight[self.term[at]], ends - size)

    def best(self, wanted: np.ndarray, weight: np.ndarray, k: int, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents, and scores, among which the best ``k`` of this block and the ``held`` scores are; all that tie for the last place too."""
        begin, end = self.list_at[wanted], self.list_at[wanted + 1]
        each = weight[wanted]
        seen = np.zeros(self.n, bool)
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step = 0, STEP
        kth = held.min() if len(held) == k else 0
        while True:
            low, high = np.minimum(begin + depth, end), np.minimum(begin + depth + step, end)
            size = high - low
            total = int(size.sum())
            if not total:
                break
            ends = np.cumsum(size)
            met = np.unique(self.list_doc[np.repeat(low - (ends - size), size) + np.arange(total)])
            new = met[~seen[met]]
            if len(new):
                seen[new] = True
                value = self.score(new, weight)
                keep = (value >= kth) & (value > 0)
                docs, scores = np.concatenate([docs, new[keep]]), np.concatenate([scores, value[keep]])
                both = np.concatenate([scores, held])
                if len(both) >= k:
                    kth = max(kth, np.partition(both, len(both) - k)[len(both) - k])
                    docs, scores = docs[scores >= kth], scores[scores >= kth]
            left = high < end
            threshold = int((each[left] * self.list_impact[high[left] - 1]).sum())
            if threshold < kth or not left.any():
                break
            depth, step = depth + step, 2 * step
        return docs, scores


def _first(ids: pa.Array, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, equal ones by ascending id, null last."""
    table = pa.table({"score": pa.array(scores), "id": ids})
    order = pc.sort_indices(table, sort_keys=[("score", "descending"), ("id", "ascending")], null_placement="at_end")
    return order.to_numpy()[:k]


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``block`` bytes of text, or one text."""
    held, size = [], 0
    for batch in batches:
        for rows in slices(batch, limit=block):
            held.append(rows)
            size += rows.column(1).nbytes
            if size >= block or sum(r.num_rows for r in held) >= 16384:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()[:1]


def _counted(docs: DataFrame, vocabulary: list[str]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and how many documents have each term of ``vocabulary``."""
    n_terms = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, sums = pa.array(vocabulary, pa.large_string()).cast(pa.large_binary()), np.zeros(n_terms + 2, np.int64)
        for batch in batches:
            for rows in slices(batch):
                block = Block(text_column(rows), lookup)
                sums[:n_terms] += np.bincount(block.term, minlength=n_terms)
                sums[n_terms:] += [np.count_nonzero(block.length), block.length.sum()]
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["at", "n"])

    out = np.zeros(n_terms + 2, np.int64)
    for r in map_arrow(docs.select("id", "text"), run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return int(out[-2]), int(out[-1]), out[:-2]


def _pass(docs: DataFrame, kind: str, items: list, k: int) -> DataFrame:
    """(number, id, score): the best ``k`` of every task for each of ``items``."""
    vocabulary = sorted({t for r in items for t in r["terms"]})
    place = {t: n for n, t in enumerate(vocabulary)}
    n_docs, n_all, df = _counted(docs, vocabulary)
    weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df]
    queries = []
    for r in items:
        times = Counter(place[t] for t in r["terms"])
        wanted = sorted(t for t in times if weights[t] > 0 and df[t])
        if wanted:
            queries.append((r["number"], np.array(wanted), np.array([weights[t] * times[t] for t in wanted])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = pa.array(vocabulary, pa.large_string()).cast(pa.large_binary())
        held: dict[int, tuple[pa.Array, np.ndarray]] = {}
        weight = np.zeros(len(vocabulary), np.int64)
        for rows in _blocks(batches, BLOCK):
            block = Block(text_column(rows), lookup)
            index = Index(block, 100 - LENGTH_SHARE + LENGTH_SHARE * block.length * n_docs // max(1, n_all), len(vocabulary))
            for number, wanted, each in queries:
                weight[wanted] = each
                ids, scores = held.get(number, (None, np.zeros(0, np.int64)))
                found, value = index.best(wanted, weight, k, scores)
                weight[wanted] = 0
                if len(found):
                    mine = rows.column(0).take(pa.array(found))
                    ids = mine if ids is None else pa.concat_arrays([ids, mine])
                    scores = np.concatenate([scores, value])
                    top = _first(ids, scores, k)
                    held[number] = ids.take(pa.array(top)), scores[top]
        for number, (ids, scores) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(ids), pa.int64()), ids, pa.array(scores)], names=["number", "id", "score"])

    return map_arrow(docs, run, f"number long, id {kind}, score long")


def search(
    docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    pass_terms: int = PASS_TERMS,
) -> DataFrame:
    """(``item_col``, rank, ``id_col``, score): the ``k`` documents of the highest scores above 0 for each item.

    Equal scores stand by ascending id, null ids last. Null and empty texts
    have no terms: as documents they are never found, as items they find
    nothing. Repeated rows, of documents or items, count each for itself. Other
    columns, whatever their names, are not read; an empty table gives an empty
    result. A very long text is a block of its own. Statistics count all
    documents. Items pass to tasks ``pass_terms`` terms at a time.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    asked = cut(query_terms(items, item_col, item_text))
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    turn = F.floor(F.col("before_size") / pass_terms)
    found = None
    for n in range((asked.agg(F.max(turn)).first()[0] or 0) + 1):
        rows = asked.where(turn == n).where("size > 0").select("number", "terms").collect()
        part = _pass(chosen, kind, rows, k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = asked.select("number", F.col("id").alias("_item"))
    return ranked.join(named, "number").select(F.col("_item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def op12_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, rank, doc_id, score) of each benchmark item's best documents; nulls, ties, repeated rows and long texts as in ``search``."""
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), counted AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counted GROUP BY doc_id),
whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_all FROM lengths),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), whole
), impacts AS (
  SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_all)) AS impact
  FROM counted JOIN lengths USING (doc_id), whole
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), scored AS (
  SELECT item_id, doc_id, sum(times * w * impact)::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY ALL
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""
