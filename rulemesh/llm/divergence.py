"""Quality rules by distribution divergence.

A document's histogram of character classes and its histogram of common words
are compared with those of its language by the Jensen-Shannon distance (square
root of the divergence in bits, 0 to 1). A document is rejected if a distance
exceeds its limit, but only where the text is long enough for a histogram to
mean something; shorter texts pass.

References are exact sums over all documents that keep the base rules of a
language that has ``LANGUAGE_WORDS`` words or more, whatever share of the corpus
that is. Texts
of other languages, or of none, have nothing to be compared with: their
distances are null and they pass. A word is common if it makes ``WORD_SHARE``
of its language's words. Finding these words
takes two passes and no shuffle of the vocabulary: a word that is common in
all the language makes half that share of so many slices that its counts there
add up to half its share of the whole, and at most 2 / WORD_SHARE words can do
so; the second pass counts just those.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut, map_arrow, read_table
from ._text import slices, text_column
from .stats import CLASSES, TextStats

WORD_SHARE = 0.0005
#: From here on a common word occurs at least twice.
LANGUAGE_WORDS = 4000
#: Distances beyond which a text is rejected, and the characters and words from which they count.
CLASS_LIMIT, CLASS_CHARS = 0.3, 200
WORD_LIMIT, WORD_WORDS = 0.65, 50
#: Base rules: fewer words, or more per cent of words in repeated windows.
LEAST_WORDS, REPEAT_PERCENT = 20, 30
#: Stands for all texts without a language; it has no reference.
ALL = ""


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts to ``q``; 0 for rows without counts."""
    total, whole = p.sum(1, keepdims=True), q.sum()
    if whole == 0:
        return np.zeros(len(p))
    p, q = p / np.maximum(total, 1), (q / whole)[None, :]
    m = (p + q) / 2

    def part(x: np.ndarray) -> np.ndarray:
        ratio = np.divide(x, m, out=np.ones_like(m), where=(x > 0) & (m > 0))
        return (x * np.log2(ratio)).sum(1)

    return np.where(total[:, 0] > 0, np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1)), 0.0)


def sparse_distance(row: np.ndarray, column: np.ndarray, seen: np.ndarray, n: int, q: np.ndarray) -> np.ndarray:
    """``distance`` of ``n`` rows of which only the counts above 0 are given, so that many short texts take little room."""
    total, whole = np.bincount(row, seen, n), q.sum()
    if whole == 0:
        return np.zeros(n)
    p, r = seen / total[row], (q / whole)[column]
    m = (p + r) / 2
    # what a row hasn't adds its share of q, so start with all of q and take off what the row has
    part = p * np.log2(p / m) + np.where(r > 0, r * np.log2(np.where(r > 0, r, 1) / m), 0) - r
    return np.where(total > 0, np.sqrt(np.clip((1 + np.bincount(row, part, n)) / 2, 0, 1)), 0.0)


def base_failed(s: TextStats) -> np.ndarray:
    return (s.n_words < LEAST_WORDS) | (100 * s.n_repeat_words > REPEAT_PERCENT * s.n_words)


@dataclass
class Reference:
    """Of a language: counts of CLASSES, the common words, and their counts with all other words last."""

    classes: np.ndarray
    words: pa.Array
    counts: np.ndarray

    def distances(self, s: TextStats, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and word distance of the texts ``rows``."""
        width = len(self.words) + 1
        place = pc.fill_null(pc.index_in(s.words.dictionary, value_set=self.words), width - 1)
        place = place.to_numpy(zero_copy_only=False).astype(np.int64)[s.ids]
        mine = np.zeros(s.n, bool)
        mine[rows] = True
        number = np.cumsum(mine) - 1
        chosen = mine[s.owner]
        at, seen = np.unique(number[s.owner[chosen]] * width + place[chosen], return_counts=True)
        return distance(s.classes[rows], self.classes), sparse_distance(at // width, at % width, seen, len(rows), self.counts)


def _languages(batch: pa.RecordBatch) -> np.ndarray:
    return pc.fill_null(batch.column(batch.schema.get_field_index("lang")).cast(pa.large_string()), ALL).to_numpy(
        zero_copy_only=False
    )


_COUNTS = "lang string, kind string, word binary, n long"


def _rows(lang: str, kind: str, words: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([lang] * len(words), pa.string()),
            pa.array([kind] * len(words), pa.string()),
            pa.array(words, pa.binary()),
            pa.array(counts, pa.int64()),
        ],
        names=["lang", "kind", "word", "n"],
    )


def _by_language(s: TextStats, langs: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Language, its texts that keep the base rules, and their count of each distinct word of the slice."""
    size = len(s.words.dictionary)
    good = ~base_failed(s)
    for lang in sorted(set(langs[good]) - {ALL}):
        rows = good & (langs == lang)
        yield lang, np.flatnonzero(rows), np.bincount(s.ids[rows[s.owner]], minlength=size)


def _frequent(share: float):
    """First pass: class counts, word totals, and words with half of ``share`` of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                s = TextStats(text_column(part))
                names = s.words.dictionary
                for lang, rows, counts in _by_language(s, _languages(part)):
                    yield _rows(lang, "class", [c.encode() for c in CLASSES], s.classes[rows].sum(0))
                    yield _rows(lang, "total", [b""], np.array([counts.sum()]))
                    often = np.flatnonzero((counts > 0) & (counts >= share / 2 * counts.sum()))
                    yield _rows(lang, "word", names.take(pa.array(often)).to_pylist(), counts[often])

    return run


def _counted(words: dict[str, pa.Array]):
    """Second pass: the counts of ``words`` of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                s = TextStats(text_column(part))
                names = s.words.dictionary
                for lang, _, counts in _by_language(s, _languages(part)):
                    if lang in words:
                        at = pc.index_in(names, value_set=words[lang])
                        here = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False) & (counts > 0))
                        yield _rows(lang, "word", names.take(pa.array(here)).to_pylist(), counts[here])

    return run


def references(
    docs: DataFrame, language_words: int = LANGUAGE_WORDS, word_share: float = WORD_SHARE
) -> dict[str, Reference]:
    """References of the languages of ``docs`` (columns text and lang) that have ``language_words`` words."""
    chosen = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    first = map_arrow(chosen, _frequent(word_share), _COUNTS).groupBy("lang", "kind", "word").agg(F.sum("n").alias("n"))
    first = cut(first)  # two questions are asked of it
    sizes = first.where("kind = 'total'").select("lang", F.col("n").alias("total"))
    sizes = sizes.where(F.col("total") >= max(1, language_words))
    kept = {r["lang"]: r["total"] for r in sizes.collect()}
    if not kept:
        return {}
    # words that can still be common: at most 2 / word_share a language
    able = (F.col("kind") == "class") | ((F.col("kind") == "word") & (F.col("n") >= F.col("total") * (word_share / 2)))
    rows = first.join(sizes, "lang").where(able).collect()
    words = {
        lang: pa.array(sorted(bytes(r["word"]) for r in rows if r["lang"] == lang and r["kind"] == "word"), pa.large_binary())
        for lang in kept
    }
    second = map_arrow(chosen, _counted(words), _COUNTS).groupBy("lang", "word").agg(F.sum("n").alias("n")).collect()
    out = {}
    for lang, size in kept.items():
        classes = {bytes(r["word"]).decode(): r["n"] for r in rows if r["lang"] == lang and r["kind"] == "class"}
        common = sorted((bytes(r["word"]), r["n"]) for r in second if r["lang"] == lang and r["n"] >= word_share * size)
        counts = np.array([n for _, n in common] + [size - sum(n for _, n in common)], float)
        out[lang] = Reference(
            np.array([classes.get(c, 0) for c in CLASSES], float), pa.array([w for w, _ in common], pa.large_binary()), counts
        )
    return out


def judge(docs: DataFrame, refs: dict[str, Reference], id_col: str = "doc_id") -> DataFrame:
    """Counts, distances and verdict of each row of ``docs`` (columns ``id_col``, text, lang).

    Null texts are empty; they have too few words. Null ids stay null. Repeated
    rows stay repeated; other columns, whatever their names, are not read; an
    empty table gives an empty one. A distance at its limit doesn't reject. A
    very long text is one step of its worker. Texts whose language isn't in
    ``refs`` have null distances, which reject nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                s = TextStats(text_column(part))
                langs = _languages(part)
                by_class, by_word = np.full(s.n, np.nan), np.full(s.n, np.nan)
                for lang in sorted(set(langs) & set(refs)):
                    rows = np.flatnonzero(langs == lang)
                    by_class[rows], by_word[rows] = refs[lang].distances(s, rows)
                repeated, failed = s.n_repeat_words, base_failed(s)
                far = ((s.n_chars >= CLASS_CHARS) & (by_class > CLASS_LIMIT)) | (
                    (s.n_words >= WORD_WORDS) & (by_word > WORD_LIMIT)
                )
                columns = [s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, repeated, failed, ~failed & ~far]
                columns = [*map(pa.array, columns), *(pa.array(x, from_pandas=True) for x in (by_class, by_word))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)

    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    kinds = ["long"] * 5 + ["boolean"] * 2 + ["double"] * 2
    names += ["class_distance", "word_distance"]
    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(
        F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    schema = ", ".join([f"id {kind}", *(f"{n} {k}" for n, k in zip(names[1:], kinds))])
    return map_arrow(chosen, run, schema).withColumnRenamed("id", id_col)


def op2_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``judge`` for each document; nulls, repeated rows, ties and long texts as there."""
    docs = read_table(spark, sf_dir, "documents")
    return judge(docs, references(docs))
