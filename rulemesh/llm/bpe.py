"""Encoding texts to ids of a byte-pair vocabulary and back.

A corpus has few frequent words and very many rare ones. The frequent ones are
counted over all texts, written as ids once and compiled into a transducer
(see ``transducer``); every executor maps its file and looks up all words of a
slice together. Words that it doesn't have are merged pair by pair by the
tokenizer's own rules, so the result doesn't depend on what is in it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import HELD, map_arrow, read_table, shared_folder, write_bytes
from ._text import slices, text_column, utf8
from .packing import WordIds, token_ids, tokenizer_path
from .stats import TextStats

#: A word is frequent in a task if it makes this share of the task's words, so a task has at most 1 / SHARE of them.
SHARE = 1 / 65536
#: Words of the transducer; a few megabytes, however large the corpus.
MOST = 131_072
#: Bytes of text counted before words that can't be frequent are let go.
SLICE = 1 << 22


def frequent_words(docs: DataFrame, text_col: str = "text", share: float = SHARE, most: int = MOST) -> DataFrame:
    """(word, n): at most ``most`` words, those of most occurrences in tasks where they make ``share`` of all words.

    A word that makes ``share`` of all words of the corpus makes it in some
    task, so none is missed; one of twice that share is counted to a half at
    least. Ties go by the word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = pa.table({"word": pa.array([], pa.large_binary()), "n": pa.array([], pa.int64())}), 0
        for batch in batches:
            for rows in slices(batch, limit=SLICE):
                s = TextStats(text_column(rows))
                if not len(s.ids):
                    continue
                total += len(s.ids)
                n = np.bincount(s.ids, minlength=len(s.words.dictionary))
                new = pa.table({"word": s.words.dictionary, "n": pa.array(n, pa.int64())})
                held = pa.concat_tables([held, new]).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
        held = held.filter(pc.greater_equal(held["n"], max(2.0, share * total)))
        for part in held.to_batches(max_chunksize=65536):
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.binary()), part.column(1)], names=["word", "n"])

    counted = map_arrow(docs.select(F.col(text_col).cast("string").alias("text")), run, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)


def write_lexicon(docs: DataFrame, path: str, text_col: str = "text", share: float = SHARE, most: int = MOST) -> str:
    """Compile the frequent words of ``docs``; the name under which executors find the file.

    The file is written to the shared folder, from which Spark gives it to
    every executor, also to those that join later.
    """
    spark = docs.sparkSession
    words = sorted(bytes(r["word"]) for r in frequent_words(docs, text_col, share, most).collect())
    from .transducer import compile_words

    flat, begin, sizes = WordIds(path, keep=most).of(pa.array(words, pa.large_binary()))
    ids = [flat[a : a + n].tolist() for a, n in zip(begin.tolist(), sizes.tolist())]
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    where = f"{shared_folder(spark)}/{name}"
    write_bytes(spark, where, compile_words(words, ids))
    spark.sparkContext.addFile(where)
    return name


class LexiconIds:
    """Ids of words by a mapped transducer, and by exact merges for the others."""

    def __init__(self, name: str, path: str):
        from .transducer import Transducer

        self.known, self.others = Transducer.mapped(SparkFiles.get(name)), WordIds(path)

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``WordIds.of``."""
        raw, offs = utf8(words)
        number = self.known.find(raw, offs[:-1], offs[1:])
        seen = number >= 0
        begin, size = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        begin[seen] = self.known.begin[number[seen]]
        size[seen] = self.known.begin[number[seen] + 1] - begin[seen]
        flat, at, sizes = self.others.of(words.filter(pa.array(~seen)))
        begin[~seen], size[~seen] = at + len(self.known.ids), sizes
        return np.concatenate([self.known.ids, flat]), begin, size


def encode(docs: DataFrame, path: str, lexicon: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n_tokens, ids): each text's ids, as little-endian unsigned 32-bit integers one after another.

    A null text is empty and has no ids. Repeated rows and null ids are rows
    like others; other columns, whatever their names, are not read; an empty
    table gives an empty one. A very long text is one step of its worker.
    """
    held = f"{path} {lexicon}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held not in HELD:
            HELD[held] = LexiconIds(lexicon, path)
        for batch in batches:
            for rows in slices(batch):
                ids, offs = token_ids(text_column(rows), HELD[held], None)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(np.diff(offs)), _binary(ids.view(np.uint8), 4 * offs)], names=["id", "n_tokens", "ids"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(chosen, run, f"id {kind}, n_tokens long, ids binary", held).withColumnRenamed("id", id_col)


def _binary(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """Parts of ``data`` as an array; a slice's parts stay far below 2 GB unless one text doesn't."""
    large = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return large.cast(kind or pa.binary())


class Pieces:
    """The strings of all ids of a tokenizer without a decoder of its own; ``decode`` sets blanks between them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec.get("decoder") is not None:
            raise ValueError(f"{path} has a decoder; only pieces joined by blanks are known here")
        strings = {i: s for s, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        each = [strings.get(i, "").encode() + b" " for i in range(max(strings) + 1)]
        self.size = np.array([len(x) for x in each], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(each), np.uint8)

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of each text's pieces, and the n + 1 offsets."""
        size = self.size[ids]
        last = offs[1:][np.diff(offs) > 0] - 1
        size[last] -= 1  # no blank after the last piece
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        at = np.repeat(self.begin[ids] - ends[:-1], size) + np.arange(ends[-1])
        return self.data[at], ends[offs]


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``text``, what its ``ids_col`` decode to, special tokens included; null ids give a null text.

    ``encoded`` has an id column, n_tokens and ``ids_col`` as ``encode`` gives them.
    """

    held = f"{path} pieces"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held not in HELD:
            HELD[held] = Pieces(path)
        for batch in batches:
            for rows in slices(batch, ids_col):
                column = rows.column(rows.schema.get_field_index(ids_col))
                raw, offs = utf8(pc.fill_null(column, b"").cast(pa.large_binary()))
                text, ends = HELD[held].decode(raw.view("<u4"), offs // 4)
                made = pc.if_else(column.is_valid(), _binary(text, ends).cast(pa.string()), None)
                yield pa.RecordBatch.from_arrays([*rows.columns, made], names=[*rows.schema.names, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return map_arrow(encoded, run, f"{schema}, text string", held)


def op13_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document; nulls, repeated rows and long texts as in ``encode``."""
    docs, path = read_table(spark, sf_dir, "documents"), str(tokenizer_path())
    made = decode(encode(docs, path, write_lexicon(docs, path)), path)
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
