"""An index of sampled q-grams that finds where quotes stand in texts.

Of each window of consecutive q-grams of a text the one with the lowest hash is
kept. A quote that is as long as a window has such a q-gram too, and wherever
the quote stands, the text has kept the same one: so one q-gram of a quote, the
one that fewest texts have, leads to all texts that can have it. Postings and
quotes meet by an equi-join on the hash; a posting also says where the quote
would have to stand, which rules most others out, and what is left is compared
as it is. Short quotes have indexes of shorter q-grams and windows, made only
if there are such quotes. Nothing of quotes or texts goes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .steps import cut, some

#: Bytes of a q-gram and q-grams of a window; the first that a quote is long enough for is its index.
LEVELS = ((16, 16), (6, 4), (1, 1))
#: Bytes of text taken at once.
SLICE = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def winnowed(texts: pa.Array, q: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of the q-grams that some window of ``w`` of them in the text has as its lowest; places are in bytes."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]].astype(np.uint64) if data is not None else np.zeros(0, np.uint64)
    offs = offs - offs[0]
    n = len(raw) - q - w + 2
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    grams = np.zeros(len(raw) - q + 1, np.uint64)
    for k in range(q):
        grams = grams * np.uint64(0x100000001B3) + raw[k : k + len(grams)] + np.uint64(1)
    grams = _mixed(grams)
    # windows that a text holds whole
    inside = np.zeros(n + 1, np.int64)
    size = np.diff(offs)
    whole = size >= q + w - 1
    np.add.at(inside, offs[:-1][whole], 1)
    np.add.at(inside, np.minimum((offs[1:] - (q + w - 2))[whole], n), -1)
    starts = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    lowest = np.zeros(n, np.int64)
    best = grams[:n].copy()
    for k in range(1, w):  # the first of equal ones stays
        lower = grams[k : k + n] < best
        best[lower], lowest[lower] = grams[k : k + n][lower], k
    place = np.unique(starts + lowest[starts])
    owner = np.searchsorted(offs, place, "right") - 1
    return owner, place - offs[owner], grams[place]


def _sampled(rows: DataFrame, text: str, q: int, w: int, size: int) -> DataFrame:
    """``rows``, their text replaced by (hash, place, length) of each kept q-gram."""
    names = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
                part = batch.slice(at, to - at)
                whole = pc.fill_null(part.column(batch.schema.get_field_index(text)), "")
                owner, place, gram = winnowed(whole, q, w)
                taken = [part.column(batch.schema.get_field_index(c)).take(pa.array(owner)) for c in names]
                length = pc.binary_length(whole).to_numpy().astype(np.int64)[owner]
                yield pa.RecordBatch.from_arrays([*taken, pa.array(gram.view(np.int64)), pa.array(place), pa.array(length)], names=[*names, "hash", "place", "length"])
                at = to

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text)
    return rows.mapInArrow(run, f"{schema}, hash long, place long, length long")


def containing(quotes: DataFrame, texts: DataFrame, size: int = SLICE) -> DataFrame:
    """(quote, d1, d2): which distinct texts have which distinct quotes.

    ``quotes``: quote, distinct, not empty; ``texts``: text, d1 and d2, two hashes that
    tell texts apart. Each level reads the texts once, however many quotes it has.
    """
    length = F.octet_length("quote")
    out, upper = None, None
    for q, w in LEVELS:
        least = q + w - 1
        mine = quotes.where((length >= least) if upper is None else (length >= least) & (length < upper))
        upper = least
        if not some(mine):
            continue
        wanted = cut(_sampled(mine.select("quote", F.col("quote").alias("text")), "text", q, w, size).withColumnsRenamed({"place": "at", "length": "needs"}))
        postings = _sampled(texts.select("d1", "d2", "text"), "text", q, w, size)
        postings = cut(postings.join(wanted.select("hash").distinct(), "hash", "left_semi"))
        owners = postings.groupBy("hash").agg(F.count("*").alias("n"))
        # a q-gram that no text has rules its quote out
        known = wanted.join(owners, "hash", "left").groupBy("quote").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash", "at", "needs")).alias("best"))
        rarest = known.where("best.n > 0").select("quote", "best.hash", "best.at", "best.needs")
        met = postings.join(rarest, "hash").where((F.col("place") >= F.col("at")) & (F.col("place") - F.col("at") + F.col("needs") <= F.col("length")))
        part = met.select("quote", "d1", "d2").distinct()
        out = part if out is None else out.unionByName(part)
    if out is None:
        return quotes.select("quote", F.lit(0).cast("long").alias("d1"), F.lit(0).cast("long").alias("d2")).where("false")
    return out
