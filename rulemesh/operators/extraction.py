"""Labels, quote alignment, provenance, votes over runs, patches and the coverage ledger."""

import re
import unicodedata
from collections import Counter
from collections.abc import Sequence
from difflib import SequenceMatcher
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from .quotes import containing
from .steps import some

# What makes a unit normative, conditional or verbatim, and what counts as a value.
NORMATIVE = r"(?iU)\b(must|never|always|only|do not|don't|required|reserved|max(?:imum)?|min(?:imum)?|at least|at most|exactly|prohibited|avoid)\b"
CONDITIONAL = r"(?iU)\b(if|when|on (?:light|dark)|desktop|mobile|print|unless|except)\b"
VERBATIM = r"(?iU)\b(verbatim|exact(?:ly as shown)?|word[- ]for[- ]word|as written)\b"
COLOUR = r"(?U)#[0-9a-fA-F]{3,8}\b"
SIZE = r"(?iU)\b\d+(?:\.\d+)?\s*(?:px|pt|em|rem|%)(?!\w)"
PROPORTION = r"(?U)\b\d+\s*:\s*\d+\b"
RGB = r"(?iU)\brgb\s*\(\s*\d{1,3}\s*,\s*\d{1,3}\s*,\s*\d{1,3}\s*\)"
WEIGHT = r"(?iU)\b(?:font-weight|weight)\s*:?\s*\d{1,4}\b"
RADII = r"(?iU)\b\d+(?:\.\d+)?\s*(?:px|pt|em|rem|%)(?:\s+\d+(?:\.\d+)?\s*(?:px|pt|em|rem|%))+(?!\w)"
VALUES = (COLOUR, SIZE, PROPORTION, RGB, WEIGHT, RADII)
RATIO = 0.92
#: Counts of characters in windows taken at once.
WINDOWS = 1_000_000


def labels(kind: Column, text: Column) -> Column:
    """Sorted labels that patterns alone give a unit."""
    body = ~kind.isin("blank", "heading")
    value = F.lit(False)
    for pattern in VALUES:
        value = value | text.rlike(pattern)
    normative = body & text.rlike(NORMATIVE)
    conditional = body & text.rlike(CONDITIONAL) & (value | normative)
    word_for_word = body & (text.rlike(VERBATIM) | S.has_long_quote(text))
    plain = ~(value | normative | conditional | word_for_word)
    named = [
        F.when(conditional, "conditional"),
        F.when((kind == "blank") | ((kind == "heading") & plain), "noise"),
        F.when(normative, "normative"),
        F.when(kind == "heading", "structural"),
        F.when(value, "value"),
        F.when(word_for_word, "verbatim"),
    ]
    return F.array_compact(F.array(*named))


def merged_labels(kind: Column, locked: Column, proposed: Column, required: Column) -> tuple[Column, Column]:
    """(labels, required): proposals and locked ones; blanks never, locked kinds of content always required."""
    must = F.arrays_overlap(locked, F.array(F.lit("value"), F.lit("normative"), F.lit("verbatim")))
    return F.array_sort(F.array_union(proposed, locked)), F.when(kind == "blank", False).when(must, True).otherwise(required)


# ------------------------------------------------------------------- alignment


#: Characters of text that the index of quotes takes at once.
QUOTE_CHARS = 1_000_000


def exact_quotes(quotes: DataFrame, units: DataFrame, quote: str, text: str, on: str | None = None, chars: int = QUOTE_CHARS) -> DataFrame:
    """Quotes in the units that have them: first place (from 0) and end.

    With ``on`` only units of the same value are searched (cited ones). Without,
    an index of sampled q-grams (see ``quotes``) leads to the units, and
    ``chars`` is how many characters of text it takes at once. Null quotes and
    texts have no places, an empty quote stands at the beginning of each text.
    """
    first = F.expr(f"locate(`{quote}`, `{text}`)") - 1
    if on is not None:
        found = quotes.join(units, on).withColumn("start", first).where("start >= 0")
        return found.withColumn("end", F.col("start") + F.length(quote))
    distinct = quotes.select(F.col(quote).alias("quote")).where("quote IS NOT NULL").distinct()
    marks = [F.xxhash64(F.lit(n), F.col(text)).alias(f"_d{n}") for n in (1, 2)]
    marked = units.select("*", *marks).where(F.col(text).isNotNull())
    texts = marked.select(F.col(text).alias("text"), F.col("_d1").alias("d1"), F.col("_d2").alias("d2")).dropDuplicates(["d1", "d2"])
    met = containing(distinct.where("quote <> ''"), texts, chars).withColumnsRenamed({"quote": "_quote", "d1": "_d1", "d2": "_d2"})
    found = marked.join(met, ["_d1", "_d2"]).drop("_d1", "_d2")
    if some(distinct.where("quote = ''")):
        found = found.unionByName(marked.drop("_d1", "_d2").withColumn("_quote", F.lit("")))
    joined = found.join(quotes, found["_quote"] == quotes[quote]).drop("_quote").withColumn("start", first.cast("int")).where("start >= 0")
    return joined.withColumn("end", F.col("start") + F.length(quote))


# Typographic signs and what they are compared as.
_SIGNS = str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'", "–": "-", "—": "-", " ": " "})


# blanks that folding changes
_BLANKS = re.compile(r"\s\s|[^\S ]")
# signs without blanks, and without a last one that others may combine with
_PLAIN = re.compile(r"[!-~]+(?![^\x00-\x7f])")


def folded(text: str) -> tuple[str, Sequence[int]]:
    """A text as it is compared (composed, plain quotes, single blanks, case folded), and where each of its characters comes from."""
    if text.isascii() and not _BLANKS.search(text):
        return text.lower(), range(len(text))
    signs = set(text)
    if unicodedata.is_normalized("NFC", text) and not any(map(unicodedata.combining, signs)) and not _BLANKS.search(text):
        # each sign stands for itself
        same = text if _SIGNS.keys().isdisjoint(map(ord, signs)) else text.translate(_SIGNS)
        out = same.casefold()
        return out, range(len(text)) if len(out) == len(text) else [k for k, c in enumerate(same) for _ in c.casefold()]
    out, source, gap = [], [], False
    at = 0
    while at < len(text):
        if plain := _PLAIN.match(text, at):
            out.append(plain[0].lower())
            source.extend(range(at, plain.end()))
            at, gap = plain.end(), False
            continue
        end = at + 1
        while end < len(text) and unicodedata.combining(text[end]):
            end += 1
        piece = unicodedata.normalize("NFC", text[at:end]).translate(_SIGNS)
        if piece.isspace():
            if not gap:
                out.append(" ")
                source.append(at)
            gap = True
        else:
            gap = False
            for c in piece.casefold():
                out.append(c)
                source.append(at)
        at = end
    return "".join(out), source


def align(quote: str, text: str, least: float = RATIO) -> tuple[int, int, str, float] | None:
    """(start, end, match, ratio) of a quote in a text: exact, else normalized, else the best similar window.

    Windows are 0.8 to 1.2 times the quote's length and begin at any character;
    of equal ones the first and then the shortest counts. A window's ratio is at
    most that of its longest common subsequence with the quote, and that at most
    the one of the characters they share; windows are tried from the highest
    bound down, and those whose bound can't win are left out.
    """
    at = text.find(quote)
    if not quote:
        return None
    if at >= 0:
        return at, at + len(quote), "exact", 1.0
    q, _ = folded(quote.strip())
    t, source = folded(text)
    if not q or not t:
        return None

    def end_of(k: int) -> int:
        # a sign that folds to several characters ends where the next sign begins
        return next((source[j] for j in range(k + 1, len(t)) if source[j] > source[k]), len(text))

    at = t.find(q)
    if at >= 0:
        return source[at], end_of(at + len(q) - 1), "normalized", 1.0
    begin, stop, bound = _windows(q, t, least)
    if not len(begin):
        return None
    best = None
    matcher = SequenceMatcher(autojunk=False)
    matcher.set_seq2(q)
    places = _places(q)
    begin, stop, bound = begin.tolist(), stop.tolist(), bound.tolist()
    waiting: list[tuple[float, int, int]] = []
    # by window, as a repeated passage makes many that are the same
    mosts: dict[str, float] = {}
    ratios: dict[str, float] = {}
    k = 0
    while k < len(begin) or waiting:
        key = (-bound[k], begin[k], stop[k]) if k < len(begin) else None
        if key is None or waiting and waiting[0] <= key:
            key = heappop(waiting)
            if best is not None and key >= best:
                break
            _, b, e = key
            if (window := t[b:e]) not in ratios:
                matcher.set_seq1(window)
                ratios[window] = matcher.ratio()
            ratio = ratios[window]
            if ratio >= least and (best is None or (-ratio, b, e) < best):
                best = -ratio, b, e
        elif best is not None and key >= best:
            break
        else:
            # the blocks that the ratio counts are a common subsequence
            _, b, e = key
            if (window := t[b:e]) not in mosts:
                mosts[window] = 2.0 * _common(places, window, len(q)) / (len(q) + e - b)
            if mosts[window] >= least:
                heappush(waiting, (-mosts[window], b, e))
            k += 1
    if best is None:
        return None
    return source[best[1]], end_of(best[2] - 1), "fuzzy", -best[0]


def _places(q: str) -> dict[str, int]:
    """Each character's places in ``q`` as bits."""
    out: dict[str, int] = {}
    for k, c in enumerate(q):
        out[c] = out.get(c, 0) | 1 << k
    return out


def _common(places: dict[str, int], text: str, n: int) -> int:
    """Length of the longest common subsequence of ``text`` and the ``n`` characters with these places."""
    whole = (1 << n) - 1
    open_ = whole
    for c in text:
        if at := open_ & places.get(c, 0):
            open_ = (open_ + at | open_ - at) & whole
    return n - open_.bit_count()


def _windows(q: str, t: str, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, stop and bound of the windows of ``t`` whose bound is ``least`` or more, the highest first."""
    count = Counter(q)
    signs, wanted = np.array([ord(c) for c in count], np.int32)[:, None], np.array(list(count.values()), np.int32)[:, None]
    there = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.int32)
    seen = np.zeros((len(signs), len(t) + 1), np.int32)
    np.cumsum(there == signs, axis=1, out=seen[:, 1:])
    low = max(1, int(0.8 * len(q)))
    high = min(max(low, int(1.2 * len(q))), len(t))
    found = []
    # no window shares more than the widest one from its place does, so most places are ruled out at once
    places = np.arange(max(len(t) - low + 1, 0))
    most = np.minimum(seen[:, np.minimum(places + high, len(t))] - seen[:, : len(places)], wanted).sum(0)
    places = places[2.0 * most / (len(q) + low) >= least]
    widths = np.arange(low, high + 1)
    step = max(1, WINDOWS // (len(signs) * len(widths) or 1))
    for k in range(0, len(places), step):
        begin = places[k : k + step, None]
        stop = begin + widths
        whole = stop <= len(t)
        shared = np.minimum(seen[:, np.minimum(stop, len(t))] - seen[:, begin], wanted[:, :, None]).sum(0)
        bound = 2.0 * shared / (len(q) + widths)
        at, of = np.nonzero(whole & (bound >= least))
        found.append((begin[at, 0], stop[at, of], bound[at, of]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    begin, stop, bound = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((stop, begin, -bound))
    return begin[order], stop[order], bound[order]


ALIGNED = T.StructType(
    [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("match", T.StringType()), T.StructField("ratio", T.DoubleType())]
)


@F.pandas_udf(ALIGNED)
def aligned(quote: pd.Series, text: pd.Series) -> pd.DataFrame:
    """``align`` of columns; ``failed`` where nothing fits or a side is null."""
    rows = [(align(q, t) if q is not None and t is not None else None) or (None, None, "failed", 0.0) for q, t in zip(quote, text)]
    return pd.DataFrame(rows, columns=["start", "end", "match", "ratio"]).astype({"start": "Int32", "end": "Int32"})


def placed(quote: str | None, units: list[dict], near: bool = False) -> dict | None:
    """The best place of a quote in its ``units``: match and ratio first, then the earliest; null if there is none.

    Units are tried one by one and, where none has the quote word for word, runs
    of consecutive units joined: a quote over two of them is fuzzy at best. With
    ``near`` all matches are, and units aren't joined. ``as_good`` counts the
    units and runs whose best place is as good.
    """
    if not quote:
        return None
    found = []
    for u in units:
        if (hit := align(quote, u["text"] or "")) is not None:
            start, end, match, ratio = hit
            rank = MATCH_RANK["fuzzy" if near else match]
            found.append((-rank, -ratio, u["start"] + start, u["start"] + end, [u["unit_id"]], u["doc_ref"]))
    if not near and all(-f[0] < MATCH_RANK["normalized"] for f in found):
        for run in _runs(units):
            hit = align(quote, "".join(u["text"] or "" for u in run))
            if hit is None:
                continue
            offsets = [u["start"] + k for u in run for k in range(len(u["text"] or ""))]
            start, end = offsets[hit[0]], offsets[hit[1] - 1] + 1
            over = [u["unit_id"] for u in run if u["start"] < end and u["end"] > start]
            if len(over) > 1:
                found.append((-MATCH_RANK["fuzzy"], -hit[3], start, end, over, run[0]["doc_ref"]))
    if not found:
        return None
    best = min(found)
    match = next(m for m, r in MATCH_RANK.items() if r == -best[0])
    as_good = sum(f[:2] == best[:2] for f in found)
    return {"doc_ref": best[5], "unit_ids": best[4], "start": best[2], "end": best[3], "match": match, "ratio": -best[1], "as_good": as_good}


def _runs(units: list[dict]) -> list[list[dict]]:
    """Two or more units of one document with consecutive ordinals."""
    out: list[list[dict]] = []
    for u in sorted(units, key=lambda u: (u["doc_ref"], u["ordinal"])):
        if out and (out[-1][-1]["doc_ref"], out[-1][-1]["ordinal"] + 1) == (u["doc_ref"], u["ordinal"]):
            out[-1].append(u)
        else:
            out.append([u])
    return [run for run in out if len(run) > 1]


PLACED = "doc_ref string, unit_ids array<string>, start int, end int, match string, ratio double, as_good int"


def align_cited(quotes: DataFrame, units: DataFrame) -> DataFrame:
    """Where each quote stands: in its cited units, over consecutive ones of them, or in a unit next to one.

    ``quotes``: quote_id, quote, unit_ids; ``units``: unit_id, doc_ref, ordinal,
    start, end, text. Returns quote_id and the fields of ``PLACED``; what stands
    next to a cited unit is fuzzy at best. A quote that stands nowhere is failed
    and spans the cited units of the first one's document; without any unit that
    exists it has an empty doc_ref and the place 0.
    """

    @F.pandas_udf(PLACED)
    def direct(quote: pd.Series, listed: pd.Series) -> pd.DataFrame:
        rows = []
        for q, us in zip(quote, listed):
            us = list(us)
            hit = placed(q, us)
            if hit is None:
                same = [u for u in us if u["doc_ref"] == us[0]["doc_ref"]]
                ids = [u["unit_id"] for u in sorted(same, key=lambda u: u["ordinal"])]
                span = {"start": min((u["start"] for u in same), default=0), "end": max((u["end"] for u in same), default=0)}
                hit = {"doc_ref": us[0]["doc_ref"] if us else "", "unit_ids": ids, **span, "match": "failed", "ratio": 0.0, "as_good": 0}
            rows.append(hit)
        return pd.DataFrame(rows, columns=["doc_ref", "unit_ids", "start", "end", "match", "ratio", "as_good"])

    @F.pandas_udf(PLACED)
    def beside(quote: pd.Series, listed: pd.Series) -> pd.DataFrame:
        none = dict.fromkeys(("doc_ref", "unit_ids", "start", "end", "match", "ratio", "as_good"))
        rows = [placed(q, list(us), near=True) or none for q, us in zip(quote, listed)]
        return pd.DataFrame(rows, columns=list(none)).astype({"start": "Int32", "end": "Int32", "as_good": "Int32"})

    fields = ["unit_id", "doc_ref", "ordinal", "start", "end", "text"]
    cited = quotes.select("quote_id", "quote", F.posexplode_outer(F.array_distinct("unit_ids")).alias("at", "unit_id"))
    there = units.select("unit_id", F.struct(*fields).alias("unit"))
    # a row is much work and few bytes, so partitions aren't to be drawn together
    spread = int(quotes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "quote_id", "quote"
    listed = cited.join(there, "unit_id", "left").repartition(*spread).groupBy("quote_id", "quote").agg(F.array_sort(F.collect_list(F.when(F.col("unit").isNotNull(), F.struct("at", "unit")))).alias("units"))
    first = listed.withColumn("units", F.transform("units", lambda u: u["unit"])).withColumn("found", direct("quote", "units"))
    beside_of = F.transform("units", lambda u: F.array(*[F.struct(u["doc_ref"].alias("doc_ref"), (u["ordinal"] + d).alias("ordinal")) for d in (-1, 1)]))
    keys = F.when(F.col("found.match") == "failed", F.array_distinct(F.flatten(beside_of)))
    wanted = first.select("quote_id", "quote", "found", F.explode_outer(keys).alias("key")).select("quote_id", "quote", "found", "key.*")
    joined = wanted.join(units.select("doc_ref", "ordinal", F.struct(*fields).alias("unit")), ["doc_ref", "ordinal"], "left")
    again = joined.repartition(*spread).groupBy("quote_id", "quote").agg(F.first("found").alias("found"), F.collect_list("unit").alias("near"))
    near = again.withColumn("next", beside("quote", "near"))
    return near.select("quote_id", F.when(F.col("next.match").isNotNull(), F.col("next")).otherwise(F.col("found")).alias("p")).select("quote_id", "p.*")


MATCH_RANK = {"exact": 3, "normalized": 2, "fuzzy": 1, "failed": 0}


def best_alignment(rows: DataFrame, key: str) -> DataFrame:
    """The best of several alignments: match, ratio and cited units first, then the earliest; with how many are as good."""
    rank = F.element_at(F.create_map(*[F.lit(x) for p in MATCH_RANK.items() for x in p]), F.col("match"))
    strength = F.struct(rank, F.col("ratio"), F.col("cited").cast("int"))
    rows = rows.withColumn("_strength", strength)
    order = Window.partitionBy(key).orderBy(F.desc("_strength"), "doc_ref", "start")
    best = F.max("_strength").over(Window.partitionBy(key))
    rows = rows.withColumn("_n", F.row_number().over(order)).withColumn("ambiguous", F.sum((F.col("_strength") == best).cast("int")).over(Window.partitionBy(key)))
    return rows.where("_n = 1").drop("_n", "_strength")


def hull(units: DataFrame, key: str) -> DataFrame:
    """The stretch from the first to the last cited unit of the first document, for quotes that align nowhere."""
    first = units.groupBy(key).agg(F.min("doc_ref").alias("doc_ref"))
    return units.join(first, [key, "doc_ref"]).groupBy(key, "doc_ref").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def value_status(kind: Column, canon: Column, span: Column, quote: Column, is_ref: Column) -> Column:
    """Whether a value's literal stands in the aligned span and in the quote."""
    pattern = S.value_pattern(kind, canon)
    inside = F.regexp_like(span, pattern) & F.regexp_like(quote, pattern)
    exact = F.lower(kind).isin("preferred_form", "body")
    return F.when(is_ref, "n/a").when(exact, F.when(F.trim(span) == F.trim(canon), "value_verified").otherwise("failed")).when(inside, "value_verified").otherwise("failed")


def quarantined(provenance: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Entities with concrete values of which every one failed."""
    concrete = provenance.where("is_concrete AND status <> 'n/a'")
    return concrete.groupBy(entity).agg(F.bool_and(F.col("status") == "failed").alias("_all")).where("_all").select(entity)


def claims(spans: DataFrame, quarantine: DataFrame) -> DataFrame:
    """(unit_id, entity_id) once each, of entities that aren't in quarantine."""
    return spans.select("entity_id", F.explode("unit_ids").alias("unit_id")).join(quarantine, "entity_id", "left_anti").distinct()


def ledger(labelled: DataFrame, claimed: DataFrame, excluded: DataFrame) -> DataFrame:
    """Each unit's status: excluded, unclaimed, over_claimed (several rules on a normative one) or covered.

    ``labelled``: unit_id, required, labels; ``claimed``: unit_id, entity_id,
    kind; ``excluded``: unit_id.
    """
    counts = claimed.groupBy("unit_id").agg(
        F.count("*").alias("claims"), F.count_if(F.col("kind") == "rule").alias("rules"), F.array_sort(F.collect_set("entity_id")).alias("claimed_by")
    )
    out = excluded.select("unit_id", F.lit(True).alias("_out")).distinct()
    joined = labelled.join(counts, "unit_id", "left").join(out, "unit_id", "left")
    status = (
        F.when(F.col("_out"), "excluded")
        .when(F.coalesce("claims", F.lit(0)) == 0, "unclaimed")
        .when((F.col("rules") > 1) & F.array_contains("labels", "normative"), "over_claimed")
        .otherwise("covered")
    )
    return joined.select("unit_id", "required", F.coalesce("claimed_by", F.array().cast("array<string>")).alias("claimed_by"), status.alias("status"))


# ------------------------------------------------------------- votes over runs


def consensus(rows: DataFrame, group: str, run: str, n_runs: int) -> DataFrame:
    """Groups by the number of runs that have them; consensus is a strict majority of all runs."""
    counted = rows.groupBy(group).agg(F.countDistinct(run).alias("runs"))
    return counted.withColumn("consensus", 2 * F.col("runs") > n_runs)


def field_votes(rows: DataFrame, group: str, run: str, fields: list[str], champion: str) -> DataFrame:
    """The winning value of each field of each group; absence is a vote, the champion's run wins ties."""
    from .aggregates import majority

    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    long = rows.select(group, run, F.explode(pairs).alias("p")).select(group, run, "p.*")
    return majority(long, [group, "field"], "value", F.col(run) == champion)


def champion(rates: DataFrame) -> DataFrame:
    """The run of the highest rate, then coverage, then the smallest id: columns run_id, rate, coverage."""
    return rates.orderBy(F.desc("rate"), F.desc("coverage"), "run_id").limit(1)


def greedy_clusters(rows: DataFrame, identity: str, key: str, units: str, least: float = 0.5) -> DataFrame:
    """(identity, key, cluster): in order of keys each row joins the first cluster whose seed it resembles, else seeds one.

    The outcome depends on the order, so an identity is one group; identities
    are single rules seen by a few runs.
    """

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        seeds: list[tuple[str, set]] = []
        out = []
        for name, items in sorted(zip(frame[key], map(set, frame[units]))):
            home = next((s for s, have in seeds if (len(have & items) / len(have | items) if have | items else 1.0) >= least), None)
            if home is None:
                seeds.append((name, items))
                home = name
            out.append((frame[identity].iloc[0], name, home))
        return pd.DataFrame(out, columns=[identity, key, "cluster"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in (identity, key)}
    schema = f"{identity} {kinds[identity]}, {key} {kinds[key]}, cluster {kinds[key]}"
    return rows.select(identity, key, units).groupBy(identity).applyInPandas(one, schema)


# --------------------------------------------------------------------- patches


def judged_patches(state: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """``patches`` (seq, op, ``key`` and more) with ``there``, whether their key is there when their turn comes, and ``ok``.

    Patches of a key are applied by ``seq``. Whatever is there, after an add
    the key is there and after a delete it isn't, so the last of them before a
    patch, or else the state, tells. Adding what is there, and updating or
    deleting what isn't, is rejected.
    """
    before = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("op").isin("add", "delete"), F.col("op")), ignorenulls=True).over(before)
    known = patches.join(state.select(key, F.lit(True).alias("_there")), key, "left").withColumn("_last", last)
    there = F.when(F.col("_last").isNull(), F.col("_there").isNotNull()).otherwise(F.col("_last") == "add")
    return known.withColumn("there", there).withColumn("ok", (F.col("op") == "add") != there).drop("_last", "_there")


def apply_patches(state: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(new state, rejected): adds, updates and deletes by key, one after another by ``seq``.

    ``patches``: seq, op, ``key``, ``columns`` and nothing else is used; see
    ``judged_patches``. A null in an update leaves the old value, one in an add
    is the value.
    """
    judged = judged_patches(state, patches.select("seq", "op", key, *columns), key)
    good = judged.where("ok")
    turn = F.when(F.col("op").isin("add", "delete"), F.col("seq"))
    # what counts comes after the last add or delete that was made
    made = good.withColumn("_turn", F.max(turn).over(Window.partitionBy(key)))
    since = F.col("_turn").isNull() | (F.col("seq") >= F.col("_turn"))
    ends = F.max_by("op", turn)

    def latest(c: str) -> Column:
        given = since & F.col(c).isNotNull() & (F.col("op") != "delete")
        return F.max_by(F.when(given, F.col(c)), F.when(given, F.col("seq"))).alias(f"_{c}")

    one = made.groupBy(key).agg(ends.alias("_ends"), *[latest(c) for c in columns])
    joined = state.select(key, *columns, F.lit(True).alias("_there")).join(one, key, "full")
    kept = joined.where(F.coalesce(F.col("_ends") == "add", F.col("_there") & ~F.col("_ends").eqNullSafe("delete"), F.lit(False)))
    new = F.col("_ends").eqNullSafe("add")
    values = [F.when(new, F.col(f"_{c}")).otherwise(F.coalesce(f"_{c}", c)).alias(c) for c in columns]
    rejected = judged.where("NOT ok").select("seq", key, "op", F.when(F.col("op") == "add", "exists").otherwise("missing").alias("reason"))
    return kept.select(key, *values), rejected


def audit(before: DataFrame, after: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(``key``, before, after): hashes of each patched row as it was and is, null where it wasn't or isn't."""
    mark = F.substring(F.sha1(F.to_json(F.struct(*sorted(columns)))), 1, 16)
    touched = patches.select(key).distinct()
    old, new = before.select(key, mark.alias("before")), after.select(key, mark.alias("after"))
    return touched.join(old, key, "left").join(new, key, "left")


def deferred(findings: DataFrame) -> DataFrame:
    """Open findings of weight go to a person."""
    heavy = (F.col("resolution") == "open") & F.col("severity").isin("major", "critical")
    return findings.withColumn("resolution", F.when(heavy, "deferred_human").otherwise(F.col("resolution")))


def contract_breaches(answers: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(key, problem) where answers miss a wanted id, add one, or give one twice."""
    lacking = wanted.join(answers, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    extra = answers.join(wanted, key, "left_anti").select(key, F.lit("extra").alias("problem")).distinct()
    twice = answers.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("duplicate").alias("problem"))
    return lacking.unionByName(extra).unionByName(twice)


def triage(computed: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(current, newly open): computed items with their latest disposition, and those to append to the log.

    ``computed``: queue, key, subject; ``history``: queue, key, status, position.
    """
    order = Window.partitionBy("queue", "key").orderBy(F.desc("position"))
    last = history.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("queue", "key", "status")
    current = computed.join(last, ["queue", "key"], "left").withColumn("known", F.col("status").isNotNull()).withColumn("status", F.coalesce("status", F.lit("open")))
    return current.drop("known"), current.where(~F.col("known")).drop("known")


# ----------------------------------------------------- provenance and ledger rest

#: Field paths whose values must be proved by a quote.
CONCRETE = r"(?:^|\.)value$|(?:^|\.)value\.default$|^body$|^preferred_form$|^variants\[\d+\]\.value$"
#: Kinds of conflict that keep a release closed while they are open.
CLASS_A = ("hard_hard", "equal_specificity", "verbatim_clash", "global_unsat")


def is_concrete(path: Column) -> Column:
    return path.rlike(CONCRETE)


def variant_paths(rows: DataFrame, key: str, values: str) -> DataFrame:
    """(key, path, value): ``variants[0].value`` and so on, one row for each element of ``values``."""
    each = rows.select(key, F.posexplode(values).alias("at", "value"))
    return each.select(key, F.concat(F.lit("variants["), F.col("at").cast("string"), F.lit("].value")).alias("path"), "value")


def soft_mismatches(claimed: DataFrame, labelled: DataFrame) -> DataFrame:
    """(unit_id, entity_id, kind) of claims of a kind that the unit isn't expected to yield; units that expect nothing don't count."""
    met = claimed.join(labelled.select("unit_id", "expected"), "unit_id")
    return met.where((F.size("expected") > 0) & ~F.array_contains("expected", F.col("kind"))).select("unit_id", "entity_id", "kind")


def orphans(entities: DataFrame, spans: DataFrame, key: str = "entity_id") -> DataFrame:
    """Entities without a span that was verified and aligned."""
    proved = spans.where("verification = 'value_verified' AND match <> 'failed'").select(key)
    return entities.select(key).join(proved, key, "left_anti")


def open_class_a(conflicts: DataFrame, triaged: DataFrame) -> DataFrame:
    """(key, kind) of CLASS_A conflicts whose latest disposition is open, or that have none."""
    last = triaged.groupBy("key").agg(F.max_by("status", "position").alias("_status"))
    known = conflicts.where(F.col("kind").isin(*CLASS_A)).join(last, "key", "left")
    return known.where(F.coalesce("_status", F.lit("open")) == "open").select("key", "kind").distinct()


def unverified(provenance: DataFrame, key: str = "entity_id") -> DataFrame:
    """Entities of which some concrete path isn't verified."""
    good = F.bool_and(F.col("status") == "value_verified")
    return provenance.where(is_concrete(F.col("path"))).groupBy(key).agg(good.alias("_good")).where("NOT _good").select(key)


def group_refs(rows: DataFrame, group: str, ref: str) -> tuple[DataFrame, DataFrame]:
    """(group, ref) of groups with just one ref, and (group, n) of the others, which have to be settled by hand."""
    counted = rows.groupBy(group).agg(F.countDistinct(ref).alias("n"), F.min(ref).alias(ref))
    return counted.where("n = 1").select(group, ref), counted.where("n <> 1").select(group, "n")


def run_problems(runs: DataFrame, run: str, key: str) -> DataFrame:
    """(run, problem): a run without an entity id, or with one twice."""
    blank = runs.where(F.coalesce(F.trim(F.col(key)), F.lit("")) == "").select(run, F.lit("blank_id").alias("problem"))
    twice = runs.groupBy(run, key).agg(F.count("*").alias("_n")).where(f"_n > 1 AND trim({key}) <> ''").select(run, F.lit("duplicate_id").alias("problem"))
    return blank.unionByName(twice).distinct()


def without_evidence(document: Column) -> Column:
    """A map without the entries whose keys end in ``_evidence``."""
    return F.map_filter(document, lambda k, v: ~k.endswith("_evidence"))


def minted_ids(rows: DataFrame, brand: str, slug: Column, order: list[str]) -> DataFrame:
    """``rows`` with ``minted``: rule_brand_slug, and _2, _3 and so on for later rows of one slug."""
    base = F.concat_ws("_", F.lit("rule"), F.lit(brand), slug)
    nth = F.row_number().over(Window.partitionBy("_base").orderBy(*order))
    numbered = rows.withColumn("_base", base).withColumn("_nth", nth)
    return numbered.withColumn("minted", F.when(F.col("_nth") == 1, F.col("_base")).otherwise(F.concat_ws("_", "_base", F.col("_nth").cast("string")))).drop("_base", "_nth")


def mapped_relations(relations: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations between minted ids, those with an end that wasn't minted); ``ids``: old, minted."""
    a, b = (ids.select(F.col("old").alias(e), F.col("minted").alias(f"_{e}")) for e in ("src", "dst"))
    both = relations.join(a, "src", "left").join(b, "dst", "left")
    known = F.col("_src").isNotNull() & F.col("_dst").isNotNull()
    return both.where(known).select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "relation").distinct(), both.where(~known).select("src", "dst", "relation")


def merged_variants(rows: DataFrame, token: str, guard: Column, run: str, value: str, champion: Column) -> DataFrame:
    """(token, guard_hash, value, votes, agreement): the winning value of each guard of each token; the champion's run wins ties."""
    from .aggregates import majority

    hashed = rows.withColumn("guard_hash", F.substring(F.sha1(F.to_json(guard)), 1, 16))
    return majority(hashed, [token, "guard_hash"], value, champion)


def canon_conflicts(rows: DataFrame, path: str, run: str, canon: str, champion: Column) -> tuple[DataFrame, DataFrame]:
    """(path, canon) that the champion's run gives, and all pairs (path, a, b) of different canons of a path."""
    each = rows.select(path, F.col(canon).alias("canon")).distinct()
    chosen = rows.where(champion).groupBy(path).agg(F.min(canon).alias("canon"))
    a, b = each.withColumnRenamed("canon", "a"), each.withColumnRenamed("canon", "b")
    return chosen, a.join(b, path).where("a < b")


def relation_handoff(relations: DataFrame, emitted: DataFrame, champion: str) -> DataFrame:
    """(group, relation) once each: the champion's, and what a strict majority of the runs that emitted the group has.

    ``relations``: run, group, relation; ``emitted``: run, group.
    """
    runs = emitted.groupBy("group").agg(F.countDistinct("run").alias("_runs"))
    counted = relations.groupBy("group", "relation").agg(F.countDistinct("run").alias("_n"), F.bool_or(F.col("run") == champion).alias("_champion"))
    return counted.join(runs, "group").where(F.col("_champion") | (2 * F.col("_n") > F.col("_runs"))).select("group", "relation")


def merged_evidence(base: DataFrame, other: DataFrame) -> DataFrame:
    """(entity, guard, path, items): ``base`` with the evidence of ``other``.

    Both: entity, guard (hash of a variant's guard, empty outside of variants),
    path, items. Items of paths that end in ``_evidence`` are united and sorted,
    all else stays as ``base`` has it. Variants with guards that ``base`` lacks
    come in whole; entities that it lacks don't.
    """
    key = ["entity", "guard", "path"]
    a = base.select(*key, F.col("items").alias("_a"), F.lit(True).alias("_in_base"))
    entities = base.select("entity").distinct()
    guards = base.select("entity", "guard", F.lit(True).alias("_known")).distinct()
    b = other.join(entities, "entity", "left_semi").join(guards, ["entity", "guard"], "left").select(*key, F.col("items").alias("_b"), "_known")
    evidence = F.col("path").endswith("_evidence")
    both = a.join(b, key, "full").where(F.col("_in_base") | evidence | F.col("_known").isNull())
    united = F.array_sort(F.array_union(F.coalesce("_a", "_b"), F.coalesce("_b", "_a")))
    return both.select(*key, F.when(evidence, united).otherwise(F.coalesce("_a", "_b")).alias("items"))


def selected_units(units: DataFrame, excluded: DataFrame, key: str = "unit_id") -> DataFrame:
    """All units but the excluded ones."""
    return units.join(excluded.select(key), key, "left_anti")


def section_names(rules: DataFrame, subtypes: DataFrame, core: DataFrame) -> DataFrame:
    """(section): of selectors, of what subtypes fill or host, and of the vocabulary; once each.

    ``rules``: section_types; ``subtypes``: fills, hosts; ``core``: section.
    """
    named = rules.select(F.explode("section_types").alias("section"))
    for c in ("fills", "hosts"):
        named = named.union(subtypes.select(F.explode(c)))
    return named.union(core.select("section")).where("section IS NOT NULL").distinct()
