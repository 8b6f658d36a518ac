"""Each stage of the pipeline against a plain version of it."""

import hashlib
import math
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

import corpus_pipeline as C
from rulemesh.llm import pii, quality
from rulemesh.llm.stats import features

from .test_layout import WORD, check_packing, plain_targets
from .test_simhash import plain_kept


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """(input rows, output rows) of each stage by name."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for n, (name, stage) in enumerate(C.STAGES):
        path = f"{folder}/{n}"
        stage(spark, docs, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = docs.collect(), after.collect()
        if n < len(C.STAGES) - 1:
            assert after.dtypes == docs.dtypes
        docs = after
    return out


def test_quality(spark, sf_dir, stages):
    before, after = stages["quality_classifier"]
    model = quality.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = model.predict(features(pa.array([r.text for r in before], pa.large_string()))) >= 0.5
    assert Counter(after) == Counter(r for r, g in zip(before, good) if g)
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    clean = [i for i, q in label.items() if q == 1]
    assert sum(i in kept for i in clean) >= 0.98 * len(clean)


def test_near_duplicates(stages):
    before, after = stages["simhash_near_dedup"]
    keep = plain_kept({r.doc_id: r.text for r in before})
    assert Counter(after) == Counter(r for r in before if r.doc_id in keep)


def test_surrogates(spark, stages):
    before, after = stages["surrogates"]
    old = {r.doc_id: r for r in before}
    assert len(after) == len(old)
    variant = dict.fromkeys(pii.KINDS, 0)
    rows = spark.createDataFrame([(r.doc_id, r.text) for r in before], "doc_id long, text string")
    new = {r.doc_id: r.text for r in pii.pseudonymise(rows, pii.EXAMPLE_KEY, variant=variant).collect()}
    for r in after:
        assert r.text == new[r.doc_id] and r.n_chars == len(r.text)
        assert (r.lang, r.source) == (old[r.doc_id].lang, old[r.doc_id].source)


def test_mix(stages):
    before, after = stages["source_mix"]
    size = {r.doc_id: len(WORD.findall(r.text)) for r in before}
    by = defaultdict(list)
    for r in before:
        by[r.source].append(r.doc_id)
    aims = plain_targets({s: sum(size[i] for i in ids) for s, ids in by.items()})
    want = {}
    for s, ids in by.items():
        place, whole, target = 0, sum(size[i] for i in ids), math.floor(aims[s] + 1e-9)
        for i in sorted(ids, key=lambda i: hashlib.md5(f"mix-1:{i}".encode()).hexdigest()):
            taken = sum(max(0, min(p + place + size[i], target) - p - place) for p in (0, whole))
            want[i] = math.floor(taken / size[i] + 0.5) if size[i] else 0
            place += size[i]
    counted = Counter(r.doc_id for r in after)
    assert counted == Counter({i: n for i, n in want.items() if n})
    old = {r.doc_id: r for r in before}
    assert all(r == old[r.doc_id] for r in after)


def test_packing(stages):
    before, after = stages["best_fit_packing"]
    bins, tokens = check_packing(after, [(r.doc_id, r.text) for r in before])
    assert bins <= tokens / 2048 * 1.02 + 1


def test_run_is_the_stages_in_order(spark, sf_dir, stages):
    got = C.run(spark, sf_dir)
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(key, got.collect())) == Counter(map(key, stages["best_fit_packing"][1]))
    assert [n for n, _ in C.STAGES] == ["quality_classifier", "simhash_near_dedup", "surrogates", "source_mix", "best_fit_packing"]


def test_odd_and_empty_documents(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some words to keep here", "en", None, 23), (4, "w " * 3000, "en", "a", 6000)]
    docs = spark.createDataFrame([*rows, rows[2]], schema)
    for odd in (docs, docs.limit(0)):
        for name, stage in C.STAGES:
            found = stage(spark, odd, sf_dir)
            assert found.count() >= 0
            if name != "best_fit_packing":
                assert found.columns == docs.columns
