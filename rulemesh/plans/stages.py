"""A runner of named stages that skips what hasn't changed."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stage:
    """``make`` gets the session and the inputs' tables by name."""

    name: str
    inputs: tuple[str, ...]
    make: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    version: str = "1"


def fingerprint(rows: DataFrame) -> str:
    """A hash of a table's content whatever its order: a count and two sums of row hashes."""
    h = F.xxhash64(*rows.columns)
    got = rows.agg(F.count("*"), F.sum(h.cast("decimal(20,0)")), F.sum(F.pmod(h, F.lit(1_000_003)))).first()
    return hashlib.sha1(repr((sorted(rows.dtypes), tuple(map(str, got)))).encode()).hexdigest()[:16]


@dataclass
class Runner:
    """Stages over tables in a folder that all executors see; ``receipts`` say what made each table."""

    spark: SparkSession
    folder: str
    stages: list[Stage]
    receipts: dict[str, dict] = field(default_factory=dict)

    def run(self, sources: dict[str, DataFrame], wanted: set[str] | None = None) -> dict[str, str]:
        """What was done for each stage: ran, skipped or left out. Stages run in order; ``wanted`` limits them."""
        prints = {name: fingerprint(rows) for name, rows in sources.items()}
        tables, done = dict(sources), {}
        for stage in self.stages:
            key = json.dumps([stage.version, [[n, prints.get(n)] for n in stage.inputs]])
            receipt = self.receipts.get(stage.name)
            path = f"{self.folder}/{stage.name}"
            if wanted is not None and stage.name not in wanted:
                done[stage.name] = "left out"
            elif receipt and receipt["key"] == key and fingerprint(self.spark.read.parquet(path)) == receipt["print"]:
                done[stage.name] = "skipped"
            else:
                missing = [n for n in stage.inputs if n not in tables]
                if missing:
                    raise ValueError(f"{stage.name} needs {missing}")
                stage.make(self.spark, tables).write.mode("overwrite").parquet(path)
                done[stage.name] = "ran"
                self.receipts[stage.name] = {"key": key, "print": fingerprint(self.spark.read.parquet(path))}
            if stage.name in self.receipts:
                tables[stage.name] = self.spark.read.parquet(path)
                prints[stage.name] = self.receipts[stage.name]["print"]
        return done
