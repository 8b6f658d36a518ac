"""Builds that go on where they were stopped and make again only the partitions whose inputs have changed.

Tables and receipts live in ``Snapshots``: a step's rows and the receipt of what
made them are published in one manifest, so a build that is stopped at any point
has each step whole or not at all, and another process can take it up. A step
``by_part`` makes each of its partitions from its inputs' partitions of that name
and from inputs without the partition column; the rows of a partition are hashed,
so where a step makes the same rows again, nothing after it is made.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.snapshots import Snapshots


@dataclass(frozen=True)
class Step:
    """``make`` gets the session and the inputs by name; of partitioned ones only the partitions to be made, if ``by_part``.

    A new ``version`` says that ``make`` gives other rows for the same inputs.
    ``volatile`` columns may change without anything after them being made again.
    """

    name: str
    inputs: tuple[str, ...]
    make: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    version: str = "1"
    by_part: bool = True
    volatile: tuple[str, ...] = ()


@dataclass(frozen=True)
class Outcome:
    """``ran``, ``skipped`` or ``left out``, with the partitions that were made and those that have gone."""

    did: str
    made: tuple[str, ...] = ()
    gone: tuple[str, ...] = ()


def _key(*what) -> str:
    return hashlib.sha256(json.dumps(what, sort_keys=True).encode()).hexdigest()


@dataclass(frozen=True)
class Build:
    """Steps in the order in which they run. Sources are tables that ``store`` has by ``commit``."""

    store: Snapshots
    steps: tuple[Step, ...]

    def __post_init__(self):
        names = [s.name for s in self.steps]
        if len(set(names)) < len(names):
            raise ValueError("two steps have one name")
        for at, step in enumerate(self.steps):
            if late := set(step.inputs) & set(names[at:]):
                raise ValueError(f"{step.name} needs {sorted(late)}, made by itself or a later step")

    def _split(self, step: Step, tables: dict) -> tuple[dict[str, dict], dict[str, dict]]:
        """The hashes of a step's inputs by partition: those taken partition by partition, and those taken whole."""
        missing = [n for n in step.inputs if n not in tables]
        if missing:
            raise ValueError(f"{step.name} needs {missing}, which nothing has made")
        prints = {n: {p: x["print"] for p, x in tables[n]["parts"].items()} for n in step.inputs}
        column = f"`{self.store.partition}` "
        parted = {n for n in step.inputs if step.by_part and any(c.startswith(column) for c in tables[n]["schema"].split(", "))}
        return {n: prints[n] for n in parted}, {n: x for n, x in prints.items() if n not in parted}

    def _keys(self, step: Step, tables: dict) -> dict[str, str]:
        """What each of the step's partitions is made from; a step that isn't by part has one, named ``*``."""
        parted, whole = self._split(step, tables)
        common = [step.version, whole, {n: tables[n]["schema"] for n in step.inputs}]
        if not parted:
            return {"*": _key(common)}
        names = set().union(*parted.values())
        return {n: _key(common, {t: p.get(n) for t, p in parted.items()}) for n in names}

    def run(self, wanted: set[str] | None = None, force: set[str] = frozenset(), verify: bool = False) -> dict[str, Outcome]:
        """Make what is out of date. Steps not ``wanted`` stay as they are stored; those in ``force`` are made whole.

        With ``verify`` stored rows are read and hashed again, and partitions that
        aren't what was published are made anew. Only names and hashes of
        partitions reach the driver.
        """
        done = {}
        for step in self.steps:
            if wanted is not None and step.name not in wanted:
                done[step.name] = Outcome("left out")
                continue
            manifest = self.store.manifest()
            keys = self._keys(step, manifest["tables"])
            receipts = manifest.get("receipts", {})
            made = step.name in receipts and step.name in manifest["tables"]
            known = receipts[step.name] if made else {}
            stale = {n for n, k in keys.items() if step.name in force or known.get(n) != k}
            if verify and made:
                hurt = self.store.damaged(step.name, step.volatile)
                stale |= (hurt & set(keys)) if "*" not in keys else ({"*"} if hurt else set())
            gone = set(known) - set(keys)
            if made and not stale and not gone:
                done[step.name] = Outcome("skipped")
                continue
            done[step.name] = self._make(step, manifest["tables"], keys, stale, gone)
        return done

    def _make(self, step: Step, tables: dict, keys: dict[str, str], stale: set[str], gone: set[str]) -> Outcome:
        parted, _ = self._split(step, tables)
        old = set(tables.get(step.name, {"parts": {}})["parts"])
        if "*" in keys or "*" in gone:  # the whole table, or one that was made whole before
            inputs = {n: self.store.read(n) for n in step.inputs}
            rows = step.make(self.store.spark, inputs)
            parts, gone, stale = None, old, set(keys)
        else:
            inputs = {n: self.store.read(n, only=stale if n in parted else None) for n in step.inputs}
            rows = step.make(self.store.spark, inputs)
            parts = stale
        self.store.replace(step.name, rows, parts, gone, keys, step.volatile)
        return Outcome("ran", tuple(sorted(stale)), tuple(sorted(gone - stale)))

    def table(self, name: str) -> DataFrame:
        """A source's or step's rows as they are stored, whoever made them."""
        return self.store.read(name)
