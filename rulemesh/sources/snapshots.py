"""Versions of a set of tables: data that is never changed, and one manifest for each version.

A commit first writes the partitions whose content has changed, each into a
folder of its own, and then publishes a manifest that names the folders of all
partitions, by a rename that fails if the version is there already. Readers go by
the last manifest, so whatever a commit was stopped by, they see a whole
version: the one before or the new one. Folders that no kept manifest names are
leftovers and can be swept.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Digits of a version in its manifest's name.
DIGITS = 12
_MARK = "_part"


def _schema(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


class Conflict(RuntimeError):
    """Another commit has published the version first."""


@dataclass(frozen=True)
class Snapshots:
    """``root`` is a folder of a file system that driver and executors share; ``partition`` the column that parts tables have in common."""

    spark: SparkSession
    root: str
    partition: str = "brand_id"

    # ------------------------------------------------------------ file system

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _store(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        return sorted(s.getPath().getName() for s in self._store().listStatus(path)) if self._store().exists(path) else []

    def _create(self, text: str, *parts: str) -> None:
        out = self._store().create(self._path(*parts), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    # --------------------------------------------------------------- versions

    def versions(self) -> list[int]:
        return [int(n[:DIGITS]) for n in self._names("manifests") if n.endswith(".json") and n[:DIGITS].isdigit()]

    def manifest(self, version: int | None = None) -> dict:
        """A version's tables, by default the last one's; without any version an empty one, numbered 0."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "tables": {}}
        lines = self.spark.read.text(f"{self.root}/manifests/{version:0{DIGITS}d}.json", wholetext=True).first()
        return json.loads(lines[0])

    def read(self, name: str, version: int | None = None, only: set[str] | None = None) -> DataFrame:
        """A table as of a version, or the parts of it named in ``only``. One without rows has no files, only its columns."""
        table = self.manifest(version)["tables"][name]
        paths = [f"{self.root}/{p['path']}" for n, p in table["parts"].items() if only is None or n in only]
        return self.spark.read.schema(table["schema"]).parquet(*paths) if paths else self.spark.createDataFrame([], table["schema"])

    # ---------------------------------------------------------------- commits

    def _prints(self, rows: DataFrame, volatile: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
        """``rows`` with the name of their part, and a hash of each part's rows, ``volatile`` columns aside, whatever
        their order: one row a part is collected."""
        marked = self._mark(rows)
        whole = F.to_json(F.struct(*sorted(set(rows.columns) - set(volatile))), {"ignoreNullFields": "false"})
        sums = [F.sum(F.xxhash64(F.lit(n), whole).cast("decimal(20,0)")) for n in (1, 2)]
        found = marked.groupBy(_MARK).agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *[s.cast("string") for s in sums]), 256).alias("print"))
        return marked, {r[_MARK]: r["print"] for r in found.collect()}

    def _mark(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the name of their part."""
        key = F.col(self.partition).cast("string") if self.partition in rows.columns else F.lit("")
        return rows.withColumn(_MARK, F.when(key.isNull(), "null").otherwise(F.md5(key)))

    def _write(self, name: str, marked: DataFrame, changed: list[str] | None = None) -> str:
        """Write a table, or some parts of it; their folder."""
        folder = f"data/{name}/{uuid.uuid4().hex}"
        kept = marked if changed is None else marked.where(F.col(_MARK).isin(changed))
        kept.write.partitionBy(_MARK).parquet(f"{self.root}/{folder}")
        return folder

    def _publish(self, manifest: dict) -> None:
        text = json.dumps(manifest, sort_keys=True, ensure_ascii=False) + "\n"
        beside, final = f".{uuid.uuid4().hex}", f"{manifest['version']:0{DIGITS}d}.json"
        self._create(text, "manifests", beside)
        jvm = self.spark._jvm
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        place = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            place.rename(self._path("manifests", beside), self._path("manifests", final), options)
        except Exception as error:
            self._store().delete(self._path("manifests", beside), False)
            if "AlreadyExists" in str(error):
                raise Conflict(f"version {manifest['version']} has been published by another commit") from error
            raise

    def commit(self, tables: dict[str, DataFrame], drop: tuple[str, ...] = ()) -> dict[str, list[str]]:
        """Publish a version with these tables; the parts of each that were written. Other tables stay but for ``drop``.

        Without any change nothing is published. A part whose rows are as before
        keeps its folder. Another commit that was first raises Conflict and
        leaves the version as that one made it.
        """
        before = self.manifest()
        new = {n: t for n, t in before["tables"].items() if n not in drop}
        written = {}
        for name, rows in tables.items():
            if _MARK in rows.columns:
                raise ValueError(f"{name} has a column {_MARK}")
            old = new.get(name, {"parts": {}, "schema": None})
            schema = _schema(rows)
            known = old["parts"] if old["schema"] == schema else {}
            marked, prints = self._prints(rows)
            changed = sorted(p for p, x in prints.items() if known.get(p, {}).get("print") != x)
            parts = {p: known[p] for p in prints if p not in changed}
            if changed:
                folder = self._write(name, marked, changed)
                parts |= {p: {"path": f"{folder}/{_MARK}={p}", "print": prints[p]} for p in changed}
            new[name], written[name] = {"schema": schema, "parts": parts}, changed
        if new != before["tables"]:
            self._publish(before | {"version": before["version"] + 1, "tables": new})
        return written

    def replace(self, name: str, rows: DataFrame, parts: set[str] | None, gone: set[str], receipt: dict, volatile: tuple[str, ...] = ()) -> dict[str, str]:
        """Publish a version in which ``rows`` are the whole of ``parts`` of a table (None: of all parts), those in ``gone``
        have left it and ``receipt`` says what made it; the hashes of its parts.

        ``rows`` are computed once: they are written, and hashed as they were
        written. Rows of other parts, or other columns while parts stay, raise
        ValueError and nothing is published.
        """
        before = self.manifest()
        old = before["tables"].get(name, {"parts": {}, "schema": None})
        schema = _schema(rows)
        kept = {} if parts is None else {n: p for n, p in old["parts"].items() if n not in parts | gone}
        if kept and old["schema"] != schema:
            raise ValueError(f"{name} has other columns than the parts that stay")
        folder = self._write(name, self._mark(rows))
        found = self._parts(folder)
        if parts is not None and found - parts:
            raise ValueError(f"{name} has rows outside the {len(parts)} parts that were asked for")
        made = self._hashes(folder, found, schema, volatile)
        now = {n: {"path": f"{folder}/{_MARK}={n}", "print": made[n]} for n in found}
        tables = before["tables"] | {name: {"schema": schema, "parts": kept | now}}
        receipts = before.get("receipts", {}) | {name: receipt}
        self._publish(before | {"version": before["version"] + 1, "tables": tables, "receipts": receipts})
        return {n: p["print"] for n, p in tables[name]["parts"].items()}

    def _parts(self, folder: str) -> set[str]:
        return {n[len(_MARK) + 1 :] for n in self._names(folder) if n.startswith(f"{_MARK}=")}

    def _hashes(self, folder: str, parts: set[str], schema: str, volatile: tuple[str, ...]) -> dict[str, str]:
        if not parts:
            return {}
        paths = [f"{self.root}/{folder}/{_MARK}={n}" for n in sorted(parts)]
        return self._prints(self.spark.read.schema(schema).parquet(*paths), volatile)[1]

    def damaged(self, name: str, volatile: tuple[str, ...] = ()) -> set[str]:
        """Parts of a table whose files are gone or hold other rows than were published."""
        table = self.manifest()["tables"][name]
        there = {n: p for n, p in table["parts"].items() if self._names(*p["path"].split("/"))}
        paths = [f"{self.root}/{p['path']}" for p in there.values()]
        now = self._prints(self.spark.read.schema(table["schema"]).parquet(*paths), volatile)[1] if paths else {}
        return {n for n, p in table["parts"].items() if now.get(n) != p["print"]}

    def sweep(self, keep: int = 2) -> list[str]:
        """Delete manifests but the last ``keep`` and all that no kept one names; what was deleted. Not while commits run."""
        versions = sorted(self.versions())
        for version in versions[:-keep]:
            self._store().delete(self._path("manifests", f"{version:0{DIGITS}d}.json"), False)
        for name in self._names("manifests"):
            if name.startswith("."):
                self._store().delete(self._path("manifests", name), False)
        named = {p["path"] for v in versions[-keep:] for t in self.manifest(v)["tables"].values() for p in t["parts"].values()}
        gone = []
        for table in self._names("data"):
            for folder in self._names("data", table):
                kept = [f"data/{table}/{folder}/{p}" in named for p in self._names("data", table, folder) if p.startswith(_MARK)]
                if not any(kept):
                    self._store().delete(self._path("data", table, folder), True)
                    gone.append(f"{table}/{folder}")
        return gone
