"""Reading and writing knowledge bases: folders of JSON entities, JSON lines, and tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXTS = "array<string>"
SCHEMAS = {
    "rules": "id string, brand_id string, rule_class string, tags array<string>, audience string, content_types array<string>, "
    "content_sub_type_ids array<string>, scope string, selector struct<section_types:array<string>, element_path:string>, "
    "applies_when array<struct<kind:string, value:string>>, evaluation_scope string, constraint_type string, effect string, "
    "polarity string, hardness string, precedence int, token_ids array<string>, asset_ids array<string>, governance string, "
    "rule_text string, intent string, summary string, source string, doc_ref string, group_id string, status string, version int",
    "tokens": "id string, brand_id string, token_type string, kind string, key string, value string, element_paths array<string>, "
    "derived_from struct<base_token_id:string, op:string, amount:double>, aliases array<string>, tier string, scope string, "
    "audience string, usage_ratio double, gated string, notes string, status string, version int",
    "assets": "id string, brand_id string, asset_type string, uri string, dims string, description string, alt_text string, "
    "contains_token_ids array<string>, required_pairing_token_ids array<string>, usage_conditions string, "
    "slot_compatibility array<string>, group_id string, group_order int, status string, version int",
    "subtypes": "id string, brand_id string, kind string, content_type string, name string, channel string, "
    "assembly struct<position:string, repeatable:boolean, locked:boolean>, fills_section_types array<string>, hosts_section_types array<string>",
    "templates": "id string, brand_id string, name string, source string, template_ref string, file string, instance_of string, "
    "fills_section_types array<string>, group_id string, group_order int, usage_conditions string",
    "relations": "src_rule_id string, dst_rule_id string, relation string, note string",
    "nodes": "id string, kind string, label string",
    "edges": "src string, dst string, type string",
}


def schema(entity: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[entity])


def read_entities(spark: SparkSession, folder: str, entity: str, strict: bool = False) -> DataFrame:
    """Entities of a folder with one JSON file each; files that begin with _ are left out, of one id the last file counts.

    Open values (effect, value, governance and the like) are kept as JSON text.
    A folder that doesn't exist has none. With ``strict`` a file that isn't JSON
    raises; without, it is left out.
    """
    kind = schema(entity)
    try:
        files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    except Exception as error:  # the path is looked up when the frame is made
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], kind)
    named = files.select(F.col("value").alias("json"), F.input_file_name().alias("file"))
    named = named.where(~F.element_at(F.split("file", "/"), -1).startswith("_"))
    options = {"mode": "FAILFAST"} if strict else {}
    rows = named.select("file", F.from_json("json", kind, options).alias("e")).where("e.id IS NOT NULL")
    return rows.groupBy("e.id").agg(F.max_by("e", "file").alias("e")).select("e.*")


def read_lines(spark: SparkSession, path: str, kind: T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped, bad ones raise if ``strict``."""
    _restored(spark, path)
    return spark.read.schema(kind).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def write_lines(rows: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines with sorted keys. What replaces older ones is written beside them first and then takes their place."""
    ordered = rows.select(sorted(rows.columns))
    _restored(rows.sparkSession, path)
    if append:
        ordered.write.mode("append").json(path)
        return
    beside = f"{path.rstrip('/')}.new"
    ordered.write.mode("overwrite").json(beside)
    _swap(rows.sparkSession, beside, path)


def _swap(spark: SparkSession, new: str, path: str) -> None:
    """Put the finished file or folder ``new`` in the place of ``path``.

    A file takes the place at once. A folder can't, so the old one is first put
    beside it as ``.old``, from where ``_restored`` brings it back if the swap
    was stopped between.
    """
    fs = spark._jvm.org.apache.hadoop.fs
    store = fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if store.getFileStatus(fs.Path(new)).isFile():
        options = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        options[0] = fs.Options.Rename.OVERWRITE
        fs.FileContext.getFileContext(fs.Path(path).toUri(), spark._jsc.hadoopConfiguration()).rename(fs.Path(new), fs.Path(path), options)
        return
    old = fs.Path(f"{path.rstrip('/')}.old")
    if store.exists(fs.Path(path)):
        store.delete(old, True)
        if not store.rename(fs.Path(path), old):
            raise OSError(f"could not put {path} aside")
    if not store.rename(fs.Path(new), fs.Path(path)):
        raise OSError(f"could not put {new} in the place of {path}")
    store.delete(old, True)


def _restored(spark: SparkSession, path: str) -> None:
    """Bring back what a stopped ``_swap`` has put aside."""
    fs = spark._jvm.org.apache.hadoop.fs
    store, old = fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), fs.Path(f"{path.rstrip('/')}.old")
    if store.exists(old) and not store.exists(fs.Path(path)):
        store.rename(old, fs.Path(path))


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    """One JSON document with sorted keys and a line's end; it is written beside the old one first."""
    text = json.dumps(document, sort_keys=True, ensure_ascii=False, indent=2) + "\n"
    make = spark._jvm.org.apache.hadoop.fs.Path
    store = make(path).getFileSystem(spark._jsc.hadoopConfiguration())
    out = store.create(make(f"{path}.new"), True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    _swap(spark, f"{path}.new", path)


def read_runs(spark: SparkSession, path: str, kind: T.StructType) -> DataFrame:
    """Results of runs, from a file or a folder of files, each with its file's name without ending as ``run``."""
    rows = spark.read.schema(kind).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    return rows.withColumn("run", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.json)?$", 1))


def append_open(items: DataFrame, path: str) -> None:
    """Only open items are ever appended to the log."""
    write_lines(items.where("status = 'open'"), path, append=True)


def write_tables(tables: dict[str, DataFrame], folder: str, partition: str = "brand_id") -> None:
    """One table for each entity; only partitions that the rows touch are replaced."""
    for name, rows in tables.items():
        out = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        (out.partitionBy(partition) if partition in rows.columns else out).parquet(f"{folder}/{name}")


def read_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def vocabulary(core: DataFrame, found: DataFrame) -> DataFrame:
    """(domain, name, brands) after adding ``found`` (domain, name, brand) to ``core``: new names come in, known ones gain brands."""
    rows = core.select("domain", "name", F.explode_outer("brands").alias("brand")).unionByName(found.select("domain", "name", "brand"))
    return rows.groupBy("domain", "name").agg(F.array_sort(F.collect_set("brand")).alias("brands"))


def blobs(bible: DataFrame) -> DataFrame:
    """(doc_ref, text) from rows (category, blobs): ``category[0]`` and so on."""
    rows = bible.select("category", F.posexplode("blobs").alias("at", "text"))
    return rows.select(F.concat("category", F.lit("["), F.col("at").cast("string"), F.lit("]")).alias("doc_ref"), "text")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")


def vectors(rows: DataFrame, path: str) -> None:
    """The vector table: collection, id, embedding, metadata (lists as comma lists, * for all)."""
    rows.write.mode("overwrite").partitionBy("collection").parquet(path)


def schema_docs(spark: SparkSession, folder: str) -> DataFrame:
    """(name, text) of the Markdown files of a folder, by name without ending; a folder that doesn't exist has none."""
    try:
        files = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    except Exception as error:  # the path is looked up when the frame is made
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "name string, text string")
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1).alias("name"), F.col("value").alias("text"))
