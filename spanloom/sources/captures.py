"""Manifests, ring metadata, tile configurations, pair lists and logs as DataFrames, and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as E


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; every column is a string."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def selected_geometry(manifest: DataFrame) -> DataFrame:
    """Rows of role geometry that are selected."""
    return manifest.where((F.col("source_role") == "geometry") & (F.lower("selected_for_geometry") == "true"))


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, sha256, length, stamp, suffix) of the JPEG files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[jJ][pP]*[gG]").option("recursiveFileLookup", True).load(path)
    out = files.select("path", E.basename("path").alias("name"), F.sha2("content", 256).alias("sha256"), "length")
    order = E.name_order("name")
    return out.withColumns({"stamp": order[0], "suffix": order[1]})


def read_rings(spark: SparkSession, path: str) -> DataFrame:
    """(name, ring) from JSON with a ``records`` array or a bare one; of rows of one name the last counts."""
    raw = spark.read.text(path, wholetext=True)
    record = "struct<relative_path:string,logical_ring_id:string>"
    listed = F.coalesce(F.from_json("value", f"struct<records:array<{record}>>")["records"], F.from_json("value", f"array<{record}>"))
    rows = raw.select(F.posexplode(listed).alias("ord", "r")).select("ord", E.basename("r.relative_path").alias("name"), F.col("r.logical_ring_id").alias("ring"))
    return rows.groupBy("name").agg(F.max_by("ring", "ord").alias("ring"))


def read_tile_config(spark: SparkSession, path: str) -> DataFrame:
    """(tile, ref, pos, source) of configurations of two lines a reference: its name, then its sources.

    Comments are skipped.  An odd number of lines, a reference twice in a tile,
    or a source that is its reference or repeated raises an error.
    """
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("tile"), "value")
    lines = F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    t = raw.select("tile", lines.alias("lines"))
    bad = F.size("lines") % 2 == 1
    refs = F.filter("lines", lambda x, i: i % 2 == 0)
    t = t.withColumn("lines", F.when(bad, F.raise_error(F.lit("odd number of lines"))).when(F.size(F.array_distinct(refs)) < F.size(refs), F.raise_error(F.lit("a reference is repeated"))).otherwise(F.col("lines")))
    rows = t.select("tile", F.explode(F.filter(F.transform("lines", lambda x, i: F.when(i % 2 == 0, F.struct(x.alias("ref"), F.element_at("lines", i + 2).alias("sources")))), lambda r: r.isNotNull())).alias("r"))
    sources = F.transform(F.split("r.sources", ","), lambda x: F.trim(x))
    rows = rows.select("tile", F.col("r.ref").alias("ref"), sources.alias("s"))
    wrong = F.array_contains("s", F.col("ref")) | (F.size(F.array_distinct("s")) < F.size("s"))
    return rows.select("tile", "ref", F.posexplode(F.when(wrong, F.raise_error(F.lit("a source is its reference or repeated"))).otherwise(F.col("s"))).alias("pos", "source"))


def tile_config_text(adjacency: DataFrame, names: DataFrame) -> DataFrame:
    """(value): the lines of a configuration from (ref, source, rank), references in the order of ``names`` (name, ord)."""
    refs = adjacency.groupBy("ref").agg(F.array_sort(F.collect_list(F.struct("rank", "source"))).alias("s")).join(names, F.col("ref") == F.col("name"))
    return refs.orderBy("ord").select(F.explode(F.array("ref", F.array_join(F.transform("s", lambda x: x["source"]), ", "))).alias("value"))


def pair_list_text(pairs: DataFrame) -> DataFrame:
    """(value): canonical pairs (a, b) parted by a space; white space in a name raises an error."""
    bad = F.col("a").rlike(r"\s") | F.col("b").rlike(r"\s")
    return pairs.orderBy("a", "b").select(F.when(bad, F.raise_error(F.lit("white space in a name"))).otherwise(F.concat_ws(" ", "a", "b")).alias("value"))


def write_once(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Fails if there is anything at ``path``."""
    df.write.mode("errorifexists").format(form).save(path)


def mask_path(images: DataFrame, listing: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """``images`` with path and rule of the first of the candidate names, in order, that ``listing`` (file) has."""
    tries = images.withColumn("c", F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(k).alias("rule"), c.alias("file")) for i, (k, c) in enumerate(rules)])))
    found = tries.select("name", "c.*").join(listing.select("file"), "file").groupBy("name").agg(F.min_by(F.struct("file", "rule"), "rank").alias("m"))
    return images.join(found, "name", "left").select(*images.columns, F.col("m.file").alias("path"), F.coalesce("m.rule", F.lit("missing")).alias("rule"))


def runtime_phases(spark: SparkSession, path: str, marker: str, flags: tuple[str, str]) -> DataFrame:
    """(block, first, second) of the two flags in each block that ``marker`` begins in a log."""
    text = spark.read.text(path, wholetext=True)
    block = text.select(F.posexplode(F.split("value", marker)).alias("block", "t")).where("block > 0")
    return block.select("block", *[F.regexp_extract("t", rf"{f}\s*[:=]\s*(\w+)", 1).alias(n) for n, f in zip(("first", "second"), flags, strict=True)])


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows of one key the last in ``order``."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
