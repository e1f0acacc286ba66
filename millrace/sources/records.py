"""Record formats that Spark has no reader for, read with its text, JSON and binary sources.

Formats of lines (VCF) and of marked records (FASTA) are split within a file, so one file of any
size is shared by many tasks. The others are one document a file and are read a file a row.
A malformed record fails the read.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.operators.clinical import hl7_fields


def _checked(df: DataFrame, good: Column, message: str, shown: Column) -> DataFrame:
    """``df``; the first row that is not ``good`` fails the read with the message and what it is about, whichever columns are used."""
    fail = F.raise_error(F.concat(F.lit(f"{message}: "), F.coalesce(F.substring(shown, 1, 80), F.lit("null")))).cast("boolean")
    return df.where(F.when(F.coalesce(good, F.lit(False)), F.lit(True)).otherwise(fail))


def _mapped(entries: Column) -> Column:
    """A map of (key, value) entries; of equal keys the last counts."""
    last = lambda a: F.filter(a, lambda e, i: ~F.exists(F.slice(a, i + 2, F.size(a)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(F.get(F.transform(F.array(entries), last), F.lit(0)))


def _whole(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, source_uri): a row a file, line ends as line feeds."""
    read = spark.read.text(path, wholetext=True).withColumn("source_uri", F.col("_metadata.file_path"))
    return read.withColumn("value", F.regexp_replace("value", "\r\n?", "\n"))


def read_geojson(spark: SparkSession, path: str | list[str], properties: str = "map<string,string>") -> DataFrame:
    """(feature_id, geometry, properties), a row a feature of the collections; geometry is JSON text, null for none.

    properties: type of the properties, e.g. ``struct<name: string, size: long>``. A file without text has no features.
    """
    schema = f"type string, features array<struct<type string, id string, geometry string, properties {properties}>>"
    docs = spark.read.schema(schema).options(multiLine="true", mode="FAILFAST").json(path)
    rows = _checked(docs, F.col("type") == "FeatureCollection", "not a FeatureCollection", F.col("type")).select(F.explode("features").alias("f"))
    return _checked(rows, F.col("f.type") == "Feature", "not a Feature", F.col("f.type")).select(F.col("f.id").alias("feature_id"), "f.geometry", "f.properties")


def read_vcf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Variant calls: chrom, pos, id, ref, alt, qual (null for a point), filter, info (flags hold ``true``; of equal names the last counts)."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value")).where("value <> '' AND NOT startswith(value, '#')")
    at = lambda i: F.get("f", F.lit(i))
    cells = _checked(lines.select(F.split("value", "\t").alias("f"), "value"), F.size("f") >= 8, "fewer than 8 fields", F.col("value"))
    f = _checked(cells, at(1).try_cast("long").isNotNull() & (at(5).isin("", ".") | at(5).try_cast("double").isNotNull()), "a position or quality that is no number", F.col("value"))
    named = F.transform(
        F.filter(F.split(at(7), ";"), lambda x: (x != "") & (x != ".")),
        lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)).alias("key"), F.when(x.contains("="), F.regexp_replace(x, "^[^=]*=", "")).otherwise("true").alias("value")),
    )
    quality = F.when(~at(5).isin("", "."), at(5)).cast("double")
    return f.select(
        at(0).alias("chrom"),
        at(1).cast("long").alias("pos"),
        at(2).alias("id"),
        at(3).alias("ref"),
        at(4).alias("alt"),
        quality.alias("qual"),
        at(6).alias("filter"),
        _mapped(named).alias("info"),
    )


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(seq_id, description, sequence), a row a sequence; a header without a name fails the read.

    Records end where a line starts with ``>``, so a file is split between tasks. Text before a file's first header is read as
    a header; a lone ``>`` without a sequence is left out.
    """
    read = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "\r", "").alias("r")).where(r"r RLIKE '\\S'")
    body = F.regexp_replace("r", "^>", "")
    header, rest = F.trim(F.substring_index(body, "\n", 1)), F.when(body.contains("\n"), F.regexp_replace(body, "^[^\n]*\n", "")).otherwise("")
    split = _checked(read, header != "", "header without a name", F.col("r")).select(header.alias("header"), F.trim(F.regexp_replace(rest, r"[ \t]*\n[ \t]*", "")).alias("sequence"))
    return split.select(F.regexp_extract("header", r"^\S+", 0).alias("seq_id"), F.regexp_replace("header", r"^\S+\s*", "").alias("description"), "sequence")


def _items(section: Column) -> Column:
    """(key, value) of a log header's lines: name, point, unit, blank, value, colon, description."""
    value = lambda x: F.trim(F.regexp_extract(x, r"^[^.]*\.\S*\s(.*?)(?::[^:]*)?$", 1))
    return F.transform(section, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^.]*)\.", 1)).alias("key"), value(x).alias("value")))


def read_las(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source_uri, well, curves, data), a row a well log in ASCII: header values, curve names and samples, wrapped or not.

    The header's null value is null in data; a last sample that is not whole fails the read.
    """
    parts = _whole(spark, path).select("source_uri", F.split(F.concat(F.lit("\n"), "value"), r"\n[ \t]*~").alias("parts"))

    def lines(letter: str) -> Column:
        own = F.get(F.filter("parts", lambda s: F.upper(F.substring(s, 1, 1)) == letter), F.lit(0))
        return F.coalesce(F.filter(F.split(own, "\n"), lambda x, i: (i > 0) & x.rlike(r"^\s*[^\s#]")), F.array().cast("array<string>"))

    heads = parts.select("source_uri", _items(lines("W")).alias("w"), _items(lines("C")).alias("c"), F.array_join(lines("A"), " ").alias("a"))
    none = F.get(F.filter("w", lambda x: x["key"] == "NULL"), F.lit(0))["value"].try_cast("double")
    sampled = F.transform(F.filter(F.split("a", r"\s+"), lambda x: x != ""), lambda x: x.try_cast("double"))
    read = heads.select("source_uri", F.col("c.key").alias("curves"), _mapped(F.col("w")).alias("well"), none.alias("none"), sampled.alias("samples"))
    n = F.size("curves")
    read = _checked(read, ~F.exists("samples", lambda x: x.isNull()), "a sample that is no number", F.col("source_uri"))
    read = _checked(read, (n > 0) & (F.size("samples") % F.greatest(n, F.lit(1)) == 0) | (F.size("samples") == 0), "samples do not fill the curves", F.col("source_uri"))
    known = F.transform("samples", lambda x: F.when(F.col("none").isNull() | (x != F.col("none")), x))
    rows = F.transform(F.array(known), lambda a: F.transform(F.filter(F.sequence(F.lit(0), F.size(a)), lambda i: (i % F.greatest(n, F.lit(1)) == 0) & (i < F.size(a))), lambda i: F.slice(a, i + 1, n)))
    return read.select("source_uri", "well", "curves", F.get(rows, F.lit(0)).alias("data"))


def read_npy(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Rows of stored arrays: the fields of a structured one by name, or the columns of a table in the order of ``schema``."""
    names = spark.createDataFrame([], schema).columns

    def rows(frames):
        for frame in frames:
            for content in frame["content"]:
                array = np.load(io.BytesIO(content), allow_pickle=False)
                if array.dtype.names:
                    yield pd.DataFrame({c: array[c] for c in names})
                elif array.ndim == 2 and array.shape[1] == len(names):
                    yield pd.DataFrame(dict(zip(names, array.T, strict=True)))
                else:
                    raise ValueError(f"an array of shape {array.shape} has no {len(names)} columns")

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, schema)


def read_hl7(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source_uri, place, segment, fields), a row a segment of the messages in each file."""
    rows = _whole(spark, path).select("source_uri", F.posexplode(hl7_fields(F.col("value"))).alias("place", "s"))
    return rows.select("source_uri", "place", "s.segment", "s.fields")
