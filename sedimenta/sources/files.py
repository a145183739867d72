"""File sources (S3-S9, S11, S13, S14, S17): explicit schemas, no inference, archives read by ranges or as streams."""

from __future__ import annotations

import csv
import io
import json
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .archives import safe_member, store_of


def strings(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_tsv(spark: SparkSession, path: str, columns: list[str], wanted: list[str]) -> DataFrame:
    """Tab-separated text with a header, no quoting, all strings, blank is null; only wanted columns are parsed."""
    return spark.read.schema(strings(columns)).option("header", True).option("sep", "\t").option("quote", "").option("nullValue", "").option("mode", "FAILFAST").csv(path).select(*wanted)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Quoted CSV with a header, all strings."""
    return spark.read.schema(strings(columns)).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "FAILFAST").csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; a broken line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_zip_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The largest CSV member of each ZIP archive: file, row_number (from 1) and the wanted columns as strings.

    headings.csv, if there, renames columns (its columns: name, heading). A member that leaves the archive, or a wanted
    column that is missing, is an error. A byte-order mark is dropped.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file in batch["path"]:
                store, at = store_of(file)
                with store.open_input_file(at) as f, zipfile.ZipFile(f) as z:  # the archive is read by ranges
                    bad = [n for n in z.namelist() if not safe_member(n)]
                    if bad:
                        raise ValueError(f"unsafe member {bad[0]}")
                    names = {}
                    if "headings.csv" in z.namelist():
                        names = {r["heading"]: r["name"] for r in csv.DictReader(io.TextIOWrapper(z.open("headings.csv"), "utf-8-sig"))}
                    tables = [i for i in z.infolist() if i.filename.endswith(".csv") and i.filename not in ("headings.csv", "citation.csv")]
                    largest = max(tables, key=lambda i: (i.file_size, i.filename))
                    reader = csv.reader(io.TextIOWrapper(z.open(largest), "utf-8-sig", newline=""))
                    header = [names.get(c, c) for c in next(reader)]
                    place = [header.index(c) for c in columns]
                    held = []
                    for n, row in enumerate(reader, 1):
                        held.append((file, n, *(row[i] or None for i in place)))
                        if len(held) == 8192:
                            yield pd.DataFrame(held, columns=["file", "row_number", *columns])
                            held = []
                    if held:
                        yield pd.DataFrame(held, columns=["file", "row_number", *columns])

    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("row_number", T.LongType()), *strings(columns)])
    return spark.read.format("binaryFile").load(path).select("path").mapInPandas(rows, schema)


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """state.json members of tar.gz archives: file, member, pages, returned."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for file in batch["path"]:
                store, at = store_of(file)
                with store.open_input_stream(at, compression=None) as f, tarfile.open(fileobj=f, mode="r|gz") as t:  # a stream, a member at a time
                    for m in t:
                        if m.isfile() and m.name.endswith("/state.json") and safe_member(m.name):
                            pages = json.load(t.extractfile(m)).get("pages", [])
                            found.append((file, m.name, len(pages), sum(int(p.get("returned", 0)) for p in pages)))
            yield pd.DataFrame(found, columns=["file", "member", "pages", "returned"])

    return spark.read.format("binaryFile").load(path).select("path").mapInPandas(rows, "file string, member string, pages long, returned long")


def read_eml(spark: SparkSession, path: str) -> DataFrame:
    """Dataset descriptions: file, title, doi (the alternate identifier that begins with 10.), licence, citation."""
    text = F.col("value")
    at = lambda p: F.nullif(F.trim(F.xpath_string(text, F.lit(p))), F.lit(""))
    ids = F.xpath(text, F.lit("//dataset/alternateIdentifier/text()"))
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("file"), at("//dataset/title").alias("title"), F.get(F.filter(ids, lambda i: i.startswith("10.")), 0).alias("doi"),
        at("//dataset/intellectualRights//ulink/@url").alias("licence"), at("//additionalMetadata//citation").alias("citation"),
    )


def read_pairs(spark: SparkSession, path: str, key: str = "Dataset:", value: str = "Rights as supplied:") -> DataFrame:
    """Line pairs of text files as name, value; a value belongs to the last key line above it. Repeated names are an error."""
    line = F.posexplode(F.split("value", "\r?\n")).alias("n", "line")
    from pyspark.sql.window import Window

    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), line)
    named = lines.withColumn("name", F.last(F.when(F.col("line").startswith(key), F.trim(F.substring("line", F.lit(len(key) + 1), F.length("line")))), ignorenulls=True).over(Window.partitionBy("file").orderBy("n")))
    pairs = named.where(F.col("line").startswith(value)).select("name", F.trim(F.substring("line", F.lit(len(value) + 1), F.length("line"))).alias("value"))
    checked = pairs.groupBy("name").agg(F.count("*").alias("n"), F.min("value").alias("value"))
    return checked.select("name", F.when(F.col("n") == 1, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("repeated name "), "name"))).alias("value"))


def read_checked(spark: SparkSession, path: str, columns: list[str], rows: int) -> DataFrame:
    """A column-pruned Parquet scan; another number of rows than the manifest's is an error."""
    df = spark.read.parquet(path)
    found = df.count()
    if found != rows:
        raise ValueError(f"{path} has {found} rows; the manifest says {rows}")
    return df.select(*columns)


def verify_artifacts(spark: SparkSession, path: str, registry: DataFrame) -> DataFrame:
    """Files against a registry (name, sha256): name, state verified, changed, unlisted or missing."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    state = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("found") == F.col("sha256"), "verified").otherwise("changed")
    return files.join(registry.select("name", "sha256"), "name", "full").select("name", state.alias("state"))


def receipt_field(html: str, label: str):
    """The text after a label in a receipt page, tags removed."""
    raw = F.regexp_extract(html, rf"(?is){label}\s*:?\s*(?:</[^>]+>\s*)*(?:<[^>]+>\s*)*([^<]+)", 1)
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, "&lt;", "<"), "&gt;", ">"), "&quot;", '"'), "&amp;", "&")
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def inspect(rows: DataFrame, categories: list[str]) -> DataFrame:
    """Counts of each value of each category column in one pass, nulls included: column, value, n."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in categories]))
    return rows.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))
