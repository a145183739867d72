"""Sinks (K1-K13): deterministic order, canonical text, archives, content addresses."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.text import canonical_json


def write_sorted(df: DataFrame, path: str, *keys: str, codec: str = "zstd", rows: int = 0) -> None:
    """Range-partitioned and sorted Parquet: files follow each other in key order (K1); rows limits a file (K6)."""
    out = df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.option("compression", codec)
    (out.option("maxRecordsPerFile", rows) if rows else out).parquet(path)


def write_jsonl(df: DataFrame, path: str, *keys: str) -> None:
    """Canonical JSON lines in key order (K2)."""
    line = canonical_json(**{c: F.col(c) for c in df.columns})
    df.orderBy(*keys).select(line.alias("value")).write.text(path)


def snapshot(cells: DataFrame, scopes: DataFrame, key: str) -> DataFrame:
    """One JSON document of small tables, rows in key order (K3)."""
    pack = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(key, *[c for c in df.columns if c != key]))).alias(name))
    return pack(cells, "cells").join(pack(scopes, "scopes")).select(F.to_json(F.struct("cells", "scopes")).alias("value"))


def content_path(digest: Column, root: str) -> Column:
    """sha256/aa/bb/digest below a root (K8)."""
    return F.concat_ws("/", F.lit(root), F.lit("sha256"), F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest)


def csv_line(*columns: Column) -> Column:
    """A line of quoted CSV; null is empty (K4)."""
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.concat_ws(",", *map(cell, columns))


def archive_bytes(members: dict[str, str]) -> bytes:
    """A ZIP with sorted members and fixed times: equal members give equal bytes (K4). For exports of a driver's size."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(members):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), members[name].encode())
    return out.getvalue()


def meta_xml(core: str, core_fields: list[str], extensions: dict[str, list[str]]) -> str:
    """The descriptor of an archive's tables; column 0 is the id (K4)."""
    fields = lambda names: "".join(f'<field index="{i}" term="{n}"/>' for i, n in enumerate(names) if i)
    part = lambda tag, name, names, key: f'<{tag} encoding="UTF-8" fieldsTerminatedBy="," fieldsEnclosedBy="&quot;" ignoreHeaderLines="1"><files><location>{name}</location></files><{key} index="0"/>{fields(names)}</{tag}>'
    return "<archive>" + part("core", core, core_fields, "id") + "".join(part("extension", n, f, "coreid") for n, f in sorted(extensions.items())) + "</archive>"


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of each table: name, rows, columns."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows", F.lit(",".join(df.columns)).alias("columns"))
        out = one if out is None else out.unionByName(one)
    return out
