"""Package references and configuration entries of source trees."""

from __future__ import annotations

import json
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import texts


def package_references(text: str) -> list[tuple[str, int]]:
    """(name, line) of every PackageReference and PackageVersion of a project file; none if it is malformed."""
    found: list[tuple[str, int]] = []
    parser = expat.ParserCreate()

    def start(tag: str, attributes: dict[str, str]) -> None:
        if tag.rpartition(":")[2].lower() in ("packagereference", "packageversion"):
            low = {k.lower(): v for k, v in attributes.items()}
            name = (low.get("include") or low.get("update") or "").strip()
            if name:
                found.append((name, parser.CurrentLineNumber))

    parser.StartElementHandler = start
    try:
        parser.Parse(text.encode("utf-8"), True)
    except expat.ExpatError:
        return []
    return found


def flattened(text: str) -> list[tuple[str, str]]:
    """(key path, value) of every leaf of a JSON document, array places as keys; none if it is invalid."""
    try:
        root = json.loads(text, parse_float=str, parse_int=str)
    except ValueError:
        return []
    out: list[tuple[str, str]] = []

    def walk(value: object, path: str) -> None:
        if isinstance(value, dict):
            for k, v in value.items():
                walk(v, f"{path}:{k}" if path else k)
        elif isinstance(value, list):
            for k, v in enumerate(value):
                walk(v, f"{path}:{k}" if path else str(k))
        elif path:
            out.append((path, "" if value is None else str(value)))

    walk(root, "")
    return out


def _per_file(files: DataFrame, parse, schema: str, names: list[str], kinds: list[pa.DataType]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, *row) for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()) for row in parse(text or "")]
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return files.select("path", "text").mapInArrow(run, schema)


def packages(files: DataFrame) -> DataFrame:
    """(file_path, name, line) of the project files among ``files`` (path, content)."""
    chosen = texts(files.where(F.lower("path").rlike(r"(^|/)([^/]*\.csproj|directory\.packages\.props)$")))
    return _per_file(chosen, package_references, "file_path string, name string, line int", ["file_path", "name", "line"], [pa.string(), pa.string(), pa.int32()])


def json_entries(files: DataFrame) -> DataFrame:
    """(file_path, key_path, value, line) of the ``appsettings*.json`` among ``files``."""
    chosen = texts(files.where(F.lower("path").rlike(r"(^|/)appsettings[^/]*\.json$")))
    rows = _per_file(chosen, flattened, "file_path string, key_path string, value string", ["file_path", "key_path", "value"], [pa.string()] * 3)
    return rows.withColumn("line", F.lit(None).cast("int"))


def env_lines(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with line, key_path and value of every ``K=V`` line of a text; built-in functions only."""
    lines = rows.select(*(c for c in rows.columns if c != text), F.posexplode(F.split(F.col(text), r"\r?\n")).alias("at", "raw"))
    lines = lines.withColumn("t", F.trim("raw")).withColumn("eq", F.instr("t", "=")).where((F.col("t") != "") & ~F.col("t").startswith("#") & (F.col("eq") > 1))
    kept = [c for c in rows.columns if c != text]
    return lines.select(*kept, F.trim(F.expr("substr(t, 1, eq - 1)")).alias("key_path"), F.trim(F.expr("substr(t, eq + 1)")).alias("value"), (F.col("at") + 1).alias("line"))


def env_entries(files: DataFrame) -> DataFrame:
    chosen = texts(files.where(F.lower("path").rlike(r"(^|/)\.env[^/]*$"))).withColumnRenamed("path", "file_path")
    return env_lines(chosen).select("file_path", "key_path", "value", "line")


def configuration(files: DataFrame) -> DataFrame:
    return json_entries(files).unionByName(env_entries(files))
