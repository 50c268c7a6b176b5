"""Sinks: CSV, JSON lines, parquet by entity, and small documents from the driver."""

from __future__ import annotations

import json
import os
import re
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines files."""
    df.write.mode("overwrite").json(path)


def write_by_entity(df: DataFrame, path: str, key: str, kind: str = "parquet") -> None:
    """Files of ``kind`` (parquet, csv or json) in a folder for each value of ``key``; rows of one value are brought together first. For few values only."""
    writer = df.repartition(key).write.mode("overwrite").partitionBy(key)
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(path)


def write_entities(tables: dict[str, DataFrame], labels: DataFrame, path: str, key: str) -> None:
    """Each of ``tables`` (demo, dynamic, static) as CSV by entity in a folder of its name, and the labels beside them. For few entities only."""
    for name, df in tables.items():
        write_by_entity(df, f"{path}/{name}", key, "csv")
    write_csv(labels, f"{path}/labels")


def write_bundle(tables: dict[str, DataFrame], path: str, about: dict | None = None) -> None:
    """Tables, also those with vectors or nested rows, as parquet by name, and a manifest of names, columns and what is told ``about`` them."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    manifest = {"tables": {n: df.schema.jsonValue() for n, df in tables.items()}, "about": about or {}}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_manifest")


def read_bundle(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """The tables of a bundle and what was told about them."""
    manifest = json.loads(spark.read.text(f"{path}/_manifest", wholetext=True).first()[0])
    return {n: spark.read.parquet(f"{path}/{n}") for n in manifest["tables"]}, manifest["about"]


def write_lines(df: DataFrame, path: str, order: str, line: str = "line") -> None:
    """The texts of ``line`` in order, as text files that follow each other by name; null lines are left out."""
    df.where(F.col(line).isNotNull()).repartitionByRange(order).sortWithinPartitions(order).select(line).write.mode("overwrite").text(path)


def archive(paths: list[str], root: str, target: str, move: bool = False) -> dict:
    """Copy local files below ``root`` to ``target`` with their relative paths; existing ones are skipped. Gives the manifest.

    With ``move`` the sources are removed once all copies are there.
    """
    kept, skipped = [], []
    for p in paths:
        rel = os.path.relpath(p, root)
        to = os.path.join(target, rel)
        if os.path.exists(to):
            skipped.append(rel)
            continue
        os.makedirs(os.path.dirname(to), exist_ok=True)
        shutil.copy2(p, to)
        kept.append(rel)
    if move:
        for rel in kept:
            os.remove(os.path.join(root, rel))
    manifest = {"mode": "move" if move else "copy", "archived": kept, "skipped": skipped}
    os.makedirs(target, exist_ok=True)
    with open(os.path.join(target, "manifest.json"), "w", encoding="utf-8") as f:
        json.dump(manifest, f, indent=1)
    return manifest


def append_rows(df: DataFrame, path: str) -> None:
    """Rows added to a JSON lines folder, as ``foreachBatch`` needs."""
    df.write.mode("append").json(path)


def write_document(df: DataFrame, path: str, most: int = 10_000) -> None:
    """A small result, of ``most`` rows at most, as one JSON document."""
    rows = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write them as JSON lines")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rows, f, ensure_ascii=False, default=str, indent=1)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small result, of ``most`` rows at most, as a Markdown table; a ValueError if there are more.

    Bars and line ends within a value are escaped, so that it stays in its cell; null is an empty cell.
    """
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write them as CSV")

    def cell(v: object) -> str:
        return "" if v is None else str(v).replace("|", "\\|").replace("\n", "<br>")

    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def report(title: str, parts: dict[str, DataFrame | str]) -> str:
    """A Markdown document of headed parts, each a text or a small table."""
    out = [f"# {title}"]
    for head, part in parts.items():
        out += [f"## {head}", part if isinstance(part, str) else markdown(part)]
    return "\n\n".join(out) + "\n"


def fenced(text: str, language: str = "") -> str:
    """``text`` as a block of code whose fence is longer than any run of backticks within it."""
    runs = re.findall("`+", text)
    fence = "`" * max(3, *(len(r) + 1 for r in runs)) if runs else "```"
    return f"{fence}{language}\n{text}\n{fence}"
