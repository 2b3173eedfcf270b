"""Readers and writers of measurement files.  Schemas are given, not inferred; malformed fields become null."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridlore.functions.layout import linearised
from gridlore.functions.stats import finite


def without_nan(df: DataFrame) -> DataFrame:
    """Not-a-number, the files' null, as null."""
    return df.select(*(finite(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def csv(spark: SparkSession, path: str | list[str], schema: StructType | str, header: bool = True) -> DataFrame:
    """Columns by name and type; unreadable fields are null."""
    return without_nan(spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE").csv(path))


def csv_if_there(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """An empty table with the schema if nothing is there."""
    try:
        return csv(spark, path, schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def csv_folder(spark: SparkSession, path: str, schema: StructType | str, skip: str | None = None, valid: Column | None = None) -> DataFrame:
    """All files of a folder with their names as ``source``; merged files and failed runs are left out."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    df = df.select("*", F.col("_metadata.file_name").alias("source"))
    if skip:
        df = df.filter(F.col("source") != skip)
    return without_nan(df if valid is None else df.filter(valid))


def ragged(lines: DataFrame, shapes: dict[int, list[tuple[str, str]]], column: str = "value") -> DataFrame:
    """Headerless lines whose number of fields says what they are: ``shapes`` maps it to (name, type).  Columns are
    united; lines of another shape are dropped, fields that don't parse are null; ``fields`` keeps the shape."""
    cells = lines.select(F.split(column, ",").alias("c"))
    types = {n: t for shape in shapes.values() for n, t in shape}
    cols = []
    for name, kind in types.items():
        value = F.lit(None).cast(kind)
        for size, shape in shapes.items():
            at = [k for k, (n, _) in enumerate(shape) if n == name]
            if at:
                value = F.when(F.size("c") == size, F.trim(F.get("c", F.lit(at[0]))).try_cast(kind)).otherwise(value)
        cols.append(value.alias(name))
    return cells.filter(F.size("c").isin(*shapes)).select(F.size("c").alias("fields"), *cols)


def labelled_numbers(lines: DataFrame, labels: list[str], column: str = "value") -> DataFrame:
    """One column per label with the number after ``label:``, null where a line lacks it."""
    number = r"\s*(-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)"
    found = [F.regexp_extract(column, re.escape(k) + ":" + number, 1).try_cast("double").alias(k.lower()) for k in labels]
    return lines.select("*", *found)


def all_matches(lines: DataFrame, pattern: str, names: list[str], column: str = "value") -> DataFrame:
    """A row for each match with its groups as columns and its place in the line."""
    groups = F.arrays_zip(*(F.regexp_extract_all(column, F.lit(pattern), F.lit(k + 1)).alias(n) for k, n in enumerate(names)))
    rest = [c for c in lines.columns if c != column]
    rows = lines.select(*rest, F.posexplode(groups).alias("place", "m"))
    return rows.select(*rest, "place", *(F.col("m")[n].alias(n) for n in names))


def suffixed_number(text: Column) -> Column:
    """Numbers with K, M, G, T or % behind them; separators of thousands are dropped; null if it isn't one."""
    clean = F.regexp_replace(F.trim(text), "[, ]", "")
    value = F.regexp_extract(clean, r"^(-?[0-9]*\.?[0-9]+)([KMGT%]?)$", 1).try_cast("double")
    unit = F.regexp_extract(clean, r"^(-?[0-9]*\.?[0-9]+)([KMGT%]?)$", 2)
    scale = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "G", 1e9).when(unit == "T", 1e12).when(unit == "%", 0.01).otherwise(1.0)
    return value * scale


def after_preamble(lines: DataFrame, order: str, starts: str, column: str = "value") -> DataFrame:
    """Rows behind the first line that begins with ``starts``; ``order`` numbers the lines of a file."""
    first = lines.filter(F.col(column).startswith(starts)).agg(F.min(order).alias("_first"))
    return lines.join(F.broadcast(first), F.col(order) > F.col("_first")).drop("_first")  # first is one row


def permissive(text: Column) -> Column:
    """(whole, real, text): the first of the readings that fits."""
    whole, real = text.try_cast("long"), text.try_cast("double")
    return F.struct(whole.alias("whole"), F.when(whole.isNull(), real).alias("real"), F.when(whole.isNull() & real.isNull(), text).alias("text"))


def array_dumps(spark: SparkSession, path: str) -> DataFrame:
    """Files of ``# rank``, ``# size``, ``# lbound`` and ``# entries`` sections: name, rank, size, lbound, data.
    Data that fall short of the size are filled up with zeros."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_parse_dumps, "name string, rank int, size array<int>, lbound array<int>, data array<double>")


def patch(spark: SparkSession, path: str, name: str, neighbours: int, width: int) -> DataFrame:
    """(edge, k, target): zero-based neighbours from dumps of one-based indices and blocks of ``width``.

    Below ``path`` each array has a folder ``array=<name>_idx_<k>`` or ``array=<name>_blk_<k>`` for k from 1.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.col("array").alias("path"), "content")
    arrays = files.mapInPandas(_parse_dumps, "name string, rank int, size array<int>, lbound array<int>, data array<double>")
    kind = F.regexp_extract("name", f"^{re.escape(name)}_(idx|blk)_([0-9]+)$", 1)
    k = F.regexp_extract("name", f"^{re.escape(name)}_(idx|blk)_([0-9]+)$", 2).try_cast("int")
    cells = arrays.select(kind.alias("kind"), k.alias("k"), F.posexplode("data").alias("edge", "v")).filter(F.col("kind") != "")
    pairs = cells.filter(F.col("k") <= neighbours).groupBy("edge", "k").agg(*(F.max(F.when(F.col("kind") == x, F.col("v"))).cast("long").alias(x) for x in ("idx", "blk")))
    return pairs.select(F.col("edge").cast("long").alias("edge"), "k", linearised(F.col("idx"), F.col("blk"), width).cast("long").alias("target"))


def _parse_dumps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(p.rsplit("/", 1)[-1].rsplit(".", 1)[0], *parse_dump(bytes(c).decode())) for p, c in zip(b["path"], b["content"], strict=True)]
        yield pd.DataFrame(rows, columns=["name", "rank", "size", "lbound", "data"])


def parse_dump(text: str) -> tuple[int, list[int], list[int], list[float]]:
    parts: dict[str, list[str]] = {}
    at = ""
    for line in text.splitlines():
        if line.startswith("#"):
            at = line[1:].strip().lower()
            parts[at] = []
        elif at:
            parts[at].extend(line.split())
    size = [int(x) for x in parts.get("size", [])]
    data = [float(x.replace("D", "E").replace("d", "e")) for x in parts.get("entries", [])]
    total = 1
    for x in size:
        total *= x
    return int((parts.get("rank") or [len(size)])[0]), size, [int(x) for x in parts.get("lbound", [])], data + [0.0] * (total - len(data))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share (spark.checkpoint.dir); local where there is one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(shared or 'file://' + tempfile.gettempdir()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_csv(df: DataFrame, path: str, append: bool = False, digits: int | None = None) -> None:
    """Header and, if asked for, fixed decimals; each partition writes its own file."""
    cols = [F.format_string(f"%.{digits}f", c).alias(c) if digits is not None and t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("append" if append else "error").option("header", True).csv(path)


def rendered(df: DataFrame, style: str = "markdown", digits: int = 3, most: int = 1000) -> str:
    """A small table as Markdown, LaTeX or plain text; larger ones are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    show = lambda x: "" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)
    body = [[show(x) for x in r] for r in rows]
    if style == "latex":
        lines = [" & ".join(r) + r" \\" for r in [df.columns, *body]]
        return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", lines[0], r"\hline", *lines[1:], r"\end{tabular}"])
    if style == "markdown":
        return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *body])
    width = [max(len(r[k]) for r in [df.columns, *body]) for k in range(len(df.columns))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, width, strict=True)).rstrip() for r in [df.columns, *body])
