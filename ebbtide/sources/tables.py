"""Read customer tables and bring any header spelling, column order or missing column to the declared schema."""

from __future__ import annotations

import csv
import re
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.session import cut_lineage
from ebbtide.sources.schema import (
    COLUMN_TYPES,
    ID,
    LABEL,
    NULL_TOKENS,
    OPTIONAL,
    REQUIRED,
    SchemaError,
    customer_schema,
)


#: Files whose first line is read at the same time.
OPEN_FILES = 16


def normalise_headers(df: DataFrame) -> DataFrame:
    """Trim, lower-case, and turn runs of blanks into one underscore."""
    names = [re.sub(r"\s+", "_", name.strip().lower()) for name in df.columns]
    clashes = sorted({name for name in names if names.count(name) > 1})
    if clashes:
        raise SchemaError(f"headers that normalise to the same name: {clashes}")
    return df.toDF(*names)


def require_columns(df: DataFrame, names=REQUIRED) -> DataFrame:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise SchemaError(f"missing {len(missing)} column(s): {missing}; present: {df.columns}")
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    """Leave NULL as the only mark of a missing number."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({name: F.nanvl(F.col(name), F.lit(None)) for name in floats}) if floats else df


def _typed(name: str, found: str) -> tuple[Column, Column]:
    """The value of a cell in the declared type, and whether the cell holds something that is no such value."""
    cell, wanted = F.col(name), COLUMN_TYPES[name]
    if found == "string":
        cell = F.when(~F.trim(cell).isin(*NULL_TOKENS), cell)
    elif found in ("double", "float"):
        cell = F.nanvl(cell, F.lit(None))
    if isinstance(wanted, T.StringType):
        return cell.cast("string"), F.lit(False)
    number = F.nanvl(cell.try_cast("double"), F.lit(None))
    if isinstance(wanted, T.IntegerType):
        number = F.when(number == F.rint(number), number).try_cast("int")
    return number, cell.isNotNull() & number.isNull()


def conform(df: DataFrame, with_label: bool = True, malformed: str = "error") -> DataFrame:
    """Normalised headers, declared types, absent optional columns as typed NULLs, other columns kept.

    ``malformed`` tells what to do with text in a number column: ``error`` fails the job,
    ``collect`` lists the column names of each row in ``malformed_columns`` for the rejects table.
    """
    df = require_columns(normalise_headers(df))
    if with_label:
        require_columns(df, (LABEL,))
    present = dict(df.dtypes)
    values, flags = {}, []
    for name, wanted in COLUMN_TYPES.items():
        if name == LABEL and not with_label:
            continue
        if name not in present:
            if name in OPTIONAL or name == ID:
                values[name] = F.lit(None).cast(wanted)
            continue
        values[name], bad = _typed(name, present[name])
        if present[name] != wanted.simpleString() and not isinstance(wanted, T.StringType):
            flags.append((name, bad))
    if flags and malformed == "collect":
        values["malformed_columns"] = F.array_compact(
            F.array(*[F.when(bad, F.lit(name)) for name, bad in flags])
        )
    elif flags:
        for name, bad in flags:
            message = F.concat(F.lit(f"not a value of column {name}: "), F.col(name).cast("string"))
            values[name] = F.when(bad, F.raise_error(message).cast(COLUMN_TYPES[name])).otherwise(values[name])
    extra = [F.col(f"`{name}`") for name in df.columns if name not in values and name != LABEL]
    return df.select(*[column.alias(name) for name, column in values.items()], *extra)


def read_customers(
    spark: SparkSession,
    path: str | list[str],
    fmt: str = "csv",
    with_label: bool = True,
    malformed: str = "error",
    row_ids: bool = False,
) -> DataFrame:
    """Labelled (training) or unlabelled (scoring) customers from CSV, Parquet, ORC or JSON.

    CSV columns are matched by header, file by file: files whose headers differ in order or spelling, or lack an optional
    column, go together by name. Nothing is inferred from the data. ``path`` may be a list of files. With ``row_ids`` each
    row carries its position in the files as ``source_row_id``, which scoring uses where an id is missing.
    """
    if fmt == "csv":
        frames = [normalise_headers(_marked(frame) if row_ids else frame) for frame in _by_header(spark, path)]
        found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        for frame in frames:
            require_columns(frame, (*REQUIRED, LABEL) if with_label else REQUIRED)
        return conform(_numbered(found, "source_row_id") if row_ids else found, with_label, malformed)
    reader = spark.read.schema(customer_schema(with_label)) if fmt == "json" else spark.read
    found = reader.format(fmt).load(path)
    return conform(with_row_numbers(found) if row_ids else found, with_label, malformed)


def _by_header(spark: SparkSession, path: str | list[str]) -> list[DataFrame]:
    """One frame of text columns per distinct header line of the files; one line per file reaches the driver."""
    files = defaultdict(list)
    for file, header in first_lines(spark, path).items():
        files[header.removesuffix("\r").removeprefix("\ufeff")].append(unquote(file))
    if not files:
        raise SchemaError(f"no header found in {path}")
    frames = []
    for header, group in sorted(files.items()):
        names = next(csv.reader([header]))
        schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
        whole = path if len(files) == 1 else sorted(group)
        frames.append(spark.read.option("header", True).schema(schema).csv(whole))
    return frames


def first_lines(spark: SparkSession, path: str | list[str]) -> dict[str, str]:
    """The first line of every file under a path that is not empty; of a file its first buffer is read, not more.

    The files are those Spark's own reader would take, opened through its file systems, packed ones included.
    """
    jvm, settings = spark.sparkContext._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(settings)

    def first(file: str) -> str | None:
        where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        stream = where.getFileSystem(settings).open(where)
        try:
            codec = codecs.getCodec(where)
            text = jvm.java.io.InputStreamReader(stream if codec is None else codec.createInputStream(stream), "UTF-8")
            return jvm.java.io.BufferedReader(text).readLine()
        finally:
            stream.close()

    files = spark.read.text(path).inputFiles()
    with ThreadPoolExecutor(OPEN_FILES) as pool:
        return {file: line for file, line in zip(files, pool.map(first, files), strict=True) if line is not None}


def customers_from_records(spark: SparkSession, records: list[dict], with_label: bool = False) -> DataFrame:
    """A short list of records as a table; a key left out or set to None is an unset value."""
    schema = customer_schema(with_label)
    doubles = {f.name for f in schema.fields if isinstance(f.dataType, T.DoubleType)}

    def value(record, name):
        raw = record.get(name)
        return float(raw) if raw is not None and name in doubles else raw

    rows = [tuple(value(record, name) for name in schema.names) for record in records]
    return nan_to_null(spark.createDataFrame(rows, schema))


def _marked(scan: DataFrame) -> DataFrame:
    """A file scan with the file, the block and a mark that grows inside the block."""
    try:
        return scan.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_mark"))
    except AnalysisException as error:
        raise SchemaError("rows can only be numbered in a plain file scan") from error


def _before(counts: DataFrame, *keys: str) -> DataFrame:
    """Rows before each file or block, in their order; the table has a row for each of them."""
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))


def _numbered(marked: DataFrame, name: str) -> DataFrame:
    """Zero-based positions in the order of (file, block, place in the block).

    The files are read once and the marked rows written; the count of each block comes from that copy. Spark reads a
    block's rows in order and in one task, so the marks of a block are consecutive.
    """
    written = cut_lineage(marked)
    blocks = written.groupBy("_file", "_block").agg(F.count("*").alias("_rows"), F.min("_mark").alias("_first"))
    starts = _before(blocks, "_file", "_block").drop("_rows")
    placed = written.join(starts, ["_file", "_block"])
    return placed.withColumn(name, F.col("_before") + F.col("_mark") - F.col("_first")).drop("_file", "_block", "_mark", "_first", "_before")


def with_row_numbers(df: DataFrame, name: str = "source_row_id") -> DataFrame:
    """Zero-based position of each row of a file scan, in the order of file name and place; other inputs are refused.

    Parquet knows the place of a row in its file, so the data are scanned once, and the rows of a file are counted from the
    files' footers. Other formats go by blocks.
    """
    try:
        placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    except AnalysisException:
        return _numbered(_marked(df), name)
    counts = df.groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.count("*").alias("_rows")).collect()
    starts = _before(df.sparkSession.createDataFrame(counts, "_file string, _rows long"), "_file").drop("_rows")
    return placed.join(starts, "_file").withColumn(name, F.col("_before") + F.col("_place")).drop("_file", "_place", "_before")


def fill_ids(df: DataFrame, row_id: str = "source_row_id") -> DataFrame:
    """An empty or missing customer id becomes the row number, as text; without row numbers it becomes NULL."""
    if row_id not in df.columns or ID not in df.columns:
        return df.withColumn(ID, F.nullif(F.col(ID), F.lit("")) if ID in df.columns else F.lit(None).cast("string"))
    return df.withColumn(ID, F.coalesce(F.nullif(F.col(ID), F.lit("")), F.col(row_id).cast("string")))
