"""Any DataFrame, strings of equal length, sequence files and CSV files as cells; data sets and partitions on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partita.operators.encode import SEQUENCE_LETTERS, Dataset, clean, require_valid


def from_table(df: DataFrame, id_col: str, cols: list[str], miss: tuple[str, ...] = ()) -> DataFrame:
    """Cells of the columns ``cols``, which become sites 1, 2, ...: one row for each unit and column."""
    values = F.array(*[F.col(c).cast("string") for c in cols])
    long = df.select(F.col(id_col).cast("long").alias("unit_id"), F.posexplode(values).alias("at", "raw"))
    return long.select("unit_id", (F.col("at") + 1).alias("pos"), clean(F.col("raw"), miss).alias("value"))


def from_strings(df: DataFrame, id_col: str, text_col: str, length: int | None = None, pad: str = "-", miss: tuple[str, ...] = ()) -> DataFrame:
    """Cells of a column of strings, a site for each character; with ``length`` they are cut or padded to it."""
    text = F.col(text_col) if length is None else F.rpad(F.substring(F.col(text_col), 1, length), length, pad)
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    long = df.select(F.col(id_col).cast("long").alias("unit_id"), F.posexplode(letters).alias("at", "raw"))
    return long.select("unit_id", (F.col("at") + 1).alias("pos"), clean(F.col("raw"), miss).alias("value"))


def _numbered(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of files numbered from 1 in the order of the files: by file, block, then place within the read."""
    placed = lines.withColumn("at", F.monotonically_increasing_id())
    parts = placed.select(F.spark_partition_id().alias("part"), "file", "block", "at").groupBy("part", "file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    # A row for each block of a file: the only global order is over those.
    before = Window.orderBy("file", "block", "first").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", "file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("part", "file", "block").orderBy("at")
    ranked = placed.withColumn("part", F.spark_partition_id()).withColumn("rank", F.row_number().over(within))
    return ranked.join(starts, ["part", "file", "block"]).select((F.col("before") + F.col("rank")).cast("long").alias("unit_id"), *columns)


def _placed() -> list[Column]:
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]


def read_fasta(spark: SparkSession, path: str, miss: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Cells and units (unit_id, uid) of a sequence file: ``>`` opens an id line, the lines after it are its sequence.

    Lines are trimmed and lower-cased, blank ones skipped. The first line that is not blank must be an id; sequences
    of another length than most, or with letters outside the alphabet, are errors that name the units.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", *_placed())
    # Ids may be indented: such records are still joined to the one before.
    records = raw.select("file", "block", F.explode(F.split("value", r"\r?\n[ \t]*>")).alias("record"))
    split = records.select("file", "block", F.split(F.col("record"), r"\r?\n", 2).alias("parts"))
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    trimmed = F.transform(F.split(F.coalesce(F.get("parts", F.lit(1)), F.lit("")), r"\r?\n"), bare)
    rows = split.select("file", "block", bare(F.get("parts", F.lit(0))).alias("head"), F.lower(F.array_join(trimmed, "")).alias("sequence"))
    first = spark.read.text(path).where(bare(F.col("value")) != "").limit(1).first()
    if first is None or not first.value.lstrip().startswith(">"):
        raise ValueError("the first line of a sequence file must be an id")
    rows = rows.where((F.col("head") != "") | (F.col("sequence") != ""))
    numbered = _numbered(rows, ["file", "head", "sequence"])
    cells = from_strings(numbered, "unit_id", "sequence", miss=miss)
    require_valid(cells, letters=SEQUENCE_LETTERS)
    # The separator takes the ``>`` of every id but a file's first.
    opening = numbered.groupBy("file").agg(F.min("unit_id").alias("unit_id")).select("unit_id", F.lit(True).alias("opens"))
    stripped = F.when(F.col("unit_id") == 1, F.lit(first.value.strip()[1:])).when(F.col("opens"), F.regexp_replace("head", "^>", "")).otherwise(F.col("head"))
    return cells, numbered.join(opening, "unit_id", "left").select("unit_id", bare(stripped).alias("uid"))


def read_csv(spark: SparkSession, path: str, header: bool = False, ids: bool = False, miss: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Cells and units of a CSV file: commas, double quotes, white space stripped; a ragged row is an error."""
    options = {"sep": ",", "quote": '"', "escape": '"', "header": header, "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True, "mode": "FAILFAST", "inferSchema": False}
    rows = spark.read.options(**options).csv(path)
    names = rows.columns
    plain = [f"c{k}" for k in range(len(names))]
    numbered = _numbered(rows.select(*[F.col(f"`{n}`").alias(p) for n, p in zip(names, plain, strict=True)], *_placed()), plain)
    uid = F.trim("c0") if ids else F.col("unit_id").cast("string")
    return from_table(numbered, "unit_id", plain[1:] if ids else plain, miss), numbered.select("unit_id", uid.alias("uid"))


def save_dataset(data: Dataset, path: str) -> None:
    """Parquet folders units, sites, attributes, ones."""
    for name in ("units", "sites", "attributes", "ones"):
        getattr(data, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load_dataset(spark: SparkSession, path: str) -> Dataset:
    return Dataset(*[spark.read.parquet(f"{path}/{name}") for name in ("units", "sites", "attributes", "ones")])


def read_partition(spark: SparkSession, path: str, units: int) -> DataFrame:
    """unit_id and label from the first column of a file without header: row i is unit i."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.trim(F.split("value", ",")[0]).alias("label"), *_placed())
    labels = _numbered(lines, ["label"])
    n = labels.count()
    if n != units:
        raise ValueError(f"the partition has {n} labels for {units} units")
    return labels.select("unit_id", F.col("label").cast("double").alias("label"))


def write_partition(partition: DataFrame, path: str) -> None:
    """One label a line, in the order of unit ids."""
    partition.orderBy("unit_id").select(F.col("cluster").cast("string")).write.mode("overwrite").text(path)
