"""Sources and sinks for vectors, grids, compositions, targets and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from gridmeld.functions.expressions import nan_to_null
from gridmeld.sources.scratch import written

COMPOSITION = "Pixel_Index int, Ru double, Rh double, Pd double, Ir double, Pt double"


def _items(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What stands between the commas of each file, as a written table (file, block, at, item) and
    its blocks (file, block, first, n, before): a file is read by as many tasks as Spark splits it in.

    `at` rises by one from item to item of a block, the part of a file that one task has read, so an
    item's place in its file is its distance from the block's first item plus the items
    of the blocks before.
    """
    raw = spark.read.option("lineSep", ",").text(path)
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("item"))
    rows = written(rows)
    blocks = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    return rows, blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))


def _number(item: Column) -> tuple[Column, Column]:
    """An item without brackets and white space, and its number: null for null, NaN and what is none."""
    bare = F.regexp_replace(item, r"[\[\]\s]+", "")
    return bare, nan_to_null(bare.try_cast("double"))


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """(id, value) of files that hold one JSON list of numbers each, in which null and NaN are
    null; positions begin at 0 in each file. A list may be larger than a task."""
    rows, blocks = _items(spark, path)
    bare, value = _number(F.col("item"))
    at = rows.join(blocks, ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first")).alias("id"), bare.alias("bare"), value.alias("value"))
    return at.where((F.col("bare") != "") | (F.col("id") > 0)).select("id", "value")  # an empty list is one empty item


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """(y, x, value) of nested JSON lists of numbers, one in each file; absent cells have no
    row. A grid may be larger than a task: rows are told by their opening brackets,
    counted within the blocks of a file and then over them."""
    rows, blocks = _items(spark, path)
    opened = F.length(F.regexp_replace("item", r"[^\[]", ""))
    rows = rows.join(blocks.select("file", "block", "first", "before"), ["file", "block"]).select("file", "block", (F.col("before") + F.col("at") - F.col("first")).alias("i"), "item", opened.alias("o"))
    ends = rows.groupBy("file", "block").agg(F.sum("o").alias("n"), F.max(F.when(F.col("o") > 0, F.col("i"))).alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.last("last", ignorenulls=True).over(before).alias("last0"))
    within = Window.partitionBy("file", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    y = F.col("n0") + F.sum("o").over(within) - 2  # the outer bracket is no row
    x = F.col("i") - F.coalesce(F.last(F.when(F.col("o") > 0, F.col("i")), ignorenulls=True).over(within), F.col("last0"))
    cells = rows.join(ends, ["file", "block"]).select(y.cast("int").alias("y"), x.cast("int").alias("x"), _number(F.col("item"))[1].alias("value"))
    return cells.where("value is not null")


def read_composition(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=COMPOSITION)


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """A headerless id, target list."""
    return spark.read.csv(path, schema="id string, target double")


def read_species_features(spark: SparkSession, path: str) -> DataFrame:
    """(species, features) of a JSON object from species number to a list of integers."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<int>>")).alias("species", "features"))
    return rows.select(F.col("species").cast("int"), F.col("features").cast("array<double>"))


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").csv(path, header=True)


def write_vectors(df: DataFrame, path: str, key: str, order: str = "id", value: str = "value") -> None:
    """A JSON list of the values in order of their positions (from 0, without gaps) for each key, null
    and NaN as null, as one file below path/key=.... A file has one writer, which
    sorts its rows with spilling and writes them one by one; keys are dealt to tasks.
    """
    sizes = df.groupBy(F.col(key).alias("__k")).agg((F.count("*") - 1).alias("__last"))
    item = F.coalesce(nan_to_null(F.col(value)).cast("string"), F.lit("null"))
    line = F.concat(F.when(F.col(order) == 0, "[").otherwise(","), item, F.when(F.col(order) == F.col("__last"), "]").otherwise(""))
    rows = df.join(sizes, F.col(key).eqNullSafe(F.col("__k"))).repartition(key).sortWithinPartitions(key, order)
    rows.select(key, line.alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def write_cells(df: DataFrame, path: str) -> None:
    """One JSON object per row, in parallel."""
    df.write.mode("overwrite").json(path)


def read_cells(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows that write_cells has written."""
    return spark.read.schema(schema).json(path)


def write_grid(df: DataFrame, path: str, value: str = "value") -> None:
    """One nested JSON list of a dense grid (y, x, value), absent cells as null; for grids
    whose size is a parameter. Others are for write_cells."""
    rows = df.groupBy("y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", value))), lambda s: s[value]).alias("row"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("y", "row"))), lambda s: s["row"])
    rows.agg(F.to_json(whole, {"ignoreNullFields": "false"}).alias("json")).write.mode("overwrite").text(path)


def write_species_features(df: DataFrame, path: str) -> None:
    """One JSON object from species number to feature list; a book of features is small."""
    book = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("species").cast("string"), F.col("features").cast("array<int>")))))
    df.agg(F.to_json(book).alias("json")).write.mode("overwrite").text(path)
