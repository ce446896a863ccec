"""Readers and writers for the record formats the jobs exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRANSACTION_SCHEMA = (
    "InvoiceNo string, StockCode string, Description string, Quantity bigint, "
    "InvoiceDate timestamp, UnitPrice decimal(12,4), CustomerID bigint, Country string"
)


def read_transactions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The raw table with a declared schema: codes stay text even when numeric."""
    reader = spark.read.schema(TRANSACTION_SCHEMA)
    return reader.csv(path, header=True) if fmt == "csv" else reader.parquet(path)


def read_summary(spark: SparkSession, path: str, schema: str, fmt: str = "csv") -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.csv(path, header=True) if fmt == "csv" else reader.parquet(path)


BOM = "\ufeff"


def numbered_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """(value, file, block, line_no): the lines of text files, read in splits.

    Rows of one block keep their order inside a task, so `id` orders a block's lines, and
    `line_no` counts from 1 in the file: blocks are offset by the line counts of those before.
    """
    lines = spark.read.text(path, **options).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
    )
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    return lines.join(blocks, ["file", "block"]).select(
        "value", "file", "block", (F.col("id") - F.col("first_id") + F.col("ahead") + 1).alias("line_no")
    )


def csv_records(spark: SparkSession, path: str, chunk: int = 1 << 16) -> DataFrame:
    """(file, line_no, record): the records of CSV files, cells with line breaks included, read in splits.

    A line break lies inside a cell where an odd number of quotes stands before it in the
    file (a quote in a cell is doubled). Each chunk of lines reports whether its quotes are odd,
    and where the last record begins in it for either state that it can start in. Put
    together in order these tell the true state at every chunk. A line that is a record by
    itself passes by; only the lines of records with breaks meet, by record. line_no is where
    the record begins; an open quote at the end of a file closes there.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = numbered_lines(spark, path, lineSep="\n").select(
        "file", "line_no", "value", (quotes % 2).alias("odd"), F.floor(F.col("line_no") / chunk).alias("chunk")
    )
    keys = ["file", "chunk"]
    inside = Window.partitionBy(*keys).orderBy("line_no")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = lines.withColumn("open", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    states = local.groupBy(*keys).agg(
        (F.sum("odd") % 2).alias("odd"),
        F.max(F.when(F.col("open") == 0, F.col("line_no"))).alias("start_0"),
        F.max(F.when(F.col("open") == 1, F.col("line_no"))).alias("start_1"),
    )
    earlier = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    states = states.withColumn("enters", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    own_start = F.when(F.col("enters") == 0, F.col("start_0")).otherwise(F.col("start_1"))
    states = states.select(*keys, "enters", F.last(own_start, ignorenulls=True).over(earlier).alias("start_before"))
    begins = (F.col("open") + F.col("enters")) % 2 == 0
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = local.join(states, keys).withColumns(
        {
            "alone": begins & (F.col("odd") == 0),
            "start": F.coalesce(F.last(F.when(begins, F.col("line_no")), ignorenulls=True).over(upto), "start_before"),
        }
    )
    whole = placed.filter("alone").select("file", "line_no", F.col("value").alias("record"))
    broken = placed.filter(~F.col("alone")).groupBy("file", F.col("start").alias("line_no")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"]), "\n").alias("record")
    )
    clean = F.regexp_replace("record", "\r$", "")
    return whole.unionByName(broken).select("file", "line_no", clean.alias("record")).filter("record <> ''")


def read_text_cells(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV files with a header, every cell a string; cells may hold line breaks and JSON.

    Each file's columns are found by the names in its header, in any order, a byte order mark
    ahead of them left out; a name that a header lacks is NULL. Large files are read in many tasks.
    """
    records = csv_records(spark, path)
    options = {"escape": '"', "multiLine": "true"}
    header = F.replace(F.col("record"), F.lit(BOM), F.lit(""))
    heads = records.filter("line_no = 1").select("file", header.alias("header"))
    # Commas outside of quotes are no fewer than the columns, so this many cells hold every row.
    width = heads.agg(F.max(F.size(F.split("header", ",")))).first()[0] or 1
    cells = ", ".join(f"c{i} string" for i in range(width))

    def parsed(c: str) -> Column:
        one = F.from_csv(c, cells, options)
        return F.array(*[one[f"c{i}"] for i in range(width)])

    named = heads.select("file", parsed("header").alias("names"))
    rows = records.filter("line_no > 1").select("file", parsed("record").alias("cells")).join(named, "file")
    at = lambda c: F.array_position("names", F.lit(c))
    return rows.select(*[F.when(at(c) > 0, F.get("cells", (at(c) - 1).cast("int"))).alias(c) for c in columns])


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def scan_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every line with its file, line number and whether it parses.

    Line numbers need no sort of the data; see `numbered_lines`.
    """
    lines = numbered_lines(spark, path).withColumnRenamed("value", "raw_line")
    parsed = F.from_json("raw_line", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return (
        lines.filter(F.trim("raw_line") != "")
        .withColumn("record", parsed)
        .withColumn("is_malformed", F.col("record").isNull() | F.col("record._bad").isNotNull())
        .select("file", "line_no", "raw_line", "record", "is_malformed")
    )


def sorted_map_json(c: Column) -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))), {"ignoreNullFields": "false"})


def nested_as_json(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs become JSON text; map keys are sorted."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.MapType):
            c = sorted_map_json(c)
        elif isinstance(field.dataType, (T.ArrayType, T.StructType)):
            c = F.to_json(c, {"ignoreNullFields": "false"})
        out.append(c.alias(field.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """A CSV with a fixed column list; a missing value is an empty cell."""
    present = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
    (
        nested_as_json(df.select(*present))
        .write.mode("overwrite")
        .csv(path, header=True, escape='"', quoteAll=True, emptyValue="", nullValue="")
    )


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines that keep null fields."""
    df.write.mode("overwrite").json(path, ignoreNullFields=False)
