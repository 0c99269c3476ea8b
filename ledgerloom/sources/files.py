"""Text sources and sinks, imports with validation, checksums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: What stands for null in CSV that is written here; a text that is this mark itself would come back as null.
NULL = "\x01N\x01"
#: Values keep their space, quotes are doubled, a field left empty is null and a quoted empty one is the empty text.
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "nullValue": NULL}


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with header; columns are read as the schema says, never guessed. Gzip is told by the extension."""
    return spark.read.schema(schema).options(**CSV, multiLine=True, lineSep="\n").csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, tag: str | None = None) -> DataFrame:
    """One JSON object a line, blank lines skipped; with ``tag`` only the rows whose _table is that."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    if tag is not None:
        rows = rows.where(F.get_json_object("value", "$._table") == tag)
    return rows.select(F.from_json("value", schema if isinstance(schema, str) else schema.simpleString()).alias("r")).select("r.*")


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON document a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def front_matter(text: Column) -> tuple[Column, Column]:
    """(map of the front matter, body) of a Markdown text; of repeated keys the first counts, a text without has an empty map."""
    head = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---\n", 1)
    items = F.transform(F.filter(F.split(head, "\n"), lambda l: l.rlike(r"^[A-Za-z_]+:")), lambda l: F.struct(F.regexp_extract(l, r"^([A-Za-z_]+):", 1).alias("k"), F.trim(F.regexp_replace(l, r"^[A-Za-z_]+:", "")).alias("v")))
    fresh = F.filter(items, lambda x, i: ~F.array_contains(F.transform(F.slice(items, F.lit(1), i), lambda y: y["k"]), x["k"]))
    return F.map_from_entries(fresh), F.regexp_replace(text, r"(?s)^---\n.*?\n---\n", "")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modificationTime, front (map of the front matter), body: one row for each file, whatever its size."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(path)
    front, body = front_matter(F.decode("content", "UTF-8"))
    return raw.select("path", "length", "modificationTime", front.alias("front"), body.alias("body"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modificationTime of every file below a folder; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")


def write_rows(df: DataFrame, path: str, form: str = "json", compression: str = "none") -> None:
    """Write to a new folder; the committer makes the files appear at once, and an existing folder is refused."""
    df.write.mode("errorifexists").format(form).options(**(CSV if form == "csv" else {}), compression=compression).save(path)


def checked_import(rows: DataFrame, required: list[str], unique: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason): rows lacking a required value or repeating the key (the first by content counts)."""
    from pyspark.sql import Window

    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    place = F.row_number().over(Window.partitionBy(unique).orderBy(F.to_json(F.struct("*"))))
    reason = F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.concat_ws(",", missing))).when(place > 1, "repeated")
    out = rows.withColumn("reason", reason)
    return out.where("reason is null").drop("reason"), out.where("reason is not null")


def verify_manifest(listed: DataFrame, found: DataFrame) -> DataFrame:
    """path, state of (path, sha256) lists: missing, extra, changed; equal rows are left out."""
    f = found.select(F.col("path").alias("_p"), F.col("sha256").alias("_h"))
    state = F.when(F.col("_p").isNull(), "missing").when(F.col("path").isNull(), "extra").when(F.col("sha256") != F.col("_h"), "changed")
    return listed.join(f, F.col("path") == F.col("_p"), "full").select(F.coalesce("path", "_p").alias("path"), state.alias("state")).where("state is not null")


def _hashes(spark: SparkSession, path: str) -> DataFrame:
    """path (below the folder), sha256 of the files of a folder."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return rows.select(F.regexp_extract("path", "([^/]+)$", 1).alias("path"), F.sha2("content", 256).alias("sha256"))


def stage(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """(table, whether it was there): the output of a stage, built unless its files are all there with the hashes noted.

    The list of hashes is written after the files, so a stage that broke off is built again; so is one whose files were
    changed, removed or added to.
    """
    out, noted = f"{folder}/{name}", f"{folder}/{name}.hashes"
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(noted).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = lambda p: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p))
    if there(out) and there(f"{noted}/_SUCCESS"):
        listed = spark.read.schema("path string, sha256 string").parquet(noted)
        if verify_manifest(listed, _hashes(spark, out)).isEmpty():
            return spark.read.parquet(out), True
    fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(noted), True)
    build().write.mode("overwrite").parquet(out)
    _hashes(spark, out).write.mode("overwrite").parquet(noted)
    return spark.read.parquet(out), False
