"""Reading files of the data set: CSV with its discovery, JSON, lists, pages, and tables over JDBC."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _paths(spark: SparkSession, pattern: str) -> list[str]:
    """Files that fit a glob pattern, in order, through Hadoop's file system, so that any store works."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(str(s.getPath()) for s in found) if found else []


def _paths_below(spark: SparkSession, folder: str) -> list[str]:
    """All files below a folder, in order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, files = [], system.listFiles(path, True) if system.exists(path) else None
    while files is not None and files.hasNext():
        found.append(str(files.next().getPath()))
    return sorted(found)


def find_file(spark: SparkSession, folder: str, name: str, by_prefix: bool = False, below: bool = False) -> str | None:
    """The path of name.csv.gz, else name.csv, else with ``by_prefix`` of the first file whose name starts so, else None.

    With ``below`` the folders in ``folder`` are searched as well, those nearer to it first.
    """
    for pattern in (f"{name}.csv.gz", f"{name}.csv", *([f"{name}*"] if by_prefix else [])):
        if found := _paths(spark, f"{folder}/{pattern}"):
            return found[0]
    if below:
        every = sorted(_paths_below(spark, folder), key=lambda p: (p.count("/"), p))
        for fits in (lambda f: f == f"{name}.csv.gz", lambda f: f == f"{name}.csv", lambda f: by_prefix and f.startswith(name)):
            if found := [p for p in every if fits(p.rsplit("/", 1)[-1])]:
                return found[0]
    return None


def read_csv(spark: SparkSession, path: str, charset: str = "UTF-8") -> DataFrame:
    """A CSV file with a header, every column a string; quoted fields may hold line breaks and doubled quotes.

    An empty field comes as an empty string, as the reports expect. Bytes that don't fit the charset are replaced.
    """
    df = spark.read.options(header=True, multiLine=True, quote='"', escape='"', encoding=charset, inferSchema=False).csv(path)
    return df.select([F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def load_table(spark: SparkSession, folder: str, name: str, columns: dict[str, Callable[[Column], Column] | None], cohort: DataFrame | None = None, key: str | None = None, required: bool = True) -> DataFrame | None:
    """A table's CSV with the named columns coerced, for the cohort's patients only, the first row of each ``key`` in file order.

    Without a function a column stays a string. A missing file raises if ``required`` and otherwise gives None; a missing column is null.
    """
    path = find_file(spark, folder, name)
    if path is None:
        if required:
            raise FileNotFoundError(f"no {name}.csv or {name}.csv.gz in {folder}")
        return None
    raw = read_csv(spark, path).withColumn("_at", F.monotonically_increasing_id())
    value = lambda c, f: (f(F.col(c)) if f else F.col(c)) if c in raw.columns else F.lit(None).cast("string")
    rows = raw.select("_at", *[value(c, f).alias(c) for c, f in columns.items()])
    if cohort is not None:
        rows = rows.join(cohort.select("subject_id").distinct(), "subject_id", "left_semi")
    if key:
        w = Window.partitionBy(key).orderBy("_at")
        rows = rows.where(F.col(key).isNotNull()).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return rows.drop("_at")


def load_dictionary(spark: SparkSession, folder: str, name: str = "d_labitems", columns: tuple[str, ...] = ("itemid", "label", "fluid", "category")) -> DataFrame:
    """The item dictionary, in ``folder`` or below: header in any letter case, known columns only, missing ones null, rows without itemid left out."""
    path = find_file(spark, folder, name, by_prefix=True, below=True)
    if path is None:
        raise FileNotFoundError(f"no {name} in {folder}")
    df = read_csv(spark, path)
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    out = df.select([(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in columns])
    return out.withColumn("itemid", F.col("itemid").try_cast("int")).where("itemid IS NOT NULL")


def load_notes(spark: SparkSession, folder: str, kinds: tuple[str, ...] = ("discharge", "radiology"), limit_per_kind: int | None = None) -> DataFrame:
    """Notes of several kinds, one file each, with kind as note_type; a limit takes so many of each by note_id."""
    parts = []
    for kind in kinds:
        path = find_file(spark, folder, kind, by_prefix=True)
        if path is None:
            continue
        df = read_csv(spark, path).select("note_id", "subject_id", "hadm_id", "charttime", "storetime", "text").withColumn("note_type", F.lit(kind))
        parts.append(df.orderBy("note_id").limit(limit_per_kind) if limit_per_kind else df)
    if not parts:
        raise FileNotFoundError(f"no notes in {folder}")
    return reduce(DataFrame.unionByName, parts)


def data_status(spark: SparkSession, folder: str, names: tuple[str, ...]) -> DataFrame:
    """(name, found, path) of the expected files."""
    rows = [(n, (p := find_file(spark, folder, n)) is not None, p) for n in names]
    return spark.createDataFrame(rows, "name string, found boolean, path string")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One JSON object a line; give a schema for large files."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, category, configs): the queries of a pooled run file, a single JSON document."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("queries").alias("q")).select("q.*")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id): the lines that are whole numbers."""
    return spark.read.text(path).where(F.trim("value").rlike("^[0-9]+$")).select(F.trim("value").cast("bigint").alias("id"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(question): the lines that aren't blank."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("question"))


def read_jdbc_ids(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """The distinct ids that a query gives over JDBC."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load().distinct()


def read_pages(spark: SparkSession, folder: str, done: DataFrame | None = None, pattern: str = "*.html") -> DataFrame:
    """(source_file, page, text): documents of a folder as pages of plain text, those named in ``done`` left out.

    A page break is a form feed; blank pages are skipped and pages count from 1. The name is cut to 60 characters. Other formats,
    such as PDF, take a binary reader with their library in place of the tag stripping here.
    """
    raw = spark.read.text(f"{folder}/{pattern}", wholetext=True).select(F.substring(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)\.[^./]+$", 1), 1, 60).alias("source_file"), F.col("value").alias("html"))
    if done is not None:
        raw = raw.join(done.select("source_file"), "source_file", "left_anti")
    plain = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"(?s)<[^>]+>", " ")
    pages = raw.select("source_file", F.posexplode(F.split(plain, "\f")).alias("i", "text"))
    return pages.where(F.trim("text") != "").select("source_file", (F.col("i") + 1).alias("page"), F.trim("text").alias("text"))
