"""Tables: a catalogue over a folder, and sources and sinks of other formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.schema import RESULTS


class Catalogue:
    """Parquet tables in one folder, reached through the file system that Spark uses."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def list(self) -> list[str]:
        if not self._fs.exists(self._path(self.root)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if s.isDirectory())

    def exists(self, name: str) -> bool:
        return name in self.list()

    def open(self, name: str) -> DataFrame:
        if not self.exists(name):
            raise FileNotFoundError(f"no table {name!r}; there are: {', '.join(self.list()) or 'none'}")
        return self.spark.read.parquet(f"{self.root}/{name}")

    def create(self, name: str, df: DataFrame, mode: str = "errorifexists", rows_per_file: int | None = None) -> None:
        """Writes a table; ``mode`` is errorifexists, overwrite, append or ignore."""
        writer = df.write.mode(mode)
        if rows_per_file:
            writer = writer.option("maxRecordsPerFile", rows_per_file)
        writer.parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def count(self, name: str) -> int:
        return self.open(name).count()

    def head(self, name: str, n: int, order: list[str]) -> DataFrame:
        return self.open(name).orderBy(*order).limit(n)

    def compact(self, name: str, files: int, order: list[str]) -> None:
        """Rewrites a table in order into ``files`` files, beside it first and then in its place."""
        fresh = f"{name}__compact"
        self.create(fresh, self.open(name).repartitionByRange(files, *order).sortWithinPartitions(*order), "overwrite")
        self.drop(name)
        self._fs.rename(self._path(f"{self.root}/{fresh}"), self._path(f"{self.root}/{name}"))

    def storage(self, name: str) -> tuple[int, int, float]:
        """Rows, bytes and bytes a row."""
        size = self._fs.getContentSummary(self._path(f"{self.root}/{name}")).getLength()
        n = self.count(name)
        return n, size, size / n if n else 0.0


def read_json_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON array, or JSON objects over several lines."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_json_map(spark: SparkSession, path: str, key: str, value: str, kind: str = "int") -> DataFrame:
    """A JSON object of key to value, as rows."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{kind}>")).alias(key, value))


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").csv(path, header=True)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=RESULTS)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def with_authors(documents: DataFrame, authors: DataFrame) -> DataFrame:
    """Documents with their author's name and department; unknown authors leave them null."""
    who = authors.select(F.col("id").alias("author_id"), F.col("name").alias("author_name"), F.col("department").alias("author_department"))
    return documents.join(who, "author_id", "left")


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    """A copy in a relational database, written by each task; the driver's jar must be on the class path."""
    df.write.mode(mode).format("jdbc").options(url=url, dbtable=table, **options).save()
