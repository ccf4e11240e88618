"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every historical version of every path is addressed by the SHA-256 of its
text. Only pairs of blob and rule version that the ledger lacks are scanned,
each blob once however many paths hold it, and findings are joined back to all
paths. A changed rule gets a new version and scans again alone.

Edge cases: a null text counts as empty; an empty text has no findings; texts
are scanned whole; repeated versions and ties share a blob and so its
findings; an empty table gives an empty result and no ledger rows; a null in
any path column is kept as a value; other columns of the input pass through,
but for the operator's own names (blob, found).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, sized_join, stored
from .spans import SPAN, matches, ordered, replaced

LEDGER = f"blob string, rule string, version int, found array<{SPAN}>"


@dataclass(frozen=True)
class Rule:
    """A pattern with a version: change the pattern, raise the version.

    With ``least``, a match counts where group 1 has that many characters; one
    that fails is not searched again from inside.
    """

    name: str
    version: int
    pattern: str
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"

    def found(self, text: Column, rank: int) -> Column:
        enough = (lambda m: F.length(F.regexp_extract(m, self.pattern, 1)) >= self.least) if self.least else None
        return matches(text, self.pattern, self.name, rank, enough)


#: The patterns of the base findings and of widely used credentials, with fixed lengths in them.
RULES = (
    Rule("assign", 1, r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)""", 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}+"),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{24,}+"),
    Rule("pem", 1, r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("chat", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}+"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"),
)
BASE = ("assign", "access", "hex")


def addressed(versions: DataFrame) -> DataFrame:
    """``versions`` with the content address of each text."""
    return versions.withColumn("text", F.coalesce(F.col("text"), F.lit(""))).withColumn("blob", F.sha2("text", 256))


def scan_blobs(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows: one for each unseen pair of blob and rule version."""
    blobs = addressed(versions).select("blob", "text").dropDuplicates(["blob"])
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", F.col("version").cast("string"))).alias("seen"))
        blobs = blobs.join(seen, "blob", "left")
    else:
        blobs = blobs.withColumn("seen", F.lit(None).cast("array<string>"))
    unseen = [~F.coalesce(F.array_contains("seen", r.key), F.lit(False)) for r in rules]
    work = [
        F.when(new, F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), r.found(F.col("text"), k).alias("found")))
        for k, (r, new) in enumerate(zip(rules, unseen, strict=True))
    ]
    done = blobs.select("blob", F.array_compact(F.array(*work)).alias("done"))
    return done.select("blob", F.inline("done"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """``versions`` with ``found`` (all spans of current rules) and the ledger rows that are new.

    The new rows are written to the shared folder; append them to the ledger.
    Rows without findings are ledger rows too, as they say what was scanned.
    """
    prepare(versions.sparkSession)
    fresh = stored(scan_blobs(versions, ledger, rules))
    known = fresh if ledger is None else fresh.unionByName(ledger.join(F.broadcast(_current(versions, rules)), ["rule", "version"], "left_semi"))
    spans = known.where(F.size("found") > 0).groupBy("blob").agg(ordered(F.flatten(F.collect_list("found"))).alias("found"))
    spans = stored(spans)  # few blobs have findings; their size decides how they are joined
    named = addressed(versions.drop("found"))
    out = sized_join(named, spans, "blob", [f"`{c}`" for c in named.columns if c not in ("text", "blob")] or ["blob"])
    return out.withColumn("found", F.coalesce("found", F.array().cast(f"array<{SPAN}>"))), fresh


def scan_with(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``versions`` with ``found``, by way of the ledger table at ``path``.

    The table is made where it is missing; pairs of blob and rule version that
    it holds are not scanned again, and new pairs are appended to it.
    """
    spark = versions.sparkSession
    prepare(spark)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    out, fresh = scan(versions, stored(spark.read.schema(LEDGER).parquet(path)) if there else None, rules)
    fresh.write.mode("append").parquet(path)
    return out


def _current(versions: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    return versions.sparkSession.createDataFrame([(r.name, r.version) for r in rules], "rule string, version int")


def base_of(found: Column) -> Column:
    return F.filter(found, lambda s: s["kind"].isin(*BASE))


def redacted(text: Column, found: Column) -> Column:
    """The text with every finding replaced by its kind in brackets."""
    return replaced(text, found, lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
