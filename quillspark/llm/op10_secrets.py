"""Secret scans with an incremental ledger of blobs.

Every version of a file is addressed by the SHA-256 of its content. The ledger, a Parquet table in a shared
folder, has a row for each (blob, rule version) that was ever scanned, with its findings. A run

1. hashes the versions (JVM side) and keeps one text of each blob (a grouping with map-side combine, so a group of
   copies shrinks before the shuffle),
2. drops the blobs that the ledger has under this rule version, scans the rest and appends the rows to the ledger,
3. joins findings back to all paths of all versions by content address.

A run that dies before the append leaves the ledger as it was; a repeated append is harmless, as rows are read
distinct by (blob, rule version).

Rules: `assign` (a credential name given a value), `access` (AKIA keys), `hex` (long lower-case hex), all with
ASCII case rules; besides these base kinds the scan adds `pem` (private key headers), `jwt` (three-part web
tokens) and `url` (a password within a URL's authority).

Defined cases: a null text counts as empty; empty texts have no findings; repeated rows each get a row; rows with
null ids keep them; an empty table gives none.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, with_text_columns

RULE_VERSION = "1"
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "jwt", "url")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
SINGLE = {
    # a run from its first character on: as long as at least so many characters, else dropped whole
    "access": re.compile(r"AKIA[A-Z0-9]{16,}"),
    "hex": re.compile(r"[0-9a-f]{24,}"),
    "pem": re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "url": re.compile(r"(?<=://)[A-Za-z0-9._-]{1,64}:[^\s:@/]{3,128}@"),
}
#: a text without any of these has no finding of the kind; plain substring tests are far faster than the patterns
NEEDS = {"access": "AKIA", "pem": "PRIVATE KEY-----", "jwt": "eyJ", "url": "://"}
FINDING = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
LEDGER = T.StructType([T.StructField("blob", T.StringType()), T.StructField("rule_version", T.StringType()), T.StructField("findings", FINDING)])


def find(text: str | None) -> list[dict]:
    """All findings of a text by start, then kind as listed; places are code points, the end exclusive."""
    if not text:
        return []
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if ":" in text or "=" in text else []
    for kind, pattern in SINGLE.items():
        if NEEDS.get(kind, "") in text:
            found += [(m.start(), KINDS.index(kind), m.end()) for m in pattern.finditer(text)]
    return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(found)]


def address(text: F.Column) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def read_ledger(spark, path: str) -> DataFrame:
    """The ledger's rows, one for each (blob, rule version); none if it isn't there yet."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def update_ledger(versions: DataFrame, path: str, text_col: str = "text", rule_version: str = RULE_VERSION) -> None:
    """Scans the blobs of these versions that the ledger at `path` lacks under this rule version, and appends them."""
    spark = versions.sparkSession
    known = read_ledger(spark, path).filter(F.col("rule_version") == rule_version).select("blob")
    blobs = versions.select(address(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # copies combine before the shuffle, and the ledger meets the blobs on the same partitioning
    unseen = blobs.groupBy("blob").agg(F.first("text").alias("text")).join(known, "blob", "left_anti")
    scanned = with_text_columns(unseen, "text", [T.StructField("findings", FINDING)], lambda: lambda texts: {"findings": [find(t) for t in texts]})
    scanned.select("blob", F.lit(rule_version).alias("rule_version"), "findings").write.mode("append").parquet(path)


def scan_versions(versions: DataFrame, ledger: str | None = None, text_col: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """All rows of `versions` with `blob` and `findings` added; the ledger is brought up to date first."""
    path = ledger or scratch(versions.sparkSession, "secret-ledger")
    update_ledger(versions, path, text_col, rule_version)
    found = read_ledger(versions.sparkSession, path).filter((F.col("rule_version") == rule_version) & (F.size("findings") > 0))
    found = found.select("blob", "findings").dropDuplicates(["blob"])
    kept = versions.drop("blob", "findings") if {"blob", "findings"} & set(versions.columns) - {text_col} else versions
    return kept.withColumn("blob", address(F.col(text_col))).join(found, "blob", "left").withColumn("findings", F.coalesce("findings", F.array().cast(FINDING)))


def spans_text(findings: F.Column) -> F.Column:
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
