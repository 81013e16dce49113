"""Sinks: line JSON, reports, content stores, signed bundles, resumable appends."""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def require_new(spark: SparkSession, path: str) -> str:
    if exists(spark, path):
        raise FileExistsError(path)
    return path


def write_jsonl(df: DataFrame, path: str, create_only: bool = False, sort_keys: bool = False) -> None:
    """Compact JSON per line with the columns in order (or sorted) and explicit nulls; the commit is a rename."""
    columns = sorted(df.columns) if sort_keys else df.columns
    lines = df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))
    lines.write.mode("errorifexists" if create_only else "overwrite").text(path)


def write_report(spark: SparkSession, path: str, report: dict, create_only: bool = False, sort_keys: bool = True) -> None:
    """One small JSON document, written beside its place and renamed."""
    fs, target = _fs(spark, path)
    if create_only and fs.exists(target):
        raise FileExistsError(path)
    hidden = f"{os.path.dirname(path)}/.{os.path.basename(path)}.{uuid.uuid4().hex}"
    _, temp = _fs(spark, hidden)
    out = fs.create(temp, True)
    out.write(bytearray(json.dumps(report, sort_keys=sort_keys, ensure_ascii=False, indent=1).encode()))
    out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(temp, target):
        raise OSError(f"could not place {path}")


def write_file(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(data))
    out.close()


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256) of the visible files below a directory, named relative to it."""
    fs, p = _fs(spark, path)
    root = fs.makeQualified(p).toUri().getPath().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    plain = F.regexp_replace("path", r"^[a-z0-9]+:/*(?=/)", "")
    name = F.substring(plain, F.lit(len(root) + 1), F.length(plain))
    return files.select(name.alias("name"), F.sha2("content", 256).alias("sha256")).filter("name <> 'completion.sha256'")


def sign(spark: SparkSession, path: str) -> str:
    """Writes ``completion.sha256`` (digest, two blanks, name; sorted) and gives the digest of its text."""
    rows = file_digests(spark, path).orderBy("name").collect()
    text = "".join(f"{r['sha256']}  {r['name']}\n" for r in rows)
    fs, p = _fs(spark, f"{path}/completion.sha256")
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    return hashlib.sha256(text.encode()).hexdigest()


def signature_breaks(spark: SparkSession, path: str) -> DataFrame:
    """(name, state) of files that are missing, changed or not signed; none if the signature holds."""
    signed = spark.read.text(f"{path}/completion.sha256").select(F.regexp_extract("value", r"^([0-9a-f]{64})  (.*)$", 2).alias("name"), F.regexp_extract("value", r"^([0-9a-f]{64})  (.*)$", 1).alias("signed"))
    joined = signed.join(file_digests(spark, path), "name", "full_outer")
    state = F.when(F.col("sha256").isNull(), "missing").when(F.col("signed").isNull(), "unsigned").when(F.col("signed") != F.col("sha256"), "changed")
    return joined.withColumn("state", state).filter("state IS NOT NULL").select("name", "state")


def publish(df: DataFrame, path: str, fmt: str = "parquet", sources: dict[str, str] | None = None) -> str:
    """All or nothing: written to a hidden directory beside ``path``, signed, and renamed; an existing ``path`` fails."""
    spark = df.sparkSession
    require_new(spark, path)
    temp = f"{os.path.dirname(path.rstrip('/'))}/.{os.path.basename(path.rstrip('/'))}.{uuid.uuid4().hex}"
    df.write.format(fmt).save(f"{temp}/data")
    write_report(spark, f"{temp}/status.json", {"status": "complete", "sources": sources or {}})
    digest = sign(spark, temp)
    fs, a = _fs(spark, temp)
    _, b = _fs(spark, path)
    if not fs.rename(a, b):
        raise OSError(f"could not publish {path}")
    return digest


def store_content(df: DataFrame, path: str, content: str = "content") -> None:
    """Appends (sha256, content) of contents that the store does not hold yet, each once."""
    spark = df.sparkSession
    new = df.filter(F.col(content).isNotNull()).select(F.sha2(F.col(content).cast("binary"), 256).alias("sha256"), F.col(content).cast("binary").alias("content")).dropDuplicates(["sha256"])
    if exists(spark, path):
        new = new.join(spark.read.parquet(path).select("sha256"), "sha256", "left_anti")
    new.write.mode("append").parquet(path)


def append_pending(source: DataFrame, path: str, key: str, make) -> dict[str, int]:
    """Appends ``make(pending rows)`` for the keys that the sink lacks, so an ended run goes on; gives the counts.

    Fails if the sink holds keys that the source does not have, or one twice.
    """
    spark = source.sparkSession
    done = spark.read.parquet(path).select(key) if exists(spark, path) else source.select(key).limit(0)
    have = done.count()
    if done.distinct().count() != have or done.join(source.select(key), key, "left_anti").limit(1).count():
        raise ValueError("the sink has repeated or unknown keys")
    todo = source.join(done, key, "left_anti")
    n = todo.count()
    if n:
        make(todo).write.mode("append").parquet(path)
    return {"existing": have, "generated": n, "total": have + n}


def finalize(source: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """The predictions, unless a source key has none: then the query fails."""
    gap = source.select(key).distinct().join(predictions.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("n"))
    ok = gap.select(F.when(F.col("n") == 0, True).otherwise(F.raise_error(F.format_string("%d rows have no prediction", "n")).cast("boolean")).alias("_ok"))
    return predictions.crossJoin(F.broadcast(ok)).filter("_ok").drop("_ok")


def write_review_sheet(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV files, each with the given header, for human review; as many as ``df`` has partitions."""
    df.select(*[F.col(c).cast("string") for c in columns]).write.mode("errorifexists").option("header", "true").csv(path)


def write_review_page(df: DataFrame, path: str, columns: list[str], title: str) -> None:
    """HTML fragments, one per row, as text files; values are escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cells = F.concat(*[F.concat(F.lit(f"<dt>{c}</dt><dd>"), safe(c), F.lit("</dd>")) for c in columns])
    df.select(F.concat(F.lit(f"<section><h2>{title}</h2><dl>"), cells, F.lit("</dl></section>")).alias("value")).write.mode("errorifexists").text(path)
