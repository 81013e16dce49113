"""File sources: line JSON, class lists, CSV, XML, archives, images, byte ranges."""

from __future__ import annotations

import hashlib
import io
import json
import os
import re
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


#: Bytes of archive members that are handed on at once.
MEMBER_BYTES = 32 << 20


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per non-blank line; malformed lines give nulls. ``_file`` names the file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file")).filter(F.trim("value") != "")
    return lines.select("_file", F.from_json("value", schema).alias("r")).select("_file", "r.*")


def read_jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As ``read_jsonl``, but a line that is no JSON object fails the query and names file and line."""
    names = spark.createDataFrame([], schema).columns

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for line, file in zip(pdf["value"], pdf["_file"]):
                try:
                    ok = isinstance(json.loads(line), dict)
                except ValueError:
                    ok = False
                if not ok:
                    raise ValueError(f"{file}: not a JSON object: {line[:80]}")
            yield pdf

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file")).filter(F.trim("value") != "")
    return lines.mapInPandas(check, "value string, _file string").select(F.from_json("value", schema).alias("r")).select(*[F.col(f"r.{n}") for n in names])


def read_split(spark: SparkSession, path: str, schema: str, split: str) -> DataFrame:
    """A split's file; a row of another split or without id fails the query."""
    rows = read_jsonl_strict(spark, path, schema)
    ok = F.when((F.col("split") == split) & (F.col("id") != ""), True).otherwise(F.raise_error(F.concat(F.lit(f"row is not of split {split}: "), F.coalesce("id", F.lit("no id")))).cast("boolean"))
    return rows.filter(ok)


def contract_breaks(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines (column value) whose object has other keys than the given ones: value, found."""
    found = F.array_sort(F.json_object_keys("value"))
    return lines.withColumn("found", found).filter(F.col("found").isNull() | (F.col("found") != F.array(*map(F.lit, sorted(keys)))))


def allowed_input(path: str, locked: tuple[str, ...]) -> str:
    """The path, unless it names a locked set."""
    if any(part in path.lower() for part in locked):
        raise ValueError(f"locked input: {path}")
    return path


def mentions_locked(messages: Column, locked: tuple[str, ...]) -> Column:
    """An image reference of the messages names a locked set."""
    return F.exists(messages, lambda m: F.exists(m["content"], lambda c: F.coalesce(F.lower(c["image"]).rlike("|".join(locked)), F.lit(False))))


def read_class_list(spark: SparkSession, path: str) -> DataFrame:
    """``<number from 1> <name>`` lines: class_id from 0, name with single spaces."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    return spark.read.text(path).filter(F.trim("value") != "").select((parts[0].cast("int") - 1).alias("class_id"), F.regexp_replace(parts[1], r"\s+", " ").alias("class_name"))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("id")).filter("id <> ''")


def list_images(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("jpg", "jpeg", "png", "bmp", "webp")) -> DataFrame:
    """(path, length, modified) of image files at any depth; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter(F.lower("path").rlike(r"\.(" + "|".join(suffixes) + ")$")).select("path", "length", F.col("modificationTime").alias("modified"))


def image_fault(data: bytes) -> str | None:
    """Why an image file cannot be read whole, or None: its container is walked from end to end.

    PNG: every chunk's check sum, and the pixel stream is inflated to the size the
    header tells. JPEG: the markers up to the end of the image. BMP and WebP: the sizes
    their headers tell.
    """
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at, pixels, head = 8, zlib.decompressobj(), None
        size = 0
        while at + 12 <= len(data):
            n, kind = struct.unpack_from(">I4s", data, at)
            body = data[at + 8 : at + 8 + n]
            if len(body) < n or at + 12 + n > len(data) or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body):
                return "chunk"
            if kind == b"IHDR" and n == 13:
                head = struct.unpack(">IIBBBBB", body)
            elif kind == b"IDAT":
                try:
                    size += len(pixels.decompress(body))
                except zlib.error:
                    return "pixels"
            elif kind == b"IEND":
                if head is None:
                    return "header"
                width, height, depth, colour, _, _, interlaced = head
                row = (width * depth * {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour, 0) + 7) // 8 + 1
                return None if size == row * height or interlaced and size > 0 else "pixels"
            at += 12 + n
        return "end"
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data):
            if data[at] != 0xFF:
                return "marker"
            kind = data[at + 1]
            if kind == 0xDA:  # the scan lasts to the end marker
                return None if data.rstrip(b"\x00").endswith(b"\xff\xd9") else "end"
            at += 2 + struct.unpack_from(">H", data, at + 2)[0]
        return "end"
    if data[:2] == b"BM" and len(data) >= 26:
        return None if struct.unpack_from("<I", data, 2)[0] == len(data) else "size"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return None if struct.unpack_from("<I", data, 4)[0] + 8 <= len(data) else "size"
    return "type"


def hashed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256, fault, readable) of the files below a folder; see ``image_fault``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "length": pdf["length"], "sha256": [hashlib.sha256(c).hexdigest() for c in pdf["content"]], "fault": [image_fault(c) for c in pdf["content"]]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")
    return files.mapInPandas(run, "path string, length long, sha256 string, fault string").withColumn("readable", F.col("fault").isNull())


def read_frozen_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV whose header must be exactly ``columns`` in order (a byte-order mark is ignored); all strings."""
    df = spark.read.option("header", "true").option("encoding", "UTF-8").csv(path)
    found = [c.lstrip("﻿") for c in df.columns]
    if found != columns:
        raise ValueError(f"header {found} is not {columns}")
    return df.toDF(*found)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """One row per XML annotation: file, image, width, height, repaired, error, objects (name, box).

    A second root glued to the first is cut off and counted as repaired. Malformed
    files give an error and no objects.
    """
    import xml.etree.ElementTree as ET

    def one(text: str) -> tuple:
        repaired, root = False, None
        try:
            root = ET.fromstring(text)
        except ET.ParseError as e:
            if text.count("<annotation") > 1 and "</annotation>" in text:
                try:
                    root, repaired = ET.fromstring(text[: text.index("</annotation>") + len("</annotation>")]), True
                except ET.ParseError:
                    pass
            if root is None:
                return None, None, None, False, str(e), []
        number = lambda node, tag: int(float(node.findtext(tag))) if (node.findtext(tag) or "").strip() else None
        boxes = []
        for o in root.iter("object"):
            b = o.find("bndbox")
            values = [number(b, t) for t in ("xmin", "ymin", "xmax", "ymax")] if b is not None else []
            boxes.append({"name": o.findtext("name"), "box": values if all(v is not None for v in values) else None})
        size = root.find("size")
        return root.findtext("filename"), size is not None and number(size, "width") or None, size is not None and number(size, "height") or None, repaired, None, boxes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, *one(t)) for f, t in zip(pdf["_file"], pdf["value"])]
            yield pd.DataFrame(rows, columns=["file", "image", "width", "height", "repaired", "error", "objects"]).astype({"width": "Int32", "height": "Int32"})

    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("_file"))
    return raw.mapInPandas(run, "file string, image string, width int, height int, repaired boolean, error string, objects array<struct<name: string, box: array<int>>>")


def annotated_objects(annotations: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid objects with class_id and area, dropped counts by reason): unknown classes and boxes outside the frame are dropped."""
    each = annotations.select("file", "image", "width", "height", F.explode("objects").alias("o")).select("file", "image", "width", "height", F.col("o.name").alias("class_name"), F.col("o.box").alias("box"))
    known = each.join(classes.select("class_name", "class_id").dropDuplicates(["class_name"]), "class_name", "left")
    b = F.col("box")
    reason = F.when(F.col("class_id").isNull(), "unknown_class").when(b.isNull() | (F.get(b, F.lit(2)) <= F.get(b, F.lit(0))) | (F.get(b, F.lit(3)) <= F.get(b, F.lit(1))), "degenerate").when((b[0] < 0) | (b[1] < 0) | (b[2] > F.col("width")) | (b[3] > F.col("height")), "outside")
    marked = known.withColumn("dropped_as", reason).withColumn("area", (b[2] - b[0]) * (b[3] - b[1]))
    return marked.filter("dropped_as IS NULL").drop("dropped_as"), marked.filter("dropped_as IS NOT NULL").groupBy("dropped_as").agg(F.count("*").alias("n"))


def read_archive_members(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(archive, member, stem, place, content) of zip and tar files; absolute, upward and non-file members are left out."""

    def members(name: str, data: bytes) -> Iterator[tuple[str, bytes]]:
        if zipfile.is_zipfile(io.BytesIO(data)):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for i in z.infolist():
                    if not i.is_dir():
                        yield i.filename, z.read(i)
        else:
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                for i in t:
                    if i.isfile():
                        yield i.name, t.extractfile(i).read()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive, data in zip(pdf["path"], pdf["content"]):
                rows, held = [], 0
                table = lambda rows: pd.DataFrame(rows, columns=["archive", "member", "stem", "place", "content"]).astype({"place": "int32"})
                for place, (name, content) in enumerate(members(archive, data)):
                    safe = not name.startswith("/") and ".." not in name.split("/")
                    if safe and (not suffixes or name.lower().endswith(tuple(suffixes))):
                        rows.append((archive, name, name.rsplit("/", 1)[-1].rsplit(".", 1)[0], place, content))
                        held += len(content)
                    if held >= MEMBER_BYTES:
                        yield table(rows)
                        rows, held = [], 0
                yield table(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, stem string, place int, content binary")


def last_per_stem(members: DataFrame) -> DataFrame:
    """Of members with one stem the last of the archive."""
    return members.groupBy("archive", "stem").agg(F.max_by("member", "place").alias("member"), F.max_by("content", "place").alias("content"))


def arrivals(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(name, size, sha256, state) of a manifest's files: ok, missing, size or digest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("_sha"))
    state = F.when(F.col("length").isNull(), "missing").when(F.col("length") != F.col("size"), "size").when(F.col("_sha") != F.lower("sha256"), "digest").otherwise("ok")
    return manifest.join(files, "name", "left").withColumn("state", state).drop("length", "_sha")


def row_count(spark: SparkSession, path: str) -> int:
    """Non-blank lines; 0 if nothing is there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return 0
    return spark.read.text(path).filter(F.trim("value") != "").count()


def blind_sets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(image ids, digests) of an exclusion manifest; a malformed one fails the query."""
    image = F.when(F.col("source_image_id").rlike(r"^IP[0-9]{9}$"), F.col("source_image_id")).otherwise(F.raise_error(F.concat(F.lit("malformed image id: "), F.coalesce("source_image_id", F.lit("null")))))
    digest = F.when(F.col("source_image_sha256").rlike(r"^[0-9a-f]{64}$"), F.col("source_image_sha256")).otherwise(F.raise_error(F.concat(F.lit("malformed digest: "), F.coalesce("source_image_sha256", F.lit("null")))))
    return rows.select(image.alias("source_image_id")).distinct(), rows.select(digest.alias("source_image_sha256")).distinct()


class ByteRanges(DataSource):
    """``auditloom_ranges``: (offset, content) of a remote file in blocks, read in parallel with retries.

    Options: url, length, block (bytes), tries, fetcher (module:function that maps
    url, first and last byte to the bytes; by default an HTTP range request).
    """

    @classmethod
    def name(cls) -> str:
        return "auditloom_ranges"

    def schema(self) -> str:
        return "offset long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _RangeReader(self.options)


class _RangeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.url, self.length = options["url"], int(options["length"])
        self.block, self.tries = int(options.get("block", 2 << 20)), int(options.get("tries", 3))
        self.fetcher = options.get("fetcher", "auditloom.sources.files:http_range")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(0, self.length, self.block)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import importlib

        if partition.value is None:
            return
        module, name = self.fetcher.split(":")
        fetch: Callable = getattr(importlib.import_module(module), name)
        first, last = partition.value, min(partition.value + self.block, self.length) - 1
        for attempt in range(self.tries):
            try:
                data = fetch(self.url, first, last)
                if len(data) != last - first + 1:
                    raise OSError(f"got {len(data)} of {last - first + 1} bytes")
                break
            except OSError:
                if attempt == self.tries - 1:
                    raise
        yield first, data


def http_range(url: str, first: int, last: int) -> bytes:
    import urllib.request

    with urllib.request.urlopen(urllib.request.Request(url, headers={"Range": f"bytes={first}-{last}"}), timeout=60) as r:
        if r.status != 206:
            raise OSError(f"status {r.status} instead of partial content")
        return r.read()


def local_path(path: str) -> str:
    """The path without a ``file`` scheme, for Python readers of a mounted folder."""
    return re.sub(r"^file:/*(?=/)", "", path)


def file_range(url: str, first: int, last: int) -> bytes:
    """Fetcher for files on a shared disk, and for tests."""
    with open(url, "rb") as f:
        f.seek(first)
        return f.read(last - first + 1)


def git_object(repository: str, sha: str) -> tuple[str, bytes]:
    """(type, body) of a loose object of a Git repository; its digest is checked."""
    with open(f"{repository}/objects/{sha[:2]}/{sha[2:]}", "rb") as f:
        data = zlib.decompress(f.read())
    if hashlib.sha1(data).hexdigest() != sha:
        raise ValueError(f"object {sha} is damaged")
    head, body = data.split(b"\0", 1)
    return head.split()[0].decode(), body


def git_tree(repository: str, commit: str) -> Iterator[tuple[str, str, str]]:
    """(path, sha, type) of everything below a commit's tree, in the tree's order."""
    kind, body = git_object(repository, commit)
    if kind != "commit":
        raise ValueError(f"{commit} is a {kind}")
    todo = [("", body.split(b"\n", 1)[0].split()[1].decode())]
    while todo:
        place, sha = todo.pop()
        body, at, below = git_object(repository, sha)[1], 0, []
        while at < len(body):
            end = body.index(b"\0", at)
            mode, name = body[at:end].split(b" ", 1)
            entry, at = body[end + 1 : end + 21].hex(), end + 21
            path = f"{place}{name.decode()}"
            yield path, entry, "tree" if mode.lstrip(b"0") == b"40000" else "commit" if mode == b"160000" else "blob"
            if mode.lstrip(b"0") == b"40000":
                below.append((f"{path}/", entry))
        todo += reversed(below)


def tree_listing(spark: SparkSession, repository: str, commit: str, below: str = "") -> DataFrame:
    """(path, sha, kind) of a repository's tree at a pinned commit, below a folder of it; read by one task in small batches.

    The repository is a folder that the executors share, with loose objects (unpack it first).
    """
    place = os.path.normpath(repository)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for sha in pdf["commit"]:
                rows = []
                for entry in git_tree(place, sha):
                    if entry[0].startswith(below):
                        rows.append(entry)
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=["path", "sha", "kind"])
                        rows = []
                yield pd.DataFrame(rows, columns=["path", "sha", "kind"])

    return spark.createDataFrame([(commit,)], "commit string").mapInPandas(run, "path string, sha string, kind string")
