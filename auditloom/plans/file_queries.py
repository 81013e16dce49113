"""Queries that send tables through the file sources and sinks and read them back.

Files go to the shared folder that also holds the checkpoints.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gates
from ..session import shared_folder, table
from ..sources import files, sinks
from ..streaming import resume
from .base import PLAIN, outcomes, plain_rows
from .registry import query


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT event_id, user_id, event_type, props FROM events")
def a01_b01_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "events")
    sinks.write_jsonl(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props"), path)
    return files.read_jsonl(spark, path, "event_id long, user_id long, event_type string, props string").drop("_file")


@query("SELECT id, source, attempt, raw_text FROM predictions WHERE raw_text IS NOT NULL")
def a02_b02_strict_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "predictions")
    sinks.write_jsonl(table(spark, sf_dir, "predictions").filter("raw_text IS NOT NULL").select("id", "source", "attempt", "raw_text"), path, create_only=True, sort_keys=True)
    return files.read_jsonl_strict(spark, path, "id string, source string, attempt int, raw_text string")


@query(f"WITH {PLAIN} SELECT id, split, role FROM pl WHERE split = 'dev' AND id IS NOT NULL")
def a03_split_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "dev")
    sinks.write_jsonl(plain_rows(spark, sf_dir).filter("split = 'dev' AND id IS NOT NULL").select("id", "split", "role"), path)
    return files.read_split(spark, path, "id string, split string, role string", "dev")


@query("SELECT id, len(list_filter(flatten(list_transform(messages, lambda m: list_transform(m.content, lambda c: coalesce(regexp_matches(lower(c.image), 'ip00000[0-4]'), false)))), lambda x: x)) > 0 AS locked, true AS guarded FROM manifest WHERE messages IS NOT NULL")
def a04_locked_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose messages show an image of the locked range; the guard lets the tables pass and stops a locked path."""
    locked = ("ip00000[0-4]",)
    files.allowed_input(sf_dir, ("locked_audit",))
    try:
        files.allowed_input(f"{sf_dir}/Locked_Audit/images", ("locked_audit",))
        guarded = False
    except ValueError:
        guarded = True
    return table(spark, sf_dir, "manifest").filter("messages IS NOT NULL").select("id", F.coalesce(files.mentions_locked(F.col("messages"), locked), F.lit(False)).alias("locked"), F.lit(guarded).alias("guarded"))


@query("SELECT count(*) AS broken FROM documents WHERE doc_id % 17 = 0")
def a05_probe_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    good = F.to_json(F.struct(F.col("doc_id").alias("id"), F.lit("train").alias("split"), F.lit(1).alias("label")))
    bad = F.to_json(F.struct(F.col("doc_id").alias("id"), F.lit("train").alias("split")))
    lines = d.select(F.when(F.col("doc_id") % 17 == 0, bad).otherwise(good).alias("value"))
    return files.contract_breaks(lines, ["id", "split", "label"]).agg(F.count("*").alias("broken"))


def _classes(spark: SparkSession, sf_dir: str) -> list:
    """The class catalog, a fixed table, by class."""
    return table(spark, sf_dir, "class_catalog").select("class_id", "class_name").orderBy("class_id").collect()


def _annotations(spark: SparkSession, sf_dir: str) -> str:
    """One XML annotation per class: some with a second root glued on, some cut off, some objects outside or unknown."""
    path = _place(spark, "xml")
    c = F.col("class_id").cast("string")
    thing = lambda name, x2: F.concat(F.lit("<object><name>"), name, F.lit("</name><bndbox><xmin>2</xmin><ymin>3</ymin><xmax>"), x2, F.lit("</xmax><ymax>40</ymax></bndbox></object>"))
    name = F.replace(F.col("class_name"), F.lit("&"), F.lit("&amp;"))
    text = F.concat(F.lit("<annotation><filename>"), c, F.lit(".jpg</filename>\n<size><width>200</width><height>50</height></size>"), thing(name, (F.col("class_id") + 3).cast("string")), thing(F.when(F.col("class_id") % 4 == 0, "nothing known").otherwise(name), F.lit("220")), F.lit("\n</annotation>"))
    glued = F.when(F.col("class_id") % 7 == 0, F.expr("left(t, length(t) - 14)")).when(F.col("class_id") % 3 == 0, F.concat("t", "t")).otherwise(F.col("t"))
    rows = table(spark, sf_dir, "class_catalog").select("class_id", text.alias("t")).select("class_id", glued.alias("value"))
    rows.repartition("class_id").write.partitionBy("class_id").text(path)
    return path


@query("SELECT CASE WHEN class_id % 7 <> 0 THEN class_id || '.jpg' END AS image, CASE WHEN class_id % 7 <> 0 THEN 200 END AS width, CASE WHEN class_id % 7 <> 0 THEN 50 END AS height, class_id % 7 <> 0 AND class_id % 3 = 0 AS repaired, class_id % 7 = 0 AS broken, CASE WHEN class_id % 7 <> 0 THEN 2 ELSE 0 END AS objects FROM class_catalog")
def a06_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.read_annotations(spark, _annotations(spark, sf_dir))
    return found.select("image", "width", "height", "repaired", F.col("error").isNotNull().alias("broken"), F.size("objects").alias("objects"))


@query("SELECT class_id, NULL AS dropped_as, ((class_id + 1) * 37)::BIGINT AS n FROM class_catalog WHERE class_id % 7 <> 0 UNION ALL SELECT NULL, CASE WHEN class_id % 4 = 0 THEN 'unknown_class' ELSE 'outside' END, count(*) FROM class_catalog WHERE class_id % 7 <> 0 GROUP BY 2")
def a07_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area of each sound object by class, and how many were dropped for what."""
    kept, dropped = files.annotated_objects(files.read_annotations(spark, _annotations(spark, sf_dir)), table(spark, sf_dir, "class_catalog"))
    return kept.select("class_id", F.lit(None).cast("string").alias("dropped_as"), F.col("area").cast("long").alias("n")).unionByName(dropped.select(F.lit(None).cast("int").alias("class_id"), "dropped_as", "n"))


def _png() -> bytes:
    """A PNG image of one grey pixel."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\x80", 9)) + chunk(b"IEND", b"")


def _images(spark: SparkSession, sf_dir: str) -> str:
    """One file per class: a PNG, the same cut short, one with a changed byte, or text; class by class."""
    path, whole = _place(spark, "images"), _png()
    for c, _ in _classes(spark, sf_dir):
        data = (whole, whole[:-5], whole[:-20] + b"x" + whole[-19:], f"class {c}".encode())[c % 4]
        sinks.write_file(spark, f"{path}/{c % 5}/{c}.{'txt' if c % 4 == 3 else 'PNG'}", data)
    return path


_PNG_SQL = f"unhex('{_png().hex()}')"


@query(f"SELECT class_id || '.PNG' AS name, CASE class_id % 4 WHEN 1 THEN octet_length({_PNG_SQL}) - 5 ELSE octet_length({_PNG_SQL}) END AS length FROM class_catalog WHERE class_id % 4 <> 3")
def a10_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.list_images(spark, _images(spark, sf_dir)).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


@query(f"SELECT class_id, CASE class_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'end' WHEN 2 THEN 'chunk' ELSE 'type' END AS fault, CASE class_id % 4 WHEN 0 THEN sha256({_PNG_SQL}) WHEN 3 THEN sha256('class ' || class_id) END AS sha256 FROM class_catalog")
def a11_image_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a file is no whole image, by walking it, and the digest of the whole ones and the texts."""
    found = files.hashed_files(spark, _images(spark, sf_dir)).withColumn("class_id", F.regexp_extract("path", r"/([0-9]+)\.[A-Za-z]+$", 1).cast("int"))
    return found.select("class_id", "fault", F.when((F.col("class_id") % 4).isin(0, 3), F.col("sha256")).alias("sha256"))


def _archived(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The class names as members of an archive, with repeated stems, an upward path and a folder, and read back."""
    buffer = io.BytesIO()
    rows = [(f"names/{c}.txt", n) for c, n in _classes(spark, sf_dir)]
    rows += [(f"later/{c}.txt", f"{n} again") for (c, n) in _classes(spark, sf_dir) if c % 6 == 0] + [("../up.txt", "up"), ("/root.txt", "root"), ("skip.bin", "bin")]
    if kind == "zip":
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("names/", "")
            for name, text in rows:
                z.writestr(name, text)
    else:
        with tarfile.open(fileobj=buffer, mode="w:gz") as t:
            for name, text in rows:
                info = tarfile.TarInfo(name)
                info.size = len(text.encode())
                t.addfile(info, io.BytesIO(text.encode()))
    path = f"{_place(spark, kind)}/names.{kind}"
    sinks.write_file(spark, path, buffer.getvalue())
    last = files.last_per_stem(files.read_archive_members(spark, path, (".txt",)))
    return last.select(F.col("stem").cast("int").alias("class_id"), "member", F.decode("content", "UTF-8").alias("text"))


_ARCHIVED = "SELECT class_id, CASE WHEN class_id % 6 = 0 THEN 'later/' ELSE 'names/' END || class_id || '.txt' AS member, class_name || CASE WHEN class_id % 6 = 0 THEN ' again' ELSE '' END AS text FROM class_catalog"


@query(_ARCHIVED)
def a13_zip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _archived(spark, sf_dir, "zip")


@query(_ARCHIVED)
def a14_tar_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _archived(spark, sf_dir, "tar")


@query("WITH t AS (SELECT encode(string_agg(class_name, '|' ORDER BY class_id)) AS b FROM class_catalog) SELECT (range * 64)::BIGINT AS \"offset\", sha256(substr(decode(b), (range * 64 + 1)::BIGINT, 64)) AS sha256 FROM t, range(0, 1000) WHERE range * 64 < octet_length(b)")
def a15_byte_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file read in blocks of 64 bytes, each by a task of its own."""
    path, data = f"{_place(spark, 'ranges')}/names", "|".join(n for _, n in _classes(spark, sf_dir)).encode()
    sinks.write_file(spark, path, data)
    spark.dataSource.register(files.ByteRanges)
    blocks = spark.read.format("auditloom_ranges").option("url", files.local_path(path)).option("length", len(data)).option("block", 64).option("fetcher", "auditloom.sources.files:file_range").load()
    return blocks.select("offset", F.sha2("content", 256).alias("sha256"))


@query("SELECT 'names/' || class_id || '.txt' AS path, sha1('blob ' || octet_length(encode(class_name)) || chr(0) || class_name) AS sha, 'blob' AS kind FROM class_catalog")
def a16_git_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class names as files of a Git repository, listed at the pinned commit; digests are those of Git."""
    path = _place(spark, "git")

    def store(kind: str, body: bytes) -> str:
        data = f"{kind} {len(body)}".encode() + b"\0" + body
        sha = hashlib.sha1(data).hexdigest()
        sinks.write_file(spark, f"{path}/objects/{sha[:2]}/{sha[2:]}", zlib.compress(data))
        return sha

    blobs = sorted((f"{c}.txt".encode(), store("blob", n.encode())) for c, n in _classes(spark, sf_dir))
    names = store("tree", b"".join(b"100644 " + n + b"\0" + bytes.fromhex(s) for n, s in blobs))
    root = store("tree", b"40000 names\0" + bytes.fromhex(names) + b"100644 readme\0" + bytes.fromhex(store("blob", b"names")))
    commit = store("commit", f"tree {root}\nauthor a <a@b> 0 +0000\ncommitter a <a@b> 0 +0000\n\nnames\n".encode())
    return files.tree_listing(spark, files.local_path(path), commit, "names/")


@query(f"SELECT class_id || CASE class_id % 4 WHEN 3 THEN '.txt' ELSE '.PNG' END AS name, CASE WHEN class_id % 9 = 8 THEN 'digest' WHEN class_id % 4 = 1 THEN 'size' WHEN class_id % 4 = 2 THEN 'digest' WHEN class_id % 4 = 3 THEN 'size' ELSE 'ok' END AS state FROM class_catalog WHERE class_id % 4 <> 3 AND NOT (class_id % 9 = 8 AND class_id % 4 = 1) UNION ALL SELECT class_id || '.PNG', 'size' FROM class_catalog WHERE class_id % 9 = 8 AND class_id % 4 = 1 UNION ALL SELECT class_id || '.PNG', 'missing' FROM class_catalog WHERE class_id % 4 = 3")
def a21_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest promises one whole PNG per class, for some with another digest; what came."""
    whole = _png()
    digest = F.when(F.col("class_id") % 9 == 8, "0" * 64).otherwise(hashlib.sha256(whole).hexdigest())
    manifest = table(spark, sf_dir, "class_catalog").select(F.concat(F.col("class_id").cast("string"), F.lit(".PNG")).alias("name"), F.lit(len(whole)).cast("long").alias("size"), digest.alias("sha256"))
    return files.arrivals(spark, _images(spark, sf_dir), manifest).select("name", "state")


@query("SELECT lower(trim(split)) AS split, count(*) AS n, true AS replaced FROM provenance WHERE split IS NOT NULL GROUP BY 1")
def b03_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON report of rows per split, written twice: the second replaces the first."""
    path = f"{_place(spark, 'report')}/report.json"
    counts = {r["s"]: r["n"] for r in table(spark, sf_dir, "provenance").filter("split IS NOT NULL").groupBy(F.lower(F.trim("split")).alias("s")).agg(F.count("*").alias("n")).collect()}  # split names
    sinks.write_report(spark, path, {"counts": {}, "replaced": False})
    sinks.write_report(spark, path, {"counts": counts, "replaced": True})
    read = spark.read.text(path, wholetext=True).select(F.from_json("value", "counts map<string, bigint>, replaced boolean").alias("r"))
    return read.select(F.explode("r.counts").alias("split", "n"), "r.replaced")


@query("SELECT (SELECT count(*) FROM class_catalog) AS classes, true AS refused")
def b04_report_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON report that may be written once: the second attempt is refused and changes nothing."""
    path = f"{_place(spark, 'once')}/report.json"
    sinks.write_report(spark, path, {"classes": len(_classes(spark, sf_dir))}, create_only=True)
    try:
        sinks.write_report(spark, path, {"classes": -1}, create_only=True)
        refused = False
    except FileExistsError:
        refused = True
    return spark.read.text(path, wholetext=True).select(F.from_json("value", "classes bigint").alias("r")).select("r.classes", F.lit(refused).alias("refused"))


@query("SELECT class_id, class_name FROM class_catalog")
def a08_class_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "classes")
    table(spark, sf_dir, "class_catalog").select(F.concat_ws("  ", (F.col("class_id") + 1).cast("string"), "class_name").alias("value")).write.text(path)
    return files.read_class_list(spark, path)


@query("SELECT id FROM feature_rows WHERE trim(id) = id")
def a09_id_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "ids")
    table(spark, sf_dir, "feature_rows").filter("trim(id) = id").select(F.concat(F.lit("  "), "id", F.lit(" ")).alias("value")).write.text(path)
    return files.read_id_list(spark, path)


@query("SELECT class_id::VARCHAR AS class_id, band FROM class_catalog")
def a12_b12_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "sheet")
    sinks.write_review_sheet(table(spark, sf_dir, "class_catalog"), path, ["class_id", "band"])
    return files.read_frozen_csv(spark, path, ["class_id", "band"])


@query("SELECT count(*) AS n FROM orders")
def a19_line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "orders")
    sinks.write_jsonl(table(spark, sf_dir, "orders").select("o_orderkey"), path)
    return spark.createDataFrame([(files.row_count(spark, path),)], "n long")


@query("SELECT (SELECT count(DISTINCT source_image_id) FROM prior_positives) AS images, (SELECT count(DISTINCT source_image_sha256) FROM prior_positives) AS digests")
def a20_blind_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    images, digests = files.blind_sets(table(spark, sf_dir, "prior_positives"))
    return images.agg(F.count("*").alias("images")).crossJoin(digests.agg(F.count("*").alias("digests")))


@query("SELECT (SELECT count(*) FROM class_catalog) AS n, 0 AS broken")
def b05_b09_signed_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sinks.require_new(spark, _place(spark, "bundle"))
    sinks.publish(table(spark, sf_dir, "class_catalog"), path)
    broken = sinks.signature_breaks(spark, path).count()
    return spark.read.parquet(f"{path}/data").agg(F.count("*").alias("n"), F.lit(broken).alias("broken"))


@query("SELECT sha256(text) AS sha256, text FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)")
def b08_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "store")
    texts = table(spark, sf_dir, "documents").select(F.col("text").alias("content"), "lang")
    for part in (texts.filter("lang = 'de'"), texts):
        sinks.store_content(part, path)
    return spark.read.parquet(path).select("sha256", F.decode("content", "UTF-8").alias("text"))


@query("SELECT event_id, value * 2 AS answer FROM events")
def b10_append_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "pending")
    e = table(spark, sf_dir, "events").select("event_id", "value")
    make = lambda df: df.select("event_id", (F.col("value") * 2).alias("answer"))
    sinks.append_pending(e.filter("value > 10"), path, "event_id", make)
    sinks.append_pending(e, path, "event_id", make)
    return spark.read.parquet(path)


@query("SELECT event_id, user_id + 1 AS answer FROM events")
def b10_stream_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "stream")
    source = spark.readStream.schema("event_id long, user_id long").parquet(f"{sf_dir}/events.parquet*")
    resume.stream_pending(source, path, "event_id", lambda df: df.select("event_id", (F.col("user_id") + 1).alias("answer")), f"{path}-state").awaitTermination()
    return spark.read.parquet(path)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL")
def s01_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return resume.windowed_counts(e, "ts", "event_type").withColumns({"start": F.col("start").cast("timestamp_ntz"), "mean_value": F.round("mean_value", 6)})


@query("SELECT class_id, CASE WHEN class_id % 11 = 0 OR class_id % 7 > class_id % 5 THEN 'BLOCKED' WHEN class_id % 7 = class_id % 5 THEN 'READY' ELSE 'WAITING' END AS state, concat_ws(',', CASE WHEN class_id % 3 = 0 THEN 'missing rate' END, CASE WHEN class_id % 4 = 0 THEN 'type seed' END, CASE WHEN class_id % 2 <> 0 THEN 'frozen quota' END, CASE WHEN class_id % 5 = 0 THEN 'unknown extra' END) AS breaks, 3 AS stages FROM class_catalog")
def l09_l10_l14_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per class a stage's state from its counts and what a configuration breaks; and three signed stages in a row."""
    path, stages = _place(spark, "stage"), 0
    for name in ("first", "second", "third"):
        at = sinks.require_new(spark, f"{path}-{name}")
        sinks.publish(table(spark, sf_dir, "class_catalog"), at)
        stages += sinks.signature_breaks(spark, at).count() == 0
    rows = []
    for (c,) in table(spark, sf_dir, "class_catalog").select("class_id").collect():  # a fixed table
        config = {"seed": "17" if c % 4 == 0 else 17, "quota": 12 + c % 2} | ({} if c % 3 == 0 else {"rate": 0.1}) | ({"extra": 1} if c % 5 == 0 else {})
        breaks = gates.check_config(config, {"seed": int, "rate": float}, {"quota": 12})
        rows.append((c, gates.run_state(c % 5, c % 7, int(c % 11 == 0)), ",".join(breaks), stages))
    return spark.createDataFrame(rows, "class_id int, state string, breaks string, stages int")


@query()
def l12_audit_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes to metrics, gates, decision and a signed report: the whole chain in one query."""
    o = outcomes(spark, sf_dir)
    metrics = o.agg(F.avg(F.col("parsed").cast("double")).alias("p"), F.avg(F.col("semantic").cast("double")).alias("s")).select(F.explode(F.array(F.struct(F.lit("parse_rate").alias("gate"), F.col("p").alias("value")), F.struct(F.lit("sound_rate").alias("gate"), F.col("s").alias("value")))).alias("m")).select("m.*")
    judged = gates.judged(metrics, gates.gates_table(spark, [("parse_rate", ">=", 0.4), ("sound_rate", ">=", 0.4)]))
    found = gates.leakage_rules(table(spark, sf_dir, "provenance"), "id", "split", "source_image_sha256", "near_duplicate_component_id")
    verdict = gates.decision(judged).crossJoin(gates.passes(found))
    path = _place(spark, "audit")
    sinks.publish(verdict, path)
    return spark.read.parquet(f"{path}/data")
