import io
import tarfile
import zipfile

import pytest
from pyspark.errors import PySparkException

from auditloom.sources import files, sinks
from auditloom.streaming import resume


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id":"1","split":"train"}\n\n{"id":"2","split":"train"}\n')
    assert files.read_jsonl(spark, str(p), "id string, split string").count() == 2
    assert files.read_split(spark, str(p), "id string, split string", "train").count() == 2
    with pytest.raises(PySparkException):
        files.read_split(spark, str(p), "id string, split string", "dev").collect()
    p.write_text('{"id":"1"} trailing\n')
    with pytest.raises(PySparkException):
        files.read_jsonl_strict(spark, str(p), "id string").collect()
    assert files.row_count(spark, str(p)) == 1 and files.row_count(spark, str(tmp_path / "none")) == 0
    p.write_text('{"id":"1","text":"x"}\n{"id":"1"}\n')
    assert files.contract_breaks(spark.read.text(str(p)), ["id", "text"]).count() == 1
    with pytest.raises(ValueError):
        files.allowed_input("/data/Locked_set/x", ("locked",))


def test_lists_and_csv(spark, tmp_path):
    (tmp_path / "c.txt").write_text("1  rice leaf   roller\n2 midge\n")
    assert [tuple(r) for r in files.read_class_list(spark, str(tmp_path / "c.txt")).orderBy("class_id").collect()] == [(0, "rice leaf roller"), (1, "midge")]
    (tmp_path / "s.txt").write_text(" a \n\nb\n")
    assert files.read_id_list(spark, str(tmp_path / "s.txt")).count() == 2
    (tmp_path / "r.csv").write_bytes("﻿audit_id,notes\n1,x\n".encode())
    assert files.read_frozen_csv(spark, str(tmp_path / "r.csv"), ["audit_id", "notes"]).count() == 1
    with pytest.raises(ValueError):
        files.read_frozen_csv(spark, str(tmp_path / "r.csv"), ["notes", "audit_id"])


BITMAP = b"BM" + (30).to_bytes(4, "little") + bytes(24)
XML = "<annotation><filename>a.jpg</filename><size><width>100</width><height>80</height></size><object><name>aphid</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>30</xmax><ymax>40</ymax></bndbox></object><object><name>aphid</name><bndbox><xmin>9</xmin><ymin>2</ymin><xmax>3</xmax><ymax>40</ymax></bndbox></object><object><name>moth</name></object></annotation>"


def test_annotations(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.xml").write_text(XML)
    (tmp_path / "x/b.xml").write_text((XML + XML).replace("><", ">\n<"))
    (tmp_path / "x/c.xml").write_text("<annotation>")
    a = files.read_annotations(spark, str(tmp_path / "x"))
    got = {r["file"][-5]: (r["repaired"], r["error"] is None, len(r["objects"])) for r in a.collect()}
    assert got == {"a": (False, True, 3), "b": (True, True, 3), "c": (False, False, 0)}
    good, dropped = files.annotated_objects(a, spark.createDataFrame([("aphid", 4)], "class_name string, class_id int"))
    assert good.count() == 2 and {tuple(r) for r in dropped.collect()} == {("degenerate", 2), ("unknown_class", 2)}


def test_archives_images_and_ranges(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/one.jpg", b"1")
        z.writestr("../evil.jpg", b"2")
    with tarfile.open(tmp_path / "b.tar", "w") as t:
        for body in (b"old", b"new!"):
            info = tarfile.TarInfo("e/two.jpg")
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    m = files.read_archive_members(spark, str(tmp_path), (".jpg",))
    assert {(r["stem"], bytes(r["content"])) for r in files.last_per_stem(m).collect()} == {("one", b"1"), ("two", b"new!")}
    (tmp_path / "i").mkdir()
    (tmp_path / "i/p.PNG").write_bytes(BITMAP)
    (tmp_path / "i/q.txt").write_bytes(b"text")
    assert files.list_images(spark, str(tmp_path / "i")).count() == 1
    assert sorted(r["readable"] for r in files.hashed_files(spark, str(tmp_path / "i")).collect()) == [False, True]
    manifest = spark.createDataFrame([("p.PNG", len(BITMAP), "0"), ("q.txt", 5, "0"), ("z", 1, "0")], "name string, size int, sha256 string")
    assert {r["name"]: r["state"] for r in files.arrivals(spark, str(tmp_path / "i"), manifest).collect()} == {"p.PNG": "digest", "q.txt": "size", "z": "missing"}
    (tmp_path / "big").write_bytes(bytes(range(256)) * 10)
    spark.dataSource.register(files.ByteRanges)
    parts = spark.read.format("auditloom_ranges").options(url=str(tmp_path / "big"), length="2560", block="1000", fetcher="auditloom.sources.files:file_range").load()
    assert b"".join(bytes(r["content"]) for r in parts.orderBy("offset").collect()) == bytes(range(256)) * 10


def test_image_faults():
    from auditloom.plans.file_queries import _png

    png = _png()
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02data\xff\xd9"
    webp = b"RIFF" + (8).to_bytes(4, "little") + b"WEBPdata"
    assert [files.image_fault(x) for x in (png, jpeg, BITMAP, webp)] == [None] * 4
    assert [files.image_fault(x) for x in (png[:-1], jpeg[:-2], BITMAP + b"x", webp[:-1], b"", b"text", png[:40] + b"\0" + png[41:], b"\xff\xd8\x00\x00\x00\x00")] == ["end", "end", "size", "size", "type", "type", "chunk", "marker"]


def test_members_come_in_bounded_pieces(spark, tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(7):
            z.writestr(f"{i}.txt", bytes([65 + i]) * 10)
        z.writestr("0/deep.bin", b"")
    monkeypatch.setattr(files, "MEMBER_BYTES", 15)
    got = files.read_archive_members(spark, str(tmp_path)).collect()
    assert [(r["member"], r["place"]) for r in got] == [(f"{i}.txt", i) for i in range(7)] + [("0/deep.bin", 7)]


def test_more_classes_than_any_bound(spark):
    n = 120_000
    a = spark.createDataFrame([("f", "i", 100, 100, [(f"c{n - 1}", [1, 1, 9, 9])])], "file string, image string, width int, height int, objects array<struct<name: string, box: array<int>>>")
    classes = spark.range(n).selectExpr("concat('c', id) AS class_name", "cast(id AS int) AS class_id")
    assert [r["class_id"] for r in files.annotated_objects(a, classes)[0].collect()] == [n - 1]


def test_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from auditloom.session import shared_folder

    none = SimpleNamespace(isDefined=lambda: False)
    sc = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)), master="spark://head:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *a: None)))


def test_blind_sets(spark):
    good = spark.createDataFrame([("IP000000001", "a" * 64)] * 2, "source_image_id string, source_image_sha256 string")
    assert [x.count() for x in files.blind_sets(good)] == [1, 1]
    with pytest.raises(PySparkException):
        files.blind_sets(spark.createDataFrame([("IP1", "a" * 64)], good.schema))[0].collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None)], "k int, a string")
    sinks.write_jsonl(df, str(tmp_path / "j"), sort_keys=True)
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "j")).collect())
    assert lines == ['{"a":"b","k":2}', '{"a":null,"k":1}']
    with pytest.raises(PySparkException):
        sinks.write_jsonl(df, str(tmp_path / "j"), create_only=True)
    sinks.write_report(spark, str(tmp_path / "r.json"), {"b": 1, "a": 2})
    assert (tmp_path / "r.json").read_text().index('"a"') < (tmp_path / "r.json").read_text().index('"b"')
    with pytest.raises(FileExistsError):
        sinks.write_report(spark, str(tmp_path / "r.json"), {}, create_only=True)
    out = str(tmp_path / "bundle")
    sinks.publish(df, out)
    assert spark.read.parquet(f"{out}/data").count() == 2 and sinks.signature_breaks(spark, out).count() == 0
    (tmp_path / "bundle/.status.json.crc").unlink()
    (tmp_path / "bundle/status.json").write_text("changed")
    assert [tuple(r) for r in sinks.signature_breaks(spark, out).collect()] == [("status.json", "changed")]
    with pytest.raises(FileExistsError):
        sinks.publish(df, out)
    store = str(tmp_path / "store")
    for _ in range(2):
        sinks.store_content(spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "content string"), store)
    assert spark.read.parquet(store).count() == 2


def test_resume(spark, tmp_path):
    path = str(tmp_path / "pred")
    source = spark.range(10).withColumnRenamed("id", "k")
    make = lambda df: df.withColumn("answer", df.k * 2)
    assert sinks.append_pending(source.filter("k < 4"), path, "k", make) == {"existing": 0, "generated": 4, "total": 4}
    assert sinks.append_pending(source, path, "k", make) == {"existing": 4, "generated": 6, "total": 10}
    assert sinks.append_pending(source, path, "k", make)["generated"] == 0
    with pytest.raises(ValueError):
        sinks.append_pending(source.filter("k < 2"), path, "k", make)
    assert sinks.finalize(source, spark.read.parquet(path), "k").count() == 10
    with pytest.raises(PySparkException):
        sinks.finalize(spark.range(11).withColumnRenamed("id", "k"), spark.read.parquet(path), "k").collect()


def test_stream_resume(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    make = lambda df: df.withColumn("answer", df.k + 1)
    for upper in (5, 8):
        spark.range(upper).withColumnRenamed("id", "k").write.mode("append").parquet(src)
        resume.stream_pending(spark.readStream.schema("k long").parquet(src), out, "k", make, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == list(range(8))


def test_windowed_counts(spark):
    e = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS kind, 1.0 AS value UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a', 3.0 UNION ALL SELECT timestamp'2024-01-01 01:10:00', 'a', 5.0")
    assert sorted((r["n"], r["mean_value"]) for r in resume.windowed_counts(e, "ts", "kind").collect()) == [(1, 5.0), (2, 2.0)]
