import json

import pytest
from pyspark.sql import functions as F

from granary.sources import io
from granary.streaming.memory import histories


def chunks(spark):
    return spark.createDataFrame([("text é", "d1", 1, "p1", "c1", "child"), (None, "d2", 2, None, "c2", "child")], "page_content string, document_id string, page_number int, parent_id string, chunk_id string, chunk_type string")


def test_documents(spark, tmp_path):
    path = io.write_documents(chunks(spark), str(tmp_path / "docs"))
    back = io.read_documents(spark, path).orderBy("chunk_id").collect()
    assert [(r.page_content, r.document_id, r.parent_id) for r in back] == [("text é", "d1", "p1"), ("", "d2", None)]
    (tmp_path / "array.json").write_text(json.dumps([{"page_content": "a", "metadata": {"chunk_id": "c", "page_number": 3}}, {"metadata": {}}], indent=2))
    assert [(r.page_content, r.page_number) for r in io.read_documents(spark, str(tmp_path / "array.json")).collect()] == [("a", 3), ("", None)]
    with pytest.raises(FileNotFoundError):
        io.read_documents(spark, str(tmp_path / "none.json"))
    with pytest.raises(ValueError):
        io.write_documents(chunks(spark).limit(0), str(tmp_path / "x"))


def test_many_documents_in_one_file(spark, tmp_path):
    rows = spark.createDataFrame([(f"text {i}", f"d{i}") for i in range(50)], "page_content string, document_id string").coalesce(1)
    path = io.write_documents(rows, str(tmp_path / "docs"))
    assert io.read_documents(spark, path).count() == 50


def test_dumps(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"{i}_chunks.json").write_text(json.dumps({"parents": [{"page_content": f"p{i}", "metadata": {"parent_id": f"p{i}"}}], **({"children": [{"page_content": f"c{i}", "metadata": {"chunk_index": i}}]} if i else {})}))
    pattern = str(tmp_path / "*_chunks.json")
    assert [r.page_content for r in io.read_chunk_dumps(spark, pattern).collect()] == ["c1"] and io.read_chunk_dumps(spark, pattern, "parents").count() == 2
    path = io.write_dumps(chunks(spark), chunks(spark), str(tmp_path / "out"))
    assert io.read_chunk_dumps(spark, f"{path}/*/*.json").count() == 2


def test_metadata(spark, tmp_path):
    (tmp_path / "Tea & Co_metadata.json").write_text(json.dumps({"document_id": "t", "publication_date": "YYYY-MM-DD"}))
    meta = io.read_metadata(spark, str(tmp_path / "*_metadata.json"))
    assert (meta.first().stem, meta.first().applicable_scope) == ("Tea & Co", "India")
    found, missing = io.with_metadata(spark.createDataFrame([("Tea & Co",), ("Other",)], "stem string"), meta)
    assert found.count() == 1 and [r.stem for r in missing.collect()] == ["Other"]


def test_page_texts(spark, tmp_path):
    pages = spark.createDataFrame([("d", 2, "second\nline", "ocr"), ("d", 1, "first", "pymupdf"), ("d", 3, " ", None)], "document_id string, page_number int, text string, extraction_method string")
    path = io.write_texts(pages, str(tmp_path / "texts"))
    back = io.read_pages(spark, f"{path}/*/*.txt").orderBy("page_number").collect()
    assert [(r.page_number, r.extraction_method, r.text) for r in back] == [(1, "pymupdf", "first"), (2, "ocr", "second\nline"), (3, None, "")]
    assert io.full_text(pages).first().text == "first\n\nsecond\nline"


def test_files_and_vectors(spark, tmp_path):
    (tmp_path / "b.pdf").write_bytes(b"two pages")
    (tmp_path / "a.pdf").write_bytes(b"bad")
    files = io.discover(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in files.select("path").collect()] == ["a.pdf", "b.pdf"]

    def parse(content):
        if content == b"bad":
            raise ValueError
        return [(i + 1, w, "native", 0) for i, w in enumerate(content.decode().split())]

    rows = io.parsed(files, parse).collect()
    assert sorted((r.page_number or 0, r.text, r.extraction_method) for r in rows) == [(0, None, "failed"), (1, "two", "native"), (2, "pages", "native")]
    with pytest.raises(FileNotFoundError):
        io.discover(spark, str(tmp_path), "*.docx")
    path = io.write_vectors(chunks(spark), lambda c: F.array(F.length(c).cast("float")), str(tmp_path / "vectors"))
    assert io.read_vectors(spark, path).count() == 2
    with pytest.raises(FileNotFoundError):
        io.read_vectors(spark, str(tmp_path / "gone"))


def test_memory_stream_equals_the_batch(spark, tmp_path):
    rows = [("s", i, "user" if i % 2 else "assistant", f"m{i}") for i in range(1, 11)] + [("t", 1, "system", None)]
    schema = "session_id string, seq long, role string, content string"
    for n, part in enumerate((rows[:4], rows[3:8] + rows[10:], rows[8:10])):  # one message comes twice
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    seen = {}

    def keep(batch, _):
        seen.update({r.session_id: (r.messages, r.history) for r in batch.collect()})

    histories(stream, 2).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert seen == {"s": (4, "User: m7\nAssistant: m8\nUser: m9\nAssistant: m10"), "t": (1, "No previous conversation.")}


def test_idle_sessions_are_forgotten(spark, tmp_path):
    from pyspark.testing.utils import eventually

    schema = "session_id string, seq long, role string, content string"
    spark.createDataFrame([("s", 1, "user", "m")], schema).write.parquet(str(tmp_path / "in" / "0"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
    query = histories(stream, 2, idle_hours=1e-6).writeStream.format("memory").queryName("idle").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        eventually(timeout=60, catch_assertions=True)(lambda: bool(query.lastProgress and query.lastProgress.stateOperators[0].numRowsRemoved + sum(p.stateOperators[0].numRowsRemoved for p in query.recentProgress if p.stateOperators)))()
    finally:
        query.stop()
