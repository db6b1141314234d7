import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from granary.operators import images
from granary.plans import ingestion

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the stand-ins below go to the workers
LONG = "The committee of farmers may claim support for solar pumps, cold rooms and seed kits under the scheme in each of the villages near the road."


def pixels(text: str) -> bytes:
    return images.encoded(np.frombuffer(text.encode() + b"\x00\xff", np.uint8).reshape(1, -1))


def parse(content):
    if content == b"broken":
        raise ValueError
    return [(n, p if p.startswith("The") else "", "native", 0) for n, p in enumerate(content.decode().split("|"), 1)]


def render(content, n, dpi):
    page = content.decode().split("|")[n - 1]
    if page == "torn":
        raise OSError("torn")
    return pixels(page)


def read(image, config):
    text = images.decoded(image).tobytes()[:-2].decode("utf-8", "ignore")
    return text, {"--psm 6": 0.5, "--psm 11": 0.4, "--psm 4": 0.8}[config] + (0.4 if text.startswith("scan good") else 0.0)


def test_pages_of_every_kind(spark):
    good, poor = "scan good: " + LONG, "scan poor: " + LONG
    files = spark.createDataFrame([("x/a.pdf", bytearray(f"{LONG}|{good}|{poor}|torn| ".encode())), ("x/b.pdf", bytearray(b"broken"))], "path string, content binary")
    found = ingestion.extracted(files, parse, render, read)
    report = {(r.path[2:3], r.page_number): (r.status, r.retried) for r in found.report.collect()}
    assert report == {("a", 1): ("successful", False), ("a", 2): ("successful", False), ("a", 3): ("successful", True), ("a", 4): ("empty", False), ("a", 5): ("empty", True), ("b", None): ("failed", False)}
    pages = {r.page_number: (r.extraction_method, r.confidence) for r in found.pages.collect()}
    assert pages == {1: ("pymupdf_text", 1.0), 2: ("tesseract_ocr", 0.9), 3: ("tesseract_ocr_retry", 0.8)}
    lists = {r.path: (r.low, r.empty, r.retried, r.missing) for r in ingestion.page_lists(found.report).collect()}
    assert lists == {"x/a.pdf": ([], [4, 5], [3, 5], []), "x/b.pdf": ([], [], [], [])}


def test_from_files_to_an_index(spark):
    files = spark.createDataFrame([("x/a.pdf", bytearray(LONG.encode())), ("x/c.pdf", bytearray(LONG.encode()))], "path string, content binary")
    metadata = spark.createDataFrame([("a", "doc-a")], "stem string, document_id string")
    _, parents, children, index = ingestion.ingested(files, metadata, parse, render, read, lambda d, _: d)
    assert [(r.document_id, r.page_number) for r in parents.collect()] == [("doc-a", 1)]
    child = children.collect()[0]
    assert child.page_content.endswith(LONG) and index.postings.where("term = 'pumps'").first().doc == child.chunk_id


def test_no_files(spark):
    found = ingestion.extracted(spark.createDataFrame([], "path string, content binary"), parse, render, read)
    assert found.pages.count() == found.report.count() == ingestion.page_lists(found.report).count() == 0


def test_modes_of_both_rounds():
    assert ingestion.PRIMARY == [("original", "--psm 6"), ("original", "--psm 11")] and len(ingestion.RETRY) == 9
    assert {k for k, _ in ingestion.RETRY} == set(images.VARIANTS)


def test_variants_of_an_image():
    rng = np.random.default_rng(3)
    colour = rng.integers(40, 200, (9, 7, 3)).astype(np.uint8)
    grey = images.decoded(images.preprocessed(images.encoded(colour), "grayscale"))
    assert np.array_equal(grey, np.rint(colour @ np.array([0.299, 0.587, 0.114])).astype(np.uint8))
    wide = images.stretched(grey)
    assert wide.min() == 0 and wide.max() == 255
    sharp, level = images.sharpened(wide).astype(int), wide.astype(float)
    goal = (32 * level[4, 3] - 2 * (level[3:6, 2:5].sum() - level[4, 3])) / 16
    assert sharp[4, 3] == np.clip(np.rint(goal), 0, 255) and np.array_equal(sharp[0], wide[0])
    assert set(np.unique(images.decoded(images.preprocessed(images.encoded(colour), "threshold")))) <= {0, 255}
    even = np.full((4, 4), 9, np.uint8)
    assert np.array_equal(images.decoded(images.preprocessed(images.encoded(even), "enhanced")), even)
    for bad in (b"", b"GIF89a", b"P5\n3 1\n65535\nabc"):
        with pytest.raises(ValueError):
            images.decoded(bad)
    assert images.preprocessed(b"anything", "original") == b"anything"


def test_pages_that_a_file_lacks(spark):
    files = spark.createDataFrame([("a", bytearray(b"one|two"))], "path string, content binary")
    wanted = spark.createDataFrame([("a", 0), ("a", 2), ("a", 9)], "path string, page_number int")
    rows = ingestion.rendered(files, wanted, render).orderBy("page_number").select("page_number", F.col("image").isNull().alias("none"), "error").collect()
    assert [(r.page_number, r.none) for r in rows] == [(0, True), (2, False), (9, True)] and rows[0].error == "IndexError: no page 0"
