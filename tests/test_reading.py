"""Reader blocks, crops and pages to questions, against cases written out by hand; figures and the file walk too."""

from pyspark.sql import functions as F

from questmill.operators import figures, reading
from questmill.plans.figure_queries import QUERIES


def test_from_blocks(spark):
    blocks = [(1, 0, "text", "4. Solve", None), (1, 1, "formula", "x", " x^2 = 4 "), (1, 2, "figure", "7. not text", None), (2, 0, "text", "no number", None), (2, 1, "formula", " y ", None), (3, 0, "figure", "only", None), (4, 0, "text", "  ", None)]
    got = reading.from_blocks(spark.createDataFrame(blocks, "doc_id long, ord int, type string, text string, latex string")).collect()
    assert {(r.doc_id, r.number, r.body) for r in got} == {(1, "4", "Solve $x^2 = 4$"), (2, None, "no number $y$")}


def test_from_crops(spark):
    crops = [(1, "12. Which is red?\n(a) sky (b) rose", None), (2, "Which is red?", "7"), (3, "1. One\n2. Two", "1"), (4, " ", "3"), (5, "no number at all", None), (6, "3", "9")]
    got = reading.from_crops(spark.createDataFrame(crops, "doc_id long, text string, number string")).collect()
    assert {(r.doc_id, r.number, r.body) for r in got} == {(1, "12", "Which is red? (a) sky (b) rose"), (2, "7", "Which is red?"), (6, "9", "3")}


def test_release_swallowed(spark):
    rows = [(1, 0, "What is two and two? How far is the moon from here?", False), (1, 1, "How far is the moon from here?", True), (1, 2, "How far is the moon from here?", False), (1, 3, "short", True), (2, 0, "How far is the moon from here?", False)]
    got = reading.release_swallowed(spark.createDataFrame(rows, "doc_id long, ord int, stem string, extra boolean")).collect()
    assert {(r.doc_id, r.ord): r.stem for r in got} == {(1, 0): "What is two and two?", (1, 1): rows[1][2], (1, 2): rows[2][2], (1, 3): "short", (2, 0): rows[4][2]}


def test_clean_pages(spark):
    pages = spark.createDataFrame([(1, "1. A stem of the page\n2. Another stem", True), (2, "1. A stem of the page", True), (3, "nothing here", False), (4, "nothing", False), (5, "1. A stem of the page", False)], "doc_id long, text string, smashed boolean")
    modeled = spark.createDataFrame([(1, 0, "1", "model's own stem"), (2, 0, "1", "model's own stem"), (3, 0, None, "model's own stem"), (4, 0, None, "short"), (5, 0, "1", "model's own stem")], "doc_id long, ord int, number string, body string")
    got = reading.clean_pages(pages, modeled, F.col("smashed")).collect()
    assert sorted((r.doc_id, r.source) for r in got) == [(1, "split"), (1, "split"), (2, "model"), (3, "model"), (5, "split")]


def test_figures(spark):
    boxes = spark.createDataFrame([(1, 1, 0.1, 0.10, 0.1), (1, 2, 0.1, 0.40, 0.1), (1, 3, 0.4, 0.41, 0.1), (2, 4, 0.1, 0.1, 0.1), (3, 5, 0.1, 0.1, 0.1), (3, 6, 0.3, 0.1, 0.1), (3, 7, 0.5, 0.1, 0.1), (3, 8, 0.7, 0.1, 0.1)], "page long, id long, x double, y double, h double")
    got = {r.id: (r.row, r.part) for r in figures.split_figures(figures.figure_rows(boxes)).collect()}
    assert got == {1: (0, "question"), 2: (1, "option"), 3: (1, "option"), 4: (0, "question"), **{k: (0, "option") for k in (5, 6, 7, 8)}}


def test_file_walk(spark):
    found = {r.path.rsplit("/", 2)[-1] for r in QUERIES["src_file_walk"](spark, "/root/testdata/sf0.001").collect()}
    assert {"region.parquet", "documents.parquet", "pages.parquet"} <= found
