"""Page text and boxes to questions, against pages written out by hand."""

import pytest

from questmill.operators import structure


def found(spark, *texts):
    pages = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = structure.structured(pages).orderBy("doc_id", "ord").collect()
    return [[(r.number, r.section, r.instructions, r.body) for r in rows if r.doc_id == k] for k in range(len(texts))]


PAGES = {
    # Sections and directions; a range holds whatever the order of the numbers, and ends with a section.
    "Section B\n11. Pick the even number. (a) 3 (b) 5\nDIRECTIONS (12-13): Choose the word\nthat fits.\n15. Later\n12. The ____ rose.\n(a) sun\n(b) son\nSection C\n13. Next": [
        ("11", "B", "Section B", "Pick the even number. (a) 3 (b) 5"),
        ("15", "B", "Section B", "Later"),
        ("12", "B", "DIRECTIONS (12-13): Choose the word that fits.", "The ____ rose. (a) sun (b) son"),
        ("13", "C", "Section C", "Next"),
    ],
    # Directions without a range hold on; a header behind a header takes its place; one glued to a choice is cut off.
    "Instructions: old\nDirections: new\n1. One (a) x (b) y DIRECTIONS (2-3): Go on. 2. Two\n4. Four": [
        ("1", None, "Directions: new", "One (a) x (b) y"),
        ("2", None, "DIRECTIONS (2-3): Go on.", "Two"),
        ("4", None, None, "Four"),
    ],
    # Numbers printed ahead of their texts, in order; one that is left over goes to the text below a section.
    "Read all.\n1.\n2.\n(3)\nFirst body\nand more\n4\nSecond body\nSection D\nThird body\nSection E\nFourth body\nSection F\nNo number left": [
        ("1", None, "Read all.", "First body and more"),
        ("2", None, "Read all.", "Second body"),
        ("3", "D", "Section D", "Third body"),
        ("4", "E", "Section E", "Fourth body"),
    ],
    # A stem behind two choices begins a question; a wrapped choice in lower case does not; a null number is outside a range.
    "DIRECTIONS (86-90): Tick.\n86. ______ is the smallest bone.\n(a) Rib (b) Scapula\n(c) Stapes (d) Coxal\nbone of the hip\nThe largest lake is ______.\n(a) Baikal (b) Victoria\nShort one": [
        ("86", None, "DIRECTIONS (86-90): Tick.", "______ is the smallest bone. (a) Rib (b) Scapula (c) Stapes (d) Coxal bone of the hip"),
        (None, None, None, "The largest lake is ______. (a) Baikal (b) Victoria Short one"),
    ],
    # A stray line behind a section is no heading once there are questions, and is before.
    "Section A\nAnswer all.\n1. One\nSection B\nstray\n2. Two": [("1", "A", "Section A Answer all.", "One"), ("2", "B", "Section B", "Two")],
    # Without numbers: by choices.
    "DIRECTIONS (1-5): Put in order.\nhe/the books/held on to\n(a) He held on\nto the books.\n(b) The books held.\nthe police/sprayed/tear gas\n(a) One.\n(b) Two.\nLonely line.\n(a) only one": [
        ("1", None, "DIRECTIONS (1-5): Put in order.", "he/the books/held on to (a) He held on to the books. (b) The books held."),
        ("2", None, "DIRECTIONS (1-5): Put in order.", "the police/sprayed/tear gas (a) One. (b) Two."),
    ],
    # Choices first; a stem goes on over lines; a lower-case line behind an unfinished choice belongs to it.
    "(a) x\n(b) y\nWhich of these is the longer one\nof the two?\n(a) red\n(b) blue or\ngreen (c) none\nNow the next stem stands here\n(a) p\n(b) q": [
        ("1", None, None, "(a) x (b) y"),
        ("2", None, None, "Which of these is the longer one of the two? (a) red (b) blue or green (c) none"),
        ("3", None, None, "Now the next stem stands here (a) p (b) q"),
    ],
    "no questions here\nat all": [],
    "": [],
    None: [],
    "7.": [],
}


def test_structured(spark):
    got = found(spark, *PAGES)
    for want, rows in zip(PAGES.values(), got, strict=True):
        assert rows == want


def test_structured_of_a_long_page(spark):
    text = "\n".join(f"{k % 999 + 1}. Stem {k}\n(a) yes (b) no\nA further stem, number {k}\n(a) x (b) y" for k in range(3000))
    (rows,) = found(spark, text)
    assert len(rows) == 6000 and rows[-1] == (None, None, None, "A further stem, number 2999 (a) x (b) y")
    assert structure.structured(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_reading_order(spark):
    boxes = [(1, 0, 0.1, 0.10, 0.02), (1, 1, 0.5, 0.105, 0.02), (1, 2, 0.3, 0.20, 0.02), (1, 3, 0.05, 0.201, 0.02), (1, 4, 0.1, 0.26, 0.02), (2, 0, 0.1, 0.5, 0.02)]
    frame = spark.createDataFrame(boxes, "page long, ord long, x double, y double, h double")
    got = {(r.page, r.ord): (r.row, r.place) for r in structure.reading_order(frame).collect()}
    assert got == {(1, 0): (0, 0), (1, 1): (0, 1), (1, 3): (1, 0), (1, 2): (1, 1), (1, 4): (2, 0), (2, 0): (0, 0)}


def test_structured_makes_its_runs_once(spark):
    """Pages with questions are read once: what follows reads the runs that were kept."""
    pages = spark.createDataFrame([(1, "1. What is this thing?\n2. And what is that one?"), (2, "no question"), (3, None)], "doc_id long, text string")
    found = structure.structured(pages)
    assert any("runs-" in f for f in found.inputFiles())
    assert [(r.doc_id, r.number) for r in found.orderBy("doc_id", "ord").collect()] == [(1, "1"), (1, "2")]
