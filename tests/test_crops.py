"""Cropped questions in all eight layouts against readings written out by hand."""

from pyspark.sql import functions as F

from questmill.operators import crops

CROPS = [
    # doc_id, layout, given number, text
    (1, "parentheses", "4", "12. Which is red?\n(a) sky;  (b) rose, (c) grass. (d)  "),
    (2, "letters", "9", "Pick one A. tin B) iron\nC. A. lead"),
    (3, "true_false", None, "(7) The sun is cold. (a) True (b) False"),
    (4, "assertion_reason", None, "3) Assertion (A): Ice floats.\nReason (R): It is light. (a) both (b) A only"),
    (5, "assertion_reason", None, "No such words (a) x (b) y"),
    (6, "fill_blank", None, "5. The __ sat on\n the _______ mat _ today"),
    (7, "match", "2", "Match rivers\nGanga\tnorth\n  Kaveri   south \none two three\nlast  a  b"),
    (8, "match", None, "a\tb\nc  d"),
    (9, "jumble", None, "the /  cat \t/ sat (a) 1-2-3 (b) 3-2-1"),
    (10, "jumble", None, "the / cat / sat"),
    (11, "plain", None, "Calculate   the sum (a) of\nall"),
    (12, "unknown", None, "x (a) p (a) q (B) r (a) s (h) t (a) u (a) v (a) w (a) z"),
    (13, None, None, "Tick. A. one B. two"),
    (14, None, None, "Go to the ____ now"),
    (15, None, None, "Is it so? (a) True (b) False"),
    (16, "parentheses", None, "Only one (a) choice"),
    (17, "parentheses", None, "What? (a) p (b) q\nDirections (5-7): Read on. (c) r"),
    (18, "plain", None, " \n "),
    (19, "plain", None, None),
    (20, "parentheses", None, "8.  "),
    (21, None, None, "x/y/z q/r (a) 1 (b) 2"),
    (22, None, None, "plain words"),
]
WANT = {
    1: ("12", "mcq", "Which is red?", "A=sky|B=rose|C=grass", 0, "", None, None),
    2: ("9", "mcq", "Pick one", "A=tin|B=iron|C=A. lead", 0, "", None, None),
    3: ("7", "true_false", "The sun is cold.", "A=True|B=False", 0, "", None, None),
    4: ("3", "assertion_reason", "Ice floats.", "A=both|B=A only", 0, "", "Ice floats.", "It is light."),
    5: (None, "assertion_reason", "No such words", "A=x|B=y", 0, "", None, None),
    6: ("5", "fill_blank", "The ____ sat on the ____ mat _ today", "", 2, "", None, None),
    7: ("2", "match_the_following", "Match rivers one two three last a b", "", 0, "Ganga>north|Kaveri>south", None, None),
    8: (None, "match_the_following", "Match the following.", "", 0, "a>b|c>d", None, None),
    9: (None, "mcq", "the / cat / sat", "A=1-2-3|B=3-2-1", 0, "", None, None),
    10: (None, "short_answer", "the / cat / sat", "", 0, "", None, None),
    11: (None, "numerical", "Calculate the sum (a) of all", "", 0, "", None, None),
    12: (None, "mcq", "x", "A=p|B=q|C=r|D=s|H=t|E=u|F=v|G=w|A=z", 0, "", None, None),
    13: (None, "mcq", "Tick.", "A=one|B=two", 0, "", None, None),
    14: (None, "fill_blank", "Go to the ____ now", "", 1, "", None, None),
    15: (None, "true_false", "Is it so?", "A=True|B=False", 0, "", None, None),
    16: (None, "short_answer", "Only one (a) choice", "", 0, "", None, None),
    17: (None, "mcq", "What?", "A=p|B=q", 0, "", None, None),
    20: (None, "short_answer", "8.", "", 0, "", None, None),
    21: (None, "mcq", "x/y/z q/r", "A=1|B=2", 0, "", None, None),
    22: (None, "short_answer", "plain words", "", 0, "", None, None),
}


def test_all_layouts(spark):
    table = spark.createDataFrame([(i, x, t, n) for i, x, n, t in CROPS], "doc_id long, layout string, text string, number string").withColumn("stem", F.lit("own"))
    got = {
        r.doc_id: (r.number, r.type, r.stem, "|".join(f"{o.key}={o.text}" for o in r.options), r.blanks, "|".join(f"{p.left}>{p.right}" for p in r.pairs), r.assertion, r.reason)
        for r in crops.read_crops(table).collect()
    }
    assert got == WANT


def test_apply_reading(spark):
    option, part = "array<struct<key:string,text:string,image_path:string>>", "array<struct<stem:string>>"
    fields = f"""id string, page int, number string, type string, stem string, instructions string, passage string, assertion string, reason string, options {option},
      answer_keys array<string>, answer_text string, figures array<string>, sub_questions {part}, confidence double, approved boolean, approval_status string, hint string, explanation string"""
    old = ("q1", 3, "7", "mcq", "old", "do", None, None, None, [("A", "x", "a.png")], ["A"], None, ["f1"], [("s",)], 0.9, True, "published", "hint", "why")
    new = ("zz", 9, " ", "mcq", "new", None, "pass", None, None, [("A", "y", "b.png")], [], "t", ["f2"], [("n",)], None, False, None, "h", "e")
    comprehension = ("zz", 9, "8", "comprehension", "new", None, None, None, None, [], [], None, [], [], 0.5, False, None, None, None)
    rows = [(1, old, new, False), (2, old, new, True), (3, old, comprehension, False)]
    table = spark.createDataFrame(rows, f"k int, current struct<{fields.replace(' string', ':string').replace(' int', ':int').replace(' double', ':double').replace(' boolean', ':boolean').replace(' array', ':array')}>, reading struct<{fields.replace(' string', ':string').replace(' int', ':int').replace(' double', ':double').replace(' boolean', ':boolean').replace(' array', ':array')}>, graphics boolean")
    got = {r.k: r.q for r in table.select("k", crops.apply_reading(F.col("current"), F.col("reading"), F.col("graphics")).alias("q")).collect()}
    one, two, three = got[1], got[2], got[3]
    assert (one.id, one.page, one.number, one.stem, one.passage, one.confidence, one.approved, one.hint, one.explanation, one.approval_status) == ("q1", 3, "7", "new", "pass", 0.9, False, None, None, None)
    assert [tuple(o) for o in one.options] == [("A", "y", None)] and one.figures == [] and one.sub_questions == []
    assert [tuple(o) for o in two.options] == [("A", "y", "b.png")] and two.figures == ["f2"]
    assert three.number == "8" and [tuple(p) for p in three.sub_questions] == [("s",)] and three.confidence == 0.5


def test_decorate(spark):
    from questmill.operators import figures

    option = "array<struct<key:string,text:string,is_correct:boolean>>"
    four = [(k, k.lower(), k == "B") for k in "ABCD"]
    asked = [
        (1, 0, "1", "mcq", "Look. Question Figure:", [("A", "long text", None)], []), (1, 1, "Q 2", "mcq", "ANSWER FIGURES", four, []), (1, 2, "9", "mcq", "none", four, []),
        (2, 0, None, "mcq", "One row", four, []), (3, 0, "1", "mcq", "Three are no options", [], []), (4, 0, "1", "mcq", "has one", four, [("d", None, None, 0.1, 0.1, 0.1, 0.1)]),
        (5, 0, "1", "mcq", "question figure", [], []),
    ]
    drawn = [(1, 10, 0.1, 0.10, 0.1, 0.05), (1, 11, 0.3, 0.11, 0.1, 0.05), (1, 12, 0.6, 0.1, 0.1, 0.05)]
    drawn += [(1, 20, 0.1, 0.5, 0.1, 0.05), (1, 23, 0.30, 0.7, 0.1, 0.05), (1, 21, 0.02, 0.71, 0.1, 0.05), (1, 22, 0.2, 0.72, 0.1, 0.05)]
    drawn += [(2, k, 0.1 * k, 0.3, 0.05, 0.05) for k in range(5)] + [(3, k, 0.1 * k, 0.3, 0.05, 0.05) for k in range(3)] + [(4, 1, 0.1, 0.3, 0.1, 0.1), (5, 1, None, None, None, None)]
    lines = [(1, 0, "1. first", 0.0, 0.09, 0.4), (1, 1, " 02) second", 0.0, 0.4, 0.4), (1, 2, "7. unknown", 0.0, 0.6, 0.4), (1, 3, "no number", 0.6, 0.0, 0.2)]
    q = spark.createDataFrame(asked, f"page long, ord long, number string, type string, stem string, options {option}, figures array<{figures.FIGURE}>").withColumn("key", F.lit("own"))
    f = spark.createDataFrame(drawn, "page long, id long, x double, y double, w double, h double")
    n = spark.createDataFrame(lines, "page long, ord long, text string, x double, y double, w double")
    got = {(r.page, r.ord): r for r in figures.decorate(q, f, n).collect()}
    roles = lambda r: [(x.role[0], x.caption, x.x) for x in r.figures]
    # The right half has no number, so figure 12 goes by the whole page; three in one row are no options.
    assert roles(got[1, 0]) == [("q", None, 0.1), ("q", None, 0.3), ("q", None, 0.6)] and got[1, 0].stem == "Look. :" and got[1, 0].type == "diagram"
    # The lower, longer row holds the options, from the left; choices that are but labels are cut to them.
    assert roles(got[1, 1]) == [("q", None, 0.1), ("o", "A", 0.02), ("o", "B", 0.2), ("o", "C", 0.3)]
    assert [tuple(o) for o in got[1, 1].options] == [("A", "a", False), ("B", "b", True), ("C", "c", False)] and got[1, 1].stem == "ANSWER FIGURES"
    assert got[1, 2].figures == [] and got[1, 2].type == "mcq" and len(got[1, 2].options) == 4
    assert [o.key for o in got[2, 0].options] == list("ABCDE") and got[2, 0].options[4].text == ""
    assert got[3, 0].options == [] and len(got[3, 0].figures) == 3
    assert len(got[4, 0].figures) == 1 and got[4, 0].type == "mcq" and got[5, 0].type == "mcq"
    assert got[1, 0].key == "own" and len(got) == 7


def test_decorate_streams_pages(spark):
    """A figure without height keeps the rows after it; numbers at one height, pages of many figures and the plan: no windows, no folds over growing arrays."""
    from questmill.operators import figures

    option = "array<struct<key:string,text:string,is_correct:boolean>>"
    asked = [(1, k, str(k), "mcq", "s", [], []) for k in (1, 2)] + [(2, 5, None, "mcq", "s", [], []), (3, 1, "1", "mcq", "s", [], []), (None, 1, "1", "mcq", "s", [], [])]
    drawn = [(1, 1, 0.6, 0.5, 0.1, 0.05), (1, 2, 0.1, 0.9, 0.1, None)] + [(2, k, 0.2 * k, 0.3, 0.1, None if k == 0 else 0.05) for k in range(4)]
    drawn += [(3, k, 0.0, 0.1 * k, 0.1, 0.05) for k in range(20_000)] + [(None, 1, 0.1, 0.1, 0.1, 0.1), (4, 1, 0.1, 0.1, 0.1, 0.1)]
    q = spark.createDataFrame(asked, f"page int, ord int, number string, type string, stem string, options {option}, figures array<{figures.FIGURE}>")
    f = spark.createDataFrame(drawn, "page long, id long, x double, y double, w double, h double")
    n = spark.createDataFrame([(1, 2, "2. b", 0.6, 0.4, 0.1), (1, 1, "1. a", 0.6, 0.4, 0.1), (1, 3, "3. c", 0.1, 0.1, 0.1)], "page long, ord long, text string, x double, y double, w double")
    done = figures.decorate(q, f, n)
    got = {(r.page, r.ord): r for r in done.collect()}
    assert [len(got[k].figures) for k in ((1, 1), (1, 2), (2, 5), (3, 1), (None, 1))] == [1, 0, 4, 20_000, 0]
    assert [o.key for o in got[2, 5].options] == list("ABCD") and got[3, 1].options == [] and [x.y for x in got[3, 1].figures] == [0.1 * k for k in range(20_000)]
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "aggregate(" not in plan
