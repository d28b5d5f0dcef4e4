"""Reading order and stacked fractions of pages written by hand, and the matching against a plain one."""

import random

import numpy as np

from questmill.operators import page_text


def test_page_texts(spark):
    line = lambda page, ord_, text, x, y, w=0.3, h=0.02: (page, ord_, text, x, y, w, h)
    lines = [
        # Two columns of numbers: the left side first, choices of one row from the left.
        line(1, 0, "3. Upper right", 0.55, 0.1), line(1, 1, "1. Upper left", 0.05, 0.1), line(1, 2, "4. Lower right", 0.55, 0.5), line(1, 3, "2. Lower left", 0.06, 0.5),
        line(1, 4, "(b) two", 0.2, 0.205, 0.1), line(1, 5, "(a) one", 0.05, 0.2, 0.1), line(1, 6, "(c)  three", 0.56, 0.2, 0.1), line(1, 7, "  ", 0.1, 0.3), line(1, 8, "no width", 0.1, 0.3, 0.0),
        # Three numbers make no columns; a number in the margin joins its stem.
        line(2, 0, "7", 0.02, 0.1, 0.02), line(2, 1, "stem beside", 0.1, 0.102), line(2, 2, "rest", 0.5, 0.101), line(2, 3, "(8)", 0.02, 0.3, 0.03), line(2, 4, "9.", 0.02, 0.5), line(2, 5, "10) x", 0.6, 0.7),
        # A row widens with its members; a gap of less than a column's keeps one column.
        line(3, 0, "1. a", 0.1, 0.10, h=0.02), line(3, 1, "b", 0.5, 0.11, h=0.03), line(3, 2, "c", 0.7, 0.135, h=0.02), line(3, 3, "2. d", 0.25, 0.3), line(3, 4, "3. e", 0.1, 0.4), line(3, 5, "4. f", 0.26, 0.5),
        line(4, 0, " ", 0.1, 0.1),
    ]
    got = {r.page: r.text for r in page_text.page_texts(spark.createDataFrame(lines, "page long, ord long, text string, x double, y double, w double, h double")).collect()}
    assert got == {
        1: "1. Upper left\n(a) one (b) two\n2. Lower left\n3. Upper right\n(c) three\n4. Lower right",
        2: "7. stem beside rest\n(8)\n9.\n10) x",
        3: "1. a b c\n2. d\n3. e\n4. f",
    }


def test_page_texts_of_a_long_page_and_lines_without_a_place(spark):
    """No line is lost behind one without a place, and a page of many rows takes time in proportion to them."""
    schema = "page long, ord long, text string, x double, y double, w double, h double"
    odd = [(1, 0, "nowhere", 0.1, None, 0.1, 0.02), (1, 1, "below", 0.1, 0.5, 0.1, 0.02), (1, 2, "\u00a0beside\u2003", None, 0.5, 0.1, 0.02), (1, 3, None, 0.1, 0.1, 0.1, 0.1)]
    long_ = [(2, i, f"line {i}", 0.1, float(i), 0.1, 0.02) for i in range(20_000)]
    found = page_text.page_texts(spark.createDataFrame(odd + long_, schema))
    assert {r.page: r.text for r in found.collect()} == {1: "nowhere\nbeside below", 2: "\n".join(f"line {i}" for i in range(20_000))}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


PAGES = {
    "alone": ([("5", 0.3, 0.2, 0.02, 0.02), ("8", 0.3, 0.23, 0.02, 0.02)], r"$\frac{5}{8}$"),
    "mixed": ([("4", 0.2, 0.21, 0.02, 0.03), ("1", 0.24, 0.2, 0.015, 0.018), ("6", 0.24, 0.225, 0.015, 0.018)], r"$4\frac{1}{6}$"),
    "choices": (
        [("(b)", 0.05, 0.315, 0.03, 0.02), ("3", 0.1, 0.3, 0.015, 0.018), ("7", 0.1, 0.325, 0.015, 0.018), ("1", 0.16, 0.3, 0.015, 0.018), ("9", 0.16, 0.325, 0.015, 0.018), ("0.25", 0.21, 0.312, 0.03, 0.02)],
        r"(b) $\frac{3}{7}$ $\frac{1}{9}$ 0.25",
    ),
    "numbers of questions": ([("12", 0.04, 0.10, 0.04, 0.02), ("Name", 0.09, 0.10, 0.08, 0.02), ("13", 0.04, 0.13, 0.04, 0.02), ("Find", 0.09, 0.13, 0.08, 0.02)], None),
    "digit in a sentence": ([("has", 0.3, 0.1, 0.04, 0.02), ("4", 0.36, 0.1, 0.02, 0.02), ("legs", 0.4, 0.1, 0.05, 0.02), ("88", 0.355, 0.13, 0.04, 0.02)], None),
    # The first numerator leans on prose; without it the second has a word beside it too.
    "chain": (
        [("is", 0.10, 0.1, 0.03, 0.02), ("1", 0.14, 0.1, 0.02, 0.02), ("2", 0.14, 0.13, 0.02, 0.02), ("3", 0.18, 0.1, 0.02, 0.02), ("4", 0.18, 0.13, 0.02, 0.02), ("5", 0.6, 0.1, 0.02, 0.02), ("6", 0.6, 0.13, 0.02, 0.02)],
        "is 1 3\n2 4 $\\frac{5}{6}$",
    ),
    "brackets": ([("(", 0.1, 0.126, 0.01, 0.02), ("1", 0.12, 0.1, 0.02, 0.02), ("2", 0.12, 0.126, 0.02, 0.02), (")", 0.15, 0.126, 0.01, 0.02), (".", 0.17, 0.126, 0.01, 0.02)], r"($\frac{1}{2}$)."),
    "blank": ([(" ", 0.1, 0.1, 0.1, 0.1)], None),
    "no numbers": ([("two", 0.1, 0.1, 0.1, 0.1), ("words", 0.1, 0.2, 0.1, 0.1)], None),
}


def test_stacked_fractions(spark):
    words = [(i, k, *w) for i, (ws, _) in enumerate(PAGES.values()) for k, w in enumerate(ws)] + [(99, 0, None, 0.1, 0.1, 0.1, 0.1)]
    got = {r.page: (r.text, r.fractions) for r in page_text.stacked_fractions(spark.createDataFrame(words, "page long, ord long, text string, x double, y double, w double, h double")).collect()}
    assert {name: got[i][0] for i, name in enumerate(PAGES)} == {name: want for name, (_, want) in PAGES.items()}
    assert [tuple(f) for f in got[1][1]] == [("1", "6", "4")] and got[99] == (None, [])


def test_pairs_equal_a_plain_matching():
    r = random.Random(4)
    for _ in range(60):
        n = r.randrange(2, 40)
        x, y = np.array([r.random() * 0.15 for _ in range(n)]), np.array([r.random() * 0.3 for _ in range(n)])
        w, h = np.array([r.uniform(0.01, 0.05) for _ in range(n)]), np.array([r.uniform(0.01, 0.03) for _ in range(n)])
        integers = np.array([i for i in range(n) if r.random() < 0.7], int)
        near = []
        for a in integers.tolist():
            for b in integers.tolist():
                gap, dx, dy, low = y[b] - (y[a] + h[a]), abs(x[a] + w[a] / 2 - (x[b] + w[b] / 2)), y[b] + h[b] / 2 - (y[a] + h[a] / 2), min(h[a], h[b])
                if a != b and dx <= max(min(w[a], w[b]) * 0.8, 0.012) and -0.6 * h[b] <= gap <= 0.8 * low and 0.35 * low <= dy <= 2.2 * low:
                    near.append((max(gap, 0) + 2 * dx, a, b))
        want, used = [], set()
        for _, a, b in sorted(near):
            if not {a, b} & used:
                used |= {a, b}
                want.append((a, b))
        assert page_text.stacked(x, y, w, h, integers) == want
        # Dropping one by one until nothing changes comes to the same.
        kept = list(want)
        changed = True
        while changed:
            changed = False
            tops = {a for a, _ in kept}
            for p in list(kept):
                a = p[0]
                for gap in (x[a] - (x + w), x - (x[a] + w[a])):
                    level = [k for k in range(n) if k != a and abs(y[k] + h[k] / 2 - y[a] - h[a] / 2) <= max(h[k], h[a], 0.012) * 1.2 and gap[k] >= -0.008]
                    if level:
                        k = min(level, key=lambda k: (gap[k], k))
                        if gap[k] <= 0.06 and k not in tops and abs(y[k] + h[k] / 2 - y[a] - h[a] / 2) <= max(h[a], h[k], 0.012) * 0.3 and p in kept:
                            kept.remove(p)
                            tops.discard(a)
                            changed = True
        assert page_text.without_prose(want, x, y, w, h) == kept




def test_pages_stream_by_in_batches(spark):
    """Pages are read from batches that cut them, many of them in one task's stream, and come out whole."""
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"page": p, "v": v}) for p, v in (([1, 1], [1, 2]), ([1, 2], [3, 4]), ([2], [5]), ([3, 4, 4], [6, 7, 8]))]
    whole = [t.to_pydict() for t in page_text.whole_pages(iter(batches))]
    assert [(t["page"], t["v"]) for t in whole] == [([1, 1, 1], [1, 2, 3]), ([2, 2, 3], [4, 5, 6]), ([4, 4], [7, 8])]
    words = [(p, k, t, 0.1 + dx, y, 0.02, 0.02) for p in range(50) for k, (t, dx, y) in enumerate((("1", 0.0, 0.1), ("2", 0.0, 0.13), ("word", 0.2, 0.115)))]
    words.append((99, 0, None, None, None, None, None))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        found = page_text.stacked_fractions(spark.createDataFrame(words, "page long, ord long, text string, x double, y double, w double, h double")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r.page, r.text) for r in found if r.page < 99) == [(p, r"$\frac{1}{2}$ word") for p in range(50)]
    assert [(r.text, r.fractions) for r in found if r.page == 99] == [(None, [])]
