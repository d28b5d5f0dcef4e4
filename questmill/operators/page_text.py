"""From boxes of words and lines to a page's text: columns, rows, margin numbers, stacked fractions."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from itertools import pairwise
from math import isfinite

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from questmill.functions.text import SPACES

#: How a question's number opens a line, and stands alone; fixed values.
NUMBER_HEAD = r"^\(?(\d{1,3})\s*[.)](?:\s+\S|\s*$)"
NUMBER_ALONE = r"^\(?(\d{1,3})\s*[.)]?\s*$"
#: The least gap between columns, how far beyond a row's extent a line's middle may lie, the least height; fixed values.
COLUMN_GAP, ROW_SLACK, LEAST_HEIGHT = 0.18, 0.25, 0.01
_HEAD, _ALONE, _BLANKS = re.compile(NUMBER_HEAD, re.ASCII), re.compile(NUMBER_ALONE, re.ASCII), re.compile(r"\s+", re.ASCII)


def middle_of(heads: list[tuple[float, float]]) -> float | None:
    """Where a page's numbers (x, w) that open questions part into two columns: between the sides of their widest gap, if that is wide and each side has two."""
    heads = sorted(heads)
    gaps = [b - a if isfinite(b - a) else -1.0 for (a, _), (b, _) in pairwise(heads)]
    if len(heads) < 4 or max(gaps) < COLUMN_GAP:
        return None
    cut = gaps.index(max(gaps)) + 1
    if cut < 2 or len(heads) - cut < 2:
        return None
    left, right = max(x + w for x, w in heads[:cut]), heads[cut][0]
    return max(0.0, min(1.0, (max(0.0, left) + min(1.0, right)) / 2))


def rows_of(lines: list[tuple[float, float, float, str]]) -> list[list[tuple[float, str]]]:
    """Lines (y, x, h, text) from the top in rows of x and text: a line whose middle lies in the extent of the row above shares it, and widens it."""
    rows, top, bottom = [], 0.0, 0.0
    for y, x, h, text in lines:
        slack, middle = max(bottom - top, h, LEAST_HEIGHT) * ROW_SLACK, y + h / 2
        if rows and top - slack <= middle <= bottom + slack:
            rows[-1].append((x, text))
            top, bottom = min(top, y), max(bottom, y + h)
        else:
            rows.append([(x, text)])
            top, bottom = y, y + h
    return rows


def joined_row(row: list[tuple[float, str]]) -> str:
    """A row's texts from the left; a number that stands alone at the left is the row's."""
    first, *rest = (t for _, t in sorted(row, key=lambda r: r[0]))
    if rest and (number := _ALONE.match(first)):
        first = f"{number[1]}."
    return _BLANKS.sub(" ", " ".join([first, *rest])).strip(SPACES)


def page_texts(lines: DataFrame) -> DataFrame:
    """lines (page, ord, text, x, y, w, h) to the text of each page in reading order: page, text.

    Where the numbers that open questions stand in two columns (four or more, two on
    each side of a gap), the page is cut between them and the left side comes first.
    In a side, lines go row by row and from the left in a row. Lines without text or
    extent are left out; a page without any has no row. A line without a height on the
    page is a row of its own. The pages of a partition stream by, one held at a time
    with those of its batch.
    """
    number = lambda v: F.when(F.isnan(v), float("inf")).otherwise(F.coalesce(v, F.lit(float("-inf"))))

    def page_text(own: list[tuple[float, float, float, float, str]]) -> str:
        middle = middle_of([(x, w) for _, x, w, _, t in own if _HEAD.match(t)])
        right = [middle is not None and x + w / 2 >= middle for _, x, w, _, _ in own]
        sides = ([(y, x, h, t) for (y, x, _, h, t), r in zip(own, right, strict=True) if r == side] for side in (False, True))
        return "\n".join(joined_row(row) for side in sides for row in rows_of(side))

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_pages(batches):
            keys, texts, *boxes = (c.to_pylist() for c in whole.columns)
            rows = [*zip(*boxes, (t.strip(SPACES) for t in texts), strict=True)]
            starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            parts = [[r for r in rows[i:j] if r[4]] for i, j in pairwise(starts)]
            some = [k for k, part in enumerate(parts) if part]
            yield pa.RecordBatch.from_arrays([whole.column(0).combine_chunks().take(pa.array([starts[k] for k in some], pa.int64())), pa.array([page_text(parts[k]) for k in some], pa.string())], names=["page", "text"])

    usable = lines.where("text is not null and w > 0 and h > 0").select("page", "ord", "text", *[number(F.col(c).cast("double")).alias(c) for c in "yxwh"])
    ordered = usable.repartition("page").sortWithinPartitions("page", "y", "x", "ord")
    return ordered.select("page", "text", *"yxwh").mapInArrow(pages, StructType([lines.schema["page"], StructField("text", StringType())]))


# Stacked fractions. All measures are fixed values, in parts of the page or of a word's height.
INTEGER = re.compile(r"\d{1,5}")
ALIGNED, LEAST_ALIGNED = 0.8, 0.012
OVERLAP, LOWEST_GAP, NEAREST, FARTHEST = -0.6, 0.8, 0.35, 2.2
BESIDE, TOUCHING, NEAR, BASELINE = 1.2, -0.008, 0.06, 0.3
WHOLE_TOUCHING, WHOLE_NEAR, WHOLE_SLACK = -0.004, 0.03, 0.01
BAND, LEAST_BAND = 0.85, 0.012


def stacked(x: Sequence[float], y: Sequence[float], w: Sequence[float], h: Sequence[float], integers: Sequence[int]) -> list[tuple[int, int]]:
    """Pairs of integers that stand above each other like a fraction's, closest first, each integer once.

    Candidates for a numerator are looked up among the integers by height, as a
    denominator lies within a few heights of it.
    """
    middle = {i: y[i] + h[i] / 2 for i in integers}
    by_height = sorted((i for i in integers if middle[i] == middle[i]), key=middle.__getitem__)
    heights, found = [middle[i] for i in by_height], []
    for a in integers:
        low, high = bisect_left(heights, middle[a]), bisect_left(heights, middle[a] + (FARTHEST * h[a] + 1e-9))
        for b in by_height[low:high]:
            height, dy = min(h[a], h[b]), middle[b] - middle[a]
            if a == b or not NEAREST * height <= dy <= FARTHEST * height:
                continue
            gap, dx = y[b] - (y[a] + h[a]), abs((x[a] + w[a] / 2) - (x[b] + w[b] / 2))
            if dx <= max(min(w[a], w[b]) * ALIGNED, LEAST_ALIGNED) and OVERLAP * h[b] <= gap <= LOWEST_GAP * height:
                found.append((max(gap, 0.0) + 2 * dx, a, b))
    used, out = set(), []
    for _, a, b in sorted(found):
        if a not in used and b not in used:
            used |= {a, b}
            out.append((a, b))
    return out


def without_prose(pairs: list[tuple[int, int]], x: Sequence[float], y: Sequence[float], w: Sequence[float], h: Sequence[float]) -> list[tuple[int, int]]:
    """Pairs whose numerator has no word beside it on its baseline that is no numerator itself; as pairs go, their neighbours may too."""
    middle, tops = [a + b / 2 for a, b in zip(y, h, strict=True)], {a for a, _ in pairs}
    by_height = sorted((i for i, m in enumerate(middle) if m == m), key=middle.__getitem__)
    heights, tallest = [middle[i] for i in by_height], max((h[i] for i in by_height), default=0.0)
    beside: dict[int, list[int]] = {}
    for top in tops:
        reach = max(tallest, LEAST_BAND) * BESIDE + 1e-9
        left = right = (np.inf, -1)
        for k in by_height[bisect_left(heights, middle[top] - reach) : bisect_right(heights, middle[top] + reach)]:
            if k != top and abs(middle[k] - middle[top]) <= max(h[k], h[top], LEAST_BAND) * BESIDE:
                before, behind = x[top] - (x[k] + w[k]), x[k] - (x[top] + w[top])
                if before >= TOUCHING:
                    left = min(left, (before, k))
                if behind >= TOUCHING:
                    right = min(right, (behind, k))
        for gap, k in (left, right):
            if gap <= NEAR and abs(middle[top] - middle[k]) <= max(h[top], h[k], LEAST_BAND) * BASELINE:
                beside.setdefault(k, []).append(top)
    # What a word beside it says of a numerator only changes when that word stops being one.
    lost = {t for k, at in beside.items() if k not in tops for t in at}
    open_ = list(lost)
    while open_:
        more = [t for t in beside.get(open_.pop(), []) if t not in lost]
        lost.update(more)
        open_ += more
    return [p for p in pairs if p[0] not in lost]


def _join(parts: list[str]) -> str:
    """Parts as one line: no space behind an opening bracket or before a closing mark."""
    line = ""
    for part in parts:
        tight = not line or line[-1] in "([" or part[0] in ".,:;?!)%]"
        line += part if tight else f" {part}"
    return line


def fraction_page(texts: list[str | None], *boxes: list[float | None]) -> tuple[str | None, list[dict]]:
    """The text of a page's words (texts, x, y, w, h) with fractions, and these; None if there are none."""
    texts = [(t or "").strip() for t in texts]
    some = [i for i, t in enumerate(texts) if t]
    texts = [texts[i] for i in some]
    x, y, w, h = ([float("nan") if b[i] is None else b[i] for i in some] for b in boxes)
    integers = [i for i, t in enumerate(texts) if INTEGER.fullmatch(t)]
    pairs = stacked(x, y, w, h, integers) if len(integers) > 1 else []
    pairs = without_prose(pairs, x, y, w, h) if pairs else []
    if not pairs:
        return None, []
    used = {k for p in pairs for k in p}
    middle = [a + b / 2 for a, b in zip(y, h, strict=True)]
    found, tokens = [], []
    for top, bottom in pairs:
        left, high = min(x[top], x[bottom]), min(y[top], y[bottom])
        low, right = max(y[top] + h[top], y[bottom] + h[bottom]), max(x[top] + w[top], x[bottom] + w[bottom])
        level = (i for i in integers if i not in used and high - WHOLE_SLACK <= middle[i] <= low + WHOLE_SLACK)
        near = [(g, i) for i in level if WHOLE_TOUCHING <= (g := left - (x[i] + w[i])) <= WHOLE_NEAR]
        whole = min(near)[1] if near else None
        body = rf"\frac{{{texts[top]}}}{{{texts[bottom]}}}"
        if whole is not None:
            used.add(whole)
            body, left, right = texts[whole] + body, min(left, x[whole]), max(right, x[whole] + w[whole])
        found.append({"top": texts[top], "bottom": texts[bottom], "whole": None if whole is None else texts[whole]})
        # It stands on the denominator's line, no higher than a word.
        tokens.append((f"${body}$", left, y[bottom] + h[bottom] / 2))
    tokens = [(texts[i], x[i], middle[i]) for i in range(len(texts)) if i not in used] + tokens
    band = max(float(np.median(h)) * BAND, LEAST_BAND)
    rank = lambda t: int(t in (".", ")"))
    lines: list[list[tuple]] = []
    for token in sorted(tokens, key=lambda t: (t[2], t[1], rank(t[0]))):
        if lines and abs(token[2] - sum(t[2] for t in lines[-1]) / len(lines[-1])) <= band:
            lines[-1].append(token)
        else:
            lines.append([token])
    return "\n".join(_join([t[0] for t in sorted(line, key=lambda t: (t[1], rank(t[0])))]) for line in lines), found


FOUND = pa.list_(pa.struct([(k, pa.string()) for k in ("top", "bottom", "whole")]))
FRACTIONS = "page long, text string, fractions array<struct<top:string,bottom:string,whole:string>>"


def whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of ordered batches anew, cut only between two pages (the first column)."""
    held = None
    for batch in batches:
        held = pa.concat_tables([*([] if held is None else [held]), pa.Table.from_batches([batch])])
        last = held.column(0)[-1] if held.num_rows else pa.scalar(None)
        start = pc.index(held.column(0), last).as_py() if last.is_valid else 0
        if start:
            yield held.slice(0, start)
            held = held.slice(start)
    if held is not None and held.num_rows:
        yield held


def stacked_fractions(words: DataFrame) -> DataFrame:
    """words (page, ord, text, x, y, w, h) to page, text (with stacked integers as fractions, null if there are none) and fractions.

    The closest pairs are taken first. A numerator beside a word on its line is a
    number of the sentence, and no fraction. A whole number close to the left of a
    fraction belongs to it. The pages of a partition stream by, one held at a time with
    those of its batch.
    """

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_pages(batches):
            keys, *columns = (c.to_pylist() for c in whole.columns)
            starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            found = [fraction_page(*(c[i:j] for c in columns)) for i, j in pairwise(starts)]
            rows = [pa.array([keys[i] for i in starts[:-1]], pa.int64()), pa.array([t for t, _ in found], pa.string()), pa.array([f for _, f in found], FOUND)]
            yield pa.RecordBatch.from_arrays(rows, names=["page", "text", "fractions"])

    ordered = words.select(F.col("page").cast("long"), "ord", "text", *[F.col(c).cast("double") for c in "xywh"]).repartition("page").sortWithinPartitions("page", "ord")
    return ordered.select("page", "text", "x", "y", "w", "h").mapInArrow(pages, FRACTIONS)
