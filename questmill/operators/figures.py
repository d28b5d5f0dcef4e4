"""Figures: rows of figures, whose they are, mirror images and SVG texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from questmill.functions.text import question_key, trimmed
from questmill.operators.page_text import whole_pages

#: Elements that a drawing may hold; a fixed value.
SVG_TAGS = "svg g defs use circle ellipse line rect polygon polyline path text title".split()
#: Longest drawing that is accepted; a fixed value.
MOST_SVG = 200_000
WIDTH = 160
#: Words of the layout that are no part of a question; a fixed value.
LAYOUT_LABEL = r"(?i)\b(?:question figure|answer figures)\b"
FIGURE = "struct<description:string,caption:string,role:string,x:double,y:double,w:double,h:double>"


def figure_rows(boxes: DataFrame) -> DataFrame:
    """boxes (page, id, x, y, h) with row: a new one starts at a real gap under the first figure of the last."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, row, bottom = None, -1, 0.0
        for batch in batches:
            out = []
            for p, y, h in zip(batch["page"].tolist(), batch["y"].tolist(), batch["h"].tolist(), strict=True):
                if p != page or y > bottom + max(0.008, h * 0.35):
                    row = 0 if p != page else row + 1
                    page, bottom = p, y + h
                out.append(row)
            yield batch.assign(row=out)

    ordered = boxes.select("page", "id", "x", "y", "h").repartition("page").sortWithinPartitions("page", "y", "x", "id")
    return ordered.mapInPandas(rows, "page long, id long, x double, y double, h double, row int")


def split_figures(rows: DataFrame) -> DataFrame:
    """rows with part: option for the longest row (the lower one of equals), question for the others.

    A single row holds options if it has four figures or more; where no row has
    two, all belong to the question.
    """
    sizes = rows.groupBy("page", "row").agg(F.count("*").alias("n"))
    best = sizes.groupBy("page").agg(F.max(F.struct("n", "row")).alias("b"), F.count("*").alias("rows"))
    chosen = F.when(F.col("rows") == 1, F.col("b.n") >= 4).otherwise(F.col("b.n") >= 2)
    out = rows.join(best, "page")
    return out.withColumn("part", F.when(chosen & (F.col("row") == F.col("b.row")), "option").otherwise("question")).drop("b", "rows")


def rectangle_svg(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.format_string('<svg><rect x="%d" y="%d" width="%d" height="%d"/></svg>', x, y, w, h)


def rectangles(svg: Column) -> Column:
    """The rectangles of a drawing, in order of their numbers."""
    number = lambda s, name: F.regexp_extract(s, rf'\b{name}="(-?\d+)"', 1).cast("int")
    found = F.regexp_extract_all(svg, F.lit(r"(<rect\b[^>]*>)"), F.lit(1))
    return F.array_sort(F.transform(found, lambda s: F.struct(number(s, "x").alias("x"), number(s, "y").alias("y"), number(s, "width").alias("w"), number(s, "height").alias("h"))))


def mirrored(rects: Column, width: int = WIDTH) -> Column:
    """Rectangles reflected at the vertical middle line."""
    return F.array_sort(F.transform(rects, lambda r: F.struct((F.lit(width) - r["x"] - r["w"]).alias("x"), r["y"].alias("y"), r["w"].alias("w"), r["h"].alias("h"))))


def sanitized_svg(svg: Column) -> Column:
    """A drawing without scripts, handlers, outside references and other elements; null if it is unsafe, too long or no drawing."""
    s = svg
    for tag in ("script", "foreignObject", "iframe"):
        s = F.regexp_replace(s, rf"(?is)<{tag}\b.*?</{tag}>", "")
    s = F.regexp_replace(s, r"(?is)\son[a-z]+\s*=\s*(?:'[^']*'|\"[^\"]*\")", "")
    s = F.regexp_replace(s, r"(?is)\s(?:xlink:)?href\s*=\s*(?:'(?!#)[^']*'|\"(?!#)[^\"]*\")", "")
    s = F.regexp_replace(s, rf"(?i)</?(?!(?:{'|'.join(SVG_TAGS)})\b)[a-z][\w:-]*[^>]*>", "")
    unsafe = s.rlike(r"(?i)<script\b|<foreignobject\b|javascript:") | ~F.contains(s, F.lit("<svg"))
    return F.when((F.length(svg) <= MOST_SVG) & ~unsafe, s)


def svg_root(svg: Column) -> Column:
    """A drawing whose root names its namespace and, from its viewBox, its size."""
    root = F.regexp_extract(svg, r"(?i)<svg\b[^>]*>", 0)
    box = F.split(F.trim(F.regexp_extract(root, r"(?i)\sviewBox\s*=\s*[\"']([^\"']*)", 1)), r"[\s,]+")
    sized = F.size(F.filter(box, lambda n: n.rlike(r"^-?\d+(\.\d+)?$"))) == 4
    add = F.concat(
        F.when(root.rlike(r"(?i)\sxmlns\s*[=:]"), "").otherwise(' xmlns="http://www.w3.org/2000/svg"'),
        F.when(sized & ~root.rlike(r"(?i)\swidth\s*="), F.concat(F.lit(' width="'), F.get(box, 2), F.lit('"'))).otherwise(""),
        F.when(sized & ~root.rlike(r"(?i)\sheight\s*="), F.concat(F.lit(' height="'), F.get(box, 3), F.lit('"'))).otherwise(""),
    )
    closed = F.when(root.endswith("/>"), F.concat(F.rtrim(F.regexp_replace(root, r"/>$", "")), add, F.lit("/>"))).otherwise(F.concat(F.regexp_replace(root, r"\s*>$", ""), add, F.lit(">")))
    return F.when(root == "", svg).otherwise(F.replace(svg, root, closed))


def exploded_options(answer: Column, wrong: Column, slot: Column) -> Column:
    """Four options: the wrong ones in order, the answer in its slot."""
    return F.concat(F.slice(wrong, F.lit(1), slot), F.array(answer), F.slice(wrong, slot + 1, 3 - slot))


def _row_starts(groups: list[int], y: list[float], h: list[float]) -> list[int]:
    """The row, over all groups, of each of their figures from the top: a new one starts at a real gap under the first figure of the last."""
    out, row, group, bottom = [], -1, None, 0.0
    for g, top, height in zip(groups, y, h, strict=True):
        gap = height * 0.35
        if g != group or top > bottom + (gap if gap > 0.008 else 0.008):
            row, group, bottom = row + 1, g, top + height
        out.append(row)
    return out


def _last_above(page: np.ndarray, at: np.ndarray, kind: np.ndarray, of: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The key of the last number (kind 1) above or beside each row in its page, -1 where there is none; of numbers at one height the first counts."""
    order = np.lexsort((-of, kind, at, page))
    page, number = page[order], np.where(kind[order] == 1, np.arange(len(order)), -1)
    last = np.maximum.accumulate(number) if len(order) else number
    out = np.empty(len(order), np.int64)
    out[order] = np.where((last >= 0) & (page[last] == page), key[order][last], -1)
    return out


def _owned(page: np.ndarray, kind: np.ndarray, n: np.ndarray, key: np.ndarray, side: np.ndarray, at: np.ndarray, placed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of whole pages, ordered by page and kind (0 questions, 1 lines, 2 figures): a number for each question and figure, equal where they belong together, -1 for figures of none and questions without."""
    asked, lined, drawn = (np.flatnonzero(kind == k) for k in range(3))
    pages, keys = int(page[-1]) + 1, int(key.max()) + 2
    count = np.bincount(page[asked], minlength=pages)
    by_number = (count > 1) & (np.bincount(page[lined], minlength=pages) > 0)
    of_page = page[asked] * keys + key[asked]
    lead = np.r_[True, page[asked][1:] != page[asked][:-1]][: len(asked)]
    first = np.full(pages, -1)
    first[page[asked][lead]] = of_page[lead]
    first[np.bincount(page[asked], placed[asked], pages) > 0] = -1
    by_number &= first >= 0

    anchors = lined[(key[lined] >= 0) & by_number[page[lined]]]
    anchors = anchors[np.isin(page[anchors] * keys + key[anchors], of_page)]
    seen = np.r_[anchors, drawn[by_number[page[drawn]]]]
    half = page * 3 + side
    rest = at[seen], kind[seen], n[seen], key[seen]
    above = np.where(np.isin(half[seen], half[anchors]), _last_above(half[seen], *rest), _last_above(page[seen], *rest))[len(anchors) :]
    owner = np.where(by_number[page[drawn]], -1, first[page[drawn]])
    owner[by_number[page[drawn]]] = np.where(above >= 0, page[seen[len(anchors) :]] * keys + above, -1)
    return np.where(by_number[page[asked]] | lead, of_page, -1), owner


def _in_page(table: pa.Table) -> pa.RecordBatch:
    """The questions with figures of whole pages: page, ord, and the figures in two lists, those that are shown, and the row that holds options."""
    table = table.combine_chunks()
    code = lambda c: pc.fill_null(pc.cast(table[c].combine_chunks().dictionary_encode().indices, pa.int64()), -1).to_numpy()
    plain = lambda c: pc.fill_null(table[c], 0).to_numpy()
    # Kinds: 0 questions, 1 lines, 2 figures, 3 questions that have a place for a figure already.
    kind, n, page = plain("kind"), plain("n"), code("page")
    middle, height = pc.add(table["x"], pc.divide(table["w"], 2.0)), pc.divide(table["h"], 2.0)
    side = pc.fill_null(pc.cast(pc.less(middle, 0.5), pa.int64()), 2).to_numpy()
    at = pc.fill_null(pc.if_else(pa.array(kind == 2), pc.add(pc.add(table["y"], height), 0.04), table["y"]), -np.inf).to_numpy()
    groups, owner = _owned(page, kind % 3, n, code("key"), side, at, kind == 3)
    drawn = np.flatnonzero(kind == 2)[owner >= 0]
    owner = owner[owner >= 0]
    order = np.argsort(owner, kind="stable")
    drawn, owner = drawn[order], owner[order]
    y, h = (np.where(np.isnan(v), np.inf, v) for v in (plain("y")[drawn], plain("h")[drawn]))
    rows = np.array(_row_starts(owner.tolist(), y.tolist(), h.tolist()), np.int64)

    # The longest row of a group, of equals the lower.
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]][: len(rows)])
    length, group = np.bincount(rows, minlength=0), owner[starts]
    best = np.lexsort((np.arange(len(starts)), length, group))
    best = best[np.r_[group[best][1:] != group[best][:-1], True][: len(best)]]
    several = np.unique(group, return_counts=True)[1] > 1
    chosen = np.zeros(len(starts), bool)
    chosen[best] = length[best] >= np.where(several, 2, 4)

    # Rows from the top and from the left in a row; where several questions share a number, each has its figures.
    order = np.lexsort((n[drawn], plain("x")[drawn], rows))
    drawn, owner, option = drawn[order], owner[order], chosen[rows[order]]
    asked = np.flatnonzero(kind % 3 == 0)
    some = np.isin(groups, owner) & np.r_[True, (page[asked][1:] != page[asked][:-1]) | (n[asked][1:] != n[asked][:-1])][: len(asked)]
    asked, groups = asked[some], groups[some]
    boxes = pa.StructArray.from_arrays([table[c].combine_chunks() for c in "xywh"], list("xywh"))

    def lists(own: np.ndarray) -> pa.Array:
        low, high = (np.searchsorted(owner[own], groups, side) for side in ("left", "right"))
        offsets = np.r_[0, np.cumsum(high - low)]
        at = np.arange(offsets[-1]) + np.repeat(low - offsets[:-1], high - low)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), boxes.take(pa.array(drawn[own][at])))

    return pa.RecordBatch.from_arrays([*[table[c].combine_chunks().take(pa.array(asked)) for c in ("page", "n")], lists(~option), lists(option)], names=["page", "ord", "shown", "drawn"])


def owned(questions: DataFrame, figures: DataFrame, lines: DataFrame) -> DataFrame:
    """The questions that have figures: page, ord and two arrays of x, y, w, h: drawn, the figures that are options, and shown, the others.

    questions: page, ord (once a page), number, figures; figures: page, id, x, y, w, h;
    lines: page, ord, text, x, y, w. On a page with lines and several questions, a
    figure belongs to the number printed last above its middle (a little below counts
    too), in its half of the page if any number is printed there; it has no owner if
    there is none above. On other pages all belong to the first question. A figure
    without height counts as a flat one. The pages of a partition stream by, one held
    at a time with those of its batch.
    """
    kind = questions.schema["page"].dataType
    number = lambda c: F.col(c).cast("long").alias("n")
    box = lambda names: [F.col(c).cast("double").alias(c) for c in names]
    printed = F.regexp_extract(trimmed(F.col("text")), r"^(\d{1,3})\s*[.)]", 1).try_cast("int").cast("string").alias("key")
    placed = F.when(F.exists("figures", lambda f: f["x"].isNotNull()), 3).otherwise(0).alias("kind")
    asked = questions.select("page", placed, number("ord"), question_key(F.col("number")).alias("key"))
    printed_at = lines.select(F.col("page").cast(kind).alias("page"), F.lit(1).alias("kind"), number("ord"), printed, *box("xyw"))
    boxes = figures.where("x is not null and y is not null").select(F.col("page").cast(kind).alias("page"), F.lit(2).alias("kind"), number("id"), *box("xywh"))
    rows = boxes.unionByName(asked, True).unionByName(printed_at, True).where("page is not null")
    ordered = rows.repartition("page").sortWithinPartitions("page", F.col("kind") % 3, "y", "x", F.asc_nulls_last("n"), "w", "h")
    listed = ArrayType(StructType([StructField(c, DoubleType()) for c in "xywh"]))
    out = StructType([StructField("page", kind), StructField("ord", LongType()), StructField("shown", listed), StructField("drawn", listed)])
    return ordered.mapInArrow(lambda batches: map(_in_page, whole_pages(batches)), out)


def decorate(questions: DataFrame, figures: DataFrame, lines: DataFrame) -> DataFrame:
    """questions with the figures of their pages: figures, options, stem and type change, other columns stay.

    questions: page, ord, number, type, stem, options (array of key, text and
    more), figures (array of FIGURE). A page where a question has a figure with its
    place already stays as it is. The longest row of a question's figures (of equals
    the lower) are its options if it has two or more, or four where it is the only
    row. An option figure whose key is missing gets an option without text; where
    all texts are but labels, the options are those of the figures. A question with
    figures is a diagram, and loses the layout's labels from its stem.
    """
    rows = owned(questions, figures, lines).select("page", "ord", F.col("shown").alias("_shown"), F.col("drawn").alias("_drawn"))
    figure = lambda f, text, caption, role: F.struct(F.lit(text).alias("description"), caption.cast("string").alias("caption"), F.lit(role).alias("role"), *[f[c].alias(c) for c in "xywh"])
    now = F.concat(
        F.transform("_shown", lambda f: figure(f, "Question figure", F.lit(None), "question_figure")),
        F.transform("_drawn", lambda f, i: figure(f, "Answer figure", F.char(i + 65), "option_figure")),
    )
    drawn, none = F.coalesce(F.size("_drawn"), F.lit(0)), F.col("_drawn").isNull()
    item = questions.schema["options"].dataType.elementType
    bare = lambda key: F.struct(*[(key if f.name == "key" else F.lit("") if f.name == "text" else F.lit(None)).cast(f.dataType).alias(f.name) for f in item.fields])
    keys = F.transform("_drawn", lambda f, i: F.char(i + 65))
    missing = F.transform(F.filter(keys, lambda k: ~F.exists("options", lambda o: o["key"] == k)), bare)
    filled = F.concat("options", missing)
    labels = F.forall("options", lambda o: F.length(trimmed(o["text"])) <= 2)
    # Of options with one key the last counts.
    by_key = F.transform(keys, lambda k: F.coalesce(F.try_element_at(F.filter("options", lambda o: o["key"] == k), F.lit(-1)), bare(k)))
    options = F.when((drawn >= 2) & labels, by_key).when(drawn > 0, filled).otherwise(F.col("options"))
    stem = trimmed(F.regexp_replace(F.regexp_replace("stem", LAYOUT_LABEL, " "), r"\s+", " "))
    new = {
        "options": options,
        "stem": F.when(none, F.col("stem")).when(stem != "", stem).otherwise(trimmed(F.col("stem"))),
        "type": F.when(none, F.col("type")).otherwise("diagram"),
        "figures": F.when(none, F.col("figures")).otherwise(now),
    }
    return questions.join(rows, ["page", "ord"], "left").withColumns(new).select(*questions.columns)


__all__ = [
    "FIGURE", "decorate", "exploded_options", "figure_rows", "mirrored", "owned", "rectangle_svg", "rectangles", "sanitized_svg", "split_figures", "svg_root",
]
