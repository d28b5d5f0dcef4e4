"""Blocks of questions whose lines hold the number of a further question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questmill.functions.text import let, trimmed

#: A number inside a line, behind text and before the words of a question; a fixed value.
SWALLOWED = r"""^(.*?[^\d\s])\s+(\d{1,3})\s*[.)]\s+([A-Za-z"'(].*)$"""
#: A sign of such a number; where it begins, behind text; the number with its mark; what ends a line for SWALLOWED.
_CANDIDATE = r"""\s\d{1,3}\s*[.)]\s+[A-Za-z"'(]"""
_INNER = r"""(?=\s)(?<=[^\d\s])(?=\s+\d{1,3}\s*[.)]\s+[A-Za-z"'(])"""
_MARK = r"^\s+(\d{1,3})\s*[.)]\s+"
_ENDS = r"[\n\r\x{85}\x{2028}\x{2029}]"
PIECE = "struct<head:string,text:string,x:double,y:double,w:double,h:double>"
BOX = "array<struct<x:double,y:double,w:double,h:double>>"


def _cut_line(line: Column, own: Column) -> Column:
    """A line's pieces (head, text, x, y, w, h): what stands before its first inner number, then one for each number it holds.

    own is the number of the block that the line opens, null for other lines: where
    a piece's inner number repeats the piece's own, the line is not cut further. The
    line is cut at all its numbers at once, in time in proportion to its length.
    """
    piece = lambda head, text: F.struct(head.alias("head"), text.alias("text"), *[line[c].alias(c) for c in "xywh"])
    whole = F.array(piece(F.lit(None).cast("string"), line["text"]))

    def joined(parts: Column, numbers: Column) -> Column:
        """The pieces of parts; the first number that repeats the one before it and all after it stay in one piece."""
        repeats = F.transform(numbers, lambda n, i: F.coalesce(n == F.when(i == 0, own).otherwise(F.get(numbers, i - 1)), F.lit(False)))

        def pieces(kept: Column) -> Column:
            def one(n: Column, i: Column) -> Column:
                tail = F.when(i + 1 < kept, F.get(parts, i + 1)).otherwise(F.array_join(F.slice(parts, i + 2, F.size(parts)), ""))
                return piece(n, F.concat(n, F.lit(". "), trimmed(F.regexp_replace(tail, _MARK, ""))))

            cut = F.concat(F.array(piece(F.lit(None).cast("string"), trimmed(F.get(parts, 0)))), F.transform(F.slice(numbers, F.lit(1), kept), one))
            return F.when(kept > 0, cut).otherwise(whole)

        first = F.array_position(repeats, True).cast("int")
        return let(F.when(first > 0, first - 1).otherwise(F.size(numbers)), pieces)

    def cut(text: Column) -> Column:
        # With an end of a line inside, only the number beside it can be the first, as no part but the white space around numbers may hold one.
        rest = F.concat(F.lit(" "), F.regexp_extract(text, SWALLOWED, 2), F.lit(". "), F.regexp_extract(text, SWALLOWED, 3))
        ended = F.when(text.rlike(SWALLOWED), F.concat(F.array(F.regexp_extract(text, SWALLOWED, 1)), F.split(rest, _INNER))).otherwise(F.array(text))
        parts = F.when(text.rlike(_ENDS), ended).otherwise(F.split(text, _INNER))
        return let(parts, lambda p: let(F.transform(F.slice(p, F.lit(2), F.size(p)), lambda x: F.regexp_extract(x, _MARK, 1)), lambda n: joined(p, n)))

    return F.when(line["text"].rlike(_CANDIDATE), let(trimmed(line["text"]), cut)).otherwise(whole)


def _boxes(box: Column, tops: Column) -> Column:
    """A block's box cut at heights, from the top: coordinates within the page, rounded to four digits, no box lower than a hundredth."""
    inside = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    rounded = lambda v: F.floor(v * 10000 + 0.5) / 10000

    def normal(x: Column, y: Column, w: Column, h: Column) -> Column:
        left, top = inside(x), inside(y)
        return F.struct(
            rounded(left).alias("x"), rounded(top).alias("y"), rounded(inside(F.least(w, 1 - left))).alias("w"), rounded(F.greatest(F.lit(0.01), inside(F.least(h, 1 - top)))).alias("h"),
        )

    def step(done: Column, top: Column) -> Column:
        def cut(last: Column) -> Column:
            upper = normal(last["x"], last["y"], last["w"], top - last["y"])
            lower = normal(last["x"], top, last["w"], last["y"] + last["h"] - top)
            return F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(upper, lower))

        return let(F.element_at(done, -1), cut)

    return F.aggregate(tops, F.array(F.struct(*[box[c].cast("double").alias(c) for c in "xywh"])), step)


def split_swallowed(blocks: DataFrame) -> DataFrame:
    """blocks (page, block, number, x, y, w, h, lines) cut where a line holds the number of a further question, until nothing is left to cut.

    lines is an array of text, x, y, w, h in order. Returns page, block, part (from
    0), number, x, y, w, h, lines. A number in a block's first line that repeats the
    block's own is no cut. All cuts of a block are made within its row.
    """
    lines = F.transform(
        "lines", lambda line, i: _cut_line(line.withField("text", F.coalesce(line["text"], F.lit(""))), F.when(i == 0, F.col("number")))
    )
    cut = blocks.withColumn("_pieces", F.flatten(lines))
    starts = F.filter(F.transform("_pieces", lambda p, i: F.when(p["head"].isNotNull(), i)), lambda i: i.isNotNull())
    cut = cut.withColumn("_starts", F.concat(F.array(F.lit(0)), starts))
    heads = F.transform(F.slice("_starts", F.lit(2), F.size("_starts")), lambda i: F.get("_pieces", i))
    boxes = _boxes(F.struct("x", "y", "w", "h"), F.transform(heads, lambda p: p["y"].cast("double")))
    cut = cut.withColumn("_boxes", boxes)

    def part(start: Column, i: Column) -> Column:
        own = F.slice("_pieces", start + 1, F.coalesce(F.get("_starts", i + 1), F.size("_pieces")) - start)
        number = F.when(i == 0, F.col("number")).otherwise(F.get("_pieces", start)["head"])
        lines = F.transform(own, lambda p: F.struct(*[p[c].alias(c) for c in ("text", "x", "y", "w", "h")]))
        return F.struct(number.alias("number"), *[F.get("_boxes", i)[c].alias(c) for c in "xywh"], lines.alias("lines"))

    # Each part leaves with its own lines only.
    parts = cut.select("page", "block", F.posexplode(F.transform("_starts", part)).alias("part", "_part"))
    return parts.select("page", "block", "part", "_part.*")
