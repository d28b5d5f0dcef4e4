"""Page text and line boxes to questions.

A page's lines are told apart by how they look; the marked ones (directions,
sections, numbers) cut the page into runs, and windows over the runs say which of
them hold questions and what stands above these. Only where one run holds several
questions are its lines folded in order, by a SQL aggregate over the run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from questmill.functions import text as T
from questmill.sources.shared import kept

#: How printed numbers, sections and choices look; fixed values.
NUMBER_ONLY = r"^\(?(\d{1,3})\s*[.)]?$"
NUMBER_START = r"^\(?(\d{1,3})\s*[.)]\s+(.*)$"
SECTION = r"(?i)^section\s+([A-Z0-9]+)\b"
CHOICE = r"\([A-Ha-h]\)"
CHOICE_LINE = r"^\([A-Ha-h]\)\s+\S"

def numbered(lines: DataFrame) -> DataFrame:
    """Questions of pages whose lines carry their numbers: each head with the lines up to the next, in order."""
    head = F.regexp_extract("line", r"^\s*\(?(\d{1,3})\s*[.)]\s+", 1)
    w = Window.partitionBy("doc_id").orderBy("ord")
    marked = lines.withColumn("head", F.nullif(head, F.lit(""))).withColumn("group", F.count("head").over(w)).where("group > 0")
    rest = F.regexp_replace("line", r"^\s*\(?\d{1,3}\s*[.)]\s+", "")
    parts = F.array_sort(F.collect_list(F.struct("ord", F.when(F.col("head").isNotNull(), rest).otherwise(F.col("line")).alias("s"))))
    joined = F.trim(F.regexp_replace(F.array_join(F.transform(parts, lambda p: p["s"]), " "), r"\s+", " "))
    return marked.groupBy("doc_id", "group").agg(F.max("head").alias("number"), joined.alias("body"))


def _lines(pages: DataFrame) -> DataFrame:
    """The lines of every page that hold anything, with what the look of each says.

    Pages are dealt before they are cut, so all that follows for a page stays in its task.
    """
    pages = pages.repartition("doc_id")
    split = F.split(T.separate_numbers(F.coalesce("text", F.lit(""))), "\n")
    lines = pages.select("doc_id", F.posexplode(split).alias("ord", "line")).withColumn("line", T.trimmed(F.col("line"))).where("line != ''")
    line = F.col("line")
    blank = line.contains("__")
    return lines.select(
        "doc_id",
        "ord",
        "line",
        F.when(T.direction_start(line), "direction").when(line.rlike(SECTION), "section").when(line.rlike(NUMBER_ONLY), "number").when(line.rlike(NUMBER_START), "head").alias("mark"),
        F.regexp_count(line, F.lit(CHOICE)).alias("choices"),
        line.rlike(CHOICE_LINE).alias("choice_line"),
        # A line that can open a stem: not a choice, in upper case or with a blank, and no mere remnant.
        (~line.rlike("^" + CHOICE) & (line.rlike(r"^[A-Z_]") | blank) & ((F.length(line) >= 12) | blank | line.contains("?"))).alias("stem_like"),
    )


def _cut(lines: Column, begins: Callable[[Column, Column], Column], start: Column) -> Column:
    """Where the questions of ordered lines begin: at start, and where begins(state, line) says so; state counts the choices since."""

    def step(state: Column, x: Column) -> Column:
        new = begins(state, x)
        since = lambda c: F.when(new, F.lit(0)).otherwise(state[c])
        return F.struct(
            (since("choices") + x["choices"]).alias("choices"),
            (since("choice_lines") + x["choice_line"].cast("int")).alias("choice_lines"),
            F.when(new, F.concat(state["at"], F.array(x["place"]))).otherwise(state["at"]).alias("at"),
        )

    placed = F.transform(lines, lambda x, k: x.withField("place", k))
    return F.aggregate(placed, F.struct(F.lit(0).alias("choices"), F.lit(0).alias("choice_lines"), start.alias("at")), step)["at"]


def _questions(cut: DataFrame) -> DataFrame:
    """A row for each place where cut.lines is cut: nth, body; columns of cut stay."""
    each = cut.select("*", F.posexplode("at").alias("nth", "from"))
    to = F.coalesce(F.get("at", F.col("nth") + 1), F.size("lines"))
    own = F.slice("lines", F.col("from") + 1, to - F.col("from"))
    return each.withColumn("own", own).withColumn("body", _joined(F.transform("own", lambda x: x["line"])))


def _joined(lines: Column) -> Column:
    return F.trim(F.regexp_replace(F.array_join(lines, " "), r"\s+", " "))


def structured(pages: DataFrame) -> DataFrame:
    """pages (doc_id, text) to questions: doc_id, ord, number, section, instructions, body.

    A question begins at a printed number, at the first line behind a number or
    section that stood alone while such a number is unused (numbers printed ahead
    of their texts are used in order), and at a stem behind two choices. The
    directions above a question hold where their printed range allows its number
    and no section began since; else the section's line does. A page without any
    number is cut by its choices. A null or empty page has no questions; doc_id
    must be unique.
    """
    lines = _lines(pages)
    w = Window.partitionBy("doc_id").orderBy("ord")
    runs = lines.withColumn("run", F.count("mark").over(w))
    found = F.struct("ord", "line", "choices", "choice_line", "stem_like")
    runs = runs.groupBy("doc_id", "run").agg(
        F.max("mark").alias("mark"),
        F.max(F.when(F.col("mark").isNotNull(), F.col("line"))).alias("first"),
        F.array_sort(F.collect_list(F.when(F.col("mark").isNull(), found))).alias("tail"),
    )

    # Which runs hold questions.
    w = Window.partitionBy("doc_id").orderBy("run")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    alone, behind_number, behind_section = (F.col("mark") == "number"), (F.col("mark") == "number") & (F.size("tail") > 0), (F.col("mark") == "section") & (F.size("tail") > 0)
    runs = runs.withColumns({"numbers": F.count_if(alone).over(w), "spent": F.count_if(behind_number).over(w), "asking": F.count_if(behind_section).over(w)})
    # Sections ask for a number in turn; the k-th gets none if ever fewer than k were left over by then.
    runs = runs.withColumn("short", F.when(behind_section, F.col("asking") - (F.col("numbers") - F.col("spent"))))
    met = F.col("short") <= F.greatest(F.lit(0), F.coalesce(F.max("short").over(before), F.lit(0)))
    runs = runs.withColumn("uses", behind_number | F.coalesce(met & behind_section, F.lit(False)))
    runs = runs.withColumn("used", F.count_if("uses").over(w)).withColumn("opens", F.coalesce((F.col("mark") == "head") | F.col("uses"), F.lit(False)))
    runs = runs.withColumns({"opened": F.coalesce(F.count_if("opens").over(before), F.lit(0)), "any": F.max("opens").over(Window.partitionBy("doc_id"))})

    # What stands above them: the section, with text before the first question, and the directions since.
    text = _joined(F.concat(F.array("first"), F.transform("tail", lambda x: x["line"])))
    loose = F.when(~F.col("opens") & (F.col("opened") == 0), _joined(F.transform("tail", lambda x: x["line"])))
    heading = F.when(F.col("mark").isNull() | (F.col("mark") == "section"), F.concat_ws(" ", "first", F.nullif(loose, F.lit(""))))
    directed = F.when(F.col("mark") == "direction", text).when(F.col("mark") == "section", F.lit(""))
    runs = runs.withColumns(
        {
            "section": F.last(F.when(F.col("mark") == "section", F.upper(F.regexp_extract("first", SECTION, 1))), True).over(w),
            "heading": F.nullif(F.last(heading, True).over(w), F.lit("")),
            "directed": F.nullif(F.last(directed, True).over(w), F.lit("")),
        }
    )
    runs = kept(runs, "runs")
    waiting = runs.where("mark = 'number'").select("doc_id", F.col("numbers").alias("used"), F.regexp_extract("first", NUMBER_ONLY, 1).alias("waiting"))
    runs = runs.where("opens").join(waiting, ["doc_id", "used"], "left")
    rest = F.regexp_extract("first", NUMBER_START, 2)
    head = F.struct(F.lit(-1).alias("ord"), rest.alias("line"), F.regexp_count(rest, F.lit(CHOICE)).alias("choices"), F.lit(False).alias("choice_line"), F.lit(False).alias("stem_like"))
    runs = runs.withColumn("lines", F.when(F.col("mark") == "head", F.concat(F.array(head), "tail")).otherwise(F.col("tail")))
    runs = runs.withColumn("at", _cut(F.col("lines"), lambda state, x: (x["place"] > 0) & x["stem_like"] & (state["choices"] >= 2), F.array(F.lit(0))))

    printed = F.when(F.col("mark") == "head", F.regexp_extract("first", NUMBER_START, 1)).otherwise(F.col("waiting"))
    asked = _questions(runs).withColumn("number", F.when(F.col("nth") == 0, printed))
    low, high = T.direction_range(F.col("directed"))
    counted = F.coalesce(F.col("number").cast("int"), F.lit(0))  # a stem without a number counts as 0
    instructions = F.when(F.col("directed").isNull() | (counted < low) | (counted > high), F.col("heading")).otherwise(F.col("directed"))
    asked = asked.where("body != ''").select("doc_id", F.col("run").alias("a"), F.col("nth").alias("b"), "number", "section", instructions.alias("instructions"), "body")

    # Only pages without a question are read again.
    bare = unnumbered(_lines(pages.join(runs.select("doc_id").distinct(), "doc_id", "left_anti")))
    none = F.lit(None).cast("string")
    out = asked.union(bare.select("doc_id", F.lit(0).cast("long"), F.col("number").cast("int"), "number", none, "instructions", "body"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("a", "b")) - 1
    return out.select("doc_id", place.cast("long").alias("ord"), "number", "section", "instructions", "body")


def unnumbered(lines: DataFrame) -> DataFrame:
    """Questions of pages whose numbers were lost: doc_id, number, instructions, body.

    The first stem is the line before a choice, or one that slashes cut in three or
    more; each further one the first line behind choices that follows the end of a
    sentence, is cut by slashes, or reads like a stem behind two choices. What
    stands above the first is the instruction for all; stems with fewer than two
    lines of choices are none.
    """
    w = Window.partitionBy("doc_id").orderBy("ord")
    line = F.col("line")
    seen = lines.withColumns(
        {
            "jumble": F.regexp_count(line, F.lit("/")) >= 2,
            "behind_end": F.coalesce(F.lag(line.rlike(r"""[.?!]["']?$""")).over(w), F.lit(False)),
            "above_choice": F.coalesce(F.lead("choice_line").over(w), F.lit(False)),
        }
    )
    fields = F.struct("ord", "line", "choices", "stem_like", "choice_line", "jumble", "behind_end", "above_choice")
    pages = seen.groupBy("doc_id").agg(F.array_sort(F.collect_list(fields)).alias("lines"))

    def begins(state: Column, x: Column) -> Column:
        first = (F.size(state["at"]) == 0) & (x["choice_line"] | x["above_choice"] | x["jumble"])
        stem = x["behind_end"] | x["jumble"] | (x["stem_like"] & (state["choices"] >= 2))
        return first | ((state["choice_lines"] > 0) & ~x["choice_line"] & stem)

    pages = pages.withColumn("at", _cut(F.col("lines"), begins, F.array().cast("array<int>")))
    above = F.slice("lines", 1, F.get("at", 0))
    pages = pages.withColumn("instructions", F.nullif(_joined(F.transform(above, lambda x: x["line"])), F.lit("")))
    kept = _questions(pages).where(F.size(F.filter("own", lambda x: x["choice_line"])) >= 2)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("nth")).cast("string")
    return kept.select("doc_id", number.alias("number"), "instructions", "body")


def reading_order(boxes: DataFrame) -> DataFrame:
    """boxes (page, ord, x, y, h) with row and place: lines whose centre lies in a row's extent share it.

    A row's extent grows with its members, so the boxes of a page are folded from
    the top; the pages of a partition stream by, one box held at a time.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, row, top, bottom = None, -1, 0.0, 0.0
        for batch in batches:
            out = []
            for p, y, h in zip(batch["page"].tolist(), batch["y"].tolist(), batch["h"].tolist(), strict=True):
                if p != page:
                    page, row = p, -1
                height = max(bottom - top, h, 0.01)
                if row >= 0 and top - height * 0.25 <= y + h / 2 <= bottom + height * 0.25:
                    top, bottom = min(top, y), max(bottom, y + h)
                else:
                    row, top, bottom = row + 1, y, y + h
                out.append(row)
            yield batch[["page", "ord", "x", "y"]].assign(row=out)

    ordered = boxes.select("page", "ord", "x", "y", "h").repartition("page").sortWithinPartitions("page", "y", "x", "ord")
    placed = ordered.mapInPandas(rows, "page long, ord long, x double, y double, row int")
    place = F.row_number().over(Window.partitionBy("page", "row").orderBy("x", "y", "ord")) - 1
    return placed.select("page", "ord", "row", place.alias("place"))
