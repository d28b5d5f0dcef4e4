"""From what a reader found on a page, or in a crop of it, to questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questmill.functions.text import let, trimmed
from questmill.operators.structure import structured
from questmill.sources.shared import kept

#: A stem counts from so many characters on; an extra one is looked for in others from so many on; fixed values.
USABLE, PIECE = 8, 12


def block_text(kind: Column, text: Column, latex: Column) -> Column:
    """What a block says: its text or else its latex, the other way round for a formula, which stands in dollar signs; null if nothing."""
    clean = lambda c: F.nullif(trimmed(F.coalesce(c, F.lit(""))), F.lit(""))
    formula = F.coalesce(clean(latex), clean(text))
    return F.when(kind == "formula", F.when(formula.startswith("$"), formula).otherwise(F.concat(F.lit("$"), formula, F.lit("$")))).otherwise(F.coalesce(clean(text), clean(latex)))


def from_blocks(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, ord, type, text, latex) to questions, as structured gives them.

    Text and formulas make the page, in order. A page with text but no question is
    one question without a number that holds it all.
    """
    said = blocks.where(F.col("type").isin("text", "formula")).select("doc_id", "ord", block_text(F.col("type"), F.col("text"), F.col("latex")).alias("line")).where("line is not null")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"])
    pages = kept(said.groupBy("doc_id").agg(F.array_join(lines, "\n").alias("text")), "pages")
    found = kept(structured(pages), "found")
    whole = pages.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    none = F.lit(None).cast("string")
    body = F.trim(F.regexp_replace("text", r"\s+", " "))
    return found.union(whole.select("doc_id", F.lit(0).cast("long"), none, none, none, body))


def from_crops(crops: DataFrame) -> DataFrame:
    """crops (doc_id, text, number) to the one question of each: doc_id, number, section, instructions, body.

    The text as it is, or with the number before it if there is none in it; crops
    with no question or several have none.
    """
    some = crops.where(trimmed(F.coalesce("text", F.lit(""))) != "").select("doc_id", trimmed(F.col("text")).alias("text"), "number")

    def only(found: DataFrame) -> DataFrame:
        asked = F.first(F.struct("number", "section", "instructions", "body")).alias("q")
        return found.groupBy("doc_id").agg(asked, F.count("*").alias("n"))

    direct = only(structured(some))
    bare = some.where("number is not null").join(direct, "doc_id", "left_anti")
    numbered = only(structured(bare.select("doc_id", F.concat("number", F.lit(". "), "text").alias("text"))))
    one = direct.union(numbered).where("n = 1").join(some.select("doc_id", F.col("number").alias("given")), "doc_id")
    return one.select("doc_id", F.coalesce("q.number", "given").alias("number"), "q.section", "q.instructions", "q.body")


def without_pieces(stem: Column, pieces: Column) -> Column:
    """A stem without the first occurrence of each piece, in order; a piece stays where too little would be left."""

    def cut(s: Column, piece: Column) -> Column:
        at = F.instr(s, piece)
        rest = F.concat(F.substring(s, F.lit(1), at - 1), F.substring(s, at + F.length(piece), F.length(s)))
        left = trimmed(F.regexp_replace(rest, r"\s{2,}", " "))
        return F.when((F.length(piece) >= PIECE) & F.contains(s, piece), let(left, lambda x: F.when(F.length(x) >= USABLE, x).otherwise(s))).otherwise(s)

    return F.aggregate(pieces, stem, lambda s, p: let(trimmed(p), lambda piece: cut(s, piece)))


def release_swallowed(questions: DataFrame) -> DataFrame:
    """questions (doc_id, ord, stem, extra): stems without those of the page's extra questions, which were read again on their own."""
    extras = F.array_sort(F.collect_list(F.when(F.col("extra"), F.struct("ord", "stem"))))
    pieces = questions.groupBy("doc_id").agg(F.transform(extras, lambda x: x["stem"]).alias("pieces"))
    joined = questions.join(pieces, "doc_id")
    return joined.withColumn("stem", F.when(F.col("extra"), F.col("stem")).otherwise(without_pieces(F.col("stem"), F.col("pieces")))).drop("pieces")


def clean_pages(pages: DataFrame, modeled: DataFrame, prefer: Column) -> DataFrame:
    """Questions of each page, by the printed numbers or as a model read them: doc_id, source, number, body.

    pages: doc_id, text and what prefer needs; modeled: doc_id, ord, number, body.
    The model's count if the split gave nothing, or where it is preferred and found
    as many. A page without a usable stem has none.
    """
    pages = kept(pages, "pages")
    split = kept(structured(pages), "split")
    usable = lambda q: q.where(F.length(trimmed(F.col("body"))) >= USABLE)
    count = lambda q, name: usable(q).groupBy("doc_id").agg(F.count("*").alias(name))
    chosen = pages.select("doc_id", prefer.alias("prefer")).join(count(split, "offline"), "doc_id", "left").join(count(modeled, "model"), "doc_id", "left").na.fill(0, ["offline", "model"])
    chosen = chosen.select("doc_id", ((F.col("model") > 0) & ((F.col("offline") == 0) | (F.col("prefer") & (F.col("model") >= F.col("offline"))))).alias("by_model"), (F.col("offline") > 0).alias("any"))
    by = lambda q, source, which: q.join(chosen.where(which).select("doc_id"), "doc_id", "left_semi").select("doc_id", F.lit(source).alias("source"), "number", "body")
    return by(split, "split", "not by_model and any").union(by(usable(modeled), "model", "by_model"))
