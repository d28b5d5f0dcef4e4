"""Queries for figures, drawings, seeded questions and sinks, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from questmill.operators import figures
from questmill.plans.library_queries import _boxes
from questmill.sources.driver_tables import PAGE_LINES_SQL, page_lines, table
from questmill.sources.shared import shared_path

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
c = F.col


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql.replace("{lines}", PAGE_LINES_SQL)
        return f

    return add


def _figures(s, d):
    return _boxes(s, d).where("kind > 3").select("page", "id", "x", "y", F.lit(0.03).alias("h"))


@query("gen_split_figures")
def gen_split_figures(s, d):
    return figures.split_figures(figures.figure_rows(_figures(s, d))).select("page", "id", "row", "part")


def _mirror(s, d):
    """One seeded rectangle an event and the drawing of its reflection; every fourth is drawn wrong."""
    x, y, w, h = (c("event_id") % 60).cast("int"), (c("user_id") % 90).cast("int"), (c("event_id") % 31 + 9).cast("int"), (c("user_id") % 20 + 5).cast("int")
    e = table(s, d, "events").select("event_id", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
    drawn = F.lit(figures.WIDTH) - c("x") - c("w") + F.when(c("event_id") % 4 == 0, 1).otherwise(0)
    return e.select("event_id", figures.rectangle_svg(c("x"), c("y"), c("w"), c("h")).alias("svg"), figures.rectangle_svg(drawn, c("y"), c("w"), c("h")).alias("option"))


@query("gen_mirror", "SELECT event_id, '<svg><rect x=\"' || (160 - event_id % 60 - (event_id % 31 + 9) + CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END) || '\" y=\"' || (user_id % 90) || '\" width=\"' || (event_id % 31 + 9) || '\" height=\"' || (user_id % 20 + 5) || '\"/></svg>' AS svg FROM events")
def gen_mirror(s, d):
    return _mirror(s, d).select("event_id", c("option").alias("svg"))


@query("val_mirror", "SELECT event_id, event_id % 4 > 0 AS passed FROM events")
def val_mirror(s, d):
    return _mirror(s, d).select("event_id", (figures.mirrored(figures.rectangles(c("svg"))) == figures.rectangles(c("option"))).alias("passed"))


@query("gen_mirror_assets", "SELECT event_id, 'f' || event_id || '/generated/' || k || '.svg' AS path FROM (SELECT event_id, unnest(['A', 'B', 'C', 'D']) AS k FROM events)")
def gen_mirror_assets(s, d):
    keys = F.explode(F.array(*[F.lit(k) for k in "ABCD"])).alias("k")
    return table(s, d, "events").select("event_id", keys).select("event_id", F.format_string("f%d/generated/%s.svg", "event_id", "k").alias("path"))


_SVGS = ["<svg viewBox=\"0 0 10 20\"><rect x=\"1\" onclick=\"evil()\"/></svg>", "<svg><script>x</script><blink>hi</blink><path d=\"M0\"/></svg>", "<p>none</p>", "<svg><use href=\"http://x\"/><use href=\"#a\"/></svg>"]


def _svg():
    return F.element_at(F.array(*[F.lit(x) for x in _SVGS]), (c("p_partkey") % 4 + 1).cast("int"))


@query("fn_sanitize_svg", "SELECT p_partkey, (['<svg viewBox=\"0 0 10 20\"><rect x=\"1\"/></svg>', '<svg>hi<path d=\"M0\"/></svg>', NULL, '<svg><use/><use href=\"#a\"/></svg>'])[p_partkey % 4 + 1] AS v FROM part")
def fn_sanitize_svg(s, d):
    return table(s, d, "part").select("p_partkey", figures.sanitized_svg(_svg()).alias("v"))


@query("gen_model_figures", "SELECT p_partkey FROM part WHERE p_partkey % 4 <> 2")
def gen_model_figures(s, d):
    """Drawings that are safe after cleaning; the others are dropped from their questions."""
    return table(s, d, "part").where(figures.sanitized_svg(_svg()).isNotNull()).select("p_partkey")


@query("fn_svg_root", "SELECT p_partkey, (['<svg viewBox=\"0 0 10 20\" xmlns=\"http://www.w3.org/2000/svg\" width=\"10\" height=\"20\"><rect x=\"1\" onclick=\"evil()\"/></svg>', '<svg xmlns=\"http://www.w3.org/2000/svg\"><script>x</script><blink>hi</blink><path d=\"M0\"/></svg>', '<p>none</p>', '<svg xmlns=\"http://www.w3.org/2000/svg\"><use href=\"http://x\"/><use href=\"#a\"/></svg>'])[p_partkey % 4 + 1] AS v FROM part")
def fn_svg_root(s, d):
    return table(s, d, "part").select("p_partkey", figures.svg_root(_svg()).alias("v"))


@query("prj_generation_spec", "SELECT o_orderkey, '{\"skill\":\"' || o_orderpriority || '\",\"grade\":' || (o_custkey % 12 + 1) || '}' AS spec FROM orders")
def prj_generation_spec(s, d):
    return table(s, d, "orders").select("o_orderkey", F.to_json(F.struct(c("o_orderpriority").alias("skill"), (c("o_custkey") % 12 + 1).alias("grade"))).alias("spec"))


@query("cls_pattern_analysis", "SELECT event_id, event_type AS skill, CASE WHEN value > 100 THEN 0.9 ELSE 0.5 END AS confidence, CASE event_type WHEN 'view' THEN 'recall' ELSE 'apply' END AS intent FROM events")
def cls_pattern_analysis(s, d):
    return table(s, d, "events").select("event_id", c("event_type").alias("skill"), F.when(c("value") > 100, 0.9).otherwise(0.5).alias("confidence"), F.when(c("event_type") == "view", "recall").otherwise("apply").alias("intent"))


@query("fn_prompt_text", "SELECT o_orderkey, 'Write one question of priority ' || o_orderpriority || '.' || chr(10) || 'State: ' || o_orderstatus AS prompt FROM orders")
def fn_prompt_text(s, d):
    return table(s, d, "orders").select("o_orderkey", F.concat_ws("\n", F.format_string("Write one question of priority %s.", "o_orderpriority"), F.concat(F.lit("State: "), c("o_orderstatus"))).alias("prompt"))


@query("set_touch", "SELECT o_orderkey, TRUE AS touched FROM orders")
def set_touch(s, d):
    return table(s, d, "orders").withColumn("updated_at", F.current_timestamp()).select("o_orderkey", (c("updated_at") >= c("o_orderdate")).alias("touched"))


@query("snk_persist", "SELECT o_orderkey, o_orderstatus FROM orders")
def snk_persist(s, d):
    """The whole table written to a fresh folder of the shared place, and read from there."""
    path = shared_path(s, "persist")
    table(s, d, "orders").select("o_orderkey", "o_orderstatus").write.parquet(path)
    return s.read.parquet(path)


@query("src_file_walk")
def src_file_walk(s, d):
    """Paths and sizes of all files below the folder, at any depth; the files themselves are not read."""
    return s.read.format("binaryFile").option("recursiveFileLookup", True).load(d).select("path", "length")
