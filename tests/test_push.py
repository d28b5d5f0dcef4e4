"""Push units and presence of a small export written by hand."""

import pytest

from questmill.operators import push

TABLES = {
    "questions": ("id string, diagram_path string, marks double", [("q1", "/local/a.png", 1.0), ("q2", None, 2.0), ("q3", None, 1.0), ("q4", None, 1.0)]),
    "question_translations": ("id string, question_id string, language_code string, explanation_diagram_path string", [("t1", "q1", "en", "/x"), ("t2", "q2", "en", None), ("t4", "q4", "en", None)]),
    "question_options": ("id string, question_id string, option_key string", [("o2", "q1", "B"), ("o1", "q1", "A"), ("o3", "q2", "A")]),
    "option_translations": ("id string, option_id string, language_code string, option_image_path string", [("p1", "o1", "en", "/i"), ("p2", "o2", "en", None), ("p9", "gone", "en", None)]),
    "question_tags": ("question_id string, tag string", [("q1", "b"), ("q1", "a")]),
    "matching_items": ("id string, question_id string", [("m1", "q2"), ("m2", "q2")]),
    "matching_pairs": ("question_id string, left_item_id string, right_item_id string", [("q2", "m1", "m2")]),
    "question_groups": ("id string, shared_image_path string", [("g", "/g")]),
    "question_group_translations": ("id string, group_id string, language_code string", [("gt", "g", "en")]),
    "group_questions": ("group_id string, question_id string", [("g", "q1"), ("g", "q2")]),
    "paper_questions": ("paper_id string, question_id string, question_order int", [("d", "q1", 1), ("d", "q2", 2), ("d", "q3", 3)]),
    "test_questions": ("test_id string, question_id string, question_order int", []),
}


@pytest.fixture
def tables(spark):
    return {name: spark.createDataFrame(rows, schema) for name, (schema, rows) in TABLES.items()}


def test_units(tables):
    units = {r.question_id: r for r in push.push_units(tables).collect()}
    one = units["q1"]
    assert one.question.diagram_path is None and one.translation.explanation_diagram_path is None and one.group.shared_image_path is None and one.option_translations[0].option_image_path is None
    assert [o.id for o in one.options] == ["o1", "o2"] and [t.tag for t in one.tags] == ["a", "b"] and one.link.kind == "paper" and one.group_translation.id == "gt"
    assert tuple(one.counts) == (1, 2, 2, 2, 0, 0, 1, 1) and tuple(units["q2"].counts) == (1, 1, 0, 0, 2, 1, 1, 1)
    assert {k: u.missing for k, u in units.items()} == {"q1": None, "q2": None, "q3": "English text", "q4": "link"}
    again = {r.question_id: r.content_hash for r in push.push_units(tables | {"question_tags": tables["question_tags"].where("tag = 'a'")}).collect()}
    assert again["q2"] == units["q2"].content_hash and again["q1"] != one.content_hash
    with pytest.raises(Exception, match="question q[34] is without its"):
        push.checked(push.push_units(tables)).collect()


def test_presence(spark, tables):
    units = push.push_units(tables)
    hindi = spark.createDataFrame([("h", "q2", "hi", None)], TABLES["question_translations"][0])
    remote = tables | {"question_translations": tables["question_translations"].where("question_id = 'q1'").union(hindi), "paper_questions": tables["paper_questions"].where("question_order = 2"), "question_options": tables["question_options"].limit(0)}
    got = {r.question_id: tuple(r)[1:] for r in push.presence(units, remote).collect()}
    assert got == {
        "q1": (False, 1, 0, 2, 2, 0, 0, 1, 1), "q2": (True, 0, 0, 0, 0, 2, 1, 1, 1), "q3": (False, 0, 0, 0, 0, 0, 0, 0, 0), "q4": (False, 0, 0, 0, 0, 0, 0, 0, 0),
    }
