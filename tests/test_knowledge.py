"""Integrity of a knowledge file, reverse citations, contradictions in order."""

import pytest

from ravelin.operators import knowledge

SHAPE = knowledge.Shape(sections=("answers",), cited={"answers": ("proof",)}, fields=("passage", "quote"), max_quote=20)
ENTRY = "section string, position long, id string, sources array<string>"
CITE = "section string, position long, field string, fields array<string>, passage string, quote string"
REF = (
    "kind string, item long, position int, source string, locator string, passage_id string, quote string, "
    "lines array<struct<first:int,last:int>>, words array<string>"
)


@pytest.fixture
def breaches(spark):
    def run(sections, entries, citations, described=("s1",), expected=("Q1", "Q2")):
        return {
            tuple(r) for r in knowledge.integrity(
                spark.createDataFrame([(s,) for s in sections], "section string"), spark.createDataFrame(entries, ENTRY),
                spark.createDataFrame(citations, CITE),
                spark.createDataFrame([("answers", i, q) for i, q in enumerate(expected)], "section string, position long, id string"),
                spark.createDataFrame([("p1", "The lease ends in May"), ("p2", None)], "id string, text string"),
                spark.createDataFrame([(s,) for s in described], "source string"), spark.createDataFrame([("s1",)], "source string"), SHAPE,
            ).collect()
        }

    return run


SOUND = [("answers", 0, "Q1", ["s1"]), ("answers", 1, "Q2", None)]
PROOFS = [("answers", i, "proof", ["quote", "passage"], "p1", "lease ends") for i in (0, 1)]


def test_sound_file_has_no_breach(breaches):
    assert breaches(["answers"], SOUND, PROOFS) == set()


def test_each_rule_finds_its_breach(breaches):
    found = breaches(
        ["answers", "notes"], [("answers", 0, "Q2", ["s9", "s9"]), ("answers", 2, "Q3", [])],
        [("answers", 0, "proof", ["quote"], "p1", "x" * 21), ("answers", 1, "proof", None, None, None), ("answers", 2, "other", ["passage", "quote"], "p2", "lease")],
        described=("s2",),
    )
    assert found == {
        ("unexpected section", "notes", None), ("id out of order", "answers.0", "Q1 / Q2"), ("id out of order", "answers.1", "Q2 / -"),
        ("id out of order", "answers.2", "- / Q3"), ("no citation", "answers.2.proof", None), ("citation shape", "answers.0.proof", "quote"),
        ("citation shape", "answers.1.proof", ""), ("unknown source described", "s2", None), ("source without description", "s1", None),
        ("unknown source named", "answers.0", "s9"), ("evidence", "answers.0.proof", "p1: quote too long"),
        ("evidence", "answers.1.proof", "-: unknown passage"), ("evidence", "answers.2.other", "p2: quote not found"),
    }


def test_empty_file(breaches):
    assert breaches([], [], [], described=("s1",), expected=()) == {("missing section", "answers", None)}


def test_cited_by_takes_the_first_reference_that_leads_there(spark):
    passages = spark.createDataFrame(
        [("a1", "s1", "one two three", 1, "x"), ("a2", "s1", "four", 2, "x"), ("b1", "s2", "one two three", 1, "part z")],
        "id string, source string, text string, line int, locator string",
    )
    refs = spark.createDataFrame([
        ("action", 1, 0, "s9", "gone", None, "", [], []),  # not a source of the corpus
        ("action", 1, 1, "s1", "lines", None, "", [(1, 2)], []),
        ("action", 1, 2, "s1", "later", "a2", "", [], []),
        ("action", 2, 0, "s1", "lines", None, "", [(1, 2)], []),  # equal target, other item
        ("answer", 5, 0, None, None, None, "one two three", [], []),  # both sources hold the quote
        ("event", 7, 0, "s2", "bare", None, "", [], []),
    ], REF)
    found = {tuple(r) for r in knowledge.cited_by(refs, passages).collect()}
    assert found == {
        ("s1", "action", 1, 1, "lines", 2, "a1"), ("s1", "action", 2, 0, "lines", 2, "a1"), ("s1", "answer", 5, 0, None, 1, "a1"),
        ("s2", "answer", 5, 0, None, 1, "b1"), ("s2", "event", 7, 0, "bare", 0, None),
    }


def test_contradictions_of_the_plan_lead_and_grow_with_missing_items(spark):
    rows = [(i, i, i in (3, 8) if i else None) for i in range(10)]
    disputes = spark.createDataFrame(rows, "id long, position long, in_plan boolean")
    for n, expected in ((0, [3, 8]), (4, [3, 8, 0, 1])):
        missing = spark.range(n)
        shown = knowledge.leading_contradictions(disputes, 2, missing).orderBy("shown").collect()
        assert [r.id for r in shown] == expected


def test_a_step_without_action_keeps_its_place(spark):
    conditions = spark.createDataFrame([("c", ["x", "y"]), ("d", None)], "condition string, action_ids array<string>")
    actions = spark.createDataFrame([("y", None, "positive")], "action string, label string, tone string")
    found = sorted(tuple(r) for r in knowledge.condition_chains(conditions, actions).collect())
    assert found == [("c", 0, "x", "not documented", "neutral"), ("c", 1, "y", None, "positive")]
