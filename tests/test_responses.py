from __future__ import annotations

import pytest

from corpusloom.functions import responses as r

SCORES = [
    (None, (1.0, "", "", False, False)),
    ("{}", (1.0, "", "", False, False)),
    ("no json", (1.0, "", "", False, False)),
    ("[1]", (1.0, "", "", False, False)),
    ('{"score": "4", "reason": "r", "keywords": ["a", "b"]}', (4.0, "r", "a; b", True, True)),
    ('{"score": 4.5, "keywords": "a"}', (4.5, "", "a", True, True)),
    ('{"score": 7}', (7.0, "", "", True, True)),
    ('{"score": null}', (1.0, "", "", False, True)),
    ('{"reason": "only"}', (1.0, "only", "", False, True)),
    ('{"score": 3}', (3.0, "", "", True, True)),
]


@pytest.mark.parametrize(("response", "expected"), SCORES)
def test_scores(spark, response, expected):
    df = spark.createDataFrame([(response,)], "response string")
    row = r.with_score(df).head()
    assert (row.score, row.reason, row.match_keywords, row.passed, row.response_ok) == expected


CLASSES = [
    ("single", '{"category": "A", "reason": "r", "keywords": ["x", "y"]}', ("A", "r", "x; y", True)),
    ("single", '{"category": ["A", "B"]}', ("A; B", "", "", False)),
    ("multi", '{"category": ["A", "B"], "keywords": "k"}', ("A; B", "", "k", True)),
    ("multi", '{"category": "A"}', ("A", "", "", False)),
    ("multi", '{"category": [], "keywords": []}', ("", "", "", True)),
    ("single", '{"category": null}', ("", "", "", True)),
    ("single", None, ("", "", "", True)),
]


@pytest.mark.parametrize(("mode", "response", "expected"), CLASSES)
def test_classes(spark, mode, response, expected):
    df = spark.createDataFrame([(response,)], "response string")
    row = r.with_classes(df, mode).head()
    assert (row.classify_category, row.classify_reason, row.classify_keywords, row.shape_ok) == expected


def test_labels_take_objects_only(spark):
    from corpusloom.plans.explore import dims_of, labels_of

    rows = [
        (1, '{"D": {"category": "x", "reason": "y"}, "E": "{\\"category\\": \\"text\\"}", "F": [1], "G": {}}'),
        (2, '{"D": {"category": null}, "H": null}'),
        (3, None),
        (4, "junk"),
    ]
    df = spark.createDataFrame(rows, "paper_id bigint, response string")
    got = {(x.dim, x.paper_id, x.category, x.reason) for x in labels_of(df).collect()}
    assert got == {("D", 1, "x", "y"), ("G", 1, "", ""), ("D", 2, "", "")}
    assert {tuple(x) for x in dims_of(df).collect()} == {("D", 2), ("E", 0), ("F", 0), ("G", 1), ("H", 0)}
