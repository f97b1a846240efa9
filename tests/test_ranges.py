"""JSON leaves, and drafts read in splits, against json and plain reading."""

from __future__ import annotations

import csv
import io
import json
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusloom.sources import documents, exports, leaves

VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-(10**20), 10**20) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=6),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4),
    max_leaves=12,
)


@settings(max_examples=300, deadline=None)
@given(VALUES)
def test_leaves_and_back(value):
    text = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    rows = [([{"key": k, "index": i} for k, i in steps], kind, v) for steps, kind, v in leaves.walk(leaves.decoded(text))]
    assert leaves.write(rows) == text


def test_leaf_table(spark):
    texts = ['{"b":[1,{"x y":"q"}],"a":null}', "[]", '"t"', None, '{"k":1,"k":2}', "[[],{}]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, document string")
    table = leaves.json_leaves(df, ["id"])
    found = {}
    for r in table.orderBy("id", "at").collect():
        found.setdefault(r.id, []).append((r.path, r.kind, r.value))
    assert found == {
        0: [("$.b[0]", "number", "1"), ('$.b[1]."x y"', "text", "q"), ("$.a", "null", "null")],
        1: [("$", "array", "")], 2: [("$", "text", "t")], 4: [("$.k", "number", "2")], 5: [("$[0]", "array", ""), ("$[1]", "object", "")],
    }
    back = {r.id: r.document for r in leaves.json_from_leaves(table, ["id"]).collect()}
    assert back == {0: texts[0], 1: "[]", 2: '"t"', 4: '{"k":2}', 5: "[[],{}]"}


@pytest.mark.parametrize("text", ["{", "NaN", "[" * 100_000])
def test_no_json_is_refused(spark, text):
    df = spark.createDataFrame([(1, text)], "id long, document string")
    with pytest.raises(Exception, match="no JSON document"):
        leaves.json_leaves(df, ["id"]).collect()


def random_draft(seed: int) -> dict:
    r = random.Random(seed)
    odd = ['}', '{"', '\\', '\\"', "]}", 'a"b}{', "é漢", "\n", "", "plain", '":[{']

    def item(i: int) -> dict:
        out = {"paper_id": i, "category": r.choice(odd) * r.randint(0, 3), "reason": "".join(r.choices(odd, k=3))}
        if r.random() < 0.4:
            out = {"more": [{"x": r.choice(odd)}, [], {}, [{}]] * r.randint(0, 4), **out}
        return out

    return {r.choice(odd) + str(d): [item(100 * d + i) for i in range(r.choice([0, 3, 5, 9]))] for d in range(r.randint(3, 5))}


@pytest.fixture
def small_splits(spark):
    """Every file is cut into splits of 300 bytes."""
    confs = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("form", ["line", "indented", "lines"])
def test_drafts_in_splits(spark, tmp_path, small_splits, form):
    want = []
    for seed in range(2):
        draft = random_draft(10 * seed + len(form))
        if form == "lines":
            text = "\n\n".join(json.dumps({d: items}, ensure_ascii=False) for d, items in draft.items()) + "\n"
        else:
            text = json.dumps(draft, ensure_ascii=bool(seed), indent=2 if form == "indented" else None)
        (tmp_path / f"f{seed}.json").write_text(("﻿" if seed == 1 else "") + text)
        want += [(d, json.dumps(i, sort_keys=True)) for d, items in draft.items() for i in items]
    rows = documents.draft_ranges(spark, str(tmp_path)).collect()
    assert sorted((r.dim, json.dumps(json.loads(r["item"]), sort_keys=True)) for r in rows) == sorted(want)
    assert len({(r.file, r.start) for r in rows}) > 2  # several splits
    labels = documents.read_draft(spark, str(tmp_path)).orderBy("seq").collect()
    assert sorted(r.paper_id for r in labels) == sorted(json.loads(i)["paper_id"] for _, i in want)


def test_order_of_a_split_draft(spark, tmp_path, small_splits):
    items = [{"paper_id": 1, "category": str(i), "reason": "}" * (i % 5)} for i in range(60)]
    (tmp_path / "d.json").write_text(json.dumps({"D": items}))
    assert [r.category for r in documents.read_draft(spark, str(tmp_path / "d.json")).orderBy("seq").collect()] == [str(i) for i in range(60)]


BROKEN = [
    "D,E\n1,2", '[{"paper_id": 1}]', '{"D": [{"paper_id": 1}]}\n{"D": oops', '{"D": [1]}', '{"D": {"Default": []}}',
    '{"D": "x"}', '{"D": [{"paper_id": 1}, "x"]}', '{"D": [{"paper_id": 1}]]}', '{"D": [{"paper_id": 1 "x"}]}', '{"D": [[{"a": 1}]]}', '{"D"}',
]


@pytest.mark.parametrize("text", BROKEN)
def test_broken_drafts_in_splits(spark, tmp_path, small_splits, text):
    (tmp_path / "d.json").write_text(text)
    with pytest.raises(Exception, match="no draft"):
        documents.read_draft(spark, str(tmp_path / "d.json")).collect()


@pytest.mark.parametrize(
    ("text", "kind"),
    [('{"D": [{"a": "}"}]}', "draft"), ('{"D": {"Default": [{"name": "x"}]}, "E": {}}', "taxonomy"), ('{"D": [], "E": {}}', "other"),
     ('{"D": null}', None), ("{}", None), ('{"D": 5}', "other"), ("[1]", "other"), ('{"D": null, "E": [{}]}', "draft")],
)
def test_kinds(spark, tmp_path, text, kind):
    (tmp_path / "d.json").write_text(text)
    assert documents.document_kind(spark, str(tmp_path / "d.json")) == kind
    (tmp_path / "e.json").write_text(json.dumps(json.loads(text), indent=3))
    assert documents.document_kind(spark, str(tmp_path / "e.json")) == kind


def test_one_file_with_all_dimensions_in_many_tasks(spark, tmp_path, small_splits):
    """3,001 labels in one file: no row holds more than a label, and many tasks read it."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    draft = {d: [{"paper_id": i, "category": f"{d} {i % 40}", "reason": "because " * 3} for i in range(1000)] for d in "ABC"}
    draft["A"].append({"paper_id": 1000, "category": "A", "reason": ""})
    (tmp_path / "d.json").write_text(json.dumps(draft, indent=2))
    rows = documents.draft_ranges(spark, str(tmp_path / "d.json"))
    assert rows.count() == 3001 and rows.select("start").distinct().count() > 10
    assert rows.agg(F.max(F.length("item"))).head()[0] < 200
    got = {(r.dim, r.paper_id) for r in documents.read_draft(spark, str(tmp_path / "d.json")).collect()}
    assert got == {(d, i["paper_id"]) for d, items in draft.items() for i in items}


CELLS = ["", "plain", 'say ""x""', "two\nlines", "a,b", "\t", '"', '5"', "é漢", "\n\n", '""', "x" * 70, ",\n,", "NA"]


def random_csv(seed: int, sep: str, end: str) -> tuple[str, list[list[str]]]:
    r = random.Random(seed)
    rows = [["id", f"Title{seed}", "Abstract"]] + [[f"r{i}", r.choice(CELLS), r.choice(CELLS) + r.choice(CELLS)] for i in range(40)]
    out = io.StringIO(newline="")
    csv.writer(out, delimiter=sep, lineterminator=end).writerows(rows)
    return out.getvalue(), rows


def plain_cells(rows: list[list[str]]) -> list[tuple]:
    return [tuple(None if c in exports.MISSING else c for c in r) for r in rows[1:]]


@pytest.mark.parametrize(("sep", "end", "suffix"), [(",", "\n", "csv"), ("\t", "\r\n", "tsv")])
def test_quoted_cells_over_splits(spark, tmp_path, small_splits, sep, end, suffix):
    files, want = [], {}
    for seed in range(2):
        text, rows = random_csv(seed, sep, end)
        path = tmp_path / f"f{seed}.{suffix}"
        path.write_bytes((b"\xef\xbb\xbf" if seed else b"") + text.encode())
        assert list(csv.reader(io.StringIO(text, newline=""), delimiter=sep)) == rows
        files.append(str(path))
        want[seed] = plain_cells(rows)
    headers = exports._headers_of(spark, str(tmp_path))
    got = exports.scan_records(spark, str(tmp_path), headers).orderBy("source_file", "_block", "_row").collect()
    for seed in range(2):
        assert [tuple(r.cells) for r in got if r.source_file.endswith(f"f{seed}.{suffix}")] == want[seed]
    assert len({r._block for r in got}) > 3
    whole = [r for f in files for r in exports.scan_delimited(spark, [f], list(headers.where(F.col("file").endswith(f)).head().names), sep, end).collect()]
    assert sorted(map(str, (tuple(r)[:3] for r in whole))) == sorted(str(tuple(r.cells)) for r in got)
    papers = exports.load_papers(spark, str(tmp_path)).orderBy("paper_id").collect()
    assert [(r.paper_id, r.id) for r in papers] == [(i + 1, f"r{i % 40}") for i in range(80)]


def test_splits_inside_one_cell(spark, tmp_path, small_splits):
    """A cell longer than several splits, with line ends and quotes all over it."""
    cell = 'a ""b"" , "" \n' * 120
    (tmp_path / "x.csv").write_text(f'Title,Abstract\nbefore,1\n"{cell}",2\nafter,"3\n"\n')
    got = exports.load_papers(spark, str(tmp_path)).orderBy("paper_id").collect()
    assert [(r.Title, r.Abstract) for r in got] == [("before", "1"), (cell.replace('""', '"'), "2"), ("after", "3\n")]


def test_many_layouts_are_one_scan(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"f{i:02}.csv").write_text(f"Title,Abstract,extra{i}\nt{i},a{i},e{i}\n")
    papers = exports.load_papers(spark, str(tmp_path))
    got = papers.orderBy("paper_id").collect()
    assert [(r.paper_title, r[f"extra{i}"], r[f"extra{(i + 1) % 30}"]) for i, r in enumerate(got)] == [(f"t{i}", f"e{i}", None) for i in range(30)]
    rows = exports.scan_records(spark, str(tmp_path), exports._headers_of(spark, str(tmp_path)))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 4  # whole records, parts, layouts: not one per file


@pytest.mark.parametrize("line", ['a,b', '"a","b', 'a","b', '""', '"""', '"a""', '","', 'x"y,"z', '"x"y,"z"', ',"', '"a"",b'])
def test_open_cells(line):
    """The state behind a line against the csv module: a record that goes on swallows the next line."""
    for inside in (False, True):
        text = ('"' if inside else "") + line + '\nEND"\n'
        rows = list(csv.reader(io.StringIO(text, newline="")))
        assert exports._inside_after(line, inside, ",") == ("\n" in "".join(rows[0]))


def test_small_splits_share_a_task(spark, tmp_path):
    """Many splits to a task, each read whole; tables that are no text in pieces keep their own splits."""
    from corpusloom.operators import ranges

    lines = [f"line {i}" for i in range(5000)]
    (tmp_path / "x.txt").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    with ranges.splits_of(spark, 512):
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
        with ranges.split_settings(spark):
            pieces = ranges.read_pieces(spark, str(tmp_path), "\n")
            assert pieces.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
            rows = pieces.collect()
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert len({r.start for r in rows}) > 50
    assert [r.value for r in sorted(rows, key=lambda r: (r.start, r.line))] == lines
