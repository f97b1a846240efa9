from __future__ import annotations

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import scratch
from corpusloom.plans import flows, translate
from corpusloom.plans.common import refuse_clashes
from corpusloom.sources import documents, exports, sinks

ODD_ROWS = '''"A ""quoted"" title","line one
line two",kw
NA,,
"　padded\t","{{output_lang}}",N/A
"A ""quoted"" title","line one
line two",kw
'''


def put(folder, name, text, bom=False):
    path = folder / name
    path.write_bytes((b"\xef\xbb\xbf" if bom else b"") + text.encode("utf-8"))
    return str(path)


HEADERS = [
    ("wos_tags.tsv", "TI\tAB\tDE\tID\tPY", "wos", {"title": "TI", "abstract": "AB", "keywords": "DE"}),
    ("wos_names.csv", "Article Title,Abstract,Author Keywords,Keywords Plus", "wos", {"title": "Article Title", "abstract": "Abstract", "keywords": "Author Keywords"}),
    ("scopus.csv", "Title,Abstract,Author Keywords,Index Keywords", "scopus", {"title": "Title", "abstract": "Abstract", "keywords": "Author Keywords"}),
    ("scopus_one_kw.csv", "Title,Abstract,Author Keywords", "wos", {"title": "Title", "abstract": "Abstract", "keywords": "Author Keywords"}),
    ("standard_zh.csv", "题目,摘要,关键词", "standard", {"title": "题目", "abstract": "摘要", "keywords": "关键词"}),
    ("fallback.csv", "Publication,Summary,note", "wos", {"title": "Publication", "abstract": "Summary", "keywords": None}),
    ("no_match.csv", "a1,b2", "wos", {"title": None, "abstract": None, "keywords": None}),
    ("dup_header.csv", "Title,Abstract,Title,Keywords", "wos", {"title": "Title", "abstract": "Abstract", "keywords": "Keywords"}),
]


def test_headers_dialects_and_columns(spark, tmp_path):
    for name, header, _, _ in HEADERS:
        put(tmp_path, name, header + "\n1,2\n", bom=True)
    headers = exports.read_headers(exports.list_files(spark, str(tmp_path)))
    headers = headers.withColumn("names", exports.dedup_names(F.col("names")))
    got = {}
    for r in exports.map_columns(headers).collect():
        got.setdefault(r.file.rsplit("/", 1)[-1], {"dialect": r.dialect})[r.role] = r.column
    assert got == {name: {"dialect": dialect, **columns} for name, _, dialect, columns in HEADERS}
    how = {(r.role, r.matched_by) for r in exports.map_columns(headers).where("file LIKE '%fallback.csv'").collect()}
    assert how == {("title", "fallback"), ("abstract", "fallback"), ("keywords", None)}
    forced = exports.map_columns(headers, "standard").where("file LIKE '%wos_names.csv'")
    assert {r.role: r.column for r in forced.collect()} == {"title": "Article Title", "abstract": "Abstract", "keywords": "Author Keywords"}


def test_csv_cells_read_like_pandas(spark, tmp_path):
    file = put(tmp_path, "odd.csv", "Title,Abstract,Keywords\n" + ODD_ROWS, bom=True)
    got = exports.load_papers(spark, file).orderBy("paper_id").collect()
    frame = pd.read_csv(file, encoding="utf-8-sig").astype(object)
    expected = [tuple(None if pd.isna(x) else x for x in row) for row in frame.itertuples(index=False)]
    assert [(r.Title, r.Abstract, r.Keywords) for r in got] == expected
    assert [r.paper_id for r in got] == [1, 2, 3, 4]
    assert [r.paper_title for r in got] == [e[0] for e in expected]


def test_repeated_header_names_read_like_pandas(spark, tmp_path):
    file = put(tmp_path, "dup.csv", "Title,Abstract,Title,Keywords,Title\nx,y,longer,k,z\n")
    row = exports.load_papers(spark, file).head()
    assert list(pd.read_csv(file).columns) == ["Title", "Abstract", "Title.1", "Keywords", "Title.2"]
    assert (row["Title"], row["Title.1"], row["Title.2"], row.paper_title) == ("x", "longer", "z", "x")


LINE_ENDS = [
    'Title,Abstract\r\n"x","line1\nline2"\r\n"y","z"\r\n',
    '"Ti\ntle",Abstract\r\n"x","q\r\nw"\r\ny,z\r\n"y","z"\r\n',
    'Title,Abstract\n"x\r\ny",z\n"q","r\r"\n',
    '"T\r\nx",Abstract\n"q","z"\na,b\n',
    'Title,"Abs ""ract"""\na,b',
]


@pytest.mark.parametrize("content", LINE_ENDS)
def test_line_ends_read_like_pandas(spark, tmp_path, content):
    file = put(tmp_path, "odd.csv", content, bom=True)
    frame = pd.read_csv(file, encoding="utf-8-sig")
    for through in ("arrow", "spark"):
        assert exports.read_headers(exports.list_files(spark, file), through).head().names == list(frame.columns)
    got = exports.load_papers(spark, file).orderBy("paper_id").select(*["`" + c + "`" for c in frame.columns]).collect()
    assert [list(r) for r in got] == frame.values.tolist()


def test_header_only_files(spark, tmp_path):
    put(tmp_path, "a.csv", "Title,Abstract")
    put(tmp_path, "b.csv", 'Title,5" disk\nx,y\n')
    got = {r.file[-5:]: r.names for r in exports.read_headers(exports.list_files(spark, str(tmp_path))).collect()}
    assert got == {"a.csv": ["Title", "Abstract"], "b.csv": ["Title", '5" disk']}


def test_headers_are_the_same_both_ways(spark, tmp_path):
    for name, header, _, _ in HEADERS:
        put(tmp_path, name, header + "\n1,2\n", bom=True)
    files = exports.list_files(spark, str(tmp_path))
    arrow, by_spark = (sorted((r.file, r.names) for r in exports.read_headers(files, way).collect()) for way in ("arrow", "spark"))
    assert arrow == by_spark and len(arrow) == len(HEADERS)


def test_names_that_differ_in_case_are_refused(spark, tmp_path):
    file = put(tmp_path, "case.csv", "Title,Abstract,Keywords,keywords\na,b,c,d\n")
    with pytest.raises(ValueError, match="differ in case"):
        exports.load_papers(spark, file)
    with pytest.raises(ValueError, match="differ in case"):
        refuse_clashes(spark.createDataFrame([(1, 2)], "paper_id int, Score int"), ["score"])


def test_unknown_file_type_is_refused(spark, tmp_path):
    file = put(tmp_path, "papers.xls", "x")
    with pytest.raises(Exception, match="unsupported"):
        exports.load_papers(spark, file)


def test_folder_of_layouts_is_one_table(spark, tmp_path):
    put(tmp_path, "a.csv", "Title,Abstract,Author Keywords,Index Keywords\nt1,a1,,ix\nt2,a2,k2,\n")
    put(tmp_path, "b.tsv", "TI\tAB\tDE\tID\tPY\nt3\ta3\t\tid3\t1999\n")
    put(tmp_path, "c.csv", "Title,Abstract,Author Keywords,Index Keywords\nt4,a4,k4,\n")
    papers = exports.load_papers(spark, str(tmp_path))
    got = [(r.paper_id, r.paper_title, r.PY) for r in papers.orderBy("paper_id").collect()]
    assert got == [(1, "t1", None), (2, "t2", None), (3, "t3", "1999"), (4, "t4", None)]
    texts = [r.x for r in papers.orderBy("paper_id").select(flows.text_of(papers).alias("x")).collect()]
    assert texts[2] == "Title: t3\nAbstract: a3\nKeywords: id3" and texts[0].endswith("Keywords: ")


def test_category_schemas(spark, tmp_path):
    def names(schema):
        return [(r.pos, r.name, r.definition) for r in documents.read_categories(spark, schema).orderBy("pos").collect()]

    assert names(" A, ,B ") == [(0, "A", None), (1, "B", None)]
    assert names(put(tmp_path, "c.txt", "A\n\n B \n")) == [(0, "A", None), (1, "B", None)]
    assert names(put(tmp_path, "c.json", '["A", "B"]')) == [(0, "A", None), (1, "B", None)]
    defined = put(tmp_path, "d.json", '{"B": "first", "A": "second"}')
    assert names(defined) == [(0, "B", "first"), (1, "A", "second")]
    assert documents.schema_text(documents.read_categories(spark, "A,B")).head().schema_text == "- A\n- B"
    assert names("") == []
    assert documents.read_categories(spark, put(tmp_path, "e.json", '"by method, in your own words"')) == "by method, in your own words"
    text = documents.schema_text(documents.read_categories(spark, defined)).head().schema_text
    assert json.loads(text) == {"B": "first", "A": "second"} and text.index("B") < text.index("A")


def test_taxonomy_files(spark, tmp_path):
    assert documents.read_taxonomy_json(spark, str(tmp_path / "none.json")).isEmpty()
    file = put(tmp_path, "t.json", json.dumps({"D": {"Default": [{"name": "A", "keywords": "k"}, {"name": "B", "keywords": ["x", "y"], "typical_cases": ["c"]}]}, "E": {"Default": []}}))
    got = documents.read_taxonomy_json(spark, file).orderBy("pos").collect()
    assert [(r.dim, r.grp, r.pos, r.name, r.keywords, r.typical_cases) for r in got] == [
        ("D", "Default", 0, "A", ["k"], None), ("D", "Default", 1, "B", ["x", "y"], ["c"]),
    ]


def test_taxonomy_of_several_dimensions_through_json(spark, tmp_path):
    rows = [(d, "Default", i, f"{d}{i}", "two\nlines", "", ["k"], ["c"], '"x":{"z":1,"a":[]}' if i else None) for d in ("A", "B", "C") for i in range(2)]
    taxonomy = spark.createDataFrame(rows, documents.TAXONOMY).coalesce(1)
    out = str(tmp_path / "tax")
    documents.taxonomy_documents(taxonomy).coalesce(1).select("document").write.text(out)
    back = documents.read_taxonomy_json(spark, out)
    assert sorted(map(tuple, back.collect())) == rows


def test_whole_file_draft(spark, tmp_path):
    file = put(tmp_path, "d.json", json.dumps({"D": [{"paper_id": 2, "category": "x", "reason": "r"}, {"paper_id": 1, "category": "y", "reason": ""}], "E": []}, indent=2))
    got = {tuple(r)[:5] for r in documents.read_draft(spark, file).collect()}
    assert got == {("D", 2, 2, "x", "r"), ("D", 1, 1, "y", "")}


def test_drafts_of_both_kinds_in_one_folder(spark, tmp_path):
    put(tmp_path, "a.json", json.dumps({"D": [{"paper_id": 1, "category": "x"}]}, indent=2))
    put(tmp_path, "b.json", '{"D": [{"paper_id": 2, "category": "y"}]}\n\n{"E": [{"paper_id": 3}]}\n')
    got = {(r.dim, r.paper_id, r.category) for r in documents.read_draft(spark, str(tmp_path)).collect()}
    assert got == {("D", 1, "x"), ("D", 2, "y"), ("E", 3, "")}


def test_whole_file_drafts_are_bounded(spark, tmp_path, monkeypatch):
    """One object a file, but a file holds a block and not a whole dimension; paths stay in a table."""
    from corpusloom.checks import converge as checks
    from tests.conftest import DATA

    monkeypatch.setattr(checks, "FILE_BLOCK", 10, raising=False)
    monkeypatch.setattr(checks, "new_path", lambda spark, name: str(tmp_path / name))
    back = checks.draft_file(spark, DATA)
    files = list((tmp_path / "draft").rglob("*.txt"))
    sizes = [sum(len(items) for items in json.loads(f.read_text()).values()) for f in files]
    assert len(files) > 3 and max(sizes) <= 10 and sum(sizes) == back.count() > 100
    assert "part-0" not in back._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("text", ['{"D": [', "D,E\n1,2", '[{"paper_id": 1}]', '{"D": [{"paper_id": 1}]}\n{"D": oops'])
def test_broken_drafts_are_refused(spark, tmp_path, text):
    file = put(tmp_path, "d.json", text)
    with pytest.raises(Exception, match="no draft"):
        documents.read_draft(spark, file).collect()


def test_translate_refuses_what_it_does_not_know(spark, tmp_path):
    said = F.concat(F.lit("fr:"), "value")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        flows.translate_file(spark, str(tmp_path / "none.json"), str(tmp_path / "o"), said)
    for i, text in enumerate(['"a"', "{'a': 1}", '{"a": [1}', ""]):
        file = put(tmp_path, f"x{i}.json", text)
        if text:
            with pytest.raises(Exception, match="neither a|no JSON"):
                flows.translate_file(spark, file, str(tmp_path / "o"), said)
        else:
            assert flows.translate_file(spark, file, str(tmp_path / "o"), said).isEmpty()


def test_translate_takes_json_of_any_shape(spark, tmp_path):
    said = F.when(F.col("value") != "no", F.concat(F.lit("fr:"), "value"))
    texts = {
        '{"b": "bb", "a": {"x": [1.50, null, true, "c", "no", {"z": "zz", "y": {}}], "w": []}}':
            '{"b":"fr:bb","a":{"x":[1.50,null,true,"c","no",{"z":"fr:zz","y":{}}],"w":[]}}',
        '["one", ["two"], {"k\\"ey": "th}ree"}]': '["fr:one",["fr:two"],{"k\\"ey":"fr:th}ree"}]',
        '{"a": {"Default": []}, "b": [1]}': '{"a":{"Default":[]},"b":[1]}',
        '{\n "D": {"Default": [{"extra": {"n": 1, "m": ["qq"]}, "name": "nn", "keywords": "kk"}]}\n}':
            '{"D":{"Default":[{"extra":{"n":1,"m":["fr:qq"]},"name":"fr:nn","keywords":"fr:kk"}]}}',
    }
    for i, (text, want) in enumerate(texts.items()):
        out = str(tmp_path / f"o{i}")
        flows.translate_file(spark, put(tmp_path, f"y{i}.json", text), out, said)
        assert [r.value for r in spark.read.text(out).collect()] == [want]


def test_translated_drafts_keep_further_fields(spark, tmp_path):
    items = [{"note": {"z": "zz", "a": [2]}, "paper_id": 2, "category": "cc", "reason": "rr"}, {"paper_id": 3, "category": "}{", "reason": None}]
    file = put(tmp_path, "d.json", json.dumps({"D }": items, "E": [], "F": None}, indent=1))
    labels = flows.translate_file(spark, file, str(tmp_path / "out"), F.concat(F.lit("fr:"), "value"))
    assert sorted((r.dim, r.paper_id, r.category) for r in labels.collect()) == [("D }", 2, "fr:cc"), ("D }", 3, "fr:}{")]
    (line,) = spark.read.option("recursiveFileLookup", "true").text(str(tmp_path / "out")).collect()
    assert json.loads(line.value) == {"D }": [{"note": {"z": "fr:zz", "a": [2]}, "paper_id": 2, "category": "fr:cc", "reason": "fr:rr"}, {"paper_id": 3, "category": "fr:}{", "reason": None}]}
    assert line.value.index("note") < line.value.index("paper_id")


def test_converge_keeps_further_fields_of_categories(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def model(prompts):
        for p in prompts:
            seen.add('"colour":{"z":1,"a":["é"]}' in p)
        category = {"colour": {"z": 1, "a": ["é"]}, "name": "A", "keywords": "k", "size": 1.5, "note": None}
        return [json.dumps({"refined_categories": [category, "odd"], "mapping": {}}, ensure_ascii=False)] * len(prompts)

    labels = spark.createDataFrame([("D", i, i, f"l{i}", "r") for i in range(40)], documents.LABELS)
    tax = str(tmp_path / "tax.json")
    got = flows.converge(spark, labels, tax, model, qps=0)
    extra = '"colour":{"z":1,"a":["é"]},"size":1.5,"note":null'
    assert sorted((r.pos, r.name, r.extra) for r in got.collect()) == [(0, "A", extra), (1, "", None)]
    assert seen.value == 1  # the second chunk's prompt
    flows.converge(spark, labels.withColumn("dim", F.lit("E")), tax, F.lit(None).cast("string"))
    kept = [json.loads(r.value) for r in spark.read.text(tax).collect()]
    assert [k["D"]["Default"][0] for k in kept if "D" in k] == [{"name": "A", "keywords": ["k"], "colour": {"z": 1, "a": ["é"]}, "size": 1.5, "note": None}]


def test_translate_draft_keeps_every_label(spark, tmp_path):
    items = [{"paper_id": 1, "category": "zz", "reason": "r1"}, {"paper_id": 1, "category": "aa", "reason": "r2"}]
    file = put(tmp_path, "d.json", json.dumps({"D": items}, indent=1))
    flows.translate_file(spark, file, str(tmp_path / "out"), F.concat(F.lit("fr:"), "value"))
    back = documents.read_draft(spark, str(tmp_path / "out")).orderBy("seq").collect()
    assert [(r.paper_id, r.category) for r in back] == [(1, "fr:zz"), (1, "fr:aa")]


def test_the_last_label_of_a_paper_wins(spark, tmp_path):
    items = [{"paper_id": 1, "category": "z", "reason": ""}, {"paper_id": 1, "category": "a", "reason": ""}]
    file = put(tmp_path, "d.json", json.dumps({"D": items}, indent=1))
    papers = spark.createDataFrame([(1, "t")], "paper_id long, paper_title string")
    out = str(tmp_path / "papers")
    flows.converge(spark, file, str(tmp_path / "t.json"), F.lit(None).cast("string"), papers=papers, output_papers=out)
    assert [r.D_category for r in spark.read.parquet(out).collect()] == ["a"]


def test_converge_keeps_other_dimensions_of_a_json_taxonomy(spark, tmp_path):
    tax = put(tmp_path, "tax.json", json.dumps({"Old": {"Default": [{"name": "O"}]}}, indent=1))
    labels = spark.createDataFrame([("D", 1, 1, "a", "r")], documents.LABELS)
    reply = F.lit(json.dumps({"refined_categories": [{"name": "A"}], "mapping": {"a": "A"}}))
    for _ in range(2):
        flows.converge(spark, labels, tax, reply)
        got = {(r.dim, r.name) for r in documents.read_taxonomy_json(spark, tax).collect()}
        assert got == {("Old", "O"), ("D", "A")}


def test_flows_leave_only_their_results(spark, tmp_path):
    file = put(tmp_path, "in.csv", "Title,Abstract,Keywords\nx1,a,k\ny,b,\n")
    elsewhere = str(tmp_path / "kept")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(scratch, "scratch_folder", lambda _: str(tmp_path / "scratch"))
        with scratch.cleared(spark):
            flows.filter_papers(spark, file, elsewhere, "x", scores(), criteria_responder=F.lit("{}"))
            assert any((tmp_path / "scratch").rglob("*.parquet"))
    assert not list((tmp_path / "scratch").rglob("*.parquet"))
    assert spark.read.parquet(elsewhere).count() == 1


def test_long_header_is_read_whole(spark, tmp_path):
    names = [f"column {i} " + "x" * 20_000 for i in range(81)]
    file = put(tmp_path, "wide.csv", ",".join(names) + "\n" + ",".join("1" * 81) + "\n")
    headers = exports.headers_by_arrow(exports.list_files(spark, file)).head()
    assert headers.names == names


def test_rows_wider_than_the_header_are_refused(spark, tmp_path):
    file = put(tmp_path, "w.csv", "Title,Abstract\na,b\nshort\n")
    assert exports.load_papers(spark, file).count() == 2
    file = put(tmp_path, "x.csv", "Title,Abstract\na,b\na,b,EXTRA\n")
    with pytest.raises(Exception, match="more cells than the header"):
        exports.load_papers(spark, file)


def test_repeated_names_stay_apart(spark, tmp_path):
    file = put(tmp_path, "n.csv", "Title,Title.1,Title,Abstract,Title\na,b,c,d,e\n")
    row = exports.load_papers(spark, file).head()
    assert (row["Title"], row["Title.1"], row["Title.2"], row["Title.3"]) == ("a", "b", "c", "e")


def test_large_files_may_be_split(spark, tmp_path):
    file = put(tmp_path, "big.csv", "Title,Abstract\n" + "".join(f"t{i},a\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        names = ["Title", "Abstract"]
        assert exports.scan_delimited(spark, [file], names, ",", multi_line=False).rdd.getNumPartitions() > 3
        loaded = exports.load_papers(spark, file, multi_line=False)
        assert loaded.where(F.concat(F.lit("t"), F.col("paper_id") - 1) != F.col("Title")).isEmpty()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_sink_starts_with_a_bom(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(1, ' a "b"\nc'), (2, None)], "id int, t string").coalesce(1)
    sinks.write_csv(df, out)
    part = next((tmp_path / "out").glob("*.csv"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbfid,t")
    assert list(pd.read_csv(part, encoding="utf-8-sig").t)[0] == ' a "b"\nc'


def test_replace_table_may_overwrite_its_input(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.range(3).write.parquet(path)
    sinks.replace_table(spark.read.parquet(path).withColumn("id", F.col("id") + 10), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [10, 11, 12]


def scores():
    return F.to_json(F.struct(F.when(F.col("paper_title").contains("x"), 5).otherwise(2).alias("score")))


def test_filter_flow(spark, tmp_path):
    file = put(tmp_path, "in.csv", "Title,Abstract,Keywords\nx1,a,k\ny,b,\nx2,c,NA\n")
    out = str(tmp_path / "kept")
    criteria = F.lit('{"criteria": {"5": "all x"}}')
    done = flows.filter_papers(spark, file, out, "x", scores(), criteria_responder=criteria)
    assert done.count() == 3
    assert sorted(r.paper_id for r in spark.read.parquet(out).collect()) == [1, 3]
    assert spark.read.parquet(out + "_all").count() == 3


def test_filter_flow_with_a_python_responder(spark, tmp_path):
    file = put(tmp_path, "in.csv", "Title,Abstract,Keywords\nx1,a,k\ny,b,\nx1,a,k\n")

    def answer(prompts):
        return ['{"score": 4}' if "Title: x" in p else None for p in prompts]

    done = flows.filter_papers(spark, file, None, "x", answer, qps=0, backoff_s=0)
    assert [(r.paper_id, r.score, r.response_ok) for r in done.orderBy("paper_id").collect()] == [(1, 4.0, True), (2, 1.0, False), (3, 4.0, True)]


def test_explore_and_converge_flows_update_in_place(spark, tmp_path):
    file = put(tmp_path, "in.csv", "Title,Abstract,Keywords\nt1,a,k\nt2,b,k\nt3,a,k\n")
    label = F.to_json(F.struct(F.struct(F.col("paper_abstract").alias("category"), F.col("paper_title").alias("reason")).alias("App")))
    labels = flows.explore(spark, file, str(tmp_path / "draft"), label, dims="App")
    back = documents.read_draft(spark, str(tmp_path / "draft"))
    assert sorted(tuple(r)[:5] for r in back.collect()) == sorted(map(tuple, labels.collect()))
    papers = exports.load_papers(spark, file)
    tax, out = str(tmp_path / "tax"), str(tmp_path / "labelled")
    old = documents.empty(spark, documents.TAXONOMY).unionByName(
        spark.createDataFrame([("Old", "Default", 0, "O", "", "", ["k"], ["c"], None), ("App", "Default", 0, "gone", "", "", None, None, None)], documents.TAXONOMY)
    )
    old.write.parquet(tax)
    reply = F.lit(json.dumps({"refined_categories": [{"name": "AB"}], "mapping": {"a": "AB"}}))
    flows.converge(spark, labels, tax, reply, dims="App,Nope", papers=papers, output_papers=out)
    assert {(r.dim, r.name) for r in spark.read.parquet(tax).collect()} == {("Old", "O"), ("App", "AB")}
    got = {r.paper_id: (r.App_raw_category, r.App_category, r.App_reason) for r in spark.read.parquet(out).collect()}
    assert got == {1: ("a", "AB", "t1"), 2: ("b", "b", "t2"), 3: ("a", "AB", "t3")}
    assert spark.read.parquet(tax).where("dim = 'App'").head().typical_cases == ["《t1》: t1", "《t3》: t3"]
    again = F.lit(json.dumps({"mapping": {"a": "Z"}}))
    flows.converge(spark, labels.where("paper_id = 1"), tax, again, papers=papers, output_papers=out)
    assert {r.dim for r in spark.read.parquet(tax).collect()} == {"Old"}  # App was processed and has no category left
    got = {r.paper_id: r.App_category for r in spark.read.parquet(out).collect()}
    assert got == {1: "Z", 2: "b", 3: "AB"}


def test_classify_flow(spark, tmp_path):
    file = put(tmp_path, "in.csv", "Title,Abstract,Keywords\nt1,a,k\nt2,b,k\n")
    reply = F.to_json(F.struct(F.array("paper_abstract", F.lit("B")).alias("category"), F.col("prompt").alias("reason")))
    done = flows.classify(spark, file, str(tmp_path / "out"), "A, B", reply, mode="multi", as_csv=True)
    rows = done.orderBy("paper_id").collect()
    assert [r.classify_category for r in rows] == ["a; B", "b; B"]
    assert "- A\n- B" in rows[0].classify_reason and "multi" in rows[0].classify_reason


def test_translate_with_a_python_responder(spark):
    calls = spark.sparkContext.accumulator(0)

    def answer(prompts):
        calls.add(len(prompts))
        out = []
        for p in prompts:
            body = p.split("\n\n", 1)[1]
            if body.startswith("["):
                out.append(json.dumps({t: t.upper() for t in json.loads(body) if t != "skip"} | {"invented": "I"}))
            else:
                out.append(body.upper())
        return out

    long = "word " * 1200
    rows = [(1, "red", long), (2, "blue", long), (3, "red", None), (4, "skip", "")]
    df = spark.createDataFrame(rows, "paper_id bigint, colour string, body string")
    done = translate.translate_columns(df, "colour, body, missing", answer, qps=0, backoff_s=0)
    got = {r.paper_id: (r.colour, r.body) for r in done.collect()}
    assert got == {1: ("RED", long.upper()), 2: ("BLUE", long.upper()), 3: ("RED", None), 4: ("skip", "")}
    assert calls.value <= 1 + 2 * 3  # one list; the long text, and the empty one three times at most
    assert translate.translate_columns(df, "missing", answer) is df


def test_translate_keeps_structure(spark):
    rows = [("D", "Default", 0, "name", "definition", None, ["k1", "x"], ["c1", "c2"], '"more":{"z":["ab",1]}'), ("D", "Default", 1, "n", "definition", "j", None, [], None)]
    taxonomy = spark.createDataFrame(rows, documents.TAXONOMY)
    reply = F.when(F.col("value") != "c2", F.upper("value"))
    got = translate.translate_taxonomy(taxonomy, reply).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [
        ("D", "Default", 0, "NAME", "DEFINITION", None, ["K1", "x"], ["C1", "c2"], '"more":{"z":["AB",1]}'),
        ("D", "Default", 1, "n", "DEFINITION", "j", None, [], None),
    ]


def test_results_go_through_csv_with_their_ids(spark, tmp_path):
    file = put(tmp_path, "in.csv", "Title,Abstract,Keywords\nx1,a,k\ny,b,\nx2,c,NA\n")
    out = str(tmp_path / "kept")
    flows.filter_papers(spark, file, out, "x", scores(), criteria_responder=F.lit("{}"), as_csv=True)
    again = exports.load_papers(spark, out)
    assert sorted((r.paper_id, r.paper_title, r.score) for r in again.collect()) == [(1, "x1", "5.0"), (3, "x2", "5.0")]
    scored = flows.filter_papers(spark, again, None, "x", scores(), criteria_responder=F.lit("{}"))
    assert dict(scored.dtypes)["score"] == "double" and scored.columns.count("score") == 1


def test_templates_of_the_users_own(spark, tmp_path):
    file = put(tmp_path, "in.csv", "Title,Abstract,Keywords\nt,a,k\n")
    put(tmp_path, "classify.md", "{{paper_id}}|{{classify_mode}}|{{schema_text}}|{{output_lang}}")
    reply = F.to_json(F.struct(F.col("prompt").alias("reason")))
    done = flows.classify(spark, file, str(tmp_path / "out"), "A,B", reply, prompt_dir=str(tmp_path), output_lang="French")
    assert done.head().classify_reason == "1|single|- A\n- B|French"


def test_translate_flow_on_files(spark, tmp_path):
    file = put(tmp_path, "in.csv", "Title,Abstract,Keywords\nred,a,k\nblue,b,k\nred,c,\n")
    texts = F.to_json(F.map_from_entries(F.transform("texts", lambda x: F.struct(x, F.upper(x)))))
    done = flows.translate_file(spark, file, str(tmp_path / "out"), texts, "Title,Nope")
    assert [(r.Title, r.Abstract) for r in done.orderBy("paper_id").collect()] == [("RED", "a"), ("BLUE", "b"), ("RED", "c")]
    tax = put(tmp_path, "t.json", json.dumps({"D": {"Default": [{"name": "ab", "keywords": ["cd", "e"]}]}}))
    flows.translate_file(spark, tax, str(tmp_path / "tax"), F.upper("value"))
    back = documents.read_taxonomy_json(spark, str(tmp_path / "tax")).head()
    assert (back.dim, back.name, back.keywords) == ("D", "AB", ["CD", "e"])
    with pytest.raises(Exception, match="unsupported"):
        flows.translate_file(spark, put(tmp_path, "x.doc", "a"), str(tmp_path / "no"), texts, "Title")
    with pytest.raises(ValueError, match="columns"):
        flows.translate_file(spark, file, str(tmp_path / "no"), texts)


def test_converge_flow_reads_a_written_draft(spark, tmp_path):
    labels = spark.createDataFrame([("D", 1, 1, "a", "r")], documents.LABELS)
    documents.write_draft(labels, str(tmp_path / "draft"))
    reply = F.lit(json.dumps({"refined_categories": [{"name": "A"}], "mapping": {"a": "A"}}))
    got = flows.converge(spark, str(tmp_path / "draft"), str(tmp_path / "tax"), reply)
    assert [(r.dim, r.name, r.typical_cases) for r in got.collect()] == [("D", "A", None)]
    assert flows.converge(spark, labels, str(tmp_path / "tax"), reply, dims="X").isEmpty()


def test_converge_takes_no_steps_for_nothing(spark, tmp_path, monkeypatch):
    """Labels are counted once; where no answer maps anything, no chains are followed and no cases looked up."""
    labels = spark.createDataFrame([("D", 1, 1, "a", "r"), ("D", 2, 2, "b", "s")], documents.LABELS)
    papers = spark.createDataFrame([(1, "t1"), (2, "t2")], "paper_id long, paper_title string")
    written = []
    for module in (flows, flows.conv):
        monkeypatch.setattr(module, "settle", lambda df, label, by=None, settle=module.settle: written.append(label) or settle(df, label, by))
    out = str(tmp_path / "labelled")
    got = flows.converge(spark, labels, str(tmp_path / "tax"), F.lit(None).cast("string"), papers=papers, output_papers=out)
    assert got.isEmpty() and written.count("label_counts") == 1 and not {"moves", "cases"} & set(written)
    rows = {r.paper_id: (r.D_raw_category, r.D_category, r.D_reason) for r in spark.read.parquet(out).collect()}
    assert rows == {1: ("a", "a", "r"), 2: ("b", "b", "s")}


def test_drafts_are_parsed_below_the_join(spark, tmp_path):
    """All tasks that hold items parse them, not the few that a join of small tables has."""
    labels = spark.createDataFrame([("D", 1, 1, "a", "r"), ("E", 1, 1, "b", "s")], documents.LABELS)
    documents.write_draft(labels, str(tmp_path / "draft"))
    found = documents.read_draft(spark, str(tmp_path / "draft"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("from_json(")
    assert sorted(tuple(r)[:5] for r in found.collect()) == sorted(map(tuple, labels.collect()))
