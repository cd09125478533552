import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.functions import text as X
from ledgerline.functions.markdown import render
from ledgerline.operators import audit as A
from ledgerline.operators import grids as H
from ledgerline.operators import joins as J
from ledgerline.operators import series as S
from ledgerline.operators import validate as V
from ledgerline.sources import sinks, tables


def col(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def out(df, c):
    return [r[0] for r in df.orderBy("i").select(c).collect()]


def test_normalize(spark):
    df = spark.createDataFrame([(0, "atomic_mass", " - 4 "), (1, "name", "a  b"), (2, "typography", "Small Caps"), (3, "symbol", "—5"), (4, "name", None), (5, "note", "‘x’"), (6, "name", "é")], "i int, f string, v string")
    assert out(df, X.normalize(F.col("f"), F.col("v"))) == ["−4", "a b", "smallcaps", "—5", "", "'x'", "é"]


def test_uncertain_reading(spark):
    df = col(spark, ["[uncertain:At.|At:]", "A[uncertain:b|c]d", "plain"])
    assert out(df, X.uncertain_alternatives(F.col("v"))) == [["At.", "At:"], ["Abd", "Acd"], []]
    assert out(df, X.compare(F.lit("Abd"), F.col("v"), X.uncertain_alternatives(F.col("v")))) == ["differ", "agree-uncertain", "differ"]


def test_both_uncertain_is_agreed(spark):
    cells = lambda v: spark.createDataFrame([(1, "name", v)], "k int, field string, value string")
    got = A.audit(cells("x"), cells("[uncertain:x|y]"), cells("[uncertain:z|x]"), ["k"], lambda f, v: v, lambda f, r: X.uncertain_alternatives(r)).first()
    assert (got.verdict_a, got.verdict_b, got["class"]) == ("agree-uncertain", "agree-uncertain", "agreed")


def test_numbers_and_folios(spark):
    assert out(col(spark, ["*2.92", "—169", "−4.5", "x", None]), X.printed_number(F.col("v"))) == [2.92, -169.0, -4.5, None, None]
    assert out(col(spark, ["[83]", "83", "none", None]), X.folio(F.col("v"))) == [83, 83, None, None]


@pytest.mark.parametrize("fault,check", [("ok", set()), ("domain", {"d"}), ("null", {"r", "d"}), ("twice", {"u"}), ("dangling", {"f"})])
def test_validators_find_their_fault(spark, fault, check):
    rows = [(1, "a", 1), (2, "b", 1)]
    rows = {"ok": rows, "domain": [(1, "z", 1)], "null": [(1, None, 1)], "twice": [*rows, (1, "a", 1)], "dangling": [(1, "a", 9)]}[fault]
    df = spark.createDataFrame(rows, "k int, v string, ref int")
    to = spark.createDataFrame([(1,)], "id int")
    got = V.union(V.in_domain(df, "d", "k", "v", ["a", "b"]), V.required(df, "r", "k", ["v"]), V.unique(df, "u", "k"), V.refers(df, "f", "k", "ref", to, "id"))
    assert {r.check_id for r in got.collect()} == check


def test_schema_subset(spark):
    schema = {"type": "object", "required": ["id", "tags"], "properties": {"id": {"type": "string", "pattern": "^E"}, "n": {"type": "integer", "enum": [1, 2]}, "tags": {"type": "array", "items": {"$ref": "#/$defs/tag"}}}, "$defs": {"tag": {"type": "string"}}}
    df = col(spark, ['{"id":"E1","n":1,"tags":["a"]}', '{"id":"X","n":3,"tags":["a"]}', '{"n":1,"tags":[1]}', "no json"])
    got = {}
    for r in V.schema_violations(df, "i", "v", schema).collect():
        got.setdefault(r.entity_key, set()).add(r.message)
    assert got == {"1": {"$.id: pattern", "$.n: enum"}, "2": {"$: required id", "$.tags[]: type"}, "3": {"$: no JSON"}}


def test_sources(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('k\tv\n1\t\n2\ta"b\n')
    assert [tuple(r) for r in tables.read_tsv(spark, str(tmp_path / "a.tsv"), ["k", "v"]).orderBy("k").collect()] == [("1", ""), ("2", 'a"b')]
    (tmp_path / "c.tsv").write_text("# note\nk\tv\n1\tx\n\n2\n")
    rows, bad = tables.read_commented_tsv(spark, str(tmp_path / "c.tsv"), ["k", "v"])
    assert [(r._line, r.k, r.v) for r in rows.collect()] == [(3, "1", "x")] and [(r.line, r.message) for r in bad.collect()] == [(5, "1 cells")]
    empty = tables.optional(spark, lambda: spark.read.parquet(str(tmp_path / "none")), spark.range(0).schema)
    assert empty.count() == 0
    (tmp_path / "x.bin").write_bytes(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\0\1\2\0\0\0\7")
    f = tables.file_inventory(spark, str(tmp_path), "*.bin").select("bytes", "sha256", tables.png_size(F.col("content")).alias("s")).first()
    assert (f.bytes, f.s.width, f.s.height) == (24, 258, 7)
    svg = col(spark, ['<svg viewBox="0 0 10.4 20.6">', "<svg>"])
    assert out(svg, tables.view_box_size(F.col("v"))) == [(10, 21), None]


def test_sinks(spark):
    df = col(spark, ['a\tb', 'c"d', "e", None])
    assert out(df, sinks.tsv_line([F.col("v"), F.lit("z")], "\r\n")) == ['"a\tb"\tz\r\n', '"c""d"\tz\r\n', "e\tz\r\n", "\tz\r\n"]
    text = col(spark, ["x\n| a |\n| b |\n\nrest"])
    assert out(text, sinks.splice(F.col("v"), "| a |", F.lit("NEW"))) == ["x\nNEW\n\nrest"]
    with pytest.raises(Exception, match="no section"):
        out(col(spark, ["nothing"]), sinks.splice(F.col("v"), "| a |", F.lit("NEW")))


def test_joins(spark):
    left, right = spark.createDataFrame([(1, 0.0), (2, 10.0)], "a int, x double"), spark.createDataFrame([(1, 7.0), (2, -7.0), (3, 17.1)], "b int, y double")
    assert {(r.a, r.b) for r in J.band_join(left, "x", right, "y", 7.0).collect()} == {(1, 1), (1, 2), (2, 1)}
    assert {(r.a, r.b) for r in J.nearest(left, "a", "x", right, "b", "y", 7.0).collect()} == {(1, 2), (2, 1)}
    assert {(r.a, r.b) for r in J.nearest(left, "a", "x", right, "b", "y", 7.0, last_wins=False).collect()} == {(1, 1), (2, 1)}
    p = spark.createDataFrame([("k", 0.0, 0.0), ("k", 10.0, 100.0)], "k string, t double, v double")
    q = spark.createDataFrame([("k", -1.0), ("k", 2.5), ("k", 10.0), ("k", 11.0)], "k string, t double")
    assert [r.v for r in J.interpolate(p, "k", "t", "v", q, "t").orderBy("t").collect()] == [0.0, 25.0, 100.0, 100.0]


def test_connectivity(spark):
    diagonal = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (2, 0, 0)], "image int, y int, x int")
    n = lambda corners: H.label_runs(diagonal, ["image"], "y", "x", corners).select("comp").distinct().count()
    assert (n(True), n(False)) == (2, 3)


def test_morphology_clears_the_border(spark):
    block = spark.createDataFrame([(y, x) for y in range(3) for x in range(3)], "y int, x int")
    assert [(r.y, r.x) for r in H.erode(block, [], "y", "x").collect()] == [(1, 1)]
    assert H.erode(H.dilate(block, [], "y", "x"), [], "y", "x").count() == 9


def test_otsu_takes_the_first_maximum(spark):
    h = spark.createDataFrame([(i, 10 if i in (2, 200) else 0) for i in range(256)], "bin int, n long")
    assert H.otsu(h).first().threshold == 2 == H.otsu_of(np.array([2] * 10 + [200] * 10))


def test_series():
    assert S.monotonic_guard(np.array([5.0, 6.0, 3.0]))[0].tolist() == [5, 4, 3]
    assert S.suppress(np.array([1, 2, 9]), np.array([1, 5, 1]), 3, True).tolist() == [1, 2]
    assert S.suppress(np.array([1, 2, 9]), np.array([1, 5, 1]), 3, False).tolist() == [0, 2]
    tier, forced = S.first_fit(np.array([0.0, 0.5, 0.6]), np.array([1.0, 1.5, 1.6]), 2)
    assert tier.tolist() == [0, 1, 1] and forced.tolist() == [False, False, True]


def test_markdown():
    assert render("# A & B\n\ntext **b** `x<y`\n\n- a\n  - b\n- c") == '<h1>A &amp; B</h1>\n<p>text <strong>b</strong> <code>x&lt;y</code></p>\n<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>'
    assert render("| a | b |\n|---|---|\n| 1 | 2 |") == "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>"
    assert render(None) is None and render("") == ""


def test_entry_works_without_the_language_model_folders():
    import subprocess
    import sys

    code = "import sys; sys.modules['ledgerline.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'cell_audit' in q and 'pipeline' not in q and not set(e.oracle_sql()) - set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
