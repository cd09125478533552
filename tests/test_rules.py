"""Operators by brute force: what SQL does not check, and faults that must be raised."""

import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerline.functions.markdown import markdown_html, with_heading_ids
from ledgerline.operators import greedy as G
from ledgerline.operators import grids as H
from ledgerline.operators import joins as J
from ledgerline.operators import ranks as R
from ledgerline.operators import series as S
from ledgerline.operators import validate as V
from ledgerline.plans import grid_queries, text_queries
from ledgerline.sources import sinks
from tests.conftest import SF


def test_overlap_dedupe_by_brute_force(spark):
    got = {r.doc_id: r.kept for r in text_queries.greedy_overlap_dedupe(spark, SF).collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text is not None]
    want, kept = {}, {}
    for i, lines in sorted(((i, set(t.split("\n"))) for i, t in docs), key=lambda x: (-len(x[1]), x[0])):
        head = dict(docs)[i].split("\n")[0]
        want[i] = all(len(lines & k) < 0.3 * len(lines) for k in kept.get(head, []))
        if want[i]:
            kept.setdefault(head, []).append(lines)
    assert got == want and False in want.values()


def test_clusters_by_brute_force(spark):
    got = sorted((r.label, r.cluster, round(r.cx, 9), round(r.weight, 9), r.members) for r in grid_queries.greedy_cluster(spark, SF).collect())
    rows = [(r.label, r.vec_id, float(r.embedding[0]), float(r.embedding[1]), 1.0 + r.vec_id % 5) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = []
    for label in {r[0] for r in rows}:
        held: list[list] = []
        for row in sorted((r for r in rows if r[0] == label), key=lambda r: (-r[4], r[1])):
            near = next((c for c in held if np.hypot(c[0][2] - row[2], c[0][3] - row[3]) < 0.1), None)
            held.append([row]) if near is None else near.append(row)
        out = [(sum(r[2] * r[4] for r in c) / sum(r[4] for r in c), sum(r[4] for r in c), len(c)) for c in held]
        out.sort(key=lambda c: (-c[1], c[0]))
        want += [(label, k, round(c[0], 9), round(c[1], 9), c[2]) for k, c in enumerate(out)]
    assert got == sorted(want)


def test_restore_by_brute_force(spark):
    """Closing, division, threshold and components of the made image, with numpy."""
    got = grid_queries.restore_synthetic(spark, SF).collect()
    ink = {(r.y, r.x) for r in grid_queries._grid(spark, SF).collect()}
    y, x = np.mgrid[0:64, 0:64]
    stroke = ((x >= 20) & (x < 24) & (y > 8) & (y < 56)) | ((y >= 40) & (y < 43) & (x > 5) & (x < 60))
    img = np.where(stroke, 40.0, np.where(np.array([[(a, b) in ink for b in range(64)] for a in range(64)]), 60.0, 180.0 + x * 0.5))
    def slide(a, f):
        for axis in (1, 0):
            a = np.stack([f(np.take(a, range(max(0, i - 4), min(64, i + 5)), axis), axis) for i in range(64)], axis)
        return a

    flat = np.clip(img / np.maximum(slide(slide(img, np.max), np.min), 1) * 255, 0, 255)
    p = np.bincount(np.floor(flat).astype(int).ravel(), minlength=256) / flat.size
    om, mu = np.cumsum(p), np.cumsum(p * np.arange(256))
    span = om * (1 - om)
    cut = int(np.argmax(np.round(np.where(span > 1e-12, (mu[-1] * om - mu) ** 2 / np.maximum(span, 1e-12), 0), 6)))
    dark, label = flat < cut, {}
    for cell in map(tuple, np.argwhere(dark)):
        if cell not in label:
            label[cell], todo = cell, [cell]
            while todo:
                a, b = todo.pop()
                for near in ((a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                    if 0 <= near[0] < 64 and 0 <= near[1] < 64 and dark[near] and near not in label:
                        label[near] = cell
                        todo.append(near)
    size = {}
    for c in label.values():
        size[c] = size.get(c, 0) + 1
    want = {c for c, r in label.items() if size[r] > 8}
    assert {r.threshold for r in got} == {cut} and {(r.y, k) for r in got for k in range(r.a, r.z)} == want
    assert {r.cells for r in got} == {n for n in size.values() if n > 8}


def test_headings_get_ids(spark):
    df = spark.createDataFrame([("# A & B\n\ntext\n\n## <C> `d`\n\n```\n# no\n```",), (None,), ("plain",)], "t string")
    got = [r[0] for r in df.select(with_heading_ids(markdown_html("t"))).collect()]
    assert got == ['<h1 id="a-and-b">A &amp; B</h1>\n<p>text</p>\n<h2 id="lt-c-gt-d">&lt;C&gt; <code>d</code></h2>\n<pre><code># no</code></pre>', None, "<p>plain</p>"]


def test_a_missing_partner_is_raised(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "rk int, v string")
    assert J.mandatory(left.where("k = 1"), "k", right, "rk").select("k", "v").collect() == [(1, "a")]
    with pytest.raises(PySparkException, match="no rk for k 2"):
        J.mandatory(left, "k", right, "rk").collect()


def test_a_tab_in_a_plain_cell_is_raised(spark):
    df = spark.createDataFrame([("fine",), ("a\tb",)], "c string").select(sinks.tsv_line([sinks.clean(F.col("c"))], quote=False).alias("l"))
    assert df.where("c = 'fine'").first().l == "fine"
    with pytest.raises(PySparkException, match="tab or line end"):
        df.collect()


def test_json_and_lines(spark, tmp_path):
    df = spark.createDataFrame([(2, "b\"", None), (1, "é", 3)], "k int, s string, n int")
    assert df.orderBy("k").select(sinks.json_pretty(["s", "k", "n"]).alias("j")).collect()[1].j == '{\n "k": 2,\n "n": null,\n "s": "b\\""\n}'
    sinks.write_lines(df, "s", ["k"], f"{tmp_path}/out")
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == 'é\nb"\n'


def test_schema_walks_items_of_objects(spark):
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "array", "items": {"$ref": "#/definitions/x"}}}, "definitions": {"x": {"type": "object", "required": ["n"], "properties": {"n": {"enum": [1, 2]}}}}}
    rows = [(0, '{"a":[{"n":1},{"n":2}]}'), (1, '{"a":[{"n":3},{}]}'), (2, '{"a":[5]}'), (3, "{}"), (4, "no json"), (5, '{"a":[]}')]
    got = sorted((r.entity_key, r.message) for r in V.schema_violations(spark.createDataFrame(rows, "i int, v string"), "i", "v", schema).collect())
    assert got == [("1", "$.a[].n: enum"), ("1", "$.a[]: required n"), ("2", "$.a[]: required n"), ("2", "$.a[]: type"), ("3", "$: required a"), ("4", "$: no JSON")]


def test_containment_by_brute_force(spark):
    random.seed(1)
    texts = [(i, " ".join(random.choice(["ab", "abc", "b", "cab", "é", "aba\tb"]) for _ in range(random.randrange(40)))) for i in range(60)]
    needles = [(k, t) for k, t in enumerate(["ab", "b c", "abc ab", "é", "zz", "ca", "", " ", "b b b", " ab ", texts[5][1], texts[9][1][3:70], "cab"])]
    got = {tuple(r) for r in J.contained_in(spark.createDataFrame(needles, "n int, s string"), "n", "s", spark.createDataFrame(texts, "t int, x string"), "t", "x", gram=4).collect()}
    assert got == {(n, t) for n, s in needles for t, x in texts if s.split() and s in x}


def test_overlaps_by_brute_force(spark):
    random.seed(2)
    sets = lambda n: [(i, sorted({random.choice("abcdefghijklmnop") + random.choice("xyz") for _ in range(random.randrange(1, 14))})) for i in range(n)]
    a, b = sets(40), sets(30)
    got = {(r.l, r.r): (r.shared, round(r.overlap, 9)) for r in J.overlaps(spark.createDataFrame(a, "l int, w array<string>"), "l", spark.createDataFrame(b, "r int, w array<string>"), "r", "w", 0.5).collect()}
    want = {(i, j): (len(set(x) & set(y)), round(len(set(x) & set(y)) / min(len(x), len(y)), 9)) for i, x in a for j, y in b}
    assert got == {k: v for k, v in want.items() if v[1] >= 0.5}


def test_interpolation_by_brute_force(spark):
    rng = np.random.default_rng(3)
    points = [(k, float(t), float(v)) for k in (0, 1) for t, v in zip(np.unique(rng.integers(0, 200, 25)), rng.normal(size=25))] + [(2, 50.0, 7.0)]
    probes = [(k, float(t)) for k in (0, 1, 2) for t in (-30, 0, 0.5, 33, 99.25, 150, 500, *[p[1] for p in points if p[0] == k][:3])]
    got = {(r.k, r.q): r.v for r in J.interpolate(spark.createDataFrame(points, "k int, t double, v double"), "k", "t", "v", spark.createDataFrame(probes, "k int, q double"), "q", 7.0).collect()}
    for k in (0, 1, 2):
        own = [(t, v) for j, t, v in points if j == k]
        assert all(abs(got[j, q] - np.interp(q, *zip(*own))) < 1e-9 for j, q in probes if j == k)


def test_blocks_see_their_neighbours(spark):
    rows = [(i % 2, i, float((i * 37) % 11)) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, i int, v double")
    cell = F.floor(F.col("i") / 50)
    use = lambda d, w: d.withColumn("m", F.avg("v").over(w.rowsBetween(-3, 3)))
    got = {r.i: round(r.m, 9) for r in S.in_blocks(df, ["k"], ["i"], cell, 3, use, block=10).collect()}
    for k in (0, 1):
        own = [v for j, _, v in rows if j == k]
        assert all(got[2 * n + k] == round(float(np.mean(own[max(0, n - 3) : n + 4])), 9) for n in range(200))
    runs = S.numbered_islands(df, ["k"], ["i"], cell, lambda w: F.col("v") < F.lag("v").over(w), "run").collect()
    for k in (0, 1):
        n, last = 0, None
        for r in sorted((r for r in runs if r.k == k), key=lambda r: r.i):
            n, last = n + (last is None or r.v < last), r.v
            assert r.run == n


def test_nearest_by_brute_force_and_without_pairs(spark):
    """Rows of equal ids are rows apart; ties, odd values and places whose distances round alike; and no pairs are made."""
    rng = np.random.default_rng(8)
    left = [(i // 2, float(v)) for i, v in enumerate(np.round(rng.uniform(-60, 60, 150), 1))] + [(7, 6.0), (7, 6.0), (8, None), (9, float("nan")), (10, float("inf")), (11, 7.0), (12, -500.0)]
    right = [(i, float(v)) for i, v in enumerate(np.round(rng.uniform(-90, 40, 60), 1)) if abs(v) > 8] + [(100, 1e-17), (101, 2e-17), (102, 1e-17), (103, None), (104, float("nan")), (105, 14.0)]
    a, b = spark.createDataFrame(left, "a int, x double"), spark.createDataFrame(right, "b int, y double")
    for last in (True, False):
        want = []
        for i, x in left:
            near = [(abs(x - y), -j if last else j, j) for j, y in right if x is not None and y is not None and abs(x - y) <= 7]
            want += [(i, x, min(near)[2])] if near else []
        got = J.nearest(a, "a", "x", b, "b", "y", 7.0, last_wins=last)
        assert got.columns == ["a", "x", "b", "y"] and sorted((r.a, r.x, r.b) for r in got.collect()) == sorted(want)
    assert "Join Inner" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_labels_of_runs_by_brute_force(spark, monkeypatch):
    """Components over many strips and images, one of them null, with a snake that crosses every strip."""
    monkeypatch.setattr(H, "STRIP", 4, raising=False)
    rng = np.random.default_rng(9)
    cells = {(None if g == 2 else g, int(y) - 20, int(x) - 15) for g in range(3) for y, x in np.argwhere(rng.uniform(size=(40, 30)) < 0.45)}
    cells |= {(5, y, x) for y in range(41) for x in range(21) if y % 2 == 0 or x == (20 if y % 4 == 1 else 0)}
    df = spark.createDataFrame(sorted(cells, key=str), "image int, y int, x int")
    for corners in (True, False):
        steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if corners or not i or not j]
        want, left = set(), set(cells)
        while left:
            group, todo = set(), [left.pop()]
            while todo:
                g, y, x = todo.pop()
                group.add((g, y, x))
                near = {(g, y + i, x + j) for i, j in steps} & left
                left -= near
                todo += near
            want.add(frozenset(group))
        got = H.label_runs(df, ["image"], "y", "x", corners).collect()
        found = {}
        for r in got:
            found.setdefault(r.comp, []).extend((r.image, r.y, x) for x in range(r.a, r.z))
        assert {frozenset(c) for c in found.values()} == want and sum(map(len, found.values())) == len(cells)
        assert all(r.comp == min(q.id for q in got if q.comp == r.comp) for r in got[::20])


def test_parts_of_a_strip():
    """Touching runs and least ids on a small strip, by hand: no Spark job is needed inside a strip."""
    y, a, z = np.array([0, 0, 1, 1, 3]), np.array([-2, 3, 1, 5, 1]), np.array([1, 5, 3, 9, 2])
    pairs = lambda corners: set(zip(*(p.tolist() for p in H.touching(y, a, z, corners))))
    assert pairs(True) == {(0, 2), (1, 2), (1, 3)} and pairs(False) == set()
    assert H.least_of_component(np.array([7, -5, 9, 2, 1]), np.array([0, 1]), np.array([2, 2])).tolist() == [-5, -5, -5, 2, 1]


def test_quantiles_by_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(v)) for g, n in (("a", 1), ("b", 2), ("c", 101), ("d", 60)) for v in np.round(rng.normal(size=n), 1)] + [("d", 3.0)] * 40 + [("e", None)]
    got = {r.g: r for r in R.quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"q1": 0.1, "mid": 0.5, "q9": 0.9}, {"up": 0.5}).collect()}
    for g in "abcd":
        own = sorted(v for k, v in rows if k == g)
        assert np.allclose([got[g].q1, got[g].mid, got[g].q9], np.quantile(own, [0.1, 0.5, 0.9])) and got[g].up == own[len(own) // 2]
    assert "e" not in got


def test_first_fit_and_guard_keep_their_groups(spark):
    df = spark.createDataFrame([(g, i, float(i % 4), float(i % 4 + 2)) for g in (0, 1) for i in range(8)], "g int, i int, lo double, hi double")
    got = G.tiers(df, "g", "i", "lo", "hi", 2).toPandas()
    assert len(got) == 16 and set(got.tier) <= {0, 1} and got.groupby("g").forced.sum().tolist() == [got[got.g == 0].forced.sum()] * 2
