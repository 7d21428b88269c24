"""Features, splits, comparisons, reports and settings."""

import math

import pytest

from inkloom.functions import render
from inkloom.operators import models
from inkloom.settings import setting


@pytest.fixture(scope="module")
def bank(spark):
    rows = [(i, [math.cos(i % 2 * 2 + i / 400), math.sin(i % 2 * 2 + i / 400)], None if i == 3 else [float(i % 2), 1.0, 0.0], i % 2) for i in range(40)]
    return spark.createDataFrame(rows, "id int, a array<float>, b array<float>, y int")


def test_fused_and_reduced(bank):
    f = models.fused(bank, "id", ["a", "b"])
    got = {r.id: r.features for r in f.collect()}
    assert all(len(v) == 5 for v in got.values()) and got[3][2:] == [0.0, 0.0, 0.0]
    r = models.reduced(f, "id", "features", 3).collect()
    assert all(abs(sum(x * x for x in v.reduced) - 1) < 1e-6 for v in r)


def test_compare(bank):
    f = models.fused(bank, "id", ["a"]).join(bank.select("id", "y"), "id")
    rows = models.compare(f, "id", "features", "y", 2, [0]).collect()
    assert {r.method for r in rows} == {"kmeans", "gmm", "bisecting"} and all(r.ari > 99 for r in rows if r.method != "gmm")


def test_edge_split(spark):
    e = spark.createDataFrame([(i, j) for i in range(40) for j in range(i + 1, 40) if (i + j) % 3 == 0], "a int, b int")
    n = {r.part: r["count"] for r in models.edge_split(e).groupBy("part").count().collect()}
    assert n == {r.part: r["count"] for r in models.edge_split(e).groupBy("part").count().collect()} and n["train"] > n["test"] > 0
    neg = models.negative_edges(e)
    assert neg.join(e, ["a", "b"], "left_semi").count() == 0 and neg.count() > 0


def test_best_run(spark):
    r = spark.createDataFrame([("x", "ari", 1.0), ("y", "ari", 2.0), ("x", "nmi", 5.0)], "params string, metric string, v double")
    assert {(q.metric, q.params) for q in models.best_run(r, "params", "metric", "v").collect()} == {("ari", "y"), ("nmi", "x")}


def test_reports():
    assert render.template("a {b}", {"b": "c"}) == "a c"
    with pytest.raises(KeyError):
        render.template("{x}", {})
    assert render.ranked_table({"m": {"q": 1.0}, "n": {"q": 2.0}, "o": {"q": 0.5}}).split("\n")[2:] == ["| m | <u>1.00</u> |", "| n | **2.00** |", "| o | 0.50 |"]
    assert render.merge_outlines([[(1, "9 A"), (2, "x")], [(1, "B")]], "T") == "T\n1 A\n  1.1 x\n2 B"
    page = render.to_html("t<", "# A <b>\ntext[^3]\n- x\n- y\n| a | b |\n|---|---|\n| 1 | 2 |\n```\n<c>\n```\n[^3]: src")
    for part in ("<h1>A &lt;b&gt;</h1>", '<a href="#ref-3">3</a>', "<li>x</li><li>y</li>", "<td>2</td>", "&lt;c&gt;", 'id="ref-3"', "<title>t&lt;</title>"):
        assert part in page


def test_settings():
    assert setting("a.b", 1, {"a": {"b": 5}}, {}) == 5
    assert setting("a.b", 1, {"a": {"b": 5}}, {"A_B": "7"}) == 7
    assert setting("a.c", "d", {"a": {}}, {}) == "d" and setting("f", False, None, {"F": "yes"}) is True
