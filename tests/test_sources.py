from __future__ import annotations

import pytest

from chronoloom.sources import readers as R


def test_skips_head_and_rejects_other_widths(spark, tmp_path):
    good = tmp_path / "a.edges"
    good.write_text("% one\n% two\n1 2 5\n\n3 4 6\n")
    assert [tuple(r) for r in R.scan_edges_ws(spark, str(good)).orderBy("src").collect()] == [(1, 2, 1.0, 5), (3, 4, 1.0, 6)]
    assert R.scan_edges_ws(spark, str(good)).filter("time >= 6").count() == 1
    bad = tmp_path / "b.edges"
    bad.write_text("% one\n% two\n1 2 5 7 8\n")
    with pytest.raises(Exception, match="three or four"):
        R.scan_edges_ws(spark, str(bad)).collect()


def test_skips_the_head_of_every_file(spark, tmp_path):
    for name, lines in (("a", ["1 2 5", "3 4 6"]), ("b", ["5 6 7"]), ("c", [])):
        (tmp_path / name).write_text("\n".join(["% head", "% of two lines", *lines]) + "\n")
    assert sorted(r.src for r in R.scan_edges_ws(spark, str(tmp_path)).collect()) == [1, 3, 5]


def test_discovery_and_presets(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "x.edges").write_text("1 2 3\n")
    assert R.discover(spark, str(tmp_path), "x").endswith("x.edges")
    assert R.discover(spark, str(tmp_path), "y") is None
    assert len({p.name for p in R.PRESETS}) == 7 and sum(p.enabled for p in R.PRESETS) == 4


def test_features_do_not_depend_on_partitions(spark):
    nodes = spark.range(20).withColumnRenamed("id", "node")
    a, b = (R.scan_features(spark, None, nodes.repartition(n), 3) for n in (1, 4))
    assert a.exceptAll(b).count() == 0
