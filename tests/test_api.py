import importlib
import json
import sys

import numpy as np
import pytest

from kinprint import cli
from kinprint.api import Library, Settings, prototype_group
from tests.test_sources import png


@pytest.fixture
def pictures(tmp_path):
    rng = np.random.default_rng(3)
    one, other = rng.integers(0, 256, (16, 16)), rng.integers(0, 256, (16, 16))
    (tmp_path / "in").mkdir()
    for name, raster in (("a", one), ("b", one), ("c", other), ("d", other), ("e", 255 - one)):
        png(tmp_path / "in" / f"{name}.png", raster)
    return tmp_path


def test_workflow(spark, pictures):
    lib = Library.of_images(spark, str(pictures / "in"), Settings(threshold=2))
    assert sorted((r["file_idx"], r["leader"]) for r in lib.members().collect()) == [(0, 0), (1, 0), (2, 2), (3, 2), (4, 4)]
    assert lib.groups().count() == 2 and lib.similar().count() == 2 and lib.pairs().count() == 10
    assert lib.project().count() == 5
    path = lib.frame.filter("file_idx = 1").first()["file"]
    assert lib.remove(path).groups().count() == 1
    assert sorted(r["leader"] for r in prototype_group(spark, str(pictures / "in"), threshold=0).collect()) == [0, 0, 2, 2, 4]


def test_command_line(spark, pictures, capsys):
    h = str(pictures / "h")
    cli.main(["hash", str(pictures / "in"), h], spark)
    cli.main(["cluster", h, str(pictures / "g"), "--threshold", "2"], spark)
    assert spark.read.parquet(str(pictures / "g" / "groups")).count() == 2
    cli.main(["find", h, "0", "--top", "2", "--json"], spark)
    found = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert [x["distance"] for x in found] == [0, 0]


def test_settings_are_checked():
    for bad in ({"size": 1}, {"algorithm": "x"}, {"method": "x"}, {"linkage": "x"}, {"threshold": -1}, {"min_cluster_size": 1}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_entry_without_the_optional_parts(monkeypatch):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    real = importlib.import_module

    def absent(name, *args):
        if name in ("kinprint.llm.registry", "corpus_pipeline"):
            raise ModuleNotFoundError(name=name)
        return real(name, *args)

    monkeypatch.setattr(importlib, "import_module", absent)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    bare = real("__spark_entry__")
    assert "group_stats" in bare.queries() and not any(q.startswith("op") or q == "pipeline" for q in bare.queries())
