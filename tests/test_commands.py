"""The command line over small tables."""

import pytest

from duelframe.__main__ import main, parser
from duelframe.sources.fixtures import view

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    view(spark, SF, "images").write.parquet(f"{d}/images")
    view(spark, SF, "comparisons").write.parquet(f"{d}/comparisons")
    view(spark, SF, "records").write.parquet(f"{d}/records")
    s = view(spark, SF, "slots").selectExpr("vector_name", "cast(id as string) id", "'x' raw", "array(v) vector")
    s.write.parquet(f"{d}/split")
    s.where("vector_name = 'size'").selectExpr("id", "vector").write.parquet(f"{d}/vectors")
    view(spark, SF, "records").selectExpr("cast(id as string) id", "score").write.parquet(f"{d}/scores")
    return str(d)


@pytest.mark.parametrize("command", [
    "database cleanup", "database recalculate --order random --seed 3", "build scores", "build split-vectors", "build full-vectors",
    "analyze stats", "analyze matrix --least 5", "analyze parameters", "analyze graph", "files tiers", "show gallery --tags ring --mode or",
    "show history img_00000001", "show next-pair", "training train-model",
])
def test_command(spark, tables, tmp_path, command):
    main(["--tables", tables, "--out", str(tmp_path / "out"), *command.split()])
    assert spark.read.parquet(str(tmp_path / "out")).columns


def test_unknown_command():
    with pytest.raises(SystemExit):
        parser().parse_args(["database", "explode"])
