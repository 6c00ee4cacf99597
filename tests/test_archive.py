"""An archive's files are opened only where their paths pass the filters."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fluxloom.sources import archive as A


@pytest.fixture
def root(tmp_path):
    for tile in ("h00v01", "h01v00"):
        for month in (202001, 202002, 202003):
            folder = tmp_path / f"tile={tile}" / f"month={month}"
            folder.mkdir(parents=True)
            if tile == "h01v00" and month > 202001:
                pq.write_table(pa.table({"x": [month % 10, 5], "nir": pa.array([month, None], pa.int32())}), folder / "a.parquet")
            else:
                (folder / "a.parquet").write_bytes(b"no file that can be read")
            (folder / "_SUCCESS").write_bytes(b"")
    return f"file://{tmp_path}"


def test_files_outside_of_the_filters_are_never_opened(spark, root):
    df = A.read_scene_archive(spark, root, ["nir", "red"]).where("tile = 'h01v00' AND month >= 202002 AND x < 5")
    assert sorted((r.tile, r.month, r.x, r.nir, r.red) for r in df.collect()) == [("h01v00", 202002, 2, 202002, None), ("h01v00", 202003, 3, 202003, None)]
    assert A.read_scene_archive(spark, root, ["nir"]).where(F.col("tile").isin("h01v00", "h09v09") & (F.col("month") == 202003)).count() == 2
    assert A.read_scene_archive(spark, root, ["nir"]).where("tile = 'none'").count() == 0
    with pytest.raises(Exception, match="Parquet|parquet|magic"):
        A.read_scene_archive(spark, root, ["nir"]).where("month >= 202002").collect()


def test_small_files_share_a_partition(root, monkeypatch):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("tile", T.StringType()), T.StructField("month", T.IntegerType()), T.StructField("x", T.LongType())])
    reader = A.ArchiveReader(root, A.SCENES, schema)
    assert len(reader.kept()) == 6 and [len(p.found) for p in reader.partitions()] == [6]
    left = list(reader.pushFilters([A.EqualTo(("tile",), "h00v01"), A.EqualTo(("x",), 1)]))
    assert left == [A.EqualTo(("x",), 1)] and [k["month"] for *_, k in reader.kept()] == [202001, 202002, 202003]
    monkeypatch.setattr(A, "TOGETHER", 30)
    assert [len(p.found) for p in reader.partitions()] == [1, 1, 1]
