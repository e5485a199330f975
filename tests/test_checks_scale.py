import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks import q_names, q_sources, views  # noqa: E402


def test_a_file_per_row_is_written_by_all_tasks(spark, tmp_path):
    rows = spark.range(50).coalesce(1).select("id", F.when(F.col("id") != 7, F.concat(F.lit("v"), "id")).alias("value"))
    views.write_file_per_row(rows, f"file:{tmp_path}/out", "id", ".txt")
    files = sorted((tmp_path / "out").rglob("*.txt"))
    assert len(files) == 50 and len({f.name for f in files}) == 50 and len({f.parent for f in files}) == 4
    assert sorted(f.read_text() for f in files) == sorted(["\n"] + [f"v{i}\n" for i in range(50) if i != 7])


@pytest.mark.parametrize("name", ["read_mix_files", "read_entity_docs"])
def test_files_of_suppliers_are_read_back(spark, tmp_path, name):
    suppliers = spark.createDataFrame([(1, "a b", 3), (2, "c", 4), (2, "c", 4), (None, "d", None)], "s_suppkey long, s_name string, s_nationkey int")
    suppliers.write.parquet(f"{tmp_path}/supplier.parquet")
    got = sorted(tuple(r) for r in getattr(q_sources, name)(spark, str(tmp_path)).collect())
    if name == "read_mix_files":
        assert got == [("help", "a b", 1), ("help", "c", 2), ("help", "d", 1)]
    else:
        day = "2025-01-02 03:04:05"
        assert got == [("a b", "1,3", day, "part"), ("c", "2,4", day, "part"), ("c", "2,4", day, "part"), ("d", "", day, "part")]


@pytest.mark.parametrize("name", ["extract_infobox", "extract_lead"])
def test_pages_of_a_small_file_are_scanned_by_all_tasks(spark, tmp_path, name):
    part = spark.range(40).coalesce(1).select(
        F.col("id").alias("p_partkey"), F.lit("bolt").alias("p_name"), F.lit("Brand#11").alias("p_brand"), F.lit("TIN").alias("p_type"),
        F.lit(3).alias("p_size"), F.lit("M").alias("p_mfgr"), F.lit("BOX").alias("p_container"), F.lit(1.0).alias("p_retailprice"),
    )
    part.write.parquet(f"{tmp_path}/part.parquet")
    found = getattr(q_names, name)(spark, str(tmp_path))
    assert found.select(F.spark_partition_id().alias("task")).distinct().count() == 4 and found.count() == 80
