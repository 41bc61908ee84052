"""Casts that fail are counted; waves are one table."""

from pyspark.sql import Observation
from pyspark.sql import types as T

from heirflow.sources import readers

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("t", T.StringType())])


def test_failed_casts_are_counted_in_the_same_pass(spark, tmp_path):
    (tmp_path / "a.csv").write_text("t,x,id\nu,1.5,1\nv,ND,2\nNA,NA,3\nw,,x\nz,1e3,4.5\n")
    failures = Observation("casts")
    rows = readers.read_csv(spark, str(tmp_path / "a.csv"), SCHEMA, failures).collect()
    assert [tuple(r) for r in rows] == [(1, 1.5, "u"), (2, None, "v"), (3, None, None), (None, None, "w"), (None, 1000.0, "z")]
    assert {r["column"]: r.failed for r in readers.failed_casts(spark, failures).collect()} == {"id": 2, "x": 1, "t": 0}


def test_waves_are_one_pruned_scan(spark, tmp_path):
    summary = spark.createDataFrame([(w, 10 * w + i, 0.5) for w in (2013, 2016, 2019) for i in range(4)], "survey_year int, y1 long, weight double")
    detail = summary.select("survey_year", "y1").withColumn("value_1", summary.y1 * 2.0)
    readers.write_wave_table(summary, detail, str(tmp_path))
    for found, given in zip(readers.read_wave_table(spark, str(tmp_path), [(2013, 2013, 1.0), (2019, 2017, 0.5), (2019, 2018, 0.5)]), (summary, detail)):
        assert found.columns == given.columns
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, given.where("survey_year <> 2016").collect()))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "PartitionFilters: [survey_year" in plan
