"""Documents of nested facts are built where their lines meet."""

from datetime import datetime

from pyspark.sql import functions as F

import __spark_entry__


def test_lines_move_once_to_their_document(spark, tmp_path):
    lines = [(o, o % 3, 1, n, 10.5 * n + o, "ANR"[o % 3], "OF"[n % 2], datetime(1998, 1 + o % 12, 3)) for o in range(130) for n in (1, 2, 7)]
    lines += [lines[0], lines[0][:4] + (None,) + lines[0][5:]]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, "
                          "l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o, o % 5) for o in range(130)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(p, f"B{p}") for p in range(3)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    out = __spark_entry__.queries()["nested_facts"](spark, str(tmp_path))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    rows = out.collect()
    assert len(rows) == len(lines)
    assert sorted(r.value for r in rows if r.value is not None) == sorted(round(x[4], 2) for x in lines if x[3] != 7 and x[4] is not None)
    assert {(r.cik, r.concept_name) for r in rows} == {(f"{x[0] % 5:010d}", f"B{x[0] % 3}") for x in lines}
    assert out.select(F.countDistinct("fact_id")).first()[0] == 390
