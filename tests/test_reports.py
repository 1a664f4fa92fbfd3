import pytest
from pyspark.sql import functions as F

from callscope.plans import report_queries, reports


def test_reports_hold_all_rows(spark):
    rows = spark.range(6_000).select(F.concat(F.lit("tool\n"), "id").alias("tool_name"), "id")
    report = {
        "byNode": reports.Section(rows, (F.desc("id"), "tool_name")),
        "none": reports.Section(rows.where("id < 0"), ("id",)),
        "recent": reports.Section(rows.orderBy(F.desc("id")).limit(3), (F.desc("id"),), few=True),
    }
    assert {r.section: r.row_count for r in report_queries._counted(spark, report).collect()} == {"byNode": 6_000, "none": 0, "recent": 3}
    with pytest.raises(ValueError, match="byNode, none"):
        reports.document(report)
    (row,) = reports.document({"recent": report["recent"]}).collect()
    assert row.row_count == 3 and row.json.startswith('[{"tool_name":"tool\\n5999","id":5999},')
