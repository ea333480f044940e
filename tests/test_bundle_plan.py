"""How often nested rows are parsed."""

from sorrel.operators import bundle


def test_json_is_parsed_once(spark):
    plan = bundle.nested_programs(spark.createDataFrame([(1, "{}")], "i int, raw string"), "raw", "i")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line.split("(")[0].split("[")[0] and "parse_json" in line.lower()]
    assert plan.lower().count("parsejson") + plan.lower().count("parse_json") <= 4
