import __spark_entry__ as entry
from cratewise.operators import graph as G
from cratewise.plans import standins as D
from cratewise.sources.snapshot import parse_lines


def plan_text(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_records_of_a_graph_are_parsed_once(spark):
    lines = spark.createDataFrame(
        [('{"name":"a-1","drvPath":"/a","inputDrvs":{"/b":{},"/gone":{}}}',), ('{"name":"b-2","drvPath":"/b"}',)], "value string"
    )
    vertices, edges = G.build_graph(parse_lines(lines).records)
    for table in (vertices, edges):
        assert "from_json" not in plan_text(table)
    assert [tuple(r) for r in edges.collect()] == [("a-1", "b-2")]
    assert sorted(tuple(r) for r in vertices.collect()) == [("a-1", "a", "1", "", "/a"), ("b-2", "b", "2", "", "/b")]


def test_inputs_of_records_need_one_read_of_the_lines(spark):
    scans = plan_text(D.raw_snapshot_with_inputs(spark, entry.SMOKE_DIR).records).count("FileScan parquet [l_orderkey")
    assert scans == 1
