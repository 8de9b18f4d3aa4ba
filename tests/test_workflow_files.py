"""Workflow files are parsed once for what is read of them, however many columns and filters use it."""

import json

from pyspark.sql import functions as F

from quarrystone.operators import analyze


def test_parsed_once(spark):
    files = spark.range(3).select(F.concat(F.lit("f"), "id").alias("path"), F.to_json(F.struct(F.array(F.struct(F.col("id").alias("name"))).alias("nodes"))).alias("content"), F.lit(None).cast("string").alias("parse_error"))
    for part in analyze.documents(files):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parseJson") == 1 and plan.count("struct(nodes") == 1


def test_odd_files(spark, tmp_path):
    deep = lambda n: "[" * n + '"x"' + "]" * n
    texts = {
        "none": "", "list": "[]", "null": '{"nodes":null,"connections":{"a":{"main":[[{"node":"b"}]]}}}', "twice": '{"nodes":[{"name":"a","name":"b"}]}',
        "only edges": '{"connections":{"a":{"main":[[{"node":"b","index":1.5}],null,[null,{"node":"c","index":2},{"node":null}]],"q":null},"z":3}}',
        "mixed": json.dumps({"nodes": [3, None, {"name": 1, "type": 2.5, "typeVersion": [1], "parameters": "text"}, "s", {"credentials": {"b": None, "a": 1}, "parameters": {"k.l": ["u", 1, {"m": "é"}], "resource": {}, "operation": True}}]}),
        "deep": f'{{"nodes":[{{"parameters":{deep(100)}}},{{"parameters":{deep(101)}}}]}}',
    }
    files = spark.createDataFrame([(k, v, None) for k, v in texts.items()], "path string, content string, parse_error string")
    nodes, leaves, edges = analyze.documents(files, str(tmp_path / "parsed"))
    assert {(r.path, r.n, r.name, r.type, *r.credential_types, r.type_version, r.operation) for r in nodes.where("path <> 'deep'").collect()} == {("mixed", 0, "1", "2.5", None, None), ("mixed", 1, None, "", "a", "b", None, "true")}
    assert {(r.path, r.n, r.json_path, r.value) for r in leaves.where("path <> 'deep'").collect()} == {("mixed", 0, "parameters", "text"), ("mixed", 1, "parameters.k.l[0]", "u"), ("mixed", 1, "parameters.k.l[2].m", "é")}
    assert [(r.n, r.json_path.count("[0]"), r.value) for r in leaves.where("path = 'deep'").collect()] == [(0, 100, "x")]
    assert {(r.path, r.source, r.channel, r.output, r.target, r.input) for r in edges.collect()} == {("only edges", "a", "main", 0, "b", 0), ("only edges", "a", "main", 2, "c", 2)}
