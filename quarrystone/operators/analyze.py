"""Static analysis of workflow documents: nodes, edges, findings, reports, admission, side effects.

Built-in node types are told apart by their last part after the prefix of the base package; a type of any other package
is itself, so that a community node is never taken for the built-in of the same name. Prefixes are compared as they
stand: a package whose name only ends like a known one is foreign.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import once

# Node types by what they do, severities from the least, verdicts from the least.
COMMAND, SSH = ("executeCommand",), ("ssh",)
FILES = ("readWriteFile", "readBinaryFile", "writeBinaryFile", "localFileTrigger")
CODE, HTTP = ("code", "function", "functionItem"), ("httpRequest",)
UNPINNABLE = ("manualTrigger",)
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
VERDICTS = ("ALLOWED", "REVIEW_REQUIRED", "BLOCKED")
TYPE_RULES = (("EXECUTE_COMMAND", "HIGH", COMMAND), ("SSH_EXECUTION", "HIGH", SSH), ("FILESYSTEM_ACCESS", "MEDIUM", FILES), ("NETWORK_REQUEST", "MEDIUM", HTTP), ("CUSTOM_CODE", "MEDIUM", CODE))
CODE_RULES = (
    ("CODE_EVAL", "HIGH", r"(?i)\beval\s*\("),
    ("CODE_FUNCTION_CONSTRUCTOR", "HIGH", r"(?i)\bnew\s+Function\s*\("),
    ("CODE_CHILD_PROCESS", "CRITICAL", r"(?i)child_process|execSync|spawnSync"),
    ("CODE_FILESYSTEM", "HIGH", r"(?i)require\s*\(\s*['\"]fs['\"]\s*\)"),
)
SECRET_KEY = r"(?i)(api[_ -]?key|token|password|passwd|secret|authorization)"
PLACEHOLDER = r"(?i)(YOUR[_ -]?[A-Z0-9_]*|<[^>]*(token|secret|password|key)[^>]*>|\{\{\s*\$(credentials|env)\b)"
TEXT_KEYS = ("content", "description", "instructions", "message", "prompt", "systemmessage", "text")
#: Levels below a node's parameters that leaves are looked for in; text nested deeper is not analysed.
MAX_DEPTH = 100
#: Leaves of about this number leave a Python task at a time.
LEAVES_AT_ONCE = 20_000
# Prefixes of the built-in nodes' package, and of all packages that come with the product itself.
BASE_PREFIXES = ("n8n-nodes-base.",)
FIRST_PARTY_PREFIXES = ("n8n-nodes-base.", "@n8n/n8n-nodes-langchain.", "n8n-nodes-langchain.")


def kind_of(node_type: Column, prefixes: tuple[str, ...] = BASE_PREFIXES) -> Column:
    """The name of a built-in node type, else the whole type behind a "?", so that no foreign type has a built-in's name."""
    return F.coalesce(*[F.when(F.startswith(node_type, F.lit(p)), F.substring(node_type, len(p) + 1, 2**31 - 1)) for p in prefixes], F.concat(F.lit("?"), node_type))


def first_party(node_type: Column, prefixes: tuple[str, ...] = FIRST_PARTY_PREFIXES) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(node_type, F.lit(p)) for p in prefixes])


def _is_object(value: Column) -> Column:
    return value.try_cast("map<string,boolean>").isNotNull()  # what it holds is not copied: anything else than a truth value is null


def _is_list(value: Column) -> Column:
    return value.try_cast("array<boolean>").isNotNull()


def _member(value: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{key}", kind)


def string_leaves(rows: DataFrame, column: str, root: str, depth: int = MAX_DEPTH) -> DataFrame:
    """All strings below a column of JSON text, as deep as depth: a row (json_path, value) for each beside the other columns.

    Arrow batches: built-in functions do not recurse, and a fold over VARIANT copies each level. The text must be that of a VARIANT.
    """
    rest = [c for c in rows.columns if c != column]
    schema = rows.select(*rest).schema.add("json_path", "string").add("value", "string")

    def found(text: str) -> list[tuple[str, str]]:
        out, todo = [], [(root, json.loads(text), 0)]
        while todo:
            path, value, level = todo.pop()
            if isinstance(value, str):
                out.append((path, value))
            elif level < depth and isinstance(value, dict):
                todo += [(f"{path}.{k}", v, level + 1) for k, v in value.items()]
            elif level < depth and isinstance(value, list):
                todo += [(f"{path}[{k}]", v, level + 1) for k, v in enumerate(value)]
        return out

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, paths, values = [], [], []

            def part(batch: pa.RecordBatch = batch, at: list = at, paths: list = paths, values: list = values) -> pa.RecordBatch:
                held = batch.select(rest).take(pa.array(at, pa.int64()))
                return pa.RecordBatch.from_arrays([*held.columns, pa.array(paths, pa.string()), pa.array(values, pa.string())], [*rest, "json_path", "value"])

            for k, text in enumerate(batch.column(column)):
                strings = found(text.as_py()) if text.is_valid else []
                at += [k] * len(strings)
                paths += [p for p, _ in strings]
                values += [v for _, v in strings]
                if len(at) >= LEAVES_AT_ONCE:
                    yield part()
                    at.clear(), paths.clear(), values.clear()
            yield part()

    return rows.mapInArrow(leaves, schema)


def _files(found: DataFrame) -> DataFrame:
    """files(path, content, parse_error) -> (path, v), v null where the text is no JSON.

    The text is parsed behind a generator: filters on what it makes stay above it, so nothing is parsed, or made, once for each use.
    """
    return found.where("parse_error is null").select("path", F.explode_outer(F.array(F.try_parse_json("content"))).alias("v"))


def _nodes(files: DataFrame) -> DataFrame:
    """(path, n, name, type, type_version, parameters, credentials) of each node that is an object, in place; parameters as VARIANT."""
    kind = "array<struct<name:string,type:string,typeVersion:variant,parameters:variant,credentials:map<string,variant>>>"
    listed = F.filter(_member(F.col("v"), "nodes", kind), lambda x: x.isNotNull())
    rows = files.select("path", F.posexplode_outer(listed).alias("n", "node")).where("n is not null")
    text = lambda c: F.coalesce(c, F.lit(""))
    return rows.select("path", "n", "node.name", text(F.col("node.type")).alias("type"), F.col("node.typeVersion").alias("type_version"), F.col("node.parameters").alias("v"), "node.credentials")


def _scalar(value: Column) -> Column:
    """A VARIANT's text unless it is an object or a list."""
    return F.when(~_is_object(value) & ~_is_list(value), F.try_variant_get(value, "$", "string"))


def _edges(files: DataFrame) -> DataFrame:
    """(path, source, channel, output, target, input) of each connection that names its target, of files whose nodes, if any, are a list."""
    kind = "map<string,map<string,array<array<struct<node:string,index:variant>>>>>"
    listed = _member(F.col("v"), "nodes", "array<boolean>").isNotNull() | _member(F.col("v"), "nodes").isNull()
    sources = files.where(listed).select("path", F.explode_outer(_member(F.col("v"), "connections", kind)).alias("source", "channels"))
    channels = sources.select("path", "source", F.explode_outer("channels").alias("channel", "outputs"))
    outputs = channels.select("path", "source", "channel", F.posexplode_outer("outputs").alias("output", "targets"))
    edges = outputs.select("path", "source", "channel", "output", F.explode_outer("targets").alias("target")).where("target.node is not null")
    index = F.col("target.index")
    whole_number = F.coalesce(~_is_object(index) & ~_is_list(index) & (F.schema_of_variant(index) == "BIGINT"), F.lit(False))
    return edges.select("path", "source", "channel", "output", F.col("target.node").alias("target"), F.when(whole_number, F.try_variant_get(index, "$", "int")).otherwise(F.lit(0)).alias("input"))


def documents(found: DataFrame, at: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """files(path, content, parse_error) -> nodes, string leaves of their parameters, edges. Malformed parts are skipped.

    A file whose nodes are no list has none of the three. Edges count the outputs of a channel, empty ones included.
    With a new folder `at`, shared by driver and executors, nodes are parsed once and stored there for all that read them and their leaves.
    """
    files = _files(found)
    rows = _nodes(files)
    rows = rows.select(
        "path", "n", "name", "type", F.to_json("v").alias("parameters"), F.array_sort(F.coalesce(F.map_keys("credentials"), F.array().cast("array<string>"))).alias("credential_types"),
        _scalar(F.col("type_version")).alias("type_version"), _scalar(_member(F.col("v"), "resource")).alias("resource"), _scalar(_member(F.col("v"), "operation")).alias("operation"),
    )
    if at is not None:
        rows.write.parquet(at)
        rows = found.sparkSession.read.parquet(at)
    nodes = rows.withColumn("parameters", F.coalesce("parameters", F.lit("{}")))
    return nodes, string_leaves(rows.select("path", "n", "type", "parameters"), "parameters", "parameters"), _edges(files)


def _exploded(rows: DataFrame, keep: list[str], rules: list[tuple[str, str, Column]]) -> DataFrame:
    """(keep..., rule_id, severity) for each rule whose condition holds: one projection, no join, compiled with the rest of its stage."""
    hits = F.array(*[F.when(c, F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"))) for r, s, c in rules])
    return rows.select(*keep, F.explode_outer(hits).alias("h")).where("h is not null").select(*keep, "h.*")


def findings(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """(path, n, json_path, rule_id, severity, evidence) of the node, leaf and workflow rules; evidence never holds a value."""
    kind = kind_of(F.col("type"))
    by_type = _exploded(nodes, ["path", "n"], [(r, s, kind.isin(*types)) for r, s, types in TYPE_RULES]).withColumns({"json_path": F.lit(None).cast("string"), "evidence": F.lit(None).cast("string")})
    value, path, kind = F.col("value"), F.col("json_path"), F.col("kind")
    trimmed = F.btrim(value, F.lit(" \t\r\n"))
    named = T.leaf_key(path).isin("id", "name") & F.contains(F.lower(path), F.lit(".credentials."))
    rules = [
        ("DECRYPTED_CREDENTIAL_EXPORT", "CRITICAL", kind.isin(*COMMAND) & F.contains(value, F.lit("export:credentials")) & F.contains(value, F.lit("--decrypted"))),
        ("PRIVATE_NETWORK_URL", "HIGH", kind.isin(*HTTP) & F.endswith(path, F.lit(".url")) & once(value, T.private_or_local)),
        *[(r, s, kind.isin(*CODE) & value.rlike(p)) for r, s, p in CODE_RULES],
        ("POSSIBLE_HARDCODED_SECRET", "HIGH", ~named & path.rlike(SECRET_KEY) & ~value.rlike(PLACEHOLDER) & (F.length(trimmed) >= 8)),
    ]
    # Most leaves meet no rule: cheap tests keep those that may.
    likely = kind.isin(*COMMAND, *CODE) | (kind.isin(*HTTP) & F.endswith(path, F.lit(".url"))) | path.rlike(SECRET_KEY)
    by_leaf = _exploded(leaves.select("path", "n", "json_path", "value", kind_of(F.col("type")).alias("kind")).where(likely), ["path", "n", "json_path", "value"], rules)
    evidence = F.when(F.col("rule_id") == "POSSIBLE_HARDCODED_SECRET", T.masked(F.btrim("value"))).otherwise(F.concat(F.lit("matched rule "), F.col("rule_id")))
    by_leaf = by_leaf.withColumn("evidence", evidence).drop("value")
    kind = kind_of(F.col("type"))
    together = nodes.groupBy("path").agg(F.bool_or(kind.isin(*COMMAND, *SSH)).alias("privileged"), F.bool_or(F.lower("type").rlike("agent|lmchat") & (kind != "noOp")).alias("ai")).where("privileged and ai")
    whole = together.select("path", F.lit(None).cast("int").alias("n"), F.lit("AI_WITH_PRIVILEGED_EXECUTION").alias("rule_id"), F.lit("CRITICAL").alias("severity"), F.lit(None).cast("string").alias("json_path"), F.lit(None).cast("string").alias("evidence"))
    return by_type.unionByName(by_leaf).unionByName(whole)


def worst(severity: Column) -> Column:
    """Aggregate: the highest severity, INFO without any."""
    return F.coalesce(F.max_by(severity, F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)), F.lit("INFO"))


def decision(severity: Column) -> Column:
    return F.when(severity == "CRITICAL", "BLOCKED").when(severity == "HIGH", "REVIEW_REQUIRED").otherwise("SAFE_FOR_LEARNING")


def reports(found: DataFrame, nodes: DataFrame, hits: DataFrame) -> DataFrame:
    """A row for each file: counts by node type, triggers, worst severity, decision. A file that cannot be parsed is CRITICAL."""
    # A file's nodes meet once: both groupings are inside its partition.
    typed = nodes.select("path", "type").repartition("path").groupBy("path", "type").agg(F.count("*").alias("n")).groupBy("path").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("node_types"), F.sum("n").alias("node_count"),
        F.array_sort(F.collect_set(F.when(F.contains(F.lower("type"), F.lit("trigger")) | F.endswith("type", F.lit(".cron")), F.col("type")))).alias("trigger_types"),
    )
    folded = hits.groupBy("path").agg(worst(F.col("severity")).alias("worst"), F.count("*").alias("n_findings"), F.array_sort(F.collect_set("rule_id")).alias("rules"))
    rows = found.select("path", "sha256", "parse_error").join(typed, "path", "left").join(folded, "path", "left")
    severity = F.when(F.col("parse_error").isNotNull(), "CRITICAL").otherwise(F.coalesce("worst", F.lit("INFO")))
    return rows.withColumn("max_severity", severity).withColumn("risk_decision", decision(F.col("max_severity"))).drop("worst")


def admission(risk: Column, severity: Column) -> Column:
    """struct<role, learning_scope, structure_allowed>."""
    def row(role: str, scope: str, allowed: bool) -> Column:
        return F.struct(F.lit(role).alias("role"), F.lit(scope).alias("learning_scope"), F.lit(allowed).alias("structure_allowed"))

    return (
        F.when((risk == "BLOCKED") | (severity == "CRITICAL"), row("SECURITY_EXAMPLE", "security_only", False))
        .when((risk == "REVIEW_REQUIRED") | (severity == "HIGH"), row("QUARANTINED", "review_only", False))
        .when(severity == "MEDIUM", row("STRUCTURE_ONLY", "structure_only", True))
        .otherwise(row("REFERENCE", "structure_and_metadata", True))
    )


def material(leaves: DataFrame) -> DataFrame:
    """Leaves (path, n, type, json_path, value) as executable metadata (digest and length, never content) or as redacted text of known keys; others are dropped.

    The node's type decides first: every text of a code or command node is executable, elsewhere expressions are.
    """
    key, value, kind = T.leaf_key(F.col("json_path")), F.col("value"), kind_of(F.col("type"))
    reason = F.when(kind.isin(*CODE), "code_node").when(kind.isin(*COMMAND, *SSH), "privileged_command").when(T.is_expression(value), "expression")
    language = F.when(kind.isin(*CODE), "javascript").when(kind.isin(*COMMAND, *SSH), "shell_or_remote_command").otherwise("expression")
    kept = leaves.where("value <> ''").withColumns({"reason": reason, "is_text": key.isin(*TEXT_KEYS)}).where("reason is not null or is_text")
    preview = F.when(T.path_is_sensitive(F.col("json_path")), F.lit("<redacted-sensitive-path>")).otherwise(T.redacted(value))
    return kept.select(
        "path", "n", "json_path", F.when(F.col("reason").isNotNull(), "executable").otherwise("text").alias("kind"), "reason", F.when(F.col("reason").isNotNull(), language).alias("language"),
        F.sha2("value", 256).alias("sha256"), F.length("value").alias("char_count"), F.when(F.col("reason").isNull(), preview).alias("preview"),
    )


def node_risk(node_type: Column, n_credentials: Column) -> Column:
    """struct<verdict, requires_pinning>: danger to the host, and reach outside."""
    kind = kind_of(node_type)
    verdict = F.when(kind.isin(*COMMAND, *SSH, *FILES), "BLOCKED").when(kind.isin(*CODE) | ~first_party(node_type), "REVIEW_REQUIRED").otherwise("ALLOWED")
    trigger = node_type.rlike("[Tt]rigger$") & ~kind.isin(*UNPINNABLE)
    return F.struct(verdict.alias("verdict"), (kind.isin(*HTTP, "webhook") | (n_credentials > 0) | trigger).alias("requires_pinning"))


def worst_verdict(verdict: Column) -> Column:
    return F.coalesce(F.max_by(verdict, F.array_position(F.array(*map(F.lit, VERDICTS)), verdict)), F.lit("ALLOWED"))


def eligible(found: DataFrame, nodes: DataFrame, report: DataFrame, count: int = 4) -> DataFrame:
    """The first `count` files by path that parse, are safe, have nodes and hold no credentials; fewer is an error for the caller."""
    held = nodes.groupBy("path").agg(F.bool_or(F.size("credential_types") > 0).alias("held"))
    rows = report.where("parse_error is null and risk_decision = 'SAFE_FOR_LEARNING'").join(held.where("not held"), "path")
    return rows.orderBy("path").limit(count).select("path", "sha256", "node_count")
