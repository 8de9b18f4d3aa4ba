"""Closed schemas over JSON text: every unexpected and missing key, wrong type, length and value at any depth, with its path.

A schema is a tree of nodes; it compiles to one column over a VARIANT, so documents are judged by a projection: no join,
no shuffle, no Python, and every fault of a document is told, not the first alone. Objects are entered by the keys that
the schema knows, arrays by position; what hangs below an unexpected key is one fault and is not entered. Keys that are
banned at any depth are looked for in the document's compact text, where a key can only stand behind a brace or a comma.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions.rules import once

FAULT = "array<struct<path:string,code:string>>"


@dataclass(frozen=True)
class Text:
    """A string: its greatest length, whether it may be empty or null, a pattern, or the values it may have."""

    longest: int
    empty: bool = False
    null: bool = False
    pattern: str | None = None
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Whole:
    least: int = 0


@dataclass(frozen=True)
class Flag:
    """A boolean, or one value of it."""

    value: bool | None = None


@dataclass(frozen=True)
class Scalar:
    """Null, a number, a boolean, or a string that is a plain token."""

    pattern: str


@dataclass(frozen=True)
class Each:
    """An array of one kind of element; banned keys may occur nowhere below it."""

    item: Node
    banned: tuple[str, ...] = ()


@dataclass(frozen=True)
class Table:
    """An object of any keys, with limits on keys and values."""

    key: Text
    value: Node


@dataclass(frozen=True)
class Object:
    """An object of these keys only; optional ones may be absent."""

    fields: dict[str, Node]
    optional: tuple[str, ...] = ()
    checks: dict[str, str] = field(default_factory=dict)


Node = Text | Whole | Flag | Scalar | Each | Table | Object


def _fault(path: Column, code: str | Column) -> Column:
    return F.struct(path.alias("path"), (F.lit(code) if isinstance(code, str) else code).alias("code"))


def _none() -> Column:
    return F.array().cast(FAULT)


def _first(path: Column, *rules: tuple[str, Column]) -> Column:
    """The first rule that is broken, as an array of one fault or none."""
    code = F.coalesce(*[F.when(F.coalesce(broken, F.lit(True)), F.lit(code)) for code, broken in rules])
    return F.when(code.isNotNull(), F.array(_fault(path, code))).otherwise(_none())


def _text_rules(value: Column, node: Text) -> list[tuple[str, Column]]:
    rules = [] if node.empty or node.values else [("EMPTY", value == "")]
    rules.append(("TOO_LONG", F.length(value) > node.longest))
    if node.pattern:
        rules.append(("PATTERN", ~value.rlike(node.pattern)))
    if node.values:
        rules.append(("VALUE", ~value.isin(*node.values)))
    return rules


def _get(value: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{key}", kind)


def _kind(value: Column) -> Column:
    """The type of a scalar; an absent value has none, and containers are not asked."""
    return F.schema_of_variant(value)


def _as(value: Column, kind: str) -> Column:
    return value.try_cast(kind)


def _judged(value: Column, path: Column, node: Node) -> Column:
    """The faults of a value that is there."""
    if isinstance(node, Text):
        kind, text = _kind(value), F.try_variant_get(value, "$", "string")
        found = _first(path, ("NOT_A_STRING", kind != "STRING"), *_text_rules(text, node))
        return F.when(F.is_variant_null(value), _none()).otherwise(found) if node.null else found
    if isinstance(node, Whole):
        # A whole number beyond 18 digits is a decimal; a shorter decimal was written with a point.
        whole = _kind(value).rlike(r"^(BIGINT|DECIMAL\((19|[23]\d),0\))$")
        return _first(path, ("NOT_A_WHOLE_NUMBER", ~whole), ("TOO_SMALL", F.try_variant_get(value, "$", "decimal(38,0)") < node.least))
    if isinstance(node, Flag):
        rules = [("NOT_A_BOOLEAN", _kind(value) != "BOOLEAN")]
        return _first(path, *rules, *([("VALUE", F.try_variant_get(value, "$", "boolean") != node.value)] if node.value is not None else []))
    if isinstance(node, Scalar):
        kind, container = _kind(value), _as(value, "map<string,variant>").isNotNull() | _as(value, "array<variant>").isNotNull()
        return F.when(F.is_variant_null(value), _none()).otherwise(_first(path, ("NOT_A_SAFE_SCALAR", container | ((kind == "STRING") & ~F.try_variant_get(value, "$", "string").rlike(node.pattern)))))
    if isinstance(node, Each):
        inside = lambda items: F.flatten(F.transform(items, lambda x, k: _judged(x, F.concat(path, F.lit("["), k.cast("string"), F.lit("]")), node.item)))
        found = once(_as(value, "array<variant>"), lambda items: F.when(items.isNull(), F.array(_fault(path, "NOT_AN_ARRAY"))).otherwise(inside(items)))
        if not node.banned:
            return found
        banned = F.coalesce(F.to_json(value).rlike(r"[{,]\"(?:" + "|".join(node.banned) + r")\":"), F.lit(False))
        return F.concat(found, F.when(banned, F.array(_fault(path, "BANNED_KEY"))).otherwise(_none()))
    entries = _as(value, "map<string,variant>")
    if isinstance(node, Table):
        def entry(e: Column) -> Column:
            at = F.concat(path, F.lit("."), e["key"])
            return F.concat(_first(F.concat(path, F.lit(".<key>")), *_text_rules(e["key"], node.key)), _judged(e["value"], at, node.value))

        return once(entries, lambda m: F.when(m.isNull(), F.array(_fault(path, "NOT_AN_OBJECT"))).otherwise(F.flatten(F.transform(F.map_entries(m), entry))))

    def members(m: Column) -> Column:
        keys = F.map_keys(m)
        at = lambda k: F.concat(path, F.when(path == "", F.lit("")).otherwise(F.lit(".")), k)
        allowed = F.array(*map(F.lit, node.fields))
        parts = [F.transform(F.array_sort(F.array_except(keys, allowed)), lambda k: _fault(at(k), "UNEXPECTED_FIELD"))]
        needed = F.array(*[F.lit(k) for k, n in node.fields.items() if k not in node.optional and not (isinstance(n, Text) and n.null or isinstance(n, Scalar))])
        parts.append(F.transform(F.array_except(needed, keys), lambda k: _fault(at(k), "MISSING_FIELD")))
        for key, child in node.fields.items():
            held = F.try_element_at(m, F.lit(key))
            parts.append(F.when(F.array_contains(keys, key), _judged(held, at(F.lit(key)), child)).otherwise(_none()))
        for code, broken in node.checks.items():
            parts.append(F.when(F.coalesce(CHECKS[broken](m), F.lit(False)), F.array(_fault(path, code))).otherwise(_none()))
        return F.flatten(F.array(*parts))

    return once(entries, lambda m: F.when(m.isNull(), F.array(_fault(path, "NOT_AN_OBJECT"))).otherwise(members(m)))


def _member(m: Column, key: str, kind: str) -> Column:
    return F.try_variant_get(F.try_element_at(m, F.lit(key)), "$", kind)


# For each decision and severity the role and scope of what may be learned.
EXPECTED_ROLES = {
    ("SAFE_FOR_LEARNING", "INFO"): ("REFERENCE", "structure_and_metadata"), ("SAFE_FOR_LEARNING", "LOW"): ("REFERENCE", "structure_and_metadata"), ("SAFE_FOR_LEARNING", "MEDIUM"): ("STRUCTURE_ONLY", "structure_only"),
    ("REVIEW_REQUIRED", "HIGH"): ("QUARANTINED", "review_only"), ("BLOCKED", "CRITICAL"): ("SECURITY_EXAMPLE", "security_only"),
}
STRUCTURE_ROLES = ("REFERENCE", "STRUCTURE_ONLY")


def _node_count(m: Column) -> Column:
    nodes = F.size(_as(F.try_element_at(m, F.lit("nodes")), "array<variant>"))
    whole = _kind(F.try_element_at(m, F.lit("node_count"))) == "BIGINT"
    return whole & (nodes >= 0) & (_member(m, "node_count", "long") != nodes)


def _pair(m: Column) -> Column:
    return F.concat_ws("|", *[_member(m, k, "string") for k in ("risk_decision", "max_severity")])


def _unknown_pair(m: Column) -> Column:
    both = _member(m, "risk_decision", "string").isNotNull() & _member(m, "max_severity", "string").isNotNull()
    return both & ~_pair(m).isin(*["|".join(p) for p in EXPECTED_ROLES])


def _other_role(m: Column) -> Column:
    role = F.concat_ws("|", *[_member(m, k, "string") for k in ("knowledge_role", "learning_scope")])
    return reduce(lambda a, b: a | b, [(_pair(m) == "|".join(pair)) & (role != "|".join(want)) for pair, want in EXPECTED_ROLES.items()])


def _structure(m: Column) -> Column:
    return _member(m, "structure_reference_allowed", "boolean") != _member(m, "knowledge_role", "string").isin(*STRUCTURE_ROLES)


#: Rules between an object's fields, by name.
CHECKS = {"node_count": _node_count, "unknown_pair": _unknown_pair, "other_role": _other_role, "structure": _structure}

# The item's keys, lengths, patterns and values.
SHA256, GIT_HASH, SAFE_TOKEN = r"^[0-9a-f]{64}\z", r"^[0-9a-f]{40}([0-9a-f]{24})?\z", r"^[A-Za-z0-9_.:/@-]{1,128}\z"
MAX_BYTES, MAX_VERSION = 5 * 1024 * 1024, 128
_NODE = Object({
    "name_untrusted": Text(256, empty=True), "type": Text(256), "type_version": Scalar(SAFE_TOKEN), "resource": Scalar(SAFE_TOKEN), "operation": Scalar(SAFE_TOKEN), "credential_types": Each(Text(128)),
})
_EDGE = Object({"source_name_untrusted": Text(256, empty=True), "target_name_untrusted": Text(256, empty=True), "channel": Text(256, empty=True), "source_output_index": Whole(), "target_input_index": Whole()})
_FINDING = Object({"rule_id": Text(128, True, True), "severity": Text(32, True, True), "node_name": Text(256, True, True), "node_type": Text(256, True, True), "json_path": Text(2048, True, True)})
_UNTRUSTED = Object(
    {"kind": Text(64), "node_name": Text(256, empty=True), "node_type": Text(256, empty=True), "json_path": Text(2048), "sha256": Text(64, pattern=SHA256), "char_count": Whole(), "preview": Text(400, empty=True)}, optional=("preview",)
)
_EXECUTABLE = Object({
    "kind": Text(64), "node_name": Text(256, empty=True), "node_type": Text(256, empty=True), "json_path": Text(2048), "reason": Text(128), "language": Text(128), "sha256": Text(64, pattern=SHA256), "char_count": Whole(), "content_persisted": Flag(False),
})
ITEM = Object({
    "schema_version": Text(128, values=("0.1",)), "kind": Text(128, values=("KNOWLEDGE_ITEM",)), "source_content_trust": Text(128, values=("UNTRUSTED_SOURCE_DATA",)),
    "provenance": Object({"source_repo": Text(512), "source_commit": Text(64, pattern=GIT_HASH), "source_path": Text(2048), "sha256": Text(64, pattern=SHA256)}),
    "workflow": Object({
        "name_untrusted": Text(256, empty=True), "node_count": Whole(), "node_types": Table(Text(256), Whole()), "trigger_types": Each(Text(256)), "integrations": Each(Text(256)), "nodes": Each(_NODE), "edges": Each(_EDGE),
    }, checks={"NODE_COUNT": "node_count"}),
    "admission": Object({
        "source_stage": Text(64, values=("RAW_UNTRUSTED",)), "analysis_stage": Text(64, values=("STATIC_ANALYZED",)), "risk_decision": Text(64), "max_severity": Text(32), "knowledge_role": Text(64), "learning_scope": Text(64),
        "structure_reference_allowed": Flag(), "implementation_reference_allowed": Flag(False), "validated": Flag(False),
    }, checks={"UNKNOWN_DECISION": "unknown_pair", "OTHER_ROLE": "other_role", "STRUCTURE_ALLOWED": "structure"}),
    "security_findings": Each(_FINDING), "untrusted_text": Each(_UNTRUSTED), "executable_snippets_untrusted": Each(_EXECUTABLE, banned=("content", "code", "command")),
})


def faults(rows: DataFrame, key: str, json: str = "json", schema: Node = ITEM, max_bytes: int = MAX_BYTES) -> DataFrame:
    """rows(key, JSON text) -> (key, path, code) of everything that breaks the schema.

    Text that is no JSON, or none at all, is one fault, NOT_JSON; more than max_bytes, counted with a space behind each
    comma and colon, is one more, TOO_LARGE. The path of the document itself is ''.
    """
    variant = F.try_parse_json(F.col(json))
    found = once(variant, lambda v: F.when(v.isNull(), F.array(_fault(F.lit(""), "NOT_JSON"))).otherwise(F.concat(_judged(v, F.lit(""), schema), _too_large(F.to_json(v), max_bytes))))
    return rows.select(F.col(key), F.explode(found).alias("f")).select(key, "f.path", "f.code")


def _too_large(compact: Column, max_bytes: int) -> Column:
    def spaced(text: Column) -> Column:
        bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', "")
        return F.octet_length(text) + F.length(bare) - F.length(F.translate(bare, ",:", ""))

    # Only texts near the limit are counted: separators are fewer than half of the bytes.
    size = once(compact, lambda t: F.when(F.octet_length(t) * 2 > max_bytes, spaced(t)).otherwise(F.octet_length(t)))
    return F.when(size > max_bytes, F.array(_fault(F.lit(""), "TOO_LARGE"))).otherwise(_none())


def prepared(rows: DataFrame, analyzer_version: str, json: str = "json") -> dict[str, DataFrame]:
    """Valid items as the rows of three tables that name one another; whoever calls has seen that there are no faults.

    Lists that are sets come sorted and without repetitions, as stored values are compared when an item comes again.
    """
    if not 1 <= len(analyzer_version) <= MAX_VERSION:
        raise ValueError(f"an analyzer version has 1 to {MAX_VERSION} characters")
    v = F.try_parse_json(F.col(json))
    get = lambda path, kind="string": F.try_variant_get(F.col("v"), f"$.{path}", kind)
    listed = lambda path: F.array_sort(F.array_distinct(get(path, "array<string>")))
    told = rows.select(F.explode_outer(F.array(v)).alias("v")).select(  # behind a generator: joins' null checks do not parse once more
        *[get(f"provenance.{c}").alias(c) for c in ("source_repo", "source_commit", "source_path", "sha256")], F.lit(analyzer_version).alias("analyzer_version"), get("schema_version").alias("schema_version"),
        *[get(f"admission.{c}").alias(c) for c in ("risk_decision", "max_severity", "knowledge_role", "learning_scope")], get("source_content_trust").alias("source_content_trust"),
        *[F.to_json(get(c, "variant")).alias(c) for c in ("security_findings", "untrusted_text", "executable_snippets_untrusted")],
        *[F.to_json(get(f"workflow.{c}", "variant")).alias(c) for c in ("node_types", "nodes", "edges")], listed("workflow.trigger_types").alias("trigger_types"), listed("workflow.integrations").alias("integrations"),
    )
    told = told.withColumn("source_id", I.digest("source_repo", "source_commit", "source_path", "sha256"))
    told = told.withColumn("analysis_id", I.digest("source_id", "analyzer_version")).withColumn("item_id", I.digest("analysis_id", "schema_version"))
    return {
        "sources": told.select("source_id", "source_repo", "source_commit", "source_path", "sha256", F.lit("WORKFLOW_JSON").alias("source_kind"), F.lit("RAW_UNTRUSTED").alias("trust_level")),
        "analyses": told.select("analysis_id", "source_id", "analyzer_version", "risk_decision", "max_severity", F.col("security_findings").alias("findings")),
        "items": told.select("item_id", "analysis_id", "schema_version", "source_content_trust", "knowledge_role", "learning_scope", "node_types", "trigger_types", "integrations", "nodes", "edges", "untrusted_text", "executable_snippets_untrusted", "security_findings"),
    }
