"""Token budgets of many context packs at once: estimates by type, and what each drop step saves of each pack.

A budget cuts content, never traceability. Steps are tried in their order until the pack fits; each is measured together
with the line in gaps that says what it took, and is taken back if the pack has not become smaller by it. A pack that
does not fit after the last step is refused with the smallest size that was reached. What each step saves is a column: packs
are rows, so a million of them are fitted by a projection, without a shuffle and without the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import once

# The steps in their order; what no budget takes; characters a token; cost of a container; length of a shortened line.
DROP_ORDER = ("VERBOSE_SUMMARY", "LOW_RELEVANCE_ARTIFACTS", "OLDER_EVENTS", "WEAKER_EVIDENCE", "SECONDARY_PROCEDURAL_REFS")
NON_DROPPABLE = (
    "context_pack_id", "version", "contract_version", "object_type", "objective", "mode", "scope", "entity_ids", "generated_at", "token_budget", "sensitivity_level", "data_classes", "constraints",
    "provenance_summary", "gaps", "state_projection_ids", "freshness_status",
)
CHARS, CONTAINER, LINE = 4, 2, 160
_WEAKEST_FIRST = ("WEAK", "MODERATE", "STRONG")
#: What the steps change, and the name of it in the line that tells of a step.
STEP_FIELDS = {"VERBOSE_SUMMARY": "constraints", "LOW_RELEVANCE_ARTIFACTS": "artifact_refs", "OLDER_EVENTS": "recent_event_ids", "WEAKER_EVIDENCE": "evidence_ids", "SECONDARY_PROCEDURAL_REFS": "procedural_refs"}
_TOLD_AS = STEP_FIELDS | {"VERBOSE_SUMMARY": "constraints (shortened)"}
#: Columns of a pack that the steps read; a pack without one of them has an empty list there.
FOLDED = (*STEP_FIELDS.values(), "provenance_summary", "gaps")
_TRIM = "array<struct<step:string,field:string,removed:array<string>>>"


def tokens(value: Column, kind: T.DataType) -> Column:
    """The estimate for a value of a type: texts by their length, 1 for a scalar, 2 for a container beside what it holds.

    A null counts nothing; a null field of a struct stands for a key that is not there.
    """
    if isinstance(kind, T.StringType):
        size = F.ceil(F.length(value) / CHARS)
    elif isinstance(kind, T.ArrayType):
        size = F.aggregate(value, F.lit(CONTAINER).cast("long"), lambda n, x: n + tokens(x, kind.elementType))
    elif isinstance(kind, T.MapType):
        size = F.aggregate(F.map_entries(value), F.lit(CONTAINER).cast("long"), lambda n, x: n + tokens(x["key"], kind.keyType) + tokens(x["value"], kind.valueType))
    elif isinstance(kind, T.StructType):
        size = F.when(value.isNotNull(), fields_tokens(value.getField, kind))
    else:
        size = F.when(value.isNotNull(), 1)
    return F.coalesce(size.cast("long"), F.lit(0).cast("long"))


def fields_tokens(of: Callable[[str], Column], kind: T.StructType) -> Column:
    """2 for an object, its keys and their values."""
    parts = [F.when(of(f.name).isNotNull(), -(-len(f.name) // CHARS) + tokens(of(f.name), f.dataType)).otherwise(F.lit(0)).cast("long") for f in kind]
    return reduce(lambda a, b: a + b, parts, F.lit(CONTAINER).cast("long"))


def core(packs: DataFrame) -> DataFrame:
    """The part of each pack that no budget takes."""
    return packs.select(*[c for c in packs.columns if c in NON_DROPPABLE])


def minimum_tokens(packs: DataFrame) -> Column:
    """What the part costs that no budget takes."""
    return fields_tokens(F.col, core(packs).schema)


def pack_tokens(packs: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """The estimate for whole packs."""
    return fields_tokens(F.col, T.StructType([f for f in packs.schema if f.name not in without]))


def trim_line(entry: Column) -> Column:
    """What a step took, as a line for gaps."""
    n = F.size(entry["removed"]).cast("string")
    return F.concat(F.lit("trimmed for token budget ("), entry["step"], F.lit("): "), n, F.lit(" item(s) removed from "), entry["field"], F.lit(" ["), F.array_join(entry["removed"], ", "), F.lit("]"))


def letters_tokens(n: Column) -> Column:
    """The estimate for a text of n letters."""
    return F.ceil(n / CHARS).cast("long")


def joined_length(n: Column, letters: Column) -> Column:
    """Letters of n texts, one at least, that have so many letters themselves, joined by a comma and a space."""
    return letters + 2 * (n - 1)


def trim_line_length(step: str, n: Column, letters: Column) -> Column:
    """Letters of trim_line for n things of so many letters."""
    return joined_length(n, letters) + F.length(n.cast("string")) + len(f"trimmed for token budget ({step}):  item(s) removed from {_TOLD_AS[step]} []")


def shortened(line: Column) -> Column:
    return F.when(F.length(line) > LINE, F.concat(F.left(line, F.lit(LINE - 3)), F.lit("..."))).otherwise(line)


def _without(values: Column, removed: Column) -> Column:
    return F.filter(values, lambda x: ~F.array_contains(removed, x))


def _weaker(evidence: Column, strengths: Column) -> Column:
    """All but the strongest quarter of the evidence, one piece at least; what has no known strength counts as the strongest."""
    rank = lambda e: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, _WEAKEST_FIRST)), F.try_element_at(strengths, e)), F.lit(0)), F.lit(len(_WEAKEST_FIRST) + 1))
    ranked = F.array_sort(F.transform(evidence, lambda e: F.struct(rank(e).alias("r"), e.alias("e"))))
    kept = F.greatest(F.lit(1), F.floor(F.size(evidence) / 4).cast("int"))
    return F.transform(F.slice(ranked, 1, F.greatest(F.lit(0), F.size(evidence) - kept)), lambda x: x["e"])


def fit(packs: DataFrame, budget: str = "token_budget", strengths: str = "strengths", artifact_id: str = "artifact_id") -> DataFrame:
    """packs, with strengths (map of evidence to its strength, not part of a pack) ->
    packs as they fit, with size, fits, minimum_required (null if it fits) and trimmed (the steps that were taken).

    The budget is a number, or an array of numbers: then a pack gives a row for each, with that number as its budget, and
    is measured once for all of them. A pack without a budget, or with one below 1, does not fit. Columns that the steps
    read and packs lack are added as empty lists. Lists that a step or the gaps' lines touch come back sorted.

    No two steps change the same list and no two lines are alike, so what a step saves, its line counted, depends neither on the
    budget nor on the other steps: a step is taken if it saves anything and what the steps before have left does not fit.
    """
    lists = {"artifact_refs": f"array<struct<{artifact_id}:string>>", "provenance_summary": "array<struct<object_id:string>>"}
    for c in FOLDED:
        packs = packs.withColumn(c, F.coalesce(F.col(c) if c in packs.columns else F.lit(None).cast(lists.get(c, "array<string>")), F.array().cast(lists.get(c, "array<string>")) if c not in packs.columns else F.array().cast(packs.schema[c].dataType)))
    pack_columns = [c for c in packs.columns if c != strengths]
    kinds = {f.name: f.dataType for f in packs.schema}
    several = isinstance(kinds[budget], T.ArrayType)
    fixed = fields_tokens(F.col, T.StructType([packs.schema[c] for c in pack_columns if c not in FOLDED and c != budget]))
    fixed = fixed + F.lit(sum(-(-len(c) // CHARS) for c in FOLDED))
    known = F.coalesce(F.col(strengths), F.create_map().cast("map<string,string>")) if strengths in packs.columns else F.create_map().cast("map<string,string>")

    constraints, events, evidence, refs = F.col("constraints"), F.col("recent_event_ids"), F.col("evidence_ids"), F.col("procedural_refs")
    last = F.when(F.size(events) > 2, F.slice(events, -2, 2)).otherwise(F.array().cast("array<string>"))
    #: For each step: what it takes, and the lists that it changes, given what it takes.
    steps = {
        "VERBOSE_SUMMARY": (F.transform(F.filter(constraints, lambda c: F.length(c) > LINE), lambda c: F.split_part(c, F.lit(":"), F.lit(1))), lambda gone: {"constraints": F.array_sort(F.transform(constraints, shortened))}),
        "LOW_RELEVANCE_ARTIFACTS": (F.transform("artifact_refs", lambda a: a[artifact_id]), lambda gone: {"artifact_refs": F.slice("artifact_refs", 1, 0)}),
        "OLDER_EVENTS": (once(last, lambda kept: _without(events, kept)), lambda gone: {"recent_event_ids": last}),
        "WEAKER_EVIDENCE": (_weaker(evidence, known), lambda gone: {"evidence_ids": F.array_sort(F.array_distinct(_without(evidence, gone))), "provenance_summary": F.filter("provenance_summary", lambda p: ~F.array_contains(gone, p["object_id"]))}),
        "SECONDARY_PROCEDURAL_REFS": (once(F.slice(refs, 1, 1), lambda kept: _without(refs, kept)), lambda gone: {"procedural_refs": F.slice(refs, 1, 1)}),
    }

    def tried(step: str) -> Column:
        """A step's entry, its line, the lists after it and what they come to less than before, the line counted unless gaps have it already."""
        removed, after = steps[step]

        def told(gone: Column) -> Column:
            entry = F.struct(F.lit(step).alias("step"), F.lit(_TOLD_AS[step]).alias("field"), F.array_sort(gone).alias("removed"))
            lists = after(gone)
            return once(F.struct(entry.alias("entry"), F.when(F.size(gone) > 0, trim_line(entry)).alias("line"), *[F.coalesce(v, F.col(c)).alias(c) for c, v in lists.items()]), lambda x: F.struct(
                *[x[c].alias(c) for c in ("entry", "line", *lists)],
                (sum((tokens(F.col(c), kinds[c]) - tokens(x[c], kinds[c]) for c in lists), F.lit(0).cast("long")) - F.when(F.array_contains("gaps", x["line"]), 0).otherwise(tokens(x["line"], T.StringType()))).alias("saved"),
            ))

        return once(removed, told)

    whole = fixed + tokens(F.array_distinct("gaps"), kinds["gaps"])
    for c in (*STEP_FIELDS.values(), "provenance_summary"):
        whole = whole + tokens(F.col(c), kinds[c])
    rows = packs.withColumns({"_whole": whole, **{f"_{step}": tried(step) for step in DROP_ORDER}}).drop(strengths)
    # An explode stands between measuring and choosing, for one budget too, so that no step is measured again where it is named.
    rows = rows.withColumn("_budgets", F.col(budget) if several else F.array(budget)).drop(budget).withColumn(budget, F.explode("_budgets"))
    size = F.col("_whole") + F.when(F.col(budget).isNotNull(), -(-len(budget) // CHARS) + 1).otherwise(0)
    new, log = {}, []
    for step in DROP_ORDER:
        own, fits = F.col(f"_{step}"), F.coalesce((size <= F.col(budget)) & (F.col(budget) >= 1), F.lit(False))
        taken = ~fits & (own["saved"] > 0)
        new |= {c: F.when(taken, own[c]).otherwise(F.col(c)) for c in (STEP_FIELDS[step], *(["provenance_summary"] if step == "WEAKER_EVIDENCE" else []))}
        log.append(F.when(taken & own["line"].isNotNull(), F.struct(own["entry"].alias("entry"), own["line"].alias("line"))))
        size = size + F.when(taken, -own["saved"]).otherwise(0)
        rows = rows.withColumn(f"_size_{step}", size)
        size = F.col(f"_size_{step}")
    rows = rows.withColumn("_log", F.array_compact(F.array(*log)))
    new["gaps"] = F.array_sort(F.array_distinct(F.concat(F.col("gaps"), F.transform("_log", lambda x: x["line"]))))
    fits = F.coalesce((size <= F.col(budget)) & (F.col(budget) >= 1), F.lit(False))
    return rows.select(
        *[new.get(c, F.col(c)).alias(c) for c in pack_columns], size.alias("size"), fits.alias("fits"), F.when(~fits, size).alias("minimum_required"), F.transform("_log", lambda x: x["entry"]).cast(_TRIM).alias("trimmed"),
    )
