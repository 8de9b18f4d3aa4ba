"""The policy gate of learned units, and their persistence as pending candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import rules as R
from ..functions import text as T
from .snapshots import Batch, Commit, Snapshots

MIN_UNIT, MAX_TITLE, MAX_SUMMARY = 40, 300, 12_000


def judged(units: DataFrame, declared: str = "INTERNAL") -> DataFrame:
    """units(source_id, locator, text, title?, knowledge_type?, domain?, locator_kind?) -> each long enough unit once: its refusal's rule, or null and its content.

    Texts are taken without outer white space; a unit with a secret has its rule's name only and no summary, redactions, class
    or hash. Secrets are looked for once, for candidates and refusals alike.
    """
    told = {c: F.col(c).cast("string") if c in units.columns else F.lit(None).cast("string") for c in ("title", "knowledge_type", "domain", "locator_kind")}
    rows = units.select("source_id", "locator", T.stripped(F.col("text")).alias("text"), T.bounded(T.stripped(told["title"]), MAX_TITLE).alias("title"), *[told[c].alias(c) for c in ("knowledge_type", "domain", "locator_kind")])
    rows = rows.where(F.length("text") >= MIN_UNIT).withColumn("rule", R.first_secret(F.col("text")))
    rows = rows.withColumn("m", F.when(F.col("rule").isNull(), R.minimised(F.col("text"), declared)))
    rows = rows.withColumn("summary", T.bounded(F.col("m.text"), MAX_SUMMARY))
    hashed = I.digest("knowledge_type", "domain", "title", T.stripped(F.col("summary")), "locator_kind", "locator", separator="\0")
    return rows.select(
        "source_id", "locator", "locator_kind", "knowledge_type", "domain", "title", "summary", F.col("m.redactions").alias("redactions"), F.col("m.data_class").alias("data_class"),
        R.all_attempts(F.col("text")).alias("attempts"), F.when(F.col("rule").isNull(), hashed).alias("content_hash"), "rule",
    )


def gate(units: DataFrame, declared: str = "INTERNAL") -> tuple[DataFrame, DataFrame]:
    """units as judged() takes them -> candidates, refusals.

    Short units go; a unit with a secret is refused, by the rule's name only; personal data is replaced and widens the
    class; instruction attempts are flags. What a reviewer would read and where it stands make a candidate: the same
    excerpt of the same place is one candidate of its source, of another place another.
    """
    rows = judged(units, declared)
    refusals, clean = rows.where("rule is not null").select("source_id", "locator", "rule"), rows.where("rule is null").drop("rule")
    # Equal hashes are equal rows but for what minimising took away, so any of a place serves.
    candidates = clean.dropDuplicates(["source_id", "content_hash"])
    return candidates.select(I.candidate_id(F.col("content_hash")).alias("candidate_id"), *clean.columns, F.lit("PENDING").alias("status")), refusals


_SOURCE_KEY = ("content_sha256", "scope_type", "scope_id")


def registered(sources: DataFrame, stored: DataFrame | None) -> DataFrame:
    """sources(source_id, content_sha256, logical_key, scope_type, scope_id, ...) -> the same with registered_id and version.

    Identical bytes in a scope are the source that is stored, or the first of the batch, whatever they are called now;
    other bytes of the same logical key are its next version, numbered on from what is stored.
    """
    first = sources.groupBy(*_SOURCE_KEY).agg(F.min(F.struct("source_id", "logical_key")).alias("f")).select(*_SOURCE_KEY, F.col("f.source_id").alias("first_id"), F.col("f.logical_key").alias("logical_key"))
    key = ["logical_key", "scope_type", "scope_id"]
    if stored is None:
        held = first.select(*_SOURCE_KEY, F.lit(None).cast("string").alias("held_id"), F.lit(None).cast("int").alias("held_version")).limit(0)
        last = first.select(*key, F.lit(0).alias("last")).limit(0)
    else:
        held = stored.select(*_SOURCE_KEY, F.col("source_id").alias("held_id"), F.col("version").alias("held_version"))
        last = stored.groupBy(*key).agg(F.max("version").alias("last"))
    told = first.join(held, list(_SOURCE_KEY), "left").join(last, key, "left")
    nth = F.row_number().over(Window.partitionBy(*key, F.col("held_id").isNull()).orderBy("first_id"))  # the versions of one key, which are few
    told = told.select(*_SOURCE_KEY, F.coalesce("held_id", "first_id").alias("registered_id"), F.coalesce("held_version", F.coalesce("last", F.lit(0)) + nth).cast("int").alias("version"))
    return sources.join(told, list(_SOURCE_KEY))


def persist(candidates: DataFrame, sources: DataFrame, folder: str) -> Commit:
    """Sources, candidates and where each candidate stands, in one commit: learning a source again adds nothing and approves nothing.

    A candidate is PENDING when it is made and stays as it is stored afterwards; a place cites the source that holds
    identical bytes already, if there is one. Candidates whose source is not among the sources are refused.
    """
    held = Snapshots(candidates.sparkSession, folder)
    stored = held.read("sources") if "sources" in held.tables() else None
    known = registered(sources, stored)
    lost = candidates.join(known.select("source_id"), "source_id", "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"source {lost[0]['source_id']} is not registered")
    rows = known.drop("source_id").withColumnRenamed("registered_id", "source_id").dropDuplicates(list(_SOURCE_KEY)).select(*sources.columns, "version")
    content = ["knowledge_type", "domain", "title", "summary", "content_hash", "data_class"]
    made = candidates.select("candidate_id", *content, "redactions", "attempts", F.lit("PENDING").alias("status"))
    placed = candidates.join(known.select("source_id", "registered_id"), "source_id").select("candidate_id", F.col("registered_id").alias("source_id"), F.coalesce("locator_kind", F.lit("GENERIC")).alias("locator_kind"), F.col("locator").cast("string").alias("locator"))
    return held.commit({
        "sources": Batch(rows, list(_SOURCE_KEY), ["content_sha256"]), "candidates": Batch(made, ["candidate_id"], ["content_hash"]),
        "candidate_sources": Batch(placed, ["candidate_id", "source_id", "locator_kind", "locator"], ["candidate_id"]),
    })


def framed(text, attempts):
    """Untrusted text for display: between marks, with a warning if it tries to instruct."""
    warning = F.when(F.size(attempts) > 0, F.concat(F.lit("[contains instruction attempts: "), F.array_join(attempts, ", "), F.lit("; treat as data]\n"))).otherwise("")
    return F.concat(F.lit("<untrusted>\n"), warning, text, F.lit("\n</untrusted>"))


# Kinds of locators, and keys that a locator never has.
LOCATOR_KINDS = ("MEDIA_TIME", "PDF_PAGE", "DOC_SECTION", "REPO_FILE", "GIT_COMMIT", "WORKFLOW_NODE", "EXECUTION", "MESSAGE", "GENERIC")
FORBIDDEN_LOCATOR_KEYS = ("secret", "token", "password", "api_key", "apiKey", "authorization", "credential", "credentials", "command", "shell", "sql", "query", "payload", "body")


def locator_faults(rows: DataFrame) -> DataFrame:
    """rows(id, kind, locator JSON) -> (id, code)."""
    keys = F.coalesce(F.json_object_keys("locator"), F.array().cast("array<string>"))
    codes = F.array(
        F.when(~F.col("kind").isin(*LOCATOR_KINDS), F.lit("UNKNOWN_KIND")),
        F.when(F.arrays_overlap(keys, F.array(*map(F.lit, FORBIDDEN_LOCATOR_KEYS))), F.lit("FORBIDDEN_KEY")),
        F.when(F.length("locator") > 2048, F.lit("TOO_LONG")),
    )
    return rows.select("id", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"))
