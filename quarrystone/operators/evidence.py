"""Evidence search (relational first, then lexical) and entity resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Kinds of entity matches, strongest first, and their scores.
MATCH_KINDS = {
    "EXACT_ID": 1.0, "EXACT_CANONICAL_NAME": 0.98, "EXACT_ALIAS": 0.92, "NORMALIZED_CANONICAL_NAME": 0.88,
    "NORMALIZED_ALIAS": 0.82, "CANONICAL_NAME_PREFIX": 0.60, "ALIAS_PREFIX": 0.55, "CANONICAL_NAME_CONTAINS": 0.40,
}
STRENGTHS = ("STRONG", "MODERATE", "WEAK")


def strength_rank(strength: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, STRENGTHS)), strength), F.lit(9))


def search(evidence: DataFrame, query: str, linked: DataFrame | None = None, entities: list[str] | None = None, min_score: float = 0.01, limit: int = 25) -> DataFrame:
    """evidence(evidence_id, text, strength?, subject_entity_id?) -> the best hits with score, relational and lexical parts.

    relational is 1.0 for evidence about a wanted entity, 0.7 for evidence that a claim about one links, else 0;
    score = 0.6 relational + 0.4 lexical, also where no entity is wanted. Evidence about another entity is dropped even if a claim links it.
    The order is total: score down, strength, id.
    """
    wanted = T.query_tokens(F.lit(query))
    rows = evidence.withColumn("lexical", T.lexical_score(wanted, T.tokens(F.col("text"))))
    if entities:
        own = F.col("subject_entity_id").isin(*entities)
        rows = rows.where(own | F.col("subject_entity_id").isNull())
        if linked is not None:
            rows = rows.join(linked.select("evidence_id").distinct().withColumn("linked", F.lit(True)), "evidence_id", "left")
        else:
            rows = rows.withColumn("linked", F.lit(None).cast("boolean"))
        relational = F.when(F.coalesce(own, F.lit(False)), 1.0).when(F.col("linked"), 0.7).otherwise(0.0)
        rows = rows.withColumn("relational", relational).withColumn("score", F.round(0.6 * F.col("relational") + 0.4 * F.col("lexical"), 6))
    else:
        rows = rows.withColumn("relational", F.lit(0.0)).withColumn("score", F.round(0.4 * F.col("lexical"), 6))
    order = [F.desc("score"), *([strength_rank(F.col("strength"))] if "strength" in rows.columns else []), F.asc("evidence_id")]
    return rows.where(F.col("score") >= min_score).orderBy(*order).limit(limit)


def match_kind(query: str, entity_id: Column, name: Column, aliases: Column) -> Column:
    """struct<kind, matched_on> of the strongest of the eight kinds, or null."""
    normal = T.normalise(F.lit(query))
    plain, sorted_aliases = T.normalise(name), F.array_sort(F.coalesce(aliases, F.array().cast("array<string>")))

    def first(test) -> Column:
        return F.get(F.filter(sorted_aliases, test), F.lit(0))

    def hit(kind: str, on: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), on.alias("matched_on"))

    some = normal != ""
    same, like, starts = first(lambda a: a == query), first(lambda a: T.normalise(a) == normal), first(lambda a: F.startswith(T.normalise(a), normal))
    inside = F.size(F.array_except(F.split(normal, " "), F.split(plain, " "))) == 0
    return (
        F.when(entity_id == query, hit("EXACT_ID", entity_id))
        .when(name == query, hit("EXACT_CANONICAL_NAME", name))
        .when(same.isNotNull(), hit("EXACT_ALIAS", same))
        .when(some & (plain == normal), hit("NORMALIZED_CANONICAL_NAME", name))
        .when(some & like.isNotNull(), hit("NORMALIZED_ALIAS", like))
        .when(some & F.startswith(plain, normal), hit("CANONICAL_NAME_PREFIX", name))
        .when(some & starts.isNotNull(), hit("ALIAS_PREFIX", starts))
        .when(some & inside, hit("CANONICAL_NAME_CONTAINS", name))
    )


def resolve(entities: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """entities(entity_id, canonical_name, aliases) -> the best matches, ambiguous if the best kind among them has more than one."""
    kinds = F.array(*[F.lit(k) for k in MATCH_KINDS])
    found = entities.withColumn("m", match_kind(query, F.col("entity_id"), F.col("canonical_name"), F.col("aliases"))).where("m is not null")
    found = found.select("entity_id", "canonical_name", F.col("m.kind").alias("match_kind"), F.col("m.matched_on").alias("matched_on"))
    found = found.withColumn("kind_rank", F.array_position(kinds, F.col("match_kind")).cast("int") - 1)
    top = found.orderBy("kind_rank", "entity_id").limit(limit)
    scores = F.create_map(*[x for k, v in MATCH_KINDS.items() for x in (F.lit(k), F.lit(v))])
    best = F.rank().over(Window.orderBy("kind_rank"))  # at most `limit` rows
    top = top.withColumns({"score": scores[F.col("match_kind")], "is_best": best == 1})
    return top.withColumn("ambiguous", F.count_if("is_best").over(Window.partitionBy()) > 1)
