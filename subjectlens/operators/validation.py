"""Validation of triples by the votes of several agents over rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subjectlens.functions.text import relation_letters


def verdict_of(response: Column) -> Column:
    """(verdict, confidence) of a reply with a JSON object in it; UNKNOWN and 5 where that does not parse or its confidence is no number."""
    body = F.regexp_extract(response, r"(\{[\s\S]*\})", 1)
    reply = F.try_parse_json(body)
    given = F.try_variant_get(reply, "$.confidence", "string")
    confidence = F.coalesce(given.try_cast("double"), F.when(given.isNull(), F.lit(5.0)))
    said = F.upper(F.coalesce(F.try_variant_get(reply, "$.verdict", "string"), F.lit("UNKNOWN")))
    parsed = reply.isNotNull() & confidence.isNotNull()
    verdict = F.when(parsed & said.isin("CORRECT", "INCORRECT"), said).otherwise("UNKNOWN")
    return F.struct(verdict.alias("verdict"), F.coalesce(F.when(parsed, confidence), F.lit(5.0)).alias("confidence"))


def complete_votes(votes: DataFrame, agents: list[str], rounds: int) -> DataFrame:
    """One row per triple, round and agent; a missing reply is UNKNOWN."""
    ids = votes.select("id").distinct()
    grid = ids.select("id", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).select("id", "round", F.explode(F.array(*map(F.lit, agents))).alias("agent"))
    return grid.join(votes, ["id", "round", "agent"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("UNKNOWN")))


def decisions(votes: DataFrame, enough: int = 3) -> DataFrame:
    """(id, decision, round): the first round in which `enough` agents agree decides; else the larger side of the
    last round, and NEEDS_REVIEW if its sides are equal."""
    by = votes.groupBy("id", "round").agg(F.count_if(F.col("verdict") == "CORRECT").alias("yes"), F.count_if(F.col("verdict") == "INCORRECT").alias("no"))
    decided = F.when((F.col("yes") >= enough) | (F.col("no") >= enough), F.col("round"))
    pick = by.groupBy("id").agg(F.min(decided).alias("first"), F.max("round").alias("last"), F.min_by(F.struct("yes", "no"), decided).alias("early"), F.max_by(F.struct("yes", "no"), "round").alias("late"))
    side = F.coalesce("early", "late")
    decision = F.when(side["yes"] > side["no"], "ACCEPT").when(side["no"] > side["yes"], "REJECT").otherwise("NEEDS_REVIEW")
    return pick.select("id", decision.alias("decision"), F.coalesce("first", "last").alias("round"))


def council(votes: DataFrame, most_rounds: int = 3) -> DataFrame:
    """(id, round, decision, go_on, final, statement) for votes(id, round, verdict, head, relation, tail) of one round.

    Three votes on one side decide, two on both sides tie, anything else continues. A tie is final as NEEDS_REVIEW, but
    like an accepted triple it has a relation to write.
    """
    by = votes.groupBy("id", "round").agg(
        F.count_if(F.upper("verdict") == "CORRECT").alias("yes"),
        F.count_if(F.upper("verdict") == "INCORRECT").alias("no"),
        *[F.first(c).alias(c) for c in ("head", "relation", "tail")],
    )
    yes, no = F.col("yes"), F.col("no")
    clear, tie = (yes >= 3) | (no >= 3), (yes == 2) & (no == 2)
    decision = F.when(clear, F.when(yes > no, "ACCEPT").otherwise("REJECT")).when(tie, "TIE").otherwise("CONTINUE")
    out = by.withColumn("decision", decision).withColumn("go_on", ~clear & (F.col("round") < most_rounds))
    kept = (F.col("decision") == "ACCEPT") | (F.col("decision") == "TIE")
    statement = F.concat(F.lit("("), "head", F.lit(")-["), relation_letters(F.col("relation")), F.lit("]->("), "tail", F.lit(")"))
    final = F.when(F.col("decision") == "TIE", "NEEDS_REVIEW").otherwise(F.col("decision"))
    return out.select("id", "round", "decision", "go_on", final.alias("final"), F.when(kept, statement).alias("statement"))


def needs_validation(risk: Column, category: Column, kind: Column) -> Column:
    """Risky items, those of a sensitive or inferred category, and inferences."""
    up = lambda c: F.upper(F.coalesce(c, F.lit("")))
    named = F.contains(up(category), F.lit("SENSITIVE")) | F.contains(up(category), F.lit("INFERRED"))
    return up(risk).isin("HIGH", "CRITICAL") | named | up(kind).isin("INFERENCE", "INFERRED")


def relation_decisions(relations: DataFrame, decided: DataFrame) -> DataFrame:
    """relations(id, s, p, o) with a decision; a part that is missing or empty needs review, as does a lacking decision."""
    whole = F.lit(True)
    for c in ("s", "p", "o"):
        whole = whole & (F.coalesce(F.col(c), F.lit("")) != "")
    joined = relations.join(decided.select("id", F.col("decision").alias("__said")), "id", "left")
    decision = F.when(whole, F.coalesce("__said", F.lit("NEEDS_REVIEW"))).otherwise("NEEDS_REVIEW")
    reason = F.when(~whole, "Incomplete relationship").otherwise("MAKGED did not accept inferred relationship")
    return joined.withColumn("decision", decision).drop("__said").withColumn("reason", F.when(F.col("decision") != "ACCEPT", reason))


def review_alerts(relations: DataFrame) -> DataFrame:
    """One alert for each relation (source_value, predicate, target_value, file_id) that was not accepted."""
    key = [F.coalesce(c, F.lit("")).alias(n) for c, n in (("s", "source_value"), ("p", "predicate"), ("o", "target_value"))]
    rows = relations.filter("decision <> 'ACCEPT'").select("file_id", *key, "decision", "reason", "seq")
    last = F.max_by(F.struct("decision", "reason"), "seq").alias("x")
    found = rows.groupBy("file_id", "source_value", "predicate", "target_value").agg(last)
    return found.select("file_id", "source_value", "predicate", "target_value", "x.decision", "x.reason", F.lit("high").alias("risk_level"), F.lit("makged_review").alias("alert_type"))


def with_status(items: DataFrame, decided: DataFrame) -> DataFrame:
    """items(id, risk, category, kind) with a status; rejected ones go."""
    joined = items.join(decided.select("id", "decision"), "id", "left")
    risky = needs_validation(F.col("risk"), F.col("category"), F.col("kind"))
    said = F.when(F.col("decision").isNull(), "not_configured").when(F.col("decision") == "ACCEPT", "accepted").when(F.col("decision") == "REJECT", "rejected").otherwise("needs_review")
    return joined.withColumn("status", F.when(risky, said).otherwise("not_required")).filter("status <> 'rejected'").drop("decision")
