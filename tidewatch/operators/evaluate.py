"""Measures of findings and session flags against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.citations import Citations
def confusion() -> list[Column]:
    """Counts over boolean columns ``flagged`` and ``malicious``."""
    hit, bad = F.col("flagged"), F.col("malicious")
    return [F.count(F.lit(1)).alias("evaluated"), F.count_if(bad).alias("malicious"), F.count_if(~bad).alias("benign"),
            F.count_if(hit & bad).alias("true_positive"), F.count_if(hit & ~bad).alias("false_positive"),
            F.count_if(~hit & bad).alias("false_negative")]


def scores(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and F1, 0 where undefined."""
    tp, fp, fn = F.col("true_positive"), F.col("false_positive"), F.col("false_negative")
    prec = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    return (counts.withColumn("precision", F.round(prec, 4)).withColumn("recall", F.round(rec, 4)).withColumn("f1", F.round(f1, 4)))


def flagged_events(findings: DataFrame, cited: Citations) -> DataFrame:
    """Distinct events carrying or cited by a finding; ``anchor`` marks the carriers."""
    own = findings.select("website_id", F.col("event_id").cast("string").alias("event_id"), F.lit(True).alias("anchor"))
    others = cited.events(findings).select("website_id", F.col("event_id").cast("string").alias("event_id"))
    return own.unionByName(others.withColumn("anchor", F.lit(False))).groupBy("website_id", "event_id").agg(F.bool_or("anchor").alias("anchor"))


def _judged(findings: DataFrame, labels: DataFrame, cited: Citations) -> DataFrame:
    lab = labels.withColumn("event_id", F.col("event_id").cast("string"))
    d = lab.join(flagged_events(findings, cited), ["website_id", "event_id"], "left")
    return d.withColumn("flagged", F.col("anchor").isNotNull()).withColumn("malicious", F.col("label") == "malicious")


def evaluate_events(findings: DataFrame, labels: DataFrame, cited: Citations) -> DataFrame:
    return scores(_judged(findings, labels, cited).agg(*confusion()))


def scenario_report(findings: DataFrame, labels: DataFrame, cited: Citations) -> DataFrame:
    """Per scenario: events, flagged events, whether any event carries a finding."""
    return _judged(findings, labels, cited).groupBy("scenario").agg(
        F.count(F.lit(1)).alias("events"), F.count_if("flagged").alias("flagged"),
        F.bool_or(F.coalesce("anchor", F.lit(False))).alias("has_finding"))


def false_positive_examples(findings: DataFrame, labels: DataFrame, cited: Citations, k: int = 5) -> DataFrame:
    """First ``k`` benign flagged events by id, with the rules anchored on them."""
    wrong = (_judged(findings, labels, cited).where(F.col("flagged") & ~F.col("malicious")).select("website_id", "event_id")
             .orderBy("event_id", "website_id").limit(k))
    rules = findings.select("website_id", F.col("event_id").cast("string").alias("event_id"), "rule_id")
    return (wrong.join(rules, ["website_id", "event_id"], "left").groupBy("website_id", "event_id")
            .agg(F.sort_array(F.collect_set("rule_id")).alias("rules")).orderBy("event_id", "website_id"))


def session_truth(keyed: DataFrame, labels: DataFrame) -> DataFrame:
    """Label of each session: malicious if any event is; the scenario is that of the deciding event."""
    d = keyed.join(labels, ["website_id", "event_id"])
    first = F.struct((F.col("label") != "malicious").alias("o"), "ts_us", "event_id")
    return (d.groupBy("website_id", "session_key").agg(F.min_by(F.struct("label", "scenario"), first).alias("t"))
            .select("website_id", "session_key", "t.label", "t.scenario"))


def _judged_sessions(flags: DataFrame, truth: DataFrame) -> DataFrame:
    return (truth.join(flags.select("website_id", "session_key", "flagged"), ["website_id", "session_key"])
            .withColumn("malicious", F.col("label") == "malicious"))


def evaluate_sessions(flags: DataFrame, truth: DataFrame) -> DataFrame:
    """Scored sessions against their truth."""
    counts = [F.count(F.lit(1)).alias("sessions_evaluated"), F.count_if("malicious").alias("malicious_sessions"), F.count_if(~F.col("malicious")).alias("benign_sessions")]
    return scores(_judged_sessions(flags, truth).agg(*counts, *confusion()))


def session_scenarios(flags: DataFrame, truth: DataFrame) -> DataFrame:
    """Per scenario with malicious sessions: how many there are and how many are flagged."""
    return (_judged_sessions(flags, truth).where("malicious").groupBy("scenario")
            .agg(F.count(F.lit(1)).alias("sessions"), F.count_if("flagged").alias("flagged")))


def false_positive_sessions(flags: DataFrame, truth: DataFrame, k: int = 5) -> DataFrame:
    """First ``k`` benign sessions that are flagged."""
    return (_judged_sessions(flags, truth).where(F.col("flagged") & ~F.col("malicious")).select("website_id", "session_key", "scenario")
            .orderBy("session_key", "website_id").limit(k))


def missed_sessions(flags: DataFrame, truth: DataFrame) -> DataFrame:
    """Malicious sessions that are not flagged."""
    return _judged_sessions(flags, truth).where(F.col("malicious") & ~F.col("flagged")).select("website_id", "session_key", "scenario")
