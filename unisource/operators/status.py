"""Connection tests: success by status code, and the latest state of each source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: source kind -> (first failing status code, message of a success) ----
SUCCESS_RULES = {
    "rest": (500, "HTTP %d"),
    "odata": (500, "HTTP %d"),
    "graphql": (500, "HTTP %d"),
    "soap": (500, "HTTP %d"),
    "sap_odata": (500, "SAP OData HTTP %d"),
    "sage_x3": (500, "SAGE X3 HTTP %d"),
    "dynamics365": (400, "Dynamics 365 HTTP %d"),
    "sage_cloud": (400, "SAGE Cloud HTTP %d"),
    "file": (400, "Fichier accessible (HTTP %d)"),
}
STRICT_STATUS = 200
# Kinds tested by a call that has no status code: an explicit flag says whether it went through.
FLAGGED = ("postgresql", "mysql", "mssql", "sqlite", "sap_hana", "sage_100", "sap_rfc")


def succeeded(kind: Column, status: Column, variant: str = "live") -> Column:
    """Whether a status code counts as success for a kind of source; no answer never does."""
    limits = F.create_map(*[F.lit(x) for k, (limit, _) in SUCCESS_RULES.items() for x in (k, limit)])
    by_limit = status < F.try_element_at(limits, kind)
    if variant == "lib":
        by_limit = F.when(kind == "odata", status == STRICT_STATUS).otherwise(by_limit)
    return F.coalesce(by_limit, F.lit(False))


def status_rules(answers: DataFrame, variant: str = "live") -> DataFrame:
    """Test rows (`source_id`, `kind`, `status`, `latency_ms`, `tested_at`) with verdict and message.

    Databases and remote function calls answer without a status code: where the rows have the columns `reached` (whether
    the call went through) and `detail` (its text), these decide for such kinds. Without them such a test never succeeds.
    """
    messages = F.create_map(*[F.lit(x) for k, (_, message) in SUCCESS_RULES.items() for x in (k, message)])
    flagged = F.col("kind").isin(*FLAGGED)
    reached = F.coalesce(F.col("reached"), F.lit(False)) if "reached" in answers.columns else F.lit(False)
    detail = F.col("detail") if "detail" in answers.columns else F.lit(None).cast("string")
    ok = F.when(flagged, reached).otherwise(succeeded(F.col("kind"), F.col("status"), variant))
    message = F.when(F.col("success"), F.try_element_at(messages, F.col("kind"))).otherwise("HTTP %d")
    spoken = F.coalesce(detail, F.when(F.col("success"), "connected").otherwise("no answer"))
    return answers.withColumn("success", F.coalesce(ok, F.lit(False))).withColumn(
        "message",
        F.when(flagged, spoken).when(F.col("status").isNull(), "no answer").otherwise(
            F.replace(message, F.lit("%d"), F.col("status").cast("string"))
        ),
    )


def latest_status(tests: DataFrame) -> DataFrame:
    """State after each source's last test; the id orders tests of one instant.

    A maximum per source: each task keeps one row a source, however many tests it logged.
    """
    last = F.max_by(F.struct("success", "latency_ms", "message"), F.struct("tested_at", "id"))
    return (
        tests.groupBy("source_id")
        .agg(last.alias("_last"), F.max("tested_at").alias("last_tested_at"))
        .select(
            "source_id",
            F.when(F.col("_last.success"), "active").otherwise("error").alias("status"),
            F.when(F.col("_last.success"), F.col("_last.latency_ms")).alias("test_latency_ms"),
            F.when(~F.col("_last.success"), F.col("_last.message")).alias("error_message"),
            "last_tested_at",
        )
    )
