"""Guidance by category, in our own words; joined to findings as a small table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Category, what it means, what to look at, what may come next.
KNOWLEDGE = (
    ("oom_killed", "Killed for using more memory than its limit.", "Compare usage with the limit over time.", "Raise the limit or lower the load once a leak is ruled out."),
    ("crash_loop", "The container does not stay up.", "Read the previous container's log and recent warnings.", "Find the first error; the loop itself names no fix."),
    ("readiness_liveness_failure", "A probe fails.", "Compare probe settings with real start and answer times.", "Check that the probe is realistic."),
    ("scheduling_failure", "No node could take the pod.", "Compare requests with node capacity.", "Change capacity or requests."),
    ("http_5xx", "Server errors were answered.", "Look for exceptions and timeouts in the same minutes.", "Find the call that failed."),
    ("http_4xx", "Client errors were answered.", "Look at callers, paths and rights.", "Find whether the caller or the configuration changed."),
    ("connection_failure", "A peer could not be reached.", "Check the peer's state, name and port.", "Restore the peer or the route."),
    ("timeout", "A call took too long.", "Look at the called side's load.", "Find the slow side before limits are raised."),
    ("authentication_failure", "Credentials or rights were refused.", "Check which account was used and when it changed.", "Correct the account or its rights."),
    ("upstream_downstream_failure", "A neighbouring tier failed.", "Follow the call to the tier named.", "Treat that tier first."),
    ("database_error", "The database refused or lost work.", "Check pool, locks and the statement.", "Treat the cause that the code names."),
    ("redis_error", "The cache store failed.", "Check its memory, rights and links.", "Restore the store."),
    ("search_error", "The search tier failed.", "Check its nodes and indexes.", "Restore the tier."),
    ("exception", "Application code failed.", "Read the class and its first frame.", "Assign it to the code's owner."),
    ("jvm_application_error", "The virtual machine failed badly.", "Check heap and class path.", "Treat memory or packaging."),
    ("stack_trace", "Frames of a failure.", "Find the line before the frames.", "Use that line's category."),
    ("generic_error", "An error without a known form.", "Read the samples.", "Add a rule if it comes again."),
)


def knowledge_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWLEDGE, "category string, guidance string, investigation string, next_step string")


def attach_knowledge(rows: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Guidance by category; ``unclassified`` has none."""
    return rows.join(F.broadcast(knowledge.where("category <> 'unclassified'")), "category", "left")  # one row for each rule
