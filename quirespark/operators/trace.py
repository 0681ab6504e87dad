"""Flat logs of conversations with tool calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten_trace(messages: DataFrame) -> DataFrame:
    """A row an event of messages (conv_id, idx, type, content, tool_calls array of (name, args, id), tool_call_id, status).

    type human: human_message; ai without calls: ai_thought; ai with calls: a tool_call each, with the
    output and status of the last tool message that answers it (null without one); tool: tool_result,
    without its content. Other types are left out. Order: conv_id, idx, call_ord.
    """
    m = messages
    answered = m.where((F.col("type") == "tool") & F.col("tool_call_id").isNotNull()).groupBy("conv_id", "tool_call_id").agg(F.max_by(F.struct(F.col("content").alias("output"), "status"), "idx").alias("r"))
    some = F.coalesce(F.size("tool_calls"), F.lit(0)) > 0
    calls = m.where((F.col("type") == "ai") & some).select("conv_id", "idx", F.col("content").alias("ai_content"), F.posexplode("tool_calls").alias("call_ord", "c"))
    calls = calls.select("conv_id", "idx", "call_ord", "ai_content", F.col("c.name").alias("tool_name"), F.col("c.args").alias("args"), F.col("c.id").alias("tool_call_id"))
    calls = calls.join(answered, ["conv_id", "tool_call_id"], "left").select("conv_id", F.lit("tool_call").alias("type"), "idx", "call_ord", "tool_call_id", "tool_name", "args", "ai_content", "r.output", "r.status")
    kind = F.when(F.col("type") == "human", "human_message").when((F.col("type") == "ai") & ~some, "ai_thought").when(F.col("type") == "tool", "tool_result")
    rest = m.withColumn("kind", kind).where(F.col("kind").isNotNull())
    tool = F.col("type") == "tool"
    rest = rest.select("conv_id", F.col("kind").alias("type"), "idx", F.lit(0).alias("call_ord"), F.when(tool, F.col("tool_call_id")).alias("tool_call_id"), F.when(~tool, F.col("content")).alias("content"), F.when(tool, F.col("status")).alias("status"))
    return rest.unionByName(calls, allowMissingColumns=True)


def as_json(log: DataFrame) -> DataFrame:
    """(conv_id, idx, call_ord, json): each event of a flat log as JSON text, nulls too."""
    return log.select("conv_id", "idx", "call_ord", F.to_json(F.struct(*log.columns), {"ignoreNullFields": "false"}).alias("json"))
