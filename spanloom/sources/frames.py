"""Framed event streams and tolerant JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FRAME = "choices array<struct<delta: struct<content: string, reasoning_content: string>>>, usage struct<total_tokens: bigint>"


def fold(lines: DataFrame) -> DataFrame:
    """(call_id, content, total_tokens) of lines (call_id, seq, line) in the order of seq.

    Only `data:` lines before `[DONE]` count; malformed frames are skipped, reasoning deltas dropped, the last usage
    wins. The frames of one call are one call's answer and bounded by it.
    """
    data = lines.filter(F.col("line").startswith("data:")).withColumn("payload", F.trim(F.substring("line", 6, 1 << 30)))
    done = data.filter("payload = '[DONE]'").groupBy("call_id").agg(F.min("seq").alias("stop"))
    live = data.join(done, "call_id", "left").filter(F.col("stop").isNull() | (F.col("seq") < F.col("stop"))).filter("payload <> '[DONE]'")
    parsed = live.withColumn("f", F.from_json("payload", FRAME)).filter("f is not null")
    piece = F.coalesce(F.get(F.col("f.choices"), F.lit(0))["delta"]["content"], F.lit(""))
    used = F.col("f.usage.total_tokens")
    ordered = F.array_sort(F.collect_list(F.struct("seq", piece.alias("piece"))))
    content = F.array_join(F.transform(ordered, lambda p: p["piece"]), "")
    return parsed.groupBy("call_id").agg(content.alias("content"), F.max_by(used, F.when(used.isNotNull(), F.col("seq"))).alias("total_tokens"))


def json_object(text: Column) -> Column:
    """The JSON object in a text, as text: without code fences, else between the outermost braces; null if none parses."""
    bare = F.trim(F.regexp_replace(text, r"^\s*```[a-zA-Z]*\s*|\s*```\s*\z", ""))
    braces = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    whole = F.when(bare.startswith("{") & F.get_json_object(bare, "$").isNotNull(), bare)
    return F.coalesce(whole, F.when((braces != "") & F.get_json_object(braces, "$").isNotNull(), braces))
