"""Conversation history and feedback, for all customers at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarspark.functions.columns import any_holds, clamp, like_pattern, top_n
from bazaarspark.streaming import events as E

ROLES = ("user", "assistant")
KEPT_CHARS, CONTEXT_CHARS, TERM_CHARS = 4000, 2000, 200


def turns_to_messages(turns: DataFrame) -> DataFrame:
    """(customer_id, user_message, assistant_message, ...) as message rows: trimmed, cut, blanks left out. Also on streams."""
    rows = turns.select("*", F.explode(F.array(F.struct(F.lit("user").alias("role"), F.col("user_message").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("assistant_message").alias("content")))).alias("m"))
    text = F.substring(F.trim("m.content"), 1, KEPT_CHARS)
    kept = [c for c in turns.columns if c not in ("user_message", "assistant_message")]
    return rows.select(*kept, F.col("m.role").alias("role"), text.alias("content")).where(F.length("content") > 0)


def short_id(col: Column, maximum: int = 64) -> Column:
    """An identifier cut to its maximum; null if blank or unsafe (see :func:`bazaarspark.streaming.events.short_id`)."""
    return F.nullif(E.short_id(col, maximum), F.lit(""))


def clean_feedback(feedback: DataFrame) -> DataFrame:
    """Feedback rows with clean identifiers and a known rating. Also on streams."""
    return feedback.withColumns({"conversation_id": short_id(F.col("conversation_id")), "message_id": short_id(F.col("message_id"))}).where(F.col("rating").isin("positive", "negative"))


def feedback_counts(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("rating").agg(F.count("*").alias("n"))


def _newest(messages: DataFrame, keys: list[str], limit: int) -> DataFrame:
    return top_n(messages, keys, [F.desc("id")], clamp(limit, 1, 50))


def _usable() -> Column:
    return F.col("role").isin(*ROLES) & (F.length(F.trim(F.coalesce("content", F.lit("")))) > 0)


def recent_messages(messages: DataFrame, limit: int = 10) -> DataFrame:
    """The newest messages of each customer. Other roles and blanks are left out after the limit, not before."""
    return _newest(messages, ["customer_id"], limit).where(_usable()).select("customer_id", "id", "role", "content")


def search_messages(messages: DataFrame, requests: DataFrame, limit: int = 10) -> DataFrame:
    """Requests are (request_id, customer_id, term); a blank term finds nothing."""
    term = F.substring(F.trim("term"), 1, TERM_CHARS)
    asked = requests.withColumn("term", term).where(F.length("term") > 0).withColumn("pattern", like_pattern(F.col("term")))
    found = messages.join(asked, "customer_id").where(any_holds(["content"], "term", "pattern"))
    return _newest(found, ["request_id"], limit).where(_usable()).select("request_id", "customer_id", "id", "role", "content")


def history_context(messages: DataFrame, limit: int = 8) -> DataFrame:
    """One row for each customer: its newest turns, oldest first, as (role, text) with texts cut. At most ``limit`` in a list."""
    rows = _newest(messages, ["customer_id"], limit).where(_usable())
    role = F.when(F.col("role") == "user", "user").otherwise("model")
    turns = F.array_sort(F.collect_list(F.struct("id", role.alias("role"), F.substring(F.trim("content"), 1, CONTEXT_CHARS).alias("text"))))
    return rows.groupBy("customer_id").agg(turns.alias("turns")).select("customer_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n").alias("context"))
