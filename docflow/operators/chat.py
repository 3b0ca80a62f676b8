"""Chat tables (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.ranking import bucketed_lead
from ..functions.text import not_blank, strip


def _bucket(turns_per_part):
    return F.floor(F.col("turn") / turns_per_part).cast("bigint")


def chat_histories(turns: DataFrame, turns_per_part: int) -> DataFrame:
    """Ordered (role, content) array per conversation, blank turns left out.

    Arrays hold the range of turns that the caller gives; a longer conversation continues in the
    next ``part_no``.
    """
    item = F.struct("turn", "role", F.col("text").alias("content"))
    parts = (
        turns.where(not_blank("text"))
        .groupBy("conv_id", _bucket(turns_per_part).alias("part_no"))
        .agg(F.array_sort(F.collect_list(item)).alias("_m"))
    )
    bare = F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return parts.select("conv_id", "part_no", bare.alias("messages"), F.size("_m").alias("message_count"))


def pair_turns(turns: DataFrame, turns_per_task=1000) -> DataFrame:
    """(user, assistant) pairs: each user turn with the answer right after it, empty if none.

    ``turns_per_task`` spreads a long conversation over tasks and does not change the result.
    """
    kept = turns.where(not_blank("text") & F.col("role").isin("user", "assistant")).select("conv_id", "turn", "role", "text")
    led = bucketed_lead(kept, ["conv_id"], _bucket(turns_per_task), "turn", ["role", "text"])
    answer = F.when(F.col("next_role") == "assistant", F.col("next_text")).otherwise(F.lit(""))
    return led.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("user"), answer.alias("assistant"))


def effective_system_prompt(requests: DataFrame, modes: DataFrame) -> DataFrame:
    """Adds ``system_prompt`` (trimmed custom prompt, else that of the usage mode, else the
    general one) and ``question`` (the message, or a default when it is empty).

    ``modes`` is the five-row table of usage modes.
    """
    joined = requests.join(modes, "usage_mode", "left")
    general = F.lit(dims.CHAT_MODES[dims.DEFAULT_MODE])
    custom = F.nullif(strip("custom_system_prompt"), F.lit(""))
    return joined.select(
        *requests.columns, F.coalesce(custom, "mode_prompt", general).alias("system_prompt"),
        F.coalesce(F.nullif("message", F.lit("")), F.lit(dims.DEFAULT_QUESTION)).alias("question"),
    )
