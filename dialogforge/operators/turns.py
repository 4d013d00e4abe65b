"""Turns and messages of dialogues, flat (one row per message) and nested (an array of turns).

Flat messages may be delivered repeatedly; ``delivered_once`` keeps one row of each. Null dialogue ids form no dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogforge.functions.text import norm_text
from dialogforge.operators.running import before

#: What the last request of a dialogue asks for besides its prompt.
FINAL_PROMPT = "\n\nGive the final state of the code and a summary of what it does."


def role_of(role: Column) -> Column:
    """user, assistant or system for the spellings in use; other roles in lower case."""
    low = F.lower(F.trim(role))
    return F.when(low == "human", "user").when(low == "model", "assistant").otherwise(low)


def provider_role(role: Column) -> Column:
    """Roles as the provider wants them whose word for assistant is model."""
    return F.when(role == "assistant", "model").otherwise(role)


def delivered_once(messages: DataFrame, *columns: str) -> DataFrame:
    """The named columns of each message, once; the deliveries of a message are alike in them."""
    return messages.filter("dialogue_id is not null and msg_id is not null").select(*columns).distinct()


#: Messages of a dialogue that are ordered in one place; longer dialogues are cut by message index.
CHUNK = 10_000


def _place(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_chunk", F.floor(F.coalesce("msg_index", F.lit(-1)) / CHUNK))


def rewrap(messages: DataFrame) -> DataFrame:
    """``dialogue_id, msg_id, msg_index, role, turn_group``: a user message opens a new group, unless it is the first message."""
    once = delivered_once(messages.withColumn("role", role_of(F.col("role"))), "dialogue_id", "msg_id", "msg_index", "role")
    user = F.coalesce(F.col("role") == "user", F.lit(False)).cast("int")
    counted = before(_place(once), ["dialogue_id"], ["_chunk"], ["msg_index", "msg_id"], {"_earlier": F.lit(1), "_users": user})
    first_is_user = F.max(F.when(F.col("_earlier") == 0, user))
    firsts = counted.groupBy("dialogue_id").agg(first_is_user.alias("_first_user"))
    # A user message opens a group; the first message is in group 1, whoever wrote it.
    return counted.join(firsts, "dialogue_id").select("dialogue_id", "msg_id", "msg_index", "role", (F.lit(1) + F.col("_users") + user - F.col("_first_user")).alias("turn_group"))


def wrapped(messages: DataFrame) -> DataFrame:
    """``dialogue_id, turns``: the flat messages of each dialogue as nested turns, in order; turn_id is the group's number.

    A dialogue becomes one record, as the nested layout has it.
    """
    said = delivered_once(messages.withColumn("role", role_of(F.col("role"))), "dialogue_id", "msg_id", "content", "code_snippet")
    placed = rewrap(messages).join(said, ["dialogue_id", "msg_id"])
    message = F.struct("msg_index", "msg_id", "role", "content", "code_snippet")
    groups = placed.groupBy("dialogue_id", F.col("turn_group").cast("int").alias("turn_id")).agg(F.transform(F.sort_array(F.collect_list(message)), lambda m: m.dropFields("msg_index", "msg_id")).alias("messages"))
    return groups.groupBy("dialogue_id").agg(F.sort_array(F.collect_list(F.struct("turn_id", "messages"))).alias("turns"))


def replace_turns(detailed: DataFrame, simple: DataFrame) -> DataFrame:
    """The records of ``detailed`` that ``simple`` (``dialogue_id, turns``) knows, with its turns in the place of their own."""
    return detailed.drop("turns").join(simple, "dialogue_id")


def prefixes(messages: DataFrame) -> DataFrame:
    """Per message what stands before it in its dialogue: messages, user messages and characters (the history a request carries)."""
    once = delivered_once(messages.withColumn("role", role_of(F.col("role"))).withColumn("chars", F.coalesce(F.length("content"), F.lit(0))), "dialogue_id", "msg_id", "msg_index", "role", "chars")
    user = F.coalesce(F.col("role") == "user", F.lit(False)).cast("int")
    counted = before(_place(once), ["dialogue_id"], ["_chunk"], ["msg_index", "msg_id"], {"prior_messages": F.lit(1), "prior_users": user, "prior_chars": F.col("chars")})
    return counted.select("dialogue_id", "msg_id", "prior_messages", "prior_users", "prior_chars")


def prompt_of(content: Column, code: Column, contains_code: Column) -> Column:
    """A user message as it is sent: its code below its text where it has some."""
    return F.concat(F.coalesce(content, F.lit("")), F.lit("\n"), F.when(contains_code, F.coalesce(code, F.lit(""))).otherwise(F.lit("")))


def requests(messages: DataFrame, final_prompt: str = FINAL_PROMPT) -> DataFrame:
    """``dialogue_id, msg_id, turn_index, is_final, prompt`` of every user message; the last of a dialogue gets the final prompt."""
    users = messages.filter(role_of(F.col("role")) == "user")
    once = delivered_once(users, "dialogue_id", "msg_id", "msg_index", "content", "code_snippet", "contains_code")
    counted = before(_place(once), ["dialogue_id"], ["_chunk"], ["msg_index", "msg_id"], {"_turn": F.lit(1)})
    # Ids name messages: the last of a dialogue is found by a combined aggregation, not by ordering it.
    last = users.filter("dialogue_id is not null and msg_id is not null").groupBy("dialogue_id").agg(F.max(F.struct("msg_index", "msg_id")).alias("_last"))
    placed = counted.join(last, "dialogue_id").withColumn("turn_index", F.col("_turn").cast("int")).withColumn("is_final", F.struct("msg_index", "msg_id") == F.col("_last"))
    prompt = prompt_of(F.col("content"), F.col("code_snippet"), F.col("contains_code"))
    return placed.select("dialogue_id", "msg_id", "turn_index", "is_final", F.concat(prompt, F.when(F.col("is_final"), F.lit(final_prompt)).otherwise(F.lit(""))).alias("prompt"))


def request_body(system: str, history: Column, prompt: Column, dup_prompt: bool = False) -> Column:
    """The messages of a request: system, history, prompt. ``dup_prompt`` keeps a history that already ends in the prompt as it is and adds the prompt again."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    last = F.try_element_at(history, F.lit(-1))
    repeated = (last["role"] == "user") & (last["content"] == prompt)
    kept = history if dup_prompt else F.when(F.coalesce(repeated, F.lit(False)), F.slice(history, 1, F.size(history) - 1)).otherwise(history)
    return F.concat(F.array(message("system", F.lit(system))), kept, F.array(message("user", prompt)))


# Nested dialogues.


def last_turn(turns: Column) -> Column:
    return F.try_element_at(turns, F.lit(-1))


def final_assistant(turns: Column) -> Column:
    """Content of the last assistant message of the last turn; earlier turns are not looked at."""
    spoken = F.filter(last_turn(turns)["messages"], lambda m: m["role"] == "assistant")
    return F.try_element_at(spoken, F.lit(-1))["content"]


def final_code(turns: Column) -> Column:
    """Code of the last message of the last turn, whoever wrote it."""
    return F.try_element_at(last_turn(turns)["messages"], F.lit(-1))["code_snippet"]


def opening_key(turns: Column) -> Column:
    """The normalised opening: the first turn's first user message with its code, else its first message; "" without any."""
    messages = F.try_element_at(turns, F.lit(1))["messages"]
    user = F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(1))
    first = F.coalesce(user, F.try_element_at(messages, F.lit(1)))
    code = F.when(user.isNotNull() & (F.coalesce(user["code_snippet"], F.lit("")) != ""), F.concat(F.lit(" "), user["code_snippet"])).otherwise(F.lit(""))
    return norm_text(F.concat(F.coalesce(first["content"], F.lit("")), code))


def expected_text(ground_truth: Column) -> Column:
    """The expected answer, null where it is blank."""
    text = ground_truth["expected_nl_output"]
    return F.when(F.trim(text) != "", text)
