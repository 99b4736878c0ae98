"""Rows of a chat as column expressions: their text and role, numbers within bounds, ids and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import bounded_text, deterministic_id

#: Kinds of hidden rows that are the system's own.
SYSTEM_TYPES = ("help", "welcome", "empty", "generic", "narrator", "comment", "slash_commands", "formatting", "hotkeys", "macros", "welcome_prompt", "assistant_note")


def message_text(content: Column, mes: Column, text: Column) -> Column:
    """A normalised row's content, else the host's text, else the plain one."""
    return F.coalesce(content, mes, text, F.lit(""))


def host_message_text(content: Column, mes: Column, text: Column) -> Column:
    """The host's text first: what another writer left in content is never read before it."""
    return F.coalesce(mes, content, text, F.lit(""))


def message_role(role: Column, is_user: Column, is_system: Column) -> Column:
    """user, assistant or system; a row that says nothing is the system's."""
    user = role.eqNullSafe("user") | is_user.eqNullSafe(True)
    reply = role.eqNullSafe("assistant") | (is_user.eqNullSafe(False) & ~is_system.eqNullSafe(True))
    return F.when(user, "user").when(reply, "assistant").otherwise("system")


def visible_role(role: Column, is_user: Column, is_system: Column) -> Column:
    """As a chat shows it: hidden rows are the system's, others that aren't the user's are replies."""
    return F.when(is_system.eqNullSafe(True) | role.eqNullSafe("system"), "system").when(is_user.eqNullSafe(True) | role.eqNullSafe("user"), "user").otherwise("assistant")


def hidden_role(role: Column, is_user: Column, is_system: Column, kind: Column, marks_system: Column, marks_reply: Column) -> Column:
    """The role of a hidden row by what it carries; of others message_role().

    kind: the row's type. marks_system: it is an interface or tool row. marks_reply: it has an avatar, alternatives, times or a model's name.
    """
    own = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    system = marks_system.eqNullSafe(True) | own.isin(*SYSTEM_TYPES)
    hidden = F.when(system, "system").when(is_user.eqNullSafe(True) | role.eqNullSafe("user"), "user").when(role.eqNullSafe("assistant") | (own == "assistant_message") | marks_reply.eqNullSafe(True), "assistant").otherwise("system")
    return F.when(is_system.eqNullSafe(True), hidden).otherwise(message_role(role, is_user, is_system))


def is_narrator(is_user: Column, is_system: Column, kind: Column) -> Column:
    """A shown row of narration, which neither ends an exchange nor begins one."""
    return ~is_system.eqNullSafe(True) & ~is_user.eqNullSafe(True) & (F.lower(F.trim(F.coalesce(kind, F.lit("")))) == "narrator")


def bounded_int(value: Column, fallback: int, least: int, most: int) -> Column:
    """The whole part of a number within bounds; fallback for what is no number."""
    number = value.try_cast("double")
    whole = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number))
    odd = number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))
    return F.when(odd, F.lit(fallback)).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), whole))).cast("long")


def budget(value: Column, fallback: int, most: int = 2400) -> Column:
    """A number of tokens; fallback for unset, blank and odd values and those under one."""
    number = value.try_cast("double")
    fits = number.isNotNull() & ~F.isnan(number) & (number != float("inf")) & (number >= 1)
    return F.when(fits, F.least(F.lit(most), F.floor(number))).otherwise(F.lit(fallback)).cast("long")


def chat_key(kind: Column, owner: Column, chat: Column) -> Column:
    """kind:owner:chat with escaped parts; empty unless the kind is chat or group and both parts are there."""
    own = [F.trim(F.coalesce(owner.cast("string"), F.lit(""))), F.trim(F.regexp_replace(F.coalesce(chat.cast("string"), F.lit("")), r"(?i)\.jsonl$", ""))]
    parts = [F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")) for x in own]
    return F.when(kind.isin("group", "chat") & (own[0] != "") & (own[1] != ""), F.concat_ws(":", kind, *parts)).otherwise("")


def parsed_chat_key(key: Column) -> Column:
    """(kind, owner, chat), or null for what is no key."""
    part = lambda i: F.regexp_extract(F.coalesce(key, F.lit("")), r"^(chat|group):([^:]+):([\s\S]+)$", i)
    text = lambda i: F.try_url_decode(F.replace(part(i), F.lit("+"), F.lit("%2B")))
    fits = (part(1) != "") & text(2).isNotNull() & text(3).isNotNull() & (text(2) != "") & (text(3) != "")
    return F.when(fits, F.struct(part(1).alias("kind"), text(2).alias("owner"), text(3).alias("chat")))


def record_id(chat: Column, message: Column, lineage: Column, ordinal: Column) -> Column:
    return deterministic_id("wsr", chat, message, lineage, ordinal)


def evidence_id(chat: Column, record: Column, message: Column, lineage: Column, ordinal: Column, claim: Column, claim_chars: int = 500) -> Column:
    return deterministic_id("wse", chat, record, message, lineage, ordinal, bounded_text(claim, claim_chars))


def link_id(chat: Column, from_: Column, to: Column, kind: Column, message: Column, lineage: Column) -> Column:
    return deterministic_id("wsl", chat, from_, to, kind, message, lineage)


def rebuild_start(operation: Column) -> Column:
    """The first message of a rebuild, from its operation's id."""
    return F.regexp_extract(F.coalesce(operation, F.lit("")), r"^rebuild:\d+:\d+:(\d+)(?::|$)", 1).try_cast("long")


def earliest_partial_start(floor: Column) -> Column:
    return F.greatest(F.lit(1), F.coalesce(floor, F.lit(-1)) + 1)
