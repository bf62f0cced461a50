"""Texts put together from fields and messages, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Headings, field names and role marks of the written formats.
SECTIONS = ("Explanation", "Question", "Answer")
DETAILS = (("Difficulty", ""), ("Student Level", ""), ("Subject", ""), ("Grade", ""), ("Estimated Time", " minutes"), ("Prerequisites", ""))
METADATA = ("subject", "grade", "topic", "difficulty", "student_level", "question_type", "question_complexity", "estimated_time", "prerequisites")
USER_ROLES = ("user", "human")


def filled(value: Column) -> Column:
    """The value, null where it is empty, so that concat_ws leaves it out."""
    return F.when(value != "", value)


def conversation(messages: Column) -> Column:
    """``[USER] x`` and ``[ASSISTANT] x`` for the turns with content, a blank line between them; null where nothing is left.
    messages: array of (role, content)."""
    said = F.filter(messages, lambda m: F.trim(F.coalesce(m["content"], F.lit(""))) != "")
    mark = lambda m: F.when(F.lower(m["role"]).isin(*USER_ROLES), "[USER] ").otherwise("[ASSISTANT] ")
    return filled(F.array_join(F.transform(said, lambda m: F.concat(mark(m), F.trim(m["content"]))), "\n\n"))


def role_blocks(messages: Column) -> Column:
    """Each turn between marks of its role, on lines of their own."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<"), F.upper(m["role"]), F.lit(">\n"), m["content"], F.lit("\n</"), F.upper(m["role"]), F.lit(">"))), "\n")


def lesson(fields: dict[str, Column]) -> Column:
    """A lesson with the sections that have text, in order, and the details that are known."""
    none = F.lit(None).cast("string")
    parts = [F.concat(F.lit("### Topic: "), filled(fields.get("Topic", none)))]
    parts += [F.concat(F.lit(f"\n### {s}:\n"), filled(fields.get(s, none))) for s in SECTIONS]
    details = F.concat_ws("  \n", *(F.concat(F.lit(f"{d}: "), filled(fields.get(d, none)), F.lit(unit)) for d, unit in DETAILS))
    parts.append(F.concat(F.lit("\n### Metadata:\n"), filled(details)))
    return F.concat_ws("\n", *parts)


def lesson_metadata(fields: dict[str, Column]) -> Column:
    """The ten known keys as JSON; what is missing is an empty string."""
    values = [F.coalesce(fields[k], F.lit("")).alias(k) if k in fields else F.lit("").alias(k) for k in METADATA]
    return F.to_json(F.struct(*values, F.lit("textbook").alias("source_type")))


def instruction(question: Column, reasoning: Column, answer: Column) -> Column:
    """Instruction, reasoning if there is any, and reference answer."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    why = F.when(text(reasoning) != "", F.concat(F.lit("### Reasoning:\n"), text(reasoning), F.lit("\n\n"))).otherwise("")
    return F.trim(F.concat(F.lit("### Instruction:\n"), text(question), F.lit("\n\n"), why, F.lit("### Reference Answer:\n"), text(answer)))


def messages_of(text: Column) -> Column:
    """The marked turns of a text as (role, content)."""
    turns = F.regexp_extract_all(text, F.lit(r"(?s)\[(?:USER|ASSISTANT)\] .*?(?=\n\n\[(?:USER|ASSISTANT)\] |\z)"), F.lit(0))
    return F.transform(turns, lambda t: F.struct(F.when(t.startswith("[USER] "), "user").otherwise("assistant").alias("role"), F.regexp_replace(t, r"^\[(USER|ASSISTANT)\] ", "").alias("content")))
