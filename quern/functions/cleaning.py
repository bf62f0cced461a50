"""Text cleaning as column expressions. Each takes and gives a text column; nulls stay null.

Patterns are written for Java's and RE2's common syntax. Where a step needs what regular expressions can't do
(Unicode composition, HTML entities) it is an Arrow-batched function in ``quern.functions.arrow``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is dropped, stripped or replaced.
LOCK_MARKS = r'integrity sha\d+-|resolved "https://registry\.|"lockfileVersion"|BUNDLED WITH|"_resolved":\s*"https://'
GENERATED_LINE = r"(?im)^[ \t]*(?:#|//|/\*|\*)[^\n]*(?:DO NOT EDIT|auto.?generated|Generated by|THIS FILE IS GENERATED|Code generated|MACHINE GENERATED|Automatically generated by)"
WARNING_LINE = r"(?im)^[ \t]*(?:#|//|\*)[^\n]*(?:DO NOT EDIT|auto.?generated|Generated by|THIS FILE IS GENERATED)[^\n]*\n?"
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{80}-\x{9F}]"
INVISIBLE = r"[\x{200B}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}\x{FFF9}-\x{FFFD}]"
PRIVATE = r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]"
STRIPPED = f"(?:{CONTROLS}|{INVISIBLE}|{PRIVATE})"
GHOST_TAGS = (
    r"(?i)(?:\s*</?(?:USER|ASSISTANT|SYSTEM|HUMAN|BOT|GPT)>\s*|\s*\[(?:USER|ASSISTANT|SYSTEM|HUMAN|BOT|INST|/INST)\]\s*"
    r"|\s*###\s*(?:Instruction|Response|Topic|Question|Answer|Context|Input|Output)\s*:\s*"
    r"|<\|(?:endoftext|im_start|im_end|pad|unk|bos|eos|sep|cls|mask)\|>|</?s>|\[/?INST\]|\[/?SYS\]|<\|(?:system|user|assistant|end)\|>"
    r"|(?:^|\n)\s*(?:Human|Assistant)\s*:\s*|<\|(?:begin_of_text|end_of_turn|start_header_id|end_header_id)\|>)"
)
MOJIBAKE = "(?:Ã[©ª¨¦¤£¢¡ ]|â€[™\"„œ•–—]|Â[·°±²³µ¹º»¼½¾])"
LICENSE = r"(?i)\A\s*(?:#|//|/\*|\*/?|<!--|;|%)[^\n]*(?:SPDX-|Copyright|\(c\)|©|Licensed under|Permission is hereby|Redistribution and use|All rights reserved)"
LEADING_COMMENTS = r"\A(?:[ \t]*(?:(?:#|//|/\*|\*|<!--|;|%)[^\n]*)?(?:\n|\z))*"
REFERENCES = r"\n\n\s*(?:References|Bibliography|Works Cited|REFERENCES|BIBLIOGRAPHY|Bibliographie|संदर्भ|参考文献)\s*\n"
CITATION = r"\[\d{1,3}\]"
LONG_LINE, LEAST_BREAKS, LOCK_HITS, HEAD, MARK_HEAD = 500, 0.005, 3, 5000, 2000
SPACES = " \t\n\r\f\x0b"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def is_minified(text: Column) -> Column:
    """One very long line, or few breaks and a very long line."""
    breaks = F.length(text) - F.length(F.translate(text, "\n", ""))
    longest = F.array_max(F.transform(F.split(text, "\n"), F.length))
    return (F.length(text) > LONG_LINE) & ((breaks == 0) | ((longest > LONG_LINE) & (breaks / F.length(text) < LEAST_BREAKS)))


def drop_reason(text: Column) -> Column:
    """Why a document is left out before it is cleaned; empty to keep it. The cheapest test comes first."""
    locked = F.regexp_count(F.substring(text, 1, HEAD), F.lit(LOCK_MARKS)) >= LOCK_HITS
    generated = F.substring(text, 1, MARK_HEAD).rlike(GENERATED_LINE)
    return F.when(is_minified(text), "minified").when(locked, "lockfile").when(generated, "autogenerated").otherwise("")


def without_controls(text: Column) -> Column:
    return F.regexp_replace(text, STRIPPED, "")


def plain_spaces(text: Column) -> Column:
    return F.translate(text, "\u00a0", " ")


def without_ghost_tags(text: Column) -> Column:
    return F.regexp_replace(text, GHOST_TAGS, " ")


def without_license(text: Column) -> Column:
    """Leading comment and blank lines go, if the first line with content is a comment about a license."""
    return F.when(text.rlike(LICENSE), F.regexp_replace(text, LEADING_COMMENTS, "")).otherwise(text)


def without_warnings(text: Column) -> Column:
    return F.regexp_replace(text, WARNING_LINE, "")


def whitespace(text: Column) -> Column:
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[ \t\f\x0B]+", " ")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def without_references(text: Column) -> Column:
    """The text before its first heading of references."""
    return F.rtrim(F.split(text, REFERENCES, 2)[0], F.lit(SPACES))


def without_citations(text: Column) -> Column:
    plain = F.regexp_replace(text, CITATION, "")
    return F.when(plain == text, text).otherwise(strip(F.regexp_replace(plain, r"[ \t]+", " ")))


def mojibake_ratio(text: Column) -> Column:
    return F.when(F.length(text) > 0, (F.length(text) - F.length(F.regexp_replace(text, MOJIBAKE, ""))) / F.length(text)).otherwise(0.0)


def clean(text: Column) -> Column:
    """All steps in order."""
    for step in (plain_spaces, without_controls, without_ghost_tags, without_license, without_warnings, whitespace, without_references, without_citations):
        text = step(text)
    return text


def is_valid(text: Column, least_characters: int = 20, least_letters: float = 0.35, least_words: int = 5, head_length: int | None = None) -> Column:
    """Long enough, with enough letters and digits (``head_length``: in so many characters at its beginning) and enough different words."""
    head = F.substring(text, 1, head_length) if head_length else text
    letters = F.length(head) - F.length(F.regexp_replace(head, r"[\p{L}\p{N}]", ""))
    words = F.size(F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: w != "")))
    return (F.length(text) >= least_characters) & (letters / F.length(head) >= least_letters) & (words >= least_words)


def normal(text: Column) -> Column:
    """Lower case with single spaces, for matching."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


LATEX = ((r"(?s)\\begin\{(thebibliography|figure|table)\*?\}.*?\\end\{\1\*?\}", " "), (r"\\(?:cite|ref|label|eqref)[a-z]*\*?(?:\[[^\]]*\])?\{[^}]*\}", " "), (r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?", " "), (r"\s+", " "))


def without_latex(text: Column) -> Column:
    """Bibliographies, floats, references and commands of LaTeX sources removed."""
    for pattern, by in LATEX:
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)
