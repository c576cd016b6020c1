"""Scalar text functions as column expressions; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\x1c-\x1f]"


def strip_ws(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, rf"(?U)^{_SPACE}+|{_SPACE}+\z", "")


def normalize_role(c: Column) -> Column:
    """developer is system, model is assistant; any other role is itself."""
    return F.when(c == "developer", F.lit("system")).when(c == "model", F.lit("assistant")).otherwise(c)


def split_thinking(c: Column) -> Column:
    """STRUCT<content, reasoning>: inline <think> and <thinking> blocks moved out; reasoning is null without a block."""
    block = r"(?s)<(think|thinking)>(.*?)</\1>"
    found = F.filter(F.transform(F.regexp_extract_all(c, F.lit(block), F.lit(2)), strip_ws), lambda x: x != "")
    content = F.when(c.rlike(block), strip_ws(F.regexp_replace(c, block, ""))).otherwise(c)
    return F.struct(content.alias("content"), F.when(F.size(found) > 0, F.array_join(found, "\n\n")).alias("reasoning"))


def first_text_block(blocks: Column) -> Column:
    """Text of ARRAY<STRUCT<type, text>>: its text blocks one a line."""
    texts = F.transform(F.filter(blocks, lambda b: b["type"].isin("text", "input_text", "output_text") & b["text"].isNotNull()), lambda b: b["text"])
    return strip_ws(unwrap_prompt_file(F.array_join(texts, "\n")))


def unwrap_prompt_file(c: Column) -> Column:
    """The body of a prompt that is nothing but one wrapped prompt file."""
    whole = r'(?s)\A\s*<file name="[^"]*-prompt\.txt">\n?(.*?)\n?</file>\s*\z'
    return F.when(c.rlike(whole), F.regexp_extract(c, whole, 1)).otherwise(c)


def prompt_key(c: Column) -> Column:
    """Lines of a prompt joined by line feeds, whatever their ends were, without outer space."""
    return strip_ws(F.regexp_replace(F.regexp_replace(unwrap_prompt_file(c), "\r\n", "\n"), r"[\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]", "\n"))


def completion_key(system: Column, prompt: Column, follow_ups: Column) -> Column:
    """The key that tells prompts apart: system text and all turns."""
    return F.concat_ws("\n\n", F.nullif(strip_ws(system), F.lit("")), resume_key(prompt, follow_ups))


def resume_key(prompt: Column, follow_ups: Column) -> Column:
    """All turns; the system text does not count."""
    turns = F.concat(F.array(prompt_key(prompt)), F.transform(F.coalesce(follow_ups, F.array().cast("array<string>")), prompt_key))
    return F.array_join(turns, " --- follow-up --- ")


def epoch_iso(seconds_or_millis: Column) -> Column:
    """ISO 8601 with Z of an epoch in seconds or milliseconds; null outside years 1 to 9999."""
    n = seconds_or_millis.cast("double")
    micros = F.round(F.when(F.abs(n) > 1e10, n * 1e3).otherwise(n * 1e6)).try_cast("bigint")
    return micros_iso(F.when(micros.between(-62135596800000000, 253402300799999999), micros))


def micros_iso(micros: Column) -> Column:
    at = F.timestamp_micros(micros)
    local = F.to_utc_timestamp(at, F.current_timezone())
    whole = F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.pmod(micros, F.lit(1_000_000))
    return F.when(part == 0, F.concat(whole, F.lit("Z"))).otherwise(F.concat(whole, F.lit("."), F.lpad(part.cast("string"), 6, "0"), F.lit("Z")))


def clip(c: Column, limit: int) -> Column:
    """At most ``limit`` characters, and how many more there were."""
    more = F.length(c) - limit
    return F.when(more > 0, F.concat(F.substring(c, 1, limit), F.lit("\n[+"), more.cast("string"), F.lit(" characters]"))).otherwise(c)


def safe_stem(c: Column, fallback: str, limit: int = 96) -> Column:
    """A file stem of letters, digits, dot, underscore and dash."""
    made = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9._-]+", "-"), "-{2,}", "-"), r"^[-.]+|[-.]+\z", "")
    made = F.regexp_replace(F.substring(made, 1, limit), r"[-.]+\z", "")
    return F.when(made == "", F.lit(fallback)).otherwise(made)


def model_text(c: Column) -> Column:
    """Lower-case letters and digits of a model's name."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def escape_line_breaks(c: Column) -> Column:
    """JSON text without the breaks that line readers beyond JSON know."""
    out = c
    for code in (0x85, 0x2028, 0x2029):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return out


def visible_controls(c: Column) -> Column:
    """Control characters but tab and line feed as visible pictures."""
    codes = [i for i in range(32) if i not in (9, 10)]
    return F.translate(c, "".join(map(chr, codes)), "".join(chr(0x2400 + i) for i in codes))
