"""Identity and secret scrubbing. Replacements of secrets come from their own hash; people are numbered within a text."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..batches import frames
from ..functions.scrub import Scrubber
from ..functions.values import compact

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
RESERVED = ("example.com", "example.net", "example.org")
HOME = r"(?<![\w])(/home/|/Users/|[A-Za-z]:\\Users\\)([A-Za-z0-9._-]+)"
SECRETS = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", r"\bsk-[A-Za-z0-9_-]{16,}", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    r"\bgh[pousr]_[A-Za-z0-9]{20,}", r"\bgithub_pat_[A-Za-z0-9_]{20,}", r"\bglpat-[A-Za-z0-9_-]{16,}", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", r"\bhf_[A-Za-z0-9]{20,}",
    r"\bAIza[0-9A-Za-z_-]{35}", r"\bnpm_[A-Za-z0-9]{30,}", r"\bpypi-[A-Za-z0-9_-]{20,}", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
)
BEARER = r"(?i)\b(bearer\s+)([A-Za-z0-9._~+/-]{16,}=*)"
URL_PASSWORD = r"\b([a-z][a-z0-9+.-]*://[^\s:/@]+:)([^\s@/]{3,})(@)"
ASSIGNED = r"(?i)\b((?:[A-Za-z0-9]+[_-])*(?:api[_-]?key|secret|password|passwd|private[_-]?key|access[_-]?key|auth[_-]?token)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)(?!\[REDACTED)([^\s\"',;]{8,})"


def emails(text: Column) -> Column:
    """Addresses in lower case in order, but those of reserved domains."""
    found = F.transform(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), F.lower)
    return F.filter(found, lambda e: ~F.substring_index(e, "@", -1).isin(*RESERVED) & ~e.endswith(".example"))


def replace_emails(text: Column) -> Column:
    """Each address numbered by first appearance in its text; longer addresses first, so that none is cut by another."""
    known = F.array_distinct(emails(text))
    named = F.transform(known, lambda e, i: F.struct(-F.length(e), e.alias("e"), (i + 1).alias("n")))
    return F.aggregate(F.array_sort(named), text, lambda t, x: F.regexp_replace(t, F.concat(F.lit(r"(?i)(?<![A-Za-z0-9._%+-])\Q"), x["e"], F.lit(r"\E(?![A-Za-z0-9-])")), F.concat(F.lit("redacted-user"), x["n"].cast("string"), F.lit("@example.com"))))


def replace_homes(text: Column) -> Column:
    """User names in home paths numbered by first appearance, wherever the path occurs."""
    known = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(HOME), F.lit(2)), F.lower))
    named = F.transform(known, lambda u, i: F.struct(u.alias("u"), (i + 1).alias("n")))
    return F.aggregate(named, text, lambda t, x: F.regexp_replace(t, F.concat(F.lit(r"(?i)(/home/|/Users/|[A-Z]:\\Users\\)\Q"), x["u"], F.lit(r"\E(?![\w.-])")), F.concat(F.lit("$1user"), x["n"].cast("string"))))


def dummy(secret: Column, size: int = 24) -> Column:
    """A stand-in made of the secret's own hash: equal secrets stay equal in every file."""
    return F.concat(F.lit("REDACTED_"), F.upper(F.substring(F.sha2(secret, 256), 1, size)))


def replace_secrets(text: Column) -> Column:
    whole = F.regexp_extract_all(text, F.lit("|".join(SECRETS)), F.lit(0))
    parts = [F.regexp_extract_all(text, F.lit(p), F.lit(2)) for p in (BEARER, URL_PASSWORD, ASSIGNED)]
    known = F.filter(F.array_distinct(F.concat(whole, *parts)), lambda s: ~s.rlike(r"(?i)^(\*+|x+|your[_-].*|<.*>|\$\{?.*|changeme|none|null|true|false|placeholder.*|REDACTED.*)$"))
    ordered = F.array_sort(F.transform(known, lambda s: F.struct(-F.length(s), s.alias("s"))))
    return F.aggregate(ordered, text, lambda t, x: F.replace(t, x["s"], dummy(x["s"])))


def anonymize_text(text: Column) -> Column:
    """E-mail addresses, then home paths, then secrets. Texts that can hold none skip the work."""
    some = text.rlike(r"@|/home/|/Users/|\\Users\\|-----BEGIN|://|(?i)bearer\s") | text.rlike("|".join(SECRETS)) | text.rlike(ASSIGNED)
    return F.when(some, replace_secrets(replace_homes(replace_emails(text)))).otherwise(text)


def anonymize(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows with their text scrubbed and ``changed``; an unchanged text keeps its bytes."""
    new = anonymize_text(F.col(text_col))
    return docs.withColumn("__new", new).withColumn("changed", F.coalesce(F.col("__new") != F.col(text_col), F.lit(False))).withColumn(text_col, F.col("__new")).drop("__new")


SESSIONS = "source_file string, text string, emails int, usernames int, api_keys int, lines int, changed int"


def anonymize_sessions(files: DataFrame) -> DataFrame:
    """(source_file, text, emails, usernames, api_keys, lines, changed) of (source_file, text) of JSONL sessions.

    A session is scrubbed by one task, as its people are numbered as they appear;
    equal secrets get equal stand-ins in all sessions. Only lines whose value changes
    are written anew; a line that is no JSON is scrubbed as text, and all others keep
    their bytes. A null text stays null.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames(batches):
            rows = []
            for name, text in zip(pdf["source_file"], pdf["text"]):
                s, out, changed = Scrubber(), [], 0
                for line in (text or "").split("\n"):
                    new = scrub_line(s, line)
                    changed += new != line
                    out.append(new)
                rows.append((name, None if text is None else "\n".join(out), s.counts["email"], s.counts["username"], s.counts["api_key"], sum(bool(x.strip()) for x in (text or "").split("\n")), changed))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SESSIONS.split(", ")])

    return files.select("source_file", "text").mapInPandas(run, SESSIONS)


def scrub_line(s: Scrubber, line: str) -> str:
    if not line.strip():
        return line
    try:
        value = json.loads(line)
    except ValueError:
        return s.text(line)
    new = s.value(value)
    return line if new == value else compact(new)


def anonymize_report(sessions: DataFrame) -> DataFrame:
    """(kind, replacements): totals of ``anonymize_sessions`` by kind."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("n")) for k, c in (("email", "emails"), ("username", "usernames"), ("api_key", "api_keys"))]))
    return sessions.select(pairs.alias("p")).groupBy("p.kind").agg(F.sum("p.n").alias("replacements"))
