"""Scalar expressions over text, time and identifiers. All stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# White space, as one class that regular expressions of Java and RE2 read alike.
SPACE = r"[ \t\n\x0B\f\r\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{001C}-\x{001F}]"
# Languages that are accepted whatever was asked for.
ALWAYS_ACCEPTED = ("ko", "en", "ja")
# Marks of a failed sign-in and of an exhausted quota in a process's output.
SIGN_IN_MARKS = ("not logged", "authentication", "unauthorized", "401")
QUOTA_MARKS = ("429", "rate limit", "usage limit")
# Marks of a quota that is spent for good.
SPENT_MARKS = ("usage limit", "quota")
# Names of origins in documents.
ORIGINS = {"source": "Source", "ai_explanation": "AI Explanation", "external_research": "External Research"}


def clean_text(text: Column) -> Column:
    """White space collapsed to single blanks and trimmed; null stays null."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def fold_text(text: Column) -> Column:
    """For comparison without case. ``lower`` keeps a sharp s, which full case folding writes as ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def to_ms(seconds: Column) -> Column:
    """Milliseconds, halves to even."""
    return F.rint(seconds * 1000).cast("bigint")


def timecode_ms(code: Column) -> Column:
    """``h:mm:ss.mmm`` with any number of parts and a dot or comma, in milliseconds; null where a part is no number."""
    parts = F.split(F.replace(F.trim(code), F.lit(","), F.lit(".")), ":")
    return to_ms(F.aggregate(parts, F.lit(0.0), lambda total, part: total * 60 + F.try_to_number(part, F.lit("9999999999.999999999")).cast("double")))


def clock(ms: Column) -> Column:
    """``MM:SS``, from an hour on ``HH:MM:SS``."""
    s = F.expr("0") + F.floor(ms / 1000).cast("bigint")
    hours, minutes, seconds = F.floor(s / 3600).cast("bigint"), F.floor(s / 60).cast("bigint") % 60, s % 60
    return F.when(hours > 0, F.format_string("%02d:%02d:%02d", hours, minutes, seconds)).otherwise(F.format_string("%02d:%02d", minutes, seconds))


def safe_name(title: Column) -> Column:
    """A title as a file name: reserved characters become dashes, blanks and dots at the ends go, nothing left is ``note``."""
    name = F.btrim(F.regexp_replace(title, r'[\\/:*?"<>|]', "-"), F.lit(" ."))
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("note"))


def numbered(prefix: str, n: Column) -> Column:
    """``prefix-001``; longer numbers keep all digits."""
    return F.format_string(prefix + "-%03d", n)


def language_base(tag: Column) -> Column:
    return F.substring_index(F.lower(tag), "-", 1)


def language_accepted(found: Column, wanted: Column) -> Column:
    """Whether a transcript's language serves a request: the same base, or one that always does."""
    return (language_base(found) == language_base(wanted)) | language_base(found).isin(*ALWAYS_ACCEPTED)


def provenance_label(provenance: Column) -> Column:
    """How documents name a claim's origin; unknown ones by themselves."""
    return F.coalesce(*[F.when(provenance == k, F.lit(v)) for k, v in ORIGINS.items()], provenance)


def quarter(at: Column, duration: Column) -> Column:
    """Which quarter of a recording a time falls into, 0 to 3."""
    return F.least(F.lit(3).cast("bigint"), F.expr("0").cast("bigint") + F.floor(at * 4 / F.greatest(F.lit(1), duration)).cast("bigint"))


# Names of the depths, and most chapters for a brief, a deep and, by duration, any other.
BRIEF = ("brief", "short", "quick", "simple", "concise", "초간단", "핵심", "간단")
DEEP = ("deep", "심층", "꽉찬")


def chapter_cap(depth: Column, duration_ms: Column) -> Column:
    """Most chapters that a depth allows; the standard one goes by duration."""
    standard = F.when(duration_ms <= 1_800_000, 5).when(duration_ms <= 3_600_000, 8).otherwise(12)
    return F.when(depth.isin(*BRIEF), 3).when(depth.isin(*DEEP), 15).otherwise(standard)


def outcome(stderr: Column, stdout: Column) -> Column:
    """What a failed process's output says: ``auth``, ``rate_limit`` or ``error``; standard output counts where the other is empty."""
    said = F.lower(F.coalesce(F.nullif(stderr, F.lit("")), stdout, F.lit("")))
    return F.when(said.rlike("|".join(SIGN_IN_MARKS)), "auth").when(said.rlike("|".join(QUOTA_MARKS)), "rate_limit").otherwise("error")


def retry_decision(error: Column, attempts: Column) -> Column:
    """What becomes of a job that failed with an error: ``blocked_auth`` where a sign-in is missing, ``failed_runtime`` on a spent quota or the second attempt, else ``retry``."""
    said = F.lower(error)
    return F.when(said.rlike("|".join(SIGN_IN_MARKS)), "blocked_auth").when(said.rlike("|".join(SPENT_MARKS)) | (attempts >= 2), "failed_runtime").otherwise("retry")


def utc_text(at: Column) -> Column:
    """A time as text, in UTC, with microseconds: ``2025-01-01T00:00:00.000000+00:00``."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def json_object(text: Column) -> Column:
    """The JSON object in a text, code fences removed, or null where there is none: an array, a scalar or no JSON."""
    body = unfenced(text)
    return F.when(F.coalesce(F.is_variant_null(F.try_parse_json(body)), F.lit(True)), None).when(body.startswith("{"), body)


def unfenced(text: Column) -> Column:
    """Text without a surrounding code fence."""
    return F.trim(F.regexp_replace(F.trim(text), r"^```[a-zA-Z0-9_-]*\s*|\s*```\z", ""))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def older_than(at: Column, now: Column, days: int) -> Column:
    return at < now - F.make_interval(days=F.lit(days))
