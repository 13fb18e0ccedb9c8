"""How evidence is shown: durations, dates, scopes, titles, scores and the timeline table, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scores from which evidence counts as high or middling.
HIGH, MIDDLE = 0.7, 0.4
#: A title's first part stands for it if it is shorter than this.
SHORT_PART = 20
RECENT = 10


def date_part(moment: Column) -> Column:
    """The date of an ISO text; empty without one."""
    return F.coalesce(F.split_part(moment, F.lit("T"), F.lit(1)), F.lit(""))


def duration_days(start: Column, end: Column) -> Column:
    """Whole days between two ISO texts, rounded; null if unknown or not positive."""
    seconds = F.unix_timestamp(F.try_to_timestamp(end)) - F.unix_timestamp(F.try_to_timestamp(start))
    days = F.floor(seconds / 86400 + 0.5).cast("int")
    return F.when(days > 0, days)


def scope_text(scope: Column) -> Column:
    """The wording inside a scope's JSON, other texts as they are, a dash for none."""
    raw = F.nullif(F.get_json_object(scope, "$.raw"), F.lit(""))
    return F.when(F.coalesce(scope, F.lit("")) == "", "-").when(scope.startswith("{"), F.coalesce(raw, scope)).otherwise(scope)


def shown_title(event_title: Column, note_title: Column, start: Column, month_words: tuple[str, ...], month: str) -> Column:
    """A title without what follows its first colon, and with the month where it names one of ``month_words``."""
    title = F.coalesce(F.nullif(event_title, F.lit("")), F.nullif(note_title, F.lit("")), F.lit("-"))
    first = F.split_part(title, F.lit(":"), F.lit(1))
    title = F.when(title.contains(":") & (F.length(first) < SHORT_PART), F.trim(first)).otherwise(title)
    suffix = F.concat(F.lit("("), F.substring(start, 6, 2).cast("int").cast("string"), F.lit(f"{month})"))
    named = F.lit(False)
    for word in month_words:
        named = named | title.contains(word)
    dated = (F.coalesce(start, F.lit("")) != "") & named & ~title.contains(suffix)
    return F.when(dated, F.concat_ws(" ", title, suffix)).otherwise(title)


def score_bucket(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MIDDLE, "mid").otherwise("low")


def timeline(evidence: DataFrame, month_words: tuple[str, ...], month: str) -> DataFrame:
    """``evidence`` with period, days, shown_title, scope, percent and bucket."""
    start, end = date_part(F.col("start_at")), date_part(F.col("end_at"))
    period = F.when(start != "", F.concat(start, F.when(end != "", F.concat(F.lit(" ~ "), end)).otherwise(F.lit(" ~")))).otherwise(F.coalesce(F.nullif(date_part(F.col("published_at")), F.lit("")), F.lit("-")))
    return evidence.withColumns(
        {
            "period": period,
            "days": duration_days(F.col("start_at"), F.col("end_at")),
            "shown_title": shown_title(F.col("event_title"), F.col("note_title"), F.col("start_at"), month_words, month),
            "scope": scope_text(F.col("target_scope")),
            "percent": F.floor(F.col("score") * 100 + 0.5).cast("int"),
            "bucket": score_bucket(F.col("score")),
        }
    )


def recent(history: list[str], question: str, keep: int = RECENT) -> list[str]:
    """Recent questions, the latest first, each once."""
    return [question, *(q for q in history if q != question)][:keep]
