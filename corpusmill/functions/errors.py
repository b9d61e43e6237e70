"""Text of failures: retry delay, category, and whether a retry makes sense."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Status codes that are worth a retry, and phrases of broken connections.
RETRY_STATUS = (429, 500, 502, 503, 504)
NETWORK_PHRASES = ("fetch failed", "timeout", "econnrefused", "network error")
DEFAULT_DELAY = 30.0


_NUMBER = r"([0-9]+(?:\.[0-9]*)?|\.[0-9]+)"
#: When to come back, as a small grammar: the word retry, how the wait is put, an optional colon, a number, and seconds as its unit.
_WAIT = rf"(?i)retry[ _-]*(?:in|after|delay)\b\s*:?\s*{_NUMBER}\s*s"


def retry_delay(message: Column, detail: Column | None = None) -> Column:
    """Seconds to wait: from a structured detail like `12s`, else from the message, else null."""
    in_message = F.regexp_extract(message, _WAIT, 1).try_cast("double")
    if detail is None:
        return in_message
    return F.coalesce(F.regexp_extract(detail, rf"^\s*{_NUMBER}", 1).try_cast("double"), in_message)


def is_network_failure(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit(False)
    for p in NETWORK_PHRASES:
        out = out | low.contains(p)
    return out


def error_category(status: Column, message: Column) -> Column:
    limited = F.coalesce(status == 429, F.lit(False)) | F.coalesce(message.contains("429"), F.lit(False))
    return F.when(limited, "rate_limit").when(is_network_failure(message), "network").when(status.between(500, 599), "server").otherwise("transient")


def is_retryable(status: Column, message: Column) -> Column:
    """By status where there is one, else by the message."""
    return F.when(status.isNotNull(), status.isin(*RETRY_STATUS)).otherwise(is_network_failure(message))


def retryable_one(status: int | None, message: str | None) -> bool:
    """is_retryable for one failure, for providers that run inside a task."""
    return status in RETRY_STATUS if status is not None else any(p in (message or "").lower() for p in NETWORK_PHRASES)
