"""Requests and responses as JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import is_blank


def _field(body: Column, name: str, kind: str) -> tuple[Column, Column]:
    """(the JSON type of a top-level field, null where absent; its value as `kind`, null where it cannot be one)."""
    v = F.try_parse_json(body)
    return F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")), F.try_variant_get(v, f"$.{name}", kind)


def _valid_json(body: Column) -> Column:
    return F.coalesce(F.try_parse_json(body).isNotNull(), F.lit(False))


def _text(body: Column, name: str) -> Column:
    """A field that is a JSON string, else null."""
    kind, value = _field(body, name, "string")
    return F.when(kind == "STRING", value)


def _number(body: Column, name: str) -> tuple[Column, Column]:
    """(whether the field is there, its value if it is a JSON number, else null)."""
    kind, value = _field(body, name, "double")
    return kind.isNotNull(), F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), value)


def validate_chat(requests: DataFrame, body: str = "body") -> DataFrame:
    """Add message, top_k (default 3), temperature, max_output_tokens, and error: the first bad field, or null."""
    b = F.col(body)
    message = _text(b, "message")
    (has_k, k), (has_t, t), (has_m, m) = (_number(b, n) for n in ("topK", "temperature", "maxOutputTokens"))
    bad = lambda given, fits: given & ~F.coalesce(fits, F.lit(False))
    error = (
        F.when(~_valid_json(b), "json")
        .when(is_blank(message), "message")
        .when(bad(has_k, k > 0), "topK")
        .when(bad(has_t, t.between(0, 2)), "temperature")
        .when(bad(has_m, m > 0), "maxOutputTokens")
    )
    return requests.withColumns({"error": error, "message": message, "top_k": F.ceil(F.coalesce(k, F.lit(3.0))).cast("int"), "temperature": t, "max_output_tokens": m.cast("int")})


def validate_index(requests: DataFrame, body: str = "body") -> DataFrame:
    """Add url, max_pages (default 10; numeric strings count), and error."""
    b = F.col(body)
    url, (given, _) = _text(b, "url"), _number(b, "maxPages")
    pages = F.when(given, _field(b, "maxPages", "string")[1].try_cast("double")).otherwise(F.lit(10.0))
    error = F.when(~_valid_json(b), "json").when(is_blank(url), "url").when(~F.coalesce(pages > 0, F.lit(False)), "maxPages")
    return requests.withColumns({"error": error, "url": F.trim(url), "max_pages": pages})


def response(error: Column, payload: Column, failure: Column | None = None) -> Column:
    """JSON of the payload, or of what was wrong with the request (error) or with answering it (failure)."""
    wrong = error if failure is None else F.coalesce(error, failure)
    return F.when(wrong.isNotNull(), F.to_json(F.struct(wrong.alias("error")))).otherwise(F.to_json(payload))


def status(error: Column, failure: Column | None = None) -> Column:
    """400 for a bad request, 500 where answering failed, else 200."""
    out = F.when(error.isNotNull(), F.lit(400))
    return (out if failure is None else out.when(failure.isNotNull(), F.lit(500))).otherwise(F.lit(200))
