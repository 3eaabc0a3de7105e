"""Captured web responses as a page source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lureline import fixed_values as V
from lureline.functions import urls as U


def accepted_pages(
    responses: DataFrame, url: str = "url", final_url: str = "final_url", status: str = "status",
    content_type: str = "content_type", body: str = "body", max_size: int = V.MAX_PAGE_BYTES,
) -> DataFrame:
    """Responses that count as a page: URL with scheme and host, status 200, HTML, not too large.

    The size test comes before decoding, so an oversized body is never turned into a string.
    Bytes that are not UTF-8 are left out.
    """
    requested = F.col(url)
    fits = (
        (F.col(status) == 200)
        & F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("text/html"))
        & (F.octet_length(body) <= max_size)
        & (U.scheme(requested) != "") & (U.netloc(requested) != "")
        & U.parses(U.netloc(requested))
    )
    raw = F.col(body).cast("string")
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(
        F.replace(F.make_valid_utf8(raw), F.lit("\ufffd"), F.lit("")))
    rest = [c for c in responses.columns if c not in (url, final_url, body, status, content_type)]
    return responses.filter(fits).select(
        *rest, requested.alias("url"), F.coalesce(F.col(final_url), requested).alias("final_url"),
        text.alias("html"))
