"""Request intake: the description from a JSON body or from a query string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brandsieve import fixed_values as V
from brandsieve.functions.text import trim_ws

FIELD = "business_description"


def body_text(body: Column) -> Column:
    """The description in a JSON body, '' when the body lacks it."""
    return F.coalesce(F.get_json_object(body, f"$.{FIELD}"), F.lit(""))


def query_text(url: Column) -> Column:
    """The decoded description in a URL's query string, '' when it lacks it."""
    return F.coalesce(F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(FIELD))), F.lit(""))


def body_failure(body: Column) -> Column:
    """Why a body is no request: struct of ``message`` and ``http_code``, null for a request.

    An empty object, array or text, null, false and zero are invalid requests (400). A body that
    is missing, can't be read or is no object breaks the processing (500).
    """
    text = trim_ws(F.coalesce(body, F.lit("")))
    invalid = F.struct(F.lit(V.MSG_BAD_JSON).alias("message"), F.lit(400).alias("http_code"))
    failed = F.struct(F.lit(V.MSG_REQUEST_FAILED).alias("message"), F.lit(500).alias("http_code"))
    empty = text.rlike(rf'^(?:\{{{V.BLANK}*\}}|\[{V.BLANK}*\]|""|null|false|-?0(?:\.0+)?)$')
    return (
        F.when((text == "") | F.try_parse_json(text).isNull(), failed)
        .when(empty, invalid)
        .when(~text.startswith("{"), failed)
    )
