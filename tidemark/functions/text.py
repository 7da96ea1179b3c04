"""Columns from text, URLs and times."""

from __future__ import annotations

import html
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values.
TOKEN = r"[a-z0-9]+(?:['\-][a-z0-9]+)*"
ENTITIES = {"&quot;": '"', "&#x27;": "'", "&#x2F;": "/", "&copy;": "©", "&middot;": "·", "&lt;": "<", "&gt;": ">", "&amp;": "&"}


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """All named and numbered entities."""
    return text.map(html.unescape, na_action="ignore")


def unescape_common(text: Column) -> Column:
    """The entities in ENTITIES, without Python."""
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def strip_html(text: Column, decode=unescape) -> Column:
    """Tags become blanks, then entities are decoded once."""
    return collapse(decode(F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]*>", " ")))


def normalise_title(text: Column, decode=unescape) -> Column:
    return F.lower(collapse(decode(decode(F.coalesce(text, F.lit(""))))))


def hostname(url: Column) -> Column:
    """The host, lower-case, without credentials, port and one www.; '' if there is none."""
    whole = F.coalesce(url, F.lit(""))
    whole = F.when(F.instr(whole, "//") > 0, whole).otherwise(F.concat(F.lit("//"), whole))
    net = F.regexp_extract(whole, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    net = F.regexp_replace(net, r"^.*@", "")
    bracket = F.regexp_extract(net, r"^\[([^\]]*)\](?::\d*)?$", 1)
    plain = F.when(F.instr(net, "[") + F.instr(net, "]") > 0, "").otherwise(F.regexp_extract(net, r"^([^:]*)", 1))
    return F.regexp_replace(F.lower(F.when(bracket != "", bracket).otherwise(plain)), r"^www\.", "")


def has_url(url: Column) -> Column:
    return (hostname(url) != "").cast("double")


def body_length(plain: Column) -> Column:
    return F.log1p(F.length(plain))


def has_body(plain: Column) -> Column:
    return (plain != "").cast("double")


def cyclical(value: Column, period: float) -> tuple[Column, Column]:
    if period <= 0:
        raise ValueError("the period must be above 0")
    turn = value * (2 * math.pi / period)
    return F.sin(turn), F.cos(turn)


def temporal(time: Column) -> dict[str, Column]:
    """Hour and day of week (Monday 0) on circles, and is_weekend. No year."""
    time = time.cast("timestamp")
    day = F.weekday(time)
    (hs, hc), (ds, dc) = cyclical(F.hour(time), 24), cyclical(day, 7)
    return {"hour_sin": hs, "hour_cos": hc, "dow_sin": ds, "dow_cos": dc, "is_weekend": (day >= 5).cast("double")}
