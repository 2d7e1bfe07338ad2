"""JSON out of messy replies, and canonical forms."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_decoder = json.JSONDecoder()


def first_json(text: str | None) -> str | None:
    """The first JSON object or array of a reply, after thoughts and code fences are taken off; None if there is none or it is cut off."""
    if text is None:
        return None
    text = re.sub(r"(?is)<think>.*?</think>", "", text).strip().lstrip("﻿")
    fenced = re.match(r"(?s)```[\w-]*\s*\n(.*?)\n```\s*\Z", text)
    text = fenced[1].strip() if fenced else text
    start = re.search(r"[{\[]", text)
    if not start:
        return None
    try:
        return json.dumps(_decoder.raw_decode(text, start.start())[0], ensure_ascii=False, separators=(",", ":"))
    except ValueError:
        return None


@F.pandas_udf(StringType())
def extract_json(text: pd.Series) -> pd.Series:
    return text.map(first_json)


def canonical(text: str | None) -> str | None:
    try:
        return None if text is None else json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    except ValueError:
        return None


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Keys in order, no blanks; null if it is not JSON."""
    return text.map(canonical)


@F.pandas_udf(StringType())
def content_sha256(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if (c := canonical(t)) is None else hashlib.sha256(c.encode()).hexdigest())
