"""Secrets out of strings and maps."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = "[REDACTED]"

# Shapes of secrets, replaced whole, in this order.
WHOLE = (
    r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----",
    r"AKIA[0-9A-Z]{16}",
    r"ya29\.[A-Za-z0-9_\-]+",
    r"1//[A-Za-z0-9_\-]+",
    r"Bearer\s+[A-Za-z0-9_\-\.=]+",
)
# Shapes whose first group stays.
AFTER = (r"(aws_secret_access_key[=:\s]+)[A-Za-z0-9/+=]{40}", r"(X-Amz-Signature=)[A-Fa-f0-9]+")
# Names whose value is masked whatever it holds, in lower case.
NAMES = ("aws_secret_access_key", "private_key", "private_key_id", "client_secret", "refresh_token", "access_token", "authorization")


def redact_text(c: Column) -> Column:
    for p in WHOLE:
        c = F.regexp_replace(c, p, MASK)
    for p in AFTER:
        c = F.regexp_replace(c, p, "$1" + MASK)
    return c


def redact_map(c: Column) -> Column:
    return F.transform_values(c, lambda k, v: F.when(F.lower(k).isin(*NAMES), F.lit(MASK)).otherwise(redact_text(v)))


_WHOLE, _AFTER = [re.compile(p) for p in WHOLE], [re.compile(p) for p in AFTER]


def redacted(value: object) -> object:
    """A value of nested dicts, lists and tuples without secrets, for what the driver writes; numbers and the like stay."""
    if isinstance(value, str):
        for p in _WHOLE:
            value = p.sub(MASK, value)
        for p in _AFTER:
            value = p.sub(rf"\1{MASK}", value)
        return value
    if isinstance(value, dict):
        return {k: MASK if isinstance(k, str) and k.lower() in NAMES else redacted(v) for k, v in value.items()}
    return type(value)(map(redacted, value)) if type(value) in (list, tuple) else value


def redact_json(c: Column) -> Column:
    """JSON texts with every nested value redacted, as compact JSON; a text that is no JSON is redacted as text."""

    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            try:
                return json.dumps(redacted(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
            except (ValueError, RecursionError):
                return redacted(text)

        return texts.map(one, na_action="ignore")

    return redact(c)
