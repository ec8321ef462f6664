"""Named predicates on a match.  A detector with a ``refine`` name keeps only
occurrences that pass; rules stay data, predicates stay Column expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from glasswatch.functions.regex_dialect import Pattern
from glasswatch.functions.text import entropy

MIN_LENGTH = 20
MIN_ENTROPY = 3.5
_VALUE = Pattern(r"[=:]\s*[\"'](.*)[\"']$")
_UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
_HEX_DIGEST = r"(?i)^[0-9a-f]{40}$"
_PLACEHOLDER = r"(?i)^(?:changeme|todo|example|placeholder|your[-_].*|x{4,}|<.*>|\$\{.*\})$"
# The quoted value of an assignment such as  name = "value"
_QUOTED = r"[\"']([^\"']+)[\"']$"


def secret_value(match: Column) -> Column:
    return F.regexp_extract(match, _QUOTED, 1)


def strong_secret(match: Column, allow_sha: str = "always") -> Column:
    """Long, high-entropy and neither an identifier, a digest nor a placeholder.

    ``allow_sha='always'`` lets 40-hex digests pass as harmless; ``'bare'``
    treats a digest assigned to a secret name as a secret.
    """
    value = secret_value(match)
    harmless = value.rlike(_UUID) | value.rlike(_PLACEHOLDER)
    if allow_sha == "always":
        harmless = harmless | value.rlike(_HEX_DIGEST)
    return (F.length(value) >= MIN_LENGTH) & ~harmless & (entropy(value) >= MIN_ENTROPY)


_REGISTRY: dict[str, Callable[[Column], Column]] = {
    "strong_secret": strong_secret,
    "strong_secret_or_sha": lambda m: strong_secret(m, "bare"),
    "luhn": lambda m: F.call_function("luhn_check", F.regexp_replace(m, r"\D", "")),
}


def register(name: str, predicate: Callable[[Column], Column]) -> None:
    _REGISTRY[name] = predicate


def predicate(name: str) -> Callable[[Column], Column]:
    return _REGISTRY[name]


def first_passing(candidates: Column, accept: Callable[[str], bool]) -> Column:
    """First candidate of an ARRAY<STRING> column accepted by plain Python, by Arrow batch."""

    @F.pandas_udf("string")
    def pick(values: pd.Series) -> pd.Series:
        return values.map(lambda xs: next((x for x in xs if accept(x)), None) if xs is not None else None)

    return pick(candidates)
