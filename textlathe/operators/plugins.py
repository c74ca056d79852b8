"""Strategies given from outside: classifiers, extractors, token counters, checks, timing."""

from __future__ import annotations

import functools
import logging
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)


def classified(df: DataFrame, text: str, make: Callable[[], object], name: str = "predicted") -> DataFrame:
    """Adds a classifier's labels. `make` builds it, once a task's Python worker; it has
    `predict_batch(list[str]) -> list[str | None]`. Null texts stay without a label."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            known = texts.notna()
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            out[known] = model.predict_batch(texts[known].tolist())
            yield out

    return df.withColumn(name, run(F.col(text)))


def extracted(df: DataFrame, text: str, extractors: dict[str, Callable[[str], list[str]]]) -> DataFrame:
    """Adds one array column for each extractor of a registry."""

    def column(f):
        @F.pandas_udf(T.ArrayType(T.StringType()))
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series([f(t) if t is not None else None for t in texts])

        return run(F.col(text))

    return df.withColumns({k: column(f) for k, f in extractors.items()})


def required(df: DataFrame, names: list[str]) -> DataFrame:
    """`df`, if it has all the columns named."""
    lost = sorted(set(names) - set(df.columns))
    if lost:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    return df


def columns_like(df: DataFrame, part: str) -> DataFrame:
    return df.select(*[c for c in df.columns if part in c])


def metric_specs(specs: list[str]) -> dict[str, str]:
    """`label=path` pairs; labels and paths must not be empty, labels not repeat."""
    out: dict[str, str] = {}
    for spec in specs:
        label, sign, path = spec.partition("=")
        if not sign or not label.strip() or not path.strip() or label.strip() in out:
            raise ValueError(f"not a new label=path: {spec}")
        out[label.strip()] = path.strip()
    return out


def metric_columns(variant: str, specs: dict[str, str]) -> list[Column]:
    """Numbers at dotted paths of a variant; strings, booleans and non-objects give null."""
    cols = []
    for label, path in specs.items():
        v = F.try_variant_get(variant, "$." + path, "variant")
        cols.append(F.when(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.try_variant_get(variant, "$." + path, "double")).alias(label))
    return cols


#: Reasons by which a response ended of itself.
FINISHED = ("stop", "eos", "end_turn")


def finished(reasons: str) -> Column:
    """Whether all of an array's reasons say that the response ended of itself."""
    return F.forall(reasons, lambda x: F.coalesce(x.isin(*FINISHED), F.lit(False)))


def tokenizer_settings(config: dict) -> dict:
    """Settings of a lower-casing word-piece tokenizer; accents go with case unless stated."""
    kind = (config.get("normalizer") or {}).get("type")
    if kind != "BertNormalizer" or (config.get("pre_tokenizer") or {}).get("type") != "BertPreTokenizer":
        raise ValueError("only the basic word-piece set-up is supported")
    n = config["normalizer"]
    lower = bool(n.get("lowercase", True))
    return {"lowercase": lower, "strip_accents": lower if n.get("strip_accents") is None else bool(n["strip_accents"]), "vocab": dict(config["model"]["vocab"])}


def broken_label(name: str, width: int) -> list[str]:
    """A dotted name in lines of at most `width`, broken after dots only."""
    lines: list[str] = []
    for part in re.findall(r"[^.]*\.|[^.]+$", name):
        if lines and len(lines[-1]) + len(part) <= width:
            lines[-1] += part
        else:
            lines.append(part)
    return lines


def timed(f):
    """Logs how long each call took and hands its result on."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        began = time.perf_counter()
        try:
            return f(*args, **kwargs)
        finally:
            log.info("%s took %.3f s", f.__name__, time.perf_counter() - began)

    return run
