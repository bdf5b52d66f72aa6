"""Patches as columns: codecs run over Arrow batches, one row at a time within a batch."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from snapforge.functions import textdiff, vcdiff
from snapforge.operators.routing import BINARY, EXTENDED, PASSTHROUGH, TEXT
from snapforge.plans.staging import ship

Codec = tuple[Callable[[bytes, bytes], bytes], Callable[[bytes, bytes], bytes]]
BUILT_IN: dict[int, Codec] = {
    PASSTHROUGH: (lambda source, target: target, lambda source, patch: patch),
    BINARY: (vcdiff.encode, vcdiff.decode),
    TEXT: (textdiff.encode, textdiff.decode),
}
_OUT = "patch binary, code int, patch_sha256 string, codec_fallback boolean"


def _codec(code: int, codec_id: str | None, extended: dict[str, Codec]) -> Codec:
    if code in BUILT_IN:
        return BUILT_IN[code]
    if code == EXTENDED and codec_id in extended:
        return extended[codec_id]
    raise ValueError(f"no codec for code {code}, id {codec_id}")


def encoded(source: str, target: str, code: str, codec_id: str | None = None, threshold: float | Column = 1.0, extended: dict | None = None, strict: bool = False) -> Column:
    """A struct (patch, code, patch_sha256, codec_fallback): a patch larger than size times threshold is the target itself,
    as code 0. Where a codec can't take the content, so it is too, with codec_fallback (an error if strict)."""
    extended = extended or {}
    ship(SparkSession.active())

    @F.pandas_udf(_OUT)
    def run(s: pd.Series, t: pd.Series, c: pd.Series, i: pd.Series, most: pd.Series) -> pd.DataFrame:
        rows = []
        for src, tgt, cd, cid, share in zip(s, t, c, i, most):
            src, tgt, fell = bytes(src or b""), bytes(tgt or b""), False
            try:
                patch = _codec(int(cd), cid, extended)[0](src, tgt)
            except ValueError:
                if strict:
                    raise
                patch, cd, fell = tgt, PASSTHROUGH, True
            if len(patch) > len(tgt) * share:
                patch, cd = tgt, PASSTHROUGH
            rows.append((patch, int(cd), hashlib.sha256(patch).hexdigest(), fell))
        return pd.DataFrame(rows, columns=["patch", "code", "patch_sha256", "codec_fallback"])

    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return run(F.col(source), F.col(target), F.col(code), F.col(codec_id) if codec_id else F.lit(None).cast("string"), limit)


def decoded(source: str, patch: str, code: str, codec_id: str | None = None, extended: dict | None = None) -> Column:
    """The target's bytes."""
    extended = extended or {}
    ship(SparkSession.active())

    @F.pandas_udf("binary")
    def run(s: pd.Series, p: pd.Series, c: pd.Series, i: pd.Series) -> pd.Series:
        return pd.Series([_codec(int(cd), cid, extended)[1](bytes(src or b""), bytes(pt or b"")) for src, pt, cd, cid in zip(s, p, c, i)])

    return run(F.col(source), F.col(patch), F.col(code), F.col(codec_id) if codec_id else F.lit(None).cast("string"))


def round_trip(pairs: DataFrame, code: int) -> DataFrame:
    """(path, ok, sha256) of (path, source, target): whether the target comes back from its patch, and its hash."""
    coded = pairs.withColumn("want", F.lit(code)).withColumn("p", encoded("source", "target", "want", threshold=1e9)).select("path", "source", "target", "p.*")
    back = coded.withColumn("back", decoded("source", "patch", "code"))
    return back.select("path", (F.col("back") == F.col("target").cast("binary")).alias("ok"), F.sha2("back", 256).alias("sha256"))
