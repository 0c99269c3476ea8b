"""Aggregates and table functions for use from SQL: ``register(spark)`` adds them to a session."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType


@F.pandas_udf(DoubleType())
def loom_kappa(x: pd.Series, y: pd.Series) -> float:
    """Cohen's kappa of two raters' labels; pairs with a null don't count, 1 where both always say the same one label."""
    both = pd.DataFrame({"x": x, "y": y}).dropna()
    if both.empty:
        return float("nan")
    seen = (both["x"] == both["y"]).mean()
    p, q = both["x"].value_counts(normalize=True), both["y"].value_counts(normalize=True)
    chance = float((p * q.reindex(p.index).fillna(0)).sum())
    return 1.0 if chance == 1 else float((seen - chance) / (1 - chance))


@F.udtf(returnType=StructType().add("line", "integer").add("level", "integer").add("title", "string"))
class LoomOutline:
    """Headings of a Markdown text outside code fences."""

    def eval(self, text: str) -> Iterator[tuple[int, int, str]]:
        fenced = False
        for i, line in enumerate((text or "").split("\n"), 1):
            if line.startswith(("```", "~~~")):
                fenced = not fenced
            elif not fenced and (m := re.match(r"(#{1,6}) (.*)$", line, re.S)):
                yield i, len(m.group(1)), m.group(2).strip(" ")


@F.udtf(returnType=StructType().add("line", "integer").add("content", "string"))
class LoomLines:
    """Lines first to last of a text, both included; lines beyond its ends are not there."""

    def eval(self, text: str, first: int, last: int) -> Iterator[tuple[int, str]]:
        if text is not None:
            for i, line in enumerate(text.split("\n")[max(0, first - 1) : max(0, last)], max(1, first)):
                yield i, line


def register(spark: SparkSession) -> None:
    spark.udf.register("loom_kappa", loom_kappa)
    spark.udtf.register("loom_outline", LoomOutline)
    spark.udtf.register("loom_lines", LoomLines)
