"""Where a language model can be plugged in, and the functions that SQL can call.

A provider completes prompts and embeds texts.  :func:`completed` and :func:`embedded` turn one
into column functions that run in Arrow batches beside the data; the default provider is the
rule-based stand-in, so every query has an answer without a model.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


class Provider(Protocol):
    """A language model: it is sent to the executors, so it holds settings, not connections."""

    def complete(self, prompts: Sequence[str]) -> list[str]: ...

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class Rules:
    """The stand-in: completes with the prompt's last line, embeds by the hashes of words."""

    def __init__(self, size: int = 64) -> None:
        self.size = size

    def complete(self, prompts: Sequence[str]) -> list[str]:
        return [p.strip().rsplit("\n", 1)[-1] for p in prompts]

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.size)
            for word in text.lower().split():
                digest = hashlib.blake2b(word.encode(), digest_size=8).digest()
                v[int.from_bytes(digest[:4], "big") % self.size] += 1 if digest[4] & 1 else -1
            out.append((v / (np.linalg.norm(v) or 1.0)).tolist())
        return out


def completed(prompt: Column, provider: Provider | None = None) -> Column:
    model = provider or Rules()

    @F.pandas_udf("string")
    def complete(prompts: pd.Series) -> pd.Series:
        return pd.Series(model.complete(prompts.fillna("").tolist()), index=prompts.index)

    return complete(prompt)


def embedded(text: Column, provider: Provider | None = None, prefix: str = "") -> Column:
    """Unit vectors of texts; prefix: what the model wants before a passage or a query."""
    model = provider or Rules()

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(model.embed([prefix + t for t in texts.fillna("").tolist()]), index=texts.index)

    return embed(text)


def register(spark: SparkSession) -> list[str]:
    """Register the engine's functions for SQL; returns their names.

    ``mended_json(text)``; ``posterior_mean(prior, confirmed)``, an aggregate over a group of rows;
    and ``text_lines(text)``, a table function with a row for each line.
    """
    from pyspark.sql.functions import udtf

    from lorebase.operators.text import mended

    @F.pandas_udf("string")
    def mended_json(texts: pd.Series) -> pd.Series:
        return texts.map(mended)

    @F.pandas_udf("double")
    def posterior_mean(prior: pd.Series, confirmed: pd.Series) -> float:
        p, yes = float(prior.iloc[0]), confirmed.astype(float)
        a, b = 2 * p + yes.sum(), 2 * (1 - p) + (1 - yes).sum()
        return float(a / (a + b))

    @udtf(returnType="line_no int, line string")
    class TextLines:
        def eval(self, text: str):
            for i, line in enumerate((text or "").split("\n")):
                yield i, line

    spark.udf.register("mended_json", mended_json)
    spark.udf.register("posterior_mean", posterior_mean)
    spark.udtf.register("text_lines", TextLines)
    return ["mended_json", "posterior_mean", "text_lines"]
