"""Chains of fitted vector transforms, described by a line of text and stored as JSON."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspan.functions import vectors as V
from vecspan.operators import backends as B


def parse(text: str) -> list[tuple[str, dict[str, str]]]:
    """`name --option value ... | name ...`; an option without a value is 'true'."""
    out = []
    for part in text.split("|"):
        name, *words = part.split()
        options: dict[str, str] = {}
        key = None
        for w in words:
            if w.startswith("--"):
                key = w[2:].replace("-", "_")
                options[key] = "true"
            elif key is None:
                raise ValueError(f"a value without an option: {w}")
            else:
                options[key] = w
                key = None
        out.append((name, options))
    return out


def fit(text: str, df: DataFrame, spk: str = "spk", vec: str = "v") -> list[dict]:
    """Fit each link on vectors that the earlier links have transformed."""
    links = []
    for name, options in parse(text):
        link = {"name": name}
        if name == "mean-subtract":
            link["mean"] = B.moments(df, vec)[1].tolist()
        elif name == "lda":
            mean, p = B.fit_lda(df, int(options.get("dim", "100")), spk, vec)
            link |= {"mean": mean.tolist(), "matrix": p.tolist()}
        elif name == "whitening":
            mean, p = B.fit_whitening(df, vec)
            link |= {"mean": mean.tolist(), "matrix": p.tolist()}
        elif name != "length-norm":
            raise ValueError(f"unknown link {name}")
        links.append(link)
        df = apply([link], df, vec)
    return links


def apply(links: list[dict], df: DataFrame, vec: str = "v") -> DataFrame:
    """Df with vec transformed by every link."""
    for link in links:
        v = V.as_double(F.col(vec))
        if link["name"] == "length-norm":
            df = df.withColumn(vec, V.l2_normalise(v))
        elif "matrix" in link:
            df = B.transform_vectors(df, np.array(link["mean"]), np.array(link["matrix"]), vec)
        else:
            df = df.withColumn(vec, V.subtract(v, F.array(*[F.lit(m) for m in link["mean"]])))
    return df


def replace(links: list[dict], position: int, text: str, df: DataFrame, spk: str = "spk", vec: str = "v") -> list[dict]:
    """The chain with one link fitted anew on df after the links before it."""
    new = fit(text, apply(links[:position], df, vec), spk, vec)
    return links[:position] + new + links[position + 1 :]


def dumps(links: list[dict]) -> str:
    """JSON, not a pickle."""
    return json.dumps(links)


def loads(text: str) -> list[dict]:
    return json.loads(text)
