"""Quality classifier: histogram gradient-boosted trees over statistics of the text.

The trees are fitted on the driver from at most ``most`` labelled rows of each class (a documented
bound) and flattened into arrays; scoring is one vectorised pass over all documents without a
shuffle. Only the text is an input of the score.

Edge cases: null and empty texts have all statistics 0 and get the score of that point; without
labels the score is 0.5 for all; repeated rows are scored each; an empty table gives no rows;
further columns are carried on by ``keep`` and ignored by ``score``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gbdt
from .common import crc_bucket, lean, release, texts
from .labelled import training_texts
from .quality_rules import repeated_words

_CLASSES = [re.compile(p) for p in (r"[#*$%&|<>]", r"[.,;:!?]", r"[0-9]", r"[A-ZÀ-ÖØ-Þ]", r"!")]
NAMES = (
    "log_chars log_words word_len symbols punctuation digits capitals bangs lines dup_lines repeats distinct "
    "top_word bare_words ends line_len short_words capped marked"
).split()


def features(text: str) -> list[float]:
    """``NAMES`` of one text; shares are of characters, words or lines."""
    n = len(text)
    words = text.split()
    if not words:
        return [0.0] * len(NAMES)
    w, count = len(words), Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    shares = [len(p.findall(text)) / n for p in _CLASSES]
    lengths = np.fromiter(map(len, words), np.int32, w)
    return [
        np.log1p(n), np.log1p(w), float(lengths.mean()), *shares, np.log1p(len(lines)),
        1 - len(set(lines)) / len(lines), repeated_words([x.encode("utf-8", "replace") for x in words]) / w,
        len(count) / w, max(count.values()) / w, sum(c for x, c in count.items() if not any(map(str.isalpha, x))) / w,
        sum(x.rstrip()[-1] in ".!?" for x in lines) / len(lines), np.log1p(n / len(lines)), float((lengths <= 3).mean()),
        sum(c for x, c in count.items() if x.isupper()) / w, sum(c for x, c in count.items() if not x[-1].isalnum()) / w,
    ]


def matrix(values: pd.Series) -> np.ndarray:
    return np.array([features(t or "") for t in values], np.float32).reshape(len(values), len(NAMES))


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", most: int = 25_000, **folds) -> gbdt.Trees:
    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"x": list(matrix(pdf["text"])), "y": pdf["y"]})

    rows = training_texts(docs, labels, column, most, **folds).mapInPandas(lean(run), "x array<float>, y int").toPandas()
    x = np.array(rows["x"].tolist(), np.float32).reshape(len(rows), len(NAMES))
    order = np.lexsort([*x.T, rows["y"]]) if len(rows) else []  # the order of arrival doesn't matter
    return gbdt.fit(x[order], rows["y"].to_numpy(np.float64)[order])


def score_column(model: gbdt.Trees, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in parts:
            yield pd.Series(model.proba(matrix(values)).astype(np.float64), index=values.index)
        release()

    return score(text)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted``."""
    model = train(docs, labels, **options)
    scored = texts(docs).select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    model = train(docs, labels, **options)
    return docs.where(score_column(model, F.coalesce(F.col("text").cast("string"), F.lit(""))) >= threshold)
