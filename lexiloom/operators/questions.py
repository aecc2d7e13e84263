"""Quality measures of short questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as T

#: Words and phrases of each intent.
INTENTS = {
    "causal": r"\b(impact|effect|influence|cause|causal|lead to|result in)\b",
    "comparative": r"\b(compare|difference|versus|vs\.|greater|less)\b",
    "numeric": r"\b(how many|how much|number of|amount of|average|mean|count)\b",
    "temporal": r"\b(when|time|duration|before|after|timeline|trend)\b",
}
PLACEHOLDER = r"(?i)(\b(xxx|tbd|todo|something|etc)\b|\[mask\])"
COMPLEX = r"(?i)\bwhat\b.*\band\b.*\b(how|why|when|where|who|which)\b"
FLAGS = ["ends_q", "starts_wh", "placeholder", "multi_q", "non_atomic"]


def flags(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with the well-formedness and atomicity flags and ``n_tokens``."""
    x = F.col(text)
    bare = F.trim(x)
    tokens = T.word_tokens(T.normalize_cq(x))
    count = lambda c: F.length(bare) - F.length(F.replace(bare, F.lit(c)))
    joined = bare.rlike(r"(?i)\b(and|or)\b") & (bare.contains(",") | bare.rlike(COMPLEX))
    return rows.withColumns(
        {
            "ends_q": bare.endswith("?"),
            "starts_wh": F.coalesce(F.get(tokens, F.lit(0)).isin(T.INTERROGATIVES), F.lit(False)),
            "placeholder": x.rlike(PLACEHOLDER),
            "multi_q": count("?") > 1,
            "non_atomic": joined | bare.contains(";") | bare.contains(":") | (count(",") >= 2),
            "n_tokens": F.size(tokens),
        }
    )


def summary(rows: DataFrame) -> DataFrame:
    """One row of ratios over all rows, those without text included."""
    has = F.coalesce(F.col("text"), F.lit("")) != ""
    flagged = flags(rows.withColumn("has", has))
    ratio = lambda c: F.round(F.count_if(F.col("has") & F.col(c)) / F.count(F.lit(1)), 6).alias(f"{c}_ratio")
    length = F.when(F.col("has"), F.col("n_tokens"))
    return flagged.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("has")).alias("missing"), *[ratio(c) for c in FLAGS],
        F.min(length).alias("len_min"), F.round(F.avg(length), 6).alias("len_avg"), F.round(F.percentile(length, 0.95), 6).alias("len_p95"), F.max(length).alias("len_max"),
    )


def intents(normal: Column, patterns: dict[str, str] = INTENTS) -> Column:
    """Labels of the intents that a normalized question shows, in alphabetical order."""
    return F.array_compact(F.array(*[F.when(normal.rlike(p), F.lit(k)) for k, p in sorted(patterns.items())]))
