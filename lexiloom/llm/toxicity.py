"""Toxicity by weak supervision.

Lexicons are mined from at most ``most`` labelled training rows of each class (a documented bound):
words and word beginnings that stand in toxic documents and hardly in others. They are dealt
into many voters, beside fixed pattern voters. A generative label model (two latent classes,
fitted by EM) estimates how often each voter speaks in either class and how votes depend on one
another inside the classes, along a tree of pairs; the sampled rows' labels are one more voter to it,
whose errors it estimates like the others'. Its posterior labels train a linear
classifier on terms and votes, which scores every document in one map without a shuffle. Only
the text is an input of the score.

Edge cases: null and empty texts have no terms and get the classifier's score for none; without
labels only the fixed voters are left; repeated rows are scored each; an empty table gives no
rows; further columns are carried on by ``keep`` and ignored by ``score``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, lean, release, stored, texts
from .labelled import training_texts

#: Plain insults of general English.
INSULTS = frozenset("idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting clown imbecile dumb".split())
PREFIXES = (4, 5, 7)
EDGES = ".,;:!?\"'()[]{}*#$%&|<>-_"
_PATTERNS = [re.compile(p) for p in (r"\b(you|ur|u) (are|r) (a|an|such|so)\b", r"\b(shut up|go away|get lost)\b", r"\w\*{2,}\w?", r"(!\s?){3,}")]
#: Lexicon voters of each kind of term, and voters in all: lexicons, insults, patterns, two or more terms.
DEALT = 5
VOTERS = DEALT * (1 + len(PREFIXES)) + 1 + len(_PATTERNS) + 1


def terms(text: str) -> set[str]:
    """Words in lower case without marks at their edges, and their beginnings as ``k^...``."""
    words = {w.strip(EDGES) for w in set(text.lower().split())}
    words.discard("")
    return words.union(f"{k}^{w[:k]}" for k in PREFIXES for w in words if len(w) >= k)


def kind(term: str) -> int:
    return 1 + PREFIXES.index(int(term[0])) if term[1:2] == "^" and term[0].isdigit() and int(term[0]) in PREFIXES else 0


class Model:
    """Lexicon (term -> index), voters and linear weights."""

    def __init__(self, lexicon: list[str]):
        self.index = {t: i for i, t in enumerate(lexicon)}
        self.voter = np.array([kind(t) * DEALT + i % DEALT for i, t in enumerate(lexicon)], np.int64)
        self.weights = np.zeros(len(lexicon) + VOTERS)
        self.weights[len(lexicon) + DEALT * (1 + len(PREFIXES))] = 6.0
        self.bias = -4.0
        self.memo: dict[str, tuple[int, ...]] = {}

    def found(self, text: str) -> list[int]:
        """Indices of lexicon terms and, after them, of voters that speak."""
        out: set[int] = set()
        memo, insult = self.memo, False
        for raw in set(text.lower().split()):
            hit = memo.get(raw)
            if hit is None:
                if len(memo) > 60_000:
                    memo.clear()
                w = raw.strip(EDGES)
                keys = [w, *(f"{k}^{w[:k]}" for k in PREFIXES if len(w) >= k)] if w else []
                hit = tuple(self.index[k] for k in keys if k in self.index)
                if w in INSULTS:
                    hit += (-1,)
                memo[raw] = hit
            out.update(hit)
        if -1 in out:
            insult = True
            out.discard(-1)
        n, base = len(self.index), DEALT * (1 + len(PREFIXES))
        votes = {int(self.voter[i]) for i in out}
        if insult:
            votes.add(base)
        low = text.lower()
        votes.update(base + 1 + i for i, p in enumerate(_PATTERNS) if p.search(low))
        if len(out) >= 2:
            votes.add(VOTERS - 1)
        return sorted(out) + [n + v for v in sorted(votes)]

    def proba(self, values) -> np.ndarray:
        raw = np.array([self.bias + self.weights[self.found(t or "")].sum() for t in values], np.float64)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))

    def __getstate__(self):
        return {**self.__dict__, "memo": {}}


def tree_of(pairs: np.ndarray, least: float) -> np.ndarray:
    """Parent of each voter in the tree of greatest total information, Prim's way; -1 for roots, which are
    those whose best pair has less than ``least``."""
    v = len(pairs)
    parent = np.full(v, -1)
    best, near = pairs[0].copy(), np.zeros(v, np.int64)
    inside = np.zeros(v, bool)
    inside[0] = True
    for _ in range(v - 1):
        i = int(np.where(inside, -np.inf, best).argmax())
        parent[i], inside[i] = near[i] if best[i] >= least else -1, True
        closer = pairs[i] > best
        best, near = np.where(closer, pairs[i], best), np.where(closer, i, near)
    return parent


class LabelModel:
    """Two latent classes, in each of which the voters' votes depend on one another along a tree.

    ``rates`` [2, voters]: how often each voter speaks in a class. ``parent`` and ``given`` [2, 2, voters]: how often
    it speaks in a class when its parent is silent or speaks; the tree holds the pairs that share most
    information inside the classes, so voters that repeat each other count about once. All are fitted by EM.
    """

    def __init__(self, v: int):
        self.prior, self.rates = 0.5, np.full((2, v), 0.5)
        self.parent, self.given = np.full(v, -1), np.full((2, 2, v), 0.5)

    def fit(self, x: np.ndarray, post: np.ndarray, least: float) -> None:
        """Parameters from votes and the posterior of the toxic class; pairs share ``least`` nats a row."""
        self.prior = float(np.clip(post.mean(), 0.02, 0.98))
        mass = (1 - post, post)
        both = [(x * p[:, None]).T @ x for p in mass]
        total = [p.sum() for p in mass]
        for y in (0, 1):
            self.rates[y] = (np.diag(both[y]) + 0.5 * (0.2 if y else 0.02)) / (total[y] + 0.5)
        self.rates = np.clip(self.rates, 1e-4, 1 - 1e-4)
        self.rates[1] = np.maximum(self.rates[1], self.rates[0])  # a voter speaks for the toxic class only
        info = np.zeros((x.shape[1], x.shape[1]))
        for y in (0, 1):
            p1 = np.diag(both[y]) / max(total[y], 1e-9)
            p11 = both[y] / max(total[y], 1e-9)
            cells = ((p11, p1[:, None] * p1), (p1[:, None] - p11, p1[:, None] * (1 - p1)), (p1 - p11, (1 - p1)[:, None] * p1), (1 - p1[:, None] - p1 + p11, (1 - p1)[:, None] * (1 - p1)))
            info += total[y] * sum(np.where(a > 1e-9, a * np.log(np.maximum(a, 1e-12) / np.maximum(b, 1e-12)), 0) for a, b in cells)
        np.fill_diagonal(info, -np.inf)
        self.parent = tree_of(info, least * len(x))
        strength = 4.0  # rows that the voter's own rate weighs beside the pair's counts
        for y in (0, 1):
            own = np.diag(both[y])
            spoke = both[y][self.parent, np.arange(len(own))]
            parent_spoke = own[self.parent]
            for k, (n, d) in enumerate(((own - spoke, total[y] - parent_spoke), (spoke, parent_spoke))):
                self.given[y, k] = np.clip((n + strength * self.rates[y]) / (d + strength), 1e-4, 1 - 1e-4)
        root = self.parent < 0
        for y in (0, 1):
            self.given[y][:, root] = self.rates[y][root]

    def posterior(self, x: np.ndarray) -> np.ndarray:
        above = x[:, self.parent].astype(bool)
        logit = np.full(len(x), np.log(self.prior / (1 - self.prior)))
        for y, sign in ((1, 1), (0, -1)):
            p = np.where(above, self.given[y, 1], self.given[y, 0])
            logit += sign * np.where(x > 0, np.log(p), np.log(1 - p)).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def label_model(votes: np.ndarray, said: np.ndarray | None = None, rounds: int = 50) -> tuple[np.ndarray, LabelModel]:
    """Posterior of the toxic class and the fitted model.

    said: labels of the rows, which vote too. Their rates in the classes are fitted like the others', but stay
    at least 0.9 and at most 0.05, so that the classes are the ones that the labels mean; they depend on no
    other voter. Without labels the tree could take over what the classes should explain, so then it keeps only
    pairs that share 0.1 nats a row.
    """
    n, v = votes.shape
    x, model = votes.astype(np.float64), LabelModel(v)
    if not n:
        return np.zeros(0), model
    if said is None:  # rare votes say more; at first the class is split at the mean of what the votes say
        weight = x @ -np.log(np.clip(x.mean(0), 1e-3, 0.999))
        post = np.clip(0.5 + 0.45 * np.sign(weight - weight.mean()), 0.05, 0.95)
    else:
        post = np.where(said, 0.95, 0.05)
    for _ in range(rounds):
        model.fit(x, post, 0.1 if said is None else 0.0)
        new = model.posterior(x)
        if said is not None:
            hit, miss = max(0.9, float(post[said].sum() / post.sum())), min(0.05, float((1 - post)[said].sum() / (1 - post).sum()))
            odds = new / (1 - new) * np.where(said, hit / max(miss, 1e-3), (1 - min(hit, 0.999)) / (1 - miss))
            new = odds / (1 + odds)
        done = np.abs(new - post).max() < 1e-6
        post = new
        if done:
            break
    return post, model


def linear(rows: np.ndarray, cols: np.ndarray, n: int, width: int, target: np.ndarray, steps: int = 400, rate: float = 0.5, l2: float = 1e-4):
    """Logistic regression on indicators in coordinate form, by full gradients with Adagrad."""
    w, b = np.zeros(width), 0.0
    gw, gb = np.full(width, 1e-8), 1e-8
    for _ in range(steps):
        raw = b + np.bincount(rows, w[cols], n)
        err = target - 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        g = np.bincount(cols, err[rows], width) / n - l2 * w
        gw, gb = gw + g * g, gb + err.mean() ** 2
        w, b = w + rate * g / np.sqrt(gw), b + rate * err.mean() / np.sqrt(gb)
    return w, b


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", most: int = 10_000, most_terms: int = 20_000, least: int = 3, precision: float = 0.9, **folds) -> Model:
    sample = stored(training_texts(docs, labels, column, most, **folds))

    def count(which, among=None):
        def run(frames):
            seen: Counter = Counter()
            for pdf in frames:
                for t in pdf["text"]:
                    found = terms(t)
                    seen.update(found if among is None else found & among)
            if seen:
                yield pd.DataFrame({"term": list(seen), "n": list(seen.values())})

        rows = sample.where(F.col("y") == which).mapInPandas(lean(run), "term string, n long")
        return rows.groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= (least if among is None else 1))

    toxic = {r["term"]: r["n"] for r in count(1).orderBy(F.desc("n"), "term").limit(5 * most_terms).collect()}
    clean = {r["term"]: r["n"] for r in count(0, frozenset(toxic)).collect()}
    size = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n1, n0 = max(1, size.get(1, 0)), max(1, size.get(0, 0))
    share = {t: (c / n1) / (c / n1 + (clean.get(t, 0) + 0.5) / n0) for t, c in toxic.items()}
    best = sorted((t for t in toxic if share[t] >= precision), key=lambda t: (-toxic[t] * share[t], t))[:most_terms]
    model = Model(best)
    if not best:
        return model

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"y": pdf["y"], "found": [model.found(t) for t in pdf["text"]]})

    known = sample.select("y", "text").mapInPandas(lean(run), "y int, found array<int>").toPandas()
    said, found = zip(*sorted(zip(known["y"], map(tuple, known["found"]), strict=True)), strict=True)
    rows = np.repeat(np.arange(len(found)), list(map(len, found)))
    cols = np.array([c for f in found for c in f], np.int64)
    votes = np.zeros((len(found), VOTERS), bool)
    spoke = cols >= len(best)
    votes[rows[spoke], cols[spoke] - len(best)] = True
    post, _ = label_model(votes, np.array(said, bool))
    model.weights, model.bias = linear(rows, cols, len(found), len(best) + VOTERS, post)
    return model


def score_column(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in parts:
            yield pd.Series(model.proba(values), index=values.index)
        model.memo.clear()
        release()

    return score(text)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted``."""
    model = train(docs, labels, **options)
    scored = texts(docs).select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns."""
    model = train(docs, labels, **options)
    return docs.where(score_column(model, F.coalesce(F.col("text").cast("string"), F.lit(""))) < threshold)
