"""How alike two normalized header texts are, from 0 to 1. Scores run in Arrow batches over distinct texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Scorer = Callable[[str, str], float]


def similarity(a: str, b: str) -> float:
    """The best of matching blocks, containment by length, and shared words by the longer text's words."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    scores = [SequenceMatcher(None, a, b).ratio()]
    short, long = sorted((a, b), key=len)
    if short in long:
        scores.append(len(short) / len(long))
    left, right = set(a.split()), set(b.split())
    if left & right:
        scores.append(len(left & right) / max(len(left), len(right)))
    return max(scores)


def label_similarity(a: str, b: str) -> float:
    """A looser score for recognised text: containment counts 0.70 at least, a common start 0.80, shared words by the shorter text's words."""
    score = similarity(a, b)
    if not a or not b or a == b:
        return score
    if min(len(a), len(b)) >= 2:
        if a in b or b in a:
            score = max(score, 0.70)
        if a.startswith(b) or b.startswith(a):
            score = max(score, 0.80)
    left, right = set(a.split()), set(b.split())
    if left & right:
        score = max(score, len(left & right) / min(len(left), len(right)))
    return score


def token_set_similarity(a: str, b: str) -> float:
    """A scorer that order and extra words don't disturb: the best insert-and-delete ratio among both texts' shared words and the shared words with either's own.

    Texts whose words hold all of the other's score 1.
    """
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared, own_a, own_b = (" ".join(sorted(w)) for w in (left & right, left - right, right - left))
    if shared and (not own_a or not own_b):
        return 1.0
    gap = 1 if shared else 0
    whole_a, whole_b = len(shared) + gap + len(own_a), len(shared) + gap + len(own_b)
    # The shared words lead both texts, so the rest decides their distance.
    scores = [1 - indel_distance(own_a, own_b) / (whole_a + whole_b)]
    if shared:
        scores += [2 * len(shared) / (len(shared) + whole) for whole in (whole_a, whole_b)]
    return max(scores)


def indel_distance(a: str, b: str) -> int:
    """How many characters must be inserted or deleted to turn ``a`` into ``b``."""
    row = [0] * (len(b) + 1)
    for x in a:
        above = 0
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], above + 1 if x == y else max(row[j], row[j - 1])
    return len(a) + len(b) - 2 * row[-1]


class Matcher:
    """Candidates (name, normalized text) and what bounds their score with any text; ``scored`` counts those that were worked out.

    Matching blocks cover no more characters than both texts have in common, and shared words are counted by an inverted
    index, so most candidates' bounds lie below the best score found so far; they are scored in the order of their bounds
    until none can win. Other scorers than this module's two have no bound, and score every candidate.
    """

    #: Characters are counted in so many classes, which can only raise a bound.
    CLASSES = 97

    def __init__(self, candidates: Sequence[tuple[str, str]], scorer: Scorer = similarity) -> None:
        self.candidates, self.scorer, self.scored = list(candidates), scorer, 0
        self.length = np.array([len(c) for _, c in self.candidates], np.int64)
        self.letters = np.array([self._counts(c) for _, c in self.candidates], np.int32).reshape(-1, self.CLASSES)
        words = [set(c.split()) for _, c in self.candidates]
        self.n_words = np.array([len(w) for w in words], np.int64)
        self.holders: dict[str, list[int]] = {}
        for i, each in enumerate(words):
            for w in each:
                self.holders.setdefault(w, []).append(i)

    def _counts(self, text: str) -> np.ndarray:
        out = np.zeros(self.CLASSES, np.int32)
        for c, n in Counter(text).items():
            out[ord(c) % self.CLASSES] += n
        return out

    def bounds(self, text: str) -> np.ndarray:
        """No candidate scores more."""
        if self.scorer not in (similarity, label_similarity):
            return np.ones(len(self.candidates))
        common = np.minimum(self.letters, self._counts(text)).sum(axis=1)
        bound = 2 * common / np.maximum(self.length + len(text), 1)
        mine = set(text.split())
        shared = np.zeros(len(self.candidates), np.int64)
        for w in mine:
            np.add.at(shared, self.holders.get(w, []), 1)
        sides = np.minimum if self.scorer is label_similarity else np.maximum
        bound = np.maximum(bound, shared / np.maximum(sides(self.n_words, len(mine)), 1))
        if self.scorer is label_similarity:
            # One may hold the other only if the longer has all of the shorter's characters.
            bound = np.where(common >= np.minimum(self.length, len(text)), np.maximum(bound, 0.80), bound)
        return bound

    def best(self, text: str) -> tuple[str | None, float]:
        """(name, score) of the first candidate with the highest score; no name at 0."""
        top, at = 0.0, -1
        if text:
            bound = self.bounds(text)
            for i in np.argsort(-bound, kind="stable").tolist():
                if bound[i] < top - 1e-12:
                    break
                score = self.scorer(text, self.candidates[i][1])
                self.scored += 1
                if score > top or score == top and score > 0 and i < at:
                    top, at = score, i
        return (self.candidates[at][0] if at >= 0 else None), top


def similarity_of(a: Column, b: Column, scorer: Scorer = similarity) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        pairs = list(zip(x.fillna(""), y.fillna(""), strict=True))
        return pd.Series([known[p] if p in known else known.setdefault(p, scorer(*p)) for p in pairs], dtype="float64")

    return run(a, b)


def best_match(text: Column, candidates: Sequence[tuple[str, str]], scorer: Scorer = similarity) -> Column:
    """struct<name string, score double>: of ``candidates`` (name, normalized text) the first with the highest score; name is null at 0."""

    @F.pandas_udf("name string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher, known = Matcher(candidates, scorer), {}
        for x in batches:
            for t in x.fillna("").unique():
                if t not in known:
                    known[t] = matcher.best(t)
            yield pd.DataFrame([known[t] for t in x.fillna("")], columns=["name", "score"])

    return run(text)


def best_of(text: Column, names: Column, scorer: Scorer = similarity) -> Column:
    """struct<name string, score double>: of the names (normalized, an array) that stand beside a text the first with the highest score; name is null at 0."""

    @F.pandas_udf("name string, score double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        # Few lists stand beside many texts; what a list's candidates share is worked out once a batch.
        for x, lists in batches:
            matchers: dict[tuple[str, ...], Matcher] = {}
            found = []
            for t, each in zip(x.fillna(""), map(tuple, lists), strict=True):
                if each not in matchers:
                    matchers[each] = Matcher([(n, n) for n in each], scorer)
                found.append(matchers[each].best(t))
            yield pd.DataFrame(found, columns=["name", "score"])

    return run(text, names)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """A built-in relative of ``similarity``: one less the edit distance over the longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(1 - F.levenshtein(a, b) / longest)
