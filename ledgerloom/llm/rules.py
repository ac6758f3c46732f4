"""Quality rules: decision lists learnt by sequential covering, applied as ordered Spark conditions.

One rule is a conjunction of thresholds on text statistics. It is grown on one part of the labelled sample by adding the
threshold with the most information gain until it covers no good text, cut back from its end on the other part, and kept
if it still is right there; the texts that it covers go, and the next rule is grown. The list becomes one ``CASE WHEN``:
the first rule that holds names the verdict, so a list can be read, edited and run without this module.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.shared import documents
from ledgerloom.llm.textstats import BASE, SHAPE, labelled_sample, with_stats

SAMPLE_ROWS = 20_000
MAX_RULES, MAX_CONDITIONS, CUTS = 12, 4, 64
#: A rule stays if so many texts of the pruning part support it, so purely.
LEAST_COVER, LEAST_PRECISION = 5, 0.9


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value >= threshold, else value <= threshold
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= self.threshold if self.above else c <= self.threshold

    def mask(self, v: np.ndarray) -> np.ndarray:
        return v >= self.threshold if self.above else v <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold!r}"


Rule = tuple[Condition, ...]


def _best(x: np.ndarray, bad: np.ndarray, names: list[str]) -> tuple[float, Condition | None]:
    """The threshold with the highest FOIL gain over the rows given."""
    p0, n0 = bad.sum(), (~bad).sum()
    base, best, found = np.log2(p0 / (p0 + n0)), 1e-9, None
    for j, name in enumerate(names):
        for cut in np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS), method="nearest")):
            for above in (True, False):
                m = x[:, j] >= cut if above else x[:, j] <= cut
                p = (m & bad).sum()
                if p and m.sum() < len(m):
                    gain = p * (np.log2(p / m.sum()) - base)
                    if gain > best:
                        best, found = gain, Condition(name, above, float(cut))
    return best, found


def learn(x: np.ndarray, bad: np.ndarray, names: list[str]) -> list[Rule]:
    """Ordered rules for ``bad`` rows of ``x``; none where nothing can be learnt. Every third row prunes, the others grow."""
    bad = bad.astype(bool)
    prune = np.arange(len(x)) % 3 == 2
    gx, gb, px, pb = x[~prune], bad[~prune], x[prune], bad[prune]
    place = {n: j for j, n in enumerate(names)}

    def covers(rule: Rule, rows: np.ndarray) -> np.ndarray:
        m = np.ones(len(rows), bool)
        for c in rule:
            m &= c.mask(rows[:, place[c.feature]])
        return m

    rules: list[Rule] = []
    while len(rules) < MAX_RULES and gb.any():
        rule: Rule = ()
        rows, b = gx, gb
        while len(rule) < MAX_CONDITIONS and not b.all():
            _, condition = _best(rows, b, names)
            if condition is None:
                break
            m = condition.mask(rows[:, place[condition.feature]])
            rule, rows, b = (*rule, condition), rows[m], b[m]
        if not rule:
            break

        def worth(r: Rule) -> float:
            m = covers(r, px)
            good = (m & ~pb).sum()
            return ((m & pb).sum() - good) / max(m.sum(), 1)

        rule = max((rule[: k + 1] for k in range(len(rule))), key=lambda r: (round(worth(r), 6), covers(r, px).sum()))
        m = covers(rule, px)
        if (m & pb).sum() < LEAST_COVER or (m & pb).sum() < LEAST_PRECISION * m.sum():
            break
        rules.append(rule)
        g = covers(rule, gx)
        gx, gb, px, pb = gx[~g], gb[~g], px[~m], pb[~m]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 0; null if none does (or a statistic is null)."""
    out = None
    for k, rule in enumerate(rules):
        condition = rule[0].column()
        for c in rule[1:]:
            condition = condition & c.column()
        out = F.when(condition, k) if out is None else out.when(condition, k)
    return F.lit(None).cast("int") if out is None else out.cast("int")


def as_sql(rules: list[Rule]) -> str:
    """The list as an SQL expression over the statistics' columns."""
    if not rules:
        return "CAST(NULL AS INT)"
    return "CASE " + " ".join(f"WHEN {' AND '.join(map(str, r))} THEN {k}" for k, r in enumerate(rules)) + " END"


def statistics(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, the base statistics and one column for each shape feature, for every row: zeros for null and empty texts, equal numbers for repeated rows; other columns are ignored."""
    return with_stats(df, key, shape=True).select(key, *BASE, *[F.col("features")[i].alias(n) for i, n in enumerate(SHAPE)])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Learns rules for label 0 from at most ``rows`` labelled training documents; their statistics come to the driver."""
    sample = labelled_sample(docs, labels, label, rows).select(F.struct("doc_id", "y").alias("k"), "text")
    found = with_stats(sample, key="k", shape=True).select("k.doc_id", "k.y", "features").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(found["features"].tolist(), float).reshape(len(found), len(SHAPE))
    return learn(x, found["y"].to_numpy() == 0, list(SHAPE))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rules = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = statistics(docs).withColumns({"base_failed": base_failed(), "rule": verdict(rules)})
    return judged.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")
