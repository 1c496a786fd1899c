"""Quality rules: learned decision lists over text statistics.

One pass computes a row of statistics per document. From labelled rows, sequential covering grows
conjunctions of thresholds by information gain on two thirds of the rows, prunes each on the rest,
removes what it covers and goes on while a rule is right more often than not. The list becomes an
ordered Spark ``when`` chain over the statistics, so its verdicts are readable and run in the JVM.

Fitting takes at most MAX_ROWS labelled rows (the first by a hash of their id, outside the held-out
fold) of a dozen numbers each to the driver; statistics cover every whole text.

Defined results: a null text has no words; documents of under 50 words, or with over half of their
words in repeated 3-word windows, fail whatever the list says; without labels of both classes the
list is empty and keeps all else; of several labels of a document the largest counts; repeated rows
get the same verdict; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sinkweave.llm.common import cut
from sinkweave.llm.toxicity import held_out

MAX_ROWS = 20_000
MIN_WORDS = 50
WINDOW = 3
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_exclaim")
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_DIGIT = bytes(range(ord("0"), ord("9") + 1))


def statistics_of(text: str | None) -> tuple[int, ...]:
    """The counts of _COUNTS for one text."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    n = len(words)
    repeat = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        twice = {w for w, k in Counter(windows).items() if k > 1}
        last = -1  # the last word counted
        for at, w in enumerate(windows):
            if w in twice:
                repeat += at + WINDOW - 1 - max(last, at - 1)
                last = at + WINDOW - 1
    return (
        n,
        len(text) - sum(map(text.count, _SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat,
        len(lines),
        len(set(words)),
        len(data) - len(data.translate(None, _UPPER)),
        len(data) - len(data.translate(None, _DIGIT)),
        text.count("!"),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts, one row per document."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([statistics_of(t) for t in texts], columns=list(_COUNTS))

    made = F.pandas_udf(run, ", ".join(f"{c} long" for c in _COUNTS))("text")
    return docs.select("doc_id", made.alias("s")).select("doc_id", "s.*")


def features() -> dict[str, Column]:
    """What rules may test: sizes and shares."""
    per_word = {c: F.col(c) / F.greatest("n_words", F.lit(1)) for c in ("n_symbols", "n_repeat_words", "n_distinct", "n_exclaim", "word_chars")}
    per_char = {c: F.col(c) / F.greatest("word_chars", F.lit(1)) for c in ("n_upper", "n_digits")}
    own = {"words": F.col("n_words").cast("double"), "dup_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), "words_per_line": F.col("n_words") / F.greatest("n_lines", F.lit(1))}
    return own | {f"{c}_per_word": e for c, e in per_word.items()} | {f"{c}_per_char": e for c, e in per_char.items()}


@dataclass(frozen=True)
class Test:
    feature: str
    at_least: bool
    threshold: float

    def rows(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.at_least else x[self.feature] < self.threshold

    def column(self, exprs: dict[str, Column]) -> Column:
        return exprs[self.feature] >= self.threshold if self.at_least else exprs[self.feature] < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


def _covered(rule: list[Test], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for t in rule:
        out &= t.rows(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int = 4) -> list[Test]:
    """Adds the test with the highest information gain until no good row is left inside."""
    rule: list[Test] = []
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < most and (~bad[inside]).any():
        p, n = bad[inside].sum(), (~bad[inside]).sum()
        base, best = np.log2(max(p, 1e-9) / (p + n)), (0.0, None)
        for name, values in x.items():
            v, y = values[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            edge = np.flatnonzero(v[1:] > v[:-1]) + 1
            if not len(edge):
                continue
            below = np.cumsum(y)[edge - 1]
            for at_least, pos, size in ((False, below, edge), (True, p - below, len(v) - edge)):
                gain = pos * (np.log2(np.maximum(pos, 1e-9) / size) - base)
                k = int(gain.argmax())
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), Test(name, at_least, float((v[edge[k]] + v[edge[k] - 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].rows(x)
    return rule


def _worth(rule: list[Test], x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    inside = _covered(rule, x, len(bad))
    p, n = bad[inside].sum(), (~bad[inside]).sum()
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: dict[str, np.ndarray], bad: np.ndarray, most: int = 12) -> list[list[Test]]:
    """An ordered list of rules for rejecting; deterministic in the order of the rows."""
    rules: list[list[Test]] = []
    left = np.ones(len(bad), dtype=bool)
    while len(rules) < most and bad[left].sum() >= 5 and (~bad[left]).any():
        at = np.flatnonzero(left)
        grow, prune = at[np.arange(len(at)) % 3 > 0], at[np.arange(len(at)) % 3 == 0]
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow])
        held = {k: v[prune] for k, v in x.items()}
        options = [rule[:k] for k in range(1, len(rule) + 1)]
        rule = max(options, key=lambda r: (_worth(r, held, bad[prune]), -len(r)), default=[])
        if not rule or _worth(rule, held, bad[prune]) <= 0:
            break
        rules.append(rule)
        left &= ~_covered(rule, x, len(bad))
    return rules


def as_column(rules: list[list[Test]]) -> Column:
    """The list as an ordered conditional expression: true keeps."""
    exprs, out = features(), None
    for rule in rules:
        inside = F.lit(True)
        for t in rule:
            inside &= t.column(exprs)
        out = F.when(inside, F.lit(False)) if out is None else out.when(inside, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(stats: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> list[list[Test]]:
    known = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_quality"))
        .orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    )
    rows = (
        stats.join(F.broadcast(known), stats["doc_id"] == known["_id"])
        .select(F.xxhash64("_id").alias("_h"), "_id", "_quality", *[e.alias(k) for k, e in features().items()])
        .distinct().orderBy("_h", "_id", "_quality", *features()).limit(2 * max_rows).toPandas()
    )
    bad = (rows["_quality"] == 0).to_numpy()
    return learn({k: rows[k].to_numpy(dtype=float) for k in features()}, bad) if len(rows) else []


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: the base statistics, base_failed and kept."""
    stats = cut(statistics(docs), "quality-stats")
    rules = fit(stats, labels)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & as_column(rules)).alias("kept"),
    )
