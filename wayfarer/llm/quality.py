"""Quality classifier: a sparse ensemble of rules over text statistics, compiled to Spark columns.

Trees are grown on a bounded labelled sample; every path from a root to a node is a conjunctive rule over statistics. A
logistic model with a lasso penalty weighs the rules and drops most of them. What is left is one Spark expression per
rule, so scoring is a projection without Python that reads each whole text once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, id_bucket, spool

#: Labelled rows that the model is fitted on, at most; chosen by a hash of the id.
SAMPLE = 8_000
#: One fold in three is held out.
FOLDS, HELD_OUT = 3, 1
TREES, DEPTH, CUTS, LEAF = 60, 3, 24, 20
PENALTY = 2e-3


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of one whole text. ``text`` must not be null; an empty text has 0 everywhere."""
    n = F.length(text)
    per = lambda x: F.when(n > 0, x / F.greatest(n, F.lit(1))).otherwise(F.lit(0.0))
    left = lambda pattern: n - F.length(F.regexp_replace(text, pattern, ""))
    one = lambda c: n - F.length(F.replace(text, F.lit(c), F.lit("")))
    words = F.split(text, r"\s+")
    lines = F.split(text, "\n")
    share = lambda a: F.size(F.array_distinct(a)) / F.greatest(F.size(a), F.lit(1))
    spaces = one(" ")
    return {
        "log_length": F.log1p(n.cast("double")),
        "upper": per(left("[A-Z]+")),
        "marks": per(left(r"[^\p{L}\p{N}\s.,]+")),
        "stops": per(left("[.,]+")),
        "digits": per(left("[0-9]+")),
        "bars": per(one("|")),
        "bangs": per(one("!")),
        "line_ends": per(one("\n")),
        "spaces": per(spaces),
        "word_length": n / (spaces + F.lit(1)),
        "distinct_words": share(words),
        "distinct_lines": share(lines),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of ``(statistic, threshold, at most)``: ``at most`` says on which side of the threshold it holds."""

    parts: tuple[tuple[str, float, bool], ...]

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, cut, below in self.parts:
            column = x[:, names.index(name)]
            out &= (column <= cut) if below else (column > cut)
        return out

    def column(self) -> Column:
        out = None
        for name, cut, below in self.parts:
            one = F.col(f"stats.{name}") <= cut if below else F.col(f"stats.{name}") > cut
            out = one if out is None else out & one
        return out.cast("double")


@dataclass
class RuleEnsemble:
    """Rules with their weights; the score is the logistic function of ``bias`` plus the weights of the rules that hold."""

    bias: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self) -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + rule.column() * F.lit(weight)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(x: np.ndarray, residual: np.ndarray, rows: np.ndarray, depth: int, names, cuts, rng, path, out) -> None:
    """Adds the rules of a regression tree on ``residual`` to ``out``."""
    if path:
        out.add(Rule(tuple(path)))
    if depth == 0 or len(rows) < 2 * LEAF:
        return
    y = residual[rows]
    best, mean = (1e-9, None), y.mean()
    for f in rng.choice(len(names), max(2, len(names) * 2 // 3), replace=False):
        column = x[rows, f]
        for c in cuts[f]:
            low = column <= c
            n = int(low.sum())
            if LEAF <= n <= len(rows) - LEAF:
                m = y[low].mean() - mean
                gain = n * m * m * len(rows) / (len(rows) - n)
                if gain > best[0]:
                    best = (gain, (f, c, low))
    if best[1] is None:
        return
    f, c, low = best[1]
    for side, below in ((rows[low], True), (rows[~low], False)):
        _grow(x, residual, side, depth - 1, names, cuts, rng, [*path, (names[f], float(c), below)], out)


def _tree_rules(x: np.ndarray, y: np.ndarray, names: list[str], seed: int) -> list[Rule]:
    """The rules of gradient-boosted trees, each grown on a random half of the rows."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, CUTS))) for f in range(len(names))]
    raw, rules = np.zeros(len(y)), []
    for _ in range(TREES):
        rows = rng.permutation(len(y))[: max(2 * LEAF, len(y) // 2)]
        fresh: set[Rule] = set()
        residual = y - 1 / (1 + np.exp(-raw))
        _grow(x, residual, rows, DEPTH, names, cuts, rng, [], fresh)
        fresh_list = sorted(fresh, key=repr)
        rules += fresh_list
        for rule in (r for r in fresh_list if len(r.parts) == DEPTH or len(fresh_list) <= 2):
            hit = rule.holds(x, names)
            if hit.any():
                raw[hit] += 0.3 * np.clip(4 * residual[hit].mean(), -2, 2)
    return sorted(set(rules), key=repr)


def _lasso(h: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Lasso logistic regression by accelerated proximal gradient steps; the bias is not penalised."""
    n, k = h.shape
    w, z, b, c, t = np.zeros(k), np.zeros(k), 0.0, 0.0, 1.0
    total = weight.sum()
    size = 4.0 / max(1e-9, float(np.linalg.norm(h * np.sqrt(weight / total)[:, None], 2)) ** 2 + 1.0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(h @ z + c)))
        g = weight * (p - y) / total
        nw = z - size * (h.T @ g)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - size * penalty, 0)
        nb = c - size * g.sum()
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return b, w


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], penalty: float = PENALTY, seed: int = 0) -> RuleEnsemble:
    """Fits a rule ensemble to 0/1 labels ``y``. With one label only, or none, the score is a constant."""
    if len(y) == 0:
        return RuleEnsemble(0.0)
    if y.min() == y.max():
        return RuleEnsemble(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    rules = _tree_rules(x, y, names, seed)
    seen: dict[bytes, int] = {}
    columns = []
    for i, rule in enumerate(rules):  # rules that hold on the same rows are one rule
        hit = rule.holds(x, names)
        if 0 < hit.sum() < len(y) and seen.setdefault(hit.tobytes(), i) == i:
            columns.append((rule, hit))
    if not columns:
        return RuleEnsemble(float(np.log(y.mean() / (1 - y.mean()))))
    h = np.stack([hit for _, hit in columns], 1).astype(float)
    bias, w = _lasso(h, y, np.ones(len(y)), penalty)
    return RuleEnsemble(float(bias), [(r, float(v)) for (r, _), v in zip(columns, w, strict=True) if abs(v) > 1e-3])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = SAMPLE,
) -> RuleEnsemble:
    """Fits on at most ``sample`` labelled documents outside the held-out fold, chosen by a hash of the id.

    Labels other than 0 and 1 and rows without an id are left out; of several labels of one id the smallest counts.
    """
    chosen = (
        labels.select(F.col(id_col).cast("long").alias("label_id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & (id_bucket(F.col("label_id"), FOLDS) != HELD_OUT))
        .groupBy("label_id")
        .agg(F.min("label").alias("label"))
    )
    chosen = hash_sample(spool(chosen), sample // 2, "label_id")
    rows = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .join(F.broadcast(chosen), F.col("id") == F.col("label_id"))
        .select("label", F.struct(*(c.cast("double").alias(k) for k, c in statistics(F.col("text")).items())).alias("stats"))
    )
    data = rows.select("label", "stats.*").toPandas()
    names = [c for c in data.columns if c != "label"]
    data = data.sort_values([*names, "label"])  # the order in which rows arrive makes no difference
    return fit_rules(data[names].to_numpy(float), data["label"].to_numpy(float), names)


def _scored(docs: DataFrame, model: RuleEnsemble, text_col: str) -> DataFrame:
    """``(row, score)``; the row travels as one column, so no name of it meets a name used here."""
    stats = F.struct(*(c.cast("double").alias(k) for k, c in statistics(F.coalesce(F.col(text_col), F.lit(""))).items()))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    # Taken out of an array of one, the statistics are a column of their own: a filter on the score is not pushed below
    # it, where each rule would compute its statistics again.
    return docs.select(row.alias("row"), F.explode(F.array(stats)).alias("stats")).select("row", model.score().alias("score"))


def score(docs: DataFrame, model: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` of every row: one projection over whole texts. A null text counts as empty.

    Repeated rows each give a row, a null id stays null, and an empty table gives no rows.
    """
    scored = _scored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), model, "text")
    return scored.select("row.doc_id", "score")


def accept(docs: DataFrame, model: RuleEnsemble, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more."""
    return _scored(docs, model, text_col).where(F.col("score") >= least).select("row.*")
