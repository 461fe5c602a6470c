"""Quality rules: an isolation forest over rule statistics.

Each text gives counts (words, their code points, symbols, repeated lines, words in
repeated three-word windows); a hard rule rejects texts that are too short or too
repetitive. The rest is judged by an isolation forest over ratios of these counts, each as far
as it goes beyond what labelled good rows have (USUAL): trees
split a sample of rows at random, rows that few splits isolate are anomalous. Each
tree takes `tree_rows` rows, as the method has it, so the forest is fitted on at most
n_trees * tree_rows rows, drawn by a seeded hash; every document is scored. What is usual
and the score above which a row is rejected come from all labelled rows: bounds are exact
quantiles, the threshold is that of the largest (rejected bad share - rejected good share)
that rejects at most `good_loss` of the good rows. Labelled rows stay on the executors.

Defined results: a null or empty text has no words and fails the hard rule; without
labels of both classes no row is rejected by the forest; equal rows get equal verdicts;
an empty table gives an empty result; further columns of any name are carried.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, packed, seeded, table

N_TREES, TREE_ROWS, GOOD_LOSS = 100, 256, 0.005
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(set(range(256)) - set(_SYMBOLS))
_CONTINUATION = bytes(range(0x80, 0xC0))
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows found twice or more in the text, the first finding included."""
    n = len(words)
    if n < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    with np.errstate(over="ignore"):
        # 64-bit window codes: mixed, so that equal sums of hashes are a matter of 2**-64
        w = h[:-2] * np.uint64(0x9E3779B97F4A7C15)
        w = (w ^ (w >> np.uint64(29))) + h[1:-1] * np.uint64(0xBF58476D1CE4E5B9)
        w = (w ^ (w >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + h[2:]
    order = np.sort(w)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.searchsorted(twice, w)
    found = twice[np.minimum(at, len(twice) - 1)] == w
    marked = np.zeros(n, bool)
    marked[:-2] |= found
    marked[1:-1] |= found
    marked[2:] |= found
    return int(marked.sum())


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: at ASCII white space alone
    if not words:
        return 0, 0, 0, 0, 0
    chars = len(raw.translate(None, _CONTINUATION + b" \t\n\x0b\x0c\r"))
    symbols = len(raw.translate(None, _NOT_SYMBOLS))
    held = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(words), chars, symbols, len(held) - len(set(held)), repeated_words(words)


def stats_of(text: str) -> Column:
    """Struct of STATS of a text column."""

    @F.pandas_udf(", ".join(f"{c} long" for c in STATS))
    def counted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_stats(t) for t in texts], columns=STATS).astype("int64")

    return counted(text)


def running(rows: DataFrame, by: list[str], key: str, counts: list[str]) -> DataFrame:
    """rows, one for each value of key within by, with the sums of counts up to each, its own included (<count>_to).

    Ranges of keys are written; their totals, a row a range, give what lies before a range, a window sums inside it.
    """
    ranges = materialise(rows.repartitionByRange(*by, key).withColumn("_range", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = ranges.groupBy(*by, "_range").agg(*[F.sum(c).alias(c) for c in counts])
    before = totals.select(*by, "_range", *[(F.sum(c).over(earlier) - F.col(c)).alias(f"_before_{c}") for c in counts])
    inside = Window.partitionBy(*by, "_range").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [(F.sum(c).over(inside) + F.col(f"_before_{c}")).alias(f"{c}_to") for c in counts]
    return ranges.join(F.broadcast(before), [*by, "_range"]).select(*rows.columns, *sums)


def quantiles(rows: DataFrame, n: int, shares: list[float]) -> dict[str, list[float]]:
    """Quantiles of `value` for each `rule` of rows (rule, value, n: how many have it), n in all for each; interpolated as np.quantile does."""
    at = [(n - 1) * q for q in shares]
    ranks = {min(int(a) + i, n - 1) for a in at for i in (0, 1)}
    held = reduce(or_, [(F.col("n_to") - F.col("n") <= r) & (F.col("n_to") > r) for r in sorted(ranks)])
    out = {}
    for rule, found in running(rows, ["rule"], "value", ["n"]).where(held).toPandas().groupby("rule"):
        value = {r: v for v, k, to in zip(found["value"], found["n"], found["n_to"], strict=True) for r in ranks if to - k <= r < to}
        out[rule] = [float(np.quantile([value[int(a)], value[min(int(a) + 1, n - 1)]], a - int(a))) for a in at]
    return out


#: What is usual reaches MARGIN times as far from the median of the labelled good rows as this share of them; rules look at what goes beyond it.
USUAL, MARGIN = 0.999, 2.0


def _shares(stats: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, repeated words and repeated lines a word, and the mean length of words."""
    n = np.maximum(stats["n_words"].to_numpy(float), 1)
    return tuple(stats[c].to_numpy(float) / n for c in ("n_symbols", "n_repeat_words", "n_dup_lines", "word_chars"))


@dataclass
class Usual:
    """Bounds of good rows: the most repeated words and lines a word, the least and largest mean length of words."""

    words: float = 0.0
    lines: float = 0.0
    short: float = 0.0
    long: float = float("inf")

    @classmethod
    def of(cls, good: DataFrame, n: int) -> Usual:
        """From rows of STATS, `good` good rows with each, n in all."""
        if not n:
            return cls()
        shares = [F.struct(F.lit(c).alias("rule"), (F.col(c) / F.greatest("n_words", F.lit(1))).alias("value")) for c in ("n_repeat_words", "n_dup_lines", "word_chars")]
        values = good.where(F.col("good") > 0).select(F.explode(F.array(*shares)).alias("_s"), "good").groupBy("_s.rule", "_s.value").agg(F.sum("good").alias("n"))
        found = quantiles(values, n, [0.5, USUAL, 1 - USUAL])
        reach = lambda rule, i: found[rule][0] + MARGIN * (found[rule][i] - found[rule][0])
        return cls(reach("n_repeat_words", 1), reach("n_dup_lines", 1), reach("word_chars", 2), reach("word_chars", 1))


def features(stats: pd.DataFrame, usual: Usual) -> np.ndarray:
    """Rule statistics, all one-sided (0 is usual), so that what is unlike the rest is worse than the rest."""
    symbols, words, lines, length = _shares(stats)
    length = np.log(np.maximum(length, 1e-9))
    high = np.maximum(0, length - np.log(usual.long)) if np.isfinite(usual.long) else np.zeros(len(length))
    low = np.maximum(0, np.log(usual.short) - length) if usual.short > 0 else np.zeros(len(length))
    return np.column_stack([np.log1p(100 * symbols), np.maximum(0, words - usual.words), np.maximum(0, lines - usual.lines), high, low])


def _harmonic_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.maximum(np.asarray(n, float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays [tree, node]: feature (-1: leaf), cut, left child (right: left + 1), path length at a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    path: np.ndarray
    norm: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / normal path): towards 1 for rows that few splits isolate."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            while True:
                f = self.feature[t][node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] >= self.cut[t][node]
                node = np.where(inner, self.left[t][node] + right, node)
            total += self.path[t][node]
        return np.exp2(-total / max(len(self.feature), 1) / self.norm) if len(self.feature) else np.zeros(len(x))


def grow(x: np.ndarray, n_trees: int, tree_rows: int, seed: int) -> Forest:
    """Trees over consecutive parts of the rows drawn; splits are uniform between a node's least and largest value."""
    rng = np.random.default_rng(seed)
    x = x[rng.permutation(len(x))]
    # a small table serves several trees with the same rows
    parts = [x[np.arange(i * tree_rows, (i + 1) * tree_rows) % len(x)] if len(x) >= tree_rows else x for i in range(n_trees)] if len(x) else []
    depth = int(np.ceil(np.log2(max(tree_rows, 2))))
    size = 2 ** (depth + 1)
    shape = (len(parts), size)
    forest = Forest(np.full(shape, -1, np.int32), np.zeros(shape), np.zeros(shape, np.int32), np.zeros(shape), float(_harmonic_path(min(tree_rows, max(len(x), 2)))) or 1.0)
    for t, rows in enumerate(parts):
        free, todo = 1, [(0, rows, 0)]
        while todo:
            node, part, level = todo.pop()
            spread = np.flatnonzero(part.max(0) > part.min(0))
            if level >= depth or len(part) < 2 or not len(spread):
                forest.path[t, node] = level + _harmonic_path(len(part))
                continue
            f = rng.choice(spread)
            cut = rng.uniform(part[:, f].min(), part[:, f].max())
            right = part[:, f] >= cut
            if not right.any() or right.all():
                right = part[:, f] > part[:, f].min()
                cut = part[right, f].min()
            forest.feature[t, node], forest.cut[t, node], forest.left[t, node] = f, cut, free
            todo += [(free, part[~right], level + 1), (free + 1, part[right], level + 1)]
            free += 2
    return forest


def calibrate(scores: np.ndarray, good: np.ndarray, good_loss: float) -> float:
    """The least score to reject from; infinity if no threshold separates."""
    if good.all() or not good.any():
        return float("inf")
    order = np.argsort(-scores, kind="stable")
    s, g = scores[order], good[order]
    ends = np.flatnonzero(np.append(s[1:] != s[:-1], True))  # rows of one score stay together
    lost, caught = np.cumsum(g)[ends] / g.sum(), np.cumsum(~g)[ends] / (~g).sum()
    gain = np.where(lost <= good_loss, caught - lost, -1)
    best = int(np.argmax(gain))
    if gain[best] <= 0:
        return float("inf")
    below = s[ends[best] + 1] if ends[best] + 1 < len(s) else s[ends[best]]
    return float((s[ends[best]] + below) / 2)


def calibrate_table(rows: DataFrame, good: int, bad: int, good_loss: float) -> float:
    """calibrate over a table: score, and how many good and bad rows have it (good and bad in all)."""
    if not good or not bad:
        return float("inf")
    scores = rows.groupBy("score").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    ranked = running(scores.withColumn("_down", -F.col("score")), [], "_down", ["good", "bad"])
    lost, caught = F.col("good_to") / F.lit(good), F.col("bad_to") / F.lit(bad)
    gain = ranked.where(lost <= good_loss).select("score", (caught - lost).alias("gain")).where("gain > 0")
    best = gain.orderBy(F.desc("gain"), F.desc("score")).first()
    if best is None:
        return float("inf")
    below = ranked.where(F.col("score") < best["score"]).agg(F.max("score")).first()[0]
    return (best["score"] + (best["score"] if below is None else below)) / 2


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


@dataclass
class Rules:
    """The fitted method; its trees (100 of 512 nodes) go along with the functions."""

    forest: Forest
    threshold: float
    usual: Usual

    def verdict(self, *stats: Column) -> Column:
        """Struct of the score and whether the forest keeps a row, from its statistics."""
        forest, threshold, usual = self.forest, self.threshold, self.usual

        @F.pandas_udf("score double, kept boolean")
        def judged(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series) -> pd.DataFrame:
            score = forest.score(features(pd.DataFrame(dict(zip(STATS, (a, b, c, d, e), strict=True))), usual))
            return pd.DataFrame({"score": score, "kept": score < threshold})

        return judged(*stats)


def fit(stats: DataFrame, labels: DataFrame, n_trees: int = N_TREES, tree_rows: int = TREE_ROWS, good_loss: float = GOOD_LOSS, seed: int = 5) -> Rules:
    """stats: _id and STATS of the rows to learn from; labels: doc_id and quality (1 good, 0 bad, null no label)."""
    eligible = stats.where(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    judged = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").alias("_label_id"), (F.col("quality") == 1).cast("long").alias("_good"))
    judged = eligible.join(judged, F.col("_id") == F.col("_label_id")).groupBy(*STATS)
    judged = materialise(judged.agg(F.sum("_good").alias("good"), F.sum(1 - F.col("_good")).alias("bad")), "judged")
    good, bad = (x or 0 for x in judged.agg(F.sum("good"), F.sum("bad")).first())
    usual = Usual.of(judged, good)
    # the trees' rows: about enough by seeded hash, cut to their number after sorting on the driver
    n, rows = max(eligible.count(), 1), n_trees * tree_rows
    drawn = eligible.select(*STATS, seeded(seed, F.col("_id"), *[F.col(c) for c in STATS]).alias("_u")).where(F.col("_u") <= int(min(1.0, (1.2 * rows + 64) / n) * (1 << 53)))
    drawn = drawn.toPandas().sort_values(["_u", *STATS], kind="stable")[:rows]
    forest = grow(features(drawn, usual), n_trees, tree_rows, seed)
    scored = judged.select(Rules(forest, float("inf"), usual).verdict(*[F.col(c) for c in STATS])["score"].alias("score"), "good", "bad")
    return Rules(forest, calibrate_table(scored, good, bad, good_loss), usual)


def op5_isolation_forest(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stats = materialise(docs.select(F.col("doc_id").alias("_id"), stats_of("text").alias("_s")).select("_id", "_s.*"), "stats")
    rules = fit(stats, table(spark, sf_dir, "labels"))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    rows = stats.withColumn("_v", rules.verdict(*[F.col(c) for c in STATS]))
    return rows.select(
        F.col("_id").alias("doc_id"), *STATS, failed.alias("base_failed"), (~failed & F.col("_v.kept")).alias("kept"), F.col("_v.score").alias("anomaly_score")
    )


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents that the rules keep. Rows are written with their statistics, so that texts are counted once."""
    rows = materialise(packed(docs).withColumn("_s", stats_of("_row.text")).select("_row", "_s.*"), "counted")
    rules = fit(rows.select(F.col("_row.doc_id").alias("_id"), *STATS), table(spark, sf_dir, "labels"))
    left = rows.where(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    return left.withColumn("_v", rules.verdict(*[F.col(c) for c in STATS])).where("_v.kept").select("_row.*")
