"""Scores of predictions: confusion, F1 over label subsets, grids, external vocabularies, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import f1, ratio

# Fixed correspondence of the classes to a wider published vocabulary.
EXTERNAL_OF = {
    "en-US": "North America",
    "en-GB": "English",
    "en-AU": "Oceania",
    "en-IN": "South Asia",
    "L1-Mandarin": "East Asia",
    "L1-Korean": "East Asia",
    "L1-Spanish": "Romance",
    "L1-Arabic": "Semitic",
}


def _domain(df: DataFrame, labels: list[str], name: str) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame([(x,) for x in labels], f"{name} string"))  # labels are the caller's own list


def labels_of(df: DataFrame, *columns: str) -> list[str]:
    """Sorted distinct labels; classes are few."""
    marks = df.select(F.explode(F.array(*columns)).alias("l")).where("l IS NOT NULL").distinct()
    return sorted(r["l"] for r in marks.collect())


def confusion(df: DataFrame, labels: list[str]) -> DataFrame:
    """y_true, y_pred, n for every pair of labels; rows with a label outside are left out."""
    counts = df.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    domain = _domain(df, labels, "y_true").crossJoin(_domain(df, labels, "y_pred"))
    return domain.join(counts, ["y_true", "y_pred"], "left").na.fill(0, ["n"])


def class_scores(df: DataFrame, labels: list[str], by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn and f1 of each label; a prediction outside the labels still misses its true one.

    Rows are counted by (true, predicted) first, so what is expanded by label is a
    table of label pairs.
    """
    by = by or []
    pairs = df.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(
        *by,
        "n",
        F.explode(
            F.array(
                F.struct(F.col("y_true").alias("label"), F.lit(True).alias("is_true"), F.col("y_pred").eqNullSafe(F.col("y_true")).alias("hit")),
                F.struct(F.col("y_pred").alias("label"), F.lit(False).alias("is_true"), F.col("y_pred").eqNullSafe(F.col("y_true")).alias("hit")),
            )
        ).alias("s"),
    ).select(*by, "n", "s.*")
    some = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    counts = sides.groupBy(*by, "label").agg(
        some(F.col("is_true") & F.col("hit")).alias("tp"), some(~F.col("is_true") & ~F.col("hit")).alias("fp"), some(F.col("is_true") & ~F.col("hit")).alias("fn")
    )
    domain = _domain(df, labels, "label")
    if by:
        domain = pairs.select(*by).distinct().crossJoin(domain)
    out = domain.join(counts, [*by, "label"], "left").na.fill(0, ["tp", "fp", "fn"])
    return out.withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))


def macro_f1(df: DataFrame, labels: list[str], by: list[str] | None = None) -> DataFrame:
    """The unweighted mean of the labels' F1, a label never seen counting 0."""
    scores = class_scores(df, labels, by)
    return (scores.groupBy(*by) if by else scores.groupBy()).agg(F.avg("f1").alias("macro_f1"))


def per_source_class_f1(df: DataFrame, source: str = "source") -> DataFrame:
    """F1 for every source and every true label found anywhere."""
    scores = class_scores(df, labels_of(df, "y_true"), [source])
    return scores.select(F.col(source).alias("source"), F.col("label").alias("accent_label"), "f1", (F.col("tp") + F.col("fn")).alias("n_clips"))


def supported_class_report(ood: DataFrame, in_domain: DataFrame, coverage: DataFrame, mask_in_domain: bool = True) -> DataFrame:
    """Macro-F1 over the classes that coverage includes, out of and in domain.

    mask_in_domain: in-domain rows count only if their true label is supported; without
    it, rows of other classes still give false positives.
    """
    flags = coverage.select("accent_label", "include").collect()  # a row a class
    supported = sorted(r["accent_label"] for r in flags if r["include"])
    excluded = sorted(r["accent_label"] for r in flags if not r["include"])
    kept = ood.where(F.col("y_true").isin(*supported)) if supported else ood.where("false")
    known = (in_domain.where(F.col("y_true").isin(*supported)) if supported else in_domain.where("false")) if mask_in_domain else in_domain
    score = lambda df, name: macro_f1(df, supported).withColumnRenamed("macro_f1", name)
    texts = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return (
        score(kept, "supported_class_macro_f1")
        .crossJoin(score(known, "in_domain_supported_class_macro_f1"))  # one row each
        .crossJoin(kept.agg(F.count(F.lit(1)).alias("n_ood_clips")))
        .withColumns({"supported_classes": texts(supported), "excluded_classes": texts(excluded)})
    )


def external(label: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in EXTERNAL_OF.items() for x in kv])[label]


def collapsed_groups(spark) -> DataFrame:
    """External labels that several classes share, with these classes."""
    pairs = spark.createDataFrame(list(EXTERNAL_OF.items()), "accent_label string, external string")
    return pairs.groupBy("external").agg(F.sort_array(F.collect_list("accent_label")).alias("classes")).where(F.size("classes") > 1)


def external_report(df: DataFrame) -> DataFrame:
    """Macro-F1 after both sides are put in the external vocabulary, and the errors that this hides."""
    strange = df.where(external(F.col("y_true")).isNull() | external(F.col("y_pred")).isNull()).limit(1).collect()
    if strange:
        raise KeyError(f"label without an external one: {strange[0]['y_true']!r} or {strange[0]['y_pred']!r}")
    mapped = df.select("y_true", "y_pred", external(F.col("y_true")).alias("t"), external(F.col("y_pred")).alias("p"))
    both = mapped.select(F.col("t").alias("y_true"), F.col("p").alias("y_pred"))
    counts = mapped.agg(F.count(F.lit(1)).alias("n_clips"), F.count_if((F.col("y_true") != F.col("y_pred")) & (F.col("t") == F.col("p"))).alias("n_errors_hidden"))
    return macro_f1(both, labels_of(both, "y_true", "y_pred")).crossJoin(counts)  # one row each


def majority_baseline(train: DataFrame, test: DataFrame, label: str = "accent_label") -> DataFrame:
    """test with y_pred, the commonest label of train (the least on ties)."""
    top = train.agg(F.mode(label, deterministic=True).alias("y_pred"))
    return test.crossJoin(F.broadcast(top))  # one row


def out_of_vocabulary_rate(df: DataFrame, labels: list[str]) -> DataFrame:
    return df.agg(F.avg((~F.coalesce(F.col("y_pred").isin(*labels), F.lit(False))).cast("double")).alias("oov_rate"))


def mean_and_std(scores: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean and population deviation over seeds."""
    return scores.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def budget_alignment(runs: DataFrame) -> DataFrame:
    """One row over runs (arm, seed, total_steps, shared_config_hash): whether protocol and budgets agree."""
    steps = lambda arm: F.sort_array(F.collect_set(F.when(F.col("arm") == arm, F.col("total_steps"))))
    out = runs.agg(F.count(F.lit(1)).alias("n_runs"), F.countDistinct("shared_config_hash").alias("n_hashes"), steps("b_gold_oversampled").alias("b"), steps("c_gold_weak").alias("c"))
    same = (F.size("b") == 0) | (F.size("c") == 0) | (F.col("b") == F.col("c"))
    return out.select("n_runs", "n_hashes", F.col("b").alias("b_steps"), F.col("c").alias("c_steps"), ((F.col("n_runs") > 0) & (F.col("n_hashes") <= 1) & same).alias("aligned"))


def assert_budget_alignment(runs: DataFrame) -> None:
    row = budget_alignment(runs).first()
    if not row["aligned"]:
        raise AssertionError(f"{row['n_runs']} runs, {row['n_hashes']} protocol hashes, steps B {row['b_steps']}, C {row['c_steps']}")


def accuracy(df: DataFrame) -> DataFrame:
    return df.agg(ratio(F.count_if(F.col("y_true") == F.col("y_pred")).cast("double"), F.count(F.lit(1)).cast("double")).alias("accuracy"))
