"""Training protocol on the driver: shared fields locked, seeds listed, a hash that runs share; and a linear probe."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import warmup_cosine
from .sample import class_weights

# Fixed fields that no arm may set for itself.
SHARED_FIELDS = (
    "epochs_c", "batch_size", "lr", "lr_schedule", "warmup_ratio", "sampler", "augment", "ckpt_select", "seeds", "base_model", "lora_r", "lora_alpha", "lora_dropout", "n_classes",
)


@dataclass(frozen=True)
class Run:
    arm: str
    budget: str
    seed: int
    shared: dict
    shared_config_hash: str
    dataset_variant: str = ""


def shared_hash(common: dict) -> str:
    locked = {k: common[k] for k in sorted(SHARED_FIELDS)}
    return hashlib.sha256(json.dumps(locked, sort_keys=True).encode()).hexdigest()[:16]


def load_run(common: dict, arm: dict, seed: int) -> Run:
    clash = sorted(set(SHARED_FIELDS) & set(arm))
    if clash:
        raise ValueError(f"the arm sets shared fields {clash}")
    if seed not in common["seeds"]:
        raise ValueError(f"seed {seed} is none of {common['seeds']}")
    return Run(arm["arm"], arm["budget"], seed, {k: common[k] for k in SHARED_FIELDS}, shared_hash(common), arm.get("dataset_variant", ""))


def schedule(spark, total: int, warmup_ratio: float, base: float = 1.0) -> DataFrame:
    """step, lr for every step of a run."""
    return spark.range(total).select(F.col("id").alias("step"), (base * warmup_cosine(F.col("id"), total, int(total * warmup_ratio))).alias("lr"))


def checkpoints(history: DataFrame) -> DataFrame:
    """Per run the step of the best validation score (the earliest on ties). history: arm, seed, step, val_macro_f1."""
    best = F.max(F.struct("val_macro_f1", (-F.col("step")).alias("back")))
    return history.groupBy("arm", "seed").agg(best.alias("b")).select("arm", "seed", F.col("b.val_macro_f1").alias("best_val_macro_f1"), (-F.col("b.back")).alias("step"))


def embedding_probe(train: DataFrame, test: DataFrame, vector: str = "embedding", label: str = "label", max_iter: int = 1_000) -> DataFrame:
    """test with y_pred of a logistic regression on frozen vectors, classes weighted alike."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    names = [r[0] for r in train.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).collect()]  # a row a class
    coded = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, float(i))])
    ready = lambda df: df.withColumn("_features", array_to_vector(F.col(vector).cast("array<double>")))
    rows = class_weights(ready(train.where(F.col(label).isNotNull())), label).withColumn("_y", coded[F.col(label)])
    weighted = rows.withColumn("weight", F.col("weight") * F.lit(float(train.count()) / max(len(names), 1)))
    model = LogisticRegression(featuresCol="_features", labelCol="_y", weightCol="weight", maxIter=max_iter, regParam=0.0, predictionCol="_p").fit(weighted)
    back = F.array(*[F.lit(n) for n in names])
    return model.transform(ready(test)).withColumn("y_pred", F.get(back, F.col("_p").cast("int"))).select(*test.columns, "y_pred")
