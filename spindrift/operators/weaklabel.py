"""Weak labels: votes of a model, consensus with evidence, and the audit of both."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import ratio, wilson
from ..functions.text import UNSURE
from ..schemas import ACCENTS
from .sample import stratified_sample

# Fixed weights of the evidence levels that can be accepted, and the least share of votes.
EVIDENCE_WEIGHT = {"E1": 1.0, "E2": 0.85}
LEAST_SHARE = 2 / 3


@dataclass(frozen=True)
class VoteConfig:
    model_id: str
    revision: str
    prompt: str
    prompt_sha256: str = ""
    k_votes: int = 3
    temperature: float = 0.7

    def checked_prompt(self) -> str:
        """The prompt, if its hash is the pinned one (an empty pin allows any)."""
        found = hashlib.sha256(self.prompt.encode()).hexdigest()
        if self.prompt_sha256 not in ("", found):
            raise ValueError(f"prompt changed: sha256 {found}, pinned {self.prompt_sha256}")
        return self.prompt

    def metadata(self) -> str:
        return json.dumps(
            {"model_id": self.model_id, "revision": self.revision, "prompt_sha256": hashlib.sha256(self.prompt.encode()).hexdigest(), "k_votes": self.k_votes, "temperature": self.temperature},
            indent=2,
        )


def one_label(reply: str) -> str:
    low = reply.lower()
    hits = [a for a in ACCENTS if a.lower() in low]
    return hits[0] if len(hits) == 1 else UNSURE


def vote(df: DataFrame, cfg: VoteConfig, generate: Callable[[str, str], str], path_of: Callable[[str], str] = str) -> DataFrame:
    """df with qwen_votes: k replies of generate(path, prompt) to each clip, parsed.

    generate runs on the executors, batch by batch; a model is best loaded on first use.
    """
    prompt, k = cfg.checked_prompt(), cfg.k_votes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(qwen_votes=[[one_label(generate(path_of(c), prompt)) for _ in range(k)] for c in batch["clip_id"]])

    return df.mapInPandas(run, T.StructType(df.schema.fields + [T.StructField("qwen_votes", T.ArrayType(T.StringType()))]))


def vote_share(votes: Column, label: Column) -> Column:
    """Share of the votes for a label, 0 without votes."""
    n = F.coalesce(F.size(votes), F.lit(0))
    return ratio(F.size(F.filter(votes, lambda v: v.eqNullSafe(label))).cast("double"), n.cast("double"))


def decide(df: DataFrame) -> DataFrame:
    """evidence_level, prior_label and qwen_votes to a decision.

    Unknown or missing evidence: rejected, evidence_E3. At least two thirds of the votes for the
    prior label (then no other can have as many): accepted, weak, train. Else: review.
    """
    known = F.coalesce(F.col("evidence_level").isin(*EVIDENCE_WEIGHT), F.lit(False))
    share = vote_share(F.col("qwen_votes"), F.col("prior_label"))
    ok = known & F.col("prior_label").isNotNull() & (share >= LEAST_SHARE)
    weight = F.create_map(*[F.lit(x) for kv in EVIDENCE_WEIGHT.items() for x in kv])[F.col("evidence_level")]
    new = {
        "accent_label": F.when(ok, F.col("prior_label")),
        "consensus_score": F.when(ok, share * weight).otherwise(0.0),
        "label_source": F.lit("weak"),
        "status": F.when(ok, "accepted").when(~known, "rejected").otherwise("review"),
        "reject_reason": F.when(~known, "evidence_E3"),
        "split": F.when(ok, "train").otherwise("unassigned"),
    }
    return df.withColumns(new)


def draw_audit(df: DataFrame, per_class: int = 25, rejects: int = 50, seed: int = 0, review_reason: str | None = None) -> DataFrame:
    """Accepted rows by class, rejected and review ones by reason, tagged with their pool.

    Review rows without a reason are in no stratum unless review_reason names one for them.
    """
    accepted = stratified_sample(df.where("status = 'accepted'"), "accent_label", per_class, seed).withColumn("pool", F.lit("accepted"))
    others = df.where("status IN ('rejected', 'review')")
    if review_reason:
        others = others.withColumn("reject_reason", F.when(F.col("status") == "review", F.coalesce("reject_reason", F.lit(review_reason))).otherwise(F.col("reject_reason")))
    reasons = others.where("reject_reason IS NOT NULL").agg(F.countDistinct("reject_reason")).first()[0]
    sampled = stratified_sample(others, "reject_reason", rejects // reasons if reasons else 0, seed).withColumn("pool", F.lit("rejected"))
    return accepted.unionByName(sampled, allowMissingColumns=True)


def blind(sample: DataFrame) -> DataFrame:
    """What a listener sees: no label."""
    return sample.select("clip_id", "pool", F.lit("").alias("human_label"))


def accepted_precision(annotated: DataFrame, kill: float = 0.80) -> DataFrame:
    """Per class of the accepted pool: precision, its Wilson interval, n, and whether the class is given up."""
    n = annotated.where("pool = 'accepted' AND accent_label IS NOT NULL").groupBy("accent_label").agg(
        F.count_if(F.coalesce(F.col("human_label") == F.col("accent_label"), F.lit(False))).alias("n_correct"), F.count(F.lit(1)).alias("n")
    )
    out = n.withColumn("precision", F.col("n_correct") / F.col("n")).withColumn("ci", wilson(F.col("n_correct"), F.col("n")))
    return out.select("accent_label", "n", "precision", F.col("ci.low").alias("ci_low"), F.col("ci.high").alias("ci_high"), (F.col("precision") < kill).alias("killed"))


def false_rejects(annotated: DataFrame) -> DataFrame:
    """Per reason of the rejected pool: the share that the listener gave the prior label."""
    right = F.coalesce(F.col("human_label") == F.col("prior_label"), F.lit(False)).cast("double")
    return annotated.where("pool = 'rejected' AND reject_reason IS NOT NULL").groupBy("reject_reason").agg(F.avg(right).alias("false_reject_rate"))
