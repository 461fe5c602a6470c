"""Mixing sources to target weights by min-cost flow.

Documents that belong to the same set of sources form one membership pattern. A
network routes the patterns' words to the sources' quotas: a pattern gives its words
once at no cost, a second time at cost 1, a third time at cost 3 and so on (convex), so
no document is repeated while another one could still be taken for the first time. The
network has one node a pattern and one a source, whatever the number of documents.
Inside a pattern, documents stand in a seeded order and are taken from its start until
the pattern's share is reached, so each pattern's take is within half a document of it.

Defined results: a null text has size 0; a null source is a source of its own, last in
order; documents of no source (null or empty membership) are never taken; repeated rows
count as rows; an empty table gives an empty result; ties in the seeded order fall to
doc_id, then size. Only the named columns are read, so further columns can't clash.
"""

from __future__ import annotations

import json
from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, named, packed, seeded, table, word_count

#: Patterns that the driver solves for; each is a set of sources, not a document.
MAX_PATTERNS = 200_000
#: Documents of a pattern that are put in order together, and buckets of a pattern that are summed together.
BUCKET_ROWS, GROUP_BUCKETS = 2_000, 2_000


def target_words(sizes: dict[str | None, int], weights: dict[str | None, float], cap: float = 3.0) -> dict[str | None, float]:
    """Share sum(sizes) by weight; none above cap times its own size, the excess reshared by weight."""
    out: dict[str | None, float] = {}
    active, left = list(sizes), float(sum(sizes.values()))
    while active:
        total = sum(weights[s] for s in active)
        share = {s: left * weights[s] / total for s in active}
        over = [s for s in active if share[s] > cap * sizes[s]]
        if not over:
            out |= share
            break
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        active = [s for s in active if s not in out]
    return out


class _Flow:
    """Maximum flow by blocking flows; arcs may gain capacity between runs."""

    def __init__(self, n: int):
        self.to: list[int] = []
        self.cap: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(n)]

    def arc(self, a: int, b: int, cap: int) -> int:
        self.out[a].append(len(self.to))
        self.out[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.cap += [cap, 0]
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        while True:
            level = {source: 0}
            queue = deque([source])
            while queue:
                a = queue.popleft()
                for e in self.out[a]:
                    if self.cap[e] and self.to[e] not in level:
                        level[self.to[e]] = level[a] + 1
                        queue.append(self.to[e])
            if sink not in level:
                return
            at = [0] * len(self.out)
            while self._push(source, sink, level, at):
                pass

    def _push(self, source: int, sink: int, level: dict[int, int], at: list[int]) -> bool:
        path, node = [], source
        while node != sink:
            while at[node] < len(self.out[node]):
                e = self.out[node][at[node]]
                if self.cap[e] and level.get(self.to[e]) == level[node] + 1:
                    break
                at[node] += 1
            else:
                if not path:
                    return False
                node = self.to[path.pop() ^ 1]
                at[node] += 1
                continue
            path.append(e)
            node = self.to[e]
        least = min(self.cap[e] for e in path)
        for e in path:
            self.cap[e] -= least
            self.cap[e ^ 1] += least
        return True


def route(capacity: dict[tuple, int], quota: dict[str | None, int], max_repeats: int = 3) -> dict[tuple, dict[str | None, int]]:
    """Words that each pattern (a tuple of sources) gives to each source, of least repetition cost.

    Costs stand on the arcs into the patterns alone, so a cheapest augmenting path is one
    that enters at the lowest open level: opening one repetition level at a time and
    augmenting to the maximum gives the min-cost flow for any convex cost.
    """
    patterns, sources = list(capacity), list(quota)
    node = {s: 1 + len(patterns) + i for i, s in enumerate(sources)}
    sink = 1 + len(patterns) + len(sources)
    net = _Flow(sink + 1)
    entry = [net.arc(0, 1 + i, 0) for i in range(len(patterns))]
    arcs = {(p, s): net.arc(1 + i, node[s], sum(quota.values())) for i, p in enumerate(patterns) for s in p if s in node}
    for s in sources:
        net.arc(node[s], sink, quota[s])
    for _ in range(max_repeats):
        for i, p in enumerate(patterns):
            net.cap[entry[i]] += capacity[p]
        net.run(0, sink)
    given: dict[tuple, dict[str | None, int]] = {p: {} for p in patterns}
    for (p, s), e in arcs.items():
        given[p][s] = net.cap[e ^ 1]
    return given


@dataclass
class Mix:
    """documents: one row per input row with _mix_size, _mix_repeats and _mix_routed (the source each copy counts for);
    sizes and targets: by source."""

    documents: DataFrame
    sizes: dict
    targets: dict


def by_code_point(sources) -> list:
    return sorted((s for s in sources if s is not None)) + ([None] if None in sources else [])


def mix(
    docs: DataFrame,
    members: Column,
    keep: list[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    weights: tuple[float, ...] = (5, 2, 1),
    max_repeats: int = 3,
    seed: int = 1,
    write_rows: bool = True,
    size: Column | None = None,
) -> Mix:
    """Take documents so that each source's words come near its target.

    members: array of the sources a document belongs to. keep: columns of docs to carry.
    weights: dealt to the sources in code point order, null last, repeating. A target is
    a share of all words, at most max_repeats times what the source holds. write_rows:
    write the kept columns down with the sizes, so that texts are read and counted once;
    not worth it if the texts themselves are kept.
    """
    spark = docs.sparkSession
    rows = docs.select(
        *named(keep),
        (word_count(F.col(text_col)) if size is None else size).alias("_mix_size"),
        F.to_json(F.sort_array(F.array_distinct(F.coalesce(members, F.array().cast("array<string>")))), {"ignoreNullFields": "false"}).alias("_mix_pattern"),
        seeded(seed, F.col(id_col)).alias("_mix_order"),
        F.col(id_col).alias("_mix_id"),
    )
    counted = materialise(rows if write_rows else rows.select("_mix_size", "_mix_pattern", "_mix_order"), "mix")
    rows = counted if write_rows else rows
    found = counted.groupBy("_mix_pattern").agg(F.sum("_mix_size").alias("words"), F.count(F.lit(1)).alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns: name fewer sources")
    pattern_of = {r["_mix_pattern"]: tuple(json.loads(r["_mix_pattern"])) for r in found}
    words = {pattern_of[r["_mix_pattern"]]: int(r["words"]) for r in found}
    sizes: dict[str | None, int] = {}
    for p, n in words.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    order = by_code_point(set(sizes))
    sizes = {s: sizes[s] for s in order}
    targets = target_words(sizes, {s: weights[i % len(weights)] for i, s in enumerate(order)}, max_repeats)
    given = route(words, {s: round(targets[s]) for s in order}, max_repeats)

    plan = []
    for r in sorted(found, key=lambda r: r["_mix_pattern"]):
        p, upto, spans = pattern_of[r["_mix_pattern"]], 0, []
        for s in by_code_point(set(p)):
            upto += given[p].get(s, 0)
            spans.append((s, upto))
        plan.append((r["_mix_pattern"], words[p], upto, max(1, -(-r["n"] // BUCKET_ROWS)), spans))
    plan_df = spark.createDataFrame(plan, "_mix_pattern string, _mix_cap long, _mix_take long, _mix_buckets long, _mix_spans array<struct<source:string,upto:long>>")
    # MAX_PATTERNS rows at most; small plans go to every executor
    plan_df = F.broadcast(plan_df) if len(plan) <= 10_000 else plan_df
    share = F.col("_mix_order") / F.lit(float(1 << 53))
    bucket = F.least(F.floor(share * F.col("_mix_buckets")), F.col("_mix_buckets") - 1)

    def placed(df: DataFrame) -> DataFrame:
        return df.join(plan_df, "_mix_pattern").withColumn("_mix_bucket", bucket).withColumn("_mix_group", F.floor(F.col("_mix_bucket") / GROUP_BUCKETS))

    # how many words stand before a document: those of earlier groups of buckets, of earlier buckets of its group, then of its own
    group, key = ["_mix_pattern", "_mix_group"], ["_mix_pattern", "_mix_group", "_mix_bucket"]
    buckets = materialise(placed(counted).groupBy(*key).agg(F.sum("_mix_size").alias("_mix_words")), "buckets")
    before = lambda part, at: F.coalesce(F.sum("_mix_words").over(Window.partitionBy(*part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = buckets.groupBy(*group).agg(F.sum("_mix_words").alias("_mix_words")).select(*group, before(group[:1], "_mix_group").alias("_mix_groups"))
    buckets = buckets.select(*key, before(group, "_mix_bucket").alias("_mix_in_group")).join(groups, group).select(*key, (F.col("_mix_in_group") + F.col("_mix_groups")).alias("_mix_earlier"))
    inside = Window.partitionBy(*key).orderBy("_mix_order", "_mix_id", "_mix_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = placed(rows).withColumn("_mix_inside", F.sum("_mix_size").over(inside) - F.col("_mix_size")).join(buckets, key)
    middle = F.col("_mix_earlier") + F.col("_mix_inside") + F.col("_mix_size") / 2
    copies = F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda c: c * F.col("_mix_cap") + middle)
    taken = F.filter(copies, lambda at: at < F.col("_mix_take"))
    routed = F.transform(taken, lambda at: F.filter(F.col("_mix_spans"), lambda s: at < s["upto"])[0]["source"])
    return Mix(rows.select(*named(keep), "_mix_size", F.size(taken).alias("_mix_repeats"), routed.alias("_mix_routed")), sizes, targets)


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = mix(docs, F.array("source"), keep=["doc_id", "source"])
    shares = spark.createDataFrame([(s, found.sizes[s], float(found.targets[s])) for s in found.sizes], "_s string, source_size long, target double")
    shares = F.broadcast(shares) if len(found.sizes) <= 10_000 else shares
    return found.documents.join(shares, F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id",
        F.col("_mix_size").alias("size"),
        "source_size",
        "target",
        (F.col("_mix_size") * F.col("_mix_repeats")).cast("long").alias("taken"),
        "source",
        F.col("_mix_repeats").alias("repeats"),
    )


def mix_overlapping_sources(spark, sf_dir: str) -> DataFrame:
    """The mix where a text belongs to every source that holds it: one row a distinct text (null texts apart), with the sources its copies count for."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    texts = docs.groupBy(F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(9), "text").alias("h2")).agg(
        F.min("doc_id").alias("doc_id"), F.transform(F.collect_set(F.struct("source")), lambda s: s["source"]).alias("sources"), F.min(word_count(F.col("text"))).alias("size")
    )
    found = mix(texts.select("doc_id", "sources", F.col("size").alias("words")), F.col("sources"), keep=["doc_id", "sources"], size=F.col("words"))
    return found.documents.select("doc_id", F.array_sort("sources").alias("sources"), F.col("_mix_size").alias("size"), F.col("_mix_repeats").alias("repeats"), F.col("_mix_routed").alias("routed"))


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents with each row as often as the mix takes it."""
    found = mix(packed(docs), F.array("_row.source"), keep=["_row"], id_col="_row.doc_id", text_col="_row.text", write_rows=False)
    return found.documents.select("_row", F.explode("_mix_routed")).select("_row.*")
