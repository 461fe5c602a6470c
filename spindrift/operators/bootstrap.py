"""Paired bootstrap over clusters (speakers), stratified by class, from sufficient statistics."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.md5 import LANES, first_words
from ..functions.numeric import f1, ratio
from ..storage import materialise, remove

#: Speakers whose statistics, and members of a class whose numbers, stand in one row.
BLOCK_SPEAKERS, BLOCK_MEMBERS = 4_096, 65_536
#: A task's counts of draws, its draws (unless there are more tasks than the most), and the bytes up to which the blocks are broadcast.
TASK_BYTES, TASK_DRAWS, MOST_TASKS, BROADCAST_BYTES = 256 << 20, 2_000_000, 384, 128 << 20


def outcomes(preds: DataFrame) -> DataFrame:
    """arm, seed, speaker_key, y_true, y_pred, n: how often."""
    return preds.groupBy("arm", "seed", "speaker_key", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def speaker_statistics(cells: DataFrame, labels: list[str]) -> DataFrame:
    """arm, seed, speaker_key, label, tp, err (false positives and negatives) from outcomes: all that a resample's F1 depends on."""
    hit = F.col("y_pred").eqNullSafe(F.col("y_true"))
    sides = F.when(hit, F.array(F.struct(F.col("y_true").alias("label"), F.col("n").alias("tp"), F.lit(0).cast("long").alias("err")))).otherwise(
        F.array(*[F.struct(F.col(c).alias("label"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("err")) for c in ("y_true", "y_pred")])
    )
    found = cells.select("arm", "seed", "speaker_key", F.explode(sides).alias("s")).select("arm", "seed", "speaker_key", "s.*")
    return found.where(F.col("label").isin(*labels)).groupBy("arm", "seed", "speaker_key", "label").agg(F.sum("tp").alias("tp"), F.sum("err").alias("err"))


def drawn(members: DataFrame, of: list[str]) -> DataFrame:
    """Members (of, stratum, speaker_key) with at, a number from 0 in order of speaker_key, and n, the members of the stratum."""
    each = Window.partitionBy(*of, "stratum")
    return members.withColumns({"at": F.row_number().over(each.orderBy("speaker_key")) - 1, "n": F.count(F.lit(1)).over(each)})


def _packed(cells: DataFrame, stats: DataFrame, arms: list[tuple[str, str]], labels: list[str], runs: list) -> tuple[DataFrame, int, int]:
    """Rows that a resample needs, as compressed blocks; the number of speakers, and that of members.

    kind 0: of a comparison and class, the speakers' numbers in order of key, BLOCK_MEMBERS
    a row. kind 1: BLOCK_SPEAKERS speakers' true positives and errors for each run and label.
    """
    bucket = F.pmod(F.xxhash64("speaker_key"), F.lit(max(1, stats.select("speaker_key").distinct().count() // BLOCK_SPEAKERS)))
    keyed = stats.select("speaker_key").distinct().withColumn("bucket", bucket)
    counts = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))  # a row for each block of speakers
    first = counts.withColumn("first", F.sum("size").over(Window.orderBy("bucket")) - F.col("size"))
    inside = keyed.withColumn("inside", F.row_number().over(Window.partitionBy("bucket").orderBy("speaker_key")) - 1)
    speakers = materialise(inside.join(F.broadcast(first), "bucket").select("speaker_key", (F.col("first") + F.col("inside")).alias("speaker")), "speakers")
    n_speakers = speakers.count()

    sides = F.filter(F.array(*[F.when(F.col("arm").isin(a, b), F.lit(k)) for k, (a, b) in enumerate(arms)]), lambda k: k.isNotNull())
    members = cells.select("speaker_key", F.col("y_true").alias("stratum"), F.explode(sides).alias("of")).distinct()
    members = materialise(drawn(members, ["of"]).join(speakers, "speaker_key").select("of", "stratum", "at", "n", "speaker", F.floor(F.col("at") / BLOCK_MEMBERS).alias("block")), "members")

    numbered = stats.sparkSession.createDataFrame([(*run, label, i * len(labels) + j) for i, run in enumerate(runs) for j, label in enumerate(labels)], f"arm string, _seed {stats.schema['seed'].dataType.simpleString()}, label string, cell int")
    placed = stats.join(F.broadcast(numbered), ["arm", "label"]).where(F.col("seed").eqNullSafe(F.col("_seed"))).join(speakers, "speaker_key").select(F.floor(F.col("speaker") / BLOCK_SPEAKERS).alias("block"), "speaker", "cell", "tp", "err")
    width = 2 * len(runs) * len(labels)

    def pack_members(rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows.sort_values("at")["speaker"].to_numpy(np.int32)
        return pd.DataFrame({"kind": [0], "of": [rows["of"].iloc[0]], "stratum": [rows["stratum"].iloc[0]], "block": [rows["block"].iloc[0]], "n": [rows["n"].iloc[0]], "type": ["int32"], "bytes": [zlib.compress(ids.tobytes(), 1)]})

    def pack_cells(rows: pd.DataFrame) -> pd.DataFrame:
        at = rows["speaker"].to_numpy() % BLOCK_SPEAKERS
        table = np.zeros((at.max() + 1, width), np.int64)
        table[at, 2 * rows["cell"].to_numpy()] = rows["tp"].to_numpy()
        table[at, 2 * rows["cell"].to_numpy() + 1] = rows["err"].to_numpy()
        kind = np.min_scalar_type(table.max())
        return pd.DataFrame({"kind": [1], "of": [0], "stratum": [""], "block": [rows["block"].iloc[0]], "n": [len(table)], "type": [str(kind)], "bytes": [zlib.compress(table.astype(kind).tobytes(), 1)]})

    schema = "kind int, of int, stratum string, block long, n long, type string, bytes binary"
    packed = materialise(members.groupBy("of", "stratum", "block").applyInPandas(pack_members, schema).unionByName(placed.groupBy("block").applyInPandas(pack_cells, schema)), "packed")
    n_members = members.count()
    remove(speakers)
    remove(members)
    return packed, n_speakers, n_members


def deltas(cells: DataFrame, stats: DataFrame, arms: list[tuple[str, str]], labels: list[list[str]], runs: list, n_boot: int, seed: int) -> DataFrame:
    """of, b, delta: for each pair of arms macro-F1 of the first less that of the second, each a mean over seeds, in every resample.

    A resample has as many draws in each class as it has speakers, with replacement; a
    speaker of two classes is drawn in both, each time with all its clips. A task takes a
    range of resamples: it draws class by class, counts each speaker's draws, then
    multiplies the counts with the speakers' statistics block by block. Pairs of arms
    share the hashes, each taken modulo its own number of speakers.
    """
    spark = cells.sparkSession
    every = sorted(set().union(*labels))
    schema = "of int, b long, delta double"
    if not every:
        return spark.createDataFrame([], schema)
    packed, n_speakers, n_members = _packed(cells, stats, arms, every, runs)
    shape = len(runs), len(every)
    of_arm = {a: np.array([i for i, run in enumerate(runs) if run[0] == a], int) for pair in arms for a in pair}
    columns = [np.array([every.index(x) for x in own], int) for own in labels]
    most = max(1, TASK_BYTES // (4 * len(arms) * n_speakers))  # resamples whose counts a task can hold
    n_tasks = min(n_boot, max(-(-n_boot // most), min(MOST_TASKS, 1 + n_members * n_boot // TASK_DRAWS)))

    def counted(first: int, last: int, name: str, members: dict[int, list[np.ndarray]], times: np.ndarray) -> None:
        places = {k: np.concatenate(parts) for k, parts in members.items()}
        n = max(len(p) for p in places.values())
        for b in range(first, last, step := max(1, LANES // n)):
            end = min(last, b + step)
            words = first_words(f"{seed}:", range(b, end), f":{name}:", range(1, n + 1))
            for k, place in places.items():
                size = np.uint32(len(place))
                at = words[:, : len(place)]
                at = (at - at // size * size).astype(np.int64)
                at += np.arange(end - b)[:, None] * len(place)
                times[k, b - first : end - first][:, place] += np.bincount(at.ravel(), minlength=(end - b) * len(place)).reshape(end - b, -1).astype(np.uint32)

    def run(batches):
        task, times, sums, name, members = None, None, None, None, {}

        def span(t):
            return t * n_boot // n_tasks, (t + 1) * n_boot // n_tasks

        def result():
            first, last = span(task)
            cells = sums.reshape(len(arms), last - first, *shape, 2)
            tp, all_ = 2.0 * cells[..., 0], 2.0 * cells[..., 0] + cells[..., 1]
            f1s = np.divide(tp, all_, out=np.zeros_like(tp), where=all_ != 0)
            for k, (a, b) in enumerate(arms):
                score = f1s[k][:, :, columns[k]].sum(2) / len(columns[k])
                mean = lambda arm: score[:, of_arm[arm]].sum(1) / max(1, len(of_arm[arm]))  # noqa: B023, E731
                yield pd.DataFrame({"of": k, "b": np.arange(first, last), "delta": mean(a) - mean(b)})

        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.task != task:
                    if task is not None:
                        yield from result()
                    task, name, members = row.task, None, {}
                    first, last = span(task)
                    times = np.zeros((len(arms), last - first, n_speakers), np.uint32)
                    sums = np.zeros((len(arms), last - first, 2 * shape[0] * shape[1]))
                if members and (row.kind == 1 or row.stratum != name):
                    counted(first, last, name, members, times)
                    members = {}
                data = np.frombuffer(zlib.decompress(row.bytes), row.type)
                if row.kind == 0:
                    name = row.stratum
                    members.setdefault(row.of, []).append(data)
                else:
                    low = row.block * BLOCK_SPEAKERS
                    sums += times[:, :, low : low + row.n] @ data.reshape(row.n, -1).astype(float)
        if task is not None:
            yield from result()

    tasks = spark.range(0, n_tasks, 1, n_tasks).select(F.col("id").cast("int").alias("task"))
    if packed.agg(F.sum(F.length("bytes"))).first()[0] <= BROADCAST_BYTES:
        rows = tasks.crossJoin(F.broadcast(packed))  # measured just before
    else:
        rows = packed.crossJoin(F.broadcast(tasks)).repartition(n_tasks, "task")  # a row for each task
    order = ["task", "kind", "stratum", "of", "block"]
    out = materialise(rows.select(*order, "n", "type", "bytes").sortWithinPartitions(*order).mapInPandas(run, schema), "deltas")
    remove(packed)
    return out


def seed_deltas(stats: DataFrame, arm_a: str, arm_b: str, labels: list[str]) -> DataFrame:
    """seed, delta over all speakers' statistics."""
    sums = stats.where(F.col("arm").isin(arm_a, arm_b) & F.col("label").isin(*labels)).groupBy("arm", "seed", "label").agg(F.sum("tp").alias("tp"), F.sum("err").alias("err"))
    scores = sums.groupBy("arm", "seed").agg((F.sum(f1(F.col("tp"), F.col("err"), F.lit(0))) / len(labels)).alias("f1"))
    side = lambda arm: F.coalesce(F.sum(F.when(F.col("arm") == arm, F.col("f1"))), F.lit(0.0))
    return scores.groupBy("seed").agg((side(arm_a) - side(arm_b)).alias("delta"))


def cluster_bootstraps(preds: DataFrame, arms: list[tuple[str, str]], n_boot: int = 10_000, seed: int = 0) -> list[DataFrame]:
    """For each pair of arms one row: mean, 95% interval, whether it excludes zero, the seeds' own deltas and their deviation.

    preds: arm, seed, speaker_key, y_true, y_pred.
    """
    own = preds.where(F.col("arm").isin(*{x for pair in arms for x in pair}) & F.col("speaker_key").isNotNull() & F.col("y_true").isNotNull())
    d = F.col("delta")
    cells = materialise(outcomes(own), "outcomes")
    seen = cells.select("arm", "seed", "y_true").distinct().collect()  # a handful of arms, seeds and classes
    runs = sorted({(r["arm"], r["seed"]) for r in seen}, key=lambda run: (run[0], run[1] is not None, run[1] or 0))
    labels = [sorted({r["y_true"] for r in seen if r["arm"] in pair}) for pair in arms]
    stats = materialise(speaker_statistics(cells, sorted(set().union(*labels))), "statistics")
    every = deltas(cells, stats, arms, labels, runs, n_boot, seed)
    remove(cells)
    rows = []
    for k, (a, b) in enumerate(arms):
        out = every.where(F.col("of") == k).agg(
            F.avg(d).alias("delta_mean"), F.percentile(d, F.lit(0.025)).alias("ci_low"), F.percentile(d, F.lit(0.975)).alias("ci_high"), F.count(F.lit(1)).alias("n_boot")
        )
        of_seeds = seed_deltas(stats, a, b, labels[k]).agg(F.sort_array(F.collect_list(F.struct("seed", "delta"))).alias("s"), F.stddev_pop(d).alias("seed_delta_std"))
        out = out.crossJoin(of_seeds).withColumn("seed_deltas", F.col("s.delta")).drop("s")  # one row each
        rows.append(out.withColumn("ci_excludes_zero", (F.col("ci_low") > 0) | (F.col("ci_high") < 0)))
    return rows


def cluster_bootstrap(preds: DataFrame, arm_a: str, arm_b: str, n_boot: int = 10_000, seed: int = 0) -> DataFrame:
    """The row of one pair of arms."""
    return cluster_bootstraps(preds, [(arm_a, arm_b)], n_boot, seed)[0]


# Fixed comparisons: name, arm, arm it is compared with, whether it is the headline.
COMPARISONS = [("C-B", "c_gold_weak", "b_gold_oversampled", True), ("A-B", "a_gold", "b_gold_oversampled", False)]


def delta_line(comparison: Column) -> Column:
    """The one wording in which a difference is reported."""
    four = lambda c: F.format_string("%.4f", c)
    return F.concat(
        comparison, F.lit(": delta macro-F1 = "), four(F.col("delta_mean")), F.lit("; test-speaker stratified bootstrap 95% CI ["), four(F.col("ci_low")), F.lit(", "), four(F.col("ci_high")),
        F.lit("] (excludes zero: "), F.when(F.col("ci_excludes_zero"), "yes").otherwise("no"), F.lit("); per-seed delta = ["),
        F.array_join(F.transform("seed_deltas", four), ", "), F.lit("], std = "), four(F.col("seed_delta_std")),
    )


def ablation_table(preds: DataFrame, n_boot: int = 10_000, seed: int = 0) -> DataFrame:
    """A row for each comparison both of whose arms are there."""
    arms = {r["arm"] for r in preds.select("arm").distinct().collect()}  # a handful
    found = [c for c in COMPARISONS if c[1] in arms and c[2] in arms]
    if not found:
        raise ValueError("no comparison has both of its arms")
    rows = cluster_bootstraps(preds, [(a, b) for _, a, b, _ in found], n_boot, seed)
    out = None
    for (name, _, _, headline), row in zip(found, rows, strict=True):
        row = row.select(F.lit(name).alias("comparison"), F.lit(headline).alias("headline"), "*")
        out = row if out is None else out.unionByName(row)
    return out.withColumn("report_line", delta_line(F.col("comparison")))


def leakage_gap(strict: DataFrame, leaky: DataFrame, labels: list[str]) -> DataFrame:
    """Macro-F1 of the same rows under both ways to split, and the difference."""
    from .evaluate import macro_f1

    a, b = macro_f1(strict, labels).withColumnRenamed("macro_f1", "strict_f1"), macro_f1(leaky, labels).withColumnRenamed("macro_f1", "leaky_f1")
    return a.crossJoin(b).withColumn("gap", F.col("leaky_f1") - F.col("strict_f1")).withColumn("relative", ratio(F.col("gap"), F.col("strict_f1"), None))  # one row each
