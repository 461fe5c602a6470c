"""Benchmark decontamination by greedy string tiling.

A document and a test item that share a seed (five successive words) are tiled: the
longest run of words that both have and neither has marked yet is marked in both, again
and again, down to runs of three words. Runs are found by running Karp-Rabin: prefix sums
of word hashes times powers of a base give the hash of any run in one step, so a length is
one pass over both; the next length to mark is found by halving. The share of the item's
words that tiles cover is its coverage in the document, whatever the order of the
passages. A document whose best coverage is at least 0.8 is contaminated; its evidence is
the item covered best. Pairs without a common seed aren't tiled, coverage 0: an item cut
into runs of four words and less isn't seen.

Seeds are joined by a shuffle: documents send those of their seeds that a filter of fixed
size lets through, each distinct text once; what is joined and tiled grows with the matches,
and neither the driver nor an executor ever holds the benchmark.

Words are runs of letters and digits in lower case, so punctuation and case don't hide a
passage. Items of fewer words than a seed match where their whole sequence occurs.

Defined results: a null or empty text is clean, coverage 0 and no item; null or wordless
items and those without an id match nothing; of items of equal coverage the least item_id
counts; several items of one id count as one, covered as its best; repeated rows are judged
alike; very long texts and items are tiled whole; an empty table or benchmark gives clean
rows or none; the stage carries further columns of any name, `coverage` adds _op6 to those it
is given.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, named as named_columns, packed, table

SEED_WORDS, LEAST_TILE, COVERAGE = 5, 3, 0.8
#: Bits of the seed filter at most (16 MB); it has SPARE bits a seed as long as that is less.
FILTER_BITS, SPARE = 1 << 27, 64
#: Seeds of the benchmark, texts with their results, up to this number go to every executor (some 40 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Items that a text is tiled with in one row.
ITEMS_A_ROW = 64
_WORDS = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def _stable(words: list[str]) -> np.ndarray:
    """64-bit hashes of words that every process agrees on."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


_POWERS = np.zeros((2, 0), np.uint64)


def _powers(n: int) -> np.ndarray:
    """The first n powers of the base and of its inverse, worked out once for the longest sequence met."""
    global _POWERS
    if _POWERS.shape[1] < n:
        out = np.empty((2, max(1_024, 2 * n)), np.uint64)
        out[:, 0], out[0, 1:], out[1, 1:] = 1, _BASE, _INVERSE
        _POWERS = np.cumprod(out, axis=1, dtype=np.uint64)
    return _POWERS[:, :n]


class Runs:
    """Hashes of all runs of a sequence of word hashes: sums of word hash times a power of the base, modulo 2**64."""

    def __init__(self, h: np.ndarray):
        self.n = len(h)
        power, self.back = _powers(self.n)
        self.upto = np.zeros(self.n + 1, np.uint64)
        np.cumsum(h * power, out=self.upto[1:])

    def of(self, n: int) -> np.ndarray:
        m = self.n - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            out = (self.upto[n:] - self.upto[:m]) * self.back[:m]  # the inverse powers bring runs to the same place
        return out ^ (out >> np.uint64(31))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    return Runs(h).of(n)


def _free(used: np.ndarray, n: int) -> np.ndarray:
    """Whether each run of n words has no marked word."""
    marked = np.concatenate([[0], np.cumsum(used)])
    return marked[n:] == marked[: len(marked) - n]


def tile(doc: np.ndarray, item: np.ndarray, least: int) -> int:
    """Words of the item that greedy tiling covers; doc and item are arrays of word hashes."""
    used_doc, used_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    in_doc, in_item = Runs(doc), Runs(item)
    least = max(least, 1)

    def common(n: int) -> np.ndarray:
        """Hashes of the unmarked runs of n words that both have."""
        return np.intersect1d(in_doc.of(n)[_free(used_doc, n)], in_item.of(n)[_free(used_item, n)])

    high = min(len(doc), len(item))
    while high >= least and not used_item.all():
        # a run of n words holds runs of every lesser length: the longest is the next length, or found by halving
        low = least - 1
        if len(common(high)):
            low = high
        while low < high:
            mid = (low + high + 1) // 2
            if len(common(mid)):
                low = mid
            else:
                high = mid - 1
        n = low
        if n < least:
            break
        both = common(n)
        own, other = in_item.of(n), in_doc.of(n)
        at = np.flatnonzero(np.isin(own, both))
        places: dict[int, list[int]] = {}
        for j, h in zip(at.tolist(), own[at].tolist(), strict=True):
            places.setdefault(h, []).append(j)
        at = np.flatnonzero(np.isin(other, both) & _free(used_doc, n))
        done = 0  # places in the document before this are marked
        for i, h in zip(at.tolist(), other[at].tolist(), strict=True):
            if i < done:
                continue
            left = places[h]
            while left:
                j = left[0]
                if used_item[j : j + n].any():
                    left.pop(0)  # marked for good
                elif (doc[i : i + n] == item[j : j + n]).all():
                    used_doc[i : i + n] = True
                    used_item[j : j + n] = True
                    done = i + n
                    break
                else:  # runs of one hash that differ: a matter of 2**-64
                    break
        high = n - 1
    return int(used_item.sum())


def _covered(h: np.ndarray, item: np.ndarray, least_tile: int) -> float:
    keep = np.isin(h, item)
    # words that the item lacks can't be in a tile; one of them stays between the others to keep runs apart
    keep |= np.concatenate([[False], keep[:-1]])
    return tile(h[keep], item, min(least_tile, len(item))) / len(item)


def _seed_filter(seeds: DataFrame) -> np.ndarray:
    """A bit for each seed's place, as 64-bit words; of a size that FILTER_BITS bounds, whatever the number of seeds."""
    n = seeds.count()
    bits = int(min(FILTER_BITS, 1 << max(12, (SPARE * max(n, 1) - 1).bit_length())))
    place = F.pmod(F.col("h"), F.lit(bits))
    words = seeds.select(F.floor(place / 64).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("bit"))
    found = words.groupBy("at").agg(F.bit_or("bit").alias("word")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[found["at"].to_numpy(np.int64)] = found["word"].to_numpy(np.int64).view(np.uint64)
    return out


def _seeds_of(h: np.ndarray, lengths: list[int]) -> np.ndarray:
    return np.concatenate([rolling(h, n) for n in lengths]).view(np.int64) if len(h) and lengths else np.zeros(0, np.int64)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


_TEXT = ["_t1", "_t2"]


def coverage(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", seed_words: int = SEED_WORDS, least_tile: int = LEAST_TILE
) -> DataFrame:
    """docs with _op6: struct(coverage, item, seeded)."""
    spark = docs.sparkSession

    # not to be worked out once more for a filter on what they give: so declared
    def once(udf):
        return udf.asNondeterministic()

    @once
    @F.pandas_udf("words int, seeds array<long>")
    def item_seeds(texts: pd.Series) -> pd.DataFrame:
        found = [_stable(words_of(t)) for t in texts]
        return pd.DataFrame({"words": [min(len(h), seed_words) for h in found], "seeds": [np.unique(_seeds_of(h, [min(len(h), seed_words)])) for h in found]})

    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("item_text"))
    seeds = items.withColumn("s", item_seeds("item_text")).where("s.words > 0").select("item", "s.words", F.explode("s.seeds").alias("h"))
    seeds = materialise(seeds.distinct(), "seeds")
    # a seed's length is that of a seed, but for items of fewer words: seed_words values at most
    lengths = sorted(r["words"] for r in seeds.select("words").distinct().collect())
    bits = spark.sparkContext.broadcast(_seed_filter(seeds))

    @once
    @F.pandas_udf("array<long>")
    def doc_seeds(texts: pd.Series) -> pd.Series:
        table, out = bits.value, []
        for t in texts:
            s = _seeds_of(_stable(words_of(t)), lengths) if lengths else np.zeros(0, np.int64)
            place = s & (64 * len(table) - 1)
            out.append(np.unique(s[(table[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1]))
        return pd.Series(out)

    text = F.col(text_col)
    named = [F.xxhash64(text).alias("_t1"), F.xxhash64(F.lit(6), text).alias("_t2")]
    seeded = docs.select(*named, doc_seeds(text).alias("hs")).where(F.size("hs") > 0)
    # texts alike have the same seeds: each is judged once
    seeded = materialise(seeded.groupBy(*_TEXT).agg(F.first("hs").alias("hs")), "seeded")
    pairs = seeded.select(*_TEXT, F.explode("hs").alias("h")).join(_small(seeds.select("h", "item")), "h").select(*_TEXT, "item").distinct()
    pairs = materialise(pairs, "seed_pairs")
    held = items.join(_small(pairs.select("item").distinct()), "item", "left_semi")
    row = F.pmod(F.xxhash64("item"), F.lit(1 << 20))
    chunks = pairs.groupBy(*_TEXT).agg(F.count(F.lit(1)).alias("n")).select(*_TEXT, F.ceil(F.col("n") / ITEMS_A_ROW).alias("rows"))
    chunks = pairs.join(chunks, _TEXT).join(held, "item").groupBy(*_TEXT, (row % F.col("rows")).alias("row")).agg(F.collect_list(F.struct("item", "item_text")).alias("items"))
    asked = materialise(pairs.select(*_TEXT).distinct(), "asked")
    texts = docs.select(*named, text.alias("_text")).join(_small(asked), _TEXT, "left_semi").dropDuplicates(_TEXT)
    tiled = texts.join(chunks, _TEXT).select(*_TEXT, "_text", "items")

    def judge(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                h = _stable(words_of(r[2]))
                found = [(_covered(h, _stable(words_of(i["item_text"])), least_tile), int(i["item"])) for i in r[3]]
                best = max(found, key=lambda f: (f[0], -f[1]))
                out.append((r[0], r[1], *best, len({i["item"] for i in r[3]})))
            yield pd.DataFrame(out, columns=[*_TEXT, "coverage", "item", "seeded"])

    judged = tiled.mapInPandas(judge, "_t1 long, _t2 long, coverage double, item long, seeded long")
    best = F.max_by(F.struct("coverage", "item"), F.struct("coverage", -F.col("item")))
    judged = materialise(judged.groupBy(*_TEXT).agg(best.alias("b"), F.sum("seeded").alias("seeded")).select(*_TEXT, F.struct(F.col("b.coverage").alias("coverage"), F.col("b.item").alias("item"), "seeded").alias("_op6")), "judged")
    none = F.struct(F.lit(0.0).alias("coverage"), F.lit(None).cast("long").alias("item"), F.lit(0).cast("long").alias("seeded"))
    columns = docs.columns
    out = docs.withColumns({"_t1": named[0], "_t2": named[1]}).join(_small(judged), _TEXT, "left")
    return out.select(*named_columns(columns), F.coalesce(F.when(F.col("_op6.coverage") > 0, F.col("_op6")), none).alias("_op6"))


def contaminated(threshold: float = COVERAGE) -> Column:
    return F.col("_op6.coverage") >= threshold


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    judged = coverage(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return judged.select(
        "doc_id", contaminated().alias("contaminated"), F.col("_op6.item").alias("item_id"), F.col("_op6.coverage").alias("coverage"), F.col("_op6.seeded").alias("seeded_items")
    )


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents without the contaminated ones."""
    return coverage(packed(docs), table(spark, sf_dir, "benchmark"), text_col="_row.text").where(~contaminated()).select("_row.*")
