"""SimHash near-dedup by tiled exact comparison.

A fingerprint has 64 bits: bit i is 1 where more than half of the text's shingle hashes
(XXH64, repeats included) have it. Fingerprints are compared exactly: distinct ones are
dealt into tiles by the population counts of their two halves, tiles into blocks of
bounded size. Two fingerprints within the radius have population counts within the
radius, in each half and in sum, so block pairs beyond it are never formed. A formed
pair is compared by exclusive-or and bit counts in numpy, itself in small tiles, sorted
by the counts of the four quarters, that are skipped by the same rule. Equal
fingerprints are one before anything is compared; from each block pair come the links of
a spanning forest, not all pairs, and components are those of all links.

Defined results: a text without words (null, empty) has fingerprint 0, which links like
any other; one of fewer words than a shingle has the whole sequence as its shingle; equal
rows share a component; component_id is the least doc_id reachable, nulls aside; an empty
table gives an empty result; only the named columns are read, so further columns can't
clash.

The pipeline's stage asks for more than the query's contract: texts are near copies where
the sets of their five-word shingles have a Jaccard similarity of at least 0.8. There the
tiled comparison only finds candidates: a text has 320 bits over its set of shingles, the
first 64 are compared within a wide radius, all of them where these agree, and texts whose
sets differ too much in size are never compared. Candidates are then settled by the exact
similarity of their sets, in two rounds: the first takes a spanning forest of each block
pair's candidates; the second compares, inside the tiles, the sets of every candidate pair
that the first has not joined, and hands on a spanning forest of the similar ones. So a group
of many copies costs links in proportion to its size, and no candidate is left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import materialise, packed, table
from .decontaminate import rolling

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Fingerprints of a block (8 bytes each) and of a tile inside it.
BLOCK, TILE = 16_384, 256
#: Hashes of the sets in a block of the stage's second round (8 bytes each), and of the sets compared at once.
SET_BLOCK, SET_CHUNK = 2_000_000, 4_000_000
#: The stage: words of a shingle; least Jaccard similarity as a fraction.
STAGE_SHINGLE, SIMILAR = 5, (4, 5)
#: Candidates: differing bits of the first 64, of all 320, and of all where a set has at most FEW shingles. At similarity 0.8 some
#: 10 and 49 bits differ (12 and 60 in sets of four and five shingles), each give or take the root of five sixths of it.
STAGE_RADIUS, WIDE, WIDE_FEW, FEW, PRINTS = 22, 76, 100, 20, 5
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:n]
    stops = ends[min(shingle, len(words)) - 1 :] - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        counts += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(text: str | Column) -> Column:
    """The fingerprint of a text column as a long (its 64 bits)."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return of(text)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (least member, member) with the same components as the links a - b of positions."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    linked = [(root(x), x) for x in parent]
    linked = [(r, x) for r, x in linked if r != x]
    return np.array([r for r, _ in linked], np.int64), np.array([x for _, x in linked], np.int64)


def _quarters(v: np.ndarray) -> np.ndarray:
    return np.bitwise_count(v.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _sorted_tiles(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of v by its quarters' counts; start and least and largest counts of each tile."""
    q = _quarters(v)
    order = np.lexsort((q[:, 3], q[:, 2], q[:, 1], q[:, 0]))
    starts = np.arange(0, len(v), TILE)
    q = q[order]
    return order, starts, np.minimum.reduceat(q, starts), np.maximum.reduceat(q, starts)


def close_pairs(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all pairs within the radius; right=None: left against itself."""
    same = right is None
    lo, ls, lmin, lmax = _sorted_tiles(left)
    ro, rs, rmin, rmax = (lo, ls, lmin, lmax) if same else _sorted_tiles(right)
    a = left[lo]
    b = a if same else right[ro]
    out_i, out_j = [], []
    for t in range(len(ls)):
        gap = np.maximum(0, np.maximum(lmin[t] - rmax, rmin - lmax[t])).sum(1)
        near = np.flatnonzero(gap <= radius)
        for u in near[near >= t] if same else near:
            x, y = a[ls[t] : ls[t] + TILE], b[rs[u] : rs[u] + TILE]
            i, j = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
            if same and t == u:
                i, j = i[i < j], j[i < j]
            if len(i):
                out_i.append(lo[ls[t] + i])
                out_j.append(ro[rs[u] + j])
    none = np.zeros(0, np.int64)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (none, none)


def links_within(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """distinct: fp (long, no two equal). Links (a, b) whose components are those of all pairs within the radius."""
    spark = distinct.sparkSession
    high = F.bit_count(F.shiftrightunsigned("fp", 32)).alias("hi")
    low = F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).alias("lo")
    counted = distinct.select("fp", high, low)
    # at most 33 * 33 rows, whatever the number of fingerprints
    sizes = {(r["hi"], r["lo"]): r["n"] for r in counted.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = {k: -(-n // BLOCK) for k, n in sizes.items()}
    dealt = spark.createDataFrame([(hi, lo, n) for (hi, lo), n in blocks.items()], "hi int, lo int, n int")
    counted = counted.join(F.broadcast(dealt), ["hi", "lo"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    packed = counted.groupBy("hi", "lo", "part").agg(F.collect_list("fp").alias("fps"))
    packed = materialise(packed, "tiles")

    # each block against itself and the blocks after it in order of (hi, lo, part) that are within the radius
    def after(hi: int, lo: int) -> list[tuple[int, int, int]]:
        return [
            (h, w, blocks[h, w])
            for h in range(hi - radius, hi + radius + 1)
            for w in range(lo - radius, lo + radius + 1)
            if (h, w) in blocks and abs(h - hi) + abs(w - lo) <= radius and (h, w) >= (hi, lo)
        ]

    plan = spark.createDataFrame([(hi, lo, after(hi, lo)) for hi, lo in blocks], "hi int, lo int, others array<struct<h:int,w:int,n:int>>")
    left = packed.join(F.broadcast(plan), ["hi", "lo"]).withColumn("o", F.explode("others")).select("hi", "lo", "part", "fps", "o.*")
    left = left.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    left = left.where((F.col("h") != F.col("hi")) | (F.col("w") != F.col("lo")) | (F.col("q") >= F.col("part")))
    right = packed.select(F.col("hi").alias("h"), F.col("lo").alias("w"), F.col("part").alias("q"), F.col("fps").alias("others"))
    pairs = left.join(right, ["h", "w", "q"]).select(
        "fps", F.when((F.col("h") == F.col("hi")) & (F.col("w") == F.col("lo")) & (F.col("q") == F.col("part")), F.lit(None)).otherwise(F.col("others")).alias("others")
    )

    def compare(batches):
        for batch in batches:
            found_a, found_b = [], []
            for mine, other in zip(batch["fps"], batch["others"], strict=True):
                x = np.asarray(mine, np.int64)
                if other is None:
                    values = x
                    i, j = close_pairs(x.view(np.uint64), None, radius)
                else:
                    y = np.asarray(other, np.int64)
                    values = np.concatenate([x, y])
                    i, j = close_pairs(x.view(np.uint64), y.view(np.uint64), radius)
                    j = j + len(x)
                r, m = _forest(i, j)
                found_a.append(values[r])
                found_b.append(values[m])
            yield pd.DataFrame({"a": np.concatenate(found_a), "b": np.concatenate(found_b)})

    return pairs.mapInPandas(compare, "a long, b long")


def near_groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints: _id, fp. Returns fp, component (a fingerprint that names it) and component_id (the least _id in reach) for each distinct fp."""
    firsts = materialise(prints.groupBy("fp").agg(F.min("_id").alias("first")), "fps")
    reach = connected_components(links_within(firsts.select("fp"), radius), "a", "b").withColumnRenamed("node", "fp")
    labelled = firsts.join(reach, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    return labelled.join(least, "component").select("fp", "component", "component_id")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prints = materialise(docs.select(F.col("doc_id").alias("_id"), fingerprints("text").alias("fp")), "prints")
    return prints.join(near_groups(prints), "fp").select(F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, shingle: int = STAGE_SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of `shingle` words; of fewer words, the hash of them all."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return np.unique(rolling(h, min(shingle, len(words)))) if words else h


def prints_of(h: np.ndarray) -> np.ndarray:
    """PRINTS fingerprints of 64 bits of a set of hashes, each over a mix of its own."""
    z = h[:, None] + np.arange(PRINTS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z = np.ascontiguousarray(z ^ (z >> np.uint64(31))).view(np.uint8)
    counts = np.zeros(64 * PRINTS, np.int64)
    for i in range(0, len(z), 255):
        counts += np.unpackbits(z[i : i + 255], axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * counts > len(h), bitorder="little").view("<u8")


_SKETCH = ["key", "size", *[f"p{k}" for k in range(PRINTS)]]


def sketches(text: str | Column) -> Column:
    """struct<key, size, p0, ...>: a hash that names the set of shingles (0: none), its size and its fingerprints."""

    @F.pandas_udf(", ".join(f"{c} long" for c in _SKETCH))
    def of(texts: pd.Series) -> pd.DataFrame:
        import xxhash

        out = np.zeros((len(texts), len(_SKETCH)), np.uint64)
        for row, t in zip(out, texts, strict=True):
            h = shingle_set(t)
            if len(h):
                row[0], row[1], row[2:] = xxhash.xxh64_intdigest(h.tobytes()), len(h), prints_of(h)
        return pd.DataFrame(out.view(np.int64), columns=_SKETCH)

    return of(text)


def _near(x: np.ndarray, y: np.ndarray, same: bool):
    """Candidates between blocks x and y (columns: _SKETCH and more), both in order of size, tile by tile: positions i and j and the bits they differ in."""
    xp, yp = np.ascontiguousarray(x[:, 2 : 2 + PRINTS].T).view(np.uint64), np.ascontiguousarray(y[:, 2 : 2 + PRINTS].T).view(np.uint64)
    num, den = SIMILAR
    side = 4 * TILE
    for s in range(0, len(x), side):
        m = x[s : s + side, 1]
        lo = np.searchsorted(y[:, 1] * den, m[0] * num, "left")
        hi = np.searchsorted(y[:, 1] * num, m[-1] * den, "right")
        if same:
            lo = max(lo, s)
        for u in range(lo, hi, side):
            v = slice(u, min(u + side, hi))
            i, j = np.nonzero(np.bitwise_count(xp[0, s : s + side, None] ^ yp[0, None, v]) <= STAGE_RADIUS)
            i, j = i + s, j + u
            if same:
                i, j = i[i < j], j[i < j]
            a, b = x[i, 1], y[j, 1]
            keep = (np.minimum(a, b) * den >= np.maximum(a, b) * num) & (x[i, 0] != y[j, 0])
            i, j, few = i[keep], j[keep], np.minimum(a, b)[keep] <= FEW
            apart = np.bitwise_count(xp[:, i] ^ yp[:, j]).sum(0, dtype=np.int64)
            keep = apart <= np.where(few, WIDE_FEW, WIDE)
            if keep.any():
                yield i[keep], j[keep], apart[keep]


class _Joined:
    """Groups of positions, joined as links are found; group names every position's."""

    def __init__(self, group: np.ndarray):
        self.group = np.unique(group, return_inverse=True)[1].astype(np.int64)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Join the groups of a and b, link by link; whether each link joined two."""
        root = np.arange(int(self.group.max(initial=-1)) + 1).tolist()

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = k = root[root[k]]
            return k

        new = np.zeros(len(a), bool)
        for k, (p, q) in enumerate(zip(self.group[a].tolist(), self.group[b].tolist(), strict=True)):
            p, q = find(p), find(q)
            if p != q:
                root[max(p, q)] = min(p, q)
                new[k] = True
        if new.any():
            self.group = np.array([find(k) for k in range(len(root))], np.int64)[self.group]
        return new


def _forest_of_candidates(x: np.ndarray, y: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of a spanning forest of the candidates: of those that are the closest or the first of a row or column of a tile, the closest."""
    x_order, y_order = np.argsort(x[:, 1], kind="stable"), np.argsort(y[:, 1], kind="stable")
    found = []
    for i, j, apart in _near(x[x_order], y[y_order], same):
        chosen = [np.unique(k, return_index=True)[1] for k in (i, j)]
        near = np.argsort(apart, kind="stable")
        chosen += [near[np.unique(k[near], return_index=True)[1]] for k in (i, j)]
        chosen = np.unique(np.concatenate(chosen))
        found.append((i[chosen], j[chosen], apart[chosen]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j, apart = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(apart, kind="stable")
    i, j = i[order], j[order]
    new = _Joined(np.arange(len(x) + (0 if same else len(y)))).join(i, j + (0 if same else len(x)))
    return x_order[i[new]], y_order[j[new]]


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many hashes the sets left[i] and right[j] share, for each pair."""
    own = np.unique(j)
    salt = np.arange(len(own), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    # every set of the right side in one sorted array, told apart by a salt of its own
    with np.errstate(over="ignore"):
        every = np.sort(np.concatenate([right[k] ^ salt[m] for m, k in enumerate(own.tolist())]))
    place = np.searchsorted(own, j)
    out = np.zeros(len(i), np.int64)
    size = np.array([len(left[k]) for k in i.tolist()])
    first = 0
    for last in (np.flatnonzero(np.diff(np.cumsum(size) // SET_CHUNK)) + 1).tolist() + [len(i)]:
        n = size[first:last]
        asked = np.concatenate([left[k] for k in i[first:last].tolist()]) ^ np.repeat(salt[place[first:last]], n)
        at = np.minimum(np.searchsorted(every, asked), len(every) - 1)
        out[first:last] = np.add.reduceat((every[at] == asked).astype(np.int64), np.cumsum(n) - n)
        first = last
    return out


def _forest_of_similar(x: np.ndarray, y: np.ndarray, x_sets: list[np.ndarray], y_sets: list[np.ndarray], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of a spanning forest of the similar pairs of different components (the column after _SKETCH)."""
    x_order, y_order = np.argsort(x[:, 1], kind="stable"), np.argsort(y[:, 1], kind="stable")
    x, y = x[x_order], y[y_order]
    x_sets, y_sets = [x_sets[k] for k in x_order.tolist()], [y_sets[k] for k in y_order.tolist()]
    far = 0 if same else len(x)
    joined = _Joined(x[:, -1] if same else np.concatenate([x[:, -1], y[:, -1]]))
    num, den = SIMILAR
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j, _ in _near(x, y, same):
        apart = joined.group[i] != joined.group[j + far]
        i, j = i[apart], j[apart]
        if not len(i):
            continue
        shared = shared_counts(x_sets, y_sets, i, j)
        alike = shared * den >= (x[i, 1] + y[j, 1] - shared) * num
        i, j = i[alike], j[alike]
        new = joined.join(i, j + far)
        out_i.append(i[new])
        out_j.append(j[new])
    return x_order[np.concatenate(out_i)], y_order[np.concatenate(out_j)]


def block_pairs(sets: DataFrame, columns: list[str], with_sets: bool) -> DataFrame:
    """sets: _SKETCH, columns and, if with_sets, set (binary). Pairs of blocks that may hold candidates: rows (_SKETCH and
    columns, flat), sets, and others, other_sets (null: the block itself)."""
    spark = sets.sparkSession
    # sizes that are similar fall in the same band or in adjacent ones (a little wider than the ratio, for rounding)
    width = float(np.log(1.01 * SIMILAR[1] / SIMILAR[0]))
    banded = sets.withColumn("band", F.floor(F.log(F.col("size").cast("double")) / width).cast("int"))
    most = lambda band: max(1, min(BLOCK, int(SET_BLOCK / np.exp((band + 1) * width)))) if with_sets else BLOCK
    blocks = {r["band"]: -(-r["n"] // most(r["band"])) for r in banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()}  # a few dozen rows
    dealt = spark.createDataFrame(list(blocks.items()), "band int, n int")
    banded = banded.join(F.broadcast(dealt), "band").withColumn("part", F.pmod(F.xxhash64("key"), F.col("n")).cast("int"))
    row = F.struct(F.array(*_SKETCH, *columns).alias("row"), (F.col("set") if with_sets else F.lit(None).cast("binary")).alias("set"))
    tiles = banded.groupBy("band", "part").agg(F.collect_list(row).alias("t"))
    tiles = materialise(tiles.select("band", "part", F.flatten("t.row").alias("rows"), F.col("t.set").alias("sets")), "tiles")
    # each block with itself and the blocks after it in its own and the next band
    plan = spark.createDataFrame([(k, w, blocks[w]) for k in blocks for w in (k, k + 1) if w in blocks], "band int, w int, n_w int")
    left = tiles.join(F.broadcast(plan), "band").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("n_w") - 1))).where((F.col("w") != F.col("band")) | (F.col("q") >= F.col("part")))
    right = tiles.select(F.col("band").alias("w"), F.col("part").alias("q"), F.col("rows").alias("others"), F.col("sets").alias("other_sets"))
    own = (F.col("band") == F.col("w")) & (F.col("part") == F.col("q"))
    pairs = left.join(right, ["w", "q"]).select("rows", "sets", F.when(~own, F.col("others")).alias("others"), F.when(~own, F.col("other_sets")).alias("other_sets"))
    # about one pair of blocks a task, as what Python gets at once isn't bounded by bytes
    n_pairs = sum(n * (n + 1) // 2 + n * blocks.get(k + 1, 0) for k, n in blocks.items())
    return pairs.repartition(min(100_000, max(spark.sparkContext.defaultParallelism, n_pairs)))


def linked(pairs: DataFrame, n_columns: int, verified: bool) -> DataFrame:
    """Keys (a, b) of the forest of each pair of blocks: of candidates, or, verified, of similar sets."""

    def compare(batches):
        for batch in batches:
            for mine, own_sets, other, other_sets in zip(batch["rows"], batch["sets"], batch["others"], batch["other_sets"], strict=True):
                x = np.asarray(mine, np.int64).reshape(-1, len(_SKETCH) + n_columns)
                y = x if other is None else np.asarray(other, np.int64).reshape(-1, len(_SKETCH) + n_columns)
                if verified:
                    x_sets = [np.frombuffer(s, np.uint64) for s in own_sets]
                    y_sets = x_sets if other is None else [np.frombuffer(s, np.uint64) for s in other_sets]
                    i, j = _forest_of_similar(x, y, x_sets, y_sets, other is None)
                else:
                    i, j = _forest_of_candidates(x, y, other is None)
                yield pd.DataFrame({"a": np.minimum(x[i, 0], y[j, 0]), "b": np.maximum(x[i, 0], y[j, 0])})

    return pairs.mapInPandas(compare, "a long, b long").distinct()


def sets_of(keys: DataFrame, members: DataFrame, texts: DataFrame) -> DataFrame:
    """key and set (its hashes as bytes). keys: key. members: key, _hash, _id of one row for each key; texts: _id, _hash, _text."""

    @F.pandas_udf("binary")
    def as_set(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t).tobytes() for t in texts])

    asked = keys.join(members, "key").select("key", F.col("_hash").alias("_h"), F.col("_id").alias("_i"))
    # one row a key, except where ids repeat
    rows = texts.join(asked, (F.col("_hash") == F.col("_h")) & F.col("_id").eqNullSafe(F.col("_i"))).select("key", "_text").dropDuplicates(["key"])
    return rows.select("key", as_set("_text").alias("set"))


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets (key, set) are similar; pairs are links of a forest, so they grow with the sets."""

    @F.pandas_udf("boolean")
    def alike(left: pd.Series, right: pd.Series) -> pd.Series:
        num, den = SIMILAR
        out = []
        for x, y in zip(left, right, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            out.append(shared * den >= (len(x) + len(y) - shared) * num)
        return pd.Series(out, dtype=bool)

    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("key").alias("b"), F.col("set").alias("sb")), "b")
    return both.where(alike("sa", "sb")).select("a", "b")


def similar_groups(prints: DataFrame, texts: DataFrame) -> DataFrame:
    """key and component of each set that is similar to another; prints: _id, _hash, _SKETCH of every row."""
    # all rows of a key have the same sketch
    one = F.min(F.struct("_hash", "_id")).alias("m")
    sketched = materialise(prints.where("size > 0").groupBy("key").agg(one, *[F.min(c).alias(c) for c in _SKETCH[1:]]).select(*_SKETCH, "m.*"), "sketches")
    first = materialise(linked(block_pairs(sketched.select(*_SKETCH), [], False), 0, False), "candidates")
    # the forest touches every set that has a candidate
    touched = first.select(F.col("a").alias("key")).union(first.select("b")).distinct()
    sets = materialise(sets_of(touched, sketched.select("key", "_hash", "_id"), texts), "sets")
    links = materialise(similar(first, sets), "similar")
    joined = connected_components(links, "a", "b").withColumnRenamed("node", "key")
    left = sketched.select(*_SKETCH).join(sets, "key").join(joined, "key", "left").withColumn("component", F.coalesce("component", "key"))
    rest = materialise(linked(block_pairs(left, ["component"], True), 1, True), "similar")
    return connected_components(links.union(rest), "a", "b").withColumnRenamed("node", "key")


def simhash_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: that of the least doc_id (of several rows with it, one)."""
    rows = packed(docs).withColumn("_doc", F.col("_row.doc_id")).withColumn("_text_hash", F.xxhash64("_row.text"))
    texts = rows.select(F.col("_doc").alias("_id"), F.col("_text_hash").alias("_hash"), F.col("_row.text").alias("_text"))
    prints = materialise(texts.select("_id", "_hash", sketches("_text").alias("s")).select("_id", "_hash", "s.*"), "prints")
    groups = materialise(similar_groups(prints, texts), "groups")
    grouped = prints.select("_id", "_hash", "key").join(groups, "key", "left").select("_id", "_hash", F.coalesce("component", "key").alias("component"))
    # rows of a group by id and text: several only where ids repeat or are null
    grouped = grouped.groupBy("component", "_id", "_hash").agg(F.count(F.lit(1)).alias("n"))
    ranked = F.struct(F.col("_id").isNull().alias("none"), "_id", "_hash", "n")
    firsts = grouped.groupBy("component").agg(F.min(ranked).alias("one")).select("one.*")
    kept = rows.join(firsts, (F.col("_text_hash") == F.col("_hash")) & F.col("_doc").eqNullSafe(F.col("_id")))
    several = kept.where("n > 1").dropDuplicates(["_hash", "_id"])
    return kept.where("n = 1").unionByName(several).select("_row.*")
