"""Token ids in Re-Pair shards.

Documents in ascending order of id are cut into ranges of near equal bytes (sampled
splitters), and ranges above one and a half shards' size once more by running sums of bytes, so
that a shard stays small at any size of the whole. A shard's texts are encoded, each followed by the end id, and its sequence of
ids is compressed by Re-Pair: pairs of symbols that are frequent in the shard are
replaced by nonterminals, round after round, until no pair is frequent or the symbols of
the shard's width are used up. A round takes all pairs within a factor `ROUND` of the
most frequent one, runs of overlapping pairs alternately from the left. The file is a
Parquet table with a row for each shard: the rules (left, right and expansion length),
the sequence that is left, and ids and lengths of the documents, so any range of ids can be
decoded without the rest of the shard (`decode_range`).

Encoding goes word by word through a cache where the tokenizer allows it: a byte-level
pre-tokenizer never joins what a single space between two other characters, or a line
break between two, separates. Other tokenizers encode whole texts, and so do all where a
text holds the string of a special or added token: the library decides what becomes of it
(`plain_specials=True` makes it ordinary text, so that a text can't inject special ids).

Defined results: a null or empty text is the end id alone; null ids come first; equal ids
stand in order of their text's hash; equal rows are rows of their own; an empty table
gives an empty result; only the named columns are read, so further columns can't clash.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, new_path, table
from .sharding import MAX_RANGES, sampled_splitters, with_range

SHARD_BYTES = 2 << 20
#: A pair is frequent from this count on; a round takes pairs of at least 1 / ROUND of the top count.
LEAST_PAIRS, ROUND = 24, 32
#: Words that a worker keeps, at some 35 bytes each, and the longest of them in bytes.
CACHE_WORDS, LONGEST = 1_000_000, 40
JOINED = 100
#: White space beyond single spaces and line breaks between other characters: such texts are encoded whole.
_ODD = ("  ", " \n", "\n ", "\n\n", *"\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)))


#: Tokenizer files read by this worker, and the words met with them: later shards find both.
_READ: dict[tuple[str, str, bool], tuple] = {}


def odd_space(text: str) -> bool:
    return any(x in text for x in _ODD) or text[:1].isspace() or text[-1:].isspace()


class Words:
    """Ids of words met before, found by 128 bits of hash: sorted arrays, so that a million words take some 35 MB."""

    def __init__(self, dtype: str):
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.n = np.zeros(0, np.int32), np.zeros(0, np.uint16)
        self.data = np.zeros(1 << 16, dtype)
        self.used = 0

    @staticmethod
    def hashed(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two polynomial hashes of each of many short byte strings that lie in one buffer, over their first LONGEST bytes."""
        size = np.minimum(np.diff(offsets), LONGEST)
        order = np.argsort(-size, kind="stable")
        start, size = offsets[:-1][order], size[order]
        alive = np.searchsorted(-size, -np.arange(LONGEST), "left")  # strings of more than i bytes
        a, b = size.astype(np.uint64), size.astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            for i, n in enumerate(alive.tolist()):
                if not n:
                    break
                byte = data[start[:n] + i].astype(np.uint64) + np.uint64(1)
                a[:n] = (a[:n] ^ byte) * np.uint64(0x9E3779B97F4A7C15)
                a[:n] ^= a[:n] >> np.uint64(29)
                b[:n] = b[:n] * np.uint64(0xD6E8FEB86659FD93) + byte
            b ^= b >> np.uint64(32)
        key, check = np.empty_like(a), np.empty_like(b)
        key[order], check[order] = a, b
        return key, check

    def find(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each is there, and where."""
        if not len(self.key):
            return np.zeros(len(key), bool), np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return (self.key[at] == key) & (self.check[at] == check), at

    def add(self, key: np.ndarray, check: np.ndarray, ids: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
        while self.used + len(ids) > len(self.data):
            self.data = np.append(self.data, np.zeros_like(self.data))
        self.data[self.used : self.used + len(ids)] = ids
        order = np.argsort(key, kind="stable")
        into = np.searchsorted(self.key, key[order])
        self.key, self.check = np.insert(self.key, into, key[order]), np.insert(self.check, into, check[order])
        self.at = np.insert(self.at, into, (start + self.used)[order].astype(np.int32))
        self.n = np.insert(self.n, into, (stop - start)[order].astype(np.uint16))
        self.used += len(ids)


class Encoder:
    """Texts to ids of the given little-endian type by a tokenizers file."""

    def __init__(self, path: str, dtype: str, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.dtype = dtype
        if (path, dtype, plain_specials) not in _READ:
            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = plain_specials
            pre = tokenizer.pre_tokenizer
            broken = tokenizer.encode("\n", add_special_tokens=False).ids
            by_word = tokenizer.normalizer is None and type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and pre.use_regex and len(broken) == 1
            added = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
            _READ[path, dtype, plain_specials] = tokenizer, by_word, broken[0] if broken else None, added, Words(dtype)
        self.tokenizer, self.by_word, self.line_break, self.added, self.known = _READ[path, dtype, plain_specials]

    def _whole(self, text: str) -> bool:
        """Whether a text must be encoded in one go."""
        return not self.by_word or odd_space(text) or any(x in text for x in self.added)

    def _fast(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words, with the space or line break that stands before each: one array, and each word's start and stop in it.

        Many words are encoded as one text with a line break between them.
        """
        whole = self._fast([self._joined(words[i : i + JOINED]) for i in range(0, len(words), JOINED)])
        ids = np.array(list(chain.from_iterable(whole)), self.dtype)
        cuts = np.flatnonzero(ids == self.line_break)
        if len(cuts) != len(words):  # a tokenizer that gives line breaks no id of their own
            each = self._fast([w if w[:1] == "\n" else f" {w}" for w in words])
            stop = np.cumsum(np.fromiter(map(len, each), np.int64, len(each)))
            return np.array(list(chain.from_iterable(each)), self.dtype), np.append(0, stop[:-1]), stop
        broken = np.fromiter((w[:1] == "\n" for w in words), bool, len(words))
        return ids, cuts + ~broken, np.append(cuts[1:], len(ids))

    @staticmethod
    def _joined(words: list[str]) -> str:
        return "".join([w if w[:1] == "\n" else f"\n {w}" for w in words])

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by the end id, and how many each has.

        Words are told apart and numbered outside Python; Python sees each distinct word once.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        if not texts:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        odd = [self._whole(t) for t in texts]
        split = pc.split_pattern(pa.array(["" if o else t.replace("\n", " \n") for t, o in zip(texts, odd, strict=True)], pa.large_string()), " ")
        words = pc.list_flatten(split).dictionary_encode()
        names, code = words.dictionary, words.indices.to_numpy().astype(np.int64)
        del words
        first = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())[:-1]])
        # a text's first word has no space before it, and an odd text is one word: both are encoded as they stand
        whole = self._fast([t if o else t.replace("\n", " \n").split(" ", 1)[0] for t, o in zip(texts, odd, strict=True)])
        _, offsets, raw = names.buffers()
        offsets = np.frombuffer(offsets, np.int64)[names.offset : names.offset + len(names) + 1]
        key, check = Words.hashed(offsets, np.frombuffer(raw or b"", np.uint8))
        there, place = self.known.find(key, check)
        length = np.diff(offsets)
        there &= length <= LONGEST

        # what a code stands for: names, then each text's own first word, then the end id
        at, n = (np.empty(len(names) + len(texts) + 1, np.int64) for _ in range(2))
        old, new = np.flatnonzero(there & (length > 0)), np.flatnonzero(~there & (length > 0))
        at[: len(names)], n[: len(names)] = 0, 0  # what an empty or odd text splits into has no ids
        at[old], n[old] = self.known.at[place[old]], self.known.n[place[old]]
        own = np.array([*chain.from_iterable(whole), end_id], self.dtype)
        size = np.fromiter(map(len, [*whole, [end_id]]), np.int64, len(whole) + 1)
        base = self.known.used
        at[len(names) :], n[len(names) :] = base + np.cumsum(size) - size, size
        learnt = np.zeros(0, self.dtype)
        if len(new):
            learnt, start, stop = self._learn(names.take(pa.array(new)).to_numpy(zero_copy_only=False).tolist())
            at[new], n[new] = base + len(own) + start, stop - start
        data = np.concatenate([self.known.data[:base], own, learnt])
        if len(new) and len(self.known.key) < CACHE_WORDS:
            short = (length <= LONGEST)[new]
            self.known.add(key[new][short], check[new][short], learnt, start[short], stop[short])
        code[first] = len(names) + np.arange(len(texts))
        code = np.insert(code, np.append(first[1:], len(code)), len(at) - 1)
        first = first + np.arange(len(texts))
        at, n = at[code], n[code]
        ends = np.cumsum(n)
        kind = np.int32 if ends[-1] < 1 << 31 and len(data) < 1 << 31 else np.int64  # a shard is small
        place = np.repeat((at - (ends - n)).astype(kind), n)
        place += np.arange(ends[-1], dtype=kind)
        del split, names
        pa.default_memory_pool().release_unused()  # a worker lives on with what its pools hold
        return data[place], np.add.reduceat(n, first)


def repair(ids: np.ndarray, first_free: int, end: int, least: int = LEAST_PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sequence left, and the left and right symbol of rule i (symbol first_free + i); symbols stay under end."""
    s = ids.astype(np.uint32)
    lefts, rights = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
    free = first_free
    narrow = end <= 1 << 16
    while len(s) > 1 and free < end:
        code = (s[:-1] << np.uint32(16)) | s[1:] if narrow else (s[:-1].astype(np.uint64) << np.uint64(32)) | s[1:]
        ordered = np.sort(code)
        starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        counts = np.diff(np.append(starts, len(ordered)))
        top = int(counts.max())
        if top < least:
            break
        frequent = np.flatnonzero(counts >= max(least, top // ROUND))
        # the most frequent first; a pair that meets an earlier one's slot waits for the next round
        frequent = frequent[np.lexsort((ordered[starts[frequent]], -counts[frequent]))][: end - free]
        pairs = ordered[starts[frequent]]
        bits = 18
        slot = _slots(pairs, bits)
        _, own = np.unique(slot, return_index=True)
        pairs = pairs[np.sort(own)]
        slots = np.full(1 << bits, len(pairs), np.int32)
        slots[_slots(pairs, bits)] = np.arange(len(pairs))
        rule = slots[_slots(code, bits)]
        # the extra entry's own slot holds another pair or none, so it never equals a code that got there
        at = np.flatnonzero(rule < len(pairs))
        at = at[pairs[rule[at]] == code[at]]
        run = np.append(True, at[1:] != at[:-1] + 1)
        first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - first) % 2 == 0]
        s[at] = (rule[at] + free).astype(np.uint32)
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        s = s[keep]
        low = np.uint32(16) if narrow else np.uint64(32)
        lefts.append((pairs >> low).astype(np.uint32))
        rights.append((pairs & pairs.dtype.type(0xFFFF if narrow else 0xFFFFFFFF)).astype(np.uint32))
        free += len(pairs)
    return s, np.concatenate(lefts), np.concatenate(rights)


def _slots(code: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        if code.dtype == np.uint32:
            return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
        return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.uint32)


def lengths(left: np.ndarray, right: np.ndarray, first_free: int) -> np.ndarray:
    """Expansion length of each rule; rules name only terminals and earlier rules."""
    out = np.ones(len(left), np.int64)
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        out[i] = (1 if a < first_free else out[a - first_free]) + (1 if b < first_free else out[b - first_free])
    return out


def expand(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, first_free: int) -> np.ndarray:
    # all rules' expansions in one array, built by expanding the rules themselves level by level
    of = np.append(np.ones(first_free, np.int64), lengths(left, right, first_free))
    at = np.cumsum(of) - of
    data = np.empty(int(of.sum()), np.uint32)
    data[:first_free] = np.arange(first_free)
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        start, middle = at[first_free + i], at[first_free + i] + of[a]
        data[start:middle] = data[at[a] : at[a] + of[a]]
        data[middle : middle + of[b]] = data[at[b] : at[b] + of[b]]
    n = of[symbols]
    ends = np.cumsum(n)
    return data[np.repeat(at[symbols] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def decode_range(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, length: np.ndarray, first_free: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a shard: only the symbols that cover them are expanded."""
    of = np.ones(len(symbols), np.int64)
    inner = symbols >= first_free
    of[inner] = length[symbols[inner] - first_free]
    ends = np.cumsum(of)
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
    if stop <= start:
        return np.zeros(0, np.uint32)
    before = int(ends[a] - of[a])
    return expand(symbols[a:b], left, right, first_free)[start - before : stop - before]


#: A shard's number: that of its range, then its own in the range.
PART_BITS = 24
SHARD_SCHEMA = "shard long, doc_ids array<long>, doc_tokens array<long>, first_free long, width int, rule_left binary, rule_right binary, rule_length binary, symbols binary"


def write_shards(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 0,
    shard_bytes: int = SHARD_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
    plain_specials: bool = False,
    max_ranges: int = MAX_RANGES,
) -> DataFrame:
    """Write the token table to path; returns it as read back. A shard has about shard_bytes of text, more only if a document alone has."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        text.alias("_text"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_k1"),
        F.xxhash64(text).alias("_k2"),
        (F.octet_length(text) + 1).cast("long").alias("_size"),
    )
    narrow = materialise(rows.drop("_text"), "keys")
    total = narrow.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    splitters, ranges = sampled_splitters(narrow, int(min(max_ranges, max(1, total // shard_bytes))), total)
    # bytes of the shards of each range: the range cut into equal parts of at most one and a half shards' size
    steps = np.full(len(splitters.first) + 1, shard_bytes, np.int64)
    steps[ranges["_range"].to_numpy(np.int64)] = [-(-n // -(-2 * n // (3 * shard_bytes))) for n in ranges["bytes"].tolist()]

    @F.pandas_udf("long")
    def step(at: pd.Series) -> pd.Series:
        return pd.Series(steps[at.to_numpy()])

    before = F.sum("_size").over(Window.partitionBy("_range").orderBy("_k1", "_k2").rowsBetween(Window.unboundedPreceding, -1))
    ranged = with_range(rows, splitters).withColumn("_step", step("_range")).withColumn("_part", F.floor(F.coalesce(before, F.lit(0)) / F.col("_step")))
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size()
    width = 2 if vocabulary < 1 << 16 else 4
    symbol = f"<u{width}"

    def encode(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_k1", "_k2"], kind="stable")
        ids, doc_tokens = Encoder(tokenizer, symbol, plain_specials).encode(pdf["_text"].tolist(), end_id)
        s, left, right = repair(ids, vocabulary, 1 << 16 if width == 2 else 1 << 32)
        row = {
            "shard": (int(key[0]) << PART_BITS) + int(key[1]),
            "doc_ids": [None if x is None or x != x else int(x) for x in pdf["_id"]],
            "doc_tokens": doc_tokens,
            "first_free": vocabulary,
            "width": width,
            "rule_left": left.astype(symbol).tobytes(),
            "rule_right": right.astype(symbol).tobytes(),
            "rule_length": lengths(left, right, vocabulary).astype("<u4").tobytes(),
            "symbols": s.astype(symbol).tobytes(),
        }
        return pd.DataFrame([row])

    shards = ranged.groupBy("_range", "_part").applyInPandas(encode, SHARD_SCHEMA)
    shards.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(shards.schema).parquet(path)


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 (as little-endian unsigned 32-bit integers), decoded from the shards."""
    counted = shards.select("shard", F.shiftrightunsigned("shard", PART_BITS).alias("range"), F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    counted = materialise(counted, "counted")
    running = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a range, of which there are at most twice MAX_RANGES; then one a shard, range by range
    ranges = counted.groupBy("range").agg(F.sum("n").alias("n")).select("range", running(Window.orderBy("range")).alias("of_range"))
    starts = counted.withColumn("in_range", running(Window.partitionBy("range").orderBy("shard"))).join(ranges, "range")
    starts = starts.select("shard", (F.col("of_range") + F.col("in_range")).cast("long").alias("shard_start"))

    def decode(batches):
        for batch in batches:
            for r in batch.itertuples():
                symbol = f"<u{r.width}"
                left, right, s = (np.frombuffer(x, symbol).astype(np.uint32) for x in (r.rule_left, r.rule_right, r.symbols))
                ids = expand(s, left, right, r.first_free).astype("<u4")
                ends = np.cumsum(np.asarray(r.doc_tokens, np.int64))
                at = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                data = memoryview(ids).cast("B")
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
                yield pd.DataFrame(
                    {"shard": r.shard, "doc_id": pd.array([None if x is None or x != x else int(x) for x in r.doc_ids], "Int64"), "at": at, "n_tokens": ends - at, "ids_crc32": np.array(crc, np.int64)}
                )

    rows = shards.drop("rule_length").mapInPandas(decode, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(starts, "shard").select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_repair_tokens(spark, sf_dir: str) -> DataFrame:
    return read_documents(write_shards(table(spark, sf_dir, "documents"), new_path(spark, "tokens"), default_tokenizer()))


def tokens_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token table of documents, a row for each document as read back from it."""
    return read_documents(write_shards(docs, new_path(spark, "tokens"), default_tokenizer()))
