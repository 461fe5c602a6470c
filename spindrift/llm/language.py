"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds all substrings of some labelled text. A text is
parsed against it into phrases, each the longest match from where the last one ended (a
byte that the language lacks is a phrase of its own). Few phrases mean little cross-entropy:
phrases * log2(training length) / text length, in bits a byte. The language of the least
wins; its score is its share of 2 ** -bits over all languages.

Texts are lower-cased UTF-8 and parsed in blocks of BLOCK bytes (a phrase ends at a block's
end), all blocks of a batch in lockstep: one lookup for a byte of every block and language
at once. The automata's rows of transitions are laid into each other's gaps, so memory grows
with transitions, at most three a byte learnt, and not with states times bytes.

Training takes whole-corpus counts of the labels, then pieces of at most DOCS documents a
language, TRAIN_BYTES in all (both documented bounds; less for over 50 languages), drawn by
a seeded hash. More than MAX_LANGS labels are an error. Every text is parsed whole.

Defined results: null texts and those without a letter are `und`, score 0; without any
labelled text all are; of equal entropies the first language in code point order wins;
null ids are not held out and not learnt from; equal texts get equal results; an empty
table gives an empty result; only the named columns are read, so further columns can't
clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import seeded, table

TRAIN_BYTES, DOCS, ALL_BYTES, BLOCK, BATCH_BYTES, MAX_LANGS = 24_000, 40, 1_200_000, 1_024, 4 << 20, 1_000
UNKNOWN = "und"


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of each state; state 0 is the root, every path from it spells a substring."""
    nexts: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p != -1:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return nexts


def lay_out(nexts: list[dict[int, int]]) -> tuple[np.ndarray, int]:
    """A place for each state, no two alike, such that place + byte is a slot of its own for each transition; and how many slots.

    States of several transitions take the first place where all their slots are free, those of one fill what is left.
    """
    window = 2_048
    size = window + 512 + 2 * sum(map(len, nexts))
    slot_free, place_free = np.ones(size + 256, bool), np.ones(size, bool)
    slot_free[:256] = False  # so that a place never falls below 0
    place = np.zeros(len(nexts), np.int64)
    several = sorted((i for i, x in enumerate(nexts) if len(x) > 1), key=lambda i: -len(nexts[i]))
    low = 0
    for k, i in enumerate(several):
        at = list(nexts[i])
        start = low
        while True:
            if start + window > len(place_free):  # rare: rows that don't fit into each other
                slot_free, place_free = (np.append(x, np.ones(len(x), bool)) for x in (slot_free, place_free))
            fits = place_free[start : start + window].copy()
            for byte in at:
                fits &= slot_free[start + byte : start + byte + window]
            j = int(fits.argmax())
            if fits[j]:
                break
            start += window
        place[i] = start + j
        place_free[start + j] = False
        slot_free[start + j + np.array(at)] = False
        if k % 256 == 0:
            low = max(0, int(slot_free.argmax()) - 255)
    todo = np.array([i for i, x in enumerate(nexts) if len(x) == 1], np.int64)
    byte = np.array([next(iter(nexts[i])) for i in todo.tolist()], np.int64)
    while len(todo):
        slots = np.flatnonzero(slot_free[: len(place_free)])[: 2 * len(todo)]
        if len(slots) < len(todo):
            slot_free, place_free = (np.append(x, np.ones(len(x), bool)) for x in (slot_free, place_free))
            continue
        slots = slots[: len(todo)]
        want = slots - byte
        first = np.zeros(len(todo), bool)
        first[np.unique(want, return_index=True)[1]] = True
        first &= place_free[want]
        place[todo[first]] = want[first]
        place_free[want[first]] = False
        slot_free[slots[first]] = False
        if not first.any():
            slot_free[slots] = False  # no one-transition state can stand there
        todo, byte = todo[~first], byte[~first]
    last = [i for i, x in enumerate(nexts) if not x]
    place[last] = np.flatnonzero(place_free)[: len(last)]
    return place, int(max(place.max() + 256, 256))


@dataclass
class Parser:
    """All languages' automata in one table. A state is its place in the table; slot place + byte holds the state it
    belongs to (0: none) and the next one. restart: the states after each language's root, where phrases start (0: none)."""

    langs: list[str]
    bits: np.ndarray
    roots: np.ndarray
    restart: np.ndarray
    slots: np.ndarray

    @classmethod
    def of(cls, texts: dict[str, bytes]) -> Parser:
        langs = sorted(texts)
        parts, roots, base = [np.zeros((1, 2), np.uint32)], [], 1
        restart = np.zeros((len(langs), 256), np.uint32)
        for k, lang in enumerate(langs):
            nexts = suffix_automaton(texts[lang])
            place, size = lay_out(nexts)
            of = np.fromiter((i for i, x in enumerate(nexts) for _ in x), np.int64)
            byte = np.fromiter((c for x in nexts for c in x), np.int64)
            to = place[np.fromiter((v for x in nexts for v in x.values()), np.int64)] + base
            own = np.zeros((size, 2), np.uint32)
            own[place[of] + byte] = np.column_stack([place[of] + base, to])
            parts.append(own)
            restart[k, byte[of == 0]] = to[of == 0]
            roots.append(place[0] + base)
            base += size
        bits = np.array([np.log2(max(len(texts[x]), 2)) for x in langs])
        return cls(langs, bits, np.array(roots, np.uint32), restart, np.concatenate(parts))

    def phrases(self, raw: list[bytes]) -> np.ndarray:
        """[text, language]: number of phrases of each text."""
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(raw)), blocks)
        grid = np.zeros(int(blocks.sum()) * BLOCK, np.uint8)
        start = (np.cumsum(blocks) - blocks) * BLOCK
        for a, x in zip(start.tolist(), raw, strict=True):
            grid[a : a + len(x)] = np.frombuffer(x, np.uint8)
        # full blocks stand first, so what remains in lockstep gets shorter
        used = np.full(len(owner), BLOCK, np.int64)
        ends = np.cumsum(blocks) - 1
        used[ends[blocks > 0]] = sizes[blocks > 0] - (blocks[blocks > 0] - 1) * BLOCK
        order = np.argsort(-used, kind="stable")
        columns = np.ascontiguousarray(grid.reshape(-1, BLOCK)[order].T)
        alive = np.searchsorted(-used[order], -np.arange(BLOCK), "left")
        n_langs = len(self.langs)
        table = self.slots.view(np.uint64).ravel()
        restart, roots = self.restart.ravel(), np.tile(self.roots, len(owner))
        state, ended = roots.copy(), np.zeros(len(roots), np.uint32)  # block by block, in each language by language
        for i in range(BLOCK):
            n = int(alive[i])
            if not n:
                break
            byte = columns[i, :n].astype(np.uint32)
            now = state[: n * n_langs]
            slot = table.take((now.reshape(n, n_langs) + byte[:, None]).ravel()).view(np.uint32)
            # no transition: a phrase ends, and the byte starts the next one or, unknown, is another
            stuck = np.flatnonzero(slot[::2] != now)
            again = restart.take((stuck % n_langs) * 256 + byte.take(stuck // n_langs))
            open_phrase = now.take(stuck) != roots[stuck]
            unknown = again == 0
            ended[stuck] += open_phrase.astype(np.uint32) + unknown
            now[:] = slot[1::2]
            now[stuck] = np.where(unknown, roots[stuck], again)
        ended += state != roots
        out = np.zeros((len(raw), n_langs), np.int64)
        np.add.at(out, owner[order], ended.reshape(-1, n_langs).astype(np.int64))
        return out

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        raw, at = [], []
        for i, t in enumerate(texts):
            if t and any(map(str.isalpha, t)):
                raw.append(t.lower().encode("utf-8", "surrogatepass"))
                at.append(i)
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        first = 0
        while first < len(raw):
            last, size = first, 0
            while last < len(raw) and (size == 0 or size + len(raw[last]) <= BATCH_BYTES):
                size += len(raw[last])
                last += 1
            part = raw[first:last]
            h = self.phrases(part) * self.bits / np.array([[len(x)] for x in part])
            best = h.argmin(1)
            share = 1 / np.exp2(h.min(1)[:, None] - h).sum(1)
            for i, b, s in zip(at[first:last], best.tolist(), share.tolist(), strict=True):
                langs[i], scores[i] = self.langs[b], s
            first = last
        return pd.DataFrame({"lang_pred": langs, "score": scores})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(labelled: DataFrame, seed: int = 2) -> Parser | None:
    """labelled: _id, text, lang, none of the last two null."""
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not counts:
        return None
    limit = min(TRAIN_BYTES, ALL_BYTES // len(counts))
    rules = [(x, min(1.0, (2 * DOCS + 32) / n), max(1, -(-limit // min(n, DOCS)))) for x, n in counts.items()]
    rules = labelled.sparkSession.createDataFrame(rules, "lang string, rate double, piece long")
    u = seeded(seed, F.col("_id"), F.xxhash64("text"))
    drawn = labelled.join(F.broadcast(rules), "lang").withColumn("u", u).where(F.col("u") <= F.col("rate") * F.lit(float(1 << 53)))
    start = F.pmod(F.col("u"), F.greatest(F.length("text") - F.col("piece"), F.lit(0)) + 1) + 1
    drawn = drawn.select("lang", "u", F.col("text").substr(start.cast("int"), F.col("piece").cast("int")).alias("piece")).toPandas()
    texts = {}
    for lang, part in drawn.sort_values(["lang", "u", "piece"], kind="stable").groupby("lang"):
        raw = "\n".join(part["piece"][:DOCS]).lower().encode("utf-8", "surrogatepass")[:limit]
        if raw:
            texts[lang] = raw
    return Parser.of(texts) if texts else None


def identify(docs: DataFrame, parser: Parser | None, text: str = "text") -> Column:
    """Struct of lang_pred and score."""
    if parser is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    # ALL_BYTES bounds the table: three transitions a byte at most, of 8 bytes each and a few gaps
    shared = docs.sparkSession.sparkContext.broadcast((parser.langs, parser.bits, parser.roots, parser.restart, parser.slots))

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        return Parser(*shared.value).predict(texts.tolist())

    return predicted(text)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learnt = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    parser = train(learnt.select(F.col("doc_id").alias("_id"), "text", "lang"))
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), identify(docs, parser).alias("_p"))
    return found.select("doc_id", "held_out", "_p.lang_pred", "_p.score")
