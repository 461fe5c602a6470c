"""Personal data: spans by pattern, and terms that give protected values away, in DataFrame operations alone.

Base spans are the leftmost non-overlapping matches of a pattern for each kind (email,
ip, card, phone), checked afterwards (octets, Luhn, digit counts); a match that fails the
check is dropped without another try. The patterns run with possessive quantifiers and
start only where a run starts, which finds the same matches in linear time.

The method on top is information-theoretic sanitisation. Protected entities e are every
value found, and the class it belongs to (an address's domain, a network, a card's issuer,
a phone's area). Over the distinct texts of the corpus, so that copies say nothing twice,
the terms of all texts that hold e tell how much a term t says of e: pmi(e; t) =
log2(p(e, t) / (p(e) p(t))), of the -log2 p(e) bits that e holds; p(e) and p(t) are shares of
all texts, p(e, t) that of texts that hold both. The disclosed share is pmi / -log2 p(e).
Without enough texts with both there is no estimate to act on: `support` texts for a value,
`class_support` for a class, whose texts are so many that words meet in a few by chance. A
term is generalised (its span becomes a class) from the share `generalise` on, and removed
from `remove_from` on, wherever it stands in any document, as it tells there too. What
overlaps a base span is no term.

Secrets (a long value with letters and digits, assigned to a name such as token or password) are
protected entities beside the base kinds: such a value tells all of itself and is a span
`secret`, after the base spans.

Defined results: a null or empty text has no span; equal texts count once and are marked alike;
null ids are ids; an empty table gives an empty result; only the named columns are read,
so further columns can't clash. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, table

# Patterns, as their contract fixes them, in a form that runs in linear time.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    # a match is a maximal run of digits; those of under 13 digits fail the check in any case
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What any match of a kind holds; texts without it aren't searched further.
NEEDS = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(PATTERNS["ip"]), "card": lambda t: t.rlike(PATTERNS["card"]), "phone": lambda t: t.contains("+")}
#: A secret's value, by the name it is assigned to; what any text with one holds.
SECRET = r"""(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_=-]{16})(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])(?<=(?i:key|token|secret|password|passwd|pwd|credential)[A-Za-z0-9_-]{0,16}["']?[\x20\t]{0,2}[:=]{1,2}[\x20\t]{0,2}["']?)[A-Za-z0-9+/_=-]{16,}+"""
SECRET_NAME = r"""(?i:key|token|secret|password|passwd|pwd|credential)[A-Za-z0-9_-]{0,16}["']?[\x20\t]{0,2}[:=]"""
#: Terms are runs of letters and digits.
TERM = r"[\p{L}\p{N}]+"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    at = F.split(F.reverse(digits), "")
    doubled = F.transform(
        F.filter(at, lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return ~F.exists(F.split(value, r"\."), lambda p: ~p.rlike(r"^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(_digits(value)).between(13, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


_MATCHES = "array<struct<start:int,end:int,value:string>>"


def _running(steps: Column) -> Column:
    """Running sums of array<int>, in parts of about the square root of its size: what a fold carries is copied at every step, so it holds few numbers and no text."""

    def summed(part: Column, start: Column) -> Column:
        carried = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, carried, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out")))["out"]

    fold = F.ceil(F.sqrt(F.size(steps))).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / fold).cast("int")), lambda i: F.slice(steps, i * fold + 1, fold))

    def over(parts: Column) -> Column:
        totals = summed(F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)), F.lit(0))
        return F.flatten(F.zip_with(parts, F.concat(F.array(F.lit(0)), F.slice(totals, F.lit(1), F.size(parts) - 1)), summed))

    return F.when(F.size(steps) > 0, F.transform(F.array(cut), over)[0]).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str, if_any: Column | None = None) -> Column:
    """All matches as array<struct<start, end, value>>; what stands between them gives the places."""
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap"))

    def placed(z: Column) -> Column:
        steps = F.zip_with(z["m"], F.slice(z["gap"], F.lit(1), F.size(z["m"])), lambda m, gap: F.length(gap) + F.length(m))
        ends = F.transform(F.array(steps), _running)[0]
        return F.zip_with(z["m"], ends, lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("value")))

    # as an element of an array a value is worked out once, not again wherever a function names it
    every = F.transform(F.array(found), placed)[0]
    return every if if_any is None else F.when(if_any, every).otherwise(F.array().cast(_MATCHES))


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end, value>> of the checked matches, by kind as listed, then start."""

    def of(kind: str) -> Column:
        passed = F.filter(matches(text, PATTERNS[kind], NEEDS[kind](text)), lambda m: _passes(kind, m["value"]))
        return F.transform(passed, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))

    return F.concat(*[of(k) for k in KINDS])


def protected_spans(text: Column) -> Column:
    """base_spans, then the secrets that no base span overlaps."""
    secrets = matches(text, SECRET, (text.contains("=") | text.contains(":")) & text.rlike(SECRET_NAME))

    def both(base: Column) -> Column:
        free = F.filter(secrets, lambda m: ~F.exists(base, lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"])))
        return F.concat(base, F.transform(free, lambda m: F.struct(F.lit("secret").alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"))))

    return F.transform(F.array(base_spans(text)), both)[0]


def _occurrences(rows: DataFrame) -> DataFrame:
    """_row, term, start, end of every term that no base span overlaps; rows: _row, _text, _base. Nothing is shuffled for it."""
    # as one element of an array both are worked out once a text, not the spans again for every term
    both = F.array(F.struct(matches(F.col("_text"), TERM).alias("found"), F.col("_base").alias("base")))
    free = F.transform(both, lambda z: F.filter(z["found"], lambda m: ~F.exists(z["base"], lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"]))))[0]
    return rows.select("_row", F.explode(free).alias("m")).select("_row", F.lower("m.value").alias("term"), "m.start", "m.end")


#: Terms, entities and repeated texts (some 40 bytes each) up to this number go to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
_TEXT = ["_h1", "_h2"]


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _class_of(kind: Column, value: Column) -> Column:
    """What a value tells of in general: an address's domain, a network of 256, a card's issuer, a phone's area (its first six digits)."""
    return (
        F.when(kind == "email", F.lower(F.substring_index(value, "@", -1)))
        .when(kind == "ip", F.substring_index(value, ".", 3))
        .when(kind == "secret", value)
        .otherwise(F.substring(_digits(value), 1, 6))
    )


def telling_terms(base: DataFrame, words: DataFrame, support: int, class_support: int, generalise: float) -> DataFrame:
    """term and share of the terms that tell of some entity.

    base: _row, _h1, _h2 (which name a text), _text (null without spans), _base of every document. words: _h1, _h2 and
    term, a row for each document and distinct term (null where there is none).
    """
    texts = base.groupBy(*_TEXT).agg(F.count(F.lit(1)).alias("copies"), F.min(F.when(F.col("_text").isNotNull(), F.col("_row"))).alias("_row"))
    texts = materialise(texts.where("copies > 1 OR _row IS NOT NULL"), "pii_texts")
    n = base.count() - (texts.agg(F.sum(F.col("copies") - 1)).first()[0] or 0)
    ones = base.join(_small(texts.where("_row IS NOT NULL").select("_row")), "_row", "left_semi").select("_row", "_text", "_base")

    of = lambda s: F.array(F.struct(F.lit(False).alias("wide"), s["value"].alias("name")), F.struct(F.lit(True).alias("wide"), _class_of(s["kind"], s["value"]).alias("name")))
    entities = F.flatten(F.transform("_base", lambda s: F.transform(of(s), lambda e: F.struct(F.xxhash64(s["kind"], e["wide"], e["name"]).alias("entity"), e["wide"].alias("wide")))))
    holds = ones.select("_row", F.explode(F.array_distinct(entities)).alias("e")).select("_row", "e.*")
    needed = F.when(F.col("wide"), class_support).otherwise(support)
    counted = holds.groupBy("entity", "wide").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") >= needed)
    # entities of too few texts can't reach the support: their texts needn't be taken apart
    holds = materialise(holds.join(_small(counted), ["entity", "wide"]), "pii_holds")
    occurring = _occurrences(ones.join(_small(holds.select("_row").distinct()), "_row", "left_semi")).select("_row", "term").distinct()
    pairs = holds.join(occurring, "_row").groupBy("entity", "wide", "n_entity", "term").agg(F.count(F.lit(1)).alias("n_pair"))
    pairs = materialise(pairs.where(F.col("n_pair") >= needed), "pii_pairs")

    # a text of several copies counts for each of them its part of one
    copies = texts.where("copies > 1").select(*_TEXT, "copies")
    held = words.join(_small(pairs.select("term").distinct()), "term", "left_semi").join(_small(copies), _TEXT, "left")
    held = held.groupBy("term").agg(F.round(F.sum(1 / F.coalesce("copies", F.lit(1)))).alias("n_term"))
    told = F.log2(F.col("n_pair") * F.lit(float(n)) / (F.col("n_entity") * F.col("n_term"))) / F.nullif(F.log2(F.lit(float(n)) / F.col("n_entity")), F.lit(0.0))
    found = pairs.join(held, "term").groupBy("term").agg(F.max(told).alias("share"))
    return materialise(found.where(F.col("share") >= generalise), "pii_telling")


def find(
    docs: DataFrame,
    support: int = 2,
    class_support: int = 5,
    generalise: float = 0.9,
    remove_from: float = 0.95,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row for each row of docs: id, _text_hash, base (the checked matches, then secrets) and terms (array<struct<start, end, action, share>>)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = [F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(10), text).alias("_h2")]
    base = docs.select(F.col(id_col).alias("_id"), *named, text.alias("_text")).withColumn("_base", protected_spans(F.col("_text")))
    # row numbers are written down with the rows, so later reads agree on them
    base = materialise(base.withColumn("_text", F.when(F.size("_base") > 0, F.col("_text"))).withColumn("_row", F.monotonically_increasing_id()), "pii")
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))
    # explode_outer: explode would bring a filter on the words, and with it take every text apart twice; a null term joins nothing
    words = docs.select(*named, words.alias("words"))
    telling = telling_terms(base, words.select(*_TEXT, F.explode_outer("words").alias("term")), support, class_support, generalise)

    # the texts that hold a telling term, each once; then where its terms stand
    small = _small(telling)
    told = materialise(words.select(*_TEXT, F.explode_outer("words").alias("term")).join(small, "term", "left_semi").select(*_TEXT).distinct(), "pii_told")
    asked = docs.select(*named, text.alias("_text")).join(_small(told), _TEXT, "left_semi").dropDuplicates(_TEXT)
    asked = asked.select(F.struct(*_TEXT).alias("_row"), "_text", protected_spans(F.col("_text")).alias("_base"))
    action = F.when(F.col("share") >= remove_from, "remove").otherwise("generalise")
    found = _occurrences(asked).join(small, "term").groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "end", action.alias("action"), "share"))).alias("_terms"))
    found = materialise(found.select("_row.*", "_terms"), "pii_found")
    out = base.join(_small(found), _TEXT, "left")
    none = F.array().cast("array<struct<start:int,end:int,action:string,share:double>>")
    return out.select(F.col("_id").alias(id_col), F.col("_h1").alias("_text_hash"), F.col("_base").alias("base"), F.coalesce("_terms", none).alias("terms"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id and clean_text: spans become <EMAIL>, <IP>, <CARD>, <PHONE> or <SECRET>, generalised terms <NAME>, <NUMBER> or <TERM> by their shape, removed ones nothing."""
    found = find(docs, id_col=id_col, text_col=text_col, **options).dropDuplicates([id_col, "_text_hash"]).withColumnRenamed(id_col, "_found_id")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("_text"), F.xxhash64(text).alias("_hash"))
    rows = rows.join(found, F.col(id_col).eqNullSafe(F.col("_found_id")) & (F.col("_hash") == F.col("_text_hash")))
    t = F.col("_text")

    def shape(m: Column) -> Column:
        value = F.substring(t, m["start"] + 1, m["end"] - m["start"])
        of = F.when(value.rlike(r"[0-9]"), "<NUMBER>").when(value.rlike(r"^\p{Lu}"), "<NAME>").otherwise("<TERM>")
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), F.when(m["action"] == "remove", "").otherwise(of).alias("by"))

    spans = F.array_sort(
        F.concat(
            F.transform("base", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.concat(F.lit("<"), F.upper(m["kind"]), F.lit(">")).alias("by"))),
            F.transform("terms", shape),
        )
    )
    # spans of different kinds may overlap: what an earlier one has covered isn't written again
    built = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, m: F.when(
            m["start"] >= acc["at"],
            F.struct(m["end"].alias("at"), F.concat(acc["out"], F.substring(t, acc["at"] + 1, m["start"] - acc["at"]), m["by"]).alias("out")),
        ).otherwise(F.struct(F.greatest(acc["at"], m["end"]).alias("at"), acc["out"].alias("out"))),
    )
    return rows.select(id_col, F.concat(built["out"], F.substring(t, built["at"] + 1, F.length(t))).alias("clean_text"))


def op10_pii_sanitise(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    written = lambda m, kind: F.concat_ws(":", kind, m["start"].cast("string"), m["end"].cast("string"))
    base = F.array_join(F.transform(F.filter("base", lambda m: m["kind"] != "secret"), lambda m: written(m, m["kind"])), ",")
    every = F.array_join(F.concat(F.transform("base", lambda m: written(m, m["kind"])), F.transform("terms", lambda m: written(m, F.lit("term")))), ",")
    count = lambda kind: F.size(F.filter("base", lambda m: m["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))
