import random

import pytest

#: Names that operators might use inside; tables may hold them too.
CLASHES = {"size": 1, "_mix_size": 2, "fp": 3, "_op6": 4, "kept": 5, "_k1": 6, "_range": 7, "_row": 8, "word": 9, "_id": 10, "_text": 11, "n": 12, "component_id": 13}
VOCABULARY = {
    "en": "the and of to in that was with for are this from have not but they which had were been".split(),
    "de": "der und die das nicht mit auf für ist ein eine auch sich werden über wird schon oder".split(),
    "fr": "le la les des une est dans pour que qui sur avec pas plus par mais nous être très".split(),
}


def sentence(rng, lang, n):
    return " ".join(rng.choice(VOCABULARY[lang]) + rng.choice(["", "", "n", "s", "e"]) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def edge_rows(seed=0, n=60):
    """doc_id, text, lang, source: normal texts, nulls in every column, empty, long, repeated, tied and multilingual ones."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(VOCABULARY))
        lines = [sentence(rng, lang, rng.randint(3, 30)) for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            lines.insert(0, "  Released under the MIT License.\t")
        rows.append((i, "\n".join(lines), lang, f"src{i % 4}"))
    rows += [(100, rows[5][1], "en", "src0"), (101, rows[5][1], "en", None), (101, rows[5][1], "en", None)]
    rows += [(None, "no id at all", "en", "src1"), (None, None, None, None), (200, None, "fr", "src2"), (201, "", "en", "src2"), (202, " \n\t\n ", None, "src3")]
    rows += [(203, "x" * 50_000, "en", "src0"), (204, sentence(rng, "en", 20_000), "en", "src0"), (205, "12 34 " * 3_000, "de", "src1"), (206, "日本語のテキスト 🙂 $$$ ###", "fr", "src1")]
    rows += [(207, "a\n" * 300, "en", "src2"), (208, "\n\n\n", "en", "src2")]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({k: F.lit(v) for k, v in CLASHES.items()} | {"n_chars": F.length("text").cast("long")})


@pytest.fixture
def world(spark, tmp_path):
    """Writes tables into a folder and gives its path, as a query takes it."""

    def write(documents, labels=(), benchmark=(), pages=(), clash=True):
        put = lambda rows, schema, name: (with_clashes if clash and name == "documents" else lambda d: d)(spark.createDataFrame(list(rows), schema)).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        put(documents, SCHEMA, "documents")
        put(labels, "doc_id long, quality int, toxic int", "labels")
        put(benchmark, "item_id long, text string", "benchmark")
        put(pages, "page_id long, url string, html string", "pages")
        return str(tmp_path)

    return write
