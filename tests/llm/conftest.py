"""One small table of whole documents with the odd rows every operator must take."""

import duckdb
import pytest
from pyspark.sql import functions as F

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "size long, did long, word string, n_words string, key string")
CLASHES = (1, 2, "w", "x", "k")


def odd_rows(texts):
    """Null, empty, blank, repeated, near, short, long, symbol and escape-heavy texts."""
    words = texts[0].split()
    near = words[:]
    near[len(near) // 2] = "changed"
    long_text = " ".join(f"w{i * 7919 % 1009} {words[i % len(words)]}" for i in range(12_000))
    return [
        (9001, None, "en", "src0"), (9002, "", "en", "src0"), (9003, " \t\n ", None, None), (9004, "one two", "de", None),
        (9005, texts[0], "en", "src0"), (9005, texts[0], "en", "src0"), (9006, " ".join(near), "en", None),
        (9007, long_text, "en", "src1"), (9008, long_text[5:] + " tail", "en", "src1"), (9009, "ha " * 400, "fr", "src2"),
        (9010, "a" * 700 + "\n" + "a" * 300, "fr", "src2"), (9011, "7 8 9 ### $$$ 12345 " * 30, "es", "src2"),
        (9012, "x▁y  é中\U0001f600\x00 z   " + "q" * 90, "es", "src3"),
        (9013, "call me at +1 (555) 010-9999 or 4111 1111 1111 1111, a.b@c.example.org, 10.0.0.256 10.0.0.255", "en", "src3"),
    ]


@pytest.fixture(scope="session")
def rows():
    got = duckdb.sql("select doc_id, text, lang, source from '/root/testdata/sf0.001/documents.parquet' order by doc_id").fetchall()
    return got + odd_rows([t for _, t, _, _ in got if len(t.split()) > 150])


@pytest.fixture(scope="session")
def docs(spark, rows):
    data = [(i, t, la, s, len(t) if t is not None else None, *CLASHES) for i, t, la, s in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(5).withColumn("did", F.lit(2).cast("long")).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
