import random

from pyspark.sql import types as T

#: Columns of documents, and more under names that the operators use inside.
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                       *(T.StructField(n, T.StringType()) for n in ("id", "h", "spans", "node", "label", "token", "length", "shard", "size", "t", "hit", "items", "bucket", "marks"))])
VOICES = {"aa": ["bala", "kalu", "mora", "tila", "sonu", "rabo", "vemi"], "bb": ["strk", "wenz", "pflu", "grum", "zwei", "krat", "hulz"]}


def words(rng: random.Random, n: int, voice: str = "aa") -> str:
    return " ".join("".join(rng.choices(VOICES[voice], k=rng.randint(1, 3))) for _ in range(n))


def frame(spark, rows):
    """rows: (doc_id, text[, lang]); odd cases in the other columns."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None if r[1] is None else len(r[1]), *("x" if i % 2 else None for i in range(14))) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def odd_rows(rng):
    """Nulls, empty, very short, very long, equal and repeated rows, and a row without an id."""
    long = words(rng, 30_000)
    same = words(rng, 80)
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, long), (6, same), (7, same), (8, same), (8, same), (None, same), (9, "É ü ß 漢字 \U0001f600 " * 30), (10, "12345 !!! ???")]


