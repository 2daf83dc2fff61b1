"""Awkward rows the operators must cope with."""

ODD = [
    (900001, None, None, None, None), (900002, "", "en", "s", 0), (None, "no number here at all", "en", "s", 3),
    (900003, "\x0b\x0c \t\n\r", "xx", None, None), (900004, "ÅÄ é  x\x1cy AKIA token:", "de", "s", 1),
    (900005, "a b c a b c\n\na b c\nd\nd", "en", "s", 1), (900006, "word " * 30_000, "en", "s", 150_000),
]


def with_odd(spark, docs):
    """The first documents with the odd rows, three repeated rows and a column of a name operators use inside."""
    from pyspark.sql import functions as F

    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame(ODD, docs.schema)
    return docs.union(odd).union(docs.orderBy("doc_id").limit(3)).withColumn("id", F.lit("clash")).withColumn("fp", F.lit(1)).withColumn("spans", F.lit(2))
