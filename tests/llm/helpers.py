"""Small tables with the awkward cases: nulls, empty and long texts, repeated rows, no rows, further columns with clashing names."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, lang="en", clash=True):
    rows = [(i, t, lang, "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("row", "key", "n", "node", "block", "piece", "length", "gram", "same", "lines", "label", "d", "k", "l", "s", "text_key", "id") if clash else ():
        df = df.withColumn(c, F.lit("clash"))
    return df


def odd(spark, clash=True):
    """doc ids 0 to 5 plus a null id; two rows are repeated."""
    df = documents(spark, [None, "", " \n\t ", "One plain text, nothing else.", "One plain text, nothing else.", "word " * 60_000], clash=clash)
    nothing = df.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long"))
    return df.unionByName(df.where("doc_id in (0, 3)")).unionByName(nothing)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]
