"""Small tables with everything a column can hold."""

LONG = " ".join(f"w{i % 977} z{i % 31}" for i in range(30_000))
PASSAGE = "The quick auditors of Ghent measured forty-one copper kettles, then sold them to a travelling clock maker for nine silver coins each."
NEAR = " ".join(f"alpha{i} beta{i} gamma{i}" for i in range(60))

DOCS = [
    (1, "Hello World\nhello world \n\n x", "a"),
    (2, None, "a"),
    (3, "", None),
    (4, " \t\n\x0b\x0c\r ", "b"),
    (5, LONG, "b"),
    (6, LONG + " tail", "b"),
    (7, "one two", "a"),
    (8, "ONE\ttwo", "a"),
    (9, "one two", None),
    (9, "one two", None),
    (10, "one", "ü"),
    (None, "no id at all here", "c"),
    (11, "é" * 150 + "naïve café ☕ " * 20, "c"),
    (12, PASSAGE + " And more.", "c"),
    (13, "x " * 400, "a"),
    (14, NEAR, "a"),
    (15, NEAR.replace("beta7 ", "changed "), "a"),
    (16, NEAR.replace("gamma50 ", ""), "a"),
]
#: Columns that share names with what operators compute.
CLASH = ["size", "kept", "n_words", "shard", "whole", "n_shingles", "component_id", "_words", "_id"]


def docs(spark, rows=None, clash=True):
    df = spark.createDataFrame(DOCS if rows is None else rows, "doc_id long, text string, source string")
    if clash:
        for c in CLASH:
            df = df.withColumn(c, df["source"])
    return df
