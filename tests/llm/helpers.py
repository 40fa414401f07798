"""Tables with awkward rows, for the operators' tests."""

AWKWARD = [
    (1, "The cat sat on the mat. The dog ran.\nA second line here, with words.", "en", "s0", 10),
    (2, None, None, None, None),
    (3, "", "en", "s1", 0),
    (4, "The cat sat on the mat. The dog ran.\nA second line here, with words.", "en", "s0", 10),
    (4, "The cat sat on the mat. The dog ran.\nA second line here, with words.", "en", "s0", 10),
    (5, " \t\r\n\x0b\x0c", "xx", "s2", 6),
    (None, "no id here", "en", "s3", 10),
    (6, "The  cat sat on the mat.\tThe dog ran. A second line here,\nwith words.", "en", "s0", 10),
    (7, "é😀 你好 á \x1c\x1f \xa0 <|endoftext|> it's we'LL 123", "mu", "s4", 1),
    (8, "word " * 30_000, "en", "s0", 150_000),
    (9, "x" * 100_000, "en", "s0", 100_000),
    (10, "mail me: a.b@c-d.example.com or call +1 (509) 555-6973", "en", "s0", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASHES = ["row", "t", "spans", "digits", "fp", "k", "length", "ids", "piece", "word", "bits", "component_id", "text_sha256",
           "keep_id", "score", "_order", "_repeated", "n", "features", "y", "next", "_bucket", "sequence_id"]


def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


def clashing(df):
    from pyspark.sql import functions as F
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
