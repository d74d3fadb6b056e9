"""A table of odd documents: nulls in any column, empty and very long texts, ties, repeated rows and columns whose
names clash with those that operators use inside."""

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id string, digest string, keep_id int,"
    " size string, fp string, key string, place int, _copy int, _times string, _facts string, label int, block int"
)
LONG = " ".join(f"long{i % 997}" for i in range(60_000))
TEXTS = [
    (5, "the same text", "en", "a"), (3, "the same text", "en", "b"), (9, "the same text", None, None),
    (1, None, "en", "a"), (2, "", "en", "a"), (4, " \t\n ", "en", None), (6, "Größe ÉTÉ ñandú", "de", "b"),
    (7, LONG, "en", "a"), (8, LONG, "en", "c"), (None, "no id here", "en", "a"), (None, "no id here", "en", "a"),
    (10, "12345 !!! 67", "en", "b"), (11, "twice", "fr", "c"), (11, "twice", "fr", "c"), (11, "other text, same id", "fr", "c"),
    (None, None, None, None), ((1 << 53) + 1, "a large id", "en", "a"),
]


def odd(spark, rows=TEXTS):
    extra = ("x", "x", 1, "x", "x", "x", 1, 1, "x", "x", 1, 1)
    return spark.createDataFrame([(*r, None, *extra) for r in rows], SCHEMA)


def texts():
    return [(i, t or "") for i, t, *_ in TEXTS]
