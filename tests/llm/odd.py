"""Rows that every operator and stage must bear: nulls, repeats, empty and very long texts, clashing column names."""

from __future__ import annotations

#: Extra columns whose names operators use inside.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, row int, key string, k0 long, k1 long, x long, c int, "
    "_id long, _dropped long, _x long, passes boolean, block int, bitmap string, live string, of_id long, of_x long, rep long, doc long, lines string"
)


def thue_morse(n: int, a: str, b: str) -> str:
    """The sequence and its complement agree under every polynomial hash modulo a power of two."""
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(n))


TEXTS = [
    (None, "token=abc123def9 without an id"), (None, None), (None, ""), (1, "token=aaa111bbb2 first of one id"), (1, "password: zzz999yyy8 second of one id"),
    (1, "token=aaa111bbb2 first of one id"), (2, None), (3, ""), (4, " \t\n"), (5, thue_morse(2048, "a", "b")), (6, thue_morse(2048, "b", "a")),
    (7, " ".join(thue_morse(2048, "a", "b"))), (8, " ".join(thue_morse(2048, "b", "a"))), (9, "word " * 40_000), (10, "é" * 5_000),
]


def table(spark, rows=TEXTS):
    extra = ["en", "s1", 1, 2, 3, "k", 4, 5, 6, 7, 8, 9, 10, True, 11, "b", "l", 12, 13, 14, 15, "n"]
    return spark.createDataFrame([(d, t, *extra) for d, t in rows], SCHEMA)
