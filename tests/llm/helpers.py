"""Small tables for the operator tests."""

from __future__ import annotations

import random
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=()):
    """Rows (doc_id, text) as a documents table, with the clashing extra columns asked for."""
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    for name in extra:
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" + r.choice(["", "", "", ".", ",\n"]) for _ in range(words))


def crc(ids) -> int:
    import numpy as np

    return zlib.crc32(np.asarray(list(ids), dtype="<u4").tobytes())


#: A null text, an empty one, blanks, repeated rows, a null id, a very long text.
ODD_ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "Hello, World's <|endoftext|> é É 12"), (4, "Hello, World's <|endoftext|> é É 12"),
            (None, "no id here"), (6, prose(1, 30_000)), (7, "x")]
