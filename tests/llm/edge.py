"""Documents that every operator has to bear: nulls, ties, long and empty texts, extra columns."""

SCHEMA = "doc_id long, text string, start string, bucket string, host string, score double"


def documents(spark, rows):
    """(doc_id, text) rows with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "x", None, "y", 1.5) for i, t in rows], SCHEMA)


WORDS = "the quick brown fox jumps over a lazy dog while seven grey geese watch from the old stone bridge".split()


def prose(n, seed=1):
    out, x = [], seed
    for i in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x // 65536 % len(WORDS)] + ("." if i % 11 == 10 else "") + ("\n" if i % 37 == 36 else ""))
    return " ".join(out)


ROWS = [
    (5, "Hello  world,\n\n  it's   fine.\t\tYes"),
    (1, None),
    (2, ""),
    (3, "   "),
    (None, "a row without id"),
    (7, "same text here"),
    (7, "same text here"),
    (8, "same text here"),
    (9, "odd spaces   x    y   z\x0b w \x1c v 　  u\x85 t"),
    (10, "special <|endoftext|> and <|startoftext|><|x tail<|endoftext|>"),
    (11, "Ünïcödé ́combining \U0001f600 emoji 日本語 İIΣ done"),
    (12, prose(9000)),
    (13, "x" * 3000),
    (2**60 + 1, "a large id"),
    (14, "\r\n line one\r\n line two \r\n"),
]
