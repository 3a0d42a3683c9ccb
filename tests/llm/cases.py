"""Texts that every operator has to bear, and tables made of them."""

ODD = ["", " ", "\n", "  \n \n ", "a", "a a a a a a", "é́ 😀 ▁ \t\r\n x", "<s> </s> <|endoftext|>", "\x00 nul", "x" * 30_000, "word " * 6_000, "1" * 3_000, "MIT License", "a@b.co +1 (456) 555-2186"]


def table(spark, texts, clash=True):
    """Documents with repeated rows, a null text, and columns named like those that operators make."""
    rows = [(i, t, "en", "src0", len(t or ""), "k", 1.0) for i, t in enumerate([*texts, None])]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, lang string, source string, n_chars long, key string, score double")
    return df if clash else df.select("doc_id", "text")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
