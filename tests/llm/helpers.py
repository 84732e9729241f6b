"""Small tables with awkward rows, shared by the operators' tests."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} x{i}" for i in range(40_000))


def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and odd characters."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog " * 3, "en", "a", 100),
        (1, "The quick brown fox jumps over the lazy dog " * 3, "en", "a", 100),
        (2, None, "en", "a", None),
        (3, "", None, None, 0),
        (4, " \t\r\n ", "xx", "b", 5),
        (None, "a document without a key", "en", "b", 24),
        (5, LONG, "en", "c", len(LONG)),
        (6, "It's I'll we've x'd 'quoted' 12³ Ⅷ naïve 中文字 😀  \x85end  \n\n  tail ", "fr", "c", 60),
        (7, "<|endoftext|> in the <|endoftext|><|endoftext|>middle", "en", "c", 40),
        (8, "a" * 3000, "en", "c", 3000),
        (9, "\x00nul \x1c and a\x0bb", "en", "d", 12),
    ]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """The same rows with further columns named like what operators make."""
    from pyspark.sql import functions as F

    names = ["ids", "m", "v", "kept", "n_words", "t", "c0", "n0", "meta", "score", "node", "component", "hits", "count", "k", "target", "grp"]
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
