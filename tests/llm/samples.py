"""Texts that are hard for text operators; doc_id, text."""

HARD = [
    "", None, " ", "  ", "\n", "a", " a", "a ", "hello world", "hello  world", "it's  we'll\n\n x", "Émile naïve ǅ ñ", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "tab\tsep \t x\r\ny",
    "x" * 3000, "é á ́b", "日本語 テキスト", "😀 😀😀", "1234567890 12 345", "\x1c a\x1fb \x85 c  d e", "end.\nNext, (line) -- '' \"q\" 's 'S", "İSTANBUL ΣΑΣ", "word " * 5000, "​ a‍", "½ ² ⅷ", "<|STARTOFTEXT|> <|startoftext|>, Word, WORD. it's, x., Ά. ΣΑΣ, ß. ,",
]


def docs(spark, texts=None, extra=False):
    rows = [(i, t) for i, t in enumerate(HARD if texts is None else texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("*", "1 as length", "'x' as bin", "2 as ids", "3 as n_chars") if extra else df
