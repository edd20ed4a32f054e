"""Rows that are awkward for every operator."""

AWKWARD = [
    (1, None), (2, ""), (3, "  \t\n "), (4, "a"), (5, "The cat sat"), (6, "the CAT sat"), (7, "The cat sat"), (7, "The cat sat"),
    (None, "the cat sat"), (None, None), (8, "Ünïcode wörds, ＡＢＣ é H̱ İx 日本語" * 3), (9, "word " * 5000), (10, "x" * 30000),
    (11, "<|endoftext|> Sta<|startoftext|>rt it's 3.5!?"),
]
