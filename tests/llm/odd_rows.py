"""Rows that the tests of all corpus operators share."""

SF = "/root/testdata/sf0.001"

LONG = " ".join(f"word{i % 977}." for i in range(30_000))
ODD_TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "One line of words that ends as it should, and is long enough to be kept."), (5, LONG), (6, "same words here again and again. " * 20),
    (7, "same words here again and again. " * 20), (7, "same words here again and again. " * 20), (None, "no key at all but a text that is here."), (9, "x" * 5000), (10, "日本 é ǅ ß <|endoftext|> a\x00b"),
]
