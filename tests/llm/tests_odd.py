"""The odd rows that every operator has to take."""

#: Nulls, empty, blank and very long texts, ties and repeated rows.
ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, "one two", "en", "a"), (5, "one two", "en", "a"),
    (5, "one two", "en", "a"), (None, "no id at all here", "en", None), (None, None, None, None),
    (6, "word " * 60_000, "en", "b"), (7, "日本語の文章です。" * 50, "ja", "b"), (8, "x" * 5000, "en", "b"),
    (9, "¡Ñandú! ▁ ünïcode \u0000 é́ 😀", "es", "c"), (-3, "ONE  TWO", "en", "c"),
]
