"""Rows that every operator has to take."""

#: Nulls, empty and blank texts, ties, repeated rows, one very long text, a null id, several lines.
LONG = " ".join(f"word{k % 977} filler{k % 31}" for k in range(60_000))
EDGE = [
    (1, None, "a"), (2, "", "a"), (3, "   ", None), (4, "same words in this text here", "b"), (5, "same words in this text here", "b"),
    (5, "same words in this text here", "b"), (6, LONG, "b"), (7, LONG, None), (None, "same words in this text here", "b"), (None, None, None),
    (8, "x", "c"), (9, "línea únîcode ☃ 𝔘\nsecond line of it", "c"), (10, "tab\tand\r\nbreaks\x0b\x0c end", "c"),
]
