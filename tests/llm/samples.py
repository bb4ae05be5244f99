"""Rows that tests of several operators share."""

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one two three four five six"), (4, "one two three four five six"), (5, "x" * 3000), (6, "wörter, ünd ☃ 日本語 é"), (None, "nameless text with some words"), (7, "1234 " * 2000)]


def letters(n: int) -> str:
    """A made-up word of letters only, another for every number."""
    return "".join("bdfgklmnpr"[int(c)] + "aeiou"[int(c) % 5] for c in str(n))
