"""Rows that operators must survive."""

TINY = "/root/testdata/sf0.001"

#: Empty, blank, null, repeated and very long texts, ties, and columns whose names clash with the operators' own.
ODD = [(1, ""), (2, None), (3, " \t\n "), (4, "one"), (5, "one two"), (6, "a b c d e f g h i j k l"), (7, "a b c d e f g h i j k l"), (7, "a b c d e f g h i j k l"), (8, "x " * 60_000), (9, "é" * 50_000), (None, "no id at all but words"), (10, "Ünï çödé\x0bword\x0cnext\r\nline")]
