import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, h string, part int, row string, spans string"


def thue_morse(n, a="a", b="b"):
    """The first n letters of the Thue-Morse word: polynomials modulo 2^64 don't tell it from the word with a and b swapped."""
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows and white space of all kinds."""
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma,", "delta.", "été", "über", "日本", "x_y", "don't", "42", "end!"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(120)
    near = base.split(" ")
    near[7], near[60] = "other", "thing"
    return [
        (1, base), (2, base), (2, base), (3, " ".join(near)), (4, text(80)), (4, text(70)),
        (5, None), (None, text(30)), (None, text(30)), (6, ""), (7, " "), (8, "  two  spaces \n\t and\x1c tabs   "), (9, "\n"),
        (10, "!!! ???"), (11, "one"), (12, "a b c"), (13, text(6000)), (14, "x" * 50000), (15, "ab" * 20000 + " " + "%" * 3000), (16, "ha " * 500),
        (20, thue_morse(1024)), (21, thue_morse(1024, "b", "a")), (22, f"{thue_morse(2048)} so, {thue_morse(2048, 'b', 'a')}"), (23, f"{thue_morse(2048, 'b', 'a')} so, {thue_morse(2048)}"),
        (24, thue_morse(65536, "x", "é")), (25, thue_morse(65536, "é", "x")), (26, f"in {thue_morse(128, 't', 'n')} it"), (27, f"in {thue_morse(128, 'n', 't')} it"),
        (17, "▁ mark ▁▁ here"), (18, "<|endoftext|> is text"), (19, "😀 é́ 🇩🇪   line"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """odd_rows with columns whose names clash with those of the operators."""
    full = [(i, t, None if k % 5 == 0 else "en", "s", None if t is None else len(t), "zz", "hh", 7, "r", "p") for k, (i, t) in enumerate(odd_rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
