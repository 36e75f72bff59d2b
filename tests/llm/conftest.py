import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, start long, score double, ids string, n_words string, part int, _m string, kept string, "
          "_row int, rest string, fp string, section string")


def prose(seed: int, n: int) -> str:
    """Words from a fixed rule: no two seeds share long passages."""
    syllables = ["ta", "ri", "mo", "len", "ka", "sun", "ver", "di", "pol", "gar", "é", "ü", "nes", "tor"]
    out, state = [], seed * 7919 + 13
    for _ in range(n):
        word = ""
        for _ in range(1 + state % 3):
            state = (state * 1103515245 + 12345) % (1 << 31)
            word += syllables[(state >> 8) % len(syllables)]
        out.append(word)
    return " ".join(out)


def rows():
    shared = prose(900, 80)
    texts = [(1, prose(1, 120)), (2, prose(2, 120) + "\n" + shared), (3, shared + " " + prose(3, 60)), (4, prose(1, 120)), (5, None), (6, ""), (7, " \n\t "),
             (8, prose(8, 30) + " changed " + prose(9, 300)), (9, prose(8, 30) + " altered " + prose(9, 300)), (10, "one two three"), (11, "X" * 3000),
             (12, prose(12, 20_000)), (13, "ha ha ha " * 60), (14, "日本語 テキスト 😀 <|endoftext|> don't  I'LL\n\n\nÉé İ ﬁ"), (15, prose(15, 90)), (15, prose(15, 90)),
             (16, "*** a### " * 40), (None, prose(2, 120)), (None, None), (17, "same\nsame\nsame\n" + prose(17, 40)), (18, "x" * 99), (19, "x" * 101)]
    return [(d, t, "en" if (d or 0) % 3 else None, "src", 1, 9, 0.5, "i", "w", 2, "m", "k", 3, "r", "f", "s") for d, t in texts]


@pytest.fixture(scope="session")
def docs(spark):
    """Missing, empty, long, repeated and copied texts, missing and repeated ids, and columns whose names clash."""
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    good = [(i, 0 if i in (13, 16) else 1, 0) for i in range(1, 18)]
    return spark.createDataFrame([*good, (None, 1, 0), (3, None, 0), (4, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path
