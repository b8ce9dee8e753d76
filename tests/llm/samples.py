"""Fixtures for the tests of this folder: small documents of every awkward kind."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, quality string, id long, digest string"


def row(i, text, lang="en"):
    """A document with columns whose names clash with those the operators use themselves."""
    return (i, text, lang, "src", None if text is None else len(text), "q", -1, "d")


@pytest.fixture(scope="session")
def texts():
    """Prose, copies, near copies, shared passages, junk, personal data, nulls, empties, one very long text."""
    r = random.Random(7)
    words = "the of and to in a is that for it was river stone cloud garden lamp winter paper quiet north".split()
    words += [f"w{i}" for i in range(120)]

    def prose(n):
        return " ".join(r.choice(words) + r.choice(["", "", "", ",", "."]) for _ in range(n))

    passage = prose(60)
    base = [prose(r.randint(1, 160)) for _ in range(16)]
    docs = [*base, base[0], base[3], base[3].replace(" ", "\n \t"), base[5] + " x", prose(20) + " " + passage]
    docs += [passage + " " + prose(20), prose(10) + "\n" + passage + "\n" + prose(9), None, "", "   \n\t", None, ""]
    docs += ["spam " * 300, "a b c " * 40, "one", "\n".join(["same line here"] * 30)]
    docs += [
        "mail bob.1@mail.example.com ip 10.0.0.255 no 10.0.0.256 card 4111 1111 1111 1111 tel +1 (988) 555-2485",
        "Released under the MIT License.\nReleased under the MIT License.\n" + prose(30),
        "x " * 30 + "Licensed under the Apache License, Version 2.0.",
        "naïve Straße ΣΑΣ 日本語 <|endoftext|> don't \u00a0 😀 e\u0301",
        " ".join(prose(40) for _ in range(300)),
    ]
    return docs


@pytest.fixture(scope="session")
def rows(texts):
    """The texts with ids from 0, one row told twice, one row without id."""
    out = [row(i, t) for i, t in enumerate(texts)]
    return [*out, out[0], row(None, "text of a row without an id")]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
