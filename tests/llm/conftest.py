import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, signature string, block string"
BASE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree and wonder about it all"
EXAM = "question one asks which of the many rivers of the north flows past the old stone mill near town"


def edge_rows():
    """Nulls in every column, empty and long texts, copies, near copies, ties and repeated rows."""
    words = BASE.split()
    texts = [None, "", " \t\n ", "one", "One TWO three", BASE, BASE, BASE.upper(), BASE + " again", "so " + BASE,
             " ".join(words[:12]), f"intro here {EXAM} outro there", EXAM[:60], "Été über Ñandú 日本語 123 !!", "123 456 !!",
             "a" * 70_000, " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000)), "\x00nul\x00 bytes \x00", "<p>not html</p>"]
    texts += [" ".join([*words[:i], f"new{i}", *words[i + 1:]]) for i in (3, 11)]
    rows = [(i, t, ("en", "de", None)[i % 3], ("b", None, "a", "")[i % 4], None if i % 2 else len(t or ""), i % 5, "x", None)
            for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[0], (None, BASE, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
