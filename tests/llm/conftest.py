import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))
sys.path.insert(0, str(ROOT / "tools"))

from tracehound.session import checkpoint_dir, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(shuffle_partitions=4)
    checkpoint_dir(s)
    return s


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and one-word texts, ties, repeated rows and a clashing extra column."""
    long = " ".join(f"w{i}" for i in range(400))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "en", "a", 5, "x"),
        (1, "alpha beta gamma delta epsilon zeta", "en", "a", 5, "x"),
        (2, "alpha beta gamma delta epsilon zeta", None, None, None, None),
        (3, "", "en", "a", 0, "x"),
        (4, None, "de", "b", None, "x"),
        (None, "alpha beta gamma delta epsilon zeta", "en", "b", 5, "x"),
        (None, None, None, None, None, None),
        (5, "one", "en", "a", 3, "x"),
        (6, long, "en", "a", 3, "x"),
        (7, "pre " + long, "en", "c", 3, "x"),
        (8, " \t\n ", "en", "c", 3, "x"),
    ]
    kind = "doc_id long, text string, lang string, source string, n_chars long, pass string"
    return spark.createDataFrame(rows, kind)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
