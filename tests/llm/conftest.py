import pytest


@pytest.fixture
def texts():
    """Rows of (doc_id, text) with nulls, empty and long texts, ties and repeated rows."""
    base = " ".join(f"w{i % 37}x{i * 7 % 101}" for i in range(120))
    return [
        (1, base),
        (2, base),
        (3, base.replace("w5x35", "other")),
        (3, base.replace("w5x35", "other")),
        (None, base),
        (None, None),
        (5, None),
        (6, ""),
        (7, " \t\n\r "),
        (8, "one"),
        (9, "two words"),
        (10, "a b c\na b c\na b c\nx"),
        (11, "É été où ça \U0001f600 " * 30),
        (12, " ".join(f"l{i * i % 9973}" for i in range(30000))),
        (13, "the same the same the same " * 40),
    ]
