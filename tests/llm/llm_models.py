"""Fixed rows and plain models for the tests of this folder."""

LONG = " ".join(f"w{k}" for k in range(30_000))
COPY = " ".join(f"copy{k}" for k in range(70))
#: Nulls, empty and very long texts, repeated rows, copies, and columns whose names operators use inside.
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (6, COPY), (7, COPY), (7, COPY), (8, "x " + COPY + " y"), (9, "é Ü ß 日本 don't A1"), (None, "no id " + COPY), (10, "a b c d e f")]


def words(text):
    return (text or "").encode().split()


def lower(text):
    return (text or "").encode().lower().split()


def shingles(text, k=5):
    w = lower(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
