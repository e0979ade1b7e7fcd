"""Joins, passages and fingerprints against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from llm_models import COPY, EDGE, lower, shingles

from vellum.llm import fingerprints, jaccard_join, suffix_dedup
from vellum.llm.components import connected_components
from vellum.llm.queries import QUERIES
from vellum.llm.words import hashed, shingle_sets


def components(rows):
    """doc_id to (set size, smallest doc_id reachable)."""
    sets = defaultdict(list)
    for i, t in rows:
        if i is not None:
            sets[i].append(shingles(t))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(s and t and 100 * len(s & t) >= 75 * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i][0]), find(i)) for i in ids}


def test_jaccard_query(spark, sf, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op8_jaccard_join"](spark, sf).collect()}
    assert got == components(rows)


def test_jaccard_families(spark):
    """Near copies around the threshold, texts with one passage in common, and short texts."""
    rng = np.random.default_rng(5)
    base, passage = [f"b{k}" for k in range(60)], [f"p{k}" for k in range(12)]
    rows = []
    for k in range(60):
        w = list(base)
        for j in rng.integers(0, 60, k % 4):
            w[j] = f"r{rng.integers(10**9)}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, " ".join([*passage, *(f"q{k}-{j}" for j in range(k))])) for k in range(12)]
    rows += [(200 + k, " ".join(["the cat sat on a mat"] * (1 + k))) for k in range(4)] + [(300 + k, "a b c") for k in range(3)] + [(400, "a b"), (401, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()}
    assert got == components(rows)
    assert sorted(r.doc_id for r in jaccard_join.one_of_each(df).collect()) == sorted({c for _, c in components(rows).values()})


def test_jaccard_two_groups(spark):
    """A list of two groups, of which only a member that does not stand for its group links with the other."""
    base = [f"c{k}" for k in range(10)]
    rows = [(1, " ".join([*base, "x", "y"])), (2, " ".join([*base, "p", "q"])), (3, " ".join([*base, "p", "r"]))]
    # texts that make the ends of 1 and 2 commoner than their beginning
    for k in range(6):
        rows.append((10 + k, " ".join([*(f"u{k}-{j}" for j in range(20)), *base[6:], "x", "y", *(f"v{k}-{j}" for j in range(20)), *base[6:], "p", "q"])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()}
    assert got[1] == (8, 1) and got[2] == (8, 2) and got[3] == (8, 2) and got == components(rows)


def test_jaccard_members_of_two_groups(spark):
    """Two groups of two, whose second members alone link."""
    tail = lambda k: " ".join(f"{k}{j}" for j in range(29))
    head = lambda k: " ".join([k, *(f"h{j}" for j in range(10))])
    rows = [(1, "p", "a"), (2, "p", "b"), (3, "q", "c"), (4, "q", "b")]
    rows = [(i, f"{head(h)} sep {tail(t)}") for i, h, t in rows]
    rows += [(10 + k, " sep ".join([" ".join(f"f{k}-{j}" for j in range(300)), tail("a"), tail("b"), tail("c")])) for k in range(10)]
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got[2] == got[4] == 2 and got == {i: c for i, (_, c) in components(rows).items()}


def test_jaccard_random_families(spark):
    """Texts of equal beginnings and differing ends, in every mixture."""
    rng = np.random.default_rng(11)
    rows = []
    for family in range(12):
        base, ends = [f"f{family}-{j}" for j in range(30)], [[f"e{family}-{k}-{j}" for j in range(9)] for k in range(3)]
        for _ in range(10):
            w = list(base)
            w[rng.integers(0, 30)] = f"r{rng.integers(3)}"
            rows.append((len(rows), " ".join([*w, *ends[rng.integers(3)][: rng.integers(2, 10)]])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()}
    assert got == components(rows)


def test_jaccard_hot_and_long_lists(documents, rows):
    """All keys by the way of very common ones, all lists in blocks, leaders with few followers a group."""
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(documents, hot_entries=2, block=3, followers=2).collect()}
    assert got == components(rows)


def test_word_hashes():
    """Two words that a polynomial over bytes modulo 2^64 cannot tell apart."""
    word = b"a"
    for _ in range(11):
        word += word.translate(bytes.maketrans(b"ab", b"ba"))
    h, starts = hashed([word, word.translate(bytes.maketrans(b"ab", b"ba")), word.upper()])
    assert h[0] != h[1] and h[0] == h[2] and starts.tolist() == [0, 1, 2, 3]


def test_jaccard_edge(edge, empty):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(edge).collect()), key=str)
    want = components(EDGE)
    assert got == sorted(((i, len(shingles(t)), None if i is None else want[i][1]) for i, t in EDGE), key=str)
    kept = jaccard_join.one_of_each(edge)
    assert kept.columns == edge.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*{c for _, c in want.values()}, None], key=str)
    assert jaccard_join.jaccard_components(empty).count() == 0 and jaccard_join.one_of_each(empty).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(50, k) for k in range(51, 90)] + [(95, 95), (51, 50), (51, 50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 50 for k in range(50, 90)}


def passages(rows, window=50):
    """Places of words in windows that occur again: those of first occurrences, and of the others."""
    found = defaultdict(list)
    for i, t in rows:
        w = lower(t)
        for k in range(len(w) - window + 1):
            found[tuple(w[k : k + window])].append((i, k))
    source, copy = defaultdict(set), defaultdict(set)
    for places in found.values():
        places = sorted(set(places))
        if len(places) > 1:
            for n, (i, k) in enumerate(places):
                (copy if n else source)[i].update(range(k, k + window))
    return source, copy


def covered(spans):
    source, copy = defaultdict(set), defaultdict(set)
    for r in spans:
        (source if r.is_source else copy)[r.doc_id].update(range(r.start_word, r.start_word + r.n_words))
    return source, copy


def test_passages_query(spark, sf, rows):
    assert covered(QUERIES["op9_suffix_dedup"](spark, sf).collect()) == passages(rows)


def test_passages_hot_way(documents, rows):
    """All suffixes by the way of very common ones."""
    assert covered(suffix_dedup.repeated_spans(documents, hot_load=0).collect()) == passages(rows)


def test_passages_of_mixed_neighbours(spark):
    """Windows that share a core with many others, of which some go on alike to the left and others to the right."""
    rng = np.random.default_rng(3)
    core, left, right = ([f"{c}{k}" for k in range(n)] for c, n in (("c", 34), ("l", 40), ("r", 40)))
    rows = []
    for i in range(60):
        a, b = rng.integers(0, 30, 2)
        w = [f"x{i}-{k}" for k in range(rng.integers(0, 20))] + left[len(left) - a :] + core + right[:b] + [f"y{i}-{k}" for k in range(rng.integers(0, 20))]
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert covered(suffix_dedup.repeated_spans(df).collect()) == passages(rows) == covered(suffix_dedup.repeated_spans(df, hot_load=0).collect())


def test_passages_of_one_id(spark):
    """Rows that share a doc_id: equal ones are one occurrence, differing ones are left as they are."""
    two = " ".join(["new words here", COPY])
    rows = [(7, COPY), (7, COPY), (3, COPY), (3, two), (9, "z " + COPY)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert suffix_dedup.repeated_spans(df.where("doc_id = 7")).count() == 0
    assert sorted((r.doc_id, r.text) for r in suffix_dedup.without_copies(df).collect()) == [(3, COPY), (3, two), (7, ""), (7, ""), (9, "z ")]


def test_passages_edge(edge, empty):
    source, copy = covered(suffix_dedup.repeated_spans(edge).collect())
    assert source[6] == set(range(70)) and copy[7] == set(range(70)) and copy[8] == set(range(1, 71))
    assert set(source) - {6} <= {7} and set(copy) == {7, 8}
    out = suffix_dedup.without_copies(edge)
    texts = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == edge.columns and texts[6] == EDGE[5][1] and texts[7] == "" and texts[8] == "x  y" and texts[1] is None and texts[None] == EDGE[10][1]
    assert suffix_dedup.repeated_spans(empty).count() == 0 and suffix_dedup.without_copies(empty).count() == 0


def test_cut():
    assert suffix_dedup.cut(" a  b\tc d ", [(1, 2)]) == " a   d " and suffix_dedup.cut("é ü", [(0, 1), (0, 2)]) == "" and suffix_dedup.cut("a b", [(5, 1)]) == "a b"


def edits(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        yield i, t, t[: len(t) - half] + following[:half], following


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_query(spark, sf, rows):
    got = {r.doc_id: r for r in QUERIES["op10_fingerprints"](spark, sf).collect()}
    errors, prints = [], {}
    for i, t, changed, following in edits(rows):
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        errors += [r.near_edited - similarity(t, changed), r.near_next - similarity(t, following)]
    assert len(got) == len(rows) and abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_fingerprints_of_common_ids(spark, monkeypatch, parts):
    """Many rows without doc_id, and many of one: dealt into parts, in one order."""
    rng = np.random.default_rng(parts)
    rows = [(None, f"null {k} a b c d") for k in range(40)] + [(5, f"five {k} a b c d") for k in range(40)] + [(int(i), f"text {i} {k} of words") for k, i in enumerate(rng.integers(0, 60, 40))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(fingerprints.shared, "parts_for", lambda df: parts)
    hashes = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    want = []
    for k, (i, t) in enumerate(order):
        half, following = len(t) // 2, order[(k + 1) % len(order)][1]
        want.append((str(i), len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in fingerprints.fingerprints(df).collect()) == sorted(want)


def plain_signature(hashes):
    """One-permutation MinHash in plain loops: a minimum for each bin, empty bins by their draws."""
    least = {}
    for h in hashes:
        least[h >> 56] = min(h, least.get(h >> 56, h))
    out = []
    for k in range(256):
        found = least.get(k)
        for draw in fingerprints._DRAWS if found is None else ():
            if int(draw[k]) in least:
                found = least[int(draw[k])]
                break
        if found is None:  # no draw hits: the next full bin
            found = least[min((x for x in least if x >= k), default=min(least))]
        out.append(found & 255)
    return bytes(out)


def test_fingerprints_against_plain_loops(spark, sf, rows):
    got = {r.doc_id: r for r in QUERIES["op10_fingerprints"](spark, sf).collect()}
    near = lambda a, b: max(0.0, (sum(x == y for x, y in zip(a, b, strict=True)) / 256 - 1 / 256) / (1 - 1 / 256))
    for i, t, changed, following in edits(rows):
        own, other, after = (plain_signature([int(h) for h in next(shingle_sets([x.encode()]))]) for x in (t, changed, following))
        r = got[i]
        assert (bytes.fromhex(r.fingerprint), bytes.fromhex(r.edited_fingerprint)) == (own, other)
        assert (r.near_edited, r.near_next) == pytest.approx((near(own, other), near(own, after)))


def test_fingerprints_edge(spark, edge, empty):
    got = sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in fingerprints.fingerprints(edge).collect())
    assert got == sorted((str(i), len(t), hashlib.sha256(c.encode()).hexdigest()) for i, t, c, _ in edits(EDGE))
    assert fingerprints.fingerprints(empty).count() == 0
    alone = fingerprints.fingerprints(spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"a b c da b c ").hexdigest()


def test_densification():
    few = fingerprints.signature(np.array([1 << 60, 5], np.uint64))
    assert len(few) == fingerprints.BINS and fingerprints.likeness(few, few) == 1.0 and fingerprints.likeness(None, few) == 0.0 and fingerprints.likeness(None, None) == 1.0
