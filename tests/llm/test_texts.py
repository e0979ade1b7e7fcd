"""Quality rules, language model, packing and BPE against plain models."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_models import EDGE, LONG, lower, words

from vellum.llm import bpe, lm_scoring, packing, quality_rules, tokens
from vellum.llm.queries import QUERIES


def base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text, w = text or "", words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if seen[x] > 1:
            covered.update(range(i, i + 5))
    return len(w), sum(len(x.decode()) for x in w), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def metrics(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_quality_query(spark, sf, rows, documents):
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op3_quality_rules"](spark, sf).collect()}
    assert {i: metrics(r) for i, r in got.items()} == {i: base(t) for i, t in rows}
    assert all(r.kept == (not r.base_failed and r.score >= quality_rules.MIN_SCORE) for r in got.values())
    clean = [got[i].kept for i, x in labels.items() if x == (1, 0) and i in got and not got[i].base_failed]
    junk = [got[i].kept for i, x in labels.items() if x[0] == 0 and i in got]
    assert np.mean(clean) > 0.95 and np.mean(junk) < 0.2
    kept = quality_rules.keep_good(documents, spark.read.parquet(f"{sf}/labels.parquet"))
    assert kept.columns == documents.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_quality_scores(spark):
    """The ratio itself, with buckets counted in Python from Spark's own hash."""
    docs = [(1, "the cat sat on the mat and then it slept all day"), (2, "spam spam $$$ buy now spam spam $$$ buy cheap"), (3, "the cat slept")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    ask = "transform(array_remove(split(text, ' '), ''), w -> xxhash64(w)) h"
    found = df.selectExpr("doc_id", ask).selectExpr("doc_id", f"transform(h, x -> pmod(xxhash64(x), {quality_rules.BUCKETS})) u", f"transform(sequence(1, size(h) - 1), i -> pmod(xxhash64(h[i - 1], h[i]), {quality_rules.BUCKETS})) b").collect()
    each = {r.doc_id: [*r.u, *r.b] for r in found}
    raw, target = Counter(x for f in each.values() for x in f), Counter(each[1])
    share = sum(target.values()) / sum(raw.values())
    ratio = lambda b: round(math.log((target[b] + quality_rules.PRIOR * share) / ((raw[b] + quality_rules.PRIOR) * share)), 4)
    got = {r.doc_id: r.score for r in quality_rules.score_documents(df, labels).collect()}
    assert got == pytest.approx({i: sum(map(ratio, f)) / len(f) for i, f in each.items()}, abs=1e-3)
    assert got[1] > got[2]


def test_quality_scores_of_all(spark, sf, documents):
    """Every document's score, from counts over all of them in Python; the hash alone is Spark's."""
    buckets = quality_rules.BUCKETS
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    h = documents.selectExpr("doc_id", "transform(filter(split(text, '[ \\\\t-\\\\r]+'), x -> x <> ''), w -> xxhash64(w)) h")
    pairs = f"case when size(h) > 1 then transform(sequence(1, size(h) - 1), i -> pmod(xxhash64(h[i - 1], h[i]), {buckets})) else array() end"
    each = {r.doc_id: [*r.u, *r.b] for r in h.selectExpr("doc_id", f"transform(h, x -> pmod(xxhash64(x), {buckets})) u", f"{pairs} b").collect()}
    raw, target = Counter(), Counter()
    for i, found in each.items():
        raw.update(found)
        if labels.get(i) == (1, 0):
            target.update(found)
    share = sum(target.values()) / sum(raw.values())
    ratio = [round(math.log((target[b] + quality_rules.PRIOR * share) / ((raw[b] + quality_rules.PRIOR) * share)), 4) for b in range(buckets)]
    want = {i: sum(ratio[b] for b in found) / len(found) if found else 0.0 for i, found in each.items()}
    assert {r.doc_id: r.score for r in QUERIES["op3_quality_rules"](spark, sf).collect()} == pytest.approx(want, abs=2e-4)


def test_quality_repeats(spark):
    rng = random.Random(2)
    docs = [(k, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))) for k in range(60)] + [(60 + k, "\n".join(rng.choice(["x y", "", " ", "z"]) for _ in range(9))) for k in range(20)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_rules.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), labels).collect()
    assert {r.doc_id: metrics(r) for r in got} == {i: base(t) for i, t in docs} and all(r.score == 0 for r in got)


def test_quality_edge(spark, edge, empty):
    labels = spark.createDataFrame([(6, 1, 0), (5, 1, None), (None, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")
    got = sorted(((r.doc_id, *metrics(r)) for r in quality_rules.score_documents(edge, labels).collect()), key=str)
    assert got == sorted(((i, *base(t)) for i, t in EDGE), key=str)
    assert quality_rules.keep_good(edge, labels).columns == edge.columns
    assert quality_rules.score_documents(empty, labels).count() == 0


def lm_base(rows):
    each = [(i, [*lower(t), None]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, x in each if not held(i) for w in x)
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x)) for i, x in each]


def close(got, want):
    key = lambda r: (str(r[0]), r[2])
    got, want = sorted(got, key=key), sorted(want, key=key)
    return len(got) == len(want) and all(a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) for a, b in zip(got, want, strict=True))


def test_lm_query(spark, sf, rows):
    got = QUERIES["op4_lm_scoring"](spark, sf).collect()
    assert close([tuple(r)[:6] for r in got], lm_base(rows))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_is_a_distribution(documents):
    """Outcomes sum to 1 after any history, seen or not, and words to 1 within a bucket."""
    model = lm_scoring.train(documents, head=500)
    counts = model.counts
    every = np.arange(len(counts.by_rank) + lm_scoring.BUCKETS)
    assert len(counts.by_rank) <= 500
    for first, second in ((1, 2), (0, 0), (int(lm_scoring.START), int(lm_scoring.START))):
        for n in (np.zeros(len(every)), (every % 40 == 0) * 3.0, (every == 7) * 1.0, (every < 300) * 1.0):
            logs = lm_scoring.after_histories(model, np.full(len(every), first, np.uint32), np.full(len(every), second, np.uint32), every, n)
            assert (10**logs).sum() == pytest.approx(1, abs=1e-4)
    inside = 10 ** counts.inside
    assert np.bincount(counts.outcome_group, inside)[np.unique(counts.outcome_group)] == pytest.approx(1, abs=1e-9)


def plain_lm(rows, model, rounds, of_round):
    """The same training and scores in plain loops, from the model's hashes only; of_round gives a text's round."""
    counts, C, S = model.counts, lm_scoring.CLASSES, lm_scoring.SLOTS
    a, b = np.zeros((lm_scoring.CLASS_ROWS, C)), np.zeros((lm_scoring.SLOT_ROWS, S))
    seen = [np.zeros(len(a)), np.zeros(len(b))]
    share = [np.exp(counts.class_bias.astype(float)), np.exp(counts.slot_bias.astype(float)).mean(axis=0)]
    each = {}
    for i, t in rows:
        h, starts = lm_scoring.tokens_of([(t or "").encode()])
        short = counts.short(h)
        first, second = lm_scoring.before(short, starts)
        each[i] = list(zip(first.tolist(), second.tolist(), counts.outcome(short).tolist(), lm_scoring.features(first, second).T.tolist(), h.tolist(), strict=True))

    def levels(f, outcome):
        c, s = divmod(int(counts.outcome_group[outcome]), S)
        inner = lm_scoring.slot_rows(np.array(f)[:, None], np.array([c]))[:, 0].tolist()
        for rows_, w, bias, y in ((f, a, counts.class_bias, c), (inner, b, counts.slot_bias[c], s)):
            z = sum(w[r] for r in rows_) + bias
            yield rows_, np.exp(z - z.max()) / np.exp(z - z.max()).sum(), y

    trained = [i for i in each if lm_scoring.in_training([i])[0]]
    for k in range(rounds):
        total, more = [np.zeros_like(a), np.zeros_like(b)], [np.zeros(len(a)), np.zeros(len(b))]
        for i in trained:
            if of_round[i] == k:
                for _, _, o, f, _ in each[i]:
                    for level, (rows_, p, y) in enumerate(levels(f, o)):
                        for r in rows_:
                            total[level][r] -= p
                            total[level][r, y] += 1
                            more[level][r] += 1
        for w, g, n, m, q in zip((a, b), total, seen, more, share, strict=True):
            n += m
            w += np.clip(lm_scoring.RATE * g / (n[:, None] * q + lm_scoring.CAUTION), -lm_scoring.MOST_STEP, lm_scoring.MOST_STEP)
    after, words = defaultdict(Counter), Counter()
    for i in trained:
        for u, v, o, _, h in each[i]:
            after[u, v][o] += 1
            words[h] += 1

    def log(u, v, o, f, h):
        prior = lambda o, f: math.prod(p[y] for _, p, y in levels(f, o)) * 10 ** counts.inside[o]
        n, total = after[u, v], sum(after[u, v].values())
        target = {x: (c - lm_scoring.D) / total for x, c in n.items()}
        q = {x: prior(x, f) for x in n}
        active = set(n)
        while True:
            scale = (1 - sum(target[x] for x in active)) / (1 - sum(q[x] for x in active))
            out = {x for x in active if target[x] <= q[x] * scale}
            if not out:
                break
            active -= out
        p = math.log10(target[o] if o in active else prior(o, f) * scale)
        rare = o - len(counts.by_rank)
        return p if rare < 0 else p + math.log10(words[h] + 0.1) - counts.bucket_mass[rare]

    return {i: sum(log(*x) for x in t) for i, t in each.items()}


@pytest.mark.parametrize("head", [lm_scoring.HEAD, 40])
def test_lm_against_plain_loops(spark, head):
    """Also with all histories by the way of very common ones."""
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["the", "of", "cat", "sat", f"x{rng.randint(0, 90)}"]) for _ in range(rng.randint(0, 25)))) for k in range(60)] + [(60, None), (61, "the cat"), (62, "the the the the")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = lm_scoring.train(df, head=head)
    of_round = {r.doc_id: r.k for r in df.selectExpr("doc_id", f"pmod(xxhash64(doc_id, text), {lm_scoring.ROUNDS}) k").collect()}
    want = plain_lm(rows, model, lm_scoring.ROUNDS, of_round)
    for hot in (lm_scoring.HOT_TOKENS, 0):
        got = lm_scoring.scored(df, model, hot_tokens=hot).collect()
        assert {r.doc_id: r.score for r in got} == pytest.approx(want, rel=1e-5) and close([tuple(r)[:6] for r in got], lm_base(rows))


def test_lm_does_not_depend_on_the_split(documents):
    found = [{r.doc_id: r.score for r in lm_scoring.scored(documents.repartition(n)).collect()} for n in (1, 8, 64)]
    assert found[0] == pytest.approx(found[1], rel=1e-6) and found[0] == pytest.approx(found[2], rel=1e-6)


def test_lm_tells_words_apart_by_history(spark):
    """Words far from the commonest, and equally common, go by the history."""
    common = " ".join(f"c{k}" for k in range(1000))
    ids = [k for k in range(60) if lm_scoring.in_training([k])[0]]
    rows = [(k, f"{common} left hand aa stop right hand bb stop") for k in ids[:2]] + [(k, common) for k in ids[2:6]]
    held = [k for k in range(200) if not lm_scoring.in_training([k])[0]][:2]
    rows += [(held[0], "left hand aa"), (held[1], "left hand bb")]
    got = {r.doc_id: r.score for r in lm_scoring.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held[0]] > got[held[1]] + 1


def test_lm_edge(edge, empty):
    got = lm_scoring.scored(edge).collect()
    assert close([tuple(r)[:6] for r in got], lm_base(EDGE)) and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm_scoring.scored(empty).count() == 0


def pieces(rows):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.default_path())
    out = []
    for i, t in rows:
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        while at < len(ids):
            n = (len(ids) % 2048 or 2048) if at == 0 else 2048
            out.append((i, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            at += n
    return out


def check_packing(got, rows):
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(pieces(rows), key=str)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= 2048
    return len(places)


def test_packing_query(spark, sf, rows):
    got = QUERIES["op6_best_fit_packing"](spark, sf).collect()
    assert check_packing(got, rows) <= 1.02 * math.ceil(sum(r.length for r in got) / 2048) + 1


def test_packing_edge(edge, empty):
    check_packing(packing.pack(edge).collect(), EDGE)
    assert packing.pack(empty).count() == 0


def test_plans():
    rng = random.Random(4)
    for size in (8, 50, 400):
        for _ in range(40):
            counts = {k: n for k in range(1, size + 1) if (n := rng.choice([0, 0, 1, rng.randint(0, 30)]))}
            made = packing.plan(counts, size)
            assert all(sum(p) <= size and times > 0 for p, times in made)
            used = Counter()
            for p, times in made:
                for k in p:
                    used[k] += times
            assert used == Counter(counts)
    assert len(packing.plan({1: 10**12, 2047: 10**12, 700: 3 * 10**9, 648: 3 * 10**9})) < 20
    assert packing.plan({5: 1, 2: 1, 1: 1}, 8) == [((5, 2, 1), 1)] and packing.plan({4: 3, 3: 1, 1: 1}, 8) == [((4, 4), 1), ((4, 3, 1), 1)]


def library(text):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(bpe.default_path())
    ids = own.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_query(spark, sf, rows):
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op7_bpe"](spark, sf).collect()} == {i: library(t) for i, t in rows}


def test_bpe_edge(edge, empty):
    assert sorted((tuple(r) for r in bpe.encoded_digests(edge).collect()), key=str) == sorted(((i, *library(t)) for i, t in EDGE), key=str)
    assert bpe.encoded_digests(empty).count() == 0
    one = bpe.encoded(edge.where("doc_id = 9")).first()
    assert bpe.vocabulary(bpe.default_path()).decode(one.ids) == one.decoded


def test_bpe_words():
    own = bpe.vocabulary(bpe.default_path())
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(bpe.default_path())
    rng = random.Random(6)
    texts = ["", " ", "a<|endoftext|>b <|startoftext|>", "ΑΣ ΣΊΣΥΦΟΣ", "İ ß é", "I'VE don't", "x" * 3000, "ab" * 700 + " c", "1234 ½", "a\x85b c\x1cd", "😀👩‍👩‍👧", LONG[:500]]
    texts += ["".join(rng.choice("aabcdé'st 12.!\n") for _ in range(rng.randint(1, 400))) for _ in range(300)]
    assert [own.encode(t) for t in texts] == [theirs.encode(t, add_special_tokens=False).ids for t in texts]
    words_ = [w.encode() for w in ("".join(rng.choice("thein") for _ in range(rng.randint(1, 300))) for _ in range(100))]
    assert own.merge(words_) == [own._merge_long(w) if len(w) > 1 else [int(own.last[w[0]])] for w in words_]


def test_bpe_of_all_characters():
    """Every code point, beside letters, digits and marks, and before a combining accent."""
    from tokenizers import Tokenizer

    own, theirs = bpe.vocabulary(bpe.default_path()), Tokenizer.from_file(bpe.default_path())
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x33000 or c >= 0xE0000 and c % 16 == 0)]
    texts = [" ".join(f"b{c}1 {c}x !{c}{c}\u0301" for c in every[k : k + 64]) for k in range(0, len(every), 64)]
    for t in texts:
        normal = theirs.normalizer.normalize_str(t)
        assert [w for p in own._pieces(t) for w in own.words(p)] == [normal[a:b] for _, (a, b) in theirs.pre_tokenizer.pre_tokenize_str(normal)]
    some = texts[::12]
    assert [own.encode(t) for t in some] == [x.ids for x in theirs.encode_batch(some, add_special_tokens=False)]


def test_encoder_is_the_library():
    from tokenizers import Tokenizer

    own, theirs = tokens.encoder(tokens.default_path()), Tokenizer.from_file(tokens.default_path())
    texts = ["", "  a  b\n\n c", "a<|endoftext|>b", "don't 12 é 日本", "x" * 5000, "\x85 \x1c a"]
    assert [own.ids(t) for t in texts] == [np.array(theirs.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
