"""Token rollups, and the pipeline."""

import random
from collections import defaultdict

import pytest
from llm_models import EDGE
from tokenizers import Tokenizer

import corpus_pipeline
from test_pairs import components, passages
from test_texts import check_packing
from vellum.llm import shared, suffix_dedup, token_rollups, tokens
from vellum.llm.queries import QUERIES


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect() if r.n_docs or r.n_tokens}


def test_rollup_query(spark, sf, documents):
    own = Tokenizer.from_file(tokens.default_path())
    count = lambda t: len(own.encode(t, add_special_tokens=False).ids)
    want = defaultdict(lambda: [0, 0])
    for r in documents.collect():
        if len(r.text.encode().split()) >= 10:
            want[r.source, r.lang][0] += 1
            want[r.source, r.lang][1] += count("\n".join(dict.fromkeys(r.text.split("\n"))))
    got = {(r.source, r.lang): [r.n_docs, r.n_tokens] for r in QUERIES["op2_token_rollups"](spark, sf).collect() if r.n_docs}
    assert got == dict(want)
    assert all(r.insert_tokens + r.revise_tokens + r.delete_tokens == r.n_tokens for r in QUERIES["op2_token_rollups"](spark, sf).collect())


def test_rollup_loaded(spark, sf, documents):
    """The totals of all whole texts are returned beside those after the later batches."""
    own = Tokenizer.from_file(tokens.default_path())
    want = defaultdict(lambda: (0, 0))
    for r in documents.collect():
        d, t = want[r.source, r.lang]
        want[r.source, r.lang] = (d + 1, t + len(own.encode(r.text, add_special_tokens=False).ids))
    assert {(r.source, r.lang): (r.loaded_docs, r.loaded_tokens) for r in QUERIES["op2_token_rollups"](spark, sf).collect()} == dict(want)
    nulls = spark.createDataFrame([(1, None, None, "a"), (2, None, None, "b c")], "doc_id long, source string, lang string, text string")
    assert [(r.n_docs, r.loaded_docs) for r in token_rollups.document_totals(nulls).collect()] == [(0, 2)]


def test_rollup_batches(spark):
    """Random batches, some sent again, against a dictionary."""
    rng, state = random.Random(1), {}
    rollup = token_rollups.TokenRollup(spark, shared.fresh_path(spark, "rollup"))
    assert rollup.totals().count() == 0
    for b in range(5):
        rows = [(s, rng.choice(["insert", "revise", "delete"]), rng.choice([None, *range(8)]), rng.choice(["t1", "t2"]), rng.choice(["a", None]), rng.choice(["en", "de"]), rng.choice([None, rng.randint(0, 99)])) for s in range(12)]
        df = spark.createDataFrame(rows, token_rollups.CHANGES)
        assert rollup.commit(f"b{b}", df)
        assert not rollup.commit(f"b{b}", df.limit(3))
        for _, op, doc, tok, source, lang, n in sorted((r for r in rows if r[2] is not None), key=lambda r: r[0]):
            if op == "delete":
                state.pop((doc, tok), None)
            else:
                state[doc, tok] = (source, lang, n or 0)
        want = defaultdict(lambda: (0, 0))
        for (_, tok), (source, lang, n) in state.items():
            d, t = want[source, lang, tok]
            want[source, lang, tok] = (d + 1, t + n)
        assert totals(rollup) == dict(want)
        if b == 2:
            rollup.compact("all-2")
            assert rollup.committed() == ["all-2"] and totals(rollup) == dict(want)


def one_change(spark, *rows):
    return spark.createDataFrame(list(rows), token_rollups.CHANGES)


def test_rollup_lost_commit(spark, monkeypatch):
    """A batch whose driver is lost before its claim does not count, and can be sent again."""
    rollup = token_rollups.TokenRollup(spark, shared.fresh_path(spark, "rollup"))
    one = one_change(spark, (0, "insert", 1, "t", "a", "en", 5))

    def lost(*args):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(token_rollups.TokenRollup, "_claim", lost)
        with pytest.raises(OSError):
            rollup.commit("b0", one)
    assert rollup.totals().count() == 0 and rollup.state().count() == 0
    assert rollup.commit("b0", one) and totals(rollup) == {("a", "en", "t"): (1, 5)} and not rollup.commit("b0", one)


def test_rollup_two_writers(spark, monkeypatch):
    """A writer that another one overtakes applies its batch to what that one left."""
    path = shared.fresh_path(spark, "rollup")
    rollup, other = token_rollups.TokenRollup(spark, path), token_rollups.TokenRollup(spark, path)
    rollup.commit("b0", one_change(spark, (0, "insert", 1, "t", "a", "en", 5)))
    claim, done = token_rollups.TokenRollup._claim, []

    def overtaken(self, entry):
        if not done:
            done.append(entry)
            assert other.commit("b1", one_change(spark, (0, "revise", 1, "t", "a", "de", 9)))
        return claim(self, entry)

    monkeypatch.setattr(token_rollups.TokenRollup, "_claim", overtaken)
    assert rollup.commit("b2", one_change(spark, (0, "revise", 1, "t", "b", "de", 2)))
    assert totals(rollup) == {("b", "de", "t"): (1, 2)} and rollup.committed() == ["b0", "b1", "b2"]


@pytest.mark.parametrize("step", [0, 3, 7])
def test_rollup_compaction(spark, monkeypatch, step):
    """A compacted batch sent again is not applied, and a driver lost at any step of dropping loses nothing."""
    rollup = token_rollups.TokenRollup(spark, shared.fresh_path(spark, "rollup"))
    one = one_change(spark, (0, "insert", 1, "t", "a", "en", 5), (1, "insert", 2, "t", "a", "en", 7))
    rollup.commit("b0", one)
    rollup.commit("b1", one_change(spark, (0, "delete", 1, "t", "a", "en", 0)))
    want, drop, calls = {("a", "en", "t"): (1, 7)}, shared.drop, []

    def lost(*args):
        if len(calls) == step:
            raise OSError("lost")
        calls.append(args)
        drop(*args)

    with monkeypatch.context() as m:
        m.setattr(shared, "drop", lost)
        with pytest.raises(OSError):
            rollup.compact("c0")
    assert totals(rollup) == want and rollup.committed() == ["c0"]
    assert not rollup.commit("b0", one) and totals(rollup) == want and rollup.state().count() == 1
    rollup.compact("c1")
    assert rollup.committed() == ["c1"] and not rollup.commit("b1", one) and not rollup.commit("c0", one) and totals(rollup) == want


def test_rollup_edge(edge, empty):
    got = token_rollups.document_totals(edge).collect()
    assert sum(r.n_docs for r in got) == len({i for i, t in EDGE if i is not None and len((t or "").encode().split()) >= 10})
    assert token_rollups.document_totals(empty).count() == 0


def run_stages(spark, docs, sf):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(shared.written(stage(spark, out[-1], sf), name.replace(" ", "-")))
    return out


def test_pipeline(spark, sf, documents):
    docs, good, one, cut, packed = run_stages(spark, documents, sf)
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {i for i, _ in rows(good)}
    assert {r.doc_id for r in QUERIES["op3_quality_rules"](spark, sf).where("kept").collect()} == kept
    clean = [i in kept for i, t in rows(docs) if labels.get(i) == (1, 0) and len(t.split()) >= 10]
    assert sum(clean) > 0.95 * len(clean)
    assert {i for i, _ in rows(one)} == {c for _, c in components(rows(good)).values()}
    _, copy = passages(rows(one))
    assert sorted(rows(cut)) == sorted((i, suffix_dedup.cut(t, [(k, 1) for k in copy[i]]) if i in copy else t) for i, t in rows(one)) or passages_cut_alike(rows(one), rows(cut), copy)
    assert all(x.columns == docs.columns for x in (good, one, cut)) and all(r.n_chars == len(r.text) for r in cut.collect())
    check_packing(packed.collect(), rows(cut))
    same = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert same(corpus_pipeline.run(spark, sf)) == same(packed)


def passages_cut_alike(before, after, copy):
    """The words left are those that are no copies."""
    after = dict(after)
    return all([w for k, w in enumerate(t.encode().split()) if k not in copy.get(i, ())] == after[i].encode().split() for i, t in before)


def test_pipeline_edge(spark, sf, edge, empty):
    for docs in (edge, empty):
        _, good, one, cut, packed = run_stages(spark, docs, sf)
        assert good.columns == one.columns == cut.columns == docs.columns
        assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in cut.collect()}
