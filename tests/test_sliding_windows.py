"""Windows that slide over one table of token vectors give the sums and losses of windows built one by one."""

import numpy as np
import pyarrow as pa
import pytest
from wordloom.operators import models as md
from wordloom.operators import samples as sm


def _batches(draw, n_ids, with_chunks):
    docs = [draw.integers(0, n_ids + 3, int(k)) for k in draw.choice([0, 1, 3, 5, 9, 40, 300], 30)]
    if not with_chunks:
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array([None, *range(1, 30)], pa.int64()), "ids": pa.array([d.tolist() for d in docs], pa.list_(pa.int64()))})
        return
    rows = [(i, k, max(0, k * 32 - 8), 32, d[max(0, k * 32 - 8):(k + 1) * 32].tolist()) for i, d in enumerate(docs) for k in range(-(-len(d) // 32))]
    doc, chunk, first, size, ids = zip(*rows, strict=True)
    yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(chunk, pa.int64()), pa.array(first, pa.int64()), pa.array(size, pa.int32()),
                                      pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "chunk", "first", "size", "ids"])


def _rare(batch, matrix, has, cold):
    """The batch with the vectors of ids from ``cold`` on, as ``vector_source`` gives them."""
    rows = [[{"token_id": i, "embedding": matrix[i].tolist()} for i in sorted({i for i in ids if cold <= i < len(has) and has[i]})]
            for ids in batch.column("ids").to_pylist()]
    kind = pa.list_(pa.struct([("token_id", pa.int64()), ("embedding", pa.list_(pa.float32()))]))
    return batch.append_column("rare", pa.array([r or None for r in rows], kind))


@pytest.mark.parametrize("align", [False, True])
@pytest.mark.parametrize("form", ["documents", "chunks", "rare"])
@pytest.mark.parametrize("C, d, share", [(4, 3, 0.9), (8, 20, 0.97), (1, 2, 0.5)])
def test_sums_and_losses_equal_those_of_single_windows(form, align, C, d, share):
    draw = np.random.default_rng(C)
    matrix, has = draw.normal(size=(50, d)).astype(np.float32), draw.random(50) < share
    batches = list(_batches(draw, 50, form != "documents"))
    source = matrix, has
    if form == "rare":
        hot = np.flatnonzero(has[:30])
        batches, source = [_rare(b, matrix, has, 30) for b in batches], (matrix[hot], hot)
    p, w = C * d + 1, draw.normal(size=(C * d + 1, d))
    want, plain, losses = md._Gram(p, d), {}, {}
    for doc, pos, target, X, Y in sm.chunk_blocks(iter(batches), *source, C, 50, align):
        want.add(X, Y)
        plain |= {(doc, i): (t, (((x @ w[:-1] + w[-1]) - y) ** 2).sum()) for i, t, x, y in zip(pos.tolist(), target.tolist(), X, Y, strict=True)}
    for tokens in (16, 1 << 11):
        got, losses = md._Gram(p, d), {}
        for heads, slide in sm.sliding_blocks(iter(batches), *source, C, 50, align, tokens):
            for doc, pos, target, X, Y in heads:
                assert pos.max() < C
                got.add(X, Y)
                losses |= {(doc, i): (t, (((x @ w[:-1] + w[-1]) - y) ** 2).sum()) for i, t, x, y in zip(pos.tolist(), target.tolist(), X, Y, strict=True)}
            if slide is not None:
                docs, row, pos, ids, encoded, vectors, sampled = slide
                got.slide(encoded, vectors, sampled)
                for i in np.flatnonzero(sampled).tolist():
                    x = encoded[i - C:i].ravel()
                    losses[docs[row[i]], int(pos[i])] = int(ids[i]), (((x @ w[:-1] + w[-1]) - vectors[i]) ** 2).sum()
        got._settle()
        assert got.n == want.n > 0
        assert np.allclose(np.triu(got.total), np.triu(want.total), atol=1e-8)
        assert losses.keys() == plain.keys()
        assert all(losses[k][0] == plain[k][0] and np.isclose(losses[k][1], plain[k][1]) for k in plain)


def test_only_the_first_positions_are_built_as_windows(monkeypatch):
    built, features = [], sm.window_features

    def counted(*args, **more):
        out = features(*args, **more)
        built.append(len(out[0]))
        return out

    monkeypatch.setattr(sm, "window_features", counted)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "ids": [list(range(40)) * 50]})
    n = 0
    for heads, slide in sm.sliding_blocks(iter([batch]), np.ones((40, 3), np.float32), np.ones(40, bool), 8, 50):
        n += sum(len(h[1]) for h in heads) + int(slide[-1].sum())
    assert n == 2000 and sum(built) == 8


@pytest.mark.parametrize("limit", [None, 5])
def test_summaries_of_features_are_taken_where_they_are_built(spark, limit):
    draw = np.random.default_rng(4)
    docs = spark.createDataFrame([(i, draw.integers(0, 12, int(draw.integers(1, 60))).tolist()) for i in range(20)], "doc_id long, ids array<long>")
    vectors = spark.createDataFrame([(i, draw.normal(size=3).tolist()) for i in range(11)], "token_id long, embedding array<double>")
    from wordloom.plans import queries as q
    want = {(r.doc_id, r.pos): r for r in sm.next_token_features(docs, vectors, 4, 50, max_broadcast_rows=limit).collect()}
    got = sm.next_token_features(docs, vectors, 4, 50, chunk=16, max_broadcast_rows=limit, summary=(q._feature_checksums, q._CHECKSUMS))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "array<double>" not in plan and got.columns[3:] == q._CHECKSUMS.names
    rows = got.collect()
    assert len(rows) == len(want) > 50
    for r in rows:
        w = want[r.doc_id, r.pos]
        assert (r.target_id, r.n_features) == (w.target_id, 12)
        for values, plain, weighted in ((w.features, r.feature_sum, r.feature_weighted), (w.target, r.target_sum, r.target_weighted)):
            assert np.isclose(sum(values), plain) and np.isclose(sum((k + 1) * x for k, x in enumerate(values)), weighted)
