"""Block search against brute force where blocks are many, rows tie, and either side is too large to be broadcast; what a search writes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import ann, search
from corpusmill.operators.chunking import chunks
from corpusmill.schema import ChunkConfig


def vectors(n, seed):
    x = np.random.default_rng(seed).normal(size=(n, 8)).round(1).astype(np.float32)
    x[::3] = x[0]
    return x


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_blocks_give_what_brute_force_gives(spark, monkeypatch, metric, broadcast):
    for name, value in (("QUERY_BLOCK", 16), ("ROW_BLOCK", 32), ("BROADCAST_BLOCKS", broadcast)):
        monkeypatch.setattr(search, name, value)
    x = vectors(150, 1)
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>").repartition(3)
    got = search.batch_top_k(e, e.withColumnRenamed("id", "qid"), 4, metric)
    d = x.astype(np.float64)
    if metric == "cosine":
        d = d / np.maximum(np.sqrt((d**2).sum(axis=1, keepdims=True)), 1e-300)
        s = np.round(d @ d.T + 1e-10, 6)
        order = np.argsort(-s, axis=1, kind="stable")
    else:
        s = np.round(((d[:, None] - d[None]) ** 2).sum(axis=2) + 1e-10, 6)
        order = np.argsort(s, axis=1, kind="stable")
    want = [(q, r + 1, int(order[q, r])) for q in range(150) for r in range(4)]
    assert sorted((r.qid, r.rank, r.id) for r in got.collect()) == want


def test_a_search_of_all_cells_writes_each_query_once(spark, tmp_path, monkeypatch):
    x = vectors(400, 2)
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    index = ann.CellIndex.build(e, str(tmp_path / "i"), 20)
    written = []
    keep = ann.saved

    def noted(df, label):
        out = keep(df, label)
        held = F.octet_length("qm") if "qm" in out.columns else 8 * F.size("v") if "v" in out.columns and "qid" in out.columns else F.lit(0)
        written.append(out.agg(F.coalesce(F.sum(held), F.lit(0))).first()[0])
        return out

    monkeypatch.setattr(ann, "saved", noted)
    asked = e.withColumnRenamed("id", "qid")
    got = index.batch_top_k(asked, 3, index.cells)
    assert sum(written) == 400 * 8 * 4  # the queries' vectors, once
    want = search.batch_top_k(e, asked, 3)
    key = lambda df: sorted((r.qid, r.rank, r.id, r.score) for r in df.collect())
    assert key(got) == key(want)


def brute(q, x, k, metric):
    """(query, row) of the k best, ties by row, rows without a score left out."""
    with np.errstate(all="ignore"):
        if metric == "cosine":
            unit = lambda m: np.where((n := np.sqrt((m**2).sum(axis=1, keepdims=True))) > 0, m / n, 0.0)
            s = -np.round(np.einsum("ik,jk->ij", unit(q), unit(x)) + 1e-10, 6)
        else:
            s = np.round(((q[:, None] - x[None]) ** 2).sum(axis=2) + 1e-10, 6)
    return [(i, j) for i in range(len(q)) for j in [j for j in np.argsort(s[i], kind="stable") if not np.isnan(s[i, j])][:k]]


def block(ids, m):
    return {"ids": pa.array([ids], pa.list_(pa.int64())), "m": pa.array([m.tobytes()], pa.binary())}


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("scale", [1.0, 1e3, 1e-12, 1e20])
def test_few_pairs_are_scored_exactly_and_none_is_missed(monkeypatch, metric, scale):
    r = np.random.default_rng(3)
    q, x = r.normal(size=(300, 16)) * scale, r.normal(size=(2000, 16)) * scale
    if scale == 1.0:
        x[7, 2], x[9, 3], q[5, 1] = np.nan, np.inf, np.nan
    scored, keep = [], search._exact
    monkeypatch.setattr(search, "_exact", lambda q, x, i, *a: scored.append(len(i)) or keep(q, x, i, *a))
    feed = []
    for a in range(0, 2000, 500):
        rows, asked = block(list(range(a, a + 500)), x[a : a + 500]), block(list(range(300)), q)
        feed.append(pa.record_batch({"block": pa.array(["b"]), "qids": asked["ids"], "qm": asked["m"], **rows}))
    with np.errstate(all="ignore"):
        out = pa.Table.from_batches(search._best_of(4, metric, ("f8", "f8"))(iter(feed))).sort_by([("qid", "ascending"), ("score", "ascending" if metric == "l2" else "descending"), ("id", "ascending")])
    assert list(zip(out["qid"].to_pylist(), out["id"].to_pylist(), strict=True)) == brute(q, x, 4, metric)
    if scale != 1e-12 or metric == "cosine":  # else all distances are equal as rounded
        assert sum(scored) < 0.05 * 300 * 2000


def test_of_equal_vectors_a_block_keeps_what_a_search_can_find():
    v = [[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [1.0, 0.0], [0.0, 1.0]]
    rows = pa.record_batch({"id": [5, 4, 3, 2, 1], "v": pa.array(v, pa.list_(pa.float64()))})
    (out,) = search._packer(10, "f8", 2)(iter([rows]))
    assert out["ids"].to_pylist() == [[1, 2, 3, 4]]
    assert np.frombuffer(out["m"][0].as_py()).reshape(4, 2).tolist() == [v[4], v[3], v[2], v[1]]
    ragged = pa.record_batch({"id": [1, 2], "v": pa.array([[1.0], [1.0, 2.0]], pa.list_(pa.float64()))})
    with pytest.raises(ValueError):
        list(search._packer(10)(iter([ragged])))


def test_texts_are_cut_once_and_rows_do_not_carry_all_chunks(spark):
    d = spark.createDataFrame([("u", "t", "one two three. " * 40)], "url string, title string, content string").where("length(content) > 3")
    plan = chunks(d, ChunkConfig(100, 10))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("+- ArrowEvalPython") == 1
    (line,) = [x for x in plan.splitlines() if "Generate posexplode" in x]
    assert "w#" not in line.split("), [", 1)[1].split("]")[0]
