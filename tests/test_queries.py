"""Every registered query with oracle SQL against DuckDB, and invariants of the others."""

import pytest

from blobsearch import plans
from oracle import compare


@pytest.mark.parametrize("key", sorted(plans.ORACLE))
def test_oracle(spark, sf_dir, key):
    compare(spark, sf_dir, plans.QUERIES[key], plans.ORACLE[key])


def run(spark, sf_dir, key):
    return plans.QUERIES[key](spark, sf_dir).toPandas()


def test_mmr_permutes_candidates(spark, sf_dir):
    out = run(spark, sf_dir, "rerank_mmr")
    assert not out.duplicated(["query_id", "blob_id"]).any()
    best = run(spark, sf_dir, "rerank_mmr_plain")
    first = lambda d: d[d.mmr_rank == 1].set_index("query_id").blob_id.to_dict()
    assert first(out) == first(best)


def test_mmr_tail_and_cross_encoder(spark, sf_dir):
    assert run(spark, sf_dir, "rerank_mmr_tail").groupby("query_id").size().max() == 10
    out = run(spark, sf_dir, "cross_encoder_rerank")
    assert (out["rank"] != out.final_rank).any() and set(out[out["rank"] <= 10].final_rank) == set(range(1, 11))


def test_mmr_against_a_plain_loop(spark, sf_dir):
    import numpy as np

    from blobsearch.plans.registry import Tables
    from blobsearch.plans.search import _candidates

    cand = _candidates(Tables(spark, sf_dir)).toPandas()
    out = run(spark, sf_dir, "rerank_mmr").sort_values("mmr_rank").groupby("query_id").blob_id.apply(list)
    for q, rows in cand.groupby("query_id"):
        rows = rows.sort_values(["sim", "blob_id"], ascending=[False, True]).reset_index(drop=True)
        e, chosen = np.array(rows.embedding.tolist(), float), []
        while len(chosen) < 10:
            best, at = None, None
            for i in range(len(rows)):
                if i not in chosen:
                    near = [e[i] @ e[j] + 0.15 * (rows.parent_quilt_id[i] is not None and rows.parent_quilt_id[i] == rows.parent_quilt_id[j]) for j in chosen]
                    gain = 0.85 * rows.sim[i] - 0.15 * (max(near) if near else 0.0)
                    if best is None or gain > best + 1e-12:
                        best, at = gain, i
            chosen.append(at)
        assert out[q] == rows.blob_id[chosen].tolist()


def test_clusters_of_candidates(spark, sf_dir):
    out = run(spark, sf_dir, "rerank_cluster_search")
    for _, rows in out.groupby("query_id"):
        rows = rows.sort_values("final_rank")
        assert rows.final_rank.tolist() == list(range(1, 11)) and rows.blob_id.is_unique
        # the first pick of every cluster comes before any second one
        n = rows.cluster_id.nunique()
        assert rows.cluster_id[:n].is_unique and rows.cluster_rank[:n].is_monotonic_increasing


def test_decoded_text(spark, sf_dir):
    from blobsearch.plans.registry import Tables

    raw = Tables(spark, sf_dir).v_payloads.toPandas().set_index("blob_id").h
    out = run(spark, sf_dir, "decode_text").set_index("blob_id").text
    assert all(out[i] == bytes.fromhex(h).decode("utf-8", "replace") for i, h in raw.items())


def test_phash_against_a_plain_transform(spark, sf_dir):
    import numpy as np

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas().set_index("vec_id").embedding
    k = np.arange(32)
    basis = 2 * np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64)
    for r in run(spark, sf_dir, "phash_dct").itertuples():
        px = np.array([rows[r.vec_id][i * 7 % 64] for i in range(1024)], float).reshape(32, 32)
        low = (basis @ px @ basis.T)[:8, :8]
        bits = (low > np.median(low[1:])).ravel()
        assert int(r.h) & (1 << 64) - 1 == int("".join(str(int(b)) for b in bits), 2)


def _unit_rows(spark, sf_dir):
    import numpy as np

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id >= 20").toPandas()
    return rows.vec_id.astype(str).tolist(), np.array(rows.embedding.tolist(), float)


def test_pca_against_a_plain_decomposition(spark, sf_dir):
    import numpy as np

    ids, x = _unit_rows(spark, sf_dir)
    x = x - x.mean(0)
    values, vectors = np.linalg.eigh(x.T @ x)
    for c, name in ((-1, "x"), (-2, "y")):
        v = vectors[:, c] * np.sign(vectors[np.abs(vectors[:, c]).argmax(), c])
        got = run(spark, sf_dir, "pca_2d").set_index("blob_id")[name]
        assert np.abs(got[ids].to_numpy() - x @ v).max() < 1e-6


def test_adapter_against_a_plain_product(spark, sf_dir):
    import numpy as np

    ids, x = _unit_rows(spark, sf_dir)
    r = np.random.default_rng(1)
    w, b = 0.1 * r.standard_normal((64, 64)), 0.05 * r.standard_normal(64)
    y = x + x @ w.T + b
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    out = run(spark, sf_dir, "residual_adapter").set_index("blob_id").embedding
    assert np.abs(np.array(out[ids].tolist()) - y).max() < 1e-6


def test_resumed_stream_reads_once(spark, sf_dir):
    out = run(spark, sf_dir, "stream_cursor_resume")
    assert len(out) == out.event_id.nunique() == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_rows_only(spark, sf_dir):
    for key in set(plans.QUERIES) - set(plans.ORACLE):
        assert plans.QUERIES[key](spark, sf_dir).columns
