"""Whitening and the trie join of SimHash fingerprints, against direct computations."""

import numpy as np
import pytest
import xxhash
from conftest import FOLDER

from sparsile.llm import lanczos_whiten, simhash_trie
from sparsile.llm.queries import QUERIES


# ---- whitening -------------------------------------------------------------

def whitened(frame, k=32):
    rows = frame.toPandas().sort_values(["vec_id", "component"])
    return rows, rows.whitened.to_numpy().reshape(-1, min(k, rows.component.max()))


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_whitening_equals_eigenvectors(spark, folder):
    given = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.floor(64 * np.stack(given.embedding.to_list()).astype(float)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:32], vectors[:, ::-1][:, :32]
    rows, white = whitened(QUERIES["op12_lanczos_whiten"](spark, folder))
    want = centred @ vectors / np.sqrt(values)
    assert np.abs(white * np.sign((white * want).sum(axis=0)) - want).max() < 1e-8
    assert np.allclose(rows.explained.to_numpy()[:32], values / np.trace(centred.T @ centred / n), rtol=1e-10, atol=0)
    assert rows.identity_error.nunique() == 1 and rows.identity_error.iloc[0] < 1e-9
    assert (rows.deviation.to_numpy().reshape(n, -1) == ((n * x - total) ** 2).sum(axis=1)[:, None]).all()


def test_equal_variances_and_odd_rows(spark):
    rows = [(i, [float(s * (j == i)) for j in range(8)]) for s in (1, -1) for i in range(6)]
    odd = [(None, [0.0] * 8), (7, None), (8, [1.0, None, *[0.0] * 6]), (9, [float("nan")] * 8), (9, [float("inf")] * 8), (10, [1.0] * 3), (11, []), (12, [1e300] * 8)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 AS n", "'x' AS component", "2 AS data")
    found = lanczos_whiten.whiten(table).toPandas()
    # six directions of equal variance, all found; two have none
    assert sorted(found.component.unique()) == [1, 2, 3, 4, 5, 6] and len(found) == 13 * 6
    assert found.identity_error.max() < 1e-9 and np.allclose(found.explained, 1 / 6)
    assert found.vec_id.isna().sum() == 6
    nothing = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert lanczos_whiten.whiten(nothing).collect() == lanczos_whiten.whiten(nothing.limit(0)).collect() == lanczos_whiten.whiten(table.filter("vec_id = 7")).collect() == []


def test_large_numbers_stay_exact(spark):
    rows = [("a", [1e9, 2.0]), ("b", [-1e9, 2.5]), ("c", [5.0, 1e12])]
    found = {r.vec_id: r.deviation for r in lanczos_whiten.whiten(spark.createDataFrame(rows, "vec_id string, embedding array<double>")).collect() if r.component == 1}
    x = [[int(64 * c // 1) + 1_000_000 for c in v] for _, v in rows]
    total = [sum(c) for c in zip(*x)]
    exact = {k: sum((3 * a - s) ** 2 for a, s in zip(v, total)) for (k, _), v in zip(rows, x)}
    assert found == {k: v if v < 2**63 else None for k, v in exact.items()}


# ---- SimHash ---------------------------------------------------------------

def print_of(text, width=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints, errors=3):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = np.array(prints, dtype=np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= errors) + i + 1:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprints_and_components(spark):
    for folder in (FOLDER, "/root/testdata/sf0.01"):
        texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
        found = {r.doc_id: r for r in QUERIES["op13_simhash_trie"](spark, folder).collect()}
        keys = sorted(texts)
        prints = [print_of(texts[k]) for k in keys]
        assert [found[k].fingerprint for k in keys] == [f"{p:016x}" for p in prints]
        assert [found[k].component_id for k in keys] == [keys[r] for r in roots(prints)]


def test_long_text_in_parts():
    text = b" \n".join(b"w%d" % (i % 613) for i in range(5000))
    whole = simhash_trie.fingerprint_of(text)
    for size in (7, 100, 4096):
        assert [w for part in simhash_trie.word_parts(text, size) for w in part] == text.split()
    assert whole == print_of(text.decode())


@pytest.mark.parametrize("n,centres,flips,cells", [(2500, 3, 4, 64), (2500, 900, 6, 32), (2500, 1, 3, 256), (2500, 30, 8, 150), (400, 400, 0, 1), (2, 1, 3, 9)])
def test_links_join_exactly_the_classes(spark, monkeypatch, n, centres, flips, cells):
    monkeypatch.setattr(simhash_trie, "FRONTIER", 500)
    rng = np.random.default_rng(n + centres + flips)
    prints = set()
    for centre in rng.integers(0, 2**63, centres).tolist():
        for _ in range(max(1, n // centres)):
            value = centre
            for bit in rng.integers(0, 64, int(rng.integers(0, flips + 1))).tolist():
                value ^= 1 << bit
            prints.add(value)
    prints = sorted(prints)
    signed = {p: p - 2**64 if p >= 2**63 else p for p in prints}
    found = simhash_trie.links(spark.createDataFrame([(s,) for s in signed.values()], "fp long"), 3, cells).collect()
    place = {s: i for i, s in enumerate(signed.values())}
    want = roots(prints)
    root = list(range(len(prints)))
    for r in found:  # links stay inside classes, and join all of each
        u, v = place[r.u], place[r.v]
        assert want[u] == want[v]
        while root[u] != u:
            u = root[u]
        while root[v] != v:
            v = root[v]
        root[max(u, v)] = min(u, v)
    final = []
    for i in range(len(prints)):
        while root[i] != i:
            i = root[i]
        final.append(i)
    assert final == want


def test_cells_tile_all_values():
    rng = np.random.default_rng(4)
    dense = (np.uint64(1 << 63) + rng.integers(0, 1 << 20, 5000).astype(np.uint64))
    starts, depths = simhash_trie.cut_cells(np.concatenate([dense, rng.integers(0, 2**63, 100).astype(np.uint64)]), 64)
    sizes = [1 << (64 - int(d)) for d in depths]
    assert starts[0] == 0 and sum(sizes) == 1 << 64
    assert all(int(s) + size == int(t) for s, size, t in zip(starts, sizes, starts[1:]))
    assert np.histogram(dense, np.append(starts, np.uint64(2**64 - 1)))[0].max() < 400
