"""SimHash and embedding links against all pairs."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest
import xxhash

from flowtally.llm import embed_dups, simhash
from flowtally.llm.common import components, join_labels


def naive_fingerprint(text: str) -> int:
    words = text.encode().lower().split()
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


TEXTS = ["", " \n", "one", "One", "a b c d", "a b c d e", "É Ü É Ü é", "x " * 9000, "the quick brown fox jumps over the lazy dog again and again"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == naive_fingerprint(text)


def test_any_four_positions_hold_a_set():
    sets = simhash.position_sets()
    assert len(sets) == 20
    assert all(any(set(s) <= set(q) for s in sets) for q in combinations(range(8), 4))


def partition(n, links):
    i, j = (np.array([x[k] for x in links], int) for k in (0, 1)) if links else (np.zeros(0, int),) * 2
    return join_labels(np.arange(n), i, j)


@pytest.mark.parametrize("block", [4, 1024])
def test_links_find_all_near_fingerprints(spark, block):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    prints = set(base.tolist())
    for b in base[:6]:
        for _ in range(12):
            flips = rng.choice(64, rng.integers(1, 6), replace=False)
            prints.add(int(b) ^ sum(1 << int(f) for f in flips))
    prints = np.array(sorted(prints), np.uint64)
    want = partition(len(prints), [(a, b) for a, b in combinations(range(len(prints)), 2) if int(prints[a] ^ prints[b]).bit_count() <= 4])
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    rows = components(simhash.links(df, block=block)).collect()
    root = {r.node: r.root for r in rows}
    got = [root.get(int(x), int(x)) for x in prints.view(np.int64)]
    assert len(set(zip(want.tolist(), got))) == len(set(want.tolist())) == len(set(got))


def test_near_duplicates_of_documents(spark):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(500)]
    base = [" ".join(rng.choice(words, 300)) for _ in range(5)]
    rows = [(k, t, "s") for k, t in enumerate(base)]
    rows += [(100 + k, t.replace("w1 ", "w2 ", 1), "s") for k, t in enumerate(base)]
    rows += [(200, base[0], None), (200, base[0], None), (None, base[1], "s"), (300, None, "s"), (301, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _keep string")
    got = simhash.near_duplicates(docs).collect()
    prints = [int(r.fingerprint, 16) for r in got]
    want = partition(len(got), [(a, b) for a, b in combinations(range(len(got)), 2) if (prints[a] ^ prints[b]).bit_count() <= 4])
    least = {}
    for r, w in zip(got, want):
        if r.doc_id is not None:
            least[w] = min(least.get(w, r.doc_id), r.doc_id)
    assert [r.component_id for r in got] == [least.get(w) for w in want]
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))


def test_one_of_each_without_rows_or_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0 and simhash.one_of_each(docs).count() == 0
    alone = spark.createDataFrame([(None, "some words"), (None, "some words"), (None, "quite other words here")], "doc_id long, text string")
    assert simhash.one_of_each(alone).count() == 2


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (205, 201), (203, 205)]
    rows = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(rows[k] == 0 for k in range(41)) and all(rows[100 + k] == 100 for k in range(30)) and rows[205] == rows[203] == 201


@pytest.mark.parametrize("block", [6, 512])
def test_embedding_links(spark, monkeypatch, block):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 64))
    near = [b + 0.12 * rng.standard_normal(64) for b in base[:10] for _ in range(4)]
    x = np.array([*base, *near, base[0], base[0], base[3] * 2], np.float32)
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 64), (902, [float("nan")] * 64), (903, [None] * 64), (904, []), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (None, [1.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(embed_dups.near_links, "__defaults__", (embed_dups.COSINE, block))
    got = {r.vec_id: r for r in embed_dups.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    close = u @ u.T >= 0.95
    np.fill_diagonal(close, False)
    label = partition(len(x), [(a, b) for a, b in zip(*np.nonzero(close)) if a < b])
    assert [got[k].n_links for k in range(len(x))] == close.sum(1).tolist()
    assert [got[k].component_id for k in range(len(x))] == label.tolist()
    assert (got[905].n_links, got[906].component_id) == (1, 905)
    assert all(got[k].n_links == 0 and got[k].kept for k in (900, 901, 902, 903, 904))


def test_embeddings_empty(spark):
    assert embed_dups.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_cell_recall():
    """A pair at the threshold shares a cell and passes the count nearly always."""
    rng = np.random.default_rng(5)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    d = rng.standard_normal(a.shape)
    d -= (d * a).sum(1)[:, None] * a
    d /= np.linalg.norm(d, axis=1)[:, None]
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * d
    meet = (embed_dups.cells(a, 64, 0.95) == embed_dups.cells(b, 64, 0.95)).any(1)
    r, _ = embed_dups.directions(64)
    points = np.vstack([a, b]) @ r[:, : embed_dups.COUNTED]
    enough = np.zeros(len(a), bool)
    enough[embed_dups.colliding(points.T, np.arange(2000), np.arange(2000, 4000), embed_dups.WIDTH * embed_dups.spread(0.95, 64))] = True
    assert (meet & enough).mean() >= 0.995
