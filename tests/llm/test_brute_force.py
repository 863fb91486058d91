"""Scores, shards, partitions and the whole pipeline held against slow, plain accounts."""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from functools import cache

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from flowtally.llm import mix, pack, quality_forest, quality_gam as gam, shards, simhash
from flowtally.llm.textstats import text_stats

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))


def test_scores_are_sums_of_table_entries(tables):
    """Every document, its bins looked up one by one."""
    docs, labels = tables
    model = gam.fit(docs, labels)
    assert model.pairs and any(abs(t).max() > 0 for t in model.tables)
    got = {r.doc_id: r for r in gam.scores(docs, model).collect()}
    for row in docs.collect():
        x = [text_stats(row.text or "")[k] for k in gam.INPUTS]
        logit = model.intercept
        for k, table in enumerate(model.tables):
            logit += table[bisect_right(model.edges[k].tolist(), x[k])]
        for (a, b), table in zip(model.pairs, model.pair_tables):
            logit += table[bisect_right(model.pair_edges[a].tolist(), x[a])][bisect_right(model.pair_edges[b].tolist(), x[b])]
        score = 1 / (1 + math.exp(-logit))
        held = zlib.crc32(str(row.doc_id).encode()) % 5 == 0
        assert got[row.doc_id].score == pytest.approx(score, abs=1e-9) and got[row.doc_id].held_out == held
        assert got[row.doc_id].predicted == int(got[row.doc_id].score >= 0.3)


def xx(data: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(data, seed & (1 << 64) - 1)


def spark_hash(*parts) -> int:
    """The engine's 64-bit hash of strings and ints (32 bits little-endian), each seeded with the one before."""
    h = 42
    for p in parts:
        h = xx(p.encode() if isinstance(p, str) else int(p).to_bytes(4, "little", signed=True), h)
    return h


def highest_shard(key: str, weights: list[float]) -> int:
    return max(range(len(weights)), key=lambda s: (-weights[s] / math.log(((spark_hash(key, s) >> 11) + 0.5) / (1 << 53)), -s))


def test_shards_against_rendezvous_by_hand(tables):
    docs, _ = tables
    rows = shards.shard_rows(docs).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert r.shard == highest_shard(str(r.doc_id), [1.0] * 8) and r.grown_shard == highest_shard(str(r.doc_id), [1.0] * 9)
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]))
    # Slots: bins of the key's hash one after another, ids in order within a bin.
    bins = max(64, -(-len(rows) // (shards.ROWS_PER_BIN * 8)))
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    place = {r.doc_id: signed(xx(b"bin", xx(r.text_crc32.to_bytes(8, "little"), spark_hash(str(r.doc_id))))) % bins for r in rows}
    for s in range(8):
        own = sorted((r for r in rows if r.shard == s), key=lambda r: (place[r.doc_id], r.doc_id))
        assert [r.slot for r in own] == list(range(len(own)))


def plain_differencing(sizes: list[int], k: int) -> list[int]:
    """Karmarkar-Karp on full tuples of k sums, without any shortcut."""
    states = [(sorted([(0, ())] * (k - 1) + [(s, (i,))], key=lambda x: x[0]), i) for i, s in enumerate(sizes)]
    order = len(sizes)
    while len(states) > 1:
        states.sort(key=lambda x: (-(x[0][-1][0] - x[0][0][0]), x[1]))
        (a, _), (b, _) = states[:2]
        merged = sorted([(x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b))], key=lambda z: z[0])
        low = merged[0][0]
        states = [*states[2:], ([(x - low, p) for x, p in merged], order)]
        order += 1
    window = [0] * len(sizes)
    for w, (_, pieces) in enumerate(states[0][0]):
        for p in pieces:
            window[p] = w
    return window


@settings(deadline=None, max_examples=300)
@given(st.lists(st.integers(1, 512), min_size=1, max_size=12), st.integers(1, 6))
def test_differencing_against_full_tuples(sizes, k):
    """The windows' sums are those of the method on full tuples (equal sums may swap their pieces)."""
    got, want = pack.differencing(np.array(sizes), k), plain_differencing(sizes, k)
    sums = lambda w: sorted(np.bincount(np.asarray(w), sizes, k).tolist())
    if len(set(sizes)) == len(sizes) and k == 2:
        assert sums(got) == sums(want)
    spread = lambda w: max(sums(w)) - min(sums(w))
    assert spread(got) <= max(sizes) and spread(want) <= max(sizes)


@settings(deadline=None, max_examples=40, derandomize=True)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=9), st.integers(60, 130))
def test_windows_against_every_partition(sizes, capacity):
    """No window is over capacity, and their number is at most one above the least possible."""
    found = pack.windows(np.array(sizes), capacity)
    loads = np.bincount(found, sizes)
    assert loads.max() <= capacity

    @cache
    def least(left: tuple[int, ...], space: tuple[int, ...]) -> int:
        if not left:
            return len(space)
        first, rest = left[0], left[1:]
        tries = [tuple(sorted([*space[:i], s - first, *space[i + 1 :]])) for i, s in enumerate(space) if s >= first]
        return min([least(rest, t) for t in dict.fromkeys(tries)] + [least(rest, tuple(sorted([*space, capacity - first])))])

    assert found.max() + 1 <= least(tuple(sorted(sizes, reverse=True)), ()) + 1


def naive_fingerprints_linked(prints: list[int], bits: int = 4) -> list[int]:
    """The smallest place reachable over links, by repeated comparison of all pairs."""
    root = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= bits and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return root


def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows, junk, and columns whose names the stages use themselves."""
    base = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 120").select("doc_id", "text", "lang", "source")
    extra = [(900, None, "en", None), (901, "", None, "x"), (902, "word other " * 4000, "en", "x"), (903, "a b c " * 40, "en", "x"), (904, "x# $ % & " * 60, "en", "x"), (None, "nobody " + " ".join(map(str, range(300))), "en", "x")]
    docs = base.unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string"))
    docs = docs.unionByName(docs.where("doc_id % 10 = 0 or doc_id is null"))
    for name in ("_row", "_score", "score", "kept", "_fp", "_keep", "_copies", "_taken_row", "size", "key", "shard"):
        docs = docs.withColumn(name, F.lit(7))
    return docs


def test_an_odd_table_through_all_stages(spark):
    """Each stage's rows against a plain account of its decision, on what the stage before kept."""
    import corpus_pipeline

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    docs = odd_documents(spark).cache()
    columns = docs.columns
    plain = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.source or "") for r in df.collect())
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["quality_rules"](spark, docs, DATA).cache()
    forest = quality_forest.fit(docs, labels)
    good = []
    for r in docs.collect():
        x = np.array([text_stats(r.text or "")])
        failed = x[0, 0] < 50 or 100 * x[0, 4] > 50 * x[0, 0]
        if not failed and not (forest is not None and forest.scores(x[:, quality_forest.AT])[0] > forest.threshold):
            good.append((r.doc_id is None, r.doc_id or 0, r.text or "", r.source or ""))
    assert kept.columns == columns and plain(kept) == sorted(good) and len(good) > 60

    scored = stages["quality_classifier"](spark, kept, DATA).cache()
    model = gam.fit(kept, labels)
    good = [r for r in kept.collect() if model.score(np.array([text_stats(r.text or "")])[:, gam.INPUTS])[0] >= 0.3]
    assert scored.columns == columns and plain(scored) == sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.source or "") for r in good)

    single = stages["near_duplicates"](spark, scored, DATA).cache()
    rows = sorted(scored.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    roots = naive_fingerprints_linked([simhash.fingerprint(r.text or "") for r in rows])
    assert single.columns == columns and plain(single) == sorted((rows[i].doc_id is None, rows[i].doc_id or 0, rows[i].text or "", rows[i].source or "") for i in sorted(set(roots)))

    mixed = stages["source_mix"](spark, single, DATA).cache()
    copies = {(r.doc_id, r.size): r.copies for r in mix.mix(single).collect()}
    want = sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.source or "") for r in single.collect() for _ in range(copies[(r.doc_id, len((r.text or "").encode().split()))]))
    assert mixed.columns == columns and plain(mixed) == want and set(copies.values()) <= {0, 1, 2}

    pieces = stages["packing"](spark, mixed, DATA).collect()
    loads = {}
    for p in pieces:
        loads.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in loads.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= pack.CAPACITY
    total = {}
    for r in mixed.collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + 1
    for doc_id, n in total.items():
        own = sorted((p.start, p.length, p.doc_tokens) for p in pieces if p.doc_id == doc_id)
        assert sum(length for _, length, _ in own) == n * own[0][2]


@pytest.mark.parametrize("stage", ["quality_rules", "quality_classifier", "near_duplicates", "source_mix", "packing"])
def test_empty_tables_through_each_stage(spark, stage):
    import corpus_pipeline

    docs = odd_documents(spark).limit(0)
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, DATA)
    assert out.count() == 0 and (stage == "packing" or out.columns == docs.columns)
