"""Sharding, mixing, licence scans, the WARC source and the pipeline."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from flowtally.llm import licences, mix, shards, warc

ROWS = [(1, "one two", "a"), (2, None, "b"), (3, "", None), (4, "x y z é", "b"), (4, "x y z é", "b"), (None, "nul", "c"), (None, "nul", "c"), (7, "w " * 30_000, "a")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 5, "q") for r in ROWS], "doc_id long, text string, source string, size int, shard string")


def test_shards(spark, odd):
    many = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 7).alias("text"))
    for docs, n in ((odd, len(ROWS)), (many, 5000), (odd.limit(0), 0)):
        rows = shards.shard_rows(docs).collect()
        assert len(rows) == n
        for s in range(8):
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
        assert all(r.grown_shard in (r.shard, 8) and r.law == "key" for r in rows)
    texts = {(r.doc_id, zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 1) for r in odd.collect()}
    assert {(r.doc_id, r.text_crc32, r.size) for r in shards.shard_rows(odd).collect()} == texts


def test_shards_follow_weights(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = {r.shard: r["count"] for r in shards.shard_rows(docs, (1.0, 2.0, 5.0)).groupBy("shard").count().collect()}
    assert abs(got[0] / 2500 - 1) < 0.1 and abs(got[1] / 5000 - 1) < 0.1 and abs(got[2] / 12_500 - 1) < 0.1


def naive_targets(sizes: dict) -> dict:
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, out, total = set(names), {}, 1.5 * sum(sizes.values())
    while left:
        level = (total - sum(out.values())) / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] >= 2 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in left}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= over
    return out


def test_mix(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for table, slack in ((docs, 40), (odd, 40)):
        rows = mix.mix(table).toPandas()
        source = table.toPandas()
        assert len(rows) == len(source)
        sizes = {None if s != s else s: int(t.fillna("").map(lambda x: len(x.encode().split())).sum()) for s, t in source.groupby("source", dropna=False).text}
        want = naive_targets(sizes)
        taken = rows.merge(source[["doc_id", "source"]].drop_duplicates(), on="doc_id").groupby("source", dropna=False).agg(t=("target", "first"), s=("source_size", "first"))
        for s, r in taken.iterrows():
            assert r.t == pytest.approx(want[None if s != s else s]) and r.s == sizes[None if s != s else s]
        assert (rows.taken <= 2 * rows["size"]).all() and (rows.taken >= 0).all()
        for t, g in rows.groupby("target"):
            assert abs(g.taken.sum() - t * g.source_size.nunique()) <= slack * max(1, g.source_size.nunique()) or abs(g.taken.sum() / t - 1) < 0.02
    assert mix.mix(odd.limit(0)).count() == 0
    again = mix.mix(docs).toPandas().sort_values("doc_id").taken.tolist()
    assert again == mix.mix(docs.repartition(7)).toPandas().sort_values("doc_id").taken.tolist()


def test_apportion_takes_the_highest_quotients(spark):
    votes = [("a", 53000.0), ("b", 24000.0), ("c", 23000.0), ("d", 1000.0), (None, 777.0)]
    for seats in (1, 7, 10, 33, 500):
        df = spark.createDataFrame([(s, v, seats, 1) for s, v in votes], "source string, votes double, seats long, g int")
        got = {r.source: r.quota for r in mix.apportion(df, ["g"], ["source"], "votes", "seats").collect()}
        quotients = sorted(((-v / (2 * j + 1), s is None, s or "", s) for s, v in votes for j in range(seats)), key=lambda q: q[:3])[:seats]
        assert got == {s: sum(q[3] == s for q in quotients) for s, _ in votes}


def highest(votes: dict, seats: int) -> dict:
    """Seats to the highest quotients, one at a time; ties to the smaller name, None last."""
    held = dict.fromkeys(votes, 0)
    if sum(votes.values()) > 0:
        for _ in range(seats):
            best = min(votes, key=lambda s: (-votes[s] / (2 * held[s] + 1), s is None, s))
            held[best] += 1
    return held


def naive_shard_quotas(words: dict[int, float], seats: int, bits: int = mix.FAN_BITS) -> dict[int, int]:
    """Seats handed down the tree of shard numbers, node by node."""
    level = 0
    while max(words) >> (bits * (level + 1)):
        level += 1

    def down(node: int, k: int, seats: int) -> dict[int, int]:
        if k < 0:
            return {node: seats}
        loads = {}
        for s, w in words.items():
            if s >> (bits * (k + 1)) == node:
                loads[s >> (bits * k)] = loads.get(s >> (bits * k), 0.0) + w
        return {s: q for child, n in highest(loads, seats).items() for s, q in down(child, k - 1, n).items()}

    return down(0, level, seats)


def test_mix_against_a_word_by_word_one(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for table, block, shard_words in ((docs, 8, 100), (odd, 3, 500)):
        got = sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.taken) for r in mix.mix(table, block=block, shard_words=shard_words).collect())
        key = F.xxhash64(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")))
        rows = table.select("doc_id", "text", "source", key.alias("key")).select("*", F.xxhash64("key", F.lit(mix.SEED)).alias("deal"), F.xxhash64("key", F.lit(mix.SEED + 2)).alias("place")).collect()
        size = lambda r: len((r.text or "").encode().split())
        by_source = {}
        for r in rows:
            by_source.setdefault(r.source, []).append(r)
        targets = naive_targets({s: sum(map(size, g)) for s, g in by_source.items()})
        seats = highest(targets, round(sum(targets.values()) / block))
        want, deep = [], 0
        for source, group in by_source.items():
            n_shards = max(1, -(-sum(map(size, group)) // shard_words))
            members = {}
            for r in group:
                members.setdefault(r.deal % n_shards, []).append(r)
            deep = max(deep, max(members))
            quota = naive_shard_quotas({s: float(sum(map(size, g))) for s, g in members.items()}, seats[source])
            phases = spark.createDataFrame([(source, s) for s in members], "s string, shard long").select("shard", F.xxhash64("s", "shard", F.lit(mix.SEED + 1)).alias("h")).collect()
            phase = {r.shard: r.h for r in phases}
            for s, g in members.items():
                g.sort(key=lambda r: (r.place, r.key))
                words = sum(map(size, g))
                n = max(1, int(words / block + 0.5))
                k = min(quota[s], 2 * n)
                passes, part, start = k // n, k % n, phase[s] % n
                chosen = [(b + 1) * part + start >= n * ((b * part + start) // n + 1) for b in range(n)]
                assert sum(chosen) == part
                given = lambda x: sum(max(0.0, min(x, (b + 1) * words / n) - b * words / n) for b in range(n) if chosen[b])
                at = 0
                for r in g:
                    m, whole = size(r), lambda x: int(x + 0.5 + 1e-9)
                    want.append((r.doc_id is None, r.doc_id or 0, m, min(2 * m, passes * m + whole(given(at + m)) - whole(given(at))) if m else 0))
                    at += m
        want.sort()
        off = [(a, b) for a, b in zip(got, want) if a != b]
        # A border within 1e-9 of half a word may round either way.
        assert len(got) == len(want) and all(a[:3] == b[:3] and abs(a[3] - b[3]) <= 1 for a, b in off) and len(off) <= len(want) // 50
        assert table is odd or deep >= mix.FAN


def test_apportion_compares_few_quotients(spark):
    votes = [(k, 1.0 + (k * 7919 % 1000) / 500) for k in range(300)] + [(300, 5000.0)]
    df = spark.createDataFrame([(s, v, 4000, 1) for s, v in votes], "shard long, votes double, seats long, g int")
    got = {r.shard: r.quota for r in mix.apportion(df, ["g"], ["shard"], "votes", "seats").collect()}
    assert got == highest(dict(votes), 4000)


def test_mixed_rows_repeat_whole_documents(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mix.mixed_rows(docs)
    assert rows.columns == docs.columns
    counts = [r["count"] for r in rows.groupBy("doc_id").count().collect()]
    assert set(counts) <= {1, 2}
    assert mix.mixed_rows(odd).columns == odd.columns and mix.mixed_rows(odd.limit(0)).count() == 0


def test_licences(spark):
    texts = {
        1: "Intro.\nReleased under the MIT License.\nMore",
        2: "This work is licensed under the GNU General Public License, version 3.",
        3: "You may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS.",
        4: "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis. You may obtain a copy of the License at",
        5: "Licensed under CC BY-NC 4.0! licensed under the apache license, version 2.0. Licensed under CC BY-NC 4.0.",
        6: "a license is good",
        7: "",
        8: None,
    }
    docs = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, licences string")
    got = {r.doc_id: (r.n_known, r.licences) for r in licences.scan(docs).collect()}
    assert got == {1: (1, "MIT"), 2: (1, "GPL-3.0-only"), 3: (3, "Apache-2.0"), 4: (2, ""), 5: (3, "Apache-2.0,CC-BY-NC-4.0"), 6: (0, ""), 7: (0, ""), 8: (0, "")}
    assert licences.scan(docs.limit(0)).count() == 0


def pages(spark):
    big = "<p>é</p>" * 300
    rows = [(1, "http://a/1", big), (5, "http://a/5", big), (3, None, big), (2, "u", "small"), (4, "u", "small"), (6, "u\r\nX: y", None), (7, "u", ""), (8, "u", "x" * 400_000), (9, "u", "a\r\n\r\nb" * 200)]
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")


def test_warc_round_trip(spark):
    table = pages(spark)
    got = {r.page_id: r for r in warc.page_index(table).collect()}
    for r in table.collect():
        raw = (r.html or "").encode()
        assert (got[r.page_id].payload_bytes, got[r.page_id].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert {k: (r.record_type, r.refers_to) for k, r in got.items() if r.record_type == "revisit"} == {1: ("revisit", 5), 3: ("revisit", 5)}
    assert warc.page_index(table.limit(0)).count() == 0


def test_warc_pushes_filters_and_reads_foreign_members(spark, tmp_path):
    import gzip

    path = str(tmp_path / "w")
    warc.archive(pages(spark), path)
    plain = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 6\r\n\r\nH\r\n\r\nok\r\n\r\n"
    (tmp_path / "w" / "z.warc.gz").write_bytes(gzip.compress(plain) + gzip.compress(plain.replace(b"urn:x", b"urn:y")))
    rows = spark.read.format("warc").load(path)
    assert rows.where("record_type = 'revisit'").count() == 2
    some = rows.where("record_type = 'response' and record_id like 'urn:page:%' and payload_bytes = 400000")
    assert some.first().payload == b"x" * 400_000
    assert {bytes(r.payload) for r in rows.where("record_id in ('urn:x', 'urn:y')").collect()} == {b"ok"}
    bare = spark.read.format("warc").option("payload", "false").option("target_mb", "0.001").load(path)
    assert "payload" not in bare.columns and bare.count() == 11


def test_skipped_payloads_are_not_read():
    row = type("R", (), {"record_id": "urn:a", "record_type": "response", "target_uri": "u", "refers_to": None, "payload": bytes(range(256)) * 4000})
    import io

    content = warc.member(warc.record(row)) * 3

    class Watched(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            Watched.taken += len(out)
            return out

        def size(self):
            return len(content)

    reader = warc.WarcReader({"path": "/x"}, True)
    assert list(reader.records(Watched(content), [lambda r: r["record_type"] == "request"])) == []
    assert Watched.taken <= 3 * 4096


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf_dir)
        assert docs.columns == before.columns, name
        docs = docs.cache()
        assert 0 < docs.count() <= 2 * n
    assert corpus_pipeline.run(spark, sf_dir).count() >= docs.count()
