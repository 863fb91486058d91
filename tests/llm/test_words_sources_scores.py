"""Spelling variants, source divergence and context-tree scores against plain accounts."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from flowtally.llm import context_tree, divergence, queries, spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and columns whose names clash with helpers."""
    rows = [(1, "Words worlds swords", "en", "a"), (1, "Words worlds swords", "en", "a"), (2, None, None, None), (None, "éclair Éclair eclair", "fr", None), (4, "", "", ""), (5, "x" * 3000 + " " + "longer words " * 4000, "en", "b"), (6, "\t\n 12 --  é", "fr", "c"), (7, "words", "en", "c")]
    return spark.createDataFrame([(*r, 1, "q", 2.0) for r in rows], "doc_id long, text string, lang string, source string, n int, word string, p double")


# Spelling -----------------------------------------------------------------------------


def near_by_hand(words):
    """Words at one inserted, deleted or replaced letter, by what is left when a letter goes."""
    near, without = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            without[(i, rest)].add(w)
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    for same in without.values():
        for a in same:
            near[a] |= same - {a}
    return near


def variants_by_hand(rows, length=6, count=5, ratio=5, every=199):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= length and c >= count}
    near = near_by_hand(n)
    form = {}
    for w in n:
        best = min(near[w], key=lambda y: (-n[y], y), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


def found(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_op11_against_a_plain_account(spark, sf_dir):
    want = variants_by_hand([(r.doc_id, r.text) for r in table(spark, sf_dir).collect()])
    assert found(queries.op11_spelling_trie(spark, sf_dir)) == want and len(want) > 100


def test_thinned_words_and_chains_of_forms(spark):
    """Every third checksum deletes a letter; chains of forms and ties."""
    rng = random.Random(5)
    words = ["aabbcc", "aabbcd", "aabbdd", "abbdda", "aabbc", "éàübcdé", "éàübcd", "éàübcdéé"]
    rows = [(rng.randrange(50) if rng.random() < 0.9 else None, " ".join(w.upper() if rng.random() < 0.2 else w for w in rng.choices(words, [200, 40, 8, 1, 5, 30, 6, 5], k=30))) for _ in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for length, count, every in ((5, 1, 3), (1, 2, 2), (6, 5, 199)):
        want = variants_by_hand(rows, length, count, 5, every)
        assert found(spelling.variants(docs, length, count, 5, every)) == want
    assert any(w[1] != w[0] and w[0] for w in variants_by_hand(rows, 5, 1, 5, 3).values())


@pytest.mark.parametrize("letters", ["ab", "abcdé"])
def test_near_pairs_of_dense_words(spark, letters):
    rng = random.Random(len(letters))
    words = {"".join(rng.choices(letters, k=rng.randrange(1, 7))) for _ in range(250)} | {"a" * n for n in range(1, 30)}
    pairs = [(r.word, r.other) for r in spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()]
    near = near_by_hand(words)
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(w, y) for w in words for y in near[w]}


def test_spelling_of_odd_tables(spark):
    docs = odd(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(spelling.variants(docs, 5, 1)) == variants_by_hand(rows, 5, 1)
    assert found(spelling.variants(docs)) == variants_by_hand(rows)
    assert spelling.variants(docs.limit(0)).count() == 0


def test_all_words_at_one_hub(spark):
    """Hundreds of words near one frequent word, none of them a group that a task holds."""
    hub = "middleword"
    rows = [(None, f"{hub} " * 600)] + [(None, f"{hub[:i]}{c}{hub[i + d :]} " * 5) for i in range(len(hub)) for c in "abcdefghijklmnopqrstuvwxyz" for d in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(spelling.variants(docs)) == variants_by_hand(rows)


# Sources ------------------------------------------------------------------------------


def audit_by_hand(rows, least=10, top=10):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = [t.translate(LOW) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        groups[(lang or "", source or "")].update(terms)
        docs[lang or ""].update(set(terms))
    out = set()
    for lang in docs:
        kept = [t for t, d in docs[lang].items() if d >= least]
        own = {s: {t: c[t] for t in kept} for (at, s), c in groups.items() if at == lang}
        share = lambda n: {t: 1 + (10**9 * (c + 2)) // (sum(n.values()) + 2 * len(kept)) for t, c in n.items()}
        whole = share({t: sum(n[t] for n in own.values()) for t in kept})
        shares = {s: share(n) for s, n in own.items()}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s, p in shares.items():
            pairs = sorted((-sum(f(p[t], q[t]) for t in kept), o) for o, q in shares.items() if o != s)
            terms = sorted((-f(p[t], whole[t]), t.encode(), t) for t in kept if own[s][t] > 0 and p[t] > whole[t])
            out |= {(lang, s, "pair", o, -v, k) for k, (v, o) in enumerate(pairs, 1)}
            out |= {(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(terms[:top], 1)}
    return out


def test_op12_against_a_plain_account(spark, sf_dir):
    rows = [(r.text, r.lang, r.source) for r in table(spark, sf_dir).collect()]
    got = list(map(tuple, queries.op12_divergence_cube(spark, sf_dir).collect()))
    assert len(got) == len(set(got)) and set(got) == audit_by_hand(rows)


@pytest.mark.parametrize("blocks", [(1, 1), (2, 3), (32, 2048)])
def test_cells_of_any_size(spark, blocks):
    """Small cells cut sources and terms; one source has a third of all rows and one no terms."""
    rng = random.Random(3)
    rows = [(" ".join(rng.choices(["Alpha", "béta", "gamma", "delta", "épsilon", "ζήτα", "x-y", "7"], k=rng.randrange(12))), rng.choice(["en", None, "de"]), "hot" if rng.random() < 0.4 else f"s{rng.randrange(7)}") for _ in range(150)]
    rows += [("1 2 3", "en", "empty"), (None, "en", None), ("alone", "xx", "one"), ("alone", "xx", "two")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    got = list(map(tuple, divergence.audit(docs, 3, 2, *blocks).collect()))
    assert len(got) == len(set(got)) and set(got) == audit_by_hand(rows, 3, 2)


def test_audit_of_odd_tables(spark):
    docs = odd(spark)
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    for least in (1, 2, 10):
        assert set(map(tuple, divergence.audit(docs, least).collect())) == audit_by_hand(rows, least)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = "Ab é-" * 50
    whole = [t for part in divergence.term_lists(text) for t in part]
    monkeypatch.setattr(divergence, "PIECE", 7)
    assert [t for part in divergence.term_lists(text) for t in part] == whole == ["ab".encode(), "é".encode()] * 50


# Scores -------------------------------------------------------------------------------


def tokens_of(text):
    return [w.translate(LOW) for w in re.findall("[^\x20\x09-\x0d]+", text or "")]


def scores_by_hand(rows, depth=5):
    """Every node of every tree in a dictionary, weights by recursion, bits one after another."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    read = lambda text: "".join(w + " " for w in tokens_of(text)).encode() + b"\n"
    count, children, n = defaultdict(lambda: [0, 0]), defaultdict(set), Counter()

    def bits(data):
        padded = b"\n" * depth + data
        for k, byte in enumerate(data):
            for b in range(8):
                yield padded[k : k + depth], (1 << b) | (byte >> (8 - b)), (byte >> (7 - b)) & 1

    for i, text in rows:
        if not held(i):
            n.update([*tokens_of(text), "\n"])
            for context, place, bit in bits(read(text)):
                for d in range(depth + 1):
                    count[(context[depth - d :], place)][bit] += 1
                    if d < depth:
                        children[(context[depth - d :], place)].add((context[depth - d - 1 :], place))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weight = {}
    for node in sorted(count, key=lambda x: -len(x[0])):
        own = kt(*count[node])
        if len(node[0]) < depth:
            below = sum(weight[c] for c in children[node])
            high = max(own, below)
            weight[node] = high + math.log(math.exp(own - high) + math.exp(below - high)) - math.log(2)
        else:
            weight[node] = own

    def chance(context, place, bit, d=0):
        node = (context[depth - d :], place)
        if node not in count:
            return 0.5
        a, b = count[node]
        estimate = ((b if bit else a) + 0.5) / (a + b + 1)
        if d == depth:
            return estimate
        stop = math.exp(kt(a, b) - math.log(2) - weight[node])
        return stop * estimate + (1 - stop) * chance(context, place, bit, d + 1)

    total, distinct, out = sum(n.values()), len(n), []
    for i, text in rows:
        words = [*tokens_of(text), "\n"]
        base = sum(math.log10((n[w] + 1) / (total + distinct + 1)) for w in words)
        out.append((i, held(i), len(words), sum(n[w] > 0 for w in words), total, base, sum(math.log10(chance(*x)) for x in bits(read(text)))))
    return out


def same_scores(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[6], 4))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], abs=1e-6) and g[6] == pytest.approx(w[6], abs=1e-5)


def test_op13_against_trees_in_dictionaries(spark, sf_dir):
    """A part of the smallest table, whose trees fit a dictionary."""
    docs = table(spark, sf_dir).orderBy("doc_id").limit(30)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    same_scores(context_tree.scores(docs).collect(), scores_by_hand(rows))


def test_scores_of_odd_tables(spark):
    docs = odd(spark).where("doc_id is null or doc_id <> 5")
    same_scores(context_tree.scores(docs).collect(), scores_by_hand([(r.doc_id, r.text) for r in docs.collect()]))
    assert context_tree.scores(docs.limit(0)).count() == 0
    untaught = spark.createDataFrame([(i, "some Words") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    rows = context_tree.scores(untaught).collect()
    assert rows and all((r.train_tokens, r.n_known, r.base_score) == (0, 0, 0.0) and r.score == pytest.approx(-8 * 12 * math.log10(2)) for r in rows)


def test_pieces_and_bundles_of_any_size(spark, monkeypatch):
    """Texts cut between any two words and bundles of a few pieces give the same sums."""
    text = "words of ångström length " * 9 + "z" * 40
    whole = b"".join(p[context_tree.DEPTH :] for p in context_tree.spelled(text))
    monkeypatch.setattr(context_tree, "PIECE", 16)
    parts = list(context_tree.spelled(text))
    assert len(parts) > 8 and b"".join(p[context_tree.DEPTH :] for p in parts) == whole
    before = b"\n" * context_tree.DEPTH
    for p in parts:
        assert p[: context_tree.DEPTH] == before[-context_tree.DEPTH :]
        before += p[context_tree.DEPTH :]
    assert [t for p in parts for t in context_tree.tokens(p)] == [*text.encode().split(), b"\n"]
    docs = spark.createDataFrame([(i, " ".join(f"{w}{i % 5}" for w in ("some", "words", "é")) + " tail" * (i % 11)) for i in range(60)], "doc_id long, text string")
    monkeypatch.setattr(context_tree, "BUNDLE", 200)
    same_scores(context_tree.scores(docs.repartition(3)).collect(), scores_by_hand([(r.doc_id, r.text) for r in docs.collect()]))


def test_the_model_beats_its_base_on_held_out_texts(spark, sf_dir):
    rows = [r for r in queries.op13_context_tree(spark, sf_dir.replace("0.001", "0.1")).where("held_out").collect()]
    base, score = sum(r.base_score for r in rows), sum(r.score for r in rows)
    print(f"held-out log10 probability: unigram {base:.0f}, context tree {score:.0f}")
    assert score > base


def test_oracle_of_op12_reads_odd_texts(spark):
    docs = odd(spark)
    con = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    con.sql("CREATE TABLE documents AS SELECT text, lang, source FROM documents")
    assert set(con.sql(divergence.oracle_sql()).fetchall()) == set(map(tuple, divergence.audit(docs).select("lang", "source", "part", "item", "value", "rank").collect()))
