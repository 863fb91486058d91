"""Source divergence audit by three-dimensional cube partitioning.

Method: within a language the sources are dealt into group blocks and the kept terms into
term blocks.  A cell (group block, group block, term block) is a task's work: it gets the two
slices of proportions, fills in the proportion of terms that a source lacks, and sums the
divergence of every pair of sources over its terms.  A slice is copied once for each group
block it meets; the partial sums of a pair are then added along the term axis.  Divergence is
symmetric, so only cells with ordered group blocks are made and pairs are mirrored at the end.
A cell holds about 2 x 32 sources and 2,048 terms whatever the size of a source or language.

All arithmetic is in integers; proportions are formed in decimals, so that counts may grow.

Cases: null text, lang and source count as ''; a source without terms, or a language in which no
term is frequent enough, still has its pairs; a language with one source has none; repeated rows
are documents of their own; ties go to the smaller item; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtally.llm.common import slices, store

LEAST_DOCS, SCALE, ADDED, TOP = 10, 10**9, 2, 10
GROUP_BLOCK, TERM_BLOCK = 32, 2048
HELD, PIECE = 200_000, 1 << 20
# Bytes of UTF-8 that belong to a term: letters of ASCII, lower-cased, and all of longer characters.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_lists(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in order, a megabyte of it at a time."""
    data = text.encode().translate(TERM_BYTES)
    start = 0
    while start < len(data):
        end = start + PIECE
        end = len(data) if end >= len(data) or (cut := data.find(b" ", end)) < 0 else cut
        yield data[start:end].split()
        start = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences, and documents with the term, per group."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in held.items():
                for s in range(0, len(n), HELD):
                    terms = list(n)[s : s + HELD]
                    size = len(terms)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * size), pa.array([source] * size), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([n[t] for t in terms]), pa.array([d[t] for t in terms])], ["lang", "source", "term", "n", "d"])
            held.clear()

        for batch in batches:
            for part, texts in slices(batch, 2):
                for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts):
                    n, d = held.setdefault((lang, source), (Counter(), Counter()))
                    own: set[bytes] = set()
                    for terms in term_lists(text):
                        n.update(terms)
                        own.update(terms)
                    d.update(own)
                if sum(len(n) for n, _ in held.values()) > HELD:
                    yield from flush()
        yield from flush()

    plain = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    found = plain.mapInArrow(count, "lang string, source string, term string, n long, d long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def proportion(n: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 kept)); null where no term is kept."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10, 0)) * cast({n} + {ADDED} as decimal(20, 0))) div cast(nullif({total} + {ADDED} * {kept}, 0) as decimal(20, 0))")


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def cell_sums(table: pa.Table) -> pa.Table:
    """Sums over a cell's terms of the divergence of every pair of its sources (a < b in a cell with itself).

    A source's row with ti = -1 has its name, the number of terms of the block (v) and the
    proportion of terms it lacks; its other rows have the proportions of terms it has.
    """
    lang, ba, bb = (table[c][0].as_py() for c in ("lang", "ba", "bb"))
    gb, gi, ti, p = (table[c].to_numpy() for c in ("gb", "gi", "ti", "p"))
    names, width = np.asarray(table["name"].to_pylist(), object), int(np.max(table["v"].to_numpy()))

    def side(block: int) -> tuple[np.ndarray, np.ndarray]:
        heads, facts = np.flatnonzero((gb == block) & (ti < 0)), np.flatnonzero((gb == block) & (ti >= 0))
        # A block may hold no source.
        place = np.zeros(int(gi[heads].max(initial=-1)) + 1, np.int64)
        place[gi[heads]] = np.arange(len(heads))
        grid = np.repeat(p[heads][:, None], width, axis=1)
        grid[place[gi[facts]], ti[facts]] = p[facts]
        return names[heads], grid

    left, a = side(ba)
    right, b = (left, a) if ba == bb else side(bb)
    one, two, sums = [], [], []
    for i in range(len(left)):
        rest = slice(i + 1, None) if ba == bb else slice(None)
        one += [left[i]] * len(right[rest])
        two += right[rest].tolist()
        sums.append(divergence(a[i], b[rest]).sum(axis=1))
    values = np.concatenate(sums) if sums else np.zeros(0, np.int64)
    return pa.table([pa.array([lang] * len(one), pa.string()), pa.array(one, pa.string()), pa.array(two, pa.string()), pa.array(values, pa.int64())], ["lang", "a", "b", "value"])


def blocks_of(rows: DataFrame, item: str, size: int, block: str, place: str) -> DataFrame:
    """Deals the ``item``s of each language into blocks of about ``size`` by hash, numbered within their block."""
    many = rows.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(f"{block}s"))
    dealt = rows.join(many, "lang").withColumn(block, F.pmod(F.xxhash64(item), F.col(f"{block}s")).cast("int")).repartition("lang", block)
    return dealt.withColumn(place, (F.row_number().over(Window.partitionBy("lang", block).orderBy(item)) - 1).cast("int"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: of each source the divergence from every other source of its
    language (``pair``) and the ``top`` terms that it has more of than its language (``term``)."""
    counts = store(term_counts(docs), "term-counts")
    frequent = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("d").alias("d")).where(F.col("d") >= least_docs).drop("d")
    terms = store(blocks_of(frequent, "term", term_block, "tb", "ti"), "terms")
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    has = store(counts.drop("d").join(terms, ["lang", "term"]), "kept")
    totals = has.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    present = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    known = present.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "kept", "lang_total"])
    groups = store(blocks_of(known, "source", group_block, "gb", "gi"), "groups")

    facts = store(has.drop("tbs").join(groups, ["lang", "source"]).withColumns({"p": proportion("n", "total", "kept"), "q": proportion("lang_n", "lang_total", "kept")}), "facts")
    widths = terms.groupBy("lang", "tb").agg(F.count(F.lit(1)).cast("int").alias("v"))
    heads = groups.join(widths, "lang", "left").select("lang", "gb", "gbs", "gi", F.coalesce("tb", F.lit(0)).alias("tb"), F.lit(-1).alias("ti"), F.coalesce(proportion("0", "total", "kept"), F.lit(0)).alias("p"), F.coalesce("v", F.lit(0)).alias("v"), F.col("source").alias("name"))
    rows = facts.select("lang", "gb", "gbs", "gi", "tb", "ti", "p", F.lit(0).alias("v"), F.lit(None).cast("string").alias("name")).unionByName(heads)
    placed = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("gbs") - 1))).withColumns({"ba": F.least("gb", "o"), "bb": F.greatest("gb", "o")}).drop("gbs", "o")
    partial = placed.groupBy("lang", "ba", "bb", "tb").applyInArrow(cell_sums, "lang string, a string, b string, value long")
    sums = store(partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "pairs")

    pairs = sums.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")
    pairs = pairs.unionByName(sums.select("lang", F.col("b").alias("source"), F.lit("pair").alias("part"), F.col("a").alias("item"), "value"))
    more = facts.where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(more.withColumn("rank", rank).where(F.col("rank") <= top))


def oracle_sql() -> str:
    """The same rows in DuckDB."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    p = lambda n, total: f"1 + ({SCALE} * CAST({n} + {ADDED} AS HUGEINT)) // ({total} + {ADDED} * kept)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{upper}', '{lower}') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCS}),
l AS (SELECT lang, count(*) AS kept, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY t.lang, t.source, t.term),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, {p("coalesce(c.n, 0)", "s.total")} AS p, {p("k.n", "l.total")} AS q FROM s JOIN k ON k.lang = s.lang JOIN l ON l.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
v AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(v.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {TOP}
"""
