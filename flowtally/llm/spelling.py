"""Spelling variants: near words by a relational trie frontier, and the form that each variant stands for.

Method: the words make a trie that is stored as a table of edges (node, first letter, label, child);
chains without a branch are one edge.  States (word, position, node, edits) go down it level by
level through joins with the edges of that level.  A state without an edit stays on its own word's
path; at a node where it branches off it spends its one edit: the edge has another letter
(replaced) or what follows the word's next letter (the word has one too many).  A word with one too
few is the same pair seen from the other side, and of two words with a replaced letter the smaller
finds the larger, so every pair is found once and then mirrored.  States with an edit follow
equal labels only; those that end together with a word are its neighbours.

Near the root a trie is dense and nearly every branch survives.  Every word is therefore also
entered backwards, below a root edge of its own, and may spend its edit in its second half only,
read either way: an edit lies in the second half of one of the two.  A pair whose first halves
agree is left to the forward reading.

The number of levels is the largest number of branching nodes on a path: words that are
beginnings of one another each add one, long words alone do not.

Cases: null and empty texts have no words; a null doc_id never deletes a letter; repeated rows
count each; words of any length are whole; ties of n go to the smallest word in code-point order; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from flowtally.llm.common import discard, store

RUN = "[a-zÀ-ÿ]+"
LENGTH, COUNT, RATIO, EVERY = 6, 5, 5, 199
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, length: int = LENGTH, count: int = COUNT, every: int = EVERY) -> DataFrame:
    """(word, n) of all words of at least ``length`` letters that occur at least ``count`` times.

    Where ``every`` divides the checksum of ``<doc_id>:<run>``, a letter of the run is deleted.
    """
    runs = docs.select(F.col("doc_id").cast("string").alias("id"), F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run")).where(F.length("run") >= length)
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    thinned = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % every == 0, thinned).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= count)


def common_letters(a: Column, b: Column) -> Column:
    """Length of the longest common beginning of two different words."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.array_position(same, F.lit(False)).cast("int") - 1


def letters(word: str, start: Column | int, n: Column | int | None = None) -> Column:
    """``n`` letters of a column from ``start`` (0: the first); without ``n`` all that follow."""
    at = (F.lit(start) if isinstance(start, int) else start) + 1
    return F.substr(F.col(word), at) if n is None else F.substr(F.col(word), at, F.lit(n) if isinstance(n, int) else n)


def edges_below(exact: DataFrame) -> DataFrame:
    """The edges out of the nodes where unedited states (s, pos, node) stand.

    The words below a node that go on with the same letter share the beginning that the
    smallest and the largest of them share; a lone word's edge is a leaf and holds all the rest.
    """
    groups = exact.groupBy("node", letters("s", F.col("pos"), 1).alias("letter")).agg(F.min("s").alias("low"), F.max("s").alias("high"), F.min("pos").alias("depth"))
    leaf = F.col("low") == F.col("high")
    shared = F.when(leaf, F.length("low")).otherwise(common_letters(F.col("low"), F.col("high")))
    return groups.select("node", "letter", leaf.alias("leaf"), letters("low", F.col("depth"), shared - F.col("depth")).alias("label"), letters("low", 0, shared).alias("child"))


def step(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """The states one edge further down: (s, pos, node, edits, leaf)."""
    pos, size = F.col("pos"), F.length("label")
    ahead = lambda start, n=size: F.when(F.col("leaf"), letters("s", start)).otherwise(letters("s", start, n))
    on = frontier.withColumn("letter", letters("s", pos, 1))
    follow = on.join(edges, ["node", "letter"]).where(F.col("label") == ahead(pos)).select("s", (pos + size).alias("pos"), F.col("child").alias("node"), "edits", "leaf")
    # An edit may be spent in the second half; position 0 is the mark of the direction.
    free = on.where((F.col("edits") == 0) & (pos > F.floor((F.length("s") - 1) / 2)) & (F.col("letter") != "")).withColumnRenamed("letter", "own")
    met = free.join(edges, "node").where(F.col("letter") != F.col("own"))
    replaced = (F.col("letter") > F.col("own")) & (letters("label", 1) == ahead(pos + 1, size - 1))
    surplus = F.col("label") == ahead(pos + 1)
    moves = F.array(F.when(replaced, pos + size), F.when(surplus, pos + 1 + size))
    spent = met.select("s", F.explode(F.array_compact(moves)).alias("pos"), F.col("child").alias("node"), F.lit(1).alias("edits"), "leaf")
    return follow.unionByName(spent)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, other) for all pairs of distinct words that differ by exactly one letter, in both orders."""
    spelled = words.select(F.explode(F.array(F.concat(F.lit(">"), "word"), F.concat(F.lit("<"), F.reverse("word")))).alias("s"))
    frontier, ends = spelled.select("s", F.lit(0).alias("pos"), F.lit("").alias("node"), F.lit(0).alias("edits")), []
    while True:
        edges = store(edges_below(frontier.where("edits = 0")), "edges")
        states = store(step(frontier, edges), "frontier")
        discard(edges)
        ends.append(states.where("leaf and edits = 1").select("s", F.col("node").alias("t")))
        frontier = states.where("not leaf").drop("leaf")
        if frontier.isEmpty():
            break
    found = reduce(DataFrame.unionByName, ends)
    forward = F.col("s").startswith(">")
    plain = lambda c: F.when(forward, letters(c, 1)).otherwise(F.reverse(letters(c, 1)))
    half = F.floor(F.length("word") / 2).cast("int")
    pairs = found.select(forward.alias("forward"), plain("s").alias("word"), plain("t").alias("other")).where(F.col("forward") | (letters("word", 0, half) != letters("other", 0, half)))
    return pairs.select("word", "other").unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every row of ``forms`` (word, form): where the forms of forms end.  Paths double each round."""
    held = ways = store(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        grown = store(ways.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        discard(held)
        held, ways = grown, grown.select("word", "root")
        if grown.where("_moved").isEmpty():
            return ways


def variants(docs: DataFrame, length: int = LENGTH, count: int = COUNT, ratio: int = RATIO, every: int = EVERY) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    The form is the near word of largest n, if that is at least ``ratio`` times the word's own.
    """
    words = store(word_counts(docs, length, count, every), "words")
    pairs = near_pairs(words).join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w"))).alias("best"))
    stands = -F.col("best.m") >= ratio * F.col("n")
    rows = store(words.join(best, "word", "left").select("word", F.when(stands, F.col("best.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(stands, -F.col("best.m")).alias("form_n")), "variants")
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
