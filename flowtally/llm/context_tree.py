"""Language-model scores by context-tree weighting over bytes, beside an add-one unigram.

The model reads a text as its lower-cased words, each followed by a space, and an end byte; the
context of a byte is the ``DEPTH`` (5) bytes before it, end bytes before the first.  A byte is eight
binary choices, and each of the 255 places in that decision tree has a context tree of its
own.  A node of it is a shorter or longer context; it holds how often either bit followed, whose
probability is Krichevsky and Trofimov's estimate, and a node's weighted probability is half that
and half the product of its children's.  The chance of a bit is then the mixture of the estimates
of all depths on the path of its context, with the weights that the training texts leave:
at a node the path stops with its half over its weighted probability and else goes on.  Scores add
the logarithms of these chances over all bytes; the model is not changed by scoring.

Form.  Everything follows from counts of strings of six bytes.  Documents are cut into pieces
and gathered in stored, compressed bundles of about 32 MB; a bundle reports each distinct string
and word once, and each of these keeps the list of its bundles.  Strings with the same last three
context bytes (at most 2^24) make a subtree, whose two deeper levels numpy computes; the levels
above are one aggregation each.  Weights
come down the same way and give each string its score.  Every bundle gets the scores of its own
strings and the counts of its own words back and adds them up per document: nothing that grows
with the corpus goes to the driver or to every task.  Strings of held-out texts are entered
with a count of 0, which leaves all estimates as they are.

Cases: a null or empty text is its end alone; a null doc_id is not held out; very long texts are
cut between words; repeated rows count and are scored each; an empty table gives no rows; without
training texts every bit has the chance 1/2; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from flowtally.llm.common import slices, store, whole_runs

DEPTH, TOP = 5, 3
FOLDS, HELD_FOLD = 7, 2
END = b"\n"
CODEC = "zstd"
PIECE, BUNDLE, POSITIONS, ROWS = 1 << 20, 32 << 20, 1 << 20, 1 << 16


# Texts --------------------------------------------------------------------------------


def spelled(text: str) -> Iterator[bytes]:
    """The bytes that the model reads, in pieces that end between words; each begins with the DEPTH bytes before it."""
    words = text.encode().lower().split()
    whole = b" ".join([*words, END]) if words else END
    head, start = END * DEPTH, 0
    while start < len(whole):
        cut = whole.find(b" ", start + PIECE)
        end = len(whole) if cut < 0 else cut + 1
        yield head + whole[start:end]
        head, start = (head + whole[max(start, end - DEPTH) : end])[-DEPTH:], end


def tokens(piece: bytes) -> list[bytes]:
    """The words of a piece, and the end if it holds it."""
    body = piece[DEPTH:]
    return body.split() + [END] * body.endswith(END)


def strings(sizes: np.ndarray, data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each byte of a run of pieces, the number made of its context and itself, and which piece it is in; some millions at a time."""
    ends, spare = np.cumsum(sizes), 8 - (DEPTH + 1)
    # Eight bytes from every position as one number, of which the first DEPTH + 1 are kept.
    words = np.ndarray((len(data) - DEPTH,), ">u8", data + bytes(spare), 0, (1,))
    for s in range(DEPTH, len(data), POSITIONS):
        at = np.arange(s, min(len(data), s + POSITIONS))
        piece = np.searchsorted(ends, at, "right")
        whole = at - (ends - sizes)[piece] >= DEPTH
        out = (words[s - DEPTH : s - DEPTH + len(at)].astype(np.uint64) >> np.uint64(8 * spare)).astype(np.int64)
        yield out[whole], piece[whole]


def pieces(docs: DataFrame) -> DataFrame:
    """Stored runs of pieces, a megabyte or one piece at least: bundle, and per piece rid, doc_id, train and its size in the compressed data."""
    kind, arrow = docs.schema["doc_id"].dataType.simpleString(), to_arrow_type(docs.schema["doc_id"].dataType)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number, size = TaskContext.get().partitionId() << 32, 0, 0
        held: list[tuple] = []

        def run() -> pa.RecordBatch:
            rids, ids, train, data = zip(*held)
            columns = [([first + number], pa.int64()), ([rids], pa.list_(pa.int64())), ([ids], pa.list_(arrow)), ([train], pa.list_(pa.bool_())), ([[len(x) for x in data]], pa.list_(pa.int64())), ([pa.compress(b"".join(data), CODEC, asbytes=True)], pa.binary())]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], ["bundle", "rids", "ids", "train", "sizes", "data"])

        for batch in batches:
            for part, texts in slices(batch, 3):
                for *about, text in zip(*(part.column(i).to_pylist() for i in range(3)), texts):
                    for piece in spelled(text):
                        held.append((*about, piece))
                        size += len(piece)
                        if size // PIECE > (size - len(piece)) // PIECE:
                            yield run()
                            if size >= BUNDLE:
                                number, size = number + 1, 0
        if held:
            yield run()

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_FOLD, F.lit(False))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", (~held_out).alias("train"), "text")
    return store(rows.mapInArrow(cut, f"bundle long, rids array<long>, ids array<{kind}>, train array<boolean>, sizes array<long>, data binary"), "pieces")


def unpacked(sizes: list[int], data: bytes) -> tuple[np.ndarray, bytes, list[bytes]]:
    """The sizes, the bytes and the pieces of a run."""
    whole, ends = pa.decompress(data, sum(sizes), CODEC, asbytes=True), np.cumsum(sizes).tolist()
    return np.asarray(sizes), whole, [whole[e - n : e] for e, n in zip(ends, sizes)]


class Tally:
    """Distinct strings with their number of occurrences."""

    def __init__(self) -> None:
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        self.held.append(keys)
        self.size += len(keys)
        if self.size >= POSITIONS:
            self.settle()

    def settle(self) -> None:
        new, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *self.held]), return_counts=True)
        keys, place = np.unique(np.concatenate([self.keys, new]), return_inverse=True)
        self.counts = np.bincount(place, np.concatenate([self.counts, counts]), len(keys)).astype(np.int64)
        self.keys, self.held, self.size = keys, [], 0


class Lookup:
    """Values of distinct numbers in open addressing: most are met at once, where a sorted search takes twenty steps."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
        at, left = self.home(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]
            won = self.keys[at] == keys[left]
            self.values[at[won]] = values[left[won]]
            left, at = left[~won], (at[~won] + 1) & self.mask

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The values of ``keys``, all of which must be there."""
        at = self.home(keys)
        missed = np.flatnonzero(self.keys[at] != keys)
        while len(missed):
            at[missed] = (at[missed] + 1) & self.mask
            missed = missed[self.keys[at[missed]] != keys[missed]]
        return self.values[at]


def found(parts: DataFrame) -> DataFrame:
    """(string or word, n, bundles), stored: how often each occurs in training texts, and the bundles that hold it."""
    names = ["bundle", "string", "word", "n"]

    def report(bundle: int, train: Tally, other: Tally, words: Counter, others: set[bytes]) -> Iterator[pa.RecordBatch]:
        train.settle()
        other.settle()
        extra = np.setdiff1d(other.keys, train.keys, assume_unique=True)
        keys, counts = np.concatenate([train.keys, extra]), np.concatenate([train.counts, np.zeros(len(extra), np.int64)])
        for s in range(0, len(keys), ROWS):
            n = len(keys[s : s + ROWS])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, bundle)), pa.array(keys[s : s + ROWS]), pa.nulls(n, pa.binary()), pa.array(counts[s : s + ROWS])], names)
        all_words = [*words, *(others - words.keys())]
        for s in range(0, len(all_words), ROWS):
            some = all_words[s : s + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), bundle)), pa.nulls(len(some), pa.int64()), pa.array(some, pa.binary()), pa.array([words[w] for w in some], pa.int64())], names)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            for bundle, trains, sizes, data in zip(*(c.to_pylist() for c in batch.columns)):
                if bundle != now:
                    if state:
                        yield from report(now, *state)
                    now, state = bundle, (Tally(), Tally(), Counter(), set())
                sizes, whole, parts_ = unpacked(sizes, data)
                learnt = np.asarray(trains)
                for keys, piece in strings(sizes, whole):
                    state[0].add(keys[learnt[piece]])
                    state[1].add(keys[~learnt[piece]])
                for train, part in zip(trains, parts_):
                    state[2 if train else 3].update(tokens(part))
        if state:
            yield from report(now, *state)

    rows = parts.select("bundle", "train", "sizes", "data").mapInArrow(gather, "bundle long, string long, word binary, n long")
    return store(rows.groupBy("string", "word").agg(F.sum("n").alias("n"), F.collect_list("bundle").alias("bundles")), "found")


# The tree -----------------------------------------------------------------------------


def log_gamma(x: Any, log: Callable) -> Any:
    """ln Gamma(x) for x > 0 by Stirling's series at x + 8, on arrays or columns."""
    z, below = x + 8.0, x
    for i in range(1, 8):
        below = below * (x + float(i))
    series = (1.0 / 12 - (1.0 / 360 - (1.0 / 1260 - 1.0 / 1680 / (z * z)) / (z * z)) / (z * z)) / z
    return (z - 0.5) * log(z) - z + 0.5 * math.log(2 * math.pi) + series - log(below)


def log_kt(a: Any, b: Any, log: Callable) -> Any:
    """ln of the estimate's probability of a zeros and b ones in any order."""
    return log_gamma(a + 0.5, log) + log_gamma(b + 0.5, log) - log_gamma(a + b + 1.0, log) - math.log(math.pi)


class Subtrees:
    """The levels below ``TOP`` for one bit of the strings, deepest first."""

    def __init__(self, string: np.ndarray, n: np.ndarray, k: int) -> None:
        context, byte = string >> 8, string & 255
        self.bit = (byte >> (7 - k)) & 1
        place = (1 << k) | (byte >> (8 - k))
        self.levels: list[dict[str, np.ndarray]] = []
        for depth in range(DEPTH, TOP, -1):
            keys, row, at = np.unique(((context & ((1 << 8 * depth) - 1)) << 8) | place, return_index=True, return_inverse=True)
            a, b = (np.bincount(at, np.where(self.bit == v, n, 0), len(keys)) for v in (0, 1))
            kt = log_kt(a, b, np.log)
            if self.levels:
                below = self.carried(at)
                weighted = np.logaddexp(kt, below) - math.log(2)
            else:
                below, weighted = np.full(len(keys), -np.inf), kt
            self.levels.append({"row": row, "at": at, "a": a, "b": b, "kt": kt, "below": below, "weighted": weighted})
        self.keys, row, self.at = np.unique(((context & ((1 << 8 * TOP) - 1)) << 8) | place, return_index=True, return_inverse=True)
        self.a, self.b = (np.bincount(self.at, np.where(self.bit == v, n, 0), len(self.keys)) for v in (0, 1))
        self.below = self.carried(self.at)

    def carried(self, at: np.ndarray) -> np.ndarray:
        """Sums of the last level's weighted probabilities over the children of the nodes ``at`` which the strings lie."""
        last = self.levels[-1]
        return np.bincount(at[last["row"]], last["weighted"], int(at.max()) + 1)

    def chances(self, zero: np.ndarray, one: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """The chance of each string's bit; the arguments are what the levels down to ``TOP`` leave, per node there."""
        before = self.at
        for level in reversed(self.levels):
            up, total = before[level["row"]], level["a"] + level["b"] + 1
            last = level is self.levels[0]
            stop = np.ones(len(total)) if last else np.exp(level["kt"] - math.log(2) - level["weighted"])
            share = rest[up] * stop
            zero, one = zero[up] + share * (level["a"] + 0.5) / total, one[up] + share * (level["b"] + 0.5) / total
            rest = np.zeros(len(total)) if last else rest[up] * np.exp(level["below"] - math.log(2) - level["weighted"])
            before = level["at"]
        return np.where(self.bit == 1, one[before], zero[before])


def crowns(counts: DataFrame) -> DataFrame:
    """(node, a, b, below) at depth ``TOP``; a node is its context and its place among the eight choices, in one number."""

    def rise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ("top",), ROWS):
            string, n = (table[c].to_numpy() for c in ("string", "n"))
            for k in range(8):
                tree = Subtrees(string, n, k)
                yield pa.RecordBatch.from_arrays([pa.array(tree.keys), pa.array(tree.a), pa.array(tree.b), pa.array(tree.below)], ["node", "a", "b", "below"])

    return dealt(counts).mapInArrow(rise, "node long, a double, b double, below double")


def dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("top").sortWithinPartitions("top")


def weighed(level: DataFrame) -> DataFrame:
    """A level (node, a, b, below) with the logarithms of its estimate and its weighted probability."""
    kt = log_kt(F.col("a"), F.col("b"), F.log)
    high, low = F.greatest("kt", "below"), F.least("kt", "below")
    return level.withColumn("kt", kt).withColumn("weighted", high + F.log1p(F.exp(low - high)) - math.log(2))


def parent(depth: int) -> Column:
    """The node one byte of context up, from a node at ``depth``."""
    return F.col("node").bitwiseAND((1 << 8 * depth) - 1)


def top_chances(counts: DataFrame) -> DataFrame:
    """(node, zero, one, rest) at depth ``TOP``: what the levels down to there give either bit, and the weight left for deeper ones."""
    levels = [store(weighed(crowns(counts)), "level")]
    for depth in range(TOP, 0, -1):
        up = levels[-1].groupBy(parent(depth).alias("node")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("weighted").alias("below"))
        levels.append(store(weighed(up), "level"))
    stop, on = F.exp(F.col("kt") - math.log(2) - F.col("weighted")), F.exp(F.col("below") - math.log(2) - F.col("weighted"))
    share, total = F.col("rest") * stop, F.col("a") + F.col("b") + 1
    way = None
    for depth, level in enumerate(reversed(levels)):
        if way is None:
            rows = level.withColumns({"zero": F.lit(0.0), "one": F.lit(0.0), "rest": F.lit(1.0)})
        else:
            rows = level.withColumn("up", parent(depth)).join(way.withColumnRenamed("node", "up"), "up")
        way = store(rows.select("node", (F.col("zero") + share * (F.col("a") + 0.5) / total).alias("zero"), (F.col("one") + share * (F.col("b") + 0.5) / total).alias("one"), (F.col("rest") * on).alias("rest")), "way")
    return way


def string_scores(counts: DataFrame) -> DataFrame:
    """(string, value): the base-10 logarithm of the chance of a string's last byte after the others; ``counts`` has top, string, n."""

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ("top",), ROWS):
            string, node = table["string"], table["node"]
            leaves, nodes = table.filter(string.is_valid()), table.filter(node.is_valid())
            keys = nodes["node"].to_numpy()
            order = np.argsort(keys)
            zero, one, rest = (nodes[c].to_numpy()[order] for c in ("zero", "one", "rest"))
            string, n, keys = leaves["string"].to_numpy(), leaves["n"].to_numpy(), keys[order]
            value = np.zeros(len(string))
            for k in range(8):
                tree = Subtrees(string, n, k)
                at = np.searchsorted(keys, tree.keys)
                value += np.log10(tree.chances(zero[at], one[at], rest[at]))
            yield pa.RecordBatch.from_arrays([pa.array(string), pa.array(value)], ["string", "value"])

    ways = top_chances(counts).withColumn("top", F.shiftright("node", 8))
    rows = counts.select("top", "string", "n").unionByName(ways, allowMissingColumns=True)
    return dealt(rows).mapInArrow(descend, "string long, value double")


# Scores -------------------------------------------------------------------------------


def piece_scores(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums over the pieces of one bundle; ``right`` has the bundle's strings with their scores and its words with their counts."""
    known = right["string"].is_valid()
    scores_of = Lookup(right["string"].filter(known).to_numpy(), right["value"].filter(known).to_numpy())
    known = right["word"].is_valid()
    words, counts = right["word"].filter(known).combine_chunks(), right["value"].filter(known).to_numpy()
    total = sum(len(x) for x in left["sizes"])
    n_tokens, n_known, base, score = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total), np.zeros(total)
    first, held, owners = 0, [], []

    def settle() -> None:
        seen = counts[pc.index_in(pa.array(held, pa.binary()), words).to_numpy()]
        owner = np.repeat(*map(np.asarray, zip(*owners)))
        n_tokens[:] += np.bincount(owner, minlength=total)
        n_known[:] += np.bincount(owner[seen > 0], minlength=total)
        base[:] += np.bincount(owner, np.log10(seen + 1), total)
        held.clear()
        owners.clear()

    for sizes, data in zip(left["sizes"], left["data"]):
        sizes, whole, parts = unpacked(sizes.as_py(), data.as_py())
        for found_, piece in strings(sizes, whole):
            score += np.bincount(piece + first, scores_of(found_), total)
        for i, part in enumerate(parts):
            own = tokens(part)
            held += own
            owners.append((first + i, len(own)))
        first += len(sizes)
        if len(held) > POSITIONS // 4:
            settle()
    if held:
        settle()
    about = [pa.chunked_array([c.flatten() for c in left[name].chunks]) for name in ("rids", "ids")]
    return pa.table([*about, *map(pa.array, (n_tokens, n_known, base, score))], ["rid", "doc_id", "n_tokens", "n_known", "base", "score"])


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    parts = pieces(docs)
    held = found(parts)
    words = held.where("word is not null")
    counts = held.where("string is not null").select("string", "n", F.shiftright("string", 8).bitwiseAND((1 << 8 * TOP) - 1).alias("top"))
    scored = held.where("string is not null").join(string_scores(counts), "string").select("string", "bundles", "value", F.lit(None).cast("binary").alias("word"))
    values = scored.unionByName(words.select(F.lit(None).cast("long").alias("string"), "bundles", F.col("n").cast("double").alias("value"), "word"))
    values = values.select(F.explode("bundles").alias("bundle"), "string", "word", "value")
    kind = docs.schema["doc_id"].dataType.simpleString()
    sums = parts.groupBy("bundle").cogroup(values.groupBy("bundle")).applyInArrow(piece_scores, f"rid long, doc_id {kind}, n_tokens long, n_known long, base double, score double")
    each = sums.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("train_tokens"), F.count(F.when(F.col("n") > 0, 1)).alias("distinct"))
    unseen = F.log10(F.col("train_tokens") + F.col("distinct") + 1)
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_FOLD, F.lit(False))
    return each.join(F.broadcast(total)).select("doc_id", fold.alias("held_out"), "n_tokens", "n_known", "train_tokens", (F.col("base") - F.col("n_tokens") * unseen).alias("base_score"), "score")
