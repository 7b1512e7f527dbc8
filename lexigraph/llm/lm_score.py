"""Document scores by masked pseudo-likelihood.

A small bidirectional window network, trained in numpy, predicts every word of a text from the words on both sides of
it; a document's score is the sum of the conditional log-probabilities of its words. The output is a binary tree with
a leaf for each frequent word and one for each of LEAVES groups of all other words (by their last letters), built from
their counts, so that a word's probability is the product of the decisions on its way. A word of a group has its share
of the group's occurrences besides: p(word | sides) = p(group | sides) * n(word) / n(group).

The words and all counts come from the whole corpus: tasks hold the frequent words by name, more of them the larger the
corpus; the counts of all others are a table that is joined to the texts' words. Texts are turned into ids once,
which are stored for training and scoring. The network is trained on all
documents: each task makes its pass over its own texts from the same start, which gives the words their own frequencies,
and each row of weights is averaged by the number of times that the tasks used it. The result depends on how the rows
are dealt to tasks: the same files, read in the same splits, give the same scores.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.llm.common import checkpointed, stored, table

#: Words held by name: so many at least, and KNOWN_RATE times the fourth root of the corpus's words.
KNOWN, KNOWN_RATE = 40_000, 400
#: Groups of the words that aren't held by name.
LEAVES = 1024
#: Places to the left and to the right, and sizes of the embedding and hidden layers.
SIDES, EMBED, HIDDEN = 2, 8, 16
#: Decisions nearest to the tree's root, on most words' ways, that are computed at once for all words that share them.
TOP = 128
#: Words whose count a task holds before it sends them on.
CACHE = 300_000
CHUNK = 4096
#: Blocks in which a task's weights are sent.
BLOCKS = 64


@dataclass
class Vocabulary:
    """Ids 0 to len(ids) - 1 are the words held by name, the LEAVES ids after them the groups of the others."""

    ids: dict[str, int]
    log_mass: np.ndarray  # of each group, the logarithm of its occurrences
    near_root: tuple[np.ndarray, np.ndarray, np.ndarray]  # the ways as far as decisions below TOP, see tree_ways
    low: tuple[np.ndarray, np.ndarray, np.ndarray]  # the rest of the ways
    lean: np.ndarray  # by decision, the logarithm of the quotient of the occurrences on its two sides
    tail: DataFrame | None = None  # (word, n) of the words not held by name that occur more than once

    @property
    def size(self) -> int:
        return len(self.low[0]) - 1


def words_in(text: str | None) -> list[str]:
    return text.lower().split() if isinstance(text, str) else []


def group_of(word: str) -> int:
    return zlib.crc32(word[-2:].encode()) % LEAVES


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over whole texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                held.update(words_in(text))
                if len(held) > CACHE:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held = Counter()
        if held:
            yield pd.DataFrame({"word": list(held), "n": list(held.values())})

    return docs.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def tree_ways(counts: list[int]) -> list:
    """near_root, low and lean of a vocabulary: the ways to the leaves of the binary tree that joins the two rarest parts again and again, as far as decisions below
    TOP and the rest, each as (first, nodes, turns): the decisions nodes[first[i] : first[i + 1]] are on the way to leaf i
    and turns, 1 or -1, says where they lead. The root is decision 0, the part joined first the last one."""
    heap = [(n, i) for i, n in enumerate(counts)]
    heapq.heapify(heap)
    size = len(counts)
    parent, turn, lean = np.zeros(2 * size - 1, dtype=np.int64), np.zeros(2 * size - 1, dtype=np.int8), np.zeros(size - 1)
    for new in range(size, 2 * size - 1):
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[[a[1], b[1]]], turn[[a[1], b[1]]] = new, (1, -1)
        lean[2 * size - 2 - new] = math.log(a[0] / b[0])
        heapq.heappush(heap, (a[0] + b[0], new))
    at, steps = np.arange(size), []
    while (up := at < 2 * size - 2).any():  # all leaves go up to the root together
        steps.append((np.where(up, 2 * size - 2 - parent[at], -1), turn[at]))
        at = np.where(up, parent[at], at)
    nodes, turns = np.stack([x for x, _ in steps], axis=1), np.stack([x for _, x in steps], axis=1)
    parts = []
    for on in ((nodes >= 0) & (nodes < TOP), nodes >= TOP):
        parts.append((np.concatenate([[0], np.cumsum(on.sum(axis=1))]), nodes[on].astype(np.int32), turns[on].astype(np.float32)))
    return [*parts, lean]


def fit_vocabulary(docs: DataFrame) -> Vocabulary:
    """Of the corpus counts the driver gets the frequent words and the sums of the other words' groups; the counts of all
    other words stay a table."""
    counts = checkpointed(word_counts(docs))
    # Levels of counts tell the size of the corpus, and how frequent the words held by name are at least, so that each
    # partition sends few others.
    level = F.floor(8 * F.log2("n"))
    levels = sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect(), reverse=True)
    known = max(KNOWN, round(KNOWN_RATE * sum(r["n"] for r in levels) ** 0.25))
    above, least = 0, 0
    for r in levels:
        above += r["words"]
        if above >= known:
            least = r["level"]
            break
    top = counts.where(level >= least).orderBy(F.desc("n"), "word").limit(known).collect()
    mass, tail = np.zeros(LEAVES), None
    if above > known or len(top) == known:
        edge = top[-1]
        rest = counts.where((F.col("n") < edge["n"]) | ((F.col("n") == edge["n"]) & (F.col("word") > edge["word"])))
        group = F.crc32(F.right("word", F.lit(2)).cast("binary")) % LEAVES
        for r in rest.groupBy(group.alias("group")).agg(F.sum("n").alias("n")).collect():
            mass[r["group"]] = r["n"]
        tail = rest.where("n > 1")
    mass = np.maximum(mass, 1)
    return Vocabulary({r["word"]: i for i, r in enumerate(top)}, np.log(mass), *tree_ways([r["n"] for r in top] + mass.astype(np.int64).tolist()), tail)


class Encoder(dict):
    """Ids of words; the groups of the last two letters of words that aren't held by name are kept for the next time."""

    def __init__(self, ids: dict[str, int]):
        super().__init__(ids)
        self.named, self.groups = len(ids), {}

    def __missing__(self, word: str) -> int:
        if (got := self.groups.get(word[-2:])) is None:
            if len(self.groups) > CACHE:
                self.groups.clear()
            got = self.groups[word[-2:]] = self.named + group_of(word)
        return got

    def __call__(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words))


class Network:
    """Embeddings of the words on both sides, one tanh layer, and a logistic decision at each node of the tree.

    ``rows``: weights as matrices whose rows are averaged by their use. The last embedding is the text's edge; the last
    column of the decisions is their bias."""

    def __init__(self, vocabulary: Vocabulary, rows: dict[str, np.ndarray] | None = None, seed: int = 7):
        rng, self.words = np.random.default_rng(seed), vocabulary
        shapes = {"e": (vocabulary.size + 1, EMBED, 0.3), "h": (2 * SIDES * EMBED + 1, HIDDEN, 0.15), "o": (vocabulary.size - 1, HIDDEN + 1, 0.0)}
        if rows is None:
            rows = {k: rng.normal(0, s, (n, m)) for k, (n, m, s) in shapes.items()}
            rows["o"][:, -1] = vocabulary.lean
        self.rows = {k: x.astype(np.float32) for k, x in rows.items()}
        # The leaves below the same side of a decision share their way near the root: the ways as a table, short ones filled up with turns of 0.
        first, nodes, turns = vocabulary.near_root
        length, last = np.diff(first), first[:-1]
        _, leaf, exits = np.unique(2 * nodes[last] + (turns[last] > 0), return_index=True, return_inverse=True)
        on = np.arange(length.max()) < length[leaf, None]
        at = first[leaf, None] + np.where(on, np.arange(length.max()), 0)
        self.exits, self.depth = exits.astype(np.int16), np.diff(vocabulary.low[0]).astype(np.int16)
        self.ways, self.turns = nodes[at], np.where(on, turns[at], 0).astype(np.float32)
        self.onto = np.zeros((nodes.max() + 1, self.ways.size), dtype=np.float32)
        self.onto[self.ways.ravel(), np.arange(self.ways.size)] = self.turns.ravel()
        self.passed = np.abs(self.onto).reshape(len(self.onto), *self.ways.shape).sum(axis=2, dtype=np.float64)
        self.low = (vocabulary.low[0].astype(np.int64), vocabulary.low[1].astype(np.int64), vocabulary.low[2])

    def hidden(self, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What stands around the words, and the hidden layer; both end with a column of ones."""
        one = np.ones((len(near), 1), dtype=np.float32)
        x = np.concatenate([self.rows["e"].take(near, axis=0).reshape(len(near), 2 * SIDES * EMBED), one], axis=1)
        return x, np.concatenate([np.tanh(x @ self.rows["h"]), one], axis=1)

    def near_root(self, h: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Of words in the order of their exits: turns times the decisions' weights by exit and step, turns times the decisions' sums by word and step, and the
        exits with their words (exit, begin, end)."""
        signed = self.rows["o"].take(self.ways, axis=0) * self.turns[:, :, None]
        ends = np.cumsum(np.bincount(self.exits[target], minlength=len(signed))).tolist()
        parts = [(k, begin, end) for k, (begin, end) in enumerate(zip([0, *ends], ends, strict=False)) if end > begin]
        z = np.empty((len(target), signed.shape[1]), dtype=h.dtype)
        for k, begin, end in parts:
            np.matmul(h[begin:end], signed[k].T, out=z[begin:end])
        return signed, z, parts

    def below(self, h: np.ndarray, target: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """The decisions below TOP of words in the order of ``deepest``, a step of all ways at a time: how many words still go on (the first ones), decisions,
        turns, weights, and turns times the decisions' sums."""
        first, nodes, turns = self.low
        begin, going = first.take(target), np.cumsum(np.bincount(self.depth[target])[::-1])[::-1]
        for k, n in enumerate(going[1:].tolist()):
            at = begin[:n] + k
            node, turn = nodes.take(at), turns.take(at)
            weights = self.rows["o"].take(node, axis=0)
            yield n, node, turn, weights, turn * np.einsum("ij,ij->i", h[:n], weights)

    def deepest(self, target: np.ndarray) -> np.ndarray:
        """Places of the words whose ways go on below TOP, the longest ways first."""
        order = np.argsort(-self.depth[target], kind="stable")
        return order[: np.count_nonzero(self.depth[target])]

    def log_probs(self, near: np.ndarray, target: np.ndarray) -> np.ndarray:
        order = np.argsort(self.exits[target], kind="stable")
        target = target[order]
        _, h = self.hidden(near.take(order, axis=0))
        _, z, _ = self.near_root(h, target)
        lost = (softplus(-z) * (self.turns != 0).astype(z.dtype)[self.exits[target]]).sum(axis=1, dtype=np.float64)
        deep = self.deepest(target)
        more = np.zeros(len(deep))
        for n, *_, z in self.below(h.take(deep, axis=0), target[deep]):
            more[:n] += softplus(-z)
        lost[deep] += more
        out = np.empty(len(target))
        out[order] = -lost
        return out

    def gradients(self, near: np.ndarray, target: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Slopes of the words' mean negative log-probability: by matrix the rows used, how often each is, and their slopes."""
        order = np.argsort(self.exits[target], kind="stable")
        near, target = near.take(order, axis=0), target[order]
        x, h = self.hidden(near)
        signed, z, parts = self.near_root(h, target)
        slopes, back = -1 / (1 + np.exp(z)) / len(target), np.empty_like(h)
        by_way, passing = np.zeros_like(signed), np.zeros(len(signed))
        for k, begin, end in parts:
            np.matmul(slopes[begin:end], signed[k], out=back[begin:end])
            np.matmul(slopes[begin:end].T, h[begin:end], out=by_way[k])
            passing[k] = end - begin
        used = self.passed @ passing
        rows = np.flatnonzero(used)
        deep = self.deepest(target)
        low_h = h.take(deep, axis=0)
        low_back, steps = back.take(deep, axis=0), [(np.arange(0), np.arange(0), np.zeros(0, dtype=np.float32))]
        for n, node, turn, weights, z in self.below(low_h, target[deep]):
            low = -turn / (1 + np.exp(z)) / len(target)
            low_back[:n] += low[:, None] * weights
            steps.append((np.arange(n), node, low))
        back[deep] = low_back
        who, node, low = (np.concatenate(x) for x in zip(*steps, strict=True))
        pairs = paired(low_h)
        low = low.astype(pairs.dtype)
        low_rows, low_times, low_slopes = row_sums(node, (pair.take(who) * low for pair in pairs), h.shape[1])
        back = back[:, :-1] * (1 - h[:, :-1] ** 2)
        top_slopes = self.onto @ by_way.reshape(-1, h.shape[1])
        return {
            "o": (np.concatenate([rows, low_rows]), np.concatenate([used[rows].astype(np.int64), low_times]), np.concatenate([top_slopes[rows], low_slopes])),
            "h": (np.arange(x.shape[1]), np.full(x.shape[1], len(target)), x.T @ back),
            "e": row_sums(near.ravel(), paired((back @ self.rows["h"][:-1].T).reshape(-1, EMBED)), EMBED),
        }

    def step(self, near: np.ndarray, target: np.ndarray, state: dict[str, np.ndarray], use: dict[str, np.ndarray], rate: float) -> None:
        """One step by Adagrad with a rate for each row of weights; ``use`` counts how often each row was used."""
        for k, (rows, times, slopes) in self.gradients(near, target).items():
            if k not in use:
                use[k], state[k] = np.zeros(len(self.rows[k]), dtype=np.int64), np.full(len(self.rows[k]), 1e-8, dtype=np.float32)
            use[k][rows] += times
            held = state[k]
            held[rows] = squares = held[rows] + np.einsum("ij,ij->i", slopes, slopes) / slopes.shape[1]
            self.rows[k][rows] = self.rows[k].take(rows, axis=0) - (rate / np.sqrt(squares))[:, None] * slopes


def softplus(z: np.ndarray) -> np.ndarray:
    return np.log(1 + np.exp(z))


def paired(values: np.ndarray) -> np.ndarray:
    """The columns of ``values`` as complex numbers, two in one, so that a pass over them adds both."""
    pairs = np.zeros((len(values), (values.shape[1] + 1) // 2), dtype=np.result_type(values, 1j))
    pairs.view(values.dtype)[:, : values.shape[1]] = values
    return np.ascontiguousarray(pairs.T)


def row_sums(rows: np.ndarray, pairs: Iterable[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows, how often each occurs, and the sums of their values: ``width`` columns, given as ``paired`` makes them."""
    times = np.bincount(rows)
    found = np.flatnonzero(times)
    place = np.empty(len(times), dtype=np.int64)
    place[found] = np.arange(len(found))
    group, sums = place.take(rows), []
    for pair in pairs:
        sums.append(np.zeros(len(found), dtype=pair.dtype))
        np.add.at(sums[-1], group, pair)
    both = np.stack(sums, axis=1)
    return found, times[found], both.view(both.real.dtype)[:, :width]


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``docs`` with the ids of the texts' words (__ids, 32 bits each) and their words that aren't held by name (__rest)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.ids)

    @F.pandas_udf("ids binary, rest array<string>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        to_ids, named = Encoder(shared.value), len(shared.value)
        for batch in texts:
            ids, rest = [], []
            for words in map(words_in, batch):
                got = to_ids(words)
                ids.append(got.tobytes())
                rest.append([words[k] for k in np.flatnonzero(got >= named).tolist()])
            yield pd.DataFrame({"ids": ids, "rest": rest})

    return docs.withColumn("__encoded", encode(F.col("text"))).withColumns({"__ids": F.col("__encoded.ids"), "__rest": F.col("__encoded.rest")}).drop("__encoded")


def stored_ids(docs: DataFrame, vocabulary: Vocabulary, *drop: str) -> DataFrame:
    """``docs`` as ``encoded`` gives them, with a number of each row (__row), stored once for training and scoring, without the columns ``drop``."""
    return stored(encoded(docs, vocabulary).withColumn("__row", F.monotonically_increasing_id()).drop(*drop), "lm_ids")


def windows_in(texts: Iterable[bytes], edge: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of whole texts' ids (number of the text, ids around, id), CHUNK words or a text's end at a time, in batches of about CHUNK words."""
    beyond = np.full(SIDES, edge, dtype=np.int32)
    who, pieces, size = [], [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        ids = np.concatenate([beyond, np.frombuffer(text, dtype=np.int32), beyond])
        for k in range(0, len(ids) - 2 * SIDES, CHUNK):
            who.append(i)
            pieces.append(ids[k : k + CHUNK + 2 * SIDES])
            size += len(pieces[-1]) - 2 * SIDES
            if size >= CHUNK:
                yield batch_of(who, pieces)
                who, pieces, size = [], [], 0
    if size:
        yield batch_of(who, pieces)


def batch_of(who: list[int], pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of pieces of texts and what stands around them; a piece begins and ends with SIDES ids that are only around its words."""
    ids, sizes = np.concatenate(pieces).astype(np.int64), np.array([len(x) - 2 * SIDES for x in pieces])
    at = np.arange(sizes.sum()) + np.repeat(SIDES + 2 * SIDES * np.arange(len(sizes)), sizes)
    return np.repeat(who, sizes), ids.take(at[:, None] + [k for k in range(-SIDES, SIDES + 1) if k]), ids.take(at)


def merged(parts: pd.DataFrame) -> pd.DataFrame:
    """One row for rows of one block of one matrix: the sums of the uses and of the weights times uses, by row of weights."""
    parts = parts.sort_values("task", kind="stable")
    rows = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in parts["rows"]])
    uses = np.concatenate([np.frombuffer(x, dtype=np.float64) for x in parts["uses"]])
    sums = np.concatenate([np.frombuffer(x, dtype=np.float32) for x in parts["sums"]]).reshape(len(rows), -1)
    found, _, both = row_sums(rows, paired(np.concatenate([uses[:, None], sums], axis=1)), sums.shape[1] + 1)
    return pd.DataFrame({"matrix": parts["matrix"].iloc[:1].tolist(), "block": parts["block"].iloc[:1].tolist(), "task": [int(parts["task"].min()) // 64], "rows": [found.tobytes()], "uses": [both[:, 0].tobytes()], "sums": [both[:, 1:].astype(np.float32).tobytes()]})


def fit_network(docs: DataFrame, vocabulary: Vocabulary, rounds: int = 1, rate: float = 0.1) -> Network:
    """Rounds of local training and averaging over all documents.

    A task sends the rows of weights that its texts used, in BLOCKS blocks a matrix; their sums are formed in two steps
    (over 64 tasks at a time, then over those groups), so that no task or driver sees the rows of all tasks. Without
    words the network stays as it began.
    """
    net = Network(vocabulary)
    ids = (docs if "__ids" in docs.columns else encoded(docs, vocabulary)).select("__ids")
    kind = "matrix string, block long, task long, rows binary, uses binary, sums binary"
    for k in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast((replace(vocabulary, ids={}, tail=None), net.rows))

        def train(batches: Iterator[pd.DataFrame], shared=shared, rate=rate / (k + 1)) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            words, start = shared.value
            own, state, use = Network(words, {k: v.copy() for k, v in start.items()}), {}, {}
            for _, near, target in windows_in((t for b in batches for t in b["__ids"]), words.size):
                own.step(near, target, state, use, rate)
            for matrix, times in use.items():
                used = np.flatnonzero(times)
                for block in range(BLOCKS):
                    rows = used[used % BLOCKS == block]
                    if len(rows):
                        uses = times[rows].astype(np.float64)
                        sums = (own.rows[matrix][rows] * uses[:, None]).astype(np.float32)
                        yield pd.DataFrame({"matrix": [matrix], "block": [block], "task": [TaskContext.get().partitionId()], "rows": [rows.tobytes()], "uses": [uses.tobytes()], "sums": [sums.tobytes()]})

        trained = ids.mapInPandas(train, kind)
        group = F.floor(F.col("task") / 64).alias("group")
        for r in trained.groupBy("matrix", "block", group).applyInPandas(merged, kind).groupBy("matrix", "block").applyInPandas(merged, kind).toLocalIterator():
            rows, uses = np.frombuffer(r["rows"], dtype=np.int64), np.frombuffer(r["uses"], dtype=np.float64)
            net.rows[r["matrix"]][rows] = np.frombuffer(r["sums"], dtype=np.float32).reshape(len(rows), -1) / uses[:, None]
    return net


def tail_sums(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(__row, __tail) of stored ``docs``: the sum of the logarithms of the corpus counts of the words not held by name."""
    met = docs.select("__row", F.explode("__rest").alias("word")).join(vocabulary.tail, "word")
    return met.groupBy("__row").agg(F.sum(F.log("n")).alias("__tail"))


def score_documents(docs: DataFrame, vocabulary: Vocabulary, net: Network) -> DataFrame:
    """``docs`` with lm_words, lm_logprob (the sum over all words) and lm_mean (a word's mean, 0 for no words).

    Whole texts are read in portions of CHUNK words with their true sides. A null or empty text has no words and a
    sum of 0; an empty table gives an empty result; repeated rows get the same result; other columns are kept, columns
    named like the new ones replaced. A word that the corpus of the vocabulary doesn't hold counts as one that it holds
    once.
    """
    if "__ids" not in docs.columns:
        docs = stored_ids(docs, vocabulary)
    shared, named = docs.sparkSession.sparkContext.broadcast((replace(vocabulary, ids={}, tail=None), net.rows)), len(vocabulary.ids)

    @F.pandas_udf("lm_words long, lm_logprob double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words, rows = shared.value
        own = Network(words, rows)
        for batch in texts:
            n, total = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch))
            for who, near, target in windows_in(batch, words.size):
                logs = own.log_probs(near, target)
                other = target >= named
                logs[other] -= words.log_mass[target[other] - named]
                n += np.bincount(who, minlength=len(batch))
                total += np.bincount(who, weights=logs, minlength=len(batch))
            yield pd.DataFrame({"lm_words": n, "lm_logprob": total})

    scored, total = docs.withColumn("__lm", score(F.col("__ids"))), F.col("__lm.lm_logprob")
    if vocabulary.tail is not None:
        scored = scored.drop("__ids", "__rest").join(tail_sums(docs, vocabulary), "__row", "left")
        total = total + F.coalesce("__tail", F.lit(0.0))
    return (
        scored.withColumns({"lm_words": F.col("__lm.lm_words"), "lm_logprob": total})
        .withColumn("lm_mean", F.when(F.col("lm_words") > 0, F.col("lm_logprob") / F.col("lm_words")).otherwise(0.0))
        .drop("__lm", "__row", "__tail", "__ids", "__rest")
    )


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = fit_vocabulary(docs)
    ids = stored_ids(docs, vocabulary, "text")
    return score_documents(ids, vocabulary, fit_network(ids, vocabulary)).select("doc_id", "lm_words", "lm_logprob", "lm_mean")
