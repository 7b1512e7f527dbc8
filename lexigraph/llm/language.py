"""Language identification by unigram pieces, summed over all segmentations.

Each language has probabilities for the pieces of a fixed public vocabulary. A word's probability is the sum over all
ways to cut it into pieces, by the forward algorithm; a text's score is the product over its words. The piece
probabilities are learned by expectation maximisation over the word counts of the whole training corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.llm.common import stored, table

LETTERS = re.compile(r"[^\W\d_]+")
#: Words of more letters are summed one by one with rescaling, as their probabilities would leave the range of a float.
LONGEST = 32
MARK = "▁"
#: Words whose scores or counts a Python worker holds at a time.
CACHE = 150_000
#: Probability of a character that no piece covers, in every language.
UNKNOWN = 1e-8
#: Words whose segmentations are laid out in memory at once.
WIDTH = 10_000
BASE = np.uint64(0x9E3779B97F4A7C15)
SLOT_BITS = 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> list[str]:
    """The vocabulary's pieces of letters, in lower case, with their mark of a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in names if p == MARK or LETTERS.fullmatch(p.removeprefix(MARK)))


def words_in(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


class Segmenter:
    """Finds the pieces in many words at once and runs the forward and backward sums over their segmentations."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces) + 1  # the last stands for a character without a piece
        self.longest = max(map(len, pieces), default=1)
        keys = np.array([self._key(p) for p in pieces], dtype=np.uint64)
        self.tables = []
        left = np.arange(len(pieces))
        while len(left):
            mult = np.uint64(0xD1342543DE82EF95 + 2 * len(self.tables))
            slots = (keys[left] * mult) >> np.uint64(64 - SLOT_BITS)
            table_ids = np.full(1 << SLOT_BITS, -1, dtype=np.int32)
            table_ids[slots] = left
            self.tables.append((mult, table_ids))
            left = left[table_ids[slots] != left]
        self.keys = keys

    @staticmethod
    def _key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c) + 1) % 2**64
        return h

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        found = np.full(len(hashes), -1, dtype=np.int32)
        if not len(self.keys):
            return found
        for mult, ids in self.tables:
            got = ids[(hashes * mult) >> np.uint64(64 - SLOT_BITS)]
            hit = (got >= 0) & (self.keys[got] == hashes)
            found[hit] = got[hit]
        return found

    def lattice(self, words: list[str]) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray, np.ndarray]]]:
        """Lengths (with the mark) and the pieces as (end, length, words, piece ids), by end."""
        size = np.fromiter((len(w) + 1 for w in words), dtype=np.int64, count=len(words))
        flat = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        most = int(size.max(initial=0))
        prefix = np.zeros((most + 1, len(words)), dtype=np.uint64)
        for e in range(1, most + 1):
            char = flat[np.minimum(start + e - 1, len(flat) - 1)]
            prefix[e] = prefix[e - 1] * BASE + char
        powers = [np.uint64(pow(int(BASE), n, 2**64)) for n in range(self.longest + 1)]
        edges = []
        for e in range(1, most + 1):
            here = np.flatnonzero(size >= e)
            for n in range(1, min(e, self.longest) + 1):
                ids = self._find(prefix[e, here] - prefix[e - n, here] * powers[n])
                if n == 1:
                    edges.append((e, n, here, np.where(ids < 0, self.size - 1, ids)))
                elif (hit := ids >= 0).any():
                    edges.append((e, n, here[hit], ids[hit]))
        return size, edges

    def forward(self, words: list[str], probs: np.ndarray) -> np.ndarray:
        """Logarithm of each word's probability in each language; probs: pieces by languages."""
        out = np.zeros((len(words), probs.shape[1]))
        long = np.fromiter((len(w) > LONGEST for w in words), dtype=bool, count=len(words))
        for i in np.flatnonzero(long):
            at, scale = self._scaled(self._spans(words[i]), probs)
            out[i] = np.log(at[-1]) + scale[-1]
        if not long.all():
            size, edges = self.lattice([w for w, is_long in zip(words, long, strict=True) if not is_long])
            alpha = self._alpha(size, edges, probs)
            out[~long] = np.log(np.maximum(alpha[size, np.arange(len(size))], 1e-300))
        return out

    def _spans(self, word: str) -> np.ndarray:
        """Pieces of one word: spans[e, n] is the piece of n characters that ends after e, -1 if there is none."""
        codes = np.frombuffer((MARK + word).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        spans = np.full((len(codes) + 1, self.longest + 1), -1, dtype=np.int32)
        hashes = np.zeros(0, dtype=np.uint64)
        for n in range(1, min(self.longest, len(codes)) + 1):
            # The hash of n characters from the hash of the n - 1 before the last.
            hashes = codes if n == 1 else hashes[:-1] * BASE + codes[n - 1 :]
            spans[n:, n] = self._find(hashes)
        spans[1:, 1][spans[1:, 1] < 0] = self.size - 1
        return spans

    def _scaled(self, spans: np.ndarray, probs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over the segmentations of each beginning, by lanes of ``probs``, as numbers and logarithms of their scales."""
        last, lanes = len(spans) - 1, probs.shape[1]
        value, scale = np.zeros((last + 1, lanes)), np.zeros((last + 1, lanes))
        value[0] = 1
        for e in range(1, last + 1):
            n = np.flatnonzero(spans[e] >= 0)
            scale[e] = scale[e - n].max(axis=0)
            value[e] = (value[e - n] * np.exp(scale[e - n] - scale[e]) * probs[spans[e, n]]).sum(axis=0)
            low = value[e] < 1e-100
            value[e][low] *= 1e100
            scale[e][low] -= np.log(1e100)
        return value, scale

    def _expected_long(self, word: str, probs: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in one word, by the probabilities of one language."""
        spans = self._spans(word)
        last = len(spans) - 1
        ahead, ahead_scale = self._scaled(spans, probs[:, None])
        # Seen from the end, a piece of n characters that ends after e starts the rest of last - e characters.
        mirrored = np.full_like(spans, -1)
        for n in range(1, spans.shape[1]):
            mirrored[n:, n] = spans[n:, n][::-1]
        back, back_scale = (x[::-1] for x in self._scaled(mirrored, probs[:, None]))
        out = np.zeros(len(probs))
        for e in range(1, last + 1):
            n = np.flatnonzero(spans[e] >= 0)
            logs = ahead_scale[e - n, 0] + back_scale[e, 0] - ahead_scale[last, 0]
            out[spans[e, n]] += ahead[e - n, 0] / ahead[last, 0] * probs[spans[e, n]] * back[e, 0] * np.exp(logs)
        return out

    @staticmethod
    def _alpha(size: np.ndarray, edges: list, probs: np.ndarray) -> np.ndarray:
        alpha = np.zeros((int(size.max()) + 1, len(size), probs.shape[1]))
        alpha[0] = 1
        for e, n, who, ids in edges:
            alpha[e, who] += alpha[e - n, who] * probs[ids]
        return alpha

    def expected(self, words: list[str], counts: np.ndarray, lang: np.ndarray, probs: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in each language, given each word's language and count."""
        long = np.fromiter((len(w) > LONGEST for w in words), dtype=bool, count=len(words))
        if long.any():
            out = np.zeros(probs.shape)
            for i in np.flatnonzero(long):
                out[:, lang[i]] += counts[i] * self._expected_long(words[i], probs[:, lang[i]])
            if not long.all():
                out += self.expected([w for w, is_long in zip(words, long, strict=True) if not is_long], counts[~long], lang[~long], probs)
            return out
        size, edges = self.lattice(words)
        alpha, beta = np.zeros((2, int(size.max()) + 1, len(size)))
        alpha[0] = 1
        for e, n, who, ids in edges:
            alpha[e, who] += alpha[e - n, who] * probs[ids, lang[who]]
        at = np.arange(len(size))
        total = np.maximum(alpha[size, at], 1e-300)
        beta[size, at] = 1
        out = np.zeros(probs.size)
        for e, n, who, ids in reversed(edges):
            p = probs[ids, lang[who]]
            use = alpha[e - n, who] * p * beta[e, who] / total[who] * counts[who]
            out += np.bincount(ids.astype(np.int64) * probs.shape[1] + lang[who], weights=use, minlength=probs.size)
            beta[e - n, who] += p * beta[e, who]
        return out.reshape(probs.shape)


@dataclass
class LanguageModel:
    pieces: list[str]
    langs: list[str]
    probs: np.ndarray


def held_out(doc_id: Column) -> Column:
    """Whether the row is kept from learning: crc32 of the id as text leaves 2 when divided by 4. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over whole texts; each task sends what it has counted whenever its table is full."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}

        def sent() -> Iterator[pd.DataFrame]:
            for lang, table_ in held.items():
                if table_:
                    yield pd.DataFrame({"lang": lang, "word": list(table_), "n": list(table_.values())})
            held.clear()

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                held.setdefault(lang, Counter()).update(words_in(text))
                if sum(map(len, held.values())) > CACHE:
                    yield from sent()
        yield from sent()

    return docs.select("lang", "text").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit_language_model(docs: DataFrame, vocabulary: str | None = None, rounds: int = 2) -> LanguageModel:
    """Piece probabilities of every language in ``docs`` (text, lang); rows without a language teach nothing, and
    without rows the model has no languages.

    Each round sends (language, piece) sums to the driver: languages times the vocabulary at most, at any corpus size.
    """
    pieces = load_pieces(vocabulary or default_vocabulary())
    counts = stored(word_counts(docs.where(F.col("lang").isNotNull())), "words")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    probs = np.full((len(pieces) + 1, len(langs)), 1 / (len(pieces) + 1))
    probs[-1] = UNKNOWN
    for _ in range(rounds if langs else 0):
        shared = docs.sparkSession.sparkContext.broadcast((pieces, langs, probs))

        def expect(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, tongues, held = shared.value
            cut, total, place = Segmenter(names), np.zeros(held.shape), {x: i for i, x in enumerate(tongues)}
            for batch in batches:
                for i in range(0, len(batch), WIDTH):
                    part = batch.iloc[i : i + WIDTH]
                    total += cut.expected(part["word"].tolist(), part["n"].to_numpy(dtype=float), part["lang"].map(place).to_numpy(), held)
            piece, lang = np.nonzero(total[:-1])
            yield pd.DataFrame({"piece": piece, "lang": lang, "n": total[piece, lang]})

        uses = np.zeros(probs.shape)
        for r in counts.mapInPandas(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).collect():
            uses[r["piece"], r["lang"]] = r["n"]
        uses[:-1] += 0.01
        probs = uses / uses.sum(axis=0)
        probs[-1] = UNKNOWN
    return LanguageModel(pieces, langs, probs)


def score_texts(model: LanguageModel, texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """lang_pred and score of each text."""
    cut, seen = Segmenter(model.pieces), {}
    logs = np.zeros((0, len(model.langs)))
    for batch in texts:
        preds, scores = [], []
        for part in _portions(batch):
            words = [words_in(t) for t in part] if model.langs else [[]] * len(part)
            if len(seen) > CACHE:
                seen, logs = {}, logs[:0]
            new = [w for w in dict.fromkeys(w for own in words for w in own) if w not in seen]
            for i in range(0, len(new), WIDTH):
                logs = np.concatenate([logs, cut.forward(new[i : i + WIDTH], model.probs)])
            seen.update(zip(new, range(len(seen), len(seen) + len(new)), strict=True))
            for own in words:
                if not own:
                    preds.append("und")
                    scores.append(0.0)
                    continue
                total = logs[np.fromiter(map(seen.__getitem__, own), dtype=np.int64, count=len(own))].sum(axis=0)
                best = int(total.argmax())
                preds.append(model.langs[best])
                scores.append(1 / float(np.exp(total - total[best]).sum()))
        yield pd.DataFrame({"lang_pred": preds, "score": scores})


def _portions(batch: pd.Series, chars: int = 500_000) -> Iterator[list[str]]:
    """The texts of a batch in order, in lists of about so many characters; "" for null."""
    part, size = [], 0
    for text in batch:
        part.append(text if isinstance(text, str) else "")
        size += len(part[-1]) + 1
        if size > chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def identify_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with lang_pred and score, the share of the text's probability that the predicted language has.

    Letters are compared in lower case; whatever isn't a letter parts words. A null, empty or letterless text, or a
    model without languages, gives ``und`` with score 0. Whole texts and words are read whatever their length. An empty
    table gives an empty result. Columns named
    lang_pred or score are replaced, others are kept; repeated rows get the same result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from score_texts(shared.value, texts)

    return docs.withColumn("__lang", judge(F.col("text"))).withColumns({"lang_pred": F.col("__lang.lang_pred"), "score": F.col("__lang.score")}).drop("__lang")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_language_model(docs.where(~held_out(F.col("doc_id"))))
    return identify_language(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
