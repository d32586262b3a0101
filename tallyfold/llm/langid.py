"""Operator 2: language identification by segmentation-marginalised unigrams over a fixed public vocabulary."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: About so many rows of each language are sampled to fit the model; languages with fewer give all.
SAMPLE_ROWS = 400
#: Pseudo-count, in pieces, that the pooled distribution adds to each language's counts.
SMOOTH = 50.0
#: Longest piece in characters; longer ones of the vocabulary hold no words.
LONGEST = 16
#: Words whose log probabilities a worker remembers at least, twice as many at most. A full memory stays beside the next one, which takes over what is in use.
CACHE_WORDS = 200_000
UNDETERMINED = "und"

_words = re.compile(r"[^\W\d_]+").findall


@lru_cache(2)
def vocabulary(path: str) -> tuple[dict[str, int], dict[str, int], object]:
    """The pieces of letters in a sentencepiece model, lower case, with the mark of a word's start; the same with -2 for what only begins a piece; the model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: dict[str, int] = {}
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i).lower()
        if len(piece) <= LONGEST and (body := piece.removeprefix("▁")) and body.isalpha():
            pieces.setdefault(piece, len(pieces))
    pieces.setdefault("▁", len(pieces))
    return pieces, {p[:k]: -2 for p in pieces for k in range(1, len(p))} | pieces, model


_used: list[Model] = []


def _remember(model: Model) -> None:
    """Note a model that this worker scores with, to empty its memory of words when another operator's task begins."""
    if not any(m is model for m in _used):
        _used.append(model)


def _forget() -> None:
    vocabulary.cache_clear()
    steps.cache_clear()
    for m in _used:
        m.known, m.rows, m.before, m.rows_before = {}, None, {}, None
    _used.clear()


common.on_leave("langid", _forget)


@lru_cache(2)
def steps(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The vocabulary's beginnings of pieces, numbered from 1, as tables to be walked by many words at once.

    The beginning that is each character by itself (0: none); each character's column (0: no piece goes on with it); each beginning's row
    (0: it ends there); the longer beginning by row and column (0: none); the piece that each beginning is (-1: none).
    """
    table = vocabulary(path)[1]
    number = {x: i for i, x in enumerate(table, 1)}
    inner = {c: i for i, c in enumerate(sorted({x[-1] for x in table if len(x) > 1}), 1)}
    first, column = np.zeros(0x110000, np.int32), np.zeros(0x110000, np.int16)
    column[[ord(c) for c in inner]] = list(inner.values())
    piece = np.array([-1, *(max(k, -1) for k in table.values())], np.int32)
    row, at = np.zeros(len(piece), np.int32), {}
    for x in table:
        if len(x) == 1:
            first[ord(x)] = number[x]
        else:
            row[number[x[:-1]]] = at.setdefault(x[:-1], len(at) + 1)
    after = np.zeros((len(at) + 1, len(inner) + 1), np.int32)
    for x, i in number.items():
        if len(x) > 1:
            after[at[x[:-1]], inner[x[-1]]] = i
    return first, column, row, after, piece


def spans(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every piece inside each word: the word's number, where the piece starts and ends, its number; ordered by end, then word.

    Piece -1 stands for one character that no piece is. All words go on by one character at a time, from each place from which a piece may still begin.
    """
    first, column, row, after, piece = steps(path)
    text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    size = np.array([len(w) for w in words])
    word = np.repeat(np.arange(len(words)), size)
    start = np.arange(len(text)) - (np.cumsum(size) - size)[word]
    left = size[word] - start  # characters from here to the word's end
    place, state, columns = np.arange(len(text)), first[text], column[text]
    places, lengths, found = [place], [np.ones(len(text), np.int64)], [piece[state]]
    length = 1
    while len(place):
        on = (row[state] > 0) & (left[place] > length)
        place, state = place[on], state[on]
        state = after[row[state], columns[place + length]]
        length += 1
        on = state > 0
        place, state = place[on], state[on]
        whole = piece[state] >= 0
        places.append(place[whole])
        lengths.append(np.full(len(places[-1]), length))
        found.append(piece[state[whole]])
    place = np.concatenate(places)
    at, begin = word[place], start[place]
    end = begin + np.concatenate(lengths)
    order = np.argsort(end * len(words) + at, kind="stable")
    return at[order], begin[order], end[order], np.concatenate(found)[order]


@dataclass
class Model:
    """Log probabilities of pieces by language; the last row is that of a character outside the vocabulary."""

    path: str
    langs: list[str]
    prob: np.ndarray  # pieces + 1, languages
    known: dict[str, int] = field(default_factory=dict)
    rows: np.ndarray | None = None
    before: dict[str, int] = field(default_factory=dict)  # the memory that was full, from which words in use are taken over
    rows_before: np.ndarray | None = None

    def words(self, words: list[str]) -> np.ndarray:
        """log P(word | language), summed over all segmentations, for many words at once: the forward algorithm by end position."""
        by_length = sorted(range(len(words)), key=lambda i: -len(words[i]))  # so that the words that reach a position come first
        lens = np.array([len(words[i]) + 1 for i in by_length])
        at, start, end, piece = spans(["▁" + words[i] for i in by_length], self.path)
        longest = int(lens[0])
        bounds = np.searchsorted(end, np.arange(1, longest + 2))
        result = np.full((len(words), len(self.langs)), -np.inf)
        # alpha is kept scaled: scale[w] is the log of what has been taken out so far
        alpha = np.zeros((longest + 1, len(words), len(self.langs)))
        alpha[0] = 1
        scale = np.zeros((longest + 1, len(words)))
        for e in range(1, longest + 1):
            here = slice(bounds[e - 1], bounds[e])
            a, s, p = at[here], start[here], piece[here]
            many = np.flatnonzero(np.diff(a, prepend=-1))  # each word that reaches e has a piece that ends there
            n, taken = len(many), scale[s, a]
            top = np.maximum.reduceat(taken, many)
            part = alpha[s, a] * self.prob[p] * np.exp(taken - top[a])[:, None]
            sums = np.add.reduceat(part, many, axis=0)
            peak = sums.max(axis=1)
            safe = np.where(peak > 0, peak, 1)
            alpha[e, :n] = sums / safe[:, None]
            scale[e, :n] = top + np.log(safe)
            done = lens[:n] == e
            if done.any():
                result[:n][done] = np.log(np.maximum(alpha[e, :n][done], 1e-300)) + scale[e, :n][done, None]
        out = np.empty_like(result)
        out[by_length] = result
        return out

    def texts(self, many: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Total log probability of each text by language, and whether it has a letter."""
        counts = [Counter(_words(x.lower())) for x in many]
        words = list(dict.fromkeys(chain.from_iterable(counts)))
        new = [w for w in words if w not in self.known]
        if self.rows is None or len(self.known) + len(new) > CACHE_WORDS:
            none = np.zeros((0, len(self.langs)), np.float64)
            self.known, self.rows, self.before, self.rows_before = {}, none, self.known, none if self.rows is None else self.rows
            new = words
        if new:
            held = [w for w in new if w in self.before]
            new = [w for w in new if w not in self.before]
            base = len(self.rows)
            groups: dict[int, list[str]] = {}
            for w in new:  # words of like length together, so that one long word costs no others memory
                groups.setdefault(len(w).bit_length(), []).append(w)
            found, order = [self.rows_before[[self.before[w] for w in held]]], held
            for g in groups.values():
                size = max(1, 200_000 // (max(map(len, g)) + 1))
                for i in range(0, len(g), size):
                    found.append(self.words(g[i : i + size]))
                    order += g[i : i + size]
            self.rows = np.concatenate([self.rows, *found])
            self.known.update((w, base + i) for i, w in enumerate(order))
        total = np.zeros((len(many), len(self.langs)))
        for i, c in enumerate(counts):
            if c:
                total[i] = np.fromiter(c.values(), np.float64, len(c)) @ self.rows[np.fromiter(map(self.known.__getitem__, c), np.int64, len(c))]
        return total, np.array([any(map(str.isalpha, c)) or any(x.isalpha() for w in c for x in w) for c in counts], bool)


def sample(df: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About `rows` rows of each language: those whose hash is below a bound set by the language's count."""
    src = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(lang_col).alias("__lang")).filter("__lang is not null and __text is not null")
    size = {r["__lang"]: r["count"] for r in src.groupBy("__lang").count().collect()}  # a row for each language
    if not size:
        return src
    share = F.create_map(*[F.lit(x) for lang, n in sorted(size.items()) for x in (lang, min(1.0, rows / n))])
    uniform = F.pmod(F.xxhash64(F.lit("sample"), "__id", F.length("__text")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return src.filter(uniform < share[F.col("__lang")])


def fit(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> Model:
    """Piece probabilities of each language from rows with a text and a language.

    Counts are of the pieces in the words' segmentation by the vocabulary itself, over whole texts of about
    `rows` rows a language; they meet on the executors, and at most a count for each piece and language
    reaches the driver. Rows without text or language are left out. Without any row the model has no language
    and predicts `und`.
    """
    picked = sample(df, id_col, text_col, lang_col, rows).select("__lang", "__text")

    def count(batches):
        pieces, prefixes, model = vocabulary(path)
        seen: Counter = Counter()
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = Counter(_words(text.lower()))
                for word, n in words.items():
                    for p in model.encode(word, out_type=str):
                        k = pieces.get(p)
                        if k is not None:
                            seen[lang, k] += n
                        else:
                            for c in p:
                                seen[lang, pieces.get(c, -1)] += n
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in seen], pa.string()), pa.array([x[1] for x in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["lang", "piece", "n"])

    found = common.in_arrow(picked, count, "lang string, piece long, n long", "langid").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
    pieces, _, _ = vocabulary(path)
    langs = sorted({r["lang"] for r in found})
    counts = np.zeros((len(pieces) + 1, len(langs)))
    for r in found:
        counts[r["piece"], langs.index(r["lang"])] = r["n"]
    pooled = counts.sum(axis=1) + 0.05
    pooled /= pooled.sum() if len(langs) else 1
    prob = counts + SMOOTH * pooled[:, None]
    prob = prob / prob.sum(axis=0, keepdims=True) if len(langs) else prob
    return Model(path, langs, prob)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """id_col, lang_pred, score of every whole text, and the columns of `carry` as they are; the text is the only input.

    lang_pred is the language with the largest probability of the text's words under equal priors, ties to the
    first in order of name; score is its posterior. A text that is null, empty or without a letter has lang_pred
    `und` and score 0. No shuffle; the model has a fixed size (vocabulary by languages) and is sent once.
    """
    src = common.texts(df, id_col, text_col, carry)
    schema = common.with_id(src, id_col, "lang_pred string, score double", carry)
    out = common.arrow_schema(schema)
    sent = df.sparkSession.sparkContext.broadcast(model)
    if not model.langs:
        return src.select(F.col(id_col), F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), *[F.col(f"`{c}`") for c in carry or ()])

    def work(batches):
        own = sent.value
        _remember(own)
        for b in batches:
            many = [x or "" for x in b.column(1).to_pylist()]
            total, any_letter = own.texts(many)
            best = total.argmax(axis=1) if len(many) else np.zeros(0, int)
            odds = np.exp(total - total.max(axis=1, keepdims=True)) if len(many) else total
            score = np.where(any_letter, 1 / odds.sum(axis=1), 0.0) if len(many) else np.zeros(0)
            yield common.batch_of(out, b.column(0), pa.array([own.langs[k] if ok else UNDETERMINED for k, ok in zip(best, any_letter)], pa.string()), pa.array(score), *b.columns[2:])

    return common.in_arrow(src, work, schema, "langid")
