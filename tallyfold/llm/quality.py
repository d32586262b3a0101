"""Operator 10: quality rules and line labelling by a linear-chain conditional random field with Viterbi decoding."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, crf

#: About so many labelled rows of each label are sampled, by hash, to fit the field, on at most so many pieces of PIECE lines.
SAMPLE_ROWS, FIT_PIECES, PIECE = 1500, 2500, 64
#: A document whose words lie in content lines to less than this part is not kept.
CONTENT_SHARE = 0.5
MIN_WORDS, WINDOW = 20, 8

_symbols = re.compile(r"[#*$%&|<>]")
_mult = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D)]

FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, labels array<tinyint>, kept boolean"


class Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def repeat_words(words: list[bytes], hashes: Hashes) -> int:
    """Words that lie in a window of WINDOW words found twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    code = np.zeros(n, np.uint64)
    for k, m in enumerate(_mult):
        code += h[k : k + n] * m
    _, back, count = np.unique(code, return_inverse=True, return_counts=True)
    again = count[back] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def features(line: str, words: list[bytes], again: bool) -> list[float]:
    n = len(words)
    if not n:
        return [1.0] + [0.0] * 9
    size = len(line)
    symbols = len(_symbols.findall(line))
    upper = sum(map(str.isupper, line)) / size
    ends = line.rstrip()[-1:] in ".!?"
    return [1.0, 1.0, min(n, 40) / 40, min(1.0, symbols / n), upper, len(set(words)) / n, line.count("!!") / n, float(again), float(ends), sum(map(str.isdigit, line)) / size]


def read(text: str, hashes: Hashes) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The five counts; features and words of each line."""
    words: list[bytes] = []
    seen: set[str] = set()
    rows, sizes = [], []
    dup = 0
    for line in text.split("\n"):
        own = line.encode().split()
        again = bool(own) and line in seen
        dup += again
        if own:
            seen.add(line)
        words += own
        sizes.append(len(own))
        rows.append(features(line, own, again))
    chars = len(text) - sum(map(text.count, " \t\n\r\x0b\x0c"))
    return [len(words), chars, len(_symbols.findall(text)), dup, repeat_words(words, hashes)], np.array(rows), np.array(sizes)


def line_tags(sequences: list[np.ndarray], good: list[bool]) -> list[np.ndarray]:
    """0 or 1 (boilerplate) for each line, from the labels of whole documents.

    A logistic model of single lines tells lines that bad documents have from those that good ones have; a bad document's
    line is boilerplate where it says so, all other lines are content. A blank line goes with the line before it.
    """
    x = np.concatenate(sequences)
    bad = np.concatenate([np.full(len(s), not g) for s, g in zip(sequences, good)])
    some = x[:, 1] > 0
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x[some] @ w, -30, 30)))
        slope = x[some].T @ (bad[some] - p) - 1e-2 * w
        bend = (x[some] * (p * (1 - p))[:, None]).T @ x[some] + 1e-2 * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(bend, slope), -5, 5)
    out = []
    for s, g in zip(sequences, good):
        tag = ((s @ w > 0) & (s[:, 1] > 0) & (not g)).astype(int)
        for k in np.flatnonzero(s[:, 1] == 0):
            tag[k] = tag[k - 1] if k else 0
        out.append(tag)
    return out


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS, pieces: int = FIT_PIECES) -> crf.Chain:
    """Fit the field on lines of a bounded hash sample of labelled documents, without the held-out ones (crc32(id as text) mod 5 is 0).

    Labels are of documents, the field's of lines: line_tags() finds which lines of a bad document are boilerplate, so sequences
    hold changes of state. Null ids, labels and texts are left out; an id labelled both ways counts as bad. Without labelled
    documents all potentials are 0 and every line is content.
    """
    own = labels.select(F.col(id_col).alias("__id"), (F.col(label_col).cast("int") == 1).alias("__good")).filter("__id is not null and __good is not null").filter(~common.held_out("__id")).groupBy("__id").agg(F.min("__good").alias("__good"))
    size = {r["__good"]: r["count"] for r in own.groupBy("__good").count().collect()}
    share = F.when(F.col("__good"), min(1.0, rows / max(1, size.get(True, 0)))).otherwise(min(1.0, rows / max(1, size.get(False, 0))))
    ids = own.filter(F.pmod(F.xxhash64(F.lit("quality"), "__id"), F.lit(1 << 20)) / F.lit(float(1 << 20)) < share)
    texts = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).filter("__text is not null").join(F.broadcast(ids), "__id")  # a bounded number of ids

    def lines(batches):
        hashes = Hashes()
        for b in batches:
            got = []
            for i, text, good in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                x = read(text, hashes)[1]
                for k in range(0, len(x), PIECE):
                    got.append((f"{i}/{k}", good, x[k : k + PIECE].ravel().tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.bool_()), pa.array([g[2] for g in got], pa.list_(pa.float64()))], names=["key", "good", "x"])

    read_lines = common.in_arrow(texts.select(F.col("__id").cast("string"), "__text", "__good"), lines, "key string, good boolean, x array<double>", "quality")
    found = read_lines.orderBy(F.xxhash64("key"), "key").limit(pieces).collect()
    sequences = [np.array(r["x"]).reshape(-1, 10) for r in found]
    return crf.fit(sequences, line_tags(sequences, [r["good"] for r in found]) if found else [], 10, rate=0.3, l2=1e-4)


def judge(df: DataFrame, chain: crf.Chain, id_col: str = "doc_id", text_col: str = "text", content_share: float = CONTENT_SHARE) -> DataFrame:
    """id_col and FIELDS for every whole text.

    Words are runs without the blanks x20 and x09 to x0D; lines lie between newlines. base_failed: fewer than 20
    words, or over 30 % of them in repeated windows of 8 words. labels: Viterbi's state of each line, 0 content, 1
    boilerplate; content_share: words in content lines by all words (0 without words). kept: not base_failed, and
    content_share at least the bound. Null and empty texts have no words and fail. No shuffle.
    """
    src = common.texts(df, id_col, text_col)
    schema = common.with_id(src, id_col, FIELDS)
    out = common.arrow_schema(schema)
    sent = df.sparkSession.sparkContext.broadcast(chain)

    def work(batches):
        hashes, own = Hashes(), sent.value
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                counts, x, sizes = read(text or "", hashes)
                state = own.viterbi(x)
                n, again = counts[0], counts[4]
                failed = n < MIN_WORDS or 100 * again > 30 * n
                share = float(sizes[state == 0].sum() / n) if n else 0.0
                rows.append([*counts, failed, share, state.tolist(), not failed and share >= content_share])
            yield common.batch_of(out, b.column(0), *[pa.array([r[k] for r in rows], out.field(k + 1).type) for k in range(9)])

    return common.in_arrow(src, work, schema, "quality")
