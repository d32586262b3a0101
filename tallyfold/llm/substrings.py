"""Operator 5: substring deduplication over sliding runs of sentences and parts of sentences."""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Consecutive parts of a run at least, and the words that a run has at least.
RUN, MIN_WORDS = 3, 10
#: A part ends after a word that comes first in the order among all words up to NEAR away. Where such words are two STEPs or more apart,
#: one STEP and two from both sides as long as no part of fewer words is left, and in the middle of what then is still as long after every word.
NEAR, STEP = 3, 5
#: Words of a group of equal short parts.
GROUP = 4

_word = re.compile(r"(?:[^\s.!?]+[.!?]*|[.!?]+)(?:[^\S\n]*\n)?")
_HASH = np.uint64((1 << 63) - 1)


class _Keys(dict):
    """Place in the order of each word: words that end a sentence first, then by hash of the lower-case word."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        key = self[word] = xxhash.xxh3_64_intdigest(word.rstrip().lower().encode()) >> 1 | (word[-1] not in ".!?\n") << 63
        return key


_keys = _Keys()
common.on_leave("substrings", _keys.clear)


def ends(key: np.ndarray) -> np.ndarray:
    """Numbers of words before each part's end, ascending. They follow from the words around; the text's begin and end count as ends of sentences."""
    x = np.full(len(key) + 1 + 2 * NEAR, (1 << 64) - 1, np.uint64)
    x[NEAR] = 0
    x[NEAR + 1 : -NEAR] = key
    x[-NEAR - 1] &= _HASH
    two = np.minimum(x[1:], x[:-1])
    four = np.minimum(two[2:], two[:-2])
    to = np.flatnonzero(x[NEAR:-NEAR] == np.minimum(four[NEAR:], four[:-NEAR]))
    if to[-1] != len(key):
        to = np.append(to, len(key))
    lo, hi = to[:-1], to[1:]
    gap = hi - lo
    if (gap >= 2 * STEP).any():
        more = [lo[gap >= 2 * STEP] + STEP, hi[gap >= 3 * STEP] - STEP, lo[gap >= 4 * STEP] + 2 * STEP, hi[gap >= 5 * STEP] - 2 * STEP]
        more += [np.arange(lo[i] + 2 * STEP, hi[i] - 2 * STEP) for i in np.flatnonzero(gap >= 6 * STEP)]
        to = np.unique(np.concatenate([to, *more]))
    return grouped(key, to[1:])


def grouped(key: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Ends of parts, where the same part of one or two words comes over and over in groups of GROUP words.

    Groups are dealt from both ends of such a stretch, what is left lies in the middle: near an end of it they depend on that end only,
    and all groups of a stretch are alike wherever it begins.
    """
    size = np.diff(to, prepend=0)
    same = np.append(False, (size[1:] == size[:-1]) & (size[1:] <= 2) & (key[to[1:] - 1] == key[to[:-1] - 1]))
    if not same.any():
        return to
    two = np.flatnonzero(same & (size == 2))
    same[two] = key[to[two] - 2] == key[to[two - 1] - 2]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    out, at = [], 0
    for i, j in zip(edge[::2] - 1, edge[1::2]):  # parts i to j - 1 are equal
        lo, hi = int(to[i] - size[i]), int(to[j - 1])
        left, rest = divmod(hi - lo, 2 * GROUP)
        right = left
        if rest == 1 and left:  # no part of one word alone
            left -= 1
        out += [to[at:i], lo + GROUP * np.arange(1, left + 1), hi - GROUP * np.arange(right, -1, -1)]
        at = j
    return np.unique(np.concatenate([*out, to[at:]]))


def parts(words: list[str]) -> list[tuple[int, int, bytes]]:
    """(first word, word after the last, hashes of the words) of each part, in order."""
    if not words:
        return []
    key = np.fromiter(map(_keys.__getitem__, words), np.uint64, len(words))
    raw = (key & _HASH).tobytes()
    to = ends(key).tolist()
    return [(lo, hi, raw[8 * lo : 8 * hi]) for lo, hi in zip([0, *to], to)]


def sentences(text: str) -> list[tuple[int, int, bytes, int]]:
    """(start, end, hashes of the lower-case words, number of words) of each part, in order.

    Words are runs without white space; one ends after a run of `.`, `!` or `?`, and with it, or before a newline, a sentence. Parts end
    with sentences as far as these lie more than NEAR words apart: shorter ones share a part, longer ones fall into several. A part has
    less than two STEPs of words and follows from the few words around it, so any 51 consecutive words hold a whole run, the same
    one wherever they stand.
    """
    found = list(_word.finditer(text))
    return [(found[lo].start(), found[hi - 1].start() + len(found[hi - 1][0].rstrip()), own, hi - lo) for lo, hi, own in parts([m[0] for m in found])]


def stops(n_words: list[int], run: int, min_words: int) -> list[int]:
    """For each part that a run begins with, the part after its last: it grows until it has `run` parts and `min_words` words."""
    total = [0, *accumulate(n_words)]
    out, j = [], 0
    for i in range(len(n_words) - run + 1):
        j = max(j, i + run)
        while j < len(n_words) and total[j] - total[i] < min_words:
            j += 1
        if total[j] - total[i] < min_words:
            break
        out.append(j)
    return out


def runs(text: str, run: int, min_words: int) -> tuple[list[tuple[int, bytes]], list[int]]:
    """(first part, 128-bit hash) of each run's first occurrence in the text; first parts of its later ones."""
    found = parts(_word.findall(text))
    own = [x[2] for x in found]
    seen: set[bytes] = set()
    first, later = [], []
    for i, j in enumerate(stops([hi - lo for lo, hi, _ in found], run, min_words)):
        h = xxhash.xxh3_128_digest(b"\n".join(own[i:j]))
        if h in seen:
            later.append(i)
        else:
            seen.add(h)
            first.append((i, h))
    return first, later


def cut(text: str, starts: list[int], run: int, min_words: int) -> tuple[str, int]:
    """The text without the parts that runs from these starts cover, and how many those are."""
    if not starts:
        return text, 0
    found = sentences(text)
    stop = stops([x[3] for x in found], run, min_words)
    gone = {i for s in starts for i in range(s, stop[s])}
    out, at = [], 0
    for i in sorted(gone):
        s, e = found[i][0], found[i][1]
        out.append(text[at:s])
        at = e
    return "".join([*out, text[at:]]), len(gone)


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """id_col, text, n_removed: every document without the parts (see sentences()) of runs that occurred before, and how many went.

    Documents are ordered by id, of whatever type (nulls first), equal ids by an arbitrary but stored order. Of equal runs the first in the first
    document stays; every part covered by any other goes. A run has `run` parts, or as many more as give it `min_words`
    words; texts of fewer parts or words are never cut. Any passage of over 50 words that occurred before loses a run at
    least; at its two ends, words that share a part with other text stay. Null texts stay null; documents left empty stay as rows.

    Runs meet by hash in one aggregation that keeps only the first document of each (hot runs combine before the
    shuffle); a Bloom filter of bounded size lets only runs that are likely repeated move a second time, to a
    join whose hot keys Spark can split. Hashes have 128 bits.
    """
    rows = common.keep(df.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("text")), "substrings")
    whole_number = isinstance(rows.schema[id_col].dataType, common.T.IntegralType)
    # nulls first; Spark combines the least of a long by hash, that of other types by sorting
    rank = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))) if whole_number else F.col(id_col)
    src = rows.select("__row", rank.alias("__rank"), "text")
    kind = src.schema["__rank"].dataType
    emitted = lambda *more: common.T.StructType([common.T.StructField("row", common.T.LongType()), common.T.StructField("rank", kind), *[common.T.StructField(n, t) for n, t in more]])
    hashes = [("h1", common.T.LongType()), ("h2", common.T.LongType())]

    found_schema = common.T.StructType([common.T.StructField("row", common.T.LongType()), common.T.StructField("rank", kind), *common.T.StructType.fromDDL("hashes binary, at binary, later binary").fields])

    def find(batches):
        for b in batches:
            hashes, at, late = [], [], []
            for text in b.column(2).to_pylist():
                first, later = runs(text or "", run, min_words)
                hashes.append(b"".join(h for _, h in first))
                at.append(np.array([i for i, _ in first], np.int32).tobytes())
                late.append(np.array(later, np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(x, pa.binary()) for x in (hashes, at, late)]], names=found_schema.names)

    # texts are cut into runs once; hashes do not compress
    found = common.keep(common.in_arrow(src, find, found_schema, "substrings"), "runs", "none")

    def emit(batches, filter_=None):
        for b in batches:
            first, later = [len(x) // 16 for x in b.column(2).to_pylist()], [len(x) // 4 for x in b.column(4).to_pylist()]
            both = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int64).reshape(-1, 2)
            of = np.repeat(np.arange(len(first)), first)
            if filter_ is None:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), b.column(1).take(pa.array(of)), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["row", "rank", "h1", "h2"])
                continue
            ok = np.flatnonzero(filter_.value.has(np.ascontiguousarray(both[:, 0]).view(np.uint64)))
            n = sum(later)
            of = pa.array(np.concatenate([of[ok], np.repeat(np.arange(len(later)), later)]))
            at = np.concatenate([np.frombuffer(b"".join(b.column(3).to_pylist()), np.int32)[ok], np.frombuffer(b"".join(b.column(4).to_pylist()), np.int32)])
            high, low = (np.append(both[ok, k], np.zeros(n, np.int64)) for k in (0, 1))
            local = np.append(np.zeros(len(ok), bool), np.ones(n, bool))
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), *[pa.array(c) for c in (at, high, low, local)]], names=["row", "rank", "at", "h1", "h2", "local"])

    place = F.col("rank") if whole_number else F.struct(F.col("rank").isNotNull().alias("known"), F.col("rank").alias("rank"))
    met = common.in_arrow(found, emit, emitted(*hashes), "substrings").groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2", F.col("first" if whole_number else "first.rank").alias("first_rank"))
    met = common.keep(met, "repeated-runs")
    sent = rows.sparkSession.sparkContext.broadcast(common.bloom(met, "h1", met.count()))
    likely = common.keep(common.in_arrow(found, lambda batches: emit(batches, sent), emitted(("at", common.T.IntegerType()), *hashes, ("local", common.T.BooleanType())), "substrings"), "likely-runs")
    # among documents of the first rank, the first row
    shared = likely.filter("not local").join(met, ["h1", "h2"])
    ties = shared.filter("rank <=> first_rank").groupBy("h1", "h2").agg(F.min("row").alias("first_row"))
    gone = shared.join(ties.hint("shuffle_hash"), ["h1", "h2"]).filter("not (rank <=> first_rank) or row <> first_row").select("row", "at").unionByName(likely.filter("local").select("row", "at"))
    starts = gone.groupBy("row").agg(F.collect_list("at").alias("starts"))
    starts = common.keep(starts, "starts")
    common.drop(found, likely, met)
    touched = starts.select("row")
    few = starts.count() <= common.BROADCAST_KEYS
    if few:  # only texts that lose something move
        touched = F.broadcast(touched)
        joined = rows.join(touched, rows["__row"] == touched["row"], "left_semi").join(starts.hint("shuffle_hash"), F.col("__row") == starts["row"])
        whole = rows.join(touched, rows["__row"] == touched["row"], "left_anti").select(F.col(id_col), "text", F.lit(0).alias("n_removed"))
    else:
        joined = rows.join(starts.hint("shuffle_hash"), rows["__row"] == starts["row"], "left")
    joined = joined.select(F.col(id_col), "text", "starts")
    schema = common.with_id(df.select(F.col(id_col)), id_col, "text string, n_removed int")
    out = common.arrow_schema(schema)

    def remove(batches):
        for b in batches:
            done = [cut(t or "", s or [], run, min_words) for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield common.batch_of(out, b.column(0), pa.array([None if t is None else d[0] for t, d in zip(b.column(1).to_pylist(), done)], pa.string()), [d[1] for d in done])

    less = common.in_arrow(joined, remove, schema, "substrings")
    return less.unionByName(whole) if few else less
