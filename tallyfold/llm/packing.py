"""Operator 13: token sequences of bounded length, packed by bulk-synchronous best fit."""

from __future__ import annotations

import re
import struct
import zlib
from codecs import charmap_decode
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokenization import byte_chars, runs

CAPACITY = 2048
#: Matches of the pattern that a worker remembers at least, twice as many at most; at about 200 bytes each.
KNOWN_PIECES = 300_000
#: Documents and gaps that one task sweeps: some 10 MB. Fewer, of LEAST_ROWS on, while there are less than MANY_RANGES tasks.
SWEEP_ROWS, LEAST_ROWS, MANY_RANGES = 1 << 17, 1 << 14, 4096


#: Texts of these characters alone are matched by PLAIN, in the standard library's faster patterns; there it says what the tokenizer's pattern says.
PLAIN_TEXT = r"[\x00-\x1b\x20-\u02c1\u2010-\u2027\u2030-\u205e]*"
_LETTERS, _DIGITS = "A-Za-zªµºÀ-ÖØ-öø-\u02c1", "0-9²³¹¼½¾"
PLAIN = rf" ?[{_LETTERS}]+| ?[{_DIGITS}]+|'(?:[stmd]|re|ve|ll)| ?[^\s{_LETTERS}{_DIGITS}]+|\s+(?!\S)|\s+"


class FileCodec:
    """Ids by a tokenizers file of a byte-level BPE. Matches of its pattern are remembered, so each distinct one is encoded once while it is in use."""

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.piece = Tokenizer.from_file(path)
        self.piece.pre_tokenizer = None  # it gets the characters of the bytes, as a byte-level one would make them
        self.chars = "".join(c for _, c in sorted(byte_chars()[0].items()))
        self.match = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.is_plain, self.match_plain = re.compile(PLAIN_TEXT).fullmatch, re.compile(PLAIN).findall
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as 32-bit integers. A text that names a special token is left to the tokenizer as a whole."""
        if any(s in text for s in self.specials):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        out = []
        for run in runs(text):
            found = self.match_plain(run) if self.is_plain(run) else self.match(run)
            if new := set(found).difference(self.known):
                self._learn(new)
            out.append(b"".join(map(self.known.__getitem__, found)))
            if len(self.known) > KNOWN_PIECES:
                self.known, self.before = {}, self.known
        return b"".join(out)

    def _learn(self, new: set[str]) -> None:
        """Remember these matches. A full memory stays beside the next one, from which what is in use is taken over."""
        for p in new & self.before.keys():
            self.known[p] = self.before[p]
        rest = list(new.difference(self.known))
        if not rest:
            return
        # no UTF-8 has the byte 255, so it parts the matches while all are written in characters of bytes at once
        written = charmap_decode(b"\xff".join(map(str.encode, rest)), "strict", self.chars)[0].split(self.chars[255])
        for p, x in zip(rest, self.piece.encode_batch_fast(written, add_special_tokens=False)):
            self.known[p] = struct.pack(f"<{len(ids := x.ids)}I", *ids)


@lru_cache(1)
def _codec(path: str, pattern: str) -> FileCodec:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return FileCodec(path, pattern)


common.on_leave("packing", _codec.cache_clear)


def pieces(df: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, piece int, start, length, ids_crc32: the pieces of every whole text's ids, closed by end_id.

    Only texts of over `capacity` ids are cut, into pieces of that length; the first takes what is over. ids_crc32 is of the piece's ids as unsigned
    little-endian integers of 32 bits. A null or empty text has one piece, of end_id alone. Ids stay in the task that makes them.
    """
    src = common.texts(df, id_col, text_col)
    schema = common.with_id(src, id_col, "piece int, start long, length long, ids_crc32 long")
    out = common.arrow_schema(schema)
    end = np.array([end_id], "<u4").tobytes()

    def work(batches):
        codec = _codec(path, pattern)
        for b in batches:
            row, rows = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = codec.encode(text or "") + end
                total = len(ids) // 4
                cuts = [0, *range(total % capacity or capacity, total + 1, capacity)]
                row += [i] * (len(cuts) - 1)
                rows += [(k, lo, hi - lo, zlib.crc32(ids[4 * lo : 4 * hi])) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]
            yield common.batch_of(out, b.column(0).take(pa.array(row, pa.int32())), *(zip(*rows) if rows else ([],) * 4))

    return common.in_arrow(src, work, schema, "packing")


def _sweep(capacity: int):
    """Match a range of documents and gaps, ascending by size and documents first: every gap takes the largest documents that are left below it, while they fit."""

    def work(batches):
        part = TaskContext.get().partitionId()
        got = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if got is None or not got.num_rows:
            return
        kind, ids, size = (got.column(c).to_numpy() for c in ("kind", "id", "size"))
        gap, sizes, names = kind.tolist(), size.tolist(), ids.tolist()
        seq, at, left_over, open_docs = [None] * len(sizes), [None] * len(sizes), size.copy(), []
        touched = np.zeros(len(sizes), bool)
        for i, is_gap in enumerate(gap):
            if not is_gap:
                open_docs.append(i)
                continue
            left = sizes[i]
            while open_docs and sizes[open_docs[-1]] <= left:
                d = open_docs.pop()
                seq[d], at[d] = names[i], capacity - left
                left -= sizes[d]
                touched[i] = True
            left_over[i] = left
        rank = np.full(len(sizes), -1, np.int64)
        rank[open_docs] = np.arange(len(open_docs))
        whole = np.flatnonzero((kind == 1) & ~touched)
        rank[whole] = np.arange(len(whole))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(sizes), part), pa.int32()), pa.array(kind, pa.int32()), pa.array(ids, pa.int64()), pa.array(left_over, pa.int64()), pa.array(rank), pa.array(seq, pa.int64()), pa.array(at, pa.int64())],
            names=["part", "kind", "id", "size", "rank", "seq", "at"],
        )

    return work


def _across(parts: list) -> list[tuple]:
    """Match what ranges have left with one another. parts: (part, documents, largest of them, untouched gaps, smallest of them), ascending by size.

    Gaps of a range take documents of the nearest range below that has any, the largest first and as many each as surely fit. Returns (part, from rank, to rank, part of the gaps, rank of the first gap, documents for a gap).
    """
    stack, out = [], []
    for part, docs, largest, gaps, smallest in parts:
        used = 0
        while used < gaps and stack:
            p, n, most = stack.pop()
            each = max(1, smallest // most)
            take = min(n, each * (gaps - used))
            out.append((p, n - take, n, part, used, each))
            used += -(-take // each)
            if take < n:
                stack.append((p, n - take, most))
        if docs:
            stack.append((part, docs, largest))
    return out


def _finish(capacity: int, opened: int):
    """Best fit of the last documents, the largest first: each takes the smallest gap that holds it, or opens a sequence."""

    def work(batches):
        got = [b.to_pydict() for b in batches]
        rows = sorted(zip(*([x for b in got for x in b[c]] for c in ("kind", "size", "id"))), reverse=True)
        room: dict[int, list[int]] = {}
        sizes, n, out = 0, opened, []  # sizes: a bit for each size of which there is a gap
        for kind, size, name in rows:
            if kind:
                room.setdefault(size, []).append(name)
                sizes |= 1 << size
                continue
            if fits := sizes >> size:
                gap = size + (fits & -fits).bit_length() - 1
                seq = room[gap].pop()
                if not room[gap]:
                    sizes ^= 1 << gap
            else:
                n += 1
                gap, seq = capacity, -n
            out.append((name, seq, capacity - gap))
            room.setdefault(gap - size, []).append(seq)
            sizes |= 1 << gap - size
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else ((), (), ()))], names=["id", "sequence_id", "at"])

    return work


def pack(docs: DataFrame, capacity: int = CAPACITY, sweep_rows: int = SWEEP_ROWS, least_rows: int = LEAST_ROWS) -> DataFrame:
    """id, sequence_id, at: where each document (id, size; ids distinct and not negative, sizes 1 to capacity) goes. At most `capacity` in a sequence, without holes.

    Documents of over half the capacity open a sequence each. Then, in rounds that all tasks finish together: documents and gaps are range-sorted by size;
    each range is swept for the successor of its documents, the larger ones first; what ranges have left is matched between them by rank, as counts
    of ranges tell; gaps shrink, and the next round begins. New sequences open only for tokens that are more than all gaps. A gap that takes anything
    loses half of itself or meets no further document, so rounds are few; what fits one sweep of least_rows is finished in one task. Equal sizes are told apart by id, so a size that many documents share is dealt
    to several ranges. Every round's state is a stored table of two numbers a row. The driver sees a count for each size, of `capacity` at most,
    and for each range.
    """
    spark = docs.sparkSession
    big = docs.filter(F.col("size") * 2 > capacity)
    placed = [big.select("id", F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("at"))]
    gaps = big.filter(F.col("size") < capacity).select(F.lit(1).alias("kind"), "id", (capacity - F.col("size")).alias("size"))
    state = common.keep(docs.filter(F.col("size") * 2 <= capacity).select(F.lit(0).alias("kind"), "id", "size").unionByName(gaps), "packing")
    opened = 0
    while True:
        counts = [(r["kind"], r["size"], r["count"]) for r in state.groupBy("kind", "size").count().collect()]
        want = [(s, n) for k, s, n in counts if not k]
        if not want:
            break
        least, tokens = min(want)[0], sum(s * n for s, n in want)
        room = [(s, n) for k, s, n in counts if k and s >= least]
        items, rows = state.filter((F.col("kind") == 0) | (F.col("size") >= least)), sum(n for _, n in (*want, *room))
        if rows <= least_rows:
            placed.append(common.keep(common.in_arrow(items.coalesce(1), _finish(capacity, opened), "id long, sequence_id long, at long", "packing"), "finished"))
            break
        new = max(0, -(-(tokens - sum(s * n for s, n in room)) // capacity))
        if new:
            items = items.unionByName(spark.range(opened + 1, opened + new + 1).select(F.lit(1).alias("kind"), (-F.col("id")).alias("id"), F.lit(capacity).cast("long").alias("size")))
            opened, rows = opened + new, rows + new
        n_ranges = max(-(-rows // sweep_rows), min(-(-rows // least_rows), MANY_RANGES))
        order = ("size", "kind", "id")
        swept = common.keep(common.in_arrow(items.repartitionByRange(n_ranges, *order).sortWithinPartitions(*order), _sweep(capacity), "part int, kind int, id long, size long, rank long, seq long, at long", "packing"), "swept")
        placed.append(swept.filter("seq is not null").select("id", F.col("seq").alias("sequence_id"), "at"))
        left = swept.filter("rank >= 0").groupBy("part").agg(*[F.coalesce(x, F.lit(0)).alias(c) for c, x in (("d", F.count_if(F.col("kind") == 0)), ("most", F.max(F.when(F.col("kind") == 0, F.col("size")))), ("g", F.count_if(F.col("kind") == 1)), ("least", F.min(F.when(F.col("kind") == 1, F.col("size")))))])
        blocks = _across(sorted(map(tuple, left.collect())))  # a row for each range
        left_docs, left_gaps = swept.filter("kind = 0 and seq is null").select("kind", "id", "size", "part", "rank"), swept.filter("kind = 1 and size > 0")
        if blocks:
            dealt = spark.createDataFrame(blocks, "p int, lo long, hi long, q int, first long, each long")
            used = dealt.groupBy(F.col("q").alias("part")).agg(F.max(F.col("first") + F.ceil((F.col("hi") - F.col("lo")) / F.col("each"))).alias("used"))
            slot = F.col("hi") - 1 - F.col("rank")
            left_docs = left_docs.join(F.broadcast(dealt), (F.col("part") == F.col("p")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left").select("kind", "id", "size", F.col("q").alias("part"), (F.col("first") + F.floor(slot / F.col("each"))).alias("rank"), slot.alias("slot"))
            left_gaps = left_gaps.join(F.broadcast(used), "part", "left").withColumn("meets", F.coalesce((F.col("rank") >= 0) & (F.col("rank") < F.col("used")), F.lit(False)))
            here = Window.partitionBy("part", "rank").orderBy("slot")
            before = F.coalesce(F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            met = left_docs.filter("part is not null").join(left_gaps.filter("meets").select("part", "rank", F.col("id").alias("seq"), F.col("size").alias("room")), ["part", "rank"])
            matched = common.keep(met.withColumns({"before": before, "last": F.lead("id").over(here).isNull()}).select("id", "seq", (capacity - F.col("room") + F.col("before")).alias("at"), F.when(F.col("last"), F.col("room") - F.col("before") - F.col("size")).alias("rest")), "matched")
            placed.append(matched.select("id", F.col("seq").alias("sequence_id"), "at"))
            left_docs = left_docs.filter("part is null")
            left_gaps = left_gaps.filter("not meets").select("kind", "id", "size").unionByName(matched.filter("rest > 0").select(F.lit(1).alias("kind"), F.col("seq").alias("id"), F.col("rest").alias("size")))
        after = common.keep(left_docs.select("kind", "id", "size").unionByName(left_gaps.select("kind", "id", "size")), "packing")
        common.drop(state)
        state = after
    out = placed[0]
    for x in placed[1:]:
        out = out.unionByName(x)
    return out


def best_fit(df: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", sweep_rows: int = SWEEP_ROWS, least_rows: int = LEAST_ROWS) -> DataFrame:
    """id_col, piece, start, length, ids_crc32, sequence_id, offset: every piece of every text (see `pieces`) and its place in a sequence (see `pack`).

    Null and empty texts are one token. Null and repeated ids and repeated rows are documents of their own; sequences are numbered by rows, not
    by ids. A text that is cut fills a sequence with each piece but the first. Texts of equal length are placed in any order. An empty table gives no rows.
    """
    cut = common.keep(pieces(df, path, pattern, capacity, end_id, id_col, text_col).withColumn("__piece", F.monotonically_increasing_id()), "pieces")
    where = pack(cut.select(F.col("__piece").alias("id"), F.col("length").alias("size")), capacity, sweep_rows, least_rows)
    return cut.join(where.select(F.col("id").alias("__piece"), "sequence_id", F.col("at").alias("offset")), "__piece").drop("__piece")
