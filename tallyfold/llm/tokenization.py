"""Operator 1: byte-level BPE encoding and decoding with the tokenizers library over Arrow batches."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Pieces whose ids a worker remembers; at about 200 bytes each. When full, the memory starts anew.
CACHE_PIECES = 250_000
#: A long text is cut into runs of about so many characters, at places where no match can span the cut.
RUN_CHARS = 1 << 16


@lru_cache(1)
def byte_chars() -> tuple[dict[int, str], dict[str, int]]:
    """The table that writes each byte as one printable character: visible Latin-1 stands for itself, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    to = {b: chr(b) for b in own}
    for b in range(256):
        if b not in to:
            to[b] = chr(256 + len(to) - len(own))
    return to, {c: b for b, c in to.items()}


def read_ranks(path: str) -> dict[bytes, int]:
    """The lines `base64(bytes) rank` of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encodes and decodes by a rank file; one for each worker process."""

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        to, back = byte_chars()
        write = lambda piece: "".join(map(to.__getitem__, piece))
        self.chars = [""] * (max(ranks.values()) + 1)  # each id's bytes, a character for a byte
        for piece, rank in ranks.items():
            self.chars[rank] = write(piece)
        self.lengths = np.array([len(p) for p in self.chars], np.int64)
        self.back = np.zeros(max(map(ord, back)) + 1, np.uint8)
        self.back[[ord(c) for c in back]] = list(back.values())
        self.bpe = Tokenizer(models.BPE(vocab={write(p): r for p, r in ranks.items()}, merges=[tuple(map(write, m)) for m in self._merges(ranks)]))
        self.bpe.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # \s of the rank files' users is the property White_Space; Python's has four control characters more
        self.match = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _merges(ranks: dict[bytes, int]) -> Iterator[tuple[bytes, bytes]]:
        """The pair that each rank joins: what the piece's bytes become under the lower ranks."""
        for piece, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(piece) == 1:
                continue
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while len(parts) > 2:
                low, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if low >= rank:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 2:
                yield parts[0], parts[1]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        out = []
        for run in runs(text):
            found = self.match(run)
            try:
                out.append(b"".join(map(self.known.__getitem__, found)))
            except KeyError:
                self._learn(found)
                out.append(b"".join(map(self.known.__getitem__, found)))
        return np.frombuffer(b"".join(out), np.int32)

    def _learn(self, found: list[str]) -> None:
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        new = [p for p in dict.fromkeys(found) if p not in self.known]
        for piece, x in zip(new, self.bpe.encode_batch_fast(new, add_special_tokens=False)):
            self.known[piece] = np.array(x.ids, np.int32).tobytes()

    def offsets(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last character of each token. A token with part of a character has that whole character."""
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        lead = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
        char_of = np.cumsum(lead) - 1  # of each byte
        if not len(ids):
            return starts, ends
        return char_of[starts], char_of[ends - 1] + 1

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids: their characters joined, and each turned back by the byte table, so that parts of a split character meet again."""
        written = "".join(map(self.chars.__getitem__, ids))
        return self.back[np.frombuffer(written.encode("utf-16-le"), np.uint16)].tobytes()


def runs(text: str) -> Iterator[str]:
    """Cut between a letter-like character and a following blank or newline: every match of the pattern ends there."""
    at = 0
    while len(text) - at > RUN_CHARS:
        cut = at + RUN_CHARS
        while True:
            places = [p for p in (text.find(" ", cut), text.find("\n", cut)) if p >= 0]
            if not places:
                yield text[at:]
                return
            cut = min(places)
            if not text[cut - 1].isspace():
                break
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


@lru_cache(2)
def _codec(path: str, pattern: str) -> Codec:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Codec(path, pattern)


common.on_leave("tokenization", _codec.cache_clear)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """Token ids of every whole text by the ranks in the file at path, each match of pattern separately, without special tokens.

    Returns id_col, token_ids array<int>; with offsets also char_start and char_end array<int>, in characters.
    A null or empty text has no tokens. Special tokens' names in a text are ordinary text. No shuffle; a worker
    holds one batch and a bounded memory of pieces.
    """
    src = common.texts(df, id_col, text_col)
    schema = common.with_id(src, id_col, "token_ids array<int>" + ", char_start array<int>, char_end array<int>" * offsets)
    out = common.arrow_schema(schema)

    def lists(arrays: list[np.ndarray]) -> pa.Array:
        sizes = np.cumsum([0, *map(len, arrays)])
        values = np.concatenate([*arrays, np.zeros(0, np.int32)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values))

    def work(batches):
        codec = _codec(path, pattern)
        for b in batches:
            own = [x or "" for x in b.column(1).to_pylist()]
            ids = [codec.encode(x) for x in own]
            columns = [b.column(0), lists(ids)]
            if offsets:
                spans = [codec.offsets(x.encode(), i) for x, i in zip(own, ids)]
                columns += [lists([s for s, _ in spans]), lists([e for _, e in spans])]
            yield common.batch_of(out, *columns)

    return common.in_arrow(src, work, schema, "tokenization")


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """The bytes and the text of token ids: id_col, token_ids, decoded binary, decoded_text string.

    Bytes are exact, so parts of a split character join again. In decoded_text, a character of which ids hold
    only a part is U+FFFD. Null ids decode to nothing. An id outside the table is an error.
    """
    src = df.select(F.col(id_col), F.col(ids_col).alias("token_ids"))
    schema = common.with_id(src, id_col, "token_ids array<int>, decoded binary")
    out = common.arrow_schema(schema)

    def work(batches):
        codec = _codec(path, pattern)
        for b in batches:
            column = b.column(1)
            ids, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            here = column.is_valid().to_numpy(zero_copy_only=False)
            decoded = [codec.decode(ids[lo:hi].tolist()) if ok else b"" for lo, hi, ok in zip(ends[:-1], ends[1:], here)]
            yield common.batch_of(out, b.column(0), column, pa.array(decoded, pa.binary()))

    return common.in_arrow(src, work, schema, "tokenization").withColumn("decoded_text", F.make_valid_utf8(F.col("decoded").cast("string")))
