"""Operator 3: toxic spans and document scores by a linear-chain conditional random field."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, crf

#: About so many labelled rows of each label are sampled, by hash, to fit the model.
SAMPLE_TOXIC, SAMPLE_CLEAN = 2000, 8000
#: Words, and words' first letters, that the field has features of: those found more often in toxic or in other documents of the sample, of which this share at most
#: is so by chance (Benjamini and Hochberg's rule over the log-likelihood ratios of all parts of SEEN or more documents, so that the bar follows the
#: number of labelled rows), and whose log odds of a toxic document differ so much from the rest's. They are evidence if the odds are higher.
FALSE_FEATURES, SEEN, EVIDENCE_ODDS = 0.05, 3, 2.0
#: Features at most, those of the highest ratio: 8 bytes each in the model. At 10,000 labelled rows there are some hundreds.
MOST_PARTS = 4000
PREFIXES = (4, 5, 6)
#: Sequences that the field is fitted on, at most, of so many tokens at most; and the words on either side of a word with features that lie in its sequence.
FIT_SEQUENCES, FIT_TOKENS, CONTEXT, ROUNDS = 6000, 200, 10, 120
CACHE_WORDS = 250_000
#: Log odds of a toxic document where nothing could be learnt: a model without labels of both kinds marks none.
EMPTY = -math.log(3)
#: A token whose marginal is below this adds nothing to a document's mass of toxic tokens.
LEAST_MARGINAL = 0.1
#: Numbers of the features that every token has one of: 0 is none, 1 the constant.
CONSTANT, PLAIN, UPPER, DIGITS, FIRST_PART = 1, 2, 3, 4, 5

_word = re.compile(r"[^\W_]+")


class _Kinds(dict):
    """The kind of each word, remembered: words of one shape and with the same parts are of one kind; 0 has no parts and no shape of note."""

    def __init__(self, parts: dict[str, int]):
        super().__init__()
        self.parts, self.found, self.features = parts, {(PLAIN,): 0}, [(PLAIN,)]

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        low = word.lower()
        shape = DIGITS if any(map(str.isdigit, word)) else UPPER if len(word) > 2 and word.isupper() else PLAIN
        own = [self.parts.get(low), *[self.parts.get(f"{low[:k]}*") for k in PREFIXES if len(low) > k]]
        key = (shape, *[k for k in own if k is not None])
        if key not in self.found:
            self.found[key] = len(self.features)
            self.features.append(key)
        kind = self[word] = self.found[key]
        return kind


@dataclass
class Model:
    """A field over words and first letters (parts), shapes, the parts of both neighbours, and a constant."""

    parts: dict[str, int] = field(default_factory=dict)  # numbers from FIRST_PART on
    evidence: frozenset[int] = frozenset()  # of parts
    chain: crf.Chain | None = None
    scale: tuple[float, ...] = (0.0, 0.0, 0.0, EMPTY)  # of the calibration: weights of what tag() returns, and a constant

    def __post_init__(self):
        self.kinds, self.flat, self.table = _Kinds(self.parts), {}, np.zeros((0, 3))

    def __getstate__(self):
        return self.parts, self.evidence, self.chain, self.scale

    def __setstate__(self, state):
        self.parts, self.evidence, self.chain, self.scale = state
        self.__post_init__()

    def width(self) -> int:
        return FIRST_PART + 3 * len(self.parts)

    def features(self, kinds: np.ndarray) -> np.ndarray:
        """Numbers of the features of each token: constant, shape, own parts, and parts of the token before and after."""
        most, n = 1 + len(PREFIXES), len(self.parts)
        own = np.zeros((len(kinds), most), np.int64)
        shape = np.zeros((len(kinds), 1), np.int64)
        for i, k in enumerate(kinds.tolist()):
            s, *parts = self.kinds.features[k]
            shape[i] = s
            own[i, : len(parts)] = parts
        before, after = np.zeros_like(own), np.zeros_like(own)
        before[1:], after[:-1] = own[:-1], own[1:]
        return np.concatenate([np.full((len(kinds), 1), CONSTANT), shape, own, np.where(before > 0, before + n, 0), np.where(after > 0, after + 2 * n, 0)], axis=1)

    def potentials(self, kinds: np.ndarray) -> np.ndarray:
        """Log potential of toxic over clean at each token: the sum over its features()."""
        if len(self.table) < len(self.kinds.features):
            w, n = self.chain.weights[:, 1] - self.chain.weights[:, 0], len(self.parts)
            self.table = np.array([[w[CONSTANT] + w[list(f)].sum(), w[[k + n for k in f[1:]]].sum(), w[[k + 2 * n for k in f[1:]]].sum()] for f in self.kinds.features])
        out = self.table[kinds, 0]
        out[1:] += self.table[kinds[:-1], 1]
        out[:-1] += self.table[kinds[1:], 2]
        return out

    def tag(self, text: str) -> tuple[tuple[float, float, float], list[tuple[int, int, float]]]:
        """What the document's score is made of, and its toxic spans with their largest marginal.

        The former: the largest marginal, log(1 + sum of marginals of LEAST_MARGINAL or more), log(1 + tokens). One word may be
        toxic by chance in a long text; several are not.
        """
        words = _word.findall(text)
        if not words or self.chain is None:
            return (0.0, 0.0, 0.0), []
        kinds = np.fromiter(map(self.kinds.__getitem__, words), np.int64, len(words))
        if not kinds.any():  # all alike: the number of tokens says it all
            if len(words) not in self.flat:
                self.flat[len(words)] = self._inputs(crf.flat_runs(self.potentials(kinds), self.chain.moves))
            return self.flat[len(words)], []
        p = crf.flat_runs(self.potentials(kinds), self.chain.moves)
        hot = np.flatnonzero(p >= 0.5)
        found: list[tuple[int, int, float]] = []
        if len(hot):
            at = [m.span() for m in _word.finditer(text)]
            for run in np.split(hot, np.flatnonzero(np.diff(hot) > 1) + 1):
                found.append((at[run[0]][0], at[run[-1]][1], float(p[run].max())))
        return self._inputs(p), found

    @staticmethod
    def _inputs(p: np.ndarray) -> tuple[float, float, float]:
        return float(p.max()), math.log1p(float(p[p >= LEAST_MARGINAL].sum())), math.log1p(len(p))

    def score(self, inputs: tuple[float, ...]) -> float:
        """The probability of a toxic document."""
        x = sum(a * b for a, b in zip(self.scale, (*inputs, 1.0)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _sample(labels: DataFrame, id_col: str, label_col: str, toxic: int, clean: int) -> DataFrame:
    """About so many toxic and clean ids by hash, one row each; an id labelled both ways counts as toxic."""
    own = labels.select(F.col(id_col).alias("__id"), (F.col(label_col).cast("int") == 1).alias("__toxic")).filter("__id is not null and __toxic is not null and " + "crc32(cast(cast(__id as string) as binary)) % 5 <> 0")
    own = own.groupBy("__id").agg(F.max("__toxic").alias("__toxic"))
    size = {r["__toxic"]: r["count"] for r in own.groupBy("__toxic").count().collect()}
    share = F.when(F.col("__toxic"), min(1.0, toxic / max(1, size.get(True, 0)))).otherwise(min(1.0, clean / max(1, size.get(False, 0))))
    return own.filter(F.pmod(F.xxhash64(F.lit("toxic"), "__id"), F.lit(1 << 20)) / F.lit(float(1 << 20)) < share)


def _distinct(rows: DataFrame) -> DataFrame:
    """The sample without copies: of rows that share the least hash of their words' runs of three, by either of two hashes, the least id stays.

    Words of one text that was copied often would otherwise look like evidence. The sample is bounded, and so are its groups.
    """

    def keys(batches):
        for b in batches:
            found = [[], []]
            for text in b.column("__text").to_pylist():
                w = _word.findall(text.lower())
                runs = {" ".join(w[i : i + 3]).encode() for i in range(max(1, len(w) - 2))}
                for k in (0, 1):
                    found[k].append(min(xxhash.xxh3_64_intdigest(r, seed=k) for r in runs) >> 1)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(f, pa.int64()) for f in found]], names=[*b.schema.names, "__k0", "__k1"])

    schema = common.T.StructType([*rows.schema.fields, common.T.StructField("__k0", common.T.LongType()), common.T.StructField("__k1", common.T.LongType())])
    keyed = common.keep(common.in_arrow(rows, keys, schema, "toxicity"), "toxicity-keyed")
    for k in ("__k0", "__k1"):
        keyed = keyed.join(keyed.groupBy(k).agg(F.min("__id").alias("__least")), k).filter("__id = __least").drop("__least")
    return keyed.select(*rows.columns)


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN, sequences: int = FIT_SEQUENCES, tokens_each: int = FIT_TOKENS, rounds: int = ROUNDS, false_features: float = FALSE_FEATURES, odds_bar: float = EVIDENCE_ODDS, most_parts: int = MOST_PARTS) -> Model:
    """Learn from labelled rows whose crc32(id as text) mod 5 is not 0, on a bounded sample of them: about `toxic` and `clean` rows.

    The field has features of words and words' first letters that toxic and clean documents of the sample have unlike often,
    copies apart. Labelled tokens are those of the sample: one in a toxic document whose own parts are evidence is toxic, all others
    are not. On sequences of them the field is fitted, then a logistic scale from the marginals (see Model.tag) to the document's
    label. Unlabelled rows, null ids and null texts are left out. Without a toxic or without another row the model is empty
    and marks no document. All bounds are parameters.
    """
    ids = _sample(labels, id_col, label_col, toxic, clean)
    texts = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).filter("__text is not null")
    picked = texts.join(F.broadcast(ids), "__id")  # a bounded number of ids
    rows = common.keep(_distinct(picked), "toxicity-sample")
    size = {r["__toxic"]: r["count"] for r in rows.groupBy("__toxic").count().collect()}
    n1, n0 = size.get(True, 0), size.get(False, 0)
    if not n1 or not n0:
        return Model()

    def parts(batches):
        for b in batches:
            names, toxic = [], []
            for text, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = set(_word.findall(text.lower()))
                own = words | {f"{w[:k]}*" for w in words for k in PREFIXES if len(w) > k}
                names += own
                toxic += [t] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(toxic, pa.bool_())], names=["part", "toxic"])

    seen = common.in_arrow(rows.select("__text", "__toxic"), parts, "part string, toxic boolean", "toxicity")
    counted = seen.groupBy("part").agg(F.count_if("toxic").alias("a"), F.count_if(~F.col("toxic")).alias("b"))
    p1, p0 = (F.col("a") + 0.5) / (n1 + 1), (F.col("b") + 0.5) / (n0 + 1)
    p = (F.col("a") + F.col("b") + 1.0) / (n1 + n0 + 2)
    ll = lambda k, n, q: k * F.log(q) + (n - k) * F.log(1 - q)
    llr = 2 * (ll(F.col("a"), F.lit(n1), p1) + ll(F.col("b"), F.lit(n0), p0) - ll(F.col("a"), F.lit(n1), p) - ll(F.col("b"), F.lit(n0), p))
    odds = F.log(p1 / (1 - p1)) - F.log(p0 / (1 - p0))
    rated = common.keep(counted.filter(F.col("a") + F.col("b") >= SEEN).select("part", llr.alias("llr"), odds.alias("odds")), "toxicity-parts")
    tests = rated.count()
    best = rated.orderBy(F.desc("llr"), "part").limit(most_parts).collect()  # a bounded list of features
    passed = max((k for k, r in enumerate(best, 1) if math.erfc(math.sqrt(max(0.0, r["llr"]) / 2)) <= false_features * k / tests), default=0)
    kept = [r for r in best[:passed] if abs(r["odds"]) >= odds_bar]
    numbered = {r["part"]: FIRST_PART + i for i, r in enumerate(kept)}
    model = Model(numbered, frozenset(numbered[r["part"]] for r in kept if r["odds"] > 0))
    sent = rows.sparkSession.sparkContext.broadcast(model)
    deep = 2 + 3 * (1 + len(PREFIXES))

    def tokens(batches):
        own = sent.value
        for b in batches:
            out = []
            for i, text, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = _word.findall(text)
                kinds = np.fromiter(map(own.kinds.__getitem__, words), np.int64, len(words))
                marked = np.array([bool(own.evidence & set(f[1:])) for f in own.kinds.features])
                hot = np.flatnonzero(kinds)
                if not len(hot) and len(words):  # one sequence of a text without any, somewhere in it
                    hot = np.array([xxhash.xxh3_64_intdigest(text) % len(words)])
                for k, group in enumerate(np.split(hot, np.flatnonzero(np.diff(hot) > 2 * CONTEXT) + 1) if len(hot) else ()):
                    lo, hi = max(0, group[0] - CONTEXT), min(len(words), group[-1] + CONTEXT + 1)
                    for j in range(lo, hi, tokens_each):
                        part = kinds[j : min(hi, j + tokens_each)]
                        out.append((f"{i}/{k}/{j}", own.features(part).astype(np.int16).tobytes(), (marked[part] & t).astype(np.int8).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), *[pa.array([o[k] for o in out], pa.binary()) for k in (1, 2)]], names=["key", "x", "y"])

    cut = common.in_arrow(rows.select(F.col("__id").cast("string"), "__text", "__toxic"), tokens, "key string, x binary, y binary", "toxicity")
    found = cut.orderBy(F.xxhash64("key"), "key").limit(sequences).collect()
    x, y = [np.frombuffer(r["x"], np.int16).astype(np.int64).reshape(-1, deep) for r in found], [np.frombuffer(r["y"], np.int8) for r in found]
    model.chain = crf.fit(x, y, model.width(), rounds=rounds, rate=0.3, l2=1e-4)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def inputs(batches):
        for b in batches:
            got = [sent.value.tag(t)[0] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[pa.array([g[k] for g in got], pa.float64()) for k in range(3)], b.column(1)], names=["top", "mass", "size", "toxic"])

    pairs = common.in_arrow(rows.select("__text", "__toxic"), inputs, "top double, mass double, size double, toxic boolean", "toxicity").orderBy("top", "mass", "size", "toxic").collect()  # a row for each of the bounded sample
    model.scale = _logistic(np.array([r[:3] for r in pairs]), np.array([float(r["toxic"]) for r in pairs]))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights and a constant by Newton's method, with a small penalty on the weights."""
    design = np.column_stack([x, np.ones(len(x))])
    ridge = np.array([1e-2] * x.shape[1] + [1e-4])
    w = np.zeros(len(ridge))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (y - p) - ridge * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        w = w + np.clip(np.linalg.solve(hess, grad), -5, 5)
    return tuple(map(float, w))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score, spans array<struct<start, end, marginal>> of every whole text; the text is the only input.

    Every token of a text goes through forward-backward (crf.flat_runs). score is the calibrated probability of the label given
    what tag() makes of the marginals; a null or empty text has no token, and all of it is 0. spans are character offsets of runs of tokens whose
    marginal is 0.5 or more. No shuffle; the model has a bounded size and is sent once.
    """
    src = common.texts(df, id_col, text_col)
    schema = common.with_id(src, id_col, "score double, spans array<struct<start:int,end:int,marginal:double>>")
    out = common.arrow_schema(schema)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for b in batches:
            got = [sent.value.tag(x or "") for x in b.column(1).to_pylist()]
            spans = pa.array([[{"start": s, "end": e, "marginal": p} for s, e, p in found] for _, found in got], out.field("spans").type)
            yield common.batch_of(out, b.column(0), pa.array([sent.value.score(t) for t, _ in got], pa.float64()), spans)

    return common.in_arrow(src, work, schema, "toxicity")
