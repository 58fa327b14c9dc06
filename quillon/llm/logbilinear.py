"""Language-model scoring: a log-bilinear model trained in numpy with noise-contrastive estimation.

Token counts of all training documents come first: partial counts by task, then a grouping by token. The model
predicts a symbol from the three tokens before it. The ``SINGLE`` most frequent tokens are symbols of their
own; all others fall into ``CLASSES`` symbols by their last two bytes, and a token's share within its symbol
is its add-one count there. Context tokens have vectors of their own for the ``CONTEXT`` most frequent.

Training documents are dealt to shards of about ``SHARD_TOKENS`` tokens by hash, so that neither the shards nor the order
in them depends on how the table is laid out. Every shard trains from the same start (noise drawn from the symbols'
frequencies, AdaGrad steps over minibatches); the parameters are then averaged, weighted by tokens, in a
grouping by parameter row. Scoring multiplies whole batches of context vectors with all symbol vectors, so
log-probabilities are normalised. Tokens outside the ``HEAD`` most frequent, which all tasks know, are joined
with the counts through a shuffle, so counts of any size are exact.

Edge cases: null and empty texts are one end token; very long texts are trained on and scored whole, in minibatches; a
null doc_id is hashed as an empty text and takes part in training; without training documents the counts are empty and
the symbols equally likely; of tokens that are equally frequent the smaller ranks first; rows that repeat are scored
each; columns of the input other than doc_id and text are not used, so clashing names do no harm; empty tables give no
rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, session, text_bytes

#: Tokens that all tasks know with their counts (about 5 MB); the others are joined.
HEAD = 65_536
SINGLE = 128
CLASSES = 128
SYMBOLS = SINGLE + CLASSES
CONTEXT = 4096
#: Rows of context vectors: frequent tokens, classes of the others, and the start of a text.
CONTEXT_ROWS = CONTEXT + CLASSES + 1
WIDTH, ORDER, NOISE, STEP = 16, 3, 16, 0.1
MINIBATCH = 8192
#: Training tokens of a shard, and the most shards (then they grow).
SHARD_TOKENS, MOST_SHARDS = 2_000_000, 65_536
#: Rows of logits at once, so that they stay in a core's cache.
SCORED_ROWS = 1024
#: Tokens of texts that are encoded together.
TOGETHER = 200_000
END = b""
#: Tokens that a task counts before it passes its counts on.
COUNTED = 200_000


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def tail_class(token: bytes) -> int:
    return zlib.crc32(token[-2:]) % CLASSES


def count_tokens(training: DataFrame) -> DataFrame:
    """token (binary; empty: the end) and c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def passed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["token", "c"])
            counts.clear()
            return out

        for batch in batches:
            for text in text_bytes(batch.column(0)):
                counts.update(text.lower().split())
                counts[END] += 1
                if len(counts) >= COUNTED:
                    yield passed_on()
        yield passed_on()

    return training.select("text").mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent tokens, ``most`` at the very most: those above a count that a table of count classes gives."""
    step = F.floor(F.log2("c") * 64).cast("int")
    classes = sorted((r["k"], r["n"]) for r in counts.groupBy(step.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect())
    least, held = None, 0
    for k, n in reversed(classes):
        if held + n > most:
            break
        least, held = k, held + n
    return counts.filter(F.lit(False) if least is None else step >= least)


class Vocabulary:
    """Ranks of the frequent tokens and what follows from them; made once in a Python worker."""

    def __init__(self, tokens: list[bytes]):
        self.rank = {t: i for i, t in enumerate(tokens)}
        classes = np.array([tail_class(t) for t in tokens] or [0], np.int32)
        ranks = np.arange(len(classes))
        self.symbol = np.where(ranks < SINGLE, ranks, SINGLE + classes).astype(np.int32)
        self.context = np.where(ranks < CONTEXT, ranks, CONTEXT + classes).astype(np.int32)

    def encode(self, texts: list[list[bytes]]) -> Encoded:
        return Encoded(self, texts)


class Encoded:
    """Texts as one stream of tokens, an end after each: ranks (-1: rare), symbols, contexts, and the rare words."""

    def __init__(self, vocabulary: Vocabulary, texts: list[list[bytes]]):
        self.lengths = np.array([len(t) + 1 for t in texts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        stream: list[bytes] = []
        for words in texts:
            stream += words
            stream.append(END)
        self.ranks = ranks = np.fromiter(map(vocabulary.rank.get, stream, repeat(-1)), np.int32, len(stream))
        self.symbols, rows = vocabulary.symbol[ranks], vocabulary.context[ranks]
        self.rare_at = np.flatnonzero(ranks < 0)
        self.rare = [stream[i] for i in self.rare_at.tolist()]
        if self.rare:
            classes = np.array([tail_class(w) for w in self.rare], np.int32)
            self.symbols[self.rare_at], rows[self.rare_at] = SINGLE + classes, CONTEXT + classes
        self.contexts = contexts(rows, self.starts)

    def rare_by_text(self) -> pa.ListArray:
        """The distinct rare words of each text and how often it has them."""
        cuts = np.searchsorted(self.rare_at, [*self.starts.tolist(), len(self.ranks)]).tolist()
        words: list[bytes] = []
        times: list[int] = []
        offsets = [0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            held = Counter(self.rare[a:b])
            words += held
            times += held.values()
            offsets.append(len(words))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(times, pa.int64())], ["token", "n"]))


def together(texts: list[bytes]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The first text's index and the words of runs of texts with about TOGETHER tokens."""
    first, size, words = 0, 0, []
    for i, text in enumerate(texts):
        words.append(text.lower().split())
        size += len(words[-1]) + 1
        if size >= TOGETHER:
            yield first, words
            first, size, words = i + 1, 0, []
    if words:
        yield first, words


_vocabularies: dict[bytes, Vocabulary] = {}


def vocabulary_of(tokens: list[bytes]) -> Vocabulary:
    key = hashlib.sha256(b" ".join(tokens)).digest()  # tokens hold no space
    if key not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[key] = Vocabulary(tokens)
    return _vocabularies[key]


def contexts(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ORDER context rows before every token (n, ORDER), the nearest first; before a text's beginning stands the start."""
    out = np.full((len(rows), ORDER), CONTEXT_ROWS - 1, np.int32)
    for j in range(ORDER):
        out[j + 1 :, j] = rows[: len(rows) - j - 1]
    for j in range(ORDER):
        for k in range(j, ORDER):
            at = starts + j
            out[at[at < len(rows)], k] = CONTEXT_ROWS - 1
    return out


def spread(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of ``values`` by index."""
    columns = np.ascontiguousarray(values.T, dtype=np.float64)
    return np.stack([np.bincount(index, c, size) for c in columns], axis=1).astype(np.float32)


class Model:
    """Vectors of contexts and symbols, a weight vector per context place, and symbol biases."""

    def __init__(self, frequency: np.ndarray, seed: int = 3):
        r = np.random.RandomState(seed)
        self.noise = ((frequency + 1.0) / (frequency + 1.0).sum()).astype(np.float64)
        self.log_noise = np.log(NOISE * self.noise).astype(np.float32)
        self.parts = [
            (r.randn(CONTEXT_ROWS, WIDTH) * 0.1).astype(np.float32),
            (r.randn(SYMBOLS, WIDTH) * 0.1).astype(np.float32),
            np.full((ORDER, WIDTH), 1.0 / ORDER, np.float32),
            np.log(self.noise).astype(np.float32).reshape(SYMBOLS, 1),
        ]
        self.squares = [np.full(p.shape, 1e-3, np.float32) for p in self.parts]

    def predicted(self, context: np.ndarray) -> np.ndarray:
        vectors, _, places, _ = self.parts
        out = np.zeros((len(context), WIDTH), np.float32)
        for j in range(ORDER):
            out += vectors[context[:, j]] * places[j]
        return out

    def step(self, context: np.ndarray, target: np.ndarray, r: np.random.RandomState) -> None:
        """One noise-contrastive step over a minibatch; the noise sample is shared by its tokens."""
        vectors, symbols, places, bias = self.parts
        noise = r.choice(SYMBOLS, NOISE, p=self.noise)
        log_noise = self.log_noise
        seen = [vectors[context[:, j]] for j in range(ORDER)]
        q = sum(seen[j] * places[j] for j in range(ORDER))
        data = np.einsum("ij,ij->i", q, symbols[target]) + bias[target, 0] - log_noise[target]
        false = q @ symbols[noise].T + (bias[noise, 0] - log_noise[noise])
        up = 1 / (1 + np.exp(np.clip(data, -30, 30)))
        down = -1 / (1 + np.exp(-np.clip(false, -30, 30)))
        dq = up[:, None] * symbols[target] + down @ symbols[noise]
        gradients = [np.zeros_like(p) for p in self.parts]
        gradients[1] += spread(target, q * up[:, None], SYMBOLS)
        np.add.at(gradients[1], noise, down.T @ q)
        gradients[3][:, 0] += np.bincount(target, up, SYMBOLS)
        np.add.at(gradients[3][:, 0], noise, down.sum(axis=0))
        for j in range(ORDER):
            gradients[0] += spread(context[:, j], dq * places[j], CONTEXT_ROWS)
            gradients[2][j] += np.einsum("ij,ij->j", dq, seen[j])
        for p, g, s in zip(self.parts, gradients, self.squares, strict=True):
            g /= len(target)
            s += g * g
            p += STEP * g / np.sqrt(s)

    def log10_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Normalised log-probability of each target symbol."""
        _, symbols, _, bias = self.parts
        out = np.empty(len(target))
        ones, across = np.ones(SYMBOLS, np.float32), np.ascontiguousarray(symbols.T)
        for i in range(0, len(target), SCORED_ROWS):
            logits = self.predicted(context[i : i + SCORED_ROWS]) @ across
            logits += bias[:, 0]
            chosen = logits[np.arange(len(logits)), target[i : i + SCORED_ROWS]]
            if (top := float(logits.max())) > 60:
                logits -= logits.max(axis=1, keepdims=True) - np.float32(60)
                chosen = logits[np.arange(len(logits)), target[i : i + SCORED_ROWS]]
            assert np.isfinite(top)
            np.exp(logits, out=logits)
            out[i : i + SCORED_ROWS] = chosen - np.log((logits @ ones).astype(np.float64))
        return out / np.log(10)


def sharded(training: DataFrame, shards: int) -> DataFrame:
    """The texts, a partition a shard, in an order that follows from the rows alone."""
    content = F.xxhash64(F.col("text"))
    dealt = training.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int").alias("shard"))
    return dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("doc_id", content).select("text")


def train(training: DataFrame, head: list[bytes], frequency: np.ndarray) -> Model:
    """The average of the models that the shards trained, weighted by their tokens."""
    spark = training.sparkSession
    shards = int(min(MOST_SHARDS, max(1, frequency.sum() // SHARD_TOKENS)))
    shared = spark.sparkContext.broadcast((head, frequency))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, frequency = shared.value
        vocabulary, model, r = vocabulary_of(head), Model(frequency), np.random.RandomState(9)
        seen = 0
        for batch in batches:
            for _, words in together(text_bytes(batch.column(0))):
                found = vocabulary.encode(words)
                for i in range(0, len(found.ranks), MINIBATCH):
                    model.step(found.contexts[i : i + MINIBATCH], found.symbols[i : i + MINIBATCH], r)
                seen += len(found.ranks)
        for part, values in enumerate(model.parts if seen else []):
            n, width = values.shape
            flat = pa.array(np.pad(values, ((0, 0), (0, WIDTH - width))).ravel(), pa.float32())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, seen, np.int64)), pa.FixedSizeListArray.from_arrays(flat, WIDTH).cast(pa.list_(pa.float32()))], ["part", "line", "seen", "values"])

    rows = sharded(training, shards).mapInArrow(run, "part int, line int, seen long, values array<float>")
    mean = [(F.sum(F.col("seen") * F.col("values")[d]) / F.sum("seen")).alias(f"v{d}") for d in range(WIDTH)]
    model = Model(frequency)
    for row in rows.groupBy("part", "line").agg(*mean).collect():
        values = model.parts[row["part"]]
        values[row["line"]] = [row[f"v{d}"] for d in range(values.shape[1])]
    return model


SCORED = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<token: binary, n: long>>"


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = session(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    training = texts.filter(~held_out())
    counts = materialise(count_tokens(training), "counts")
    sums = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = sums["n"] or 0, sums["v"]
    top = sorted(frequent(counts, HEAD).collect(), key=lambda r: (-r["c"], bytes(r["token"])))
    head, head_counts = [bytes(r["token"]) for r in top], np.array([r["c"] for r in top] or [0], np.int64)
    single = head[:SINGLE]
    symbol = F.pmod(F.crc32(F.expr("substring(token, -2)")), F.lit(CLASSES)).cast("int")
    mass = {r["k"]: (r["m"], r["c"]) for r in counts.filter(~F.col("token").isin(*single)).groupBy(symbol.alias("k")).agg(F.sum(F.col("c") + 1).alias("m"), F.sum("c").alias("c")).collect()} if single else {}
    frequency = np.zeros(SYMBOLS)
    frequency[: len(single)] = head_counts[: len(single)]
    log_mass = np.zeros(SYMBOLS)
    log_mass[: len(single)] = np.log10(head_counts[: len(single)] + 1.0)
    for k, (m, c) in mass.items():
        frequency[SINGLE + k] = c
        log_mass[SINGLE + k] = np.log10(m + 1.0)
    model = train(training, head, frequency)
    shared = spark.sparkContext.broadcast((head, head_counts, log_mass, frequency, model.parts))
    log_all = float(np.log10(n + v + 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        head, head_counts, log_mass, frequency, parts = shared.value
        vocabulary, model = vocabulary_of(head), Model(frequency)
        model.parts = parts
        log_counts = np.append(np.log10(head_counts + 1.0), 0.0)  # rank -1, a rare word, is left to the join
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            for first, words in together(text_bytes(batch.column(1))):
                found = vocabulary.encode(words)
                known = log_counts[found.ranks]
                within = model.log10_probability(found.contexts, found.symbols) + known - log_mass[found.symbols]
                n_texts = len(words)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(uid, uid + n_texts)), batch.column(0).slice(first, n_texts), batch.column(2).slice(first, n_texts), pa.array(found.lengths),
                        pa.array(np.add.reduceat((found.ranks >= 0).astype(np.int64), found.starts)), pa.array(np.add.reduceat(known, found.starts) - log_all * found.lengths), pa.array(np.add.reduceat(within, found.starts)),
                        found.rare_by_text(),
                    ],
                    [x.split()[0] for x in SCORED.split(", ")[:7]] + ["rare"],
                )
                uid += n_texts

    scored = materialise(texts.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(run, SCORED), "scored")
    rare = scored.select("uid", F.explode("rare").alias("r")).select("uid", F.col("r.token").alias("token"), F.col("r.n").alias("times"))
    extra = rare.join(counts, "token").groupBy("uid").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more"))
    out = scored.drop("rare").join(extra, "uid", "left")
    more = F.coalesce(F.col("more"), F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"))
