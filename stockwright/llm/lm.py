"""Language-model scores of texts by a log-bilinear model over word classes.

Words are counted over all training texts.  The most frequent words are classes of their own, as is the end of a text;
all other words fall into classes by length.  The log-bilinear model predicts a class from the two before it: the
context's vectors, each turned by a matrix for its distance, add up to a vector whose product with a class's vector,
plus its bias, is the class's score.  It is fitted in numpy by noise-contrastive estimation on the counts of all class
triples of the corpus, a table bounded by the number of classes.  One batched matrix product over all contexts and a
normalisation give every log-probability.

Inside a class of several words, each word of at least ``SHARE`` of all tokens has a vector of its own, however many
there are: a word's score is the log of its smoothed count plus the product of the context's vector with its own.  These
vectors are fitted on every training token: tasks sum the context vectors before each word, and one Newton step of the
class's likelihood, shrunk by the word's count, gives its vector.  Rarer words back off to their smoothed counts.  The
normaliser of each class in every context is an exact sum over all its words.  So the probabilities of all words, unseen
ones included, add up to one in every context.

Frequent words' counts and vectors are broadcast: at most ``1 / SHARE`` words.  The rare words of a text are joined with
their exact counts by word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import fold, narrow, parts, slices, stored

#: A word with at least this share of the training tokens is looked up by broadcast.
SHARE = 1e-6
CLASSES = 96
#: Classes of other words, by length in bytes.
TAILS = 12
BYTES_A_TAIL = 2
SIZE = 16
NOISE = 32
STEPS = 1500
BATCH = 2048
RATE = 0.1
SEED = 9
SMOOTH = 0.1
#: A word's vector is half of its Newton step at so many tokens.
SHRINK = 50
#: Context vectors are summed in whole steps of this size, so that sums are the same in any order.
STEP = 2.0**-20
#: Words whose scores are held at once, for a row of contexts, when the normalisers are made.
HELD_SCORES = 50_000
#: Distinct words that a task holds before it passes on its counts.
HELD_WORDS = 400_000
END = ""


def tail(word: bytes) -> int:
    return min(len(word) // BYTES_A_TAIL, TAILS - 1)


def word_counts(texts: DataFrame) -> DataFrame:
    """``word``, ``c`` over the texts of ``texts``; the end of each text counts as the word ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])
            seen.clear()
            return made

        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                seen[b""] += 1
                for part in parts(t or b""):
                    seen.update(part.lower().split())
                if len(seen) > HELD_WORDS:
                    yield flush()
        yield flush()

    return texts.select("text").mapInArrow(run, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


class Codes(dict):
    """Place of a frequent word among the frequent ones; other words give -1 minus their tail class."""

    def __missing__(self, word: bytes) -> int:
        return -1 - tail(word)


class Lookup:
    """Frequent words with counts and classes."""

    def __init__(self, words: list[bytes], counts: np.ndarray):
        self.codes = Codes({w: i for i, w in enumerate(words)})
        self.counts = counts
        end = np.array([w == b"" for w in words], bool)
        own = np.flatnonzero(~end)[: CLASSES - TAILS - 1]
        self.classes = np.array([1 + tail(w) for w in words], np.int64)
        self.classes[end] = 0
        self.classes[own] = 1 + TAILS + np.arange(len(own))
        self.own = [words[i] for i in own]

    def encode(self, text: bytes) -> Iterator[np.ndarray]:
        """Codes of the words, in pieces, and at last of the end."""
        for part in parts(text):
            words = part.lower().split()
            yield np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        yield np.array([self.codes[b""]], np.int64)

    def classed(self, codes: np.ndarray) -> np.ndarray:
        """Classes of codes: 0 the end, 1 .. TAILS by length, then words of their own."""
        out = -codes
        known = codes >= 0
        out[known] = self.classes[codes[known]]
        return out


@lru_cache(maxsize=2)
def _lookup(key) -> Lookup:
    return Lookup(*key.value)


class _Key:
    """A broadcast that a worker's cache can tell by its number."""

    def __init__(self, broadcast, number: int):
        self.broadcast, self.number = broadcast, number

    @property
    def value(self):
        return self.broadcast.value

    def __hash__(self) -> int:
        return self.number

    def __eq__(self, other) -> bool:
        return isinstance(other, _Key) and self.number == other.number


def triples(texts: DataFrame, key: _Key) -> DataFrame:
    """``cell`` (two classes and the one that follows), ``n``; texts begin after two ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, total = _lookup(key), np.zeros(CLASSES**3, np.int64)
        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                last = np.zeros(2, np.int64)
                for codes in look.encode(t or b""):
                    c = np.r_[last, look.classed(codes)]
                    cells = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
                    if len(cells) > 50_000:
                        total += np.bincount(cells, minlength=CLASSES**3)
                    else:
                        np.add.at(total, cells, 1)
                    last = c[-2:]
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": there.astype(np.int32), "n": total[there]})

    return texts.select("text").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))


def fit(cells: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """The log-bilinear model, by noise-contrastive estimation on triples drawn by their counts; noise is drawn from
    the classes' frequencies.  The draws are seeded: equal counts give an equal model."""
    rng = np.random.default_rng(SEED)
    total = np.bincount(cells % CLASSES, weights=counts, minlength=CLASSES) if len(cells) else np.zeros(CLASSES)
    share = (total + SMOOTH) / (total + SMOOTH).sum()
    model = {"context": rng.normal(0, 0.1, (CLASSES, SIZE)), "target": rng.normal(0, 0.1, (CLASSES, SIZE)),
             "near": np.eye(SIZE) * 0.5, "far": np.eye(SIZE) * 0.25, "bias": np.log(share)}
    if not len(cells):
        return model
    order = np.argsort(cells)
    cells, mass = cells[order], np.cumsum(counts[order].astype(np.float64))
    model = {k: v.astype(np.float32) for k, v in model.items()}
    squares = {k: np.full(v.shape, 1e-3, np.float32) for k, v in model.items()}
    log_noise = np.log(NOISE * share).astype(np.float32)
    one = np.eye(CLASSES, dtype=np.float32)
    for step in range(STEPS):
        drawn = cells[np.searchsorted(mass, rng.random(BATCH) * mass[-1], side="right").clip(max=len(cells) - 1)]
        far, near, target = drawn // (CLASSES * CLASSES), drawn // CLASSES % CLASSES, drawn % CLASSES
        noise = rng.choice(CLASSES, NOISE, p=share)
        r_near, r_far = model["context"][near], model["context"][far]
        q = r_near @ model["near"] + r_far @ model["far"]
        t = model["target"][target]
        true = 1 / (1 + np.exp(-((q * t).sum(axis=1) + model["bias"][target] - log_noise[target]))) - 1
        false = 1 / (1 + np.exp(-(q @ model["target"][noise].T + model["bias"][noise] - log_noise[noise])))
        dq = true[:, None] * t + false @ model["target"][noise]
        hot = one[target]
        slope = {
            "target": hot.T @ (true[:, None] * q) + one[noise].T @ (false.T @ q),
            "bias": hot.T @ true + one[noise].T @ false.sum(axis=0),
            "near": r_near.T @ dq, "far": r_far.T @ dq,
            "context": one[near].T @ (dq @ model["near"].T) + one[far].T @ (dq @ model["far"].T),
        }
        pace = RATE * (1 - step / STEPS)
        for k, g in slope.items():
            g /= BATCH
            squares[k] += g * g
            model[k] -= np.float32(pace) * g / np.sqrt(squares[k])
    return {k: v.astype(np.float64) for k, v in model.items()}


def log_table(model: dict[str, np.ndarray]) -> np.ndarray:
    """log10 P(class | context) for every context (far * CLASSES + near) in one batched product."""
    q = (model["context"] @ model["far"])[:, None, :] + (model["context"] @ model["near"])[None, :, :]
    score = q.reshape(-1, SIZE) @ model["target"].T + model["bias"]
    score -= score.max(axis=1, keepdims=True)
    return (score - np.log(np.exp(score).sum(axis=1, keepdims=True))) / np.log(10)


def context_vectors(model: dict[str, np.ndarray]) -> np.ndarray:
    """The vector that predicts the next class, for every context (far * CLASSES + near)."""
    return ((model["context"] @ model["far"])[:, None, :] + (model["context"] @ model["near"])[None, :, :]).reshape(-1, SIZE)


def word_contexts(texts: DataFrame, key: _Key, steps) -> DataFrame:
    """``code`` of a frequent word that shares its class, and ``s0`` .. : the sums of the context vectors before it.

    ``steps`` is a broadcast of the context vectors in whole steps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, q = _lookup(key), steps.value
        total, seen = np.zeros((len(look.counts), SIZE), np.int64), np.zeros(len(look.counts), bool)
        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                last = np.zeros(2, np.int64)
                for codes in look.encode(t or b""):
                    c = np.r_[last, look.classed(codes)]
                    at = np.flatnonzero((codes >= 0) & (c[2:] > 0) & (c[2:] <= TAILS))
                    np.add.at(total, codes[at], q[c[at] * CLASSES + c[at + 1]])
                    seen[codes[at]] = True
                    last = c[-2:]
        there = np.flatnonzero(seen)
        for k in range(0, len(there), 20_000):
            some = there[k : k + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *[pa.array(total[some, j]) for j in range(SIZE)]],
                                             ["code", *[f"s{j}" for j in range(SIZE)]])

    names = [f"s{j}" for j in range(SIZE)]
    found = texts.select("text").mapInArrow(run, "code int, " + ", ".join(f"{n} bigint" for n in names))
    return found.groupBy("code").agg(*[F.sum(n).alias(n) for n in names])


def word_vectors(look: Lookup, codes: np.ndarray, sums: np.ndarray, q: np.ndarray, cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One row per frequent word: its vector, and a bias that leaves the word's mean share in its class as counted.

    ``sums`` are the context vectors before the words ``codes``; ``cells`` and ``counts`` all class triples, which give
    the mean and the spread of the contexts of a class.  Words with a class of their own have zeros.
    """
    out = np.zeros((len(look.counts), SIZE + 1))
    context, target = cells // CLASSES, cells % CLASSES
    for t in range(1, TAILS + 1):
        mine, words = target == t, codes[look.classes[codes] == t]
        if not len(words):
            continue
        share = counts[mine] / counts[mine].sum()
        mean = share @ q[context[mine]]
        off = q[context[mine]] - mean
        spread = (off * share[:, None]).T @ off
        n = look.counts[words][:, None].astype(float)
        shift = sums[look.classes[codes] == t] / n - mean
        ridge = spread + np.eye(SIZE) * (1e-3 * np.trace(spread) / SIZE + 1e-9)
        v = np.linalg.solve(ridge, (shift * n / (n + SHRINK)).T).T
        out[words, :SIZE] = v
        out[words, SIZE] = -(v @ mean) - 0.5 * np.einsum("wi,ij,wj->w", v, spread, v)
    return out.astype(np.float32).astype(float)


def normalisers(spark, key: _Key, sent, rare: np.ndarray) -> np.ndarray:
    """log10 of the summed weights of each class's words (columns) in every context (rows); made in tasks, a row of
    contexts at a time.  ``sent`` is a broadcast of context vectors and word vectors; ``rare`` the weight of each class's
    words without a vector, unseen ones included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, (q, v) = _lookup(key), sent.value
        groups = [np.flatnonzero(look.classes == t + 1) for t in range(TAILS)]
        for b in batches:
            for far in b.column(0).to_pylist():
                at = np.c_[q[far * CLASSES : (far + 1) * CLASSES], np.ones(CLASSES)]
                out = np.empty((CLASSES, TAILS))
                for t, words in enumerate(groups):
                    total = np.full(CLASSES, np.log(rare[t]))
                    for k in range(0, len(words), HELD_SCORES):
                        some = words[k : k + HELD_SCORES]
                        weight = at @ v[some].T + np.log(look.counts[some] + SMOOTH)
                        top = weight.max(axis=1)
                        total = np.logaddexp(total, top + np.log(np.exp(weight - top[:, None]).sum(axis=1)))
                    out[:, t] = total / np.log(10)
                yield pa.RecordBatch.from_arrays([pa.array([far], pa.int32()), pa.array([out.ravel().tolist()], pa.list_(pa.float64()))], ["far", "logs"])

    tasks = int(np.clip(len(_lookup(key).counts) // 2_000, 1, CLASSES))
    made = spark.range(0, CLASSES, 1, tasks).select(F.col("id").cast("int").alias("far")).mapInArrow(run, "far int, logs array<double>").toArrow()
    out = np.empty((CLASSES, CLASSES, TAILS))
    for far, logs in zip(made.column("far").to_pylist(), made.column("logs").to_pylist()):
        out[far] = np.reshape(logs, (CLASSES, TAILS))
    return out.reshape(-1, TAILS)


def score_texts(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (by
    smoothed word frequencies) and ``score`` (by the model), both log10 of the whole text's probability.

    Learned from the documents whose crc32 of the id as text, modulo 10, is not 0; a NULL id counts as the empty text.
    NULL texts are empty: their end is their only token.  Repeated rows each count and are each scored.  Without any
    training document all words are unknown and the model is flat.  An empty table gives no row.
    """
    spark = docs.sparkSession
    df = narrow(docs, doc_id=id, text=text)
    train = df.where(fold("doc_id", 10) != 0)
    counts = stored(word_counts(train), "lm-counts")
    n, v = (int(x or 0) for x in counts.agg(F.sum("c"), F.count(F.lit(1))).first())
    often = counts.where((F.col("c") >= F.lit(SHARE) * n) | (F.col("word") == END)).toArrow()
    found = sorted(zip(often.column("c").to_pylist(), often.column("word").to_pylist()), key=lambda x: (-x[0], x[1]))
    words, numbers = [w.encode() for _, w in found], np.array([c for c, _ in found], np.int64)
    key = _Key(spark.sparkContext.broadcast((words, numbers)), hash((spark.sparkContext.applicationId, id, n, v, len(words), counts.inputFiles()[0] if n else "")))
    look = Lookup(words, numbers)
    found = triples(train, key).toArrow()
    order = np.argsort(found.column("cell").to_numpy())
    cells, times = (found.column(c).to_numpy().astype(np.int64)[order] for c in ("cell", "n"))
    model = fit(cells, times)
    steps = np.round(context_vectors(model) / STEP).astype(np.int64)
    q = steps * STEP
    summed = word_contexts(train, key, spark.sparkContext.broadcast(steps)).toArrow()
    codes = summed.column("code").to_numpy()
    sums = np.column_stack([summed.column(f"s{j}").to_numpy() for j in range(SIZE)]) * STEP
    vectors = word_vectors(look, codes, sums, q, cells, times)

    own = spark.createDataFrame([(w.decode(),) for w in [b"", *look.own]], "word string")
    length = F.least(F.floor(F.octet_length("word") / BYTES_A_TAIL), F.lit(TAILS - 1)).cast("int")
    sizes = counts.join(F.broadcast(own), "word", "left_anti").groupBy(length.alias("t")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()
    tails = np.zeros((TAILS, 2))
    for r in sizes:
        tails[r["t"]] = r["c"], r["v"]
    shared = np.flatnonzero((look.classes > 0) & (look.classes <= TAILS))
    held = np.bincount(look.classes[shared] - 1, weights=look.counts[shared] + SMOOTH, minlength=TAILS)
    # at least the unseen word's weight: the difference of two sums is off by their rounding
    rest = np.maximum(tails[:, 0] + SMOOTH * (tails[:, 1] + 1) - held, SMOOTH)
    log_class = normalisers(spark, key, spark.sparkContext.broadcast((q, vectors)), rest)
    log_all = float(np.log10(n + SMOOTH * (v + 1)))
    end_known = bool(len(words)) and b"" in look.codes
    sent = spark.sparkContext.broadcast((model, log_class, q, vectors))
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, (model, log_class, q, vectors) = _lookup(key), sent.value
        inner = q, vectors, log_class
        table = log_table(model)
        log_count = np.log10(look.counts + SMOOTH)
        is_own = (look.classes > TAILS) | (look.classes == 0)
        row = TaskContext.get().partitionId() << 40
        for b in (x for whole in batches for x in slices(whole)):
            out = []
            for t in b.column(2).cast(pa.binary()).to_pylist():
                last, tokens, known, base, score = np.zeros(2, np.int64), 0, 0, 0.0, 0.0
                rare: Counter[bytes] = Counter()
                for part in parts(t or b""):
                    w = part.lower().split()
                    last, a = _add(look, table, inner, log_count, is_own, log_all, np.fromiter(map(look.codes.__getitem__, w), np.int64, len(w)), last)
                    rare.update([w[i] for i in np.flatnonzero(a[4]).tolist()])
                    tokens, known, base, score = tokens + a[0], known + a[1], base + a[2], score + a[3]
                if end_known:
                    last, a = _add(look, table, inner, log_count, is_own, log_all, np.array([look.codes[b""]]), last)
                    tokens, known, base, score = tokens + a[0], known + a[1], base + a[2], score + a[3]
                else:
                    tokens, base, score = tokens + 1, base + np.log10(SMOOTH) - log_all, score + table[last[0] * CLASSES + last[1], 0]
                out.append((row, tokens, known, base, score, list(rare), list(rare.values())))
                row += 1
            c = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[0], pa.int64()), b.column(0), b.column(1), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.float64()),
                 pa.array(c[4], pa.float64()), pa.array(c[5], pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array(c[6], pa.list_(pa.int32()))],
                ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "times"])

    scored = stored(df.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "text").mapInArrow(
        run, f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, rare array<string>, times array<int>"), "lm-scored")
    pairs = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    looked = pairs.join(counts.where(F.col("c") < F.lit(SHARE) * n), "word", "left").select("row", "times", F.coalesce("c", F.lit(0)).alias("c"))
    sums = looked.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + F.lit(SMOOTH))).alias("log_rare"),
                                     F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    rare = F.coalesce("log_rare", F.lit(0.0))
    return scored.drop("rare", "times").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + rare).alias("base_score"), (F.col("score") + rare).alias("score"))


def _add(look: Lookup, table, inner, log_count, is_own, log_all: float, codes: np.ndarray, last: np.ndarray):
    """The context after ``codes``, and: tokens, known ones, the two sums without rare words' counts, which are rare."""
    classes = look.classed(codes)
    c = np.r_[last, classes]
    rare = codes < 0
    often = codes[~rare]
    logs = log_count[often]
    score = table[c[:-2] * CLASSES + c[1:-1], classes].sum() + logs[~is_own[often]].sum()
    q, vectors, log_class = inner
    context = c[:-2] * CLASSES + c[1:-1]
    inside = np.flatnonzero((classes > 0) & (classes <= TAILS))
    score -= log_class[context[inside], classes[inside] - 1].sum()
    own = inside[codes[inside] >= 0]
    v = vectors[codes[own]]
    score += (np.einsum("ij,ij->", q[context[own]], v[:, :SIZE]) + v[:, SIZE].sum()) / np.log(10)
    return c[-2:], (len(codes), len(often), logs.sum() - log_all * len(codes), score, rare)
