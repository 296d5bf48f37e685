"""Detectability, train-on-synthetic utility and evaluation runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numeric import uniform
from ..functions.ranks import largest, running_totals
from ..session import cut
from . import fidelity as fi, series as se, synth as sy, trees as tr

# --- detection -----------------------------------------------------------------------------------------


def auc(scored: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve per key, from counts per distinct score; ties count half."""
    counts = scored.groupBy(*keys, F.col(score).alias("_s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    ranked = running_totals(counts, keys, "_s", ["p", "q"])
    wins = F.sum(F.col("p") * (F.col("q_before") + F.col("q") / 2.0))
    return ranked.groupBy(*keys).agg((wins / (F.max("p_total").cast("double") * F.max("q_total"))).alias("auc"))


#: Rows whose hash order one task sorts, rows dealt together and binned rows that are counted by number.
SHUFFLE_ROWS = 500_000
DEALT_ROWS = 1 << 17
NUMBERED = 1 << 20


def detection_report(both: DataFrame, columns: list[str], folds: int = 5, seed: int = 7, trees: int = 30, depth: int = 4, rate: float = 0.3,
                     repeats: int = 5) -> DataFrame:
    """How well boosted trees tell synthetic (side 1) from real rows on ``folds`` held-out folds.

    Sides are brought to equal size and folds drawn by hashed row numbers.  The models of all folds grow together, one scan
    of the rows per tree level.  Importance: the AUC lost when one column is taken from another row of the fold, the mean
    of ``repeats`` rotations; one pass scores every row as it is and with each column rotated.
    """
    sizes = {r.side: r.n for r in both.groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = min(sizes.get(0, 0), sizes.get(1, 0))
    if n < folds:
        raise ValueError(f"too few rows for {folds}-fold detection: {sizes.get(0, 0)} real, {sizes.get(1, 0)} synthetic")
    marked = both.select(F.col("side").cast("double").alias("label"), *[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(columns)])
    # a row is known by its values and the number of its copy, whatever the partitioning
    counted = marked.groupBy(*marked.columns).agg(F.count(F.lit(1)).alias("_n"))
    numbered = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "_n"))).withColumn(
        "_id", F.xxhash64(*marked.columns, "_copy")).drop("_n", "_copy")
    rows = cut(numbered.withColumns({"_u": uniform(seed, "detect", "_id"), "fold": F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(folds)).cast("int")}))
    names = [f"x{j}" for j in range(len(columns))]
    ready = cut(largest(rows.where("label = 0"), "_u", n, ["_id"]).unionByName(largest(rows.where("label = 1"), "_u", n, ["_id"])).drop("_u"))
    model = tr.fit(ready, names, "label", [tr.Spec(tr.LOGISTIC, without=f) for f in range(folds)], "fold", trees, rate, depth)
    counts = permuted_scores(ready, model, names, seed, repeats, -(-2 * n // folds))
    below = Window.partitionBy("fold", "variant").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)  # a row per step of the grid
    won = F.col("p") * (F.coalesce(F.sum("q").over(below), F.lit(0)) + F.col("q") / 2.0)
    share = F.sum("won") / (F.sum("p").cast("double") * F.sum("q"))
    ranked = counts.withColumn("won", won).groupBy("fold", "variant").agg(share.alias("auc"))
    found = {(r.fold, r.variant): r.auc for r in ranked.collect()}  # folds x (columns x repeats + 1) rows
    aucs = [found[f, 0] for f in range(folds)]
    lost = [np.mean([found[f, 0] - found[f, 1 + j * repeats + r] for f in range(folds) for r in range(repeats)]) for j in range(len(columns))]
    ranked = [columns[j] for j in sorted(range(len(columns)), key=lambda j: (-lost[j], j)) if lost[j] > 0][:3]
    return both.sparkSession.createDataFrame(
        [(round(float(np.mean(aucs)), 4), round(min(aucs), 4), round(max(aucs), 4), n, n, ", ".join(ranked))],
        "auc double, auc_low double, auc_high double, n_real bigint, n_synth bigint, top_columns string",
    ).withColumn("verdict", F.when(F.col("auc") < 0.6, "hard to distinguish").when(F.col("auc") <= 0.8, "distinguishable").otherwise("easily distinguished"))


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of at least ``rows`` rows, but for the last."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def hash_ranges(rows: DataFrame, payload: list[str], pack: Callable[[list[np.ndarray]], np.ndarray], names: list[str], seed: int, repeats: int, fold_rows: int) -> DataFrame:
    """``fold, v, g, block``: the rows of every fold in hash ranges ``g`` of about ``SHUFFLE_ROWS`` rows, once for each column
    and repeat (``v``: column * repeats + repeat, each with a hash order of its own).

    A block holds, for many rows, the hash, the ``_id`` and what ``pack`` makes of the columns ``payload``, bytes of equal
    length for each row: what is shuffled is a few blocks per task and range, and never a record per row."""
    ranges, keys = max(1, -(-fold_rows // SHUFFLE_ROWS)), len(names) * repeats

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _gathered(batches, DEALT_ROWS):
            columns = [c.to_numpy() for c in t.columns]
            fold, kept = columns[0].astype(np.int64), pack(columns[2 + keys :])
            made = np.empty(t.num_rows, np.dtype([("u", np.float64), ("id", np.int64), ("row", np.uint8, (kept.shape[1],))]))
            made["id"], made["row"] = columns[1], kept
            for v in range(keys):
                made["u"] = columns[2 + v]
                place = fold * ranges + np.floor(made["u"] * ranges).astype(np.int64)
                order = np.argsort(place, kind="stable")
                dealt, at = made[order], place[order]
                starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                ends = np.r_[starts[1:], len(at)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((at[starts] // ranges).astype(np.int32)), pa.array(np.full(len(starts), v, np.int32)), pa.array((at[starts] % ranges).astype(np.int32)),
                     pa.array([dealt[i:j].tobytes() for i, j in zip(starts, ends)], pa.binary())], ["fold", "v", "g", "block"])

    drawn = [uniform(seed, f"shuffle.{j}.{r}", "_id").alias(f"_u{j}_{r}") for j in range(len(names)) for r in range(repeats)]
    return rows.select("fold", "_id", *drawn, *payload).mapInArrow(deal, "fold int, v int, g int, block binary")


def _ordered(table: pa.Table) -> tuple[int, int, int, np.ndarray, np.ndarray]:
    """Fold, number of the order and range, and the ``_id`` and bytes of all rows of a range in hash order."""
    blocks = table.column("block").to_pylist()
    data = np.frombuffer(b"".join(blocks), np.uint8)
    fold, v, g = (table.column(c)[0].as_py() for c in ("fold", "v", "g"))
    width = int(table.column("width")[0].as_py())
    rows = data.view(np.dtype([("u", np.float64), ("id", np.int64), ("row", np.uint8, (width,))]))
    order = np.argsort(rows["u"], kind="stable")
    u = rows["u"][order]
    if (u[1:] == u[:-1]).any():
        order = np.lexsort((rows["id"], rows["u"]))
    return fold, v, g, rows["id"][order], rows["row"][order]


def _following(ends: DataFrame, first: str) -> DataFrame:
    """``ends`` (a row per range) with ``_next``: ``first`` of the next range, after the last that of the first one."""
    order = Window.partitionBy("fold", "v").orderBy("g")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return ends.withColumn("_next", F.coalesce(F.lead(first).over(order), F.first(first).over(whole)))


def rotated(rows: DataFrame, names: list[str], seed: int, repeats: int, fold_rows: int) -> DataFrame:
    """``_id`` and ``taken``: for every column and repeat the value that another row of the fold gives.

    In the hash order of each (fold, column, repeat) every row takes the value of the one after it: inside a hash range
    of ``hash_ranges``, from one range to the next and from the last to the first by the ranges' first values.
    """
    width = 8 * len(names)

    def pack(columns: list[np.ndarray]) -> np.ndarray:
        return np.ascontiguousarray(np.column_stack(columns).astype(np.float64)).view(np.uint8)

    def run(table: pa.Table) -> pa.Table:
        fold, v, g, ids, packed = _ordered(table)
        x = np.ascontiguousarray(packed).view(np.float64)[:, v // repeats]
        some = np.r_[False, np.ones(len(x) - 1, bool)]
        return pa.table({"fold": pa.array(np.full(len(x), fold, np.int32)), "v": pa.array(np.full(len(x), v, np.int32)), "g": pa.array(np.full(len(x), g, np.int32)),
                         "_id": ids, "x": pa.array(np.r_[x[1:], 0.0], mask=~np.r_[some[1:], False]), "first": pa.array(np.full(len(x), x[0]))})

    dealt = hash_ranges(rows, [F.col(c).cast("double").alias(c) for c in names], pack, names, seed, repeats, fold_rows)
    moved = cut(dealt.withColumn("width", F.lit(width)).groupBy("fold", "v", "g").applyInArrow(run, "fold int, v int, g int, _id bigint, x double, first double"))
    last = _following(moved.where(F.col("x").isNull()), "first").select("_id", "v", F.col("_next").alias("x"))
    taken = moved.where(F.col("x").isNotNull()).select("_id", "v", "x").unionByName(last)
    return taken.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("v", "x"))).alias("_t")).select("_id", F.col("_t.x").alias("taken"))


def _distinct(rows: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of small numbers (column j below ``sizes[j]``) and how often each comes."""
    if int(np.prod([float(n) for n in sizes])) <= NUMBERED:
        steps = np.cumprod([1, *sizes[:-1]])
        number = np.zeros(len(rows), np.int64)
        for j, step in enumerate(steps):
            number += rows[:, j].astype(np.int64) * step
        n = np.bincount(number)
        there = np.flatnonzero(n)
        return np.column_stack([there // step % size for step, size in zip(steps, sizes)]).astype(np.uint8), n[there]
    same, n = np.unique(np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1]))).ravel(), return_counts=True)
    return np.frombuffer(same.tobytes(), np.uint8).reshape(-1, rows.shape[1]), n


def permuted_scores(rows: DataFrame, model: tr.Ensemble, names: list[str], seed: int, repeats: int, fold_rows: int) -> DataFrame:
    """``fold, variant, score, p, q``: synthetic and real rows by score, to four decimals, where each row is scored by its
    fold's model as it is (variant 0) and with column j taken from the r-th rotation (variant 1 + j * repeats + r).

    A rotation is that of ``rotated``: in the hash order of (fold, column, repeat) a row takes the value of the one after it.
    The model sees bins only, so a row's bins and label go to each of its hash ranges, and are not joined back.  Tasks
    score each distinct binned row of a range once and count equal scores before the shuffle."""
    sent, width = rows.sparkSession.sparkContext.broadcast(model), len(names)
    sizes = [*[len(b) + 1 for b in model.borders], 2]

    def pack(columns: list[np.ndarray]) -> np.ndarray:
        bins = tr.binned(np.column_stack(columns[1:]).astype(float), sent.value.borders)
        return np.ascontiguousarray(np.vstack([bins, (columns[0] == 1).astype(np.uint8)[None, :]]).T)

    def counted(fold: int, variant: int, packed: np.ndarray) -> dict:
        same, n = _distinct(packed, sizes)
        score = sent.value.linked(np.ascontiguousarray(same[:, :width].T), [fold])[0]
        key, place = np.unique(np.rint(score * 10_000).astype(np.int32), return_inverse=True)
        p, q = (np.bincount(place, weights=n * (same[:, width] == side), minlength=len(key)).astype(np.int64) for side in (1, 0))
        return {"fold": np.full(len(key), fold, np.int32), "variant": np.full(len(key), variant, np.int32), "score": key, "p": p, "q": q}

    counts = "fold int, variant int, score int, p bigint, q bigint"

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _gathered(batches, DEALT_ROWS):
            fold, *columns = [c.to_numpy() for c in t.columns]
            packed = pack(columns)
            for f in np.unique(fold):
                yield pa.RecordBatch.from_pydict(counted(int(f), 0, packed[fold == f]))

    def inside(table: pa.Table) -> pa.Table:
        fold, v, g, _, packed = _ordered(table)
        moved = packed[:-1].copy()
        moved[:, v // repeats] = packed[1:, v // repeats]
        found = pa.table(counted(fold, 1 + v, moved)) if len(moved) else pa.table({n: pa.array([], k) for n, k in zip(("fold", "variant", "score", "p", "q"), (pa.int32(),) * 3 + (pa.int64(),) * 2)})
        for name, value, kind in (("v", None, pa.int32()), ("g", None, pa.int32()), ("first", None, pa.binary()), ("last", None, pa.binary())):
            found = found.append_column(name, pa.array([value] * found.num_rows, kind))
        end = {"fold": [fold], "variant": [None], "score": [None], "p": [None], "q": [None], "v": [v], "g": [g], "first": [packed[0].tobytes()], "last": [packed[-1].tobytes()]}
        return pa.concat_tables([found, pa.table(end, schema=found.schema)])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for fold, v, last, following in zip(*[c.to_pylist() for c in b.columns]):
                moved = np.frombuffer(last, np.uint8)[None, :].copy()
                moved[0, v // repeats] = following[v // repeats]
                yield pa.RecordBatch.from_pydict(counted(fold, 1 + v, moved))

    payload = [F.col("label"), *[F.col(c) for c in names]]
    dealt = hash_ranges(rows, payload, pack, names, seed, repeats, fold_rows).withColumn("width", F.lit(width + 1))
    scored = cut(dealt.groupBy("fold", "v", "g").applyInArrow(inside, f"{counts}, v int, g int, first binary, last binary"))
    ends = _following(scored.where(F.col("v").isNotNull()).select("fold", "v", "g", "first", "last"), "first")  # a row per range
    every = rows.select("fold", *payload).mapInArrow(plain, counts).unionByName(scored.where(F.col("v").isNull()).select("fold", "variant", "score", "p", "q")).unionByName(
        ends.select("fold", "v", "last", "_next").mapInArrow(across, counts))
    return every.groupBy("fold", "variant", "score").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))


# --- train on synthetic, test on real ----------------------------------------------------------------------


def tstr(series: DataFrame, period: int, test_frac: float = 0.3, seed: int = 7, together: bool = False) -> DataFrame:
    """Per key: error on the real tail of a seasonal-linear model trained on the real and on a synthetic head.

    A key's points are read once: its head is fitted, the synthetic head drawn from the fit in the key's own row, and both
    models trained there.  ``together``: a key's points follow each other already."""

    def split_of(n: int) -> int:
        split = max(2 * period + 2, int(np.floor(n * (1 - test_frac))))
        return split if split < n - 1 else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made: list[list] = [[] for _ in range(7)]
            for key, length, real, drawn in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                split = split_of(length)
                y, s = (x.values.to_numpy(zero_copy_only=False).astype(float) for x in (real, drawn))
                errors, full = [], []
                for train in (y[:split], s):
                    x, target = se.design(train, period)
                    w, _, rank, _ = np.linalg.lstsq(x, target, rcond=None)
                    errors.append(float(np.abs(se.predictions(w, np.arange(split, len(y)), period, y) - y[split:]).mean()))
                    full.append(bool(rank < x.shape[1]))
                for held, new in zip(made, (key, split, len(y) - split, *errors, *full)):
                    held.append(new)
            yield pa.RecordBatch.from_arrays([pa.array(made[0], pa.string()), *[pa.array(m, pa.int64()) for m in made[1:3]], *[pa.array(m, pa.float64()) for m in made[3:5]], *[pa.array(m, pa.bool_()) for m in made[5:]]], names)

    names = ["key", "train_len", "test_len", "trtr_mae", "tstr_mae", "trtr_rank_deficient", "tstr_rank_deficient"]
    heads = sy.fitted_heads(series, period, split_of, together)
    fakes = sy.drawn_heads(heads, period, seed).select(F.col("key").cast("string"), "length", "values", "drawn")
    out = fakes.mapInArrow(run, "key string, train_len bigint, test_len bigint, trtr_mae double, tstr_mae double, trtr_rank_deficient boolean, tstr_rank_deficient boolean")
    return out.withColumn("ratio", F.try_divide("tstr_mae", "trtr_mae"))


# --- evaluation run --------------------------------------------------------------------------------------


def side_by_side(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Real and synthetic rows in one table: ``side`` 0 and 1, and the origin by name."""
    return real.withColumns({"side": F.lit(0), "origin": F.lit("real")}).unionByName(
        synthetic.withColumns({"side": F.lit(1), "origin": F.lit("synthetic")}))


def evaluate_table(real: DataFrame, columns: list[str], kinds: dict[str, str], generator: str | Callable[..., DataFrame], seed: int = 7,
                   detection: bool = True, **options) -> DataFrame:
    """Fit, sample, check and score a table generator (a built-in name or a user's function) in one row."""
    real = cut(real.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna())
    make = sy.TABLE_GENERATORS[generator] if isinstance(generator, str) else generator
    synthetic = cut(make(real, columns, kinds=kinds, seed=seed, **options).select(*columns))
    bad = sy.check_sample(synthetic, columns).first()
    if any(bad):
        raise ValueError(f"the synthesizer returned values that are not finite: {bad.asDict()}")
    both = cut(side_by_side(real, synthetic))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    name = generator if isinstance(generator, str) else generator.__name__
    fidelity = fi.table_fidelity(both, columns, pairs).select("column_shape_score", "pair_trend_score", "overall")
    parts = [fidelity, fi.privacy_report(both, columns).drop("n_synth", "dims").withColumnRenamed("verdict", "privacy_verdict")]
    if detection:
        parts.append(detection_report(both, columns).withColumnRenamed("verdict", "detection_verdict"))
    values = {}
    for part in parts:  # one row each
        values.update(part.first().asDict())
    schema = "generator string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for p in parts for f in p.schema.fields)
    return real.sparkSession.createDataFrame([(name, *values.values())], schema)


def evaluate_series(series: DataFrame, period: int, seed: int = 7) -> DataFrame:
    """Seasonal-profile synthesis of every key's series scored for fidelity."""
    fake = sy.sample_seasonal(sy.fit_seasonal(series, period), period, None, seed)
    both = series.select("key", "i", "value", F.lit(0).alias("side")).unionByName(fake.select("key", "i", "value", F.lit(1).alias("side")))
    return fi.series_fidelity(both, period)
