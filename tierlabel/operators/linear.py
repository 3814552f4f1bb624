"""Linear classifier: TF-IDF features, one linear support vector machine per class, labels by lookup.

For each class k the weights minimise ``|w|^2 / 2 + C * sum of s_i * max(0, 1 - y_i w.x_i)^2`` (squared hinge,
one against the rest, the constant feature counted in ``|w|``). All classes share the Spark jobs of a step: tasks
give loss and gradient of their rows, which are added up per class; a task per group of classes and piece of the vocabulary then moves each
of them along its own quasi-Newton direction (limited-memory BFGS; Nocedal & Wright, Numerical Optimization; from the products of
its vectors alone, which pieces add up, as by Chen et al., Large-scale L-BFGS using MapReduce, 2014). Weights, gradients
and step histories are rows of a table in the shared folder; the driver sees the number of classes still moving.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tierlabel.operators.blocks import SCORE_CELLS
from tierlabel.operators.groups import class_table, first_per_class
from tierlabel.operators.pieces import CountedTexts, number_of_pieces, read_cell, read_vocabulary, smallest, store_vocabulary, weights_by_count
from tierlabel.operators.sparse import BIAS, BLOCK_BYTES, _divisor, _hashed, _parts_of_norm, best_reference
from tierlabel.operators.tables import lookup_join
from tierlabel.operators.tfidf import TfidfSettings, load_settings, save_settings, tfidf_fit
from tierlabel.session import scratch_path
from tierlabel.sources.folders import kept_until_the_end, remove

WEIGHT_CELLS = 250_000  # weights of one group of classes in one piece of the vocabulary: terms x classes
PIECE_TERMS = WEIGHT_CELLS // 4  # terms of a piece of the vocabulary, about
HELD_BYTES = 32 << 20  # training blocks that a task holds while the groups' weights pass by
FAN_IN = 4  # partial sums that a task reads at once
SUM_TASKS = 4  # tasks per core that sum up a pass, at most
MEMORY = 6  # steps that the quasi-Newton direction remembers


def label_lookup(items: DataFrame, taxonomy: DataFrame, class_col: str, prefix: str = "clf_") -> DataFrame:
    """Attach segment and family of a class by left join; the right side has one row per class."""
    lookup = first_per_class(taxonomy).select(
        F.col("ClassTitle").alias("__class"),
        F.col("SegmentTitle").alias(f"{prefix}segment"),
        F.col("FamilyTitle").alias(f"{prefix}family"),
    )
    return lookup_join(items, lookup, class_col, "__class").drop("__class")


def _training_blocks(rows: DataFrame, vocabulary: str, n_pieces: int, settings: TfidfSettings, max_terms: int) -> DataFrame:
    """Pack ``(class_id, copies, positive, tokens)`` rows into binary blocks of at most about ``max_terms`` terms.

    ``tokens`` are 64-bit hashes. A task holds texts of bounded size and reads the pieces of the vocabulary from the shared folder
    in turn, so that neither texts nor tokens are shuffled and no task holds the vocabulary. A block has its terms by piece, in small numbers:
    how often a text has a term, and one factor per text, from which the weights follow.
    """
    limit = HELD_BYTES

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def meet() -> Iterator[pa.RecordBatch]:
            norms, parts = [np.zeros(texts.n) for *_, texts in held], [[] for _ in held]
            for p in range(n_pieces):
                keys, idf = read_vocabulary(vocabulary, p, "keys"), read_vocabulary(vocabulary, p, "idf")
                for (*_, texts), norm, part in zip(held, norms, parts):
                    terms, counts, row, tf = texts.known(p, keys)
                    weight = weights_by_count(int(tf.max(initial=0)), settings.sublinear_tf)[tf] * np.repeat(idf[terms], counts)
                    norm += _parts_of_norm(row, weight, texts.n, settings.norm)
                    part.append((smallest(np.diff(terms, prepend=0)), counts, row, tf))
            for (label, copies, positive, _), norm, part in zip(held, norms, parts):
                packed = pickle.dumps((label, copies, positive, 1.0 / _divisor(norm, settings.norm), part))
                yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], names=["block"])

        for batch in batches:
            label, copies, positive = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            length = batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
            ends, lo = np.cumsum(length + 1), 0
            while lo < len(batch):
                done = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, done + max_terms, side="right")))
                texts = CountedTexts.of(length[lo:hi], batch.column(3).slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False), n_pieces)
                held.append((label[lo:hi].copy(), copies[lo:hi].copy(), positive[lo:hi].copy(), texts))
                size += texts.nbytes + 24 * texts.n
                lo = hi
                if size >= limit:
                    yield from meet()
                    held, size = [], 0
        if held:
            yield from meet()

    return rows.select("class_id", "copies", "positive", "tokens").mapInArrow(pack, "block binary")


class _Block:
    """A training block: per piece its terms in rising order, how many rows have each, these rows, and how often they have it."""

    def __init__(self, packed: bytes, sublinear: bool) -> None:
        self.label, self.copies, self.positive, self.scale, parts = pickle.loads(packed)
        self.parts = [(np.cumsum(steps, dtype=np.int32), counts, row, tf) for steps, counts, row, tf in parts]
        self.by_count = weights_by_count(max(int(tf.max(initial=0)) for *_, tf in parts), sublinear)

    def no_margins(self, n_classes: int) -> np.ndarray:
        return np.zeros((n_classes, len(self.label)))

    def add_margins(self, p: int, trial: np.ndarray, margins: np.ndarray) -> None:
        """What the terms of a piece add to the margins (classes x rows) before ``scale``; ``trial`` holds classes x terms."""
        terms, counts, row, tf = self.parts[p]
        weight, each, row = self.by_count[tf], np.repeat(terms.astype(np.intp), counts), row.astype(np.intp)
        for k, w in enumerate(trial):
            margins[k] += np.bincount(row, weights=w[each] * weight, minlength=margins.shape[1])

    def add_slopes(self, p: int, slopes: np.ndarray, sums: np.ndarray) -> None:
        """Add the gradient (classes x terms) of a piece's terms, given what its rows' scaled margins pull."""
        terms, counts, row, tf = self.parts[p]
        if not len(terms):
            return
        weight, first, row = self.by_count[tf], np.cumsum(counts, dtype=np.int64) - counts, row.astype(np.intp)
        for k, slope in enumerate(slopes):
            sums[k, terms] += np.add.reduceat(slope[row] * weight, first)

    def loss(self, margins: np.ndarray, constant: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Loss per class, and its slope by margin (classes x rows); ``classes`` are in rising order."""
        margin = margins * self.scale + constant[:, None]
        sign = np.full(margin.shape, -1.0)
        cost = np.repeat(self.copies[None, :], len(margin), axis=0)
        own = np.minimum(np.searchsorted(classes, self.label), len(classes) - 1)
        mine = np.flatnonzero(classes[own] == self.label)
        sign[own[mine], mine] = 1.0
        cost[own[mine], mine] *= self.positive[mine]
        short = np.maximum(0.0, 1.0 - sign * margin)
        return (cost * short * short).sum(axis=1), -2.0 * cost * short * sign


def _add_partials(folder: str, g: int, p: int, first_class: int, total: np.ndarray) -> None:
    """Add all partial sums of a piece of group ``g``, a few at a time, to ``total`` (terms and loss x classes); read in a task."""
    system, root = pafs.FileSystem.from_uri(folder)
    files = system.get_file_info(pafs.FileSelector(f"{root}/g={g}/p={p}", allow_not_found=True))
    for path in sorted(f.path for f in files if f.path.endswith(".parquet")):
        with system.open_input_file(path) as file:
            for batch in pq.ParquetFile(file).iter_batches(FAN_IN, columns=["k", "sums"]):
                for k, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                    terms, values = pickle.loads(packed.as_buffer())
                    total[terms, k - first_class] += values


def _partial_sums(blocks: DataFrame, state: str, sizes: list[int], n_classes: int, width: int, sublinear: bool) -> DataFrame:
    """Loss and gradient of each task's rows at the trial weights in ``state``: ``(k, g, p, sums)``, what is not zero, loss last.

    A task holds training blocks of bounded size, meets one group of classes after the other with them, and goes on. The margins of the
    held rows come piece by piece, then the sums do.
    """
    limit, last = HELD_BYTES, len(sizes) - 1

    def trial_of(g: int, p: int) -> tuple[np.ndarray, np.ndarray] | None:
        packed = read_cell(state, "trial", g=g, p=p)
        return pickle.loads(packed.as_buffer()) if packed.is_valid else None

    def packed_sums(g: int, p: int, classes: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k, found in zip(classes.tolist(), sums):
            terms = np.flatnonzero(found).astype(np.int32)
            if len(terms):
                sparse = pickle.dumps((terms, found[terms]))
                columns = [pa.array([x], pa.int64()) for x in (k, g, p)] + [pa.array([sparse], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "g", "p", "sums"])

    def one_piece(g: int, classes: np.ndarray, trial: np.ndarray, held: list[_Block]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(trial), sizes[0] + 1))  # the constant and the loss are last
        for block in held:
            margins = block.no_margins(len(trial))
            block.add_margins(0, trial, margins)
            loss, slopes = block.loss(margins, trial[:, -1], classes)
            sums[:, -2] += slopes.sum(axis=1)
            sums[:, -1] += loss
            block.add_slopes(0, slopes * block.scale, sums)
        yield from packed_sums(g, 0, classes, sums)

    def many_pieces(g: int, classes: np.ndarray, trial: np.ndarray, held: list[_Block]) -> Iterator[pa.RecordBatch]:
        margins = [block.no_margins(len(trial)) for block in held]
        for p in range(len(sizes)):
            trial = trial_of(g, p)[1] if p else trial
            for block, m in zip(held, margins):
                block.add_margins(p, trial, m)
        constant, ends = trial[:, -1], np.zeros((len(trial), 2))
        for i, block in enumerate(held):
            loss, slopes = block.loss(margins[i], constant, classes)
            ends += np.column_stack([slopes.sum(axis=1), loss])
            margins[i] = slopes * block.scale
        for p in range(len(sizes)):
            sums = np.zeros((len(trial), sizes[p] + 1))
            for block, slopes in zip(held, margins):
                block.add_slopes(p, slopes, sums)
            if p == last:
                sums[:, -2:] += ends
            yield from packed_sums(g, p, classes, sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def meet() -> Iterator[pa.RecordBatch]:
            for g in range(math.ceil(n_classes / width)):
                trial = trial_of(g, 0)
                if trial is not None:  # else every class of the group has stopped
                    classes, weights = trial
                    yield from (many_pieces if last else one_piece)(g, classes, weights, held)

        for batch in batches:
            for packed in batch.column(0):
                held.append(_Block(packed.as_py(), sublinear))
                size += len(packed.as_buffer()) + 8 * len(held[-1].label) * width * bool(last)  # and its margins
                if size >= limit:
                    yield from meet()
                    held, size = [], 0
        if held:
            yield from meet()

    return blocks.mapInArrow(run, "k long, g long, p long, sums binary")


def _products(vectors: list[np.ndarray]) -> np.ndarray:
    """The products of all pairs of vectors, for each class (column): classes x vectors x vectors."""
    by_class = np.ascontiguousarray(np.stack(vectors).transpose(2, 0, 1))
    return by_class @ by_class.transpose(0, 2, 1)


def _coefficients(products: np.ndarray) -> np.ndarray:
    """Two-loop recursion for all classes at once, in the products of the vectors alone: what each vector adds to the step.

    The vectors are past steps, the changes of the gradient that came with them, and the gradient. A pair without curvature is skipped per class.
    """
    n = products.shape[1] // 2
    q = np.zeros(products.shape[:2])
    q[:, -1] = 1.0
    sy = [products[:, i, n + i] for i in range(n)]
    rho = [np.where(x > 1e-12, 1.0 / np.where(x > 1e-12, x, 1.0), 0.0) for x in sy]
    alpha = {}
    for i in reversed(range(n)):
        alpha[i] = rho[i] * (products[:, i] * q).sum(axis=1)
        q[:, n + i] -= alpha[i]
    scale = np.ones(len(q))
    for i in range(n):  # the newest pair with curvature decides
        yy = products[:, n + i, n + i]
        scale = np.where(sy[i] > 1e-12, sy[i] / np.where(yy > 0, yy, 1.0), scale)
    q *= scale[:, None]
    for i in range(n):
        q[:, i] += alpha[i] - rho[i] * (products[:, n + i] * q).sum(axis=1)
    return q


def _direction(gradient: np.ndarray, steps: list[np.ndarray], changes: list[np.ndarray], products: np.ndarray | None = None) -> np.ndarray:
    """The quasi-Newton direction of all classes (columns); ``products`` are those over all terms, if these are some of them."""
    vectors = [*steps, *changes, gradient]
    found = np.zeros(gradient.shape)
    for part, vector in zip(_coefficients(_products(vectors) if products is None else products).T, vectors):
        found -= part * vector
    return found


@dataclass
class Descent:
    """Where the classes (columns) of one group are on their way down; each has its own step length and stops on its own.

    The rows are all terms or a piece of them. The pieces of a group take the same steps, since these follow from sums over all terms.
    """

    w: np.ndarray
    value: np.ndarray | None = None
    gradient: np.ndarray | None = None
    size: np.ndarray | None = None  # of the gradient, over all terms
    goal: np.ndarray | None = None
    direction: np.ndarray | None = None
    length: np.ndarray | None = None
    steps: list[np.ndarray] = field(default_factory=list)
    changes: list[np.ndarray] = field(default_factory=list)

    def __getstate__(self) -> dict:
        """Directions and past steps, which only shape the way, are kept in single precision; weights and gradient are not."""
        short = {name: [x.astype(np.float32) for x in getattr(self, name)] for name in ("steps", "changes")}
        return self.__dict__ | short | {"direction": None if self.direction is None else self.direction.astype(np.float32)}

    def __setstate__(self, state: dict) -> None:
        long = {name: [x.astype(np.float64) for x in state[name]] for name in ("steps", "changes")}
        self.__dict__ |= state | long | {"direction": None if state["direction"] is None else state["direction"].astype(np.float64)}

    def active(self) -> np.ndarray:
        if self.value is None:
            return np.ones(self.w.shape[1], bool)
        return self.size > self.goal

    def _move(self) -> np.ndarray:
        return np.where(self.active(), self.length, 0.0) * self.direction

    def trial(self) -> np.ndarray:
        """The weights at which the loss is wanted next."""
        return self.w if self.value is None else self.w + self._move()

    def sums(self, loss: np.ndarray, slopes: np.ndarray, c: float) -> list[np.ndarray]:
        """What a step has to know of all terms, given loss and its gradient at the trial weights; of pieces these add up."""
        at = self.trial()
        new = at + c * slopes
        move = [] if self.value is None else [self._move(), new - self.gradient, self.gradient]
        return [loss, (at * at).sum(axis=0), _products([*self.steps, *self.changes, *move, new])]

    def step(self, loss: np.ndarray, slopes: np.ndarray, c: float, tolerance: float, sums: list[np.ndarray] | None = None) -> bool:
        """Take loss and its gradient at the trial weights, and the sums over all pieces if this is one; whether a class has moved."""
        loss, squares, products = self.sums(loss, slopes, c) if sums is None else sums
        at = self.trial()
        new_value, new_gradient = 0.5 * squares + c * loss, at + c * slopes
        new_size = np.sqrt(products[:, -1, -1])
        if self.value is None:
            self.value, self.gradient, self.size = new_value, new_gradient, new_size
            self.goal, self.direction = tolerance * new_size, self._short(-new_gradient / np.maximum(1.0, new_size))
            self.length = np.ones(at.shape[1])
            return False
        move, active, n = self._move(), self.active(), len(self.steps)
        slope = products[:, 2 * n, 2 * n + 2]  # of the move and the gradient
        accepted = active & (new_value <= self.value + 1e-4 * slope)
        # a rejected class tries again from where it is, at the minimum of the parabola through both values
        curve = 2.0 * (new_value - self.value - slope)
        shrink = np.clip(-slope / np.where(curve > 0, curve, 1.0), 0.1, 0.5)
        self.length = np.where(accepted, 1.0, np.where(active, self.length * shrink, self.length))
        if accepted.any():
            self.steps = [*self.steps, np.where(accepted, move, 0.0)][-MEMORY:]
            self.changes = [*self.changes, np.where(accepted, new_gradient - self.gradient, 0.0)][-MEMORY:]
            products = products.copy()
            products[~accepted, 2 * n : 2 * n + 2] = 0.0
            products[~accepted, :, 2 * n : 2 * n + 2] = 0.0
            used = [*[*range(n), 2 * n][-MEMORY:], *[*range(n, 2 * n), 2 * n + 1][-MEMORY:], 2 * n + 3]
            found = _direction(new_gradient, self.steps, self.changes, products[:, used][:, :, used])
            self.direction = np.where(accepted, self._short(found), self.direction)
        self.w = np.where(accepted, at, self.w)
        self.value = np.where(accepted, new_value, self.value)
        self.gradient = np.where(accepted, new_gradient, self.gradient)
        self.size = np.where(accepted, new_size, self.size)
        return bool(accepted.any())

    @staticmethod
    def _short(direction: np.ndarray) -> np.ndarray:
        """As it is kept, so that the trial weights are those that the loss was taken at."""
        return direction.astype(np.float32).astype(np.float64)


_PLAIN = {"compression": "none", "parquet.enable.dictionary": "false"}  # numbers that neither pack nor repeat
_STATE = "g long, p long, state binary, trial binary, moving long"


def _state_rows(g: int, p: int, first_class: int, at: Descent, idf: np.ndarray, newest: bool | None) -> Iterator[pa.RecordBatch]:
    """The row of a group's piece, with the trial weights (classes x terms, times idf) of the classes that move.

    Past steps are in the state; unless ``newest`` is given, which says whether there is a newest step, as a row of its own.
    """
    active = np.flatnonzero(at.active())
    moving = len(active)
    trial = pickle.dumps((active + first_class, np.ascontiguousarray((idf[:, None] * at.trial()[:, active]).T))) if moving else None
    rows = [("state", pickle.dumps(at if newest is None else replace(at, steps=[], changes=[])), trial, 0 if p else moving)]
    if newest:
        rows.append(("step", pickle.dumps((at.steps[-1].astype(np.float32), at.changes[-1].astype(np.float32))), None, 0))
    for kind, state, weights, number in rows:
        columns = [pa.array([kind]), pa.array([g], pa.int64()), pa.array([p], pa.int64()), pa.array([state], pa.binary())]
        columns += [pa.array([weights], pa.binary()), pa.array([number], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["kind", "g", "p", "state", "trial", "moving"])


def _read_state(folder: str, history: list[str], g: int, p: int) -> Descent:
    """The state of a group's piece, and its past steps where those are tables of their own; read in a task."""
    at = pickle.loads(read_cell(f"{folder}/kind=state", "state", g=g, p=p).as_py())
    for older in history:
        packed = read_cell(f"{older}/kind=step", "state", g=g, p=p)
        if packed is not None:
            step, change = pickle.loads(packed.as_py())
            at.steps.append(step.astype(np.float64))
            at.changes.append(change.astype(np.float64))
    return at


def _solve(
    blocks: DataFrame, folder: str, vocabulary: str, sizes: list[int], n_classes: int, width: int, c: float, tolerance: float, max_passes: int, sublinear: bool
) -> str:
    """Move all classes until each has stopped; two jobs per pass, three if the vocabulary has pieces. Gives the folder of the last states.

    A pass reads the states of the one before from the shared folder and writes its own, so a lost executor costs a
    task. So do the partial sums, which are a table of their own and not a shuffle, whose files would stay. Older states and
    sums are removed. A group that has stopped is carried along and no longer compared with the rows.

    A task holds one piece of one group. The pieces of a group have to agree on their step: a job writes what each adds to the sums over
    all terms that the step follows from, and the next one adds these up in every task. Past steps of pieces are written once each.
    """
    spark = blocks.sparkSession
    n_pieces, n_groups = len(sizes), math.ceil(n_classes / width)
    split = n_pieces > 1

    def idf_of(p: int) -> np.ndarray:
        found = read_vocabulary(vocabulary, p, "idf")
        return np.append(found, 1.0) if p == n_pieces - 1 else found  # the constant is the last term of all

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield divmod(i, n_pieces)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, p in each(batches):
            at = Descent(np.zeros((sizes[p], min(width, n_classes - g * width))))
            yield from _state_rows(g, p, g * width, at, idf_of(p), False if split else None)

    def slopes_of(sums: str, g: int, p: int, at: Descent) -> tuple[np.ndarray, np.ndarray]:
        total = np.zeros((sizes[p] + 1, at.w.shape[1]))
        _add_partials(sums, g, p, g * width, total)
        return total[-1], total[:-1] * idf_of(p)[:, None]

    def step(before: str, sums: str) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g, p in each(batches):
                at = _read_state(before, [], g, p)
                if at.active().any():
                    at.step(*slopes_of(sums, g, p, at), c, tolerance)
                yield from _state_rows(g, p, g * width, at, idf_of(p), None)

        return run

    def parts_of_step(before: str, history: list[str], sums: str) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g, p in each(batches):
                at = _read_state(before, history, g, p)
                if at.active().any():
                    loss, slopes = slopes_of(sums, g, p, at)
                    columns = [pa.array([x], pa.int64()) for x in (g, p)]
                    columns += [pa.array([pickle.dumps(x)], pa.binary()) for x in (at.sums(loss, slopes, c), slopes)]
                    yield pa.RecordBatch.from_arrays(columns, names=["g", "p", "sums", "slopes"])

        return run

    def joint_step(before: str, history: list[str], parts: str) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g, p in each(batches):
                at, moved = _read_state(before, history, g, p), False
                if at.active().any():
                    totals = [sum(x) for x in zip(*(pickle.loads(read_cell(parts, "sums", g=g, p=i).as_py()) for i in range(n_pieces)))]
                    slopes = pickle.loads(read_cell(parts, "slopes", g=g, p=p).as_py())
                    moved = at.step(totals[0], slopes, c, tolerance, totals)
                yield from _state_rows(g, p, g * width, at, idf_of(p), moved)

        return run

    def written(states: DataFrame, number: int) -> int:
        seen = Observation()
        observed = states.observe(seen, F.sum("moving").alias("moving"))
        observed.write.partitionBy("kind", "g", "p").options(**_PLAIN).parquet(f"{folder}/{number}")
        return seen.get["moving"]

    places, schema = spark.range(0, n_groups * n_pieces, 1, n_groups * n_pieces), f"kind string, {_STATE}"  # a task per place
    together = blocks.coalesce(SUM_TASKS * spark.sparkContext.defaultParallelism)
    left = written(places.mapInArrow(start, schema), 0)
    number = 0
    while left and number <= max_passes:  # the first one finds where the classes start
        before, sums, parts = f"{folder}/{number}", f"{folder}/sums-{number}", f"{folder}/parts-{number}"
        history = [f"{folder}/{i}" for i in range(max(0, number + 1 - MEMORY), number + 1)]
        found = _partial_sums(together, f"{before}/kind=state", sizes, n_classes, width, sublinear)
        found.write.partitionBy("g", "p").options(**_PLAIN).parquet(sums)
        if split:
            found = places.mapInArrow(parts_of_step(before, history, sums), "g long, p long, sums binary, slopes binary")
            found.write.partitionBy("g", "p").options(**_PLAIN).parquet(parts)
            remove(spark, sums)
        left = written(places.mapInArrow(joint_step(before, history, parts) if split else step(before, sums), schema), number + 1)
        for done in (sums, parts, f"{before}/kind=state", before if not split else history[0] if len(history) == MEMORY else parts):
            remove(spark, done)
        number += 1
    for done in (*(f"{folder}/{i}" for i in range(max(0, number - MEMORY), number)), f"{folder}/{number}/kind=step"):
        remove(spark, done)
    if left:
        raise RuntimeError(f"{left} of {n_classes} classes have not converged in {max_passes} passes; allow more of them")
    return f"{folder}/{number}/kind=state"


def _weights(states: DataFrame, vocabulary: str, width: int) -> DataFrame:
    """``(class_id, key, weight)`` of the weights that are not zero; the constant has no key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, p, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                w, keys = pickle.loads(packed.as_py()).w, read_vocabulary(vocabulary, p, "keys")
                term, k = np.nonzero(w)
                known = np.append(keys, 0)[term]
                columns = [pa.array(k + g * width, pa.int64()), pa.array(known, pa.int64(), mask=term == len(keys)), pa.array(w[term, k])]
                yield pa.RecordBatch.from_arrays(columns, names=["class_id", "key", "weight"])

    return states.select("g", "p", "state").mapInArrow(run, "class_id long, key long, weight double")


def _stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The table in the shared folder, where it takes no memory and Spark knows its size; and its path."""
    path = kept_until_the_end(df.sparkSession, scratch_path(df.sparkSession, name))
    df.write.option("compression", "zstd").parquet(f"{path}/rows")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows"), path


@dataclass
class LinearModel:
    """A fitted classifier as tables: ``idf(token, idf)``, ``weights(class_id, token, weight)``, ``classes``."""

    settings: TfidfSettings
    idf: DataFrame | None = None
    weights: DataFrame | None = None
    classes: DataFrame | None = None

    @classmethod
    def fit(
        cls,
        train: DataFrame,
        text: str,
        label: str,
        settings: TfidfSettings = TfidfSettings(),
        c: float = 1.0,
        class_weight: str | None = None,
        tolerance: float = 1e-3,
        max_passes: int = 200,
        weight_cells: int = WEIGHT_CELLS,
        copies: str | None = None,
    ) -> LinearModel:
        """Fit on the texts and classes of ``train``; rows without a class are left out.

        Equal (text, class) rows become one row with their number as weight, which leaves the objective as
        it is; so ``train`` is read once. With a column ``copies`` a row counts as that many. ``class_weight='balanced'`` weighs the rows of a class, in its own problem, by
        n / (classes * rows of the class). Classes are moved in groups of at most ``weight_cells`` weights
        (at least one class) in each piece of the vocabulary, so that what a task holds depends on neither the rows nor the
        number of classes nor the vocabulary. The driver holds none of it.
        """
        if class_weight not in (None, "balanced"):
            raise ValueError("class_weight must be None or 'balanced'")
        spark = train.sparkSession
        each = F.lit(1) if copies is None else F.col(copies)
        rows = train.select(F.coalesce(F.col(text), F.lit("")).alias("__text"), F.col(label).alias("class_name"), each.alias("copies"))
        rows = rows.filter(F.col("class_name").isNotNull())
        distinct = rows.groupBy("__text", "class_name").agg(F.sum("copies").alias("copies"))
        distinct, texts = _stored(distinct, "linear-rows")
        n_rows, n_classes = distinct.agg(F.sum("copies"), F.count_distinct("class_name")).first()
        if not n_classes:
            raise ValueError("there are no training rows with a class")
        idf, _ = _stored(tfidf_fit(distinct, "__text", settings, "copies"), "linear-idf")
        classes, _ = _stored(class_table(distinct, "class_name", "class_id"), "linear-classes")
        positive = F.lit(float(n_rows)) / (F.lit(n_classes) * F.sum("copies")) if class_weight else F.lit(1.0)
        known = distinct.groupBy("class_name").agg(positive.alias("positive")).join(classes, "class_name")
        known, _ = _stored(known.withColumnRenamed("class_name", "__name"), "linear-positive")
        counted = lookup_join(distinct, known, "class_name", "__name", "inner")

        n_pieces = number_of_pieces(idf.count() + 1, PIECE_TERMS)
        folder = kept_until_the_end(spark, scratch_path(spark, "linear"))
        vocabulary, training = f"{folder}/training/vocabulary", f"{folder}/training/blocks"
        sizes = store_vocabulary(idf, n_pieces, vocabulary)
        sizes[-1] += 1  # the constant feature is the last term
        width = min(max(1, weight_cells // max(sizes)), n_classes)
        examples = counted.select(
            F.col("class_id"),
            F.col("copies").cast("double").alias("copies"),
            F.col("positive").cast("double").alias("positive"),
            _hashed(F.col("__text"), settings).alias("tokens"),
        )
        blocks = _training_blocks(examples, vocabulary, n_pieces, settings, max(1, SCORE_CELLS // max(4, width)))
        blocks.write.option("compression", "zstd").parquet(training)
        remove(spark, texts)
        solved = _solve(spark.read.parquet(training), folder, vocabulary, sizes, n_classes, width, c, tolerance, max_passes, settings.sublinear_tf)
        found = _weights(spark.read.schema(_STATE).parquet(solved), vocabulary, width)
        tokens = idf.select(F.xxhash64("token").alias("key"), "token")
        weights = found.join(tokens, "key", "left").select("class_id", F.coalesce("token", F.lit(BIAS)).alias("token"), "weight")
        return cls(settings, idf, weights.persist(), classes)

    def predict(
        self,
        items: DataFrame,
        text: str,
        taxonomy: DataFrame | None = None,
        prefix: str = "clf_",
        block_bytes: int = BLOCK_BYTES,
    ) -> DataFrame:
        """Items with the class of highest margin and, given a taxonomy, its segment and family."""
        if self.weights is None:
            raise ValueError("fit or load the model first")
        scored = best_reference(items, text, self.settings, self.idf, self.weights, "class_id", block_bytes)
        named = self.classes.select(F.col("class_id").alias("__id"), F.col("class_name").alias(f"{prefix}class"))
        found = lookup_join(scored, named, "__ref", "__id").select(*items.columns, f"{prefix}class")
        return found if taxonomy is None else label_lookup(found, taxonomy, f"{prefix}class", prefix)

    def save(self, path: str) -> None:
        if self.weights is None:
            raise ValueError("fit the model first")
        for name in ("idf", "weights", "classes"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        save_settings(self.idf.sparkSession, self.settings, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LinearModel:
        """Read a saved model with the settings it was fitted with."""
        return cls(load_settings(spark, path), *[spark.read.parquet(f"{path}/{name}") for name in ("idf", "weights", "classes")])
