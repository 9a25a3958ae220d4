"""Multi-state reweighting (MBAR) for many problems in one job.

A problem is a set of samples (key columns) with the reduced energies `u` of each sample in all K states. A group of
problems shares its samples, each problem holding some of them. The free energies are iterated as a table of one vector
per problem; each pass is one aggregation over the samples, packed into arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.numeric import half_even
from tidewater.operators.series import checked, drop_unequilibrated, indexed
from tidewater.schema import K_B, RUN, SERIES, STAGE
from tidewater.sources.scratch import settled

TOLERANCE, MOST_PASSES = 1e-9, 60
#: Points at which each neighbour difference is tried for the warm start.
POINTS = 128
#: No state moves further in one step; a step is halved until the objective falls by this share of what its slope promises.
FARTHEST, PROMISED = 20.0, 1e-4
#: Numbers that a task holds of its problems before it sends them on.
HELD = 1 << 22

Arrays = tuple[np.ndarray, ...]
COMBINE = {"sum": np.add, "low": np.minimum, "high": np.maximum, "log": np.logaddexp}


@dataclass
class Rows:
    """Some samples of one group: the sampled state of each and its energies in all states, and who holds which of them."""

    s: np.ndarray
    u: np.ndarray
    owner: np.ndarray | None
    at: np.ndarray | None

    @classmethod
    def of(cls, block: dict) -> Rows:
        s = np.frombuffer(block["_s"], np.int32)
        u = np.frombuffer(block["_u"]).reshape(len(s), -1)
        if block["_owner"] is None:
            return cls(s, u, None, None)
        return cls(s, u, np.frombuffer(block["_owner"], np.int32), np.frombuffer(block["_at"], np.int32))

    def held(self) -> Iterator[tuple[int, np.ndarray | slice]]:
        """Each problem that holds some of the rows, with these."""
        if self.owner is None:
            yield 0, slice(None)
            return
        # packed by problem, so that its rows stand together; no problem may hold any of them
        first = np.flatnonzero(np.diff(self.owner, prepend=-1))
        for a, e in zip(first, [*first[1:], len(self.owner)][: len(first)], strict=True):
            yield int(self.owner[a]), self.at[a:e]


def packed(samples: DataFrame, keys: list[str], state: str = "state", held: Column | None = None) -> DataFrame:
    """(keys, _s, _u, _owner, _at): the samples of each Arrow batch and group as one row of packed arrays.

    held, an array of numbers for each row, says which problems of its group the row belongs to; rows are not copied.
    """
    rows = samples.select(*keys, F.col(state).cast("int").alias("_s"), "u", (F.lit(None).cast("array<int>") if held is None else held).alias("_held"))
    kinds = T.StructType([samples.schema[k] for k in keys] + [T.StructField(c, T.BinaryType()) for c in ("_s", "_u", "_owner", "_at")])
    shared = held is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            group = b.select(keys).to_pandas().groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(group, kind="stable")
            u, own, s = b.column("u"), b.column("_held"), b.column("_s").to_numpy(zero_copy_only=False)
            size, flat = pc.fill_null(pc.list_value_length(u), -1).to_numpy(), u.values.to_numpy(zero_copy_only=False)
            offset, first = u.offsets.to_numpy(), np.flatnonzero(np.diff(group[order], prepend=-1))
            out: list[list] = [[], [], [], []]
            for at in np.split(order, first[1:]) if len(order) else []:
                k = size[at]
                if (k != k[0]).any() or not ((s[at] >= 0) & (s[at] < k[0])).all():
                    raise ValueError("energies and states of a problem do not match")
                owner, place = None, None
                if shared:
                    lists = own.take(pa.array(at))
                    owner = lists.flatten().to_numpy()
                    place = np.repeat(np.arange(len(at), dtype=np.int32), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
                    by = np.argsort(owner, kind="stable")
                    owner, place = owner[by].tobytes(), place[by].tobytes()
                for column, x in zip(out, (s[at].astype(np.int32).tobytes(), flat[offset[at][:, None] + np.arange(k[0])].astype(float).tobytes(), owner, place), strict=True):
                    column.append(x)
            names = pa.array(order[first])
            yield pa.RecordBatch.from_arrays([b.column(c).take(names) for c in keys] + [pa.array(x, pa.binary()) for x in out], [*keys, "_s", "_u", "_owner", "_at"])

    return rows.mapInArrow(run, kinds)


def sweep(blocks: DataFrame, state: DataFrame | None, keys: list[str], by: dict[str, str], work: Callable[[Rows, dict], Iterator[tuple[int, Arrays]]]) -> DataFrame:
    """(keys, _p, arrays named in `by`): what work makes of each block, combined by problem; every block is read once.

    state has a row of each group's present numbers, handed to work with the block. Tasks combine what their blocks give
    before they send it, and a problem's parts are combined as they arrive.
    """
    kinds = T.StructType([*(blocks.schema[k] for k in keys), T.StructField("_p", T.IntegerType()), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in by)])
    names, fold = [*keys, "_p", *by], [COMBINE[x] for x in by.values()]

    def joined(a: Arrays | None, b: Arrays) -> Arrays:
        return b if a is None else tuple(f(x, y) for f, x, y in zip(fold, a, b, strict=True))

    def made(held: dict[tuple, Arrays], types: list[pa.DataType]) -> pa.RecordBatch:
        columns = [pa.array([k[c] for k in held], t) for c, t in enumerate(types)]
        return pa.RecordBatch.from_arrays(columns + [pa.array([x[c].ravel().tolist() for x in held.values()], pa.list_(pa.float64())) for c in range(len(fold))], names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Arrays] = {}
        cells, types = 0, []
        for b in batches:
            types = [b.schema.field(k).type for k in keys] + [pa.int32()]
            for i in range(b.num_rows):
                block = {c: b.column(c)[i].as_py() for c in b.schema.names}
                key = tuple(block[k] for k in keys)
                for p, part in work(Rows.of(block), block):
                    cells += 0 if (*key, p) in held else sum(x.size for x in part)
                    held[*key, p] = joined(held.get((*key, p)), part)
                if cells > HELD:
                    yield made(held, types)
                    held, cells = {}, 0
        if held:
            yield made(held, types)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, key = None, None
        for b in batches:
            for i in range(b.num_rows):
                key = b.slice(i, 1).select([*keys, "_p"]) if key is None else key
                sums = joined(sums, tuple(np.array(b.column(c)[i].values) for c in by))
        if key is not None:
            yield pa.RecordBatch.from_arrays([*key.columns, *(pa.array([x.tolist()], pa.list_(pa.float64())) for x in sums)], names)

    source = blocks if state is None else blocks.join(state, keys)
    return source.mapInArrow(each, kinds).groupBy(*keys, "_p").applyInArrow(total, kinds)


def _weights(rows: Rows, at: np.ndarray | slice, f: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row d = ln sum_j N_j exp(f_j - u_j), and -u - d; states without samples add nothing to d."""
    u = rows.u[at]
    with np.errstate(divide="ignore"):
        terms = f + np.log(n) - u
    top = terms.max(axis=1, keepdims=True)
    d = top + np.log(np.exp(terms - top).sum(axis=1, keepdims=True))
    return d, -u - d


def _log_sums(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=0)
    return top + np.log(np.exp(x - top).sum(axis=0))


# The warm start: a chain of estimates between neighbours among a group's sampled states.


def _counts(rows: Rows, block: dict) -> Iterator[tuple[int, Arrays]]:
    """Samples by state, of each problem and of the group (-1); of the group also the extremes of u_b - u_a in samples of a, for all a and b."""
    k = rows.u.shape[1]
    low, high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
    for p, at in rows.held():
        yield p, (np.bincount(rows.s[at], minlength=k).astype(float), low[:0], high[:0])
    for a in np.unique(rows.s):
        own = rows.u[rows.s == a]
        own = own - own[:, [a]]
        low[a], high[a] = own.min(axis=0), own.max(axis=0)
    yield -1, (np.bincount(rows.s, minlength=k).astype(float), low, high)


def _pairs(n: np.ndarray) -> np.ndarray:
    """Neighbours among the states with samples."""
    some = np.flatnonzero(n > 0)
    return np.stack([some[:-1], some[1:]], axis=1)


def _differences(rows: Rows, n: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each pair of neighbours, the energy differences of the rows of the first and of those of the second."""
    for k, (a, b) in enumerate(_pairs(n)):
        low, high = rows.u[rows.s == a], rows.u[rows.s == b]
        yield k, low[:, b] - low[:, a], high[:, b] - high[:, a]


def _bracket(n: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the difference of each pair lies: within the extremes of both states' rows, widened by what unequal numbers can shift it."""
    (a, b), k = _pairs(n).T, len(n)
    low, high, ratio = low.reshape(k, k), high.reshape(k, k), n[a] / n[b]
    return np.minimum(low[a, b], -high[b, a]) - np.log1p(ratio), np.maximum(high[a, b], -low[b, a]) + np.log1p(1 / ratio)


def _tried(rows: Rows, block: dict) -> Iterator[tuple[int, Arrays]]:
    """At POINTS values of each pair's difference, by how much the first state's rows outweigh the second's."""
    n = np.array(block["all"])
    x, out = _points(n, block["low"], block["high"]), np.zeros((len(_pairs(n)), POINTS))
    for k, first, second in _differences(rows, n):
        out[k] = expit(x[k] - first[:, None]).sum(axis=0) - expit(second[:, None] - x[k]).sum(axis=0)
    yield 0, (out,)


def expit(x: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(x))
    return np.where(x > 0, 1, e) / (1 + e)


def _points(n: np.ndarray, low: list, high: list) -> np.ndarray:
    return np.linspace(*_bracket(n, np.array(low), np.array(high)), POINTS, axis=-1)


def _chain(n: np.ndarray, low: np.ndarray, high: np.ndarray, tried: np.ndarray) -> np.ndarray:
    """Free energies of all states by the neighbours' differences at which the rising sums pass zero; states without samples wait for the first step."""
    f, x, tried = np.zeros(len(n)), _points(n, low, high), tried.reshape(-1, POINTS)
    for k, (a, b) in enumerate(_pairs(n)):
        at = int(np.clip((tried[k] < 0).sum(), 1, POINTS - 1))
        rise = tried[k, at] - tried[k, at - 1]
        part = min(max(-tried[k, at - 1] / rise, 0.0), 1.0) if rise > 0 else 0.5
        f[b] = f[a] + x[k, at - 1] + part * (x[k, at] - x[k, at - 1]) + np.log(n[a] / n[b])
    return f


# Newton steps on the convex objective, with a line search.


def _derivatives(rows: Rows, block: dict) -> Iterator[tuple[int, Arrays]]:
    """Of each open problem: the objective (less the own energy of each row), ln sums of exp(-u - d), products of the weights."""
    problems = {x["_p"]: x for x in block["problems"]}
    for p, at in rows.held():
        if p in problems:
            f, n = np.array(problems[p]["f"]), np.array(problems[p]["n"])
            d, logs = _weights(rows, at, f, n)
            s, u = rows.s[at], rows.u[at]
            own = d[:, 0] - f[s] + u[np.arange(len(s)), s]
            some = np.flatnonzero(n > 0)
            w = np.exp(f[some] + logs[:, some])
            yield p, (np.array([own.sum()]), _log_sums(logs), w.T @ w)


@dataclass
class Search:
    """A problem on its way: the accepted point f0 with its objective, and the move from it that is being tried."""

    f: np.ndarray
    n: np.ndarray
    f0: np.ndarray
    move: np.ndarray
    value: float
    slope: float
    part: float
    done: bool

    def step(self, value: float, logs: np.ndarray, gram: np.ndarray) -> None:
        """Accepts f and takes the Newton direction from there, or halves the move."""
        some = np.flatnonzero(self.n > 0)
        rounding = 1e-12 * abs(self.value) + 1e-9
        if not np.isnan(self.value) and not value <= self.value + PROMISED * self.part * self.slope + rounding:
            self.part /= 2
            self.f = self.f0 + self.part * self.move
            return
        s = np.exp(self.f + logs)[some]
        n, free = self.n[some], np.arange(1, len(some))
        grad, hess = n * (s - 1), np.diag(n * s) - n[:, None] * gram.reshape(len(some), -1) * n
        move = np.zeros(len(self.n))
        if len(free):
            move[some[free]] = -np.linalg.lstsq(hess[np.ix_(free, free)], grad[free], rcond=None)[0]
        # what a Newton step leaves is of the order of its square; states without samples lag a step behind
        far = np.abs(move).max()
        self.done = bool((far if len(some) < len(self.n) else far * far) <= TOLERANCE)
        move *= min(1.0, FARTHEST / max(np.abs(move).max(), 1e-300))
        # states without samples follow the others, and are no part of the search
        self.f0 = np.where(self.n > 0, self.f, -logs)
        self.move, self.value, self.slope, self.part = move, value, float(grad @ move[some]), 1.0
        self.f = self.f0 + move


def solve(samples: DataFrame, keys: list[str] = RUN, state: str = "state", held: Column | None = None) -> DataFrame:
    """(keys, f array, n array, passes): dimensionless free energies of all states, the first one 0, and sample counts.

    samples has the sampled state's number and u. They are packed and written once; every pass reads them once, however
    many problems a row belongs to (see packed; with held the result has `problem`). A chain of estimates between
    neighbouring states, each from the samples of both, is where all problems of a group start; Newton steps with a line
    search on the convex objective follow. The free energies are a table of one row for each problem. Problems that have
    converged leave the passes; one that has not after MOST_PASSES fails the query, as do energies of different lengths or
    a state beyond them.
    """
    double, array = T.DoubleType(), T.ArrayType(T.DoubleType())
    blocks = settled(packed(samples, keys, state, held))
    counts = settled(sweep(blocks, None, keys, {"n": "sum", "low": "low", "high": "high"}, _counts))
    group = counts.where("_p = -1").select(*keys, F.col("n").alias("all"), "low", "high")

    @F.pandas_udf(array)
    def chain(n: pd.Series, low: pd.Series, high: pd.Series, tried: pd.Series) -> pd.Series:
        return pd.Series([_chain(*(np.asarray(x, float) for x in r)).tolist() for r in zip(n, low, high, tried, strict=True)])

    tried = sweep(blocks, group, keys, {"tried": "sum"}, _tried).drop("_p")
    start = counts.where("_p >= 0").select(*keys, "_p", "n").join(group.join(tried, keys).select(*keys, chain("all", "low", "high", "tried").alias("f")), keys)
    none = F.lit(None).cast(array)
    now = start.select(*keys, "_p", "f", "n", F.col("f").alias("f0"), none.alias("move"), F.lit(float("nan")).alias("value"), F.lit(0.0).alias("slope"), F.lit(1.0).alias("part"), F.lit(False).alias("done"), F.lit(0).alias("passes"))
    now = settled(now)

    searched = ["f", "n", "f0", "move", "value", "slope", "part", "done"]
    kinds = T.StructType([*(T.StructField(c, array) for c in searched[:4]), *(T.StructField(c, double) for c in searched[4:7]), T.StructField("done", T.BooleanType())])

    @F.pandas_udf(kinds)
    def stepped(f: pd.Series, n: pd.Series, f0: pd.Series, move: pd.Series, value: pd.Series, slope: pd.Series, part: pd.Series, obj: pd.Series, logs: pd.Series, gram: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, c, m, v, sl, pt, o, lg, g in zip(f, n, f0, move, value, slope, part, obj, logs, gram, strict=True):
            search = Search(np.array(a), np.array(b), np.array(c), np.zeros(len(a)) if m is None else np.array(m), v, sl, pt, False)
            search.step(float(o[0]), np.asarray(lg, float), np.asarray(g, float))
            out.append([x.tolist() if isinstance(x, np.ndarray) else x for x in (getattr(search, c) for c in searched)])
        return pd.DataFrame(out, columns=searched)

    for turn in range(MOST_PASSES + 1):
        left = now.where("not done")
        if turn and left.isEmpty():
            break
        if turn == MOST_PASSES:
            raise RuntimeError(f"reweighting has not converged within MOST_PASSES = {MOST_PASSES} passes")
        state_ = left.groupBy(*keys).agg(F.collect_list(F.struct("_p", "f", "n")).alias("problems"))
        sums = sweep(blocks, state_, keys, {"obj": "sum", "logs": "log", "gram": "sum"}, _derivatives)
        moved = left.join(sums, [*keys, "_p"]).withColumn("_m", stepped(*searched[:7], "obj", "logs", "gram"))
        now = settled(now.where("done").unionByName(moved.select(*keys, "_p", *(f"_m.{c}" for c in searched), (F.col("passes") + 1).alias("passes"))))
    out = now.select(*keys, F.col("_p").alias("problem"), F.transform("f", lambda x: x - F.col("f")[0]).alias("f"), "n", "passes")
    return out if held is not None else out.drop("problem")


def _products(rows: Rows, block: dict) -> Iterator[tuple[int, Arrays]]:
    f = np.array(block["f"])
    w = np.exp(f + _weights(rows, slice(None), f, np.array(block["n"]))[1])
    yield 0, (w.T @ w,)


def gram(samples: DataFrame, solved: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """(keys, i, j, value) of the K x K products of the sample weights, j >= i, summed over the samples."""
    rows = samples.withColumn("_none", F.lit(0))
    sums = sweep(packed(rows, keys, "_none"), solved.select(*keys, "f", "n"), keys, {"g": "sum"}, _products)
    k = F.sqrt(F.size("g").cast("double")).cast("int")
    cells = sums.select(*keys, k.alias("k"), F.posexplode("g").alias("at", "value")).select(*keys, F.floor(F.col("at") / F.col("k")).cast("int").alias("i"), (F.col("at") % F.col("k")).alias("j"), "value")
    return cells.where("j >= i")


def overlap(grams: DataFrame, solved: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """(keys, i, j, value): N_j times the Gram matrix; rows sum to 1."""
    full = grams.unionByName(grams.where("i < j").select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    return full.join(solved.select(*keys, "n"), keys).select(*keys, "i", "j", (F.col("value") * F.col("n")[F.col("j")]).alias("value"))


def covariance(grams: DataFrame, solved: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """(keys, i, j, d_f, err): all differences of free energies with their asymptotic errors, in reduced units.

    One row per problem holds its K x K matrix; its pseudo-inverse is taken there.
    """
    lists = grams.groupBy(*keys).agg(F.collect_list(F.struct("i", "j", "value")).alias("cells")).join(solved.select(*keys, "f", "n"), keys)

    @F.pandas_udf("array<double>")
    def errors(cells: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for c, counts in zip(cells, n, strict=True):
            k, g = len(counts), np.zeros((len(counts), len(counts)))
            for x in c:
                g[x["i"], x["j"]] = g[x["j"], x["i"]] = x["value"]
            values, v = np.linalg.eigh(g)
            s = np.sqrt(np.maximum(values, 0))
            inner = np.eye(k) - (s[:, None] * v.T) @ np.diag(counts) @ (v * s)
            theta = (v * s) @ np.linalg.pinv(inner, rcond=1e-10) @ (s[:, None] * v.T)
            d = np.diag(theta)
            out.append(np.sqrt(np.maximum(d[:, None] + d - 2 * theta, 0)).ravel().tolist())
        return pd.Series(out)

    rows = lists.withColumn("e", errors("cells", "n")).withColumn("k", F.size("n"))
    rows = rows.select(*keys, "f", "e", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i")).select(*keys, "f", "e", "k", "i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j"))
    return rows.select(*keys, "i", "j", (F.col("f")[F.col("j")] - F.col("f")[F.col("i")]).alias("d_f"), F.col("e")[F.col("i") * F.col("k") + F.col("j")].alias("err"))


def mbar(samples: DataFrame, temperature_k: float = 298.0, keys: list[str] = RUN, state: str = "state") -> DataFrame:
    """(keys, dg, err) in kcal/mol between the first and the last state."""
    solved = solve(samples, keys, state)
    return end_states(solved, gram(samples, solved, keys), temperature_k, keys)


def end_states(solved: DataFrame, grams: DataFrame, temperature_k: float = 298.0, keys: list[str] = RUN) -> DataFrame:
    """As mbar, of problems that are solved already."""
    k_t = K_B * temperature_k
    last = solved.select(*keys, (F.size("n") - 1).alias("j"))
    ends = covariance(grams, solved, keys).where("i = 0").join(last, [*keys, "j"])
    return ends.select(*keys, (F.col("d_f") * k_t).alias("dg"), (F.col("err") * k_t).alias("err"))


def pmf(solved: DataFrame, lambdas: Column, temperature_k: float = 298.0, keys: list[str] = RUN) -> DataFrame:
    """(keys, i, lam, pmf): the free energy of every state in kcal/mol; lambdas is the array of the states' lam."""
    return solved.select(*keys, F.posexplode(F.arrays_zip("f", lambdas.alias("lam"))).alias("i", "s")).select(*keys, "i", F.col("s.lam").alias("lam"), (F.col("s.f") * K_B * temperature_k).alias("pmf"))


def neighbour_slopes(pmfs: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """(keys, lam_mid, d_pmf, grad) between neighbouring states."""
    w = Window.partitionBy(*keys).orderBy("i")
    rows = pmfs.select(*keys, "i", ((F.col("lam") + F.lead("lam").over(w)) / 2).alias("lam_mid"), (F.lead("pmf").over(w) - F.col("pmf")).alias("d_pmf"), (F.lead("lam").over(w) - F.col("lam")).alias("d"))
    return rows.where("d is not null").select(*keys, "lam_mid", "d_pmf", (F.col("d_pmf") / F.col("d")).alias("grad"))


def holding(ranges: list[tuple[int, Column, Column]]) -> Column:
    """Of indexed rows: the problems (number, start, end) whose range of row fractions holds the row, as truncation by fractions keeps it."""
    held = F.array(*(F.struct(F.lit(p).alias("problem"), a.cast("double").alias("a"), b.cast("double").alias("b")) for p, a, b in ranges))
    low = lambda s: F.greatest(half_even(F.col("n") * s["a"]) - 1, F.lit(0.0))
    inside = F.filter(held, lambda s: (F.col("i") >= low(s)) & (F.col("i") <= half_even(F.col("n") * s["b"]) - 1))
    return F.transform(inside, lambda s: s["problem"])


def run_times(samples: DataFrame, timestep_ns: float = 1.0, keys: list[str] = STAGE) -> DataFrame:
    """(keys, run, total_ns): the simulated time of all windows of each run."""
    series = samples.groupBy(*keys, "lam", "run").agg(F.max("step").alias("_last"))
    return series.groupBy(*keys, "run").agg((F.sum("_last") * F.lit(timestep_ns)).alias("total_ns"))


def even_run_times(curves: DataFrame, samples: DataFrame, keys: list[str] = STAGE) -> DataFrame:
    """curves (keys, run, dg ...); a stage whose runs' times are not within 1 % of their mean fails the query."""
    mean = F.avg("total_ns").over(Window.partitionBy(*keys))
    even = run_times(samples, keys=keys).select(*keys, "run", (F.abs(F.col("total_ns") - mean) <= 1e-8 + 0.01 * F.abs(mean)).alias("_even"))
    return curves.join(even, [*keys, "run"]).withColumn("dg", checked(F.col("_even"), "the runs of a stage differ in time by more than 1 %", F.col("dg"))).drop("_even")


def block_mbar(samples: DataFrame, n_blocks: int = 100, start: float = 0.0, temperature_k: float = 298.0, keys: list[str] = STAGE, timestep_ns: float = 1.0, equil_ns: float = 0.0) -> DataFrame:
    """(keys, run, block, dg, time_ns): one estimate for each block of rows of the series after `start`.

    A block's time is that of its start, between the equilibration time of all windows, equil_ns, and the run's end.
    """
    return block_mbars(samples, n_blocks, [start], temperature_k, keys, timestep_ns, equil_ns).drop("fraction")


def block_mbars(samples: DataFrame, n_blocks: int, starts: list[float], temperature_k: float = 298.0, keys: list[str] = STAGE, timestep_ns: float = 1.0, equil_ns: float = 0.0) -> DataFrame:
    """block_mbar for several start fractions, told apart by `fraction`, in one solve."""
    cut = [(s, b, round(s + (1 - s) * b / n_blocks, 5), round(s + (1 - s) * b / n_blocks + (1 - s) / n_blocks, 5)) for s in starts for b in range(n_blocks)]
    held = holding([(p, F.lit(a), F.lit(e)) for p, (_, _, a, e) in enumerate(cut)])
    solved = solve(indexed(samples, [*keys, "lam", "run"]), [*keys, "run"], held=held)
    what = F.array(*(F.struct(F.lit(float(s)).alias("fraction"), F.lit(b).alias("block"), F.lit(a).alias("at")) for s, b, a, _ in cut))[F.col("problem")]
    rows = solved.join(run_times(samples, timestep_ns, keys), [*keys, "run"]).withColumn("_w", what)
    return rows.select(*keys, "run", "_w.fraction", "_w.block", (F.element_at("f", -1) * K_B * temperature_k).alias("dg"), ((F.col("total_ns") - equil_ns) * F.col("_w.at") + equil_ns).alias("time_ns"))


def _fractions(samples: DataFrame, fraction: float | DataFrame) -> tuple[DataFrame, list[str]]:
    """samples with the fraction of them to take, `_f`, and the keys by which a table of fractions gives it."""
    if isinstance(fraction, DataFrame):
        on = [c for c in fraction.columns if c != "fraction"]
        return samples.join(fraction.withColumnRenamed("fraction", "_f"), on), on
    return samples.withColumn("_f", F.lit(float(fraction))), []


def convergence(samples: DataFrame, cumulative: bool = True, fraction: float | DataFrame = 1.0, points: int = 20, temperature_k: float = 298.0, keys: list[str] = STAGE) -> DataFrame:
    """(keys, run, frac, dg) at each of `points` fractions of the run: over all rows up to it, or over its own block.

    fraction bounds the rows; as a table (some of the keys, fraction) it bounds those of each key. The runs of a stage
    have to agree in time to 1 %.
    """
    rows, _ = _fractions(samples, fraction)
    end = lambda p: F.round(F.col("_f") * p / points, 5)
    cut = [(p, F.lit(0.0) if cumulative else end(p - 1), end(p)) for p in range(1, points + 1)]
    solved = solve(indexed(rows, [*keys, "lam", "run"]), [*keys, "run", "_f"], held=holding(cut))
    curves = solved.select(*keys, "run", F.round(F.col("problem") * F.col("_f") / points, 5).alias("frac"), (F.element_at("f", -1) * K_B * temperature_k).alias("dg"))
    return even_run_times(curves, samples, keys)


def ti_convergence(samples: DataFrame, weights: DataFrame, cumulative: bool = True, fraction: float | DataFrame = 1.0, points: int = 20, keys: list[str] = STAGE) -> DataFrame:
    """As convergence, by thermodynamic integration: sums of blocks, each row read once."""
    series = [*keys, "lam", "run"]
    rows, _ = _fractions(samples, fraction)
    rows = indexed(rows, series)
    ends = [half_even(F.col("n") * F.round(F.col("_f") * p / points, 5)) for p in range(points + 1)]
    point = reduce(lambda a, p: F.when(F.col("i") < ends[p], F.lit(p)).otherwise(a), range(points, 0, -1), F.lit(None).cast("int"))
    sums = rows.withColumn("p", point).where("p is not null").groupBy(*series, "_f", "p").agg(F.sum("grad").alias("s"), F.count("*").alias("c"))
    if cumulative:
        w = Window.partitionBy(*series).orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("s", F.sum("s").over(w)).withColumn("c", F.sum("c").over(w))
    means = sums.join(weights.select(*keys, "lam", "weight"), [*keys, "lam"])
    curves = means.groupBy(*keys, "run", F.round(F.col("p") * F.col("_f") / points, 5).alias("frac")).agg(F.sum(F.col("s") / F.col("c") * F.col("weight")).alias("dg"))
    return even_run_times(curves, samples, keys)


def roll_up_convergence(curves: DataFrame, multipliers: DataFrame, child: str, keys: list[str], corrections: DataFrame | None = None) -> DataFrame:
    """(keys, run, frac, dg): children's curves added with their signs; corrections (child key, run, dg) are added to every point."""
    rows = curves.join(multipliers.select(child, "multiplier"), child)
    if corrections is not None:
        on = [c for c in corrections.columns if c != "dg"]
        rows = rows.join(corrections.withColumnRenamed("dg", "_corr"), on, "left").withColumn("dg", F.col("dg") + F.coalesce("_corr", F.lit(0.0)))
    return rows.groupBy(*keys, "run", "frac").agg(F.sum(F.col("dg") * F.col("multiplier")).alias("dg"))


def comparative_convergence(samples: DataFrame, weights: DataFrame | None = None, windows: DataFrame | None = None, timestep_ns: float = 1.0, energy_freq: int = 1, cumulative: bool = True, points: int = 20, keys: list[str] = STAGE, group: str = "calc") -> DataFrame:
    """(keys, run, frac, dg, time_ns): curves of several calculations, each cut to the shortest one's total time.

    With weights by integration, without by reweighting. With windows only equilibrated rows are taken, and the
    calculations' equilibration times, of all windows of a run, have to be equal to three places. Times are those of all
    runs together.
    """
    total = run_times(samples, timestep_ns, keys).groupBy(group).agg(F.sum("total_ns").alias("_t"), F.countDistinct("run").alias("_r"))
    if windows is None:
        spans = total.withColumn("_b", F.lit(0.0))
    else:
        equil = windows.groupBy(group).agg(F.sum("equil_time_ns").alias("_e"))
        known = total.join(equil, group)
        ends = known.agg((F.max(F.round("_e", 3)) == F.min(F.round("_e", 3))).alias("_same"))
        same = F.col("_same")
        spans = known.crossJoin(F.broadcast(ends)).withColumn("_b", checked(same, "equilibration times differ between calculations", F.col("_e") * F.col("_r")))
        samples = drop_unequilibrated(samples, windows, timestep_ns, energy_freq)
    least = F.col("_shortest")
    spans = spans.crossJoin(F.broadcast(spans.agg(F.min("_t").alias("_shortest"))))
    spans = settled(spans.select(group, "_t", "_b", ((least - F.col("_b")) / (F.col("_t") - F.col("_b"))).alias("fraction")))
    share = spans.select(group, "fraction")
    curves = convergence(samples, cumulative, share, points, keys=keys) if weights is None else ti_convergence(samples, weights, cumulative, share, points, keys)
    return curves.join(spans, group).select(*keys, "run", "frac", "dg", F.round(F.col("_b") + F.col("frac") * (F.col("_t") - F.col("_b")), 6).alias("time_ns"))
