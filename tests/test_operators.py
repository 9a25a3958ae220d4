"""Operators against numpy and closed forms."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewater.functions import distributions as dist
from tidewater.functions import ranges
from tidewater.operators import agreement, autocorrelation, equilibration, estimator, geometry, rollup, schedule, series, statistics
from tidewater.plans import analyse, queries
from tidewater.schema import COORDS
from tidewater.sources import sinks
from tidewater.sources.tables import LAM


def make(spark, arrays, lams=None):
    """samples from {(lam index, run): values}."""
    rows = [("c", "free", "s", float(lams[k] if lams else k), r, (i + 1) * 100, float(v)) for (k, r), x in arrays.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "calc string, leg string, stage string, lam double, run int, step long, grad double")


def inefficiency(x, fast=False, mintime=3):
    n, d = len(x), x - x.mean()
    s2, g, t, inc = (d * d).mean(), 1.0, 1, 1
    while t < n - 1:
        c = 2 * (d[: n - t] * d[t:]).sum() / (2.0 * (n - t) * s2)
        if c <= 0 and t > mintime:
            break
        g += 2 * c * (1 - t / n) * inc
        t += inc
        inc += int(fast)
    return max(g, 1.0)


def ar1(rng, a, n):
    x = np.zeros(n)
    for i in range(1, n):
        x[i] = a * x[i - 1] + rng.normal()
    return x


@pytest.mark.parametrize("fast", [False, True])
def test_inefficiency(spark, fast):
    rng = np.random.default_rng(1)
    data = {(0, r): ar1(rng, a, n) for r, (a, n) in enumerate([(0.0, 50), (0.5, 400), (0.9, 900), (0.97, 600), (0.3, 4), (0.2, 2)], 1)}
    got = {r.run: r.g for r in autocorrelation.statistical_inefficiency(make(spark, data), fast=fast).collect()}
    assert got == pytest.approx({r: inefficiency(x, fast) for (_, r), x in data.items()}, rel=1e-9)


def test_inefficiency_of_ar1_and_constants(spark):
    x = ar1(np.random.default_rng(2), 0.5, 20000)
    assert autocorrelation.statistical_inefficiency(make(spark, {(0, 1): x})).first().g == pytest.approx(3, rel=0.15)
    with pytest.raises(PySparkException):
        autocorrelation.statistical_inefficiency(make(spark, {(0, 1): np.ones(30)})).collect()


def test_chodera(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.linspace(8, 0, 40), np.zeros(160)]) + rng.normal(size=200)
    got = autocorrelation.chodera_windows(make(spark, {(0, 1): x, (1, 1): np.ones(50)}), ["lam"]).collect()
    got = {r.lam: r for r in got}
    tried = [(len(x) - t + 1) / inefficiency(x[t:], fast=True) for t in range(len(x) - 1)]
    assert got[0.0].t0 == int(np.argmax(tried)) and got[0.0].n_eff == pytest.approx(max(tried)) and got[0.0].equilibrated
    assert (got[1.0].t0, got[1.0].g, got[1.0].n_eff, got[1.0].equilibrated) == (0, 1.0, 1.0, False)


def test_truncation_goldens(spark):
    df = make(spark, {(0, 1): np.arange(100)})
    steps = lambda a, b: sorted(r.step for r in series.truncate_fraction(df, a, b).collect())
    assert steps(0.0, 0.1) == list(range(100, 1001, 100))
    assert steps(0.5, 0.9) == list(range(5000, 9001, 100))
    for a, b in ((0.5, 0.5), (-0.1, 1), (0, 1.1)):
        with pytest.raises(ValueError):
            series.truncate_fraction(df, a, b)


def test_blocks(spark):
    rng = np.random.default_rng(4)
    data = {(k, r): rng.normal(size=100 + 37 * k + 13) for k in range(3) for r in (1, 2)}
    lams = [0.0, 0.3, 1.0]
    df = make(spark, data, lams)
    weight = [0.15, 0.5, 0.35]
    for n, start in ((20, 0.0), (100, 0.0), (20, 0.37)):
        got = {(r.run, r.block): (r.dg, r.time_ns) for r in series.block_average(df, series.lambda_weights(df), n, start).collect()}
        for run in (1, 2):
            dg, at = np.zeros(n), np.zeros(n)
            for k in range(3):
                x, t = data[k, run] * weight[k], (np.arange(len(data[k, run])) + 1) * 100.0
                a = round(start * len(x))
                x, t = x[a:], t[a:]
                edge = [round(v) for v in np.linspace(0, len(x), n + 1)]
                dg += [x[p:q].mean() for p, q in zip(edge, edge[1:], strict=False)]
                at += np.linspace(t[0], t[-1], n)
            assert np.allclose([got[run, b][0] for b in range(n)], dg) and np.allclose([got[run, b][1] for b in range(n)], at)
    with pytest.raises(PySparkException):
        series.block_average(df, series.lambda_weights(df), 500).collect()


def test_rolling(spark):
    x = np.random.default_rng(5).normal(size=30)
    got = {r.i: r.rolling for r in series.rolling_mean(make(spark, {(0, 1): x}), 7).collect()}
    assert all(got[i] is None for i in range(7)) and all(got[i] == pytest.approx(x[i - 7 : i].mean()) for i in range(7, 30))
    with pytest.raises(PySparkException):
        series.rolling_mean(make(spark, {(0, 1): x}), 31).collect()


def test_runs_and_times(spark):
    df = make(spark, {(0, r): np.arange(5.0) for r in (1, 2, 3)})
    assert {r.run for r in series.select_runs(df, [1, 3], 3).collect()} == {1, 3}
    for bad in ([], [1, 1], [0], [4]):
        with pytest.raises(ValueError):
            series.select_runs(df, bad, 3)
    times = [r.time_ns for r in series.time_axis(df.where("run = 1"), F.lit(1.0), F.lit(2.0)).orderBy("step").collect()]
    assert np.allclose(times, np.linspace(1, 2, 6)[1:])


def test_thermodynamic_integration_is_exact_for_lines(spark):
    lams = [0.0, 0.1, 0.45, 1.0]
    df = make(spark, {(k, r): np.full(4, 2 + 3 * lam) for k, lam in enumerate(lams) for r in (1, 2, 3)}, lams)
    row = analyse.free_energy_ti(df).first()
    assert (row.n, row.mean, row.ci95) == (3, pytest.approx(3.5), pytest.approx(0))


def test_distributions(spark):
    # published values
    cases = [(1, 12.706205), (2, 4.302653), (3, 3.182446), (4, 2.776445), (5, 2.570582), (10, 2.228139), (30, 2.042272), (64, 1.997730)]
    df = spark.createDataFrame([(float(t), float(d)) for d, t in cases], "t double, df double")
    rows = df.select(dist.t_two_sided(F.col("t"), F.col("df")).alias("a"), dist.t_p_value("t", "df").alias("b"), dist.t975(F.col("df")).alias("q"), "t").collect()
    for r in rows:
        assert r.a == pytest.approx(0.05, abs=1e-6) and r.b == pytest.approx(0.05, abs=1e-6) and r.q == pytest.approx(r.t, abs=1e-5)
    far = spark.range(1).select(dist.t975(F.lit(150)).alias("q")).first().q
    assert far == pytest.approx(dist.t_quantile_975(150), abs=1e-8)
    z = spark.createDataFrame([(p,) for p in (0.975, 0.5, 0.001, 1e-10, 0.3)], "p double").select(dist.normal_quantile(F.col("p")).alias("z")).collect()
    assert [r.z for r in z] == pytest.approx([1.959963984540054, 0, -3.090232306167813, -6.361340902404056, -0.5244005127080409], abs=1e-12)
    c = spark.createDataFrame([(3.841459, 1.0), (9.487729, 4.0), (18.307038, 10.0)], "x double, df double").select(dist.chi2_p_value("x", "df").alias("p")).collect()
    assert [r.p for r in c] == pytest.approx([0.05] * 3, abs=1e-6)
    assert dist.beta_regularized(2.0, 3.0, 0.4) == pytest.approx(0.5248)


def test_detectors_on_a_step(spark):
    rng = np.random.default_rng(6)
    lams, data = [0.0, 0.5, 1.0], {}
    for k in range(3):
        for r in range(1, 6):
            x = rng.normal(size=600)
            x[:120] += 20
            data[k, r] = x
    df = make(spark, data, lams)
    w = series.lambda_weights(df)
    blocks = series.block_average(df, w)
    p = {round(r.fraction, 2): r.p for r in equilibration.geweke_tests(df, w).collect()}
    assert p[0.0] < 1e-4 and p[0.33] > 1e-3
    assert {r.fraction: r.p for r in equilibration.paired_t_tests(df, w).collect()}[0.0] < 1e-4
    kpss = {r.fraction: r.p for r in equilibration.kpss_tests(blocks).collect()}
    assert kpss[0.0] == 0.01 and kpss[0.3] > 0.01
    found = equilibration.equil_multiwindow(blocks).first()
    assert found.equilibrated and found.fraction > 0
    windows = w.withColumn("equilibrated", F.lit(False)).withColumn("equil_time_ns", F.lit(None).cast("double"))
    ns = w.select("calc", "leg", "stage", "lam", F.lit(2.0).alias("total_ns"))
    back = equilibration.write_back_equilibration(windows, spark.createDataFrame([("c", "free", "s", True, 0.3)], "calc string, leg string, stage string, equilibrated boolean, fraction double"), ns).collect()
    assert all(r.equilibrated and r.equil_time_ns == pytest.approx(0.6) for r in back)


def test_kpss_of_white_noise_and_trend():
    rng = np.random.default_rng(7)
    assert equilibration.kpss_level(rng.normal(size=100))[1] > 0.01
    assert equilibration.kpss_level(np.arange(100) + rng.normal(size=100))[1] == 0.01


def rhat(chains):
    """Rank-normalised split R-hat with plain numpy."""

    def one(x):
        flat = x.ravel()
        order = np.sort(flat)
        rank = (np.searchsorted(order, flat, "left") + np.searchsorted(order, flat, "right") + 1) / 2
        u = (rank - 0.375) / (len(flat) + 0.25)
        lo = np.vectorize(lambda p: 2**0.5 * _erfinv(2 * p - 1))
        z = lo(u).reshape(x.shape)
        m = x.shape[1]
        b, w = m * z.mean(axis=1).var(ddof=1), z.var(axis=1, ddof=1).mean()
        return math.sqrt((b / w + m - 1) / m)

    return max(one(chains), one(np.abs(chains - np.median(chains))))


def _erfinv(y):
    lo, hi = -6.0, 6.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.erf(mid) < y else (lo, mid)
    return lo


def test_gelman_rubin(spark):
    rng = np.random.default_rng(8)
    data = {(0, r): np.round(rng.normal(size=101), 1) for r in range(1, 6)} | {(1, r): rng.normal(size=101) + (3 if r == 5 else 0) for r in range(1, 6)}
    got = {r.lam: r for r in equilibration.gelman_rubin(make(spark, data), 0.0).collect()}
    for k in (0, 1):
        chains = np.array([half for r in range(1, 6) for half in (data[k, r][:50], data[k, r][51:])])
        assert got[float(k)].rhat == pytest.approx(rhat(chains), rel=1e-9)
    assert got[0.0].converged and not got[1.0].converged and got[1.0].rhat > 1.1
    assert statistics.kruskal_wallis(make(spark, data)).where("lam = 1").first().differ


def harmonic(spark, rng, ks, n, run=1):
    """Samples of harmonic states: f_k = ln(k_k / k_0) / 2."""
    rows = []
    for s, k in enumerate(ks):
        for i, x in enumerate(rng.normal(size=n) / math.sqrt(k)):
            rows.append(("c", "free", "s", s / (len(ks) - 1), run, i, s, [float(0.5 * q * x * x) for q in ks]))
    return spark.createDataFrame(rows, "calc string, leg string, stage string, lam double, run int, step long, state int, u array<double>")


def test_estimator(spark):
    rng, ks = np.random.default_rng(9), [1.0, 2.0, 4.0, 9.0]
    df = harmonic(spark, rng, ks, 1500).union(harmonic(spark, rng, ks, 700, run=2))
    solved = {r.run: r for r in estimator.solve(df).collect()}
    for r in solved.values():
        assert r.f == pytest.approx([0.5 * math.log(k) for k in ks], abs=0.05) and r.passes < 30
    # self-consistency by numpy
    u, n = np.array([r.u for r in df.where("run = 1").collect()]), np.full(4, 1500.0)
    f = np.array(solved[1].f)
    d = np.log((n * np.exp(f - u)).sum(axis=1))
    new = -np.log(np.exp(-u - d[:, None]).sum(axis=0))
    assert np.allclose(new - new[0], f, atol=1e-7)
    s = estimator.solve(df)
    o = estimator.overlap(estimator.gram(df, s), s).groupBy("run", "i").agg(F.sum("value").alias("v")).collect()
    assert all(r.v == pytest.approx(1, abs=1e-8) for r in o)
    ends = {r.run: r for r in estimator.mbar(df, 300.0).collect()}
    assert all(abs(r.dg / (0.0019872043 * 300) - 0.5 * math.log(9)) < 5 * r.err / 0.596 for r in ends.values())
    assert ends[1].err < ends[2].err
    curve = estimator.convergence(df.where("run = 1"), points=4).orderBy("frac").collect()
    assert [r.frac for r in curve] == [0.25, 0.5, 0.75, 1.0] and curve[-1].dg == pytest.approx(f[-1] * 0.0019872043 * 298, rel=1e-6)
    assert estimator.block_mbar(df.where("run = 1"), 5).count() == 5


def apart(spark, k, gap, rise, n, skip=(), seed=0):
    """n samples of each of k harmonic states, `gap` widths apart, each `rise` above the one before."""
    rng, rows = np.random.default_rng(seed), []
    for s in set(range(k)) - set(skip):
        for x in rng.normal(s * gap, 1, n):
            rows.append(("c", "l", "s", float(s), 1, s, (0.5 * (x - np.arange(k) * gap) ** 2 + np.arange(k) * rise).tolist()))
    return spark.createDataFrame(rows, "calc string, leg string, stage string, lam double, run int, state int, u array<double>")


@pytest.mark.parametrize("k,gap,rise,skip", [(11, 3, 5, ()), (20, 2, 5, ()), (44, 2, 3, ()), (44, 3, 10, ()), (20, 2, 5, (0, 3, 7, 8, 19)), (4, 9, 30, ()), (1, 1, 1, ())])
def test_states_that_overlap_little(spark, k, gap, rise, skip):
    """Few passes, states without samples too, and the equations hold."""
    df = apart(spark, k, gap, rise, 100, skip).repartition(3)
    got = estimator.solve(df).first()
    u, f, n = np.array([r.u for r in df.collect()]), np.array(got.f), np.array(got.n)
    assert got.passes < 15 and n.tolist() == [0 if s in skip else 100 for s in range(k)]
    log_sum = lambda x, axis: np.log(np.exp(x - x.max(axis=axis, keepdims=True)).sum(axis=axis)) + x.max(axis=axis)
    d = log_sum((f - u)[:, n > 0] + np.log(n[n > 0]), 1)
    new = -log_sum(-u - d[:, None], 0)
    # where states hardly overlap the equations are flat: the weights of a state have to sum to 1
    assert np.allclose(new, f + (new - f)[np.flatnonzero(n > 0)[0]], atol=1e-7)


def test_problems_share_rows(spark):
    """Rows are packed once, whatever holds them; each problem is that of its own rows; one may lack a state."""
    df = states(spark, n_runs=2, n=90)
    rows = series.indexed(df)
    held = F.array_compact(F.array(F.lit(0), F.when(F.col("i") < 30, F.lit(1)), F.when((F.col("i") >= 20) & (F.col("state") < 2), F.lit(5))))
    keys = ["calc", "leg", "stage", "run"]
    blocks = estimator.packed(rows, keys, held=held).collect()
    assert sum(len(b._s) // 4 for b in blocks) == df.count() == 540 and sum(len(b._owner) // 4 for b in blocks) == 540 + 180 + 280
    got = {(r.run, r.problem): r for r in estimator.solve(rows, held=held).collect()}
    assert set(got) == {(r, p) for r in (1, 2) for p in (0, 1, 5)} and got[1, 5].n == [70.0, 70.0, 0.0]
    for p, part in ((0, rows), (1, rows.where("i < 30")), (5, rows.where("i >= 20 and state < 2"))):
        for r in estimator.solve(part).collect():
            assert got[r.run, p].f == pytest.approx(r.f, abs=1e-7)


def test_a_bad_start_is_searched(spark, monkeypatch):
    """Without the chain, halved steps still find the minimum."""
    monkeypatch.setattr(estimator, "_chain", lambda n, *rest: np.zeros(len(n)))
    df = apart(spark, 6, 2, 6, 60)
    bad = estimator.solve(df).first()
    monkeypatch.undo()
    good = estimator.solve(df).first()
    assert bad.f == pytest.approx(good.f, abs=1e-6) and bad.passes > good.passes


def test_schedule(spark):
    rng = np.random.default_rng(10)
    lams = [0.0, 0.1, 0.2, 0.5, 0.8, 1.0]
    df = make(spark, {(k, r): rng.normal(size=200) * (1 + 6 * lam**2) + lam for k, lam in enumerate(lams) for r in range(1, 6)}, lams)
    stats = analyse.gradient_data(df, 4e-6, 100).persist()
    times = df.groupBy("calc", "leg", "stage", "lam").agg((F.max("step") * 4e-6).alias("total_ns"))
    errors = schedule.integrated_error(stats, er_type="root_var").orderBy("lam").collect()
    y = np.array([r.er for r in errors])
    integral = np.concatenate([[0], np.cumsum((y[1:] + y[:-1]) / 2 * np.diff(lams))])
    assert np.allclose([r.integrated for r in errors], integral)
    table = schedule.integrated_error(stats, er_type="root_var").persist()
    best = [r.lam for r in schedule.optimal_lambdas(table, n_lam=20, places=None).orderBy("k").collect()]
    assert np.allclose(best, np.interp(np.linspace(0, integral[-1], 20), integral, lams))
    # at the optimal windows there is nothing left to gain
    again = spark.createDataFrame([("c", "free", "s", float(v)) for v in best], "calc string, leg string, stage string, lam double")
    assert schedule.improvement_factor(table, again).first().factor > 0.98
    for kind in ({}, {"delta_er": 1.0, "n_lam": 3}):
        with pytest.raises(ValueError):
            schedule.optimal_lambdas(table, **kind)
    overlap = {(r.i, r.j): r.value for r in schedule.predicted_overlap(stats).collect()}
    assert all(sum(v for (i, _), v in overlap.items() if i == k) == pytest.approx(1) for k in range(6))
    windows = series.lambda_weights(df).withColumn("runtime_constant", F.lit(0.0005)).withColumn("relative_cost", F.lit(1.0))
    plan = schedule.optimal_runtime(stats, times, windows, 30.0).collect()
    for r in plan:
        assert r.extra_ns == (0 if r.actual_ns >= r.predicted_ns else math.ceil(min(r.predicted_ns - r.actual_ns, r.actual_ns) / 5 * 10) / 10)
    cycles = schedule.runtime_to_cycles(spark.createDataFrame([(0.3,), (1.0,)], "extra_ns double"), 0.1).collect()
    assert [r.cycles for r in cycles] == [3, 10]
    with pytest.raises(PySparkException):
        schedule.runtime_to_cycles(spark.createDataFrame([(0.35,)], "extra_ns double"), 0.1).collect()


def test_agreement(spark):
    rng = np.random.default_rng(11)
    x, y = np.round(rng.normal(size=60), 1), np.round(rng.normal(size=60), 1)
    df = spark.createDataFrame([(0, i, float(a), float(b), 0.3, 0.2) for i, (a, b) in enumerate(zip(x, y, strict=True))], "g int, k int, x double, y double, xe double, ye double")
    row = agreement.all_statistics(df, ["g"], "x", "y").first()
    sign = lambda v: np.sign(v[:, None] - v)
    tau = (sign(x) * sign(y)).sum() / math.sqrt((sign(x) ** 2).sum() * (sign(y) ** 2).sum())
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    assert row.r == pytest.approx(np.corrcoef(x, y)[0, 1]) and row.r2 == pytest.approx(np.corrcoef(x, y)[0, 1] ** 2)
    assert row.mue == pytest.approx(np.abs(x - y).mean()) and row.rmse == pytest.approx(math.sqrt(((x - y) ** 2).mean()))
    assert row.rho == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1]) and row.tau == pytest.approx(tau)
    one = {r.stat: tuple(r) for r in agreement.stats_with_ci(df, "x", "y", "xe", "ye", "k", n=40).collect()}
    two = {r.stat: tuple(r) for r in agreement.stats_with_ci(df.repartition(7), "x", "y", "xe", "ye", "k", n=40).collect()}
    assert one.keys() == set(agreement.STATISTICS) and all(one[k] == pytest.approx(two[k]) or one[k][1:] == pytest.approx(two[k][1:]) for k in one)
    assert all(v[2] < v[3] for v in one.values())
    runs = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", 5.0)], "calc_base_dir string, dg double")
    measured = spark.createDataFrame([("a", "A", 1.0, 0.1, 0.5), ("b", "B", 2.0, 0.1, 0.0), ("z", "Z", 3.0, 0.1, 0.0)], "calc_base_dir string, name string, exp_dg double, exp_er double, calc_cor double")
    got = {r.name: r.calc_dg for r in agreement.set_results(runs, measured).collect()}
    assert got == {"A": 2.5, "B": 5.0}
    with pytest.raises(PySparkException):
        agreement.set_results(runs, measured.union(measured)).collect()
    assert agreement.to_analyse(runs.select("calc_base_dir").distinct(), measured.where("name = 'A'"), ["calc_base_dir"]).collect()[0][0] == "b"


def test_brown_forsythe(spark):
    a, b = np.random.default_rng(12).normal(size=7), np.random.default_rng(13).normal(size=9) * 4
    df = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b], "g string, v double")
    row = equilibration.brown_forsythe(df, "g", "v").first()
    da, db = np.abs(a - np.median(a)), np.abs(b - np.median(b))
    every = np.concatenate([da, db])
    between = 7 * (da.mean() - every.mean()) ** 2 + 9 * (db.mean() - every.mean()) ** 2
    f = between / ((7 * da.var() + 9 * db.var()) / 14)
    assert row.f == pytest.approx(f) and 0 < row.p < 1


def test_rmsd_of_moved_copies(spark):
    rng = np.random.default_rng(14)
    atoms = rng.normal(size=(12, 3))
    rows = []
    for frame in range(6):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        q *= np.sign(np.linalg.det(q))
        moved = atoms @ q + rng.normal(size=3) * 5 if frame else atoms
        rows += [("c", "free", "s", 0.0, 1, frame, a, "LIG", "X", *map(float, p)) for a, p in enumerate(moved)]
    df = spark.createDataFrame(rows, "calc string, leg string, stage string, lam double, run int, frame long, atom long, resname string, atom_name string, x double, y double, z double")
    got = geometry.rmsd(df, F.col("atom") < 8, F.col("atom") >= 0).collect()
    assert len(got) == 6 and all(r.rmsd < 1e-6 for r in got)
    far = df.withColumn("x", F.when(F.col("atom") == 11, F.col("x") + 50).otherwise(F.col("x")))
    assert all((r.rmsd > 1) for r in geometry.rmsd(far, F.col("atom") < 8, F.col("atom") >= 8, geometry.reference_frame(df)).collect())
    axis = [r.time_ns for r in geometry.rmsd_time_axis(geometry.rmsd(df, F.col("atom") < 8), F.lit(10.0)).orderBy("frame").collect()]
    assert np.allclose(axis, np.linspace(0, 10, 6))


def test_waters(spark):
    rows = [("c", "free", "s", 0.0, 1, f, a, "LIG" if a == 0 else "WAT", "O", float(a if (f == 1 or a == 0) else 100), 0.0, 0.0) for f in range(2) for a in range(7)]
    df = spark.createDataFrame(rows, "calc string, leg string, stage string, lam double, run int, frame long, atom long, resname string, atom_name string, x double, y double, z double")
    # no atom in the first frame, three in the second
    assert statistics.average_waters(df, 0, 3.5).first().waters == pytest.approx(0.5)
    assert statistics.average_waters(df, 0, 3.5, 50.0).first().waters == pytest.approx(1.0)


def test_rollups(spark):
    df = make(spark, {(0, 1): np.arange(5), (0, 2): np.arange(3), (1, 1): np.arange(4)})
    got = {(r.level, r.lam, r.run): r.simtime_ns for r in rollup.total_simtime(df, 0.01, ["lam", "run"]).collect()}
    assert got["all", None, None] == 12.0 and got["lam", 0.0, None] == 8.0 and got["run", 1.0, 1] == 4.0
    runs = spark.createDataFrame([("c", "bound", 1, 5.0, 3.0), ("c", "free", 1, 7.0, 4.0)], "calc string, leg string, run int, dg double, er double")
    fixed = rollup.apply_restraint_correction(runs, spark.createDataFrame([("c", 1, 0.5)], "calc string, run int, dg double"))
    row = rollup.combine_legs(fixed, ["calc"]).first()
    assert (row.dg, row.er) == (1.5, 5.0)
    windows = spark.createDataFrame([("c", True, 1.0), ("c", False, 2.0)], "calc string, equilibrated boolean, equil_time_ns double")
    assert rollup.all_equilibrated(windows, ["calc"]).first().equilibrated is False and rollup.equil_time(windows, ["calc"]).first().equil_time_ns == 3.0


def test_shapiro_wilk_keeps_every_group(spark):
    rng = np.random.default_rng(15)
    data = {"few": [1.0, 2.0, 4.0], "one": [1.0], "none": [None, None], "four": [1.0, 2.0, 4.0, 9.0], "most": list(rng.normal(size=5000)), "more": [*rng.normal(size=5001), None], "skewed": list(rng.exponential(size=6000))}
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, x in data.items() for v in x], "g string, v double")
    got = {r.g: r for r in statistics.shapiro_wilk(df, ["g"], "v").collect()}
    assert {k: r.n for k, r in got.items()} == {k: sum(v is not None for v in x) for k, x in data.items()}
    assert all((got[k].w, got[k].p) == (None, None) for k in ("few", "one", "none"))
    # published weights for four values
    assert got["four"].w == pytest.approx((0.6872 * (9 - 1) + 0.1677 * (4 - 2)) ** 2 / 38, abs=2e-3) and 0 < got["four"].p < 1
    for k in ("most", "more", "skewed"):
        x = np.sort([v for v in data[k] if v is not None])
        n, u = len(x), len(x) ** -0.5
        m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
        a1 = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, m[-1] / math.sqrt(m @ m)], u)
        a2 = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / math.sqrt(m @ m)], u)
        a = m / math.sqrt((m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * a1**2 - 2 * a2**2))
        a[[0, 1, -2, -1]] = -a1, -a2, a2, a1
        w = (a @ x) ** 2 / ((x - x.mean()) ** 2).sum()
        c = math.log(n)
        z = (math.log(1 - w) - np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], c)) / math.exp(np.polyval([0.0030302, -0.082676, -0.4803], c))
        assert got[k].w == pytest.approx(w, abs=1e-9) and got[k].p == pytest.approx(1 - NormalDist().cdf(z), abs=1e-6), k
    assert got["more"].p > 1e-3 and got["skewed"].p < 1e-6


def test_chodera_query_tries_every_start(spark, tmp_path):
    rng = np.random.default_rng(16)
    means, rows = {}, []
    for k, (name, lam) in enumerate(LAM.items()):
        n = 60 + 20 * k
        x = np.concatenate([np.linspace(3e3 if k == 1 else 9, 0, 17 + k), np.zeros(n - 17 - k)]) + rng.normal(size=(5, n))
        means[lam] = x.mean(axis=0)
        rows += [(len(rows) + j, name, r, j, float(x[r, j])) for r in range(5) for j in range(n)]
    spark.createDataFrame(rows, "event_id long, event_type string, user_id long, ts long, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.lam: r for r in queries.QUERIES["chodera"](spark, str(tmp_path)).collect()}
    assert got.keys() == means.keys()
    for lam, x in means.items():
        tried = [(len(x) - t + 1) / inefficiency(x[t:], fast=True) for t in range(len(x) - 1)]
        assert got[lam].t0 == int(np.argmax(tried)) and got[lam].n_eff == pytest.approx(max(tried), abs=1e-5), lam


def test_chodera_of_long_correlation(spark):
    # many passes of lags, and a constant end
    x = np.concatenate([np.sin(np.arange(700) / 250) + np.random.default_rng(17).normal(size=700) / 10, np.full(5, 0.3)])
    got = autocorrelation.chodera_windows(make(spark, {(0, 1): x}), ["lam"]).first()
    tried = [(len(x) - t + 1) / inefficiency(x[t:], fast=True) for t in range(len(x) - 5)]
    assert got.t0 == int(np.argmax(tried)) and got.n_eff == pytest.approx(max(tried), rel=1e-9)


def test_queries_on_single_series_keep_all_rows(spark, tmp_path):
    rng = np.random.default_rng(18)
    sizes = {1: 30, 2: 6, 3: 1}
    rows = [(i, "click", run - 1, i, float(rng.normal())) for run, n in sizes.items() for i in range(n)]
    spark.createDataFrame(rows, "event_id long, event_type string, user_id long, ts long, value double").write.parquet(str(tmp_path / "events.parquet"))
    assert {r.run: r.n for r in queries.QUERIES["shapiro_wilk"](spark, str(tmp_path)).collect()} == sizes
    assert {r.run: r["count"] for r in queries.QUERIES["probability_plot"](spark, str(tmp_path)).groupBy("run").count().collect()} == sizes


def states(spark, n_runs=2, n=120, k=3, seed=4, uneven=False):
    """Samples of k harmonic states, with energies in all of them."""
    rng, rows = np.random.default_rng(seed), []
    for run in range(1, n_runs + 1):
        for s in range(k):
            for i in range(n + (40 if uneven and run == 1 else 0)):
                x = rng.normal() / math.sqrt(1 + s)
                rows.append(("c", "free", "s", s / (k - 1), run, (i + 1) * 10, s, [float((1 + j) * x * x / 2) for j in range(k)]))
    return spark.createDataFrame(rows, "calc string, leg string, stage string, lam double, run int, step long, state int, u array<double>")


def test_estimates_that_have_not_converged_fail(spark, monkeypatch):
    # states that all overlap take two passes by now, these more
    rows = apart(spark, 20, 2, 5, 50)
    assert estimator.solve(rows).count() == 1
    monkeypatch.setattr(estimator, "MOST_PASSES", 2)
    with pytest.raises(RuntimeError, match="MOST_PASSES = 2"):
        estimator.solve(rows)


def test_runs_must_agree_in_time(spark):
    assert estimator.convergence(states(spark), points=2).count() == 4
    with pytest.raises(PySparkException, match="more than 1 %"):
        estimator.convergence(states(spark, uneven=True), points=2).collect()
    data = {(k, r): np.arange(100.0 + 30 * (r == 1)) for k in range(2) for r in (1, 2)}
    rows = make(spark, data)
    with pytest.raises(PySparkException, match="more than 1 %"):
        estimator.ti_convergence(rows, series.lambda_weights(rows)).collect()
    even = series.cut_to_shortest(rows)
    assert even.groupBy("run").count().select("count").distinct().collect()[0][0] == 200
    assert estimator.ti_convergence(even, series.lambda_weights(even), points=4).count() == 8


def test_blocks_by_reweighting(spark):
    """Each block's estimate is that of its own rows, at the time of its start."""
    rows = states(spark, n_runs=1, n=40)
    got = {r.block: r for r in estimator.block_mbar(rows, 4, timestep_ns=0.5, equil_ns=30.0).collect()}
    assert {b: r.time_ns for b, r in got.items()} == {b: pytest.approx((600 - 30) * b / 4 + 30) for b in range(4)}
    # a block shares a row with the one before
    own = rows.where("step between 200 and 300")
    one = estimator.solve(own).first().f[-1]
    assert got[2].dg == pytest.approx(one * 298.0 * 8.314462618 / 4184, rel=1e-6)


def test_costs_of_a_stage_must_agree(spark):
    rng = np.random.default_rng(5)
    rows = make(spark, {(k, r): rng.normal(size=50) for k in range(2) for r in (1, 2)})
    w = series.lambda_weights(rows)
    assert analyse.gradient_data(rows, 1.0, 1, w.withColumn("relative_cost", F.lit(2.0))).first().relative_cost == 2.0
    with pytest.raises(PySparkException, match="costs differ"):
        analyse.gradient_data(rows, 1.0, 1, w.withColumn("relative_cost", F.col("lam"))).collect()


def test_comparative_convergence_checks_equilibration(spark):
    data = {(k, r): np.arange(200.0) for k in range(2) for r in (1, 2)}
    two = make(spark, data).withColumn("calc", F.when(F.col("run") == 1, F.lit("a")).otherwise(F.lit("b")))
    w = series.lambda_weights(two)
    windows = w.withColumn("equil_time_ns", F.lit(2000.0))
    assert estimator.comparative_convergence(two, w, windows, points=4, energy_freq=100).count() == 8
    apart = w.withColumn("equil_time_ns", F.when(F.col("calc") == "a", 2000.0).otherwise(3000.0))
    with pytest.raises(PySparkException, match="differ between calculations"):
        estimator.comparative_convergence(two, w, apart, points=4, energy_freq=100).collect()


def test_shapiro_published_example_and_names(spark):
    """Weights of eleven men, a published example; key columns may have any names."""
    men = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    df = spark.createDataFrame([("men", float(x)) for x in men] + [("few", 1.0), ("few", 2.0), ("few", 4.0)], "k string, v double")
    got = {r.k: r for r in statistics.shapiro_wilk(df, ["k"], "v").collect()}
    assert got["men"].n == 11 and got["men"].w == pytest.approx(0.79, abs=0.005) and got["men"].p == pytest.approx(0.0067, abs=0.0005)
    assert got["few"].n == 3 and got["few"].w is None
    dense = statistics.gaussian_kde(df.where("k = 'men'"), ["k"], "v", 400).toPandas()
    x, h = np.array(men, float), np.std(men, ddof=1) * len(men) ** -0.2
    want = [np.exp(-0.5 * ((g - x) / h) ** 2).sum() / (len(men) * h * math.sqrt(2 * math.pi)) for g in np.linspace(x.min(), x.max(), 400)]
    assert sorted(dense.density) == pytest.approx(sorted(want))


@pytest.mark.parametrize("kind", ["apart", "mirrored", "flat", "line", "point"])
def test_rmsd_by_singular_vectors(spark, kind):
    """The least distance over all rotations, by another method; mirror images and atoms in a plane, a line or a point too."""
    rng = np.random.default_rng(3)
    keep = {"flat": [1, 1, 0], "line": [1, 0, 0], "point": [0, 0, 0]}.get(kind, [1, 1, 1])
    first = rng.normal(size=(6, 3)) * keep
    frames = [first] + [(-first if kind == "mirrored" else rng.normal(size=(6, 3)) * keep) + rng.normal(size=3) for _ in range(4)]
    rows = [("c", "l", "s", 0.0, 1, f, a, "A", "A", *map(float, x[a])) for f, x in enumerate(frames) for a in range(6)]
    got = {r.frame: r.rmsd for r in geometry.rmsd(spark.createDataFrame(rows, COORDS), F.lit(True)).collect()}
    y = first - first.mean(axis=0)
    for f, x in enumerate(frames):
        x = x - x.mean(axis=0)
        u, s, vt = np.linalg.svd(x.T @ y)
        s[-1] *= np.sign(np.linalg.det(u) * np.linalg.det(vt))
        assert got[f] == pytest.approx(math.sqrt(max((x**2).sum() + (y**2).sum() - 2 * s.sum(), 0) / 6), abs=1e-6)


def test_bucketed_series_need_no_shuffle(spark, tmp_path):
    s = make(spark, {(k, r): np.arange(40.0) + r for k in range(3) for r in (1, 2)})
    sinks.write_sample_table(s, "tide_samples", 4, str(tmp_path / "t"))
    rows = series.rolling_mean(spark.table("tide_samples"), 5)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    key = ["lam", "run", "i", "rolling"]
    assert sorted(map(tuple, rows.select(key).collect()), key=str) == sorted(map(tuple, series.rolling_mean(s, 5).select(key).collect()), key=str)
    spark.sql("drop table tide_samples")


def test_median_and_ranks(spark):
    rows = [("a", float(v)) for v in (5, 1, 1, 3)] + [("b", float(v)) for v in (2, 9, 4)] + [("b", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    mids = {r.k: r.m for r in ranges.medians(df, ["k"], "v", "m").collect()}
    assert mids == {"a": 2.0, "b": 4.0}
    ranks = sorted((r.v, r.r) for r in ranges.ranked(df.where("k = 'a'"), ["k"], "v", "r").collect())
    assert ranks == [(1.0, 1.5), (1.0, 1.5), (3.0, 3.0), (5.0, 4.0)]


def test_integration_needs_no_weights(spark):
    rng = np.random.default_rng(8)
    rows = make(spark, {(k, r): rng.normal(size=20) for k in range(4) for r in (1, 2)}, [0.0, 0.1, 0.5, 1.0])
    with_ = {r.run: r.dg for r in statistics.thermodynamic_integration(rows, series.lambda_weights(rows)).collect()}
    assert {r.run: r.dg for r in statistics.thermodynamic_integration(rows).collect()} == pytest.approx(with_)


def test_batches_of_rows_that_no_problem_holds(spark):
    """The longer calculation's rows behind the shortest one's time are in Arrow batches of their own."""
    rng = np.random.default_rng(12)
    rows = [(c, "f", "s", k / 2.0, 1, (i + 1) * 10, k, [float(x) for x in rng.normal(size=3)]) for c, n in (("a", 40), ("b", 10)) for k in range(3) for i in range(n)]
    samples = spark.createDataFrame(rows, "calc string, leg string, stage string, lam double, run int, step long, state int, u array<double>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    curve = lambda s: {(r.calc, r.frac): r.dg for r in estimator.comparative_convergence(s, points=2).collect()}
    want = curve(samples)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = curve(samples)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert set(got) == {("a", 0.125), ("a", 0.25), ("b", 0.5), ("b", 1.0)}
    assert got == pytest.approx(want, abs=1e-6)
