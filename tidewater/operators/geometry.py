"""Superposed distances of frames from a reference frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.schema import SERIES

AXES = ("x", "y", "z")


#: Squarings of the key matrix: what is left of an eigenvalue smaller by 1e-11 of the largest is nothing.
SQUARINGS = 42
_UPPER = [(i, j) for i in range(4) for j in range(i, 4)]


def rotation(h: dict[tuple[str, str], Column], bound: Column) -> Column:
    """Rotation (row by row) that best turns centred frame atoms onto the reference, from their covariance sums.

    It is the quaternion of the largest eigenvalue of a symmetric 4 x 4 matrix. Raised by `bound`, which no eigenvalue's
    size exceeds, the matrix is squared again and again, which leaves the projection on that eigenvalue's vectors; any of
    its columns will do, the largest is taken. Atoms in a line or at one point leave more than one such vector: each is best.
    """
    s = lambda a, b: h[a, b]
    key = {
        (0, 0): s("x", "x") + s("y", "y") + s("z", "z"), (0, 1): s("y", "z") - s("z", "y"), (0, 2): s("z", "x") - s("x", "z"), (0, 3): s("x", "y") - s("y", "x"),
        (1, 1): s("x", "x") - s("y", "y") - s("z", "z"), (1, 2): s("x", "y") + s("y", "x"), (1, 3): s("z", "x") + s("x", "z"),
        (2, 2): s("y", "y") - s("x", "x") - s("z", "z"), (2, 3): s("y", "z") + s("z", "y"), (3, 3): s("z", "z") - s("x", "x") - s("y", "y"),
    }
    # without any spread every rotation is as good: the identity's projection
    start = F.array(*((key[ij] + bound if ij[0] == ij[1] else key[ij]) + (F.when(bound > 0, 0.0).otherwise(1.0) if ij == (0, 0) else F.lit(0.0)) for ij in _UPPER))
    at = {ij: k for k, ij in enumerate(_UPPER)} | {(j, i): k for k, (i, j) in enumerate(_UPPER)}
    trace = lambda m: m[at[0, 0]] + m[at[1, 1]] + m[at[2, 2]] + m[at[3, 3]]

    def squared(m: Column, _: Column) -> Column:
        n = F.transform(m, lambda x: x / trace(m))
        return F.transform(F.array(n), lambda n: F.array(*(sum((n[at[i, k]] * n[at[k, j]] for k in range(1, 4)), n[at[i, 0]] * n[at[0, j]]) for i, j in _UPPER)))[0]

    m = F.aggregate(F.sequence(F.lit(1), F.lit(SQUARINGS)), start, squared)
    columns = F.transform(F.array(m), lambda m: F.array_max(F.array(*(F.struct(m[at[k, k]].alias("size"), F.array(*(m[at[i, k]] for i in range(4))).alias("q")) for k in range(4)))))[0]["q"]

    def turn(q: Column) -> Column:
        w, x, y, z = (q[k] for k in range(4))
        n = w * w + x * x + y * y + z * z
        cells = [w * w + x * x - y * y - z * z, 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), w * w - x * x + y * y - z * z, 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), w * w - x * x - y * y + z * z]
        return F.array(*(c / n for c in cells))

    return F.transform(F.array(columns), turn)[0]


def reference_frame(coords: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """(atom, x, y, z) of the first frame of the first series."""
    first = coords.select(*keys, "frame").orderBy(*keys, "frame").limit(1)
    return coords.join(first, [*keys, "frame"], "left_semi").select("atom", *AXES)


def rmsd(coords: DataFrame, select: Column, group: Column | None = None, reference: DataFrame | None = None, keys: list[str] = SERIES) -> DataFrame:
    """(keys, frame, rmsd) of the group's atoms (the selection by default) after superposing the selection.

    The fit takes nine covariance sums per frame from an aggregation; the rotation is an expression of them, and the
    residual is an aggregation again. Frames without a selected atom are left out.
    """
    ref = (reference_frame(coords, keys) if reference is None else reference).select(F.col("atom").alias("_a"), *(F.col(c).alias(f"r{c}") for c in AXES))
    frame = [*keys, "frame"]
    rows = coords.join(ref, F.col("atom") == F.col("_a")).withColumn("_sel", select).withColumn("_grp", select if group is None else group)
    fit = rows.where("_sel").groupBy(*frame).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"c{c}") for c in AXES), *(F.avg(f"r{c}").alias(f"d{c}") for c in AXES), *(F.sum(F.col(a) * F.col(f"r{b}")).alias(f"h{a}{b}") for a in AXES for b in AXES), *(F.var_pop(c).alias(f"v{c}") for c in [*AXES, *(f"r{c}" for c in AXES)]))
    h = {(a, b): F.col(f"h{a}{b}") - F.col("n") * F.col(f"c{a}") * F.col(f"d{b}") for a in AXES for b in AXES}
    bound = F.col("n") * sum((F.col(f"v{c}") + F.col(f"vr{c}") for c in AXES), F.lit(0.0)) / 2
    fit = fit.select(*frame, *(f"c{c}" for c in AXES), *(f"d{c}" for c in AXES), *(x.alias(f"h{a}{b}") for (a, b), x in h.items()), bound.alias("_bound"))
    fit = fit.withColumn("q", rotation({(a, b): F.col(f"h{a}{b}") for a, b in h}, F.col("_bound"))).select(*frame, "q", *(f"c{c}" for c in AXES), *(f"d{c}" for c in AXES))
    placed = rows.where("_grp").join(fit, frame)
    turned = lambda i: sum((F.col("q")[3 * i + j] * (F.col(c) - F.col(f"c{c}")) for j, c in enumerate(AXES)), F.col(f"d{AXES[i]}"))
    d2 = sum(((turned(i) - F.col(f"r{c}")) ** 2 for i, c in enumerate(AXES)), F.lit(0.0))
    return placed.groupBy(*frame).agg(F.sqrt(F.avg(d2)).alias("rmsd"))


def rmsd_time_axis(values: DataFrame, total_ns: Column, keys: list[str] = SERIES) -> DataFrame:
    """values with time_ns, an even grid from 0 to the total over a series' frames."""
    w = Window.partitionBy(*keys)
    n, k = F.count("*").over(w), F.row_number().over(w.orderBy("frame")) - 1
    return values.withColumn("_n", n).withColumn("time_ns", F.when(F.col("_n") > 1, total_ns * k / (F.col("_n") - 1)).otherwise(F.lit(0.0))).drop("_n")
