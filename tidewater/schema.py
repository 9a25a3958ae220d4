"""Keys and schemas of the tables: calculations, legs, stages, windows (lam) and replicate runs."""

from __future__ import annotations

from pyspark.sql import types as T

STAGE = ["calc", "leg", "stage"]
WINDOW = [*STAGE, "lam"]
SERIES = [*WINDOW, "run"]
#: A stage's runs, one series of combined values each.
RUN = [*STAGE, "run"]

#: Gas constant in kcal / (mol K).
K_B = 8.314462618 / 4184.0


def _fields(*pairs: tuple[str, T.DataType]) -> list[T.StructField]:
    return [T.StructField(n, t) for n, t in pairs]


KEY_FIELDS = _fields(("calc", T.StringType()), ("leg", T.StringType()), ("stage", T.StringType()), ("lam", T.DoubleType()), ("run", T.IntegerType()))
SAMPLES = T.StructType([*KEY_FIELDS, *_fields(("step", T.LongType()), ("potential", T.DoubleType()), ("grad", T.DoubleType()), ("fwd", T.DoubleType()), ("bwd", T.DoubleType()), ("u", T.ArrayType(T.DoubleType())))])
COORDS = T.StructType([*KEY_FIELDS, *_fields(("frame", T.LongType()), ("atom", T.LongType()), ("resname", T.StringType()), ("atom_name", T.StringType()), ("x", T.DoubleType()), ("y", T.DoubleType()), ("z", T.DoubleType()))])
WINDOWS = T.StructType([*KEY_FIELDS[:4], *_fields(("lam_index", T.IntegerType()), ("weight", T.DoubleType()), ("equilibrated", T.BooleanType()), ("equil_time_ns", T.DoubleType()), ("runtime_constant", T.DoubleType()), ("relative_cost", T.DoubleType()))])
EXP_DGS = T.StructType(_fields(("calc_base_dir", T.StringType()), ("name", T.StringType()), ("exp_dg", T.DoubleType()), ("exp_er", T.DoubleType()), ("calc_cor", T.DoubleType())))
