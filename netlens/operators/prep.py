"""Imputation, scaling and encoding, fitted on one frame and applied to any (PP1-PP8)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netlens.functions.codegen import short_methods
from netlens.functions.numbers import clean_double
from netlens.operators.profile import feature_types

SMALL = 100_000
ACCURACY = 1_000
MAX_CATEGORIES = 100_000


def _number(name: str) -> Column:
    return clean_double(F.col(f"`{name}`"))


def exact_medians(df: DataFrame, columns: Sequence[str], small: int = SMALL) -> dict[str, float | None]:
    """PP1: interpolated medians of all columns.

    Up to ``small`` values per column one aggregation does it. Beyond, an
    approximate percentile with a guaranteed rank error brackets each median, and
    only the values inside the bracket (under a hundredth of the rows, counted per
    value) are ordered.
    """
    if not columns:
        return {}
    with short_methods(df.sparkSession):
        return _medians(df, columns, small)


def _medians(df: DataFrame, columns: Sequence[str], small: int) -> dict[str, float | None]:
    names = [f"n{i}" for i in range(len(columns))]
    numbers = df.select(*[_number(c).alias(n) for c, n in zip(columns, names, strict=True)])
    counts = numbers.agg(*map(F.count, names)).first()
    if max(counts) <= small:
        row = numbers.agg(*[F.percentile(n, F.lit(0.5)) for n in names]).first()
        return dict(zip(columns, row, strict=True))
    edge = 2 / ACCURACY
    bracket = numbers.agg(*[F.percentile_approx(n, [0.5 - edge, 0.5 + edge], ACCURACY) for n in names]).first()
    found: dict[str, float | None] = dict.fromkeys(columns)
    values = []  # beside the bracket: all smaller ones as one, larger ones left out
    for c, ends in zip(columns, bracket, strict=True):
        low, top = ends or (None, None)
        values.append(F.when(_number(c) < low, F.lit(float("-inf"))).when(_number(c) <= top, _number(c)))
    upto = Window.partitionBy("at").orderBy("value")
    ranks = (
        df.select(F.array(*values).alias("values"))
        .select(F.posexplode("values").alias("at", "value"))
        .where("value is not null")
        .groupBy("at", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(upto))
    )

    def at_rank(ranks_of: list[int]) -> Column:
        rank = F.get(F.array(*map(F.lit, ranks_of)), F.col("at"))
        return F.max(F.when((F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto")), F.col("value")))

    picked = ranks.groupBy("at").agg(
        at_rank([max(0, n - 1) // 2 for n in counts]).alias("low"), at_rank([n // 2 for n in counts]).alias("high")
    )
    for r in picked.collect():  # one row per column
        found[columns[r["at"]]] = (r["low"] + r["high"]) / 2
    return found


def most_frequent(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """PP3: the most frequent value, the smallest of several, per column."""
    out = {}
    for c in columns:
        top = (
            df.where(F.col(f"`{c}`").isNotNull())
            .groupBy(F.col(f"`{c}`").cast("string").alias("v"))
            .count()
            .orderBy(F.desc("count"), "v")
            .first()
        )
        out[c] = top["v"] if top else None
    return out


@dataclass
class Preprocessor:
    """Fitted values only, so it is saved as JSON and applied as plain expressions."""

    numeric: list[str]
    categorical: list[str]
    scaled: bool
    medians: dict[str, float | None] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    deviations: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str | None] = field(default_factory=dict)
    categories: dict[str, list[str]] = field(default_factory=dict)

    @property
    def input_columns(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    @property
    def feature_names(self) -> list[str]:
        """PP6: numeric names, then ``column_value`` names."""
        return [*self.numeric, *[f"{c}_{v}" for c in self.categorical for v in self.categories[c]]]

    def imputed(self, name: str) -> Column:
        if name in self.medians:
            return F.coalesce(_number(name), F.lit(self.medians[name]))
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(self.modes[name]))

    def columns(self) -> list[Column]:
        """PP5: one double per feature, numeric block first."""
        out = []
        for c in self.numeric:
            value = self.imputed(c)
            if self.scaled:  # PP2: a constant column becomes 0
                value = (value - F.lit(self.means[c])) / F.lit(self.deviations[c] or 1.0)
            out.append(value)
        for c in self.categorical:  # PP4: an unknown value matches no category
            out += [F.coalesce((self.imputed(c) == v).cast("double"), F.lit(0.0)) for v in self.categories[c]]
        return out

    def transform(self, df: DataFrame, keep: Sequence[str], vector: bool = True) -> DataFrame:
        """``keep`` columns and ``features`` (array, or ML vector)."""
        packed = F.array(*self.columns()).cast("array<double>")
        return df.select(*keep, (array_to_vector(packed) if vector else packed).alias("features"))

    def to_dict(self) -> dict:
        return asdict(self)


def fit_preprocessor(
    df: DataFrame,
    numeric: Sequence[str] | None = None,
    categorical: Sequence[str] | None = None,
    scale: bool = True,
    exclude: Sequence[str] = (),
) -> Preprocessor:
    """PP7: ``scale`` only for models that need it."""
    if numeric is None or categorical is None:
        numeric, categorical = feature_types(df, exclude)
    prep = Preprocessor(list(numeric), list(categorical), scale)
    prep.medians = exact_medians(df, prep.numeric)
    empty = [c for c, m in prep.medians.items() if m is None]
    if empty:  # nothing to learn from: the column is left out
        prep.numeric = [c for c in prep.numeric if c not in empty]
        prep.medians = {c: prep.medians[c] for c in prep.numeric}
    if scale and prep.numeric:
        aggs = [f(prep.imputed(c)) for c in prep.numeric for f in (F.avg, F.stddev_pop)]
        with short_methods(df.sparkSession):
            row = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first()
        prep.means = {c: row[2 * i] for i, c in enumerate(prep.numeric)}
        prep.deviations = {c: row[2 * i + 1] for i, c in enumerate(prep.numeric)}
    prep.modes = most_frequent(df, prep.categorical)
    for c in prep.categorical:
        seen = df.select(prep.imputed(c).alias("v")).where("v is not null").distinct().limit(MAX_CATEGORIES + 1)
        values = sorted(r[0] for r in seen.collect())
        if len(values) > MAX_CATEGORIES:
            raise ValueError(f"Column '{c}' has more than {MAX_CATEGORIES} categories; one-hot encoding is no use.")
        prep.categories[c] = values
    return prep
