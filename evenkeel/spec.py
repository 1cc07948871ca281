"""Column roles of a table and the checks that go with them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class FeatureSpec:
    """Names of the label, the unique key and the feature columns."""

    label: str
    key: str
    continuous: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "continuous", tuple(self.continuous))
        object.__setattr__(self, "categorical", tuple(self.categorical))
        names = [self.label, self.key, *self.continuous, *self.categorical]
        if len(set(names)) != len(names):
            raise ValueError(f"a column has two roles: {names}")

    @classmethod
    def infer(cls, df: DataFrame, label: str, key: str) -> "FeatureSpec":
        """Text and boolean columns are categorical, every other one continuous."""
        kinds = (T.StringType, T.BooleanType)
        rest = [f for f in df.schema.fields if f.name not in (label, key)]
        return cls(
            label,
            key,
            tuple(f.name for f in rest if not isinstance(f.dataType, kinds)),
            tuple(f.name for f in rest if isinstance(f.dataType, kinds)),
        )

    @property
    def features(self) -> list[str]:
        return [*self.continuous, *self.categorical]

    @property
    def columns(self) -> list[str]:
        return [self.key, *self.features, self.label]

    def with_features(self, continuous: Iterable[str], categorical: Iterable[str]) -> "FeatureSpec":
        return replace(self, continuous=tuple(continuous), categorical=tuple(categorical))

    def require(self, df: DataFrame) -> DataFrame:
        """The columns of the spec, or an error that names the missing ones."""
        missing = [c for c in self.columns if c not in df.columns]
        if missing:
            raise ValueError(f"columns {missing} are not in the table")
        return df.select(*self.columns)


def check_feature_order(columns: Sequence[str], spec: FeatureSpec) -> None:
    """Continuous columns must come before categorical ones."""
    place = {c: i for i, c in enumerate(columns)}
    missing = [c for c in spec.features if c not in place]
    if missing:
        raise ValueError(f"columns {missing} are not in the table")
    if spec.continuous and spec.categorical:
        if max(place[c] for c in spec.continuous) > min(place[c] for c in spec.categorical):
            raise ValueError("features must be ordered continuous first, then categorical")


def reject_nulls(df: DataFrame, spec: FeatureSpec) -> None:
    """Raise when a feature, the label or the key is null (one pass, one row back)."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in spec.columns]).first()
    bad = {c: counts[c] for c in spec.columns if counts[c]}
    if bad:
        raise ValueError(f"null values in {bad}; fill them before resampling")
