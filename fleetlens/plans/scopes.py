"""Names within scopes: two projects may have a relation of one name and don't know of each other."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

#: Parts a scope from a name inside a qualified name; neither may hold it.
UNIT = "\x1f"


def _qualified(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    if "scope" not in df.columns:
        raise ValueError("some inputs have a scope and some don't")
    # a name that is null stays null, and so meets no other
    return df.select(*[F.concat("scope", F.lit(UNIT), F.col(c).cast("string")).alias(c) if c in names else c for c in df.columns if c != "scope"])


def _restored(df: DataFrame, names: tuple[str, ...], kinds: dict[str, DataType]) -> DataFrame:
    held = [c for c in df.columns if c in names]
    if not held:
        return df
    bare = lambda c: F.regexp_replace(c, rf"(^|>)[^>{UNIT}]*{UNIT}", "$1").cast(kinds.get(c, StringType()))  # noqa: E731  # a path holds several names
    scope = F.coalesce(*[F.when(F.col(c).isNotNull(), F.substring_index(c, UNIT, 1)) for c in held])
    return df.select(scope.alias("scope"), *[bare(c).alias(c) if c in names else c for c in df.columns])


def by_scope(*names: str) -> Callable:
    """Let an operator over names work within scopes.

    Where its inputs have a column ``scope``, the columns ``names`` are joined to it, so that every
    join, aggregate and fixpoint of the operator is by scope and name, and the results get the scope
    back; names keep the types that the inputs give columns of their name. Inputs without a scope are taken as
    a single one, as they are.
    """

    def wrap(fn: Callable) -> Callable:
        @wraps(fn)
        def run(*args, **kwargs):
            frames = [a for a in args if isinstance(a, DataFrame)]
            if not any("scope" in f.columns for f in frames):
                return fn(*args, **kwargs)
            out = fn(*[_qualified(a, names) if isinstance(a, DataFrame) else a for a in args], **kwargs)
            kinds = {f.name: f.dataType for frame in frames for f in frame.schema}
            return tuple(_restored(o, names, kinds) for o in out) if isinstance(out, tuple) else _restored(out, names, kinds)

        return run

    return wrap
