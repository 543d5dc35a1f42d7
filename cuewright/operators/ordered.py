"""Previous and next values along a key's order, with the key split into time cells.

A plain ``lag`` over one key puts all rows of that key into one task, and one recording may hold a third of all rows.
Here a window runs over (key, cell), and the value that crosses a cell's edge comes from a summary with one row per
non-empty cell, which is the only thing that is ever ordered over a whole key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Width of a time cell: an hour holds some thousands of cues at most.
CELL_MS = 3_600_000


def cell(at: Column, width: int = CELL_MS) -> Column:
    return F.floor(at / F.lit(width)).cast("bigint")


#: Parts into which a key's rows are split where a table with one row a key is joined to them.
SALTS = 8


def salted(df: DataFrame, by: str, name: str = "_salt") -> DataFrame:
    """Add a number below :data:`SALTS` that follows from the column ``by``."""
    return df.withColumn(name, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def spread(one: DataFrame, name: str = "_salt") -> DataFrame:
    """A table with one row a key, repeated for every salt. Joined on key and salt, a hot key's rows go to that many tasks.

    It is never broadcast: repeated rows compress well, so their size on the way says little of that in memory.
    """
    return one.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")


def join_one(df: DataFrame, one: DataFrame, key: str, by: str, how: str = "left") -> DataFrame:
    """Join a table with one row a ``key`` to one with any number, whose rows the column ``by`` tells apart."""
    return salted(df, by).join(spread(one), [key, "_salt"], how).drop("_salt")


def _known(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def neighbour(df: DataFrame, keys: list[str], by: list[str], values: list[str], prefix: str, forward: bool = False, cell_column: str = "_cell") -> DataFrame:
    """Add ``prefix + value`` for each of ``values``: that of the row before (``forward``: after) in the order ``by``.

    ``cell_column`` must grow with the first column of ``by``, which must not be null; rows equal in ``by`` count as in
    any order. The first row of a key gets nulls. Rows with a null key are left out.

    Window, summary and join all go by (key, cell), so the rows are shuffled and sorted once.
    """
    df = df.where(_known(keys))
    order = [F.col(c).desc() if forward else F.col(c).asc() for c in by]
    near = Window.partitionBy(*keys, cell_column).orderBy(*order)
    edge = (F.min_by if forward else F.max_by)(F.struct(*values), F.struct(*by))
    # the last row of each cell, handed to the next non-empty cell of the same key
    along = Window.partitionBy(*keys).orderBy(F.col(cell_column).desc() if forward else F.col(cell_column).asc())
    edges = df.groupBy(*keys, cell_column).agg(edge.alias("_edge")).withColumn("_edge", F.lag("_edge").over(along))
    here = df.withColumn("_near", F.lag(F.struct(*values)).over(near)).withColumn("_first", F.row_number().over(near) == 1)
    a, b = here.alias("a"), edges.alias("b")
    match = F.lit(True)
    for k in [*keys, cell_column]:
        match = match & (F.col(f"a.`{k}`") == F.col(f"b.`{k}`"))
    joined = a.join(b, match, "left")
    got = F.when(F.col("a._first"), F.col("b._edge")).otherwise(F.col("a._near"))
    return joined.select(*[F.col(f"a.`{c}`") for c in df.columns], *[got.getField(v).alias(prefix + v) for v in values])


def running(df: DataFrame, keys: list[str], by: list[str], values: dict[str, tuple[str, str]], cell_column: str = "_cell") -> DataFrame:
    """Add running values of the rows *before* each row in the order ``by``: name -> (``sum``, ``max`` or ``last``, column).

    As in :func:`neighbour`, a window runs over (key, cell), and what earlier cells add comes from one row per cell.
    ``last`` skips nulls; a sum is 0 where nothing came before. Rows equal in ``by`` count as in any order. Rows with a
    null key are left out.
    """
    df = df.where(_known(keys))
    near = Window.partitionBy(*keys, cell_column).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(*keys).orderBy(cell_column).rowsBetween(Window.unboundedPreceding, -1)
    over = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    whole = {"sum": F.sum, "max": F.max, "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*by)))}
    join = {
        "sum": lambda before, here: F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0)),
        "max": lambda before, here: F.greatest(before, here),
        "last": lambda before, here: F.coalesce(here, before),
    }
    cells = df.groupBy(*keys, cell_column).agg(*[whole[kind](c).alias("_b_" + name) for name, (kind, c) in values.items()])
    cells = cells.select(*keys, cell_column, *[over[kind]("_b_" + name).over(along).alias("_b_" + name) for name, (kind, _) in values.items()])
    here = df.select("*", *[over[kind](c).over(near).alias("_h_" + name) for name, (kind, c) in values.items()])
    a, b = here.alias("a"), cells.alias("b")
    match = F.lit(True)
    for k in [*keys, cell_column]:
        match = match & (F.col(f"a.`{k}`") == F.col(f"b.`{k}`"))
    found = [join[kind](F.col("b._b_" + name), F.col("a._h_" + name)).alias(name) for name, (kind, _) in values.items()]
    return a.join(b, match).select(*[F.col(f"a.`{c}`") for c in df.columns], *found)
