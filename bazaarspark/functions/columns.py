"""Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp(limit: Column | int, lo: int, hi: int) -> Column:
    """A request's limit within bounds; null gives the lower one."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    return F.least(F.greatest(F.coalesce(limit, F.lit(lo)), F.lit(lo)), F.lit(hi))


def guarded(col: str) -> Column:
    """Text that is an unsigned decimal number as such; anything else (blanks, signs, separators, null) counts as 0."""
    return F.when(F.col(col).rlike(r"^[0-9]+(\.[0-9]+)?\z"), F.col(col).cast("decimal(38,10)")).otherwise(F.lit(0).cast("decimal(38,10)"))


def rounded(c: Column, places: int) -> Column:
    """A double rounded half up that keeps its sign, also that of a zero (:func:`round` makes every zero positive)."""
    return F.round(F.abs(c), places) * F.signum(c)


def total(col: str) -> Column:
    """Exact sum of guarded numbers, as a double at the very end."""
    return F.sum(guarded(col)).cast("double")


def mean(c: Column | str) -> Column:
    """The mean of numbers to six places each: their sum is exact, whatever the order."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast("decimal(18,6)")).cast("double") / F.count(c)


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: Column | int, rank: str = "rank") -> DataFrame:
    """The first rows of each key. Spark prunes each partition to its own first rows before it shuffles."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    return ranked.where(F.col(rank) <= limit)


def like_pattern(term: Column) -> Column:
    """``%term%`` for ILIKE. ``%`` and ``_`` of the term stay wildcards; a backslash before any other character is literal."""
    return F.concat(F.lit("%"), F.regexp_replace(term, r"\\(?![%_\\])", r"\\\\"), F.lit("%"))


def ilike_any(columns: Sequence[str], pattern: str) -> Column:
    """Whether any of the columns matches the pattern column."""
    return F.expr(" OR ".join(f"coalesce({c} ILIKE {pattern}, false)" for c in columns))


def any_holds(columns: Sequence[str], term: str, pattern: str) -> Column:
    """Whether any of the columns holds the term, whatever its case. Only terms with wildcards are matched as patterns, as
    a pattern column is compiled anew for every row."""
    plain = ~F.col(term).rlike(r"[%_\\]")
    held = F.contains(F.lower(F.concat_ws("\x01", *columns)), F.lower(F.col(term)))
    return F.when(plain, held).otherwise(ilike_any(columns, pattern))


def values_at(rows: DataFrame, key: str, col: str, places: dict[str, Callable[[Column], Column]], ranges: int = 1 << 14) -> DataFrame:
    """(key, place name, x): the values at places (from 0, as columns of the count) of each key's sorted values.

    Values are counted in ``ranges`` of equal width for each key; only the range that holds a place is then sorted, its equal values
    as one row, so that no task holds a key.
    """
    x = rows.where(F.col(col).isNotNull()).select(F.col(key).alias("k"), F.col(col).cast("double").alias("x"))
    stats = x.groupBy("k").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    s = stats.alias("s")
    share = (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    binned = x.alias("x").join(s, F.col("x.k").eqNullSafe(F.col("s.k"))).select("x.k", "x", F.when(F.col("hi") > F.col("lo"), F.least(F.floor(share * ranges), F.lit(ranges - 1))).otherwise(F.lit(0)).alias("bin"))
    counts = binned.groupBy("k", "bin").agg(F.count("*").alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("k").orderBy("bin"))).alias("b")
    wanted = stats.select("k", F.inline(F.array(*[F.struct(F.lit(name).alias("name"), place(F.col("n")).cast("long").alias("place")) for name, place in places.items()]))).alias("w")
    held = (F.col("place") >= F.col("upto") - F.col("c")) & (F.col("place") < F.col("upto"))
    here = upto.join(wanted, F.col("b.k").eqNullSafe(F.col("w.k"))).where(held).select("w.k", "w.name", "b.bin", (F.col("place") - F.col("upto") + F.col("c")).alias("inside")).alias("h")
    within = binned.alias("x").join(here, F.col("x.k").eqNullSafe(F.col("h.k")) & (F.col("x.bin") == F.col("h.bin")))
    equal = within.groupBy("h.k", "h.name", "h.inside", "x.x").agg(F.count("*").alias("c"))
    last = F.sum("c").over(Window.partitionBy("k", "name").orderBy("x"))
    found = equal.withColumn("upto", last).where((F.col("inside") >= F.col("upto") - F.col("c")) & (F.col("inside") < F.col("upto")))
    return found.select(F.col("k").alias(key), "name", "x")


#: Rows up to which the side of a join is broadcast.
FEW = 20_000


def side(df: DataFrame, few: int = FEW) -> DataFrame:
    """The side of a join that is broadcast if it has few rows, which are counted, and is sorted and merged if not. Spark goes by the bytes of
    files, which may be a small part of what a driver has to hold: rows that came from an explode or a join aren't counted in."""
    return F.broadcast(df) if df.limit(few + 1).count() <= few else df.hint("merge")


def is_blank(col: Column) -> Column:
    return F.length(F.trim(F.coalesce(col.cast("string"), F.lit("")))) == 0


def check_requests(requests: DataFrame, required: Sequence[str], limits: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Requests with ``status`` ('ok' or the first blank argument) and their limits within bounds."""
    status = F.coalesce(*[F.when(is_blank(F.col(c)), F.lit(f"blank_{c}")) for c in required], F.lit("ok"))
    out = requests.withColumn("status", status)
    for col, (lo, hi) in (limits or {}).items():
        out = out.withColumn(col, clamp(F.col(col), lo, hi))
    return out


def result_payload(results: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One JSON text for each key: found, and its rows without nulls, in order."""
    fields = [c for c in results.columns if c not in keys]
    rows = F.array_sort(F.collect_list(F.struct(*order, *[c for c in fields if c not in order])))
    return results.groupBy(*keys).agg(rows.alias("rows")).select(*keys, F.to_json(F.struct((F.size("rows") > 0).alias("found"), F.col("rows").alias("results"))).alias("payload"))
