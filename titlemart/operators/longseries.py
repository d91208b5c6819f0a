"""Kendall's S and the median slope of a series of any length, without making its pairs.

Both rest on one count: among rows in one order, the pairs that another value puts the other way round.  A series is cut into blocks
by its order and dealt into bins by the value, in ranges.  Pairs inside a block are counted where the block lies, pairs of two blocks inside a bin where
the bin lies, and all others by how many rows each block has in each bin.  A block is at most the 256th part of a series or 4,096 rows; no task holds a series,
and a count shuffles each row once.

Slopes below t are such pairs of y - t * i.  The median is found by selection: slopes of sampled pairs, then simple fractions near
the place that a line through the counted ends foretells, are pivots; all pairs are counted at the pivots, and the bracket closes until few slopes are left, which
are then made and sorted.  The counts are of all pairs, so the result is exact whatever was sampled or foretold.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .keys import running

#: Slopes are made once at most so many a row, and so many in all, are left in the bracket.
FEW, MOST = 64, 1 << 22
#: About so many pairs of a series propose pivots in a round.
SAMPLE = 1 << 17
#: At most so many blocks of a series, of so many rows at least.
BLOCKS, LEAST = 256, 4096
#: About so many rows lie in a partition.
ROWS = 1 << 18
#: Tables of a row a series are broadcast up to so many.
BROADCAST = 1 << 20


def _parts(df: DataFrame, rows: int) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS))


def _near(few: DataFrame) -> DataFrame:
    return F.broadcast(few) if few.count() <= BROADCAST else few


def dealt(series: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Of (g, i, y): sizes (g, id, n and the ends of i), rows (id, n, place, block, i, y) dealt by block, and the number of rows.  ``i`` are unique in a group, ``g`` is not null."""
    placed = series.select("g", F.col("i").cast("bigint").alias("i"), F.col("y").cast("double").alias("y"))
    known = placed.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("least"), F.max("i").alias("most"))
    sizes = cut(known.withColumn("id", F.monotonically_increasing_id()))
    total, gaps = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max(F.col("most") - F.col("least") >= F.col("n") * 4)).first()
    place = F.col("i") - F.col("least")
    if gaps:
        # Numbers with wide gaps are numbered anew, as blocks are cut by place.
        placed, place = running(placed.withColumn("one", F.lit(1).cast("bigint")), ["g", "i"], "one", "y"), F.col("before")
    rows = placed.join(_near(sizes), "g").withColumn("place", place).select("id", "n", "place", _block("place").alias("block"), "i", "y")
    return sizes, cut(rows.repartition(_parts(series, total), "id", "block")), total


def _block(place: str) -> Column:
    width = F.greatest(F.lit(LEAST), F.ceil(F.col("n") / BLOCKS))
    return F.floor(F.col(place) / width).cast("bigint")


def _levels(rank: np.ndarray) -> Iterator[tuple]:
    """A permutation of 0..n-1, parted stably by its bits from the highest down: each level's (values, ones before in their block, blocks' starts, bit, next values)."""
    at = np.arange(len(rank))
    for b in range((len(rank) - 1).bit_length() - 1, -1, -1):
        bit = (rank >> b) & 1
        start = rank >> (b + 1) << (b + 1)
        sums = np.concatenate(([0], np.cumsum(bit)))
        ones = sums[:-1] - sums[start]
        parted = np.empty_like(rank)
        parted[(rank >> b << b) + np.where(bit == 0, at - start - ones, ones)] = rank
        yield rank, ones, start + (1 << b), bit == 0, parted
        rank = parted


def _ranked(first: tuple, then: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Rows' places in the order ``then`` as they come in the order ``first``, and the rows in the order ``then``.  Keys as of ``lexsort``: the last one counts most.

    Where ``first`` is empty, rows come in the order in which they are.
    """
    go = np.lexsort(then)
    come = np.lexsort(first) if first else slice(None)
    rank = np.empty(len(go), np.int64)
    rank[go] = np.arange(len(go))
    return rank[come], go


def _turned(first: tuple, then: tuple, key: np.ndarray) -> pd.DataFrame:
    """Pairs in one order in ``first`` and the other in ``then``, by ``key``, which leads both orders."""
    rank, go = _ranked(first, then)
    against = np.zeros(len(rank), np.int64)
    for values, ones, _, zero, _ in _levels(rank):
        against[values[zero]] += ones[zero]
    keys, code = np.unique(key[go], return_inverse=True)
    k = np.zeros(len(keys), np.int64)
    np.add.at(k, code, against)
    return pd.DataFrame({"pid": keys, "k": k})


def _pairs(first: tuple, then: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The pairs themselves, as numbers of rows."""
    rank, go = _ranked(first, then)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for values, ones, begin, zero, parted in _levels(rank):
        some = zero & (ones > 0)
        n = ones[some]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        left.append(np.repeat(values[some], n))
        right.append(parted[np.repeat(begin[some], n) + nth])
    return go[np.concatenate(left)], go[np.concatenate(right)]


def _whole(batches: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    """A partition's rows, if it has any."""
    held = [b for b in batches if len(b)]
    return pd.concat(held, ignore_index=True) if held else None


def _by_place(x: pd.DataFrame, *columns: str) -> list[np.ndarray]:
    """Columns of a partition in the order of (pid, place), to which stable sorts fall back."""
    order = np.lexsort((x["place"].to_numpy(), x["pid"].to_numpy()))
    return [x[c].to_numpy()[order] for c in columns]


def _code(pid: np.ndarray, block: np.ndarray) -> np.ndarray:
    """One number for both, in their order; blocks are few hundreds a series."""
    _, code = np.unique(pid, return_inverse=True)
    return code * (int(block.max()) + 1) + block


_COUNTS = "kind string, pid bigint, bin int, block bigint, z double, k bigint"


def _inside_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs inside blocks, of which a partition holds whole ones."""
    if (x := _whole(batches)) is not None:
        pid, block, z = _by_place(x, "pid", "block", "z")
        yield _turned((), (z, _code(pid, block)), pid).assign(kind="less", bin=0, block=0, z=0.0)[_columns(_COUNTS)]


def _inside_bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a bin: pairs of two blocks, rows by block, pairs of equal values, and the first and last value, which may go on in the next bins."""
    if (x := _whole(batches)) is None:
        return
    pid, block, z = _by_place(x, "pid", "block", "z")
    less = _turned((z, _code(pid, block)), (z, pid), pid).assign(kind="less", block=0, z=0.0)
    cells = x.groupby(["pid", "block"]).size().rename("k").reset_index().assign(kind="cell", z=0.0)
    runs = x.groupby(["pid", "z"]).size().rename("k").reset_index()
    ends = runs.pid.ne(runs.pid.shift()) | runs.pid.ne(runs.pid.shift(-1))
    within = runs[~ends].assign(k=lambda r: r.k * (r.k - 1) // 2).groupby("pid").k.sum().reset_index().assign(kind="alike", block=0, z=0.0)
    bin_ = int(x["bin"].iloc[0])
    for part in (less, cells, within, runs[ends].assign(kind="end", block=0)):
        yield part.assign(bin=bin_)[_columns(_COUNTS)]


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _cells(x: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by block and bin as a table, with the numbers of both."""
    blocks, b = np.unique(x["block"].to_numpy(), return_inverse=True)
    bins, c = np.unique(x["bin"].to_numpy(), return_inverse=True)
    table = np.zeros((len(blocks), len(bins)), np.int64)
    table[b, c] = x["k"].to_numpy()
    return table, blocks, bins


def _between_cells(x: pd.DataFrame) -> pd.DataFrame:
    """Pairs of an earlier block and a later bin with a later block and an earlier bin."""
    table, _, _ = _cells(x)
    before = np.zeros_like(table)
    before[1:, :-1] = table[:-1, ::-1].cumsum(0).cumsum(1)[:, ::-1][:, 1:]
    return pd.DataFrame({"pid": [x["pid"].iloc[0]], "k": [int((table * before).sum())]})


def _crossed(x: pd.DataFrame) -> pd.DataFrame:
    """The pairs of cells whose rows are all such pairs."""
    block, bin_ = x["block"].to_numpy(), x["bin"].to_numpy()
    found = [(k, m) for k in range(len(x)) for m in np.flatnonzero((block > block[k]) & (bin_ < bin_[k]))]
    one, two = (np.array([f[s] for f in found], np.int64) for s in (0, 1))
    return pd.DataFrame({"pid": x["pid"].iloc[0], "block": block[one], "bin": bin_[one], "block2": block[two], "bin2": bin_[two]})


def _against(rows: DataFrame, n: int) -> DataFrame:
    """Of (pid, block, place, z) dealt by block: (pid, less, alike), pairs in order of place whose z falls, and whose z is equal."""
    inside = rows.mapInPandas(_inside_blocks, _COUNTS)
    binned = rows.repartitionByRange(_parts(rows, n), "pid", "z", "place").withColumn("bin", F.spark_partition_id())
    counts = cut(binned.mapInPandas(_inside_bins, _COUNTS).union(inside))
    between = counts.filter("kind = 'cell'").groupBy("pid").applyInPandas(_between_cells, "pid bigint, k bigint").select("pid", F.lit("less").alias("kind"), "k")
    ends = counts.filter("kind = 'end'").groupBy("pid", "z").agg(F.sum("k").alias("k")).select("pid", F.lit("alike").alias("kind"), F.expr("k * (k - 1) div 2").alias("k"))
    parts = counts.filter("kind IN ('less', 'alike')").select("pid", "kind", "k").union(between).union(ends)
    return parts.groupBy("pid").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == c, F.col("k"))), F.lit(0)).alias(c) for c in ("less", "alike")))


def kendall_s(sizes: DataFrame, rows: DataFrame, total: int) -> DataFrame:
    """Of ``dealt``: (g, s), rising pairs less falling ones."""
    counted = _against(rows.select(F.col("id").alias("pid"), "block", "place", (F.col("y") + 0.0).alias("z")), total)
    return sizes.join(counted.withColumnRenamed("pid", "id"), "id").select("g", F.expr("n * (n - 1) div 2 - alike - 2 * less").cast("double").alias("s"))


def _simplest(low: Fraction, high: Fraction) -> Fraction:
    """The fraction of smallest denominator in a closed range."""
    if low <= 0 <= high:
        return Fraction(0)
    if high < 0:
        return -_simplest(-high, -low)
    whole = -(-low.numerator // low.denominator)
    if whole <= high:
        return Fraction(whole)
    down = whole - 1
    return down + 1 / _simplest(1 / (high - down), 1 / (low - down))


def _foretold(low: float, high: float, aim: float) -> list[tuple[float, float]]:
    """Fractions (p, q) between both ends: near where the ``aim``-th part of the slopes would be on a line, and the simplest of all."""
    lo, hi = Fraction(low), Fraction(high)
    wide = hi - lo
    at = lo + wide * Fraction(aim)
    found = {_simplest(lo + wide / 8, hi - wide / 8)}
    for far in (Fraction(1, 50), Fraction(1, 200)):
        found |= {_simplest(x - wide * far / 4, x + wide * far / 4) for x in (at - wide * far, at + wide * far)}
    return [(float(f.numerator), float(f.denominator)) for f in found if low < float(f) < high and f.denominator < 2**31]


def _sampled(rows: DataFrame, round_: int) -> DataFrame:
    """(id, p, q): rise and run of about ``SAMPLE`` pairs of a series."""
    some = rows.filter(F.pmod(F.xxhash64("id", "i", F.lit(round_)), F.ceil(F.col("n") / SAMPLE)) == 0)
    w = W.partitionBy("id").orderBy(F.xxhash64("i", F.lit(-1 - round_)), "i")
    both = some.select("id", "i", "y", F.lead("i").over(w).alias("j"), F.lead("y").over(w).alias("z")).filter("j IS NOT NULL")
    turn = F.signum(F.col("j") - F.col("i"))
    return both.select("id", ((F.col("z") - F.col("y")) * turn).alias("p"), F.abs(F.col("j") - F.col("i")).cast("double").alias("q"))


def _slope(end: str) -> Column:
    return F.col(f"{end}.p") / F.col(f"{end}.q")


def _brackets(state: DataFrame) -> DataFrame:
    """(id, low, high, aim): searches for different places share a bracket while their ends are the same."""
    aim = (F.col("k") - F.col("below")) / (F.col("above") - F.col("below"))
    return state.groupBy("id", "low", "high").agg(F.avg(aim).alias("aim"))


def _pivots(rows: DataFrame, searches: DataFrame, round_: int) -> DataFrame:
    """(pid, id, p, q): slopes at which all pairs are to be counted, inside the brackets."""
    brackets = cut(_brackets(searches).withColumn("bid", F.monotonically_increasing_id()))
    inside = (_slope("low").isNull() | (F.col("slope") > _slope("low"))) & (_slope("high").isNull() | (F.col("slope") < _slope("high")))
    met = _sampled(rows, round_).withColumn("slope", F.col("p") / F.col("q")).join(_near(brackets), "id").filter(inside)
    w = W.partitionBy("bid")
    upto = F.row_number().over(w.orderBy("slope", "q", "p")) / F.count(F.lit(1)).over(w)
    placed = met.select("bid", "id", "slope", "aim", F.struct("p", "q").alias("pair"), upto.alias("upto"), (1.5 / F.sqrt(F.count(F.lit(1)).over(w))).alias("room"))
    drawn = placed.groupBy("bid", "id").agg(
        F.max_by("pair", F.when(F.col("upto") <= F.col("aim") - F.col("room"), F.col("slope"))).alias("a"),
        F.min_by("pair", F.when(F.col("upto") >= F.col("aim"), F.col("slope"))).alias("b"),
        F.min_by("pair", F.when(F.col("upto") >= F.col("aim") + F.col("room"), F.col("slope"))).alias("c"),
    )
    of = F.udf(lambda low, high, aim: _foretold(low, high, aim), "array<struct<p: double, q: double>>")
    told = brackets.filter("low IS NOT NULL AND high IS NOT NULL").select("id", F.explode(of(_slope("low"), _slope("high"), "aim")).alias("x"))
    both = drawn.select("id", F.explode(F.array_compact(F.array("a", "b", "c"))).alias("x")).union(told).select("id", "x.p", "x.q")
    return cut(both.groupBy("id", (F.col("p") / F.col("q")).alias("slope")).agg(F.min_by(F.struct("p", "q"), F.struct("q", "p")).alias("x")).select("id", "x.p", "x.q").withColumn("pid", F.monotonically_increasing_id()))


def _closed(rows: DataFrame, total: int, state: DataFrame, searches: DataFrame, pivots: DataFrame) -> DataFrame:
    """The searches after all pairs were counted at the pivots: those found have their slope, the others a smaller bracket.

    A bracket without a pivot has no number between its ends: they are one slope but for rounding.
    """
    at = (F.col("q") * F.col("y") - F.col("p") * F.col("i") + 0.0).alias("z")
    counted = _against(rows.join(_near(pivots), "id").select("pid", "block", "place", at), total * 8)
    seen = pivots.join(counted, "pid").select(
        "id", F.struct("p", "q").alias("pair"), (F.col("p") / F.col("q")).alias("slope"), "less", (F.col("less") + F.col("alike")).alias("most")
    )
    above_low = F.col("low").isNull() | (F.col("slope") > _slope("low"))
    below_high = F.col("high").isNull() | (F.col("slope") < _slope("high"))
    low, high = F.when(F.col("most") < F.col("k"), F.col("slope")), F.when(F.col("less") >= F.col("k"), F.col("slope"))
    ends = searches.join(seen, "id").filter(above_low & below_high).groupBy("id", "k").agg(
        F.max(F.when((F.col("less") < F.col("k")) & (F.col("k") <= F.col("most")), F.col("slope"))).alias("hit"),
        F.max_by("pair", low).alias("l"), F.max(F.when(low.isNotNull(), F.col("most"))).alias("b"),
        F.min_by("pair", high).alias("h"), F.min(F.when(high.isNotNull(), F.col("less"))).alias("a"), F.count(F.lit(1)).alias("seen"),
    )
    asked = searches.select("id", "k", F.lit(True).alias("asked"))
    stuck = F.when(F.col("asked") & F.col("seen").isNull() & F.col("low").isNotNull() & F.col("high").isNotNull(), _slope("high"))
    return state.join(ends, ["id", "k"], "left").join(asked, ["id", "k"], "left").select(
        "id", "k", "n", F.coalesce("found", "hit", stuck).alias("found"), F.coalesce("l", "low").alias("low"), F.coalesce("h", "high").alias("high"),
        F.coalesce("b", "below").alias("below"), F.coalesce("a", "above").alias("above"),
    )


_MET = "pid bigint, p double, q double"


def _met(x: pd.DataFrame, first: tuple, then: tuple) -> pd.DataFrame:
    one, two = _pairs(first, then)
    i, y = x["i"].to_numpy(), x["y"].to_numpy()
    return pd.DataFrame({"pid": x["pid"].to_numpy()[one], "p": y[one] - y[two], "q": (i[one] - i[two]).astype(float)})


def _met_in_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    if (x := _whole(batches)) is not None:
        pid, block, place, z = (x[c].to_numpy() for c in ("pid", "block", "place", "z"))
        yield _met(x, (place, block, pid), (place, z, block, pid))


def _met_in_bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    if (x := _whole(batches)) is not None:
        pid, block, place, z, bin_ = (x[c].to_numpy() for c in ("pid", "block", "place", "z", "bin"))
        yield _met(x, (place, z, block, bin_, pid), (place, z, bin_, pid))


def _left(rows: DataFrame, total: int, brackets: DataFrame) -> DataFrame:
    """(pid, p, q): the pairs with a slope between both ends: in order at the low end, the other way round at the high one."""
    own = rows.join(_near(brackets), "id")
    low = F.when(F.col("low").isNull(), F.col("i")).otherwise(F.col("low.q") * F.col("y") - F.col("low.p") * F.col("i")) + 0.0
    high = F.when(F.col("high").isNull(), -F.col("i")).otherwise(F.col("high.q") * F.col("y") - F.col("high.p") * F.col("i")) + 0.0
    # A slope that equals the low end is not inside: rows alike there come backwards.
    at = own.select(F.col("bid").alias("pid"), F.struct(low.alias("low"), (-F.col("i")).alias("back")).alias("at"), high.alias("z"), "n", "i", "y", F.lit(1).cast("bigint").alias("one"))
    placed = running(at, ["pid", "at"], "one", "z", "n", "i", "y").select("pid", F.col("before").alias("place"), _block("before").alias("block"), "z", "i", "y")
    parts = _parts(rows, total * 2)
    binned = cut(placed.repartitionByRange(parts, "pid", "z", "place").withColumn("bin", F.spark_partition_id()))
    pairs = binned.groupBy("pid", "block", "bin").count().groupBy("pid").applyInPandas(_crossed, "pid bigint, block bigint, bin int, block2 bigint, bin2 int")
    ends = lambda k: binned.select("pid", F.col("block").alias(f"block{k}"), F.col("bin").alias(f"bin{k}"), F.col("i").alias(f"i_{k}"), F.col("y").alias(f"y_{k}"))
    far = pairs.join(ends(""), ["pid", "block", "bin"]).join(ends("2"), ["pid", "block2", "bin2"])
    far = far.select("pid", (F.col("y_2") - F.col("y_")).alias("p"), (F.col("i_2") - F.col("i_")).cast("double").alias("q"))
    return binned.repartition(parts, "pid", "block").mapInPandas(_met_in_blocks, _MET).union(binned.mapInPandas(_met_in_bins, _MET)).union(far)


def median_slope(sizes: DataFrame, rows: DataFrame, total: int) -> DataFrame:
    """Of ``dealt``: (g, slope), the median of (y of j less y of i) / (j - i) over all pairs i < j; groups of one row have none.

    Where y are whole numbers whose products with i a double holds, the result is exact; for others slopes that differ only in rounding may count as one.
    """
    end = F.expr("CAST(NULL AS STRUCT<p: DOUBLE, q: DOUBLE>)")
    paired = sizes.withColumn("pairs", F.expr("n * (n - 1) div 2")).filter("pairs > 0")
    places = F.array_distinct(F.array(F.expr("(pairs + 1) div 2"), F.expr("pairs div 2 + 1")))
    state = cut(
        paired.select(
            "id", F.explode(places).alias("k"), "n", F.lit(None).cast("double").alias("found"), end.alias("low"), end.alias("high"),
            F.lit(0).cast("bigint").alias("below"), F.col("pairs").alias("above"),
        )
    )
    wide = F.col("found").isNull() & (F.col("above") - F.col("below") > F.least(FEW * F.col("n"), F.lit(MOST)))
    round_ = 0
    while not (searches := state.filter(wide)).isEmpty():
        state = cut(_closed(rows, total, state, searches, _pivots(rows, searches, round_)))
        round_ += 1
    few = state.filter(F.col("found").isNull())
    brackets = cut(_brackets(few).withColumn("bid", F.monotonically_increasing_id()))
    nth = F.row_number().over(W.partitionBy("pid").orderBy("slope"))
    left = _left(rows, total, brackets).select("pid", (F.col("p") / F.col("q")).alias("slope")).withColumn("nth", nth)
    asked = few.alias("s").join(brackets.alias("b"), (F.col("s.id") == F.col("b.id")) & F.col("s.low").eqNullSafe(F.col("b.low")) & F.col("s.high").eqNullSafe(F.col("b.high")))
    asked = asked.select("s.id", F.col("bid").alias("pid"), (F.col("k") - F.col("below")).alias("nth"))
    found = state.filter(F.col("found").isNotNull()).select("id", F.col("found").alias("slope")).union(left.join(asked, ["pid", "nth"]).select("id", "slope"))
    return sizes.join(found.groupBy("id").agg(F.avg("slope").alias("slope")), "id").select("g", "slope")
