"""Best-fit packing by a configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits a sequence.  The program covers every
length's count with as few configurations as possible.  It is solved by multiplicative
weights: a length's price grows exponentially with the cover that it lags behind, a
knapsack dynamic program finds the best configuration under the prices, and every round
takes configurations within a tolerance of the best.  The dynamic program also gives a
lower bound (prices over the best price are feasible for the dual program), and the loop
stops when the fractional solution is within a stated gap of it.  Where a hard histogram
is not that near after some rounds, the program restricted to the configurations found is
solved by an interior point method, and its prices, by the same dynamic program, give the
next configurations and bounds until the gap is met.  The solution is rounded
within what is left of each length, configurations of few pieces first; the program is
solved again for what remains, and the last few pieces are packed best fit.  All of this sees the
histogram alone (at most ``capacity`` numbers); pieces meet their places by their rank
within their length, in Spark.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from masswright.session import ship_package

from .common import bucket_bits, stage_table
from .tokens import slices, word_encoder

#: The gap to the lower bound at which the program counts as solved.
GAP = 0.005
#: Rounds of multiplicative weights before the restricted program takes over.
ROUNDS = 32
#: A price grows by this power of e for every round that a length's cover lags behind.
ETA = 0.02
#: Configurations are taken if their price is at most this share below the best.
DELTA = 0.004
#: Shares of the prices of the best bound in those at which a restricted program's solution is priced.
SHARES = (0.9, 0.7, 0.5, 0.3, 0.0)
#: Pairs of lengths within configurations that an interior point step adds up one by one, at most.
PAIRS = 2_000_000

#: Indices of lengths, how often each occurs, and the number of sequences of this kind.
Pattern = tuple[np.ndarray, np.ndarray, int]


def price_capacities(lengths: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """The largest value of a multiset of pieces that fits, for every capacity up to ``capacity`` (unbounded knapsack)."""
    best = np.zeros(capacity + 1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
    for c in range(1, capacity + 1):
        k = upto[c]
        best[c] = max(best[c - 1], (best[c - lengths[:k]] + values[:k]).max()) if k else best[c - 1]
    return best


def take_configurations(lengths: np.ndarray, values: np.ndarray, best: np.ndarray, wanted: np.ndarray) -> list[tuple[tuple[int, ...], float]]:
    """Configurations priced within DELTA of the best that cover ``wanted``, and their numbers.

    The longest wanted length comes first; from there on the table of best prices tells
    which lengths still lead to a configuration within the tolerance, and of these the
    longest wanted one is taken.  Each configuration is taken until one of its wanted
    lengths is covered.  Lengths with no such configuration stay wanting.
    """
    capacity = len(best) - 1
    top, wanted, taken = best[capacity], wanted.copy(), []
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
    for k in range(len(lengths) - 1, -1, -1):
        slack = DELTA * top - (top - values[k] - best[capacity - lengths[k]])
        while wanted[k] > 0 and slack >= 0:
            used, room, budget = [k], capacity - int(lengths[k]), slack
            while (n := upto[room]) and (best[room] > budget or (wanted[:n] > 0).any()):
                loss = best[room] - best[room - lengths[:n]] - values[:n]
                fit = np.flatnonzero((loss <= budget) & (wanted[:n] > 0))
                if not len(fit) and best[room] <= budget:
                    break
                j = int(fit[-1]) if len(fit) else int(loss.argmin())
                budget -= max(0.0, loss[j])
                room -= int(lengths[j])
                used.append(j)
            kinds, times = np.unique(used, return_counts=True)
            short = wanted[kinds] > 0
            number = float((wanted[kinds][short] / times[short]).min())
            left = wanted[kinds] - number * times
            wanted[kinds] = np.where(left > 1e-9 * number, left, np.minimum(left, 0.0))
            taken.append((tuple(used), number))
    return taken


def normal_matrix(cover: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The function of weights w that gives cover @ diag(w) @ cover.T.

    A configuration holds few lengths, so only the pairs of its own are added up; where
    these are more than PAIRS, the dense product takes less memory.
    """
    kinds, columns = np.nonzero(cover)
    order = np.argsort(columns, kind="stable")
    kinds, columns = kinds[order], columns[order]
    n = np.bincount(columns, minlength=cover.shape[1])
    if int((n * n).sum()) > PAIRS:
        return lambda w: (cover * w) @ cover.T
    each = n[columns]
    left = np.repeat(np.arange(len(kinds)), each)
    right = np.repeat((np.cumsum(n) - n)[columns], each) + np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each)
    at, of = kinds[left] * len(cover) + kinds[right], columns[left]
    times = cover[kinds[left], of] * cover[kinds[right], of]
    return lambda w: np.bincount(at, times * w[of], len(cover) ** 2).reshape(len(cover), len(cover))


def solve_restricted(columns: list[tuple[int, ...]], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the given configurations, at least covering ``counts``, whose sum is least to 1e-4, and the lengths' prices.

    Costs differ from 1 by up to 1e-4, so that one corner of the program is best: it has
    few configurations, which round well.
    """
    costs = 1.0 + 1e-4 * np.random.default_rng(len(columns)).random(len(columns))
    cover = np.zeros((len(counts), len(columns)))
    for k, used in enumerate(columns):
        np.add.at(cover[:, k], list(used), 1.0)
    normal = normal_matrix(cover)
    prices = np.full(len(counts), 0.9 / cover.sum(axis=0).max())
    numbers = np.full(len(columns), 2.0 * float((counts / cover.sum(axis=1)).max()))
    spare, over = costs - prices @ cover, cover @ numbers - counts
    for _ in range(200):
        gap = numbers @ spare + over @ prices
        if gap <= 1e-7 * (counts @ prices):
            break
        aim = 0.1 * gap / (len(numbers) + len(prices))
        first, second = aim / spare - numbers, aim / prices - over
        system = normal(numbers / spare)
        system[np.diag_indices(len(prices))] += over / prices
        move = np.linalg.solve(system, second - cover @ first)
        d_spare = -(move @ cover)
        d_numbers, d_over = first - numbers / spare * d_spare, second - over / prices * move
        steps = [min(1.0, 0.95 / max(1e-300, float((-d / v).max()))) for d, v in ((np.concatenate([d_numbers, d_over]), np.concatenate([numbers, over])), (np.concatenate([move, d_spare]), np.concatenate([prices, spare])))]
        numbers, over = numbers + steps[0] * d_numbers, over + steps[0] * d_over
        prices, spare = prices + steps[1] * move, spare + steps[1] * d_spare
    return numbers, prices


def solve_configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int, gap: float = GAP) -> tuple[dict[tuple[int, ...], float], float, float]:
    """Configurations and their fractional numbers, which cover all counts; their total, within ``gap`` of the last; a lower bound of any cover.

    The solution is the mean of the rounds since the last power of two, so that it forgets
    the first prices.  The restricted program's own prices may be far too high for a length
    that few of its configurations hold, and then give a poor bound and configurations of
    that length alone.  So each of its solutions is priced several times: at prices on the
    way to those of the best bound so far (SHARES), and at its own.
    """
    behind, low, mean, known = np.zeros(len(lengths)), 0.0, {}, np.zeros(len(lengths))
    for rounds in range(ROUNDS):
        if rounds & (rounds - 1) == 0:
            cover, mean = np.zeros(len(lengths)), {}
        values = lengths * np.exp(ETA * behind)
        best = price_capacities(lengths, values, capacity)
        if (bound := float(counts @ values) / best[capacity]) > low:
            low, known = bound, values / best[capacity]
        behind += 1
        got = np.zeros(len(lengths))
        for used, number in take_configurations(lengths, values, best, counts * np.minimum(behind, 2.0)):
            mean[used] = mean.get(used, 0.0) + number
            np.add.at(got, list(used), number)
        behind -= got / counts
        cover += got
        least = float((cover / counts).min())
        if least > 0 and sum(mean.values()) / least <= (1 + gap) * low:
            return {k: x / least for k, x in mean.items()}, sum(mean.values()) / least, low
    columns = list(dict.fromkeys([*mean, *[(k,) * int(capacity // n) for k, n in enumerate(lengths.tolist())]]))
    while True:
        numbers, prices = solve_restricted(columns, counts)
        value, center, found = float(numbers.sum()), known, []
        for share in SHARES:
            mixed = share * center + (1 - share) * prices
            best = price_capacities(lengths, mixed, capacity)
            if (bound := float(counts @ mixed) / best[capacity]) > low:
                low, known = bound, mixed / best[capacity]
            if value <= (1 + gap) * low:
                return {used: float(x) for used, x in zip(columns, numbers, strict=True)}, value, low
            found += [used for used, _ in take_configurations(lengths, mixed, best, counts.astype(float))]
        # At the program's own prices (share 0), a bound past the gap means that configurations near the best one cost less than what they cover.
        columns = list(dict.fromkeys([*columns, *found]))


def best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[Pattern]:
    """Pack what is left: the longest first, then again the longest that fits, as often as counts allow."""
    left, patterns = left.copy(), []
    while left.any():
        room, used, times = capacity, [], []
        k = int(np.flatnonzero(left)[-1])
        while k >= 0:
            n = min(int(left[k]), int(room // lengths[k]))
            used.append(k)
            times.append(n)
            room -= n * int(lengths[k])
            fits = np.flatnonzero((left[:k] > 0) & (lengths[:k] <= room))
            k = int(fits[-1]) if len(fits) else -1
        kinds, each = np.array(used[::-1]), np.array(times[::-1])
        number = int((left[kinds] // each).min())
        left[kinds] -= number * each
        patterns.append((kinds, each, number))
    return patterns


def round_configurations(lengths: np.ndarray, counts: np.ndarray, solution: dict[tuple[int, ...], float]) -> tuple[list[Pattern], np.ndarray]:
    """Whole numbers of configurations within the counts, those of few (long) pieces first, and what they leave of each length."""
    left, patterns = counts.copy(), []
    full = {used: int(lengths[list(used)].sum()) for used in solution}
    for used in sorted(solution, key=lambda u: (len(u), -full[u], u)):
        kinds, each = np.unique(used, return_counts=True)
        number = min(int(np.ceil(solution[used] - 1e-3)), int((left[kinds] // each).min()))
        if number:
            left[kinds] -= number * each
            patterns.append((kinds, each, number))
    return patterns, left


def plan_packing(lengths: np.ndarray, counts: np.ndarray, capacity: int, gap: float = GAP) -> tuple[list[Pattern], dict[str, float]]:
    """Patterns that cover the counts exactly, and a report.

    ``lengths`` ascend and lie in 1..capacity.  What rounding leaves is solved again, with
    a gap as much wider as there are fewer pieces, until most of it can't be rounded.  The
    report has the first program's value and lower bound, and the numbers of pieces placed
    by rounding and by best fit.
    """
    left, patterns, report = counts.copy(), [], {"value": 0.0, "bound": 0.0, "rounded": 0, "completed": 0}
    while True:
        some = np.flatnonzero(left)
        if not len(some):
            break
        solution, value, bound = solve_configurations(lengths[some], left[some], capacity, gap * int(counts.sum()) / int(left.sum()))
        if not patterns:
            report |= {"value": value, "bound": bound}
        made, rest = round_configurations(lengths[some], left[some], solution)
        patterns += [(some[kinds], each, number) for kinds, each, number in made]
        placed = int(left[some].sum() - rest.sum())
        report["rounded"] += placed
        left[some] = rest
        if placed < rest.sum():
            report["completed"] = int(rest.sum())
            patterns += [(some[kinds], each, number) for kinds, each, number in best_fit(lengths[some], rest, capacity)]
            break
    return patterns, report


def placement_table(lengths: np.ndarray, patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Which ranks of each length go where: rows sorted by length and first rank."""
    taken, rows, sequence = np.zeros(len(lengths), np.int64), [], 0
    for kinds, each, times in patterns:
        offset = 0
        for k, n in zip(kinds.tolist(), each.tolist(), strict=True):
            rows.append((lengths[k], taken[k], sequence, n, offset))
            taken[k] += times * n
            offset += n * int(lengths[k])
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "sequence", "each", "offset"), table.T, strict=True))


def place_pieces(pieces: DataFrame, capacity: int, keys: list[str], rows_per_bucket: int = 5_000, gap: float = GAP) -> DataFrame:
    """Adds sequence_id and offset to ``pieces``, which has a length in 1..capacity and is cheap to read again.

    ``keys`` order the pieces of equal length; pieces equal in all keys are interchangeable.
    """
    spark = pieces.sparkSession
    ship_package(spark)
    histogram = sorted((r["length"], r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect())
    lengths, counts = np.array([x for x, _ in histogram], np.int64), np.array([n for _, n in histogram], np.int64)
    table = placement_table(lengths, plan_packing(lengths, counts, capacity, gap)[0])

    spread = 1 << bucket_bits(int(counts.max()) if histogram else 0, rows_per_bucket)
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(spread)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    here = Window.partitionBy("length", "bucket").orderBy(*keys)
    ranked = rows.join(offsets, ["length", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(here) - 1).drop("bucket", "before")
    names = pieces.columns

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        start = (table["length"] << 42) + table["first"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(start, (length << 42) + rank, "right") - 1
            within = rank - table["first"][at]
            each = table["each"][at]
            made = [pa.array(table["sequence"][at] + within // each), pa.array(table["offset"][at] + within % each * length)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *made], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """Tokenize every whole text and cut it: doc_id, piece, start, length, ids_crc32 and, if asked, ids."""
    ship_package(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if with_ids else 5]

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        encoder = word_encoder(vocabulary)
        for batch in batches:
            for part in slices(batch):
                ids, n = encoder.encode_texts(pc.fill_null(part.column(1), ""))
                ids = np.insert(ids, np.cumsum(n), end_id).astype("<u4")
                n = n + 1
                each = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), each)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
                start = piece * capacity
                length = np.minimum(n[doc] - start, capacity)
                begin = (np.cumsum(n) - n)[doc] + start
                runs = [ids[a : a + k] for a, k in zip(begin.tolist(), length.tolist(), strict=True)]
                columns = [part.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(r) for r in runs], pa.int64())]
                if with_ids:
                    columns.append(pa.array(runs, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, gap: float = GAP) -> DataFrame:
    """Pack all rows of ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    A document is its ids and the end id; only longer ones are cut.  Returns one row per
    piece: doc_id, piece, start, length, ids_crc32, ids (if asked), sequence_id, offset.
    Null texts count as empty and are packed as the end id alone; rows with null or equal
    ids are packed each on its own; an empty table gives an empty result; other columns
    are ignored.
    """
    pieces = stage_table(token_pieces(docs, vocabulary, capacity, end_id, with_ids), "pieces")
    return place_pieces(pieces, capacity, ["doc_id", "piece", "ids_crc32"], gap=gap)
