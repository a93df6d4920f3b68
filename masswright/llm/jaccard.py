"""N-gram Jaccard join with Bayesian candidate pruning.

Equal texts are one class.  Distinct texts get MinHash signatures of their word shingles;
texts that agree on a band of the signature are candidates.  A bucket of candidates is
worked through in blocks of bounded size: signatures are compared a few hashes at a time,
pairs whose posterior probability of reaching the threshold falls below the tolerance are
dropped, and the rest are verified on their exact shingle sets.  Blocks report the number
of each text's links and a spanning forest of them, never the pairs, so results stay
linear in the texts even where thousands are alike.  A pair that meets in several buckets
counts in the first alone.  Classes are the connected components of the forests' edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from masswright.session import ship_package

from .common import stage_table

HASHES, ROWS = 100, 4
BANDS = HASHES // ROWS
STEP = 20
SPACE = r"[\x20\x09-\x0D]"
#: Texts of one chunk of a bucket; a block holds two chunks at most.
CHUNK = 256
#: Edges of one task of a contraction round, where the shuffle has more partitions than they need; so few are left to one task.
EDGES_A_TASK = 5_000
#: Rows of one task that writes signatures, buckets or classes, where the shuffle has more partitions than they need.
ROWS_A_TASK = 2_000
_LOWEST = -(1 << 63)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of n words, and their number per text.

    ``words`` are word hashes, texts one after the other.  A text of fewer words has one
    shingle of all it has.
    """
    rng = np.random.default_rng(5)
    odd = rng.integers(1 << 62, size=n, dtype=np.int64).astype(np.uint64) | np.uint64(1)
    words = words.view(np.uint64)
    lengths = np.diff(bounds)
    counts = np.where(lengths >= n, lengths - n + 1, np.minimum(lengths, 1))
    first = np.repeat(bounds[:-1], counts) + (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
    left = np.repeat(bounds[1:], counts) - first
    total = np.zeros(len(first), np.uint64)
    for k in range(n):
        inside = left > k
        total += np.where(inside, words[np.where(inside, first + k, 0)] if len(words) else 0, np.uint64(0)) * odd[k] + np.uint64(k)
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(32)), counts


def minhash(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Signatures (texts x HASHES, uint32) of texts that all have shingles."""
    rng = np.random.default_rng(7)
    odd = rng.integers(1 << 62, size=HASHES, dtype=np.int64).astype(np.uint64) | np.uint64(1)
    mask = rng.integers(1 << 62, size=HASHES, dtype=np.int64).astype(np.uint64)
    out = np.empty((len(counts), HASHES), np.uint32)
    starts = np.cumsum(counts) - counts
    mixed = np.empty_like(shingles)
    for k in range(HASHES):
        np.bitwise_xor(shingles, mask[k], out=mixed)
        np.multiply(mixed, odd[k], out=mixed)
        out[:, k] = np.minimum.reduceat(mixed, starts) >> np.uint64(32)
    return out


def least_matches(threshold: Fraction, tolerance: float) -> dict[int, int]:
    """After t compared hashes, the least number of matches with posterior at or above the tolerance.

    Under a uniform prior the posterior of similarity s after m of t matches is
    Beta(m + 1, t - m + 1), so P(s >= threshold) = P(Binomial(t + 1, threshold) <= m).
    """
    out, p = {}, float(threshold)
    for t in range(STEP, HASHES + 1, STEP):
        total = 0.0
        for m in range(t + 1):
            total += comb(t + 1, m) * p**m * (1 - p) ** (t + 1 - m)
            if total >= tolerance:
                out[t] = m
                break
    return out


def exact_shingles(texts: list[str], n: int) -> list[np.ndarray]:
    """Sorted sets of shingle numbers; equal numbers are equal shingles, with no hashing."""
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")
    number: dict[str, int] = {}
    rows, sizes = [], []
    for text in texts:
        ids = np.array([number.setdefault(w, len(number) + 1) for w in word.findall(text)], np.int64)
        if len(ids) < n:
            ids = np.pad(ids, (0, n - len(ids))) if len(ids) else np.zeros(0, np.int64)
        windows = np.lib.stride_tricks.sliding_window_view(ids, n) if len(ids) else np.zeros((0, n), np.int64)
        rows.append(windows)
        sizes.append(len(windows))
    table = np.concatenate(rows)
    code = table[:, 0]
    for k in range(1, n):
        code = np.unique(code, return_inverse=True)[1] * (len(number) + 1) + table[:, k]
    code = np.unique(code, return_inverse=True)[1]
    ends = np.cumsum(sizes)
    return [np.unique(code[e - s : e]) for s, e in zip(sizes, ends, strict=True)]


def linked_pairs(a: np.ndarray, b: np.ndarray, sets: list[np.ndarray], threshold: Fraction) -> np.ndarray:
    """Which pairs reach the threshold exactly."""
    sizes = np.array([len(s) for s in sets])
    if len(a) > 4 * len(sets):
        numbers = np.unique(np.concatenate(sets))
        shared = np.zeros((len(sets), len(sets)), np.float32)
        for begin in range(0, len(numbers), 8192):
            part = numbers[begin : begin + 8192]
            has = np.zeros((len(sets), len(part)), np.float32)
            for k, s in enumerate(sets):
                lo, hi = np.searchsorted(s, part[0]), np.searchsorted(s, part[-1], "right")
                has[k, np.searchsorted(part, s[lo:hi])] = 1
            shared += has @ has.T
        both = shared[a, b].astype(np.int64)
    else:
        both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    return both * threshold.denominator >= (sizes[a] + sizes[b] - both) * threshold.numerator


def block_links(bucket: int, side: np.ndarray, signatures: np.ndarray, buckets: list[np.ndarray], texts: list[str], n: int, threshold: Fraction, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of a block: of texts on different sides, or of one side with itself if there is one."""
    if side.min() == side.max():
        a, b = np.triu_indices(len(side), 1)
    else:
        a, b = (x.ravel() for x in np.meshgrid(np.flatnonzero(side == 0), np.flatnonzero(side == 1), indexing="ij"))
    earlier = [x[x < bucket] for x in buckets]
    if any(len(x) for x in earlier):
        known = np.unique(np.concatenate(earlier))
        has = np.zeros((len(side), len(known)), np.float32)
        for k, x in enumerate(earlier):
            has[k, np.searchsorted(known, x)] = 1
        fresh = (has @ has.T)[a, b] == 0
        a, b = a[fresh], b[fresh]
    matches = np.zeros(len(a), np.int64)
    for t, enough in least.items():
        matches += (signatures[a, t - STEP : t] == signatures[b, t - STEP : t]).sum(axis=1)
        alive = matches >= enough
        a, b, matches = a[alive], b[alive], matches[alive]
    if not len(a):
        return a, b
    used = np.unique(np.concatenate([a, b]))
    a2, b2 = np.searchsorted(used, a), np.searchsorted(used, b)
    good = linked_pairs(a2, b2, exact_shingles([texts[i] for i in used], n), threshold)
    return a[good], b[good]


def spanning_forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Edges of a spanning forest of n nodes, and every node's root."""
    root, edges = list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[q] = p
            edges.append((x, y))
    return edges, [find(x) for x in range(n)]


def in_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about ``rows`` rows, in no more tasks than they need."""
    return df.coalesce(max(1, -(-rows // ROWS_A_TASK)))


def root_nodes(batches: Iterator) -> Iterator:
    """(node, to) of all nodes of the edges (a, b) of one task: its component's root."""
    import pyarrow as pa

    ends = [np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]) for batch in batches if batch.num_rows]
    if ends:
        nodes, at = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
        a, b = at.reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[spanning_forest(a, b, len(nodes))[1]])], names=["node", "to"])


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of (a, b) edges: (node, root), by randomized contraction.

    In each round every node moves to the one of its closed neighbourhood that a new
    random order puts first, and edges are rewritten; the expected number of nodes falls by
    a constant factor, whatever the shape.  Every round is written to the shared folder, by
    as many tasks as its edges need.  The last EDGES_A_TASK edges, which are one task's work
    in any case, are joined up in one go.
    """
    ship_package(edges.sparkSession)
    moves, current = [], stage_table(in_tasks(edges.select("a", "b").where("a != b").distinct(), edges.count()), "edges")
    while (n := current.count()) > EDGES_A_TASK:
        tasks = -(-n // max(1, EDGES_A_TASK))
        order = lambda c, r=len(moves): F.xxhash64(c, F.lit(r))
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(order(F.col("b")).alias("o"), F.col("b").alias("to"))).alias("best"))
        to = F.when(F.col("best.o") < order(F.col("a")), F.col("best.to")).otherwise(F.col("a"))
        move = stage_table(best.select(F.col("a").alias("node"), to.alias("to")).coalesce(tasks), "moves")
        moves.append(move)
        step = current.join(move.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a").join(move.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b")
        ends = step.where("a2 != b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        current = stage_table(ends.distinct().coalesce(tasks), "edges")
    if n or not moves:
        moves.append(stage_table(current.coalesce(1).mapInArrow(root_nodes, "node long, to long"), "moves"))
    labels = moves[0].select("node", F.col("to").alias("root"))
    for move in moves[1:]:
        step = move.select(F.col("node").alias("root"), F.col("to").alias("next"))
        labels = labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return stage_table(labels, "labels")


def text_key(text: str = "text"):
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """(id, key, signature) of every row; texts without words have no signature."""
    ship_package(docs.sparkSession)

    def sign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            words = batch.column(2)
            bounds = words.offsets.to_numpy().astype(np.int64)
            values = words.values.slice(bounds[0], bounds[-1] - bounds[0]).to_numpy()
            bounds -= bounds[0]
            out: list[bytes | None] = [None] * batch.num_rows
            cuts = np.unique(np.concatenate([np.searchsorted(bounds, np.arange(0, bounds[-1] + 1, 1 << 18)), [batch.num_rows]]))
            cuts = np.concatenate([[0], cuts[cuts > 0]])
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                shingles, counts = shingle_hashes(values[bounds[x] : bounds[y]], bounds[x : y + 1] - bounds[x], n)
                some = np.flatnonzero(counts)
                if len(some):
                    for k, row in zip((some + x).tolist(), minhash(shingles, counts[some]), strict=True):
                        out[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["id", "key", "signature"])

    text = F.coalesce("text", F.lit(""))
    words = F.transform(F.filter(F.split(text, f"{SPACE}+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    return docs.select(F.col("doc_id").cast("long").alias("id"), text_key().alias("key"), words.alias("words")).mapInArrow(sign, "id long, key string, signature binary")


def near_links(texts: DataFrame, docs: DataFrame, n: int, threshold: Fraction, tolerance: float) -> DataFrame:
    """Blocks' reports on distinct ``texts`` (node, id, key, signature): (a, links) rows and (a, b) rows."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring(F.col("signature"), k * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    banded = texts.where("signature is not null").select("node", F.explode(bands).alias("bucket"))
    full = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("members")).where("n > 1")
    # Buckets with the same members hold the same pairs; one of them is kept.
    kept = full.groupBy("n", "members").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    members = banded.join(kept, "bucket")
    active = members.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("buckets"))
    active = stage_table(in_tasks(active, texts.count()), "bucket-members")

    chosen = texts.join(active, "node").select("node", F.coalesce("id", F.lit(_LOWEST)).alias("id"), "key", "signature", "buckets")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("id"), text_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    payload = rows.dropDuplicates(["id", "key"]).join(chosen, ["id", "key"])
    chunks = F.ceil(F.col("one.n") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int")
    blocks = (
        payload.select("node", "signature", "text", F.transform("buckets", lambda b: b["bucket"]).alias("buckets"), F.explode("buckets").alias("one"))
        .withColumn("chunks", chunks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(
            F.col("one.bucket").alias("bucket"),
            F.least("own", "other").alias("low"),
            F.greatest("own", "other").alias("high"),
            (F.col("own") > F.col("other")).cast("int").alias("side"),
            "node",
            "signature",
            "buckets",
            "text",
        )
    )
    least = least_matches(threshold, tolerance)

    def report(held: list) -> Iterator:
        import pyarrow as pa

        rows = pa.Table.from_batches(held)
        if rows.num_rows < 2:
            return
        nodes, side = rows.column("node").to_numpy(), rows.column("side").to_numpy()
        if rows.column("low")[0].as_py() != rows.column("high")[0].as_py() and side.min() == side.max():
            return  # one chunk of the two is empty
        sigs = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES)
        lists = [np.array(x, np.int64) for x in rows.column("buckets").to_pylist()]
        a, b = block_links(rows.column("bucket")[0].as_py(), side, sigs, lists, rows.column("text").to_pylist(), n, threshold, least)
        if len(a):
            degree = np.bincount(np.concatenate([a, b]), minlength=len(nodes))
            some = np.flatnonzero(degree)
            edges = np.array(spanning_forest(a, b, len(nodes))[0])
            left = np.concatenate([nodes[some], nodes[edges[:, 0]]])
            right = pa.array(np.concatenate([nodes[some], nodes[edges[:, 1]]]), mask=np.arange(len(left)) < len(some))
            yield pa.RecordBatch.from_arrays([pa.array(left), right, pa.array(np.concatenate([degree[some], np.zeros(len(edges), np.int64)]))], names=["a", "b", "links"])

    def work(batches: Iterator) -> Iterator:
        """Rows come sorted by block; a block may span Arrow batches."""
        held: list = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if held and keys[x] != key:
                    yield from report(held)
                    held = []
                key = keys[x]
                held.append(batch.slice(x, y - x))
        if held:
            yield from report(held)

    where = ["bucket", "low", "high"]
    return blocks.repartition(*where).sortWithinPartitions(*where).mapInArrow(work, "a long, b long, links long")


def text_classes(docs: DataFrame, n: int, threshold: Fraction, tolerance: float) -> DataFrame:
    """Every distinct text's class: key, class_id, n_links, n_copies and whether its smallest id and key stand for the class."""
    signed = signatures(docs, n)
    grouped = signed.groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n_copies"), F.first("signature").alias("signature"))
    texts = stage_table(in_tasks(grouped, docs.count()).withColumn("node", F.monotonically_increasing_id()), "texts")
    reports = stage_table(near_links(texts, docs, n, threshold, tolerance), "links")
    links = reports.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    labels = connected_components(reports.where("b is not null"))
    known = texts.select("node", "key", "id", "n_copies").join(labels, "node", "left").join(links, "node", "left")
    known = known.select("key", "id", "n_copies", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    # Null ids come last, so that a class is named by a real id if it has one.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    classes = known.groupBy("root").agg(first)
    return known.join(classes, "root").select("key", F.col("first.id").alias("class_id"), "n_links", "n_copies", (F.col("first.key") == F.col("key")).alias("stands"))


def jaccard_join(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5), tolerance: float = 1e-6) -> DataFrame:
    """Near-duplicate classes of all rows of ``docs`` (doc_id, text).

    Two texts are linked if the Jaccard similarity of their sets of n-word shingles
    reaches the threshold; words are runs of anything but ASCII white space.  Returns one
    row per input row: doc_id, class_id (the smallest doc_id of the connected component),
    n_links (other distinct texts linked to this row's) and n_copies (rows with this
    text).  A link is missed with a probability of about ``tolerance`` a comparison plus
    that of sharing no band (2e-6 at similarity 0.8, less above).

    Null texts count as empty.  Texts without words are alike only if equal; texts of
    fewer than n words have one shingle of all their words.  Rows with equal or null ids
    are rows of their own (a null class_id means that all ids of the class are null).  An
    empty table gives an empty result; other columns are ignored.
    """
    known = text_classes(docs, n, threshold, tolerance).drop("stands")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"))
    return rows.join(known, "key").select("doc_id", "class_id", "n_links", "n_copies")


def keep_one_each(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5), tolerance: float = 1e-6) -> DataFrame:
    """One row of ``docs`` for each class of jaccard_join, whole and with all its columns.

    It is the row with the smallest doc_id (ties: the smallest text hash; null ids come
    last).  Of rows equal in id and text any one stays.
    """
    known = text_classes(docs, n, threshold, tolerance).where("stands").select("key", "class_id")
    rows = docs.select(text_key().alias("key"), F.col("doc_id").cast("long").alias("id"), F.struct("*").alias("row"))
    stands = rows.join(known, (rows["key"] == known["key"]) & rows["id"].eqNullSafe(known["class_id"]), "left_semi")
    return stands.dropDuplicates(["key"]).select("row.*")
