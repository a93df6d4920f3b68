"""Token-ID files with Re-Pair grammar compression.

Documents are dealt to ranges of ids, tokenized in id order and gathered into shards of a
bounded number of ids.  Each shard repeatedly replaces its frequent id pairs by
nonterminals until no pair within a document occurs LEAST times.  A round counts the pairs
of all places that may still hold a frequent one and replaces many pairs at once; where two
of them overlap, the more frequent one wins.  No pair spans two documents.  A shard's blob
holds its documents' places, the rules with their expansion lengths, and the symbols, so a
single document, or any stretch of it, is decoded from the rules that it reaches.

Blob layout (little-endian): magic ``RPTOK2\0\0``; int64 blob bytes, n_docs, n_rounds,
n_rules, n_symbols, base (first nonterminal), symbol bits (16 or more); doc_id int64[n_docs];
null flags uint8[n_docs]; symbol_start int64[n_docs + 1]; n_tokens int64[n_docs]; rules made
up to the end of each round int64[n_rounds]; expansion lengths uint32[n_rules]; the rules'
left symbols, their right symbols, and the symbols, each as uint16 low halves and then one
plane of packed bits for every further bit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from masswright.session import ship_package

from .common import shared_path, stage_table
from .tokens import ragged, slices, word_encoder

MAGIC = b"RPTOK2\0\0"
#: Ids per shard (a longer document is a shard of its own).
SHARD_IDS = 2_000_000
#: Shards per file, so that a file's size is bounded however much a range of ids holds.
SHARDS_PER_FILE = 4
#: The least number of occurrences of a pair that is replaced.  A rule takes two symbols of some
#: 2 bytes each and a length of 4, and an occurrence saves one symbol, so below four a rule gains nothing.
LEAST = 4


def _frequent(codes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places whose code occurs at least ``least`` times, their group numbers, and the groups' codes, ascending."""
    bits = max(1, int(len(codes) - 1).bit_length())
    if int(codes.max()).bit_length() + bits < 64:  # one sort of code and place is faster than argsort
        codes <<= bits
        codes |= np.arange(len(codes))
        codes.sort()
        order, ordered = (codes & ((1 << bits) - 1)).astype(np.int32), codes >> bits
    else:
        order = np.argsort(codes, kind="stable")
        ordered = codes[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    sizes = np.diff(starts, append=len(ordered))
    often = sizes >= least
    group = np.full(len(order), -1, np.int32)
    group[order[np.repeat(often, sizes)]] = np.repeat(np.arange(np.count_nonzero(often), dtype=np.int32), sizes[often])
    places = np.flatnonzero(group >= 0)
    return places, group[places], ordered[starts[often]]


def _peaks(rank: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Which places rank before both neighbours; ``joined`` says that a place overlaps the one before."""
    good = np.ones(len(rank), bool)
    worse = rank[1:] < rank[:-1]
    good[:-1] &= ~(joined[1:] & worse)
    good[1:] &= ~joined[1:] | worse
    return good


def repair(ids: np.ndarray, last: np.ndarray, base: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Compress ids; ``last`` marks each document's last id.

    Returns the symbols, the marks of the symbols that end a document, the rules, and the
    number of rules after each round.  Places are linked, so that a round costs as much as
    the places it looks at: those whose pair was frequent in the round before, and those
    beside a replacement.  All occurrences of a pair that may be frequent are among them,
    since an old pair's number only falls.  A run of one id is paired from its left end.
    """
    n = len(ids)
    kind = np.int32 if n < 1 << 31 else np.int64
    symbols = ids.astype(np.int64)
    after, before = np.arange(1, n + 1, dtype=kind), np.arange(-1, n - 1, dtype=kind)
    after[last] = -1
    before[1:][last[:-1]] = -1
    alive, wanted = np.ones(n, bool), np.zeros(n, bool)
    at = np.flatnonzero(after >= 0).astype(kind)
    rules, rounds, made = [np.zeros((0, 2), np.int64)], [], 0
    while len(at):
        shift = 20 if base + made < 1 << 20 else 32
        places, group, codes = _frequent(symbols[at] << shift | symbols[after[at]], least)
        if not len(codes):
            break
        at = at[places]
        joined = np.concatenate([[False], after[at[:-1]] == at[1:]])
        # In a run of one id every second pair counts, from the left.
        odd = np.zeros(len(at), bool)
        twins = (codes >> shift) == (codes & ((1 << shift) - 1))
        if twins.any():
            same = joined & twins[group] & np.concatenate([[False], group[1:] == group[:-1]])
            place = np.arange(len(at), dtype=kind)
            odd = ((place - np.maximum.accumulate(np.where(same, 0, place))) & 1).astype(bool)
        counts = np.bincount(group[~odd], minlength=len(codes))
        ranks = np.empty(len(codes), np.int32)
        ranks[np.argsort(-counts, kind="stable")] = np.arange(len(codes))
        ranks[counts < least] = len(codes)
        rank = ranks[group]
        rank[odd] = len(codes)
        # A pair is taken if it wins often enough where pairs overlap; the most frequent one always does.
        wins = np.bincount(group[_peaks(rank, joined) & (rank < len(codes))], minlength=len(codes)) >= least
        if not wins.any():
            break
        # The pairs taken are replaced wherever none of them that ranks before overlaps.
        some, chosen = np.flatnonzero(wins[group] & ~odd), np.zeros(len(at), bool)
        while len(some):
            touch = np.concatenate([[False], (np.diff(some) == 1) & joined[some[1:]]])
            good = _peaks(rank[some], touch)
            chosen[some[good]] = True
            hit = good.copy()
            hit[1:] |= good[:-1] & touch[1:]
            hit[:-1] |= good[1:] & touch[1:]
            some = some[~hit]
        code = codes[wins]
        rules.append(np.stack([code >> shift, code & ((1 << shift) - 1)], axis=1))
        a = at[chosen]
        b = after[a]
        c = after[b]
        symbols[a] = (base + made - 1 + np.cumsum(wins))[group[chosen]]
        made += len(code)
        rounds.append(made)
        alive[b] = False
        after[a] = c
        inner = c >= 0
        before[c[inner]] = a[inner]
        p = before[a]
        wanted[at] = True
        wanted[p[p >= 0]] = True
        wanted[b] = False
        at = np.flatnonzero(wanted).astype(kind)
        wanted[at] = False
        at = at[after[at] >= 0]
    return symbols[alive], after[alive] < 0, np.concatenate(rules), np.array(rounds, np.int64)


def rule_lengths(rules: np.ndarray, rounds: np.ndarray, base: int) -> np.ndarray:
    """Ids in every rule's expansion; a round's rules hold symbols of earlier rounds only."""
    lengths = np.ones(base + len(rules), np.int64)
    for a, b in pairwise([0, *rounds.tolist()]):
        lengths[base + a : base + b] = lengths[rules[a:b]].sum(axis=1)
    return lengths[base:]


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """Ids of a run of symbols: nonterminals give way to their pairs until none is left."""
    while (deep := symbols >= base).any():
        out = np.repeat(symbols, 1 + deep)
        at = np.flatnonzero(deep) + np.arange(np.count_nonzero(deep))
        pairs = rules[symbols[deep] - base]
        out[at], out[at + 1] = pairs[:, 0], pairs[:, 1]
        symbols = out
    return symbols


def expansions(rules: np.ndarray, rounds: np.ndarray, lengths: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All expansions one after the other, and the start and length of each symbol's, ids included."""
    sizes = np.concatenate([np.ones(base, np.int64), lengths])
    starts = np.cumsum(sizes) - sizes
    flat = np.empty(int(sizes.sum()), np.uint32)
    flat[:base] = np.arange(base)
    for a, b in pairwise([0, *rounds.tolist()]):
        parts = rules[a:b].ravel()
        begin = int(starts[base + a])
        made = flat[ragged(starts[parts], sizes[parts])]
        flat[begin : begin + len(made)] = made
    return flat, starts, sizes


def pack_blob(doc_ids: list, n_tokens: np.ndarray, ids: np.ndarray, base: int) -> bytes:
    last = np.zeros(len(ids), bool)
    last[np.cumsum(n_tokens)[n_tokens > 0] - 1] = True
    symbols, ends, rules, rounds = repair(ids, last, base)
    starts = np.zeros(len(n_tokens) + 1, np.int64)
    starts[1:][n_tokens > 0] = np.flatnonzero(ends) + 1
    starts = np.maximum.accumulate(starts)
    bits = max(16, (base + len(rules)).bit_length())
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    body = b"".join(
        [x.tobytes() for x in (np.array([d or 0 for d in doc_ids], "<i8"), nulls, starts.astype("<i8"), n_tokens.astype("<i8"), rounds.astype("<i8"), rule_lengths(rules, rounds, base).astype("<u4"))]
        + [to_planes(x, bits) for x in (rules[:, 0], rules[:, 1], symbols)]
    )
    head = np.array([len(MAGIC) + 56 + len(body), len(doc_ids), len(rounds), len(rules), len(symbols), base, bits], "<i8")
    return MAGIC + head.tobytes() + body


def to_planes(values: np.ndarray, bits: int) -> bytes:
    return b"".join([values.astype("<u2").tobytes(), *[np.packbits(values >> b & 1).tobytes() for b in range(16, bits)]])


class Blob:
    """A shard read from bytes at an offset."""

    def __init__(self, data: bytes, at: int = 0):
        if data[at : at + len(MAGIC)] != MAGIC:
            raise ValueError("not a token blob")
        self.size, n, levels, r, s, self.base, bits = np.frombuffer(data, "<i8", 7, at + len(MAGIC)).tolist()
        at += len(MAGIC) + 56

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        ids, nulls = take("<i8", n), take("u1", n)
        self.doc_ids = [None if z else d for d, z in zip(ids.tolist(), nulls.tolist(), strict=True)]
        self.starts, self.n_tokens = take("<i8", n + 1), take("<i8", n)
        self.rounds, self.lengths = take("<i8", levels), take("<u4", r)

        def planes(count: int) -> np.ndarray:
            out = take("<u2", count).astype(np.uint32)
            for b in range(16, bits):
                out |= np.unpackbits(take("u1", -(-count // 8)), count=count).astype(np.uint32) << b
            return out

        self.rules = np.stack([planes(r), planes(r)], axis=1)
        self.symbols = planes(s)

    def all_ids(self) -> np.ndarray:
        flat, starts, sizes = expansions(self.rules, self.rounds, self.lengths, self.base)
        return flat[ragged(starts[self.symbols], sizes[self.symbols])]

    def doc(self, k: int, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Ids begin to end of the k-th document, decoding only the symbols that cover them and the rules these reach."""
        symbols = self.symbols[self.starts[k] : self.starts[k + 1]].astype(np.int64)
        sizes = np.ones(len(symbols), np.int64)
        deep = symbols >= self.base
        sizes[deep] = self.lengths[symbols[deep] - self.base]
        ends = np.cumsum(sizes)
        end = int(self.n_tokens[k]) if end is None else min(end, int(self.n_tokens[k]))
        a, b = np.searchsorted(ends, begin, "right"), np.searchsorted(ends, end, "left") + 1
        first = int(ends[a - 1]) if a else 0
        return expand(symbols[a:b], self.rules, self.base)[begin - first : max(begin, end) - first]


def write_token_files(docs: DataFrame, vocabulary: str, path: str | None = None, end_id: int = 2) -> str:
    """Tokenize every whole text of ``docs`` (doc_id, text) and write blobs in ascending doc_id order.

    Rows are range-partitioned by doc_id; a range is written as files of SHARDS_PER_FILE
    blobs, each followed by a line feed.  Null texts count as empty (the end id alone); null ids come first; rows
    with equal ids are ordered by text hash.  Returns the path.
    """
    ship_package(docs.sparkSession)
    path = path or shared_path(docs.sparkSession, "token-files")

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        encoder = word_encoder(vocabulary)
        base = max(encoder.tokenizer.get_vocab_size(), end_id + 1)
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        count = 0

        def blob() -> pa.RecordBatch:
            ids = [d for x in held for d in x[0]]
            data = pack_blob(ids, np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held]), base)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["blob"])

        for batch in batches:
            for part in slices(batch):
                ids, n = encoder.encode_texts(pc.fill_null(part.column(1), ""))
                ends = np.cumsum(n)
                ids = np.insert(ids, ends, end_id).astype(np.uint32)
                n, names = n + 1, part.column(0).to_pylist()
                shard = (count + np.cumsum(n)) // SHARD_IDS
                cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(n)]
                stops = np.concatenate([[0], np.cumsum(n)])
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if a and held:
                        yield blob()
                        count = 0
                    held.append((names[a:b], n[a:b], ids[stops[a] : stops[b]]))
                    count += int(stops[b] - stops[a])
        if held:
            yield blob()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(encode, "blob binary").select(F.col("blob").cast("string").alias("value")).write.option("maxRecordsPerFile", SHARDS_PER_FILE).text(path)
    return path


def read_token_files(spark, path: str) -> DataFrame:
    """Read the files back: one row per document with its ids' digest.

    Returns doc_id, start (ids of all documents before it), n_tokens and ids_crc32.
    """
    ship_package(spark)

    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, at, k = data.as_py(), 0, 0
                while at < len(data):
                    blob = Blob(data, at)
                    ids = blob.all_ids().astype("<u4")
                    ends = np.cumsum(blob.n_tokens)
                    starts = ends - blob.n_tokens
                    sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    n = len(ends)
                    columns = [
                        pa.array([name] * n),
                        pa.array(np.full(n, k)),
                        pa.array(blob.doc_ids, pa.int64()),
                        pa.array(np.arange(n)),
                        pa.array(starts),
                        pa.array(blob.n_tokens),
                        pa.array(sums, pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["file", "blob", "doc_id", "place", "inside", "n_tokens", "ids_crc32"])
                    at += blob.size + 1
                    k += 1

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(decode, "file string, blob long, doc_id long, place long, inside long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` as token files and read them back (see the two functions above).

    A document's start is its blob's start plus its place inside; blobs are ordered by
    file number (files are numbered by range of doc_id, then within the range) and then
    by place in the file.
    """
    spark = docs.sparkSession
    rows = stage_table(read_token_files(spark, write_token_files(docs, vocabulary, end_id=end_id)), "token-rows")
    blobs = rows.groupBy("file", "blob").agg(F.sum("n_tokens").alias("n"))
    inside = Window.partitionBy("file").orderBy("blob").rowsBetween(Window.unboundedPreceding, -1)
    files = blobs.groupBy("file").agg(F.sum("n").alias("n")).select("file", "n", *[F.regexp_extract("file", pattern, 1).cast("long").alias(c) for c, pattern in (("part", r"part-(\d+)-"), ("chunk", r"-c(\d+)\.[^/]*$"))])
    before = Window.orderBy("part", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_start"))
    blobs = blobs.withColumn("blob_start", F.coalesce(F.sum("n").over(inside), F.lit(0))).drop("n").join(files, "file")
    return rows.join(blobs, ["file", "blob"]).select("doc_id", (F.col("file_start") + F.col("blob_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
