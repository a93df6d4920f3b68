"""BPE encoding and decoding through a distinct-word table.

Texts are split into words in Spark, at places that the vocabulary's own splitting never
crosses.  Documents are handled in blocks of bounded size: a block keeps its documents as
positions into the list of its distinct words.  The distinct words of all blocks are
brought together by word, each is encoded once, and its ids go back to the positions of
every block that has it.  Decoding maps ids to pieces by the vocabulary's table (a
map-side join: its size is that of the vocabulary).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from masswright.session import ship_package

from .tokens import load_tokenizer, ragged

_W = r"\t-\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_LATIN = r"A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F"
#: Words, as byte-level BPE splits them or coarser.  White space before a word follows the
#: vocabulary's rule (one blank joins the word); a run of Latin letters and a run of
#: punctuation stand alone only where the character after them ends a run in any case.
WORD = rf" ?[{_LATIN}]++(?=[{_W}.,;:!?]|\z)| ?[.,;:!?]++(?=[{_W}]|\z)| ?[^{_W}]+|[{_W}]+(?![^{_W}])|[{_W}]+"
BLOCK_BYTES = 32 << 20


def byte_of_char() -> dict[str, int]:
    """Byte-level BPE's alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(c): b for b, c in [*zip(plain, plain, strict=True), *((b, 256 + i) for i, b in enumerate(rest))]}


def piece_table(tokenizer) -> list[bytes]:
    """The bytes of every id; added tokens outside the alphabet stand for their text."""
    alphabet = byte_of_char()
    pieces = []
    for i in range(tokenizer.get_vocab_size()):
        token = tokenizer.id_to_token(i) or ""
        pieces.append(bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode())
    return pieces


def _cached(path: str) -> tuple:
    """This worker's tokenizer, pieces and decimal forms for a vocabulary file."""
    if path not in _loaded:
        tokenizer = load_tokenizer(path)
        _loaded[path] = (tokenizer, piece_table(tokenizer), [str(i).encode() for i in range(tokenizer.get_vocab_size())])
    return _loaded[path]


_loaded: dict[str, tuple] = {}


def _blocks(batches: Iterator) -> Iterator:
    """(block id, doc ids, distinct words, places of each document's words and their bounds)."""
    import pyarrow.compute as pc
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        words = batch.column(1)
        chars = np.concatenate([[0], np.cumsum(pc.binary_length(words.values).to_numpy(zero_copy_only=False))])[words.offsets.to_numpy()]
        part = (chars[1:] - chars[0]) // BLOCK_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            bounds = words.offsets.to_numpy()[a : b + 1].astype(np.int64)
            coded = words.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
            yield block, batch.column(0).slice(a, b - a), coded.dictionary, coded.indices.to_numpy(), bounds - bounds[0]
            block += 1


def _split(docs: DataFrame, special: list[str]) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    whole = F.lit(False)
    for token in special:
        whole = whole | F.contains(text, F.lit(token))
    # A text with an added token's string is one word: such strings cut white space runs.
    words = F.when(whole, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"))


def encode_documents(docs: DataFrame, vocabulary: str, digests: bool = False) -> DataFrame:
    """Encode every whole text of ``docs`` (doc_id, text) and decode it again.

    ``docs`` is a table as read, so that its partitions are the same each time; a block
    that doesn't meet its own words raises.  Returns doc_id, n_tokens and either ids and
    decoded, or, with ``digests``, ids_sha256 (decimal ids joined by commas) and
    decoded_sha256 (UTF-8).  Null texts count as empty and have no ids; rows with null or
    equal ids have a result each; an empty table gives an empty result; other columns are
    ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    special = [t.content for t in load_tokenizer(vocabulary).get_added_tokens_decoder().values()]
    split = _split(docs, special)

    def documents(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for block, ids, words, places, bounds in _blocks(batches):
            n = len(ids)
            places = places.astype("<i4")
            packed = [pa.compress(places[a:b].tobytes(), codec="zstd", asbytes=True) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block)), ids, pa.array(np.full(n, len(words))), pa.array(bounds[1:] - bounds[:-1]), pa.array(packed, pa.binary())],
                names=["block", "doc_id", "n_distinct", "n_words", "places"],
            )

    def distinct_words(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for block, _, words, _, _ in _blocks(batches):
            n = len(words)
            yield pa.RecordBatch.from_arrays([words, pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32))], names=["word", "block", "place"])

    def encode(batches: Iterator) -> Iterator:
        """Rows come sorted by word, so a word met again is the last one of the batch before."""
        import pyarrow as pa
        import pyarrow.compute as pc

        tokenizer = _cached(vocabulary)[0]
        last, last_ids = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = pc.run_end_encode(batch.column(0))
            words = ends.values.to_pylist()
            known = [last_ids] if words[0] == last else []
            encoded = known + [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(words[len(known) :], add_special_tokens=False)]
            last, last_ids = words[-1], encoded[-1]
            sizes = np.array([len(e) for e in encoded])
            flat = np.concatenate(encoded)
            word = np.repeat(np.arange(len(words)), np.diff(np.concatenate([[0], ends.run_ends.to_numpy()])))
            blocks, places = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            order = np.argsort(blocks, kind="stable")
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(blocks[order])) + 1, [len(order)]])
            starts = np.cumsum(sizes) - sizes
            rows = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                at = order[a:b]
                w = word[at]
                data = (places[at].astype("<i4"), sizes[w].astype("<i4"), flat[ragged(starts[w], sizes[w])].astype("<u4"))
                rows.append((int(blocks[at[0]]), b - a, pa.compress(b"".join(x.tobytes() for x in data), codec="zstd", asbytes=True), int(sum(x.nbytes for x in data))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.int64()))], names=["block", "n", "coded", "size"]
            )

    kinds = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    def assemble(docs, coded):
        import pyarrow as pa

        _, pieces, decimals = _cached(vocabulary)
        n = docs.column("n_distinct")[0].as_py() if docs.num_rows else 0
        ids: list = [None] * n
        for k, data, size in zip(*(coded.column(c).to_pylist() for c in ("n", "coded", "size")), strict=True):
            raw = pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True)
            places, sizes = np.frombuffer(raw, "<i4", k), np.frombuffer(raw, "<i4", k, 4 * k)
            flat, ends = np.frombuffer(raw, "<u4", -1, 8 * k).tolist(), np.cumsum(sizes).tolist()
            for p, a, b in zip(places.tolist(), [0, *ends], ends, strict=False):
                ids[p] = flat[a:b]
        if any(x is None for x in ids):
            raise RuntimeError("a block doesn't meet its words: the input's partitions changed between reads")
        text = [b"".join([pieces[i] for i in x]) for x in ids]
        digits = [b",".join([decimals[i] for i in x]) for x in ids] if digests else ids
        counts = np.array([len(x) for x in ids] or [0])
        out: tuple[list, list, list] = [], [], []
        for words, packed in zip(docs.column("n_words").to_pylist(), docs.column("places").to_pylist(), strict=True):
            places = np.frombuffer(pa.decompress(packed, decompressed_size=4 * words, codec="zstd", asbytes=True), "<i4") if words else np.zeros(0, np.int32)
            at = places.tolist()
            out[0].append(int(counts[places].sum()))
            decoded = b"".join([text[p] for p in at]).decode("utf-8", "replace")
            if digests:
                out[1].append(hashlib.sha256(b",".join([digits[p] for p in at])).hexdigest())
                out[2].append(hashlib.sha256(decoded.encode()).hexdigest())
            else:
                out[1].append([i for p in at for i in ids[p]])
                out[2].append(decoded)
        second = pa.array(out[1], pa.string() if digests else pa.list_(pa.int32()))
        names = ["doc_id", "n_tokens", *[x.split()[0] for x in kinds.split(", ")]]
        return pa.Table.from_arrays([docs.column("doc_id"), pa.array(out[0], pa.int64()), second, pa.array(out[2], pa.string())], names=names)

    rows = split.mapInArrow(documents, "block long, doc_id long, n_distinct long, n_words long, places binary")
    words = split.select("doc_id", "words").mapInArrow(distinct_words, "word string, block long, place int")
    table = words.repartition("word").sortWithinPartitions("word").mapInArrow(encode, "block long, n long, coded binary, size long")
    return rows.groupBy("block").cogroup(table.groupBy("block")).applyInArrow(assemble, f"doc_id long, n_tokens long, {kinds}")
