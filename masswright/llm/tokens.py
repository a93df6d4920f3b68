"""Tokenizing whole Arrow batches.

The vocabulary file's pre-tokenizer never joins across white space, so a batch is split at
ASCII white space and dictionary-encoded by Arrow.  Case and punctuation are taken off the
distinct words, Arrow looks the forms up among those that the worker has met, only new ones
are given to the tokenizers library, and ids are gathered back with NumPy.
"""

from __future__ import annotations

import numpy as np

#: Forms, and bytes of forms, that a worker remembers; beyond either it keeps the forms at hand and forgets the rest (memory bound only).
MEMORY_WORDS = 1_000_000
MEMORY_BYTES = 32_000_000

#: Letters after which punctuation may be taken off.  U+0130 is left out: its lower case ends in a combining dot, which splits with the punctuation.
_LETTERS = "A-Za-zÀ-ÖØ-öø-\u012f\u0131-ɏ"
#: Words of letters that share a call of the tokenizers library.
_GROUP = 256
_workers: dict[str, WordEncoder] = {}


def load_tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(lengths)
    out = np.repeat(starts - (ends - lengths), lengths)
    out += np.arange(len(out))
    return out


class WordEncoder:
    """Ids of white-space separated words under a vocabulary that drops white space."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.is_last = np.array([t.endswith("</w>") for t in tokens])
        self.forget()

    def forget(self) -> None:
        import pyarrow as pa

        self.known = pa.array([""])  # the k-th form's ids are ids[ends[k]:ends[k + 1]]
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(2, np.int64)

    def _add(self, forms, ids: np.ndarray, sizes: np.ndarray) -> None:
        import pyarrow as pa

        self.known = pa.concat_arrays([self.known, forms])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32, copy=False)])

    def _ids_of(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known forms one after the other, and the number of ids of each."""
        starts = self.ends[slots]
        sizes = self.ends[slots + 1] - starts
        return self.ids[ragged(starts, sizes)], sizes

    def _keep_only(self, slots: np.ndarray) -> None:
        forms, (ids, sizes) = self.known.take(slots), self._ids_of(slots)
        self.forget()
        self._add(forms, ids, sizes)

    def _learn(self, forms) -> np.ndarray:
        """Add new forms (an Arrow array); returns their order in memory.

        Runs of Latin letters are one token run each, with a mark on its last token, so many share a call.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        is_letters = pc.match_substring_regex(forms, rf"^[{_LETTERS}]+\z").to_numpy(zero_copy_only=False)
        letters, rest = np.flatnonzero(is_letters), [np.flatnonzero(~is_letters)]
        order, found, sizes = [], [], []
        if len(letters):
            groups = pa.ListArray.from_arrays(pa.array([*range(0, len(letters), _GROUP), len(letters)], pa.int32()), forms.take(letters))
            for k, one in enumerate(self.tokenizer.encode_batch_fast(pc.binary_join(groups, " ").to_pylist(), add_special_tokens=False)):
                group, ids = letters[k * _GROUP : (k + 1) * _GROUP], np.array(one.ids, np.uint32)
                last = np.flatnonzero(self.is_last[ids])
                if len(last) == len(group):
                    order.append(group)
                    found.append(ids)
                    sizes.append(np.diff(last, prepend=-1))
                else:  # lower case of some letters has a mark of its own
                    rest.append(group)
        single = np.concatenate(rest)
        for a in range(0, len(single), 50_000):
            part = [x.ids for x in self.tokenizer.encode_batch_fast(forms.take(single[a : a + 50_000]).to_pylist(), add_special_tokens=False)]
            order.append(single[a : a + 50_000])
            found.append(np.fromiter((i for x in part for i in x), np.uint32))
            sizes.append(np.array([len(x) for x in part], np.int64))
        at = np.concatenate(order)
        self._add(forms.take(at), np.concatenate(found), np.concatenate(sizes))
        return at

    def _slots(self, forms) -> np.ndarray:
        """The places in memory of distinct forms; new ones are added."""
        import pyarrow as pa
        import pyarrow.compute as pc

        slots = pc.fill_null(pc.index_in(forms, value_set=self.known), -1).to_numpy().astype(np.int64)
        if len(self.known) > MEMORY_WORDS or self.known.nbytes > MEMORY_BYTES:
            old = np.flatnonzero(slots > 0)
            self._keep_only(slots[old])
            slots[old] = np.arange(1, len(old) + 1)
        new = np.flatnonzero(slots < 0)
        if len(new):
            first = len(self.known)
            slots[new[self._learn(forms.take(pa.array(new)))]] = first + np.arange(len(new))
        return slots

    def encode_words(self, words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (an Arrow array) one after the other, and the number of ids of each.

        The vocabulary lowers all text, which for ASCII words may come first, and
        punctuation after Latin letters is a token run of its own; so a word is a form
        without either and a form of its punctuation, which may be empty.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        plain = pc.if_else(pc.string_is_ascii(words), pc.ascii_lower(words), words)
        marked = pc.match_substring_regex(plain, rf"^[{_LETTERS}]+[.,;:!?]+\z")
        some = plain.filter(marked)
        heads = pc.replace_with_mask(plain, marked, pc.ascii_rtrim(some, ".,;:!?"))
        coded = pa.concat_arrays([heads, pc.replace_substring_regex(some, rf"^[{_LETTERS}]+", "")]).dictionary_encode()
        slots = self._slots(coded.dictionary)[coded.indices.to_numpy()]
        both = np.zeros((len(words), 2), np.int64)  # slot 0 is the empty form
        both[:, 0] = slots[: len(words)]
        both[marked.to_numpy(zero_copy_only=False), 1] = slots[len(words) :]
        ids, sizes = self._ids_of(both.ravel())
        return ids, sizes.reshape(-1, 2).sum(axis=1)

    def encode_texts(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (an Arrow string array without nulls), and the number of ids of each."""
        import pyarrow.compute as pc

        lists = pc.ascii_split_whitespace(texts.cast("string"))
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        ids, sizes = self.encode_words(coded.dictionary)
        starts = np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[at])])
        bounds -= bounds[0]
        return ids[ragged(starts[at], sizes[at])], ends[bounds[1:]] - ends[bounds[:-1]]


def word_encoder(path: str) -> WordEncoder:
    """This worker's encoder for a vocabulary file; it remembers words across tasks."""
    if path not in _workers:
        _workers[path] = WordEncoder(path)
    return _workers[path]


def slices(batch, most_bytes: int = 8 << 20):
    """Consecutive parts of an Arrow batch whose column 1 (text) has about most_bytes each."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(int(a), int(b - a))
