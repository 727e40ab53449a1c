"""Token ids by a public vocabulary file, read and applied by tokenizers.

Texts are cut into chunks before single spaces and line ends that stand between
characters which aren't white space, and before a mark like a comma that stands
between an ASCII letter or digit and such a place.  The vocabulary's pre-tokens
never reach across these cuts, so the ids of a text are those of its chunks, one
after another.  Cuts are found in the UTF-8 bytes, and the equal chunks of a
block are brought together by Arrow, by their whole bytes, so that Python sees
each of them once.  Each worker keeps the ids of at most ``KEPT`` chunks and a
block's; those that it doesn't have are given to tokenizers, many as one text,
whose ids are told apart by the lengths of their tokens.  Strings of the
vocabulary's added tokens become these tokens' ids, as in tokenizers; no special
token is added.
"""

from __future__ import annotations

import os
from functools import cache

import numpy as np
import pyarrow as pa

from .textarrays import release_memory

#: Chunks whose ids a worker keeps, and the most bytes of one of them.
KEPT, LONGEST = 600_000, 64
#: Chunks that are looked up at once.
BLOCK = 1 << 18

#: str.isspace, which has more characters than the vocabulary's patterns call white space, never fewer.
_SPACES = [chr(c).encode() for c in range(0x3001) if chr(c).isspace()]
_SPACE_1 = np.zeros(256, bool)
_SPACE_1[[s[0] for s in _SPACES if len(s) == 1]] = True
_SPACE_2, _SPACE_3 = ([int.from_bytes(s) for s in _SPACES if len(s) == n] for n in (2, 3))
_MARK = np.zeros(256, bool)
_MARK[list(b",.;:!?")] = True
_ALNUM = np.array([c < 0x80 and chr(c).isalnum() for c in range(256)])


def _spaces(data: np.ndarray, first: np.ndarray, step: int) -> np.ndarray:
    """Whether the character that begins (``step`` 1) or ends (-1) at each place is white space."""
    found = _SPACE_1[data[first]]
    wide = np.flatnonzero(data[first] >= 0x80)
    if len(wide):
        code = [data[np.clip(first[wide] + i * step, 0, len(data) - 1)].astype(np.int64) for i in range(3)]
        two, three = (code[:n] if step > 0 else code[n - 1 :: -1] for n in (2, 3))
        found[wide] = np.isin(two[0] << 8 | two[1], _SPACE_2) | np.isin(three[0] << 16 | three[1] << 8 | three[2], _SPACE_3)
    return found


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the chunks of the texts of ``data`` begin, which have the space or line end that they are cut at as first."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    at = at[~(edge[at] | edge[at + 1])]
    at = at[~_spaces(data, at - 1, -1)]
    at = at[~_spaces(data, at + 1, 1)]
    edge[at] = True
    mark = at[_MARK[data[at - 1]]] - 1
    edge[mark[_ALNUM[data[mark - 1]]]] = True
    return np.flatnonzero(edge[:-1])


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {i: len(t.content.encode()) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        #: Bytes that an id stands for: one for each character of a byte-level token.
        self.width = np.zeros(max([*vocabulary.values(), *added]) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        for i, n in added.items():
            self.width[i] = n
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat, self.bounds = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids straight from tokenizers."""
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: list[bytes]) -> None:
        joined, rest = [], []
        for k in keys:
            t = k.decode()
            (joined if t[0] in " \n" and not t[1:2].isspace() and not t[-1].isspace() else rest).append(k)
        if joined:
            (ids,) = self.whole([b"".join(joined).decode()])
            self._add(joined, ids, np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(k) for k in joined]), side="right"))
        if rest:
            found = self.whole([k.decode() for k in rest])
            self._add(rest, np.concatenate(found), np.cumsum([len(f) for f in found]))

    def _add(self, keys: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        n, at = len(self.place), int(self.bounds[len(self.place)])
        if n + len(keys) >= len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros(len(self.bounds) + len(keys), np.int64)])
        if at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) + len(ids), "<u4")])
        self.flat[at : at + len(ids)] = ids
        self.bounds[n + 1 : n + 1 + len(keys)] = at + ends
        self.place.update(zip(keys, range(n, n + len(keys))))

    def _block(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some chunks, one after another, and how many each has."""
        if len(self.place) > KEPT:
            self._clear()
        coded = chunks.dictionary_encode()
        keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [k for k in keys if k not in self.place]
        # Long chunks come last, to be forgotten after the block.
        long = [k for k in new if len(k) > LONGEST]
        for some in ([k for k in new if len(k) <= LONGEST], long):
            if some:
                self._learn(some)
        place = self.place
        which = np.array([place[k] for k in keys], np.int64)[coded.indices.to_numpy()]
        count = self.bounds[which + 1] - self.bounds[which]
        ends = np.cumsum(count)
        ids = self.flat[np.repeat(self.bounds[which] - (ends - count), count) + np.arange(ends[-1])]
        for k in long:
            del place[k]
        return ids, count

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts in ``data``, one after another, and where each text's begin (and the last one's end)."""
        starts = chunk_starts(data, offsets)
        bounds = np.append(starts, len(data)).astype(np.int64)
        ids, ends = [np.zeros(0, "<u4")], [np.zeros(1, np.int64)]
        for at in range(0, len(starts), BLOCK):
            n = min(BLOCK, len(starts) - at)
            chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds[at : at + n + 1]), pa.py_buffer(data)])
            found, count = self._block(chunks)
            ids.append(found)
            ends.append(ends[-1][-1] + np.cumsum(count))
        return np.concatenate(ids), np.concatenate(ends)[np.searchsorted(starts, offsets)]

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids."""
        parts = [t.encode() for t in texts]
        offsets = np.cumsum([0, *[len(p) for p in parts]])
        ids, at = self.texts(np.frombuffer(b"".join(parts), np.uint8), offsets)
        return [ids[a:b] for a, b in zip(at[:-1], at[1:])]


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    return Encoder(path)


def forget() -> None:
    """Give back what this process's encoders keep; workers outlive their stage, and call this when they start other work on texts."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        release_memory()
