"""Token ids of whole texts by the ``tokenizers`` library, each distinct piece of a slice encoded once.

A byte-level BPE of this kind splits a text wherever a space comes before a non-space, and never merges
across such a place. So texts are cut there, the library encodes the distinct pieces (many in one string,
told apart by their leading space), and a text's ids are its pieces' ids in order. Texts where a space is
followed by white space or by the end are left whole for the library. Both ways give the ids that the
library gives for the whole text. Pieces that a slice has more than once are remembered, up to a bound.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are encoded at once: the more, the fewer pieces are met again.
SLICE_BYTES = 4 << 20
#: Pieces that are remembered, pieces in one string, and pieces in one call of the library.
REMEMBERED, _JOINED, _CALL = 400_000, 512, 1 << 15
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers begins[0] to begins[0] + sizes[0], then those of the next range, and so on."""
    reach = np.cumsum(sizes)
    n = int(reach[-1]) if len(reach) else 0
    kind = np.int32 if n < 1 << 30 and (not n or int(begins.max()) < 1 << 30) else np.int64
    out = np.repeat((begins - reach + sizes).astype(kind), sizes)
    out += np.arange(n, dtype=kind)
    return out


def _loose(pieces: pa.Array) -> np.ndarray:
    """Which pieces are empty or begin with white space."""
    offsets, data = (np.frombuffer(b, t) if b is not None else np.zeros(0, t) for b, t in zip(pieces.buffers()[1:], (np.int64, np.uint8), strict=True))
    offsets = offsets[pieces.offset : pieces.offset + len(pieces) + 1]
    out = np.diff(offsets) == 0
    first = data[np.minimum(offsets[:-1], max(len(data) - 1, 0))] if len(data) else np.zeros(len(pieces), np.uint8)
    out |= _WHITE[first]
    for k in np.flatnonzero(((first == 0xC2) | (first >= 0xE1) & (first <= 0xE3)) & ~out):  # other characters of white space
        out[k] = pieces[int(k)].as_py()[0].isspace()
    return out


class Encoder:
    """Encodes texts with the vocabulary file at ``path``. Strings of special tokens are ordinary text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self._opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self._opens[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self._known = pa.array([], pa.large_string())
        self._known_ids, self._known_sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of strings encoded one by one."""
        encoded = [e.ids for e in self._tokenizer.encode_batch(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(encoded), np.uint32), np.fromiter(map(len, encoded), np.int64, len(encoded))

    def _spaced(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of pieces, each after a space."""
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(pieces), _CALL):
            part = pieces.slice(at, _CALL).to_pylist()
            got, _ = self._each([" " + " ".join(part[k : k + _JOINED]) for k in range(0, len(part), _JOINED)])
            opens = np.flatnonzero(self._opens[got])
            sizes = np.diff(opens, append=len(got))
            if len(opens) != len(part):
                got, sizes = self._each([" " + p for p in part])
            ids.append(got)
            lengths.append(sizes)
        return np.concatenate(ids), np.concatenate(lengths)

    def _pieces(self, pieces: pa.Array, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for distinct pieces, known ones from memory; those of ``often`` are remembered."""
        found = pc.index_in(pieces, value_set=self._known)
        new = np.asarray(found.is_null())
        ids, lengths = self._spaced(pieces.filter(pa.array(new)))
        sizes = np.empty(len(pieces), np.int64)
        at = np.empty(len(pieces), np.int64)
        sizes[new], at[new] = lengths, len(self._known_ids) + np.cumsum(lengths) - lengths
        old = np.asarray(found.drop_null()).astype(np.int64)
        sizes[~new], at[~new] = self._known_sizes[old], (np.cumsum(self._known_sizes) - self._known_sizes)[old]
        pool = np.concatenate([self._known_ids, ids])
        out = pool[_ranges(at, sizes)]
        keep = new & often
        if keep.any() and len(self._known) < REMEMBERED:
            self._known = pa.concat_arrays([self._known, pieces.filter(pa.array(keep)).cast(pa.large_string())])
            self._known_ids = np.concatenate([self._known_ids, pool[_ranges(at[keep], sizes[keep])]])
            self._known_sizes = np.concatenate([self._known_sizes, sizes[keep]])
        return out, sizes

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): all texts' uint32 ids in order, and where each text's begin (one more than texts).

        ``end`` is put after each text. Null and empty texts have no ids but ``end``.
        """
        texts = texts.fill_null("")
        n = len(texts)
        split = pc.split_pattern(texts.cast(pa.large_string()), " ")
        offsets = np.asarray(split.offsets)[: n + 1] - (split.offsets[0].as_py() if n else 0)
        coded = split.flatten().dictionary_encode()
        index, pieces = np.asarray(coded.indices), coded.dictionary.cast(pa.large_string())
        leads = np.zeros(len(index), bool)
        leads[offsets[:-1]] = True
        often = np.bincount(index[~leads], minlength=len(pieces))
        spaced = often > 0
        loose = _loose(pieces) & spaced
        odd = np.zeros(n, bool)
        if loose.any():
            at = np.flatnonzero(loose[index] & ~leads)
            odd[np.searchsorted(offsets, at, side="right") - 1] = True
        spaced &= ~loose

        use = np.flatnonzero(spaced)
        ids, lengths = self._pieces(pieces.take(pa.array(use)), often[use] > 1)
        lead, lead_of = np.unique(index[leads], return_inverse=True)
        lead_ids, lead_lengths = self._each(pieces.take(pa.array(lead)).to_pylist())
        pool = np.concatenate([ids, lead_ids])
        sizes = np.concatenate([lengths, lead_lengths, [0]])
        begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        place = np.full(len(pieces), len(sizes) - 1, np.int64)
        place[use] = np.arange(len(use))
        where = place[index]
        where[leads] = len(use) + lead_of
        counts = sizes[where]
        out = pool[_ranges(begins[where], counts)]
        first = np.concatenate([[0], np.cumsum(counts)])[offsets]
        if odd.any():
            whole = np.flatnonzero(odd)
            odd_ids, odd_lengths = self._each([texts[int(k)].as_py() for k in whole])
            bodies, at = [], 0
            for k in range(n):
                if odd[k]:
                    size = odd_lengths[np.searchsorted(whole, k)]
                    bodies.append(odd_ids[at : at + size])
                    at += size
                else:
                    bodies.append(out[first[k] : first[k + 1]])
            out = np.concatenate(bodies)
            first = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
        if end is None:
            return out, first
        ended = first + np.arange(n + 1)
        joined = np.full(int(ended[-1]), end, np.uint32)
        body = np.ones(len(joined), bool)
        body[ended[1:] - 1] = False
        joined[body] = out
        return joined, ended


#: Encoders by path, one for each process.
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
