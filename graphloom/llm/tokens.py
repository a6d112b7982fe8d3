"""Token ids of a public word-end BPE tokenizer, with a bounded cache of white-space-separated chunks."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

TOKENIZER = "word_bpe_49k.json"
#: Chunks kept in one Python worker before its cache starts anew.
CACHE_CHUNKS = 500_000

#: Characters for which lower-casing, NFC and white space need no care: ASCII and the Latin letters up to U+017F.
_OTHER = re.compile("[^\t-\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-įı-ſ]")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-ſ]+|[0-9]|[^\\s0-9a-z\xdf-\xf6\xf8-ſ]+")
_SPECIAL = ("<|startoftext|>", "<|endoftext|>")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class _Slots(dict):
    """Chunks' places in the cache; a new chunk gets the next one and waits in ``new`` for its ids."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = slot = len(self)
        self.new.append(chunk)
        return slot


class ChunkTokenizer:
    """Ids equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``, for a batch of texts at once.

    The tokenizer treats white space as a hard border, so a text's ids are the concatenation of its chunks' ids.
    Texts with other characters than ``_OTHER`` allows, or with the special tokens' strings, go to the library whole.
    """

    def __init__(self, path: str, limit: int = CACHE_CHUNKS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.slots = _Slots()
        self.pieces: dict[str, tuple[int, int]] = {}
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0

    def _store(self, ids: np.ndarray) -> int:
        """Put ids at the end of the flat store; where they start."""
        at = self.used
        while at + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[at : at + len(ids)] = ids
        self.used = at + len(ids)
        return at

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, chunks: list[str]) -> None:
        split = [_PIECES.findall(c) for c in chunks]
        new = list(dict.fromkeys(p for ps in split for p in ps if p not in self.pieces))
        for at in range(0, len(new), 1000):
            group = new[at : at + 1000]
            ids = self._encode(" ".join(group))
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(group):
                start = self._store(ids)
                lengths = np.diff(cuts, prepend=0)
                self.pieces.update(zip(group, zip((cuts - lengths + start).tolist(), lengths.tolist())))
            else:
                for piece in group:
                    ids = self._encode(piece)
                    self.pieces[piece] = (self._store(ids), len(ids))
        known, places = self.pieces, []
        for ps in split:
            if len(ps) == 1:
                places.append(known[ps[0]])
            else:
                ids = np.concatenate([self.flat[a : a + n] for a, n in map(known.__getitem__, ps)])
                places.append((self._store(ids), len(ids)))
        first = len(self.slots) - len(chunks)
        while first + len(chunks) > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        both = np.array(places, np.int64).reshape(-1, 2)
        self.starts[first : first + len(chunks)], self.lengths[first : first + len(chunks)] = both[:, 0], both[:, 1]

    def _slots(self, texts: list[str]) -> list[np.ndarray | None]:
        """The places of each text's chunks in the cache; None for a text that the library gets whole."""
        if len(self.slots) > self.limit:
            self._clear()
        find, out = self.slots.__getitem__, []
        for t in texts:
            if _OTHER.search(t) or "<|" in t and any(s in t for s in _SPECIAL):
                out.append(None)
            else:
                chunks = t.lower().split()
                out.append(np.fromiter(map(find, chunks), np.int64, len(chunks)))
        new, self.slots.new = self.slots.new, []
        if new:
            self._learn(new)
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids."""
        out = []
        for text, slots in zip(texts, self._slots(texts)):
            if slots is None:
                out.append(self._encode(text))
                continue
            n = self.lengths[slots]
            ends = np.cumsum(n)
            out.append(self.flat[np.repeat(self.starts[slots] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)])
        return out

    def counts(self, texts: list[str]) -> list[int]:
        """Each text's number of ids."""
        return [len(self._encode(t)) if slots is None else int(self.lengths[slots].sum()) for t, slots in zip(texts, self._slots(texts))]


@lru_cache(maxsize=2)
def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """One tokenizer for each Python worker, kept between tasks."""
    return ChunkTokenizer(path)
