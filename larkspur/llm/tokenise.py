"""Public tokenizers inside workers. Ids of the word tokenizer come through a bounded cache of white-space pieces."""

from __future__ import annotations

import itertools
import os

import numpy as np

from . import bytesops as B
from .runtime import caches

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.tiktoken"
#: Pieces a worker keeps; the oldest half, which holds the frequent ones, outlives a clearing.
CACHE = 300_000


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


class _Index(dict):
    """Numbers keys in the order they are first asked for; `fresh` lists those not yet learnt."""

    def __init__(self, *args):
        super().__init__(*args)
        self.fresh: list[bytes] = []

    def __missing__(self, key: bytes) -> int:
        n = self[key] = len(self)
        self.fresh.append(key)
        return n


_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
#: ASCII punctuation but the apostrophe, which contractions bind to letters.
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


class PieceEncoder:
    """Ids of whole texts under a lower-casing tokenizer whose tokens never cross ASCII white space and drop it.

    A text is split at ASCII white space and where ASCII letters and marks meet, which the tokenizer's own pattern
    splits too. Each distinct piece is encoded once and the ids are gathered; this equals encoding the text, since
    neither normalisation nor merges reach across such a place.
    """

    def __init__(self, path: str = WORD_BPE, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(path))
        self.tokenizer.encode_special_tokens = True
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.cache = cache
        self.known = _Index()
        self.size = np.zeros(0, np.int64)
        self.start = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self) -> None:
        fresh, self.known.fresh = self.known.fresh, []
        size = np.zeros(len(fresh), np.int64)
        plain = np.array([x.isalpha() for x in fresh], bool)  # of bytes: ASCII letters only, so one word
        ids: list[np.ndarray] = []
        at = np.flatnonzero(plain)
        for i in range(0, len(at), 2048):
            part = at[i : i + 2048]
            got = np.array(self.tokenizer.encode(b" ".join(fresh[k] for k in part).decode(), add_special_tokens=False).ids, np.uint32)
            stop = np.flatnonzero(self.ends[got]) + 1
            size[part] = np.diff(stop, prepend=0)
            ids.append(got)
        at = np.flatnonzero(~plain)
        for i in range(0, len(at), 2048):
            part = at[i : i + 2048]
            got = self.tokenizer.encode_batch([fresh[k].decode("utf-8", "replace") for k in part], add_special_tokens=False)
            size[part] = [len(x) for x in got]
            ids.append(np.array([n for x in got for n in x.ids], np.uint32))
        order = np.concatenate((np.flatnonzero(plain), at))
        start = np.empty(len(fresh), np.int64)
        start[order] = len(self.flat) + np.cumsum(size[order]) - size[order]
        self.size, self.start = np.concatenate((self.size, size)), np.concatenate((self.start, start))
        self.flat = np.concatenate((self.flat, *ids))

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's begin (n + 1 offsets)."""
        if len(self.known) > self.cache:  # the oldest ones are the frequent ones
            keep = self.cache // 2
            self.known = _Index(itertools.islice(self.known.items(), keep))
            self.flat = np.concatenate([np.zeros(0, np.uint32), *(self.flat[a : a + n] for a, n in zip(self.start[:keep].tolist(), self.size[:keep].tolist(), strict=True))])
            self.size = self.size[:keep]
            self.start = np.cumsum(self.size) - self.size
        low = B.LOWER[data]
        solid = B.SOLID[low]
        cut = np.zeros(len(low) + 1, bool)
        cut[offs] = True
        before, letter, mark = low[:-1], _LETTER[low], _MARK[low]
        if len(low) > 1:
            cut[1:-1] |= (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
        begins = solid & cut[:-1]
        begins[1:] |= solid[1:] & ~solid[:-1]
        where = np.flatnonzero(cut[1:-1] & solid[1:] & B.SOLID[before]) + 1 if len(low) > 1 else np.zeros(0, np.int64)
        spaced = np.insert(low, where, 32).tobytes()
        pieces = spaced.split()
        code = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        if self.known.fresh:
            self._learn()
        size = self.size[code]
        total = np.zeros(len(code) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        at = np.arange(int(total[-1])) - np.repeat(total[:-1] - self.start[code], size)
        count = np.zeros(len(low) + 1, np.int64)
        np.cumsum(begins, out=count[1:])
        return self.flat[at], total[count[offs]]


_encoders: dict[str, PieceEncoder] = caches.setdefault("pieces", {})


def piece_encoder(path: str) -> PieceEncoder:
    """One per worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


_byte_pairs: dict[str, tuple[object, np.ndarray]] = caches.setdefault("bytes", {})


def byte_encoding(path: str) -> tuple[object, np.ndarray]:
    """A byte-level encoding, and the bytes in each of its tokens."""
    if path not in _byte_pairs:
        import base64

        import public_tokenizers
        import tiktoken

        with open(vocabulary_path(path), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            size[rank] = len(token)
        _byte_pairs[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), size
    return _byte_pairs[path]
