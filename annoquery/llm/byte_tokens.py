"""Token ids of whole texts by a byte-level BPE file of the tokenizers library, a chunk between single spaces at a time."""

from __future__ import annotations

import json
import os
from itertools import pairwise

import numpy as np

from .shared import _Slots

_SPACE = "Ġ"  # how byte-level vocabularies write a leading space
#: How byte-level BPE splits a text (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _letters() -> list[str]:
    """The characters that stand for the 256 bytes: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class ByteTextEncoder:
    """Ids of texts; each distinct chunk goes through the library once and is kept in a table of at most ``most`` chunks, which then starts anew.

    The splitting pattern of byte-level BPE puts a single space in front of the run that follows it, and nothing else
    crosses such a place. So where a space stands between two characters that are no white space, a text can be cut. A text
    with white space beside a space, or at an end, goes whole through the library.
    """

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library, self.most = Tokenizer.from_file(path), most
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        model = json.loads(self.library.to_str())["model"]
        letters = dict(zip(_letters(), range(256)))
        merged = (model["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"])
        self.special = [t for t in vocabulary if t not in model["vocab"]]
        self.quick = None
        if all(a < b for a, b in pairwise(merged)):  # ids in the order of the merges: ids serve as ranks
            ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items()}
            self.quick = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith(_SPACE)]] = True
        self.clear()

    def clear(self) -> None:
        self.slots = _Slots()
        self.ids, self.start, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, text: str) -> list[int]:
        if self.quick and not any(t in text for t in self.special):
            return self.quick.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids

    def _learn(self) -> None:
        """Encode queued chunks; a key that ends in a space is the first chunk of a text. Length -1: a chunk that no clean cut gives."""
        queued, self.slots.queued = self.slots.queued, []
        if not queued:
            return
        clean = [i for i, c in enumerate(queued) if c[-1:] not in ("", " ") and not c[0].isspace() and not c[-1].isspace()]
        first = [i for i, c in enumerate(queued) if c[-1:] == " " and len(c) > 1 and not c[0].isspace() and not c[-2].isspace()]
        flat, lengths, starts = np.zeros(0, np.uint32), np.full(len(queued), -1, np.int64), np.zeros(len(queued), np.int64)
        if clean:
            flat = np.asarray(self._ids(" " + " ".join([queued[i] for i in clean])), np.uint32)
            edges = np.flatnonzero(np.append(self.begins[flat], True))
            if len(edges) != len(clean) + 1 or edges[0]:
                raise ValueError("the vocabulary does not mark leading spaces")
            lengths[clean], starts[clean] = np.diff(edges), edges[:-1]
        if first:
            own = [self._ids(queued[i][:-1]) for i in first]
            lengths[first] = size = np.array(list(map(len, own)))
            starts[first] = len(flat) + np.cumsum(size) - size
            flat = np.concatenate([flat, np.fromiter((i for ids in own for i in ids), np.uint32)])
        self.start = np.concatenate([self.start, len(self.ids) + starts])
        self.length = np.concatenate([self.length, lengths])
        self.ids = np.concatenate([self.ids, flat])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """One array of unsigned 32-bit ids per text; null and empty texts give empty arrays."""
        if self.slots.total > self.most:
            self.clear()
        slot, cut = self.slots.__getitem__, []
        for text in texts:
            chunks = (text or "").split(" ")
            chunks[0] += " "
            cut.append(np.fromiter(map(slot, chunks), np.int64, len(chunks)))
        self._learn()
        out = []
        for text, at in zip(texts, cut):
            lengths = self.length[at]
            if lengths.min() < 0:
                out.append(np.asarray(self._ids(text) if text else [], np.uint32))
                continue
            shift = self.start[at] - (np.cumsum(lengths) - lengths)
            out.append(self.ids[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))])
        return out
