"""Token ids of whole texts, by the tokenizers library, as little-endian 32-bit bytes.

A byte-level tokenizer first cuts a text into pieces (words with the space
before them, numbers, punctuation, white space) and encodes each by itself. So
a task keeps the ids of pieces it has met and asks the tokenizer only for new
ones, many at a time. That holds for texts of printable ASCII, line feeds and
Latin letters, for which the pieces are cut here by the same pattern; any other
text, and one with a special token's string in it, goes to the tokenizer whole.
"""

from __future__ import annotations

import os
import re
import sys
import types

import numpy as np

# Fixed: the cutting pattern of the byte-level tokenizers, on the characters named.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_PIECES = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")
_BEYOND = re.compile(rf"[^\x20-\x7e\n{_LETTERS}]")

HELD = 800_000  # pieces a worker keeps, some 160 MB
TOGETHER = 4 << 20  # bytes of texts to encode together, so that a new piece is encoded once for all of them
LONGEST = 64  # characters of a piece that is kept
_BREAK = "\n"


def _worker() -> types.ModuleType:
    """What this worker process keeps from one task to the next."""
    return sys.modules.setdefault("_pageloom_llm_worker", types.ModuleType("_pageloom_llm_worker"))


def let_go() -> None:
    """Drop the encoders this worker keeps: some 200 MB beside an operator that encodes nothing."""
    _worker().__dict__.pop("encoders", None)


class Encoder:
    """Ids of texts by one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.held: dict[str, bytes] = {}
        self.plain = _cuts_like(self.tokenizer)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.stop = self._ids([_BREAK])[0]

    @staticmethod
    def of(path: str) -> Encoder:
        """The worker's own encoder for a file."""
        kept = _worker().__dict__.setdefault("encoders", {})
        if path not in kept:
            kept[path] = Encoder(path)
        return kept[path]

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return [np.array(ids, "<u4").tobytes() for ids in found]

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces: joined by line feeds, encoded together, and parted at the line feed's id."""
        alone = [p for p in pieces if _BREAK in p or p.isspace()]
        joined = [p for p in pieces if not (_BREAK in p or p.isspace())]
        out = dict(zip(alone, self._ids(alone)))
        for low in range(0, len(joined), 2048):
            group = joined[low: low + 2048]
            ids = np.frombuffer(self._ids([_BREAK.join(group)])[0], "<u4")
            cuts = np.flatnonzero(ids == np.frombuffer(self.stop, "<u4")[0])
            if len(cuts) != len(group) - 1:
                raise ValueError("the tokenizer does not encode pieces by themselves")
            raw, begin = ids.tobytes(), 0
            for piece, cut in zip(group, [*(4 * cuts).tolist(), len(raw)]):
                out[piece] = raw[begin:cut]
                begin = cut + 4
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes each."""
        whole = [i for i, t in enumerate(texts) if not self.plain or _BEYOND.search(t) or any(x in t for x in self.added)]
        out: list[bytes] = [b""] * len(texts)
        if whole:
            for i, ids in zip(whole, self._ids([texts[i] for i in whole])):
                out[i] = ids
        held, special = self.held, set(whole)
        get = held.get
        waiting, missing = [], set()
        for i, text in enumerate(texts):
            if i in special:
                continue
            pieces = _PIECES.findall(text)
            ids = [*map(get, pieces)]
            if None in ids:
                missing.update([p for p, x in zip(pieces, ids) if x is None])
                waiting.append((i, pieces, ids))
            else:
                out[i] = b"".join(ids)
        new = self._learn(list(missing)) if missing else {}
        for i, pieces, ids in waiting:
            out[i] = b"".join([new[p] if x is None else x for p, x in zip(pieces, ids)])
        # The pieces met first are the frequent ones; those met later are encoded once for each batch.
        for piece, ids in new.items():
            if len(held) >= HELD:
                break
            if len(piece) <= LONGEST:
                held[piece] = ids
        return out


def _cuts_like(tokenizer) -> bool:
    """Whether a tokenizer cuts a sample text as the pattern here does and knows no special words within it."""
    sample = "It's  a\n\n word's end, 'tis \n 1,234 ok?! x'll  \n" + "Ärger élan $$$ a_b"
    try:
        cut = [sample[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(sample)]
    except Exception:
        return False
    return cut == _PIECES.findall(sample) and tokenizer.normalizer is None


def ids_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4")
