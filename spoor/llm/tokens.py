"""Token ids of whole texts by a public tokenizer file, with the work shared by words.

The tokenizer splits at white space before anything else, so a text's ids are those of
its space-separated chunks one after another. Chunks of a block are numbered by hash and
each new one is encoded once; plain chunks (letters, then ASCII punctuation) go straight
to the tokenizer's BPE model, the rest through the whole tokenizer.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from spoor.llm import common

#: Chunks and letter runs a worker remembers; beyond that it starts afresh.
REMEMBERED = 800_000
#: Ids a worker remembers: 32 MB.
REMEMBERED_IDS = 8 << 20

SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")


def _visible_bytes() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it
    prints, else the next code point from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = Tokenizer(self.whole.model)
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.shown = str.maketrans({chr(b): c for b, c in _visible_bytes().items()})
        self._forget()

    def _forget(self) -> None:
        # Hashes of known chunks, ascending, and the place of each; ids of letter runs.
        self.known = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.runs: dict[str, bytes] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 12, np.int64)
        self.used = 0

    def _encode_runs(self, runs: list[str]) -> None:
        """Ids of letter or punctuation runs by the model alone; a run ends with the id
        of a word end."""
        for i in range(0, len(runs), 1000):
            part = runs[i:i + 1000]
            shown = [x if x.isascii() else x.encode().decode("latin1").translate(self.shown) for x in part]
            ids = np.array(self.model.encode_batch_fast([shown], is_pretokenized=True, add_special_tokens=False)[0].ids, np.int64)
            cut = np.flatnonzero(self.ends[ids]) + 1
            for x, piece in zip(part, np.split(ids, cut[:-1])):
                self.runs[x] = piece.astype(np.uint32).tobytes()

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """The 32-bit ids of each chunk."""
        plans: list[tuple[str, ...] | None] = []
        new: dict[str, None] = {}
        for chunk in chunks:
            plan = None
            body = chunk.rstrip("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
            if body.isalpha() and (chunk.isascii() or (max(chunk) < "ɐ" and "İ" not in chunk)):
                plan = (body.lower(), chunk[len(body):]) if len(body) < len(chunk) else (body.lower(),)
                for x in plan:
                    if x not in self.runs:
                        new[x] = None
            plans.append(plan)
        self._encode_runs(list(new))
        other = iter(self.whole.encode_batch_fast([c for c, p in zip(chunks, plans) if p is None], add_special_tokens=False))
        return [np.array(next(other).ids, np.uint32).tobytes() if p is None else self.runs[p[0]] if len(p) == 1 else self.runs[p[0]] + self.runs[p[1]] for p in plans]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin (one more at the end)."""
        w = common.words(texts)
        known, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        if (len(self.known) + len(known) > REMEMBERED or self.used > REMEMBERED_IDS) and len(self.known):
            self._forget()
        spot = np.searchsorted(self.known, known)
        index = np.full(len(known), -1, np.int64)
        if len(self.known):
            near = np.minimum(spot, len(self.known) - 1)
            index = np.where(self.known[near] == known, self.place[near], -1)
        new = np.flatnonzero(index < 0)
        if len(new):
            encoded = self._encode_chunks([w.bytes_of(first[i]).decode() for i in new])
            sizes = np.array([len(x) // 4 for x in encoded], np.int64)
            n = len(self.known)
            while n + len(new) + 1 > len(self.start):
                self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            total = int(sizes.sum())
            while self.used + total > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.used:self.used + total] = np.frombuffer(b"".join(encoded), np.uint32)
            self.start[n + 1:n + 1 + len(new)] = self.used + np.cumsum(sizes)
            self.used += total
            index[new] = np.arange(n, n + len(new))
            self.known = np.insert(self.known, spot[new], known[new])
            self.place = np.insert(self.place, spot[new], index[new])
        chunk = index[inverse]
        begin, size = self.start[chunk], self.start[chunk + 1] - self.start[chunk]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) + np.repeat(begin - (ends - size), size)]
        at = np.concatenate([[0], ends])[w.at]
        odd = [d for d in range(len(texts)) if (s := w.raw[w.start[w.at[d]]:w.end[w.at[d + 1] - 1]].tobytes() if w.at[d + 1] > w.at[d] else b"").find(b"<|") >= 0
               and any(x in s for x in SPECIAL)]
        if odd:  # special tokens are found in a text before it is split
            parts = [ids[at[d]:at[d + 1]] for d in range(len(texts))]
            for d in odd:
                parts[d] = np.array(self.whole.encode(texts[d].as_py(), add_special_tokens=False).ids, np.uint32)
            ids = np.concatenate(parts)
            at = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, at


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; it keeps what it knows from task to task."""
    if path not in common.remembered:
        common.remembered[path] = Encoder(path)
    return common.remembered[path]
