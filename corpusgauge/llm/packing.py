"""Hierarchical packing of token ids into windows of several lengths.

A document is cut into windows of the longest tier; what is left is routed to the shortest tier that holds it. From the
longest tier down, each piece opens a window of its tier, the window's gap is filled with the largest pieces that fit
from its own and the shorter tiers, and what gap remains takes the head of a shorter piece, whose rest is routed again. At the end of a
task what is left is cut into windows of smaller powers of two, so no window is padded.

Windows of a tier are dealt into step groups of equal tokens, back and forth by attention cost (the sum of squared piece
lengths), so that steps of a tier cost about the same.

A task packs the documents that it reads, a bounded buffer at a time: ids are never shuffled and a lost task is repeated
alone. Each task adds at most a few short windows.
"""

import bisect
import functools
import json

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .bpe import WORD, byte_letters, encoder, slices

TIERS = (256, 512, 1024, 2048)
#: Tokens that are gathered before they are packed.
BUFFER = 1 << 20
#: Tokens of a step group.
STEP = 1 << 15


@functools.lru_cache(maxsize=2)
def coder(path: str) -> tiktoken.Encoding:
    """An encoder of a vocabulary file of byte-level BPE, in which ids are ranks."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters, special = byte_letters(), {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("vocabulary", pat_str=WORD.pattern, mergeable_ranks=ranks, special_tokens=special)


def token_ids(text: str, path: str, end: int) -> np.ndarray:
    """The ids of a text, its special tokens' too, and the end id."""
    def encode(piece):
        try:
            return coder(path).encode_to_numpy(piece, allowed_special="all")
        except ValueError:  # more white space in a row than its patterns can go back over
            return np.frombuffer(encoder(path).encode([piece])[0], "<u4")

    return np.concatenate([*map(encode, slices(text)), [end]]).astype("<u4")


class Packer:
    """Packs documents given one by one; windows come out by flush()."""

    def __init__(self, tiers=TIERS, step: int = STEP):
        self.tiers, self.step = tuple(sorted(tiers)), step
        # Pieces (length, number, document's number, start) of each tier, by length.
        self.waiting: list[list[tuple[int, int, int, int]]] = [[] for _ in self.tiers]
        self.pieces = 0
        self.held = 0
        self.full: list[tuple[int, list[tuple[int, int, int]]]] = []

    def add(self, doc: int, tokens: int) -> None:
        longest = self.tiers[-1]
        for start in range(0, tokens - longest + 1, longest):
            self.full.append((longest, [(doc, start, longest)]))
        rest = tokens % longest
        self.held += rest
        if rest:
            self._route(doc, tokens - rest, rest)

    def _route(self, doc: int, start: int, length: int) -> None:
        self.pieces += 1
        bisect.insort(self.waiting[bisect.bisect_left(self.tiers, length)], (length, self.pieces, doc, start))

    def _largest(self, tier: int, gap: int):
        """Take the largest waiting piece of up to `gap` tokens from the tier or a shorter one."""
        for pieces in self.waiting[tier::-1]:
            at = bisect.bisect_left(pieces, (gap + 1,))
            if at:
                return pieces.pop(at - 1)
        return None

    def _smallest(self):
        for pieces in self.waiting:
            if pieces:
                return pieces.pop(0)
        return None

    def flush(self, last: bool = False) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """Windows (length, pieces (document, start, length)); the last time all that waits."""
        windows, self.full = self.full, []
        for tier in range(len(self.tiers) - 1, -1, -1):
            size = self.tiers[tier]
            while self.waiting[tier] and self.held >= size:
                length, _, doc, start = self.waiting[tier].pop()
                window, gap = [(doc, start, length)], size - length
                while gap:
                    piece = self._largest(tier, gap)
                    if piece is None:
                        n, _, doc, start = self._smallest()
                        self._route(doc, start + gap, n - gap)
                        piece = (gap, 0, doc, start)
                    window.append((piece[2], piece[3], piece[0]))
                    gap -= piece[0]
                windows.append((size, window))
                self.held -= size
        if last:
            while self.held:
                size = 1 << (min(self.held, self.tiers[-1]).bit_length() - 1)
                window, gap = [], size
                while gap:
                    n, _, doc, start = self._largest(len(self.tiers) - 1, self.tiers[-1])
                    if n > gap:
                        self._route(doc, start + gap, n - gap)
                    window.append((doc, start, min(n, gap)))
                    gap -= min(n, gap)
                windows.append((size, window))
                self.held -= size
        return windows

    def steps(self, windows) -> list[int]:
        """The step group of each window, counted from 0."""
        out, first = [0] * len(windows), 0
        for size in sorted({w[0] for w in windows}):
            same = [i for i, w in enumerate(windows) if w[0] == size]
            same.sort(key=lambda i: -sum(p[2] ** 2 for p in windows[i][1]))
            groups = -(-len(same) // max(1, self.step // size))
            for k, i in enumerate(same):
                turn, at = divmod(k, groups)
                out[i] = first + (at if turn % 2 == 0 else groups - 1 - at)
            first += groups
        return out


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, window int, step_id long"


def pack(docs: DataFrame, vocabulary: str, end: int = 1, tiers=TIERS, text: str = "text", key: str = "doc_id", step: int = STEP,
         buffer: int = BUFFER) -> DataFrame:
    """One row per piece of a document's ids: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id,
    offset, window (the sequence's length) and step_id.

    Null and empty texts have the end id only. Null and repeated ids are carried along: each row is a document. Tiers are
    powers of two. Other columns are left out.
    """
    tiers = tuple(sorted(tiers))
    if any(t < 1 or t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")

    def run(batches):
        task = TaskContext.get().partitionId() << 40
        packer, docs_held, number, sequence, steps = Packer(tiers, step), {}, 0, 0, 0

        def emit(windows):
            nonlocal sequence, steps
            groups = packer.steps(windows)
            for begin in range(0, len(windows), 512):
                rows = []
                for (size, pieces), group in zip(windows[begin : begin + 512], groups[begin : begin + 512]):
                    offset = 0
                    for doc, start, n in pieces:
                        held = docs_held[doc]
                        rows.append((held[0], start, n, held[1][start : start + n].tobytes(), len(held[1]), task + sequence, offset, size, task + steps + group))
                        offset += n
                        held[2] -= n
                        if not held[2]:
                            del docs_held[doc]
                    sequence += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), KINDS)], [f.split()[0] for f in SCHEMA.split(", ")])
            steps += max(groups, default=-1) + 1

        waiting = 0
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1)):
                ids = token_ids(t.as_py() or "", vocabulary, end)
                docs_held[number] = [k.as_py(), ids, len(ids)]
                packer.add(number, len(ids))
                number += 1
                waiting += len(ids)
                if waiting >= buffer:
                    yield from emit(packer.flush())
                    waiting = 0
        yield from emit(packer.flush(last=True))

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, SCHEMA)


KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_id")
