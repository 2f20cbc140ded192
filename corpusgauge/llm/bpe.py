"""Byte-level BPE by traversal of the trie of distinct words.

The last token of a prefix's encoding decides the rest: the encoding of a prefix is that of the prefix without its last
token, followed by that token. So every node of the trie of distinct words needs one state, its last token, and words
that share a prefix share the states of that prefix. Sorted words are the trie in depth-first order: going from one word
to the next keeps the states of the common prefix and computes those of the new bytes.

Text is split into words, each distinct word of a block of texts is encoded once, and texts are put together from the
encodings of their words. Words met before are remembered, up to MEMORY of them per Python worker and emptied then,
which bounds memory and changes no result.
"""

import functools
import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Fixed value: the pattern of byte-level BPE vocabularies that splits text before the merges.
WORD = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")

#: A space with white space or the end behind it.
ODD = re.compile(r" (?=\s|\Z)")

#: Pieces of text whose encoding a worker remembers.
MEMORY = 400_000
#: Characters of text that are split into words at once.
BLOCK = 1 << 22


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable bytes are themselves, others follow from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable}
    return letters | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}


class Encoder:
    """Encodings by one vocabulary file of byte-level BPE merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.tokens = [b""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for token, i in self.ids.items():
            self.tokens[i] = token
        for text, i in self.special.items():
            self.tokens[i] = text.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {(raw(a), raw(b)): rank for rank, (a, b) in enumerate(merges)}
        # The endings of tokens; an ending that is a token has its id.
        self.endings = {t[i:]: -1 for t in self.ids for i in range(len(t))} | self.ids
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}

    def merged(self, text: bytes) -> list[bytes]:
        """The merges applied one by one, as they define the encoding; used for pairs of tokens only."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get((a, b), len(self.ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == len(self.ranks):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, pair: tuple[int, int]) -> bool:
        """Whether the right token of a pair stays a token of its own behind the left one."""
        if len(self.pairs) > 2 * MEMORY:
            self.pairs.clear()
        a, b = self.tokens[pair[0]], self.tokens[pair[1]]
        self.pairs[pair] = kept = self.merged(a + b) == [a, b]
        return kept

    def traverse(self, words: list[bytes]) -> Iterator[list[int]]:
        """The ids of each word; words are sorted, so that neighbours share the states of their common prefix."""
        last, before = [0], b""
        tokens, endings, pairs, follows = self.tokens, self.endings, self.pairs, self.follows
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                start = end - 1
                token = endings[word[start:end]]
                while start:
                    if token >= 0:
                        pair = (last[start], token)
                        if pairs[pair] if pair in pairs else follows(pair):
                            break
                    start -= 1
                    token = endings[word[start:end]]
                last.append(token)
            ids, end = [], len(word)
            while end:
                ids.append(last[end])
                end -= len(tokens[last[end]])
            yield ids[::-1]
            before = word

    def learn(self, pieces: set[str]) -> None:
        """Encode a space and each piece that isn't known."""
        new = [(piece, WORD.findall(" " + piece)) for piece in pieces.difference(self.pieces)]
        distinct = sorted({w.encode() for _, words in new for w in words})
        known = {w.decode(): array("I", ids).tobytes() for w, ids in zip(distinct, self.traverse(distinct))}
        for piece, words in new:
            self.pieces[piece] = known[words[0]] if len(words) == 1 else b"".join(map(known.__getitem__, words))

    def encode_plain(self, parts: list[str]) -> list[bytes]:
        """The ids of each part; parts hold no special token.

        A space that stands alone between others begins a word, so a part is its pieces between spaces, each with the
        space before it. Parts in which white space meets a space are split by the pattern instead.
        """
        split = [None if ODD.search(part) else part.split(" ") for part in parts]
        if len(self.pieces) > MEMORY:
            self.pieces.clear()
        self.learn({piece for pieces in split if pieces for piece in pieces[1:]})
        others = [WORD.findall(part if pieces is None else pieces[0]) for part, pieces in zip(parts, split)]
        distinct = sorted({w.encode() for words in others for w in words})
        known = {w.decode(): array("I", ids).tobytes() for w, ids in zip(distinct, self.traverse(distinct))}
        return [
            b"".join(map(known.__getitem__, words)) + (b"".join(map(self.pieces.__getitem__, pieces[1:])) if pieces else b"")
            for words, pieces in zip(others, split)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as unsigned 32-bit integers in the machine's (little-endian) order."""
        out: list[list[bytes]] = [[] for _ in texts]
        block: list[tuple[int, str]] = []
        size = 0

        def flush():
            for (i, _), ids in zip(block, self.encode_plain([part for _, part in block])):
                out[i].append(ids)
            block.clear()

        for i, text in enumerate(texts):
            for part in self.cut.split(text) if self.cut else [text]:
                if part in self.special:
                    flush()
                    out[i].append(array("I", [self.special[part]]).tobytes())
                    continue
                for piece in slices(part):
                    block.append((i, piece))
                    size += len(piece)
                    if size >= BLOCK:
                        flush()
                        size = 0
        flush()
        return [b"".join(parts) for parts in out]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


def slices(text: str) -> Iterator[str]:
    """The text in pieces of about BLOCK characters, cut before a space that follows a letter, where words end too."""
    start = 0
    while len(text) - start > BLOCK:
        cut = CUT.search(text, start + BLOCK)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


CUT = regex.compile(r"(?<=\p{L}) ")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    return Encoder(path)


def encode_decode(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_tokens, ids (array of int) and the text decoded from the ids.

    A null text counts as empty and has no ids. Nulls and repeated values in the key are kept, other columns are left
    out. vocabulary is a path that executors can read.
    """
    def run(batches):
        coder = encoder(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for keys, part in chunks(batch.column(0), texts):
                ids = [np.frombuffer(x, "<u4") for x in coder.encode(part)]
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("i4") for x in ids], pa.list_(pa.int32())),
                     pa.array([coder.decode(x.tolist()) for x in ids], pa.string())], ["key", "n_tokens", "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(
        run, f"key {kind}, n_tokens long, ids array<int>, decoded string").withColumnRenamed("key", key)


def digest(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """As encode_decode, with the SHA-256 of the decimal ids joined by commas and of the decoded text in their place."""
    def run(batches):
        coder = encoder(vocabulary)
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for keys, part in chunks(batch.column(0), texts):
                counts, ids_sha, text_sha = [], [], []
                for raw in coder.encode(part):
                    ids = np.frombuffer(raw, "<u4").tolist()
                    counts.append(len(ids))
                    ids_sha.append(sha(",".join(map(str, ids)).encode()))
                    text_sha.append(sha(coder.decode(ids).encode()))
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                    ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(
        run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


def chunks(keys: pa.Array, texts: list[str]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Runs of rows of about BLOCK characters, at least one row each."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= BLOCK or i == len(texts) - 1:
            yield keys.slice(start, i + 1 - start), texts[start : i + 1]
            start, size = i + 1, 0
