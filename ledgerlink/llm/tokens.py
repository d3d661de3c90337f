"""Token ids of a public byte-level BPE, by dynamic programming over prefixes (problem 6)."""

from __future__ import annotations

import base64
import itertools
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary files lie; a parameter of every function that reads them.
TOKENIZERS = "/opt/tokenizers"
#: Characters that are cut at a time, and distinct words that a worker remembers.
BLOCK_CHARS, MEMORY_WORDS = 1_000_000, 400_000
OTHER, LETTER, NUMBER, SPACE, EDGE = range(5)


@cache
def char_classes() -> np.ndarray:
    """The class of each code point; EDGE is what stands between texts."""
    import regex

    table = np.zeros(0x110001, dtype=np.uint8)
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4")
    every = points.tobytes().decode("utf-32-le")
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for m in regex.finditer(pattern, every):
            table[points[m.start() : m.end()]] = kind
    table[0x110000] = EDGE
    return table


def word_starts(codes: np.ndarray) -> np.ndarray:
    """Where the vocabulary's words begin in code points; texts are divided by 0x110000, which is a word of its own.

    The same cuts as the pattern of the rank files makes: runs of letters, of numbers, of other signs, each
    with one blank before it; English contractions; white space but for its last character.
    """
    kind = char_classes()[codes]
    n = codes.size
    change = np.ones(n, dtype=bool)
    change[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == EDGE)
    space = kind == SPACE
    blank_before = np.zeros(n, dtype=bool)
    blank_before[1:] = codes[:-1] == 32
    cut = change & ~(blank_before & ~space & (kind != EDGE))
    ends = np.flatnonzero(space[:-1] & ~space[1:] & (kind[1:] != EDGE)) if n else np.empty(0, dtype=np.int64)
    cut[ends] = True  # the last white space before a word stands alone, or goes to it
    lone = np.flatnonzero((codes == 39) & cut & change)
    if lone.size:
        padded = np.concatenate([codes, np.full(2, 0x110000, dtype=codes.dtype)])
        a, b = padded[lone + 1], padded[lone + 2]
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        size = np.where(np.isin(a, [ord(x) for x in "stmd"]), 1, np.where(two, 2, 0))
        lone, size = lone[size > 0], size[size > 0]
        cut[lone + 1] = False
        after = lone + 1 + size
        cut[after[after < n]] = True
    return np.flatnonzero(cut)


class BytePairs:
    """A vocabulary of byte sequences ranked in order of their merges."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.text = {r: t for t, r in self.rank.items()}
        self.suffixes = ahocorasick.Automaton()
        for token, r in self.rank.items():
            self.suffixes.add_word(token.decode("latin-1"), (len(token), r))
        self.suffixes.make_automaton()
        self.fits: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = {}, {}
        self.whole: dict[int, bool] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the plain rule merges last to make this one; None for a single byte."""
        text = self.text[token]
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 2:
            ranks = [self.rank.get(a + b, 1 << 30) for a, b in itertools.pairwise(parts)]
            least = min(ranks)
            if least == 1 << 30:
                break
            k = ranks.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return (self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 else None

    def edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The pieces that stand at an edge of the token while it is merged (side 0: first, 1: last), each with the rank that ends it."""
        if (got := self.edges[side].get(token)) is None:
            got = [(self.text[token], 1 << 30)]
            if halves := self.halves(token):
                inner = self.edge(halves[side], side)
                got = [*got, (inner[0][0], token), *inner[1:]]
            self.edges[side][token] = got
        return got

    def compatible(self, a: int, b: int) -> bool:
        """Whether a text may be encoded with ``b`` right after ``a``.

        Merges happen in order of rank, so that each side merges as if alone until a piece at its edge
        merges across; a merge across comes first if its rank is less than what ends the left piece, and
        not more than what ends the right one (of equal ranks, the left goes first).
        """
        if (got := self.fits.get(key := a << 20 | b)) is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            rank = self.rank.get
            left, right = self.edge(a, 1), self.edge(b, 0)
            got = self.fits[key] = not any((q := rank(x + y)) is not None and q < x_end and q <= y_end for x, x_end in left for y, y_end in right)
        return got

    def encode(self, word: bytes) -> list[int]:
        """Ids of one word: the one last token of each prefix, from its suffixes in the vocabulary, then back."""
        if (whole := self.rank.get(word)) is not None and self.stands(whole):
            return [whole]
        last = [-1] * (len(word) + 1)
        for end, (size, token) in self.suffixes.iter(word.decode("latin-1")):
            at = end + 1 - size
            if last[end + 1] < 0 and (self.stands(token) if at == 0 else last[at] >= 0 and self.compatible(last[at], token)):
                last[end + 1] = token
        ids, at = [], len(word)
        while at > 0:
            ids.append(last[at])
            at -= len(self.text[last[at]])
        return ids[::-1]

    def stands(self, token: int) -> bool:
        """Whether the token's own text is encoded as the token."""
        if (got := self.whole.get(token)) is None:
            halves = self.halves(token)
            got = self.whole[token] = len(self.text[token]) == 1 or halves is not None and self.rank.get(self.text[halves[0]] + self.text[halves[1]]) == token
        return got


class WordIds(dict):
    """Numbers of words met so far; their ids lie one after the other in ``flat``."""

    def __init__(self, vocabulary: BytePairs):
        super().__init__()
        self.vocabulary, self.flat, self.begin = vocabulary, array("i"), array("q", [0])

    def __missing__(self, word: str) -> int:
        self.flat.extend(self.vocabulary.encode(word.encode("utf-8")) if word != EDGE_WORD else ())
        self.begin.append(len(self.flat))
        self[word] = number = len(self)
        return number


EDGE_WORD = ""


def encode_block(texts: list[str], words: WordIds, with_ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """The number of ids of each text, and all ids in order."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(lengths + 1) - 1
    joined = "\n".join([*texts, ""])
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4").copy()
    codes[ends] = 0x110000
    starts = word_starts(codes)
    bounds = np.append(starts, codes.size)
    edge = np.searchsorted(starts, ends)  # the words that only divide
    ends_of = bounds[1:].copy()
    ends_of[edge] = bounds[:-1][edge]  # an empty word
    a, b = starts.tolist(), ends_of.tolist()
    numbers = np.fromiter(map(words.__getitem__, map(joined.__getitem__, map(slice, a, b))), dtype=np.int64, count=len(a))
    begin = np.frombuffer(words.begin, dtype=np.int64)
    size = begin[numbers + 1] - begin[numbers]
    upto = np.concatenate([[0], np.cumsum(size)])
    counts = np.diff(upto[edge + 1], prepend=0)
    ids = None
    if with_ids:
        flat = np.frombuffer(words.flat, dtype=np.int32) if len(words.flat) else np.empty(0, dtype=np.int32)
        ids = flat[np.repeat(begin[numbers] - upto[:-1], size) + np.arange(upto[-1])]
    return counts, ids


def blocks(texts: list[str | None]) -> Iterator[list[str]]:
    block, used = [], 0
    for t in texts:
        block.append(t or "")
        used += len(block[-1]) + 1
        if used > BLOCK_CHARS:
            yield block
            block, used = [], 0
    if block:
        yield block


@cache
def vocabulary(name: str, folder: str) -> BytePairs:
    """Once in each worker process."""
    return BytePairs(f"{folder}/{name}.tiktoken")


def token_ids(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``doc_id`` and ``ids``, the token ids of the whole ``text``, one row per row of ``documents``.

    Null and empty texts give an empty list. No special tokens: their names within a text are ordinary
    text. A repeated doc_id is encoded each time, a null one is kept; extra columns are ignored. Rows stay
    in their partition; texts of any length are cut into words once and each word's ids are remembered.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(vocabulary(name, folder))
        for batch in batches:
            if len(words) > MEMORY_WORDS:
                words = WordIds(words.vocabulary)
            at = 0
            for block in blocks(batch.column(1).to_pylist()):
                counts, ids = encode_block(block, words)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(block)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=["doc_id", "ids"])
                at += len(block)

    return documents.select("doc_id", "text").mapInArrow(work, "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, names: list[str], folder: str = TOKENIZERS) -> DataFrame:
    """``doc_id`` and ``n_tokens``, the whole text's numbers of tokens by each of the tokenizer files; null and empty texts have 0."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [counter(name, folder) for name in names]
        for batch in batches:
            at = 0
            for block in blocks(batch.column(1).to_pylist()):
                counts = [count(block) for count in counters]
                each = pa.array([list(x) for x in zip(*counts)] if names else [[]] * len(block), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(block)), each], names=["doc_id", "n_tokens"])
                at += len(block)

    return documents.select("doc_id", "text").mapInArrow(work, "doc_id bigint, n_tokens array<int>")


class PieceCounts(dict):
    """Numbers of tokens of the parts that begin with blanks and end before the next; no piece reaches over such a border."""

    def __init__(self, model):
        super().__init__({" ": 1, "▁": 1})
        self.model = model

    def __missing__(self, part: str) -> int:
        self[part] = n = len(self.model.encode(part[1:]))  # the model puts a blank before every text
        return n


def counter(name: str, folder: str):
    """A function from texts to their numbers of tokens."""
    if os.path.exists(f"{folder}/{name}.tiktoken"):
        state = [WordIds(vocabulary(name, folder))]

        def pairs(texts: list[str]) -> list[int]:
            if len(state[0]) > MEMORY_WORDS:
                state[0] = WordIds(state[0].vocabulary)
            return encode_block(texts, state[0], with_ids=False)[0].tolist()

        return pairs
    if os.path.exists(f"{folder}/{name}.model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{name}.model")
        if any(re.search("[^▁]▁", model.id_to_piece(i)) for i in range(len(model))) or model.encode(" a  b", out_type=str) != ["▁", "▁a", "▁", "▁b"]:
            return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        parts, memory = re.compile("[ ▁]+[^ ▁]*"), [PieceCounts(model)]

        def pieces(texts: list[str]) -> list[int]:
            if len(memory[0]) > MEMORY_WORDS:
                memory[0] = PieceCounts(model)
            return [sum(map(memory[0].__getitem__, parts.findall(" " + t))) if t else 0 for t in texts]

        return pieces
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(f"{folder}/{name}.json")
    tokenizer.encode_special_tokens = True
    return lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
