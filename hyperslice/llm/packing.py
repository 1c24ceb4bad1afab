"""Tokenise documents and pack them into sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

#: The id that ends each document.
LAST = np.array([2], "<u4")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet's letters of each character below U+0180 that doesn't stand for itself (fixed by the
    tokenizer's format: printable bytes stand for themselves, the others in order for the letters from U+0100 on)."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    letter = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}
    whole = {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0x180) if c != 32}
    return {c: x for c, x in whole.items() if x != chr(c)}


class WordTokens:
    """Token ids of texts by a tokenizer that drops white space, treats each pre-token apart and ends it with '</w>'.

    Plain texts (below U+0180, where NFC changes nothing) are cut into pre-tokens here; the ids of those seen before lie
    in one array and are gathered from there, and only new ones are encoded. Other texts go to the tokenizer whole.
    `kept` (entries), LONGEST (characters of an entry) and HELD (ids) bound what is remembered, which only saves time.
    """

    LONGEST, HELD = 48, 2_000_000

    def __init__(self, path: str, kept: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.bare.normalizer, self.bare.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.kept, self.letters = kept, _byte_letters()
        self.forget()
        span = lambda kind: "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == kind)
        letter, number, space = span("L"), span("N"), r"\t\n\x0b\x0c\r \x85\xa0"
        self.plain = re.compile("[\x00-\x1b\x20-\u012f\u0131-\u017f]*").fullmatch
        self.pieces = re.compile(f"[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d|[{number}]|[^{space}{letter}{number}]+").findall

    def forget(self) -> None:
        self.place: dict[str, int] = {}  # pre-token: its row in start and size, which point into flat
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids."""
        split = [self.pieces(t.lower()) if self.plain(t) and "<|" not in t else None for t in texts]
        if len(self.place) > self.kept or len(self.flat) > self.HELD:
            self.forget()
        pieces = list(chain.from_iterable(s for s in split if s))
        at = np.fromiter(map(self.place.get, pieces, repeat(-1)), np.int64, len(pieces))
        absent = np.flatnonzero(at < 0).tolist()
        if absent:
            missed = [pieces[i] for i in absent]
            fresh = list(set(missed))
            rows = dict(zip(fresh, range(len(self.start), len(self.start) + len(fresh)), strict=True))
            at[absent] = list(map(rows.__getitem__, missed))
            size, flat = self.encode(fresh)
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])
            if max(map(len, fresh)) > self.LONGEST:
                rows = {w: r for w, r in rows.items() if len(w) <= self.LONGEST}
            self.place.update(rows)
        size = self.size[at]
        ends = np.cumsum(size)
        found = self.flat[np.repeat(self.start[at] - ends + size, size) + np.arange(size.sum())]
        cut = np.concatenate(([0], ends))[np.cumsum([0, *(len(s or ()) for s in split)])].tolist()
        return [self.whole(t) if s is None else found[a:b] for t, s, a, b in zip(texts, split, cut[:-1], cut[1:], strict=True)]

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, all ids)."""
        sizes, flat = [], []
        parts = [pieces[at : at + 100] for at in range(0, len(pieces), 100)]
        joined = [" ".join(p) for p in parts]
        joined = [j if j.isascii() and j.isprintable() else " ".join([w if w.isascii() and w.isprintable() else w.translate(self.letters) for w in p]) for j, p in zip(joined, parts, strict=True)]
        for part, code in zip(parts, self.bare.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(code.ids, "<u4")
            size = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            if len(size) != len(part):  # the pieces did not stay apart; one by one
                alone = [self.whole(w) for w in part]
                ids, size = np.concatenate(alone), np.array([len(x) for x in alone])
            sizes.append(size)
            flat.append(ids)
        return np.concatenate(sizes), np.concatenate(flat)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4")


@lru_cache(maxsize=2)
def _words(path: str) -> WordTokens:
    return WordTokens(path)


def difference(sizes: list[int], parts: int) -> list[list[int]]:
    """Karmarkar-Karp multiway differencing: indexes of sizes in `parts` parts with near-equal sums.

    Each size starts as a partial partition of its own. The two partitions with the widest spread are merged again and
    again, the heaviest part of the one with the lightest of the other, so that opposing imbalances cancel.
    """
    heap: list[tuple[int, int, list[tuple[int, list[int]]]]] = []
    for i, s in enumerate(sizes):
        heap.append((-s, i, [(s, [i])]))  # parts that are not listed are empty
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        room = parts - len(a)
        if room >= len(b):
            merged = a + b
        else:  # the lightest of a (the listed ones; the empty ones took b's lightest) with the heaviest of b
            b_heavy, b_rest = b[: len(b) - room], b[len(b) - room :]
            merged = a[: len(a) - len(b_heavy)] + b_rest
            merged += [(x + y, i + j) for (x, i), (y, j) in zip(a[len(a) - len(b_heavy) :], reversed(b_heavy), strict=True)]
        merged.sort(key=lambda p: -p[0])
        low = merged[-1][0] if len(merged) == parts else 0
        heapq.heappush(heap, (low - merged[0][0], count, merged))
        count += 1
    got = [members for _, members in heap[0][2]] if heap else []
    return got + [[] for _ in range(parts - len(got))]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """The fewest windows, from ceil(sum / capacity) up, whose differencing keeps every sum within capacity."""
    total = sum(sizes)
    parts = max(1, -(-total // capacity))
    while True:
        got = difference(sizes, parts)
        if max((sum(sizes[i] for i in w) for w in got), default=0) <= capacity:
            return [w for w in got if w]
        parts += max(1, parts // 100)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, fill: int = 48, batch_pieces: int = 2000, ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and (if asked) ids.

    A document's ids end with 2. Documents of more than `capacity` ids are cut into full sequences and a rest; each
    rest of at least 4 * `fill` ids also gives up its last `fill` ids as a small piece, with which differencing levels the windows. Each task packs
    its own rows, `batch_pieces` pieces at a time; lengths depend on nothing else, so nothing is shuffled and a lost task is
    redone alike. Null and empty texts give one piece of one id; repeated rows are packed one by one; null ids stay
    null; other columns of docs are not read; an empty table gives an empty table.
    """
    path = tokenizer or default_tokenizer()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task = _words(path), TaskContext.get().partitionId()
        next_id, held = task << 36, []  # held: doc_id, start, doc_tokens, ids

        def flush() -> pa.RecordBatch:
            nonlocal next_id, held
            rows, found = [], []
            whole = [i for i, h in enumerate(held) if len(h[3]) == capacity]
            part = [i for i, h in enumerate(held) if len(h[3]) < capacity]
            for members in [[i] for i in whole] + [[part[j] for j in w] for w in windows([len(held[i][3]) for i in part], capacity)]:
                offset = 0
                for i in sorted(members):
                    doc, start, n, piece = held[i]
                    rows.append((doc, start, len(piece), zlib.crc32(piece), n, next_id, offset))
                    found.append(piece)
                    offset += len(piece)
                next_id += 1
            held = []
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            if not ids:
                return pa.RecordBatch.from_arrays(cols, names=names)
            lens = np.concatenate(([0], np.cumsum([len(x) for x in found])))
            lists = pa.ListArray.from_arrays(pa.array(lens, pa.int32()), pa.array(np.concatenate(found).view("<i4"), pa.int32()))
            return pa.RecordBatch.from_arrays([*cols, lists], names=[*names, "ids"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                docs_, texts = batch.column(0)[at : at + 256].to_pylist(), [t or "" for t in batch.column(1)[at : at + 256].to_pylist()]
                for doc, got in zip(docs_, words.ids(texts), strict=True):
                    got = np.concatenate([got, LAST])
                    n = len(got)
                    cuts = list(range(0, n, capacity))
                    if 4 * fill <= n - cuts[-1] < capacity:
                        cuts.append(n - fill)
                    held += [(doc, a, n, got[a:b]) for a, b in zip(cuts, [*cuts[1:], n], strict=True)]
                if len(held) >= batch_pieces:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names) + ", ids array<int>" * ids)
