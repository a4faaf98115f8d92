"""Byte-level BPE over whole Arrow batches: rank-synchronous merging of ragged numpy arrays.

Texts are cut into pre-tokens with array operations on code points. The
distinct pre-tokens of a batch are held as one ragged array of symbols; in
each round every sequence applies its lowest-ranked pair at once, wherever it
stands, until no sequence has a pair left. Symbols that survive are the
tokens.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_U = np.uint64
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_NONE = np.iinfo(np.int32).max
#: Characters that are worked on at once, and pre-tokens that a worker remembers.
_CHUNK, _KNOWN = 1 << 20, 1 << 20
_SALT = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15
_CUT = re.compile(r"(?<=\S)\s")


@functools.cache
def _classes() -> np.ndarray:
    """The class of each code point. White space is Unicode's White_Space property."""
    table = np.full(0x110000, _OTHER, dtype=np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            table[c] = _LETTER if kind == "L" else _NUMBER
    for a, b in ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        table[a : b + 1] = _SPACE
    return table


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: visible Latin-1 characters are themselves, the rest follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """A byte-level BPE vocabulary file's merges, and the pre-tokens met so far."""

    #: Bits of a pre-token's hash. Fewer only cost time.
    hash_bits = 64

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, letters = file["model"], _byte_letters()
        if model["type"] != "BPE" or (file["pre_tokenizer"] or {}).get("type") != "ByteLevel":
            raise ValueError(f"{path} isn't a byte-level BPE vocabulary")
        ids = model["vocab"]
        self.of_byte = np.zeros(256, dtype=np.int32)
        for letter, byte in letters.items():
            self.of_byte[byte] = ids[letter]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"] if t["special"]}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], dtype=np.int64)
        made = np.array([ids[a + b] for a, b in pairs], dtype=np.int32)
        # open addressing: the first free slot at or after a multiplicative hash
        self._shift, size = 64 - 18, 1 << 18
        self._keys = np.full(size + 64, -1, dtype=np.int64)
        self._rank = np.full(size + 64, _NONE, dtype=np.int32)
        self._made = np.zeros(size + 64, dtype=np.int32)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist())):
            while self._keys[slot] >= 0 and self._keys[slot] != key:
                slot += 1
            if self._keys[slot] < 0:
                self._keys[slot], self._rank[slot], self._made[slot] = key, rank, made[rank]
        self._forget()

    def _forget(self) -> None:
        self._hashes = np.zeros(0, dtype=np.uint64)
        self._bytes = np.zeros(0, dtype=np.uint8)
        self._from = np.zeros(0, dtype=np.int64)
        self._size = np.zeros(0, dtype=np.int64)
        self._begin = np.zeros(0, dtype=np.int64)
        self._count = np.zeros(0, dtype=np.int32)
        self._pool = np.zeros(0, dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _U(0xD6E8FEB86659FD93)) >> _U(self._shift)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merge rank of each pair, and the symbol it makes."""
        keys = left.astype(np.int64) << 32 | right
        slots = self._slot(keys)
        ranks, made = np.full(len(keys), _NONE, dtype=np.int32), np.zeros(len(keys), dtype=np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            there = self._keys[slots[todo]]
            hit = there == keys[todo]
            ranks[todo[hit]], made[todo[hit]] = self._rank[slots[todo[hit]]], self._made[slots[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
            slots[todo] += 1
        return ranks, made

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of consecutive sequences -> (surviving symbols, their number in each sequence)."""
        done_at: list[np.ndarray] = []
        done: list[np.ndarray] = []
        counts = sizes.copy()
        owner = np.repeat(np.arange(len(sizes)), sizes)
        ranks, made = self._ranks(symbols[:-1], symbols[1:]) if len(symbols) else (np.zeros(0, np.int32), np.zeros(0, np.int32))
        ranks, made = np.append(ranks, _NONE), np.append(made, 0)  # of a symbol and the next
        if len(symbols):
            ranks[:-1][owner[1:] != owner[:-1]] = _NONE
        while len(symbols):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            least = np.minimum.reduceat(ranks, first)
            span = np.diff(np.append(first, len(symbols)))
            over = np.repeat(least == _NONE, span)
            if over.any():
                done.append(symbols[over])
                done_at.append(owner[over])
                symbols, owner, ranks, made = symbols[~over], owner[~over], ranks[~over], made[~over]
                keep = least != _NONE
                least, span = least[keep], span[keep]
                if not len(symbols):
                    break
            take = ranks == np.repeat(least, span)
            if (twice := take[1:] & take[:-1]).any():  # in a run of overlapping pairs every second one, from the left
                at = np.flatnonzero(take)
                fresh = np.concatenate(([True], np.diff(at) > 1))
                run = at - at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
                take[at[run % 2 == 1]] = False
            symbols = symbols.copy()
            symbols[take] = made[take]
            gone = np.zeros(len(symbols), dtype=bool)
            gone[1:] = take[:-1]
            changed = take.copy()
            follows = np.flatnonzero(take) - 1
            changed[follows[follows >= 0]] = True
            symbols, owner, ranks, made, changed = symbols[~gone], owner[~gone], ranks[~gone], made[~gone], changed[~gone]
            # a pair's left neighbour may itself have been removed: then the symbol before it changed
            changed[:-1] |= changed[1:]
            at = np.flatnonzero(changed)
            inner = at[at < len(symbols) - 1]
            same = owner[inner] == owner[inner + 1]
            ranks[at] = _NONE
            ranks[inner[same]], made[inner[same]] = self._ranks(symbols[inner[same]], symbols[inner[same] + 1])
        if done:
            at = np.concatenate(done_at)
            order = np.argsort(at, kind="stable")
            symbols = np.concatenate(done)[order]
            counts = np.bincount(at, minlength=len(sizes)).astype(sizes.dtype)
        return symbols, counts

    def _pieces(self, text: str, special: bool) -> Iterator[tuple[str, int | None]]:
        """Parts of a text that are tokenized alone, and ids of special tokens between them."""
        parts = [text]
        if special and self.special and any(s in text for s in self.special):
            parts = re.split("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")", text)
        for i, part in enumerate(parts):
            if i % 2:
                yield "", self.special[part]
                continue
            at = 0
            while at < len(part):  # a cut before white space that follows something else changes no pre-token
                cut = _CUT.search(part, at + _CHUNK) if len(part) - at > _CHUNK else None
                end = cut.start() if cut else len(part)
                yield part[at:end], None
                at = end

    def encode(self, texts: list[str | None], special: bool = True, ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(all tokens' ids in order, tokens of each text). ``special``: special tokens' strings in a text become those tokens. Without ``ids`` only the counts are made."""
        counts = np.zeros(len(texts), dtype=np.int64)
        out: list[np.ndarray] = []
        held: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            nonlocal held, size
            if held:
                flat, n = self._encode([t for _, t in held], ids)
                np.add.at(counts, [i for i, _ in held], n)
                out.append(flat)
            held, size = [], 0

        for i, text in enumerate(texts):
            for part, token in self._pieces(text or "", special):
                if token is not None:
                    flush()
                    counts[i] += 1
                    out.append(np.array([token], dtype=np.int32))
                elif part:
                    held.append((i, part))
                    size += len(part)
                    if size >= _CHUNK:
                        flush()
        flush()
        return np.concatenate(out) if out and ids else np.zeros(0, np.int32), counts

    def _encode(self, texts: list[str], ids: bool) -> tuple[np.ndarray, np.ndarray]:
        starts, of_text, raw, at_byte = pretokens(texts)
        ends = np.append(starts[1:], len(at_byte) - 1)
        a, b = at_byte[starts], at_byte[ends]
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_SALT[raw] * _powers(_BASE, len(raw)), out=sums[1:])
        hashes = (sums[b] - sums[a]) * _powers(pow(_BASE, -1, 1 << 64), len(raw))[a] + (b - a).astype(np.uint64) * _U(0xD6E8FEB86659FD93)
        hashes >>= _U(64 - self.hash_bits)
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = self._look_up(distinct, a[where], b[where], raw)[back]
        n, begin = self._count[at].astype(np.int64), self._begin[at]
        # hashes only propose: a pre-token whose bytes aren't those of the known one is merged by itself
        odd = np.flatnonzero(_differ(raw, a, b, self._bytes, self._from[at], self._size[at]))
        if len(odd):
            symbols, n[odd] = self._merged(a[odd], b[odd], raw)
            begin[odd] = len(self._pool) + np.cumsum(n[odd]) - n[odd]
            self._pool = np.concatenate((self._pool, symbols))
        counts = np.bincount(of_text, weights=n, minlength=len(texts)).astype(np.int64)
        if not ids:
            return np.zeros(0, np.int32), counts
        stops = np.cumsum(n)
        return self._pool[np.arange(stops[-1] if len(stops) else 0) + np.repeat(begin - (stops - n), n)], counts

    def _merged(self, a: np.ndarray, b: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the pre-tokens from bytes ``a`` to ``b``."""
        return self.merge(self.of_byte[raw[_ranges(a, b - a)]], b - a)

    def _look_up(self, hashes: np.ndarray, a: np.ndarray, b: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """Where each pre-token stands among the known ones; new ones are merged first."""
        if len(self._hashes) > _KNOWN:
            self._forget()
        at = np.searchsorted(self._hashes, hashes)
        new = at == len(self._hashes)
        new[~new] = self._hashes[at[~new]] != hashes[~new]
        if new.any():
            symbols, counts = self._merged(a[new], b[new], raw)
            begin = len(self._pool) + np.cumsum(counts) - counts
            self._pool = np.concatenate((self._pool, symbols))
            sizes, place = (b - a)[new], at[new]
            held = len(self._bytes) + np.cumsum(sizes) - sizes
            self._bytes = np.concatenate((self._bytes, raw[_ranges(a[new], sizes)]))
            self._hashes = np.insert(self._hashes, place, hashes[new])
            self._begin, self._count = np.insert(self._begin, place, begin), np.insert(self._count, place, counts)
            self._from, self._size = np.insert(self._from, place, held), np.insert(self._size, place, sizes)
            at = np.searchsorted(self._hashes, hashes)
        return at


def _ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each begin on, as many as its size."""
    stops = np.cumsum(sizes)
    return np.arange(stops[-1] if len(stops) else 0) + np.repeat(begin - (stops - sizes), sizes)


def _differ(raw: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether each stretch of ``raw`` (they follow each other without gaps) has other bytes than its known one."""
    other = (b - a) != sizes
    place = np.repeat(np.where(other, 0, begin) - a, b - a) + np.arange(len(raw))
    unlike = raw != (known.take(place, mode="clip") if len(known) else 0)
    return other | (np.logical_or.reduceat(unlike, a) if len(a) else False)


def _powers(base: int, n: int) -> np.ndarray:
    size = 1 << max(0, n - 1).bit_length()
    return _all_powers(base, size)[:n]


@functools.lru_cache(maxsize=6)
def _all_powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def pretokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first code point of each pre-token, text it is in, UTF-8 bytes of all texts, first byte of each code point and the end).

    A pre-token is an apostrophe with s, t, re, ve, m, ll or d; letters,
    digits or other signs, each with one space before them if there is one;
    or white space, of which the last character before something else is left
    to what follows.
    """
    joined = "".join(texts)
    raw = np.frombuffer(joined.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    at_byte = np.concatenate(([0], np.cumsum(lengths)))
    edges = np.cumsum([0, *map(len, texts)])
    kind = _classes()[points]
    n = len(points)
    begins = np.zeros(n + 1, dtype=bool)
    begins[edges] = True
    begins, closes = begins[:n], begins[1:]  # first and last code point of a text
    space = kind == _SPACE
    start = begins.copy()
    start[1:] |= kind[1:] != kind[:-1]
    ahead = np.zeros(n, dtype=bool)  # last white space before something else in the same text
    ahead[:-1] = space[:-1] & ~space[1:]
    ahead &= ~closes
    start |= ahead
    start[1:] &= ~(ahead[:-1] & (points[:-1] == 0x20))
    for i in np.flatnonzero(start & (points == 0x27) & ~closes).tolist():
        tail = joined[i + 1 : i + 3]
        long = 2 if tail in ("re", "ve", "ll") and not closes[i + 1] else 1 if tail[0] in "stmd" else 0
        if long:
            start[i + 1 : i + 1 + long] = False
            if i + 1 + long < n:
                start[i + 1 + long] = True
    starts = np.flatnonzero(start)
    return starts, np.searchsorted(edges, starts, side="right") - 1, raw, at_byte


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Merges:
    """A worker's copy of the vocabulary file at ``path``."""
    return Merges(path)


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 512, special: bool = True) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) for each row of ``docs``.

    A null text counts as an empty one: no bytes, no tokens. Repeated rows
    each return a row, and null ids stay null; an empty table returns none.
    Very long texts are cut between pre-tokens and read in pieces. ``path`` is a vocabulary file
    that every executor has.
    """
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id_"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                _, counts = merges.encode(part.column(1).to_pylist(), special, ids=False)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts)], names=["doc_id_", "n"])

    # the length in bytes is the engine's own; only texts go to the workers
    counted = source.withColumn("n_bytes_", F.octet_length("text_").cast("long")).select(F.struct("doc_id_", "n_bytes_").alias("id_"), "text_")
    kept = counted.schema["id_"].dataType.simpleString()
    out = counted.mapInArrow(run, f"doc_id_ {kept}, n long")
    return out.select(F.col("doc_id_.doc_id_").alias(doc_id), F.col("doc_id_.n_bytes_").alias("n_bytes"), F.col("n").alias("n_tokens"), (F.col("n") > limit).alias("over_limit"))
