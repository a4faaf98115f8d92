"""Many words looked for in one pass: an Aho-Corasick automaton that advances over all texts of an Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Texts are cut into pieces of so many bytes that advance side by side; steps between looks at what was found.
PIECE, LOOK = 1024, 64
#: The largest automaton that is broadcast. More words make several, and a pass over the texts for each.
MOST_BYTES = 256 << 20
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: The two characters beyond ASCII whose simple fold is an ASCII letter.
_FOLDS = ((b"\xc5\xbf", b"s"), (b"\xe2\x84\xaa", b"k"))


def folded(text: bytes) -> bytes:
    """ASCII letters small; the long s and the Kelvin sign as s and k."""
    text = text.translate(_LOWER)
    for sign, letter in _FOLDS:
        text = text.replace(sign, letter)
    return text


class Automaton:
    """Goto, fail and output links of a set of words, with a dense table of transitions over the bytes that occur in them."""

    def __init__(self, words: Iterable[bytes]):
        self.words = sorted({w for w in words if w})
        self.longest = max(map(len, self.words), default=0)
        letters = sorted({b for w in self.words for b in w})
        self.classes = np.zeros(256, dtype=np.int32)
        self.classes[letters] = np.arange(1, len(letters) + 1)
        width = self.width = len(letters) + 1
        goto: list[dict[int, int]] = [{}]
        own: list[int] = [-1]
        for number, word in enumerate(self.words):
            state = 0
            for c in self.classes[list(word)].tolist():
                if c not in goto[state]:
                    goto[state][c] = len(goto)
                    goto.append({})
                    own.append(-1)
                state = goto[state][c]
            own[state] = number
        self._link(goto, np.array(own), width)

    def _link(self, goto: list[dict[int, int]], own: np.ndarray, width: int) -> None:
        """Breadth first: a state falls back to the longest proper suffix that is a state too. What a state has no edge for, it does as that one; ``links`` lead to the next shorter word that ends with a state."""
        fail, links = np.zeros(len(goto), dtype=np.int64), np.zeros(len(goto), dtype=np.int64)
        table = np.zeros((len(goto), width), dtype=np.int32)
        level = [0]
        while level:
            below = []
            for state in level:
                if state:
                    table[state] = table[fail[state]]
                    links[state] = fail[state] if own[fail[state]] >= 0 else links[fail[state]]
                edges = goto[state]
                for c, child in edges.items():
                    fail[child] = table[fail[state], c] if state else 0
                    below.append(child)
                if edges:
                    table[state, list(edges)] = list(edges.values())
            level = below
        self.own, self.links = own, links
        self.table = (table * width).ravel()  # states are numbered by where their row begins
        self.ends = np.repeat((own >= 0) | (links > 0), width)

    def nbytes(self) -> int:
        return self.table.nbytes + self.ends.nbytes

    def _steps(self, texts: Sequence[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, last byte's offset, state) where words end."""
        if not self.words or not texts:
            return
        before = self.longest - 1
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        counts = np.maximum(1, -(-sizes // PIECE))
        text = np.repeat(np.arange(len(texts)), counts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
        first = nth * PIECE  # what ends before it belongs to the piece before
        start = np.maximum(first - before, 0)
        length = np.minimum(first + PIECE, sizes[text]) - start
        order = np.argsort(-length, kind="stable")
        text, first, start, length = text[order], first[order], start[order], length[order]
        raw = np.frombuffer(b"".join(texts) + bytes(LOOK), dtype=np.uint8)
        at = (np.cumsum(sizes) - sizes)[text] + start
        state = np.zeros(len(text), dtype=np.int32)
        shorter = -length  # ascending, so that what is still under way is found by bisection
        for step in range(0, int(length[0]) if len(length) else 0, LOOK):
            n = int(np.searchsorted(shorter, -step, side="left"))
            steps = min(LOOK, int(length[0]) - step)
            letters = self.classes[raw[np.minimum(at[:n] + step + np.arange(steps)[:, None], len(raw) - 1)]]
            states = np.empty((steps, n), dtype=np.int32)
            now = state[:n]
            for j in range(steps):
                now = self.table[now + letters[j]]
                states[j] = now
            state[:n] = now
            j, lane = np.nonzero(self.ends[states])
            offset = start[lane] + step + j
            good = (step + j < length[lane]) & (offset >= first[lane])
            if good.any():
                yield text[lane[good]], offset[good], states[j[good], lane[good]] // self.width

    def occurrences(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, end offset, word) of each occurrence, overlapping ones too."""
        found = [[], [], []]
        for text, last, state in self._steps(texts):
            while len(state):
                here = self.own[state] >= 0
                for column, values in zip(found, (text[here], last[here] + 1, self.own[state[here]])):
                    column.append(values)
                state = self.links[state]
                more = state > 0
                text, last, state = text[more], last[more], state[more]
        return tuple(np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in found)

    def found(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text, word), each once and in order."""
        keys = np.zeros(0, dtype=np.int64)
        states = len(self.own)
        for text, _, state in self._steps(texts):
            keys = np.union1d(keys, text * states + state)
        text, state = keys // states, keys % states
        pairs = []
        while len(state):
            here = self.own[state] >= 0
            pairs.append(text[here] * len(self.words) + self.own[state[here]])
            state = self.links[state]
            more = state > 0
            text, state = text[more], state[more]
        both = np.unique(np.concatenate(pairs)) if pairs else keys
        return both // max(1, len(self.words)), both % max(1, len(self.words))


def automata(words: Iterable[str], fold: bool = True) -> list[Automaton]:
    """Automata for all ``words``, none of which is over MOST_BYTES."""
    raw = sorted({folded(w.encode()) if fold else w.encode() for w in words} - {b""})
    letters = len({b for w in raw for b in w}) + 1
    groups, size = [[]], 0
    for w in raw:
        cost = len(w) * letters * 5  # a state for each byte at most
        if groups[-1] and size + cost > MOST_BYTES:
            groups.append([])
            size = 0
        groups[-1].append(w)
        size += cost
    return [Automaton(g) for g in groups if g]


def _bytes(column: pa.Array, fold: bool) -> list[bytes]:
    raw = [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]
    return [folded(t) for t in raw] if fold else raw


#: Bytes and texts that a worker looks at together; what it holds doesn't grow with an Arrow batch.
SLICE, SLICE_ROWS = 4 << 20, 1_000


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of batches with some megabytes in the first column, or a single row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_pylist()
        at, held = 0, 0
        for i, n in enumerate(sizes):
            if i > at and (held + n > SLICE or i - at >= SLICE_ROWS):
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        yield batch.slice(at)


def with_words(rows: DataFrame, text: str, words: Iterable[str], numbers: dict[str, list[int]], always: Sequence[int] = (), into: str = "numbers_") -> DataFrame:
    """``rows`` with ``into`` array<int>: ``always`` and the ``numbers`` of each word that is in ``text``, each once and in order. Case doesn't count; a null text holds no word.

    One pass over the texts however many words there are. The automata are
    broadcast; their size is known before, and bounded.
    """
    spark = rows.sparkSession
    by_bytes: dict[bytes, set[int]] = {}
    for w in words:
        by_bytes.setdefault(folded(w.encode()), set()).update(numbers[w])
    built = automata(words)
    held = [(spark.sparkContext.broadcast(a), [np.array(sorted(by_bytes[w])) for w in a.words]) for a in built]
    source = rows.select(F.col(f"`{text}`").alias("text__"), *(F.col(f"`{c}`").alias(f"c{i}__") for i, c in enumerate(rows.columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            texts = _bytes(batch.column(0), True)
            found: list[set[int]] = [set(always) for _ in texts]
            for automaton, of in held:
                for t, w in zip(*(x.tolist() for x in automaton.value.found(texts))):
                    found[t].update(of[w].tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([sorted(f) for f in found], pa.list_(pa.int32()))], names=[*batch.schema.names[1:], into])

    made = source.mapInArrow(run, ", ".join([*(f"{n} {t}" for n, t in source.dtypes[1:]), f"{into} array<int>"]))
    return made.select(*(F.col(f"c{i}__").alias(c) for i, c in enumerate(rows.columns)), into)


def occurrences(rows: DataFrame, text: str, words: Iterable[str], keep: Sequence[str] = ()) -> DataFrame:
    """(``keep``, start, word): every occurrence of every word in ``text``, overlapping ones too, with its offset in bytes of UTF-8. Bytes are compared as they are; a null text has none."""
    spark = rows.sparkSession
    held = [spark.sparkContext.broadcast(a) for a in automata(words, fold=False)]
    source = rows.select(F.col(f"`{text}`").alias("text__"), *(F.col(f"`{c}`").alias(f"c{i}__") for i, c in enumerate(keep)))
    names = [*source.columns[1:], "start", "word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            texts = _bytes(batch.column(0), False)
            kept = batch.select(batch.schema.names[1:])
            for one in held:
                t, end, w = one.value.occurrences(texts)
                spelt = pa.array([x.decode() for x in one.value.words], pa.string())
                sizes = np.array([len(x) for x in one.value.words])
                yield pa.RecordBatch.from_arrays([*kept.take(pa.array(t)).columns, pa.array(end - sizes[w], pa.int64()), spelt.take(pa.array(w))], names=names)

    made = source.mapInArrow(run, ", ".join([*(f"{n} {t}" for n, t in source.dtypes[1:]), "start long, word string"]))
    return made.select(*(F.col(f"c{i}__").alias(c) for i, c in enumerate(keep)), "start", "word")


def holds_any(text: Column, words: Iterable[str]) -> Column:
    """Any of the words is in the text, in whatever case: for more words than a row of ``contains`` should have."""
    built = automata(words)

    @arrow_udf("boolean")
    def found(texts: pa.Array) -> pa.Array:
        raw = _bytes(texts, True)
        hit = np.zeros(len(raw), dtype=bool)
        for automaton in built:
            hit[automaton.found(raw)[0]] = True
        return pa.array(hit, pa.bool_(), mask=np.array(texts.is_null().to_pylist(), dtype=bool))

    return found(text)
