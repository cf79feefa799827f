"""Packing into fixed windows by the sum-of-squares rule.

Each Spark task packs the documents of its own partition in order, with no
shuffle: a level array counts the partly filled windows of every fill, and a
document goes to the level that leaves the smallest sum of squared counts.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ventanilla.llm.common import id_and_text, schema

#: Fixed values of the registered query.
WINDOW, END_ID = 2048, 1
#: A leftover window missing at most this many tokens is padded; fuller ones are re-laid.
SLACK = 8
#: Entries of a generation of a task's word cache (a speed setting; ids do not depend on it).
CACHE = 400_000
#: Bytes of text whose words are looked up together (a longer text alone).
SLICE = 16 << 20

# Words of these characters are lower-cased and split here as the tokenizer's own
# normaliser and pattern do; every other word goes through the tokenizer whole.
_PLAIN = "^[!-~À-ÖØ-öø-ÿ]+$"
_PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\x20]+|\x20")
#: Longer words and parts are not kept in the cache, so its entries bound its bytes.
LONGEST_KEPT = 100


class Aged:
    """A bounded cache of two generations: what the older one still answers moves to the younger."""

    def __init__(self, make: Callable[[str], bytes], most: int) -> None:
        self.make, self.most = make, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, key: str) -> bytes:
        got = self.young.get(key)
        if got is None:
            got = self.old.get(key)
            if got is None:
                got = self.make(key)
            if len(key) > LONGEST_KEPT:
                return got
            if len(self.young) >= self.most:
                self.young, self.old = {}, self.young
            self.young[key] = got
        return got


class WordIds:
    """Ids of texts by way of their distinct words.

    The vocabulary drops white space and never merges across it, so a text's
    ids are those of its words one after the other. The words of a slice of
    texts are dictionary-encoded, and so are the parts of the distinct words;
    each distinct part is looked up once, and ids are gathered by position.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        # printable stand-ins of bytes, as in every byte-level vocabulary
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        byte = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.shown = {c: "".join(byte[b] for b in chr(c).encode()) for c in range(256)}
        self.odd, self.part = Aged(self._odd, CACHE), Aged(self._part, CACHE)

    def _odd(self, word: str) -> bytes:
        return _bytes(self.whole.encode(word, add_special_tokens=False).ids) if word else b""

    def _part(self, part: str) -> bytes:
        # letters of ASCII stand for themselves
        shown = part if part.isascii() and part.isalpha() else part.translate(self.shown)
        return _bytes([t.id for t in self.model.tokenize(shown)])

    def encode_batches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(key, ids) of every row of (key, text) batches, which are gathered to ``SLICE`` bytes first."""
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= SLICE:
                yield from self._rows(held)
                held, size = [], 0
        if held:
            yield from self._rows(held)

    def _rows(self, batches: list[pa.RecordBatch]) -> Iterator[tuple]:
        table = pa.Table.from_batches(batches).combine_chunks()
        keys, texts = table.column(0).to_pylist(), table.column(1).cast(pa.large_string()).combine_chunks()
        return zip(keys, self.encode(texts), strict=True)

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, in order; a null text has none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        a = 0
        while a < len(texts):
            done = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, done + SLICE, "right")))
            yield from self._slice(texts.slice(a, b - a))
            a = b

    def _slice(self, texts: pa.Array) -> list[np.ndarray]:
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        code = words.indices.to_numpy()
        table, start, size = self._word_ids(words.dictionary)
        ends = np.concatenate([[0], np.cumsum(size[code])])
        rows = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        return np.split(_gathered(table, start[code], size[code]), ends[rows[1:-1]])

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words: a table of ids, and where each word's begin and how many they are."""
        plain = pc.match_substring_regex(words, _PLAIN)
        for token in self.special:
            plain = pc.and_not(plain, pc.match_substring(words, token))
        mask = plain.to_numpy(zero_copy_only=False)
        simple = words.filter(plain)
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(simple)], simple), pa.scalar(" ", simple.type))[0].as_py()
        parts = pa.array(_PART.findall(joined.lower()), pa.large_string())
        word_of = np.cumsum(pc.equal(parts, " ").to_numpy(zero_copy_only=False))
        parts = parts.dictionary_encode()
        code = parts.indices.to_numpy()
        table, start, size = _laid([b"" if p == " " else self.part(p) for p in parts.dictionary.to_pylist()])
        odd, _, odd_size = _laid([self.odd(w) for w in words.filter(pc.invert(plain)).to_pylist()])
        out = np.empty(len(words), np.int64)
        out[mask] = np.bincount(word_of, size[code], len(simple)).astype(np.int64)
        out[~mask] = odd_size
        order = np.argsort(~mask, kind="stable")  # plain words first, as their ids lie in the table
        begin = np.empty(len(words), np.int64)
        begin[order] = np.cumsum(out[order]) - out[order]
        return np.concatenate([_gathered(table, start[code], size[code]), odd]), begin, out


def _laid(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids laid end to end, with the start and the number of each entry's."""
    size = np.fromiter(map(len, found), np.int64, len(found)) // 4
    return np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size, size


def _gathered(table: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of a table one after the other."""
    return table[np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)]


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class SquaresPacker:
    """Windows of ``size`` tokens; pieces are ``(key, start, ids)`` with ids as uint32 bytes."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.count = np.zeros(size + 1, np.int64)  # open windows by fill
        self.open: list[list[list]] = [[] for _ in range(size + 1)]
        self.made = 0

    def place(self, piece: tuple, n: int) -> list[tuple[int, list]]:
        """Put a piece of ``n < size`` tokens; returns the windows that this filled."""
        top = self.size - n
        c = self.count
        here, there = c[:top + 1], c[n:]
        # the change of the sum of squares: one window fewer at a level, one more n levels up
        cost = 2 * there - 2 * here + 2
        cost[0] = 2 * there[0] + 1
        cost[top] = 1 - 2 * here[top]
        usable = here > 0
        usable[0] = True
        levels = np.flatnonzero(usable)
        picked = cost[levels]
        level = int(levels[len(levels) - 1 - int(picked[::-1].argmin())])  # ties: the fullest window
        if level:
            window = self.open[level].pop()
            c[level] -= 1
        else:
            window = [[self.made, 0]]
            self.made += 1
        window.append(piece)
        window[0][1] += n
        if level + n == self.size:
            return [(window[0][0], window[1:])]
        self.open[level + n].append(window)
        c[level + n] += 1
        return []

    def close(self) -> Iterator[tuple[int, list]]:
        """The windows left open: nearly full ones as they are, the others laid end to end and cut.

        The cut stream gives full windows and one rest, which is cut into
        powers of two, so it needs no padding.
        """
        stream: list[tuple] = []
        for fill in range(self.size - 1, 0, -1):
            for (number, _), *pieces in self.open[fill]:
                if fill >= self.size - SLACK or fill & (fill - 1) == 0:
                    yield number, pieces
                else:
                    stream += pieces
        left = sum(len(ids) for _, _, ids in stream) // 4
        room, now = 0, []
        for key, start, ids in stream:
            while ids:
                if not room:
                    room = self.size if left >= self.size else 1 << (left.bit_length() - 1)
                n = min(room, len(ids) // 4)
                now.append((key, start, ids[:4 * n]))
                start, ids, room, left = start + n, ids[4 * n:], room - n, left - n
                if not room:
                    yield self.made, now
                    self.made, now = self.made + 1, []


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID,
                   with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: where it lies in its document and in which sequence.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and,
    with ``with_ids``, ``ids`` (little-endian uint32 bytes). A document is its
    ids and then ``end_id``; a null or empty text is ``end_id`` alone. Its
    full windows stand alone; the rest is placed whole by the sum-of-squares
    rule; only what is left over when a task's input ends is cut again. A
    null id is kept; repeated rows are packed each on its own; an empty table
    gives no rows; other columns are not read. ``sequence_id`` is made of the
    input partition's number and a counter, so a rerun task gives the same
    ids for the same rows in the same order.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    end = _bytes([end_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = WordIds(tokenizer_path), SquaresPacker(window)
        base = TaskContext.get().partitionId() << 33
        rows: list[list] = [[] for _ in range(8)]

        def emit(number: int, pieces: list) -> None:
            at = 0
            for (doc, total), start, ids in pieces:
                n = len(ids) // 4
                for col, v in zip(rows, (doc, start, n, zlib.crc32(ids), total, base + number, at, ids), strict=True):
                    col.append(v)
                at += n

        def flush() -> pa.RecordBatch:
            cols = [pa.array(c, pa.int64()) for c in rows[:7]] + [pa.array(rows[7], pa.binary())] * with_ids
            for c in rows:
                c.clear()
            return pa.RecordBatch.from_arrays(cols, names=names + ["ids"] * with_ids)

        for doc, text_ids in words.encode_batches(batches):
            ids = text_ids.tobytes() + end
            total = len(ids) // 4
            key = (doc, total)
            whole = total - total % window
            for start in range(0, whole, window):
                emit(packer.made, [(key, start, ids[4 * start:4 * (start + window)])])
                packer.made += 1
            if total > whole:
                for number, pieces in packer.place((key, whole, ids[4 * whole:]), total - whole):
                    emit(number, pieces)
            if len(rows[0]) >= 4096:
                yield flush()
        for number, pieces in packer.close():
            emit(number, pieces)
        if rows[0]:
            yield flush()

    ddl = ", ".join(f"{n} bigint" for n in names) + (", ids binary" if with_ids else "")
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema(ddl.replace("offset", "`offset`")))
