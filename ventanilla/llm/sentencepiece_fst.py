"""SentencePiece BPE encoding and decoding as a weighted finite-state transducer.

The transducer is the composition of a normaliser (dummy prefix, spaces as
U+2581), the piece lexicon and a byte fallback for characters outside it. Its
states are a position and the last piece; an arc to the next piece has weight
0 if byte-pair merging would leave the two side by side, else infinity. By
the locality of byte-pair merging the shortest path in the tropical semiring
is the model's own segmentation.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ventanilla.llm.common import id_and_text, schema

SPACE = "▁"
#: Words a task remembers (a speed setting).
CACHE = 500_000
#: Longer runs of spaces are merged anew each time and not kept.
LONGEST_RUN = 1000


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        x = shift = 0
        while True:
            c = b[i]
            i += 1
            x |= (c & 127) << shift
            shift += 7
            if c < 128:
                return x

    while i < len(b):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, b[i:i + n]
            i += n


class PieceTransducer:
    """The compiled transducer of one model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            parts = dict(_fields(f.read()))  # of repeated fields the last; the specs come once
        trainer, normal = dict(_fields(parts[2])), dict(_fields(parts[3]))
        if trainer.get(3) != 2 or normal.get(2) or normal.get(4, 1):
            raise ValueError("a byte-pair model with the identity normaliser that keeps spaces is needed")
        self.prefix = bool(normal.get(3, 1))
        n = model.vocab_size()
        self.surface: list[bytes] = []
        self.id: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte = [model.unk_id()] * 256
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte[value] = i
                self.surface.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.surface.append(b"")
            else:
                self.surface.append(piece.replace(SPACE, " ").encode())
                self.id[piece], self.score[piece] = i, model.get_score(i)
        # no piece spans a word's end, so words are independent
        if any(SPACE in p.lstrip(SPACE) for p in self.id) or any(p.startswith(SPACE * 2) and p.strip(SPACE) for p in self.id):
            raise ValueError("a piece spans a word's end")
        # by string: 0 for a mere beginning of pieces, 1 for a piece that merging can make
        self.lexicon = dict.fromkeys((p[:k] for p in self.id for k in range(1, len(p))), 0)
        self.lexicon |= dict.fromkeys(self.id, 1)
        # two characters that no piece has side by side never merge, so words fall apart there
        self.joined = {p[k:k + 2] for p in self.id for k in range(len(p) - 1)}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.runs: dict[int, list[int]] = {}
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, list[int]] = {}
        self.plain_newline = "\n" not in self.id

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Byte-pair merging itself, the best-scored pair first, ties to the left; and the last pair merged."""
        parts, pair = list(text), None
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue: list[tuple] = []

        def offer(i: int, j: int) -> None:
            s = self.score.get(parts[i] + parts[j])
            if s is not None:
                heapq.heappush(queue, (-s, i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while queue:
            _, i, x, y = heapq.heappop(queue)
            j = after[i]
            if parts[i] != x or j >= len(parts) or parts[j] != y:
                continue  # one of the two has been merged since
            pair, parts[i], parts[j], after[i] = (x, y), x + y, "", after[j]
            if after[i] < len(parts):
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p], pair

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces that are merged last to make this one; null for a single character."""
        if piece not in self.halves:
            parts, pair = self.merged(piece)
            if parts != [piece]:
                raise ValueError(f"merging does not make the piece {piece!r}")
            self.halves[piece] = pair
        return self.halves[piece]

    def _beside(self, a: str, b: str) -> bool:
        """Whether merging ``a + b`` leaves the two pieces.

        Merges are undone from the latest, on the sides that touch; the pair
        stays apart unless two touching parts could have merged before the
        merge that took one of them away.
        """
        score, x, y = self.score, a, b
        first = True  # nothing was undone: any merge of the two pieces themselves happens
        bound, left = 0.0, False
        while True:
            s = score.get(x + y)
            # a merge at the bound's own score happens first if it lies to the left
            if s is not None and (first or s > bound or (s == bound and left)):
                return False
            sx = score[x] if len(x) > 1 else None
            sy = score[y] if len(y) > 1 else None
            if sx is None and sy is None:
                return True
            first = False
            if sy is None or (sx is not None and sx < sy):
                bound, left, x = sx, False, self._halves(x)[1]
            else:
                bound, left, y = sy, True, self._halves(y)[0]

    def _arcs(self, unit: str, i: int) -> list[str]:
        """The pieces that begin at a position, the longest last; a character without one stands for its bytes."""
        lexicon, out = self.lexicon, []
        for j in range(i + 1, len(unit) + 1):
            piece = unit[i:j]
            kind = lexicon.get(piece)
            if kind is None:
                break
            if kind:
                out.append(piece)
        return out or [unit[i]]

    def path(self, unit: str) -> list[int]:
        """Shortest path over one unit, depth first with the longest pieces tried first.

        At every position at most one path from the start has weight 0, so a
        position from which the end is not reached is given up for good.
        """
        n, known, pairs = len(unit), self.id, self.pairs
        taken: list[str] = []
        arcs, given_up, i = [self._arcs(unit, 0)], set(), 0
        while i < n:
            here = taken[-1] if taken else None
            free = here is None or here not in known  # nothing merges across the byte fallback
            while arcs[-1]:
                piece = arcs[-1].pop()
                if i + len(piece) in given_up:
                    continue
                if not free and piece in known:
                    ok = pairs.get((here, piece))
                    if ok is None:
                        if len(pairs) > 2 * CACHE:
                            pairs.clear()
                        ok = pairs[here, piece] = self._beside(here, piece)
                    if not ok:
                        continue
                taken.append(piece)
                i += len(piece)
                if i < n:
                    arcs.append(self._arcs(unit, i))
                break
            else:
                given_up.add(i)
                arcs.pop()
                i -= len(taken.pop())
        out: list[int] = []
        for piece in taken:
            if piece in known:
                out.append(known[piece])
            else:
                out += [self.byte[c] for c in piece.encode()]
        return out

    def _spaces(self, n: int) -> list[int]:
        """Ids of ``n`` spaces in a row, which merge after everything else."""
        got = self.runs.get(n)
        if got is None:
            got = [self.id[p] for p in self.merged(SPACE * n)[0]]
            if n <= LONGEST_RUN:
                self.runs[n] = got
        return got

    def unit(self, unit: str) -> list[int]:
        """Ids of spaces followed by a word without spaces."""
        word = unit.lstrip(SPACE)
        n = len(unit) - len(word)
        if not word:
            return self._spaces(n)
        if n < 2:
            return self._parts(unit)
        ids = self._parts(SPACE + word)
        if ids[0] == self.id.get(SPACE):
            return self._spaces(n) + ids[1:]
        return self._spaces(n - 1) + ids

    def _parts(self, unit: str) -> list[int]:
        """Shortest paths of the stretches between characters that never join."""
        cuts = []
        if not unit[1:].isalpha():
            cuts = [k for k in range(1, len(unit)) if unit[k - 1:k + 1] not in self.joined]
        out: list[int] = []
        for a, b in zip([0, *cuts], [*cuts, len(unit)]):
            part = unit[a:b]
            got = self.parts.get(part)
            if got is None:
                if len(self.parts) >= CACHE:
                    self.parts.clear()
                got = self.parts[part] = self.path(part)
            out += got
        return out

    def _word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            if len(self.words) >= CACHE:
                self.words.clear()
            got = self.words[word] = np.asarray(self.unit(word if word[0] == "\n" else SPACE + word), "<u4").tobytes()
        return got

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian uint32 bytes."""
        if not text:
            return b""
        if self.prefix and self.plain_newline and SPACE not in text:
            # single spaces, newlines through the byte fallback: a word is a unit
            words = text.replace("\n", " \n").split(" ")
            if text[0] != "\n" and "" not in words:
                return b"".join(map(self._word, words))
        text = (" " if self.prefix else "") + text
        units = re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", text.replace(" ", SPACE))
        return np.asarray([i for u in units for i in self.unit(u)], "<u4").tobytes()

    def decode(self, ids: bytes) -> str:
        """The text of ids: the transducer read the other way, without the dummy prefix."""
        raw = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        if self.prefix and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (little-endian uint32 bytes) of every whole text.

    Null counts as empty and gives no ids; a null id is kept; repeated rows
    are encoded alike; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = PieceTransducer(model_path)
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([fst.encode(t.as_py()) for t in part.column(1)], pa.binary())], names=["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema("doc_id bigint, ids binary"))


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` of rows ``doc_id, ids``; null ids give the empty text. U+2581 comes back as a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = PieceTransducer(model_path)
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([fst.decode(x.as_py() or b"") for x in part.column(1)], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, schema("doc_id bigint, text string"))


def sentencepiece_report(docs: DataFrame, model_path: str) -> DataFrame:
    """One row per document, encoded and decoded again.

    ``doc_id, n_ids, n_byte_ids`` (ids of the byte fallback), ``ids_crc32``
    (of the uint32 bytes), ``decoded_sha256`` and ``round_trip`` (the decoded
    text is the text, U+2581 read as a space). Edge cases as in
    ``encode_documents``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = PieceTransducer(model_path)
        is_byte = np.zeros(len(fst.surface), bool)
        is_byte[fst.byte] = True
        for b in batches:
            n, nb, crc, sha, same = [], [], [], [], []
            for t in b.column(1):
                text = t.as_py()
                ids = fst.encode(text)
                back = fst.decode(ids)
                n.append(len(ids) // 4)
                nb.append(int(is_byte[np.frombuffer(ids, "<u4")].sum()))
                crc.append(zlib.crc32(ids))
                sha.append(hashlib.sha256(back.encode()).hexdigest())
                same.append(back == text.replace(SPACE, " "))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in (n, nb, crc)), pa.array(sha, pa.string()), pa.array(same, pa.bool_())],
                names=["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "decoded_sha256", "round_trip"])

    return id_and_text(docs).mapInArrow(run, schema(
        "doc_id bigint, n_ids bigint, n_byte_ids bigint, ids_crc32 bigint, decoded_sha256 string, round_trip boolean"))
