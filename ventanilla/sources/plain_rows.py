"""Rows of a block of a sheet's XML at once (S2, S3), where the block is written plainly.

A block's tags are found by the places of ``<`` and ``>`` and told by their first
bytes; arrays of places are worked on instead of one element after another. Plain
is what spreadsheet programs write: rows of cells with a value, a formula with a
value or an inline text, attributes of any kind (a reference stands first), blanks
between tags. Everything else -- comments, CDATA, formatted runs, a bare ``>`` in a
text, unordered cells, what XML forbids -- gives None, and the block is read
by a parser instead (``sheets``). Attributes and marks like ``&amp;`` are read by
that same XML parser, each spelling once.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from xml.parsers import expat

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Tags: opened, without content (+ 8), closed (+ 16).
ROW, CELL, VALUE, INLINE, TEXT, FORMULA = range(1, 7)
ALONE, CLOSED = 8, 16
NAMES = {ROW: b"row", CELL: b"c", VALUE: b"v", INLINE: b"is", TEXT: b"t", FORMULA: b"f"}
#: Which tags may stand behind a tag: so each tells where in a row it is.
FOLLOW = {
    ROW: [CELL, CELL + ALONE, ROW + CLOSED],
    CELL: [VALUE, VALUE + ALONE, INLINE, INLINE + ALONE, FORMULA, FORMULA + ALONE, CELL + CLOSED],
    FORMULA: [FORMULA + CLOSED], VALUE: [VALUE + CLOSED], TEXT: [TEXT + CLOSED],
    INLINE: [TEXT, TEXT + ALONE, INLINE + CLOSED],
    VALUE + CLOSED: [CELL + CLOSED], VALUE + ALONE: [CELL + CLOSED],
    FORMULA + CLOSED: [VALUE, VALUE + ALONE, CELL + CLOSED], FORMULA + ALONE: [VALUE, VALUE + ALONE, CELL + CLOSED],
    TEXT + CLOSED: [INLINE + CLOSED], TEXT + ALONE: [INLINE + CLOSED],
    INLINE + CLOSED: [CELL + CLOSED], INLINE + ALONE: [CELL + CLOSED],
    CELL + CLOSED: [CELL, CELL + ALONE, ROW + CLOSED], CELL + ALONE: [CELL, CELL + ALONE, ROW + CLOSED],
    ROW + CLOSED: [ROW, ROW + ALONE], ROW + ALONE: [ROW, ROW + ALONE],
}
#: Longest reference of a cell or row number, longest other attributes of a tag, spellings of them in a block.
REFERENCE, ATTRIBUTES, SPELLINGS = 11, 160, 200
#: Empty places before cells that a block may have for each cell, beside a million.
SPARSE = 16
PAD = ATTRIBUTES + 16
_BLANKS = b" \t\n\r"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Tag by its first two bytes, pairs of tags that may follow."""
    first, pairs = np.zeros(1 << 16, np.uint8), np.zeros(1 << 10, bool)
    for tag, name in NAMES.items():
        ends = _BLANKS + b">/" if len(name) == 1 else name[1:2]
        for e in ends:
            first[name[0] | e << 8] = tag
        first[ord("/") | name[0] << 8] = tag + CLOSED
    for a, after in FOLLOW.items():
        for b in after:
            pairs[a << 5 | b] = True
    return first, pairs


def block_rows(xml: bytes, head: bytes, number: int, cell: Callable) -> tuple[pa.Array, pa.Array, pa.Array] | None:
    """Row numbers, cell texts and kinds of the rows of a block of whole rows, or None if it is not plain.

    ``head`` is the root's opening tag, ``number`` that of the row before, ``cell`` gives text and kind of a value."""
    prefix = re.match(rb"<([A-Za-z_][\w.-]*:)", head)
    if prefix:
        if xml.count(b"<") != xml.count(b"<" + prefix[1]) + xml.count(b"</" + prefix[1]):
            return None
        xml = xml.replace(b"<" + prefix[1], b"<").replace(b"</" + prefix[1], b"</")
    if b"\r" in xml:
        # as XML reads ends of lines
        xml = xml.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
    buf = np.frombuffer(xml + bytes(PAD), np.uint8)
    places = np.flatnonzero((buf | 2) == ord(">"))
    lt, gt = places[::2], places[1::2]
    if len(lt) != len(gt) or not len(lt) or not ((buf[lt] == ord("<")).all() and (buf[gt] == ord(">")).all()):
        return None
    tags = _tags(buf, lt, gt)
    if tags is None or not _marks_allowed(xml, buf, lt, gt, tags):
        return None
    rows, cells = np.flatnonzero((tags & 7 == ROW) & (tags < CLOSED)), np.flatnonzero((tags & 7 == CELL) & (tags < CLOSED))
    parser = _Attributes(head)
    numbers = _numbers(buf, lt[rows], gt[rows], number, parser)
    found = _references(buf, lt[cells], gt[cells], parser)
    if numbers is None or found is None:
        return None
    for tag in (VALUE, INLINE, TEXT, FORMULA):
        at = np.flatnonzero((tags & 7 == tag) & (tags < CLOSED))
        if _spellings(buf, lt[at] + 1 + len(NAMES[tag]), gt[at], parser) is None:
            return None
    columns, spelling, known = found
    # the value of each cell: what stands behind its v or t
    opened = np.flatnonzero((tags == VALUE) | (tags == TEXT))
    owner = np.searchsorted(cells, opened) - 1
    inline = np.array([a.get("t") == "inlineStr" for a in known] or [False])[spelling]
    counts = (tags[opened] == TEXT) == inline[owner]
    opened, owner = opened[counts], owner[counts]
    starts, lengths = np.zeros(len(cells), np.int64), np.zeros(len(cells), np.int64)
    starts[owner], lengths[owner] = gt[opened] + 1, lt[opened + 1] - gt[opened] - 1
    raw = _texts(buf, starts, lengths, parser)
    if raw is None:
        return None
    texts, kinds = _typed(raw, spelling, known, cell)
    # cells before each row, and each row's widest cell
    row_of = np.searchsorted(rows, cells) - 1
    bounds = np.searchsorted(cells, np.append(rows, len(tags)))
    first = bounds[:-1]
    if columns is None:
        columns = np.arange(len(cells)) - first[row_of]
    elif ((np.diff(columns) <= 0) & (np.diff(row_of) == 0)).any():
        return None
    widths = np.where(np.diff(bounds) > 0, columns[np.maximum(bounds[1:] - 1, 0)] + 1 if len(cells) else 0, 0)
    offsets = np.concatenate([[0], np.cumsum(widths)])
    if offsets[-1] > SPARSE * len(cells) + 1_000_000:
        return None
    if offsets[-1] != len(cells):
        order = np.full(offsets[-1], len(cells))
        order[offsets[row_of] + columns] = np.arange(len(cells))
        order = pa.array(order)
        texts = pa.concat_arrays([texts, pa.array([""], texts.type)]).take(order)
        kinds = pa.concat_arrays([kinds, pa.array([None], kinds.type)]).take(order)
    offsets = pa.array(offsets.astype(np.int32))
    return pa.array(numbers), pa.ListArray.from_arrays(offsets, texts), pa.ListArray.from_arrays(offsets, kinds)


def _words(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as a number."""
    return np.ndarray((len(buf) - 7,), "<u8", buffer=buf, strides=(1,))


def _tags(buf: np.ndarray, lt: np.ndarray, gt: np.ndarray) -> np.ndarray | None:
    """The tag at each place, or None if one is unknown or stands where it may not."""
    first, pairs = _tables()
    words = _words(buf)[lt + 1]
    tags = first[(words & 0xFFFF).astype(np.uint16)]
    if not tags.all():
        return None
    closed = tags >= CLOSED
    for tag in (ROW, INLINE):
        # names of more than one byte: the rest of the name and what ends it
        name = NAMES[tag]
        at = words[tags == tag]
        ends = (at >> np.uint64(8 * len(name))).astype(np.uint8)
        if (at & np.uint64((1 << 8 * len(name)) - 1) != int.from_bytes(name, "little")).any() or not np.isin(ends, list(_BLANKS + b">/")).all():
            return None
    for tag, name in NAMES.items():
        whole = b"/" + name + b">"
        at = words[tags == tag + CLOSED]
        if (at & np.uint64((1 << 8 * len(whole)) - 1) != int.from_bytes(whole, "little")).any():
            return None
    tags = tags + ((buf[gt - 1] == ord("/")) & ~closed) * np.uint8(ALONE)
    after = tags[:-1].astype(np.uint16) << 5 | tags[1:]
    ends = {ROW + CLOSED, ROW + ALONE}
    if not pairs[after].all() or int(tags[0]) not in (ROW, ROW + ALONE) or int(tags[-1]) not in ends:
        return None
    return tags


def _marks_allowed(xml: bytes, buf: np.ndarray, lt: np.ndarray, gt: np.ndarray, tags: np.ndarray) -> bool:
    """No marks that XML forbids or changes, and only blanks between tags that hold no text."""
    body = buf[:len(xml)]
    low = body[body < 32]
    if len(low) and not np.isin(low, (9, 10)).all():
        return False
    if not xml.isascii():
        try:
            xml.decode()
        except UnicodeDecodeError:
            return False
        if b"\xef\xbf\xbe" in xml or b"\xef\xbf\xbf" in xml:
            return False
    gaps = lt[1:] - gt[:-1] - 1
    empty = np.ones(32, bool)
    empty[[VALUE, TEXT, FORMULA]] = False
    between = np.flatnonzero((gaps > 0) & empty[tags[:-1]])
    if len(between):
        solid = np.concatenate([[0], np.cumsum(~np.isin(body, list(_BLANKS)))])
        if (solid[lt[between + 1]] != solid[gt[between] + 1]).any():
            return False
    if xml[:lt[0]].strip(_BLANKS) or xml[gt[-1] + 1:].strip(_BLANKS):
        return False
    formulas = np.flatnonzero(tags == FORMULA)
    return not any(b"&" in xml[gt[i] + 1:lt[i + 1]] for i in formulas) if b"&" in xml else True


class _Attributes:
    """Reads attributes and marks of texts with an XML parser, under the root's opening tag; None where it refuses."""

    def __init__(self, head: bytes) -> None:
        self.head = head
        self.seen: dict[bytes, object] = {}

    def read(self, spelled: bytes) -> dict[str, str] | None:
        """The attributes spelled in a tag (a ``/`` at its end counts for nothing)."""
        if spelled and spelled[0] not in _BLANKS + b"/":
            return None
        held = []
        parser = expat.ParserCreate(namespace_separator="}")
        parser.StartElementHandler = lambda _, attributes: held.append(attributes)
        try:
            parser.Parse(self.head, False)
            parser.Parse(b"<c" + spelled.removesuffix(b"/") + b"/>", False)
        except expat.ExpatError:
            return None
        return held[-1] if len(held) == 2 else None

    def text(self, spelled: bytes) -> str | None:
        """A text with its marks read."""
        if spelled not in self.seen:
            parts = []
            parser = expat.ParserCreate()
            parser.CharacterDataHandler = parts.append
            try:
                parser.Parse(b"<t>" + spelled + b"</t>", True)
                self.seen[spelled] = "".join(parts)
            except expat.ExpatError:
                self.seen[spelled] = None
        return self.seen[spelled]


def _spellings(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, parser: _Attributes) -> tuple[np.ndarray, list[dict]] | None:
    """Which spelling of attributes stands at each place, and the attributes of each spelling."""
    lengths = ends - starts
    group, known = np.zeros(len(starts), np.int64), []
    if not len(starts):
        return group, known
    longest = int(lengths.max())
    if longest > ATTRIBUTES or int(lengths.min()) < 0:
        return None
    words = _words(buf)
    left = np.arange(len(starts))
    while len(left):
        if len(known) == SPELLINGS:
            return None
        size, at = int(lengths[left[0]]), starts[left]
        same = lengths[left] == size
        for k in range(0, size, 8):
            kept = np.uint64((1 << 8 * min(8, size - k)) - 1)
            here = words[at + k] & kept
            same &= here == here[0]
        attributes = parser.read(buf[starts[left[0]]:starts[left[0]] + size].tobytes())
        if attributes is None:
            return None
        group[left[same]] = len(known)
        known.append(attributes)
        left = left[~same]
    return group, known


def _leading(buf: np.ndarray, at: np.ndarray, letters: bool) -> tuple[np.ndarray, np.ndarray] | None:
    """Column (from 0) or number that ``r="..."`` gives and the place behind it."""
    value, size = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    lettered, done = np.full(len(at), letters), np.zeros(len(at), bool)
    good = np.ones(len(at), bool)
    for k in range(REFERENCE + 1):
        b = buf[at + k]
        quote, digit = b == ord('"'), (b >= ord("0")) & (b <= ord("9"))
        if letters:
            lettered &= (b >= ord("A")) & (b <= ord("Z"))
            value = np.where(lettered, value * 26 + b - (ord("A") - 1), value)
            good &= done | lettered | (digit | quote if k else False)
        else:
            value = np.where(digit & ~done, value * 10 + b - ord("0"), value)
            good &= done | digit | (quote if k else False)
        size = np.where(quote & ~done, k, size)
        done |= quote
        if done.all():
            break
    if not (good & done).all():
        return None
    return value - letters, at + size + 1


def _refers(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether `` r="`` stands at each place."""
    return (_words(buf)[at] & np.uint64(0xFFFFFFFF)) == int.from_bytes(b' r="', "little")


def _numbers(buf: np.ndarray, lt: np.ndarray, gt: np.ndarray, number: int, parser: _Attributes) -> np.ndarray | None:
    """The number of each row; one without follows the row before."""
    at = lt + 4
    says = _refers(buf, at)
    read = _leading(buf, at[says] + 4, False)
    if read is None:
        return None
    rest = at.copy()
    rest[says] = read[1]
    spelled = _spellings(buf, rest, gt, parser)
    # a number behind other attributes
    if spelled is None or any("r" in a for a in spelled[1]):
        return None
    said = np.full(len(lt), number)
    said[says] = read[0]
    last = np.maximum.accumulate(np.where(says, np.arange(len(lt)), -1))
    return said[np.maximum(last, 0)] * (last >= 0) + number * (last < 0) + np.arange(len(lt)) - last


def _references(buf: np.ndarray, lt: np.ndarray, gt: np.ndarray, parser: _Attributes) -> tuple[np.ndarray | None, np.ndarray, list[dict]] | None:
    """Column of each cell (None if no cell says it), which spelling its other attributes have, and those."""
    at = lt + 2
    says = _refers(buf, at)
    if says.any() and not says.all():
        return None
    columns = None
    if says.any():
        read = _leading(buf, at + 4, True)
        if read is None:
            return None
        columns, at = read
    spelled = _spellings(buf, at, gt, parser)
    # a reference behind other attributes
    if spelled is None or any("r" in a for a in spelled[1]):
        return None
    return columns, *spelled


def _texts(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, parser: _Attributes) -> pa.StringArray | None:
    """The texts at the places, marks read."""
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    if offsets[-1] >= 1 << 31:
        return None
    data = buf[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)]
    texts = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
    marked = np.flatnonzero(data == ord("&"))
    if not len(marked):
        return texts
    at = np.unique(np.searchsorted(offsets, marked, "right") - 1)
    read = [parser.text(texts[i].as_py().encode()) for i in at]
    if None in read:
        return None
    order = np.arange(len(starts))
    order[at] = len(starts) + np.arange(len(at))
    return pa.concat_arrays([texts, pa.array(read, pa.string())]).take(pa.array(order))


def _typed(raw: pa.StringArray, spelling: np.ndarray, known: list[dict], cell: Callable) -> tuple[pa.StringArray, pa.StringArray]:
    """Texts and kinds of the cells: each value of a type and style is read once."""
    names, order, parts, base = [None], np.arange(len(raw)), [raw], len(raw)
    kinds = np.zeros(len(raw), np.int64)
    for g, attributes in enumerate(known):
        at = np.flatnonzero(spelling == g)
        said, style = attributes.get("t", "n"), attributes.get("s", 0)
        values = (raw if len(at) == len(raw) else raw.take(pa.array(at)))
        if said in ("inlineStr", "str"):
            # as they are
            kind = cell(said, style, "x")[1]
            if kind not in names:
                names.append(kind)
            lengths = np.diff(np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, values.offset * 4))
            kinds[at] = np.where(lengths > 0, names.index(kind), 0)
            continue
        coded = values.dictionary_encode()
        read = [cell(said, style, v) for v in coded.dictionary.to_pylist()]
        names += [k for k in dict.fromkeys(k for _, k in read) if k not in names]
        codes = coded.indices.to_numpy(zero_copy_only=False)
        kinds[at] = np.array([names.index(k) for _, k in read], np.int64)[codes]
        order[at] = base + codes
        parts.append(pa.array([t for t, _ in read], pa.string()))
        base += len(read)
    texts = pa.concat_arrays(parts).take(pa.array(order)) if len(parts) > 1 else raw
    return texts, pa.array(names, pa.string()).take(pa.array(kinds))
