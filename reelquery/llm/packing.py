"""Harmonic sequence packing (operator 4).

Capacity C = 2048.  A document of more than C ids is cut into full sequences; what is left, or a shorter document, stays
whole and belongs to class k = floor(C / length).  Each bin of class k takes exactly k documents, whatever else arrives,
so every worker packs on its own without any exchange.  The room that a full bin has left goes to the next document that
fits it whole; only when ``WAITING`` bins wait for one, the next that fits none is cut to fill the largest rooms.  At a
partition's end the documents of unfinished bins fill the rooms of waiting ones, and what is left is laid end to end
into sequences of C ids, the last stretch into sequences of power-of-two lengths, which need no padding.  So there is
hardly any padding, and about one cut for several documents.

Token ids are those of the tokenizers library for the public vocabulary's JSON file, unchanged settings.  Texts are cut
at places that no token of this vocabulary reaches across (before white space, between a word and the punctuation after
it, after a single line end), and the ids of each stretch are kept in a bounded table.  Texts with white space other than spaces, tabs and line
ends, or with an added token, go through the tokenizer whole, as do all texts if the file isn't of that kind.

Sequence ids are the partition's number times 2**40 plus a running number, so they are unique without an exchange and
the same again when a lost partition is recomputed.

Edge cases: a null or empty text has only the end id; very long texts simply fill many sequences; rows that repeat a
doc_id are packed one by one; doc_id may be null; an empty table has no pieces; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common as C

CAPACITY = 2048
END_ID = 1
#: Most distinct stretches of which a worker keeps the ids; it changes no result.
KNOWN_WORDS = 400_000
#: Most full bins with room that wait for a document; a task holds at most their ids and one bin of each class.
WAITING = 64
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_STRETCH = re.compile(rf"\n(?=[{_LATIN}])| ?[{_LATIN}]+(?=[ \n\t\r.,;:!?]|\Z)|[.,;:!?]+(?=[ \n\t\r]|\Z)|[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
_WORD = re.compile(rf" ?[{_LATIN}]+")
#: The bytes that stand for themselves in byte-level vocabularies; the others follow from 256 on, in order.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LEVEL = dict(zip((b for b in range(256) if b not in _VISIBLE), map(chr, range(256, 512)), strict=False))
_OTHER_SPACE = re.compile(r"[^\S \n\t\r]")


class Encoder:
    """Texts to little-endian 32-bit id bytes; ``spec``: a tokenizer's JSON file."""

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_buffer(spec)
        d = json.loads(spec)
        split = d["pre_tokenizer"] or {}
        self.apart = d["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True) and not d["model"].get("dropout")
        self.merge = self.plain.model.tokenize if self.apart and d["model"].get("type") == "BPE" else None
        self.added = [t["content"] for t in d["added_tokens"]]
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        out = array("I", self.plain.encode(text, add_special_tokens=False).ids)
        return out.tobytes()

    def _stretch(self, part: str) -> bytes:
        if self.merge and _WORD.fullmatch(part):  # one pre-token: straight to the tokenizer's model, at a third of the cost
            out = array("I", [t.id for t in self.merge(part.encode().decode("latin-1").translate(_BYTE_LEVEL))]).tobytes()
        else:
            out = self.ids(part)
        if len(self.known) < KNOWN_WORDS and len(part) < 32:
            self.known[part] = out
        return out

    def __call__(self, text: str) -> bytes:
        if not self.apart or _OTHER_SPACE.search(text) or any(t in text for t in self.added):
            return self.ids(text)
        get = self.known.get
        return b"".join([get(w) or self._stretch(w) for w in _STRETCH.findall(text)])


_encoders: dict[int, Encoder] = {}


class Packer:
    """The bins of one partition; ``done`` holds finished pieces (doc row, start, length, crc, tokens, sequence, offset)."""

    def __init__(self, base: int, capacity: int = CAPACITY):
        self.next, self.capacity, self.open, self.done = base, capacity, {}, []
        self.rooms: list[tuple[int, int]] = []  # (room, number) of waiting bins, by room
        self.waiting: dict[int, list[tuple]] = {}
        self.serial = 0

    def _close(self, bin_: list[tuple]) -> None:
        at = 0
        for doc, start, raw, tokens in bin_:
            n = len(raw) // 4
            self.done.append((doc, start, n, zlib.crc32(raw), tokens, self.next, at))
            at += n
        self.next += 1

    def _wait(self, room: int, number: int) -> None:
        if room:
            insort(self.rooms, (room, number))
        else:
            self._close(self.waiting.pop(number))

    def _pour(self, doc, start: int, raw: bytes, tokens: int) -> tuple[int, bytes]:
        """Fill the largest rooms; the start and the ids that are left if these run out."""
        while raw and self.rooms:
            room, number = self.rooms.pop()
            n = min(room, len(raw) // 4)
            self.waiting[number].append((doc, start, raw[: 4 * n], tokens))
            self._wait(room - n, number)
            start, raw = start + n, raw[4 * n :]
        return start, raw

    def add(self, doc, raw: bytes) -> None:
        tokens, at, c = len(raw) // 4, 0, self.capacity
        while tokens - at >= c:
            self._close([(doc, at, raw[4 * at : 4 * (at + c)], tokens)])
            at += c
        rest = tokens - at
        if not rest:
            return
        piece = (doc, at, raw[4 * at :], tokens)
        fit = bisect_left(self.rooms, (rest, -1))
        if fit < len(self.rooms):
            room, number = self.rooms.pop(fit)
            self.waiting[number].append(piece)
            self._wait(room - rest, number)
        elif len(self.rooms) >= WAITING and sum(r for r, _ in self.rooms) >= rest:
            self._pour(*piece)
        else:
            k = c // rest
            bin_ = self.open.setdefault(k, [])
            bin_.append(piece)
            if len(bin_) == k:
                self.waiting[self.serial] = self.open.pop(k)
                self._wait(c - sum(len(p[2]) // 4 for p in bin_), self.serial)
                self.serial += 1

    def finish(self) -> None:
        """Unfinished bins: into the rooms of waiting ones, then end to end; the last stretch in powers of two."""
        left = []
        for doc, start, raw, tokens in (p for k in sorted(self.open) for p in self.open[k]):
            start, raw = self._pour(doc, start, raw, tokens)
            if raw:
                left.append((doc, start, raw, tokens))
        left += [p for _, number in self.rooms for p in self.waiting[number]]
        self.open, self.rooms, self.waiting = {}, [], {}
        total = sum(len(p[2]) // 4 for p in left)
        room, bin_ = 0, []
        for doc, start, raw, tokens in left:
            while raw:
                if not room:
                    if bin_:
                        self._close(bin_)
                    room = self.capacity if total >= self.capacity else 1 << (total.bit_length() - 1)
                    total -= room
                    bin_ = []
                n = min(room, len(raw) // 4)
                bin_.append((doc, start, raw[: 4 * n], tokens))
                room, start, raw = room - n, start + n, raw[4 * n :]
        if bin_:
            self._close(bin_)


_PACKED = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _pack(held, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(held.value)
        encode = _encoders.get(key) or _encoders.setdefault(key, Encoder(held.value))
        packer = Packer(TaskContext.get().partitionId() << 40, capacity)
        end = end_id.to_bytes(4, "little")

        def out() -> pa.RecordBatch:
            columns = zip(*packer.done, strict=True) if packer.done else [[]] * len(_PACKED)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PACKED, strict=True)], schema=_PACKED)
            packer.done = []
            return batch

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packer.add(doc, encode(text) + end)
                if len(packer.done) > 8192:
                    yield out()
        packer.finish()
        yield out()

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of all rows of ``docs``.  ``tokenizer``: path on the driver of the public tokenizer's JSON file.

    The file's size is fixed (about 1.5 megabytes), so it is broadcast; executors need no file.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    with open(tokenizer, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())
    return C.id_text(docs).mapInArrow(_pack(held, capacity, end_id), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
