"""Token ids in compressed files: order-0 to order-2 predictions are mixed and drive an adaptive range coder over independent blocks."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Tokens in a block, which starts from an empty model, and in a segment (one row of the file table), which ends with a document.
BLOCK = 4096
SEGMENT = 8 << 20
END_ID = 2
#: Words beyond which a worker forgets those not asked for of late (each takes some 40 bytes), the bytes of the longest, and words that go to the library together.
REMEMBERED = 1_200_000
LONGEST = 64
_TOGETHER = 100

# Format of a segment: MAGIC, crc32 of the header, header length, header (deflated), blocks.
MAGIC = b"LKT1"

TOTAL = 1 << 16
SLOT_BITS = 12
_SLOTS = (1 << SLOT_BITS) - 1
#: What a slot holds before it has seen an id; no rank equals it.
_NONE = 0xFFFF
CONFIDENCE = 7
#: Order 0 keeps at least this part of TOTAL for itself against order 1, and both together twice as much against order 2.
FLOOR = 4096
#: Steps after which slots and weights take in what was seen; order 0 does so at first as often, then each time its block has grown by a quarter.
EPOCH = 16
#: What an id adds to its bucket's count, and the sum of the buckets' shares.
STEP = 8
SHARES_BITS = 12
SHARES = 1 << SHARES_BITS
#: Bits of the weights of orders 1 and 2, and how fast they follow their success.
WEIGHT_BITS, RATE = 14, 5

# Order-0 buckets of ranks: 64 single ranks, then eight buckets for each power of two.
BUCKET_BITS = np.array([0] * 64 + [b for b in range(3, 13) for _ in range(8)])
BUCKET_BASE = np.concatenate([[0], np.cumsum(1 << BUCKET_BITS)[:-1]])
BUCKETS = len(BUCKET_BITS)
_SCALE, _BASE, _ORDINAL = 0.5**BUCKET_BITS, BUCKET_BASE.astype(np.int32), np.arange(BUCKETS + 1, dtype=np.int32)
#: A slot's next confidence, shifted into place: by its confidence after an error, then after a success.
_NEXT = np.array([max(1, k >> 1) for k in range(CONFIDENCE + 1)] + [min(k + 1, CONFIDENCE) for k in range(CONFIDENCE + 1)], np.int32) << 16
# The coder's 48-bit numbers are kept as doubles, which hold them and all products here exactly.
_WHOLE, _SHORT, _WORD, _UNWORD, _UNSHORT = 2.0**48, 2.0**32, 2.0**16, 2.0**-16, 2.0**-32
#: What rows of ranks are longer by in memory: rows a power of two apart would share few places of the processor's caches.
_PAD = 32


class _Lanes:
    """The models of many blocks side by side, one lane each. The same calls in the same order give the same numbers, so reader and writer agree.

    A slot of order 1 or 2 holds the id that it expects and a confidence; each confidence has a weight that follows how often such slots
    are right. Weights of both orders and the shares of order 0 are mixed into one distribution of TOTAL. Slots and weights learn
    an epoch's ids at its end: the writer then predicts whole epochs at once, and the reader's steps are short. Arrays of both
    orders are kept in one, order 1 in front.
    """

    def __init__(self, lanes: int):
        self.lanes, both = lanes, np.arange(2 * lanes, dtype=np.int64)
        self.slot, self.row8 = both << SLOT_BITS, both * (CONFIDENCE + 1)
        self.row0 = both[:lanes] * BUCKETS
        self.table = np.full(2 * lanes << SLOT_BITS, _NONE, np.int32)
        self.weight = np.tile(np.array([0] + [(1 << WEIGHT_BITS) // 3] * CONFIDENCE, np.int32), 2 * lanes)
        self.count = np.ones(lanes * BUCKETS, np.float32)
        self.share = np.zeros((lanes, BUCKETS + 1), np.int32)
        self.seen, self.steps, self.due = [], 0, 0

    def refresh(self) -> bool:
        """Whether order 0 was due: then shares follow the buckets' counts, one at least, summed up; ends has a bucket's sum before it and with it, 16 bits each."""
        if self.steps < self.due:
            return False
        self.due = self.steps + max(EPOCH, self.steps // 4)
        if self.seen:
            self.count += STEP * np.bincount(np.concatenate(self.seen), minlength=len(self.count))
            self.seen = []
        total = np.cumsum(self.count.reshape(-1, BUCKETS), axis=1)
        total *= (SHARES - BUCKETS) / total[:, -1:]
        total[:, -1] = SHARES - BUCKETS
        self.share[:, 0], self.share[:, 1:] = 0, total
        self.share += _ORDINAL
        self.ends = (self.share[:, :-1] << 16 | self.share[:, 1:]).ravel()
        return True

    def places(self, last: np.ndarray, older: np.ndarray, out: np.ndarray) -> np.ndarray:
        """The slots of contexts, for one step or for many: order 1 by the last rank, order 2 by a hash of the last two."""
        n = self.lanes
        np.bitwise_and(last, _SLOTS, out=out[..., :n])
        hashed = last * 40503
        hashed ^= older * 30011
        hashed >>= 3
        np.bitwise_and(hashed, _SLOTS, out=out[..., n:])
        out += self.slot
        return out

    def mix(self, held: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of slots' contents: what they expect, their confidences, and the parts m2 and m1 of TOTAL for the ids that orders 2 and 1 expect."""
        n = self.lanes
        expected, sure = held & 0xFFFF, held >> 16
        weight = self.weight.take(self.row8 + sure, mode="clip")
        m2 = weight[..., n:] * (TOTAL - 2 * FLOOR)
        m2 >>= WEIGHT_BITS
        m1 = (TOTAL - FLOOR) - m2
        m1 *= weight[..., :n]
        m1 >>= WEIGHT_BITS
        m1 *= expected[..., :n] != expected[..., n:]
        return expected, sure, m2, m1

    def learn(self, at: np.ndarray, held: np.ndarray, x: np.ndarray, bucket: np.ndarray) -> None:
        """What slots, weights and counts take from the ranks x of an epoch. A slot that was wrong halves its confidence, and takes the new id at the lowest."""
        n = self.lanes
        expected, sure = held & 0xFFFF, held >> 16
        same = expected.reshape(-1, 2, n) == x[:, None]
        twice = np.concatenate([x, x], axis=1)
        hit2, same = same[:, 1].copy(), same.reshape(len(x), -1)
        expected -= twice
        expected *= same | (sure > 1)
        expected += twice
        expected |= _NEXT.take(sure + same * np.int32(CONFIDENCE + 1), mode="clip")
        self.table[at] = expected
        sure[:, :n] *= ~hit2
        j = self.row8 + sure
        held_by, right = np.bincount(j.ravel(), minlength=len(self.weight)), np.bincount(j[same], minlength=len(self.weight))
        self.weight += ((right << WEIGHT_BITS) - held_by * self.weight >> RATE).astype(np.int32)
        self.weight[:: CONFIDENCE + 1] = 0
        self.seen.append((self.row0 + bucket)[~(hit2 | same[:, :n])])
        self.steps += len(x)


def encode_blocks(ranks: np.ndarray, bucket_of: np.ndarray) -> list[bytes]:
    """Each row of ranks as the words of a range coder with 48-bit low end.

    An id is coded in the part of the highest order that expects it, or in the share of its bucket and there evenly. Afterwards a
    width below 2^32 gives off one or two words of 16 bits. Between words low may pass 2^48: the carry then goes into the next
    word, and all carries are settled at the end.
    """
    lanes, size = ranks.shape
    model = _Lanes(lanes)
    low, width = np.zeros(lanes), np.full(lanes, _WHOLE - 1)
    # An epoch's words, two a step at most, and which of them are given off; those that are, with their lanes, in order of time.
    words, given, lane_of = np.zeros((EPOCH, 2, lanes), np.int32), np.zeros((EPOCH, 2, lanes), bool), np.tile(np.arange(lanes, dtype=np.min_scalar_type(lanes)), 2 * EPOCH)
    line, lane = [], []
    columns = np.zeros((EPOCH + 2, lanes), np.int64)
    for t in range(0, size, EPOCH):
        n = min(EPOCH, size - t)
        columns[:2], columns[2 : n + 2] = columns[EPOCH:], ranks[:, t : t + n].T
        x = columns[2 : n + 2].astype(np.int32)
        b = bucket_of.take(columns[2 : n + 2])
        model.refresh()
        at = model.places(columns[1 : n + 1], columns[:n], np.empty((n, 2 * lanes), np.int64))
        held = model.table.take(at, mode="clip")
        expected, _, m2, m1 = model.mix(held)
        is2, is1 = (expected[:, lanes:] == x) & (m2 > 0), (expected[:, :lanes] == x) & (m1 > 0)
        literal, m21 = ~(is1 | is2), m2 + m1
        z, m0 = model.ends.take(model.row0 + b, mode="clip"), TOTAL - m21
        a, z = (z >> 16) * m0 >> SHARES_BITS, (z & 0xFFFF) * m0 >> SHARES_BITS
        z -= a
        a += m21
        start, part = (a * literal + m2 * is1).astype(np.float64), (z * literal + m2 * is2 + m1 * is1).astype(np.float64)
        inner = b * literal
        scale, off = _SCALE.take(inner), ((x - _BASE.take(inner)) * literal).astype(np.float64)
        for k in range(n):
            unit = np.floor(width * _UNWORD)
            low += start[k] * unit
            width = part[k] * unit
            width *= scale[k]
            np.floor(width, out=width)
            low += off[k] * width
            short = np.less(width, _SHORT, out=given[k, 0])
            word = np.floor(low * _UNSHORT)
            words[k, 0] = word
            short = short.astype(np.float64)
            word *= short
            word *= _SHORT
            low -= word
            more = short * (_WORD - 1)
            more += 1
            low *= more
            width *= more
            short = np.less(width, _SHORT, out=given[k, 1]).nonzero()[0]
            if len(short):
                word = np.floor(low.take(short) * _UNSHORT)
                words[k, 1, short] = word
                low[short] = (low.take(short) - word * _SHORT) * _WORD
                width[short] *= _WORD
        off = np.flatnonzero(given[:n])
        line.append(words.reshape(-1).take(off))
        lane.append(lane_of.take(off))
        model.learn(at, held, x, b)
    for _ in range(3):
        word = np.floor(low * _UNSHORT)
        line.append(word.astype(np.int32))
        lane.append(lane_of[:lanes])
        low = (low - word * _SHORT) * _WORD
    lane = np.concatenate(lane)
    line, ends = np.concatenate(line).take(np.argsort(lane, kind="stable")), (2 * np.cumsum(np.bincount(lane))).tolist()
    while len(carry := np.flatnonzero(line >> 16)):  # low is below 1 at the start, so no block's first word has any
        line[carry] &= 0xFFFF
        line[carry - 1] += 1
    raw = line.astype("<u2").tobytes()
    return [raw[b:e] for b, e in zip([0, *ends], ends, strict=False)]


def decode_blocks(blocks: list[bytes], size: int, bucket_of: np.ndarray) -> np.ndarray:
    """The rows of ranks that encode_blocks() had."""
    lanes = len(blocks)
    room = max(map(len, blocks)) // 2 + 4
    words = np.zeros((lanes, room), np.uint16)
    for k, b in enumerate(blocks):
        words[k, : len(b) // 2] = np.frombuffer(b, "<u2")
    code = words[:, 0] * _SHORT + words[:, 1] * _WORD + words[:, 2]
    words = words.reshape(-1)
    model = _Lanes(lanes)
    width, pos = np.full(lanes, _WHOLE - 1), np.arange(lanes) * room + 3
    bucket_by_share, share_row = np.zeros(0, np.uint8), np.arange(lanes) << SHARES_BITS
    every = np.tile(np.arange(BUCKETS, dtype=np.uint8), lanes)
    out, ranks = np.zeros((EPOCH + 2, lanes), np.int64), np.zeros((lanes, size + _PAD), np.uint16)
    for t in range(0, size, EPOCH):
        n = min(EPOCH, size - t)
        if model.refresh():
            bucket_by_share = np.repeat(every, np.diff(model.share, axis=1).ravel())
        at, held, bucket = np.empty((n, 2 * lanes), np.int64), np.empty((n, 2 * lanes), np.int32), np.empty((n, lanes), np.uint8)
        for k in range(n):
            model.places(out[k + 1], out[k], at[k])
            model.table.take(at[k], out=held[k], mode="clip")
            expected, _, m2, m1 = model.mix(held[k])
            m21 = m2 + m1
            m0 = TOTAL - m21
            unit = np.floor(width * _UNWORD)
            value = (code / unit).astype(np.int32)
            by2, own = value < m2, value >= m21
            value -= m21
            value += 1
            goal = ((value * float(SHARES) - 1) / m0).astype(np.int64)
            goal *= own
            goal += share_row
            b = bucket[k]
            bucket_by_share.take(goal, out=b, mode="clip")
            z = model.ends.take(model.row0 + b, mode="clip")
            a = z >> 16
            z &= 0xFFFF
            a *= m0
            a >>= SHARES_BITS
            z *= m0
            z >>= SHARES_BITS
            z -= a
            # Selections by multiplying, as the conditions are too irregular for branches: own, by2, or else m1's part.
            a += m1
            a *= own
            a += m2 * ~by2
            z -= m1
            z *= own
            z += m1
            m2 -= m1
            m2 *= by2
            z += m2
            code -= a * unit
            width = z * unit
            width *= _SCALE.take(b, mode="clip")
            np.floor(width, out=width)
            off = np.floor(code / width)
            code -= off * width
            x, second = expected[:lanes], expected[lanes:]
            own_x = off.astype(np.int32)
            own_x += _BASE.take(b, mode="clip")
            own_x -= x
            own_x *= own
            second -= x
            second *= by2
            own_x += second
            own_x += x
            out[k + 2] = own_x
            short = width < _SHORT
            more = short * (_WORD - 1)
            more += 1
            width *= more
            code *= more
            code += words.take(pos, mode="clip") * short
            pos += short
            short = (width < _SHORT).nonzero()[0]
            if len(short):
                code[short] = code[short] * _WORD + words.take(pos[short])
                width[short] *= _WORD
                pos[short] += 1
        model.learn(at, held, out[2 : n + 2].astype(np.int32), bucket)
        ranks[:, t : t + n] = out[2 : n + 2].T
        out[:2] = out[EPOCH:]
    return ranks[:, :size]


def _bucket_of(ranks: int) -> np.ndarray:
    return np.repeat(np.arange(BUCKETS), 1 << BUCKET_BITS)[: max(ranks, 1)]


def pack(ids: np.ndarray, doc_ids: list[int | None], sizes: list[int]) -> bytes:
    """A segment: the ids of some documents in a row (below 65,536), with the documents' ids and sizes. Ids are ranked by how common they are here."""
    if len(ids) and int(ids.max()) >= 1 << 16:
        raise ValueError("token ids of 65,536 or more don't fit this format")
    count = np.bincount(ids, minlength=1)
    held = np.flatnonzero(count)
    table = held[np.argsort(-count[held], kind="stable")]
    rank = np.zeros(len(count), np.uint16)
    rank[table] = np.arange(len(table))
    size = max(1, min(BLOCK, len(ids)))
    lanes = -(-len(ids) // size)
    rows, ranks = np.zeros((lanes, size + _PAD), np.uint16), rank.take(ids, mode="clip")
    full = len(ids) // size
    rows[:full, :size] = ranks[: full * size].reshape(full, size)
    rows[full:, : len(ids) - full * size] = ranks[full * size :]
    blocks = encode_blocks(rows[:, :size], _bucket_of(len(table))) if lanes else []
    known = np.array([d is not None for d in doc_ids], np.uint8)
    header = zlib.compress(b"".join([
        struct.pack("<QQIII", len(ids), len(doc_ids), size, len(blocks), len(table)),
        table.astype("<u2").tobytes(), known.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array(sizes, "<u8").tobytes(),
        np.array([len(b) for b in blocks], "<u4").tobytes(), np.array([zlib.crc32(b) for b in blocks], "<u4").tobytes(),
    ]), 6)
    return b"".join([MAGIC, struct.pack("<II", zlib.crc32(header), len(header)), header, *blocks])


def unpack(data: bytes) -> tuple[np.ndarray, list[int | None], list[int]]:
    """What pack() was given. A wrong checksum of the header or of any block raises ValueError."""
    crc, length = struct.unpack_from("<II", data, 4)
    deflated = data[12 : 12 + length]
    if data[:4] != MAGIC or zlib.crc32(deflated) != crc:
        raise ValueError("damaged header")
    header = zlib.decompress(deflated)
    n, docs, size, lanes, ranks = struct.unpack_from("<QQIII", header)
    at = 28
    fields = []
    for kind, k in (("<u2", ranks), ("u1", docs), ("<i8", docs), ("<u8", docs), ("<u4", lanes), ("<u4", lanes)):
        fields.append(np.frombuffer(header, kind, k, at))
        at += fields[-1].nbytes
    table, known, doc_ids, sizes, lengths, sums = fields
    ends = 12 + length + np.cumsum(lengths.astype(np.int64))
    blocks = [data[e - w : e] for e, w in zip(ends.tolist(), lengths.tolist(), strict=True)]
    for k, (b, s) in enumerate(zip(blocks, sums.tolist(), strict=True)):
        if zlib.crc32(b) != s:
            raise ValueError(f"damaged block {k}")
    rows = decode_blocks(blocks, size, _bucket_of(ranks)).reshape(-1)[:n] if lanes else np.zeros(0, np.int64)
    return table.take(rows).astype(np.int64) if n else rows, [int(d) if k else None for d, k in zip(doc_ids, known, strict=True)], sizes.tolist()


class _Memory:
    """Ids of short texts in two generations of at most `room` entries each: what is found in the old one moves to the new one, and when that is full the old one goes."""

    def __init__(self, room: int):
        self.room, self.new, self.old = room, {}, {}

    def find(self, text: str) -> bytes | None:
        x = self.new.get(text)
        if x is None and (x := self.old.get(text)) is not None:
            self.new[text] = x
        return x

    def turn(self) -> None:
        if len(self.new) >= self.room:
            self.old, self.new = self.new, {}


class Pieces:
    """The tokenizers library with a memory of words.

    Byte-level BPE first cuts a text into runs that never hold a space after another character, so a text may be cut before any
    space that doesn't stand between two white-space characters (the end of the text counts as one): the pieces' ids joined
    are the text's ids. A run never goes on from a letter, digit or sign into a line feed either; texts in which no white space stands before
    a line feed are cut there too. Nor does it go on from a letter or digit into other signs, so a piece that ends with ASCII signs after
    an ASCII letter or digit may be cut before them. Words recur far more than texts, so the library encodes each once; many go to it in one text, with a
    line feed, which is a run of its own before one space or none and a character, before each. Texts that hold one of the tokenizer's added
    tokens aren't cut at all. Pieces and words are counted out, looked up and joined by array operations over some MB of text at once.
    """

    # all white space by any of the libraries at hand
    _BLANKS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
    _BLANK = rf"[{_BLANKS}]"
    _UNSAFE = rf"{_BLANK} (?:{_BLANK}|\z)"
    _CUT = re.compile(r"(?<=\S)(?= )|(?= \S)")
    _SPACE = re.compile(r"\s")
    _SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
    _ENDS = np.array([c < 128 and chr(c).isalnum() for c in range(256)])

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("this tokenizer has ids of 65,536 or more")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        feed = self._ids("\n")
        self.feed = feed[0] if len(feed) == 1 else None
        # The memory: texts, their ids, two bytes each, and which were asked for since some were last forgotten.
        self.texts, self.ids, self.used = pa.array([], pa.large_string()), pa.array([], pa.large_binary()), np.zeros(0, bool)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u2")

    def _learn_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words after a space, each by itself or, without white space in them, many with line feeds between them, which are found again one for each."""
        out, together = {}, []
        for w in words:
            if w and self.feed is not None and not self._SPACE.search(w):
                together.append(w)
            else:
                out[w] = self._ids(" " + w).tobytes()
        for i in range(0, len(together), _TOGETHER):
            some = together[i : i + _TOGETHER]
            ids = self._ids(" " + "\n ".join(some))
            ends = np.flatnonzero(ids == self.feed)
            if len(ends) == len(some) - 1:
                raw, ends = ids.tobytes(), [-2, *(ends * 2).tolist(), 2 * len(ids)]
                out.update((w, raw[b + 2 : e]) for w, b, e in zip(some, ends, ends[1:], strict=False))
            else:
                out.update((w, self._ids(" " + w).tobytes()) for w in some)
        return out

    def _learn(self, texts: pa.Array) -> pa.Array:
        """Ids of distinct texts: those without white space but one space or line feed in front go to the library together."""
        alone = np.ones(len(texts), bool)
        if self.feed is not None:
            alone = ~np.asarray(pc.match_substring_regex(texts, rf"\A[\n ]?[^{self._BLANKS}]+\z"))
        words = texts.take(pa.array(np.flatnonzero(~alone)))
        fed = np.asarray(pc.starts_with(words, "\n"))
        ends = np.append(np.arange(0, len(words), _TOGETHER), len(words))
        lines = _regrouped(pc.if_else(pa.array(fed), words, _after("\n", words)), lambda at: at[ends])
        got = self._all_ids(lines)
        right = np.array([np.count_nonzero(x == self.feed) for x in got], np.int64) == np.diff(ends)
        of_right = np.repeat(right, np.diff(ends))
        alone[np.flatnonzero(~alone)[~of_right]] = True
        ids, fed = np.concatenate([np.zeros(0, "<u2"), *(x for x, r in zip(got, right, strict=True) if r)]), fed[of_right]
        at = np.flatnonzero(ids == self.feed) if len(fed) else np.zeros(0, np.int64)
        at = 2 * np.append(np.stack([at, at + ~fed], axis=1).ravel(), len(ids))
        together = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(ids)]).take(pa.array(np.arange(1, len(at), 2)))
        own = pa.array([x.tobytes() for x in self._all_ids(texts.filter(pa.array(alone)))], pa.large_binary())
        place = np.argsort(np.append(np.flatnonzero(~alone), np.flatnonzero(alone)))
        return pa.concat_arrays([together, own]).take(pa.array(place))

    def _all_ids(self, texts: pa.Array) -> list[np.ndarray]:
        return [np.array(x.ids, "<u2") for x in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]

    def _find(self, texts: pa.Array) -> np.ndarray:
        """Where in the memory distinct texts stand; new ones are learnt."""
        at = pc.index_in(texts, value_set=self.texts)
        new = texts.filter(at.is_null())
        at = at.fill_null(-1).to_numpy().astype(np.int64)
        at[at < 0] = len(self.texts) + np.arange(len(new))
        self.ids, self.texts = pa.concat_arrays([self.ids, self._learn(new)]), pa.concat_arrays([self.texts, new])
        self.used = np.append(self.used, np.zeros(len(new), bool))
        self.used[at] = True
        return at

    def _forget(self) -> None:
        """Keeps what was asked for since the last time and isn't long, when there is more than REMEMBERED."""
        if len(self.texts) <= REMEMBERED:
            return
        kept = pa.array(np.flatnonzero(self.used & (pc.binary_length(self.texts).to_numpy() <= LONGEST)))
        self.texts, self.ids, self.used = self.texts.take(kept), self.ids.take(kept), np.zeros(len(kept), bool)

    def _pieces(self, pieces: pa.Array) -> pa.Array:
        """Ids of pieces, of which each is its word and the signs after it."""
        words, data = pc.binary_length(pc.ascii_rtrim(pieces, self._SIGNS)).to_numpy(), pieces.buffers()[2]
        raw = np.append(np.frombuffer(data, np.uint8) if data else [], 0).astype(np.uint8)

        def cut(at: np.ndarray) -> np.ndarray:
            ends = at[:-1] + words
            return np.append(np.stack([at[:-1], np.where((words > 0) & self._ENDS[raw[ends - 1]], ends, at[1:])], axis=1).ravel(), at[-1])

        coded = _regrouped(pieces, cut).dictionary_encode()
        at = self._find(coded.dictionary)
        return _regrouped(self.ids.take(pa.array(at[coded.indices.to_numpy()])), lambda at: at[::2])

    @staticmethod
    def _split(texts: pa.Array, feeds: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Pieces of texts cut before spaces and, if asked for, line feeds: the pieces, each text's in order by their numbers, and where each text's begin."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n") if feeds else texts, " ")
        begin, coded = split.offsets.to_numpy(), split.values.dictionary_encode()
        pieces = _after(" ", coded.dictionary)
        if feeds:
            pieces = pc.if_else(pc.starts_with(coded.dictionary, "\n"), coded.dictionary, pieces)
        code = coded.indices.to_numpy().astype(np.int64)
        code[begin[:-1]] = len(pieces) + np.arange(len(texts))
        return pa.concat_arrays([pieces, split.values.take(pa.array(begin[:-1]))]), code, begin

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Each text's ids, two bytes each, little-endian."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        self._forget()
        special = np.zeros(len(texts), bool)
        for token in self.added:
            special |= np.asarray(pc.match_substring(texts, token))
        unsafe = np.asarray(pc.match_substring_regex(texts, self._UNSAFE)) & ~special
        feeds = ~np.asarray(pc.match_substring_regex(texts, rf"{self._BLANK}\n"))
        out = [b""] * len(texts)
        for k in np.flatnonzero(special).tolist():
            out[k] = self._ids(texts[k].as_py()).tobytes()
        groups = []
        if (own := np.flatnonzero(unsafe)).size:
            cut = [[p for p in self._CUT.split(t) if p] for t in texts.take(pa.array(own)).to_pylist()]
            begin = np.append(0, np.cumsum(list(map(len, cut))))
            groups.append((own, pa.array([p for c in cut for p in c], pa.large_string()), np.arange(begin[-1]), begin))
        for which in (feeds, ~feeds):
            if (own := np.flatnonzero(which & ~(special | unsafe))).size:
                groups.append((own, *self._split(texts.take(pa.array(own)) if len(own) < len(texts) else texts, which is feeds)))
        if not groups:
            return out
        ids, before = self._pieces(pa.concat_arrays([pieces for _, pieces, _, _ in groups])), 0
        for own, pieces, code, begin in groups:
            joined = _regrouped(ids.take(pa.array(code + before)), lambda at, begin=begin: at[begin])
            before += len(pieces)
            for k, x in zip(own.tolist(), joined.to_pylist(), strict=True):
                out[k] = x
        return out


def _after(mark: str, texts: pa.Array) -> pa.Array:
    kind = pa.large_string()
    return pc.binary_join_element_wise(pa.scalar(mark, kind), texts, pa.scalar("", kind))


def _regrouped(texts: pa.Array, ends: Callable[[np.ndarray], np.ndarray]) -> pa.Array:
    """The same characters or bytes in other texts; ends makes their offsets of the former ones."""
    _, at, data = texts.buffers()
    at = np.ascontiguousarray(ends(np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]))
    return pa.Array.from_buffers(texts.type, len(at) - 1, [None, pa.py_buffer(at), data or pa.py_buffer(b"")])


@cache
def _pieces(path: str) -> Pieces:
    """A worker keeps its memory from task to task."""
    return Pieces(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Texts that are cut into pieces at once, in bytes; the more, the fewer pieces come again.
_SLICE = 12 << 20


def write_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The file table: rows (part, seq, n_docs, n_tokens, segment), written to the shared folder; in order of part and seq it holds all documents by doc_id.

    Null texts count as empty, null doc_ids come first, equal doc_ids in an order of their texts. Each document ends with END_ID.
    Rows are dealt by ranges of doc_id and text checksum, so not even one doc_id with a third of all rows goes to one task.
    """
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", text.alias("text"), F.crc32(text.cast("binary")).alias("tie"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = slim.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")

    def pack_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, end = _pieces(tokenizer), np.array([END_ID], "<u2").tobytes()
        part, seq, ids, doc_ids, tokens = TaskContext.get().partitionId(), 0, [], [], 0

        def row() -> pa.RecordBatch:
            joined = np.frombuffer(b"".join(ids), "<u2").astype(np.int64)
            data = pack(joined, doc_ids, [len(x) // 2 for x in ids])
            columns = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(doc_ids)], pa.int64()), pa.array([len(joined)], pa.int64()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "seq", "n_docs", "n_tokens", "segment"])

        for b in batches:
            texts, own = b.column("text"), b.column("doc_id").to_pylist()
            reach = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
            i = 0
            while i < len(own):
                j = max(i + 1, int(np.searchsorted(reach, (reach[i - 1] if i else 0) + _SLICE, side="right")))
                for d, x in zip(own[i:j], pieces.encode(texts[i:j]), strict=True):
                    ids.append(x + end)
                    doc_ids.append(d)
                    tokens += len(x) // 2 + 1
                    if tokens >= SEGMENT:
                        yield row()
                        ids, doc_ids, tokens, seq = [], [], 0, seq + 1
                i = j
        if doc_ids:
            yield row()

    return written(dealt.select("doc_id", "text").mapInArrow(pack_all, "part int, seq int, n_docs long, n_tokens long, segment binary"), "tokens")


def read_tokens(files: DataFrame) -> DataFrame:
    """One row for each document of a file table: doc_id, start, n_tokens, ids_crc32, decoded block by block and checked."""

    def unpack_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, data in zip(*[b.column(c).to_pylist() for c in ("part", "seq", "segment")], strict=True):
                ids, doc_ids, sizes = unpack(data)
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(sizes)
                starts = ends - sizes
                sums = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(doc_ids)
                columns = [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), *[pa.array(x, pa.int64()) for x in (doc_ids, starts, sizes, sums)]]
                yield pa.RecordBatch.from_arrays(columns, ["part", "seq", "doc_id", "offset", "n_tokens", "ids_crc32"])

    sizes = files.select("part", "seq", "n_tokens")
    per_part = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # no more rows than the writer had partitions
    part_start = per_part.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    before = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.join(part_start, "part").select("part", "seq", (F.col("part_start") + F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).alias("base"))
    rows = files.select("part", "seq", "segment").mapInArrow(unpack_all, "part int, seq int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes all documents and reads them back; an empty table gives no rows, further columns aren't read."""
    return read_tokens(write_tokens(docs.select("doc_id", "text"), tokenizer or default_tokenizer()))
