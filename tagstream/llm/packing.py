"""Sum-of-squares online packing into windows of `capacity` tokens.

Each task packs its own stream of documents: a document's full windows go out at once, the rest
is placed whole into the fill level that minimises the sum of squared counts of partially filled
windows (an array of `capacity` counts). What stays open when the stream ends is joined in order
of fill, cut into full windows, and the last rest is cut at powers of two, so that nothing is
padded. A window's number is the task's partition number and a running count, so a task that
runs again gives the same rows.

The share of windows made from what stays open falls with a task's tokens; a task's size is the session's
spark.sql.files.maxPartitionBytes.

Cases: null and empty texts are one end token; names of special tokens in a text are these tokens, as in
the tokenizer's plain call; repeated rows are packed each by itself; a
document of any length is cut at capacity; empty tables give no rows.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bounded, documents, schema, slices, trim, worker_state

CAPACITY, END = 4096, 2
VOCABULARY = "word_bpe_49k.json"
#: Words that a worker keeps the ids of, about 60 bytes each; and words of over 15 bytes among them.
_CACHE, _CACHE_LONG = 1_500_000, 60_000
_U = np.uint64
#: White space beyond ASCII, as the tokenizer sees it.
_SPACES = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SPACE, _LETTER, _DIGIT, _MARK = range(4)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes as: printable bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in own)}


def byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of each byte, and whether it makes a word one that only the pattern can cut: apostrophes and characters beyond Latin-1 letters."""
    kind = np.full(256, _MARK, np.uint8)
    kind[[9, 10, 11, 12, 13, 32]], kind[48:58], kind[97:123], kind[128:] = _SPACE, _DIGIT, _LETTER, _LETTER
    odd = np.zeros(256, bool)
    odd[39] = True
    odd[0xC0:] = True
    odd[0xC3] = False
    return kind, odd


class IdTable:
    """Open-addressing table from words of up to 15 bytes, held exactly in two integers, to their ids.

    When it is full, the recently used half of the words that were seen in more than one batch stays.
    """

    def __init__(self, most: int):
        self.most, self.now = most, 0
        self._fill(*(np.empty(0, t) for t in (_U, _U, np.int64, np.int32, np.int32)), np.empty(0, np.uint32))

    def _fill(self, lo, hi, start, n, last, pool) -> None:
        size = len(lo)
        room = max(1 << 14, 1 << (2 * size).bit_length())
        self.lo, self.hi, self.start, self.n, self.last, self.born = (np.zeros(room, t) for t in (_U, _U, np.int64, np.int32, np.int32, np.int32))
        self.lo[:size], self.hi[:size], self.start[:size], self.n[:size], self.last[:size], self.born[:size] = lo, hi, start, n, last, last
        self.size, self.pool, self.used = size, np.zeros(max(1 << 16, 2 * len(pool)), np.uint32), len(pool)
        self.pool[: len(pool)] = pool
        self.slots = np.full(2 * room, -1, np.int32)
        self._place(np.arange(size, dtype=np.int32))

    def _first(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        h = (lo * _U(0x9E3779B97F4A7C15)) ^ (hi * _U(0xC2B2AE3D27D4EB4F))
        return ((h ^ (h >> _U(29)) ^ (h >> _U(47))) & _U(len(self.slots) - 1)).astype(np.int64)

    def _place(self, entries: np.ndarray) -> None:
        at = self._first(self.lo[entries], self.hi[entries])
        while len(entries):
            free = self.slots[at] < 0
            self.slots[at[free]] = entries[free]
            left = self.slots[at] != entries
            entries, at = entries[left], (at[left] + 1) & (len(self.slots) - 1)

    def find(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Entry of each word, or -1."""
        at, out, todo = self._first(lo, hi), np.full(len(lo), -1, np.int32), np.arange(len(lo))
        while len(todo):
            e = self.slots[at]
            known = e >= 0
            hit = known & (self.lo[e] == lo[todo]) & (self.hi[e] == hi[todo])
            out[todo[hit]] = e[hit]
            go = known & ~hit
            todo, at = todo[go], (at[go] + 1) & (len(self.slots) - 1)
        self.last[out[out >= 0]] = self.now
        return out

    def add(self, lo: np.ndarray, hi: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
        """New, distinct words; ids one after another."""
        a, b = self.size, self.size + len(lo)
        if b > len(self.lo):
            self.lo, self.hi, self.start, self.n, self.last, self.born = (np.concatenate([x[:a], np.zeros(2 * b - a, x.dtype)]) for x in (self.lo, self.hi, self.start, self.n, self.last, self.born))
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used + 2 * len(ids), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.lo[a:b], self.hi[a:b], self.n[a:b], self.last[a:b], self.born[a:b] = lo, hi, n, self.now, self.now
        self.start[a:b] = self.used + np.cumsum(n) - n
        self.size, self.used = b, self.used + len(ids)
        if 2 * b > len(self.slots):
            self.slots = np.full(1 << (4 * b).bit_length(), -1, np.int32)
            self._place(np.arange(b, dtype=np.int32))
        else:
            self._place(np.arange(a, b, dtype=np.int32))

    def tidy(self) -> None:
        """Call between batches."""
        self.now += 1
        if self.size > self.most:
            last = self.last[: self.size]
            keep = np.flatnonzero(last > self.born[: self.size])
            if len(keep) > self.most // 2:
                keep = np.sort(keep[np.argsort(last[keep], kind="stable")[-(self.most // 2) :]])
            self._fill(self.lo[keep], self.hi[keep], np.cumsum(self.n[keep]) - self.n[keep], self.n[keep], last[keep], gather(self.pool, self.start[keep], self.n[keep]))


def gather(pool: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """pool[start : start + n] of each row, one after another."""
    before = np.cumsum(n) - n
    return pool[np.repeat(start - before, n) + np.arange(int(n.sum()))] if len(n) else pool[:0]


class WordIds:
    """ids of texts, as the tokenizer's own call gives them.

    The tokenizer takes out the names of its special tokens, normalises (NFC, lower case), splits at white
    space, cuts words into pieces by a pattern, and merges within pieces alone. So a text's ids are
    its words' or pieces' ids one after another; these repeat, and their ids are kept. The merging is the
    tokenizer's; a piece's last id is one of those that end a word, which tells the pieces of a
    batch apart. Words of ASCII and Latin-1 letters, digits and marks are cut where the class of a byte
    changes; all others by the pattern, which comes from the vocabulary's file.
    """

    def __init__(self, path: str, state: dict | None = None, most: int = _CACHE):
        state = {} if state is None else state
        if "tokenizer" not in state:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer, normalizers, pre_tokenizers

            t = Tokenizer.from_file(path)
            own = json.loads(t.to_str())
            ends = np.zeros(t.get_vocab_size(), bool)
            ends[[k for w, k in t.get_vocab(False).items() if w.endswith("</w>")]] = True
            special = {x["content"]: np.array([x["id"]], np.uint32) for x in own["added_tokens"]}
            piece = regex.compile(own["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
            t.normalizer, t.pre_tokenizer, t.encode_special_tokens = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit(), True
            state |= {"tokenizer": t, "ends": ends, "table": IdTable(most), "long": {}, "special": special, "piece": piece}
        self.tokenizer, self.ends, self.table, self.long, self.special, self.piece = (state[k] for k in ("tokenizer", "ends", "table", "long", "special", "piece"))
        self.names = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters, (self.kind, self.odd) = byte_letters(), byte_classes()

    @staticmethod
    def normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if _SPACES.search(text):
            text = _SPACES.sub(" ", text)
        return text.lower() if "\u03a3" not in text else "".join(c.lower() for c in text)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and the ids."""
        split = [[w] if w.isalpha() else self.piece.findall(w) for w in words]
        flat = [p for s in split for p in s]
        spelt = [p if p.isascii() and p.isprintable() else "".join(map(self.letters.get, p.encode("utf-8", "replace"))) for p in flat]
        got = self.tokenizer.encode_batch_fast([" ".join(spelt[k : k + 256]) for k in range(0, len(spelt), 256)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in got]) if got else np.empty(0, np.uint32)
        cut = np.flatnonzero(self.ends[ids]) + 1
        if len(cut) != len(flat):
            raise ValueError("the vocabulary doesn't mark the ends of words")
        upto = np.concatenate([[0], cut])[np.cumsum([0, *map(len, split)])]
        return np.diff(upto), ids

    def _units(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each word or piece."""
        b = np.frombuffer(raw, np.uint8)
        kind = self.kind[b]
        odd = self.odd[b]
        lead = np.flatnonzero(b[:-1] == 0xC3)
        odd[lead[(b[lead + 1] == 0x97) | (b[lead + 1] == 0xB7)]] = True
        if (at := np.flatnonzero(odd)).size:  # one unit from white space to white space
            space = np.flatnonzero(kind == _SPACE)
            k = np.unique(np.searchsorted(space, at))
            step = np.zeros(len(b) + 1, np.int8)
            step[space[k - 1] + 1] += 1
            step[space[k]] -= 1
            kind[np.cumsum(step[:-1], dtype=np.int8) > 0] = _LETTER
        edge = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)) + 1
        start = edge[kind[edge] != _SPACE]
        return start, edge[np.flatnonzero(kind[edge] != _SPACE) + 1]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        if self.names and any(self.names.search(t) for t in texts):
            parts = [self.names.split(t) for t in texts]
            got = iter(self._ids([p for s in parts for p in s[::2]]))
            return [np.concatenate([self.special[p] if k % 2 else next(got) for k, p in enumerate(s)]) for s in parts]
        return self._ids(texts)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        self.table.tidy()
        if len(self.long) > _CACHE_LONG:
            for w in list(self.long)[: _CACHE_LONG // 2]:
                del self.long[w]
        coded = [self.normal(t).encode("utf-8", "replace") for t in texts]
        raw = b" " + b" ".join(coded) + b" "
        start, end = self._units(raw)
        size = end - start
        word = np.lib.stride_tricks.as_strided(np.frombuffer(raw + bytes(16), "<u8", len(raw) // 8), (len(raw),), (1,))
        low = np.array([(1 << 8 * min(k, 8)) - 1 for k in range(17)], _U)
        high = np.array([(1 << 8 * max(0, k - 8)) - 1 for k in range(16)], _U)
        short = np.flatnonzero(size < 16)
        s, n = start[short], size[short]
        lo = word[s] & low[n]
        hi = np.where(n > 8, word[np.minimum(s + 8, len(raw) - 1)] & high[n], _U(0)) | (n.astype(_U) << _U(56))
        entry = self.table.find(lo, hi)
        if (new := np.flatnonzero(entry < 0)).size:
            order = new[np.lexsort((lo[new], hi[new]))]
            first = np.ones(len(order), bool)
            first[1:] = (lo[order[1:]] != lo[order[:-1]]) | (hi[order[1:]] != hi[order[:-1]])
            own = order[first]
            count, ids = self._learn([raw[a:b].decode() for a, b in zip(s[own].tolist(), (s + n)[own].tolist(), strict=True)])
            a = self.table.size
            self.table.add(lo[own], hi[own], count, ids)
            entry[order] = a + np.cumsum(first) - 1
        first, count, pool = np.empty(len(start), np.int64), np.empty(len(start), np.int64), self.table.pool
        first[short], count[short] = self.table.start[entry], self.table.n[entry]
        if len(short) < len(start):
            far = np.flatnonzero(size > 15)
            spelt = [raw[a:b] for a, b in zip(start[far].tolist(), end[far].tolist(), strict=True)]
            if miss := list(dict.fromkeys(w for w in spelt if w not in self.long)):
                n, ids = self._learn([w.decode() for w in miss])
                self.long.update(zip(miss, np.split(ids, np.cumsum(n)[:-1]), strict=True))
            found = [self.long[w] for w in spelt]
            count[far] = [len(x) for x in found]
            first[far] = self.table.used + np.cumsum(count[far]) - count[far]
            pool = np.concatenate([pool[: self.table.used], *found])
        ids = gather(pool, first, count)
        ends = np.cumsum([len(c) + 1 for c in coded])
        upto = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(start, ends)]
        return np.split(ids, upto[:-1])


class Packer:
    """piece = (key, start, length, crc, doc_tokens, window, offset); finished pieces are in .out."""

    def __init__(self, capacity: int, first_window: int):
        self.capacity, self.window = capacity, first_window
        self.level = np.zeros(capacity + 1, np.int64)  # open windows of each fill; full ones do not count
        self.open: dict[int, list[list]] = {}
        self.out: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((key, start, n, zlib.crc32(ids), total, self.window, offset))
            offset += n
        self.window += 1

    def add(self, key, ids: bytes) -> None:
        total, c = len(ids) // 4, self.capacity
        for at in range(0, total - c + 1, c):
            self._emit([(key, at, ids[4 * at : 4 * (at + c)], total)])
        rest = total % c
        if rest:
            at = total - rest
            self._place((key, at, ids[4 * at :], total), rest)

    def _place(self, piece: tuple, size: int) -> None:
        fills = np.flatnonzero(self.level[: self.capacity - size + 1])
        change = 2 * (self.level[fills + size] - self.level[fills]) + 2
        change[fills + size == self.capacity] = (1 - 2 * self.level[fills])[fills + size == self.capacity]
        best, fill = 2 * self.level[size] + 1, 0
        if len(fills):
            k = len(fills) - 1 - int(np.argmin(change[::-1]))  # of equals the fullest
            if change[k] <= best:
                fill = int(fills[k])
        pieces = [piece]
        if fill:
            pieces = self.open[fill].pop() + pieces
            self.level[fill] -= 1
        if fill + size == self.capacity:
            self._emit(pieces)
        else:
            self.open.setdefault(fill + size, []).append(pieces)
            self.level[fill + size] += 1

    def finish(self) -> None:
        rest: list[tuple] = []
        filled = 0
        for fill in sorted(self.open, reverse=True):
            for pieces in self.open[fill]:
                for piece in pieces:
                    rest.append(piece)
                    filled += len(piece[2]) // 4
                    while filled >= self.capacity:
                        rest, filled = self._cut(rest, filled, self.capacity)
        while filled:
            rest, filled = self._cut(rest, filled, 1 << (filled.bit_length() - 1))
        self.open, self.level[:] = {}, 0

    def _cut(self, pieces: list[tuple], filled: int, size: int) -> tuple[list[tuple], int]:
        """Send out a window of the first `size` tokens."""
        whole, left = [], size
        for k, (key, start, ids, total) in enumerate(pieces):
            n = len(ids) // 4
            if n <= left:
                whole.append((key, start, ids, total))
                left -= n
                after = pieces[k + 1 :]
            else:
                whole.append((key, start, ids[: 4 * left], total))
                after = [(key, start + left, ids[4 * left :], total), *pieces[k + 1 :]]
                left = 0
            if not left:
                break
        self._emit([p for p in whole if len(p[2])])
        return after, filled - size


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """One row per piece; no shuffle."""
    kind = df.schema[key].dataType.simpleString()
    path = path or vocabulary_path()
    rows = schema(f"{key} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    out = to_arrow_schema(rows)
    end = np.array([END], "<u4").tobytes()
    bounded(df.sparkSession)

    def run(batches):
        trim()
        words = WordIds(path, worker_state("packing", path))
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)

        def flush():
            got, packer.out = packer.out, []
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True) if got else [[]] * len(out), out, strict=True)], schema=out)

        for batch in batches:
            for part in slices(batch):
                keys, texts = (c.to_pylist() for c in part.columns)
                for k, ids in zip(keys, words([t or "" for t in texts]), strict=True):
                    packer.add(k, ids.astype("<u4").tobytes() + end)
                if len(packer.out) >= 4096:
                    yield flush()
        packer.finish()
        yield flush()

    return df.select(key, text).mapInArrow(run, rows)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)
