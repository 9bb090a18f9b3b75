"""BPE encoding and decoding with a pair occurrence index.

The new words of a group of texts (cut by the byte-level pattern) are laid out once each as one long
array of symbols. An index maps each pair that has a rank to all its positions. Active ranks are
taken in ascending order from a heap; a rank's positions are merged from left to right, and the
lists of the pairs that a merge makes are added to. Texts are then put together from the symbols
of their words. A word's symbols are kept for later groups of the same worker, up to ``CACHE_BYTES``;
past that the store is emptied, which costs time and changes nothing else. A text longer than a group
is read in pieces, cut where a blank stands between two words, so that memory follows its tokens only.

Nulls count as empty texts, which have no tokens. Added (special) tokens found in a text become their
id, as the tokenizers library does; decoding keeps them. Rows are encoded one by one, so repeated
rows and ties come out as they come in, an empty table gives no rows, and only the columns ``keep``
and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from tessera.llm.common import by_bytes, short_batches

#: Bytes of words and symbols that a worker keeps, and what a word takes besides its characters.
CACHE_BYTES, WORD_BYTES = 64 << 20, 160
#: New words are merged in blocks of about so many characters.
BLOCK_CHARS = 4_000_000
#: After so many lists of less than LONG_LIST positions, plain lists take over.
SHORT_LISTS, LONG_LIST = 40, 100
# The suffixes that the byte-level pattern cuts off after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself if it is
    printable Latin-1, else the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@functools.cache
def character_classes() -> np.ndarray:
    """The class of each code point: letter, number, white space or other."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    # Unicode's White_Space.
    for a, b in ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[a : b + 1] = SPACE
    return out


def word_starts(text: str) -> list[int]:
    """Where the words of the byte-level pattern begin in a text that isn't empty."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = character_classes()[points]
    n = len(points)
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    blank = points == 0x20
    space = kind == SPACE
    # a blank goes with the run that follows it
    first[1:] &= ~(blank[:-1] & ~space[1:])
    # white space before a run: its last character stands apart from the others
    last = space[:-1] & ~space[1:]
    first[:-1] |= last
    if "'" in text:
        for m in re.finditer("'", text):
            at = m.start()
            if first[at]:
                for tail in CONTRACTIONS:
                    if text.startswith(tail, at + 1):
                        end = at + 1 + len(tail)
                        first[at + 1] = False
                        if end < n and not space[end]:
                            first[end] = True
                        break
    return np.flatnonzero(first).tolist()


class Ragged:
    """Rows of different lengths in one growing array."""

    def __init__(self, kind: type = np.int32) -> None:
        self.data, self.starts, self.n, self.rows = np.empty(1024, kind), np.zeros(1025, np.int64), 0, 0

    def append(self, data: np.ndarray, counts: np.ndarray) -> None:
        if self.n + len(data) > len(self.data):
            self.data = np.resize(self.data, 2 * (self.n + len(data)))
        if self.rows + len(counts) >= len(self.starts):
            self.starts = np.resize(self.starts, 2 * (self.rows + len(counts)) + 1)
        self.data[self.n : self.n + len(data)] = data
        self.starts[self.rows + 1 : self.rows + len(counts) + 1] = self.n + np.cumsum(counts)
        self.n, self.rows = self.n + len(data), self.rows + len(counts)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """These rows one after the other, and the length of each."""
        begins = self.starts[rows]
        counts = self.starts[rows + 1] - begins
        ahead = np.cumsum(counts)
        at = np.arange(ahead[-1] if len(ahead) else 0)
        at += np.repeat(begins - ahead + counts, counts)
        return self.data[at], counts


class BytePairs:
    """A byte-level BPE vocabulary of the tokenizers library: the content of a file, or its path."""

    def __init__(self, source: bytes | str) -> None:
        spec = json.loads(source if isinstance(source, bytes) else content_of(source))
        model, before = spec["model"], spec["pre_tokenizer"]
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if spec["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before.get("use_regex", True) or odd:
            raise ValueError("not a plain byte-level BPE file")
        ids: dict[str, int] = model["vocab"]
        chars = byte_characters()
        byte_of = {c: b for b, c in enumerate(chars)}
        self.byte_ids = [ids[c] for c in chars]
        self.ranks: dict[int, int] = {}
        self.left, self.right, self.made = [], [], []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.left.append(ids[a])
            self.right.append(ids[b])
            self.made.append(ids[a + b])
            self.ranks.setdefault(ids[a] << 32 | ids[b], rank)
        self.keys = np.array(sorted(self.ranks))
        self.key_ranks = np.array([self.ranks[k] for k in self.keys.tolist()])
        added = {x["content"]: x for x in spec["added_tokens"]}
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in added.values()):
            raise ValueError("added tokens that strip or want word borders")
        self.added = {content: x["id"] for content, x in added.items()}
        longest = sorted(map(re.escape, added), key=len, reverse=True)
        self.cut = re.compile("|".join(longest)) if longest else None
        bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in ids.items()}
        bytes_of |= {x["id"]: content.encode() for content, x in added.items()}
        tokens = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]
        self.token_bytes, self.digits = Ragged(np.uint8), Ragged(np.uint8)
        for out, rows in ((self.token_bytes, tokens), (self.digits, [b"%d," % i for i in range(len(tokens))])):
            out.append(np.frombuffer(b"".join(rows), np.uint8), np.array([len(x) for x in rows]))
        # a cut between two words is safe unless an added token holds a blank
        self.between = None if any(" " in x for x in added) else re.compile(r"(?<=\w) (?=\w)")
        self.words: dict[str, int] = {}
        self.word_ids, self.kept = Ragged(), 0

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and each word's number of ids, by one pair
        occurrence index over all of them. The first ranks have long lists, which numpy merges;
        once lists are short, plain lists are faster."""
        raw = [w.encode("utf-8", "replace") for w in words]
        ends = np.cumsum([len(x) for x in raw])
        sym = np.array(self.byte_ids, np.int64)[np.frombuffer(b"".join(raw), np.uint8)]
        n = len(sym)
        nxt = np.arange(1, n + 1)
        nxt[ends - 1] = -1
        prv = np.arange(-1, n - 1)
        prv[ends[:-1]] = -1
        index: dict[int, list] = {}
        active: list[int] = []

        def add(keys: np.ndarray, at: np.ndarray) -> None:
            """Enters the pairs that begin at these positions."""
            slot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            known = self.keys[slot] == keys
            rank, at = self.key_ranks[slot[known]], at[known]
            order = np.argsort(rank, kind="stable")
            rank, at = rank[order], at[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.r_[0, cuts]].tolist() if len(rank) else (), np.split(at, cuts), strict=False):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(active, r)

        whole = np.flatnonzero(nxt[:-1] >= 0)
        add(sym[whole] << 32 | sym[whole + 1], whole)
        short = 0
        while active and short < SHORT_LISTS:
            rank = heapq.heappop(active)
            left, right, made = self.left[rank], self.right[rank], self.made[rank]
            at = np.sort(np.concatenate(index.pop(rank)))
            short += len(at) < LONG_LIST
            after = nxt[at]
            at = at[(sym[at] == left) & (after >= 0) & (sym[after] == right)]
            if left == right and len(at) > 1:  # from the left, of those that overlap
                taken, last = [], -1
                for i, j in zip(at.tolist(), nxt[at].tolist(), strict=True):
                    if i != last:
                        taken.append(i)
                        last = j
                at = np.array(taken)
            after = nxt[at]
            sym[at], sym[after] = made, -1
            nxt[at] = beyond = nxt[after]
            more = beyond >= 0
            prv[beyond[more]] = at[more]
            before = prv[at]
            ahead = before >= 0
            keys = np.concatenate([made << 32 | sym[beyond[more]], sym[before[ahead]] << 32 | made])
            places = np.concatenate([at[more], before[ahead]])
            if len(at):
                add(keys, places)
        if active:
            sym = self._merge_rest(sym.tolist(), nxt.tolist(), prv.tolist(), active, {r: np.concatenate(parts).tolist() for r, parts in index.items()})
        left_over = sym >= 0
        counts = np.add.reduceat(left_over, np.r_[0, ends[:-1]], dtype=np.int64)
        return sym[left_over].astype(np.int32), counts

    def _merge_rest(self, sym: list[int], nxt: list[int], prv: list[int], active: list[int], index: dict[int, list[int]]) -> np.ndarray:
        ranks = self.ranks
        while active:
            rank = heapq.heappop(active)
            left, right, made = self.left[rank], self.right[rank], self.made[rank]
            at = index.pop(rank)
            at.sort()
            for i in at:
                if sym[i] != left:
                    continue
                j = nxt[i]
                if j < 0 or sym[j] != right:
                    continue
                sym[i], sym[j] = made, -1
                k = nxt[i] = nxt[j]
                if k >= 0:
                    prv[k] = i
                    r = ranks.get(made << 32 | sym[k])
                    if r is not None:
                        if r in index:
                            index[r].append(i)
                        else:
                            index[r] = [i]
                            heapq.heappush(active, r)
                p = prv[i]
                if p >= 0:
                    r = ranks.get(sym[p] << 32 | made)
                    if r is not None:
                        if r in index:
                            index[r].append(p)
                        else:
                            index[r] = [p]
                            heapq.heappush(active, r)
        return np.array(sym)

    def learn(self, words: list[str]) -> None:
        """Puts the words' ids in the store."""
        block: list[str] = []
        size = 0
        for w in words:
            block.append(w)
            size += len(w)
            if size >= BLOCK_CHARS:
                self._store(block)
                block, size = [], 0
        if block:
            self._store(block)

    def _store(self, block: list[str]) -> None:
        ids, counts = self.merge(block)
        begin = len(self.words)
        self.words.update(zip(block, range(begin, begin + len(block)), strict=True))
        self.word_ids.append(ids, counts)
        self.kept += sum(map(len, block)) + WORD_BYTES * len(block)

    def pieces(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is an added token, part of the text)."""
        begin = 0
        for m in self.cut.finditer(text) if self.cut else ():
            if m.start() > begin:
                yield False, text[begin : m.start()]
            yield True, m[0]
            begin = m.end()
        if begin < len(text):
            yield False, text[begin:]

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and each text's number of ids."""
        if self.kept > CACHE_BYTES:
            self.words, self.word_ids, self.kept = {}, Ragged(), 0
        flat: list[str] = []
        sizes = []
        for text in texts:
            before = len(flat)
            for special, part in self.pieces(text):
                if special:
                    if part not in self.words:
                        self.words[part] = len(self.words)
                        self.word_ids.append(np.array([self.added[part]], np.int32), np.array([1]))
                    flat.append(part)
                else:
                    starts = word_starts(part)
                    flat += [part[a:b] for a, b in zip(starts, [*starts[1:], len(part)], strict=True)]
            sizes.append(len(flat) - before)
        at = np.fromiter(map(self.words.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [flat[i] for i in missing.tolist()]
            self.learn(list(dict.fromkeys(new)))
            at[missing] = np.fromiter(map(self.words.__getitem__, new), np.int64, len(new))
        ids, counts = self.word_ids.take(at)
        ends = np.cumsum(sizes)
        total = np.r_[0, np.cumsum(counts)]
        return ids, np.diff(total[np.r_[0, ends]])

    def long_pieces(self, text: str) -> Iterator[str]:
        """A text in pieces of about PIECE_CHARS, none of which cuts a word."""
        begin = 0
        while self.between and len(text) - begin > PIECE_CHARS:
            at = self.between.search(text, begin + PIECE_CHARS)
            if at is None:
                break
            yield text[begin : at.start()]
            begin = at.start()
        yield text[begin:]

    def encode_long(self, text: str) -> tuple[np.ndarray, str, str]:
        """The ids of one text, and the digests of these and of what they decode to, piece by piece."""
        told, decoded, found = hashlib.sha256(), hashlib.sha256(), []
        for piece in self.long_pieces(text):
            ids, counts = self.encode_batch([piece])
            told.update(b"," * bool(found) + self.decimals(ids, counts)[0])
            decoded.update(self.decode(ids, counts)[0].encode())
            found.append(ids)
        return np.concatenate(found), told.hexdigest(), decoded.hexdigest()

    def decimals(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Each text's ids in decimal, joined by commas."""
        data, sizes = self.digits.take(ids)
        return [x[:-1] for x in cut(data, sizes, counts)]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of ids; added tokens stay in them."""
        data, sizes = self.token_bytes.take(ids)
        return [x.decode("utf-8", "replace") for x in cut(data, sizes, counts)]


def cut(data: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """data, which has pieces of these sizes, cut after so many pieces each time."""
    total = np.r_[0, np.cumsum(sizes)]
    bounds = total[np.r_[0, np.cumsum(counts)]].tolist()
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def content_of(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


_loaded: dict[bytes, BytePairs] = {}


def loaded(source: bytes) -> BytePairs:
    """The vocabulary that this worker holds; another one takes its place."""
    digest = hashlib.sha256(source).digest()
    if digest not in _loaded:
        _loaded.clear()
        _loaded[digest] = BytePairs(source)
    return _loaded[digest]


#: Texts are encoded in groups of about so many bytes; a longer text is cut into pieces of so many characters.
GROUP_BYTES, PIECE_CHARS = 1 << 19, 1 << 18


def encode(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = (), ids: bool = True) -> DataFrame:
    """docs' columns ``keep`` with n_tokens, ids_sha256, decoded_sha256 (the digest of the text that
    the ids decode to) and, if asked for, ids (array of int). The vocabulary is a file that the driver can
    read; its content goes to the executors."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(content_of(vocabulary))
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = StructType([docs.schema[c] for c in keep]).add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if ids:
        schema = schema.add("ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(shared.value)
        gc.disable()  # many short strings, none in a cycle
        for batch in batches:
            last = batch.num_columns - 1
            for part in by_bytes(batch, last, GROUP_BYTES):
                if part.num_rows == 1:
                    found, told, decoded = bpe.encode_long(part.column(last)[0].as_py())
                    counts, told, decoded = np.array([len(found)]), [told], [decoded]
                else:
                    found, counts = bpe.encode_batch(part.column(last).to_pylist())
                    told = [hashlib.sha256(x).hexdigest() for x in bpe.decimals(found, counts)]
                    decoded = [hashlib.sha256(x.encode()).hexdigest() for x in bpe.decode(found, counts)]
                columns = [*part.columns[:-1], pa.array(counts), pa.array(told), pa.array(decoded)]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(found)))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        gc.enable()

    return rows.mapInArrow(run, schema)
