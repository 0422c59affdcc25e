"""Byte-level BPE: vectorised pre-tokenisation by scans of transition functions, cached pair merging, decoding.

A text is an array of codepoint classes. Each class is a function from the scanner's state to its next state; functions are
composed inside blocks and then over blocks, which is associative, so that every state, and with it every boundary, comes from
array operations over a whole batch of texts at once. The slices between boundaries look up their ids in a bounded cache, and
only a slice seen for the first time is merged pair by pair. Ids keep the byte offset at which they start.

A null text is an empty text and has no ids. Texts of any length, repeated rows and extra columns need nothing special.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from basketlens.llm.common import in_chunks, table, tell_workers
from basketlens.llm.words import mixed

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Characters scanned at once, characters of a scan's block and of its end, and slices whose ids a worker keeps.
CHUNK, BLOCK, TAIL, CACHE = 1_000_000, 256, 8, 400_000
#: A worker keeps a cache of up to so many slices from task to task; a larger one goes when its task ends.
KEPT = 150_000
#: Slices of up to so many bytes are handled as numbers; bits of their table, and ids after which it is emptied; bits of the table
#: that marks the pairs that merge; no rank.
SHORT, TABLE, STORED, FILTER, NONE = 15, 20, 4_000_000, 21, (1 << 31) - 1
#: Longer slices of up to so many bytes are merged so many together; those beyond one by one.
LONG, ROWS = 63, 8_000

# Symbols that the scanner reads. A space or other white space is `last` if something that is not white space follows it; an
# apostrophe is `one` or `two` if that many letters of a contraction follow it. Symbols of a text's first character come after.
LETTER, NUMBER, OTHER, SPACE_MID, WHITE_MID, SPACE_LAST, WHITE_LAST, QUOTE_ONE, QUOTE_TWO = range(9)
SYMBOLS = 9
# States: at a fresh start, in a run of one class, after a space that the next run takes in, after other white space, inside a
# run of white space, and with one or two letters of a contraction to come.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, AFTER_WHITE, IN_WHITE, ONE_LEFT, TWO_LEFT = range(9)
STATES = 9
#: What a state becomes, and whether a slice starts, for each symbol: the states that go on with their slice, then the default.
GO_ON = {
    LETTER: {IN_LETTERS: IN_LETTERS, AFTER_SPACE: IN_LETTERS, ONE_LEFT: FRESH, TWO_LEFT: ONE_LEFT},
    NUMBER: {IN_NUMBERS: IN_NUMBERS, AFTER_SPACE: IN_NUMBERS},
    OTHER: {IN_OTHERS: IN_OTHERS, AFTER_SPACE: IN_OTHERS},
    SPACE_MID: {IN_WHITE: IN_WHITE},
    WHITE_MID: {IN_WHITE: IN_WHITE},
    SPACE_LAST: {},
    WHITE_LAST: {},
    QUOTE_ONE: {IN_OTHERS: IN_OTHERS, AFTER_SPACE: IN_OTHERS},
    QUOTE_TWO: {IN_OTHERS: IN_OTHERS, AFTER_SPACE: IN_OTHERS},
}
STARTS = [IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, IN_WHITE, AFTER_SPACE, AFTER_WHITE, ONE_LEFT, TWO_LEFT]


@lru_cache(1)
def transitions() -> tuple[np.ndarray, np.ndarray]:
    """(next state, starts a slice), each flat by symbol * STATES + state; symbols from SYMBOLS on forget the state before."""
    after = np.zeros((2 * SYMBOLS, STATES), np.intp)
    starts = np.ones((2 * SYMBOLS, STATES), bool)
    for symbol in range(SYMBOLS):
        after[symbol] = after[symbol + SYMBOLS] = STARTS[symbol]
        for state, then in GO_ON[symbol].items():
            after[symbol, state], starts[symbol, state] = then, False
    return after.ravel(), starts.ravel()


@lru_cache(1)
def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or WHITE_MID of every codepoint, by the library's own Unicode tables."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE_MID, r"\s")):
        bare = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        found = bytes(bare.encode_ordinary(every)).decode()
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return out


def symbols(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The scanner's symbols of joined texts, whose first characters are at the indices `first`."""
    s = classes()[codes]
    begins = np.zeros(len(codes) + 3, bool)
    begins[first] = begins[len(codes):] = True
    white = s == WHITE_MID
    follows = np.zeros(len(codes), bool)  # something that is not white space follows in the same text
    follows[:-1] = ~white[1:]
    follows &= ~begins[1 : len(codes) + 1]
    space = codes == 32
    np.putmask(s, space, SPACE_MID)
    np.putmask(s, white & follows, WHITE_LAST)
    np.putmask(s, space & follows, SPACE_LAST)
    quotes = np.flatnonzero(codes == 39)
    if len(quotes):
        ahead = np.concatenate([codes, np.zeros(2, codes.dtype)])
        x, y = ahead[quotes + 1], ahead[quotes + 2]
        x = np.where(begins[quotes + 1], 0, x)
        y = np.where(begins[quotes + 1] | begins[quotes + 2], 0, y)
        s[quotes[np.isin(x, [ord(c) for c in "stmd"])]] = QUOTE_ONE
        s[quotes[((y == ord("e")) & ((x == ord("r")) | (x == ord("v")))) | ((x == ord("l")) & (y == ord("l")))]] = QUOTE_TWO
    s[first] += SYMBOLS
    return s


def _composed(after: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Each block's function: the state after it, for every state before it."""
    whole = np.repeat(np.arange(STATES)[:, None], columns.shape[1], 1)
    for column in columns:
        whole = after.take(whole + column)
    return whole


def slice_starts(s: np.ndarray) -> np.ndarray:
    """Indices at which slices start, for the symbols of joined texts."""
    after, starts = transitions()
    n = len(s)
    wide = np.full(-(-n // BLOCK) * BLOCK, OTHER, np.uint8)
    wide[:n] = s
    columns = np.ascontiguousarray(wide.reshape(-1, BLOCK).T).astype(np.int16) * STATES  # [place in block, block]
    whole = _composed(after, columns[-TAIL:])
    # where a block's end gives one state whatever comes before it, so does the block; the others are composed in full
    rest = np.flatnonzero((whole != whole[0]).any(0))
    if len(rest):
        whole[:, rest] = _composed(after, columns[:, rest])
    whole = np.ascontiguousarray(whole.T)
    step = 1
    while step < len(whole):  # compose over blocks: 1, 2, 4, ... blocks at a time
        whole = np.concatenate([whole[:step], np.take_along_axis(whole[step:], whole[:-step], 1)])
        step *= 2
    state = np.concatenate([np.zeros(1, np.intp), whole[:-1, FRESH]])
    flags = np.empty(columns.shape, bool)
    for i, column in enumerate(columns):
        at = column + state
        flags[i], state = starts.take(at), after.take(at)
    return np.flatnonzero(flags.T.ravel()[:n])


def _numbers(raw: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices of up to SHORT bytes as two numbers: their bytes, the rest zero, and their length in the last byte."""
    word = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    bits = 8 * sizes.astype(np.uint64)
    ones = ~np.uint64(0)
    low = word[at] & np.where(bits >= 64, ones, (np.uint64(1) << np.minimum(bits, np.uint64(63))) - np.uint64(1))
    rest = np.where(bits > 64, bits - np.minimum(bits, np.uint64(64)), np.uint64(0))
    high = word[np.minimum(at + 8, len(word) - 1)] & ((np.uint64(1) << rest) - np.uint64(1))
    return low, high | sizes.astype(np.uint64) << np.uint64(56)


def _mixed(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return mixed(low * np.uint64(0x9E3779B97F4A7C15) + mixed(high))


def _filter(pairs: np.ndarray) -> np.ndarray:
    """Where pairs, as one number each, are marked in a table of 1 << FILTER marks."""
    return (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - FILTER)).astype(np.intp)


class Codec(dict):
    """Slices to their ids, for one vocabulary file. Slices of up to SHORT bytes are two numbers, which hold their bytes and their
    length; a table keeps the ids of those met last, and new ones are merged together. Longer ones are kept in the dictionary; of
    those, new ones of up to LONG bytes are merged together too."""

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pieces = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece
        self.lengths = np.array([len(x) for x in self.pieces], np.int64)
        get = self.ranks.get
        # every pair of pieces that make a piece, as one number, in order, and the rank of what they make
        pairs = {a << 32 | b: rank for piece, rank in self.ranks.items() for k in range(1, len(piece))
                 if (a := get(piece[:k])) is not None and (b := get(piece[k:])) is not None}
        self.pairs = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(self.pairs)
        self.pairs, self.made = self.pairs[order], np.fromiter(pairs.values(), np.int32, len(pairs))[order]
        self.paired = np.zeros(1 << FILTER, bool)
        self.paired[_filter(self.pairs)] = True
        self.single = np.array([get(bytes([b]), -1) for b in range(256)], np.int32)
        self.double = self._rank(np.repeat(self.single, 256), np.tile(self.single, 256))
        # the short pieces themselves, in the order of their two numbers
        short = [x for x in self.ranks if len(x) <= SHORT]
        data = np.frombuffer(b"".join(short) + bytes(16), np.uint8)
        sizes = np.array([len(x) for x in short], np.int64)
        low, high = _numbers(data, np.cumsum(sizes) - sizes, sizes)
        key, rank = _mixed(low, high), np.array([self.ranks[x] for x in short], np.int32)
        order = np.argsort(key)
        self.whole = key[order], low[order], high[order], rank[order]
        self.forget()

    def forget(self) -> None:
        """Empties the table of short slices."""
        self.low, self.high = np.zeros((2, 1 << TABLE), np.uint64)
        self.start, self.many = np.zeros((2, 1 << TABLE), np.int32)
        self.store, self.used = np.zeros(1 << TABLE, np.int32), 0

    def _keep(self, ids: np.ndarray) -> int:
        """Appends ids to the store; where they start."""
        if self.used + len(ids) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros(max(len(ids), len(self.store)), np.int32)])
        at = self.used
        self.store[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of what two pieces make, NONE where they make none."""
        key = left.astype(np.int64) << 32 | right
        some = np.flatnonzero(self.paired[_filter(key)] & (left >= 0) & (right >= 0))  # most pairs make nothing
        at = np.minimum(np.searchsorted(self.pairs, key[some]), len(self.pairs) - 1)
        out = np.full(len(key), NONE, np.int32)
        out[some] = np.where(self.pairs[at] == key[some], self.made[at], np.int32(NONE))
        return out

    def merged_together(self, data: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges many slices, a row of bytes each: in every turn each row merges its pair of lowest rank, the leftmost of equal
        ones. Ids row by row, and how many a row has."""
        width, many = data.shape[1], many.copy()
        column = np.arange(width)
        ids = np.where(column < many[:, None], self.single[data], np.int32(-1))
        ranks = np.full(ids.shape, NONE, np.int32)
        pairs = self.double[data[:, :-1].astype(np.intp) << 8 | data[:, 1:]]
        ranks[:, :-1] = np.where(column[1:] < many[:, None], pairs, np.int32(NONE))
        rows, out = np.arange(len(ids)), np.full(ids.shape, -1, np.int32)
        while len(rows):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            done = best == NONE
            if done.any():
                out[rows[done], : ids.shape[1]] = ids[done]
                rows, ids, ranks, at, best = rows[~done], ids[~done], ranks[~done], at[~done], best[~done]
            # what lies behind the pair moves one place to the left
            every, back = np.arange(len(rows)), column[: ids.shape[1] - 1] >= at[:, None]
            fewer, less = ids[:, :-1].copy(), ranks[:, :-1].copy()
            np.copyto(fewer, ids[:, 1:], where=back)
            np.copyto(less, ranks[:, 1:], where=back)
            ids, ranks = fewer, less
            ids[every, at] = best
            many[rows] -= 1
            last = ids.shape[1] - 1
            after = np.where(at < last, ids[every, np.minimum(at + 1, last)], np.int32(-1))
            ranks[every, at] = self._rank(best, after)
            inner = at > 0
            ranks[every[inner], at[inner] - 1] = self._rank(ids[every[inner], at[inner] - 1], best[inner])
        return out, many

    def _new(self, raw: np.ndarray, at: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray, key: np.ndarray):
        """Ids of short slices that the table does not hold: (start in the store, how many) of each; they are put into the table."""
        order = np.lexsort((low, high))
        low, high, key = low[order], high[order], key[order]
        first = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
        group = np.zeros(len(order), np.int64)
        group[first[1:]] = 1
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(group)
        at, sizes, low, high, key = at[order][first], sizes[order][first], low[first], high[first], key[first]
        keys, lows, highs, ranks = self.whole
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        known = (lows[place] == low) & (highs[place] == high)
        many = np.ones(len(at), np.int64)
        start = np.empty(len(at), np.int64)
        start[known] = self._keep(ranks[place[known]]) + np.arange(known.sum())
        for width in (4, 8, 12, SHORT):  # slices of similar length together
            some = np.flatnonzero(~known & (sizes <= width) & (sizes > (width - 4 if width != SHORT else 12)))
            if len(some):
                ids, many[some] = self.merged_together(raw[at[some][:, None] + np.arange(width)], sizes[some])
                start[some] = self._keep(ids[np.arange(width) < many[some][:, None]]) + np.cumsum(many[some]) - many[some]
        slot = (key >> np.uint64(64 - TABLE)).astype(np.int64)
        self.low[slot], self.high[slot], self.start[slot], self.many[slot] = low, high, start, many
        return start[inverse], many[inverse]

    def ids_of(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the slices that start at `at` in raw (which ends in 16 zeros), and how many each has."""
        if self.used > STORED:
            self.forget()
        sizes = np.diff(at, append=len(raw) - 16)
        start, many = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        long = np.flatnonzero(sizes > SHORT)
        for some in (long[i : i + ROWS] for i in range(0, len(long), ROWS)):
            pieces = [raw[a : a + n].tobytes() for a, n in zip(at[some].tolist(), sizes[some].tolist())]
            self._learn({x for x in pieces if len(x) <= LONG and x not in self and x not in self.ranks})
            for k, piece in zip(some.tolist(), pieces):
                ids = self[piece]
                start[k], many[k] = self._keep(np.array(ids, np.int64)), len(ids)
        short = np.flatnonzero(sizes <= SHORT)
        low, high = _numbers(raw, at[short], sizes[short])
        key = _mixed(low, high)
        slot = (key >> np.uint64(64 - TABLE)).astype(np.int64)
        start[short], many[short] = self.start[slot], self.many[slot]
        miss = np.flatnonzero((self.low[slot] != low) | (self.high[slot] != high))
        if len(miss):
            new = short[miss]
            start[new], many[new] = self._new(raw, at[new], sizes[new], low[miss], high[miss], key[miss])
        total = np.cumsum(many)
        index = np.repeat(start - total + many, many) + np.arange(total[-1] if len(total) else 0)
        return self.store[index], many

    def _learn(self, pieces: set[bytes]) -> None:
        """Merges new slices of up to LONG bytes together and keeps their ids."""
        if len(self) + len(pieces) > CACHE:
            self.clear()
        for width in range(SHORT + 8, LONG + 8, 8):  # slices of similar length together
            some = [x for x in pieces if width - 8 < len(x) <= width]
            if some:
                data = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in some), np.uint8).reshape(-1, width)
                ids, many = self.merged_together(data, np.array([len(x) for x in some]))
                self.update((x, tuple(row[:n])) for x, row, n in zip(some, ids.tolist(), many.tolist()))

    def __missing__(self, piece: bytes) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        whole = self.ranks.get(piece)
        ids = (whole,) if whole is not None else self.merged(piece)
        if len(piece) <= 200:
            self[piece] = ids
        return ids

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Merges the pair of lowest rank, leftmost first, until none is left; a heap keeps long slices at n log n."""
        n, ranks = len(piece), self.ranks
        end = list(range(1, n + 1))  # where the part that starts here ends; 0 once it is merged into another
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if i and (r := ranks.get(piece[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encode(self, texts: list[str]):
        """The ids of each text, in order."""
        for ids in self.encoded(texts):
            yield ids.tolist()

    def encoded(self, texts: list[str]):
        """The ids of each text, in order, as arrays."""
        for part in in_chunks(texts, len, CHUNK):
            joined = "".join(part)
            stops = np.cumsum([len(t) for t in part])
            codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            if not len(codes):
                yield from (np.empty(0, np.int64) for _ in part)
                continue
            first = np.unique(np.concatenate([[0], stops[:-1]]))
            starts = slice_starts(symbols(codes, first[first < len(codes)]))
            raw = np.frombuffer(joined.encode() + bytes(16), np.uint8)
            at = starts
            if len(raw) != len(codes) + 16:
                width = np.ones(len(codes), np.uint8)
                for bound in (0x80, 0x800, 0x10000):
                    width += codes >= bound
                at = np.cumsum(width, dtype=np.int64)[starts] - width[starts]
            ids, many = self.ids_of(raw, at)
            ends = np.concatenate([[0], np.cumsum(many)])
            yield from np.split(ids, ends[np.searchsorted(starts, stops)][:-1])

    def decode(self, ids) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))

    def offsets(self, ids) -> np.ndarray:
        """Where each id's bytes start."""
        lengths = self.lengths[np.asarray(ids, np.int64)]
        return np.cumsum(lengths) - lengths


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids, offsets) of every text; the vocabulary file is read at the same path on every executor."""
    tell_workers(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    def run(batches):
        c = codec(path)
        for docs, texts in _pieces(batches, c):
            ids = list(c.encoded(texts))
            yield pd.DataFrame({"doc_id": docs, "ids": ids, "offsets": [c.offsets(x) for x in ids]})

    return _texts(docs).mapInPandas(run, "doc_id long, ids array<int>, offsets array<long>")


def checked(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, exact) of every text; exact: the decoded ids are the text again."""
    tell_workers(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    def run(batches):
        c = codec(path)
        for docs, texts in _pieces(batches, c):
            ids = list(c.encoded(texts))
            yield pd.DataFrame({"doc_id": docs, "n_tokens": list(map(len, ids)), "ids": ids, "exact": [c.decode(x) == t.encode() for x, t in zip(ids, texts)]})

    return _texts(docs).mapInPandas(run, "doc_id long, n_tokens long, ids array<int>, exact boolean")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, bytes) of encoded ids."""
    tell_workers(encoded.sparkSession)
    path = vocabulary or default_vocabulary()

    def run(batches):
        c = codec(path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "bytes": [c.decode(x) for x in batch["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Encodes every text and decodes its ids in the same task: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    tell_workers(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    def run(batches):
        c = codec(path)
        for docs, texts in _pieces(batches, c):
            rows = []
            for ids in c.encode(texts):
                listed = ",".join(map(str, ids)).encode()
                rows.append((len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", docs.array)
            yield out

    return _texts(docs).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _pieces(batches, c: Codec):
    """(ids, texts) of about CHUNK characters at a time, so that a batch's results are never held at once."""
    for batch in batches:
        at = 0
        for part in in_chunks(batch["text"].tolist(), len, CHUNK):
            yield batch["doc_id"].iloc[at : at + len(part)].reset_index(drop=True), part
            at += len(part)
    if len(c) > KEPT:
        c.clear()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(table(spark, folder, "documents"))
