"""Byte-level BPE as a finite-state transducer, and decoding as a stream of UTF-8.

A token sequence is the encoding of its bytes exactly if every two neighbours are: merging the bytes of both must give the two
again. So every prefix of a piece has one last token, and a machine needs to remember only the places from which a longer token may
still grow: for each the node it has reached in the tree of tokens, the last token before the place, and the tokens not yet given
out. Reading a byte moves all nodes on; of the tokens that end there the one that fits its predecessor is the last token
of the new prefix. What all remaining places have in common is given out. No place lasts longer than the longest token, so the
lookahead is bounded. Such sets are the states of a deterministic transducer; they are made when first met and kept.

Whether two tokens fit follows from the merges at their border: the parts that meet there live from the rank that makes them to the
rank that merges them further, and a merge across the border happens if its rank comes before both.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .registry import query, table

RANKS = "byte_bpe_multi_50k.tiktoken"
KEPT_PIECES = 200_000
LONGEST_KEPT = 100
KEPT_STATES = 250_000
LONG_TEXT = 1 << 20
OUTPUT_BITS = 20
OUTPUT_MASK = (1 << OUTPUT_BITS) - 1
SLICE = 1 << 16
STEP_BYTES = 16 << 20
NEVER = 1 << 62


class Merges:
    """What the ranks say of single tokens and of neighbours."""
    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self._edges: dict[int, tuple[list, list, bool] | None] = {}
        self._fits: dict[int, bool] = {}

    def merge(self, piece: bytes) -> list[bytes]:
        """The parts that remain when always the first pair of lowest rank is merged."""
        return self._merged(piece)[0]

    def _merged(self, piece: bytes) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
        parts, pair = [piece[i:i + 1] for i in range(len(piece))], None
        while len(parts) > 1:
            ranked = [(self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(ranked)
            if rank == NEVER:
                break
            pair = parts[i], parts[i + 1]
            parts[i:i + 2] = [pair[0] + pair[1]]
        return parts, pair

    def edges(self, token: int) -> tuple[list, list, bool] | None:
        """(part, rank that merges it further) along the left and the right edge, from the byte up, and whether these ranks rise.

        None if merges don't give the token.
        """
        if token in self._edges:
            return self._edges[token]
        word = self.bytes_of[token]
        out = None
        if len(word) == 1:
            out = [(word, NEVER)], [(word, NEVER)], True
        else:
            parts, pair = self._merged(word)
            halves = [self.edges(self.ranks[h]) for h in pair] if len(parts) == 1 else [None]
            if None not in halves:
                left, right = halves[0][0], halves[1][1]
                out = [*left[:-1], (left[-1][0], token), (word, NEVER)], [*right[:-1], (right[-1][0], token), (word, NEVER)], all(
                    h[2] and self.ranks[p] < token for h, p in zip(halves, pair) if len(p) > 1)
        self._edges[token] = out
        return out

    def forget(self) -> None:
        """Drop the pairs looked at so far."""
        self._fits.clear()

    def fits(self, a: int, b: int) -> bool:
        """Do the merges of the bytes of both tokens give the two tokens? With -1 for ``a``: do they give ``b`` alone?"""
        key = a << 32 | b
        known = self._fits.get(key)
        if known is None:
            known = self._fits[key] = self._compare(a, b)
        return known

    def _compare(self, a: int, b: int) -> bool:
        if a < 0 or self.edges(b) is None:
            return self.edges(b) is not None
        (_, left, a_rises), (right, _, b_rises) = self.edges(a), self.edges(b)
        if not (a_rises and b_rises):  # merges out of the order of ranks
            return self.merge(self.bytes_of[a] + self.bytes_of[b]) == [self.bytes_of[a], self.bytes_of[b]]
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            rank = self.ranks.get(x + y, NEVER)
            if rank < x_ends and rank <= y_ends and rank != NEVER:  # at equal rank the pair further left goes first
                return False
            if x_ends == y_ends == NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1


class Transducer:
    """Pieces to token ids; states are made when first met, at most ``kept`` of them at a time.

    A state is a row of whole numbers: for each place, oldest first, its node, the last token before it, how many tokens it holds back, and
    those. Moves are kept by (state, byte) as (next state, what is given out).
    """
    def __init__(self, ranks: dict[bytes, int], kept: int = KEPT_STATES):
        if kept >= 1 << OUTPUT_BITS:
            raise ValueError(f"more than {(1 << OUTPUT_BITS) - 1} states cannot be kept")
        self.merges, self.kept = Merges(ranks), kept
        self.child: dict[int, int] = {}
        self.ends, self.grows = [-1], bytearray(1)
        for word, token in ranks.items():
            node = 0
            for b in word:
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    nxt = self.child[node << 8 | b] = len(self.ends)
                    self.ends.append(-1)
                    self.grows.append(0)
                    self.grows[node] = 1
                node = nxt
            self.ends[node] = token
        self.moves: dict[int, int] = {}
        self.states: dict[tuple[int, ...], int] = {}
        self.rows: list[tuple[int, ...]] = []
        self.tails: list[int] = []
        self.outputs: list[tuple[int, ...]] = []
        self.output_of: dict[tuple[int, ...], int] = {}
        self._clear()

    def _clear(self) -> None:
        for kept in (self.moves, self.states, self.rows, self.tails, self.outputs, self.output_of):
            kept.clear()
        self.merges.forget()
        self._output(())
        self._state((0, -1, 0), ())

    def _output(self, tokens: tuple[int, ...]) -> int:
        number = self.output_of.setdefault(tokens, len(self.outputs))
        if number == len(self.outputs):
            self.outputs.append(tokens)
        return number

    def _state(self, row: tuple[int, ...], tail: tuple[int, ...]) -> int:
        number = self.states.setdefault(row, len(self.rows))
        if number == len(self.rows):
            self.rows.append(row)
            self.tails.append(self._output(tail))
        return number

    def _move(self, state: int, byte: int) -> int:
        row, child, ends, grows, fits = self.rows[state], self.child, self.ends, self.grows, self.merges.fits
        places, ended, at, size = [], None, 0, len(row)
        while at < size:
            node = child.get(row[at] << 8 | byte)
            begin = at + 3
            at = begin + row[at + 2]
            if node is None:
                continue
            if ended is None and ends[node] >= 0 and fits(row[begin - 2], ends[node]):
                ended = (0, ends[node], (*row[begin:at], ends[node]))
            if grows[node]:
                places.append((node, row[begin - 2], row[begin:at]))
        if ended is None:
            raise ValueError("a prefix has no encoding")
        places.append(ended)
        shared, first = 0, places[0][2]
        while shared < len(first) and all([len(p[2]) > shared and p[2][shared] == first[shared] for p in places]):
            shared += 1
        nxt = []
        for node, last, held in places:
            nxt += (node, last, len(held) - shared, *held[shared:])
        full = len(self.rows) >= self.kept
        if full:
            self._clear()
        move = self._state(tuple(nxt), ended[2][shared:]) << OUTPUT_BITS | self._output(first[:shared])
        if not full:  # else the state that was left is gone
            self.moves[state << 8 | byte] = move
        return move

    def tokens(self, piece: bytes) -> Iterator[tuple[int, ...]]:
        """Tokens of a piece, given out as soon as nothing that follows can change them: once for each byte, and at the end."""
        state = 0
        for b in piece:
            move = self.moves.get(state << 8 | b)
            move = self._move(state, b) if move is None else move
            state = move >> OUTPUT_BITS
            yield self.outputs[move & OUTPUT_MASK]
        yield self.outputs[self.tails[state]]

    def encode(self, piece: bytes) -> list[int]:
        """All tokens of a piece; a piece that is a token as a whole is that token, whatever the merges give."""
        whole = self.merges.ranks.get(piece)
        if whole is not None:
            return [whole]
        state, out, get, outputs = 0, [], self.moves.get, self.outputs
        for b in piece:  # as in ``tokens``
            move = get(state << 8 | b)
            if move is None:
                move = self._move(state, b)
            state = move >> OUTPUT_BITS
            given = move & OUTPUT_MASK
            if given:
                out += outputs[given]
        out += outputs[self.tails[state]]
        return out


def _ranges(chars: set[str]) -> str:
    points = set(map(ord, chars))
    starts = sorted(p for p in points if p - 1 not in points)
    ends = sorted(p for p in points if p + 1 not in points)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))


class Splitter:
    """Matches of the vocabulary's pattern, as the library of the rank files finds them.

    Its tables of letters, numbers and blanks can be of another Unicode version than Python's, so it is asked for them once, and the pattern is
    written out with them. Ranges beyond 16 bits are tried one after the other, so they stand in a pattern of their own, for texts that need it.
    """
    CLASSES = (r"\p{L}", r"\p{N}", r"\s")

    def __init__(self, pattern: str):
        import tiktoken

        single = {bytes([b]): b for b in range(256)}
        known: dict[str, set[str]] = {}
        chars = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
        for name in self.CLASSES:
            library = tiktoken.Encoding("classes", pat_str=name + "+", mergeable_ranks=single, special_tokens={})
            known[name] = set(library.decode([t for at in range(0, len(chars), 1 << 16) for t in library.encode_ordinary(chars[at:at + (1 << 16)])]))
        self.ascii, self.low, self.full = (re.compile(self._written(pattern, known, end)) for end in (0x80, 0x10000, 0x110000))
        self.beyond = re.compile("[\U00010000-\U0010ffff]")

    def _written(self, pattern: str, known: dict[str, set[str]], end: int) -> str:
        """The pattern with the members of each class below ``end``."""
        inside = {name: _ranges({c for c in chars if ord(c) < end}) for name, chars in known.items()}
        out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{''.join(inside.values())}]").replace(r"\S", f"[^{inside[r'\s']}]")
        for name, members in inside.items():
            out = out.replace(name, f"[{members}]")
        return out

    def __call__(self, text: str) -> Iterator[str]:
        """The pieces of a text, one after the other if it is long."""
        use = self.ascii if text.isascii() else self.full if self.beyond.search(text) else self.low
        return iter(use.findall(text)) if len(text) <= LONG_TEXT else (m.group() for m in use.finditer(text))


class _Memo(dict):
    """Values of texts. Beyond ``kept`` of them a new generation begins; those still in use are taken over from the last one."""
    def __init__(self, make: Callable[[str], bytes], kept: int):
        super().__init__()
        self.make, self.kept, self.old = make, kept, {}

    def __missing__(self, text: str) -> bytes:
        value = self.old.get(text)
        if value is None:
            value = self.make(text)
        if len(text) <= LONGEST_KEPT:
            if len(self) >= self.kept:
                self.old = dict(self)
                self.clear()
            self[text] = value
        return value


class Encoder:
    """Texts to token ids; pieces that come again, mostly words, are looked up, others go through the machine."""
    def __init__(self, ranks: dict[bytes, int], pattern: str, kept: int = KEPT_PIECES, kept_states: int = KEPT_STATES):
        self.machine, self.split = Transducer(ranks, kept_states), Splitter(pattern)
        self.pieces = _Memo(lambda piece: array("i", self.machine.encode(piece.encode())).tobytes(), kept)

    def __call__(self, text: str) -> bytes:
        """Native 32-bit ids."""
        ids = map(self.pieces.__getitem__, self.split(text))
        if len(text) <= LONG_TEXT:
            return b"".join(ids)
        out = bytearray()
        for one in ids:
            out += one
        return bytes(out)


# states of the UTF-8 machine: START, then by the continuation bytes that must follow, the first of them being restricted in the last four
START, ONE, TWO, THREE, AFTER_E0, AFTER_ED, AFTER_F0, AFTER_F4, BAD = range(9)
REPLACEMENT = "�".encode()
HIGH = re.compile(rb"[\x80-\xff]+")


def _utf8_table() -> list[bytes]:
    rows = [bytearray([BAD]) * 256 for _ in range(BAD)]

    def allow(state: int, first: int, last: int, to: int) -> None:
        for b in range(first, last + 1):
            rows[state][b] = to

    allow(START, 0x00, 0x7F, START)
    allow(START, 0xC2, 0xDF, ONE)
    allow(START, 0xE1, 0xEF, TWO)
    allow(START, 0xE0, 0xE0, AFTER_E0)
    allow(START, 0xED, 0xED, AFTER_ED)
    allow(START, 0xF1, 0xF3, THREE)
    allow(START, 0xF0, 0xF0, AFTER_F0)
    allow(START, 0xF4, 0xF4, AFTER_F4)
    allow(ONE, 0x80, 0xBF, START)
    allow(TWO, 0x80, 0xBF, ONE)
    allow(THREE, 0x80, 0xBF, TWO)
    allow(AFTER_E0, 0xA0, 0xBF, ONE)
    allow(AFTER_ED, 0x80, 0x9F, ONE)
    allow(AFTER_F0, 0x90, 0xBF, TWO)
    allow(AFTER_F4, 0x80, 0x8F, TWO)
    return [bytes(r) for r in rows]


UTF8 = _utf8_table()


class Utf8Stream:
    """Bytes in, whole characters out (as UTF-8); what does not form a character becomes U+FFFD, one for each longest beginning of one."""
    def __init__(self) -> None:
        self.state, self.held = START, b""

    def feed(self, data: bytes) -> bytes:
        out: list[bytes] = []
        state, held, at = self.state, self.held, 0
        for run in HIGH.finditer(data):
            i, end = run.span()
            if at < i:  # a span of ASCII
                if state:
                    out.append(REPLACEMENT)
                    state, held = START, b""
                out.append(data[at:i])
            whole = begin = i  # data[begin:whole] are whole characters, with `held` before them
            while i < end:
                nxt = UTF8[state][data[i]]
                if nxt != BAD:
                    state = nxt
                    i += 1
                    if not state:
                        whole = i
                    continue
                if whole > begin:
                    out += [held, data[begin:whole]]
                if not state:  # the byte cannot begin a character
                    i += 1
                out.append(REPLACEMENT)
                state, held, begin, whole = START, b"", i, i
            if whole > begin:
                out += [held, data[begin:whole]]
                held = b""
            held, at = held + data[whole:end], end
        if at < len(data):
            if state:
                out.append(REPLACEMENT)
                state, held = START, b""
            out.append(data[at:])
        self.state, self.held = state, held
        return b"".join(out)

    def finish(self) -> bytes:
        """What is held back at the end."""
        out = REPLACEMENT if self.state else b""
        self.state, self.held = START, b""
        return out


def read_ranks(name: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file of the public tokenizers, or of any path."""
    import public_tokenizers

    with open(name if "/" in name else public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_encoders: dict[str, Encoder] = {}
_words: dict[str, Vocabulary] = {}


def _encoder(name: str) -> Encoder:
    if name not in _encoders:
        import public_tokenizers
        _encoders[name] = Encoder(read_ranks(name), public_tokenizers.PATTERN)
    return _encoders[name]


class Vocabulary:
    """Bytes of each id; ids between that the vocabulary lacks become U+FFFD, as does the last entry, which stands for all others.

    ``whole`` marks the ids whose bytes take the UTF-8 machine from its start back to its start, all of them being characters.
    """
    def __init__(self, ranks: dict[bytes, int]):
        words = [REPLACEMENT] * (max(ranks.values()) + 2)
        for w, i in ranks.items():
            words[i] = w
        stream, self.last = Utf8Stream(), len(words) - 1
        self.words = pa.array(words, pa.binary())
        self.whole = np.array([stream.feed(w) + stream.finish() == w for w in words])

    def join(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all ids, and where each begins, with the end."""
        _, ends, data = self.words.take(pa.array(ids)).buffers()
        at = np.frombuffer(ends, np.int32)[:len(ids) + 1]
        return data[:int(at[-1])].to_pybytes(), at


def _vocabulary(name: str) -> Vocabulary:
    if name not in _words:
        _words[name] = Vocabulary(read_ranks(name))
    return _words[name]


def _text_of(ids: np.ndarray, words: Vocabulary) -> bytes:
    """The text of token ids as UTF-8, read in slices of bounded size.

    Only runs of tokens that are not whole characters go through the machine byte by byte. A whole token behind such a run ends it: its first
    byte begins a character, so what is still open cannot be finished.
    """
    stream, parts = Utf8Stream(), []
    for lo in range(0, len(ids), SLICE):
        some = ids[lo:lo + SLICE]
        some = np.where((some < 0) | (some > words.last), words.last, some)
        data, at = words.join(some)
        broken = ~words.whole[some]
        if not broken[0]:
            parts.append(stream.finish())
        if not broken.any():
            parts.append(data)
            continue
        turns = np.flatnonzero(broken[1:] != broken[:-1]) + 1
        begin, odd = 0, bool(broken[0])
        for end in [*at[turns].tolist(), len(data)]:
            parts.append(stream.feed(data[begin:end]) if odd else data[begin:end])
            if odd and end < len(data):
                parts.append(stream.finish())
            begin, odd = end, not odd
    parts.append(stream.finish())
    return b"".join(parts)


def _strings(texts: list[bytes]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(b"".join(texts))).cast(pa.string())


def encode(docs: DataFrame, ranks: str = RANKS, decoded: bool = False) -> DataFrame:
    """``doc_id`` and ``ids`` of every row: the tokens of each match of the pattern, one behind the other, without special tokens.

    A null text is empty and has no ids. Null ids and repeated rows are rows like any others; no rows give none; other columns are ignored.
    With ``decoded`` also that column: the text that the ids give back, decoded in the same task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, words = _encoder(ranks), _vocabulary(ranks) if decoded else None

        def packed(b: pa.RecordBatch, lo: int, rows: list[bytes], texts: list[bytes]) -> pa.RecordBatch:
            ends = np.concatenate(([0], np.cumsum([len(r) // 4 for r in rows])))
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(rows))])
            columns = [b.column(0).slice(lo, len(rows)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)]
            return pa.RecordBatch.from_arrays(columns + [_strings(texts)] * decoded, names=["doc_id", "ids"] + ["decoded"] * decoded)

        for b in batches:
            rows, texts, lo, size = [], [], 0, 0
            for i, text in enumerate(b.column(1)):
                rows.append(code(text.as_py() or ""))
                size += len(rows[-1])
                if decoded:
                    texts.append(_text_of(np.frombuffer(rows[-1], dtype=np.int32), words))
                    size += len(texts[-1])
                if size > STEP_BYTES:
                    yield packed(b, lo, rows, texts)
                    rows, texts, lo, size = [], [], i + 1, 0
            if rows:
                yield packed(b, lo, rows, texts)

    two = docs.select("doc_id", "text")
    return two.mapInArrow(run, f"doc_id {two.schema['doc_id'].dataType.simpleString()}, ids array<int>" + ", decoded string" * decoded)


def decode(coded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """The columns of ``coded`` with ``text`` in place of ``ids``.

    Ids are read in slices of bounded size. Bytes that form no character become U+FFFD, as does an id that the vocabulary
    lacks; a null id is nothing, a null array the empty text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _vocabulary(ranks)

        def packed(b: pa.RecordBatch, lo: int, texts: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(c.slice(lo, len(texts)) for c in b.columns[:-1]), _strings(texts)], names=[*b.schema.names[:-1], "text"])

        for b in batches:
            texts, lo, size = [], 0, 0
            for i, row in enumerate(b.column(b.num_columns - 1)):
                texts.append(_text_of(np.asarray(row.values.drop_null()), words) if row.is_valid else b"")
                size += len(texts[-1])
                if size > STEP_BYTES:
                    yield packed(b, lo, texts)
                    texts, lo, size = [], i + 1, 0
            if texts:
                yield packed(b, lo, texts)

    others = [c for c in coded.columns if c != "ids"]
    ready = coded.select(*others, F.col("ids").cast("array<int>").alias("ids"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in ready.schema.fields[:-1])
    return ready.mapInArrow(run, f"{kinds}text string")


@query("op13_transducer_bpe")
def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents"), decoded=True)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
