"""Byte-level BPE encoding and decoding.

Encoding is a finite-state transduction. A list of tokens is the result of the
merges exactly if each token is the result of merging its own bytes and each
two neighbours are the result of merging their joined bytes (no merge ever
crosses a border between them). So a nondeterministic transducer that reads a
text as any chain of vocabulary tokens, and drops a chain at the first pair of
neighbours that would not stay apart, accepts one chain: the encoding.

``Transducer`` determinises it lazily, byte by byte: a state is the set of open
hypotheses (last token, place in the vocabulary trie). At most one chain ends at
any byte, so a transition puts out the last token of that chain, or none, and
the tokens are read back from the end: a state needs no tokens of its own, and
texts that differ only in tokens further back share it. In a long text
the tokens that all hypotheses share leave after each block. States, transitions
and pair checks are computed when first met and kept up to a bound, then computed anew.

Decoding joins the tokens' bytes and passes them through an incremental UTF-8
state machine, so a stream of ids can be cut anywhere.

Defined cases: null and empty texts have no tokens. Long texts are encoded and
decoded piece by piece with bounded memory. Repeated rows and null ids are rows
like others; other columns are ignored and cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hunkline.llm.runtime import arrow_map, fields

OPEN = -1                   # key of a state's hypotheses
NEVER = 1 << 62             # a rank after all ranks
NODE = (1 << 32) - 1        # a hypothesis: its last token plus 1, times 2^32, plus its node
STATE_LIMIT = 130_000       # determinised states kept
PAIR_LIMIT = 300_000        # pair checks kept
PIECE_LIMIT = 220_000       # encoded pieces kept, in each of two generations
ROWS = 500                  # rows of an output batch
BLOCK = 50_000              # pieces, ids or bytes of a piece handled at a time


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank file: a base64 token and its rank on each line."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


class Transducer:
    ROOT = 0

    def __init__(self, ranks: dict[bytes, int], tables: float = 1.0) -> None:
        self.ranks, self.tables = ranks, tables
        self.tokens = {r: t for t, r in ranks.items()}
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        self.token_at, self.depth = [-1], [0]  # by node
        for token, rank in ranks.items():
            at = self.ROOT
            for byte in token:
                key = at << 8 | byte
                if key not in self.child:
                    self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.depth.append(self.depth[at] + 1)
                at = self.child[key]
            self.token_at[at] = rank
        self.inner = bytearray(len(self.token_at))  # nodes that go on
        for key in self.child:
            self.inner[key >> 8] = 1
        self.history: dict[int, tuple | None] = {}
        self.apart: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        # a state maps a byte to (next state, token that ends there or -1), and OPEN to its hypotheses
        self.states: dict[tuple[int, ...], dict] = {}
        self.start = self._state((self.ROOT,))

    def _state(self, hypotheses: tuple[int, ...]) -> dict:
        state = self.states.get(hypotheses)
        if state is None:
            state = self.states[hypotheses] = {OPEN: hypotheses}
        return state

    def _merges(self, text: bytes) -> tuple[list[bytes], list[tuple[int, bytes, bytes]]]:
        """The merges applied one by one, lowest rank first, leftmost first:
        the parts left, and after each merge its rank and the outer parts."""
        parts, log = [text[i:i + 1] for i in range(len(text))], []
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            log.append((best, parts[0], parts[-1]))
        return parts, log

    def _history(self, token: int) -> tuple[list[int], list[bytes], list[bytes]] | None:
        """How the token comes about from its bytes: ranks of its merges (then
        one that is never reached), its first part and its last part before
        each. None if its bytes do not merge into it."""
        if token not in self.history:
            text = self.tokens[token]
            parts, log = self._merges(text)
            self.history[token] = None if len(parts) > 1 else (
                [x[0] for x in log] + [NEVER], [text[:1]] + [x[1] for x in log], [text[-1:]] + [x[2] for x in log])
        return self.history[token]

    def _apart(self, before: int, token: int) -> bool:
        """Whether merging the joined bytes leaves the two tokens: their own
        merges happen in the order of rank, on a tie the left one first, and
        at no moment is a merge across the border the next one."""
        (left, _, last), (right, first, _) = self._history(before), self._history(token)
        i = j = 0
        while True:
            a, b = left[i], right[j]
            across = self.ranks.get(last[i] + first[j])
            if across is not None and across < a and across <= b:
                return False
            if a == b == NEVER:
                return True
            if a <= b:
                i += 1
            else:
                j += 1

    def follows(self, before: int, token: int) -> bool:
        """Whether the token can stand in an encoding, and stand after ``before``."""
        key = before << 32 | token
        ok = self.apart.get(key)
        if ok is None:
            if len(self.apart) >= PAIR_LIMIT * self.tables:
                self.apart.clear()
            ok = self.apart[key] = self._history(token) is not None and (before < 0 or self._apart(before, token))
        return ok

    def _step(self, state: dict, byte: int) -> tuple[dict, int]:
        """Hypotheses stand in the order of their start, so the longest open
        token comes first; at most one token can end here, see above."""
        out, ended = [], -1
        child, inner, token_at = self.child, self.inner, self.token_at
        for h in state[OPEN]:
            node = h & NODE
            to = child.get(node << 8 | byte)
            if to is None:
                continue
            if inner[to]:
                out.append(h - node + to)
            if ended < 0 and (token := token_at[to]) >= 0 and self.follows((h >> 32) - 1, token):
                ended = token
        if ended >= 0:
            out.append(ended + 1 << 32 | self.ROOT)
        if not out:
            raise ValueError(f"the vocabulary has no token for byte {byte} here")
        return self._state(tuple(out)), ended

    def _chain(self, ends: list[int], place: int) -> list[int]:
        """The one chain of tokens that ends at a place."""
        ids: list[int] = []
        while place:
            token = ends[place - 1]
            ids.append(token)
            place -= len(self.tokens[token])
        return ids[::-1]

    def _shared(self, ends: list[int], state: dict) -> int:
        """The last place that the chains of all open hypotheses pass."""
        places = {len(ends) - self.depth[h & NODE] for h in state[OPEN]}
        while len(places) > 1:
            place = max(places)
            places.remove(place)
            places.add(place - len(self.tokens[ends[place - 1]]))
        return places.pop()

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one match of the splitting pattern."""
        if piece in self.ranks:  # a vocabulary entry stands for itself
            return [self.ranks[piece]]
        ids: list[int] = []
        ends: list[int] = []  # the token that ends after each byte, or -1
        state = self.start
        for at in range(0, len(piece), BLOCK):
            if at:
                place = self._shared(ends, state)
                ids += self._chain(ends, place)
                del ends[:place]
            if len(self.states) > STATE_LIMIT * self.tables:
                hypotheses = state[OPEN]
                self._reset()
                state = self._state(hypotheses)
            for byte in piece[at:at + BLOCK]:
                step = state.get(byte)
                if step is None:
                    step = state[byte] = self._step(state, byte)
                state, token = step
                ends.append(token)
        if ends and ends[-1] < 0:
            raise ValueError("the vocabulary does not cover this text")
        return ids + self._chain(ends, len(ends))


class Utf8Stream:
    """Incremental UTF-8 decoding: bytes come in any cuts, whole characters go
    out. Between calls it keeps a state: the bytes of an unfinished character
    and how many continuation bytes it still needs."""

    def __init__(self, errors: str = "replace") -> None:
        self.errors, self.held, self.need = errors, b"", 0

    @staticmethod
    def _needs(lead: int) -> int:
        return 0 if lead < 0xC2 else 1 if lead < 0xE0 else 2 if lead < 0xF0 else 3 if lead < 0xF5 else 0

    def feed(self, data: bytes) -> str:
        at = 0
        while self.need and at < len(data):  # finish the open character
            if data[at] & 0xC0 != 0x80:
                self.need = 0  # broken off: the decoder below marks it
                break
            self.held, self.need, at = self.held + data[at:at + 1], self.need - 1, at + 1
        if self.need:
            return ""
        data, self.held = self.held + data[at:], b""
        for back in range(1, min(3, len(data)) + 1):  # an unfinished character at the end
            lead = data[-back]
            if lead & 0xC0 != 0x80:
                if self._needs(lead) >= back:
                    self.held, self.need = data[-back:], self._needs(lead) - back + 1
                    data = data[:-back]
                break
        return data.decode("utf-8", self.errors)

    def end(self) -> str:
        data, self.held, self.need = self.held, b"", 0
        return data.decode("utf-8", self.errors)


class Codec:
    """Encoder and decoder for one rank file and splitting pattern; ``tables``
    scales the bounds of the tables that it keeps, never the result."""

    def __init__(self, path: str, pattern: str, tables: float = 1.0) -> None:
        import regex

        self.machine = Transducer(read_ranks(path), tables)
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.table = [self.machine.tokens.get(i, b"") for i in range(max(self.machine.tokens, default=-1) + 1)]

    def _piece(self, piece: str) -> bytes:
        raw = self.older.get(piece)
        if raw is None:
            raw = np.array(self.machine.encode(piece.encode()), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self.known) >= PIECE_LIMIT * self.machine.tables:
                # pieces met again since then move on to the new generation
                self.older, self.known = self.known, {}
            self.known[piece] = raw
        return raw

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids of a text as little-endian unsigned 32-bit integers, in blocks."""
        matches = iter(self.pattern.findall(text)) if len(text) < 1 << 20 else (m.group() for m in self.pattern.finditer(text))
        while pieces := list(islice(matches, BLOCK)):
            known = self.known
            yield b"".join([known.get(p) or self._piece(p) for p in pieces])

    def decode_bytes(self, raw: bytes) -> Iterator[bytes]:
        for i in range(0, len(raw), 4 * BLOCK):
            yield b"".join(map(self.table.__getitem__, np.frombuffer(raw[i:i + 4 * BLOCK], "<u4").tolist()))

    def decode(self, ids: Iterable[int], errors: str = "replace") -> Iterator[str]:
        """Text of a stream of ids, in parts that end between characters."""
        stream, ids = Utf8Stream(errors), iter(ids)
        while block := list(islice(ids, BLOCK)):
            yield stream.feed(b"".join([self.table[i] for i in block]))
        yield stream.end()


_CODECS: dict[tuple[str, str, float], Codec] = {}


def codec(path: str, pattern: str, tables: float = 1.0) -> Codec:
    if (path, pattern, tables) not in _CODECS:
        _CODECS[path, pattern, tables] = Codec(path, pattern, tables)
    return _CODECS[path, pattern, tables]


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text",
           with_ids: bool = False, tables: float = 1.0) -> DataFrame:
    """One row per row of ``df``: id, n_tokens, ids_sha256 (of the ids as
    little-endian unsigned 32-bit integers), decoded_sha256 (of the text that the
    ids decode to), and the ids themselves if asked for. ``tables`` below 1 trades
    time for memory of the tasks, above 1 memory for time."""
    rows = df.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(id_col).alias("id"))
    schema = fields((id_col, df.schema[id_col].dataType), ("n_tokens", T.LongType()),
                    ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()),
                    *([("ids", T.ArrayType(T.IntegerType()))] if with_ids else []))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hunkline.llm import bpe

        c = bpe.codec(path, pattern, tables)
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            counts, ids_hash, text_hash, blocks = [], [], [], []
            for value in batch.column(0):
                n, left, right, stream, own = 0, hashlib.sha256(), hashlib.sha256(), Utf8Stream("strict"), []
                for raw in c.encode(value.as_py()):
                    n += len(raw) // 4
                    left.update(raw)
                    for part in c.decode_bytes(raw):
                        right.update(stream.feed(part).encode())
                    if with_ids:
                        own.append(raw)
                right.update(stream.end().encode())
                counts.append(n)
                ids_hash.append(left.hexdigest())
                text_hash.append(right.hexdigest())
                blocks += own
            cols = [batch.column(1), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            if with_ids:
                flat = np.frombuffer(b"".join(blocks), "<i4")
                cols.append(pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), flat))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return arrow_map(rows, task, schema)


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Texts of columns of ids: id, text. Null ids give a null text."""
    rows = df.select(F.col(ids).cast("array<int>").alias("ids"), F.col(id_col).alias("id"))
    schema = fields((id_col, df.schema[id_col].dataType), ("text", T.StringType()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hunkline.llm import bpe

        c = bpe.codec(path, pattern)
        for batch in batches:
            texts = [None if x is None else "".join(c.decode(x)) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(1)][::-1], names=schema.names)

    return arrow_map(rows, task, schema)
