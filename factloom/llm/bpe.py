"""Operator 1: byte-level BPE as a lazily determinised finite-state transducer.

The merges decide, for every prefix of a piece, one last token: the longest token that ends there and may follow
the last token of the prefix before it (two tokens may stand side by side when BPE, run on their joined bytes,
gives just these two). A state of the transducer is what later bytes can still depend on: the last token at the
settled position and the last tokens at the positions after it. States and transitions are made when first met
and kept. A position is settled, and the tokens before it are emitted, as soon as all tokens that can still end
at a coming byte start from it or later; lookahead is bounded by the longest token.

Decoding is a stream too: token bytes pass through an incremental UTF-8 machine that holds back at most three bytes.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces and transitions kept at once in a worker; beyond that they are made anew. Results don't depend on it.
KEPT_PIECES, KEPT_STATES = 500_000, 500_000
#: Characters of a piece that is kept, at most; longer ones are made each time they come in another text.
LONGEST_KEPT = 200
END = -1


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.lengths = {i: len(t) for t, i in ranks.items()}
        #: Tokens by their bytes, and -1 for what only begins one.
        self.known = {t[:i]: -1 for t in ranks for i in range(1, len(t))} | ranks
        self.parts: dict[int, tuple[int, int]] = {}
        self.fits: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        #: A state: (token settled last or END, bytes since), which determine the last token at each position since, and where tokens may start.
        self.states: list[tuple[int, bytes, tuple[int, ...], bytes | tuple[int, ...]]] = [(END, b"", (), b"\0")]
        self.ids = {self.states[0][:2]: 0}
        #: By state and byte: the next state, doubled, and 1 more if the move emits.
        self.moves: dict[int, int] = {}
        self.emits: dict[int, tuple[int, ...]] = {}

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self.parts:
            text = self.bytes_of[token]
            if len(text) == 1:
                self.parts[token] = None
            else:
                parts = [text[i : i + 1] for i in range(len(text))]
                while len(parts) > 2:
                    best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
                    parts[best : best + 2] = [parts[best] + parts[best + 1]]
                self.parts[token] = (self.ranks[parts[0]], self.ranks[parts[1]])
        return self.parts[token]

    def fit(self, left: int, right: int) -> bool:
        """Whether BPE on the joined bytes keeps the cut between the two tokens.

        Undo the merges of both sides from the last made to the first; while a side stood as (a, b) at the cut, a merge
        across it would have been taken if its rank came before the next merge on either side."""
        key = left << 32 | right
        ok = self.fits.get(key)
        if ok is not None:
            return ok
        bound, ok = 1 << 60, True
        while True:
            across = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if across is not None and across < bound:
                ok = False
                break
            # the side whose own merge is the later one is undone first
            first, second = self.split(left), self.split(right)
            if first is None and second is None:
                break
            if second is None or (first is not None and left > right):
                bound, left = left, first[1]
            else:
                bound, right = right + 1, second[0]
        if len(self.fits) > 400_000:
            self.fits.clear()
        self.fits[key] = ok
        return ok

    def move(self, state: int, byte: int) -> int:
        settled, tail, last, live = self.states[state]
        tail += bytes((byte,))
        known, lengths, token, open_at = self.known, self.lengths, None, []
        # Positions at which a token that is still to end may start: its bytes so far are a prefix of some token.
        for start in live:
            code = known.get(tail[start:])
            if code is None:
                continue
            open_at.append(start)
            if token is None and code >= 0:
                before = last[start - 1] if start else settled
                if before == END or self.fit(before, code):
                    token = code
        if token is None:
            raise ValueError("no token fits; the vocabulary lacks single bytes")
        last += (token,)
        # Their paths back meet at the position that is settled.
        common = len(tail)
        for p in reversed(open_at):
            while common != p:
                if common > p:
                    common -= lengths[last[common - 1]]
                else:
                    p -= lengths[last[p - 1]]
            if not common:
                break
        open_at.append(len(tail))
        out: list[int] = []
        p = common
        while p:
            out.append(last[p - 1])
            p -= lengths[last[p - 1]]
        if common:
            settled, tail, last, open_at = last[common - 1], tail[common:], last[common:], [p - common for p in open_at]
        to = (settled, tail)
        at = self.ids.get(to)
        if at is None:
            at = self.ids[to] = len(self.states)
            self.states.append((settled, tail, last, bytes(open_at) if len(tail) < 256 else tuple(open_at)))
        key = state << 8 | byte
        if out:
            self.emits[key] = tuple(reversed(out))
        self.moves[key] = made = at << 1 | bool(out)
        return made

    def forget(self, state: int) -> int:
        """Begins anew with one state beside the start, in the midst of a piece; gives its new number."""
        kept = self.states[state]
        self.reset()
        if kept[:2] in self.ids:
            return self.ids[kept[:2]]
        self.ids[kept[:2]] = len(self.states)
        self.states.append(kept)
        return len(self.states) - 1

    def piece(self, text: bytes) -> list[int]:
        if len(self.states) > KEPT_STATES:
            self.reset()
        state, out, moves, emits = 0, [], self.moves, self.emits
        for byte in text:
            key = state << 8 | byte
            step = moves.get(key)
            if step is None:
                step = self.move(state, byte)
            if step & 1:
                out.extend(emits[key])
            state = step >> 1
            if len(self.states) > 2 * KEPT_STATES:
                state = self.forget(state)
                moves, emits = self.moves, self.emits
        _, tail, last, _ = self.states[state]
        rest, p = [], len(tail)
        while p:
            rest.append(last[p - 1])
            p -= self.lengths[last[p - 1]]
        out.extend(reversed(rest))
        return out


class Utf8Machine:
    """Feeds on bytes in any cuts; gives back whole characters only and holds at most three bytes.

    Malformed input gives U+FFFD as Python's decoder does, so that any ids can be decoded."""

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes, last: bool = False) -> str:
        data = self.held + data
        keep = 0
        if not last:
            for back in range(1, min(3, len(data)) + 1):
                byte = data[-back]
                if byte >= 0xC0:
                    need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                    keep = back if need > back else 0
                    break
                if byte < 0x80:
                    break
        self.held = data[len(data) - keep :] if keep else b""
        return (data[: len(data) - keep] if keep else data).decode("utf-8", "replace")


class Codec:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.machine = Transducer(self.ranks)
        self.find = regex.compile(pattern).findall
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.bytes_of[i] = token
        self.words = [i.to_bytes(4, "little") for i in range(len(self.bytes_of))]
        #: Ids of pieces met lately, and of those met before them.
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """The ids, as little-endian unsigned 32-bit integers. Each match of the pattern is a run of the transducer."""
        found, kept = self.find(text), self.pieces
        try:
            return b"".join(map(kept.__getitem__, found))
        except KeyError:
            pass
        if len(kept) > KEPT_PIECES:
            self.older, self.pieces = kept, {}
            kept = self.pieces
        run, older, word, long = self.machine.piece, self.older, self.words, {}
        for piece in found:
            if piece not in kept and piece not in long:
                (kept if len(piece) <= LONGEST_KEPT else long)[piece] = older.get(piece) or b"".join([word[i] for i in run(piece.encode())])
        if long:
            return b"".join([long[p] if p in long else kept[p] for p in found])
        return b"".join(map(kept.__getitem__, found))

    def decode(self, ids: bytes, block: int = 1 << 16) -> bytes:
        numbers = array("I", ids)
        machine, out = Utf8Machine(), []
        for at in range(0, len(numbers), block):
            out.append(machine.feed(b"".join(map(self.bytes_of.__getitem__, numbers[at : at + block]))).encode())
        out.append(machine.feed(b"", last=True).encode())
        return b"".join(out)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str | None = None, ids: bool = False) -> DataFrame:
    """One row per row of docs: its id, n_tokens, digests of ids and of the bytes decoded from them; with ids, the ids too.

    Null text counts as empty: no tokens. Rows with the same id give a row each. Other columns aren't read.
    """
    pattern = pattern or public_tokenizers.PATTERN
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        own = codec(public_tokenizers.path(vocabulary), pattern)
        gc.disable()  # the kept tables hold no cycles, and walking them costs a fifth of the time
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            coded = [own.encode(t) if t else b"" for t in texts]
            columns = [batch.column(0), pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in coded]), pa.array([hashlib.sha256(own.decode(c)).hexdigest() for c in coded])]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns.append(pa.array([array("I", c).tolist() for c in coded], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(id_col, text_col).mapInArrow(work, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * ids)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
