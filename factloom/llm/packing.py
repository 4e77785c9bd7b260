"""Operator 7: cost-balanced packing of tokenised documents into training sequences.

A piece of n tokens costs LINEAR * n + QUADRATIC * n * n (attention stays inside a document). Documents, by
descending size, go to the sequence of lowest cost that has token capacity left; a document is cut where the
sequence is full. Every block of documents has just as many sequences as its tokens fill; the tokens over whole
sequences get sequences whose sizes are the powers of two of their count, so that nothing is padded.
"""

from __future__ import annotations

import gc
import heapq
import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark import TaskContext

from .common import slices, table, trim

TOKENIZER, END_ID, CAPACITY = "word_bpe_49k.json", 1, 2048
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Tokens of a block that is packed at once, and words whose ids a worker keeps.
BLOCK_TOKENS, KEPT_WORDS = 1 << 21, 250_000


#: Texts of Latin letters, without the characters that PLAIN takes (such as other digits, and white space that Python has
#: alone), are cut into words here and their words' ids kept; other texts go to the library as they are.
LATIN = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff\u0100-\u017f"
PLAIN = re.compile("[^\0-\x1b\x20-\xb1\xb4-\xb8\xba-\xbb\xbf-\u012f\u0131-\u017f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]")
PLAIN_WORDS = re.compile(f"[{LATIN}]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^{LATIN}0-9\\s]+").findall


class Words:
    """Ids by the tokenizers library, kept by word: its pre-tokeniser cuts texts into words that are encoded each by itself."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Strings that the library takes as one token wherever they stand; texts that hold one go to it as they are.
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        #: Ids of words met lately, and of those met before them.
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        lower = text.lower()
        if PLAIN.search(text) is None and unicodedata.is_normalized("NFC", text) and not any(t in lower for t in self.added):
            found = PLAIN_WORDS(lower)
        else:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        kept = self.kept
        if len(kept) > KEPT_WORDS:
            self.older, self.kept = kept, {}
            kept = self.kept
        if new := set(found).difference(kept):
            if again := [w for w in new if w in self.older]:
                new.difference_update(again)
                kept.update(zip(again, map(self.older.__getitem__, again)))
            if new:
                self.learn(list(new))
        return b"".join(map(kept.__getitem__, found))

    def learn(self, new: list[str]) -> None:
        """All new words in one call: white space parts them, and a word's last token is marked as its end."""
        ids = np.array(self.tokenizer.encode(" ".join(new), add_special_tokens=False).ids, "<u4")
        ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(ends) == len(new):
            data, at = ids.tobytes(), 0
            for word, end in zip(new, ends.tolist()):
                self.kept[word] = data[at:end]
                at = end
        else:
            for word in new:
                self.kept[word] = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


def plan(sizes: list[int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """((document, start, length, sequence, offset) of each piece, size of each sequence); sizes are of documents."""
    total = sum(sizes)
    rest = total % capacity
    room = [capacity] * (total // capacity) + [1 << i for i in reversed(range(capacity.bit_length())) if rest >> i & 1]
    made, free = list(room), [(0.0, -size, i) for i, size in enumerate(room)]
    heapq.heapify(free)
    pieces = []
    for doc in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = 0
        while at < sizes[doc]:
            cost, size, i = heapq.heappop(free)
            n = min(room[i], sizes[doc] - at)
            pieces.append((doc, at, n, i, made[i] - room[i]))
            room[i] -= n
            at += n
            if room[i]:
                heapq.heappush(free, (cost + LINEAR * n + QUADRATIC * n * n, size, i))
    return pieces, made


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """One row per piece; with ids, its token ids too.

    Ids are those of the tokenizers library as it comes, with add_special_tokens=False: an added token's string in a text
    (such as <|endoftext|>) is that token. Null or empty text is the end id alone. Rows with the same or no id are
    documents of their own. Tables without rows give none. Other columns aren't read. Packing is by blocks of a partition, without a shuffle; sequence_id holds the partition and a count.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    path = public_tokenizers.path(tokenizer)

    def work(batches):
        own, end = words(path), np.array([end_id], "<u4").tobytes()
        base, names, coded, held = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, [], [], 0

        def flush():
            nonlocal base
            pieces, made = plan([len(c) // 4 for c in coded], capacity)
            for at in range(0, len(pieces), 20_000):
                part = pieces[at : at + 20_000]
                cuts = [coded[d][4 * s : 4 * (s + n)] for d, s, n, _, _ in part]
                columns = [pa.array([names[p[0]] for p in part], id_type), *(pa.array([p[k] for p in part], pa.int64()) for k in (1, 2)), pa.array(map(zlib.crc32, cuts), pa.int64()), pa.array([len(coded[p[0]]) // 4 for p in part], pa.int64()), pa.array([base + p[3] for p in part], pa.int64()), pa.array([p[4] for p in part], pa.int64()), pa.array([made[p[3]] for p in part], pa.int64())]
                if ids:
                    columns.append(pa.array([np.frombuffer(c, "<u4").astype("i8") for c in cuts], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, fields)
            base += len(made)

        gc.disable()  # the kept tables hold no cycles
        fields, id_type = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens"] + ["ids"] * ids, None
        for batch in slices(batches):
            id_type = batch.schema.field(0).type
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names.append(name)
                coded.append(own.ids(text) + end)
                held += len(coded[-1]) // 4
                if held >= BLOCK_TOKENS:
                    yield from flush()
                    names, coded, held = [], [], 0
        if coded:
            yield from flush()
        del names, coded
        trim()

    return docs.select(id_col, text_col).mapInArrow(work, f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long" + ", ids array<long>" * ids)


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
