"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a whole pre-token that is a token
itself. Tier two: other pre-tokens start as linked single bytes; a heap gives the adjacent pair of
lowest rank, leftmost first, until no pair is in the vocabulary. What either tier found is kept in a
bounded table until the task ends, as most pre-tokens come again.

Scale: rows are independent, nothing shuffles; the vocabulary (about 50,000 tokens, its size is that
of the file) is broadcast. Long runs of one pre-token cost n log n.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import prepare, table, text_of
from ._words import trim

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens that a task keeps.
KEPT = 300_000
#: White space other than space and line feed.
_RARE_SPACE = re.compile("[\t\v\f\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search


class PerfectHash:
    """Minimal perfect hash from byte strings to their ranks: one seed a bucket, as many slots as keys."""

    def __init__(self, tokens: dict[bytes, int]):
        n = self.n = len(tokens)
        self.m = max(1, n // 3)
        buckets: list[list[bytes]] = [[] for _ in range(self.m)]
        for t in sorted(tokens):
            buckets[xxhash.xxh64_intdigest(t) % self.m].append(t)
        self.seeds, self.keys, self.ranks = [0] * self.m, [None] * n, [0] * n
        order = sorted(range(self.m), key=lambda b: -len(buckets[b]))
        free = None
        for b in order:
            own = buckets[b]
            if len(own) > 1:
                seed, slots = 0, []
                while len(set(slots)) < len(own) or any(self.keys[s] is not None for s in slots):
                    seed += 1
                    slots = [xxhash.xxh64_intdigest(t, seed) % n for t in own]
                self.seeds[b] = seed
            elif own:  # a bucket of one key names its slot
                free = free if free is not None else iter([s for s in range(n) if self.keys[s] is None])
                slots = [next(free)]
                self.seeds[b] = -slots[0] - 1
            else:
                continue
            for t, s in zip(own, slots):
                self.keys[s], self.ranks[s] = t, tokens[t]

    def get(self, token: bytes) -> int:
        """The rank of ``token``, or -1."""
        if not self.n:
            return -1
        seed = self.seeds[xxhash.xxh64_intdigest(token) % self.m]
        slot = -seed - 1 if seed < 0 else xxhash.xxh64_intdigest(token, seed) % self.n
        return self.ranks[slot] if self.keys[slot] == token else -1


def merge_bytes(word: bytes, rank) -> list[int]:
    """Ranks of the tokens of ``word``: the lowest-ranked adjacent pair merges first, the leftmost of equals.

    A piece is known by its start; ``after[i]`` is the start of the next one. ``rank``: of a byte string, or None.
    """
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [r << 32 | i for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        top = heapq.heappop(heap)
        i = top & 0xFFFFFFFF
        j = after[i]
        if j < 0 or j >= n:  # i was merged into its left, or is the last
            continue
        k = after[j]
        if rank(word[i:k]) != top >> 32:  # one of the two has grown since
            continue
        after[i], after[j] = k, -1
        if k < n:
            before[k] = i
            if (r := rank(word[i : after[k]])) is not None:
                heapq.heappush(heap, r << 32 | i)
        if i and (r := rank(word[before[i] : k])) is not None:
            heapq.heappush(heap, r << 32 | before[i])
    out, i = [], 0
    while i < n:
        out.append(rank(word[i : after[i]]))
        i = after[i]
    return out


class _Pieces(dict):
    """From a pre-token to its ids, packed."""

    def __init__(self, codec):
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        codec, word = self.codec, piece.encode()
        r = codec.whole.get(word)
        packed = codec.packed[r] if r >= 0 else b"".join(map(codec.packed.__getitem__, merge_bytes(word, codec.ranks.get)))
        if len(self) >= KEPT:
            self.clear()
        if len(word) <= 64:
            self[piece] = packed
        return packed


class _Chunks(dict):
    """From what stands between two single spaces to the ids of it with a space before it."""

    def __init__(self, codec):
        self.codec = codec

    def __missing__(self, chunk: str) -> bytes:
        packed = b"".join(map(self.codec.pieces.__getitem__, self.codec.split(" " + chunk)))
        if len(self) >= KEPT:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = packed
        return packed


class Codec:
    """Encode and decode by the ranks of a vocabulary file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, whole: PerfectHash | None = None):
        import regex

        self.ranks = ranks
        self.whole = whole or PerfectHash(ranks)
        size = max(ranks.values(), default=-1) + 1
        self.bytes: list[bytes] = [b""] * size
        for t, r in ranks.items():
            self.bytes[r] = t
        self.packed = [r.to_bytes(4, "little") for r in range(size)]
        self.split = regex.compile(pattern).findall
        self.pieces, self.chunks = _Pieces(self), _Chunks(self)

    def encode(self, text: str) -> bytes:
        """Ids of ``text``, each as four little-endian bytes; no special tokens."""
        # white space next to a space would be one pre-token with it: such texts are split as a whole
        if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or _RARE_SPACE(text):
            return b"".join(map(self.pieces.__getitem__, self.split(text)))
        first, *rest = text.split(" ")
        return b"".join(map(self.pieces.__getitem__, self.split(first))) + b"".join(map(self.chunks.__getitem__, rest))

    def forget(self) -> None:
        """Drop what was kept of texts: a worker lives on, through tasks of other work, too."""
        self.pieces.clear()
        self.chunks.clear()
        trim()

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _codec_of(shared) -> Codec:
    """One codec a worker process and vocabulary; it outlives a task."""
    kept = sys.modules.setdefault("_auditlake_codecs", type(sys)("_auditlake_codecs")).__dict__
    key, ranks, pattern, whole = shared.value
    if key not in kept:
        kept[key] = Codec(ranks, pattern, whole)
    return kept[key]


def encode_texts(df: DataFrame, vocabulary: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row for each row of ``df``: id, n_tokens, ids_sha256, decoded_sha256, and with ``keep_ids`` the packed ids.

    ``vocabulary`` is the path of a rank file on the driver. A null text counts as empty, and an empty text
    has no tokens. Repeated rows are encoded alike; other columns are not read. The ids are decoded again
    and ``decoded_sha256`` is of these bytes.
    """
    spark = df.sparkSession
    prepare(spark)
    ranks = read_ranks(vocabulary)
    key = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    shared = spark.sparkContext.broadcast((key, ranks, pattern, PerfectHash(ranks)))

    def run(batches):
        codec = _codec_of(shared)
        for batch in batches:
            n, ids, back, raw = [], [], [], []
            for text in batch.column(1):
                packed = codec.encode(text.as_py())
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(codec.decode(packed)).hexdigest())
                if keep_ids:
                    raw.append(packed)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
            names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns, names = columns + [pa.array(raw, pa.binary())], names + ["ids"]
            yield pa.RecordBatch.from_arrays(columns, names)
        codec.forget()

    kind = df.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return df.select(F.col(id_column), text_of(text_column).alias("text")).mapInArrow(run, schema)


def encode_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return encode_texts(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, and what they decode to, as digests. Null and empty texts have no tokens; repeated rows have equal values."""
    return encode_documents(table(spark, sf_dir, "documents"))
