"""Token-ID output (3): best-fit-decreasing packing into fixed-length sequences.

One narrow pass: each task tokenises its texts, cuts token lists longer than a sequence into pieces
without loss, and packs blocks of ``block_tokens`` tokens (a bounded buffer) best-fit-decreasing. The
open bins are found with a segment tree over remaining capacities. Full sequences go out as matrices.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from .common import own, table, utf8_rows

SEQ_LEN, ROWS, BLOCK_TOKENS = 2048, 32, 1 << 21
SCHEMA = "n_rows int, n_tokens long, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<{id}>, starts array<long>"
#: The pattern that cuts a text into the pieces which byte-pair merges stay within. White space goes in
#: pieces of 4096 characters at most: the matcher keeps a stack entry for each character of such a run.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s{1,4096}(?!\S)|\s{1,4096}"""
#: A rank file is sent to every worker; public ones have a few MB.
MOST_VOCABULARY_BYTES = 64 << 20


def default_vocabulary() -> str:
    """The public byte-level vocabulary that comes with the machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Tokenizer:
    """Byte-level BPE from the bytes of a rank file; the end token is the first id that is free."""

    def __init__(self, rank_file: bytes):
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_file.splitlines())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.eos = max(ranks.values()) + 1
        self.dtype = np.dtype("<u2" if self.eos < 1 << 16 else "<u4")

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian bytes."""
        ids = array("H" if self.dtype.itemsize == 2 else "I", self.encoding.encode_ordinary(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


class CapacityTree:
    """Open bins by remaining capacity; finds the least capacity that is large enough in O(log capacity)."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: dict[int, list[int]] = {}

    def _add(self, capacity: int, n: int) -> None:
        node = self.size + capacity
        while node:
            self.count[node] += n
            node >>= 1

    def put(self, number: int, capacity: int) -> None:
        self.bins.setdefault(capacity, []).append(number)
        self._add(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """(bin, capacity), removed; None if no bin has ``least`` left."""
        node, count = self.size + least, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.size
        self._add(capacity, -1)
        return self.bins[capacity].pop(), capacity


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of piece numbers; longest first, ties by number, each into the fullest bin that has room."""
    tree, bins = CapacityTree(capacity), []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        found = tree.take(lengths[k])
        number, left = found if found else (len(bins), capacity)
        if not found:
            bins.append([])
        bins[number].append(k)
        tree.put(number, left - lengths[k])
    return bins


def matrices(pieces: list[tuple], seq_len: int, rows: int, pad: int, dtype: np.dtype):
    """SCHEMA rows from (doc_id, start, ids): each sequence is padded; padding is a segment with a null doc_id."""
    bins = best_fit_decreasing([len(p[2]) for p in pieces], seq_len)
    for a in range(0, len(bins), rows):
        part = bins[a : a + rows]
        ids = np.full((len(part), seq_len), pad, dtype)
        positions = np.zeros((len(part), seq_len), np.dtype("<u2" if seq_len <= 1 << 16 else "<u4"))
        ends, docs, starts, n_tokens = [0], [], [], 0
        for row, numbers in enumerate(part):
            at = 0
            for k in numbers:
                doc, start, tokens = pieces[k]
                end = at + len(tokens)
                ids[row, at:end] = tokens
                positions[row, at:end] = np.arange(len(tokens))
                docs.append(doc)
                starts.append(start)
                ends.append(row * seq_len + end)
                at = end
            n_tokens += at
            if at < seq_len:
                positions[row, at:] = np.arange(seq_len - at)
                docs.append(None)
                starts.append(None)
                ends.append((row + 1) * seq_len)
        yield {"n_rows": len(part), "n_tokens": n_tokens, "ids": ids.tobytes(), "positions": positions.tobytes(), "cu_seqlens": ends, "doc_ids": docs, "starts": starts}


_TOKENIZERS: dict[str, Tokenizer] = {}


def tokenizer_of(name: str, rank_file) -> Tokenizer:
    """One for each worker process and vocabulary; ``rank_file`` is a broadcast."""
    if name not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[name] = Tokenizer(rank_file.value)
    return _TOKENIZERS[name]


def pack(df: DataFrame, id_: str = "doc_id", text: str = "text", vocabulary: str | None = None, seq_len: int = SEQ_LEN, rows: int = ROWS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per matrix of up to ``rows`` sequences of ``seq_len`` token ids.

    ids and positions: little-endian matrices (positions restart at 0 in each segment); cu_seqlens:
    cumulative segment lengths over the flattened matrix, from 0; doc_ids and starts: for each
    segment its text's id and the place of its first token in that text; both null for padding. Each
    text ends in the end token, so null and empty texts are one segment of one token. Null ids are
    kept as null with a start that is not null; ids keep their type. A very long text, white space
    too, is cut into segments like any other. Repeated rows are packed one by one; ties in length
    go by row order; an empty table gives no rows; extra columns, also of these names, are not read.

    ``vocabulary`` is a rank file that the driver can open; its bytes are broadcast.
    """
    with open(vocabulary or default_vocabulary(), "rb") as file:
        ranks = file.read(MOST_VOCABULARY_BYTES + 1)
    if len(ranks) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"a vocabulary of more than {MOST_VOCABULARY_BYTES} bytes is not sent to workers")
    name, shared = hashlib.sha256(ranks).hexdigest(), df.sparkSession.sparkContext.broadcast(ranks)
    id_type = df.schema[id_].dataType
    fields = pa.schema([("n_rows", pa.int32()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("positions", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("doc_ids", pa.list_(to_arrow_type(id_type))), ("starts", pa.list_(pa.int64()))])

    def packed(batches):
        tokenizer = tokenizer_of(name, shared)
        pieces, held = [], 0

        def out():
            many = []
            for m in matrices(pieces, seq_len, rows, tokenizer.eos, tokenizer.dtype):
                many.append(m)
                if len(many) == 64:
                    yield pa.RecordBatch.from_pylist(many, fields)
                    many = []
            if many:
                yield pa.RecordBatch.from_pylist(many, fields)

        for batch in batches:
            for doc, t in zip(batch.column(0).to_pylist(), utf8_rows(batch.column(1))):
                tokens = np.frombuffer(tokenizer.encode((t or b"").decode("utf-8", "replace")), tokenizer.dtype)
                tokens = np.append(tokens, tokenizer.dtype.type(tokenizer.eos))
                for a in range(0, len(tokens), seq_len):
                    pieces.append((doc, a, tokens[a : a + seq_len]))
                    held += len(pieces[-1][2])
                    if held >= block_tokens:
                        yield from out()
                        pieces, held = [], 0
        yield from out()

    return df.select(own(df, id_).alias("id"), own(df, text).alias("text")).mapInArrow(packed, SCHEMA.format(id=id_type.simpleString()))


def write_packed(packed: DataFrame, path: str) -> None:
    """Matrices as Parquet files (uncompressed id pages decode straight into arrays)."""
    packed.write.option("compression", "zstd").parquet(path)


def unpacked(rows, seq_len: int = SEQ_LEN, wide: bool = False) -> dict:
    """{doc_id: token ids without the end token} of collected matrices (for tests and readers)."""
    parts: dict = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4" if wide else "<u2")
        for k, (doc, start) in enumerate(zip(r["doc_ids"], r["starts"])):
            if start is not None:
                parts.setdefault(doc, []).append((start, ids[r["cu_seqlens"][k] : r["cu_seqlens"][k + 1]]))
    return {doc: np.concatenate([ids for _, ids in sorted(p, key=lambda x: x[0])])[:-1] for doc, p in parts.items()}


def op3_pack_tokens(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
