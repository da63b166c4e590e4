"""Packing in the order of a space-filling curve: documents that lie near each other share training sequences.

A document's token counts, hashed to a few thousand signed places, are projected to four dimensions; the Hilbert key of
that point orders the corpus. The token stream in this order is cut every `length` tokens, so all sequences but the last
are full and a document is cut only where a sequence ends. Texts are tokenised once; what is shuffled is token ids.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterlode.llm.common import documents, freeze, small_batches

LENGTH = 2048
END_ID = 1
PLACES, DIMS, BITS = 4096, 4, 12  # of hashed vectors; of the curve
TIE_BITS = 15  # below the curve's key: rows at one place of the curve are parted by these
REACH = 4.0  # projected unit vectors lie within +-REACH; what does not counts as at the edge
TOKENS_PER_BUCKET = 2_000_000
MOST_BUCKETS = 8_192  # their edges and first places are all that the driver holds

#: Fixed value: how the byte-level rule cuts a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_ranks() -> str:
    """The default tokenizer's vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Ids:
    """Token ids of texts as the tokenizers library gives them.

    With a file of ranks of the same vocabulary, tiktoken encodes, which takes a third of the time; texts that hold a
    special token, and what tiktoken cannot match (very long runs of blanks), go to the tokenizers library itself."""

    def __init__(self, file: str, ranks_file: str | None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.library.no_truncation()
        self.library.no_padding()
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.quick = None
        if ranks_file is not None:
            import tiktoken

            with open(ranks_file, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
            self.quick = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def texts(self, texts: list[str]) -> list[bytes]:
        if self.quick is None:
            return self.whole(texts)
        return [self.text(t) for t in texts]

    def text(self, t: str) -> bytes:
        if not any(s in t for s in self.special):
            try:
                return np.array(self.quick.encode_ordinary(t), self.kind).tobytes()
            except BaseException as e:
                if type(e).__name__ != "PanicException":  # what the matcher raises on too many steps
                    raise
        return self.whole([t])[0]


@lru_cache(maxsize=2)
def load(file: str, ranks_file: str | None = None) -> Ids:
    return Ids(file, ranks_file)


@lru_cache(maxsize=2)
def projection(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((PLACES, DIMS))


def points(ids: list[np.ndarray], seed: int = 7) -> np.ndarray:
    """Places of documents in DIMS dimensions: hashed, signed, damped token counts, as unit vectors, projected."""
    onto, out = projection(seed), np.zeros((len(ids), DIMS))
    for i, a in enumerate(ids):
        h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * seed)
        counts = np.bincount((h >> np.uint64(51)).astype(np.int64), minlength=2 * PLACES)
        at = np.flatnonzero(counts)
        weight, split = np.log1p(counts[at]), np.searchsorted(at, PLACES)
        damped = np.zeros(PLACES)
        damped[at[:split]] = weight[:split]
        damped[at[split:] - PLACES] -= weight[split:]
        out[i] = damped @ onto / max(1e-9, np.sqrt(damped @ damped))
    return out


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of cells (whole numbers below 2^bits in every dimension)."""
    x = [cells[:, i].astype(np.uint64) for i in range(cells.shape[1])]
    for b in range(bits - 1, 0, -1):  # from the largest cube down, undo the turn of each cube
        q, low = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(len(x)):
            turned = (x[i] & q) != 0
            swap = np.where(turned, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] & np.uint64(1 << b)) != 0, np.uint64((1 << b) - 1), np.uint64(0))
    key = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << np.uint64(1)) | (((axis ^ flip) >> np.uint64(b)) & np.uint64(1))
    return key


def curve(ids: list[np.ndarray], seed: int = 7) -> np.ndarray:
    cells = (points(ids, seed) + REACH) * ((1 << BITS) / (2 * REACH))
    return hilbert(np.clip(cells, 0, (1 << BITS) - 1).astype(np.uint64), BITS)


def tokenized(docs: DataFrame, tokenizer_file: str, *, ranks_file: str | None = None, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, seed: int = 7) -> DataFrame:
    """Rows (doc_id, n, ids, place): the document's ids with the end id as little-endian numbers, and its place in the order.

    A place is the curve's key, then TIE_BITS of a hash of id, ids and, for rows repeated within a batch, their count."""
    thin = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    out = pa.schema([("n", pa.int64()), ("ids", pa.binary()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = load(tokenizer_file, ranks_file)
        end = np.array([end_id], made.kind).tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                raw = made.texts(texts)
                if at == 0 and texts and made.whole(texts[:1]) != raw[:1]:  # the whole path for one text of each batch
                    raise AssertionError("the tokenizers library gives other ids for a text")
                key = curve([np.frombuffer(r, made.kind) for r in raw], seed)
                seen: dict[tuple, int] = {}
                tie = np.zeros(len(raw), np.uint64)
                for i, (d, r) in enumerate(zip(batch.column("doc_id").to_pylist(), raw, strict=True)):
                    row = (d, zlib.crc32(r))
                    seen[row] = seen.get(row, -1) + 1
                    tie[i] = zlib.crc32(f"{row}:{seen[row]}".encode()) >> (32 - TIE_BITS)
                place = ((key << np.uint64(TIE_BITS)) | tie).astype(np.int64)
                width = made.kind.itemsize
                columns = [pa.array([len(r) // width + 1 for r in raw], pa.int64()), pa.array([r + end for r in raw], pa.binary()), pa.array(place)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *out.names])

    return small_batches(thin).mapInArrow(run, f"doc_id {thin.schema['doc_id'].dataType.simpleString()}, n long, ids binary, place long")


def bucket_of(place: Column, edges: list[int]) -> Column:
    """How many edges are at or below the place, by bisection inside the expression."""
    if not edges:
        return F.lit(0)
    steps = len(edges).bit_length()
    padded = F.array(*(F.lit(e) for e in [*edges, *[(1 << 63) - 1] * ((1 << steps) - 1 - len(edges))]))
    jumps = F.array(*(F.lit(1 << s) for s in range(steps - 1, -1, -1)))
    return F.aggregate(jumps, F.lit(0), lambda at, jump: F.when(F.element_at(padded, at + jump) <= place, at + jump).otherwise(at))


def pack(docs: DataFrame, tokenizer_file: str, *, ranks_file: str | None = None, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID, ids: bool = True, seed: int = 7) -> DataFrame:
    """Pieces of documents in sequences of `length` tokens: (doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset).

    Each id, the end id of each document included, lies in exactly one piece; only the last sequence may be short.
    Null text counts as empty: the end id alone. A text of any length is cut like others. Rows are packed one by one, so
    repeated rows and ids, null ids and ties each keep their pieces; ties lie in the order of a hash of id and tokens.
    Runs over the same files agree. Other columns are ignored. Empty table: empty result. With `ids` false that column is left out.

    Memory: a batch of rows. The order is cut into buckets by estimated quantiles of the place; tokens are summed by
    bucket, and every bucket is numbered from its first place on by itself, so no task sees more than its own buckets."""
    spark = docs.sparkSession
    rows = freeze(tokenized(docs, tokenizer_file, ranks_file=ranks_file, doc_id=doc_id, text=text, end_id=end_id, seed=seed))
    kind = load(tokenizer_file, ranks_file).kind
    total = rows.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (16 * TOKENS_PER_BUCKET))
    wanted = int(min(MOST_BUCKETS, max(4 * parts, total // TOKENS_PER_BUCKET)))
    edges = rows.agg(F.percentile_approx("place", [i / wanted for i in range(1, wanted)], 4 * wanted)).first()[0] if wanted > 1 else []
    edges = sorted(set(edges or ()))
    split = rows.withColumn("_bucket", bucket_of(F.col("place"), edges))
    sums = dict(split.groupBy("_bucket").agg(F.sum("n")).collect())  # at most MOST_BUCKETS rows
    first = [0, *accumulate(sums.get(b, 0) for b in range(len(edges) + 1))]
    ordered = split.repartitionByRange(parts, "_bucket").sortWithinPartitions("_bucket", "place", "doc_id", "n", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, at = -1, 0
        for whole in batches:
            for begin in range(0, whole.num_rows, 200):
                batch = whole.slice(begin, 200)
                found: list[tuple[int, int, int, bytes, int, int, int, int]] = []
                for i, (n, raw, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n", "ids", "_bucket")), strict=True)):
                    if b != bucket:
                        bucket, at = b, first[b]
                    numbers, done = np.frombuffer(raw, kind).astype("<u4"), 0
                    while done < n:
                        sequence, offset = divmod(at, length)
                        size = min(length - offset, n - done)
                        piece = numbers[done : done + size]
                        found.append((i, done, size, piece, zlib.crc32(piece.tobytes()), n, sequence, offset))
                        done, at = done + size, at + size
                column = [[f[k] for f in found] for k in range(8)]
                arrays = [batch.column("doc_id").take(pa.array(column[0], pa.int32())), *(pa.array(column[k], pa.int64()) for k in (1, 2)), *([pa.array(column[3], pa.list_(pa.int32()))] if ids else []), *(pa.array(column[k], pa.int64()) for k in (4, 5, 6, 7))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", *(["ids"] if ids else []), "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ordered.mapInArrow(cut, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, length long, {'ids array<int>, ' if ids else ''}ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def sequences(pieces: DataFrame, *, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, lengths): each sequence's ids in order, the last one padded to a power of two; lengths of its pieces.

    A group is one sequence, so at most `length` ids."""
    at = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = pieces.groupBy("sequence_id").agg(at.alias("_at"))
    flat = F.flatten(F.transform("_at", lambda p: p["ids"]))
    fill = F.least(F.lit(length), F.pow(F.lit(2), F.ceil(F.log2(F.size(flat)))).cast("int"))
    return whole.select("sequence_id", F.concat(flat, F.array_repeat(F.lit(pad_id), fill - F.size(flat))).alias("ids"), F.transform("_at", lambda p: F.size(p["ids"])).alias("lengths"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), default_tokenizer(), ranks_file=default_ranks(), ids=False)
