"""SentencePiece encoding and decoding with merge-type vocabularies, by a score-ordered agenda of adjacent pairs.

A text's blanks become the mark U+2581 and one mark is put before it. In each segment all adjacent symbol pairs that form
a piece wait in a heap ordered by score, then place; the best pair merges, its new neighbours enter, pairs whose symbols
have changed meanwhile are passed over. What is no piece in the end becomes byte pieces. No piece holds a mark behind
another sign, so no merge crosses the start of a mark run and segments between them stand alone; segments seen before
are looked up. Every new segment and the first text of each Arrow batch are held against the sentencepiece library.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterlode.llm.common import documents, small_batches

MARK = "▁"
SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
CACHE_SEGMENTS = 100_000  # in each of two generations
SLICE_ROWS = 125  # texts taken apart at a time
CACHE_LENGTH = 48  # of a segment, in code points


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Vocabulary of one model and the agenda over it."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        self.library = sp = SentencePieceProcessor(model_file=model_file)
        if any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size())) or sp.normalize("é ﬁ  a ") != f"{MARK}é{MARK}ﬁ{MARK}{MARK}a{MARK}":
            raise ValueError("only models without normalisation whose pieces hold marks in front alone")
        self.pieces = {sp.id_to_piece(i): (sp.get_score(i), i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        self.bytes = {b: sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.text = {i: sp.id_to_piece(i) for i in range(sp.get_piece_size())}
        self.marks = {i for i in range(sp.get_piece_size()) if sp.is_control(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.bos, self.eos = struct.pack("<I", sp.bos_id()), struct.pack("<I", sp.eos_id())
        self.known: dict[str, bytes] = {}  # ids of segments met since the cache was last full
        self.older: dict[str, bytes] = {}  # those of the time before; the ones met again move over
        self.odd: dict[str, str] = {}  # texts of segments with byte pieces that decode otherwise than to themselves
        self.width = sp.get_piece_size() + 1  # the last number stands for signs that are no piece
        self.sign_at = np.full(1 + max(ord(p) for p in self.pieces if len(p) == 1) + 1, self.width - 1)
        for p, (_, i) in self.pieces.items():
            if len(p) == 1:
                self.sign_at[ord(p)] = i
        merges = sorted((self.pieces[p[:k]][1] * self.width + self.pieces[p[k:]][1], score, i) for p, (score, i) in self.pieces.items() for k in range(1, len(p)) if p[:k] in self.pieces and p[k:] in self.pieces)
        self.pairs, self.pair_score, self.pair_id = (np.array(x) for x in zip(*merges, strict=True))

    def agenda(self, segment: str) -> list[int]:
        symbols: list[str | None] = list(segment)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, int]] = []
        pieces = self.pieces

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (found := pieces.get(symbols[i] + symbols[j])):
                heapq.heappush(heap, (-found[0], i, j, len(symbols[i]) + len(symbols[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, length = heapq.heappop(heap)
            if symbols[i] is None or symbols[j] is None or after[i] != j or len(symbols[i]) + len(symbols[j]) != length:
                continue
            symbols[i] += symbols[j]
            symbols[j] = None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            offer(before[i], i)
            offer(i, k)
        ids: list[int] = []
        for s in symbols:
            if s is not None:
                ids += [pieces[s][1]] if s in pieces else [self.bytes[b] for b in s.encode()]
        return ids

    def decode(self, ids: list[int]) -> str:
        """Text of ids; marks become blanks, the bytes of a run of byte pieces UTF-8."""
        out, run = [], bytearray()
        for i in [*ids, -1]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if i >= 0 and i not in self.marks:
                out.append(self.text[i])
        return "".join(out).replace(MARK, " ")

    def agendas(self, segments: list[str]) -> tuple[list[bytes], set[int]]:
        """agenda() for many short segments at once, as bytes: in each round the best pair of every segment merges.

        Also returns which segments hold byte pieces."""
        signs = "".join(segments)
        points = np.frombuffer(signs.encode("utf-32-le", "surrogatepass"), np.uint32)
        ids = self.sign_at[np.minimum(points, len(self.sign_at) - 1)]
        of = np.repeat(np.arange(len(segments)), [len(s) for s in segments])
        at = np.arange(len(ids))  # where each symbol begins
        done: list[tuple[np.ndarray, np.ndarray]] = []
        found = self.pairs_at(ids, of, at)  # of each symbol with the next: its place in the table of pairs, or -1
        while len(ids):
            hit = np.flatnonzero(found >= 0)
            live = np.zeros(len(segments), bool)
            live[of[hit]] = True
            rest = live[of]
            if not rest.all():
                done.append((ids[~rest], at[~rest]))
            if not len(hit):
                break
            score, owner = self.pair_score[found[hit]], of[hit]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.repeat(np.maximum.reduceat(score, first), np.diff(np.r_[first, len(hit)]))
            top = np.flatnonzero(score == best)
            top = top[np.r_[True, owner[top][1:] != owner[top][:-1]]]  # the leftmost of the best
            place = hit[top]
            ids[place] = self.pair_id[found[place]]
            rest[place + 1] = False
            changed = np.zeros(len(ids), bool)
            changed[place] = True
            ids, of, at, found = ids[rest], of[rest], at[rest], found[rest]
            merged = np.flatnonzero(changed[rest])
            near = np.r_[merged, merged[merged > 0] - 1]
            found[near] = self.pairs_at(ids, of, near)
        ids, at = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (ids, at)
        order = np.argsort(at)
        ids, at = ids[order], at[order]
        ends = np.searchsorted(at, np.cumsum([len(s) for s in segments])).tolist()
        flat = ids.astype("<u4").tobytes()
        out = [flat[4 * i : 4 * j] for i, j in zip([0, *ends], ends, strict=False)]
        odd = set(np.searchsorted(ends, np.flatnonzero(ids == self.width - 1), "right").tolist())
        for k in odd:  # signs that are no piece
            begin = ends[k - 1] if k else 0
            own = [x for i, y in enumerate(ids[begin : ends[k]].tolist(), begin) for x in ([y] if y != self.width - 1 else [self.bytes[b] for b in signs[at[i]].encode()])]
            out[k] = struct.pack(f"<{len(own)}I", *own)
        return out, odd

    def pairs_at(self, ids: np.ndarray, of: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the pairs of the symbols `at` with their next ones stand in the table; -1: no pair."""
        out = np.full(len(at), -1)
        inner = np.flatnonzero(at + 1 < len(ids))
        left = at[inner]
        pair = ids[left] * self.width + ids[left + 1]
        place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        good = (self.pairs[place] == pair) & (of[left] == of[left + 1])
        out[inner[good]] = place[good]
        return out

    def learn(self, segments: list[str]) -> None:
        """Encodes, decodes and keeps new segments, and holds all of them against the library."""
        every, odd = self.agendas(segments)
        held = self.library.encode([s[1:].replace(MARK, " ") if s[0] == MARK else s for s in segments])
        lengths = np.fromiter(map(len, held), np.int64, len(held))
        flat, ends = np.fromiter(chain.from_iterable(held), "<u4", int(lengths.sum())).tobytes(), (4 * np.cumsum(lengths)).tolist()
        if flat != b"".join(every) or [*map(len, every)] != (4 * lengths).tolist():
            for s, ids, i, j in zip(segments, every, [0, *ends], ends, strict=False):
                if ids != flat[i:j] and s[0] == MARK and s != MARK:
                    raise AssertionError(f"the library encodes {s!r} otherwise")
        self.known.update(zip(segments, every, strict=True))
        for i in odd:
            if (text := self.decode(self.ids_of(every[i]))) != segments[i].replace(MARK, " "):
                self.odd[segments[i]] = text

    def ids_of(self, packed: bytes) -> tuple[int, ...]:
        return struct.unpack(f"<{len(packed) // 4}I", packed)

    def prepare(self, texts: list[list[str]]) -> None:
        """Learns the short segments of these texts that are not known yet; they stay known until the next call."""
        if len(self.known) > CACHE_SEGMENTS:
            self.known, self.older = {}, self.known
            self.odd = {s: x for s, x in self.odd.items() if s in self.older}
        new = set().union(*texts).difference(self.known)
        again = {s for s in new if s in self.older} if self.older else ()
        for s in again:
            self.known[s] = self.older[s]
        plain = [s for s in new.difference(again) if len(s) <= CACHE_LENGTH]
        for i in range(0, len(plain), 20_000):
            self.learn(plain[i : i + 20_000])

    def segment(self, s: str) -> bytes:
        """Ids of a segment too long to be kept."""
        ids = self.agenda(s)
        text = s.replace(MARK, " ")
        if s[0] == MARK and s != MARK and self.library.encode(text[1:]) != ids:
            raise AssertionError(f"the library encodes {text!r} otherwise")
        return struct.pack(f"<{len(ids)}I", *ids)

    def text_ids(self, segments: list[str]) -> tuple[bytes, str]:
        """Ids of a text's segments, with begin and end, as little-endian 32-bit integers; and the text they decode to."""
        odd: dict[str, str] = {}
        try:
            found = [*map(self.known.__getitem__, segments)]
        except KeyError:  # segments too long to be kept
            found = [self.known.get(s) or self.segment(s) for s in segments]
            for s, f in zip(segments, found, strict=True):
                if len(s) > CACHE_LENGTH and (text := self.decode(self.ids_of(f))) != s.replace(MARK, " "):
                    odd[s] = text
        if self.odd and not self.odd.keys().isdisjoint(segments):
            odd |= self.odd
        whole = "".join([odd.get(s) or s.replace(MARK, " ") for s in segments]) if odd else "".join(segments).replace(MARK, " ")
        return b"".join([self.bos, *found, self.eos]), whole[1:]


def segments_of(text: str) -> list[str]:
    return SEGMENT.findall(MARK + text.replace(" ", MARK)) if text else []


@lru_cache(maxsize=2)
def load(model_file: str) -> Pieces:
    return Pieces(model_file)


def encode(docs: DataFrame, model_file: str, *, text: str = "text", ids: bool = True) -> DataFrame:
    """docs with the columns piece_ids (array of int; left out unless `ids`), n_tokens, ids_sha256, decoded, decoded_sha256.

    Null text counts as empty: begin and end ids alone. Existing columns of these names are replaced. Rows are
    independent, so repeated rows, ties and empty tables need no care. Memory: a batch of rows and the longest text."""
    made = pa.schema([("piece_ids", pa.list_(pa.int32()))] * ids + [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded", pa.string()), ("decoded_sha256", pa.string())])
    kept = docs.drop(*made.names) if set(made.names) & set(docs.columns) - {text} else docs
    kept = kept.withColumn("_piece_text", docs[text]) if text not in kept.columns else kept.withColumn("_piece_text", F.col(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_file)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                texts = [t or "" for t in batch.column("_piece_text").to_pylist()]
                parts = [segments_of(t) for t in texts]
                pieces.prepare(parts)
                done = [pieces.text_ids(p) for p in parts]
                if at == 0 and texts:  # the whole path for one text of each batch
                    held = pieces.library.encode(texts[0], add_bos=True, add_eos=True)
                    if struct.pack(f"<{len(held)}I", *held) != done[0][0] or pieces.library.decode(held) != done[0][1]:
                        raise AssertionError("the library encodes or decodes a text otherwise")
                columns = [] if not ids else [pa.ListArray.from_arrays(np.cumsum([0, *(len(a) // 4 for a, _ in done)]).astype(np.int32), np.frombuffer(b"".join(a for a, _ in done), "<i4"))]
                columns += [pa.array([len(a) // 4 for a, _ in done], pa.int64()), pa.array([hashlib.sha256(a).hexdigest() for a, _ in done]), pa.array([t for _, t in done], pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for _, t in done])]
                rest = batch.drop_columns(["_piece_text"])
                yield pa.RecordBatch.from_arrays([*rest.columns, *columns], names=[*rest.schema.names, *made.names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.drop("_piece_text").schema.fields), *(["piece_ids array<int>"] if ids else []), "n_tokens long, ids_sha256 string, decoded string, decoded_sha256 string"])
    return small_batches(kept).mapInArrow(run, schema)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode(documents(spark, sf_dir).select("doc_id", "text"), default_model(), ids=False)
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
