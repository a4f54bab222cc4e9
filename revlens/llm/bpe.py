"""Byte-level BPE as a bounded-lookahead streaming transducer.

A merge at rank i that differs between two continuations of the same prefix moves the
place up to which both tokenizations agree left by the length of its left part ``u_i``.
A later merge j moves it further only if its right part begins with that ``u_i``.  The
heaviest chain of such merges is therefore a *sufficient lookahead* L: a token that ends
L bytes before the end of what has been read can no longer change, and no merge crosses
its end, so encoding may go on from there with nothing else remembered.

Text is read in chunks; a piece of the pre-tokenizer is stable once it ends before the
pattern's own lookahead; a piece that fills the chunk is fed to a run encoder that holds
O(L) bytes and emits tokens once they are stable.  Decoding pushes token bytes through an
incremental UTF-8 state machine.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import os
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from revlens.llm.common import released, text_batches

# Fixed value: the split pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RUNS = {"letters": r"\p{L}+", "numbers": r"\p{N}+", "others": r"[^\s\p{L}\p{N}]+", "spaces": r"\s+"}
CHUNK = 1 << 16          # characters read at once
HOLD = 3                 # characters the split pattern may look ahead
LONG_PIECE = 1 << 15     # a held piece of this length is streamed
KEPT_PIECES = 300_000    # encoded pieces of a generation of the cache; two are held
KEPT_LENGTH = 48
SHORT_PIECE = 256        # bytes of a piece that is merged at once
MOST_SPEC_BYTES = 64 << 20


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies spell printable Latin-1 bytes as themselves and the
    others as the code points from 256 on, in byte order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(shifted)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes of lookahead after which a token is final (see the module's text).

    Requires every merge result to be made by one merge only, and parts to be made by
    earlier merges; raises ValueError otherwise.
    """
    made: set[bytes] = set()
    heaviest: dict[bytes, int] = {}
    most = 1
    for u, v in merges:
        if u + v in made or any(len(x) > 1 and x not in made for x in (u, v)):
            raise ValueError("merge list is not proper: the lookahead is not bounded by chains")
        made.add(u + v)
        weight = len(u) + max(heaviest.get(v[:k], 0) for k in range(1, len(v) + 1))
        heaviest[u] = max(heaviest.get(u, 0), weight)
        most = max(most, weight)
    return most


class Vocabulary:
    """Merge table, token bytes and added tokens of a tokenizer file's JSON."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model, pre = data["model"], data.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or data.get("normalizer"):
            raise ValueError("only byte-level BPE without a normalizer is supported")
        if pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("unsupported option in the tokenizer file")
        byte = _byte_of_char()
        raw = {t: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in model["vocab"]}
        self.added = {}
        for t in data.get("added_tokens", []):
            if t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError("unsupported added token")
            self.added[t["content"]] = t["id"]
        size = max([*model["vocab"].values(), *self.added.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for t, i in model["vocab"].items():
            self.bytes_of[i] = raw[t]
        for t, i in self.added.items():
            self.bytes_of[i] = t.encode()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.pairs = {(model["vocab"][a], model["vocab"][b]): (rank, model["vocab"][a + b])
                      for rank, (a, b) in enumerate(pairs)}
        self.first = [0] * 256
        for c, b in byte.items():
            self.first[b] = model["vocab"][c]
        self.lookahead = sufficient_lookahead([(raw[a], raw[b]) for a, b in pairs])


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class _Cache(dict):
    """Piece -> packed token ids.  Bounded: when a generation is full it becomes the old one,
    from which pieces that are met again come back, and the old one before it goes."""

    def __init__(self, encoder: "Encoder"):
        super().__init__()
        self.encoder, self.old = encoder, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            data = piece.encode("utf-8", "surrogatepass")
            packed = pack(self.encoder.merge(data) if len(data) <= SHORT_PIECE else list(self.encoder.encode_bytes(data)))
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = packed
        return packed


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        import regex
        self.v = vocabulary
        self.split = regex.compile(PATTERN).findall
        self.runs = {k: regex.compile(p) for k, p in RUNS.items()}
        self.cache = _Cache(self)
        self.mark = os.path.commonprefix(list(vocabulary.added))       # every added token begins with it
        self.special = regex.compile("|".join(
            regex.escape(t) for t in sorted(vocabulary.added, key=len, reverse=True))) if vocabulary.added else None

    def merge(self, data: bytes) -> list[int]:
        """Token ids of one piece held whole."""
        ids = [self.v.first[b] for b in data]
        get = self.v.pairs.get
        if len(ids) <= 24:
            while len(ids) > 1:
                best, at = None, 0
                for k in range(len(ids) - 1):
                    found = get((ids[k], ids[k + 1]))
                    if found and (best is None or found < best):
                        best, at = found, k
                if best is None:
                    break
                ids[at:at + 2] = [best[1]]
            return ids
        # linked list and a heap of (rank, place)
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for k in range(n - 1):
            if found := get((ids[k], ids[k + 1])):
                heap.append((found[0], k, found[1], ids[k], ids[k + 1]))
        heapq.heapify(heap)
        while heap:
            _, k, new, left, right = heapq.heappop(heap)
            j = after[k]
            if ids[k] != left or j >= n or ids[j] != right:
                continue
            ids[k], ids[j] = new, -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
                if found := get((new, ids[after[k]])):
                    heapq.heappush(heap, (found[0], k, found[1], new, ids[after[k]]))
            if (p := before[k]) >= 0 and (found := get((ids[p], new))):
                heapq.heappush(heap, (found[0], p, found[1], ids[p], new))
        return [i for i in ids if i >= 0]

    def encode_bytes(self, data: bytes) -> Iterator[int]:
        run = Run(self)
        yield from run.feed(data)
        yield from run.close()

    def stream(self, text: str) -> Iterator[Iterable[int]]:
        """Token ids of a text, given out as they become stable."""
        for packed in self.packed(text):
            yield (i for i, in struct.iter_unpack("<I", packed))

    def packed(self, text: str) -> Iterator[bytes]:
        """The same as packed ids."""
        if self.special is None or self.mark not in text:
            yield from self._plain(text)
            return
        at = 0
        for m in self.special.finditer(text):
            yield from self._plain(text[at:m.start()])
            yield pack([self.v.added[m[0]]])
            at = m.end()
        yield from self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> Iterator[bytes]:
        carry, run, kind, at = "", None, "", 0
        while at < len(text) or carry:
            chunk = carry + text[at:at + CHUNK]
            at += CHUNK
            last = at >= len(text)
            carry = ""
            if run is not None:
                m = self.runs[kind].match(chunk)
                end = m.end() if m else 0
                if end == len(chunk) and not last:
                    end -= kind == "spaces"          # its last space may belong to the next piece
                    yield pack(run.feed(chunk[:end].encode("utf-8", "surrogatepass")))
                    carry = chunk[end:]
                    continue
                end -= kind == "spaces" and end > 0 and end < len(chunk)
                yield pack(run.feed(chunk[:end].encode("utf-8", "surrogatepass")))
                yield pack(run.close())
                run, chunk = None, chunk[end:]
            pieces = self.split(chunk)
            if not last:
                held = 0
                while pieces and held < HOLD:
                    held += len(pieces[-1])
                    carry = pieces.pop() + carry
                if pieces or held < LONG_PIECE:
                    pass
                else:
                    first = self.split(carry)[0]
                    if len(first) >= LONG_PIECE and len(first) == len(carry):
                        kind = next(k for k, p in self.runs.items() if p.fullmatch(carry[-1]))
                        end = len(carry) - (kind == "spaces")
                        run = Run(self)
                        yield pack(run.feed(carry[:end].encode("utf-8", "surrogatepass")))
                        carry = carry[end:]
            yield b"".join(map(self.cache.__getitem__, pieces))


class Run:
    """One piece of any length: holds at most a window of bytes, emits stable tokens."""

    def __init__(self, encoder: Encoder):
        self.e, self.held = encoder, b""
        self.window = 4 * encoder.v.lookahead + 1024

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        lookahead, lengths = self.e.v.lookahead, self.e.v.bytes_of
        self.held += data
        at = 0
        while len(self.held) - at > self.window:
            end = 0
            for i in self.e.merge(self.held[at:at + self.window]):
                if end + len(lengths[i]) > self.window - lookahead:
                    break
                out.append(i)
                end += len(lengths[i])
            at += end
        self.held = self.held[at:]
        return out

    def close(self) -> list[int]:
        held, self.held = self.held, b""
        return self.e.merge(held)


class Decoder:
    """Incremental: token bytes in, text out; an unfinished character waits in the state."""

    def __init__(self, vocabulary: Vocabulary):
        self.of = vocabulary.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        n = len(self.of)
        return self.state.decode(b"".join([self.of[i] for i in ids if 0 <= i < n]))

    def close(self) -> str:
        return self.state.decode(b"", True)


# ---------------------------------------------------------------- Spark

_loaded: dict[str, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Encoder(Vocabulary(spec))
    return _loaded[key]


def _read_spec(df: DataFrame, path: str):
    text_batches(df)
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > MOST_SPEC_BYTES:
        raise ValueError("tokenizer file too large to ship to executors")
    Vocabulary(spec)   # a wrong file fails here, on the driver
    return df.sparkSession.sparkContext.broadcast(spec)


def _replace(batch: pa.RecordBatch, schema_names: list[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in schema_names], names=schema_names)


def _with(df: DataFrame, new: list[StructField]) -> StructType:
    names = {f.name for f in new}
    return StructType([f for f in df.schema.fields if f.name not in names] + new)


def _encode_batch(encoder: Encoder, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    packed = [b"".join(encoder.packed(text.as_py() or "")) for text in texts]
    return pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary())


def _decode_batch(vocabulary: Vocabulary, ids: pa.Array, step: int = 8192) -> pa.Array:
    texts = []
    for packed in ids:
        own = np.frombuffer(packed.as_py() or b"", "<u4")
        machine = Decoder(vocabulary)
        out = [machine.feed(own[k:k + step].tolist()) for k in range(0, len(own), step)]
        texts.append("".join([*out, machine.close()]))
    return pa.array(texts, pa.string())


def _map(df: DataFrame, path: str, new: list[StructField], run) -> DataFrame:
    """``run(encoder, batch) -> new columns`` over slices of at most 256 rows."""
    spec = _read_spec(df, path)
    schema = _with(df, new)
    names = schema.names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec.value)
        for batch in released(batches):
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield _replace(part, names, run(encoder, part))

    return df.mapInArrow(work, schema)


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", count_col: str = "n_tokens") -> DataFrame:
    """Append ``ids`` (binary: token ids as little-endian unsigned 32-bit integers, the
    usual packed form of token shards) and ``n_tokens``.

    Ids equal the tokenizer's without special tokens added; the strings of added tokens
    in a text become their ids.  A null or empty text gives no ids.  Input columns named
    like the new ones are replaced, all others pass unchanged, rows are neither lost nor
    merged.
    """
    def run(encoder: Encoder, part: pa.RecordBatch) -> dict[str, pa.Array]:
        counts, ids = _encode_batch(encoder, part.column(text_col))
        return {count_col: counts, ids_col: ids}

    return _map(df, path, [StructField(count_col, LongType()), StructField(ids_col, BinaryType())], run)


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Append ``decoded``: the text of packed ``ids``.  Null or empty ids give the empty
    text, ids outside the vocabulary are passed over, malformed bytes become U+FFFD."""
    return _map(df, path, [StructField(text_col, StringType())],
                lambda encoder, part: {text_col: _decode_batch(encoder.v, part.column(ids_col))})


def encode_and_decode(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass over the rows: append ``n_tokens``, ``ids`` and
    ``decoded``, with the same rules."""
    def run(encoder: Encoder, part: pa.RecordBatch) -> dict[str, pa.Array]:
        counts, ids = _encode_batch(encoder, part.column(text_col))
        return {"n_tokens": counts, "ids": ids, "decoded": _decode_batch(encoder.v, ids)}

    return _map(df, path, [StructField("n_tokens", LongType()), StructField("ids", BinaryType()), StructField("decoded", StringType())], run)


def unpack(c):
    """Packed ids as ``array<bigint>``, with SQL functions."""
    h = F.hex(c)
    n = (F.length(h) / 8).cast("int")
    def word(k):
        s = F.substr(h, k * 8 + 1, F.lit(8))
        le = F.concat(F.substr(s, F.lit(7), F.lit(2)), F.substr(s, F.lit(5), F.lit(2)),
                      F.substr(s, F.lit(3), F.lit(2)), F.substr(s, F.lit(1), F.lit(2)))
        return F.conv(le, 16, 10).cast("bigint")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), word)).otherwise(F.array().cast("array<bigint>"))
