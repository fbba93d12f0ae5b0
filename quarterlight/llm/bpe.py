"""Byte-level BPE as a streaming transducer, and an incremental decoder.

From the merge list we compute a lookahead K: a token boundary that lies more than
K bytes before the end of what has been read cannot change, whatever follows. The
encoder reads a piece in bounded windows, merges what it holds, emits the tokens
that end K or more bytes before the window's end, and goes on from the last stable
boundary. No merge crosses a boundary of the final result, so the part before it
and the part after it merge independently, and memory stays constant in the length
of the piece. The decoder is a byte-to-text state machine that keeps at most three
pending bytes.

A text is read from its Arrow buffer in blocks that end where no piece goes on (a blank after
a visible ASCII character); where there is no such place, pieces are found one at a time and
long ones are fed to the transducer in chunks. So the working memory is that of a block,
whatever the text's length; ids and decoded text are hashed block by block. Encoder state lives
in a task and is rebuilt if the task runs again.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# Fixed value: the pre-tokenizer's pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that are remembered are no longer than this, and so many at most.
CACHED_BYTES, CACHED_PIECES = 64, 200_000
#: Bytes of text in a block, and characters of a long piece encoded at a time.
BLOCK, CHUNK = 1 << 16, 1 << 12
#: A window is this many times the lookahead.
WINDOW = 4


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte, as a map back to the byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes before the end of what is read that an unknown continuation can still change.

    Two runs that differ only beyond the end diverge from there leftwards. ``reach[s]`` is
    how far the divergence can have moved when ``s`` is the first symbol right of it. A
    merge (a, b) moves it over ``a`` if ``b`` may stand there, and later merges have later
    ranks, so one pass in rank order gives the longest chain.
    """
    reach: dict[bytes, int] = {}
    most = 0
    for a, b in merges:
        moved = reach.get(b, 0) + len(a)
        most = max(most, moved)
        kept = reach.get(a, 0)
        reach[a] = max(kept, moved)
        reach[a + b] = max(reach.get(a + b, 0), moved, kept)
    return most


class Vocabulary:
    """Ids, merge ranks and added tokens of a tokenizer file of the byte-level kind."""

    def __init__(self, text: str):
        spec = json.loads(text)
        letters = byte_alphabet()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        model = spec["model"]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.ids = {to_bytes(k): v for k, v in model["vocab"].items() if all(c in letters for c in k)}
        self.bytes_of = {v: k for k, v in self.ids.items()} | {v: k.encode() for k, v in added.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = [(to_bytes(a), to_bytes(b)) for a, b in pairs]
        self.rank = {m: i for i, m in reversed(list(enumerate(self.merges)))}
        self.added = added
        self.lookahead = sufficient_lookahead(self.merges)

    def merge_short(self, piece: bytes) -> list[bytes]:
        """``merge`` for pieces of so few bytes that a scan of the ranks is faster than a heap."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        rank, none = self.rank.get, len(self.rank)
        ranks = [rank(pair, none) for pair in zip(parts, parts[1:], strict=False)]
        while ranks and (r := min(ranks)) < none:
            i = ranks.index(r)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
        return parts

    def merge(self, piece: bytes) -> list[bytes]:
        """All merges of a bounded piece, lowest rank first, leftmost first among equals."""
        rank = self.rank
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        if len(parts) < 2:
            return parts  # type: ignore[return-value]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) >= n or rank.get((parts[i], parts[j])) != r:
                continue
            parts[i] += parts[j]  # type: ignore[operator]
            parts[j] = None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := rank.get((parts[i], parts[after[i]]))) is not None:
                    heapq.heappush(heap, (x, i))
            if (p := before[i]) >= 0 and (x := rank.get((parts[p], parts[i]))) is not None:
                heapq.heappush(heap, (x, p))
        return [p for p in parts if p is not None]

    def stream(self, chunks: Iterable[bytes]) -> Iterator[bytes]:
        """The tokens of one piece that arrives in chunks; at most a window is held."""
        held, most = b"", self.lookahead * WINDOW
        for chunk in chunks:
            for i in range(0, len(chunk), most):
                held += chunk[i : i + most]
                if len(held) > most:
                    at, stable = 0, len(held) - self.lookahead
                    for token in self.merge(held):
                        if at + len(token) > stable:
                            break
                        yield token
                        at += len(token)
                    held = held[at:]
        yield from self.merge(held)


class Pieces(dict):
    """Ids of pieces as little-endian 32-bit bytes, made at first use; a bounded number of short ones is remembered."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, text: str) -> bytes:
        if len(text) * 4 > CACHED_BYTES and len(text.encode()) > CACHED_BYTES:
            return b"".join(self.encoder.long_piece(text, 0, len(text)))
        ids = b"".join([self.encoder.v.ids[t].to_bytes(4, "little") for t in self.encoder.v.merge_short(text.encode())])
        if len(self) >= CACHED_PIECES:
            self.clear()
        self[text] = ids
        return ids


class Encoder:
    """Text to ids as little-endian 32-bit bytes, with a bounded memory of short pieces."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.v = vocabulary
        pattern = regex.compile(PATTERN)
        self.find, self.find_each = pattern.findall, pattern.finditer
        self.seen = Pieces(self)
        special = sorted(vocabulary.added, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        # Blocks end before a blank after a visible character; an added token with such a place in it would be cut.
        self.end = None if any(regex.search(r"[!-~] ", t) for t in special) else re.compile(rb"[!-~](?= )")

    def long_piece(self, text: str, a: int, z: int) -> Iterator[bytes]:
        ids = self.v.ids
        for token in self.v.stream(text[i : min(i + CHUNK, z)].encode("utf-8") for i in range(a, z, CHUNK)):
            yield ids[token].to_bytes(4, "little")

    def plain(self, text: str, a: int, z: int) -> Iterator[bytes]:
        """The ids of text[a:z]: of a block at once, of more text piece by piece."""
        if z - a <= 2 * BLOCK:
            yield b"".join(map(self.seen.__getitem__, self.find(text, a, z)))
            return
        for m in self.find_each(text, a, z):
            yield from self.long_piece(text, *m.span())

    def block(self, text: str) -> Iterator[bytes]:
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield from self.plain(text, at, m.start())
            yield self.v.added[m.group()].to_bytes(4, "little")
            at = m.end()
        yield from self.plain(text, at, len(text))

    def blocks(self, raw) -> Iterator[bytes]:
        """Ids of a whole UTF-8 text (any bytes-like object), a bounded part at a time."""
        n, at = len(raw), 0
        while at < n:
            cut = None
            if self.end and n - at > BLOCK:
                found = self.end.search(raw, at + BLOCK)
                cut = found.end() if found else None
            text = str(raw[at : cut or n], "utf-8")
            at = cut or n
            held, size = [], 0
            for ids in self.block(text):
                held.append(ids)
                size += len(ids)
                if size >= BLOCK:
                    yield b"".join(held)
                    held, size = [], 0
            if held:
                yield b"".join(held)

    def encode(self, text: str) -> bytes:
        return b"".join(self.blocks(text.encode("utf-8")))


class Decoder:
    """Ids to text, piece by piece; bytes that are no UTF-8 become U+FFFD."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes_of = vocabulary.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def end(self) -> str:
        return self.state.decode(b"", True)


def decode(vocabulary: Vocabulary, blocks: Iterable[bytes]) -> Iterator[str]:
    machine = Decoder(vocabulary)
    for ids in blocks:
        yield machine.feed(array("I", ids))
    yield machine.end()


def _digests(vocabulary: Vocabulary, blocks: Iterable[bytes], keep: list[bytes] | None = None) -> tuple[int, str, str]:
    """Number of ids, and SHA-256 of the ids and of the text decoded from them; ``keep`` gets the blocks."""
    n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()

    def passing() -> Iterator[bytes]:
        nonlocal n
        for ids in blocks:
            n += len(ids) // 4
            of_ids.update(ids)
            if keep is not None:
                keep.append(ids)
            yield ids

    for part in decode(vocabulary, passing()):
        of_text.update(part.encode("utf-8"))
    return n, of_ids.hexdigest(), of_text.hexdigest()


def read_vocabulary(spark, path: str) -> str:
    """The tokenizer file's text; its size is that of the vocabulary, a few MB, whatever the data."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _tasks(df: DataFrame, vocabulary: str, work, schema: str, id_col: str, text_col: str) -> DataFrame:
    """Run ``work(encoder, UTF-8 bytes)`` over the texts in Arrow batches; a null text is empty."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    names = [x.split(" ")[0] for x in schema.split(", ")]
    types = [x.split(" ")[1] for x in schema.split(", ")[1:]]

    def run(batches):
        import pyarrow as pa

        kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t] for t in types]
        encoder = Encoder(Vocabulary(shared.value))
        for batch in slices(batches, 256):
            rows = [work(encoder, memoryview(t.as_buffer()) if t.is_valid else b"") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def encode_documents(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the token ids (binary, little-endian 32-bit) of every whole text; null: empty. Null ids and repeated rows are kept; an empty table gives no rows."""
    return _tasks(df, vocabulary, lambda e, raw: (b"".join(e.blocks(raw)),), "doc_id long, ids binary", id_col, text_col)


def digest_documents(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, decode, and digest both.

    A null text counts as empty (0 tokens). Null ids and repeated rows are kept as they
    are. An empty table gives no rows. Other columns are not read.
    """
    return _tasks(df, vocabulary, lambda e, raw: _digests(e.v, e.blocks(raw)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text_col)


def tokenize_documents(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian 32-bit) and the digests of ``digest_documents``; here the ids of a text are held whole, as they are the result.

    Null texts, null ids, repeated rows and empty tables are treated as there.
    """

    def work(encoder, raw):
        kept: list[bytes] = []
        found = _digests(encoder.v, encoder.blocks(raw), kept)
        return b"".join(kept), *found

    return _tasks(df, vocabulary, work, "doc_id long, ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text_col)
