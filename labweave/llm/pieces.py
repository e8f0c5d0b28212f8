"""SentencePiece BPE encoding that keeps offsets, and decoding.

The text is normalised by the longest matching prefix in the model's compiled character map; every normalised byte remembers the source
byte it came from. Pieces are cut on the normalised text and projected back to byte spans of the source. The model file is read by the
driver (its size bounds what is sent to the tasks) and its path is a parameter.

Defined cases: a null text counts as empty; an empty text has no pieces. Texts are encoded whole, however long. Only BPE models
without user-defined or unused pieces are accepted. Equal texts give equal rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from labweave.llm.arrays import text_blocks

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2
#: Words in each of two stores a task keeps; when the newer is full it becomes the older, so memory has a bound.
CACHE_WORDS = 300_000
#: Up to so many symbols a plain scan for the best pair beats a heap.
SCAN_SYMBOLS = 48
#: Segments longer than this are cut one by one and not kept.
LONGEST_KEPT = 40
#: Segments of one length that are cut together, and bytes of texts that are prepared together.
MATRIX_ROWS, PREPARED_BYTES = 4096, 4 << 20
NO_RANK = np.iinfo(np.int64).max


class CharacterMap:
    """The compiled normalisation map of a model: a double-array trie over UTF-8 bytes and a block of replacement strings."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.texts = b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix at ``at`` and its replacement."""
        if not self.units:
            return None
        found = None
        node = self._child(self.units[0], 0)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = self.units[node] if node < len(self.units) else 0
            if unit & 0x800000FF != data[i]:
                break
            node = self._child(unit, node)
            if unit & 0x100:
                found = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        length, start = found
        return length, self.texts[start : self.texts.index(b"\0", start)]

    @staticmethod
    def _child(unit: int, node: int) -> int:
        return node ^ ((unit >> 10) << ((unit & 0x200) >> 6))


class PieceModel:
    """A BPE model: its normaliser, its pieces, and a bounded store of words already cut."""

    def __init__(self, serialized: bytes):
        from sentencepiece import sentencepiece_model_pb2 as schema

        proto = schema.ModelProto()
        proto.ParseFromString(serialized)
        if proto.trainer_spec.model_type != BPE:
            raise ValueError("only BPE models are supported")
        odd = {p.type for p in proto.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}
        if odd:
            raise ValueError(f"pieces of types {sorted(odd)} are not supported")
        if proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("white space as a suffix is not supported")
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.texts = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.unknown = self.kinds.index(UNKNOWN)
        self.unknown_text = proto.trainer_spec.unk_surface
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        levels = {s: n for n, s in enumerate(sorted({proto.pieces[i].score for i in self.ids.values()}, reverse=True))}
        self.rank = {t: levels[proto.pieces[i].score] for t, i in self.ids.items()}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        # words can be cut apart where no piece ever joins them
        inner = any(SPACE in t.lstrip(SPACE) for t in self.ids)
        self.segments = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if not inner else "(?s:.+)")
        self.plain = not self.map.units and not self.squeeze and self.dummy and self.escape and not inner
        self.raw, lengths = [], []
        for i, (piece, kind) in enumerate(zip(self.texts, self.kinds)):
            own = bytes([self.byte_of[i]]) if kind == BYTE else piece.encode() if kind == NORMAL else b""
            lengths.append(len(own))
            self.raw.append(self.unknown_text.encode() if kind == UNKNOWN else own.replace(SPACE.encode(), b" "))
        self.sizes = np.array(lengths, np.int64)
        # single characters by code, and every pair of symbols that makes a piece; other characters count from the number of pieces on
        self.symbol = np.full(0x10000, -1, np.int32)
        for text, i in self.ids.items():
            if len(text) == 1 and ord(text) < 0xFFFF:  # the last entry stands for all codes beyond
                self.symbol[ord(text)] = i
        pairs = []
        for text, i in self.ids.items():
            for at in range(1, len(text)):
                left, right = (
                    len(self.texts) + ord(x) if len(x) == 1 and (x not in self.ids or ord(x) >= 0xFFFF) else self.ids.get(x) for x in (text[:at], text[at:])
                )
                if left is not None and right is not None:
                    pairs.append(((left << 22) | right, self.rank[text], i))
        table = np.array(sorted(pairs), np.int64).reshape(-1, 3)
        self.pair_keys, self.pair_ranks, self.pair_joined = table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy()
        self.numbers = list(map(str, range(len(self.texts))))
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its UTF-8 bytes and the end, the source byte where it comes from."""
        data = text.encode()
        if not self.map.units and not self.squeeze and self.escape:
            widths = np.where(np.frombuffer(data, np.uint8) == 32, 3, 1)
            align = np.repeat(np.arange(len(data)), widths)
            lead = 3 if self.dummy and data else 0
            return (SPACE if lead else "") + text.replace(" ", SPACE), np.concatenate([np.zeros(lead, np.int64), align, [len(data)]])
        out, align, at = bytearray(), [], 0
        mark = SPACE.encode() if self.escape else b" "
        spaced = self.squeeze  # leading white space goes when extra white space does
        pending_lead = self.dummy
        while at < len(data):
            found = self.map.longest(data, at)
            if found is None:
                length = 1
                while at + length < len(data) and data[at + length] & 0xC0 == 0x80:
                    length += 1
                found = length, data[at : at + length]
            length, new = found
            if self.squeeze and spaced:
                new = new.lstrip(b" ")
            if new:
                if pending_lead:
                    out += mark
                    align += [at] * len(mark)
                    pending_lead = False
                literal = new == data[at : at + length]
                for i, b in enumerate(new):
                    piece = mark if b == 32 else bytes([b])
                    out += piece
                    align += [at + i if literal else at] * len(piece)
                spaced = self.squeeze and new.endswith(b" ")
            at += length
        end = len(data)
        if self.squeeze:
            while out.endswith(mark):
                end = align[len(out) - len(mark)]
                del out[-len(mark) :], align[-len(mark) :]
        return out.decode(), np.array([*align, end], np.int64)

    def merge(self, symbols: list[str]) -> list[str]:
        """Join the best pair, the leftmost of equals, until no pair is a piece."""
        if len(symbols) > SCAN_SYMBOLS:
            return self._merge_heap(symbols)
        rank, none = self.rank.get, len(self.rank) + 1
        scores = [rank(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while scores:
            best = min(scores)
            if best == none:
                break
            i = scores.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = rank(symbols[i - 1] + symbols[i], none)
            if i < len(scores):
                scores[i] = rank(symbols[i] + symbols[i + 1], none)
        return symbols

    def _merge_heap(self, symbols: list[str]) -> list[str]:
        rank, n = self.rank.get, len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def offer(a: int, b: int) -> None:
            joined = symbols[a] + symbols[b]
            if (r := rank(joined)) is not None:
                heapq.heappush(heap, (r, a, b, joined))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if not symbols[a] or not symbols[b] or right[a] != b or symbols[a] + symbols[b] != joined:
                continue
            symbols[a], symbols[b] = joined, ""
            right[a] = right[b]
            if right[a] < n:
                left[right[a]] = a
                offer(a, right[a])
            if left[a] >= 0:
                offer(left[a], a)
        return [s for s in symbols if s]

    def cut(self, segment: str) -> bytes:
        """The ids of one segment that is in neither store."""
        size = len(self.texts)
        return self.spell([size + ord(x) if (i := self.ids.get(x)) is None else i for x in self.merge(list(segment))])

    def fill(self, segments: set[str]) -> None:
        """Cut many new short segments at once: those of one length are the rows of a matrix and each round joins every row's best pair."""
        by_length: dict[int, list[str]] = {}
        for segment in segments:
            got = self.older.pop(segment, None)
            if got is None:
                by_length.setdefault(len(segment), []).append(segment)
            else:
                self.cache[segment] = got
        for length, group in by_length.items():
            for at in range(0, len(group), MATRIX_ROWS):
                part = group[at : at + MATRIX_ROWS]
                codes = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32).reshape(len(part), length)
                symbols, counts = self._merge_rows(self.symbol[np.minimum(codes, 0xFFFF)].astype(np.int64), codes)
                flat, width = symbols.astype(np.int32).tobytes(), 4 * length
                self.cache.update(zip(part, [flat[width * i : width * i + n] for i, n in enumerate((4 * counts).tolist())]))
                for i in np.flatnonzero(((symbols >= len(self.texts)) & (np.arange(length) < counts[:, None])).any(axis=1)).tolist():
                    self.cache[part[i]] = self.spell(symbols[i, : counts[i]].tolist())

    def spell(self, symbols: list[int]) -> bytes:
        """Ids of symbols of which some are single characters that are no piece."""
        ids: list[int] = []
        for s in symbols:
            if s < len(self.texts):
                ids.append(s)
            elif (own := self.ids.get(chr(s - len(self.texts)))) is not None:
                ids.append(own)
            elif self.bytes:
                ids += [self.bytes[b] for b in chr(s - len(self.texts)).encode()]
            else:
                ids.append(self.unknown)
        return np.array(ids, np.int32).tobytes()

    def _pair_scores(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and joined symbol of pairs; pairs that are no piece get the last rank."""
        keys = (left << 22) | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        found = self.pair_keys[at] == keys
        return np.where(found, self.pair_ranks[at], NO_RANK), self.pair_joined[at]

    def _merge_rows(self, symbols: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = symbols.shape
        symbols = np.where(symbols < 0, codes.astype(np.int64) + len(self.texts), symbols)
        counts = np.full(n, width)
        out = symbols.copy()
        if width == 1 or not len(self.pair_keys):
            return out, counts
        live = np.arange(n)
        ranks, joined = self._pair_scores(symbols[:, :-1], symbols[:, 1:])
        columns = np.arange(width)
        while True:
            best = ranks.argmin(axis=1)
            row = np.arange(len(live))
            going = ranks[row, best] != NO_RANK
            if not going.all():
                done = ~going
                out[live[done], : symbols.shape[1]] = symbols[done]
                counts[live[done]] = symbols.shape[1]
                live, symbols, ranks, joined, best = live[going], symbols[going], ranks[going], joined[going], best[going]
                row = np.arange(len(live))
            if not len(live):
                return out, counts
            symbols[row, best] = joined[row, best]
            wide = symbols.shape[1] - 1
            symbols = np.take_along_axis(symbols, columns[:wide] + (columns[:wide] > best[:, None]), axis=1)
            if wide == 1:
                out[live, 0], counts[live] = symbols[:, 0], 1
                return out, counts
            keep = columns[: wide - 1] + (columns[: wide - 1] >= best[:, None])
            ranks, joined = np.take_along_axis(ranks, keep, axis=1), np.take_along_axis(joined, keep, axis=1)
            for shift in (-1, 0):
                touched = np.flatnonzero((best + shift >= 0) & (best + shift < wide - 1))
                at = best[touched] + shift
                ranks[touched, at], joined[touched, at] = self._pair_scores(symbols[touched, at], symbols[touched, at + 1])

    def segments_of(self, text: str, normalised: str | None = None) -> list[str]:
        if not text:
            return []
        if self.plain and "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " ":
            return [SPACE + w for w in text.split(" ")]
        return self.segments.findall(self.normalise(text)[0] if normalised is None else normalised)

    def ids_of(self, segments: list[str]) -> np.ndarray:
        try:
            parts = list(map(self.cache.__getitem__, segments))
        except KeyError:
            known = self.cache.get
            parts = [known(s) or self.cut(s) for s in segments]
        return np.frombuffer(b"".join(parts), np.int32)

    def prepare(self, texts: list[str]) -> list[list[str]]:
        """Segments of some texts, with all new short ones cut together."""
        segments = [self.segments_of(t) for t in texts]
        new: set[str] = set()
        for each in segments:
            new.update(each)
        if len(self.cache) > CACHE_WORDS:
            self.older, self.cache = self.cache, {}
        new -= self.cache.keys()
        self.fill({s for s in new if len(s) <= LONGEST_KEPT})
        return segments

    def encode(self, text: str, segments: list[str] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the source bytes where each piece begins and ends. An unknown symbol counts its own bytes."""
        normalised, align = self.normalise(text)
        ids = self.ids_of(self.segments_of(text, normalised) if segments is None else segments)
        if not self.bytes and (ids == self.unknown).any():
            sizes = np.array([len(s.encode()) for x in self.segments.findall(normalised) for s in self.merge(list(x))], np.int64)
        else:
            sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return ids, align[ends - sizes], align[ends]

    def surface(self, ids) -> str:
        """Pieces as text; runs of byte pieces are read as UTF-8. The leading mark of the whole text still stands."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")

    def finish(self, surface: str) -> str:
        """Take off the space that normalising put in front."""
        if self.dummy or self.squeeze:
            return surface.lstrip(" ") if self.squeeze else surface.removeprefix(" ")
        return surface

    def decode(self, ids) -> str:
        return self.finish(self.surface(ids))


@lru_cache(maxsize=2)
def loaded(serialized: bytes) -> PieceModel:
    """One model per task's process, as its store of words serves all batches."""
    return PieceModel(serialized)


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _encoded(model: PieceModel, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Encodings of a column's texts in order, some megabytes of texts at a time."""
    for row, _, offsets in text_blocks(column, PREPARED_BYTES):
        texts = [x or "" for x in column.slice(row, len(offsets) - 1).to_pylist()]
        for text, segments in zip(texts, model.prepare(texts)):
            yield model.encode(text, segments)


def encode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text as ``ids`` with the source byte spans ``starts`` and ``ends`` of its pieces."""
    serialized = read_model(model_path)

    def run(batches):
        model = loaded(serialized)
        for batch in batches:
            rows = list(_encoded(model, batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.list_(pa.int32())), *(pa.array([r[i] for r in rows], pa.list_(pa.int64())) for i in (1, 2))],
                ["key", "ids", "starts", "ends"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"key {kind}, ids array<int>, starts array<bigint>, ends array<bigint>").withColumnRenamed("key", key)


def decode(rows: DataFrame, model_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """The text of every array of ids; a null array gives an empty text."""
    serialized = read_model(model_path)

    def run(batches):
        model = loaded(serialized)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.decode(x.as_py() or []) for x in batch.column(1)], pa.string())], ["key", "text"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, ids).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of encoding and decoding in one pass: ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and ``spans_sha256`` (of the
    pieces' source byte spans, as 64-bit little-endian begins, then ends)."""
    serialized = read_model(model_path)

    def digest(value: bytes) -> str:
        return hashlib.sha256(value).hexdigest()

    def run(batches):
        model = loaded(serialized)
        for batch in batches:
            out = []
            for ids, begins, ends in _encoded(model, batch.column(1)):
                plain = ids.tolist()
                out.append((
                    len(plain), digest(",".join(map(model.numbers.__getitem__, plain)).encode()),
                    digest(model.decode(plain).encode()), digest(begins.tobytes() + ends.tobytes()),
                ))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:])],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string").withColumnRenamed("key", key)
