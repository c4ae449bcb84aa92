"""Removal of repeated byte strings by a distributed difference-cover comparison of suffixes.

Only the first ``length`` bytes of suffixes matter here, so the difference-cover algorithm runs to that depth:

1. Suffixes at the places of a difference cover modulo 57 are sampled. Any two places have a common distance below 57 at
   which both are sampled, so two equal 200-byte strings contain equal samples of 144 bytes. Samples are named (by a
   fingerprint of their bytes), sorted, and those whose name is unique drop out.
2. The remaining suffixes, sampled or not, that a tied sample can reach are named to full depth, sorted and merged.
3. Those whose name is found in two places are named once more, by polynomials modulo a prime that have nothing to do with
   the first names. Places that have company under both names are the repeats; what they cover is removed.

Texts travel once, as packs of about 1 MB, to the partitions in which all later steps find them; a longer text is cut into
pieces that overlap by length - 1 bytes, so that every string starts in one piece. Names travel as sorted arrays, one for
each pack and name range, with inner duplicates taken out first, so that a passage in a third of all documents adds one entry
a pack to one range. Ranges are about as many as the input has blocks of 6 MB. What comes back is one bit a name, and one bit
a byte tells the next step which places are left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, settled

#: A perfect difference set modulo 57, every non-zero residue is the difference of exactly one pair.
COVER_MOD = 57
COVER = (0, 1, 3, 13, 32, 36, 43, 52)
#: Bits of first names up to some 100 GB; more for more (see remove_repeats).
FIRST_BITS, SECOND_BITS = 50, 61

_BASE = 0x9E3779B97F4A7C15  # 5 modulo 8
_BYTES = np.random.default_rng(20240501).integers(0, 2**64, 256, dtype=np.uint64)
_PRIME = (1 << 31) - 1
_POINTS = (0x2C5E9B41, 0x61D3A8F7)
_COVERED = np.isin(np.arange(COVER_MOD), COVER)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


@lru_cache(4)
def _prime_powers(n: int, base: int) -> np.ndarray:
    out = np.ones(n, np.uint32)
    k = 1
    while k < n:
        out[k : 2 * k] = out[: min(k, n - k)].astype(np.uint64) * pow(base, k, _PRIME) % _PRIME
        k *= 2
    return out


def _folded(x: np.ndarray) -> np.ndarray:
    """A smaller number of the same remainder modulo 2**31 - 1: below 2**32 + 2**31 for any x, at most 2**31 from there."""
    return (x & np.uint64(_PRIME)) + (x >> np.uint64(31))


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Pack:
    """Bytes of some texts in a row, their bounds, and fingerprints of their windows."""

    def __init__(self, data: bytes, lengths: np.ndarray):
        self.data = np.frombuffer(data, np.uint8)
        self.lengths = lengths.astype(np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        n = len(self.data)
        self.up, self.down = _powers(max(1 << 20, 1 << int(n).bit_length()))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[self.data] * self.up[:n], out=self.sums[1:])

    def names(self, at: np.ndarray, width: int) -> np.ndarray:
        """Mixed 64-bit fingerprints of the ``width`` bytes from each place."""
        return _mixed((self.sums[at + width] - self.sums[at]) * self.down[at])

    def second_names(self, at: np.ndarray, width: int) -> np.ndarray:
        """Fingerprints that are independent of ``names``: the windows as polynomials at two points modulo a prime, 62 bits, mixed."""
        h = np.zeros(len(at), np.uint64)
        n, size = len(self.data), len(self.up)
        signs = self.data.astype(np.uint64) + np.uint64(1)
        for base in _POINTS:
            up, down = _prime_powers(size, base), _prime_powers(size, pow(base, -1, _PRIME))
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_folded(signs * up[:n]), out=sums[1:])
            h <<= np.uint64(31)
            value = _folded(_folded(_folded(sums[at + width] - sums[at]) * down[at]))
            h |= np.where(value >= _PRIME, value - np.uint64(_PRIME), value)
        return _mixed(h)

    def sampled(self, length: int) -> np.ndarray:
        """Places of the difference cover, counted from each text's start, whose sample fits into a text of ``length`` bytes or more."""
        out = []
        for a, n in zip(self.starts.tolist(), self.lengths.tolist(), strict=True):
            if n >= length:
                last = n - (length - COVER_MOD + 1)
                out.append(a + np.flatnonzero(np.resize(_COVERED, last + 1)))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def reachable(self, tied: np.ndarray, length: int) -> np.ndarray:
        """Places whose ``length`` bytes fit into their text and hold a tied sample within the cover's reach."""
        marks = np.zeros(len(self.data) + 1, np.int32)
        owner = np.searchsorted(self.ends, tied, "right")
        first = np.maximum(tied - COVER_MOD + 1, self.starts[owner])
        last = np.minimum(tied, self.ends[owner] - length)
        ok = first <= last
        np.add.at(marks, first[ok], 1)
        np.add.at(marks, last[ok] + 1, -1)
        return np.flatnonzero(np.cumsum(marks[:-1], dtype=np.int32) > 0)


def _squeeze(values: np.ndarray) -> bytes:
    """A sorted array as differences, byte plane by byte plane; the upper planes compress."""
    steps = np.diff(values, prepend=np.uint64(0))
    return pa.Codec("zstd", compression_level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), asbytes=True)


def _expand(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(blob, 8 * n, asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


class Names:
    """Distinct names in order, cut into ranges; ``bits``: bits of a name that count."""

    def __init__(self, names: np.ndarray, ranges: int, bits: int):
        names >>= np.uint64(64 - bits)
        self.order = np.argsort(names, kind="stable")
        ranked = names[self.order]
        new = np.ones(len(ranked), bool)
        np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
        self.place = np.cumsum(new, dtype=np.int32) - 1
        self.values = ranked[new]
        self.twice = np.diff(np.flatnonzero(np.append(new, True))) > 1
        parts = ((self.values >> np.uint64(bits - 24)) * np.uint64(ranges)) >> np.uint64(24)
        self.cuts = np.flatnonzero(np.diff(parts, prepend=np.uint64(1 << 63)))
        self.parts = parts[self.cuts]

    def blobs(self) -> Iterator[tuple[int, int, bytes]]:
        """Range number, number of names and the names."""
        for k, a, b in zip(self.parts, self.cuts, [*self.cuts[1:], len(self.values)]):  # no names, no range
            yield int(k), int(b - a), _squeeze(self.values[a:b])

    def shared(self, answers: Iterator[tuple[int, bytes]]) -> np.ndarray:
        """For each of the names given at first: whether it is there twice or an answer has its bit."""
        flags = self.twice
        begins = dict(zip(self.parts.tolist(), self.cuts.tolist(), strict=True))
        for k, bits in answers:
            flags[begins[k] + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8)))] = True
        out = np.empty(len(self.order), bool)
        out[self.order] = flags[self.place]
        return out


def _places(places: np.ndarray, n: int) -> bytes:
    """Places among n bytes, as a compressed bit a byte."""
    mask = np.zeros(n, np.uint8)
    mask[places] = 1
    return pa.Codec("zstd", compression_level=1).compress(np.packbits(mask).tobytes(), asbytes=True)


def _places_of(blob: bytes, n: int) -> np.ndarray:
    bits = pa.Codec("zstd").decompress(blob, -(-n // 8), asbytes=True)
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=n))


def _match(group: pd.DataFrame) -> pd.DataFrame:
    """Of one range: for each pack the bits of names that another pack has too. Places that a step keeps pass as they are."""
    if group["part"].iloc[0] < 0:
        return pd.DataFrame({"pack": group["pack"], "part": -1, "bits": group["names"]})
    sizes = group["n"].tolist()
    values = np.empty(sum(sizes), np.uint64)
    at = 0
    for blob, n in zip(group["names"], sizes, strict=True):
        values[at : at + n] = _expand(blob, n)
        at += n
    order = np.argsort(values, kind="stable")
    values = values[order]
    equal = values[1:] == values[:-1]
    shared = np.zeros(len(values), bool)
    shared[order[1:][equal]] = True
    shared[order[:-1][equal]] = True
    packs, bits, at = [], [], 0
    for pack, n in zip(group["pack"], sizes, strict=True):
        own = shared[at : at + n]
        at += n
        if own.any():
            packs.append(pack)
            bits.append(np.packbits(own).tobytes())
    return pd.DataFrame({"pack": np.array(packs, np.int64), "part": int(group["part"].iloc[0]), "bits": bits})


_PACK = ["pack", "ids", "rows", "pieces", "own", "lengths", "data"]


def _pack_up(size: int, overlap: int, kind: pa.DataType) -> Callable:
    """Texts as packs of about ``size`` bytes: ids, row numbers, number of the piece (from 0; -1: a whole text), bytes of its own, and all its bytes."""
    types = [pa.int64(), pa.list_(kind), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: list[tuple] = []
        parts, total = [], 0
        number = row = TaskContext.get().partitionId() << 32
        codec = pa.Codec("zstd", compression_level=3)

        def flush() -> pa.RecordBatch:
            nonlocal entries, parts, total, number
            number += 1
            columns = [number, *map(list, zip(*entries, strict=True)), codec.compress(b"".join(parts), asbytes=True)]
            entries, parts, total = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, types, strict=True)], _PACK)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_buffer() if text.is_valid else pa.py_buffer(b"")
                row += 1
                if entries and total + raw.size > size:
                    yield flush()
                if raw.size <= size:
                    entries.append((i, row, -1, raw.size, raw.size))
                    parts.append(raw.to_pybytes())
                    total += raw.size
                    continue
                for k, a in enumerate(range(0, raw.size, size)):
                    own = min(size, raw.size - a)
                    piece = raw.slice(a, min(own + overlap, raw.size - a)).to_pybytes()
                    entries.append((i, row, k, own, len(piece)))
                    parts.append(piece)
                    yield flush()
        if entries:
            yield flush()

    return run


def _joined(texts: bool) -> Callable:
    """Of pieces in order (id, row, piece, body, mask) the rows of whole texts; one piece is in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, i, state = None, None, None
        rows: list[tuple] = []

        def closed() -> tuple:
            n, removed, spans, digest, kept = state["n"], state["removed"], state["spans"], state["sha"].hexdigest(), b"".join(state["kept"])
            return (i, n, removed, spans, digest, *([kept] if texts else []))

        def out(names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else [])]
        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.schema.field("id").type, pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if texts else [])]
            for k in range(batch.num_rows):
                row = batch.column("row")[k].as_py()
                if row != last:
                    if last is not None:
                        rows.append(closed())
                    last, i = row, batch.column("id")[k].as_py()
                    state = {"n": 0, "removed": 0, "spans": 0, "sha": hashlib.sha256(), "kept": [], "gone": 0, "carry": np.zeros(0, bool)}
                body = np.frombuffer(batch.column("body")[k].as_buffer(), np.uint8)
                mask = np.unpackbits(np.frombuffer(batch.column("mask")[k].as_buffer(), np.uint8)).astype(bool)
                mask[: len(state["carry"])] |= state["carry"]
                own = mask[: len(body)]
                state["carry"] = mask[len(body) :][: batch.column("more")[k].as_py()]
                kept = body[~own].tobytes()
                state["n"] += len(body)
                state["removed"] += int(own.sum())
                state["spans"] += int((np.diff(own.astype(np.int8), prepend=np.int8(state["gone"])) == 1).sum())
                state["gone"] = int(own[-1])
                state["sha"].update(kept)
                if texts:
                    state["kept"].append(kept)
            if rows:
                yield out(names, types)
                rows = []
        if last is not None:
            rows.append(closed())
            yield out(names, types)

    return run


def _open(data: bytes, lengths: np.ndarray) -> Pack:
    lengths = np.asarray(lengths, np.int64)
    n = int(lengths.sum())
    return Pack(pa.Codec("zstd").decompress(data, n, asbytes=True) if n else b"", lengths)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, texts: bool = False, pack_bytes: int = 1 << 20, range_bytes: int = 6 << 20) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for each row.

    A byte goes if a ``length``-byte string over it also starts anywhere else in the input, in the same text or another.
    Null texts are empty; texts shorter than ``length`` lose nothing; repeated rows are repeats of each other; an empty table
    gives none. With ``texts`` the remaining bytes come as ``kept`` (binary: a cut may fall inside a character). Other columns
    are not read. Texts of any length are looked at in pieces of ``pack_bytes``.

    First names have 50 bits, or as many more (61 at most) as keep n**3 / 2**(first + second bits) below a thousandth for n
    bytes; so many false repeats are expected where nothing repeats by chance.
    """
    if length <= COVER_MOD:
        raise ValueError(f"length must be over {COVER_MOD}")
    kind = docs.schema[id_col].dataType.simpleString()
    arrow = docs.select(id_col).limit(0).toArrow().schema.field(0).type
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    packed = docs.select(id_col, text_col).mapInArrow(_pack_up(pack_bytes, length - 1, arrow), f"pack long, ids array<{kind}>, rows array<long>, pieces array<int>, own array<long>, lengths array<long>, data binary")
    packs = settled(packed, "pack", total // (16 * pack_bytes))
    ranges = int(min(1 << 24, max(4, total // range_bytes)))
    sample = length - COVER_MOD + 1
    size = (total + 1).bit_length()
    sample_bits = min(60, max(32, size + 10))  # one false tie in 4,096 or so
    first_bits = min(61, max(FIRST_BITS, 3 * size + 10 - SECOND_BITS))

    def sample_names(pack: Pack) -> tuple[np.ndarray, Names]:
        at = pack.sampled(length)
        return at, Names(pack.names(at, sample), ranges, sample_bits)

    def ties(names: Names, answers: pd.DataFrame) -> np.ndarray:
        own = answers[answers["part"] >= 0]
        return names.shared(zip(own["part"], own["bits"], strict=True))

    def kept_places(pack: Pack, answers: pd.DataFrame) -> np.ndarray:
        return _places_of(answers.loc[answers["part"] < 0, "bits"].iloc[0], len(pack.data))

    def reached(pack: Pack, answers: pd.DataFrame) -> tuple[np.ndarray, Names]:
        at, names = sample_names(pack)
        places = pack.reachable(at[ties(names, answers)], length)
        return places, Names(pack.names(places, length), ranges, first_bits)

    def confirmed(pack: Pack, answers: pd.DataFrame) -> tuple[np.ndarray, Names]:
        places = kept_places(pack, answers)
        places = places[ties(Names(pack.names(places, length), ranges, first_bits), answers)]
        return places, Names(pack.second_names(places, length), ranges, SECOND_BITS)

    def repeated(pack: Pack, answers: pd.DataFrame) -> np.ndarray:
        places = kept_places(pack, answers)
        return places[ties(Names(pack.second_names(places, length), ranges, SECOND_BITS), answers)]

    def send_samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, lengths, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                blobs = list(sample_names(_open(data, lengths))[1].blobs())
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in blobs], pa.int32()), pa.array([pack] * len(blobs), pa.int64()), pa.array([n for _, n, _ in blobs], pa.int32()), pa.array([b for _, _, b in blobs], pa.binary())], ["part", "pack", "n", "names"])

    def send(named: Callable, left: bool) -> Callable:
        """Names of the places that are left, and these places themselves, for the next step; ``left``: the last step has said which."""

        def run(packed: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
            out = []
            for row in packed.itertuples():
                if not left or (answers["part"] < 0).any():
                    pack = _open(row.data, row.lengths)
                    places, names = named(pack, answers)
                    if len(places):
                        out += [(k, row.pack, n, b) for k, n, b in names.blobs()]
                        out.append((-1 - row.pack % ranges, row.pack, len(places), _places(places, len(pack.data))))
            return pd.DataFrame(out, columns=["part", "pack", "n", "names"])

        return run

    def cut(packed: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        for row in packed.itertuples():
            pack = _open(row.data, row.lengths)
            marks = np.zeros(len(pack.data) + 1, np.int32)
            if (answers["part"] < 0).any():
                repeats = repeated(pack, answers)
                np.add.at(marks, repeats, 1)
                np.add.at(marks, repeats + length, -1)
            gone = np.cumsum(marks[:-1], dtype=np.int32) > 0
            for i, place, piece, own, a, b in zip(row.ids, row.rows, row.pieces, row.own, pack.starts, pack.ends, strict=True):
                mask = gone[a:b]
                if piece < 0:
                    kept = pack.data[a:b][~mask].tobytes()
                    spans = int((np.diff(mask.astype(np.int8), prepend=0) == 1).sum())
                    rows.append((i, place, piece, b - a, int(mask.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if texts else None, None, None, 0))
                else:
                    rows.append((i, place, piece, 0, 0, 0, "", None, pack.data[a : a + own].tobytes(), np.packbits(mask).tobytes(), b - a - own))
        return pd.DataFrame(rows, columns=["id", "row", "piece", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "body", "mask", "more"])

    blob, answer = "part int, pack long, n int, names binary", "pack long, part int, bits binary"

    def ask(names: DataFrame, name: str) -> DataFrame:
        return materialize(names.groupBy("part").applyInPandas(_match, answer), name)

    def follow(work: Callable, answers: DataFrame, schema: str) -> DataFrame:
        return packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInPandas(work, schema)

    tied = ask(packs.select("pack", "lengths", "data").mapInArrow(send_samples, blob), "tied")
    found = ask(follow(send(reached, False), tied, blob), "found")
    equal = ask(follow(send(confirmed, True), found, blob), "equal")
    results = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    done = materialize(follow(cut, equal, f"id {kind}, row long, piece int, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, body binary, mask binary, more long"), "cut")
    whole = done.where("piece < 0").select("id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else []))
    pieces = done.where("piece >= 0").repartition("row").sortWithinPartitions("row", "piece").select("id", "row", "body", "mask", "more")
    return whole.unionByName(pieces.mapInArrow(_joined(texts), results)).withColumnRenamed("id", id_col)
