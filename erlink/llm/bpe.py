"""Byte-level BPE by a lazily determinised transducer, and a streaming UTF-8 decoder.

A token sequence is the BPE result of its bytes exactly when every two neighbours are what BPE makes of
their joint bytes, so the encoder is a finite-state transducer: a configuration is (last complete token,
trie node of the token being read). Determinising it keeps all configurations that are alive and emits a
token as soon as they agree on it; they can differ only within the longest token's length, which bounds
the lookahead. States and transitions are built when first met and kept in caches of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

#: The characters of Unicode's White_Space property, as the split pattern's \s sees them.
WHITE = "\t-\r \x85\xa0  -     　"
#: Marks that make a pre-token of their own after a word.
MARKS = frozenset(",.:;!?)")
#: Lead byte range -> (continuation bytes, range of the first of them), from the UTF-8 definition.
UTF8_LEADS = (
    (0x00, 0x7F, 0, 0x00, 0x00),
    (0xC2, 0xDF, 1, 0x80, 0xBF),
    (0xE0, 0xE0, 2, 0xA0, 0xBF),
    (0xE1, 0xEC, 2, 0x80, 0xBF),
    (0xED, 0xED, 2, 0x80, 0x9F),
    (0xEE, 0xEF, 2, 0x80, 0xBF),
    (0xF0, 0xF0, 3, 0x90, 0xBF),
    (0xF1, 0xF3, 3, 0x80, 0xBF),
    (0xF4, 0xF4, 3, 0x80, 0x8F),
)


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Transducer:
    """Encodes one pre-token's bytes; ``ranks`` maps token bytes to ids that are also merge priorities."""

    START, ROOT = -1, 0

    def __init__(self, ranks: dict[bytes, int], max_states: int = 40_000):
        self.ranks = ranks
        self.text = {i: t for t, i in ranks.items()}
        self.max_states = max_states
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.child: dict[int, int] = {}
        self.ends: list[int] = [-1]
        parent, node_of = [0], {}
        for token, i in ranks.items():
            if not self._own(token, i):
                continue
            node = self.ROOT
            for b in token:
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    nxt = self.child[node << 8 | b] = len(self.ends)
                    self.ends.append(-1)
                    parent.append(node)
                node = nxt
            self.ends[node] = i
            node_of[i] = node
        #: the longest token on the way to a node; the longest token that begins another; how long tokens are
        self.longest = [-1]
        for node in range(1, len(self.ends)):
            self.longest.append(self.ends[node] if self.ends[node] >= 0 else self.longest[parent[node]])
        self.shorter = {i: self.longest[parent[node]] for i, node in node_of.items()}
        self.size = {i: len(self.text[i]) for i in node_of}
        self._reset()

    def _own(self, token: bytes, i: int) -> bool:
        """Whether merges build this token from its bytes; notes its last merge."""
        if len(token) == 1:
            self.halves[i] = None
            return True
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda k: self.ranks.get(parts[k] + parts[k + 1], 1 << 60))
            if self.ranks.get(parts[best] + parts[best + 1], 1 << 60) >= i:
                return False
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if not all(p in self.ranks for p in parts):
            return False
        self.halves[i] = (self.ranks[parts[0]], self.ranks[parts[1]])
        return True

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE keeps the border between two tokens: no merge across it comes before the merges beside it.

        Both tokens are taken apart from the border outwards, latest merge first. At each moment the two
        parts that touch must not be a token that would have been merged earlier than the part's own next merge.
        """
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is not None:
            return known
        a, b, before, answer = left, right, 1 << 60, True
        while True:
            joint = self.ranks.get(self.text[a] + self.text[b])
            if joint is not None and joint < before:
                answer = False
                break
            split_a, split_b = self.halves.get(a), self.halves.get(b)
            if split_a is None and split_b is None:
                break
            if split_b is None or (split_a is not None and a > b):
                before, a = a, split_a[1]
            elif split_a is None or b > a:
                before, b = b + 1, split_b[0]
            else:  # equal tokens: the left one was merged first
                before, b = b + 1, split_b[0]
        if len(self.pairs) > 400_000:
            self.pairs.clear()
        self.pairs[key] = answer
        return answer

    def _reset(self) -> None:
        first = ((self.START, self.ROOT, ()),)
        self.numbers = {first: 0}
        self.states = [first]
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        out, child, ends, pairs = [], self.child, self.ends, self.pairs
        waiting = True
        for last, node, pending in self.states[state]:
            nxt = child.get(node << 8 | byte)
            if nxt is None:
                continue
            out.append((last, nxt, pending))
            if not pending:
                waiting = False
            token = ends[nxt]
            if token >= 0:
                fit = last == self.START or pairs.get(last << 32 | token)
                if fit or (fit is None and self.fits(last, token)):
                    out.append((token, self.ROOT, (*pending, token)))
        emitted: tuple[int, ...] = ()
        if waiting:
            agreed, shortest = 0, min((c[2] for c in out), key=len)
            while agreed < len(shortest) and all(c[2][agreed] == shortest[agreed] for c in out):
                agreed += 1
            emitted = shortest[:agreed]
            out = [(last, node, pending[agreed:]) for last, node, pending in out]
        key = tuple(out)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
        found = self.moves[state << 8 | byte] = (number, emitted)
        return found

    def _simulate(self, piece: bytes, out: list[int]) -> list[int]:
        """The same transducer without determinising, from behind the tokens in ``out``: paths depth first, longest tokens first.

        Borders that hold so far make the one result of the prefix before them, so no place is reached by two paths, and the
        work is at most the number of places times the longest token.
        """
        child, longest, shorter, size, pairs, n = self.child.get, self.longest, self.shorter, self.size, self.pairs, len(piece)
        at = sum([size[t] for t in out])
        last = out[-1] if out else self.START
        while at < n:
            node, i = 0, at
            while i < n:
                nxt = child(node << 8 | piece[i])
                if nxt is None:
                    break
                node, i = nxt, i + 1
            token = longest[node]
            while True:
                while token >= 0:
                    fit = last < 0 or pairs.get(last << 32 | token)
                    if fit or (fit is None and self.fits(last, token)):
                        break
                    token = shorter[token]
                if token >= 0:
                    break
                back = out.pop()  # no token fits here: a shorter one before
                at -= size[back]
                last = out[-1] if out else self.START
                token = shorter[back]
            out.append(token)
            at += size[token]
            last = token
        return out

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one pre-token. A piece that is a token as a whole is that token, reachable by merges or not.

        Known transitions are followed; unknown ones are determinised while there is room for states. Beyond that the
        states that are there stay, and pieces that leave them are simulated from what is emitted by then.
        """
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        state, out, moves = 0, [], self.moves
        for byte in piece:
            step = moves.get(state << 8 | byte)
            if step is None:
                if len(self.states) >= self.max_states:
                    return self._simulate(piece, out)
                step = self._move(state, byte)
            state = step[0]
            out += step[1]
        return out + list(next(c[2] for c in self.states[state] if c[1] == self.ROOT))


class Utf8Machine:
    """Incremental UTF-8: bytes in, text out; what may still become a character waits in ``pending``."""

    def __init__(self) -> None:
        self.pending = b""

    def feed(self, data: bytes) -> str:
        """Text that is certain by now. Each maximal part of a broken sequence gives one U+FFFD."""
        data, out, i = self.pending + data, [], 0
        while i < len(data):
            lead = next((x for x in UTF8_LEADS if x[0] <= data[i] <= x[1]), None)
            if lead is None:
                out.append("�")
                i += 1
                continue
            _, _, more, low, high = lead
            k = 1
            while k <= more and i + k < len(data) and (low if k == 1 else 0x80) <= data[i + k] <= (high if k == 1 else 0xBF):
                k += 1
            if k > more:
                out.append(data[i : i + k].decode())
            elif i + k == len(data):
                break
            else:
                out.append("�")
            i += k
        self.pending = data[i:]
        return "".join(out)

    def end(self) -> str:
        """U+FFFD if the stream stopped inside a character."""
        left, self.pending = self.pending, b""
        return "�" if left else ""


class Codec:
    """Whole texts to ids and back. Repeated chunks are looked up in a bounded memo of transducer results."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_memo: int = 520_000, newer: str | None = None):
        self.fst = Transducer(ranks)
        self.pattern = regex.compile(pattern)
        #: This pattern begins a pre-token at every space before another character; texts of others are not cut first.
        self.spaced = pattern == public_tokenizers.PATTERN
        newer = newer_characters() if newer is None else newer
        #: Such characters are neither letters nor numbers: another of that kind stands for them while texts are split.
        self.newer = regex.compile(f"[{regex.escape(newer)}]") if newer else None
        self.stand_in = dict.fromkeys(map(ord, newer), "\ue000")
        self.cut = regex.compile(f" (?=[^{WHITE}])")
        self.odd = regex.compile(f" (?:[{WHITE}]|\\Z)")
        self.max_memo = max_memo
        self.rest: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.pieces: dict[str, str] = {}
        self.marks = {mark: self._ids(mark) for mark in MARKS}
        self.plain: dict[int, str | None] = {}
        for i, token in self.fst.text.items():
            try:
                self.plain[i] = token.decode()
            except UnicodeDecodeError:
                self.plain[i] = None
        self.by_decimal = {str(i): t for i, t in self.plain.items()}

    def _ids(self, piece: str) -> str:
        return ",".join(map(str, self.fst.encode(piece.encode())))

    def _has_newer(self, text: str) -> bool:
        if text.isascii() or not self.newer:
            return False
        try:
            text.encode("latin-1")  # these are all older, and this is the quicker way to see it
            return False
        except UnicodeEncodeError:
            return self.newer.search(text) is not None

    def _pieces(self, text: str) -> str:
        """Ids of all pre-tokens of a text, by a small memo."""
        out = []
        shown = text.translate(self.stand_in) if self._has_newer(text) else text
        for m in self.pattern.finditer(shown):
            piece = m[0] if shown is text else text[m.start() : m.end()]
            found = self.pieces.get(piece)
            if found is None:
                found = self._ids(piece)
                if len(piece) <= 32:
                    if len(self.pieces) > self.max_memo // 8:
                        self.pieces.clear()
                    self.pieces[piece] = found
            out.append(found)
        return ",".join(out)

    def _chunk(self, key: str) -> str:
        """Ids of a space and ``key``. A space and letters are one pre-token; a mark after letters is one of its own."""
        found = self.older.get(key)
        if found is None:
            word = key[:-1]
            if key.isalpha():
                found = ",".join(map(str, self.fst.encode(b" " + key.encode())))
            elif key[-1:] in MARKS and word.isalpha():
                found = (self.rest.get(word) or self._chunk(word)) + "," + self.marks[key[-1]]
            else:
                found = self._pieces(" " + key)
        if len(key) <= 64:
            self.rest[key] = found
        return found

    def joined(self, text: str) -> str:
        """Decimal ids of a text, comma-joined. Where a space before a non-space always starts a pre-token, texts are cut there."""
        if not text:
            return ""
        if not self.spaced:
            return self._pieces(text)
        if len(self.rest) > self.max_memo:  # entries come back from the older generation when met again
            self.older, self.rest = self.rest, {}
        chunks = self.cut.split(text) if self.odd.search(text) else text.split(" ")
        head = [self._pieces(chunks[0])] if chunks[0] else []
        del chunks[0]
        found = list(map(self.rest.get, chunks))
        if None in found:
            for i in [i for i, ids in enumerate(found) if ids is None]:
                found[i] = self.rest.get(chunks[i]) or self._chunk(chunks[i])
        return ",".join(head + found)

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without special tokens."""
        found = self.joined(text)
        return list(map(int, found.split(","))) if found else []

    def decode_stream(self, blocks: Iterable[list[int]]) -> Iterator[str]:
        """Text of blocks of ids as they come; a character may span tokens and blocks."""
        machine = Utf8Machine()
        for ids in blocks:
            if not machine.pending:
                texts = list(map(self.plain.__getitem__, ids))
                if None not in texts:
                    yield "".join(texts)
                    continue
            for i in ids:
                text = None if machine.pending else self.plain[i]
                yield machine.feed(self.fst.text[i]) if text is None else text
        yield machine.end()

    def decode(self, ids: list[int], block: int = 8192) -> str:
        """Text of all ids."""
        return "".join(self.decode_stream(ids[k : k + block] for k in range(0, len(ids), block)))

    def decode_joined(self, ids: str) -> str:
        """Text of comma-joined decimal ids; those that hold whole characters only are looked up, others go the streaming way."""
        tokens = ids.split(",") if ids else []
        texts = list(map(self.by_decimal.__getitem__, tokens))
        return self.decode(list(map(int, tokens))) if None in texts else "".join(texts)


def newer_characters() -> str:
    """Letters and numbers of this Unicode version that the reference library's version, which may be older, does not know.

    The library is asked which of them its own classes match. Where it is not installed there are none.
    """
    try:
        import tiktoken
    except ModuleNotFoundError:
        return ""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    single = {bytes([i]): i for i in range(256)}
    out = []
    for kind in (r"\p{L}", r"\p{N}"):
        ours = regex.findall(kind, every)
        library = tiktoken.Encoding(f"class {kind}", pat_str=kind, mergeable_ranks=single, special_tokens={})
        known = set(bytes(library.encode_ordinary("".join(ours))).decode())
        out += [c for c in ours if c not in known]
    return "".join(out)


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str, newer: str | None = None) -> Codec:
    """The process's codec for a rank file; Python workers are reused, so it is built once in each."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(load_ranks(path), pattern, newer=newer)
    return _codecs[path, pattern]


def encode_column(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """(id, ids array or null, n_tokens, ids_sha256, decoded_sha256) for every row; a map without shuffle.

    Null texts are empty texts; an empty text has no tokens and the hashes of nothing. Repeated rows and rows with null ids
    come out as often as they go in. Other columns are not read. ``rank_file`` must be installed on every executor.
    """

    newer = newer_characters()  # asked once, so that workers need not load the library

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern, newer)
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for text in batch.column(1):
                found = c.joined(text.as_py() or "")
                rows[0].append(list(map(int, found.split(","))) if ids and found else [] if ids else None)
                rows[1].append(found.count(",") + bool(found))
                rows[2].append(hashlib.sha256(found.encode()).hexdigest())
                rows[3].append(hashlib.sha256(c.decode_joined(found).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows[0], pa.list_(pa.int32())), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.string())],
                [id_col, "ids", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")


def round_trip(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Documents whose text is what decoding its ids gives, with the number of tokens as ``n_tokens`` (replaced if there); all columns stay.

    Null texts stay null and have no tokens, empty ones none; rows come out as often as they go in, an empty table gives none.
    """
    docs = docs.drop("n_tokens")
    names = docs.columns

    newer = newer_characters()  # asked once, so that workers need not load the library

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern, newer)
        k = names.index("text")
        for batch in batches:
            texts, counts = [], []
            for text in batch.column(k):
                text = text.as_py()
                found = c.joined(text or "")
                texts.append(None if text is None else c.decode_joined(found))
                counts.append(found.count(",") + bool(found))
            columns = [pa.array(texts, pa.string()) if i == k else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], [*names, "n_tokens"])

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", n_tokens long"
    return docs.mapInArrow(run, schema)
