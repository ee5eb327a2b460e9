"""Byte-level BPE encoding and decoding from a rank file.

Encoding: bytes become Latin-1 characters, so one pyahocorasick automaton over
all vocabulary entries finds the longest entry at every position of a piece. A
backtracking walk then takes longest entries first and steps back to the next
shorter entry (its longest proper prefix in the vocabulary) whenever two
neighbours aren't *compatible*, i.e. whenever the merges would not leave exactly
these two entries side by side. Compatibility of a pair depends on the pair
alone, so it is remembered; each position is entered a bounded number of times,
which makes the walk linear in the piece. The result equals applying the merges
in rank order.

Longest entries without overlap, taken from the left, are tried first: if all
neighbours are compatible they are the answer.

Text is cut into pieces by the public pattern. A single space between two
characters that aren't white space always begins a piece, so the text between two
such spaces is encoded by itself and remembered, up to a bounded number of entries
per worker; stretches of letters need no pattern at all.

Defined cases: NULL and empty texts have no ids and decode to no bytes; any
Unicode text round-trips; text of special tokens is ordinary text. Rows are
independent: repeated rows and extra columns are carried as they are.
"""

from __future__ import annotations

import base64
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docmill.llm.common import Memory, carried, map_text, per_worker

#: Remembered entries per worker (up to twice as many): stretches between spaces;
#: entry pairs.
STRETCHES, PAIRS = 90_000, 120_000
#: Marks that may end a word; a run of them is a piece of its own.
_MARKS = ".,;:!?\"')]}"

ENCODED = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
DECODED = [T.StructField("decoded", T.BinaryType())]


def read_ranks(path: str) -> dict[bytes, int]:
    """A public rank file: a base64 entry and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(entry): int(rank) for entry, rank in map(bytes.split, f)}


class Vocabulary:
    """The automaton, each entry's next shorter prefix entry and last merge."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick
        self.ranks = ranks
        self.entries: list[bytes] = [b""] * (max(ranks.values()) + 1)
        self.automaton = ahocorasick.Automaton()
        for entry, rank in ranks.items():
            self.entries[rank] = entry
            self.automaton.add_word(entry.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.lengths = [len(e) for e in self.entries]
        self.shorter = [next((ranks[e[:n]] for n in range(len(e) - 1, 0, -1) if e[:n] in ranks), -1)
                        for e in self.entries]
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int] | None] = [None] * len(self.entries)
        for rank in sorted(ranks.values()):
            self._find_halves(rank)
        #: By left entry: whether right entries may follow it.
        self.known: list[dict[int, bool]] = [{} for _ in self.entries]
        self.pairs = 0
        self.all_bytes = all(bytes([c]) in ranks for c in range(256))
        #: The longest entry that begins each beginning of an entry that isn't one itself.
        self.begins: dict[str, int] = {}
        for entry in sorted(ranks):
            longest = -1
            for n in range(1, len(entry)):
                own = ranks.get(entry[:n])
                if own is not None:
                    longest = own
                else:
                    self.begins.setdefault(entry[:n].decode("latin-1"), longest)
        self.most = max(self.lengths)

    def _find_halves(self, rank: int) -> None:
        """The merge that makes this entry: the split into two lower-ranked
        entries that earlier merges leave side by side."""
        left = self.shorter[rank]
        while left >= 0:
            right = self.ranks.get(self.entries[rank][self.lengths[left]:])
            if right is not None and left < rank and right < rank and self._fits(left, right):
                self.halves[rank] = (left, right)
                self.merged[left, right] = rank
                return
            left = self.shorter[left]

    def _fits(self, left: int, right: int) -> bool:
        """Would the merges leave ``left`` and ``right`` as neighbours? Undo their
        merges from the latest on; no pair across the border may have a merge
        that comes before the one just undone."""
        merged, halves = self.merged, self.halves
        before = len(self.entries) + 1
        while True:
            across = merged.get((left, right))
            if across is not None and across < before:
                return False
            from_left = halves[left] is not None and (left > right or halves[right] is None)
            if from_left:
                before, left = left, halves[left][1]
            elif halves[right] is not None:
                before, right = right + 1, halves[right][0]
            else:
                return True

    def _learn(self, left: int, right: int) -> bool:
        """Compatibility of a pair that isn't remembered, remembered now."""
        if self.pairs >= PAIRS:
            for row in self.known:
                row.clear()
            self.pairs = 0
        self.pairs += 1
        ok = self.known[left][right] = self._fits(left, right)
        return ok

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text, known = piece.decode("latin-1"), self.known
        out = [rank for _, rank in self.automaton.iter_long(text)]
        if not self.all_bytes and sum(map(self.lengths.__getitem__, out)) != len(piece):
            raise ValueError("the vocabulary lacks a byte of the text")
        last = out[0]
        for i in range(1, len(out)):
            entry = out[i]
            ok = known[last].get(entry)
            if not (self._learn(last, entry) if ok is None else ok):
                return self._backtrack(text, out[:i], entry)
            last = entry
        return out

    def _backtrack(self, text: str, out: list[int], entry: int) -> list[int]:
        """Go on from compatible entries ``out`` and an ``entry`` that doesn't fit."""
        n, lengths, shorter, known, learn = len(text), self.lengths, self.shorter, self.known, self._learn
        begins, most, reach, own = self.begins, self.most, self.automaton.longest_prefix, self.automaton.get
        usable = bytearray(b"\x01") * (n + 1)
        at, last = sum(map(lengths.__getitem__, out)), out[-1]
        entry = shorter[entry]
        while True:
            while entry >= 0:
                if usable[at + lengths[entry]]:
                    if last < 0:
                        break
                    ok = known[last].get(entry)
                    if learn(last, entry) if ok is None else ok:
                        break
                entry = shorter[entry]
            if entry >= 0:
                out.append(entry)
                at += lengths[entry]
                if at == n:
                    return out
                rest = text[at:at + most]
                rest = rest[:reach(rest)]
                last, entry = entry, own(rest, -1)
                if entry < 0:
                    entry = begins[rest]
            else:  # nothing fits here: step back and shorten the entry before
                usable[at] = 0
                entry = out.pop()
                at -= lengths[entry]
                last = out[-1] if out else -1
                entry = shorter[entry]


class Encoder:
    """Text to ids as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex
        self.find = regex.compile(pattern).findall
        self.encode_piece = vocabulary.encode_piece
        self.bytes = [i.to_bytes(4, "little") for i in range(len(vocabulary.entries))]
        self.later = Memory(self._after_space, STRETCHES)
        self.marks = Memory(self.stretch, 1000)

    def piece(self, piece: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, self.encode_piece(piece)))

    def stretch(self, text: str) -> bytes:
        return b"".join([self.piece(p.encode("utf-8")) for p in self.find(text)])

    def _after_space(self, s: str) -> bytes:
        """The ids of ``s`` after a single space, or of ``s`` itself if it begins with a line feed."""
        if s.isalpha():
            return self.piece(b" " + s.encode("utf-8"))
        word = s.rstrip(_MARKS)
        if word.isalpha():  # a word and its marks are two pieces
            return self.later[word] + self.marks[s[len(word):]]
        return self.stretch(s if s[:1] == "\n" else " " + s)

    def __call__(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        s = text.decode("utf-8")
        if "  " in s or " \n" in s or not s.replace("\n", "").isprintable():
            parts = _clean_parts(s)
        else:
            if "\n" in s and not ("\n\n\n" in s or "\n\n " in s or s.endswith("\n\n")):
                s = s.replace("\n", " \n")  # a line feed is a piece, so a cut before it changes nothing
            parts = s.split(" ")
        head, *rest = parts
        return self.stretch(head) + b"".join(map(self.later.__getitem__, rest))


def _clean_parts(s: str) -> list[str]:
    """``s`` cut at single spaces that have no white space on either side."""
    parts, open_end = [], True
    for part in s.split(" "):
        if parts and (open_end or not part or part[0].isspace()):
            parts[-1] += " " + part
        else:
            parts.append(part)
        open_end = not part or part[-1].isspace()
    return parts


def _encoding(ranks, pattern: str):
    """A kernel from texts to (n_tokens, ids)."""
    key = "bpe", zlib.crc32(repr(sorted(ranks.items(), key=lambda x: x[1])).encode()), pattern
    encoder = per_worker(key, lambda: Encoder(Vocabulary(ranks), pattern))

    def kernel(texts):
        ids = [encoder(t) for t in texts]
        return [[len(i) // 4 for i in ids], ids]

    kernel.remembers = True
    return kernel


def _decoding(ranks):
    """A kernel from ids to their bytes: one look-up of all ids of a slice; the bytes
    of the entries found stand one behind the other, so rows are ranges of them."""
    import numpy as np
    import pyarrow as pa
    entries: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for entry, rank in ranks.items():
        entries[rank] = entry
    table = pa.array(entries, pa.large_binary())

    def kernel(rows):
        ids = np.frombuffer(b"".join([r or b"" for r in rows]), dtype="<u4")
        found = table.take(pa.array(ids))
        ends = np.frombuffer(found.buffers()[1], dtype=np.int64)[:len(ids) + 1]
        at = np.concatenate([[0], np.cumsum([len(r or b"") // 4 for r in rows])])
        offsets = pa.py_buffer((ends[at] if len(ids) else at).astype(np.int32))
        return [pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, found.buffers()[2]])]

    return kernel


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text",
           keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all but the text) plus n_tokens and ids (binary,
    little-endian unsigned 32-bit integers). ``ranks_path`` is read on the driver."""
    keep = carried(df, ["n_tokens", "ids"], [text]) if keep is None else keep
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    return map_text(df, text, ENCODED, lambda: _encoding(ranks.value, pattern), keep)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) plus decoded (the bytes of the ids)."""
    keep = carried(df, ["decoded"]) if keep is None else keep
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    return map_text(df, ids, DECODED, lambda: _decoding(ranks.value), keep)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text",
               keep: list[str] | None = None) -> DataFrame:
    """``encode`` and then ``decode`` of its ids in one worker: ``keep`` columns
    plus n_tokens, ids and decoded. (As two steps of a plan they take two Python
    workers per task.)"""
    keep = carried(df, ["n_tokens", "ids", "decoded"], [text]) if keep is None else keep
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def make():
        encoding, decoding = _encoding(ranks.value, pattern), _decoding(ranks.value)

        def kernel(texts):
            n_tokens, ids = encoding(texts)
            return [n_tokens, ids, *decoding(ids)]

        kernel.remembers = True
        return kernel

    return map_text(df, text, ENCODED + DECODED, make, keep)
