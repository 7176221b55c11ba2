"""Byte-level BPE over a fixed vocabulary, by an index of pair occurrences.

The distinct pieces of a block of texts are laid end to end as one array of symbols. An index maps the rank of every mergeable
pair to all its positions; the smallest active rank is applied everywhere at once, and the pairs that arise beside the merged
positions join the lists of their own ranks. Since a merged symbol takes part only in merges of larger rank, one ascending
sweep does for all pieces what the library does piece by piece.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import ship, tidy

#: Fixed value: the pattern of byte-level BPE that cuts a text into pieces.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where white space isn't one character between two others, at which a text can be cut without looking further.
ODD_WHITE = re.compile(r"\s(?:\s|\Z)|\A\s")
#: Marks that never join the letters before them.
MARKS = frozenset(".,;:!?)")
BLOCK_CHARS, CACHED = 1 << 20, 250_000
#: Number of ids, the ids joined by commas, the bytes that they decode to.
Entry = tuple[int, str, bytes]
KINDS = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "ids": "array<int>", "decoded": "string"}


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass
class Tables:
    """A vocabulary as arrays; small enough to travel with each task."""

    of_byte: np.ndarray
    left: np.ndarray
    right: np.ndarray
    merged: np.ndarray
    token_bytes: list[bytes]
    special: dict[str, int]
    keys: np.ndarray = field(init=False)
    ranks: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        keys = self.left.astype(np.int64) << 32 | self.right
        self.ranks = np.argsort(keys, kind="stable")
        self.keys = keys[self.ranks]

    @classmethod
    def load(cls, path: str) -> Tables:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        size = 1 + max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])])
        token_bytes = [b""] * size
        for token, i in vocab.items():
            token_bytes[i] = bytes(alphabet[c] for c in token)
        special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for token, i in special.items():
            token_bytes[i] = token.encode()
        of_byte = np.zeros(256, np.int32)
        for c, b in alphabet.items():
            of_byte[b] = vocab[c]
        ids = [np.array([vocab[f(p)] for p in pairs], np.int32) for f in (lambda p: p[0], lambda p: p[1], lambda p: p[0] + p[1])]
        made = {int(t): r for r, t in enumerate(ids[2])}
        if any(made.get(int(x), -1) >= r for r, pair in enumerate(zip(ids[0], ids[1], strict=True)) for x in pair) or len(made) < len(pairs):
            raise ValueError("a merge uses a symbol that a later merge makes; one ascending sweep would not be right")
        return cls(of_byte, *ids, token_bytes, special)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for none."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


def encode_pieces(pieces: Sequence[bytes], t: Tables) -> tuple[list[int], list[int]]:
    """The ids of all pieces end to end, and where each piece's ids end; pieces are encoded apart from one another."""
    if not pieces:
        return [], []
    lengths = np.array([len(p) for p in pieces], np.int64)
    ends = np.cumsum(lengths)
    n = int(ends[-1])
    sym = t.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
    after = np.arange(1, n + 1)
    after[ends[lengths > 0] - 1] = -1
    before = np.arange(-1, n - 1)
    before[(ends - lengths)[lengths > 0]] = -1
    alive = np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def add(at: np.ndarray) -> None:
        rank = t.rank_of(sym[at], sym[after[at]])
        at, rank = at[rank >= 0], rank[rank >= 0]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for r, group in zip(rank[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts), strict=True):
            if r in index:
                index[r].append(group)
            else:
                index[r] = [group]
                heapq.heappush(active, r)

    add(np.flatnonzero(after >= 0))
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        a, b, c = t.left[r], t.right[r], t.merged[r]
        at = at[alive[at] & (sym[at] == a)]
        right = after[at]
        at = at[(right >= 0) & (sym[right] == b)]
        if a == b and len(at) > 1:  # of a run of equal symbols, every second one from the left begins a pair
            joined = np.concatenate(([False], at[1:] == after[at[:-1]]))
            start = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
        if not len(at):
            continue
        right = after[at]
        sym[at] = c
        alive[right] = False
        beyond = after[right]
        after[at] = beyond
        inner = beyond >= 0
        before[beyond[inner]] = at[inner]
        prior = before[at]
        beside = np.concatenate((at[inner], prior[prior >= 0]))
        add(np.unique(beside) if len(beside) > 1 else beside)
    left = np.flatnonzero(alive)
    return sym[left].tolist(), np.searchsorted(left, ends).tolist()


def decode_ids(ids: Sequence[int], t: Tables) -> bytes:
    return b"".join([t.token_bytes[i] for i in ids])


class Coder:
    """Encodes texts and decodes them again; remembers the pieces of earlier blocks up to a bound."""

    def __init__(self, tables: Tables, cached: int = CACHED):
        self.t = tables
        self.cached = cached
        self.pattern = regex.compile(PIECES)
        self.shown = [str(i) for i in range(len(tables.token_bytes))]
        self.cut = re.compile("(" + "|".join(map(re.escape, tables.special)) + ")") if tables.special else None
        self.plain: dict[str, Entry] = {}  # by the piece's text
        self.spaced: dict[str, Entry] = {}  # by the text after the piece's leading space

    def _entry(self, ids: Sequence[int]) -> Entry:
        return len(ids), ",".join([self.shown[i] for i in ids]), decode_ids(ids, self.t)

    def _pieces(self, s: str) -> list[str]:
        """What the pattern cuts s into; letters alone, or letters and one mark after them, need no pattern."""
        word = s[1:] if s[:1] == " " else s
        if word.isalpha():
            return [s]
        if word[-1:] in MARKS and word[:-1].isalpha():
            return [s[:-1], word[-1]]
        return self.pattern.findall(s)

    def _learn(self, plain: set[str], spaced: set[str]) -> None:
        todo = [(self.plain, s, self._pieces(s)) for s in plain.difference(self.plain)]
        todo += [(self.spaced, s, self._pieces(" " + s)) for s in spaced.difference(self.spaced)]
        distinct = list({p for _, _, pieces in todo for p in pieces})
        ids, ends = encode_pieces([p.encode() for p in distinct], self.t)
        entries, begin = {}, 0
        for p, end in zip(distinct, ends, strict=True):
            entries[p] = self._entry(ids[begin:end])
            begin = end
        for into, key, pieces in todo:
            if len(pieces) == 1:
                into[key] = entries[pieces[0]]
            else:
                got = [entries[p] for p in pieces]
                into[key] = (sum([e[0] for e in got]), ",".join([e[1] for e in got]), b"".join([e[2] for e in got]))

    def _split(self, text: str) -> list[tuple[str, list[str]] | int]:
        """Parts of a text: the first piece with those that follow a space, or the id of a special token."""
        out: list[tuple[str, list[str]] | int] = []
        for i, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if i % 2:
                out.append(self.t.special[part])
            elif ODD_WHITE.search(part):
                out += [(p, []) for p in self.pattern.findall(part)]
            elif part:
                for j, line in enumerate(part.split("\n")):
                    if j:
                        out.append(("\n", []))
                    first, *rest = line.split(" ")
                    out.append((first, rest))
        return out

    def block(self, texts: list[str]) -> Iterator[list[Entry]]:
        """For each text its entries: number of ids, ids joined by commas, decoded bytes."""
        split = [self._split(x) for x in texts]
        plain: set[str] = set()
        spaced: set[str] = set()
        for parts in split:
            for p in parts:
                if not isinstance(p, int):
                    plain.add(p[0])
                    spaced.update(p[1])
        if len(self.plain) + len(self.spaced) > self.cached:
            self.plain.clear()
            self.spaced.clear()
        self._learn(plain, spaced)
        for parts in split:
            out: list[Entry] = []
            for p in parts:
                if isinstance(p, int):
                    out.append(self._entry([p]))
                else:
                    out.append(self.plain[p[0]])
                    out.extend(map(self.spaced.__getitem__, p[1]))
            yield out


_CODERS: dict[str, Coder] = {}


def _coder(tables: Tables, name: str, cached: int) -> Coder:
    if name not in _CODERS:
        _CODERS.clear()
        _CODERS[name] = Coder(tables)
    _CODERS[name].cached = cached
    return _CODERS[name]


def _value(kind: str, entries: list[Entry]) -> object:
    if kind == "n_tokens":
        return sum([e[0] for e in entries])
    ids = ",".join([e[1] for e in entries]) if kind.startswith("ids") else ""
    if kind == "ids":
        return [int(i) for i in ids.split(",")] if ids else []
    if kind == "ids_sha256":
        return hashlib.sha256(ids.encode()).hexdigest()
    decoded = b"".join([e[2] for e in entries]).decode("utf-8", "replace")
    return decoded if kind == "decoded" else hashlib.sha256(decoded.encode()).hexdigest()


def encode_documents(docs: DataFrame, path: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("n_tokens", "ids_sha256", "decoded_sha256"), cached: int = CACHED) -> DataFrame:
    """The carried columns and, for every row, any of n_tokens, ids, ids_sha256, decoded and decoded_sha256.

    path: a byte-level BPE vocabulary in the JSON form of the tokenizers library, read on the driver. Special tokens that stand in
    a text are encoded as such, and none are added. decoded is what the ids decode to. A null text is encoded as an empty one: no
    ids. Texts of any length are encoded whole; rows are worked on in blocks of about a million characters, and
    a worker remembers the pieces of earlier blocks, up to about `cached` of them. An empty table gives
    an empty result. A carried column that has the name of an output is an error; other columns are not read.
    """
    if clash := set(carry) & set(outputs):
        raise ValueError(f"columns named like outputs: {sorted(clash)}")
    spark = docs.sparkSession
    ship(spark)
    tables, name = Tables.load(path), path
    fields = {f.name: f for f in docs.schema.fields}
    kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(tables, name, cached)
        gc.disable()  # nothing here makes cycles, and the remembered pieces are costly to look through
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            lengths = np.asarray(pc.binary_length(texts).fill_null(0))
            begin = 0
            while begin < len(texts):
                upto = begin + 1 + int(np.searchsorted(np.cumsum(lengths[begin + 1 :]), BLOCK_CHARS - lengths[begin], "right"))
                rows = [x or "" for x in texts.slice(begin, upto - begin).to_pylist()]
                made = [[_value(k, entries) for k in outputs] for entries in coder.block(rows)]
                columns = [batch.column(i).slice(begin, upto - begin) for i in range(len(carry))]
                columns += [pa.array(list(values), kinds.get(k, pa.string())) for k, values in zip(outputs, zip(*made, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, [*carry, *outputs])
                begin = upto

    thin = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(text).alias("__text"))
    schema = ", ".join([f"`{c}` {fields[c].dataType.simpleString()}" for c in carry] + [f"{k} {KINDS[k]}" for k in outputs])
    return thin.mapInArrow(lambda rows: tidy(run(rows)), schema)
