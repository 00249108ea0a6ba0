"""SentencePiece encoding and decoding by vectorised merge rounds.

A text is one string with U+2581 for spaces and one in front. It falls into units at spaces, and a unit into parts
where no piece of the vocabulary has the two characters side by side: merges never cross these. The distinct new units
of a batch lie in one flat symbol array. Each round looks up all pairs, takes the least rank of each part, merges its
leftmost non-overlapping pairs of that rank at once and compacts, until no pair is left. If a merged piece can begin a
merge that outranks its own, only the part's leftmost pair is merged that round, as a queue would; a part that is still
``LONG`` by then goes on with a heap of pairs, whose merges cost their neighbourhood only. Characters
outside the vocabulary fall back to bytes. Where no piece holds a letter beside another character, letters and others
are units of their own. Units are remembered per worker in two generations of ``MEMO`` each.

Defined cases: a null or empty text has no ids and decodes to an empty one; very long units without spaces take
about linear time and a few arrays of their length; null or repeated ids each keep a row; an empty table
gives no row; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Units remembered in each of two generations, and the longest ones that are.
MEMO, LONGEST = 200_000, 64
FLAT = 1 << 18
#: Symbols from which on a part with such merges as have to follow each other leaves the rounds for a heap.
LONG = 128
_UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: The same, with letters apart from other characters.
_LETTER = r"[^\W\d_]"
_PARTS = re.compile(rf"{SPACE}*{_LETTER}+|{SPACE}*[\d_]+|{SPACE}*[^\w{SPACE}]+|{SPACE}+")


def _kind(c: str) -> int:
    return 0 if c == SPACE else 1 if re.fullmatch(_LETTER, c) else 2 if re.fullmatch(r"[\d_]", c) else 3


def _bridges(a: str, b: str) -> bool:
    """Whether a piece with these neighbours would cross a border of ``_PARTS``."""
    return _kind(a) != _kind(b) and a != SPACE


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PairTable:
    """Fixed map of 64-bit keys (two symbols) to pieces for whole arrays: cuckoo hashing in two tables, both under 1/4 full."""

    ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(keys) - 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.full((2, 1 << bits), -1, np.int64), np.full((2, 1 << bits), -1, np.int32)
        turn = 0
        while len(keys):  # each round puts keys into one table; those that they push out go to the other one
            at = self._slots(keys, turn)
            at, last = np.unique(at[::-1], return_index=True)
            last = len(keys) - 1 - last
            rest = np.ones(len(keys), bool)
            rest[last] = False
            old_keys, old_values = self.keys[turn, at], self.values[turn, at]
            self.keys[turn, at], self.values[turn, at] = keys[last], values[last]
            out = old_keys >= 0
            keys, values = np.concatenate((keys[rest], old_keys[out])), np.concatenate((values[rest], old_values[out]))
            turn = 1 - turn

    def _slots(self, keys: np.ndarray, turn: int) -> np.ndarray:
        return ((keys.view(np.uint64) * self.ODD[turn]) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two neighbours make, -1 where they make none."""
        key = (left.astype(np.int64) << 32) | right
        one, two = self._slots(key, 0), self._slots(key, 1)
        out = np.where(self.keys[0, one] == key, self.values[0, one], np.int32(-1))
        return np.where(self.keys[1, two] == key, self.values[1, two], out)


class Vocabulary:
    """Tables from a model file: characters, bytes, mergeable pairs and the breaks between characters."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        score = np.array([sp.get_score(i) for i in range(n)])
        self.rank = np.unique(-score, return_inverse=True)[1].astype(np.int32)  # equal scores tie
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.text = [b"" if special[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.text[sp.unk_id()] = " ⁇ ".encode()
        for b, i in enumerate(self.bytes):
            self.text[i] = bytes([b])
        self.is_byte = np.array([sp.is_byte(i) for i in range(n)])

        self.top = n  # symbols from here on are unknown characters: top + code point
        self.symbol = np.arange(n, n + 0x110000, dtype=np.int32)  # of each code point
        single = [p for p in ids if len(p) == 1]
        self.symbol[[ord(p) for p in single]] = [ids[p] for p in single]
        left, right, made, inverted = [], [], [], set()
        joined = set()
        for p, i in ids.items():
            joined.update(zip(p, p[1:]))
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(i)
                    inverted.update(x for x in (a, b) if self.rank[x] >= self.rank[i])
        self.pairs = PairTable((np.array(left, np.int64) << 32) | np.array(right, np.int64), np.array(made, np.int32))
        self.one_by_one = np.zeros(n, bool)
        self.one_by_one[sorted(inverted)] = True
        ends = np.array([[ord(a), ord(b)] for a, b in joined], np.int64).reshape(-1, 2)
        self.joined = PairTable((self.symbol[ends[:, 0]].astype(np.int64) << 32) | self.symbol[ends[:, 1]], np.ones(len(ends), np.int32))
        self.split = _UNITS if any(_bridges(a, b) for a, b in joined) else _PARTS
        # A long run of spaces grows from its left into the longest pieces made of spaces by doubling.
        self.run = 1
        while ids.get(SPACE * self.run * 2) is not None:
            self.run *= 2
        if any(set(p) == {SPACE} and len(p) > self.run for p in ids):
            self.run = 1

    def encode_units(self, units: list[str]) -> list[bytes]:
        """The ids of each unit as 32-bit numbers."""
        out: list[bytes] = []
        at = 0
        while at < len(units):  # some units at a time: about FLAT characters
            end, n = at, 0
            while end < len(units) and (end == at or n + len(units[end]) <= FLAT):
                n += len(units[end])
                end += 1
            out += self._encode(units[at:end])
            at = end
        return out

    def _encode(self, units: list[str]) -> list[bytes]:
        code = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        owner = np.repeat(np.arange(len(units), dtype=np.int32), sizes)
        sym = self.symbol[code]
        cut = (self.joined.get(sym[:-1], sym[1:]) < 0) | (owner[:-1] != owner[1:])
        part = np.concatenate((np.zeros(1, np.int32), np.cumsum(cut, dtype=np.int32)))[: len(sym)]
        # All symbols, in order; parts that may still merge are worked on apart and put back at the end.
        place = np.arange(len(sym), dtype=np.int32)
        final = sym.copy()
        live = np.ones(len(sym), bool)
        made = np.full(len(sym), -1, np.int32)  # what each symbol makes with the next one
        made[:-1] = np.where(cut, np.int32(-1), self.pairs.get(sym[:-1], sym[1:]))
        while True:
            hit = np.flatnonzero(made >= 0)
            if not len(hit):
                break
            piece, of = made[hit], part[hit]
            rank = self.rank[piece]
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            least = np.minimum.reduceat(rank, first)
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(hit))))
            best = rank == least[group]
            pos, piece, group = hit[best], piece[best], group[best]
            start = np.concatenate(([True], group[1:] != group[:-1]))
            # Leftmost first: of touching pairs, every second one counted from the start of its chain.
            chain_start = start | np.concatenate(([True], np.diff(pos) != 1))
            index = np.arange(len(pos))
            since = index - np.maximum.accumulate(np.where(chain_start, index, 0))
            take = since % 2 == 0
            slow = self.one_by_one[piece]
            if slow.any():
                slow_group = np.zeros(len(first), bool)
                slow_group[group[slow]] = True
                parts = of[first[slow_group]]
                begin, end = np.searchsorted(part, parts), np.searchsorted(part, parts, "right")
                wide = np.flatnonzero(end - begin >= LONG)
                if len(wide):
                    for a, b in zip(begin[wide], end[wide]):
                        kept, left = self._one_by_one(sym[a:b], made[a:b])
                        live[place[a:b]], made[a:b] = False, -1
                        live[place[a + kept]], final[place[a + kept]] = True, left
                    continue
                take = np.where(slow_group[group], start, take)
            pos, piece = pos[take], piece[take]
            sym[pos] = piece
            live[place[pos + 1]] = False
            final[place[pos]] = piece
            # Merged symbols leave the arrays, and so do parts without a pair: they are done.
            open_ = np.zeros(int(part[-1]) + 1, bool)
            open_[of[first]] = True
            stay = open_[part]
            stay[pos + 1] = False
            pos = np.cumsum(stay)[pos] - 1
            sym, part, place, made = sym[stay], part[stay], place[stay], made[stay]
            near = np.concatenate((pos, pos[pos > 0] - 1))
            made[pos] = -1
            near = near[near < len(sym) - 1]
            a, b = sym[near], sym[near + 1]
            made[near] = np.where(part[near] == part[near + 1], self.pairs.get(a, b), np.int32(-1))
        final, owner = final[live], owner[live]
        if (final >= self.top).any():
            known = [[x] if x < self.top else [self.bytes[b] for b in chr(x - self.top).encode("utf-8", "replace")] for x in final.tolist()]
            owner = np.repeat(owner, [len(x) for x in known])
            final = np.array(list(chain.from_iterable(known)), np.int32)
        ends = (np.cumsum(np.bincount(owner, minlength=len(units))) * 4).tolist()
        flat = final.astype(np.int32).tobytes()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def _one_by_one(self, sym: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, symbols) that are left of a long part whose merges have to follow each other: the best one first, of
        equal ones the leftmost, taken from a heap, so that a merge costs its neighbourhood and not the part."""
        s, made, get, n = sym.tolist(), made.tolist(), self.piece_of.get, len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.ranks[m] << 32) | i for i, m in enumerate(made) if m >= 0]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i = top & 0xFFFFFFFF
            piece = made[i]
            if piece < 0 or self.ranks[piece] != top >> 32:
                continue  # merged since, or another pair by now
            j = after[i]
            s[i], s[j], made[j] = piece, -1, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0:
                    made[a] = m = get(s[a] << 32 | s[b], -1) if b < n else -1
                    if m >= 0:
                        heapq.heappush(heap, (self.ranks[m] << 32) | a)
        left = np.array(s, np.int32)
        kept = np.flatnonzero(left >= 0)
        return kept, left[kept]

    @cached_property
    def piece_of(self) -> dict[int, int]:
        """The pairs by key, for merges that follow each other."""
        return {k: v for keys, values in zip(self.pairs.keys.tolist(), self.pairs.values.tolist()) for k, v in zip(keys, values) if k >= 0}

    @cached_property
    def ranks(self) -> list[int]:
        return self.rank.tolist()

    def units(self, text: str) -> list[str]:
        line = SPACE + text.replace(" ", SPACE)
        found = self.split.findall(line)
        if self.run == 1 or SPACE * (3 * self.run) not in line:
            return found
        # Only the end of a long run of spaces can meet the word.
        out = []
        for u in found:
            while u.startswith(SPACE * (3 * self.run)):
                out.append(SPACE * self.run)
                u = u[self.run :]
            out.append(u)
        return out

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.text.__getitem__, ids.tolist()))
        if data[:1] == b" " and not self.is_byte[ids[0]]:
            data = data[1:]
        return data.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(model: str) -> Vocabulary:
    return Vocabulary(model)


class _Memo:
    """Ids of units, in two generations: once the young one is full it becomes the old one; what is asked again moves on."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of(self, split: list[list[str]], v: Vocabulary) -> dict[str, bytes]:
        """A dictionary that holds all units of some texts."""
        if len(self.young) > MEMO:
            self.old, self.young = self.young, {}
        missing = set().union(*split) - self.young.keys()
        known = missing & self.old.keys()
        self.young.update((u, self.old[u]) for u in known)
        new = list(missing - known)
        ids = dict(zip(new, v.encode_units(new)))
        long = {u for u in new if len(u) > LONGEST}
        if not long:
            self.young.update(ids)
            return self.young
        self.young.update((u, x) for u, x in ids.items() if u not in long)
        return self.young | ids


_memo: dict[str, _Memo] = {}


def encode_texts(texts: list[str], model: str) -> list[np.ndarray]:
    v = vocabulary(model)
    split = [v.units(t) if t else [] for t in texts]
    ids = _memo.setdefault(model, _Memo()).of(split, v)
    return [np.frombuffer(b"".join(map(ids.__getitem__, s)), np.int32) for s in split]


SLICE_CHARS = 1_000_000


def text_slices(batch: pd.Series) -> Iterator[list[str]]:
    """Some texts at a time, nulls as empty ones: about SLICE_CHARS characters."""
    part, n = [], 0
    for t in batch:
        part.append(t or "")
        n += len(part[-1])
        if n >= SLICE_CHARS:
            yield part
            part, n = [], 0
    if part:
        yield part


def encode(text: Column, model: str | None = None) -> Column:
    path = model or default_model()

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([ids for part in text_slices(batch) for ids in encode_texts(part, path)], dtype=object)

    return run(text)


def decode(ids: Column, model: str | None = None) -> Column:
    path = model or default_model()

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = vocabulary(path)
        for batch in batches:
            yield pd.Series([v.decode(np.empty(0, np.int32) if x is None else np.asarray(x)) for x in batch], dtype=object)

    return run(ids)


def encode_decode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", model: str | None = None) -> DataFrame:
    """A row per document: the ``keep`` columns, ``ids`` and ``decoded``, in one pass of small batches."""
    path = model or default_model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for batch in batches:
            at = 0
            for part in text_slices(batch.pop("_text")):
                ids = encode_texts(part, path)
                yield batch.iloc[at : at + len(part)].assign(ids=ids, decoded=[v.decode(x) for x in ids])
                at += len(part)

    df = docs.select(*keep, F.col(text_col).alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "_text")
    return df.mapInPandas(run, f"{kept}, ids array<int>, decoded string")


def op6(docs: DataFrame) -> DataFrame:
    out = encode_decode(docs)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
