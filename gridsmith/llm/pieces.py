"""Sampled segmentations of texts without replacement, and their decoding.

A text's lattice has an edge for every vocabulary piece at every place. No piece crosses
a pre-token boundary (``token_counts``), so the lattice is a chain of small lattices, one
for each pre-token. Perturbed A* search: every set of segmentations still to be searched
carries the Gumbel-perturbed log of its mass, drawn below that of the set it was split
from; the set with the largest value is popped, gives the segmentation that attains it,
and is split at each place where another segmentation could leave it. So segmentations
come out in the order of their perturbed values, distinct, and without replacement.

The vocabulary holds merge ranks, not probabilities; a piece of rank r weighs
(r + 2) ** -power, by Zipf's law. A character outside the vocabulary is its bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole
from .token_counts import check_cuts, pre_tokens, processor

#: Edges of lattices a worker remembers, and texts whose new lattices are built together.
EDGES, STEP = 2_000_000, 250
#: A factor a character that keeps weights near 1; it cancels out.
PER_CHAR = 8.0
#: Bytes of ids from which a batch of results is passed on.
BATCH_BYTES = 8_000_000

_workers: dict[tuple, tuple] = {}


class Lattice:
    """Segmentations of one pre-token, drawn backwards along forward sums."""

    __slots__ = ("size", "edges", "total")

    def __init__(self, piece: str, vocabulary: dict[str, tuple[bytes, float]], longest: int, unknown):
        self.size = size = len(piece)
        sums, self.edges = [1.0] + [0.0] * size, [()] * (size + 1)
        for end in range(1, size + 1):
            total, found = 0.0, []
            for begin in range(max(0, end - longest), end):
                hit = vocabulary.get(piece[begin:end])
                if hit is None and begin == end - 1:
                    hit = unknown(piece[begin])
                if hit is not None and sums[begin]:
                    weight = sums[begin] * hit[1]
                    total += weight
                    found.append((weight, begin, hit[0]))
            found.sort(reverse=True)
            # the share of the others is summed where total - weight would lose small ones
            others = [(total - x[0] if 2 * x[0] < total else sum(y[0] for y in found if y is not x)) / total for x in found]
            self.edges[end] = tuple((w / total, b, ids, o) for (w, b, ids), o in zip(found, others))
            sums[end] = total
            if not 1e-200 < total < 1e200:  # only ratios within a piece's reach matter
                for i in range(max(0, end - longest), end + 1):
                    sums[i] /= total

    def draw(self, rng, at: int | None = None) -> tuple[tuple[int, ...], bytes, float, float]:
        """Path (places from ``at`` back to the start), ids, probability, and that of all
        other paths."""
        at, chance, other, path, out = self.size if at is None else at, 1.0, 0.0, [], []
        while at:
            edges = self.edges[at]
            if len(edges) == 1:
                _, at, ids, _ = edges[0]
            else:
                u = rng()
                for p, begin, ids, rest in edges:
                    u -= p
                    if u < 0:
                        break
                other += chance * rest
                chance *= p
                at = begin
            path.append(at)
            out.append(ids)
        out.reverse()
        return tuple(path), b"".join(out), chance, other

    def other(self, taken: list[tuple[int, ...]], at: int | None = None) -> float:
        """Probability of the paths from ``at`` outside ``taken``."""
        todo, total = [(1.0, self.size if at is None else at, 0, list(taken))], 0.0
        while todo:
            chance, at, depth, live = todo.pop()
            if not live:
                total += chance
            elif at:
                todo += [(chance * p, begin, depth + 1, [t for t in live if t[depth] == begin]) for p, begin, _, _ in self.edges[at]]
        return total

    def draw_other(self, rng, taken: frozenset) -> tuple[tuple[int, ...], bytes, float, float] | None:
        """As ``draw`` among the paths outside ``taken``; None if there is no other.

        As long as a taken path runs along, an edge is drawn by its mass without the
        taken paths that begin with it."""
        at, chance, path, out, live = self.size, 1.0, [], [], list(taken)
        while at and live:
            left = []
            for p, begin, ids, _ in self.edges[at]:
                left.append((p * self.other([t[1:] for t in live if t[0] == begin], begin), p, begin, ids))
            u = rng() * sum(x[0] for x in left)
            if not sum(x[0] for x in left):
                return None
            for mass, p, begin, ids in left:
                u -= mass
                if u < 0 and mass:
                    break
            else:
                _, p, begin, ids = max(left)
            live = [t[1:] for t in live if t[0] == begin]
            chance, at = chance * p, begin
            path.append(begin)
            out.append(ids)
        out.reverse()
        rest = self.draw(rng, at)
        path = (*path, *rest[0])
        return path, rest[1] + b"".join(out), chance * rest[2], self.other([*taken, path])


def below(mass: np.ndarray, limit: float, noise: np.ndarray) -> np.ndarray:
    """Gumbel values with log masses ``mass`` that lie below ``limit``; ``noise`` is
    exponential."""
    with np.errstate(divide="ignore", over="ignore"):
        return mass - np.logaddexp(mass - limit, np.log(noise))


class Drawn:
    """Segmentations of the pre-tokens from a place on: their probabilities, those of all
    others, the ids of all, where each one's ids end, and the path of each."""

    def __init__(self, chance: np.ndarray, other: np.ndarray, ids: bytes, ends: np.ndarray, path_of):
        self.chance, self.other, self.ids, self.ends, self.path_of = chance, other, ids, ends, path_of

    def after(self, first: tuple) -> "Drawn":
        """With the draw of the pre-token in front."""
        path, ids, chance, other = first
        ends = np.concatenate([[len(ids)], self.ends + len(ids)])
        return Drawn(np.concatenate([[chance], self.chance]), np.concatenate([[other], self.other]), ids + self.ids, ends, lambda j: path if j == 0 else self.path_of(j - 1))


class Chain:
    """Lattices of one text, drawn one after the other."""

    def __init__(self, lattices: list[Lattice]):
        self.lattices, self.size = lattices, len(lattices)

    def draw(self, place: int, rng, _) -> Drawn:
        drawn = [x.draw(rng) for x in self.lattices[place:]]
        ends = np.cumsum([len(x[1]) for x in drawn], dtype=np.int64)
        return Drawn(np.array([x[2] for x in drawn]), np.array([x[3] for x in drawn]), b"".join(x[1] for x in drawn), ends, lambda j: drawn[j][0])

    def lattice(self, place: int) -> Lattice:
        return self.lattices[place]


def sample(chain, k: int, seed: int) -> list[tuple[float, float, bytes]]:
    """(perturbed value, log probability, ids) of k + 1 segmentations of a chain (or list
    of lattices), or of all there are; the last one only bounds the inclusion of the others."""
    chain = Chain(chain) if isinstance(chain, list) else chain
    rng = random.Random(seed).random
    noise = np.random.default_rng(seed)
    queue = [(math.log(noise.standard_exponential()), 0, 0, 0.0, b"", frozenset())]  # -value, order, place, log prefix, prefix, taken
    out, order = [], 0
    while queue and len(out) <= k:
        value, _, place, prefix, front, taken = heapq.heappop(queue)
        value = -value
        if len(out) == k and k:
            out.append((value, 0.0, b""))
            break
        if place == chain.size:
            out.append((value, prefix, front))
            continue
        if taken:
            first = chain.lattice(place).draw_other(rng, taken)
            if first is None:
                continue
            drawn = chain.draw(place + 1, rng, noise).after(first)
        else:
            drawn = chain.draw(place, rng, noise)
        before = prefix + np.concatenate([[0.0], np.cumsum(np.log(drawn.chance))])
        out.append((value, float(before[-1]), front + drawn.ids))
        with np.errstate(divide="ignore"):
            mass = before[:-1] + np.log(drawn.other)
        values = below(mass, value, noise.standard_exponential(len(mass)))
        open_ = np.flatnonzero(np.isfinite(mass))
        keep = min(len(open_), k + 1 - len(out))
        for j in open_[np.argpartition(-values[open_], keep - 1)[:keep]].tolist() if keep else ():
            order += 1
            kept = frozenset([drawn.path_of(j)]) | (taken if j == 0 else frozenset())
            ids = front + drawn.ids[: int(drawn.ends[j - 1]) if j else 0]
            heapq.heappush(queue, (-float(values[j]), order, place + j, float(before[j]), ids, kept))
    return out


_BASE, _SALT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9FB21C651E98DF25)


def _char_hash(codes: np.ndarray) -> np.ndarray:
    h = (codes.astype(np.uint64) + _SALT) * _BASE
    h = (h ^ (h >> np.uint64(32))) * _SALT
    return h ^ (h >> np.uint64(29))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Lattices:
    """Lattices of many pre-tokens as arrays, built for a batch of texts at once: places of
    all pre-tokens one after the other, and the edges that end at each place. Pieces are
    looked up by rolling hashes, one length at a time."""

    def __init__(self, known: dict[str, tuple[bytes, float]], longest: int, unknown):
        self.args = known, longest, unknown
        self.longest = longest
        by_length: dict[int, list[tuple[str, int]]] = {}
        for i, piece in enumerate(known):
            by_length.setdefault(len(piece), []).append((piece, i))
        self.tables = {}
        for n, found in by_length.items():
            codes = _char_hash(_codes("".join(p for p, _ in found))).reshape(-1, n)
            h = codes[:, 0].copy()
            for i in range(1, n):
                h = h * _BASE + codes[:, i]
            order = np.argsort(h)
            maybe = np.zeros(1 << 18, bool)  # most substrings end here
            maybe[h >> np.uint64(46)] = True
            self.tables[n] = h[order], np.array([i for _, i in found])[order], maybe
        self.ids = [v[0] for v in known.values()]
        self.weights = [v[1] for v in known.values()]
        self.others: dict[str, int] = {}  # entries of characters outside the vocabulary
        self.clear()

    def clear(self) -> None:
        self.of: dict[str, int] = {}
        self.parts: list[tuple] = []
        self.n_places = self.n_edges = self.n_tokens = 0
        self.arrays = None

    def _entry(self, char: str) -> int:
        if char not in self.others:
            ids, weight = self.args[2](char)
            self.others[char] = len(self.ids)
            self.ids.append(ids)
            self.weights.append(weight)
        return self.others[char]

    def add(self, pieces: list[str]) -> None:
        """New, distinct, not empty pre-tokens."""
        if not pieces:
            return
        line = "".join(pieces)
        codes = _codes(line)
        sizes = np.array([len(p) for p in pieces])
        starts = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(pieces)), sizes)
        inside = np.arange(len(codes)) - starts[of]
        h1 = _char_hash(codes)
        ends, lens, entries = [], [], []
        h = h1
        for n in range(1, min(self.longest, int(sizes.max())) + 1):
            if n > 1:
                h = np.concatenate([[np.uint64(0)], h[:-1] * _BASE]) + h1
            if n not in self.tables:
                continue
            table, which, maybe = self.tables[n]
            at = np.flatnonzero((inside >= n - 1) & maybe[h >> np.uint64(46)])
            spot = np.minimum(np.searchsorted(table, h[at]), len(table) - 1)
            hit = table[spot] == h[at]
            ends.append(at[hit])
            lens.append(np.full(int(hit.sum()), n))
            entries.append(which[spot[hit]])
        plain = np.zeros(len(codes), bool)
        for e, n in zip(ends, lens):
            if len(n) and n[0] == 1:
                plain[e] = True
        odd = np.flatnonzero(~plain)
        ends.append(odd)
        lens.append(np.ones(len(odd), np.int64))
        entries.append(np.array([self._entry(line[i]) for i in odd.tolist()], np.int64))
        end, length, entry = (np.concatenate(x) for x in (ends, lens, entries))
        order = np.argsort((inside[end] << 40) + (end << 8) + length)  # by place in the pre-token, so sums go forward
        end, length, entry = end[order], length[order], entry[order]
        weight = np.array(self.weights)[entry]
        spot = end + of[end] + 1  # every pre-token has one place more than characters
        sums = np.zeros(len(codes) + len(pieces))
        first = starts + np.arange(len(pieces))
        sums[first] = 1.0
        share, other = np.empty(len(end)), np.empty(len(end))
        step = inside[end]
        edges = np.flatnonzero(np.diff(step, prepend=-1))
        bounds = [*edges.tolist(), len(end)]
        for lo, hi in zip(bounds, bounds[1:]):
            own = sums[spot[lo:hi] - length[lo:hi]] * weight[lo:hi]
            begin = np.flatnonzero(np.diff(spot[lo:hi], prepend=-1))
            n = np.diff(np.append(begin, hi - lo))
            total = np.add.reduceat(own, begin)
            whole_ = np.repeat(total, n)
            large = 2 * own > whole_
            # the share of the others is summed where whole - own would lose small ones
            rest = np.repeat(np.add.reduceat(np.where(large, 0.0, own), begin), n)
            share[lo:hi] = own / whole_
            other[lo:hi] = np.where(large, rest, whole_ - own) / whole_
            other[lo:hi][np.repeat(n == 1, n)] = 0.0
            places = spot[lo:hi][begin]
            sums[places] = total
            for p in places[(total < 1e-200) | (total > 1e200)].tolist():
                low = max(first[np.searchsorted(first, p, side="right") - 1], p - self.longest)
                sums[low : p + 1] /= sums[p]
        order = np.lexsort((-share, spot))  # likely edges first
        spot, length, entry, share, other = (x[order] for x in (spot, length, entry, share, other))
        begin = np.flatnonzero(np.diff(spot, prepend=-1))
        n = np.diff(np.append(begin, len(spot)))
        rank = np.arange(len(spot)) - np.repeat(begin, n)
        upto = share.copy()
        for r in range(1, int(rank.max()) + 1):
            at = np.flatnonzero(rank == r)
            upto[at] += upto[at - 1]
        upto[begin + n - 1] = 2.0  # the last one takes what rounding leaves
        edge_start = np.zeros(len(sums), np.int64)
        edge_start[spot[begin]] = begin + self.n_edges
        for i, p in enumerate(pieces, self.n_tokens):
            self.of[p] = i
        numbers = np.stack([upto, share, other], axis=1)  # read together
        self.parts.append((first + self.n_places, sizes, edge_start, numbers, np.stack([spot - length + self.n_places, entry], axis=1).astype(np.int32)))
        self.n_tokens += len(pieces)
        self.n_places += len(sums)
        self.n_edges += len(spot)
        self.arrays = None

    def ready(self) -> None:
        """Arrays over all pre-tokens added so far."""
        if self.arrays is None:
            self.parts = [tuple(np.concatenate(x) for x in zip(*self.parts))] if self.parts else []
            self.arrays = self.parts[0] if self.parts else None
            n = np.array([len(x) for x in self.ids])
            self.entry_ids, self.entry_n, self.entry_at = np.frombuffer(b"".join(self.ids), "<u4"), n // 4, (np.cumsum(n) - n) // 4

    def chain(self, pieces: list[str]) -> "ArrayChain":
        return ArrayChain(self, pieces)


class ArrayChain:
    """A text over ``Lattices``: all its pre-tokens are drawn together."""

    def __init__(self, store: Lattices, pieces: list[str]):
        self.store, self.pieces, self.size = store, pieces, len(pieces)
        self.tokens = np.fromiter(map(store.of.__getitem__, pieces), np.int64, len(pieces))

    def lattice(self, place: int) -> Lattice:
        return Lattice(self.pieces[place], *self.store.args)

    def draw(self, place: int, _, noise: np.random.Generator) -> Drawn:
        n = self.size - place
        if not n:
            return Drawn(np.ones(0), np.zeros(0), b"", np.zeros(0, np.int64), None)
        store = self.store
        base, size, edge_start, numbers, links = store.arrays
        first = base[self.tokens[place:]]
        at = first + size[self.tokens[place:]]
        chance, other = np.ones(n), np.zeros(n)
        live, tokens, edges = np.arange(n), [], []
        while len(live):
            edge = edge_start[at[live]]
            u, found = noise.random(len(live)), numbers[edge]
            wait = np.flatnonzero(found[:, 0] <= u)
            while len(wait):
                edge[wait] += 1
                found[wait] = numbers[edge[wait]]
                wait = wait[found[wait, 0] <= u[wait]]
            other[live] += chance[live] * found[:, 2]
            chance[live] *= found[:, 1]
            link = links[edge]
            at[live] = link[:, 0]
            tokens.append(live)
            edges.append(link)
            live = live[link[:, 0] > first[live]]
        token, edge = np.concatenate(tokens), np.concatenate(edges)
        begins = edge[:, 0]
        # paths run backwards: the last edge drawn comes first in the text
        order = np.lexsort((-np.arange(len(token)), token))
        used = edge[order, 1]
        counts = store.entry_n[used]
        ends = np.cumsum(counts)
        spots = np.repeat(store.entry_at[used] - (ends - counts), counts) + np.arange(ends[-1])
        ids = store.entry_ids[spots].tobytes()
        last = np.searchsorted(token[order], np.arange(n), side="right") - 1
        return Drawn(chance, other, ids, 4 * ends[last], lambda j: tuple((begins[token == j] - first[j]).tolist()))


def vocabulary(model: str, power: float):
    """Pieces with their id (four bytes) and weight, the longest one, and the weight of
    a character that is in none."""
    sp = processor(model)
    check_cuts(sp)
    known = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
            piece, rank = sp.id_to_piece(i), -sp.get_score(i)
            known[piece.replace("▁", " ")] = i.to_bytes(4, "little"), (rank + 2) ** -power * PER_CHAR ** len(piece)
    first = sp.piece_to_id("<0x00>")
    rare = (sp.get_piece_size() + 2.0) ** -power * PER_CHAR

    def unknown(char: str) -> tuple[bytes, float]:
        parts = char.encode()
        return b"".join((first + b).to_bytes(4, "little") for b in parts), rare ** len(parts)

    return known, max(map(len, known)), unknown


def seed_of(key: str, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}|{key}".encode(), digest_size=8).digest(), "little")


def inclusion(log_p: float, bound: float) -> float:
    """Log probability that a segmentation's perturbed value passes ``bound``."""
    rate = math.exp(min(log_p - bound, 700.0))
    return math.log(-math.expm1(-rate)) if rate > 0 else -math.inf


def encode_samples(docs: DataFrame, model: str, keys: list[str], text: str = "text", samples: int = 3, power: float = 1.0, seed: int = 0) -> DataFrame:
    """keys, rank (from 1), ids (little-endian 32-bit), n_pieces, log_prob, perturbed and
    inclusion (log) of ``samples`` distinct segmentations a row, in the order in which
    they were drawn without replacement; fewer rows if a text has no more, with
    inclusion 0 (certain).

    Draws depend on the row's keys, the seed and the text alone. A null or empty text
    has one segmentation of no pieces; a null key counts as empty. Rows that repeat
    keys and text are sampled alike. Other columns are ignored. An empty table gives
    an empty result.
    """
    own = docs.select(*[F.col(c) for c in keys], F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys]).alias("_seed"), whole(text).alias("_text"))
    fields = [own.schema[i] for i in range(len(keys))]
    fields += [T.StructField("rank", T.IntegerType()), T.StructField("ids", T.BinaryType()), T.StructField("n_pieces", T.LongType())]
    fields += [T.StructField(n, T.DoubleType()) for n in ("log_prob", "perturbed", "inclusion")]
    names = [f.name for f in fields]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (model, power) not in _workers:
            _workers[model, power] = Lattices(*vocabulary(model, power))
        store = _workers[model, power]

        kinds = [pa.int32(), pa.binary(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]

        def made(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
            kept = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(keys))]
            own_columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([*kept, *own_columns], names=names)

        for whole_batch in batches:
            for lo in range(0, len(whole_batch), STEP):
                batch = whole_batch.slice(lo, STEP)
                texts = [pre_tokens(value) for value in batch.column(len(keys) + 1).to_pylist()]
                if store.n_edges > EDGES:
                    store.clear()
                store.add(list({p: None for text in texts for p in text if p not in store.of}))
                store.ready()
                at, rows, size = [], [], 0
                for i, (key, text) in enumerate(zip(batch.column(len(keys)).to_pylist(), texts)):
                    drawn = sample(store.chain(text), samples, seed_of(key, seed))
                    bound = drawn[samples][0] if len(drawn) > samples else None
                    for rank, (perturbed, log_p, ids) in enumerate(drawn[:samples], 1):
                        at.append(i)
                        rows.append((rank, ids, len(ids) // 4, log_p, perturbed, 0.0 if bound is None else inclusion(log_p, bound)))
                        size += len(ids)
                    if size > BATCH_BYTES:
                        yield made(batch, at, rows)
                        at, rows, size = [], [], 0
                yield made(batch, at, rows)

    return own.mapInArrow(draw, T.StructType(fields))


def decode(frame: DataFrame, model: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``frame`` with the text of its ids: pieces joined, marks read as spaces, byte
    pieces as bytes, the space the model puts in front taken off. Bytes that are no
    UTF-8 become replacement characters; null ids give null."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sp = processor(model)
        parts = [bytes([i - sp.piece_to_id("<0x00>")]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())]
        for column in batches:
            out = []
            for value in column:
                joined = None if value is None else b"".join(map(parts.__getitem__, np.frombuffer(value, "<u4").tolist())).decode("utf-8", "replace")
                out.append(joined[1:] if joined is not None and joined.startswith(" ") else joined)
            yield pd.Series(out, dtype=object)

    return frame.withColumn(name, texts(F.col(ids)))
