"""Sampled segmentations of texts over a piece vocabulary, without replacement: Gumbel top-k by perturbed A* search.

A text's segmentations are the paths of its lattice of pieces. Each path has a log-probability from its pieces, and
perturbing every path by its own Gumbel value and taking the k largest samples k different paths without replacement.
The values need not be drawn one by one: the largest of a set of paths is one Gumbel value at the set's total mass.
The search keeps a queue of disjoint sets of paths, each with its perturbed maximum, and pops the largest: its
winning path is drawn from the set, and what is left of the set is split along that path, at each node of the
lattice into the paths that leave it there, each with a maximum below the popped one. Exact mass as the heuristic makes
the search visit only winning paths.

Pieces never join white space to what is before it, so a lattice falls into units of one word with its spaces;
units are independent, and a path of the whole text is drawn for all of its units at once. What can follow a position
depends on the rest of its unit only, so units that end alike share nodes, whose masses are found once per different ending.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import common

SAMPLES = 3
#: Inverse temperature of the samples: higher values keep closer to the best segmentation.
ALPHA = 1.0
SPACE = "▁"
#: Spaces with the characters up to the next space; a line feed is a unit of its own.
UNIT = re.compile(f"{SPACE}*[^{SPACE}\\n]+|{SPACE}+|\\n")
#: Nodes kept in each Python worker.
REMEMBERED = 400_000
#: Characters of texts searched together; what a search holds beside the store follows them.
SLICE = 200_000
#: Stands for the vocabulary's mark where a text itself has that character; no text can hold a lone surrogate.
MARK = "\ud800"
FACTOR = 0x9E3779B97F4A7C15
#: What random numbers are for.
ROOT, DRAW, SPLIT, LEAVE = 1, 2, 3, 4
ONE = np.zeros(1, np.uint64)
STEP, LANE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
SAMPLE = pa.struct(
    [("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("log_prob", pa.float64()), ("inclusion", pa.float64())]
)


class Vocabulary:
    """Pieces with log-probabilities, and the ids of single bytes for characters without a piece.

    A merge vocabulary has ranks in place of probabilities; a piece of rank r weighs as 1 / (r + 10), by Zipf's law,
    which makes them probabilities of the right shape without any training.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text, self.byte_ids = [b""] * n, [0] * 256
        rank, normal = np.full(n, float(n)), []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.text[i] = piece.replace(SPACE, " ").encode()
                normal.append((piece, i))
                # Normal pieces carry minus their merge rank; what was added by hand is rare but usable.
                rank[i] = -model.get_score(i) if model.get_score(i) > -1e8 else n
        self.longest = max(len(piece) for piece, _ in normal)
        weight = -np.log(rank + 10.0)
        weight -= np.log(np.exp(weight[[i for _, i in normal]]).sum())
        self.byte_weight = float(weight.min()) - 1.0
        # A symbol is a piece, or a character spelt in bytes, whose ids lie in ``spelt`` at ``begin``.
        self.weight, self.begin, self.spelt = weight, np.arange(n + 1), np.arange(n, dtype=np.int32)
        self.spelling: dict[int, int] = {}
        keys, begun = np.zeros(len(normal), np.uint64), set()
        for k, (piece, _) in enumerate(normal):
            h = 0
            for c in piece:
                begun.add(h)
                h = (h * FACTOR + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            keys[k] = h
        order = np.argsort(keys)
        self.keys, self.symbols = keys[order], np.array([i for _, i in normal])[order]
        # By slot of a key: 1 if it may be a piece, 2 if a longer piece may begin so.
        self.likely = np.zeros(1 << 20, np.uint8)
        self.likely[slot(self.keys)] = 1
        self.likely[slot(np.array(sorted(begun), np.uint64))] |= 2
        self.bytes = pa.array(self.text, pa.large_binary())

    def spell(self, code: int) -> int:
        """The symbol of a character without a piece."""
        if code not in self.spelling:
            data = (SPACE if code == ord(MARK) else chr(code)).encode()
            self.spelling[code] = len(self.weight)
            self.spelt = np.append(self.spelt, np.array([self.byte_ids[b] for b in data], np.int32))
            self.begin = np.append(self.begin, len(self.spelt))
            self.weight = np.append(self.weight, self.byte_weight * len(data))
        return self.spelling[code]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece of each key, or -1, and whether a longer piece may begin with it."""
        out, likely = np.full(len(keys), -1), self.likely[slot(keys)]
        maybe = np.flatnonzero(likely & 1)
        at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == keys[maybe]
        out[maybe[hit]] = self.symbols[at[hit]]
        return out, likely > 1

    def decode(self, ids) -> str:
        """The text of a segmentation, without the space that was put before it."""
        return b"".join(map(self.text.__getitem__, ids))[1:].decode()

    def decode_all(self, segmentations: list[np.ndarray]) -> Iterator[bytes]:
        """The UTF-8 text of each segmentation, with the space that was put before it."""
        spelt = self.bytes.take(pa.array(np.concatenate([np.empty(0, np.int32), *segmentations])))
        ends = np.cumsum([0, *map(len, segmentations)])
        if not ends[-1]:
            return iter([b""] * len(segmentations))
        _, offsets, data = spelt.buffers()
        at = np.frombuffer(offsets, np.int64)[ends].tolist()
        data = data.to_pybytes()
        return (data[a:b] for a, b in zip(at, at[1:]))


def slot(keys: np.ndarray) -> np.ndarray:
    return mixed(keys) >> np.uint64(44)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def lane_step(step: int, by: np.uint64) -> np.uint64:
    return np.uint64(step * int(by) & 0xFFFFFFFFFFFFFFFF)


def uniform(stream: np.ndarray, step: int) -> np.ndarray:
    """Numbers strictly between 0 and 1 that depend on a stream and a step only."""
    return ((mixed(stream + lane_step(step, STEP)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def lane(stream: np.ndarray, use: int, turn: int, place: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """Streams of their own for every use, turn of the search and place in the text; many places of each if sizes are given."""
    own = mixed(stream + lane_step(16 * turn + use, LANE))
    return mixed((own if sizes is None else np.repeat(own, sizes)) + place * STEP)


class Store:
    """Lattices of the different units seen, side by side in arrays.

    A node is the rest of a unit from a position on, whichever units end so; the edges of a node are neighbours.
    ``share`` is an edge's probability among all continuations of its node, from the masses of all segmentations of the
    rest of the unit (``after``, a logarithm); ``log_rest`` is the logarithm of what the node's other edges have.
    ``start`` has the first nodes of units that were learnt by name.
    """

    def __init__(self, vocabulary: Vocabulary, alpha: float):
        self.vocabulary, self.alpha = vocabulary, alpha
        # Room for all that is usually kept: what isn't written takes no memory, and nothing is copied as the store grows.
        room = REMEMBERED + SLICE
        self.first, self.after = np.empty(room, np.int64), np.empty(room)
        self.to, self.symbol = np.empty((2, 4 * room), np.int32)
        self.share, self.log_rest = np.empty((2, 4 * room))
        self.clear()

    def clear(self) -> None:
        """Forget all units; the arrays stay as large as they are and are written anew."""
        self.start: dict[str, int] = {}
        self.nodes = self.edges = 0
        # Keys of the nodes' endings in order, and the node of each.
        self.keys, self.node_of = np.empty(0, np.uint64), np.empty(0, np.int64)

    def learn(self, units: list[str]) -> None:
        """Add the lattices of units."""
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([0, *map(len, units)])
        nodes = self.enter(codes, ends[:-1])
        self.start.update(zip(units, nodes.tolist()))

    def known(self, keys: np.ndarray) -> np.ndarray:
        """The node of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.node_of[at], -1)

    def enter(self, codes: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """First nodes of the units that begin at places of a text; nodes not known yet are added, all at once."""
        if self.nodes > REMEMBERED:
            self.clear()
        if not len(begin):
            return np.empty(0, np.int64)
        sizes = np.diff(begin, append=len(codes))
        left = np.repeat(begin + sizes, sizes) - np.arange(len(codes))
        # An ending's key is a sum over its characters of a number for the character and its place from the end.
        keys = mixed(codes * np.uint64(FACTOR) + left.view(np.uint64) * LANE)
        sums = np.cumsum(keys)
        keys += np.repeat(sums[begin + sizes - 1], sizes) - sums
        units, at, which = np.unique(keys[begin], return_index=True, return_inverse=True)
        nodes = self.known(units)
        new = nodes < 0
        if new.any():
            n = sizes[at[new]]
            spans = np.repeat(begin[at[new]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            self.add(codes[spans].astype(np.uint64), left[spans], keys[spans])
            nodes[new] = self.known(units[new])
        return nodes[which]

    def add(self, codes: np.ndarray, left: np.ndarray, keys: np.ndarray) -> None:
        """Add the nodes of units side by side: edges by length, masses from the units' ends."""
        v = self.vocabulary
        keys, at, which = np.unique(keys, return_index=True, return_inverse=True)
        node = self.known(keys)
        new = np.flatnonzero(node < 0)
        order = np.argsort(left[at[new]], kind="stable")
        node[new[order]] = np.arange(self.nodes, self.nodes + len(new))
        place = np.searchsorted(self.keys, keys[new])
        self.keys, self.node_of = np.insert(self.keys, place, keys[new]), np.insert(self.node_of, place, node[new])
        # From here on nodes are numbered from the first new one, by their distance from the end of the unit.
        at, node = at[new[order]], node[which]
        left = left[at]
        on, keys = np.arange(len(at)), np.zeros(len(at), np.uint64)
        # A character counts as its code plus one, so that a leading NUL is not lost.
        counted = codes + np.uint64(1)
        found, many = [], np.zeros(len(at), np.int64)
        for length in range(1, v.longest + 1):
            keys = keys * np.uint64(FACTOR) + counted[at[on] + length - 1]
            symbol, longer = v.find(keys)
            if length == 1:
                for k in np.flatnonzero(symbol < 0):
                    symbol[k] = v.spell(int(codes[at[k]]))
            hit = np.flatnonzero(symbol >= 0)
            found.append((on[hit], symbol[hit]))
            many[on[hit]] += 1
            go = np.flatnonzero(longer & (left[on] > length))
            on, keys = on[go], keys[go]
            if not len(on):
                break

        # Edges of a node side by side.
        first = np.cumsum(many) - many
        edges = int(many.sum())
        symbol, to, slots = np.empty(edges, np.int64), np.empty(edges, np.int64), first.copy()
        for length, (on, symbols) in enumerate(found, 1):
            edge = slots[on]
            symbol[edge] = symbols
            to[edge] = np.where(left[on] == length, -1, node[np.minimum(at[on] + length, len(node) - 1)])
            slots[on] += 1
        weight = self.alpha * v.weight[symbol]
        share, rest = np.empty(edges), np.empty(edges)
        self.after = grown(self.after, self.nodes, np.zeros(len(at)))
        bounds = np.flatnonzero(np.diff(left, prepend=0)).tolist()
        for i, j in zip(bounds, [*bounds[1:], len(at)]):
            a, b = int(first[i]), int(first[j - 1] + many[j - 1])
            begin, n = first[i:j] - a, many[i:j]
            x = weight[a:b] + np.where(to[a:b] < 0, 0.0, self.after[to[a:b]])
            highest = np.maximum.reduceat(x, begin)
            top = np.repeat(highest, n)
            e = np.exp(x - top)
            sums = np.add.reduceat(e, begin)
            total = np.repeat(sums, n)
            largest = x == top
            # What is left beside the largest edge is summed without it, so that little is not lost.
            others = np.where(largest, np.repeat(np.add.reduceat(np.where(largest, 0.0, e), begin), n), total - e)
            ties = np.repeat(np.add.reduceat(largest.astype(np.int64), begin), n)
            others = np.where(largest, others + ties - 1, others)
            share[a:b], rest[a:b] = e / total, others / total
            self.after[self.nodes + i : self.nodes + j] = highest + np.log(sums)

        order = np.lexsort((-share, np.repeat(np.arange(len(at)), many)))
        share = share[order]
        with np.errstate(divide="ignore"):
            log_rest = np.log(rest[order])
        self.first = grown(self.first, self.nodes, np.append(first, edges) + self.edges)
        for name, values in zip(("to", "symbol", "share", "log_rest"), (to[order], symbol[order], share, log_rest)):
            setattr(self, name, grown(getattr(self, name), self.edges, values))
        self.nodes, self.edges = self.nodes + len(at), self.edges + edges

    def pick(self, nodes: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node; a node's likeliest edges come first, so few are passed over."""
        edge = self.first[nodes]
        share = self.share[edge]
        on = np.flatnonzero(u >= share)
        u, at, last = u[on] - share[on], edge[on], self.first[nodes[on] + 1] - 1
        while len(on):
            # Those that stay at their node's last edge are done, the others go one edge further.
            go = at < last
            on, u, at, last = on[go], u[go], at[go] + 1, last[go]
            edge[on] = at
            share = self.share[at]
            go = u >= share
            on, u, at, last = on[go], u[go] - share[go], at[go], last[go]
        return edge

    def draw(self, nodes: np.ndarray, streams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ancestral samples from each node to its unit's end: edges of all in order, and the number of each."""
        at, who, steps = nodes, np.arange(len(nodes)), []
        while len(who):
            edge = self.pick(at, uniform(streams[who], len(steps)))
            steps.append((who, edge))
            at = self.to[edge]
            go = at >= 0
            at, who = at[go], who[go]
        counts = np.zeros(len(nodes), np.int64)
        for who, _ in steps:
            counts[who] += 1
        offsets = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int64)
        for k, (who, edge) in enumerate(steps):
            out[offsets[who] + k] = edge
        return out, counts

    def ids_of(self, path: np.ndarray) -> np.ndarray:
        return self.ids_of_each([path])[0]

    def ids_of_each(self, paths: list[np.ndarray]) -> list[np.ndarray]:
        """The ids of each path, all looked up at once."""
        v, ends = self.vocabulary, np.cumsum([0, *map(len, paths)])
        symbols = self.symbol[np.concatenate([np.empty(0, np.int64), *paths])]
        a = v.begin[symbols]
        n = v.begin[symbols + 1] - a
        upto = np.cumsum(np.append(0, n))
        ids = v.spelt[np.repeat(a - upto[:-1], n) + np.arange(int(upto[-1]))]
        at = upto[ends].tolist()
        return [ids[a:b] for a, b in zip(at, at[1:])]

    def siblings(self, edge: int) -> range:
        """All edges of the node that an edge leaves."""
        node = int(np.searchsorted(self.first[: self.nodes + 1], edge, side="right")) - 1
        return range(int(self.first[node]), int(self.first[node + 1]))


def grown(array: np.ndarray, size: int, values: np.ndarray) -> np.ndarray:
    need = size + len(values)
    if need > len(array):
        # Only what is in use is copied: memory that nothing was written to is not taken.
        larger = np.empty(max(need, 2 * len(array)), array.dtype)
        larger[:size] = array[:size]
        array = larger
    array[size:need] = values
    return array


def truncated(mass: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values at log masses, given that they lie below their bounds."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        return np.where(np.isneginf(mass), -np.inf, mass - np.log(np.exp(mass - bound) - np.log(u)))


@dataclass
class Search:
    """The queue of one text: sets of paths that share edges of ``path`` up to a place and leave it there."""

    starts: np.ndarray
    queue: list = field(default_factory=list)
    found: list = field(default_factory=list)
    pending: tuple | None = None


def units_of(text: str) -> list[str]:
    """Units of a text as encoded: a space is put before it, and spaces become the vocabulary's mark."""
    if not text:
        return []
    return UNIT.findall(SPACE + text.replace(SPACE, MARK).replace(" ", SPACE))


def laid_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts as encoded, the places where their units begin (those of ``units_of``), and each text's number of units."""
    marked = [" " + t if t else "" for t in texts]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    space, feed = codes == ord(" "), codes == ord("\n")
    codes[codes == ord(SPACE)] = ord(MARK)
    codes[space] = ord(SPACE)
    begins = feed.copy()
    begins[1:] |= feed[:-1] | (space[1:] & ~space[:-1])
    ends = np.cumsum(sizes)
    begins[(ends - sizes)[sizes > 0]] = True
    begin = np.flatnonzero(begins)
    return codes, begin, np.diff(np.searchsorted(begin, ends), prepend=0)


def sample(texts: list[str], keys: list[int], store: Store, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k different segmentations (ids, log-probability, perturbed value, inclusion), best first.

    All texts take a round of their search together, so that paths are drawn for all of them at once.
    """
    codes, begin, units = laid_out(texts)
    starts = store.enter(codes, begin)
    streams = mixed(np.array(keys, np.int64).view(np.uint64) + STEP)
    searches = [Search(s) for s in np.split(starts, np.cumsum(units)[:-1])] if texts else []
    for s, u in zip(searches, uniform(lane(streams, ROOT, 0, ONE), 0).tolist()):
        s.pending = (-math.log(-math.log(u)), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), None, -1, frozenset())
    for turn in range(k):
        which = [i for i, s in enumerate(searches) if s.pending]
        if not which:
            break
        live, own, tails, keeps = [searches[i] for i in which], streams[which], [], []
        for s in live:
            _, path, _, _, edge, unit, _ = s.pending
            tail = s.starts[unit + 1 :]
            if edge is not None and store.to[edge] >= 0:
                tail = np.concatenate([[store.to[edge]], tail])
            tails.append(tail)
            keeps.append(len(path))
        sizes = np.fromiter(map(len, tails), np.int64, len(tails))
        places = np.repeat(np.cumsum(sizes), sizes) - 1 - np.arange(int(sizes.sum()))
        drawn, counts = store.draw(np.concatenate(tails), lane(own, DRAW, turn, places.view(np.uint64), sizes))
        drawn_logs = np.log(store.share[drawn])
        edges_upto = np.cumsum(counts)
        masses, bounds, firsts = [], [], []
        at = edges_at = 0
        for s, size, keep in zip(live, sizes.tolist(), keeps):
            value, path, logs, upto, edge, unit, out = s.pending
            upto_tail = edges_upto[at : at + size] - edges_at + keep
            end = edges_at + int(upto_tail[-1]) - keep if size else edges_at
            tail, tail_logs = drawn[edges_at:end], drawn_logs[edges_at:end]
            if edge is None:
                path, logs, upto = tail, tail_logs, upto_tail
            else:
                inside = store.to[edge] >= 0
                path, logs = np.concatenate([path, [edge], tail]), np.concatenate([logs, np.log(store.share[[edge]]), tail_logs])
                upto = np.concatenate([upto[:unit], upto_tail + 1] if inside else [upto[:unit], [keep + 1], upto_tail + 1])
            at, edges_at = at + size, end
            s.found.append((path, float(logs.sum()), value))
            # Split what is left of the popped set along its winner.
            left = store.log_rest[path[keep:]]
            if edge is not None:
                out = out | {int(edge)}
                share = sum(float(store.share[e]) for e in store.siblings(edge) if e not in out)
                left[0] = math.log(share) if share > 0 else -math.inf
            masses.append((np.cumsum(logs) - logs)[keep:] + left)
            bounds.append(value)
            firsts.append((logs, upto, out))
        sizes = np.fromiter(map(len, masses), np.int64, len(masses))
        ends = np.cumsum(sizes)
        places = np.arange(int(ends[-1])) + np.repeat(np.array(keeps) - (ends - sizes), sizes)
        u = uniform(lane(own, SPLIT, turn, places.view(np.uint64), sizes), 0)
        best_of = truncated(np.concatenate(masses), np.repeat(bounds, sizes), u)
        leave = uniform(lane(own, LEAVE, turn, ONE), 0).tolist()
        want = k - turn
        for s, (logs, upto, out), keep, a, b, u in zip(live, firsts, keeps, (ends - sizes).tolist(), ends.tolist(), leave):
            path, edge, best = s.found[-1][0], s.pending[4], best_of[a:b]
            top = np.argpartition(-best, want)[:want] if len(best) > want else np.arange(len(best))
            for j in top.tolist():
                if best[j] > -np.inf:
                    taken = out if j == 0 and edge is not None else frozenset([int(path[keep + j])])
                    heapq.heappush(s.queue, (-float(best[j]), len(s.found), keep + j, path, logs, upto, taken))
            s.pending = None
            if s.queue and turn + 1 < k:
                v, _, t, path, logs, upto, taken = heapq.heappop(s.queue)
                options = [e for e in store.siblings(path[t]) if e not in taken]
                weights = np.cumsum(store.share[options])
                pick = np.searchsorted(weights, u * weights[-1])
                unit = int(np.searchsorted(upto, t, side="right"))
                s.pending = (-v, path[:t], logs[:t], upto, options[min(int(pick), len(options) - 1)], unit, taken)
    out, ids = [], iter(store.ids_of_each([path for s in searches for path, *_ in s.found]))
    for s in searches:
        bar = -s.queue[0][0] if s.queue else -math.inf
        chance = lambda p: -math.expm1(-math.exp(min(700.0, p - bar))) if bar > -math.inf else 1.0
        out.append([(next(ids), p, v, chance(p)) for _, p, v in s.found])
    return out


def store_of(path: str, alpha: float) -> Store:
    stores = common.remembered("pieces")
    if (path, alpha) not in stores:
        stores[path, alpha] = Store(Vocabulary(path), alpha)
    return stores[path, alpha]


def sampled(
    docs: DataFrame, path: str, id_col="doc_id", text_col="text", *, k: int = SAMPLES, alpha: float = ALPHA, keep_ids: bool = True
) -> DataFrame:
    """(id, samples, round_trip), one row per input row.

    ``samples`` are up to k different segmentations, by falling perturbed value: ids (left out unless ``keep_ids``),
    their number and checksum, the log-probability among all segmentations and the estimated probability of being
    included. ``round_trip`` tells whether every sample decodes to the text. A null or empty text has one empty
    segmentation; a text with fewer segmentations than k has them all. Samples depend on id, text and
    parameters only, so repeated rows get equal ones; a null id is as 0. An empty table gives no rows.
    """

    def run(batches):
        store = store_of(path, alpha)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            keys = [i or 0 for i in batch.column("id").to_pylist()]
            rows, trips, at = [], [], 0
            while at < len(texts):
                upto, size = at, 0
                while upto < len(texts) and (upto == at or size + len(texts[upto]) <= SLICE):
                    size += len(texts[upto])
                    upto += 1
                samples = sample(texts[at:upto], keys[at:upto], store, k)
                decoded = store.vocabulary.decode_all([ids for found in samples for ids, *_ in found])
                for text, found in zip(texts[at:upto], samples):
                    wanted = b" " + text.encode() if text else b""
                    trips.append(all([next(decoded) == wanted for _ in found]))
                    rows.append(
                        [
                            {
                                "ids": ids if keep_ids else None,
                                "n_tokens": len(ids),
                                "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes()),
                                "log_prob": round(p, 6),
                                "inclusion": q,
                            }
                            for ids, p, _, q in found
                        ]
                    )
                at = upto
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(rows, pa.list_(SAMPLE)), pa.array(trips, pa.bool_())], ["id", "samples", "round_trip"]
            )

    one = "struct<ids:array<int>,n_tokens:bigint,ids_crc32:bigint,log_prob:double,inclusion:double>"
    return common.text_rows(docs, id_col, text_col).mapInArrow(run, f"id long, samples array<{one}>, round_trip boolean")
