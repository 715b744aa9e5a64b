"""Sampled segmentations into SentencePiece pieces, without replacement, by Gumbel top-k search; and decoding.

A text's lattice has an edge for every vocabulary piece at every place. Scores are log weights of pieces, so a walk that
takes edge e at node i with probability exp(score + beta(end) - beta(i)), beta being the log sum over all ways to the end,
samples a segmentation by its probability. The k segmentations of the largest Gumbel-perturbed log probabilities are k
draws without replacement. They are found best first: the queue holds disjoint sets of segmentations (a fixed beginning,
edges excluded at the next node, the rest free), each under the largest perturbed value in it, which is drawn top down as
a Gumbel of the set's log probability, truncated at its parent's. The set at the head yields its segmentation and is
split, one new set for each place where the others can leave it. Every value taken from the queue is exact, no bound is
guessed, and the first value left in it is the threshold of the inclusion scores.

No piece crosses the start of a run of spaces or a line feed, so lattices are built once for each distinct stretch between
them; a text is a chain of stretches. All random numbers are hashes of seed, row key, draw and place.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import joined, mixed, pieces, same_spans, span_hashes

STEP = np.uint64(0x9E3779B97F4A7C15)
SPACE, FEED = 32, 10
NULL_KEY = np.uint64(0x5EED)
PLAIN = 24


@dataclass
class Vocabulary:
    """Pieces as bytes (space for the word mark), their ids and log weights, and the ids of the 256 byte pieces."""

    surface: list[bytes]
    ids: np.ndarray
    score: np.ndarray
    byte_ids: np.ndarray
    byte_score: float

    def __post_init__(self) -> None:
        flat = b"".join(self.surface)
        size = np.array([len(x) for x in self.surface], np.int64)
        begin = np.cumsum(size) - size
        hashes = _roll(np.frombuffer(flat, np.uint8), begin, size)
        self.longest = int(size.max(initial=1))
        order = np.argsort(hashes)
        self.hashes, self.order = hashes[order], order
        # bytes to the next border up to which sums are kept as numbers, being far from too small for one
        lowest = min(self.byte_score, float((self.score / np.maximum(size, 1)).min(initial=0)))
        self.plain = int(min(PLAIN, 600 / max(-lowest, 1.0)))
        # where a hash's upper bits lead among the sorted hashes: nowhere (-1), or to the last piece that has them
        self.slot = np.full(1 << 20, -1, np.int32)
        self.slot[(self.hashes >> np.uint64(44)).astype(np.int64)] = np.arange(len(order))
        self.crowd = int(np.bincount((hashes >> np.uint64(44)).astype(np.int64), minlength=1).max(initial=1))
        # hashes of all that pieces begin with: a place whose bytes are no such beginning has no longer piece either
        self.begun = np.zeros(1 << 22, bool)
        for k in range(1, self.longest):
            some = size > k
            self.begun[(_roll(np.frombuffer(flat, np.uint8), begin[some], np.full(int(some.sum()), k)) >> np.uint64(42)).astype(np.int64)] = True
        # bytes of each id, for decoding
        top = int(max(self.ids.max(initial=0), self.byte_ids.max(initial=0))) + 1
        whole = [b""] * top
        for i, x in zip(self.ids.tolist(), self.surface, strict=True):
            whole[i] = x
        for b, i in enumerate(self.byte_ids.tolist()):
            whole[i] = bytes([b])
        self.piece_size = np.array([len(x) for x in whole], np.int64)
        self.piece_at = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(whole), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids, without the space that encoding puts first."""
        size = self.piece_size[ids]
        at = np.repeat(self.piece_at[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return self.piece_bytes[at].tobytes()[1:]


def _roll(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    h = np.zeros(len(begin), np.uint64)
    for k in range(int(size.max(initial=0))):
        live = size > k
        h[live] = (h[live] + raw[begin[live] + k].astype(np.uint64) + np.uint64(1)) * STEP
        h[live] ^= h[live] >> np.uint64(29)
    return h


def load(path: str, by_rank: bool = True) -> Vocabulary:
    """Reads a SentencePiece model file. by_rank: log weights are -log(1 + rank) (Zipf), for models whose scores are merge
    ranks and no log probabilities; else the model's scores. Control and unknown pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    surface = [sp.id_to_piece(i).replace("▁", " ").encode() for i in plain]
    if any(b" " in s.lstrip(b" ") or (b"\n" in s and s != b"\n") for s in surface):
        raise ValueError("a piece has a space or line feed inside; stretches would not be independent")
    score = np.array([sp.get_score(i) for i in plain])
    if by_rank:
        score = -np.log(2.0 + np.argsort(np.argsort(-score, kind="stable")))
    byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
    if not all(sp.is_byte(int(i)) for i in byte_ids):
        raise ValueError("the model has no byte pieces")
    if max(map(len, surface), default=0) > 60:
        raise ValueError("pieces of more than 60 bytes do not fit the masks of excluded edges")
    return Vocabulary(surface, np.array(plain, np.int64), score, byte_ids, float(score.min(initial=0)) - 1.0)


@dataclass
class Lattice:
    """Edges of distinct stretches, by node: node i has edges first[i]..first[i + 1]; ends are the last nodes."""

    first: np.ndarray
    src: np.ndarray
    to: np.ndarray
    piece: np.ndarray  # index into ids, or -1 for a character in byte pieces
    logp: np.ndarray
    upto: np.ndarray  # probabilities summed within the node
    log_left: np.ndarray  # log probability of the node's other edges; -inf if there is none
    start: np.ndarray  # first node of each stretch
    end: np.ndarray
    raw: np.ndarray  # the byte at each node


LEVEL_COST = 150  # edges that take as long one by one as a level of few edges takes at once


def build(vocabulary: Vocabulary, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Lattice:
    """The lattice of stretches raw[begin:end]; each gets its bytes as nodes and one more for its end."""
    size = end - begin
    start = np.cumsum(size + 1) - (size + 1)
    n = int((size + 1).sum())
    inner = np.arange(n) - np.repeat(start, size + 1)
    is_byte = np.ones(n, bool)
    is_byte[start + size] = False
    byte = np.zeros(n, np.uint8)
    byte[is_byte] = raw[(np.repeat(begin, size + 1) + inner)[is_byte]]
    left = np.repeat(size, size + 1) - inner  # bytes from here to the end
    head = is_byte & ((byte & 0xC0) != 0x80)
    head[start[size > 0]] = True
    # length of the character at each head: to the next head or the end
    stops = np.flatnonzero(head | ~is_byte)
    wide = np.zeros(n, np.int64)
    wide[stops[:-1]] = np.diff(stops)
    at, h = np.flatnonzero(head), np.zeros(int(head.sum()), np.uint64)
    found = []  # (source, length, piece) by length
    has_one = np.zeros(n, bool)
    for k in range(vocabulary.longest):
        live = left[at] > k
        at, h = at[live], h[live]
        if not len(at):
            break
        h = (h + byte[at + k] + np.uint64(1)) * STEP
        h ^= h >> np.uint64(29)
        place = vocabulary.slot[(h >> np.uint64(44)).view(np.int64)]
        maybe = np.flatnonzero(place >= 0)
        place = place[maybe]
        ok = vocabulary.hashes[place] == h[maybe]
        for j in range(1, vocabulary.crowd):
            again = np.flatnonzero(~ok & (place >= j))
            hit = vocabulary.hashes[place[again] - j] == h[maybe[again]]
            place[again[hit]] -= j
            ok[again[hit]] = True
        src = at[maybe[ok]]
        found.append((src, np.full(len(src), k + 1), vocabulary.order[place[ok]]))
        has_one[src[wide[src] == k + 1]] = True
        live = vocabulary.begun[(h >> np.uint64(42)).view(np.int64)]
        at, h = at[live], h[live]
    bare = np.flatnonzero(head & ~has_one)
    found.append((bare, wide[bare], np.full(len(bare), -1)))
    # edges by source: each length has a source once, so places are counted, not sorted
    fan = np.zeros(n, np.int64)
    for node, _, _ in found:
        fan[node] += 1
    first = np.concatenate(([0], np.cumsum(fan)))
    src = np.repeat(np.arange(n), fan)
    free = first[:-1].copy()
    step, piece = np.empty(len(src), np.int64), np.empty(len(src), np.int64)
    for node, length, which in found:
        e = free[node]
        step[e], piece[e] = length, which
        free[node] += 1
    dst = src + step
    weight = np.where(piece >= 0, vocabulary.score[piece], vocabulary.byte_score * step)
    # places that no edge crosses part a stretch into independent runs; sums go to the end of the run
    cross = np.zeros(n + 1, np.int64)
    more = step > 1
    np.add.at(cross, src[more] + 1, 1)
    np.subtract.at(cross, dst[more], 1)
    border = head & (np.cumsum(cross[:-1]) == 0)
    border |= ~is_byte
    edges = np.flatnonzero(border)
    away = edges[np.searchsorted(edges, np.arange(n), "right").clip(max=max(0, len(edges) - 1))] - np.arange(n) if n else np.zeros(0, np.int64)
    # levels of few edges, far from the next border, are summed one by one: what is left beyond the cheapest level
    far = np.bincount(away[src], minlength=1)
    deepest = min(int(np.argmin(LEVEL_COST * np.arange(len(far)) + len(src) - np.cumsum(far))), 0xFFFF)
    slow = away[src] > deepest
    by = np.flatnonzero(~slow) if slow.any() else np.arange(len(src))
    by = by[np.argsort(away[src[by]].astype(np.uint16), kind="stable")]
    level = away[src[by]]
    levels = np.append(np.flatnonzero(np.diff(level, prepend=-1)), len(by))
    source, target, factor = src[by], dst[by], np.exp(weight[by])
    sums, beyond = np.zeros(n), np.ones(n)  # beyond: a sum as seen from before, 1 at a border
    beta, plain = np.full(n, -np.inf), int(np.searchsorted(level, vocabulary.plain, "right"))
    for a, b in zip(levels[:-1], levels[1:], strict=True):
        if a == plain:  # from here on sums could be too small for a number, and are kept as logs
            beyond = np.log(np.maximum(beyond, 1e-320))
        cut = np.flatnonzero(np.diff(source[a:b], prepend=-1))
        node = source[a:b][cut]
        if b <= plain:
            total = np.add.reduceat(factor[a:b] * beyond[target[a:b]], cut)
            sums[node] = total
        else:
            value = weight[by[a:b]] + beyond[target[a:b]]
            top = np.maximum.reduceat(value, cut)
            total = np.add.reduceat(np.exp(value - np.repeat(top, np.diff(np.append(cut, b - a)))), cut)
            total = beta[node] = top + np.log(total)
        inside = ~border[node]
        beyond[node[inside]] = total[inside]
    if plain == len(by):
        beyond = np.log(np.maximum(beyond, 1e-320))
    done = sums > 0
    beta[done] = np.log(sums[done])
    if slow.any():
        _sums_one_by_one(np.flatnonzero(slow), first, dst, src, weight, beta, beyond, border)
    logp = weight + beyond[dst] - beta[src]
    p = np.exp(logp)
    upto = np.cumsum(p)
    upto -= np.repeat((upto - p)[first[:-1][fan > 0]], fan[fan > 0])
    upto[first[1:][fan > 0] - 1] = 2.0  # the last edge holds whatever the others do not
    out = Lattice(first, src, dst, piece, np.minimum(logp, 0.0), upto, np.log(np.maximum(1 - p, 1e-300)), start, start + size, byte)
    near = np.flatnonzero((p > 0.999) & (fan[src] > 1))  # too near 1 for a difference
    out.log_left[near] = np.log(np.maximum(_others(out, src[near], np.left_shift(1, near - first[src[near]])), 1e-300))
    out.log_left[fan[src] == 1] = -np.inf
    return out


def _sums_one_by_one(edges: np.ndarray, first: np.ndarray, dst: np.ndarray, src: np.ndarray, weight: np.ndarray, beta: np.ndarray, beyond: np.ndarray, border: np.ndarray) -> None:
    """Fills beta of the edges' sources from the last to the first: runs of which levels would have a few edges each."""
    nodes = np.unique(src[edges])[::-1].tolist()
    values = dict(zip(nodes, beta[nodes].tolist(), strict=True))
    lo, hi = first[nodes].tolist(), first[[i + 1 for i in nodes]].tolist()
    for i, a, b in zip(nodes, lo, hi, strict=True):
        v = [w + (0.0 if edge else values[d] if d in values else float(beta[d])) for w, d, edge in zip(weight[a:b].tolist(), dst[a:b].tolist(), border[dst[a:b]].tolist(), strict=True)]
        top = max(v)
        values[i] = top + math.log(sum(math.exp(x - top) for x in v))
    beta[nodes] = [values[i] for i in nodes]
    inside = np.array(nodes)[~border[nodes]]
    beyond[inside] = beta[inside]


class Known:
    """Lattices of stretches that came twice or more, kept for later texts in arrays of a bounded size.

    The lattices of a piece's other stretches stand behind them for as long as the piece lasts.
    """

    def __init__(self, most_edges: int = 2_500_000) -> None:
        self.most = most_edges
        self.keys, self.which = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.kept = (0, 0, 0)  # nodes, edges and stretches that stay
        self.begun = np.zeros(1 << 22, bool)  # marks of hashes that have been seen
        self.arrays: dict[str, np.ndarray] = {}

    def _put(self, name: str, at: int, values: np.ndarray, kind: type) -> None:
        old = self.arrays.get(name)
        if old is None or len(old) < at + len(values):
            new = np.empty(int((at + len(values)) * 1.2) + 1, kind)
            if old is not None:
                new[:at] = old[:at]
            self.arrays[name] = new
        self.arrays[name][at : at + len(values)] = values

    def lattice(self, vocabulary: Vocabulary, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[Lattice, np.ndarray]:
        """A lattice that has all these stretches, and the number of each in it."""
        keys, one, back = np.unique(span_hashes(raw, begin, end), return_index=True, return_inverse=True)
        alike = same_spans(raw, begin, end, raw, begin[one[back]], end[one[back]])
        if not alike.all():  # equal hashes of different bytes: these stretches stand for themselves
            odd = np.flatnonzero(~alike)
            back[odd] = len(keys) + np.arange(len(odd))
            one, keys = np.concatenate((one, odd)), np.concatenate((keys, np.zeros(len(odd), np.uint64)))
        number = np.full(len(keys), -1)
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[place] == keys)
            old = self.which[place[hit]]
            a = self.arrays
            same = same_spans(raw, begin[one[hit]], end[one[hit]], a["raw"], a["start"][old], a["end"][old])
            number[hit[same]] = old[same]
        new = np.flatnonzero(number < 0)
        mark = (keys[new] >> np.uint64(42)).view(np.int64)
        again = self.begun[mark] & (keys[new] != 0)
        self.begun[mark] = True
        new = new[np.argsort(~again, kind="stable")]
        made = build(vocabulary, raw, begin[one[new]], end[one[new]])
        nodes, edges, stretches = self.kept
        number[new] = stretches + np.arange(len(new))
        for name, at, values, kind in (
            ("first", nodes, made.first + edges, np.int64), ("src", edges, made.src + nodes, np.int32), ("to", edges, made.to + nodes, np.int32), ("piece", edges, made.piece, np.int32), ("logp", edges, made.logp, np.float64),
            ("upto", edges, made.upto, np.float64), ("log_left", edges, made.log_left, np.float64), ("start", stretches, made.start + nodes, np.int64), ("end", stretches, made.end + nodes, np.int64), ("raw", nodes, made.raw, np.uint8),
        ):
            self._put(name, at, values, kind)
        a = self.arrays
        all_nodes, all_edges = nodes + len(made.raw), edges + len(made.src)
        whole = Lattice(a["first"][: all_nodes + 1], *(a[x][:all_edges] for x in ("src", "to", "piece", "logp", "upto", "log_left")), *(a[x][: stretches + len(new)] for x in ("start", "end")), a["raw"][:all_nodes])
        count = int(again.sum())
        if count and edges < self.most:
            ends = made.end[:count] + 1  # nodes up to each stretch's end
            count = int(np.searchsorted(made.first[ends], self.most - edges, "right"))
            if count:
                self.kept = (nodes + int(ends[count - 1]), edges + int(made.first[ends[count - 1]]), stretches + count)
                keys = np.concatenate((self.keys, keys[new[:count]]))
                order = np.argsort(keys, kind="stable")
                self.keys, self.which = keys[order], np.concatenate((self.which, stretches + np.arange(count)))[order]
        return whole, number[back]


def _uniform(key: np.ndarray, draw: int, place: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) from the row key, the draw, the place in the text and a salt."""
    return ((mixed(key + mixed(place.astype(np.uint64) * np.uint64(64) + np.uint64(2 * draw + salt)) * STEP) >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52


def _pick(lattice: Lattice, node: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The edge of each node that holds u, by its probabilities' running sums."""
    e = lattice.first[node]
    live = np.flatnonzero(lattice.upto[e] < u)
    v = u[live]
    while live.size:
        e[live] += 1
        on = lattice.upto[e[live]] < v
        live, v = live[on], v[on]
    return e


REACH = 41.0  # Gumbel values of 53-bit numbers lie between -3.7 and 36.8
AHEAD = 64  # places of a text that are looked at for a bound


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each range, one after the other."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


FEW = 4  # walks that are taken one by one


def _walk(lattice: Lattice, at: np.ndarray, node: np.ndarray, stop: np.ndarray, keys: np.ndarray, places: np.ndarray, draw: int, out: np.ndarray) -> None:
    """Free walks from nodes to their stretches' ends, all at once; out[byte] gets the edge taken there.

    at: the byte of each node in the chains; keys and places: of each byte, the row key and the place in its text.
    """
    live = node < stop
    while (left := int(live.sum())) > FEW:
        if left < len(at):
            at, node, stop = at[live], node[live], stop[live]
        e = _pick(lattice, node, _uniform(keys[at], draw, places[at], 0))
        out[at] = e
        to = lattice.to[e]
        at, node = at + to - node, to
        live = node < stop
    for i, k, last in zip(at[live].tolist(), node[live].tolist(), stop[live].tolist(), strict=True):
        while k < last:  # a block of nodes at a time as lists, then one step after the other
            b = min(k + 4096, last)
            lo, hi = int(lattice.first[k]), int(lattice.first[b])
            u = _uniform(keys[i : i + b - k], draw, places[i : i + b - k], 0).tolist()
            first, upto, to = (lattice.first[k : b + 1] - lo).tolist(), lattice.upto[lo:hi].tolist(), lattice.to[lo:hi].tolist()
            j = k
            while j < b:
                e, x = first[j - k], u[j - k]
                while upto[e] < x:
                    e += 1
                out[i + j - k] = lo + e
                j = to[e]
            i, k = i + j - k, j


def sample(vocabulary: Vocabulary, column: pa.Array, keys: np.ndarray, k: int, seed: int, known: Known | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """For each draw 0..k-1: texts that have one, and their log probability, perturbed value, path starts, ids' starts, ids;
    then one last item, the perturbed value at the head of each text's queue (-inf: nothing is left)."""
    known = known or Known()
    data, starts = joined(column)
    n = len(starts) - 1
    # chain: a space, then the text; a lone feed closes each text and is not part of it
    raw = np.frombuffer(data, np.uint8)
    size = np.diff(starts) - 1
    chain = np.where(size > 0, size + 1, 0)
    at = np.concatenate(([0], np.cumsum(chain)))
    flat = np.full(int(at[-1]), SPACE, np.uint8)
    inside = np.ones(len(raw), bool)
    inside[starts[1:] - 1] = False
    body = np.ones(int(at[-1]), bool)
    body[at[:-1][chain > 0]] = False
    flat[body] = raw[inside]
    # a stretch begins with a text, with a run of spaces, and at and after a line feed
    cut = np.zeros(len(flat), bool)
    cut[at[:-1][chain > 0]] = True
    space, feed = flat == SPACE, flat == FEED
    cut[1:] |= (space[1:] & ~space[:-1]) | feed[1:] | feed[:-1]
    begin = np.flatnonzero(cut)
    end = np.append(begin[1:], len(flat))
    lattice, back = known.lattice(vocabulary, flat, begin, end)
    key = mixed(keys + np.array([seed], np.uint64) * STEP)
    text_of = np.repeat(np.arange(n), chain)  # of each byte of the chains
    keys_of, places = key[text_of], np.arange(len(flat)) - at[text_of]
    stretch_of = np.cumsum(cut) - 1
    starts_at, ends_at = lattice.start[back], lattice.end[back]
    stretches = np.searchsorted(begin, at)  # the first of each text, and the count of all

    def rest(texts: np.ndarray, after: np.ndarray, draw: int, out: np.ndarray) -> None:
        """Free walks through the stretches from number `after` on, of each of these texts."""
        count = stretches[texts + 1] - after
        x = np.repeat(after - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        _walk(lattice, begin[x], starts_at[x], ends_at[x], keys_of, places, draw, out)

    edge_at = np.full(len(flat), -1)
    rest(np.arange(n), stretches[:-1], 0, edge_at)
    value = -np.log(-np.log(_uniform(key, 31, np.zeros(n), 1)))  # of each text's best segmentation
    live = np.arange(n)
    floor, floor_mask = at[:-1] - 1, np.zeros(n, np.int64)  # of the current sets: where the beginning ends
    queue = {f: np.zeros(0, t) for f, t in (("text", int), ("value", float), ("draw", int), ("byte", int), ("mask", np.int64))}
    stored = []
    for draw in range(k):
        taken = np.flatnonzero(edge_at >= 0)
        edge = edge_at[taken]
        bounds = np.searchsorted(taken, at)
        run = np.concatenate(([0.0], np.cumsum(lattice.logp[edge])))
        total = run[bounds[1:]] - run[bounds[:-1]]
        yield (live, total[live], value[live], *_ids(vocabulary, lattice, edge, bounds))
        stored.append(edge_at)
        # split the set just emitted: one set for each place, from its beginning's end on, where the others leave its path
        mine = live[floor[live] >= at[live]]  # texts whose set excludes edges already where its beginning ends
        step = np.searchsorted(taken, floor[mine])
        node = lattice.src[edge[step]]
        mask = floor_mask[mine] | np.left_shift(1, edge[step] - lattice.first[node])
        other = _others(lattice, node, mask)
        step_left = np.where(np.bitwise_count(mask) < lattice.first[node + 1] - lattice.first[node], np.log(np.maximum(other, 1e-300)), -np.inf)
        since = bounds[:-1].copy()
        since[mine] = step
        special = np.full(n, -1)  # of each text, the row of step, mask and step_left
        special[mine] = np.arange(len(mine))
        some = live[since[live] < bounds[live + 1]]

        def left_of(texts: np.ndarray, x: np.ndarray) -> np.ndarray:
            """The log probability of leaving the path at places x."""
            out = lattice.log_left[edge[x]]
            if len(step):
                own = np.flatnonzero((special[texts] >= 0) & (x == since[texts]))
                out[own] = step_left[special[texts[own]]]
            return run[x] - run[bounds[texts]] + out

        # later draws and the threshold need k - draw sets of each text: no noise lifts a set over one REACH above it
        ahead = np.minimum(bounds[some + 1] - since[some], AHEAD)
        texts, x = np.repeat(some, ahead), _ranges(since[some], ahead)
        table = np.full((len(some), AHEAD), -np.inf)
        table[np.repeat(np.arange(len(some)), ahead), _ranges(np.zeros(len(some), np.int64), ahead)] = left_of(texts, x)
        least = -np.partition(-table, k - draw - 1, axis=1)[:, k - draw - 1] if k - draw <= AHEAD else np.full(len(some), -np.inf)
        ends = np.where(least > -np.inf, np.searchsorted(-run, REACH - least - run[bounds[some]], "right"), bounds[some + 1])
        count = np.maximum(np.minimum(ends, bounds[some + 1]) - since[some], 1)
        t, x = np.repeat(some, count), _ranges(since[some], count)
        mu = left_of(t, x)
        noise = -np.log(_uniform(keys_of[taken[x]], draw, places[taken[x]], 1))
        new = mu - np.log(np.exp(np.minimum(mu - value[t], 700.0)) + noise)
        found = []
        cuts = np.cumsum(count) - count
        for _ in range(k - draw if len(some) else 0):
            best = np.maximum.reduceat(new, cuts)
            hit = np.flatnonzero(new == np.repeat(best, count))
            hit = hit[(new[hit] > -np.inf) & (np.diff(t[hit], prepend=-1) != 0)]
            found.append((hit, new[hit].copy()))
            new[hit] = -np.inf
        hit, values = (np.concatenate(y) for y in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0))
        t, x = (t[hit], x[hit]) if len(some) else (np.zeros(0, int), np.zeros(0, int))
        own = np.left_shift(1, edge[x] - lattice.first[lattice.src[edge[x]]])
        if len(step):
            again = np.flatnonzero((special[t] >= 0) & (x == since[t]))
            own[again] = mask[special[t[again]]]
        fresh = {"text": t, "value": values, "draw": np.full(len(hit), draw), "byte": taken[x], "mask": own}
        queue = {f: np.concatenate((queue[f], x)) for f, x in fresh.items()}
        order = np.lexsort((-queue["value"], queue["text"]))
        queue = {f: x[order] for f, x in queue.items()}
        is_head = np.diff(queue["text"], prepend=-1) != 0
        heads = {f: x[is_head] for f, x in queue.items()}
        queue = {f: x[~is_head] for f, x in queue.items()}
        live, value = heads["text"], np.full(n, -np.inf)
        value[live] = heads["value"]
        if draw == k - 1:
            break
        # the heads' segmentations: their beginning, another edge at its end, then free walks
        edge_at = np.full(len(flat), -1)
        for old, path in enumerate(stored):
            mine = heads["draw"] == old
            texts, byte, mask = heads["text"][mine], heads["byte"][mine], heads["mask"][mine]
            count = byte - at[texts]
            copy = np.repeat(at[texts] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            edge_at[copy] = path[copy]
            node = lattice.src[path[byte]]
            e = _pick_other(lattice, node, mask, _uniform(keys_of[byte], draw + 1, places[byte], 0) * _others(lattice, node, mask))
            edge_at[byte] = e
            to, x = lattice.to[e], stretch_of[byte]
            _walk(lattice, byte + to - node, to, ends_at[x], keys_of, places, draw + 1, edge_at)
            rest(texts, x + 1, draw + 1, edge_at)
        floor = at[:-1] - 1
        floor_mask = np.zeros(n, np.int64)
        floor[live], floor_mask[live] = heads["byte"], heads["mask"]
    yield (value,)


def _others(lattice: Lattice, node: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The summed probabilities of each node's edges that are not in its mask."""
    fan, out = lattice.first[node + 1] - lattice.first[node], np.zeros(len(node))
    for j in range(int(fan.max(initial=0))):
        live = np.flatnonzero((fan > j) & ((mask >> j) & 1 == 0))
        out[live] += np.exp(lattice.logp[lattice.first[node[live]] + j])
    return out


def _pick_other(lattice: Lattice, node: np.ndarray, mask: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The edge of each node, among those not in its mask, that holds u, by their probabilities' running sums."""
    fan, out = lattice.first[node + 1] - lattice.first[node], np.full(len(node), -1)
    u = u.copy()
    for j in range(int(fan.max(initial=0))):
        live = np.flatnonzero((fan > j) & ((mask >> j) & 1 == 0) & ((u >= 0) | (out < 0)))
        out[live] = lattice.first[node[live]] + j
        u[live] -= np.exp(lattice.logp[out[live]])
    return out


def _ids(vocabulary: Vocabulary, lattice: Lattice, edge: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's ids begin (and the last end), and the ids; a character without a piece gives its byte pieces."""
    piece = lattice.piece[edge]
    bare = np.flatnonzero(piece < 0)
    src = lattice.src[edge[bare]]
    many = lattice.to[edge[bare]] - src
    size = np.ones(len(edge), np.int64)
    size[bare] = many
    at = np.concatenate(([0], np.cumsum(size)))
    ids = np.empty(int(at[-1]), np.int64)
    ids[at[:-1]] = vocabulary.ids[piece]
    inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    ids[np.repeat(at[:-1][bare], many) + inner] = vocabulary.byte_ids[lattice.raw[np.repeat(src, many) + inner]]
    return at[bounds], ids


_LOADED: dict[tuple[str, bool], tuple[Vocabulary, Known]] = {}
ROW = "doc_id long, rank int, n_pieces long, log_prob double, perturbed double, log_inclusion double, ids_crc32 long, round_trip boolean"


def segmentations(df: DataFrame, model: str, k: int = 2, seed: int = 8, by_rank: bool = True, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", most: int = 1 << 20, copy_col: str | None = None) -> DataFrame:
    """Up to k (at most 31) distinct segmentations of every text, best perturbed value first.

    doc_id, rank (from 1), n_pieces, log_prob (of the segmentation among all of the text), perturbed (its Gumbel value),
    log_inclusion (of exceeding the first value not drawn), ids_crc32 (of ids as little-endian unsigned 32-bit integers),
    round_trip (decoding gives the text back); with_ids adds ids. A text with fewer than k segmentations gives all of
    them; a null or empty text gives one without pieces. most: bytes of text that a task works on at a time. Rows with equal id and text get equal draws; a null id has a key
    of its own. copy_col names a column of numbers that tell copies of a row apart: those of 2 and more draw anew, and
    the result has it as `copy`.
    """
    if not 1 <= k <= 31:
        raise ValueError("k must be 1 to 31")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (model, by_rank) not in _LOADED:
            _LOADED[model, by_rank] = load(model, by_rank), Known()
        vocabulary, known = _LOADED[model, by_rank]
        for b in pieces(batches, "text", most):
            doc_ids = b.column(0)
            keys = np.where(doc_ids.is_valid().to_numpy(zero_copy_only=False), mixed(doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)), NULL_KEY)
            if copy_col is not None:
                copies = b.column(2).to_numpy(zero_copy_only=False).astype(np.uint64)
                keys = np.where(copies > 1, mixed(keys + copies * STEP), keys)
            *draws, (threshold,) = list(sample(vocabulary, b.column(1), keys, k, seed, known))
            texts = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            for rank, (live, log_prob, value, at, ids) in enumerate(draws, start=1):
                if not len(live):
                    break
                flat = ids.astype("<u4")
                size, step = vocabulary.piece_size[ids], vocabulary.piece_at[ids]
                ends = np.concatenate(([0], np.cumsum(size)))
                whole = vocabulary.piece_bytes[np.repeat(step - ends[:-1], size) + np.arange(int(ends[-1]))].tobytes()
                cut = ends[at]
                x = log_prob - threshold[live]
                inclusion = np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.clip(x, -30, 50)))))
                columns = [
                    doc_ids.take(pa.array(live)),
                    pa.array(np.full(len(live), rank, np.int32)),
                    pa.array(np.diff(at)[live]),
                    pa.array(log_prob),
                    pa.array(value),
                    pa.array(inclusion),
                    pa.array([zlib.crc32(flat[at[i] : at[i + 1]].tobytes()) for i in live.tolist()], pa.int64()),
                    pa.array([whole[cut[i] : cut[i + 1]][1:] == texts[i] for i in live.tolist()]),
                ]
                names = [c.split()[0] for c in ROW.split(", ")]
                if with_ids:
                    all_ids = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                    columns, names = [*columns, all_ids.take(pa.array(live))], [*names, "ids"]
                if copy_col is not None:
                    columns, names = [*columns, b.column(2).take(pa.array(live))], [*names, "copy"]
                yield pa.record_batch(columns, names=names)

    schema = ROW + (", ids array<int>" if with_ids else "") + (", copy int" if copy_col is not None else "")
    own = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    return df.select(*own, *([F.col(copy_col).cast("int").alias("copy")] if copy_col is not None else [])).mapInArrow(run, schema)
