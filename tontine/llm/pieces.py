"""Sampled SentencePiece segmentations without replacement, by a perturbed best-first search over the lattice.

The lattice of a text has an edge for every vocabulary piece that spells the characters between two positions. Edges are
weighted by a unigram model, so each segmentation has a probability, and backward sums give the mass behind every
position exactly. The search keeps regions of segmentations (a fixed prefix and edges that must not follow it). The
largest Gumbel-perturbed log-probability of a region is a Gumbel variable located at the region's log-mass and cut at its
parent's value; taking the region with the largest value out, sampling its best segmentation forward and splitting the
rest along that path yields the top k of all perturbed segmentations: k distinct samples without replacement.

Each sample comes with the log of its inclusion score, ``log(1 - exp(-exp(log_prob - threshold)))``, where the threshold
is the (k+1)-th largest perturbed value. All random numbers are hashes of (seed, row key, sample, segment, step).

No piece of the vocabulary runs from a visible character into a following space mark, so a text is cut before each run
of space marks; lattices are built once per distinct segment, and all segments of a batch are sampled side by side.

Piece weights: the vocabulary orders pieces by rank; the weight of rank ``r`` is ``1 / (r + 50)``, normalised. Characters
outside of the vocabulary are spelled in bytes, each at twice the last rank.

Defined results
* null and empty texts: one sample without pieces, log-probability 0;
* fewer than k segmentations: all of them, each with inclusion 1 (log 0);
* a null key draws with a key of its own; rows with equal keys and texts get equal samples;
* the space mark itself (U+2581) decodes to a space; every other text decodes to itself;
* repeated rows are answered each; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import functools
import math
import re
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from tontine.llm.arrowtools import mix64, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
SEED = 11
SPACE_MARK = "▁"
RANK_SHIFT = 50.0
MARK = ord(SPACE_MARK)
#: Distinct segments whose lattices a worker remembers from batch to batch.
REMEMBERED = 5 << 16
BATCH_BYTES = 1 << 19
BASE = 0xC2B2AE3D27D4EB4F
#: Leading bits of a piece's hash that find it.
SLOT_BITS = 20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` or more powers of an odd base modulo 2^64 and of its inverse."""
    return some_powers(1 << max(16, (n - 1).bit_length()))


@functools.lru_cache(maxsize=2)
def some_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = np.full(n, np.uint64(BASE), np.uint64), np.full(n, np.uint64(pow(BASE, -1, 1 << 64)), np.uint64)
    base[:1] = inverse[:1] = 1
    return np.multiply.accumulate(base), np.multiply.accumulate(inverse)


def piece_hash(piece: str) -> int:
    """The hash under which ``Lattices`` looks a piece up."""
    total = sum((ord(c) + 1) * pow(BASE, i, 1 << 64) for i, c in enumerate(piece))
    return int(mix64(np.array([(total + len(piece)) % (1 << 64)], np.uint64))[0])


class Vocabulary:
    """Pieces with their ids and log-weights, and the byte pieces."""

    def __init__(self, model: bytes) -> None:
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.processor.get_piece_size()
        ranked, self.bytes = [], {}
        for i in range(size):
            piece = self.processor.id_to_piece(i)
            if self.processor.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (self.processor.is_control(i) or self.processor.is_unknown(i) or self.processor.is_unused(i)):
                ranked.append((-self.processor.get_score(i), piece, i))
        if any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", piece) for _, piece, _ in ranked):
            raise ValueError("a piece runs into a following space mark; texts cannot be cut there")
        total = sum(1.0 / (rank + RANK_SHIFT) for rank, _, _ in ranked)
        texts = [self.processor.id_to_piece(i) for i in range(size)]
        self.pieces = {piece: (i, -math.log(rank + RANK_SHIFT) - math.log(total)) for rank, piece, i in ranked}
        self.byte_weight = -math.log(2.0 * len(ranked) + RANK_SHIFT) - math.log(total)
        self.byte_ids = np.array([self.bytes.get(b, 0) for b in range(128)], np.int64)
        # A byte under 128 is a character by itself; others spell one together.
        self.is_part = np.zeros(size, bool)
        for value, i in self.bytes.items():
            self.is_part[i] = value >= 128
            texts[i] = chr(value)
        self.lengths = np.array([len(x) for x in texts], np.int64)
        self.spelling = np.array([sum((ord(c) + 1) * pow(BASE, i, 1 << 64) for i, c in enumerate(x)) % (1 << 64) for x in texts], np.uint64)
        self.longest = max(len(piece) for piece in self.pieces)


class Lattices:
    """Lattices of segments in flat arrays: edges in node order, each with the running sum of its node's edges.

    The lattices of all new segments of a batch are built together: substrings of one length at a time are looked up by
    their hash, and backward sums go level by level, by distance from a segment's end.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        rows = sorted((piece_hash(piece), i, weight) for piece, (i, weight) in vocabulary.pieces.items())
        self.hashes = np.array([h for h, _, _ in rows], np.uint64)
        self.numbers = np.array([i for _, i, _ in rows], np.int64)
        self.weights = np.array([w for _, _, w in rows])
        # Where the pieces with the same leading bits of their hash begin; the longest run of such pieces.
        leading = (self.hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        self.slots = np.full(1 << SLOT_BITS, -1, np.int32)
        self.slots[leading[::-1]] = np.arange(len(rows) - 1, -1, -1, dtype=np.int32)
        self.run = int(np.bincount(leading).max(initial=1))
        self.hashes = np.append(self.hashes, np.full(self.run, ~self.hashes[-1:].max(initial=0), np.uint64))
        self.clear()

    def look_up(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are those of pieces, and the place of each of these pieces."""
        place = self.slots[(found >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
        maybe = np.flatnonzero(place >= 0)
        at, wanted = place[maybe], found[maybe]
        right = self.hashes[at] == wanted
        for _ in range(1, self.run):
            wrong = np.flatnonzero(~right)
            if not len(wrong):
                break
            at[wrong] += 1
            right[wrong] = self.hashes[at[wrong]] == wanted[wrong]
        return maybe[right], at[right]

    def clear(self) -> None:
        #: First node of a segment, by the segment's hash.
        self.entry: dict[int, int] = {}
        self.nodes = 0
        #: Per edge: running sum within its node, log-probability given the node, next node (-1: the end), piece or -code point.
        self.running, self.log, self.after, self.piece = array("d"), array("d"), array("i"), array("i")
        #: Per node: its first edge.
        self.first = array("i")

    def add(self, names: list[int], segments: list[str]) -> None:
        """Lattices of distinct new segments (none empty) under their hashes."""
        base = self.nodes
        lengths = np.array([len(x) for x in segments], np.int64)
        self.entry.update(zip(names, (base + np.cumsum(lengths) - lengths).tolist(), strict=True))
        text = "".join(segments)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(codes)
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(n)
        power, inverse = powers(n)
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * power[:n])))
        origin, size, number, weight = [], [], [], []
        spelled = np.zeros(n, bool)
        at = np.arange(n)
        for length in range(1, self.vocabulary.longest + 1):
            at = at[left[at] >= length]
            with np.errstate(over="ignore"):
                found = mix64((sums[at + length] - sums[at]) * inverse[at] + np.uint64(length))
            hit, place = self.look_up(found)
            origin.append(at[hit])
            size.append(np.full(len(place), length))
            number.append(self.numbers[place])
            weight.append(self.weights[place])
            if length == 1:
                spelled[at[hit]] = True
                bare = np.flatnonzero(~spelled)  # characters that only bytes spell
                wide = 1 + (codes[bare] >= 0x80).astype(int) + (codes[bare] >= 0x800) + (codes[bare] >= 0x10000)
                origin.append(bare)
                size.append(np.ones(len(bare), np.int64))
                number.append(np.where(wide == 1, self.vocabulary.byte_ids[np.minimum(codes[bare], 127).astype(int)], -codes[bare].astype(np.int64)))
                weight.append(wide * self.vocabulary.byte_weight)
        origin, size, number, weight = (np.concatenate(x) for x in (origin, size, number, weight))
        # Rows come as one ascending run per length, so a stable merge sorts them by node and length.
        order = np.argsort(origin, kind="stable")
        origin, size, number, weight = origin[order], size[order], number[order], weight[order]
        # Backward sums go by distance from the end.
        distance = left[origin]
        turn = np.argsort(distance.astype(np.int16) if distance.max(initial=0) < 1 << 15 else distance, kind="stable")
        level = np.concatenate(([0], np.cumsum(np.bincount(distance)[1:]))) if n else np.zeros(1, np.int64)
        far_origin, far_weight, far_next = origin[turn], weight[turn], (origin + size)[turn]
        far_ends = (distance == size)[turn]
        mass = np.zeros(n + 1)
        for a, b in zip(level[:-1].tolist(), level[1:].tolist(), strict=True):
            if a == b:
                continue
            value = far_weight[a:b] + np.where(far_ends[a:b], 0.0, mass[far_next[a:b]])
            starts = np.flatnonzero(np.diff(far_origin[a:b], prepend=-1))
            top = np.maximum.reduceat(value, starts)
            counts = np.diff(np.append(starts, b - a))
            mass[far_origin[a:b][starts]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, counts)), starts))
        ends = distance == size
        chance = np.minimum(0.0, weight + np.where(ends, 0.0, mass[np.minimum(origin + size, n)]) - mass[origin])
        first = np.concatenate(([0], np.cumsum(np.bincount(origin, minlength=n))))[:-1]
        # Sums of whole multiples of 2^-52 are exact, so a lattice does not depend on those that it is built with.
        total = np.cumsum(np.rint(np.exp(chance) * 2.0**52).astype(np.int64))
        running = (total - np.concatenate(([0], total))[first][origin]) * 2.0**-52
        running[np.append(first[1:], len(origin)) - 1] = 1.0
        self.first.frombytes((first + len(self.running)).astype(np.int32).tobytes())
        self.running.frombytes(running.tobytes())
        self.log.frombytes(chance.tobytes())
        self.after.frombytes(np.where(ends, -1, base + origin + size).astype(np.int32).tobytes())
        self.piece.frombytes(number.astype(np.int32).tobytes())
        self.nodes += n

    def views(self) -> tuple[np.ndarray, ...]:
        kinds = ((self.running, np.float64), (self.log, np.float64), (self.after, np.int32), (self.piece, np.int32), (self.first, np.int32))
        return tuple(np.frombuffer(values, kind) if len(values) else np.empty(0, kind) for values, kind in kinds)


def marked(text: str | None) -> str:
    """A text as the pieces spell it: a mark in front and for every space."""
    return SPACE_MARK + text.replace(" ", SPACE_MARK) if text else ""


def segments_of(texts: list[str | None]):
    """Hashes of the segments of all texts in order, their number per text, and a function from segments to strings.

    A segment is a run of space marks and what follows it up to the next mark; a text begins with a mark. Segments are told
    apart by 64-bit hashes that are computed on the code points of all texts at once.
    """
    whole = "".join(map(marked, texts))
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    ends_of = np.cumsum([len(text) + 1 if text else 0 for text in texts])
    mark = codes == MARK
    begins = mark.copy()
    begins[1:] &= ~mark[:-1]
    heads = np.concatenate(([0], ends_of[:-1])).astype(np.int64)
    begins[heads[heads < n]] = True
    starts = np.flatnonzero(begins)
    stops = np.append(starts[1:], n)
    power, inverse = powers(n)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[:n])))
        names = mix64((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))
    counts = np.diff(np.searchsorted(starts, np.concatenate(([0], ends_of))))

    def cut(at: np.ndarray) -> list[str]:
        return [whole[a:b] for a, b in zip(starts[at].tolist(), stops[at].tolist(), strict=True)]

    return names, counts, cut


def uniform(*parts: np.ndarray | int) -> np.ndarray:
    """Hash of the parts as a number in (0, 1)."""
    value = np.uint64(SEED)
    with np.errstate(over="ignore"):
        for part in parts:
            value = mix64(np.atleast_1d(np.asarray(part).astype(np.uint64) + value * np.uint64(0x9E3779B97F4A7C15)))
    return ((value >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def cut_gumbel(place: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables located at ``place`` given that they lie under ``bound``; -inf where there is no mass."""
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        out = place - np.log(np.exp(np.minimum(place - bound, 700.0)) - np.log(u))
        out = np.where(place - bound > 700.0, bound, out)
    return np.where(np.isneginf(place), -np.inf, np.minimum(out, bound))


class Path:
    """One sample of every text of a batch: token arrays, and the values of the regions that branch off its tokens."""

    def __init__(self, edge: np.ndarray, segment: np.ndarray, at: np.ndarray, value: np.ndarray, log: np.ndarray) -> None:
        self.edge, self.segment, self.at, self.value = edge, segment, at, value
        self.own = log[edge] if len(edge) else np.empty(0)
        # Sums of a text start at that text, so they do not depend on its batch.
        self.before, self.total = np.zeros(len(edge)), np.zeros(len(at) - 1)
        for r, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            if b > a:
                sums = np.cumsum(self.own[a:b])
                self.before[a + 1 : b] = sums[:-1]
                self.total[r] = sums[-1]
        self.region = np.full(len(edge), -np.inf)


class Sampler:
    """Draws samples for batches of texts."""

    def __init__(self, model: bytes, samples: int = SAMPLES, remembered: int = REMEMBERED) -> None:
        self.vocabulary, self.samples, self.remembered = Vocabulary(model), samples, remembered
        self.lattices = Lattices(self.vocabulary)

    def walk(self, nodes: np.ndarray, keys: np.ndarray, segment: np.ndarray, sample: int, views) -> tuple[np.ndarray, np.ndarray]:
        """Edges of a random path from each node to its lattice's end, and the walk each belongs to, in order."""
        running, _, after, _, first = views
        last = np.append(first[1:], len(running)) - 1
        walkers, edges = [], []
        active, step = np.arange(len(nodes)), 0
        while len(active):
            u = uniform(keys[active], sample, segment[active], step)
            # The last, longest edge of a node is the likeliest; from there down to the one that u falls on.
            aim = u
            edge, low = last[nodes[active]], first[nodes[active]]
            moving = np.flatnonzero(edge > low)
            while len(moving := moving[running[edge[moving] - 1] >= aim[moving]]):
                edge[moving] -= 1
                moving = moving[edge[moving] > low[moving]]
            walkers.append(active)
            edges.append(edge)
            onward = after[edge]
            going = onward >= 0
            nodes = nodes.copy() if step == 0 else nodes
            nodes[active] = onward
            active, step = active[going], step + 1
        if not walkers:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        walker, edge = np.concatenate(walkers), np.concatenate(edges)
        order = np.argsort(walker, kind="stable")
        return edge[order], walker[order]

    def branch(self, path: Path, fresh: np.ndarray, keys: np.ndarray, sample: int) -> None:
        """Values of the regions that leave ``path`` at its fresh tokens."""
        row = np.repeat(np.arange(len(path.at) - 1), np.diff(path.at))[fresh]
        with np.errstate(divide="ignore"):
            place = path.before[fresh] + np.log(np.maximum(0.0, -np.expm1(path.own[fresh])))
        place[path.own[fresh] > -1e-14] = -np.inf
        token = np.flatnonzero(fresh) - path.at[row] if fresh.dtype == bool else fresh - path.at[row]
        u = uniform(keys[row], 1000 + sample, token, 0)
        path.region[fresh] = cut_gumbel(place, path.value[row], u)

    def draw(self, texts: list[str | None], keys: np.ndarray) -> list[tuple[list[Path], np.ndarray, list[list[int]]]]:
        lattices = self.lattices
        if len(lattices.entry) > self.remembered:
            lattices.clear()
        names, counts, cut = segments_of(texts)
        known, seen, which = np.unique(names, return_index=True, return_inverse=True)
        found = np.fromiter(map(lattices.entry.get, known.tolist(), repeat(-1)), np.int64, len(known))
        unknown = np.flatnonzero(found < 0)
        if len(unknown):
            lattices.add(known[unknown].tolist(), cut(seen[unknown]))
            found[unknown] = [lattices.entry[x] for x in known[unknown].tolist()]
        nodes = found[which]
        seg_at = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
        views = lattices.views()
        running, log, after, _, first = views
        row_of = np.repeat(np.arange(len(texts)), counts)
        number = np.arange(len(nodes)) - seg_at[row_of] if len(nodes) else nodes
        edge, walker = self.walk(nodes, keys[row_of], number, 0, views)
        at = np.searchsorted(row_of[walker], np.arange(len(texts) + 1))
        top = -np.log(-np.log(uniform(keys, 2000, 0, 0)))
        paths = [Path(edge, walker, at, top, log)]
        self.branch(paths[0], np.ones(len(edge), bool), keys, 0)
        alive = [np.ones(len(texts), bool)]
        banned: dict[tuple[int, int, int], list[int]] = {}

        def node_edges(edge: int) -> tuple[int, int]:
            node = int(np.searchsorted(first, np.int32(edge), side="right")) - 1  # same type: no copy
            return int(first[node]), int(first[node + 1]) if node + 1 < len(first) else len(running)

        for sample in range(1, self.samples):
            starts, start_keys, start_segment, prefix = [], [], [], [None] * len(texts)
            value = np.full(len(texts), -np.inf)
            best = []
            for r in range(len(texts)):
                top = (-np.inf, -1, -1)
                for p, path in enumerate(paths):
                    a, b = path.at[r], path.at[r + 1]
                    if b > a:
                        t = int(np.argmax(path.region[a:b]))
                        top = max(top, (float(path.region[a + t]), p, t))
                if top[0] > -np.inf:
                    value[r] = top[0]
                    best.append((r, *top[1:]))
            rows, steps = np.array([b[0] for b in best], np.int64), np.array([b[2] for b in best], np.int64)
            aim, places = uniform(keys[rows], 3000 + sample, steps, 0), []
            for (r, p, t), u in zip(best, aim.tolist(), strict=True):
                path, i = paths[p], int(paths[p].at[r]) + t
                out = banned.setdefault((r, p, t), [int(path.edge[i])])
                low, high = node_edges(out[0])
                free = [e for e in range(low, high) if e not in out]
                sums = np.cumsum(np.exp(log[free]))
                chosen = free[min(int(np.searchsorted(sums, u * sums[-1])), len(free) - 1)]
                out.append(chosen)
                left = float(np.exp(log[[e for e in free if e != chosen]]).sum()) if len(free) > 1 else 0.0
                places.append(path.before[i] + math.log(left) if left > 0 else -np.inf)
                prefix[r] = (p, t, chosen)
                segment = int(path.segment[i])
                if after[chosen] >= 0:
                    starts.append(np.array([after[chosen]]))
                    start_segment.append(np.array([segment]))
                    start_keys.append(keys[r : r + 1])
                rest = np.arange(segment + 1, seg_at[r + 1])
                starts.append(nodes[rest])
                start_segment.append(rest)
                start_keys.append(np.full(len(rest), keys[r]))
            remaining = cut_gumbel(np.array(places), value[rows], uniform(keys[rows], 4000 + sample, steps, 0))
            for (r, p, t), region in zip(best, remaining.tolist(), strict=True):
                paths[p].region[int(paths[p].at[r]) + t] = region
            pick = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
            seg = pick(start_segment, np.int64)
            own = seg - seg_at[row_of[seg]] if len(seg) else seg  # the draws of a row must not depend on its batch
            edge, walker = self.walk(pick(starts, np.int64), pick(start_keys, np.uint64), own, sample, views)
            fresh_segment = seg[walker] if len(walker) else walker
            fresh_at = np.searchsorted(row_of[fresh_segment], np.arange(len(texts) + 1)) if len(nodes) else np.zeros(len(texts) + 1, np.int64)
            edges, segments, lengths, fresh = [], [], [], []
            for r, start in enumerate(prefix):
                if start is None:
                    lengths.append(0)
                    continue
                p, t, chosen = start
                a, i = int(paths[p].at[r]), int(paths[p].at[r]) + t
                tail = slice(fresh_at[r], fresh_at[r + 1])
                edges += [paths[p].edge[a:i], [chosen], edge[tail]]
                segments += [paths[p].segment[a:i], [paths[p].segment[i]], fresh_segment[tail]]
                fresh += [np.zeros(t + 1, bool), np.ones(tail.stop - tail.start, bool)]
                lengths.append(t + 1 + tail.stop - tail.start)
            at = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
            path = Path(pick(edges, np.int64), pick(segments, np.int64), at, value, log)
            if len(path.edge):
                self.branch(path, np.concatenate(fresh), keys, sample)
            paths.append(path)
            alive.append(value > -np.inf)
        threshold = np.full(len(texts), -np.inf)
        for path in paths:
            full = np.flatnonzero(np.diff(path.at))
            if len(full):
                threshold[full] = np.maximum(threshold[full], np.maximum.reduceat(path.region, path.at[full]))
        return paths, alive, threshold

    def spell(self, pieces: list[np.ndarray], texts: list[str | None]) -> np.ndarray:
        """Whether the pieces of each sample spell its text: by length and 64-bit hash of the code points.

        A piece adds its own hash at its place in the text. Where characters are spelt by several byte pieces, the model's own
        decoder is asked.
        """
        v = self.vocabulary
        counts = np.array([len(p) for p in pieces], np.int64)
        ids = np.concatenate([*pieces, np.empty(0, np.int32)]).astype(np.int64)
        lengths = v.lengths[ids]
        upto = np.cumsum(lengths)
        first = np.cumsum(counts) - counts
        spelt = np.diff(np.concatenate(([0], upto))[np.append(first, len(ids))])
        place = upto - lengths - np.repeat(np.concatenate(([0], upto))[first], counts)
        power, _ = powers(max(2, int(spelt.max(initial=0)), *(len(t or "") + 1 for t in texts)) if texts else 2)
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(v.spelling[ids] * power[place])))
            found = sums[first + counts] - sums[first]
        parts = np.concatenate(([0], np.cumsum(v.is_part[ids])))
        asked = parts[first + counts] > parts[first]
        out = np.empty(len(pieces), bool)
        last, name = None, (0, 0)
        for i, text in enumerate(texts):
            if asked[i]:
                out[i] = v.processor.decode(pieces[i].tolist()) == (text or "").replace(SPACE_MARK, " ")
                continue
            if text is not last or last is None:
                codes = np.frombuffer(marked(text).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
                with np.errstate(over="ignore"):
                    last, name = text, (len(codes), int(((codes + np.uint64(1)) * power[: len(codes)]).sum()))
            out[i] = (int(spelt[i]), int(found[i])) == name
        return out

    def ids(self, path: Path, r: int) -> np.ndarray:
        """Piece ids of one text's sample."""
        piece = np.frombuffer(self.lattices.piece, np.int32)[path.edge[path.at[r] : path.at[r + 1]]]
        if not (piece < 0).any():
            return piece
        out: list[int] = []
        for value in piece.tolist():
            out.extend([value] if value >= 0 else [self.vocabulary.bytes[b] for b in chr(-value).encode("utf-8", "surrogatepass")])
        return np.array(out, np.int32)


@functools.lru_cache(maxsize=1)
def worker_sampler(model: bytes, samples: int, remembered: int) -> Sampler:
    """One sampler per worker process, so that the tasks it runs share vocabulary and lattices."""
    return Sampler(model, samples, remembered)


def log_inclusion(log_prob: float, threshold: float) -> float:
    """``log(1 - exp(-exp(log_prob - threshold)))`` without under- or overflow."""
    x = log_prob - threshold
    if threshold == -math.inf or x > 5:
        return 0.0 if threshold == -math.inf else math.log1p(-math.exp(-math.exp(min(x, 7.0))))
    return x if x < -30 else math.log(-math.expm1(-math.exp(x)))


ENCODED = "doc_id long, sample int, pieces array<int>, n_pieces int, log_prob double, perturbed double, log_inclusion double, decodes boolean"


def encode(
    documents: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, samples: int = SAMPLES,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """``samples`` distinct segmentations of every row, best perturbed value first; ``decodes``: the pieces give the text.

    ``remembered`` bounds the lattices that a worker keeps (about 0.7 KB each); it trades memory for time only.
    """
    if samples < 1:
        raise ValueError(f"at least one sample is needed, not {samples}")
    with open(model, "rb") as file:  # half a megabyte; the workers get it from here
        shared = documents.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = worker_sampler(shared.value, samples, remembered)
        for batch in slices(batches, 1, BATCH_BYTES):
            texts, ids = batch.column(1).to_pylist(), batch.column(0)
            keys = mix64(ids.fill_null(-(1 << 62) - 1).to_numpy().view(np.uint64) + np.uint64(1))
            paths, alive, threshold = sampler.draw(texts, keys)
            rows = [(r, s) for r in range(len(texts)) for s in range(len(paths)) if alive[s][r]]
            pieces = [sampler.ids(paths[s], r) for r, s in rows]
            decodes = sampler.spell(pieces, [texts[r] for r, _ in rows])
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in pieces]))).astype(np.int32)
            logs = [float(paths[s].total[r]) for r, s in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array([r for r, _ in rows], pa.int64())),
                    pa.array([s + 1 for _, s in rows], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*pieces, np.empty(0, np.int32)]))),
                    pa.array([len(p) for p in pieces], pa.int32()),
                    pa.array(logs, pa.float64()),
                    pa.array([float(paths[s].value[r]) for r, s in rows], pa.float64()),
                    pa.array([log_inclusion(x, float(threshold[r])) for x, (r, _) in zip(logs, rows, strict=True)], pa.float64()),
                    pa.array(decodes, pa.bool_()),
                ],
                names=[c.split()[0] for c in ENCODED.split(", ")],
            )

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, pieces: str = "pieces", model: str = MODEL) -> DataFrame:
    """``text`` beside the columns of ``encoded``; null pieces decode to null."""
    with open(model, "rb") as file:
        shared = encoded.sparkSession.sparkContext.broadcast(file.read())

    @F.pandas_udf("string")
    def spelled(column):
        import pandas as pd

        processor = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        rows = [None if ids is None else [int(i) for i in ids] for ids in column]
        found = iter(processor.decode([ids for ids in rows if ids is not None]) if any(r is not None for r in rows) else [])
        return pd.Series([None if ids is None else next(found) for ids in rows], dtype=object)

    return encoded.withColumn("text", spelled(F.col(pieces)))
