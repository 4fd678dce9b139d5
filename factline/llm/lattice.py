"""Sampling SentencePiece segmentations without replacement, by perturbed A* over the lattice."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.llm import words as w
from factline.llm.tables import bound_batches, id_number

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_U = np.uint64
_GOLD, _ODD = _U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95)
_FALLBACK = -1
_SPACE, _BREAK = 0x20, 0x0A


def _uniform(keys: np.ndarray, draw: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the keys and the number of the draw only."""
    with np.errstate(over="ignore"):
        return ((w._mixed(keys + _U(draw + 1) * _GOLD) >> _U(11)).astype(float) + 0.5) * 2.0**-53


@dataclass
class Pieces:
    """A model's pieces as byte strings (a space for the white-space mark), byte pieces and a prior.

    The model's scores are merge ranks, not log-probabilities; pieces get Zipf's law over the
    rank instead: log p = -slope log(rank + shift), normalised, times the smoothing alpha (at 1
    the shortest segmentation all but always wins). Pieces without a rank are
    decoded but never sampled.
    """

    data: np.ndarray  # bytes of all pieces, end to end
    offsets: np.ndarray
    logp: np.ndarray
    usable: np.ndarray
    byte0: int  # id of the piece for byte 0; the others follow

    @classmethod
    def load(cls, path: str = MODEL, slope: float = 1.0, shift: float = 10.0, alpha: float = 0.3) -> Pieces:
        import sentencepiece

        with open(path, "rb") as f:
            model = sentencepiece.SentencePieceProcessor(model_proto=f.read())
        size = model.get_piece_size()
        byte = [model.is_byte(i) for i in range(size)]
        text = [b"" if model.is_control(i) or model.is_unknown(i) else bytes([int(model.id_to_piece(i)[1:-1], 16)]) if byte[i] else model.id_to_piece(i).replace("▁", " ").encode() for i in range(size)]
        score = np.array([model.get_score(i) for i in range(size)])
        usable = np.array([bool(t) and not b and s > -1e8 for t, b, s in zip(text, byte, score, strict=True)])
        rank = np.where(usable, -score, -score[usable].min())
        logp = -slope * np.log(rank + shift)
        logp = alpha * (logp - np.log(np.exp(logp[usable | np.array(byte)]).sum()))
        return cls(np.frombuffer(b"".join(text), np.uint8), np.cumsum([0, *map(len, text)]), logp, usable, byte.index(True))

    def __post_init__(self):
        for i in np.flatnonzero(self.usable):
            t = self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()
            if b"\n" in t or b" " in t.lstrip(b" "):
                raise ValueError("a piece spans a line break or an inner space: texts would not fall into units")
        self.sizes = np.diff(self.offsets).astype(np.int32)
        self._trie()

    def _trie(self) -> None:
        """Tables of the nodes after one and two bytes, an open-addressed one from (node, byte) to node, and the piece that ends at each node."""
        step: dict[tuple[int, int], int] = {}
        piece = [_FALLBACK]
        for i in np.flatnonzero(self.usable).tolist():
            node = 0
            for b in self.data[self.offsets[i] : self.offsets[i + 1]].tolist():
                node = step.setdefault((node, b), len(step) + 1)
                if node == len(piece):
                    piece.append(_FALLBACK)
            piece[node] = i
        if len(piece) >= 1 << 23:
            raise ValueError("a trie of 2^23 nodes or more does not fit its keys")
        self.piece_at = np.array([*piece, _FALLBACK], np.int32)
        self.inner = np.zeros(len(piece) + 1, bool)  # nodes that lead on; the last entry stands for no node
        self.inner[[a for a, _ in step]] = True
        self.one, self.two = np.full(256, -1, np.int32), np.full(1 << 16, -1, np.int32)
        top = {n: b for (a, b), n in step.items() if a == 0}
        for n, b in top.items():
            self.one[b] = n
        for (a, b), n in step.items():
            if a in top:
                self.two[top[a] << 8 | b] = n
        self.bits = max(10, (4 * len(step)).bit_length())
        self.keys, self.to = np.full(1 << self.bits, -1, np.int32), np.zeros(1 << self.bits, np.int32)
        left = np.array([[a << 8 | b, n] for (a, b), n in step.items()], np.int32).reshape(-1, 2)
        probe = 0
        while len(left):
            slot = self._slot(left[:, 0], probe)
            free = np.flatnonzero(self.keys[slot] == -1)
            first = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[first]], self.to[slot[first]] = left[first, 0], left[first, 1]
            left = np.delete(left, first, 0)
            probe += 1
        self.probes = probe

    def _slot(self, key: np.ndarray, probe: int) -> np.ndarray:
        h = (key.view(np.uint32) if key.flags.c_contiguous else key.astype(np.uint32)) * np.uint32(0x9E3779B1)
        return ((h >> np.uint32(32 - self.bits)) + np.uint32(probe)) & np.uint32((1 << self.bits) - 1)

    def follow(self, nodes: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The node after one byte more, or -1."""
        key = nodes << np.int32(8) | data
        slot = self._slot(key, 0)
        at = self.keys[slot]
        out = np.where(at == key, self.to[slot], np.int32(-1))
        left = np.flatnonzero((at != key) & (at != -1))
        for probe in range(1, self.probes):
            if not len(left):
                break
            slot = self._slot(key[left], probe)
            at = self.keys[slot]
            hit = at == key[left]
            out[left[hit]] = self.to[slot[hit]]
            left = left[~hit & (at != -1)]
        return out


def decode(pieces: Pieces, ids: np.ndarray) -> bytes:
    """The text of a sequence of ids: their bytes end to end, without the leading space."""
    return _bytes(pieces, ids)[0][1:].tobytes()


def _bytes(pieces: Pieces, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = pieces.sizes[ids]
    ends = np.cumsum(size, dtype=np.int64)
    at = np.repeat((pieces.offsets[ids] - (ends - size)).astype(np.int32), size) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)
    return pieces.data[at], ends


class Lattice:
    """The lattices of distinct units, over the bytes of the units laid end to end.

    An edge is a piece (or a bare character) at a byte. Edges lie together by start: first[s] to
    first[s] + count[s]; starts are ordered by their distance from their unit's end, so that
    backward sums run over slices. q is an edge's share of its start's paths, and cum the running
    sum of q within the start, which depends on nothing outside the unit.
    """

    LONG = 256  # bytes; in longer units sums are taken of logarithms

    def __init__(self, pieces: Pieces, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        head = (data & 0xC0) != 0x80
        head[offsets[:-1]] = True
        node_ok = np.r_[head, True]
        chars = np.flatnonzero(head).astype(np.int32)
        stop = np.repeat(offsets[1:], np.diff(offsets)).astype(np.int32)  # end of each byte's unit
        left = stop[chars] - chars
        order = np.argsort(left.astype(np.uint16) if len(left) and left.max() < 1 << 16 else left, kind="stable")
        chars, left = chars[order], left[order]
        after = np.flatnonzero(node_ok).astype(np.int32)
        char_end = np.empty(n, np.int32)
        char_end[after[:-1]] = after[1:]
        count = np.zeros(n, np.int32)
        found, at, node, depth = [], chars, np.zeros(len(chars), np.int32), 0
        whole = np.zeros(n, bool)  # chars that are a piece themselves
        room = left
        while len(at):
            node = pieces.one[data[at]] if depth == 0 else pieces.two[data[at].astype(np.int32) << 8 | data[at + 1]] if depth == 1 else pieces.follow(node, data[at + depth])
            depth += 1
            piece = pieces.piece_at[node]  # the last one, for no node, is no piece
            end = at + np.int32(depth)
            hit = np.flatnonzero((piece >= 0) & node_ok[end])
            s, e = at[hit], end[hit]
            k = count[s]
            found.append((s, k, e, piece[hit]))
            count[s] = k + 1
            if depth <= 4:
                whole[s[char_end[s] == e]] = True
            on = np.flatnonzero((room > depth) & pieces.inner[node])
            at, node, room = at[on], node[on], room[on]
        bare = chars[~whole[chars]]
        found.append((bare, count[bare], char_end[bare], np.full(len(bare), _FALLBACK, np.int32)))
        count[bare] += 1
        degree = count[chars]
        to = np.cumsum(degree)
        self.first, self.count = np.zeros(n, np.int32), count
        self.first[chars] = to - degree
        total = int(to[-1]) if len(to) else 0
        self.start, self.end, self.piece = (np.empty(total, np.int32) for _ in range(3))
        for s, k, e, p in found:
            place = self.first[s] + k
            self.start[place], self.end[place], self.piece[place] = s, e, p
        self.data = data
        lp = np.where(self.piece == _FALLBACK, (self.end - self.start) * pieces.logp[pieces.byte0], pieces.logp[self.piece])
        # the end of one unit is the start of the next: paths that end there lead to a node of their own
        self.last = self.end == stop[self.start]
        target = np.where(self.last, n, self.end)
        wide = int(left[-1]) if len(left) else 0
        cuts = np.searchsorted(left, np.arange(1, wide + 2))
        plain = int(np.searchsorted(left, self.LONG, "right"))
        share, beta = np.exp(lp), np.ones(n + 1)
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if lo == hi or lo >= plain:
                continue
            a, b = int(to[lo] - degree[lo]), int(to[hi - 1])
            v = share[a:b]
            v *= beta[target[a:b]]
            firsts = to[lo:hi] - degree[lo:hi] - a
            sums = np.add.reduceat(v, firsts)
            beta[chars[lo:hi]] = sums
            v /= np.repeat(sums, degree[lo:hi])
        if plain < len(chars):
            beta = np.log(beta)
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if lo == hi or lo < plain:
                    continue
                a, b = int(to[lo] - degree[lo]), int(to[hi - 1])
                v = lp[a:b] + beta[target[a:b]]
                firsts = to[lo:hi] - degree[lo:hi] - a
                top = np.maximum.reduceat(v, firsts)
                sums = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, degree[lo:hi])), firsts))
                beta[chars[lo:hi]] = sums
                share[a:b] = np.exp(v - np.repeat(sums, degree[lo:hi]))
        self.q, self.cum = share, share.copy()
        at = self.first[chars]
        for k in range(1, int(degree.max()) if len(degree) else 0):
            more = np.flatnonzero(degree > k)
            at, degree = at[more], degree[more]
            self.cum[at + k] += self.cum[at + (k - 1)]

    def pick(self, at: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge from each byte position, by its share."""
        lo = self.first[at]
        out = lo + self.count[at] - np.int32(1)
        goal = u * self.cum[out]
        # the longest piece is the likeliest, so few are left after a step or two
        left = np.flatnonzero(out > lo)
        while len(left):
            e = out[left] - np.int32(1)
            left, e = left[(down := self.cum[e] >= goal[left])], e[down]
            out[left] = e
            left = left[e > lo[left]]
        return out

    def paths(self, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled paths from each position to its unit's end: edges, and where each path's begin."""
        live, rounds = np.arange(len(at)), []
        length = np.zeros(len(at), np.int64)
        while len(live):
            e = self.pick(at, _uniform(keys, len(rounds)))
            rounds.append((live, e))
            length[live] += 1
            on = np.flatnonzero(~self.last[e])
            live, at, keys = live[on], self.end[e[on]], keys[on]
        firsts = np.r_[0, np.cumsum(length)]
        out = np.empty(firsts[-1], np.int32)
        for k, (of, e) in enumerate(rounds):
            out[firsts[of] + k] = e
        return out, firsts

    def ids(self, pieces: Pieces, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of edges, with a fallback as the pieces of its bytes; and each edge's number of ids."""
        piece = self.piece[edges]
        bare = piece == _FALLBACK
        if not bare.any():
            return piece, np.ones(len(piece), np.int64)
        size = np.where(bare, self.end[edges] - self.start[edges], 1)
        ids = np.repeat(piece, size)
        where = np.repeat(bare, size)
        step = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
        ids[where] = pieces.byte0 + self.data[(np.repeat(self.start[edges], size) + step)[where]]
        return ids, size


def _units(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the units: at texts' starts, at line breaks and after them, and where spaces begin."""
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = (data[1:] == _SPACE) & (data[:-1] != _SPACE)
    breaks = data == _BREAK
    cut[:-1] |= breaks
    cut[1:] |= breaks
    cut[offsets] = True
    return np.flatnonzero(cut[:-1])


def _truncated(g: float, top: float) -> float:
    """A Gumbel variable g, given that the maximum of its kind is top: -log(exp(-top) + exp(-g))."""
    return -float(np.logaddexp(-top, -g)) if g > -np.inf else -np.inf


@dataclass
class Sample:
    """One drawn segmentation of one text: ids, log-probability, perturbed value."""

    ids: np.ndarray
    logp: float
    gumbel: float
    text_ok: bool


def sample_slice(pieces: Pieces, texts: list[bytes], keys: np.ndarray, k: int) -> list[tuple[list[Sample], float]]:
    """For each text its k samples, best first, and the bound: the best perturbed value left.

    The search tree's nodes are sets of segmentations: a common beginning, then any edge but
    some. A node's perturbed value, the maximum of its members', is drawn top-down, so popping
    the best node, completing it by its shares, and pushing the sets that leave its path at each
    step is A* search on an exact bound, and gives Gumbel top-k sampling without replacement.
    Units do not interact, so beginnings are shared over all words of a text, and all texts'
    completions are drawn at once.
    """
    out: list[tuple[list[Sample], float]] = [([], -np.inf) for _ in texts]
    top = -np.log(-np.log(_uniform(keys, 0)))  # the root's perturbed value
    for t, text in enumerate(texts):
        if not text:
            out[t] = ([Sample(np.zeros(0, np.int32), 0.0, float(top[t]), True)], -np.inf)
    live = np.array([t for t, text in enumerate(texts) if text], np.int64)
    if not len(live):
        return out
    whole = b"".join(b" " + t if t else b"" for t in texts)
    offsets = np.cumsum([0, *[len(t) + 1 if t else 0 for t in texts]])
    data = np.frombuffer(whole, np.uint8)
    starts = _units(data, offsets)
    ends = np.r_[starts[1:], len(data)]
    _, rep, kind = np.unique(w.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    sizes = (ends - starts)[rep]
    type_off = np.r_[0, np.cumsum(sizes)]
    type_data = data[np.repeat(starts[rep] - type_off[:-1], sizes) + np.arange(type_off[-1])]
    lattice = Lattice(pieces, type_data, type_off)
    unit_first = np.searchsorted(starts, offsets)
    text_of = np.repeat(np.arange(len(texts)), np.diff(unit_first))
    at0 = type_off[kind].astype(np.int32)
    with np.errstate(over="ignore"):
        unit_keys = w._mixed(keys[text_of] ^ (np.arange(len(starts), dtype=np.uint64) - unit_first[text_of].astype(np.uint64) + _U(1)) * _GOLD)

    # paths of each text: edges, Gumbel values (not yet truncated at the path's, the last) of the sets that leave the path at each step, the step it branched at, the edges barred there, the best set's value, the path's
    known: list[list[list]] = [[] for _ in texts]
    flat, firsts = lattice.paths(at0, unit_keys)
    bounds = firsts[unit_first[np.r_[live, len(texts)]]]  # empty texts have no units
    branch: dict[int, int] = {}
    barred: dict[int, list[int]] = {}
    for r in range(k):
        # one path for each live text is complete: edges end to end, bounds by text
        lens = np.diff(bounds)
        share = lattice.q[flat]
        lq, rest = np.log(share), 1.0 - share
        rest[rest < 1e-14] = 0.0
        with np.errstate(divide="ignore"):
            np.log(rest, out=rest)
        for n, t in enumerate(live.tolist()):
            if t in branch:
                s = bounds[n] + branch[t]
                left = 1.0 - sum(lattice.q[e] for e in barred[t])
                rest[s] = np.log(left) if left >= 1e-14 else -np.inf
        step = np.arange(len(flat)) - np.repeat(bounds[:-1], lens)
        with np.errstate(over="ignore"):
            noise_keys = np.repeat(w._mixed(keys[live] + _U(7919 * (r + 1))), lens) + step.astype(np.uint64) * _ODD
        run = np.empty(len(flat))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            np.cumsum(lq[a:b], out=run[a:b])  # within the text, so that digits do not depend on its neighbours
        drawn = run - lq + rest - np.log(-np.log(_uniform(noise_keys, 1)))
        ids, size = lattice.ids(pieces, flat)
        id_ends = np.r_[0, np.cumsum(size)][bounds].tolist()
        back, back_ends = _bytes(pieces, ids)
        byte_ends = np.r_[0, back_ends][id_ends].tolist()
        nxt = []
        for n, (t, a, b) in enumerate(zip(live.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            values = drawn[a:b]
            if t in branch:
                values[: branch[t]] = -np.inf
            logp = float(run[b - 1])
            ok = back[byte_ends[n] + 1 : byte_ends[n + 1]].tobytes() == texts[t]
            out[t][0].append(Sample(ids[id_ends[n] : id_ends[n + 1]], logp, float(top[t]), ok))
            known[t].append([flat[a:b], values, branch.get(t, -1), barred.get(t, []), _truncated(values.max(), top[t]), float(top[t])])
            best = max(known[t], key=lambda p: p[4])
            out[t] = (out[t][0], best[4])
            if best[4] > -np.inf:
                nxt.append((t, best))
        if r + 1 == k or not nxt:
            break
        live = np.array([t for t, _ in nxt], np.int64)
        # pop the best set of each live text: keep its beginning, take another edge, complete it
        heads, branch, barred, spans, inner = [], {}, {}, [], []
        with np.errstate(over="ignore"):
            turns = _uniform(w._mixed(keys + _U(104729 * (r + 1))), 2)
        for t, path in nxt:
            p_edges, p_values, p_branch, p_bars, top[t], p_top = path
            s = int(p_values.argmax())
            p_values[s] = -np.inf
            path[4] = _truncated(p_values.max(), p_top)
            bars = p_bars if s == p_branch else [int(p_edges[s])]  # p_bars ends with the edge taken at the branch
            start = int(lattice.start[p_edges[s]])
            lo = int(lattice.first[start])
            options = [e for e in range(lo, lo + int(lattice.count[start])) if e not in bars]
            share = lattice.q[options].cumsum()
            e = options[min(int(share.searchsorted(turns[t] * share[-1])), len(options) - 1)]
            unit = int(unit_first[t]) + int(np.count_nonzero(lattice.last[p_edges[:s]]))
            heads.append((p_edges[:s], e))
            branch[t], barred[t] = s, [*bars, e]
            ended = bool(lattice.last[e])
            spans.append((unit + ended, int(unit_first[t + 1])))
            inner.append(-1 if ended else int(lattice.end[e]))
        sizes = np.array([hi - lo for lo, hi in spans])
        tails = np.cumsum(np.r_[0, sizes])
        units = np.repeat(np.array([lo for lo, _ in spans]) - tails[:-1], sizes) + np.arange(tails[-1])
        at = at0[units]
        for n, x in enumerate(inner):
            if x >= 0:
                at[tails[n]] = x
        with np.errstate(over="ignore"):
            more, more_firsts = lattice.paths(at, w._mixed(unit_keys[units] + _U(15485863 * (r + 1))))
        cuts = more_firsts[tails].tolist()
        parts = [x for n, (head, e) in enumerate(heads) for x in (head, np.array([e], np.int32), more[cuts[n] : cuts[n + 1]])]
        bounds = np.cumsum([0, *[len(head) + 1 + cuts[n + 1] - cuts[n] for n, (head, _) in enumerate(heads)]])
        flat = np.concatenate(parts)
    return out


def sample_segmentations(docs: DataFrame, k: int = 2, model: str = MODEL, seed: int = 1, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text", position: Column | None = None) -> DataFrame:
    """k distinct segmentations of every whole text, drawn without replacement, and checked by decoding.

    Rows: id, sample (1 to k, best perturbed value first), n_pieces, logp, gumbel, log_inclusion,
    ids_sha256 (of the ids as little-endian 32-bit integers), roundtrip (the ids decode to the
    text's bytes), with_ids, ids, and, where a position (a bigint column of docs) is given, that.
    log_inclusion is the log of 1 - exp(-exp(logp - bound)),
    with the best perturbed value left out as the bound: the chance that the segmentation
    exceeds it, so that weights p / inclusion estimate sums over all segmentations.

    Draws depend on the seed, the row's id and the place in the text only, so a lost executor's
    rows come out the same. Characters without a piece fall back to byte pieces, so every text,
    valid or not, decodes exactly. Rows are independent: no shuffle, and a task holds a few
    megabytes of text, or one long text, at a time (tables.bound_batches).

    Ids that are not whole numbers are hashed for their draws.

    Nulls: a null text counts as empty, and an empty text has one segmentation, of no pieces; a
    null id is hashed as -1. Texts with fewer than k segmentations give what they have. Repeated
    rows are all sampled, alike where ids and texts are. Empty tables give no rows.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.load(model))
    kind = docs.schema[id_col].dataType.simpleString()
    placed = position is not None
    names = ["id", "sample", "n_pieces", "logp", "gumbel", "log_inclusion", "ids_sha256", "roundtrip"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        for batch in batches:
            row_keys = w._mixed(batch["h"].to_numpy().view(np.uint64) + _U(seed) * _GOLD)
            for lo, hi, _, _ in w.slices(batch):
                texts = batch["raw"].slice(lo, hi - lo).to_pylist()
                rows, cols = [], [[] for _ in names[1:]]
                for n, (samples, bound) in enumerate(sample_slice(pieces, texts, row_keys[lo:hi], k)):
                    for r, s in enumerate(samples):
                        odds = s.logp - bound  # bound is -inf when nothing is left out
                        pi = 0.0 if odds > 30 else odds if odds < -30 else np.log(-np.expm1(-np.exp(odds)))
                        rows.append(lo + n)
                        for c, v in zip(cols, (r + 1, len(s.ids), s.logp, s.gumbel, float(pi), hashlib.sha256(s.ids.astype("<i4").tobytes()).hexdigest(), s.text_ok, s.ids), strict=False):
                            c.append(v)
                types = [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.bool_(), pa.list_(pa.int32())]
                at = pa.array(rows, pa.int64())
                own = [batch["id"].take(at), *[pa.array(c, t) for c, t in zip(cols, types, strict=False)]]
                yield pa.RecordBatch.from_arrays([*own, batch["position"].take(at)] if placed else own, names + ["position"] * placed)

    raw = docs.select(F.col(id_col).alias("id"), F.coalesce(id_number(docs, id_col), F.lit(-1)).alias("h"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("raw"), *([position.alias("position")] if placed else []))
    schema = f"id {kind}, sample int, n_pieces long, logp double, gumbel double, log_inclusion double, ids_sha256 string, roundtrip boolean" + ", ids array<int>" * with_ids + ", position long" * placed
    return raw.mapInArrow(w.tidy(run), schema).withColumnRenamed("id", id_col)


def decode_ids(samples: DataFrame, model: str = MODEL, ids_col: str = "ids") -> DataFrame:
    """Add `decoded`, the text of the ids; null for null ids."""
    shared = samples.sparkSession.sparkContext.broadcast(Pieces.load(model))

    @F.pandas_udf("string")
    def text(col):
        return col.map(lambda x: None if x is None else decode(shared.value, np.asarray(x, np.int64)).decode("utf-8", "replace"))

    return samples.withColumn("decoded", text(F.col(ids_col)))
