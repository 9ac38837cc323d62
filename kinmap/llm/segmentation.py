"""SentencePiece encoding and decoding: sampled segmentations without replacement.

The lattice of a text has a node before each character and an edge for each
piece of the model that starts there (bytes where no piece holds a character). Weights
are the pieces' scores; a model of the BPE type has only merge ranks, which count as
log-probabilities by Zipf's law. Backward sums make each node's edges a
distribution, so a segmentation's probability is a product along its path.

Gumbel top-k: every segmentation has its log-probability plus Gumbel noise; the k
largest are wanted. Perturbed A-star search finds them from the top down. The largest value of all is
a Gumbel variable, its path an ancestral sample. What is left falls into one set for each
decision of the path (same choices before, another one here), whose largest value is a
truncated Gumbel of the set's mass: an exact priority. The best set is opened next,
and so on. The best set not opened is the threshold for the inclusion scores
log(1 - exp(-exp(log p - threshold))). All noise comes from a hash of (row key, sample, position).

Pieces never span a space that follows another character, nor most ends of words (checked when a
model is loaded), so lattices of words are built once and remembered; walks over all words of a block of texts are vectorised.

Defined cases: null or empty text has one segmentation, without pieces; a text with
fewer than k segmentations gives them all, with inclusion score 0 (certain); equal key and text
give equal samples; a null key is a key of its own; characters the model lacks,
and its space symbol when it stands in a text, become bytes, so that decoding gives the text back; repeated rows have the same samples each;
an empty table gives an empty result; a very long text, or word, costs time and memory in proportion to its length; other columns aren't read, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmap.llm.common import fresh, per_text, remembered, table

SPACE = "▁"
GOLD = np.uint64(0x9E3779B97F4A7C15)
END = -1
#: Walks of this many words at most go on one by one.
FEW = 4
#: What a walk reads of an edge, side by side.
TURN = np.dtype([("below", np.float32), ("step", np.uint32)])
SPREAD = np.int64(0x1E3779B97F4A7C15)


def uniform(x: np.ndarray) -> np.ndarray:
    """Hashes of 64-bit numbers (the finaliser of SplitMix64) as numbers between 0 and 1."""
    z = x + GOLD
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


def key_seed(key, what: str) -> int:
    return xxhash.xxh64_intdigest(f"{what}:{key!r}", seed=7)


class Pieces:
    """The model's pieces, their weights (probabilities, not summing to one) and their bytes."""

    def __init__(self, path: str, sharpness: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        score = np.array([model.get_score(i) for i in plain])
        if score.min() < -1000:  # merge ranks
            order = np.argsort(-score, kind="stable")
            rank = np.empty(len(plain))
            rank[order] = np.arange(len(plain))
            score = -np.log(rank + 10) - math.log(math.log(len(plain)))
        weight = np.exp(sharpness * score)
        self.edges = {model.id_to_piece(i): (i, w) for i, w in zip(plain, weight.tolist(), strict=True)}
        self.longest = max(map(len, self.edges))
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.rare = float(weight.min())
        self.bytes = [b""] * n
        for i in plain:
            self.bytes[i] = model.id_to_piece(i).replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte):
            self.bytes[i] = bytes([b])
        self.size_of = np.array([len(x) for x in self.bytes])
        self.begin_of = np.cumsum(self.size_of) - self.size_of
        self.table = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.build_trie()
        self.cut, self.open, self.quick = self.cuts()
        # the same for texts with their own spaces: most stay ASCII
        self.find, self.find_quick = (re.compile(x.pattern.replace(SPACE, " ")).findall for x in (self.cut, self.quick))

    def cuts(self) -> tuple[re.Pattern, list[str], re.Pattern]:
        """Where words end that no piece goes beyond: before a space that follows another character, around line feeds, and
        between a word character and another one, but for the few word characters that some piece goes on from.

        The pattern of words, those few characters, and a quicker pattern for texts that have none of them."""
        if any(re.search(f"[^{SPACE}]{SPACE}", p) or "\n" in p for p in self.edges):
            whole = re.compile("(?s).+")
            return whole, [], whole
        goes_on = sorted({p[i] for p in self.edges for i in range(len(p) - 1) if re.match(r"\w", p[i]) and re.match(f"[^\\w{SPACE}]", p[i + 1])} | {"\0", "\1"})
        if len(goes_on) > 60:
            spaces = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
            return spaces, [], spaces
        on = f"[{re.escape(''.join(goes_on))}]"
        plain = f"[^\\w{SPACE}\n\0\1]"
        cut = re.compile(f"\n|{SPACE}*{plain}*(?:\\w*{on}[^{SPACE}\n]*|\\w+)|{SPACE}*{plain}+|{SPACE}+")
        return cut, goes_on, re.compile(f"{SPACE}*\\w+|\n|{SPACE}*{plain}+\\w*|{SPACE}+")

    def build_trie(self) -> None:
        """Transitions of the pieces' trie: sorted keys (state and character), and for each state its piece and weight."""
        to: dict[int, int] = {}
        ends: dict[int, tuple[int, float]] = {}
        for piece, value in self.edges.items():
            state = 0
            for c in piece:
                state = to.setdefault(state << 21 | ord(c), len(to) + 1)
            ends[state] = value
        keys = np.array(sorted(to), np.int64)
        self.keys, self.to = keys, np.array([to[x] for x in keys.tolist()], np.int32)
        self.piece = np.full(len(to) + 1, -1, np.int32)
        self.weight = np.zeros(len(to) + 1)
        for state, (i, w) in ends.items():
            self.piece[state], self.weight[state] = i, w
        # a hashed table in front of the sorted keys: one key a slot, slots with several are marked
        self.mask = (1 << 19) - 1
        slot = (keys * SPREAD >> 44) & self.mask
        self.slot_key, self.slot_to = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.int32)
        self.slot_key[slot], self.slot_to[slot] = keys, self.to
        self.shared = np.bincount(slot, minlength=self.mask + 1) > 1
        self.head = np.zeros(0x110000, np.int32)
        roots = keys < 1 << 21
        self.head[keys[roots]] = self.to[roots]

    def cut_up(self, text: str) -> list[str]:
        """The text's words, one space put before. \\0 and what follows stand for a space symbol or a zero in the text itself."""
        if not text:
            return []
        if SPACE in text or "\0" in text:
            text = text.replace("\0", "\0\0").replace(SPACE, "\0\1")
        return (self.find if any(c in text for c in self.open) else self.find_quick)(" " + text)

    def words(self, text: str) -> list[str]:
        """``cut_up`` with the space symbol for spaces."""
        return [w.replace(" ", SPACE) for w in self.cut_up(text)]

    def decoded(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The pieces' bytes one after the other, and where each piece begins; the end last."""
        sizes = self.size_of[ids]
        at = np.append(0, np.cumsum(sizes))
        where = np.repeat(self.begin_of[ids] - at[:-1], sizes)
        where += np.arange(len(where))
        return self.table[where].tobytes(), at

    def decode(self, ids) -> str:
        """The text of a segmentation: its bytes without the space put before."""
        return self.decoded(np.asarray(ids, np.int64))[0][1:].decode("utf-8", "replace")


class Lattices:
    """Lattices of words in flat arrays: for each edge its node's cumulative probability (2 for the node's last edge), its
    own log-probability and id, and its step: from where it stands to the next node's first edge (0: the word ends), times 256,
    plus its width. A node goes by its first edge. Forgets all words when there are about ``most``, or
    ``most_edges`` edges (long unbroken words)."""

    def __init__(self, pieces: Pieces, most: int = 300_000, most_edges: int = 8_000_000):
        self.pieces, self.most, self.most_edges = pieces, most, most_edges
        self.id = np.zeros(0)
        self.clear()

    def clear(self) -> None:
        self.start: dict[str, int] = {}
        self.n_edges = 0
        room = self.most_edges + (1 << 18)  # takes memory as it is filled, and is filled anew after that
        if len(self.id) != room:
            self.turn, self.logp = np.empty(room, TURN), np.empty(room)
            self.id = np.empty(room, np.uint16 if len(self.pieces.bytes) <= 1 << 16 else np.int32)

    def starts(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """First nodes and lengths of the words of all texts. Valid until the next call."""
        get = self.start.get
        words = list(chain.from_iterable(texts))
        codes = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        lost = np.flatnonzero(codes < 0)
        if len(lost):
            missed = list(map(words.__getitem__, lost.tolist()))
            new = set(missed)
            if self.start and (len(self.start) + len(new) > self.most or self.n_edges > self.most_edges):
                self.clear()
                return self.starts(texts)
            self.add(new)
            codes[lost] = np.fromiter(map(get, missed), np.int64, len(missed))
        return codes >> 32, codes & 0xFFFFFFFF

    def add(self, words) -> None:
        """Words of up to 32 characters that are all pieces are built together by length, the others one by one."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        rest = [w for n, same in by_length.items() if n > 32 for w in same]
        for n, same in by_length.items():
            if n > 32:
                continue
            chars = np.frombuffer("".join(same).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(same), n)
            known = (self.pieces.piece[self.pieces.head[chars]] >= 0).all(axis=1)
            if not known.all():
                rest += [w for w, ok in zip(same, known.tolist(), strict=True) if not ok]
                same = [w for w, ok in zip(same, known.tolist(), strict=True) if ok]
                chars = chars[known]
            if same:
                self.add_plain(same, chars.astype(np.int64))
        if rest:
            self.add_any(rest)

    def add_plain(self, words: list[str], chars: np.ndarray) -> None:
        """chars: one row for each word, of one length, all of whose characters are pieces; so each is a node."""
        p = self.pieces
        n, size = chars.shape
        wide = min(p.longest, size)
        weight, piece = np.zeros(n * size * wide), np.zeros(n * size * wide, np.int32)  # the longest edge of a cell first
        flat, cell, left = chars.ravel(), np.arange(n * size), np.tile(np.arange(size, 0, -1, dtype=np.int32), n)
        state = p.head[flat].astype(np.int64)
        for length in range(1, wide + 1):
            if length > 1:
                on = np.flatnonzero(left >= length)
                cell, left = cell[on], left[on]
                cell, left, state = self.step(state[on], cell, left, flat[cell + (length - 1)])
                if not len(cell):
                    break
            to = cell * wide + (wide - length)
            weight[to] = p.weight[state]
            piece[to] = p.piece[state]
        total = np.zeros((n, size + 1))
        total[:, size] = 1.0
        edges = weight.reshape(n, size, wide)
        for i in range(size - 1, -1, -1):
            k = min(wide, size - i)
            own = edges[:, i, wide - k :]
            own *= total[:, i + k : i : -1]
            total[:, i] = own.sum(axis=1)
        known = np.flatnonzero(weight != 0)
        at = known // wide
        ahead = known - at * wide
        share = weight[known] / total[:, :size].ravel()[at]
        ids = piece[known]
        length = wide - ahead
        counts = np.bincount(at, minlength=n * size)
        first = np.cumsum(counts) - counts
        below = np.cumsum(share)
        below -= np.repeat(below[first] - share[first], counts)
        below[first + counts - 1] = 2.0
        self.start.update(zip(words, ((first[::size] + self.n_edges) << 32 | size).tolist(), strict=True))
        to = at + length
        last = to % size == 0
        to[last] = 0
        hop = first[to] - np.arange(len(at))
        hop[last] = 0
        self.put(below, share, ids, hop, length)

    def step(self, state: np.ndarray, cell: np.ndarray, left: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = self.pieces
        key = state << 21 | char
        slot = (key * SPREAD >> 44) & p.mask
        to = p.slot_to[slot]
        hit = p.slot_key[slot] == key
        lost = np.flatnonzero(~hit & p.shared[slot])  # several keys in this slot: look up in order
        if len(lost):
            where = np.minimum(np.searchsorted(p.keys, key[lost]), len(p.keys) - 1)
            found = p.keys[where] == key[lost]
            hit[lost[found]] = True
            to[lost[found]] = p.to[where[found]]
        on = np.flatnonzero(hit)
        return cell[on], left[on], to[on].astype(np.int64)

    def put(self, below, share, ids, hop, wide) -> None:
        e0, e1 = self.n_edges, self.n_edges + len(ids)
        if e1 > len(self.id):
            for name in ("turn", "logp", "id"):
                old = getattr(self, name)
                grown = np.zeros(e1 * 5 // 4, old.dtype)
                grown[:e0] = old[:e0]
                setattr(self, name, grown)
        self.turn["below"][e0:e1] = below
        self.turn["step"][e0:e1] = hop << 8 | wide
        self.logp[e0:e1] = np.log(np.minimum(share, 1.0))
        self.id[e0:e1] = ids
        self.n_edges = e1

    def add_any(self, words: list[str]) -> None:
        """One word after the other, from the last to the first and each from its end, into flat arrays that are turned round at last.
        Only the totals that a piece can still reach are kept, so a word costs time and memory in proportion to its length."""
        known, rare, longest, byte = self.pieces.edges, self.pieces.rare, self.pieces.longest, self.pieces.byte
        get = known.get
        share, ids, nxt, wide, counts = array("d"), array("i"), array("q"), array("B"), array("i")  # nxt: nodes counted from the end, -1: none
        begins = []
        for given in reversed(words):
            word = given.replace(" ", SPACE)
            n = len(word)
            escaped = "\0" in word
            reach = longest * (2 if escaped else 1)  # in characters of the word, where some stand for one with the next
            total: dict[int, float] = {n: 1.0}
            at: dict[int, int] = {n: -1}
            a = n
            while a:
                k, raw = 1, None
                if escaped and a > 1 and word[a - 2] == "\0" and self.escape_at(word, a - 2):
                    k, raw = 2, b"\0" if word[a - 1] == "\0" else SPACE.encode()
                elif word[a - 1] not in known:
                    raw = word[a - 1].encode("utf-8", "replace")
                a -= k
                if raw:  # one node for each byte, one edge each; in reverse order
                    s = rare ** len(raw) * total[a + k]
                    for j in range(len(raw) - 1, -1, -1):
                        share.append(1.0)
                        ids.append(byte[raw[j]])
                        nxt.append(at[a + k] if j == len(raw) - 1 else len(counts) - 1)
                        wide.append(k if j == len(raw) - 1 else 0)
                        counts.append(1)
                else:
                    found = []
                    for b in range(a + 1, min(n, a + longest) + 1):
                        e = get(word[a:b])
                        if e and b in at:
                            found.append((e[1] * total[b], e[0], at[b], b - a))
                    s = 0.0
                    for f in reversed(found):
                        s += f[0]
                    for z, i, to, w in found:
                        share.append(z / s)
                        ids.append(i)
                        nxt.append(to)
                        wide.append(w)
                    counts.append(len(found))
                total[a], at[a] = s, len(counts) - 1
                if s < 1e-200:  # too small: scale what a piece can still reach
                    for b in total:
                        total[b] *= 1e100
                if len(total) > 2 * reach:
                    for b in [b for b in total if b > a + reach]:
                        del total[b], at[b]
            begins.append((given, n, len(counts) - 1))
        nodes = len(counts)
        own = np.frombuffer(counts, np.int32)[::-1].astype(np.int64)
        first = np.cumsum(own) - own
        for word, n, r in begins:
            self.start[word] = (self.n_edges + int(first[nodes - 1 - r])) << 32 | n
        prob = np.frombuffer(share, np.float64)[::-1]
        below = np.cumsum(prob)
        below -= np.repeat(below[first] - prob[first], own)
        below[first + own - 1] = 2.0
        to = np.frombuffer(nxt, np.int64)[::-1]
        hop = np.where(to < 0, 0, first[nodes - 1 - np.maximum(to, 0)] - np.arange(len(to)))
        self.put(below, prob, np.frombuffer(ids, np.int32)[::-1], hop, np.frombuffer(wide, np.uint8)[::-1])

    @staticmethod
    def escape_at(word: str, i: int) -> bool:
        """Whether the \\0 at i begins a pair, that is, whether an even number of \\0 stands before it."""
        j = i
        while j and word[j - 1] == "\0":
            j -= 1
        return (i - j) % 2 == 0

    def node_of(self, edge: int) -> tuple[int, int]:
        """The first edge of this edge's node, and the one behind its last."""
        below, lo, hi = self.turn["below"], edge, edge
        while lo and below[lo - 1] < 2:
            lo -= 1
        while below[hi] < 2:
            hi += 1
        return lo, hi + 1

    def after(self, edge: int) -> tuple[int, int]:
        """The next node (END: none) and the edge's width."""
        hop, wide = divmod(int(self.turn["step"][edge]), 256)
        return edge + hop if hop else END, wide

    def walk(self, node: np.ndarray, seed: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ancestral samples of the words that start at these nodes (END: none left).

        -> edges in order, the number of edges of each word, and each edge's position. The noise
        depends on the word's seed and the position alone."""
        n = len(node)
        turn = self.turn.view(np.uint64)
        live = np.flatnonzero(node >= 0)
        e, where, own = node[live], pos[live], seed[live]
        counts = np.zeros(n, np.int64)
        steps = []
        while len(live):
            u = uniform(own + where.astype(np.uint64) * GOLD)
            here = turn[e]
            below = here.view(TURN)["below"]
            more = np.flatnonzero(u > below)
            while len(more):
                e[more] += 1
                here[more] = turn[e[more]]
                more = more[u[more] > below[more]]
            steps.append((live, e, where))
            counts[live] += 1
            step = here.view(TURN)["step"]
            on = np.flatnonzero(step >= 256)
            step = step[on]
            # the bytes of one character share its position: later bytes have one edge, so no noise is used
            live, e, where, own = live[on], e[on] + (step >> 8), where[on] + (step & 255), own[on]
            if len(live) <= FEW:
                break
        begun = len(steps)
        tails = [(w, *self.walk_one(*x)) for w, *x in zip(live.tolist(), e.tolist(), own.tolist(), where.tolist(), strict=True)] if len(live) else []
        for w, e, _ in tails:
            counts[w] += len(e)
        offsets = np.cumsum(counts) - counts
        edges, places = np.empty(int(counts.sum()), np.int64), np.empty(int(counts.sum()), np.int64)
        for s, (who, e, where) in enumerate(steps):
            to = offsets[who] + s
            edges[to], places[to] = e, where
        for w, e, where in tails:
            edges[offsets[w] + begun : offsets[w] + counts[w]], places[offsets[w] + begun : offsets[w] + counts[w]] = e, where
        return edges, counts, places

    def walk_one(self, node: int, seed: int, pos: int) -> tuple[array, array]:
        """The rest of one word's sample, as in ``walk``: for the few words that are longer than all others."""
        below, steps = self.turn["below"], self.turn["step"]
        gold, full = int(GOLD), (1 << 64) - 1
        edges, places = array("q"), array("q")
        while node >= 0:
            z = (seed + pos * gold + gold) & full
            z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & full
            z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & full
            z ^= z >> 31
            u = (z >> 11) * 2.0**-53 + 2.0**-54
            e = node
            while u > below[e]:
                e += 1
            edges.append(e)
            places.append(pos)
            step = int(steps[e])
            node = e + (step >> 8) if step >= 256 else END
            pos += step & 255
        return edges, places


def truncated(phi: np.ndarray, bound, u: np.ndarray) -> np.ndarray:
    """Gumbel variables of location phi, given that they are below ``bound``."""
    with np.errstate(divide="ignore", over="ignore"):
        return phi - np.log(np.exp(phi - bound) - np.log(u))


#: -log(E) of the noise E = -log(u), u < 1 - 2^-54, is below this. So a set behind an edge is worth less than the
#: log-probability before the edge plus this, and all later ones too.
HIGHEST = 37.5


class Path:
    """One segmentation of one text: its edges, where those of each word end, and their positions. Behind edge ``base`` - 1 sets leave it: the
    log-probabilities ``before`` those edges and the sets' values, the largest being ``best``, at edge ``cut``. Values are
    made from the front, as far as one of them can be the largest (see HIGHEST); ``ahead`` is the log-probability before the next edge."""

    __slots__ = ("edges", "words", "places", "value", "base", "start", "total", "before", "sets", "best", "cut", "ahead")

    def __init__(self, edges: np.ndarray, words: np.ndarray, places: np.ndarray, value: float, base: int = 0, start: float = 0.0):
        self.edges, self.words, self.places, self.value, self.base, self.start = edges, words, places, value, base, start
        self.before = self.sets = np.zeros(0)
        self.ahead, self.best, self.cut = start, -np.inf, base

    def find(self) -> None:
        i = int(self.sets.argmax()) if len(self.sets) else 0
        self.cut, self.best = self.base + i, float(self.sets[i]) if len(self.sets) else -np.inf

    def unsure(self) -> bool:
        """Whether a set that has no value yet may be the largest."""
        return self.base + len(self.sets) < len(self.edges) and not self.ahead + HIGHEST < self.best


def open_paths(lattices: Lattices, paths: list[Path], seeds: np.ndarray, some: int = 384) -> None:
    """Values of the sets of paths from their ``base`` on, until the largest is known."""
    left = [i for i, p in enumerate(paths) if p.unsure()]
    while left:
        own = [paths[i] for i in left]
        begins = [p.base + len(p.sets) for p in own]
        ends = [min(len(p.edges), a + (len(p.sets) // 2 or some)) for p, a in zip(own, begins, strict=True)]
        sizes = np.array(ends) - begins
        who = np.repeat(np.arange(len(own)), sizes)
        edges = np.concatenate([p.edges[a:b] for p, a, b in zip(own, begins, ends, strict=True)])
        logp = lattices.logp[edges]
        run = np.append(0.0, np.cumsum(logp))
        stop = np.cumsum(sizes)
        shift = np.array([p.ahead for p in own]) - run[stop - sizes]
        before = run[:-1] + shift[who]
        u = uniform(seeds[left][who] + np.concatenate([p.places[a:b] for p, a, b in zip(own, begins, ends, strict=True)]).astype(np.uint64) * GOLD)
        with np.errstate(divide="ignore"):
            share = np.exp(logp)
            rest = np.log1p(-np.where(share > 1 - 1e-12, 1.0, share))  # of the nodes' other edges
        sets = truncated(before + rest, np.array([p.value for p in own])[who], u)
        for p, a, b, ahead in zip(own, (stop - sizes).tolist(), stop.tolist(), (run[stop] + shift).tolist(), strict=True):
            p.before, p.sets, p.ahead = np.concatenate([p.before, before[a:b]]), np.concatenate([p.sets, sets[a:b]]), ahead
            p.find()
        left = [i for i in left if paths[i].unsure()]


def sample(lattices: Lattices, texts: list[str], seeds: list[int], k: int) -> list[tuple[list[Path], float]]:
    """For each text its k best perturbed segmentations, best first, and the threshold (-inf: nothing else is left)."""
    if not texts:
        return []
    with np.errstate(over="ignore", divide="ignore"):
        words = [lattices.pieces.cut_up(t) for t in texts]
        node, length = lattices.starts(words)
        bounds = list(pairwise(np.cumsum([0, *map(len, words)]).tolist()))
        place = np.append(0, np.cumsum(length))
        nodes, places = [node[a:b] for a, b in bounds], [place[a:b] - place[a] for a, b in bounds]
        base = np.array(seeds, np.uint64)

        def seeded(round_: int, use: int) -> np.ndarray:
            return base ^ (np.uint64(round_ * 2 + use + 1) * np.uint64(0xD6E8FEB86659FD93))

        def walks(round_: int, which: list[int], node: list[np.ndarray], pos: list[np.ndarray]) -> list[tuple]:
            """Samples of the words of each text from these nodes: edges, where each word's edges end, positions."""
            sizes = np.array([len(x) for x in node])
            who = np.repeat(np.array(which, np.int64), sizes)
            edges, counts, at = lattices.walk(np.concatenate(node), seeded(round_, 0)[who], np.concatenate(pos))
            own = np.append(0, np.cumsum(sizes))
            ends = np.append(0, np.cumsum(counts))
            return [(edges[a:b], ends[i + 1 : j + 1] - a, at[a:b]) for (i, j), (a, b) in zip(pairwise(own.tolist()), pairwise(ends[own].tolist()), strict=True)]

        first = (-np.log(-np.log(uniform(seeded(0, 1) + np.uint64(12345))))).tolist()
        found = [[Path(e, w, at, v)] for (e, w, at), v in zip(walks(0, list(range(len(texts))), nodes, places), first, strict=True)]
        open_paths(lattices, [p[0] for p in found], seeded(0, 1))
        born_in = [[0] for _ in texts]  # the round in which a path was found, which names its noise
        gone: dict[tuple[int, int, int], list[int]] = {}  # (text, path, edge number) -> edges that are taken
        for r in range(1, k):
            plan = []
            noise = uniform(seeded(r, 1) ^ np.uint64(0x14057B7EF767814F)).tolist()
            choice = uniform(seeded(r, 0) ^ np.uint64(0x5851F42D4C957F2D)).tolist()
            for d, paths in enumerate(found):
                j = max(range(len(paths)), key=lambda i, paths=paths: paths[i].best)
                p = paths[j]
                if len(paths) < r or p.best == -np.inf:
                    continue
                t, value = p.cut, p.best
                taken = gone.setdefault((d, j, t), [int(p.edges[t])])
                lo, hi = lattices.node_of(int(p.edges[t]))
                share = np.exp(lattices.logp[lo:hi]).tolist()
                for x in taken:
                    share[x - lo] = 0.0
                left = choice[d] * sum(share)
                pick = max(i for i, x in enumerate(share) if x > 0)
                for i, x in enumerate(share):
                    left -= x
                    if left < 0 and x > 0:
                        pick = i
                        break
                edge = lo + pick
                taken.append(edge)
                share[pick] = 0.0
                mass = sum(share)
                here = float(p.before[t - p.base])
                p.sets[t - p.base] = truncated(np.array([here + math.log(mass)]), value, noise[d])[0] if mass > 0 else -np.inf
                p.find()
                born = born_in[d][j]
                if p.unsure():
                    open_paths(lattices, [p], seeded(born, 1)[[d]])
                plan.append((d, p, t, edge, value, int(np.searchsorted(p.words, t, side="right")), here + float(lattices.logp[edge])))
            if not plan:
                break
            which = [x[0] for x in plan]
            begin = [np.concatenate([[lattices.after(e)[0]], nodes[d][w + 1 :]]) for d, _, _, e, _, w, _ in plan]
            start = [np.concatenate([p.places[t : t + 1] + lattices.after(e)[1], places[d][w + 1 :]]) for d, p, t, e, _, w, _ in plan]
            new = []
            for (d, p, t, e, value, w, start_), (edges, ends, at) in zip(plan, walks(r, which, begin, start), strict=True):
                path = Path(np.concatenate([p.edges[:t], [e], edges]), np.concatenate([p.words[:w], ends + (t + 1)]), np.concatenate([p.places[: t + 1], at]), value, t + 1, start_)
                found[d].append(path)
                born_in[d].append(r)
                new.append(path)
            open_paths(lattices, new, seeded(r, 1)[which])
        every = [p for paths in found for p in paths]
        sizes = np.array([len(p.edges) for p in every])
        run = np.append(0.0, np.cumsum(lattices.logp[np.concatenate([p.edges for p in every])]))
        ends = np.cumsum(sizes)
        for p, total in zip(every, (run[ends] - run[ends - sizes]).tolist(), strict=True):
            p.total = total
        return [(paths, max(p.best for p in paths)) for paths in found]


def inclusion(log_prob: float, threshold: float) -> float:
    """log(1 - exp(-exp(log_prob - threshold)))."""
    x = log_prob - threshold
    return 0.0 if threshold == -np.inf else x if x < -30 else float(np.log(-np.expm1(-np.exp(x))))


def lattices_of(model: str, words: int = 300_000) -> Lattices:
    return remembered(("lattices", model, words), lambda: Lattices(Pieces(model), words, 27 * words))


FIELDS = "sample:int,n_pieces:long,log_prob:double,perturbed:double,log_inclusion:double,ids_crc32:long,decoded:boolean,ids:array<int>"


def sampled_segmentations(docs: DataFrame, model: str, k: int = 3, keep: tuple[str, ...] = ("doc_id",), key: str = "doc_id", text: str = "text", seed: str = "segmentation", block: int = 1 << 19, words: int = 300_000) -> DataFrame:
    """``keep`` columns and ``samples``: array of (sample from 0, n_pieces, log_prob, perturbed value,
    log_inclusion, ids_crc32, decoded (the ids give the text back), ids), largest perturbed value first.

    No shuffle. A worker holds the lattices of about ``words`` words (some 500 bytes each) and the paths of ``block`` bytes of text, one text at least.
    """
    names = list(dict.fromkeys([*keep]))
    named = fresh(docs, "_key")
    keyed = docs.withColumn(named, F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("\0null")))

    def make():
        lattices = lattices_of(model, words)

        def some(texts: list[bytes], keys: list[str]) -> pa.Array:
            strings = [t.decode("utf-8", "replace") for t in texts]
            found = sample(lattices, strings, [key_seed(x, seed) for x in keys], k)
            every = [p for paths, _ in found for p in paths]
            ids = lattices.id[np.concatenate([p.edges for p in every])].astype("<u4") if every else np.zeros(0, "<u4")
            data, at = lattices.pieces.decoded(ids)
            ends = np.cumsum([0, *(len(p.edges) for p in every)]).tolist()
            at = at[ends].tolist()
            number, logs, chance, crc, back, n = [], [], [], [], [], 0
            for t, (paths, threshold) in zip(texts, found, strict=True):
                for i, p in enumerate(paths):
                    a, b = ends[n], ends[n + 1]
                    n += 1
                    logp = p.total
                    number.append(i)
                    logs.append(logp)
                    chance.append(inclusion(logp, threshold))
                    crc.append(zlib.crc32(ids[a:b]))
                    back.append(data[at[n - 1] + (b > a) : at[n]] == t)
            fields = {"sample": pa.array(number, pa.int32()), "n_pieces": pa.array(np.diff(ends)), "log_prob": pa.array(logs, pa.float64()), "perturbed": pa.array([p.value for p in every], pa.float64())}
            fields |= {"log_inclusion": pa.array(chance, pa.float64()), "ids_crc32": pa.array(crc, pa.int64()), "decoded": pa.array(back, pa.bool_())}
            fields["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view("<i4")))
            held = np.cumsum([0, *(len(paths) for paths, _ in found)])
            return pa.ListArray.from_arrays(pa.array(held, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))

        def run(texts: list[bytes], keys: list[str]) -> list:
            made, at, held = [], 0, 0
            for i, t in enumerate(texts):
                if i > at and held + len(t) > block:
                    made.append(some(texts[at:i], keys[at:i]))
                    at, held = i, 0
                held += len(t)
            return [pa.concat_arrays([*made, some(texts[at:], keys[at:])])]

        return run

    return per_text(keyed, names, f"samples array<struct<{FIELDS}>>", make, text, also=named)


def op7_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and sampled segmentation: doc_id, then FIELDS, the segmentation itself (``ids``) last."""
    import public_tokenizers

    found = sampled_segmentations(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", F.inline("samples"))
