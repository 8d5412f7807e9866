"""SentencePiece encoding and decoding by suffix-array matching.

The distinct segments of a batch are joined to one text and indexed with a suffix array, sorted as far as the longest piece
reaches. Every piece of the vocabulary is looked up by halving, which gives its range of occurrences; the ranges become
edges (start, end, piece), sorted by position. A BPE model relaxes them by merges: in each segment the best-scored edge
that joins two neighbouring symbols is taken first, the leftmost of equals, until none is left. A unigram model relaxes them
from left to right, keeping the best-scored path to every position.

A segment is a run of spaces with the characters up to the next space. No piece of the model joins a character and a space
behind it, so segments are independent and each distinct one is solved once a batch; models with such pieces are refused.
Characters without a piece become byte pieces where the model has them, else the unknown piece.

Only models with the identity normaliser are taken (a leading space is added if the model says so). U+2581 in a text is the
space symbol itself and decodes as a space.

Defined cases: a null or empty text has no ids and decodes to an empty text. Repeated rows are encoded each. Extra columns are
left out. An empty table gives no rows. Texts of any length are encoded whole, long ones part by part, in memory of some ten
times their size: a long segment without spaces goes in windows that meet at symbols which are the same seen from either side.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import batches_of, slices, utf8
from .tokens import vocab_path

SPACE = "▁"
#: Segments of more symbols are merged one by one with a heap.
SHORT = 64
#: Edges put in their places at a time; characters of a text, or of a segment without spaces, that are worked on at a time.
EDGES, WINDOW = 1 << 19, 1 << 18
UNKNOWN_TEXT = " ⁇ ".encode()
_NONE = np.int64(1) << np.int64(40)


class Pieces:
    """Pieces, ranks and bytes of a model file."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec, trainer = proto.normalizer_spec, proto.trainer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or trainer.treat_whitespace_as_suffix:
            raise ValueError("only models with the identity normaliser")
        self.bpe, self.prefix = trainer.model_type == 2, spec.add_dummy_prefix
        sp = SentencePieceProcessor(model_file=path)
        self.size, self.unk = sp.get_piece_size(), sp.unk_id()
        texts = [sp.id_to_piece(i) for i in range(self.size)]
        self.byte_of = {i: int(texts[i][3:5], 16) for i in range(self.size) if sp.is_byte(i)}
        self.byte_id = np.full(256, self.unk, np.int64)
        for i, b in self.byte_of.items():
            self.byte_id[b] = i
        special = {i for i in range(self.size) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.ids = np.array([i for i in range(self.size) if i not in special], np.int64)
        normal = [texts[i] for i in self.ids]
        if any(SPACE in p.lstrip(SPACE) or (p[0] == SPACE and SPACE in p[1:] and p.strip(SPACE)) for p in normal):
            raise ValueError("a piece goes on behind a space")
        self.width = max(map(len, normal))
        self.length = np.array([len(p) for p in normal], np.int64)
        self.chars = np.zeros((len(normal), self.width), np.int64)
        for n, p in enumerate(normal):
            self.chars[n, : len(p)] = [ord(c) + 1 for c in p]
        self.score = np.array([sp.get_score(int(i)) for i in self.ids])
        # Rank 0 is merged first; equal scores have equal ranks.
        self.rank = np.unique(-self.score, return_inverse=True)[1].astype(np.int64)
        plain = [b"" if sp.is_control(i) else UNKNOWN_TEXT if sp.is_unknown(i) else bytes([self.byte_of[i]]) if i in self.byte_of else texts[i].replace(SPACE, " ").encode() for i in range(self.size)]
        self.unknown = float(self.score.min()) - 10.0
        self.raw = np.frombuffer(b"".join(plain), np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum([len(x) for x in plain])]).astype(np.int64)


@functools.cache
def load(model: str) -> Pieces:
    return Pieces(vocab_path(model))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, sorted by their first ``depth`` characters at least.

    As many characters as fit 62 bits make the first keys; from there ranks are doubled.
    """
    there = np.zeros(int(text.max()) + 1, bool)
    there[text] = True
    code = (np.cumsum(there) - 1)[text]
    bits = max(1, int(code.max() + 1).bit_length())
    done = min(depth, 62 // bits)
    key = np.zeros(len(text), np.int64)
    for k in range(done):
        key <<= bits
        key[: max(0, len(text) - k)] |= code[k:] + 1
    while done < depth:
        _, rank = np.unique(key, return_inverse=True)
        key = (rank + 1) * (len(text) + 2)
        key[:-done] += rank[done:] + 1
        done *= 2
    return np.argsort(key)


def occurrences(text: np.ndarray, order: np.ndarray, chars: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every piece the range [lo, hi) of ``order`` whose suffixes begin with it."""
    width = chars.shape[1]
    wide = np.concatenate([text, np.zeros(width, text.dtype)])

    def compare(begin: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Suffixes against pieces: -1 less, 1 greater, 0 begins with it."""
        state = np.zeros(len(piece), np.int8)
        live = np.arange(len(piece))
        for k in range(width):
            live = live[length[piece[live]] > k]
            if not len(live):
                break
            a, b = wide[begin[live] + k], chars[piece[live], k]
            state[live] = np.where(a < b, -1, np.where(a > b, 1, 0))
            live = live[a == b]
        return state

    def bound(piece: np.ndarray, lo: np.ndarray, after: bool) -> np.ndarray:
        lo, hi = lo.copy(), np.full(len(piece), len(order), np.int64)
        at = np.flatnonzero(lo < hi)
        while len(at):
            mid = (lo[at] + hi[at]) >> 1
            state = compare(order[mid], piece[at])
            right = (state < 0) | ((state == 0) & after)
            lo[at] = np.where(right, mid + 1, lo[at])
            hi[at] = np.where(right, hi[at], mid)
            at = at[lo[at] < hi[at]]
        return lo

    lo = bound(np.arange(len(chars)), np.zeros(len(chars), np.int64), False)
    hi = lo.copy()
    found = np.flatnonzero(lo < len(order))
    found = found[compare(order[lo[found]], found) == 0]
    hi[found] = bound(found, lo[found], True)
    return lo, hi


class Lattice:
    """Edges of a text of segments (each closed by a 0): ``edge[i, n]`` is the piece of n characters at i, or -1.

    The table is the edges sorted by position (by counting: each goes to its place), so a range's piece is one look away.
    """

    def __init__(self, text: np.ndarray, pieces: Pieces) -> None:
        order = suffix_array(text, pieces.width)
        lo, hi = occurrences(text, order, pieces.chars, pieces.length)
        self.wide = pieces.width + 1
        self.edge = np.full(len(text) * self.wide, -1, np.int32)
        count, some = hi - lo, np.flatnonzero(hi > lo)
        upto = np.cumsum(count[some])
        while len(some):  # a bounded number of edges at a time
            n = max(1, int(np.searchsorted(upto, upto[0] - count[some[0]] + EDGES, "right")))
            part, some, upto = some[:n], some[n:], upto[n:]
            size = count[part]
            which = np.repeat(part, size)
            begin = order[np.arange(len(which)) + np.repeat(lo[part] - np.cumsum(size) + size, size)]
            self.edge[begin * self.wide + pieces.length[which]] = which
        self.pieces = pieces

    def piece(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Index into the model's pieces, -1 if none."""
        size = end - begin
        return np.where(size < self.wide, self.edge[begin * self.wide + np.minimum(size, self.wide - 1)], -1)

    def rank(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        p = self.piece(begin, end)
        return np.where(p >= 0, self.pieces.rank[p], _NONE)

    def merge(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the final symbols of BPE segments that begin at ``first`` and end before the next one's 0."""
        size = np.diff(first) - 1
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for n in np.flatnonzero(size > SHORT).tolist():
            done.append(self._heap(int(first[n]), int(first[n] + size[n])))
        short = np.flatnonzero((size <= SHORT) & (size > 0))
        begin = np.repeat(first[short], size[short]) + (np.arange(size[short].sum()) - np.repeat(np.cumsum(size[short]) - size[short], size[short]))
        seg = np.repeat(np.arange(len(short)), size[short])
        end = begin + 1
        rank = self._pair_ranks(begin, end, seg, np.arange(len(begin)))
        while len(begin):
            head = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            best = np.minimum.reduceat(rank, head)
            live = best < _NONE
            whole = np.repeat(live, np.diff(np.append(head, len(seg))))
            if not live.all():
                done.append((begin[~whole], end[~whole]))
                begin, end, seg, rank = begin[whole], end[whole], seg[whole], rank[whole]
                if not len(begin):
                    break
                head = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
                best = best[live]
            hit = np.flatnonzero(rank == np.repeat(best, np.diff(np.append(head, len(seg)))))
            hit = hit[np.concatenate([[True], seg[hit[1:]] != seg[hit[:-1]]])]  # the leftmost of a segment
            end[hit] = end[hit + 1]
            keep = np.ones(len(begin), bool)
            keep[hit + 1] = False
            moved = np.cumsum(keep)[hit] - 1
            begin, end, seg, rank = begin[keep], end[keep], seg[keep], rank[keep]
            touched = np.zeros(len(begin), bool)
            touched[moved] = True
            touched[moved[moved > 0] - 1] = True
            again = np.flatnonzero(touched)
            rank[again] = self._pair_ranks(begin, end, seg, again)
        b = np.concatenate([x for x, _ in done]) if done else np.zeros(0, np.int64)
        e = np.concatenate([x for _, x in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(b, kind="stable")
        return b[order], e[order]

    def _pair_ranks(self, begin: np.ndarray, end: np.ndarray, seg: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.full(len(at), _NONE)
        pair = np.flatnonzero(at + 1 < len(begin))
        pair = pair[seg[at[pair]] == seg[at[pair] + 1]]
        out[pair] = self.rank(begin[at[pair]], end[at[pair] + 1])
        return out

    def _heap(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        held = self.edge[a * self.wide : b * self.wide]
        at = np.flatnonzero(held >= 0)
        ranks = dict(zip((at + a * self.wide).tolist(), self.pieces.rank[held[at]].tolist(), strict=True))
        end = {i: i + 1 for i in range(a, b)}
        before = {i: i - 1 for i in range(a + 1, b)}
        heap: list[tuple[int, int, int]] = []

        def push(i: int) -> None:
            j = end[i]
            if j < b and end[j] - i < self.wide and (r := ranks.get(i * self.wide + end[j] - i)) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        for i in range(a, b):
            push(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end.get(i)
            if j is None or j >= b or end.get(j) != stop:
                continue
            end[i] = stop
            del end[j], before[j]
            if stop < b:
                before[stop] = i
            push(i)
            if i in before:
                push(before[i])
        begins = sorted(end)
        return np.array(begins, np.int64), np.array([end[i] for i in begins], np.int64)

    def path(self, first: np.ndarray, unknown: float) -> tuple[np.ndarray, np.ndarray]:
        """Unigram: starts and ends of the best path of each segment; a character without a piece costs ``unknown``."""
        n = int(first[-1])
        best, back = np.full(n + 1, -np.inf), np.arange(-1, n)
        best[first[:-1]] = 0.0
        edge = self.edge.reshape(-1, self.wide)
        last = np.zeros(n + 1, bool)
        last[first[1:] - 1] = True
        for i in range(n):
            if last[i]:
                continue
            options = [(int(k), float(self.pieces.score[edge[i, k]])) for k in np.flatnonzero(edge[i] >= 0)]
            if all(length != 1 for length, _ in options):
                options.append((1, unknown))
            for length, s in options:
                if best[i] + s > best[i + length]:
                    best[i + length], back[i + length] = best[i] + s, i
        b, e = [], []
        for a, z in zip(first[:-1].tolist(), (first[1:] - 1).tolist(), strict=True):
            i = z
            while i > a:
                b.append(int(back[i]))
                e.append(i)
                i = int(back[i])
        order = np.argsort(b)
        return np.array(b, np.int64)[order], np.array(e, np.int64)[order]


def segments(text: str, prefix: bool) -> list[str]:
    """Runs of spaces with what follows up to the next space."""
    text = text.replace(SPACE, " ")
    if not text:
        return []
    parts = (" " + text if prefix else text).split(" ")
    out, spaces = [], 0
    if parts[0]:
        out.append(parts[0])
    if "" not in parts[1:]:
        return out + [SPACE + p for p in parts[1:]]
    for p in parts[1:]:
        spaces += 1
        if p:
            out.append(SPACE * spaces + p)
            spaces = 0
    if spaces:
        out.append(SPACE * spaces)
    return out


def _lattice(found: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray, Lattice]:
    """Characters of the segments, each with a 0 behind it, where each begins, and their edges."""
    joined = np.frombuffer(("\x00".join(found) + "\x00").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1
    first = np.concatenate([[0], np.cumsum(np.array([len(s) + 1 for s in found], np.int64))])
    joined[first[1:] - 1] = 0
    return joined, first, Lattice(joined, pieces)


def _named(joined: np.ndarray, begin: np.ndarray, which: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of symbols, and where each symbol's begin; what has no piece becomes its UTF-8 bytes."""
    ids = np.where(which >= 0, pieces.ids[which], -1)
    width = np.ones(len(ids), np.int64)
    lost = np.flatnonzero(ids < 0)
    raw = [chr(c - 1).encode("utf-8", "surrogatepass") for c in joined[begin[lost]]] if len(pieces.byte_of) else [b""] * len(lost)
    width[lost] = [max(1, len(x)) for x in raw]
    at = np.cumsum(width) - width
    flat = np.full(int(width.sum()), pieces.unk, np.int32)
    flat[at[ids >= 0]] = ids[ids >= 0]
    for i, x in zip(lost.tolist(), raw, strict=True):
        flat[at[i] : at[i] + len(x)] = pieces.byte_id[list(x)]
    return flat, np.append(at, len(flat))


def _short(found: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    joined, first, lattice = _lattice(found, pieces)
    begin, end = lattice.merge(first) if pieces.bpe else lattice.path(first, pieces.unknown)
    flat, at = _named(joined, begin, lattice.piece(begin, end), pieces)
    return flat, at[np.searchsorted(begin, first)]


def _merged(text: str, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    joined, first, lattice = _lattice([text], pieces)
    begin, end = lattice.merge(first)
    return joined, begin, end, lattice.piece(begin, end)


def _fits(left: str, right: str, pieces: Pieces) -> bool:
    """Whether two symbols stay two when they stand side by side."""
    _, begin, _, _ = _merged(left + right, pieces)
    return begin.tolist() == [0, len(left)]


def _long_merge(text: str, pieces: Pieces, window: int) -> np.ndarray:
    """Ids of a long BPE segment, a window at a time.

    Merges never cross a boundary of the result, so a run of symbols is the result exactly if each two neighbours, merged alone,
    stay those two. Inside a window they do. Where a window ends in the middle, its last symbols are dropped and the next one begins
    at one that fits the symbol before it; where none of the last half fits, the window is doubled.
    """
    out, at, size = [], 0, window
    joined, begin, end, which = _merged(text[:size], pieces)
    while at + size < len(text):
        # Symbols near the window's end still depend on what comes behind it.
        far = int(np.searchsorted(begin, len(joined) - 1 - 4 * pieces.width))
        for cut in range(max(1, far), max(1, far // 2), -max(1, far // 64)):
            c = int(begin[cut])
            after = _merged(text[at + c : at + c + size], pieces)
            if _fits(text[at + int(begin[cut - 1]) : at + c], text[at + c : at + c + int(after[2][0])], pieces):
                out.append(_named(joined, begin[:cut], which[:cut], pieces)[0])
                at, (joined, begin, end, which) = at + c, after
                break
        else:
            size *= 2
            joined, begin, end, which = _merged(text[at : at + size], pieces)
    out.append(_named(joined, begin, which, pieces)[0])
    return np.concatenate(out)


def _long_path(text: str, pieces: Pieces, window: int) -> np.ndarray:
    """Ids of a long unigram segment: the best path's steps are kept, a byte a character, its scores only as far as a piece reaches."""
    n, width = len(text), pieces.width
    back = np.zeros(n + 1, np.uint8)
    best = np.full(width + 1, -np.inf)
    best[0] = 0.0
    for at in range(0, n, window):
        own = min(window, n - at)
        _, _, lattice = _lattice([text[at : at + own + width]], pieces)
        edge = lattice.edge.reshape(-1, lattice.wide)
        scores = np.concatenate([best, np.full(own, -np.inf)])
        for i in range(own):
            options = [(int(k), float(pieces.score[edge[i, k]])) for k in np.flatnonzero(edge[i] >= 0)]
            if all(length != 1 for length, _ in options):
                options.append((1, pieces.unknown))
            for length, s in options:
                if scores[i] + s > scores[i + length]:
                    scores[i + length], back[at + i + length] = scores[i] + s, length
        best = scores[own:]
    ends = [n]
    while ends[-1] > 0:
        ends.append(ends[-1] - int(back[ends[-1]]))
    ends = np.array(ends[::-1], np.int64)
    out = []
    for a in range(0, len(ends) - 1, window):
        part = ends[a : a + window + 1]
        joined, _, lattice = _lattice([text[part[0] : part[-1]]], pieces)
        begin = part[:-1] - part[0]
        out.append(_named(joined, begin, lattice.piece(begin, part[1:] - part[0]), pieces)[0])
    return np.concatenate(out)


def _solve(found: list[str], pieces: Pieces, window: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all distinct segments and their offsets; a segment longer than a window is solved by itself, in windows."""
    window = WINDOW if window is None else window
    flat, ends, i = [np.zeros(0, np.int32)], [0], 0
    while i < len(found):
        j = i
        while j < len(found) and len(found[j]) <= window:
            j += 1
        if j > i:
            ids, bounds = _short(found[i:j], pieces)
            ends += (bounds[1:] + ends[-1]).tolist()
            i = j
        else:
            ids = (_long_merge if pieces.bpe else _long_path)(found[i], pieces, window)
            ends.append(ends[-1] + len(ids))
            i += 1
        flat.append(ids)
    return np.concatenate(flat), np.array(ends, np.int64)


class Encoder:
    """Encodes batches of texts; segments solved for one batch are remembered for the next, up to ``KNOWN`` of them or ``HELD`` characters."""

    KNOWN, HELD = 200_000, 8_000_000

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self._forget()

    def _forget(self) -> None:
        self.code: dict[str, int] = {}
        self.held = 0
        self.flat, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and n + 1 offsets."""
        ids, count = [np.zeros(0, np.int32)], []
        short: list[tuple[str, bool]] = []
        for t in texts:
            if len(t or "") <= WINDOW:
                short.append((t or "", self.pieces.prefix))
                continue
            for part in (short, None):
                if part is None:
                    own = [self._solved([c])[0] for c in _cut(t, self.pieces.prefix)]
                    ids += own
                    count.append(sum(map(len, own)))
                elif part:
                    flat, n = self._solved(part)
                    ids.append(flat)
                    count += n.tolist()
            short = []
        if short:
            flat, n = self._solved(short)
            ids.append(flat)
            count += n.tolist()
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(count)]).astype(np.int64)

    def _solved(self, texts: list[tuple[str, bool]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after another, and how many each has."""
        if len(self.code) > self.KNOWN or self.held > self.HELD:
            self._forget()
        code, before = self.code, len(self.code)
        number, count = [], []
        for t, prefix in texts:
            own = segments(t, prefix)
            count.append(len(own))
            number += [code.setdefault(s, len(code)) for s in own]
        if len(code) > before:
            new = list(islice(code, before, None))
            self.held += sum(map(len, new))
            flat, bounds = _solve(new, self.pieces)
            self.bounds = np.concatenate([self.bounds, bounds[1:] + len(self.flat)])
            self.flat = np.concatenate([self.flat, flat])
        number = np.array(number, np.int64)
        begin, n = self.bounds[number], self.bounds[number + 1] - self.bounds[number]
        total = np.concatenate([[0], np.cumsum(n)])
        out = self.flat[np.arange(total[-1]) + np.repeat(begin - total[:-1], n)]
        return out, np.diff(total[np.concatenate([[0], np.cumsum(count)]).astype(np.int64)])


def _cut(text: str, prefix: bool) -> Iterator[tuple[str, bool]]:
    """A long text in parts of some ``WINDOW`` characters that begin where a run of spaces does, so segments stay whole."""
    text, at = text.replace(SPACE, " "), 0
    while at < len(text):
        end = text.find(" ", at + WINDOW)
        while 0 <= end and text[end - 1] == " ":
            end = text.find(" ", end + 1)
        end = len(text) if end < 0 else end
        yield text[at:end], prefix and not at
        at = end


def decode_batch(ids: np.ndarray, off: np.ndarray, pieces: Pieces) -> list[str]:
    """Texts of id lists; bytes that aren't UTF-8 become U+FFFD."""
    out = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        own = b"".join(_raw(ids[i : min(b, i + WINDOW)], pieces) for i in range(a, b, WINDOW))
        out.append((own[1:] if pieces.prefix and own[:1] == b" " else own).decode("utf-8", "replace"))
    return out


def _raw(ids: np.ndarray, pieces: Pieces) -> bytes:
    n = np.diff(pieces.raw_at)[ids]
    total = np.concatenate([[0], np.cumsum(n)])
    return pieces.raw[np.arange(total[-1]) + np.repeat(pieces.raw_at[:-1][ids] - total[:-1], n)].tobytes()


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 3 << 19) -> DataFrame:
    """(id, ``ids``): each text's ids as little-endian unsigned 32-bit numbers."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_batch = Encoder(load(model))
        for batch in batches:
            _, sizes = utf8(batch.column(1))
            for i, j in slices(sizes, batch_bytes):
                ids, off = encode_batch(batch.column(1).slice(i, j - i).to_pylist())
                raw = ids.astype("<u4").tobytes()
                rows = pa.array([raw[4 * a : 4 * b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), rows], [id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(batches_of(run), f"`{id_col}` {kind}, ids binary")


def decode(encoded: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id") -> DataFrame:
    """(id, ``ids``, ``text``): the texts again."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            column = batch.column(1).fill_null(b"")
            off = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy() // 4)]).astype(np.int64)
            for i, j in slices(off, 1 << 18):
                ids = np.frombuffer(b"".join(column.slice(i, j - i).to_pylist()), "<u4").astype(np.int64)
                texts = decode_batch(ids, off[i : j + 1] - off[i], pieces)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), column.slice(i, j - i), pa.array(texts, pa.string())], [id_col, "ids", "text"])

    return encoded.select(id_col, "ids").mapInArrow(batches_of(run), f"`{id_col}` {kind}, ids binary, text string")
