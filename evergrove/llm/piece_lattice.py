"""SentencePiece BPE as a max-plus lattice.

A sequence of pieces is what the merges produce exactly if every piece is what
its own characters merge to, and every two neighbours are what their joined
characters merge to.  So an encoding is the best path of a lattice whose nodes
are (end, piece) and whose arcs weigh 0 if two pieces may be neighbours and
minus infinity if not; any prefix of a text has at most one path of weight 0.

A chunk of a long text maps the states at its left boundary (a piece that
reaches or crosses it) to those at its right one: a max-plus transfer matrix,
kept sparse.  Products of such matrices are associative, so chunks can be done
in parallel; the state at every boundary then lets each chunk find its own
pieces.  Pieces never join a word to the blank after it, which makes complete
words independent of what surrounds them.
"""

from __future__ import annotations

import re

BLANK = "▁"
State = tuple[int, int, str]  # how far the piece reaches past the boundary, its id, its text
Matrix = dict[State, dict[State, float]]
START: State = (0, -2, "")
_BREAK = re.compile(f"(?<!{BLANK}){BLANK}")


class PieceModel:
    """Pieces, scores and merges of a SentencePiece BPE model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.processor.get_piece_size()
        special = [self.processor.is_control(i) or self.processor.is_unknown(i) or self.processor.is_byte(i) or self.processor.is_unused(i) for i in range(size)]
        self.ids = {self.processor.id_to_piece(i): i for i in range(size) if not special[i]}
        self.scores = {piece: self.processor.get_score(i) for piece, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.bytes = [self.processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.neighbours: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        raw = {piece_id: bytes([b]) for b, piece_id in enumerate(self.bytes)}
        self.raw = [raw.get(i) if i in raw else (b"" if special[i] else self.processor.id_to_piece(i).replace(BLANK, " ").encode()) for i in range(size)]

    def merge(self, text: str) -> list[str]:
        """The merges on a short text: the best-scored neighbours first, the
        leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def is_piece(self, text: str) -> bool:
        """A known piece that merges can make, or any single character."""
        if len(text) == 1:
            return True
        known = self.whole.get(text)
        if known is None:
            known = self.whole[text] = text in self.ids and self.merge(text) == [text]
        return known

    def may_follow(self, left: str, right: str) -> bool:
        if not left:
            return True
        known = self.neighbours.get((left, right))
        if known is None:
            if len(self.neighbours) > 500_000:
                self.neighbours.clear()
            known = self.neighbours[left, right] = self.merge(left + right) == [left, right]
        return known

    def emit(self, piece: str) -> list[int]:
        """The ids of a piece; a character without one becomes its bytes."""
        own = self.ids.get(piece)
        return [own] if own is not None else [self.bytes[b] for b in piece.encode()]

    def decode(self, ids) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return raw[1:] if raw.startswith(" ") else raw


def paths(model: PieceModel, text: str, first: str, start: int, stop: int) -> dict[int, tuple[int, str]]:
    """Best paths from position ``start``, after the piece ``first``: the last
    piece's (start, text) for every end that can be reached by pieces starting
    before ``stop``."""
    last: dict[int, tuple[int, str]] = {start: (-1, first)}
    for end in range(start + 1, min(len(text), stop - 1 + model.longest) + 1):
        for begin in range(max(start, end - model.longest), min(end, stop)):
            if begin in last:
                piece = text[begin:end]
                if model.is_piece(piece) and model.may_follow(last[begin][1], piece):
                    last[end] = (begin, piece)
                    break
    return last


def walk(last: dict[int, tuple[int, str]], end: int, start: int) -> list[str]:
    pieces = []
    while end > start:
        end, piece = last[end]
        pieces.append(piece)
    return pieces[::-1]


class Chunk:
    """Characters [begin, stop) of a text with ``model.longest`` more on both
    sides; ``final`` says that the text ends at ``stop``."""

    def __init__(self, model: PieceModel, context: str, begin: int, stop: int, final: bool):
        self.model, self.text, self.begin, self.stop, self.final = model, context, begin, stop, final
        # words from the first to the last break are complete, whatever the neighbours
        breaks = [m.start() for m in _BREAK.finditer(context, begin + 1, stop) if m.start() > 0]
        self.left = breaks[0] if breaks else None
        self.right = breaks[-1] if breaks else None

    def entries(self) -> list[State]:
        """Every piece that could cross or reach the left boundary."""
        if self.begin == 0:
            return [START]
        found = []
        for start in range(max(0, self.begin - self.model.longest), self.begin):
            for end in range(self.begin, min(len(self.text), start + self.model.longest) + 1):
                piece = self.text[start:end]
                if self.model.is_piece(piece):
                    found.append((end - self.begin, self.model.ids.get(piece, -1), piece))
        return found

    def _exits(self, last: dict[int, tuple[int, str]]) -> dict[State, float]:
        if self.final:
            return {START: 0.0} if self.stop in last else {}
        found = {}
        for end, (start, piece) in last.items():
            if end >= self.stop and start < self.stop:
                found[end - self.stop, self.model.ids.get(piece, -1), piece] = 0.0
        return found

    def _passes(self, entry: State) -> bool:
        return self.begin + entry[0] >= self.stop

    def matrix(self) -> Matrix:
        """Entry state -> exit state -> weight; absent means minus infinity."""
        model, out = self.model, {}
        after = self._exits(paths(model, self.text, "", self.right, self.stop)) if self.right is not None else None
        for entry in self.entries():
            at = self.begin + entry[0]
            if at > self.stop:  # the piece spans the whole chunk
                out[entry] = {(at - self.stop, entry[1], entry[2]): 0.0}
            elif self.left is not None:
                if at <= self.left and self.left in paths(model, self.text[: self.left], entry[2], at, self.left):
                    out[entry] = after
            elif self.final and at == self.stop:
                out[entry] = {START: 0.0}
            else:
                last = paths(model, self.text, entry[2], at, self.stop)
                exits = self._exits(last)
                if at == self.stop:
                    exits[0, entry[1], entry[2]] = 0.0
                out[entry] = exits
        return out

    def pieces(self, entry: State, leave: State, words) -> list[int]:
        """The ids of the pieces that start in the chunk, given its states.
        ``words`` encodes a string of complete words."""
        model, at = self.model, self.begin + entry[0]
        if at >= self.stop:
            return []
        end = self.stop + (0 if self.final else leave[0])
        if self.left is None:
            return [i for p in walk(paths(model, self.text, entry[2], at, self.stop), end, at) for i in model.emit(p)]
        head = walk(paths(model, self.text[: self.left], entry[2], at, self.left), self.left, at)
        tail = walk(paths(model, self.text, "", self.right, self.stop), end, self.right)
        return [i for p in head for i in model.emit(p)] + words(self.text[self.left : self.right]) + [i for p in tail for i in model.emit(p)]


def product(a: Matrix, b: Matrix) -> Matrix:
    """Max-plus product of two transfer matrices."""
    out: Matrix = {}
    for entry, row in a.items():
        best: dict[State, float] = {}
        for middle, weight in row.items():
            for leave, more in b.get(middle, {}).items():
                if weight + more > best.get(leave, float("-inf")):
                    best[leave] = weight + more
        if best:
            out[entry] = best
    return out


def combined(matrices: list[Matrix]) -> Matrix:
    """The product of consecutive chunks' matrices, by halves."""
    if len(matrices) == 1:
        return matrices[0]
    half = len(matrices) // 2
    return product(combined(matrices[:half]), combined(matrices[half:]))


def boundary_states(matrices: list[Matrix], first: State = START, last: State = START) -> list[State]:
    """The best path's state at every boundary of consecutive chunks, from the
    state ``first`` at their left end to ``last`` at their right one.

    Products from the right tell which states can still reach the end; the path
    then goes forward through the best of them."""
    suffix: list[Matrix] = [{last: {last: 0.0}}]
    for matrix in reversed(matrices):
        reach = product(matrix, suffix[-1])
        suffix.append(reach)
    suffix.reverse()
    states, now = [first], first
    for k, matrix in enumerate(matrices):
        ahead = suffix[k + 1]
        options = [(weight + ahead[s][last], s) for s, weight in matrix[now].items() if last in ahead.get(s, {})]
        now = max(options)[1]
        states.append(now)
    return states
