"""SentencePiece encoding and decoding as a weighted finite-state transducer."""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from keystrata.llm.common import kept, with_made

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            size = varint()
        yield tag >> 3, data[at : at + size]
        at += size


class Model:
    """What a ``.model`` file says: pieces with scores and kinds, and how text is normalised."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback = UNIGRAM, False
        self.dummy_prefix, self.squeeze, self.charsmap = True, True, b""
        for field, value in _fields(data):
            if field == 1:
                own = dict(_fields(value))
                score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
                self.pieces.append((own.get(1, b"").decode(), score, own.get(3, NORMAL)))
            elif field == 2:
                own = dict(_fields(value))
                self.kind, self.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
            elif field == 3:
                own = dict(_fields(value))
                self.charsmap = own.get(2, b"")
                self.dummy_prefix, self.squeeze = bool(own.get(3, 1)), bool(own.get(4, 1))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if self.charsmap or any(kind == USER_DEFINED for _, _, kind in self.pieces):
            raise ValueError("normalisation tables and user-defined pieces are not supported")


class _Memo(dict):
    """Remembers what ``make`` gives, for at most ``limit`` keys, none of them a string of more than 64
    characters.  Full, it stays as it is, as what is frequent comes early, and starts anew after
    eight times as many misses."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.missed = make, limit, 0

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.limit:
            if type(key) is not str or len(key) <= 64:
                self[key] = value
        else:
            self.missed += 1
            if self.missed > 8 * self.limit:
                self.clear()
                self.missed = 0
        return value


class Normaliser:
    """The normaliser as a transducer: state -> (arcs for some characters, what all others do).

    An arc is (output, next state); any other character is copied behind the output of the
    state's default arc.  It is deterministic, so composing it with a text means running it.
    """

    def __init__(self, dummy_prefix: bool, squeeze: bool):
        prefix = SPACE if dummy_prefix else ""
        if squeeze:
            # 0: nothing written yet, 1: behind a character, 2: behind spaces that may be the last
            self.arcs = [({" ": ("", 0)}, (prefix, 1)), ({" ": ("", 2)}, ("", 1)), ({" ": ("", 2)}, (SPACE, 1))]
        else:
            self.arcs = [({" ": (prefix + SPACE, 1)}, (prefix, 1)), ({" ": (SPACE, 1)}, ("", 1))]
        self.inputs = re.compile("([" + re.escape("".join({c for own, _ in self.arcs for c in own})) + "])")

    def __call__(self, text: str) -> str:
        state, out, at = 0, [], 0
        while at < len(text):
            own, (before, after) = self.arcs[state]
            if after == state and not before and all(to == state for _, to in own.values()):
                # nothing leaves this state: its arcs apply to all that is left at once
                for c, (put, _) in own.items():
                    text = text.replace(c, put) if not at else text[at:].replace(c, put)
                    at = 0
                return "".join([*out, text])
            if text[at] in own:
                put, state = own[text[at]]
                out.append(put)
                at += 1
                continue
            found = self.inputs.search(text, at)
            # the first character takes the default arc, the rest of the stretch that of the next state
            end = found.start() if found and self.arcs[after] == self.arcs[1] else at + 1 if found else len(text)
            out += [before, text[at:end]]
            state, at = after, end
        return "".join(out)


class Transducer:
    """Normaliser, pieces and byte fallback, compiled once; each input takes its shortest path.

    - The normaliser maps a text to what pieces are made of (``Normaliser``).
    - Pieces are a trie: an arc a character, and an arc back to the root that emits the id.
    - Byte fallback gives a character without a piece an arc that emits its UTF-8 bytes.

    Their composition with a text has the states (position, last piece).  Its arcs are weighed in
    the tropical semiring by ``_weight`` of two neighbours; the shortest path is the encoding.
    For a unigram model the weight is minus the piece's score.  For a BPE model it is 0, or
    infinite where merges would not leave the two side by side: the merges that build a piece
    form a tree, so only the trees' edges at the boundary matter, and the ranks of merges
    across it are compared with the ranks of those that build the edges on (``_survives``).
    A position is then reached by one piece only, and no text is merged by trying.

    No arc crosses two neighbouring characters that no piece has, so paths split there, and
    repeated stretches are composed once: the memo holds at most ``limit`` of them.
    """

    def __init__(self, model: Model, limit: int = 1 << 19):
        self.model = model
        usable = [(p, s, i) for i, (p, s, k) in enumerate(model.pieces) if k == NORMAL and p]
        self.ids = {p: i for p, _, i in usable}
        self.scores = {p: s for p, s, _ in usable}
        # a node of the trie: the piece that ends here, and the next character's nodes
        self.trie: list = [None, {}]
        for piece in self.ids:
            node = self.trie
            for c in piece:
                node = node[1].setdefault(c, [None, {}])
            node[0] = piece
        self.pairs = {p[n : n + 2] for p in self.ids for n in range(len(p) - 1)}
        self.unknown = next((i for i, (_, _, k) in enumerate(model.pieces) if k == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(model.pieces) if k == BYTE}
        self.bpe = model.kind == BPE
        self.rare = min(self.scores.values(), default=0.0) - 10.0
        # no arc weighs less
        self.least = 0.0 if self.bpe else -max(self.scores.values(), default=0.0)
        self.trees: dict[str, tuple | None] = {}
        self.weights = _Memo(lambda before: _Memo(lambda piece: self._weight(before, piece), 1 << 8), 1 << 13)
        self.emits = _Memo(self._packed, 1 << 16)
        self.paths = _Memo(self._path, limit)
        self.normalise = Normaliser(model.dummy_prefix, model.squeeze)
        single = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        # characters of white space that no piece has can be read by themselves
        apart = "".join(c for c in "\n\t\r" if not any(c in p for p in self.ids))
        pattern = rf"[{apart}]|{SPACE}*[^{SPACE}{apart}]+|{SPACE}+" if apart else rf"{SPACE}*[^{SPACE}]+|{SPACE}+"
        self.cut = (lambda s: [s]) if single else re.compile(pattern).findall
        self.back = [self._surface(p, k) for p, _, k in model.pieces]

    @staticmethod
    def _surface(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == CONTROL else piece.replace(SPACE, " ").encode()

    def _tree(self, piece: str) -> tuple | None:
        """How merges build a piece: its states at its left and at its right edge, as (piece, rank), from
        a character to itself.  The rank is the score of the merge that makes the state, of a
        character infinite.  None for pieces that merges never build."""
        if piece in self.trees:
            return self.trees[piece]
        made = None
        if len(piece) == 1:
            made = ((piece, math.inf),), ((piece, math.inf),)
        elif piece in self.scores:
            for n in range(1, len(piece)):
                left, right = self._tree(piece[:n]), self._tree(piece[n:])
                if left and right and self._survives(right[0], left[1]):
                    state = ((piece, self.scores[piece]),)
                    if self.scores[piece] > min(left[0][-1][1], right[0][-1][1]):
                        raise ValueError("a piece that merges before its parts is not supported")
                    made = left[0] + state, right[1] + state
                    break
        self.trees[piece] = made
        return made

    def _survives(self, after: tuple, before: tuple) -> bool:
        """Does the boundary between two pieces last until both are built?

        ``before`` are the states at the right edge of the left piece, ``after`` those at the left
        edge of the right one.  Merges come by rank, and of equal rank from the left: a merge
        across beats one that builds the left edge on if its rank is higher, and one of the
        right edge also if it is equal.
        """
        i = j = 0
        while True:
            next_left = before[i + 1][1] if i + 1 < len(before) else -math.inf
            next_right = after[j + 1][1] if j + 1 < len(after) else -math.inf
            if next_left == next_right == -math.inf:
                return True
            across = self.scores.get(before[i][0] + after[j][0])
            if across is not None and across > next_left and across >= next_right:
                return False
            if next_left >= next_right:
                i += 1
            else:
                j += 1

    def _weight(self, before: str | None, piece: str) -> float:
        """Tropical weight of a piece behind another one (None at the beginning)."""
        if not self.bpe:
            return -self.scores.get(piece, self.rare)
        own = self._tree(piece)
        if own is None:
            return math.inf
        if before is None:
            return 0.0
        left = self._tree(before)
        together = left is not None and before + piece not in self.scores and self._survives(own[0], left[1])
        return 0.0 if together else math.inf

    def _packed(self, piece: str) -> bytes:
        """The ids a piece emits, as 32-bit integers; a character without a piece emits its bytes."""
        known = self.ids.get(piece)
        if known is not None:
            out = [known]
        elif self.model.byte_fallback:
            out = [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
        else:
            out = [self.unknown]
        return struct.pack(f"<{len(out)}i", *out)

    def _path(self, text: str) -> bytes:
        """Ids of the shortest path through one stretch."""
        pairs = self.pairs
        cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in pairs]
        if cuts:
            return b"".join([self.paths[text[i:j]] for i, j in zip([0, *cuts], [*cuts, len(text)], strict=True)])
        return b"".join(map(self.emits.__getitem__, self._shortest(text)))

    def _shortest(self, text: str) -> list[str]:
        """Pieces of the path of least weight from the first to the last position."""
        n, root, weights, least, inf = len(text), self.trie[1], self.weights, self.least, math.inf
        weight: list[float] = [0.0] + [inf] * n
        last: list[str | None] = [None] * (n + 1)
        for i in range(n):
            here = weight[i]
            if here == inf:
                continue
            behind = weights[last[i]]
            j = i + 1
            # a character is an arc, whether it has a piece or not
            piece = text[i]
            node = root.get(piece)
            while True:
                if piece is not None and here + least < weight[j]:
                    whole = here + behind[piece]
                    if whole < weight[j]:
                        weight[j], last[j] = whole, piece
                if node is None or j == n:
                    break
                node = node[1].get(text[j])
                if node is None:
                    break
                piece = node[0]
                j += 1
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as packed 32-bit integers."""
        return b"".join(map(self.paths.__getitem__, self.cut(self.normalise(text))))

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.back.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def compiled(data: bytes) -> Transducer:
    """The transducer of a model, compiled once a process, which keeps it until a task of another operator."""
    return kept(data, lambda: Transducer(Model(data)))


def default_model() -> str:
    """The public 32k piece vocabulary where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_texts(docs: DataFrame, *, model: str | None = None, column: str = "text", decoded: bool = False) -> DataFrame:
    """Add ``ids`` (array of int), ``n_tokens`` and ``decodes`` to every row; ``decoded`` adds the text itself.

    The model file is read by the driver and handed to the tasks (a file of fixed size).
    ``decodes`` says whether decoding the ids gives the text again (the space mark reads as a
    space, and models that squeeze spaces lose them).  Null text has null ids, no tokens and
    null ``decodes``; empty text has no ids.  Long texts are read whole, in one pass.  Equal texts have equal ids.
    All columns are kept but those named like the added ones, which are replaced.  An empty
    table gives an empty result.
    """
    data = Path(model or default_model()).read_bytes()
    added = T.StructType().add("ids", T.ArrayType(T.IntegerType())).add("n_tokens", "long").add("decodes", "boolean")
    if decoded:
        added = added.add("decoded", "string")

    def make(texts: list[str | None]) -> list:
        from keystrata.llm.sentencepiece_fst import SPACE, compiled

        coder = compiled(data)
        packed = [None if t is None else coder.encode(t) for t in texts]
        back = [None if p is None else coder.decode(np.frombuffer(p, np.int32).tolist()) for p in packed]
        lengths = [0 if p is None else len(p) // 4 for p in packed]
        begins = np.cumsum([0, *lengths]).tolist()
        offsets = [None if p is None else at for p, at in zip(packed, begins, strict=False)] + begins[-1:]
        flat = np.frombuffer(b"".join(p for p in packed if p), np.int32)
        return [
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)),
            pa.array(lengths, pa.int64()),
            pa.array([None if t is None else t.replace(SPACE, " ") == b for t, b in zip(texts, back, strict=True)], pa.bool_()),
            *([pa.array(back, pa.string())] if decoded else []),
        ]

    return with_made(docs, column, added, make, keeps=data)
