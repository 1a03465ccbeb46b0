"""SentencePiece encoding and decoding by a max-plus parallel scan.

An encoding is a path over piece boundaries. For a byte-fallback BPE vocabulary a piece sequence is the
encoding exactly when each piece alone and each two neighbours together encode to themselves, so a path
weighs 0 when all its neighbours do and minus infinity otherwise, and the encoding is the best path.

Texts up to CHUNK characters are one chunk. Longer ones are split into chunks anywhere, white space or
not. The state at a boundary is the piece that covers the character before it, and where it starts. A
chunk yields the max-plus transfer matrix from states at its left boundary to states at its right one;
matrices are combined associatively in a tree, the best end state is traced down the tree to the state
at every boundary, and each chunk is then backtraced on its own. Chunks of one text are spread over
tasks; only the small matrices meet by text. Since no piece spans from another character to U+2581, a
chunk's inner words are settled apart, and its matrix needs only its first and last word.

Decoding joins pieces, bytes of byte pieces decoded together, and takes away the blank put in front.

Edges: null and empty texts have no pieces and round-trip. U+2581 in a text is read as a blank, so such
a text does not round-trip; all others do. Rows come back one for one, repeated rows and null ids too;
an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import materialise
from tidemark.session import ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 16_384
BLANK = "▁"
#: Words and pairs that a worker remembers, in each of two generations.
MEMO_WORDS, MEMO_PAIRS = 250_000, 300_000
LONE = re.compile("[\udc80-\udcff]")
NEVER = -(1 << 60)
#: State before the first character.
START = (-2, 0)
#: Texts that usual normalisers change.
PROBES = ("  two  blanks ", "\tA\u00a0B\n", "\ufb01 \u2167 \uff21 e\u0301 \u212b", "I\u0130 Stra\u00dfe")
#: Piece number of a character that is no piece; it is written as its bytes.
UNKNOWN = -1


def load(path: str = MODEL) -> dict:
    """Plain tables of a vocabulary file: pieces that texts can hold with their merge scores, byte pieces, all pieces.

    Weights are 0 and minus infinity only, so a vocabulary must be a BPE one, whose scores are ranks, with a piece
    for every byte, a blank put in front and no other normalisation; any other raises.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    kept = {pieces[i]: i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    if any(sp.get_score(i) != int(sp.get_score(i)) for i in kept.values()):
        raise ValueError(f"{path} is no BPE vocabulary: its scores are no ranks")
    if any(sp.decode(sp.encode(text)) != text for text in PROBES):
        raise ValueError(f"{path} normalises texts, which is not done here")
    bytes_ = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
    if len(bytes_) < 256:
        raise ValueError(f"{path} lacks pieces for bytes")
    return {"pieces": pieces, "kept": kept, "scores": [sp.get_score(i) for i in range(n)], "bytes": [bytes_[b] for b in range(256)], "silent": [i for i in range(n) if sp.is_control(i)]}


class Codec:
    """Encoding and decoding with the tables of load()."""

    def __init__(self, tables: dict):
        self.pieces, self.kept, self.scores, self.bytes = tables["pieces"], dict(tables["kept"]), tables["scores"], tables["bytes"]
        self.longest = max(map(len, self.kept), default=1)
        self.broken: set[int] = set()
        self.of_byte = {i: b for b, i in enumerate(self.bytes)}
        self.plain = {i: p for p, i in self.kept.items()}
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.unit = self._units()
        #: Text of each piece number; bytes from 128 on as lone surrogates until they are decoded together.
        self.shown = [""] * len(self.pieces)
        for i, piece in self.plain.items():
            self.shown[i] = piece.replace(BLANK, " ")
        for i, byte in self.of_byte.items():
            self.shown[i] = chr(byte) if byte < 128 else chr(0xDC00 + byte)
        #: Order of merging of each piece, and the two parts it is merged from; pieces that do not encode to themselves are left out.
        self.turn = {p: n for n, p in enumerate(sorted(self.kept, key=lambda p: -self.scores[self.kept[p]]))}
        self.halves: dict[str, tuple[str, str]] = {}
        for piece in list(self.kept):
            parts, halves = self._merges(piece)
            if len(parts) > 1:
                self.broken.add(self.kept[piece])
            elif halves:
                self.halves[piece] = halves
        for i in self.broken:
            del self.kept[self.plain[i]]
        automaton = ahocorasick.Automaton()
        for piece, i in self.kept.items():
            automaton.add_word(piece, (i, len(piece)))
        automaton.make_automaton()
        self.matches = automaton.iter

    def _units(self) -> re.Pattern:
        """Splits a text where no piece can cross: before blanks, and before signs that in no piece follow another character than signs."""
        before: dict[str, set[str]] = {c: set() for p in self.kept for c in p}
        for piece in self.kept:
            for x, y in zip(piece, piece[1:]):
                before[y].add(x)
        signs = {c for c in before if not c.isalpha() and c != BLANK}
        while drop := {c for c in signs if before[c] - signs - {BLANK}}:
            signs -= drop
        p = "".join(re.escape(c) for c in sorted(signs))
        return re.compile(f"{BLANK}+[{p}]*[^{BLANK}{p}]*|[{p}]+[^{BLANK}{p}]*|[^{BLANK}{p}]+" if p else f"{BLANK}*[^{BLANK}]+|{BLANK}+")

    # Merging, on the few characters of one or two pieces.

    def merged(self, text: str) -> list[str]:
        """Merges of the best-scored, then leftmost pair until none is a piece."""
        return self._merges(text)[0]

    def _merges(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """(parts after all merges, the two parts of the last merge)."""
        parts, halves = list(text), None
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = self.kept.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.scores[piece] > best):
                    best, at = self.scores[piece], i
            if at < 0:
                break
            halves = parts[at], parts[at + 1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, halves

    def pair(self, a: int, b: int) -> bool:
        """Whether the text of two pieces encodes to just these two.

        The later merge of the two sides is taken back in turn; a piece across the border that merges
        before what has been taken back would have been made instead.
        """
        if a < 0 or b < 0:
            return True
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._pair(self.plain[a], self.plain[b])
        return known

    def _pair(self, x: str, y: str) -> bool:
        turn, halves, limit = self.turn, self.halves, len(self.pieces)
        while True:
            if turn.get(x + y, limit) < limit:
                return False
            later_x, later_y = turn[x] if x in halves else -1, turn[y] if y in halves else -1
            if later_x > later_y:
                limit, x = later_x, halves[x][1]
            elif later_y >= 0:
                limit, y = later_y + 1, halves[y][0]
            else:
                return True

    # Paths.

    def best_path(self, text: str) -> list[int]:
        """The pieces of `text` (blanks written), UNKNOWN where a character is none: one forward pass, one trace back.

        The best path to a position is unique, so one predecessor is kept for each.
        """
        known, pair = self.pairs.get, self.pair
        last: list[int | None] = [None] * (len(text) + 1)
        back = [0] * (len(text) + 1)
        done = 0
        # All pieces that end at each character, longest first.
        for at, (piece, length) in self.matches(text):
            end = at + 1
            if end == done:
                continue
            start = end - length
            if start:
                before = last[start]
                if before is None:
                    continue
                fits = known(before << 20 | piece)
                if not (pair(before, piece) if fits is None else fits):
                    continue
            last[end], back[end] = piece, start
            done = end
        if text and last[-1] is None:
            return self._path_around(text)
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def _path_around(self, text: str) -> list[int]:
        """best_path() of a text with characters that are no piece: they stand alone between what can merge."""
        out: list[int] = []
        at = 0
        for end in [i for i, c in enumerate(text) if c not in self.kept] + [len(text)]:
            if at == 0 and end == len(text) > 0:
                raise ValueError("no path: the vocabulary is not closed under its merges")
            out += self.best_path(text[at:end])
            out += [UNKNOWN] * (end < len(text))
            at = end + 1
        return out

    def written(self, path: list[int], text: str) -> tuple[int, ...]:
        """Piece numbers with unknown characters as bytes; `text` is what the path covers."""
        if UNKNOWN not in path:
            return tuple(path)
        out, at = [], 0
        for piece in path:
            if piece == UNKNOWN:
                out += [self.bytes[b] for b in text[at].encode()]
                at += 1
            else:
                out.append(piece)
                at += len(self.plain[piece])
        return tuple(out)

    def word(self, unit: str) -> tuple[int, ...]:
        """Piece numbers of a unit, remembered; one with a single blank before it under its text without that."""
        key = unit[1:] if unit[0] == BLANK and unit[1:2] != BLANK else BLANK + unit
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is None:
                found = self.written(self.best_path(unit), unit)
            if len(unit) <= 48:
                if len(self.young) >= MEMO_WORDS:
                    self.old, self.young = self.young, {}
                self.young[key] = found
        return found

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        if text[0] == " " or "  " in text or BLANK in text:
            for unit in self.unit.findall(BLANK + text.replace(" ", BLANK)):
                out += self.word(unit)
            return out
        # Single blanks only: each starts a word, and most words are one unit that is remembered.
        young, units, word = self.young, self.unit.findall, self.word
        for part in text.split(" "):
            found = young.get(part)
            if found is None:
                for unit in units(BLANK + part):
                    out += word(unit)
                young = self.young
            else:
                out += found
        return out

    def decode(self, ids: list[int]) -> str:
        text = self.surface(ids)
        return text[1:] if text.startswith(" ") else text

    def surface(self, ids: list[int]) -> str:
        """The text of pieces as it stands, the blank in front included."""
        text = "".join(map(self.shown.__getitem__, ids))
        if text.isascii() or not LONE.search(text):
            return text
        return text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")

    # Chunks. Positions are relative to a window of text that goes `longest` characters past both boundaries.

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """(piece, start - at) of all pieces that cover the character before `at`."""
        out = [(UNKNOWN, -1)] if text[at - 1] not in self.kept else []
        for start in range(max(0, at - self.longest), at):
            for end in range(at, min(len(text), start + self.longest) + 1):
                piece = self.kept.get(text[start:end])
                if piece is not None:
                    out.append((piece, start - at))
        return out

    def span(self, state: tuple[int, int]) -> int:
        """End of a state's piece, relative to its boundary."""
        return 0 if state == START else state[1] + (1 if state[0] == UNKNOWN else len(self.plain[state[0]]))

    def reach(self, text: str, entries: list[tuple[int, int]], stop: int) -> dict[tuple[int, int], int]:
        """(piece, start) that cover the character before `stop` -> bits of the entries (piece, end) with a path there."""
        nodes: dict[int, dict[int, int]] = {}
        out: dict[tuple[int, int], int] = {}
        for bit, (piece, end) in enumerate(entries):
            if end >= stop:
                key = (piece, end - (1 if piece < 0 else len(self.plain[piece])))
                out[key] = out.get(key, 0) | 1 << bit
            else:
                node = nodes.setdefault(end, {})
                node[piece] = node.get(piece, 0) | 1 << bit
        for at in range(min((e for _, e in entries), default=stop), stop):
            node = nodes.pop(at, None)
            if not node:
                continue
            for end in range(at + 1, min(len(text), at + self.longest) + 1):
                piece = self.kept.get(text[at:end])
                if piece is None:
                    if end > at + 1:
                        continue
                    piece = UNKNOWN
                bits = 0
                for before, mask in node.items():
                    if before == START[0] or self.pair(before, piece):
                        bits |= mask
                if bits:
                    if end >= stop:
                        out[piece, at] = out.get((piece, at), 0) | bits
                    else:
                        deeper = nodes.setdefault(end, {})
                        deeper[piece] = deeper.get(piece, 0) | bits
        return out

    def cuts(self, text: str, begin: int, stop: int) -> tuple[int, int] | None:
        """First and last position in begin .. stop where a word starts, which no piece crosses."""
        first = next((m.start() + 1 for m in re.compile(f"[^{BLANK}]{BLANK}").finditer(text, max(0, begin - 1), min(len(text), stop + 1))), None)
        if first is None or first > stop:
            return None
        last = text.rfind(BLANK, first, stop + 1)
        while last > first and text[last - 1] == BLANK:
            last -= 1
        return first, max(first, last)

    def transfer(self, text: str, begin: int, stop: int, first: bool) -> dict[tuple, int]:
        """{(state at begin, state at stop): best weight}; states as (piece, start - boundary); paths of weight 0 only."""
        entries = [START] if first else self.states(text, begin)
        ends = [(s[0], begin + self.span(s)) for s in entries]
        cut = self.cuts(text, begin, stop)
        if cut is None:
            exits = self.reach(text, ends, stop)
        else:
            head = 0
            for bits in self.reach(text[: cut[0]], ends, cut[0]).values():
                head |= bits
            # A boundary on a cut is covered by the last piece of the word before it.
            if cut[1] == stop and cut[1] > cut[0]:
                last = self.last_cut(text, cut[0], stop)
                exits = self.reach(text[:stop], [(START[0], last)], stop)
            elif cut[1] == stop:
                return {(entries[b], (p, s - stop)): 0 for (p, s), bits in self.reach(text[:stop], ends, stop).items() for b in range(len(entries)) if bits >> b & 1}
            else:
                exits = self.reach(text, [(START[0], cut[1])], stop)
            exits = {key: head for key in exits}
        return {(entries[b], (p, s - stop)): 0 for (p, s), bits in exits.items() for b in range(len(entries)) if bits >> b & 1}

    def last_cut(self, text: str, first: int, stop: int) -> int:
        """The last word start before `stop`, `first` at least."""
        at = text.rfind(BLANK, first, stop)
        while at > first and text[at - 1] == BLANK:
            at -= 1
        return max(first, at)

    def backtrace(self, text: str, begin: int, stop: int, entry: tuple[int, int], exit_: tuple[int, int]) -> tuple[list[int], str]:
        """(piece numbers, their text) after the entry state's piece up to and with the exit state's piece."""
        start, end = begin + self.span(entry), stop + self.span(exit_)
        if start >= end:
            return [], ""
        inside = text[start:end]
        out: list[int] = []
        at = 0
        if entry != START and inside[0] != BLANK or entry != START and text[start - 1] == BLANK:
            # The first word began before this chunk: its pieces follow on the entry piece.
            m = re.compile(f"[^{BLANK}]{BLANK}").search(text, start - 1, end)
            at = (m.start() + 1 if m else end) - start
            lead = text[start - 1 : start] if entry[0] == UNKNOWN else self.plain[entry[0]]
            if at:
                out += self.written(self.best_path(lead + inside[:at])[1:], inside[:at])
        for unit in self.unit.findall(inside[at:]):
            out += self.word(unit)
        return out, inside


def product(a: dict[tuple, int], b: dict[tuple, int]) -> dict[tuple, int]:
    """Max-plus product of two sparse transfer matrices."""
    rows: dict = {}
    for (x, y), w in b.items():
        rows.setdefault(x, []).append((y, w))
    out: dict[tuple, int] = {}
    for (x, m), w in a.items():
        for y, v in rows.get(m, ()):
            if w + v > out.get((x, y), NEVER):
                out[x, y] = w + v
    return out


def boundary_states(matrices: list[dict[tuple, int]]) -> list[tuple[int, int]]:
    """The states of the best path at all boundaries, ends included: a product tree up, choices down it."""
    tree = [matrices]
    while len(tree[-1]) > 1:
        level = tree[-1]
        tree.append([product(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)])
    (start, end) = max(tree[-1][0], key=lambda k: (tree[-1][0][k], k))
    states = [start, end]
    for level in tree[-2::-1]:
        finer = []
        for i, (x, y) in enumerate(zip(states, states[1:])):
            finer.append(x)
            if 2 * i + 1 < len(level):
                left, right = level[2 * i], level[2 * i + 1]
                options = [(w + right[m, y], m) for (s, m), w in left.items() if s == x and (m, y) in right]
                finer.append(max(options)[1])
        states = [*finer, states[-1]]
    return states


_CODECS: dict[int, Codec] = {}


class _Step:
    """A worker's codec is kept between tasks, with what it remembers."""

    def __init__(self, shared):
        self.shared = shared

    @property
    def codec(self) -> Codec:
        key = getattr(self.shared, "id", 0)
        if key not in _CODECS:
            _CODECS.clear()
            _CODECS[key] = Codec(self.shared.value)
        return _CODECS[key]


def _lists(rows: list[list[int]]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    flat = np.fromiter(chain.from_iterable(rows), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


class _Encode(_Step):
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = self.codec
        for batch in batches:
            for piece in range(0, batch.num_rows, 256):
                part = batch.slice(piece, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = [codec.encode(t) for t in texts]
                fine = [codec.decode(i) == t for i, t in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(i) for i in ids], pa.int64()), _lists(ids), pa.array(fine, pa.bool_())], ["doc_id", "n_tokens", "ids", "round_trip"])


class _Split:
    def __init__(self, chunk: int, side: int):
        self.chunk, self.side = chunk, side

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = self.side
        for batch in batches:
            for doc, row, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = BLANK + item.as_py().replace(" ", BLANK)
                n = -(-len(text) // self.chunk)
                for k in range(n):
                    a, b = k * self.chunk, min(len(text), (k + 1) * self.chunk)
                    left = max(0, a - side)
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc], batch.column(0).type), "row": pa.array([row], pa.int64()), "k": pa.array([k], pa.int64()), "text": [text[left : b + side]], "begin": pa.array([a - left], pa.int32()), "stop": pa.array([b - left], pa.int32())})


class _Transfer(_Step):
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = self.codec
        for batch in batches:
            made = []
            for k, text, begin, stop in zip(*(batch.column(c).to_pylist() for c in ("k", "text", "begin", "stop"))):
                made.append([list(x + y) for x, y in codec.transfer(text, begin, stop, k == 0)])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), pa.array([[i for e in m for i in e] for m in made], pa.list_(pa.int32()))], ["row", "k", "moves"])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Boundary states of each text from its chunks' matrices, which come sorted by (row, k)."""
    row, held = None, []
    for batch in batches:
        for r, moves in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if r != row and held:
                yield _settled(row, held)
                held = []
            row = r
            held.append({((moves[i], moves[i + 1]), (moves[i + 2], moves[i + 3])): 0 for i in range(0, len(moves), 4)})
    if held:
        yield _settled(row, held)


def _settled(row: int, matrices: list[dict]) -> pa.RecordBatch:
    s = boundary_states(matrices)
    n = len(matrices)
    columns = [[row] * n, list(range(n)), [x[0] for x in s[:-1]], [x[1] for x in s[:-1]], [x[0] for x in s[1:]], [x[1] for x in s[1:]]]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.int32()) for c in columns[2:])], ["row", "k", "in_piece", "in_at", "out_piece", "out_at"])


class _Backtrace(_Step):
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = self.codec
        for batch in batches:
            ids, fine = [], []
            for text, begin, stop, a, b, c, d in zip(*(batch.column(x).to_pylist() for x in ("text", "begin", "stop", "in_piece", "in_at", "out_piece", "out_at"))):
                found, inside = codec.backtrace(text, begin, stop, (a, b), (c, d))
                ids.append(found)
                fine.append(codec.surface(found) == inside.replace(BLANK, " "))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), batch.column("k"), _lists(ids), pa.array(fine, pa.bool_())], ["doc_id", "row", "k", "ids", "fine"])


class _Decode(_Step):
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = self.codec
        for batch in batches:
            texts = [None if i is None else codec.decode(i) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens, ids, round_trip (decoding the ids gives the text back)."""
    spark = docs.sparkSession
    ship(spark)
    tables = load(model)
    shared = spark.sparkContext.broadcast(tables)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    giant = F.coalesce(F.char_length("text") > chunk - 1, F.lit(False))
    short = own.where(~giant).mapInArrow(_Encode(shared), f"doc_id {kind}, n_tokens long, ids array<int>, round_trip boolean")

    rows = own.where(giant).select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    chunks = rows.mapInArrow(_Split(chunk, max(map(len, tables["kept"]), default=1)), f"doc_id {kind}, row long, k long, text string, begin int, stop int")
    chunks = materialise(chunks.repartition("row", "k"), "chunks")
    moves = chunks.mapInArrow(_Transfer(shared), "row long, k long, moves array<int>")
    states = moves.repartition("row").sortWithinPartitions("row", "k").mapInArrow(_combine, "row long, k long, in_piece int, in_at int, out_piece int, out_at int")
    # Written first, so that a task never runs two steps' workers, each with its memory, at a time.
    states = materialise(states, "states")
    traced = chunks.join(states, ["row", "k"]).mapInArrow(_Backtrace(shared), f"doc_id {kind}, row long, k long, ids array<int>, fine boolean")
    whole = traced.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"), F.bool_and("fine").alias("fine"))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    long_ = whole.select("doc_id", ids.alias("ids"), "fine").select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("fine").alias("round_trip"))
    return short.unionByName(long_)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """(doc_id, text) of piece numbers; null stays null."""
    ship(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(load(model))
    own = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return own.mapInArrow(_Decode(shared), f"doc_id {own.schema['doc_id'].dataType.simpleString()}, text string")
