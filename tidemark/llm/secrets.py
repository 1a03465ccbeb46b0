"""Secret scans: base patterns, and formats learned from labelled credentials.

Base spans are leftmost matches, without overlap inside a kind, of three patterns: assign, access, hex.
Grammar inference adds spans. Labelled credentials are those that the base patterns find in a bounded sample of
rows, each under its kind, and SEED_EACH strings of each public token format of FORMATS. The strings of a kind
make a prefix tree over characters; its states are merged, in red-blue order, when their frequencies and those
below them are compatible (Hoeffding test), each into the compatible state that makes it most likely. Merging
makes loops, so the probabilistic automata know credentials of lengths and characters they have not seen.

Every candidate, a run of 16 or more token characters anywhere in a text, is scored: its log likelihood
under each automaton, and that under a background of the sample's other words and numbers (each character
after the one before). It becomes a span of kind `format` when the likeliest automaton is MARGIN bits or
more ahead of the background, which is what a credential's rarity asks for, and its bits a character exceed the
mean of that kind's credentials, each under the automaton of the other half of them, by no more than those
of all but MISSED_SHARE of them do; what chance adds shrinks with the root of the length. Candidates inside a base span are scored as well but add no span.

Edges: a null text counts as empty. Offsets are code points, end exclusive. Texts are scanned whole, one
row at a time. A kind with fewer than LEAST_WORDS credentials is not learned; credentials of more than
MOST_LABEL characters are found but not learned from. Rows come back one for one, repeated rows and null ids
too; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import materialise, release
from tidemark.session import ship

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "format")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WORD = re.compile(r"[A-Za-z0-9+/_-]{4,64}={0,2}")
SYMBOLS = 66

DIGITS = "0123456789"
ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + DIGITS
#: Public token formats, as literals and (characters, how many).
FORMATS = {
    "github": ["ghp_", (ALNUM, 36)],
    "gitlab": ["glpat-", (ALNUM + "_-", 20)],
    "google": ["AIza", (ALNUM + "_-", 35)],
    "npm": ["npm_", (ALNUM, 36)],
    "slack": ["xoxb-", (DIGITS, 12), "-", (DIGITS, 12), "-", (ALNUM, 24)],
    "stripe": ["sk_live_", (ALNUM, 24)],
}
SEED_EACH = 200

#: Bounds of the labelled sample: rows read for it, credentials kept of each kind, background words, and the longest credential learned from.
SAMPLE_ROWS, SAMPLE_EACH, SAMPLE_WORDS, MOST_LABEL = 20_000, 400, 50_000, 256
LEAST_WORDS = 8
#: Merge test; share of a state's probability kept for characters it has not seen, which leave the state as it is.
ALPHA, UNSEEN = 0.001, 0.02
#: Acceptance.
MISSED_SHARE, MARGIN = 0.05, 20.0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start, then kind as listed."""
    low = text.lower()
    spans = []
    if "pass" in low or "secret" in low or "token" in low or "key" in low:
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def credentials(text: str) -> Iterator[tuple[str, str]]:
    """(kind, credential) of the base spans; for assign the value alone."""
    for start, end, kind in base_spans(text):
        m = ASSIGN.match(text, start) if kind == "assign" else None
        yield kind, m[2] if m else text[start:end]


class Automaton:
    """A probabilistic automaton inferred from strings by state merging."""

    def __init__(self, words: list[str], alpha: float = ALPHA):
        self._count, self._final, self._next = [0], [0], [{}]
        for word in words:
            s = 0
            self._count[0] += 1
            for c in word:
                if c not in self._next[s]:
                    self._next[s][c] = [len(self._count), 0]
                    self._count.append(0)
                    self._final.append(0)
                    self._next.append({})
                edge = self._next[s][c]
                edge[1] += 1
                s = edge[0]
                self._count[s] += 1
            self._final[s] += 1
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._infer()

    def _gain(self, p: int, q: int, best: float) -> float | None:
        """Log likelihood of what the tree below q holds if it were below p; None where the two are not compatible or it is less than `best`."""
        work, gain = [(p, q)], 0.0
        while work:
            p, q = work.pop()
            np_, nq = self._count[p], self._count[q]
            own, other = self._next[p], self._next[q]
            # Of so few that no frequencies differ for certain, only those of q count.
            most = self._bound * (1 / math.sqrt(np_) + 1 / math.sqrt(nq))
            if most <= 1 and (abs(self._final[p] / np_ - self._final[q] / nq) >= most or any(abs((own[c][1] / np_ if c in own else 0) - (other[c][1] / nq if c in other else 0)) >= most for c in own.keys() | other.keys())):
                return None
            for c, (t, n) in other.items():
                next_, k = own.get(c, (p, 0))
                gain += n * math.log((1 - UNSEEN) * k / np_ + UNSEEN / SYMBOLS)
                work.append((next_, t))
            if gain < best:
                return None
        return gain

    def _fold(self, p: int, q: int) -> None:
        """Adds the tree below q to the state p."""
        work = [(p, q)]
        while work:
            p, q = work.pop()
            self._count[p] += self._count[q]
            self._final[p] += self._final[q]
            for c, (t, n) in self._next[q].items():
                own = self._next[p].get(c)
                if own:
                    own[1] += n
                    work.append((own[0], t))
                else:
                    self._next[p][c] = [t, n]

    def _infer(self) -> None:
        red = [0]
        while True:
            known = set(red)
            blue = [(self._count[t], -t, r, c) for r in red for c, (t, _) in self._next[r].items() if t not in known]
            if not blue:
                break
            _, q, r, c = max(blue)
            best, into = -math.inf, None
            for p in red:
                gain = self._gain(p, -q, best)
                if gain is not None and (into is None or gain > best):
                    best, into = gain, p
            if into is None:
                red.append(-q)
            else:
                self._next[r][c][0] = into
                self._fold(into, -q)
        number = {s: i for i, s in enumerate(red)}
        #: For each state the step of each character seen as (state, bits), the bits of others, and those of the end.
        self.table = []
        for s in red:
            n = self._count[s]
            bits = lambda k: -math.log2((1 - UNSEEN) * k / n + UNSEEN / SYMBOLS)  # noqa: E731, B023
            self.table.append(({c: (number[t], bits(k)) for c, (t, k) in self._next[s].items()}, bits(0), bits(self._final[s])))
        del self._count, self._final, self._next

    def bits(self, word: str) -> tuple[float, float]:
        """Minus the log likelihood of `word`, and of its end after it, to base 2."""
        s, total = 0, 0.0
        for c in word:
            steps, unseen, _ = self.table[s]
            s, cost = steps.get(c, (s, unseen))
            total += cost
        return total, self.table[s][2]


class Background:
    """Each character given the one before it, over words that are no credentials; both ends are characters too."""

    def __init__(self, words: list[str]):
        counts, totals = {}, {}
        for word in words:
            for pair in zip("\n" + word, word + "\n"):
                counts[pair] = counts.get(pair, 0) + 1
                totals[pair[0]] = totals.get(pair[0], 0) + 1
        self.pairs = {pair: -math.log2((n + 0.1) / (totals[pair[0]] + 0.1 * SYMBOLS)) for pair, n in counts.items()}
        self.others = {a: -math.log2(0.1 / (n + 0.1 * SYMBOLS)) for a, n in totals.items()}

    def bits(self, word: str) -> float:
        return sum(self.pairs[pair] if pair in self.pairs else self.others.get(pair[0], math.log2(SYMBOLS)) for pair in zip("\n" + word, word + "\n"))


class Formats:
    """What was learned: (name, automaton, mean bits a character, most that these are exceeded by times the root of the length) of each kind, and the background."""

    def __init__(self, kinds: dict[str, list[str]], background: list[str]):
        self.background = Background(background)
        self.kinds = []
        for name, words in sorted(kinds.items()):
            if len(words) >= LEAST_WORDS:
                halves = [Automaton(words[i::2]) for i in range(2)]
                costs = [(halves[1 - i].bits(w)[0], len(w)) for i in range(2) for w in words[i::2]]
                mean = sum(c for c, _ in costs) / sum(n for _, n in costs)
                above = sorted((c / n - mean) * math.sqrt(n) for c, n in costs)
                self.kinds.append((name, Automaton(words), mean, above[min(len(above) - 1, int(len(above) * (1 - MISSED_SHARE)))]))

    def score(self, word: str) -> tuple[str, float, bool] | None:
        """(kind that makes `word` likeliest, bits by which it is ahead of the background, whether it is taken as a credential)."""
        if not self.kinds:
            return None
        _, name, cost, end, mean, most = min((sum(bits := automaton.bits(word)), name, *bits, mean, most) for name, automaton, mean, most in self.kinds)
        ahead, n = self.background.bits(word) - cost - end, len(word)
        return name, ahead, ahead >= MARGIN and (cost / n - mean) * math.sqrt(n) <= most


def seeds(each: int = SEED_EACH) -> list[tuple[str, str]]:
    """(kind, credential): `each` drawn strings of each of FORMATS."""
    rng = np.random.default_rng(11)
    draw = lambda part: part if isinstance(part, str) else "".join(rng.choice(list(part[0]), part[1]))
    return [(name, "".join(map(draw, parts))) for name, parts in FORMATS.items() for _ in range(each)]


def learn(labelled: list[tuple[str, str]], background: list[str]) -> Formats:
    """One automaton for each kind of the labelled (kind, credential) that could be candidates."""
    kinds: dict[str, list[str]] = {}
    for kind, credential in sorted(set(labelled)):
        if CANDIDATE.fullmatch(credential):
            kinds.setdefault(kind, []).append(credential)
    return Formats(kinds, background)


def scored(text: str, base: list[tuple[int, int, str]], formats: Formats) -> list[tuple[int, int, str, float, bool]]:
    """(start, end, kind, bits ahead, adds a span) of every candidate of `text`."""
    out = []
    reach, at, order = 0, 0, sorted(base)
    for m in CANDIDATE.finditer(text) if formats.kinds else ():
        start, end = m.span()
        # Of base spans that start no later, the farthest end.
        while at < len(order) and order[at][0] <= start:
            reach = max(reach, order[at][1])
            at += 1
        name, ahead, taken = formats.score(m[0])
        out.append((start, end, name, ahead, taken and end > reach))
    return out


class _Scan:
    def __init__(self, formats):
        self.formats = formats

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formats = self.formats.value
        for batch in batches:
            rows = []
            for item in batch.column(1):
                text = item.as_py() or ""
                base = base_spans(text)
                found = scored(text, base, formats)
                spans = sorted(base + [(s, e, "format") for s, e, _, _, adds in found if adds], key=lambda s: (s[0], KINDS.index(s[2])))
                join = lambda spans: ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
                n = [sum(k == kind for _, _, k in spans) for kind in KINDS]
                rows.append((*n, hashlib.sha256(join(base).encode()).hexdigest(), join(spans), ",".join(f"{s}:{e}:{name}:{ahead:.1f}" for s, e, name, ahead, _ in found)))
            columns = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], ["doc_id", "n_assign", "n_access", "n_hex", "n_format", "base_sha256", "spans", "candidates"])


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, word): credentials, and under the kind `word` the words and numbers outside them."""
    for batch in batches:
        found = []
        for item in batch.column(0):
            text = item.as_py() or ""
            found += [x for x in credentials(text) if len(x[1]) <= MOST_LABEL]
            at = 0
            for start, end, _ in [*base_spans(text), (len(text), len(text), "")]:
                if start > at:
                    found += [("word", w) for w in set(WORD.findall(text, at, start))]
                at = max(at, end)
        found = sorted(set(found))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([c for _, c in found], pa.string())], ["kind", "word"])


def labelled_sample(docs: DataFrame, text_col: str = "text", rows: int = SAMPLE_ROWS, each: int = SAMPLE_EACH, words: int = SAMPLE_WORDS) -> tuple[list[tuple[str, str]], list[str]]:
    """Labelled credentials, at most `each` of a kind, and at most `words` background words, all distinct, from about `rows` rows chosen by hash of the text."""
    ship(docs.sparkSession)
    total = docs.count()
    text = F.col(text_col).cast("string")
    some = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(max(1, total // rows)).cast("long")) == 0)
    found = materialise(some.mapInArrow(_label, "kind string, word string").distinct().withColumn("at", F.xxhash64("word")), "labelled")
    least = lambda kind, n: [(r["kind"], r["word"]) for r in found.where(F.col("kind") == kind).orderBy("at", "word").limit(n).collect()]
    labelled = [x for kind in KINDS[:3] for x in least(kind, each)]
    background = [w for _, w in least("word", words)]
    release(found)
    return labelled, background


def scan(docs: DataFrame, formats: Formats, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_assign, n_access, n_hex, n_format, base_sha256, spans, and candidates, each start:end:kind:bits ahead."""
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(formats)
    return own.mapInArrow(_Scan(shared), f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_format long, base_sha256 string, spans string, candidates string")
