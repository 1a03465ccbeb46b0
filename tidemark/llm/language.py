"""Language ID by a linear-chain conditional random field over the words of a text.

Each run of letters is a word. Its features are its character n-grams of length 2 to 4 between boundary
marks, of which those at a mark are its affixes, and its entry in a lexicon, all hashed to weights for
each language; learned transitions tie neighbouring words. Forward-backward gives every word of a
code-switched text its language posterior. A text's language is the one with the largest posterior share
of its letters, its score that share.

Weights are learned by gradient ascent on the conditional likelihood of word labels. Training sequences
string together runs of words of differently labelled documents, so switches and their rate are seen.
The sample is bounded: about ROWS_EACH rows of each language, RUNS runs of RUN_WORDS words of each row.

Forward-backward runs on segments of SEGMENT words at once: transfer matrices of all segments, a scan
over each document's segments, then vectors inside all segments; exact for texts of any length.

A filter also asks how well a text's letters are known: the mean log probability of each letter after the two
before it, in the language the CRF gives its word. Its floor is calibrated on labelled runs that the
probabilities were not counted from, and is lower for shorter texts; gibberish and prose of a language
that no label names fall below it whatever the number of languages, code-switched prose does not.

Edges: a null text, or one without letters, is `und` with score 0; so is every text where no labelled
row can be learned from. An empty `lang` is no label and is not learned from. Ties go to the first language in alphabetical order. Rows with a null id are
held in. Rows come back one for one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.session import ship

ROWS_EACH, RUNS, RUN_WORDS = 300, 3, 24
ORDERS = (2, 3, 4)
GRAM_BITS, LEXICON_BITS = 16, 15
ROUNDS, RATE, SHRINK = 30, 0.35, 1e-6
SEGMENT = 32
#: Characters worked on at a time; longer texts are worked on alone, their features in blocks of whole words.
BLOCK_CHARS = 200_000
UNDETERMINED = "und"
MARK = 1
LEXICON_AT = len(ORDERS) << GRAM_BITS
SIZE = LEXICON_AT + (1 << LEXICON_BITS)
HELD_OUT, FOLDS = 1, 3
#: Count that each letter has after any two at least, out of LETTERS.
SMOOTH, LETTERS = 0.1, 30
#: In a filter, how many spreads of labelled runs of RUN_WORDS words a text may fall below their median; least spread.
MOST_SURPRISE, LEAST_SPREAD = 8.0, 0.05


@cache
def _letters() -> np.ndarray:
    """Lower-case code of each letter of the basic plane, 0 for what is no letter."""
    return np.array([ord(chr(i).lower()[0]) if chr(i).isalpha() else 0 for i in range(1 << 16)], np.uint32)


def _is_digit(raw: np.ndarray) -> np.ndarray:
    return (raw >= 48) & (raw <= 57)


def codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _letters()[np.minimum(raw, 0xFFFF)]
    far = raw > 0xFFFF
    if far.any():
        kinds, back = np.unique(raw[far], return_inverse=True)
        out[far] = np.array([ord(chr(k).lower()[0]) if chr(k).isalpha() else 0 for k in kinds.tolist()], np.uint32)[back]
    return out


def marked_words(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of the words with a mark before and after each, start of each word there, start of each in the text)."""
    word = letters > 0
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    begin, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    sizes = end - begin + 2
    starts = np.cumsum(sizes) - sizes
    out = np.full(int(sizes.sum()), MARK, np.uint64)
    inner = np.ones(len(out), bool)
    inner[starts] = False
    inner[starts + sizes - 1] = False
    out[inner] = letters[word]
    return out, starts, begin


def features(chars: np.ndarray, starts: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each n-gram order (feature of each position, valid positions); and each word's lexicon feature."""
    n = len(chars)
    ends = np.concatenate([starts[1:], [n]])
    left = np.repeat(ends, ends - starts) - np.arange(n)
    grams, value = [], chars.copy()
    prime = np.uint64(0x9E3779B97F4A7C15)
    for order in range(2, max(ORDERS) + 1):
        value = value * prime
        value[: n - order + 1] += chars[order - 1 :]
        if order in ORDERS:
            mixed = (value ^ value >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            grams.append(((mixed >> np.uint64(64 - GRAM_BITS)).astype(np.int64) + (ORDERS.index(order) << GRAM_BITS), left >= order))
    at = np.arange(n) - np.repeat(starts, ends - starts)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(63, prime)]))
    whole = np.add.reduceat(chars * power[at & 63], starts) if n else np.zeros(0, np.uint64)
    whole = (whole ^ whole >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
    return grams, (whole >> np.uint64(64 - LEXICON_BITS)).astype(np.int64) + LEXICON_AT


class Model:
    """Languages (sorted), feature weights SIZE x K, transition and start weights; log counts of three and of two letters, median and spread of a letter's log probability."""

    def __init__(self, languages: list[str]):
        k = len(languages)
        self.languages = languages
        self.weights, self.moves, self.start = np.zeros((SIZE, k), np.float32), np.zeros((k, k)), np.zeros(k)
        self.threes, self.twos = np.zeros((1 << GRAM_BITS, k), np.float32), np.zeros((1 << GRAM_BITS, k), np.float32)
        self.usual, self.spread = 0.0, np.inf

    def emissions(self, grams: list, lexicon: np.ndarray, starts: np.ndarray) -> np.ndarray:
        total = self.weights[lexicon].astype(np.float64)
        for ids, valid in grams:
            total += np.add.reduceat(self.weights[ids] * valid[:, None].astype(np.float32), starts, axis=0)
        return total

    def posteriors(self, emit: np.ndarray, sizes: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Word posteriors for texts of `sizes` words laid end to end (none empty); with `pairs` the expected moves."""
        k = emit.shape[1]
        local = np.exp(emit - emit.max(axis=1, keepdims=True))
        segs = -(-sizes // SEGMENT)
        first = np.cumsum(segs) - segs
        total = int(segs.sum())
        doc = np.repeat(np.arange(len(sizes)), sizes)
        pos = np.arange(len(emit)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        seg, off = first[doc] + pos // SEGMENT, pos % SEGMENT
        grid = np.ones((SEGMENT, total, k))
        real = np.zeros((SEGMENT, total), bool)
        grid[off, seg], real[off, seg] = local, True
        step, begin = np.exp(self.moves - self.moves.max()), np.exp(self.start - self.start.max())
        flow = np.broadcast_to(np.eye(k), (total, k, k)).copy()
        for t in range(SEGMENT):
            moved = flow @ step
            if t == 0:
                moved[first] = flow[first]
            new = moved * grid[t, :, None, :]
            new /= new.max(axis=(1, 2), keepdims=True)
            flow = np.where(real[t][:, None, None], new, flow)
        # What comes into each segment; a text's first word is entered from the start weights, without a move.
        inward = np.zeros((total, k))
        inward[first] = begin
        outward = np.ones((total, k))
        order = np.argsort(-segs, kind="stable")
        longest = int(segs.max())
        counts = np.searchsorted(-segs[order], -np.arange(longest), side="left")
        for s in range(1, longest):
            at = first[order[: counts[s]]] + s
            v = np.einsum("ij,ijk->ik", inward[at - 1], flow[at - 1])
            inward[at] = v / np.abs(v).max(axis=1, keepdims=True)
        last = first + segs - 1
        for s in range(1, longest):
            at = last[order[: counts[s]]] - s
            v = np.einsum("ijk,ik->ij", flow[at + 1], outward[at + 1])
            outward[at] = v / v.max(axis=1, keepdims=True)
        alphas = np.empty((SEGMENT, total, k))
        now = inward
        for t in range(SEGMENT):
            moved = now @ step
            if t == 0:
                moved[first] = begin
            new = moved * grid[t]
            new /= new.sum(axis=1, keepdims=True)
            now = np.where(real[t][:, None], new, now)
            alphas[t] = now
        now = outward
        marg = np.empty((SEGMENT, total, k))
        moves = np.zeros((k, k)) if pairs else None
        for t in range(SEGMENT - 1, -1, -1):
            both = alphas[t] * now
            marg[t] = both / both.sum(axis=1, keepdims=True)
            back = (grid[t] * now) @ step.T
            if pairs:
                before = alphas[t - 1] if t else inward
                joint = before[:, :, None] * step * (grid[t] * now)[:, None, :]
                use = real[t].copy()
                if t == 0:
                    use[first] = False
                joint = joint[use]
                moves += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            back /= np.abs(back).max(axis=1, keepdims=True)
            now = np.where(real[t][:, None], back, now)
        return marg[off, seg], moves

    def knowledge(self, grams: list, starts: np.ndarray) -> np.ndarray:
        """Log probability of each word's letters in each language."""
        (twos, _), (threes, valid) = grams[ORDERS.index(2)], grams[ORDERS.index(3)]
        each = self.threes[threes - (ORDERS.index(3) << GRAM_BITS)] - self.twos[twos - (ORDERS.index(2) << GRAM_BITS)]
        return np.add.reduceat(each * valid[:, None].astype(np.float32), starts, axis=0)

    def read(self, chars: np.ndarray, starts: np.ndarray, surprise: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Emissions of each word, and with `surprise` the log probability of its letters; BLOCK_CHARS letters at a time, which bounds what features take."""
        n, k = len(starts), len(self.languages)
        emit, known = np.empty((n, k)), np.empty((n, k)) if surprise else None
        ends = np.concatenate([starts[1:], [len(chars)]])
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(ends, starts[a] + BLOCK_CHARS, side="right")))
            own = starts[a:b] - starts[a]
            grams, lexicon = features(chars[starts[a] : ends[b - 1]], own)
            emit[a:b] = self.emissions(grams, lexicon, own)
            if surprise:
                known[a:b] = self.knowledge(grams, own)
            a = b
        return emit, known

    def label(self, texts: list[str], surprise: bool = False) -> list[tuple]:
        """(language, score) of each text; with `surprise` also how many spreads its letters are less probable than usual."""
        out: list = [(UNDETERMINED, 0.0, np.inf)[: 2 + surprise]] * len(texts)
        if not self.languages:
            return out
        joined = "\n".join(texts)
        chars, starts, begin = marked_words(codes(joined))
        if not len(starts):
            return out
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        doc = np.searchsorted(np.cumsum(lengths), begin, side="right")
        some, sizes = np.unique(doc, return_counts=True)
        emit, letters = self.read(chars, starts, surprise)
        marg, _ = self.posteriors(emit, sizes)
        weight = np.diff(np.concatenate([starts, [len(chars)]])) - 2
        firsts = np.cumsum(sizes) - sizes
        share = np.add.reduceat(marg * weight[:, None], firsts, axis=0)
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        for d, b, s in zip(some.tolist(), best.tolist(), share.max(axis=1).tolist()):
            out[d] = (self.languages[b], min(1.0, s))
        if surprise:
            # Letters that touch digits are of keys and numbers, not prose, and count only where there are no others.
            raw = np.frombuffer(f"\n{joined}\n".encode("utf-32-le", "surrogatepass"), np.uint32)
            prose = ~(_is_digit(raw[begin]) | _is_digit(raw[begin + weight + 1]))
            prose |= np.repeat(np.add.reduceat(prose.astype(np.int64), firsts) == 0, sizes)
            known = np.add.reduceat((marg * letters).sum(axis=1) * prose, firsts) / np.add.reduceat(weight * prose, firsts)
            sizes = np.add.reduceat(prose.astype(np.int64), firsts)
            for d, x in zip(some.tolist(), ((self.usual - known) / (self.spread * np.sqrt(np.maximum(1, RUN_WORDS / sizes)))).tolist()):
                out[d] += (x,)
        return out


def _log_counts(grams: list, labels: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Log smoothed counts of three letters, and of the two they start with, in each language; of each hash."""
    (twos, _), (threes, valid) = grams[ORDERS.index(2)], grams[ORDERS.index(3)]
    of = lambda ids, order, least: np.log(np.stack([np.bincount((ids - (ORDERS.index(order) << GRAM_BITS))[valid & (labels == c)], minlength=1 << GRAM_BITS) for c in range(k)], axis=1) + least).astype(np.float32)
    return of(threes, 3, SMOOTH), of(twos, 2, SMOOTH * LETTERS)


def _calibrate(model: Model, runs: list[tuple[str, str]]) -> None:
    """Letter counts of all runs; the median and spread of a run's letters are those under the counts of the other half of the runs."""
    runs = [r for r in runs if len(marked_words(codes(r[1]))[1])]
    if not runs:
        return
    chars, starts, begin = marked_words(codes("\n".join(run for _, run in runs)))
    grams, _ = features(chars, starts)
    words = np.searchsorted(np.cumsum([len(run) + 1 for _, run in runs]), begin, side="right")
    letters = np.diff(np.concatenate([starts, [len(chars)]]))
    langs = np.array([model.languages.index(lang) for lang, _ in runs])
    own, run = np.repeat(langs[words], letters), np.repeat(words, letters)
    known = np.empty(len(runs))
    first = np.searchsorted(words, np.arange(len(runs)))
    for half in range(2):
        model.threes, model.twos = _log_counts(grams, np.where(run % 2 == half, own, -1), len(model.languages))
        each = np.add.reduceat(model.knowledge(grams, starts)[np.arange(len(words)), langs[words]], first) / np.add.reduceat(letters - 2, first)
        known[1 - half :: 2] = each[1 - half :: 2]
    model.threes, model.twos = _log_counts(grams, own, len(model.languages))
    sizes = np.bincount(words, minlength=len(runs))
    model.usual = float(np.median(known))
    model.spread = max(LEAST_SPREAD, 1.4826 * float(np.median(np.abs(known - model.usual) / np.sqrt(RUN_WORDS / np.minimum(RUN_WORDS, sizes)))))


def train(samples: list[tuple[str, str]], rounds: int = ROUNDS) -> Model:
    """A model from (language, run of words) samples, by adaptive gradient ascent over all sequences."""
    samples = sorted(s for s in set(samples) if s[0] and s[1])
    model = Model(sorted({lang for lang, _ in samples}))
    if not samples:
        return model
    rng = np.random.default_rng(7)
    order = rng.permutation(len(samples)).tolist()
    texts, labels, sizes = [], [], []
    _calibrate(model, [samples[i] for i in order])
    at = 0
    while at < len(order):
        take = int(rng.integers(1, 4))
        runs = [samples[i] for i in order[at : at + take]]
        at += take
        size = 0
        for lang, run in runs:
            n = len(marked_words(codes(run))[1])
            labels += [model.languages.index(lang)] * n
            size += n
        if size:
            texts += [run for _, run in runs]
            sizes.append(size)
    chars, starts, _ = marked_words(codes("\n".join(texts)))
    grams, lexicon = features(chars, starts)
    spread = np.repeat(np.arange(len(starts)), np.diff(np.concatenate([starts, [len(chars)]])))
    ids = np.concatenate([g[v] for g, v in grams] + [lexicon])
    words = np.concatenate([spread[v] for _, v in grams] + [np.arange(len(starts))])
    k, sizes_ = len(model.languages), np.array(sizes)
    truth = np.eye(k)[labels]
    firsts = np.cumsum(sizes_) - sizes_
    inner = np.ones(len(labels), bool)
    inner[firsts] = False
    labels_ = np.array(labels)
    seen = np.zeros((k, k))
    np.add.at(seen, (labels_[np.nonzero(inner)[0] - 1], labels_[inner]), 1)
    sums = [np.full(model.weights.shape, 1e-3, np.float32), np.full((k, k), 1e-3), np.full(k, 1e-3)]
    for _ in range(rounds):
        marg, moves = model.posteriors(model.emissions(grams, lexicon, starts), sizes_, pairs=True)
        error = truth - marg
        slope = np.stack([np.bincount(ids, error[words, c], SIZE) for c in range(k)], axis=1).astype(np.float32)
        for value, grad, total in zip((model.weights, model.moves, model.start), (slope - SHRINK * len(labels) * model.weights, seen - moves, error[firsts].sum(axis=0)), sums):
            total += grad * grad
            value += (RATE * grad / np.sqrt(total)).astype(value.dtype)
    return model


class _Runs:
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, runs = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.split()
                for r in range(RUNS):
                    at = (len(words) * r // RUNS) if len(words) > RUNS * RUN_WORDS else r * RUN_WORDS
                    run = " ".join(w[:100] for w in words[at : at + RUN_WORDS])
                    if run:
                        langs.append(lang)
                        runs.append(run)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(runs, pa.string())], ["lang", "run"])


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def labelled_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """Runs of words of about ROWS_EACH rows of each language, chosen by a hash of the id, none of them held out."""
    ship(docs.sparkSession)
    own = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & (F.col(lang_col) != "") & F.col(text_col).isNotNull())
    own = own.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    every = F.element_at(F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, max(1, n // ROWS_EACH))]), F.col("lang"))
    some = own.where(F.pmod(F.xxhash64("id"), every.cast("long")) == 0).select("lang", "text")
    return [(r["lang"], r["run"]) for r in some.mapInArrow(_Runs(), "lang string, run string").collect()]


class _Label:
    """Adds lang_pred and score, with `surprise` that too, to batches whose last column is the text, which is left out."""

    def __init__(self, model, surprise: bool = False):
        self.model, self.surprise = model, surprise

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = self.model.value
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(batch.num_columns - 1).to_pylist()]
            found: list = []
            held, size = [], 0
            for text in texts:
                if held and size + len(text) > BLOCK_CHARS:
                    found += model.label(held, self.surprise)
                    held, size = [], 0
                held.append(text)
                size += len(text)
            if held:
                found += model.label(held, self.surprise)
            names = ["lang_pred", "score", "surprise"][: 2 + self.surprise]
            labels = [pa.array([x[i] for x in found], pa.float64() if i else pa.string()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *labels], [*batch.schema.names[:-1], *names])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, lang_pred, score. Narrow: no shuffle."""
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return own.mapInArrow(_Label(shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def in_a_language(docs: DataFrame, model: Model, text_col: str = "text", most: float = MOST_SURPRISE, allowed: list[str] | None = None) -> DataFrame:
    """The rows of `docs`, all columns, whose text has letters and is at most `most` spreads less probable than labelled prose.

    With `allowed`, a list of learned languages, also those alone whose language is one of them.
    """
    ship(docs.sparkSession)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = packed.schema["row"].dataType.simpleString()
    labelled = packed.mapInArrow(_Label(shared, surprise=True), f"row {kind}, lang_pred string, score double, surprise double")
    kept = (F.col("lang_pred") != UNDETERMINED) & (F.col("surprise") <= most)
    return labelled.where(kept if allowed is None else kept & F.col("lang_pred").isin(allowed)).select("row.*")
