"""Abusive, hateful or sexually explicit language: a linear-chain conditional random field over the tokens of passages.

Reviews flag whole documents, so token labels come first: a passage model is fitted to the flags by multiple-instance
rounds (in a flagged document the passages that explain the flag are positive, in others none is; documents whose flag no
passage explains, and passages sure against their flag, are set aside as wrong flags); in positive passages the tokens
that carry the evidence for it are labelled, the others of the passage are not. The field is then fitted to these tokens,
from all passages of the reviewed documents (equal harmless ones as one of their joint weight). Spans are the runs of
tokens whose forward-backward marginal reaches the threshold, and a document's score is the largest mean of a span
(without any, the largest chance that a passage has an offending token, which is below the threshold or set just below it).

Defined results: null, empty and blank texts score 0 without spans; texts are taken whole; repeated rows are scored each;
of several reviews the largest share decides, null flags don't count; without positive reviews no document is offending.
The field is fitted on at most ``max_reviews`` reviewed documents (the smallest hashes of doc_id) of at most ``max_chars``
characters together; all documents are scored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PASSAGE = re.compile(r"[^\n。！？.!?]*(?:[.!?](?!\s|$)[^\n。！？.!?]*)*(?:[。！？]+|[.!?]+(?=\s|$)|\n|$)")
TOKEN = re.compile(r"(?<!\w)\w(?: \w){2,}(?!\w)|[一-鿿]|[^\W_一-鿿][\w@$!*+|­​‌‍]*(?:['’-][\w@$*]+)*|[@$*][\w@$*]+|[^\w\s]")
LEET = str.maketrans("014357@$!|+", "oiaestasilt")
#: A speaker's name before a message says nothing about the message.
SPEAKER = re.compile(r"\s*(?:>\s*)?(?:\*\*[^*\n]{1,60}\*\*(?: \([^)\n]{1,20}\))?|[\w.-]{1,30}):\s+")
#: Tags of HTML.
TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?: [^<>\n]*)?/?>")
#: Cyrillic letters that look like Latin ones.
ALIKE = str.maketrans("аеорсухіѕјһкмтн", "aeopcyxisjhkmth")
JOINERS = re.compile("[­​‌‍ ]")
#: Cells (passages times tokens) that forward-backward holds at once; characters that are read at once.
CELLS, CHARS = 400_000, 1_000_000
#: Spellings a worker keeps.
SPELLINGS = 300_000
#: A passage of more tokens than the first is read in windows of the second, each beginning so many tokens after the one before.
LONG, WINDOW, STRIDE = 32, 12, 6
#: The share of a passage's largest log-odds from which a token carries its evidence.
PART = 0.25
SPREAD = re.compile(r"\w(?:[_.-]\w){2,}")
BITS = 20
MASK = np.uint64((1 << BITS) - 1)
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))

def normal(token: str) -> str:
    """A token in one spelling: case, width, joiners, spaced letters and look-alike signs undone; numbers as '#'."""
    t = JOINERS.sub("", unicodedata.normalize("NFKC", token)).lower()
    if SPREAD.fullmatch(t):
        t = t[::2]
    if not any(c.isalpha() for c in t):
        return "#" if any(c.isdigit() for c in t) else t
    core = t.rstrip("!|+")
    if not core.isascii() and re.search("[a-z]", core):
        core = core.translate(ALIKE)
    if any(c in "014357@$!|+" for c in core) and not re.fullmatch(r"[a-z]?\d+[a-z]{0,3}|\d+e-?\d+", core):
        core = core.translate(LEET)
    return core


def skeleton(word: str) -> str:
    """Consonants of a longer word, so a vowel behind a sign doesn't hide it."""
    s = re.sub(r"[aeiouyäöüéèê*@\W\d_]", "", word)
    return s if len(s) >= 3 and word.isascii() else ""


def untagged(text: str) -> str:
    """The text with blanks for tags, which say nothing; all else keeps its place."""
    return TAG.sub(lambda m: " " * len(m.group()), text) if "<" in text else text


def passages(text: str) -> Iterator[tuple[int, int]]:
    for m in PASSAGE.finditer(text):
        if m.end() > m.start() and not m.group().isspace():
            yield m.start(), m.end()


def shape(raw: str) -> str:
    """What stands for a word that the training texts don't have: names and odd spellings look alike."""
    kind = "name" if raw[:1].isupper() and raw[1:].islower() else "upper" if raw.isupper() else "word"
    return f"<{kind}>" if raw.isalpha() else "<odd>"


class Reader(dict):
    """Tokens of passages as places in tables of codes; a dict of the spellings met so far and their places.

    Words outside ``known`` are read as their shape; their skeletons stay.
    """

    def __init__(self, known: set[int] | None = None):
        super().__init__()
        self.known = known
        self.words: list[int] = []
        self.skeletons: list[int] = []

    def _word(self, raw: str, word: str) -> int:
        code = zlib.crc32(word.encode("utf-8", "replace"))
        return code if self.known is None or code in self.known else zlib.crc32(shape(raw).encode())

    def __missing__(self, raw: str) -> int:
        word = normal(raw)
        skel = skeleton(word)
        self.words.append(self._word(raw, word))
        self.skeletons.append(zlib.crc32(skel.encode()) if skel else 0)
        out = self[raw] = len(self.words) - 1
        return out

    def restrict(self, known: set[int]) -> None:
        """Read the spellings met so far anew with ``known``; their places stay."""
        self.known = known
        self.words = [self._word(raw, normal(raw)) for raw in self]

    def codes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, skeleton) codes of tokens by their places."""
        return np.array(self.words, np.uint64)[at], np.array(self.skeletons, np.uint64)[at]

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place of each token, first token of each passage, document of each passage, start and end of each); windows of long passages stand for them."""
        if len(self) > SPELLINGS:
            self.clear()
            self.words, self.skeletons = [], []
        codes: list[int] = []
        starts, owners, spans = [], [], []
        code, find, speaker, add = self.__getitem__, TOKEN.findall, SPEAKER.match, codes.extend
        for d, text in enumerate(texts):
            if not text:
                continue
            text = untagged(text)
            for a, b in passages(text):
                said = speaker(text, a, b)
                if said:
                    a = said.end()
                tokens = find(text, a, b)
                if len(tokens) > LONG:
                    where = [m.span() for m in TOKEN.finditer(text, a, b)]
                    for at in range(0, len(tokens) - WINDOW + STRIDE, STRIDE):
                        starts.append(len(codes))
                        owners.append(d)
                        own = where[at : at + WINDOW]
                        spans.append((own[0][0], own[-1][1]))
                        add(map(code, tokens[at : at + WINDOW]))
                elif tokens:
                    starts.append(len(codes))
                    owners.append(d)
                    spans.append((a, b))
                    add(map(code, tokens))
        return np.array(codes, np.int64), np.array(starts, np.int64), np.array(owners, np.int64), np.array(spans, np.int64).reshape(-1, 2)


def features(word: np.ndarray, skel: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(local features of each token, features that the whole passage shares), as rows of the weight table."""
    n = len(word)
    first = np.zeros(n, bool)
    first[starts] = True
    last = np.zeros(n, bool)
    last[starts[1:] - 1] = True
    if n:
        last[-1] = True
    prev, nxt = np.empty_like(word), np.empty_like(word)
    prev[1:], nxt[:-1] = word[:-1], word[1:]
    prev[first], nxt[last] = 1, 2
    prev2 = np.empty_like(word)
    prev2[1:] = prev[:-1]
    prev2[first] = 3
    with np.errstate(over="ignore"):
        h = lambda k, *xs: _fold(k, xs)
        local = np.stack([h(1, word), h(2, prev, word), h(3, word, nxt), h(4, prev2, prev, word), h(5, np.where(skel > 0, skel, word))], 1)
        shared = np.stack([h(11, word), h(12, prev, word)], 1)
    return local, shared


def _fold(kind: int, xs: tuple[np.ndarray, ...], bits: int = BITS) -> np.ndarray:
    out = np.uint64(kind) * MIX[1]
    for x in xs:
        out = (out ^ x) * MIX[0]
        out = out ^ (out >> np.uint64(29))
    return out * MIX[2] if bits == 64 else ((out * MIX[2]) >> np.uint64(40) & MASK).astype(np.int64)


class Field:
    """A two-state linear-chain field: weights of hashed features, transitions, and passage-wide features."""

    def __init__(self):
        self.w = np.zeros(1 << BITS, np.float32)
        self.bias = -3.0
        self.move = np.array([[1.0, -1.0], [-1.0, 1.0]])
        self.known: set[int] | None = None

    def emissions(self, local, shared, starts, lengths) -> np.ndarray:
        own = self.w[local].sum(1)
        whole = np.add.reduceat(self.w[shared].sum(1), starts) / np.sqrt(lengths) if len(starts) else np.zeros(0)
        return own + np.repeat(whole, lengths) + self.bias / 4

    def marginals(self, e: np.ndarray, starts: np.ndarray, lengths: np.ndarray, least: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability of the offending state for each token, expected moves summed, chance of each passage to have any), by forward-backward.

        A passage with a chance below ``least`` has no token above it: its tokens are given 0 without the way back.
        """
        n = len(starts)
        out, moves, chance = np.zeros(len(e)), np.zeros((2, 2)), np.zeros(n)
        order, end = np.argsort(-lengths, kind="stable"), 0
        while end < n:  # the longest first; a batch has a bounded number of cells, however long a passage is
            at, t = end, int(lengths[order[end]])
            end = at + max(1, min(4096, CELLS // t))
            part = order[at:end]
            ls = lengths[part]
            index = np.minimum(starts[part][:, None] + np.arange(t), len(e) - 1)
            valid = np.arange(t) < ls[:, None]
            x = np.where(valid, e[index], 0.0)
            a = np.zeros((t, len(part), 2))
            a[0, :, 1] = x[:, 0] + self.bias
            for i in range(1, t):
                m = a[i - 1][:, :, None] + self.move
                a[i] = np.logaddexp(m[:, 0], m[:, 1])
                a[i, :, 1] += x[:, i]
                a[i] = np.where(valid[:, i, None], a[i], a[i - 1])
            z = np.logaddexp(a[-1, :, 0], a[-1, :, 1])
            chance[part] = 1 - np.exp(np.minimum((ls - 1) * self.move[0, 0] - z, 0))
            if least:
                go = np.flatnonzero(chance[part] >= least)
                if not len(go):
                    continue
                part, ls, index, valid, x, z, a = part[go], ls[go], index[go], valid[go], x[go], z[go], a[:, go]
            b = np.zeros((len(part), 2))
            for i in range(t - 1, -1, -1):
                p = np.exp(np.minimum(a[i] + b - z[:, None], 0))
                ok = valid[:, i]
                out[index[ok, i]] = p[ok, 1]
                if i:
                    emit = np.stack([np.zeros(len(part)), x[:, i]], 1) + b
                    joint = a[i - 1][:, :, None] + self.move + emit[:, None, :]
                    moves += np.exp(np.minimum(joint - z[:, None, None], 0))[ok].sum(0)
                    b = np.where(ok[:, None], np.logaddexp(self.move[:, 0] + emit[:, :1], self.move[:, 1] + emit[:, 1:]), b)
        return out, moves, chance

    def fit(self, local, shared, starts, labels: np.ndarray, weight: np.ndarray, epochs: int = 4, batch: int = 512, rate: float = 0.15, decay: float = 1e-5, seed: int = 7) -> None:
        """Adagrad on the log-likelihood; ``labels`` are those of the tokens, ``weight`` that of each passage's tokens."""
        lengths = np.diff(np.append(starts, len(local)))
        rng, seen, move_seen, bias_seen = np.random.default_rng(seed), np.full(1 << BITS, 1.0, np.float32), np.ones((2, 2)), 1.0
        for _ in range(epochs):
            order = rng.permutation(len(starts))
            for at in range(0, len(order), batch):
                part = np.sort(order[at : at + batch])
                ls = lengths[part]
                token = np.repeat(starts[part] - np.append(0, np.cumsum(ls)[:-1]), ls) + np.arange(ls.sum())
                begin = np.append(0, np.cumsum(ls)[:-1])
                lo, sh = local[token], shared[token]
                y, v = labels[token], np.repeat(weight[part], ls)
                e = self.emissions(lo, sh, begin, ls)
                p, moves, _ = self.marginals(e, begin, ls)
                g = (p - y) * v
                passage = np.add.reduceat(g, begin) / np.sqrt(ls)
                index = np.concatenate([lo.ravel(), sh.ravel()])
                value = np.concatenate([np.repeat(g, lo.shape[1]), np.repeat(np.repeat(passage, ls), sh.shape[1])])
                rows, where = np.unique(index, return_inverse=True)
                grad = (np.bincount(where, value) + decay * batch * self.w[rows]).astype(np.float32)
                seen[rows] += grad**2
                self.w[rows] -= rate * grad / np.sqrt(seen[rows])
                on, inner = y.astype(int), np.ones(len(y), bool)
                inner[begin] = False
                up = np.bincount((2 * np.append(0, on[:-1]) + on)[inner], minlength=4).reshape(2, 2).astype(float)
                step = (moves - up) / max(1, len(part))
                move_seen += step**2
                self.move -= rate * step / np.sqrt(move_seen)
                slope = float(g[begin].sum() + g.sum() / 4) / max(1, len(part))
                bias_seen += slope**2
                self.bias -= rate * slope / bias_seen**0.5


def _distinct(x: np.ndarray) -> np.ndarray:
    """Distinct values in order, by sorting."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


class PassageModel:
    """Probability of each passage from its words and word pairs, by logistic regressions fitted to the documents of the other folds.

    Every fit goes on from the weights of the one before.
    """

    def __init__(self, shared: np.ndarray, lengths: np.ndarray, owner: np.ndarray, folds: int = 6):
        n = len(lengths)
        feats, cols = np.unique(shared.ravel(), return_inverse=True)
        pair = _distinct(np.repeat(np.repeat(np.arange(n), lengths), shared.shape[1]) * len(feats) + cols)
        rows, self.cols = pair // len(feats), pair % len(feats)
        self.begin = np.searchsorted(rows, np.arange(n))
        self.size = (np.sqrt(np.bincount(rows, minlength=n)) / 3).astype(np.float32)
        order = np.argsort(self.cols, kind="stable")
        self.rows, self.column = rows[order], np.searchsorted(self.cols[order], np.arange(len(feats)))
        self.fold = owner % folds
        self.fits = [(np.zeros(len(feats), np.float32), -2.0, np.full(len(feats), 1e-3, np.float32)) for _ in range(folds)]

    def chance(self, w: np.ndarray, b: float) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[self.cols], self.begin) / self.size + b, -30, 30)))

    def fit(self, label: np.ndarray, weight: np.ndarray, steps: int, rate: float = 0.5) -> np.ndarray:
        out = np.zeros(len(label))
        for k, (w, b, seen) in enumerate(self.fits):
            v = (weight * (self.fold != k)).astype(np.float32)
            for _ in range(steps):
                g = (self.chance(w, b) - label) * v
                grad = np.add.reduceat((g / self.size).astype(np.float32)[self.rows], self.column) + 0.02 * w
                seen += grad**2
                w -= rate * grad / np.sqrt(seen)
                b -= rate * g.sum() / max(1.0, np.abs(g).sum() * 4)
            self.fits[k] = (w, b, seen)
            out = np.where(self.fold == k, self.chance(w, b), out)
        return out


def _evidence(odds: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which tokens carry a passage's evidence: those of at least the share PART of its largest log-odds, and up to two tokens between such."""
    top = np.repeat(np.maximum.reduceat(odds, starts), lengths)
    hit = odds >= np.where(top > 0, top * PART, top)
    at = np.flatnonzero(hit)
    owner = np.repeat(np.arange(len(starts)), lengths)
    near = np.flatnonzero((np.diff(at) <= 3) & (owner[at[1:]] == owner[at[:-1]])) if len(at) else at
    for gap in (1, 2):
        x = at[near] + gap
        hit[x[x < at[near + 1]]] = True
    return hit


def train(texts: list[str], flags: list[float], rounds: int = 4) -> Field:
    """A field from reviewed documents (share of reviews that flag them)."""
    flags = np.array(flags, float)
    field = Field()
    reader = Reader()
    at, starts, owner, _ = reader.read(texts)
    lengths = np.diff(np.append(starts, len(at)))
    in_docs = _distinct(np.repeat(owner, lengths) << 32 | reader.codes(at)[0].astype(np.int64)) & ((1 << 32) - 1)
    codes, n_docs = np.unique(in_docs, return_counts=True)
    field.known = set(codes[n_docs >= 3].tolist())
    pos, neg = (flags > 0.5).sum(), (flags <= 0.5).sum()
    if not len(starts) or not pos:
        return field
    reader.restrict(field.known)
    word, skel = reader.codes(at)
    local, shared = features(word, skel, starts)
    inside = flags[owner] > 0.5
    # The first guess: how much more often a passage's rarest word or word pair stands in flagged documents than in others.
    docs_of = _distinct(np.repeat(owner, lengths).repeat(2) * (1 << BITS) + shared.ravel())
    d, f = docs_of >> BITS, docs_of & ((1 << BITS) - 1)
    up = np.bincount(f, flags[d] > 0.5, minlength=1 << BITS)
    down = np.bincount(f, flags[d] <= 0.5, minlength=1 << BITS)
    odds = np.log((up + 0.3) / (pos + 0.6)) - np.log((down + 0.3) / (neg + 0.6))
    odds *= np.minimum(1.0, np.log1p(up))
    first = np.maximum.reduceat(odds[shared].max(1), starts)
    score = 1 / (1 + np.exp(-(first - 2.5)))
    model = PassageModel(shared, lengths, owner)
    for k in range(rounds):
        best = np.zeros(len(flags))
        np.maximum.at(best, owner, score)
        positive = inside & (score > 0.5) & (score >= best[owner] * 0.5)
        weight = np.where(inside & ~positive & (score > 0.1), 0.0, np.where(positive, 2.0, 1.0))
        weight = np.where(~inside & (score > 0.98) & (k > 0), 0.3, weight)
        score = model.fit(positive.astype(float), weight, 20 if k == 0 else 6)
    label = inside & (score > 0.5)
    weight = np.where(inside & (score > 0.1) & (score <= 0.5), 0.0, np.where(~inside & (score > 0.98), 0.3, 1.0))
    marked = np.repeat(label, lengths)
    marked &= _evidence(odds[shared].max(1), starts, lengths)
    # Equal harmless passages are one of their joint weight.
    with np.errstate(over="ignore"):
        place = np.arange(len(word), dtype=np.uint64) - np.repeat(starts, lengths).astype(np.uint64)
        same = np.add.reduceat(_fold(20, (word, skel, place), 64), starts)
    same = np.where(label, np.arange(len(starts), dtype=np.uint64), same)
    _, chosen, at = np.unique(same, return_index=True, return_inverse=True)
    weight = np.bincount(at, weight, minlength=len(chosen))
    chosen, weight = chosen[weight > 0], weight[weight > 0]
    ls = lengths[chosen]
    token = np.repeat(starts[chosen] - np.append(0, np.cumsum(ls)[:-1]), ls) + np.arange(ls.sum())
    field.fit(local[token], shared[token], np.append(0, np.cumsum(ls)[:-1]), marked[token].astype(float), weight)
    return field


def assess(field: Field, reader: Reader, texts: list[str], least: float = 0.2) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """(score of each text, offending spans with their mean probability)."""
    scores, spans = np.zeros(len(texts)), [[] for _ in texts]
    at, starts, owner, place = reader.read(texts)
    if not len(starts):
        return scores, spans
    local, shared = features(*reader.codes(at), starts)
    lengths = np.diff(np.append(starts, len(at)))
    p, _, chance = field.marginals(field.emissions(local, shared, starts, lengths), starts, lengths, least)
    np.maximum.at(scores, owner, np.minimum(chance, np.nextafter(least, 0)))
    over = p >= least
    for i in np.flatnonzero(np.logical_or.reduceat(over, starts)):
        text, (a, b) = untagged(texts[owner[i]]), place[i]
        where = [m.span() for m in TOKEN.finditer(text, a, b)]
        own = slice(starts[i], starts[i] + lengths[i])
        edge = np.flatnonzero(np.diff(np.concatenate([[0], over[own], [0]]).astype(int)))
        for first, end in zip(edge[::2], edge[1::2]):
            mean = float(p[own][first:end].mean())
            spans[owner[i]].append((where[first][0], where[end - 1][1], mean))
            scores[owner[i]] = max(scores[owner[i]], mean)
    for d in np.unique(owner[np.logical_or.reduceat(over, starts)]):
        whole = []
        for a, b, mean in sorted(spans[d]):  # windows of a passage overlap
            if whole and a < whole[-1][1]:
                whole[-1] = (whole[-1][0], max(b, whole[-1][1]), max(mean, whole[-1][2]))
            else:
                whole.append((a, b, mean))
        spans[d] = whole
    return scores, spans


def reviewed(documents: DataFrame, reviews: DataFrame, max_reviews: int = 20_000, max_chars: int = 20_000_000) -> DataFrame:
    """doc_id, text and flag (share of its reviews) of at most ``max_reviews`` reviewed documents, by hash of doc_id, of ``max_chars`` characters together.

    A document that would go beyond the characters is left out, and so are those after it.
    """
    flags = reviews.where("flagged is not null").groupBy("doc_id").agg(F.avg(F.col("flagged").cast("double")).alias("flag"))
    flags = flags.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_reviews)  # so both sides that are broadcast have at most max_reviews short rows
    texts = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(flags), "doc_id").withColumn("size", F.length("text"))
    sizes = texts.select("doc_id", "size", F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")).alias("so_far"))  # at most max_reviews rows
    return texts.join(F.broadcast(sizes.where(F.col("so_far") <= max_chars).select("doc_id")), "doc_id", "left_semi").select("doc_id", "text", "flag")


def score(documents: DataFrame, reviews: DataFrame, max_reviews: int = 20_000, max_chars: int = 20_000_000, least: float = 0.2) -> DataFrame:
    """doc_id, source, score, offending (score >= ``least``), spans (first, end in characters, probability)."""
    spark = documents.sparkSession
    sample = reviewed(documents, reviews, max_reviews, max_chars).toPandas().sort_values(["doc_id"])
    field = train(sample["text"].tolist(), sample["flag"].tolist())
    used = np.flatnonzero(field.w)
    sent = spark.sparkContext.broadcast((used.astype(np.int32), field.w[used], field.bias, field.move, np.array(sorted(field.known), np.int64)))

    @F.pandas_udf("score double, spans array<struct<first:int,end:int,p:double>>")
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Field()
        at, w, model.bias, model.move, known = sent.value
        model.w[at] = w
        reader = Reader(set(known.tolist()))
        for batch in batches:
            texts = batch.tolist()
            scores, spans = np.zeros(len(texts)), []
            at, size = 0, 0
            for i, text in enumerate(texts):
                size += len(text or "")
                if size >= CHARS or i + 1 == len(texts):
                    scores[at : i + 1], found = assess(model, reader, texts[at : i + 1], least)
                    spans += [[{"first": a, "end": b, "p": p} for a, b, p in x] for x in found]
                    at, size = i + 1, 0
            yield pd.DataFrame({"score": scores, "spans": spans})

    out = documents.select("doc_id", "source", "text").withColumn("t", tag("text"))
    return out.select("doc_id", "source", F.col("t.score").alias("score"), (F.col("t.score") >= least).alias("offending"), F.col("t.spans").alias("spans"))
