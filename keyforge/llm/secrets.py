"""Secret scan: character Markov models of random strings and ordinary identifiers.

A candidate is a run of 16 or more characters of [A-Za-z0-9_+/-], with dots between
them; or of 8 to 15, if a word such as password or token with '=' or ':' names it. Two order-2
models give its log-likelihood ratio. A candidate whose ratio per character
passes a threshold chosen on held-out labelled strings (one for each length class) is a secret; so is the
longest such stretch of 16 or more characters between separators ('_', '+', '/', '.'
and '-') of another one: a secret behind a long path or name.

The models are trained from labelled samples: random strings of the kinds that keys are made
of, and ordinary ones made of words as the whole corpus writes them. A table of labelled samples of
one's own can be added.

Any other character ends a run, beyond ASCII too: quotes, spaces, dashes and
letters of other scripts. Latin letters beyond ASCII (and accents that combine) make
a word of the characters that they touch, up to the next of '_', '+', '/', '.' and '-':
that part is no candidate, what lies behind the separator is one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .common import importable, table, texts

#: Production parameters: shortest candidate, and shortest that is named as a secret; labelled strings of each class that are made; words that are drawn from the corpus' character statistics.
LEAST, NAMED, TRAIN_STRINGS, WORDS = 16, 8, 20_000, 4000
MARK = "[SECRET]"

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-+/."
_N = len(_ALPHABET) + 1  # the last is the start
_CODE = np.full(256, -1, np.int64)
_CODE[[ord(c) for c in _ALPHABET]] = np.arange(len(_ALPHABET))
_RUN = _CODE >= 0
_DOT = ord(".")
_RUN[_DOT] = False  # one between two of the others is part of a run
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_WORD_CODE = np.where(_LETTER, _CODE, _N - 1).astype(np.int32)  # the last begins and ends a word
_OTHER = ~_LETTER & (_RUN | (np.arange(256) >= 128))
#: What names a short secret, and what follows the '=' or ':' after it.
_NAME = re.compile(rb"""(?i)(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|access|private|auth|secret)[_-]?key)["']?[ \t]{0,3}\Z""")
_VALUE = re.compile(rb"""[:=]>?[ \t]{0,3}["'`]?([A-Za-z0-9_+/-]+(?:\.[A-Za-z0-9_+/-]+)*)""")
_SEPARATOR = np.isin(np.arange(256), [ord(c) for c in "_+/-."])
#: Ranges of the Latin letters beyond ASCII, and of combining accents; of up to three bytes each.
_LATIN = np.array([(0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x2AF), (0x300, 0x36F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA722, 0xA787), (0xA78B, 0xA7FF), (0xAB30, 0xAB5A), (0xFB00, 0xFB06)])
_WORDS = (
    "account action active address agent alias amount archive array asset attribute audit author average backup balance base batch begin binary block body branch bucket buffer build bundle button cache calendar callback cancel "
    "category change channel check child class client cluster code collection column command comment commit common component config connection container content context control convert cookie copy count counter create "
    "current customer data database date default delete delta description device dictionary directory discount display document domain download driver edge editor element email enable encode engine entity entry error event "
    "execute export extra factory feature fetch field file filter final find first flag folder format forward frame function gateway generate get global graph group handle handler header height history host image import index "
    "info input insert instance integer interface internal invoice item iterator job join keyword label language large last layer layout length level library limit line link list listener load local location lock logger main "
    "manager mapping master match matrix maximum memory merge message method metric minimum mode model module monitor month mutable name network next node normal note notify null number object offset open operator option order "
    "output owner package page parameter parent parse partition path pattern payment percent period plugin point pointer policy pool port position prefix price primary print private process product profile project property "
    "provider proxy public publish query queue random range rate reader record recover region register relation release remote remove render replace report request reset resource response result retry return review role root "
    "route rule runner sample scale schedule schema scope score screen script search section segment select sender sequence serial server service session setting shape shared shipping signal simple size snapshot socket sort "
    "source space stage standard start state static status step storage store stream string style subject submit suffix summary support switch symbol sync system table target task template temporary test text thread time title "
    "tool total trace track transaction transfer transform tree trigger type unique unit update upload user util valid value variable vector vendor verify version video view visible volume warning weight width window worker write"
).split()


_B62, _HEX, _DIGITS = _ALPHABET[:62], "0123456789abcdef", "0123456789"
#: Kinds of random strings: characters, least and most of them, what stands before.
KINDS = {
    "hex": (_HEX, 16, 64, ""), "upper hex": (_HEX.upper(), 16, 64, ""), "letters and digits": (_B62, 16, 64, ""), "upper": (_ALPHABET[:26] + _DIGITS, 16, 32, ""), "cloud key": (_ALPHABET[:26] + "234567", 16, 20, "AKIA"),
    "forge token": (_B62, 20, 40, "ghp_"), "payment key": (_B62, 20, 40, "sk_live_"), "lower": (_ALPHABET[26:62], 16, 40, ""), "url base64": (_B62 + "-_", 20, 64, ""), "base64": (_B62 + "+/", 20, 64, ""), "dotted": (_B62 + "-_", 30, 64, ""),
}


def random_strings(rng: np.random.Generator, n: int, kinds: Sequence[str] = tuple(KINDS), short: bool = False) -> list[str]:
    """Strings as keys, tokens and passwords are made, of these kinds in turn; short: NAMED to LEAST - 1 characters."""
    out = []
    for i in range(n):
        kind = kinds[i % len(kinds)]
        chars, lo, hi, head = KINDS[kind]
        if short:
            lo, hi, head = NAMED, LEAST - 1, ""
        s = "".join(rng.choice(list(chars), rng.integers(lo, hi + 1)))
        if kind == "dotted" and not short:
            at = len(s) // 3
            s = ".".join((s[:at].strip("-_") or "A", s[at : 2 * at], s[2 * at :]))
        out.append(head + s)
    return out


def ordinary_strings(rng: np.random.Generator, n: int, words: list[str], short: bool = False) -> list[str]:
    """Identifiers, paths, hosts, files, versions, dates, numbers of 16 to 20 digits, one character repeated, and long words as they occur in texts and code.

    short: of NAMED to LEAST - 1 characters.
    """
    words = [*_WORDS, *words]
    out = []
    for i in range(n):
        w = [words[k] for k in rng.integers(0, len(words), rng.integers(1, 3) if short else rng.integers(2, 6))]
        kind = i % 14
        if kind == 0:
            s = "_".join(w)
        elif kind == 1:
            s = w[0] + "".join(x.capitalize() for x in w[1:])
        elif kind == 2:
            s = "-".join(w)
        elif kind == 3:
            s = "/".join(w)
        elif kind == 4:
            s = "_".join(w).upper()
        elif kind == 5:
            s = "".join(w)
        elif kind == 6:
            s = "_".join([*w, str(rng.integers(0, 10 ** int(rng.integers(1, 5))))])
        elif kind == 7:
            s = "".join(rng.choice(list(_DIGITS), rng.integers(NAMED, LEAST) if short else rng.integers(16, 21)))
        elif kind == 8:
            s = rng.choice(["20%02d-%02d-%02d-%02d%02d%02d-00", "+%02d-%02d%02d-%02d%02d-%02d00", "%02d%02d%02d%02d%02d%02d0000"]) % tuple(rng.integers(10, 60, 6))
        elif kind == 9:
            s = ".".join(w)
        elif kind == 10:
            s = "www." + "-".join(w[:2]) + rng.choice([".com", ".org", ".net", ".de", ".co.uk"]) + "/" + "/".join(w[2:])
        elif kind == 11:
            s = "_".join(w) + rng.choice([".tar.gz", ".html", ".json", ".py", ".jpg", ".v2.csv"])
        elif kind == 12:
            s = rng.choice(list(_ALPHABET[:-1])) * int(rng.integers(LEAST, 65))  # lines and fillers
        else:
            s = rng.choice(["%d.%d.%d-%d", "192.168.%d.%d-10.%d.0.%d", "%d.%d%d%d"]) % tuple(rng.integers(0, 255, 4))
        if short:
            s = s[: int(rng.integers(NAMED, LEAST))].strip("._-/+")
        while len(s) < (NAMED if short else LEAST):
            s += "_" + words[int(rng.integers(0, len(words)))]
        s = "".join(c for c in s if ord(c) < 128 and _CODE[ord(c)] >= 0)
        out.append(s[: LEAST - 1] if short else s)
    return [s for s in out if len(s) >= (NAMED if short else LEAST)]


def _contexts(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(index of each character's trigram, offsets by string)."""
    size = np.array([len(s) for s in strings], np.int64)
    offs = np.concatenate([[0], np.cumsum(size)])
    code = _CODE[np.frombuffer(b"".join(strings), np.uint8)]
    pos = np.arange(len(code)) - np.repeat(offs[:-1], size)
    one, two = np.roll(code, 1), np.roll(code, 2)
    one[pos < 1], two[pos < 2] = _N - 1, _N - 1
    return (two * _N + one) * _N + code, offs


class Detector:
    """Ratio of the models' log probabilities, and the thresholds per character: of candidates, and of short ones that are named."""

    def __init__(self, ratio: np.ndarray, threshold: float, named: float = np.inf):
        self.ratio, self.threshold, self.named = ratio, threshold, named

    def sums(self, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihood ratio of all characters before each, offsets by string)."""
        at, offs = _contexts(strings)
        return np.concatenate([[0.0], np.cumsum(self.ratio[at], dtype=np.float64)]), offs

    def score(self, strings: list[bytes]) -> np.ndarray:
        """The best mean of a string and of the shortest stretches, LEAST at least, from each of its parts on."""
        if not strings:
            return np.zeros(0)
        total, offs = self.sums(strings)
        return self._best(strings, total, offs)

    def _best(self, strings: list[bytes], total: np.ndarray, offs: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(_SEPARATOR[np.frombuffer(b"".join(strings), np.uint8)])
        start, end = np.union1d(offs[:-1], at + 1), np.union1d(offs[1:], at)
        start = start[start < offs[-1]]
        of = np.searchsorted(offs, start, "right") - 1
        e = end[np.minimum(np.searchsorted(end, start + LEAST), len(end) - 1)]
        short = (e - start >= LEAST) & (e <= offs[of + 1])
        mean = np.where(short, (total[e] - total[start]) / np.maximum(e - start, 1), -np.inf)
        return np.maximum(np.diff(total[offs]) / np.diff(offs), np.maximum.reduceat(mean, np.searchsorted(of, np.arange(len(strings)))))

    def find(self, strings: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(string, start, end, mean) of the secrets, in order."""
        if not strings:
            return []
        total, offs = self.sums(strings)
        out = []
        for i in np.flatnonzero(self._best(strings, total, offs) > self.threshold):
            text = np.frombuffer(strings[i], np.uint8)
            over = total[offs[i] : offs[i + 1] + 1] - self.threshold * np.arange(len(text) + 1)
            at, todo = np.flatnonzero(_SEPARATOR[text]), [(0, len(text))]
            while todo:
                lo, hi = todo.pop()
                got = self._longest(over, at[np.searchsorted(at, lo) : np.searchsorted(at, hi)], lo, hi) if hi - lo >= LEAST else None
                if got:
                    s, e = got
                    out.append((int(i), s, e, (total[offs[i] + e] - total[offs[i] + s]) / (e - s)))
                    todo += [(lo, s - 1), (e + 1, hi)]
        return sorted(out)

    @staticmethod
    def _longest(over: np.ndarray, at: np.ndarray, lo: int, hi: int) -> tuple[int, int] | None:
        """The longest stretch between separators `at`, of LEAST at least, over which `over` rises."""
        start, end = np.append(lo, at + 1), np.append(at, hi)
        first = start[np.minimum(np.searchsorted(-np.minimum.accumulate(over[start]), -over[end], "right"), len(start) - 1)]
        size = np.where(over[first] < over[end], end - first, 0)
        k = int(np.argmax(size))
        return (int(first[k]), int(end[k])) if size[k] >= LEAST else None


def _log_model(strings: list[str]) -> np.ndarray:
    """log P(c | two before), interpolated with lower orders."""
    at, _ = _contexts([s.encode() for s in strings])
    tri = np.bincount(at, minlength=_N**3).reshape(_N, _N, _N).astype(float)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    p1 = (uni + 1) / (uni.sum() + _N)
    p2 = (bi + 8 * p1) / (bi.sum(1, keepdims=True) + 8)
    return np.log((tri + 4 * p2[None]) / (tri.sum(2, keepdims=True) + 4)).reshape(-1)


def _threshold(positive: np.ndarray, negative: np.ndarray) -> float:
    """The middle of the range in which the errors, with false alarms counted ten times, are least."""
    p, q = np.sort(positive), np.sort(negative)
    tries = np.unique(np.concatenate([p, q]))
    loss = np.searchsorted(p, tries) + 10 * (len(q) - np.searchsorted(q, tries))
    best = np.flatnonzero(loss == loss.min())
    below = tries[best[0] - 1] if best[0] else tries[best[0]]
    return float((below + tries[best[-1]]) / 2)


def fit(secret: list[str], ordinary: list[str], short_secret: Sequence[str] = (), short_ordinary: Sequence[str] = ()) -> Detector:
    """Models and thresholds from labelled samples.

    Of each class the last quarter is held out of the models, and chooses the threshold. Without short samples
    of both classes, short candidates are left alone.
    """
    cut = [len(x) * 3 // 4 for x in (secret, ordinary, short_secret, short_ordinary)]
    found = Detector((_log_model([*secret[: cut[0]], *short_secret[: cut[2]]]) - _log_model([*ordinary[: cut[1]], *short_ordinary[: cut[3]]])).astype(np.float32), 0.0)
    score = lambda x: found.score([s.encode() for s in x])
    found.threshold = _threshold(score(secret[cut[0] :]), score(ordinary[cut[1] :]))
    if short_secret and short_ordinary:
        found.named = _threshold(score(short_secret[cut[2] :]), score(short_ordinary[cut[3] :]))
    return found


def train(words: list[str], strings: int = TRAIN_STRINGS, seed: int = 5, kinds: Sequence[str] = tuple(KINDS), samples: Sequence[tuple[str, int]] = ()) -> Detector:
    """fit() on labelled strings: random ones of these kinds, ordinary ones made of words, and `samples` (string, 1 for a secret)."""
    rng = np.random.default_rng(seed)
    made = [random_strings(rng, strings, kinds), ordinary_strings(rng, strings, words), random_strings(rng, strings // 4, kinds, True), ordinary_strings(rng, strings // 4, words, True)]
    for text, secret in samples:
        for part in re.findall(r"[A-Za-z0-9_+/.-]+", text):
            if len(part) >= NAMED:
                made[(len(part) < LEAST) * 2 + 1 - int(secret)].append(part)
    if samples:
        made = [[x[k] for k in rng.permutation(len(x))] for x in made]
    return fit(*made)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(context, n): how often each two letters of a word are followed by a third, or by its end."""
    total, held, used = np.zeros(_N**3, np.int64), np.empty(1 << 20, np.int32), 0
    for batch in batches:
        for part in T.slices(batch, limit=len(held) // 8):  # arrays stay small, counts are taken of many together
            raw, offs = T.buffers(part.column("text"))
            raw = np.insert(raw, np.append(0, offs), 10)  # a line end around each text, two before the first
            word = _LETTER[raw]
            step = np.diff(word.view(np.int8))
            s, e = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
            other = _OTHER[raw]  # part of something else than a word
            fine = (e - s >= 4) & ~other[s - 1] & ~other[e]
            change = np.zeros(len(raw) + 1, np.int8)
            change[s[fine]] += 1
            change[e[fine] + 1] -= 1
            inside = np.cumsum(change, dtype=np.int8)[2:-1].astype(bool)  # letters, and the place after them
            code = _WORD_CODE[raw]
            one, two = code[1:-1], code[:-2]
            got = (np.where(one == _N - 1, _N - 1, two) * np.int32(_N * _N) + one * np.int32(_N) + code[2:])[inside]
            if used + len(got) > len(held):
                total += np.bincount(held[:used], minlength=len(total))
                used = 0
            if len(got) > len(held):
                total += np.bincount(got, minlength=len(total))
            else:
                held[used : used + len(got)] = got
                used += len(got)
    total += np.bincount(held[:used], minlength=len(total))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"context": some, "n": total[some]})


def drawn_words(counts: np.ndarray, n: int = WORDS, seed: int = 11) -> list[str]:
    """Words as the character statistics (counts by context) have them, of 4 to 24 letters; none without counts."""
    if not counts.sum():
        return []
    rng = np.random.default_rng(seed)
    by = counts.reshape(_N * _N, _N)
    upto = np.cumsum(by, 1) / np.maximum(by.sum(1, keepdims=True), 1)
    two = one = np.full(n, _N - 1)
    out, live = np.full((n, 24), -1), np.ones(n, bool)
    for k in range(24):
        nxt = (upto[two * _N + one] <= rng.random(n)[:, None]).sum(1)
        live &= nxt < _N - 1
        out[live, k] = nxt[live]
        two, one = one, np.where(live, nxt, _N - 1)
    words = ("".join(_ALPHABET[c] for c in row if c >= 0) for row in out)
    return [w for w in words if len(w) >= 4]


def detector(docs: DataFrame, samples: DataFrame | None = None) -> Detector:
    """Trained with words drawn from the character statistics of all documents' words, which are labelled as ordinary.

    samples: labelled strings (value, secret 0 or 1) to learn from as well; nulls are left out, and they come to the driver.
    """
    got = texts(docs).select("text").mapInArrow(_word_counts, "context long, n long").groupBy("context").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(_N**3, np.int64)
    counts[got.column("context").to_numpy()] = got.column("n").to_numpy()
    more = [(r.value, r.secret) for r in samples.select("value", "secret").filter("value IS NOT NULL AND secret IN (0, 1)").orderBy("value", "secret").collect()] if samples is not None else ()
    return train(drawn_words(counts), samples=more)


def _latin(raw: np.ndarray) -> np.ndarray:
    """Which bytes (and one past the end) are of Latin letters beyond ASCII."""
    out = np.zeros(len(raw) + 1, bool)
    at = np.flatnonzero((raw >= 0xC3) & (raw < 0xF0))
    if len(at):
        pad = np.append(raw, np.zeros(2, np.uint8)).astype(np.int64)
        x, y, z = pad[at], pad[at + 1] & 0x3F, pad[at + 2] & 0x3F
        three = x >= 0xE0
        point = np.where(three, (x & 0xF) << 12 | y << 6 | z, (x & 0x1F) << 6 | y)
        k = np.searchsorted(_LATIN[:, 0], point, "right") - 1
        latin = (k >= 0) & (point <= _LATIN[k, 1])
        for step, of in ((0, latin), (1, latin), (2, latin & three)):
            out[np.minimum(at[of] + step, len(raw))] = True
        out[len(raw)] = False
    return out


def _runs(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) in bytes of the candidates."""
    n = len(raw)
    run = np.zeros(n + 1, bool)
    run[:n] = _RUN[raw]
    dot = np.flatnonzero(raw[1:-1] == _DOT) + 1 if n > 2 else np.zeros(0, np.int64)
    run[dot[run[dot - 1] & run[dot + 1]]] = True
    edge, before = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    edge[offs] = True
    before[1:] = run[:-1]
    s, e = np.flatnonzero(run & (~before | edge)), np.flatnonzero(before & (~run | edge))
    long = e - s >= LEAST
    s, e = s[long], e[long]
    latin = _latin(raw)
    left, right = ~edge[s] & latin[s - 1], ~edge[e] & latin[e]
    if left.any() or right.any():
        at = np.concatenate([[-1], np.flatnonzero(_SEPARATOR[raw]), [n]])
        s, e = np.where(left, at[np.searchsorted(at, s)] + 1, s), np.where(right, at[np.searchsorted(at, e) - 1], e)
        long = e - s >= LEAST
        s, e = s[long], e[long]
    return np.searchsorted(offs, s, "right") - 1, s, e


def _named(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) in bytes of the short candidates that are named."""
    apart = (np.insert(raw, offs[1:-1], 10) if len(offs) > 2 else raw).tobytes()  # a line end between texts
    view, spans = np.frombuffer(apart, np.uint8), []
    for p in np.flatnonzero((view == ord("=")) | (view == ord(":"))).tolist():
        m = _VALUE.match(apart, p, p + LEAST + 8)
        if m and NAMED <= m.end(1) - m.start(1) < LEAST and _NAME.search(apart[max(0, p - 24) : p]):
            spans.append(m.span(1))
    at = np.array(spans, np.int64).reshape(-1, 2)
    row = np.searchsorted(offs + np.arange(len(offs)), at[:, 0], "right") - 1
    at = at - row[:, None]
    fine = (at[:, 1] == offs[row + 1]) | ~_latin(raw)[at[:, 1]]
    return row[fine], at[fine, 0], at[fine, 1]


def _found(found: Detector, column: pa.Array):
    raw, offs = T.buffers(column)
    row, s, e = _runs(raw, offs)
    got = found.find([raw[a:b].tobytes() for a, b in zip(s, e)])
    k, a, b = (np.array([x[c] for x in got], np.int64) for c in range(3))
    row, s, e, score = row[k], s[k] + a, s[k] + b, np.array([x[3] for x in got])
    if np.isfinite(found.named):
        r, a, b = _named(raw, offs)
        x = found.score([raw[i:j].tobytes() for i, j in zip(a, b)])
        hit = x > found.named
        row, s, e, score = (np.concatenate(z) for z in ((row, r[hit]), (s, a[hit]), (e, b[hit]), (score, x[hit])))
        by = np.argsort(s, kind="stable")
        row, s, e, score = row[by], s[by], e[by], score[by]
    return raw, offs, row, s, e, score


def _scan(found: Detector):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                raw, offs, row, s, e, score = _found(found, part.column("text"))
                if len(row):
                    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").take(pa.array(row)), "start": chars[s] - chars[offs[row]], "length": e - s, "llr": score.astype(np.float64)})

    return run


def secrets(docs: DataFrame, found: Detector | None = None) -> DataFrame:
    """(doc_id, start, length, llr) of each secret: its characters in the text, from 0.

    llr is the log-likelihood ratio per character, random against ordinary.
    Null ids or texts have none; repeated rows each report theirs once
    (equal rows are merged). Other columns are ignored.
    """
    found = found or detector(docs)
    return texts(docs).mapInArrow(_scan(found), "doc_id long, start long, length long, llr double").distinct()


def redact(docs: DataFrame, found: Detector | None = None) -> DataFrame:
    """docs with each secret replaced by MARK; n_chars, if there, follows the text.

    All rows and columns stay; null texts stay null. Texts without secrets don't change.
    """
    found = found or detector(docs)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                raw, offs, row, s, e, _ = _found(found, part.column("text"))
                if not len(row):
                    yield part
                    continue
                rows = np.unique(row)
                new = []
                for r in rows:
                    at, pieces = offs[r], []
                    for k in np.flatnonzero(row == r):
                        pieces += [raw[at : s[k]].tobytes(), MARK.encode()]
                        at = e[k]
                    new.append((b"".join(pieces) + raw[at : offs[r + 1]].tobytes()).decode(errors="replace"))
                mask = np.zeros(part.num_rows, bool)
                mask[rows] = True
                text = pc.replace_with_mask(part.column("text"), pa.array(mask), pa.array(new, part.schema.field("text").type))
                part = part.set_column(names.index("text"), part.schema.field("text"), text)
                if "n_chars" in names:
                    field = part.schema.field("n_chars")
                    part = part.set_column(names.index("n_chars"), field, pc.if_else(pa.array(mask), pc.utf8_length(text).cast(field.type), part.column("n_chars")))
                yield part

    importable(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in the whole documents table."""
    return secrets(table(spark, sf_dir, "documents"))
