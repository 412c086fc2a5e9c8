"""The learnt operators' queries against slow versions that go word by word, passage by passage and character by character."""

from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
import pyarrow as pa
import ugly
from test_text import split

from keyforge.llm import quality, secrets, toxicity
from keyforge.llm import text as T
from keyforge.llm.common import table


def tables(spark):
    return table(spark, ugly.SF, "documents"), table(spark, ugly.SF, "labels")


def word_hash(word: str) -> int:
    return int(T.Words(pa.array([word])).hash[0])


def test_toxicity_pair_by_pair(spark):
    docs, labels = tables(spark)
    m = toxicity.train(docs, labels)
    got = {r.doc_id: (r.toxicity, r.toxic) for r in toxicity.op5_toxicity(spark, ugly.SF).collect()}
    at = {int(t): k for k, t in enumerate(m.terms)}
    place = {}
    rows = docs.collect()
    assert len(got) == len({r.doc_id for r in rows})
    for r in rows:
        known = set()
        for w in set(split(r.text or "")):
            if w not in place:
                place[w] = at.get(word_hash(w) >> (64 - toxicity.BITS))
            if place[w] is not None:
                known.add(place[w])
        known = sorted(known)
        z = m.w0 + sum(m.w[i] for i in known) + sum(float(m.v[i] @ m.v[j]) for k, i in enumerate(known) for j in known[k + 1 :]) if len(known) < 150 else None
        if z is not None:
            p = 1 / (1 + math.exp(-z))
            assert abs(got[r.doc_id][0] - p) < 1e-9 and got[r.doc_id][1] == (p > m.threshold)


def slow_passages(text: str) -> list[list[float]]:
    raw = (text or "").encode()
    tokens = [(m.start(), m.end()) for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", raw)]
    kinds = list(quality._BYTES.values())
    kind_of = lambda b: len(kinds) + 1 if b >= 128 else next((k for k, x in enumerate(kinds, 1) if b in x), 0)
    hash_of = lambda t: int(T._spans_hash(T._BYTE[np.frombuffer(t, np.uint8)], np.array([0]), np.array([len(t)]), T._P)[0])
    out = []
    for k in range(0, max(len(tokens), 1), quality.PASSAGE):
        part = tokens[k : k + quality.PASSAGE]
        n = len(part)
        x = np.zeros(quality.FEATURES)
        if n:
            # a passage's bytes go up to the next one's first; what stands before a text's first token counts with it
            first = 0 if k == 0 else part[0][0]
            last = tokens[k + n][0] if k + n < len(tokens) else len(raw)
            size = sum(e - s for s, e in part)
            for b in raw[first:last]:
                x[kind_of(b)] += 4 / max(size, 1)
            words = [raw[s:e] for s, e in part]
            before = raw[slice(*tokens[k - 1])] if k else None
            same = sum(w == b for w, b in zip(words, [before, *words]))
            ends = [kind_of(w[-1]) for w in words]
            x[quality._KINDS : quality._KINDS + 7] = [
                size / n / 10, same / n * 3, len(set(words)) / n * 2, sum(len(w) == 1 for w in words) / n * 2, sum(len(w) > 20 for w in words) / n * 2, sum(kind_of(w[0]) == 1 for w in words) / n, sum(e not in (0, 1, 2, quality._KINDS - 1) for e in ends) / n]
            for w in words:
                h = hash_of(w)
                x[quality._KINDS + 7 + (h >> 32) % quality.HASHED] += (1 if h >> 63 else -1) / math.sqrt(n) / 4
        out.append(x)
    return out


def test_quality_passage_by_passage(spark):
    docs, labels = tables(spark)
    model = quality.train(docs, labels)
    p = {k: v.astype(float) for k, v in model.p.items()}
    got = {r.doc_id: (r.quality, r.keep) for r in quality.op1_quality(spark, ugly.SF).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows[::3]:
        h = [np.tanh(x @ p["e"] + p["eb"]) for x in slow_passages(r.text)]
        s = [float((np.tanh(a @ p["v"]) / (1 + np.exp(-(a @ p["u"])))) @ p["w"]) for a in h]
        a = [math.exp(x - max(s)) for x in s]
        z = sum(w * x for w, x in zip(a, h)) / sum(a)
        y = 1 / (1 + math.exp(-float(z @ p["c"] + p["cb"][0])))
        assert abs(got[r.doc_id][0] - y) < 2e-3, r.doc_id
        if abs(y - model.threshold) > 2e-3:
            assert got[r.doc_id][1] == (y >= model.threshold)


def test_attention_beats_mean_pooling(monkeypatch):
    """Bags of 30 passages of which one decides."""
    rng = np.random.default_rng(4)
    n, each = 500, 30
    x, y = rng.normal(0, 0.5, (n * each, quality.FEATURES)).astype(np.float32), (rng.random(n) < 0.5).astype(int)
    at = np.arange(n) * each + rng.integers(0, each, n)
    x[at, 0] += 3
    x[at, 1] += np.where(y, 2, -2)
    right = lambda m: np.mean((m.score(x[400 * each :], np.arange(101) * each) > m.threshold) == y[400:])
    attention = right(quality.fit(x[: 400 * each], np.arange(401) * each, y[:400], epochs=40))
    step = quality.Adam.step

    def uniform(self, grads):
        self.p["w"][:] = 0  # all passages weigh the same
        step(self, {k: g * (k not in "vuw") for k, g in grads.items()})
        self.p["w"][:] = 0

    monkeypatch.setattr(quality.Adam, "step", uniform)
    mean = right(quality.fit(x[: 400 * each], np.arange(401) * each, y[:400], epochs=40))
    assert attention >= 0.9 and attention >= mean + 0.05


def slow_secrets(found: secrets.Detector, text: str) -> set[tuple[int, int]]:
    """(start, length) in characters."""
    latin = lambda c: ord(c) >= 128 and (unicodedata.name(c, "").startswith("LATIN") or 0x300 <= ord(c) <= 0x36F)
    char = lambda a, b, c: found.ratio[(a * secrets._N + b) * secrets._N + c]

    def sums(s):
        code, total = [secrets._N - 1] * 2, [0.0]
        for c in s:
            code.append(secrets._ALPHABET.index(c))
            total.append(total[-1] + float(char(*code[-3:])))
        return total

    out = set()
    one = "A-Za-z0-9_+/-"
    for m in re.finditer(rf"[{one}]+(?:\.[{one}]+)*", text):
        s, e = m.span()
        if e - s < secrets.LEAST:
            continue
        if s and latin(text[s - 1]):
            s = next((k + 1 for k in range(s, e) if text[k] in "_+/.-"), e)
        if e < len(text) and latin(text[e]):
            e = next((k for k in range(e - 1, s - 1, -1) if text[k] in "_+/.-"), s)
        if e - s < secrets.LEAST:
            continue
        run = text[s:e]
        total = sums(run)
        cuts = [k for k, c in enumerate(run) if c in "_+/.-"]
        mean = lambda a, b: (total[b] - total[a]) / (b - a)
        short = [mean(a, b) for a in [0, *(k + 1 for k in cuts)] if (b := next((b for b in [*cuts, len(run)] if b >= a + secrets.LEAST), None))]
        if max([mean(0, len(run)), *short]) <= found.threshold:
            continue
        todo = [(0, len(run))]
        while todo:
            lo, hi = todo.pop()
            inner = [k for k in cuts if lo <= k < hi]
            spans = [(b - a, -b, a) for a in [lo, *(k + 1 for k in inner)] for b in [*inner, hi] if b - a >= secrets.LEAST and mean(a, b) > found.threshold]
            if spans:
                size, b, a = max(spans)
                out.add((s + a, size))
                todo += [(lo, a - 1), (-b + 1, hi)]
    name = r"""(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|access|private|auth|secret)[_-]?key)["']?[ \t]{0,3}[:=]>?[ \t]{0,3}["'`]?"""
    for m in re.finditer(rf"{name}([{one}]+(?:\.[{one}]+)*)", text):
        run = m[1]
        if secrets.NAMED <= len(run) < secrets.LEAST and not (m.end() < len(text) and latin(text[m.end()])) and sums(run)[-1] / len(run) > found.named:
            out.add((m.start(1), len(run)))
    return out


def test_secrets_character_by_character(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = secrets.detector(docs)
    want = {(r.doc_id, *x) for r in docs.collect() if r.text for x in slow_secrets(found, r.text)}
    got = {(r.doc_id, r.start, r.length) for r in secrets.op6_secrets(spark, "/root/testdata/sf0.01").collect()}
    assert got == want and len(got) > 10
