"""Personal data: exact base patterns, and a character BiLSTM with CRF transitions that adds spans to them."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import documents, tune

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
# possessive runs: the same matches as the greedy ones of the contract, in time linear in the text; no match can begin
# within a run of digits, as it would go on exactly like one from the run's first digit
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What every span of the model holds, in folded text; the model reads only around these.
TRIGGER = re.compile(r"[0-9@]|[\[({<]\s{0,2}at\s{0,2}[\])}>]|\bat\s{1,3}[a-z0-9-]{1,63}\s{0,3}(?:[\[({<]\s{0,2})?dot\b", re.IGNORECASE)
#: Other forms of ASCII characters, one for one: full width, decimal digits of any script, small @, blanks.
FOLD = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {c: 48 + int(chr(c)) for c in range(128, 0x110000) if chr(c).isdecimal()} | {0xFE6B: 64, 0x3000: 32, 0xA0: 32}


def folded(text: str) -> str:
    """The text with other forms of ASCII characters replaced; offsets stay."""
    return text if text.isascii() else text.translate(FOLD)


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octets(s: str) -> bool:
    return all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the patterns alone, leftmost and not overlapping within a kind."""
    if not text:
        return []
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    out += [("ip", *m.span()) for m in IP.finditer(text) if _octets(m[0])]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


# --- the tagger -------------------------------------------------------------------------------------------------------

#: 0: outside; 1 + 2k begins, 2 + 2k continues a span of the k-th kind.
TAGS = 1 + 2 * len(KINDS)
VOCAB = 131


def encode(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.where(c < 128, c, np.where(c < 0x250, 128, 129))


def _sig(x):
    return 1 / (1 + np.exp(-x))


@dataclass
class Tagger:
    """Embedding, one LSTM a direction, linear emissions, CRF transitions; all in numpy."""

    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, width: int = 12, hidden: int = 16, seed: int = 7) -> Tagger:
        r = np.random.default_rng(seed)
        p = {"E": r.normal(0, 0.3, (VOCAB, width)), "O": r.normal(0, 0.2, (2 * hidden, TAGS)), "b": np.zeros(TAGS), "A": r.normal(0, 0.05, (TAGS, TAGS)), "s": np.zeros(TAGS)}
        for d in "fr":
            p |= {f"W{d}": r.normal(0, 0.25, (width, 4 * hidden)), f"U{d}": r.normal(0, 0.25, (hidden, 4 * hidden)), f"c{d}": np.concatenate((np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)))}
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def _states(self, x: np.ndarray, keep: bool):
        """States of both directions, time first: (2, t, n, hidden); the second runs from the end."""
        n, t, e = x.shape
        u, w, c0 = (np.stack([self.p[f"{name}{d}"] for d in "fr"]) for name in "UWc")
        k = u.shape[1]
        two = np.stack((x.transpose(1, 0, 2), x.transpose(1, 0, 2)[::-1])).reshape(2, t * n, e)
        z = (two @ w + c0[:, None]).reshape(2, t, n, 4 * k)
        h, c, out, mem = np.zeros((2, n, k), z.dtype), np.zeros((2, n, k), z.dtype), np.empty((2, t, n, k), z.dtype), []
        for i in range(t):
            a = z[:, i] + h @ u
            g = _sig(a[..., : 3 * k])
            i_, f_, o_, q = g[..., :k], g[..., k : 2 * k], g[..., 2 * k :], np.tanh(a[..., 3 * k :])
            before = c
            c = f_ * c + i_ * q
            tc = np.tanh(c)
            h = o_ * tc
            out[:, i] = h
            if keep:
                mem.append((i_, f_, o_, q, before, tc))
        return out, (two, mem)

    def emissions(self, ids: np.ndarray, keep: bool = False):
        s, mem = self._states(self.p["E"][ids], keep)
        h = np.concatenate((s[0], s[1, ::-1]), 2).transpose(1, 0, 2)
        return h @ self.p["O"] + self.p["b"], (h, s, *mem)

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log-likelihood a row and its gradients. Rows have equal lengths; padding is tagged as outside."""
        e, (h, states, two, mem) = self.emissions(ids, True)
        n, t, _ = e.shape
        a, s = self.p["A"].astype(np.float64), self.p["s"].astype(np.float64)
        # forward and backward sums, scaled to 1 at each place
        top, most = e.max(2).astype(np.float64), a.max()
        x, step = np.exp(e - top[..., None]), np.exp(a - most)
        al, be, scale = np.empty((n, t, TAGS)), np.ones((n, t, TAGS)), np.empty((n, t))
        v = np.exp(s - s.max()) * x[:, 0]
        for i in range(t):
            v = v if i == 0 else (v @ step) * x[:, i]
            scale[:, i] = v.sum(1)
            al[:, i] = v = v / scale[:, i, None]
        for i in range(t - 2, -1, -1):
            be[:, i] = ((x[:, i + 1] * be[:, i + 1]) @ step.T) / scale[:, i + 1, None]
        z = np.log(scale).sum(1) + top.sum(1) + s.max() + (t - 1) * most
        rows = np.arange(n)
        gold = s[tags[:, 0]] + e[rows[:, None], np.arange(t), tags].sum(1) + a[tags[:, :-1], tags[:, 1:]].sum(1)
        de = al * be
        g = {"s": de[:, 0].sum(0)}
        pairs = step * (al[:, :-1].reshape(-1, TAGS).T @ ((x[:, 1:] * be[:, 1:]) / scale[:, 1:, None]).reshape(-1, TAGS))
        np.add.at(pairs, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1)
        np.add.at(g["s"], tags[:, 0], -1)
        de[rows[:, None], np.arange(t), tags] -= 1
        de = de.astype(e.dtype)
        g |= {"A": pairs, "O": h.reshape(n * t, -1).T @ de.reshape(n * t, TAGS), "b": de.sum((0, 1))}
        dh, k = (de @ self.p["O"].T).transpose(1, 0, 2), states.shape[3]
        part = np.stack((dh[..., :k], dh[::-1, :, k:]))
        u, w = (np.stack([self.p[f"{name}{d}"] for d in "fr"]) for name in "UW")
        da_all, back = np.empty((2, t, n, 4 * k), e.dtype), u.transpose(0, 2, 1)
        nh, nc = np.zeros((2, n, k), e.dtype), np.zeros((2, n, k), e.dtype)
        for i in range(t - 1, -1, -1):
            i_, f_, o_, q, before, tc = mem[i]
            hh = part[:, i] + nh
            nc = nc + hh * o_ * (1 - tc * tc)
            da = da_all[:, i]
            da[..., :k], da[..., k : 2 * k], da[..., 2 * k : 3 * k], da[..., 3 * k :] = nc * q * i_ * (1 - i_), nc * before * f_ * (1 - f_), hh * tc * o_ * (1 - o_), nc * i_ * (1 - q * q)
            nh, nc = da @ back, nc * f_
        flat = da_all.reshape(2, t * n, 4 * k)
        earlier = np.concatenate((np.zeros((2, 1, n, k), e.dtype), states[:, :-1]), 1).reshape(2, t * n, k)
        gu, gw, gc = earlier.transpose(0, 2, 1) @ flat, two.transpose(0, 2, 1) @ flat, flat.sum(1)
        for j, d in enumerate("fr"):
            g |= {f"U{d}": gu[j], f"W{d}": gw[j], f"c{d}": gc[j]}
        dx = (flat @ w.transpose(0, 2, 1)).reshape(2, t, n, -1)
        dx = (dx[0] + dx[1, ::-1]).transpose(1, 0, 2)
        g["E"] = np.zeros_like(self.p["E"])
        np.add.at(g["E"], ids.ravel(), dx.reshape(-1, dx.shape[2]))
        return float((z - gold).mean()), {k_: v / n for k_, v in g.items()}

    def fit(self, ids: np.ndarray, tags: np.ndarray, epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Tagger:
        """Adam with a falling rate, in a fixed order of batches."""
        r, m, v, t = np.random.default_rng(seed), {}, {}, 0
        steps = epochs * -(-len(ids) // batch)
        for _ in range(epochs):
            order = r.permutation(len(ids))
            for at in range(0, len(order), batch):
                k = order[at : at + batch]
                _, g = self.gradients(ids[k], tags[k])
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                t += 1
                for n, x in g.items():
                    x = x * min(1.0, 5.0 / (norm + 1e-9))
                    m[n] = 0.9 * m.get(n, 0) + 0.1 * x
                    v[n] = 0.99 * v.get(n, 0) + 0.01 * x * x
                    self.p[n] = (self.p[n] - rate * (1 - 0.9 * t / steps) * (m[n] / (1 - 0.9**t)) / (np.sqrt(v[n] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        return self

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags of each row (Viterbi, no inside without a begin), and the margin of each emission over outside."""
        e, _ = self.emissions(ids)
        a, s = self.p["A"].copy(), self.p["s"].copy()
        for k in range(len(KINDS)):
            bad = np.ones(TAGS, bool)
            bad[[1 + 2 * k, 2 + 2 * k]] = False
            a[bad, 2 + 2 * k] = s[2 + 2 * k] = -1e4
        n, t, _ = e.shape
        best, back = s + e[:, 0], np.zeros((n, t, TAGS), np.int8)
        for i in range(1, t):
            v = best[:, :, None] + a
            back[:, i] = v.argmax(1)
            best = v.max(1) + e[:, i]
        tags = np.zeros((n, t), np.int8)
        tags[:, -1] = best.argmax(1)
        for i in range(t - 1, 0, -1):
            tags[:, i - 1] = back[np.arange(n), i, tags[:, i]]
        return tags, np.take_along_axis(e, tags[..., None].astype(np.int64), 2)[..., 0] - e[..., 0]


#: A span of up to STRIDE characters is whole in some window; a longer one is read again in a wider window, up to WIDEST.
WIDTH, STRIDE, WIDEST = 192, 96, 1536


def windows(text: str) -> list[int]:
    """Starts of overlapping windows that cover all triggers with half a window around; none without a trigger."""
    out: list[int] = []
    for m in TRIGGER.finditer(text):
        at = m.start()
        while not out or at + STRIDE // 2 > out[-1] + STRIDE + STRIDE // 2:
            first = max(0, at - STRIDE)
            out.append(max(first, out[-1] + STRIDE) if out and first < out[-1] + WIDTH else first)
    return out


_NAME, _LABEL, _DOT = r"[^\s@\[\](){}<>]+", "[a-z0-9-]+", r"\s?[\[({<]\s{0,2}dot\s{0,2}[\])}>]\s?|\s{1,3}dot\s{1,3}"
#: With a sign or brackets for `at`, dots may be plain; a bare `at` needs a written one, or prose would fit.
EMAIL = re.compile(rf"{_NAME}(?:(?:{_DOT}){_NAME})*(?:\s?(?:@|[\[({{<]\s{{0,2}}at\s{{0,2}}[\])}}>])\s?{_LABEL}(?:(?:\.|{_DOT}){_LABEL})+|\s{{1,3}}at\s{{1,3}}{_LABEL}(?:(?:{_DOT}){_LABEL})+)", re.IGNORECASE)


def plausible(kind: str, s: str) -> bool:
    """What a span of the model must hold to be added."""
    d = _digits(s)
    if kind == "email":
        return bool(EMAIL.fullmatch(s))
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d) and bool(re.fullmatch(r"[0-9]+([ ./-][0-9]+)*", s))
    if kind == "phone":
        return 9 <= len(d) <= 15 and bool(re.fullmatch(r"\+?[(0-9][0-9 ()./-]*[0-9]", s)) and bool(re.search(r"[ ()./-]", s))
    return bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", s)) and _octets(s)


def reconcile(found: list[tuple[float, int, int, str]], taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Of spans from all windows of a text: highest mean margin first (ties: longer, leftmost), none that overlaps one
    chosen before or a base span."""
    out: list[tuple[str, int, int]] = []
    for _, a, b, kind in sorted(found, key=lambda s: (-s[0], s[1] - s[2], s[1], s[3])):
        if all(b <= x or a >= y for x, y in taken):
            taken.append((a, b))
            out.append((kind, a, b))
    return out


def added_spans(texts: list[str | None], bases: list[list[tuple[str, int, int]]], tagger: Tagger, least: float = 0.25, rows: int = 512) -> list[list[tuple[str, int, int]]]:
    """The model's spans in each text beside its base spans, each decoded in every window that holds it whole.

    A span that a window's edge cuts is decoded again in windows twice as wide around it, until one holds it.
    """
    texts = [folded(t) if t else t for t in texts]
    found: list[list] = [[] for _ in texts]
    width, at = WIDTH, [(i, w) for i, t in enumerate(texts) if t for w in windows(t)]
    while at:
        cut = set()
        for k in range(0, len(at), rows):
            part = at[k : k + rows]
            ids = np.full((len(part), width), 130, np.int64)
            for j, (i, w) in enumerate(part):
                c = encode(texts[i][w : w + width])
                ids[j, : len(c)] = c
            tags, margin = tagger.decode(ids)
            for j in np.flatnonzero((tags > 0).any(1)):
                i, w = part[j]
                size = min(width, len(texts[i]) - w)
                begins = np.flatnonzero(tags[j, :size] % 2 == 1)
                for a in begins:
                    b = a + 1
                    while b < size and tags[j, b] == tags[j, a] + 1:
                        b += 1
                    if (a == 0 and w > 0) or (b == width and w + width < len(texts[i])):
                        # steps of half the old width: what is wide up to the old width is whole in the new window
                        cut.add((i, max(0, (int(w + (a + b) // 2) - width) // (width // 2) * (width // 2))))
                        continue
                    kind, mean = KINDS[(tags[j, a] - 1) // 2], float(margin[j, a:b].mean())
                    s = texts[i][w + a : w + b]
                    if mean >= least and TRIGGER.search(s) and plausible(kind, s) and not _continues(texts[i], w + a, w + b):
                        found[i].append((round(mean, 4), int(w + a), int(w + b), kind))
        width *= 2
        rows = max(1, rows // 2)
        at = sorted(cut) if width <= WIDEST else []
    return [reconcile(f, [(a, b) for _, a, b in base]) for f, base in zip(found, bases)]


def _continues(text: str, a: int, b: int) -> bool:
    """A letter or digit right before or after: part of a longer token."""
    return (a > 0 and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum())


# --- labelled spans -----------------------------------------------------------------------------------------------------


def _with_luhn(r: np.random.Generator, n: int) -> str:
    body = "".join(map(str, r.integers(0, 10, n - 1)))
    return next(body + str(k) for k in range(10) if luhn(body + str(k)))


#: Written forms of `@` and of the dots that go with it.
AT_DOT = [(" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "), ("[at]", "."), (" at ", " dot "), (" at ", " dot "), (" {at} ", " {dot} "), ("{at}", "."), (" <at> ", " <dot> "), ("<at>", ".")]


def _example(r: np.random.Generator, words: list[str]) -> tuple[str, str | None]:
    """A made-up string and its kind; None: it only looks like personal data."""
    any_ = lambda x: x[int(r.integers(len(x)))]
    w = lambda: re.sub(r"[^a-z]", "", any_(words).lower()) or "ana"
    d = lambda n: "".join(map(str, r.integers(0, 10, n)))
    pick = int(r.integers(0, 20))
    if pick < 2:
        return f"{w()}.{r.integers(1, 99)}@{w()}{r.integers(1, 9)}.{any_(['com', 'org', 'net', 'example.com'])}", "email"
    if pick < 4 or pick > 16:
        at, dot = AT_DOT[int(r.integers(len(AT_DOT)))]
        name = any_([w(), w(), f"{w()}.{w()}", f"{w()}{r.integers(1, 99)}", f"{w()}.{w()}{r.integers(1, 99)}"])
        host = any_([w(), w(), f"{w()}-{w()}", f"{w()}{dot}{w()}", f"{w()}.{w()}-{w()}" if at != " at " else w()])
        s = f"{name}{at}{host}{dot}{any_(['com', 'org', 'net', 'example'])}"
        return (s.upper() if r.random() < 0.25 else re.sub(r"\bat\b", "AT", s) if r.random() < 0.15 else s), "email"
    if pick < 6:
        return ".".join(map(str, r.integers(0, 256, 4))), "ip"
    if pick < 9:
        n = any_([15, 16, 16, 16])
        s, sep = _with_luhn(r, n), any_(["", " ", "-", ".", "/"])
        cuts = (4, 10) if n == 15 else (4, 8, 12)
        return sep.join(s[a:b] for a, b in zip((0, *cuts), (*cuts, n))), "card"
    if pick < 12:
        a, b, c = d(3), d(3), d(4)
        return any_([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{d(2)} {d(3)} {d(3)} {d(3)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"00{d(2)} {d(3)} {d(6)}"]), "phone"
    hexed = "".join(r.choice(list("0123456789abcdef"), 40))
    return any_([f'token = "{hexed}"', f"{r.integers(1900, 2100)}-{r.integers(10, 13)}-{d(2)}", f"{d(1)}.{d(2)}", f"v{d(1)}.{d(1)}.{d(2)}", f"{d(3)},{d(3)}.{d(2)}", d(16), d(8), f"{d(4)}:{d(2)}", f"page {d(3)}", f"@{w()}", f"{d(1)}.{d(1)}.{d(1)}.999", f"{d(5)}-{d(2)}"]), None


FITTED = 128  # characters a row to learn from


def labelled(carriers: list[str], n: int = 3000, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Windows of carrier text with made-up strings put in, and the tags of the spans among them."""
    r = np.random.default_rng(seed)
    carriers = [c for c in carriers if not TRIGGER.search(c)] or ["the quick brown fox jumps over the lazy dog while it rains"]
    words = [w for c in carriers[:200] for w in c.split()[:40]] or ["word"]
    ids, tags = np.full((n, FITTED), 130, np.int64), np.zeros((n, FITTED), np.int64)
    for i in range(n):
        c = carriers[int(r.integers(len(carriers)))]
        a = int(r.integers(0, max(1, len(c) - FITTED)))
        text, spans = c[a : a + int(r.integers(4, 50))] + str(r.choice([" ", "\n", ": ", ", "])), []
        for _ in range(int(r.integers(1, 3))):
            s, kind = _example(r, words)
            if kind:
                spans.append((len(text), len(text) + len(s), kind))
            b = int(r.integers(0, max(1, len(c) - FITTED)))
            text += s + str(r.choice([" ", " ", ", ", ". ", "\n"])) + c[b : b + int(r.integers(3, 30))] + " "
        text = text[:FITTED]
        ids[i, : len(text)] = encode(text)
        for a, b, kind in spans:
            if b <= FITTED:
                k = KINDS.index(kind)
                tags[i, a:b] = 2 + 2 * k
                tags[i, a] = 1 + 2 * k
    return ids, tags


def train(docs: DataFrame, text="text", sample: int = 300, piece: int = 2000) -> Tagger:
    """A tagger from labelled spans put into pieces of about `sample` texts, chosen by a hash; equal texts count once.

    A piece has at most `piece` characters from a place that the hash chooses, so what reaches the driver is bounded.
    """
    n = docs.count()
    part = int(min(1.0, sample / max(1, n)) * 1_000_000)
    t = F.col(text).cast("string")
    slot = F.pmod(F.xxhash64(t), F.lit(1_000_000))
    start = F.pmod(F.xxhash64(t, F.lit(2)), F.greatest(F.length(t) - piece, F.lit(0)) + 1).cast("int") + 1
    rows = docs.where(t.isNotNull() & (slot < part)).select(slot.alias("slot"), F.substr(t, start, F.lit(piece)).alias("text")).distinct()
    ids, tags = labelled([t for _, t in sorted(map(tuple, rows.collect()))])
    return Tagger.new().fit(ids, tags)


# --- queries ------------------------------------------------------------------------------------------------------------

COUNTS = [f"n_{k}" for k in KINDS]
NEW = [*COUNTS, "base_sha256", "spans", "found"]
FOUND = f"struct<{', '.join(f'{c}: long' for c in COUNTS)}, base_sha256: string, spans: string, found: boolean>"


def finder(tagger: Tagger):
    """A column function from text to `FOUND`."""

    @arrow_udf(FOUND)
    def find(texts: pa.Array) -> pa.Array:
        t = texts.to_pylist()
        bases = [base_spans(x) for x in t]
        spans = [b + a for b, a in zip(bases, added_spans(t, bases, tagger))]
        cols = [pa.array([sum(s[0] == k for s in x) for x in spans], pa.int64()) for k in KINDS]
        cols += [pa.array([hashlib.sha256(told(b).encode()).hexdigest() for b in bases], pa.string()), pa.array([told(x) for x in spans], pa.string()), pa.array(map(bool, spans), pa.bool_())]
        return pa.StructArray.from_arrays(cols, names=NEW)

    return find.asNondeterministic()


def find(docs: DataFrame, tagger: Tagger, text="text") -> DataFrame:
    """`docs` with counts of spans by kind (base and added), the digest of the base spans, all spans, and if there are any.

    Base spans follow the patterns exactly and always stay. The tagger reads overlapping windows around every digit,
    `@`, bracketed `at` and `at` with a written `dot` of the whole text, in any case and width: what it adds must hold
    one, and text without them is not decoded. Spans
    of all windows are reconciled over the text, base spans first. Null and empty texts have no spans; equal texts get
    equal answers; very long texts cost time in proportion.
    """
    tune(docs.sparkSession)
    rest = [c for c in docs.columns if c not in NEW]
    return docs.withColumn("_f", finder(tagger)(F.col(text).cast("string"))).select(*rest, *(f"_f.{c}" for c in NEW))


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span (and those that overlap it) replaced by its kind in brackets."""
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; every document stays, n_chars follows the text.

    Null and empty texts stay as they are; repeated rows are treated alike. An empty table gives an empty table; extra
    columns, whatever their names, are carried along.
    """
    tune(spark)
    tagger = train(docs)

    @arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        t = texts.to_pylist()
        bases = [base_spans(x) for x in t]
        return pa.array([redact(x, b + a) for x, b, a in zip(t, bases, added_spans(t, bases, tagger))], pa.string())

    out = docs.withColumn("text", clean.asNondeterministic()(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def op8_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all `documents`."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return find(docs, train(docs)).drop("text")


def base_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8's base spans alone, which are patterns without a model: (doc_id, n_base, base_sha256) of all `documents`."""

    @arrow_udf("struct<n_base: long, base_sha256: string>")
    def base(texts: pa.Array) -> pa.Array:
        found = [base_spans(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array(map(len, found), pa.int64()), pa.array([hashlib.sha256(told(b).encode()).hexdigest() for b in found], pa.string())], names=["n_base", "base_sha256"])

    tune(spark)
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", base.asNondeterministic()(F.col("text")).alias("b")).select("doc_id", "b.*")


def _spans_sql(kind: int, pattern: str, ok: str) -> str:
    """Matches of a pattern with their places: what stands between them comes from a split by the same pattern."""
    return f"""SELECT doc_id, {kind} AS kind, m[i] AS v, (list_sum([len(x) FOR x IN s[1:i]]) + coalesce(list_sum([len(x) FOR x IN m[1:i-1]]), 0))::BIGINT AS start
    FROM (SELECT doc_id, m, s, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS s FROM d)) WHERE {ok}"""


_DIGITS = "regexp_replace(m[i], '[^0-9]', '', 'g')"
_LUHN = f"list_sum([CASE WHEN (len({_DIGITS}) - k) % 2 = 0 THEN substr({_DIGITS}, k, 1)::INT ELSE (2 * substr({_DIGITS}, k, 1)::INT) // 10 + (2 * substr({_DIGITS}, k, 1)::INT) % 10 END FOR k IN range(1, len({_DIGITS}) + 1)]) % 10 = 0"
BASE_SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),\nm AS ("
    + " UNION ALL ".join(
        [
            _spans_sql(1, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
            _spans_sql(2, r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_max([x::HUGEINT FOR x IN string_split(m[i], '.')]) <= 255"),
            _spans_sql(3, r"[0-9](?:[\x20-]?[0-9])+", f"len({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}"),
            _spans_sql(4, r"\+[0-9][\x20().0-9-]+[0-9]", f"len({_DIGITS}) BETWEEN 8 AND 15"),
        ]
    )
    + f"""),
t AS (SELECT doc_id, count(*) AS n, string_agg({list(KINDS)}[kind] || ':' || start::VARCHAR || ':' || (start + len(v))::VARCHAR, ',' ORDER BY kind, start) AS said FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_base, sha256(coalesce(said, '')) AS base_sha256 FROM d LEFT JOIN t USING (doc_id)"""
)
