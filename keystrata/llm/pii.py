"""Personal data by candidate generation and gradient boosting (operator 6).

Base spans follow fixed patterns with checks (email, ip, card, phone; see `base_spans`). Generators of
high recall propose further, overlapping spans: spelled-out or spaced addresses and addresses in
brackets, and every row of digit groups that could be a card or a telephone number, with any separators
and inside longer rows. Boosted regression trees (logistic loss, depth 2, on binned features) score a
candidate by its format and context.

Labels do not come from the base patterns. Examples are written: personal data of known kinds in many
formats, base ones and others (`_written`), and what looks like them (versions, dates, amounts, article
numbers, digit rows with a wrong check digit, handles). They stand in contexts cut from a bounded
sample of the documents. One half of the examples fits the trees; on the other a threshold per kind is
calibrated: the smallest score from which on at least `precision` of the candidates are personal data.
Candidates over it that overlap no base span and no better candidate are added. Base spans stay,
whatever their score. `redact` replaces all spans.

Only the fit uses a sample: contexts of at most about `sample_documents` documents, chosen by a hash of
the text. Every text is searched whole, in time that follows its length.

Spans are code points, ends exclusive. Null and empty texts have none. Rows are independent: repeated
rows give repeated results, and an empty table none. Columns of the input stay; those made here get
underscores behind their names where they clash.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clean_name, ship, steps

# Kinds in order and the base patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# begun at a digit behind no digit: matches end with a run of digits, so these are the same ones, in linear time
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

SAMPLE_DOCUMENTS, EXAMPLES, SEED = 4000, 4000, 20260103  # examples: of each kind, half of them personal data
PRECISION, TREES, RATE = 0.98, 40, 0.3
CONTEXT = 24

Span = tuple[int, int, int]  # rank of the kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _byte(digits: str) -> bool:
    """Whether digits, of any number, are at most 255."""
    own = digits.lstrip("0")
    return len(own) <= 3 and int(own or "0") <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of local@domain; found from the @, which gives the same leftmost matches in linear time."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[Span]:
    """The base spans, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(_byte(p) for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return out


# What the generators of further candidates look for.
_AT, _DOT = r"(?:\x20?(?:@|[(\[{]at[)\]}])\x20?|\x20at\x20)", r"(?:\x20?[(\[{]dot[)\]}]\x20?|\x20dot\x20|\.|\x20\.\x20)"
_ADDRESS = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{{0,63}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{2,63}}){{1,4}}", re.I)
_HAS_AT = re.compile(r"@|[(\[{]at[)\]}]|\x20at\x20", re.I)
_FOUR = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\x20?[.,]\x20?|\x20dot\x20|[(\[]dot[)\]])[0-9]{1,3}(?![0-9])){3}", re.I)
_GROUP = re.compile(r"[0-9]+")
_BETWEEN = re.compile(r"[\x20./_()-]{1,3}")
_NEXT = re.compile(r"[\x20./_()-]{1,3}(?=[0-9])")
GROUPS = 8  # of digits in one candidate


def _numbers(text: str) -> Iterator[Span]:
    """Rows of up to GROUPS groups of digits with the length of a card or telephone number.

    A telephone number of several groups ends where the separators change, so a long list of numbers, all
    separated alike, has none.
    """
    held: list[tuple[int, int]] = []  # groups of the row that goes on
    for m in _GROUP.finditer(text):
        a, b = m.span()
        if held and (a - held[-1][1] > 3 or not _BETWEEN.fullmatch(text, held[-1][1], a)):
            held.clear()
        held.append((a, b))
        if len(held) > GROUPS:
            held.pop(0)
        following = m.group() if (m := _NEXT.match(text, b)) else ""
        digits, inner = 0, set()
        for k in range(len(held) - 1, -1, -1):  # rows that end with this group
            digits += held[k][1] - held[k][0]
            if digits > 19:
                break
            start, n = held[k][0], len(held) - k
            if n > 1:
                inner.add(text[held[k][1] : held[k + 1][0]])
            leading = text[held[k - 1][1] : start] if k else ""
            if 13 <= digits and text[start] in "3456" and luhn(_NOT_DIGIT.sub("", text[start:b])):
                yield (2, start, b)
            if 7 <= digits <= 15 and (n > 1 or digits <= 13) and digits >= 2 * n - 1 and leading not in inner and following not in inner:
                if start and text[start - 1] == "(":
                    start -= 1
                if start and text[start - 1] == "+":
                    start -= 1
                yield (3, start, b)


def candidates(text: str) -> list[Span]:
    """What the generators propose; spans may overlap."""
    out = [(0, *m.span()) for m in _ADDRESS.finditer(text)] if _HAS_AT.search(text) else []
    if _DIGIT.search(text):
        out += [(1, *m.span()) for m in _FOUR.finditer(text) if all(int(g) <= 255 for g in _GROUP.findall(m.group()))]
        out += _numbers(text)
    return out


# Words beside personal data, in the languages of the corpus.
CUES = (
    ("mail", "e-mail", "contact", "write to", "correo", "courriel", "kontakt"),
    ("ip", "host", "addr", "server", "client"),
    ("card", "visa", "credit", "konto", "tarjeta", "carte", "pay"),
    ("tel", "phone", "call", "mobile", "fax", "telefon", "telefono", "appel"),
)
# Words beside what only looks like it.
OTHERS = ("version", "build", "isbn", "order", "item", "page", "chapter", "from", "until", "total", "price", "on", "no", "ref", "id", "lines")
_CUE = tuple(re.compile("|".join(re.escape(w) for w in words), re.I) for words in CUES)
_OTHER = re.compile(r"\b(?:" + "|".join(OTHERS) + r")\b", re.I)
FEATURES = 29


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    rank, a, b = span
    s, before, after = text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
    digits = _NOT_DIGIT.sub("", s)
    groups = [len(g) for g in _GROUP.findall(s)] or [0]
    near, beside = before[-1:], after[:1]
    return [
        rank, b - a, len(digits), sum(map(str.isalpha, s)), len(groups), max(groups), min(groups), groups[0], groups[-1],
        s.count("@"), s.count("."), s.count("-"), s.count(" "), s.count("/"), s.count(",") + s.count("_"), float(s[:1] == "+"), float("(" in s), float("[" in s or "{" in s),
        float(s.startswith("00")) + float(s.startswith("0")), float(13 <= len(digits) <= 19 and luhn(digits)), float(len(groups) == 4 and max(groups) <= 3),
        float(near.isalnum()), float(beside.isalnum()), float(near in "-./_," and bool(near)), float(beside in "-/_," and bool(beside)),
        float(bool(_CUE[rank].search(before))), float(bool(_OTHER.search(before))), float(sum(map(str.isdigit, before[-6:] + after[:6]))), float(" at " in s.lower() or " dot " in s.lower()),
    ]


def _check_digit(digits: str) -> str:
    return next(d for d in "0123456789" if luhn(digits + d))


def _written(r: random.Random, kind: int, word: Callable[[], str]) -> tuple[str, bool]:
    """Something of the kind or like it, and whether it is personal data: half of them are."""
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    lead = lambda k: r.choice("123456789") + n(k - 1)
    real = r.random() < 0.5
    if kind == 0:
        name = r.choice((word(), f"{word()}.{word()}", f"{word()}{n(2)}", f"{word()}_{word()}", f"{word()}.{n(2)}"))
        host = r.choice((word(), f"{word()}-{word()}", f"mail{n(1)}.{word()}"))
        top = r.choice(("com", "org", "net", "de", "fr", "es", "info", "example.com"))
        if real:
            at, dot = r.choice((("@", "."), (" (at) ", "."), ("(at)", "."), (" [at] ", "."), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" @ ", "."), (" at ", " dot "), ("{at}", "."), (" @ ", " . ")))
            return f"{name}{at}{host.replace('.', dot)}{dot}{top.replace('.', dot)}", True
        return r.choice((f"{word()} at {word()}. {word()}", f"{word()} @ {word()}. {word()}", f"{word()} at {word()}.{word()}", f"{word()} (at) {word()}. {word()}", f"{word()} at {word()} dot {word()} at {word()}", f"{word()} at {word()}.{word()}.", f"at {word()}. {word()}", f"@{word()}.{word()}")), False
    if kind == 1:
        four = [str(r.randrange(256)) for _ in range(4)]
        if real:
            return r.choice((".", "[.]", " . ", "(.)", " dot ", "[dot]", ". ")).join(four), True
        return r.choice((",".join(four), ", ".join(four), f"{r.randrange(1, 20)},{n(3)},{n(3)},{n(3)}", f"{r.randrange(32)}.{r.randrange(13)}, {r.randrange(32)}.{r.randrange(13)}", ". ".join(str(r.randrange(1, 9) + k) for k in range(4)), f"{n(1)},{n(1)}, {n(1)},{n(1)}")), False
    if kind == 2:
        size = r.choice((16, 16, 16, 15, 13, 19))
        body = r.choice("3456") + n(size - 2)
        good = body + _check_digit(body)
        cut = (4, 6, 5) if size == 15 else (4,) * (size // 4) + ((size % 4,) if size % 4 else ())
        sep = r.choice(("", "", " ", "-", ".", "/", "  ", " - ", "_"))
        grouped = lambda d: sep.join(d[sum(cut[:i]) : sum(cut[: i + 1])] for i in range(len(cut)))
        if real:
            return r.choice((grouped(good), grouped(good), f"{good} {good}")), True
        wrong = body + r.choice([d for d in "0123456789" if not luhn(body + d)])
        inside = n(r.randrange(3, 9)) + good  # the end of a longer number, groups of a list of amounts
        return r.choice((grouped(wrong), f"{good}{n(5)}", inside, f"978{n(10)}", " ".join(lead(3) for _ in range(6)), ".".join(lead(3) for _ in range(5)))), False
    if real:
        return r.choice((
            f"+{r.randrange(1, 99)} ({n(3)}) {n(3)}-{n(4)}", f"({lead(3)}) {n(3)}-{n(4)}", f"{lead(3)}-{n(3)}-{n(4)}", f"{lead(3)}.{n(3)}.{n(4)}", f"({lead(3)}) {n(3)} {n(4)}", f"00{lead(2)} {n(2)} {n(7)}", f"00{lead(2)}-{n(3)}-{n(6)}",
            f"0{lead(2)} {n(7)}", f"0{lead(3)}/{n(6)}", f"0{lead(1)} {n(2)} {n(2)} {n(2)} {n(2)}", f"({lead(3)}){n(3)}-{n(4)}", f"1-{lead(3)}-{n(3)}-{n(4)}",
        )), True
    year, month, day = r.randrange(1900, 2100), f"{r.randrange(1, 13):02d}", f"{r.randrange(1, 29):02d}"
    return r.choice((
        f"{year}-{month}-{day}", f"{day}.{month}.{year}", f"{day}/{month}/{year}", f"{year}-{year + r.randrange(9)}", f"{lead(2)} {n(3)} {n(3)}", f"{lead(1)} {n(3)} {n(3)}.{n(2)}", f"978-{n(1)}-{n(2)}-{n(6)}-{n(1)}", lead(r.randrange(7, 16)),
        f"{lead(4)}.{n(4)}", f"{year} {year + 1}", f"{lead(5)} {lead(5)}", f"{year}-{month}-{day} {r.randrange(24):02d}.{n(2)}", f"{lead(3)} {lead(3)} {lead(3)}", f"{lead(2)}-{lead(3)}-{lead(2)}", f"{lead(16)}", f"{lead(3)}.{lead(3)}.{lead(3)}",
    )), False


def examples(contexts: list[str], per_kind: int = EXAMPLES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and kinds of written examples in contexts; the same for the same contexts in any order.

    Every candidate in an example counts: personal data are those that are the whole of it, or whole numbers
    repeated in it. What only overlaps them is nobody's data, unless it is nearly the whole.
    """
    r = random.Random(seed)
    pool = sorted(set(contexts)) or ["lorem ipsum dolor sit amet consectetur"]
    names = sorted({w.lower() for c in pool for w in re.findall(r"[A-Za-z]{2,10}", c)}) or ["name", "other"]
    x, y, kinds = [], [], []
    for kind in range(len(KINDS)):
        for _ in range(per_kind):
            said, real = _written(r, kind, lambda: r.choice(names))
            before, after = r.choice(pool)[: r.randrange(8, 30)], r.choice(pool)[: r.randrange(0, 30)]
            cue = r.random()
            if cue < (0.5 if real else 0.08):
                before += " " + r.choice(CUES[kind]) + r.choice((" ", ": ", ":"))
            elif not real and cue < 0.5:
                before += " " + r.choice(OTHERS) + " "
            else:
                before += r.choice((" ", " ", " ", ", ", " (", ": ", "\n"))
            text = before + said + r.choice((" ", " ", ". ", ", ", ")", "###", "\n")) + after
            a, b = len(before), len(before) + len(said)
            parts = [(a, b)]
            if real and kind == 2 and " " in said and said[: len(said) // 2] == said[len(said) // 2 + 1 :]:
                parts = [(a, a + len(said) // 2), (b - len(said) // 2, b)]
            base = base_spans(text)
            for s in _free(candidates(text), sorted((p, q) for _, p, q in base)):
                hit = real and s[0] == kind and any(abs(s[1] - p) + abs(s[2] - q) <= 1 for p, q in parts)
                if s[1] < b and a < s[2] and (hit or not real or s[0] == kind):
                    x.append(features(text, s))
                    y.append(int(hit))
                    kinds.append(s[0])
    return np.array(x, float).reshape(-1, FEATURES), np.array(y, np.int64), np.array(kinds, np.int64)


@dataclass
class Boosted:
    """Depth-2 trees on features cut at quantiles: (feature, cut, feature, cut) and four values each."""

    base: float = 0.0
    trees: list[tuple[int, float, tuple[tuple[int, float], tuple[int, float]], tuple[float, float, float, float]]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, c, ((fl, cl), (fr, cr)), (a, b, d, e) in self.trees:
            out += np.where(x[:, f] <= c, np.where(x[:, fl] <= cl, a, b), np.where(x[:, fr] <= cr, d, e))
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE) -> Boosted:
    """Newton boosting of the logistic loss; ties go to the first feature and cut."""
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
    model = Boosted(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 25))) for f in range(x.shape[1])]
    below = [[x[:, f] <= c for c in cuts[f]] for f in range(x.shape[1])]
    raw = np.full(len(y), model.base)

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, float, np.ndarray]:
        best = (0.0, 0, float(cuts[0][0]), below[0][0])
        G, H = g[rows].sum(), h[rows].sum()
        for f, own in enumerate(below):
            for c, left in zip(cuts[f], own, strict=True):
                both = rows & left
                gl, hl = g[both].sum(), h[both].sum()
                gain = gl * gl / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G * G / (H + 1)
                if gain > best[0] + 1e-9:
                    best = (float(gain), f, float(c), left)
        return best

    everything = np.ones(len(y), bool)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        g, h = y - p, p * (1 - p)
        _, f, c, left = split(everything, g, h)
        halves, values = [], []
        for rows in (left, ~left):
            _, f2, c2, l2 = split(rows, g, h)
            halves.append((f2, c2))
            for leaf in (rows & l2, rows & ~l2):
                values.append(float(rate * g[leaf].sum() / (h[leaf].sum() + 1)))
                raw[leaf] += values[-1]
        model.trees.append((f, c, (halves[0], halves[1]), tuple(values)))
    return model


@dataclass
class Detector:
    model: Boosted
    thresholds: tuple[float, ...]

    def spans(self, text: str | None) -> tuple[list[Span], list[Span]]:
        """Base spans, and those that the model adds."""
        if not text:
            return [], []
        base = base_spans(text)
        found = candidates(text)
        if not found:
            return base, []
        taken = sorted((a, b) for _, a, b in base)
        free = _free(found, taken)
        if not free:
            return base, []
        score = self.model.score(np.array([features(text, s) for s in free], float))
        good = sorted(((-p, s) for p, s in zip(score.tolist(), free, strict=True) if p >= self.thresholds[s[0]]), key=lambda e: (e[0], e[1]))
        added: list[Span] = []
        if len(good) > 1:
            # best first; places taken so far are kept as a sorted list
            from bisect import bisect_left, insort

            held: list[tuple[int, int]] = []
            for _, s in good:
                k = bisect_left(held, (s[1], s[2]))
                if (k == 0 or held[k - 1][1] <= s[1]) and (k == len(held) or held[k][0] >= s[2]):
                    insort(held, (s[1], s[2]))
                    added.append(s)
        else:
            added = [s for _, s in good]
        return base, added


def _free(found: list[Span], taken: list[tuple[int, int]]) -> list[Span]:
    """Candidates that overlap none of the taken ranges."""
    if not taken:
        return found
    starts = np.array([a for a, _ in taken])
    reach = np.maximum.accumulate(np.array([b for _, b in taken]))
    k = np.searchsorted(starts, [e for _, _, e in found], "left") - 1  # the last range that begins before the candidate ends
    return [s for s, i in zip(found, k.tolist(), strict=True) if i < 0 or reach[i] <= s[1]]


def fit(docs: DataFrame, text: str = "text", sample_documents: int = SAMPLE_DOCUMENTS, precision: float = PRECISION, per_kind: int = EXAMPLES) -> Detector:
    """A detector from written examples in contexts of at most about sample_documents documents."""
    rows = docs.select(F.col(f"`{text}`").alias("t")).where(F.length("t") > 0)
    hashed = F.pmod(F.xxhash64("t", F.lit(SEED)), F.lit(1 << 30))
    total = rows.count()
    chosen = rows.where(hashed < int((1 << 30) * min(1.0, sample_documents / max(total, 1))))
    # 30 characters of each, at a place by its hash; a copy gives the same ones
    place = (F.pmod(F.xxhash64("t"), F.length("t").cast("long")) + 1).cast("int")
    contexts = [row[0] for row in chosen.select(F.translate(F.substring("t", place, F.lit(30)), "0123456789", "").alias("c")).distinct().collect()]
    x, y, kind = examples(contexts, per_kind)
    half = np.arange(len(y)) % 2 == 0
    model = fit_trees(x[half], y[half].astype(float))
    score = model.score(x[~half])
    thresholds = []
    for r in range(len(KINDS)):
        own = kind[~half] == r
        s, t = score[own], y[~half][own]
        by = np.argsort(-s, kind="stable")
        # a threshold takes all of a score, so it may lie only where the score falls
        ends = np.flatnonzero((np.cumsum(t[by]) >= precision * np.arange(1, len(by) + 1)) & np.append(np.diff(s[by]) < 0, True))
        # no threshold that is good enough: nothing is added
        thresholds.append(float(s[by][ends[-1]]) if len(ends) else 2.0)
    return Detector(model, tuple(thresholds))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[r]}:{a}:{b}" for r, a, b in spans)


def detect(docs: DataFrame, detector: Detector, text: str = "text") -> DataFrame:
    """docs without the text, with counts and digest of the base spans and all spans, by kind, then start."""
    keep = [c for c in docs.columns if c != text]
    names = [clean_name(keep, c) for c in (*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added")]
    types = [T.LongType()] * 4 + [T.StringType(), T.StringType(), T.LongType()]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, t) for n, t in zip(names, types, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, text):
                counts: list[list[int]] = [[], [], [], []]
                digest, spans, more = [], [], []
                for t in part.column(part.schema.get_field_index(text)).to_pylist():
                    base, added = detector.spans(t)
                    for r in range(4):
                        counts[r].append(sum(1 for s in base if s[0] == r))
                    digest.append(hashlib.sha256(written(base).encode()).hexdigest())
                    spans.append(written(sorted(base + added)))
                    more.append(len(added))
                columns = [part.column(part.schema.get_field_index(c)) for c in keep]
                made = [*(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(more, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *made], names=[*keep, *names])

    ship(docs.sparkSession)
    return docs.select(*(f"`{c}`" for c in [*keep, text])).mapInArrow(run, schema)


def redact(docs: DataFrame, detector: Detector, text: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets, such as [EMAIL]; of overlapping spans the whole
    stretch, by the kind of the first. Null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, text):
                k = part.schema.get_field_index(text)
                changed = pa.array([None if t is None else redacted(t, sum(detector.spans(t), [])) for t in part.column(k).to_pylist()], pa.string())
                yield part.set_column(k, part.schema.field(k), changed.cast(part.schema.field(k).type))

    ship(docs.sparkSession)
    return docs.select(*(f"`{c}`" for c in docs.columns)).mapInArrow(run, docs.schema)


def redacted(text: str, spans: list[Span]) -> str:
    out, at, end = [], 0, -1
    for a, r, b in sorted((a, r, b) for r, a, b in spans):
        if a >= end:
            out += [text[at:a], f"[{KINDS[r].upper()}]"]
        end = max(end, b)
        at = end
    return "".join([*out, text[at:]])
