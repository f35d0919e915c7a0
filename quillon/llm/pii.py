"""Personal data: base patterns, and spans that a character-level BiLSTM-CRF adds.

Every kind of span here holds a digit or an at sign, written as such or in brackets, so only the stretches around these, with context on both sides, can
hold one; these are cut into overlapping windows for the network. Where windows overlap, a character's scores come
from the window in which it lies farthest from an edge, and one Viterbi pass decodes the whole stretch. A decoded span is
added if it passes its kind's check and touches no base span. Texts are read where they lie; nothing is shuffled.

The network is trained on the driver from labelled spans: those of the base patterns in a bounded sample of
documents, and generated ones whose spellings the base patterns miss.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillon.llm.bilstm_crf import BiLstmCrf, encode
from quillon.llm.common import sample_ids, slices, text_of

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
LABELS = ["O", *(f"{b}-{k}" for k in KINDS for b in "BI")]
WINDOW, STRIDE, CONTEXT = 96, 48, 20
#: Documents whose base spans train the network, by hash order of the id.
SAMPLE, PER_DOCUMENT = 300, 20
GENERATED, EPOCHS = 4000, 8

_AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]+|[\[({]at[\])}]", re.IGNORECASE)
#: Spelt-out forms of the at sign and the dot.
_AT_FORM = re.compile(r"\s*(?:@|[\[({]\s?at\s?[\])}])\s*", re.IGNORECASE)
_DOT_FORM = re.compile(r"\s*(?:\.|[\[({]\s?dot\s?[\])}])\s*", re.IGNORECASE)
_SECRET = re.compile(r"(?<![0-9A-Za-z])(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,64}(?![0-9A-Za-z])")

_BEFORE = re.compile(r"""[\s=:"']+""")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches, in time linear in the text: the local part is read backwards from each at sign."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _AT_DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end(), "email"
            done = m.end()
        else:
            done = at + 1  # no local part reaches across an at sign
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds by start, then kind as listed. Matches that fail their check are dropped, not retried."""
    if not _TRIGGER.search(text):
        return []
    out = list(_emails(text))
    out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    out += [(m.start(), m.end(), "card") for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=_place)


def _place(span: Span) -> tuple[int, int]:
    return span[0], KINDS.index(span[2])


def _valid(kind: str, text: str) -> bool:
    """What an added span must hold to be of its kind at all; which one it is, and where it ends, the network says."""
    digits = _digits(text)
    if kind == "email":
        plain = _AT_FORM.sub("@", _DOT_FORM.sub(".", text), count=1)
        return plain.count("@") == 1 and bool(re.fullmatch(r"[^\s@]+@[^\s@.]+(\.[^\s@.]+)+", plain))
    if kind == "ip":
        parts = re.split(r"\s?[.,]\s?|\[\.\]", text)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[A-Za-z]", text)
    if kind == "phone":
        return 9 <= len(digits) <= 15 and text[0] in "+(0123456789" and bool(re.fullmatch(r"[0-9+().\x20/-]+", text)) and len(re.findall(r"[0-9]+", text)) > 1
    return len(text) >= 12 and bool(digits) and bool(re.search(r"[A-Za-z]", text)) and not re.search(r"\s", text)


#: Characters of addresses; a stretch ends where a run of them does.
_RUN = re.compile(r"[A-Za-z0-9._%+@-]*")
_RUN_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+@-")


def stretches(text: str) -> list[tuple[int, int]]:
    """Where a span can lie: around digits and at signs, written as such or in brackets, with context and to the end of the run of
    address characters there; merged where they meet."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        floor = out[-1][1] if out else 0
        if m.end() + CONTEXT <= floor:
            continue
        s, e = max(0, m.start() - CONTEXT), _RUN.match(text, min(len(text), m.end() + CONTEXT)).end()
        while s > floor and text[s - 1] in _RUN_CHARACTERS:
            s -= 1
        if out and s <= floor:
            out[-1][1] = max(e, floor)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _windows(n: int) -> list[int]:
    """Starts of overlapping windows over ``n`` characters; the last one ends with them."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def _source(n: int) -> np.ndarray:
    """For each of ``n`` characters the number of the window in which it lies farthest from an edge."""
    starts = np.array(_windows(n))
    if len(starts) == 1:
        return np.zeros(n, dtype=np.int64)
    # The centres' midpoints divide the characters among the windows.
    return np.searchsorted((starts[1:] + starts[:-1] + WINDOW) / 2, np.arange(n), side="right")


class Tagger:
    def __init__(self, model: BiLstmCrf) -> None:
        self.model = model

    def _emissions(self, codes: list[np.ndarray]) -> list[np.ndarray]:
        """Reconciled emissions of each stretch."""
        cuts = [(i, s) for i, c in enumerate(codes) for s in _windows(len(c))]
        out = [np.empty((len(c), len(LABELS)), np.float32) for c in codes]
        source = [_source(len(c)) for c in codes]
        number = 0
        order = 0
        for at in range(0, len(cuts), 512):
            part = cuts[at : at + 512]
            batch = np.zeros((len(part), WINDOW), np.uint8)
            for r, (i, s) in enumerate(part):
                c = codes[i][s : s + WINDOW]
                batch[r, : len(c)] = c
            width = max(min(len(codes[i]) - s, WINDOW) for i, s in part)
            e = self.model.emissions(batch[:, :width])
            for r, (i, s) in enumerate(part):
                number = 0 if s == 0 else order + 1
                order = number
                own = np.nonzero(source[i][s : s + WINDOW] == number)[0]
                out[i][s + own] = e[r, own]
        return out

    def added(self, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
        """Spans that the network adds to the base spans of each text."""
        places = [(t, s, e) for t, text in enumerate(texts) for s, e in stretches(text)]
        places.sort(key=lambda p: p[2] - p[1])
        out: list[list[Span]] = [[] for _ in texts]
        at = 0
        while at < len(places):
            take = 1  # batches of like lengths, at most about 64 thousand characters unless one stretch is longer
            while at + take < len(places) and take < 512 and (take + 1) * (places[at + take][2] - places[at + take][1]) <= 1 << 16:
                take += 1
            part = places[at : at + take]
            at += take
            found = self._emissions([encode(texts[t][s:e]) for t, s, e in part])
            lengths = np.array([len(x) for x in found])
            e = np.zeros((len(part), lengths.max(), len(LABELS)), np.float32)
            for r, x in enumerate(found):
                e[r, : len(x)] = x
            for (t, s, _), tags in zip(part, self.model.decode(e, lengths), strict=True):
                out[t] += self._spans(texts[t], s, tags, base[t])
        return [sorted(x, key=_place) for x in out]

    def _spans(self, text: str, offset: int, tags: np.ndarray, base: list[Span]) -> Iterator[Span]:
        marked = np.nonzero(tags)[0]
        if not len(marked):
            return
        for run in np.split(marked, np.nonzero(np.diff(marked) > 1)[0] + 1):
            starts = [int(i) for i in run if LABELS[tags[i]][0] == "B"]
            for s, e in zip(starts, [*starts[1:], int(run[-1]) + 1], strict=True):
                kind, (s, e) = LABELS[tags[s]][2:], (s + offset, e + offset)
                while e > s and text[e - 1] in " .,;:)(" and not (kind == "phone" and text[e - 1] == ")"):
                    e -= 1
                if kind == "phone" and s and text[s - 1] == "(" and ")" in text[s:e]:
                    s -= 1
                # A span that took in words before it begins after them.
                s = next((at for at in (s, *(s + m.end() for m in _BEFORE.finditer(text[s:e]))) if at < e and _valid(kind, text[at:e])), -1)
                if s >= 0 and not any(b[0] < e and s < b[1] for b in base):
                    yield s, e, kind


def _generated(rng: random.Random, n: int) -> list[tuple[str, list[Span]]]:
    """Labelled windows: entities in spellings of which the base patterns know some, or numbers and codes that are none, between invented words."""
    syllables = "an er the ti on re ing ent la de ou es te ver ge cha lo mi que ra na sch ble is".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    written = lambda: rng.choice([str.lower, str.lower, str.lower, str.capitalize, str.upper])(word())
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    pick = lambda characters, k: "".join(rng.choice(characters) for _ in range(k))
    octet = lambda: str(rng.randint(0, 255))
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def card() -> str:
        body = digits(15)
        body += next(d for d in "0123456789" if luhn(body + d))
        return rng.choice(["", " ", "-", ".", "  ", "/"]).join(body[i : i + 4] for i in range(0, 16, 4))

    def email() -> str:
        host = [word() + rng.choice(["", digits(1), "-" + word()]), rng.choice(["example", word()]), rng.choice(["com", "org", "net", "de", "fr", "io", "info"])][rng.randint(0, 1) :]
        at = rng.choice(["@", "@", " @ ", "@ ", " (at) ", "(at)", "[at]", " [at] "])
        dot = rng.choice([" . ", ".", "(dot)", "[dot]", " [dot] "]) if at != "@" else rng.choice([".", ".", " . ", "[dot]"])
        return (word() + rng.choice(["", "." + word(), digits(2), "_" + word(), "-" + digits(1)])) + at + dot.join(host)

    def phone() -> str:
        code, d = f"+{rng.randint(1, 99)}", digits
        forms = [f"{code} ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{code} {d(3)} {d(7)}", f"00{rng.randint(30, 49)}-{d(3)}-{d(6)}",
                 f"{d(3)}.{d(3)}.{d(4)}", f"0{d(3)}/{d(7)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(2)} {d(4)} {d(4)}", f"{d(3)} {d(3)} {d(4)}", f"({d(3)}){d(3)}-{d(4)}"]
        return rng.choice(forms)

    def secret() -> str:
        every = lower + upper + "0123456789"
        return rng.choice([
            lambda: pick("0123456789abcdef", rng.choice([32, 40, 40, 40, 48])), lambda: pick(every, rng.randint(20, 40)) + digits(1), lambda: pick(upper, 4) + pick(upper + "0123456789", 15) + digits(1),
            lambda: pick(lower, 2) + rng.choice("_-") + pick(every, rng.randint(20, 36)) + digits(1), lambda: pick("0123456789ABCDEF", 32),
        ])()

    make = {"email": email, "ip": lambda: rng.choice([".", ".", ". ", ",", "[.]"]).join(octet() for _ in range(4)), "card": card, "phone": phone, "secret": secret}
    plain = [
        lambda: digits(rng.randint(1, 7)), lambda: f"20{digits(2)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}.{digits(2)}.20{digits(2)}", lambda: f"{digits(1)}.{digits(1)}", lambda: f"{digits(1)}.{digits(1)}.{digits(2)}",
        lambda: f"{digits(2)}:{digits(2)}", lambda: "@" + word(), lambda: f"{digits(2)},{digits(3)}", lambda: f"{digits(2)}%", lambda: digits(rng.randint(8, 12)), lambda: f"19{digits(2)}-19{digits(2)}", lambda: f"{digits(3)}-{digits(3)}", lambda: f"{digits(1)}-{digits(1)}, {digits(2)}-{digits(1)}", lambda: word() + digits(2),
        lambda: pick(upper, 2) + "-" + digits(4), lambda: f"{digits(3)},{digits(3)},{digits(3)}", lambda: f"{digits(2)}/{digits(2)}/{digits(4)}", lambda: f"({digits(2)})", lambda: word() + "(at)" + " " + word(), lambda: f"{digits(4)} {digits(4)}", lambda: digits(rng.choice([16, 18, 20])),
    ]
    out = []
    for _ in range(n):
        text, spans = " ".join(written() for _ in range(rng.randint(0, 5))), []
        for _ in range(rng.randint(1, 2)):
            text += rng.choice([" ", ": ", ', "', " (", " | ", "### "])
            if rng.random() < 0.7:
                kind = rng.choice(KINDS)
                if kind == "secret" and rng.random() < 0.7:
                    name = rng.choice(["token", "key", "secret", "api_key", "password", "auth"])
                    text += rng.choice([name, name, name.upper(), name.capitalize()]) + rng.choice([' = "', ": ", "="])
                value = make[kind]()
                spans.append((len(text), len(text) + len(value), kind))
                text += value
            else:
                text += rng.choice(plain)()
            text += rng.choice([" ", ". ", ", ", '" ', ") ", "### ", "\n"]) + " ".join(written() for _ in range(rng.randint(0, 4)))
        if len(text) <= WINDOW:
            out.append((text, spans))
    return out


def _labelled(text: str) -> list[tuple[str, list[Span]]]:
    """Windows of a text with the base spans, and long hexadecimal secrets, that lie in them whole."""
    spans = base_spans(text)
    spans += [(m.start(), m.end(), "secret") for m in _SECRET.finditer(text) if not any(b[0] < m.end() and m.start() < b[1] for b in spans)]
    out = []
    for s, e in ((s + w, min(e, s + w + WINDOW)) for s, e in stretches(text) for w in _windows(e - s)):
        inside, last = [], s
        for b in sorted(spans, key=_place):
            if b[0] >= last and b[1] <= e:
                inside.append((b[0] - s, b[1] - s, b[2]))
                last = b[1]
        if not any(b[0] < e < b[1] or b[0] < s < b[1] for b in spans):
            out.append((text[s:e], inside))
    return out


def fit(texts: list[str], generated: int = GENERATED, epochs: int = EPOCHS, seed: int = 7) -> BiLstmCrf:
    """Train on all windows of ``texts`` and about ``generated`` others."""
    examples = _generated(random.Random(seed), generated) + [x for t in texts for x in _labelled(t)]
    codes, tags = np.zeros((len(examples), WINDOW), np.uint8), np.zeros((len(examples), WINDOW), np.int64)
    for r, (text, spans) in enumerate(examples):
        codes[r, : len(text)] = encode(text)
        for s, e, kind in spans:
            tags[r, s:e] = LABELS.index(f"I-{kind}")
            tags[r, s] = LABELS.index(f"B-{kind}")
    model = BiLstmCrf(LABELS, seed)
    model.fit(codes, tags, np.array([len(t) for t, _ in examples]), epochs=epochs, batch=32, seed=seed)
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, a_document: int = PER_DOCUMENT) -> BiLstmCrf:
    """Fit on a bounded sample: of at most ``sample`` documents that have a digit or an at sign, out of twenty times as many, the first
    ``a_document`` windows of their stretches each, which, not texts, reach the driver; and generated windows. Nulls count as
    empty, repeated ids as one; an empty table leaves the generated windows alone."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [list(islice((t[s + w : min(e, s + w + WINDOW)] for s, e in stretches(t) for w in _windows(e - s)), a_document)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.list_(pa.string()))], names=["__id", "parts"])

    ids = F.broadcast(sample_ids(docs, id_col, 20 * sample))  # of fixed size
    narrow = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text")).join(ids, "__id", "left_semi").filter(F.col("__text").rlike("[0-9@]"))
    parts = narrow.mapInArrow(run, f"__id {id_type}, parts array<string>").orderBy(F.xxhash64("__id"), "__id").limit(sample)
    return fit([p for r in parts.collect() for p in r["parts"]])


def as_text(spans: Column) -> Column:
    """Spans of an array column as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


_SPANS = "array<struct<start:int,end:int,kind:string>>"
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def found_spans(docs: DataFrame, model: BiLstmCrf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, and three arrays of (start, end, kind): base, added, and spans, which is both; in order of
    start, then kind.

    Offsets count code points, ends are exclusive. Null text counts as empty. Spans of different kinds may overlap among
    the base spans; added ones overlap none of these. Equal texts get equal results; an empty table an empty one; other columns
    are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        column = lambda rows: pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in row] for row in rows], _SPANS_ARROW)
        for batch in batches:
            for part in slices(batch, 1, 256):
                texts = part.column(1).to_pylist()
                base = [base_spans(t) for t in texts]
                added = tagger.added(texts, base)
                both = [sorted(b + a, key=_place) for b, a in zip(base, added, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), column(base), column(added), column(both)], names=["__id", "base", "added", "spans"])

    narrow = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text"))
    return narrow.mapInArrow(run, f"__id {id_type}, base {_SPANS}, added {_SPANS}, spans {_SPANS}").withColumnRenamed("__id", id_col)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or union of overlapping spans, replaced by the first one's kind in angle brackets."""
    out, last = [], 0
    merged: list[list] = []
    for s, e, kind in sorted(spans, key=_place):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, kind])
    for s, e, kind in merged:
        out += [text[last:s], f"<{kind.upper()}>"]
        last = e
    return "".join([*out, text[last:]])


def redacted(docs: DataFrame, model: BiLstmCrf, text_col: str = "text") -> DataFrame:
    """``docs`` with the personal data in its text column replaced; null texts stay null, other columns pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    place = docs.columns.index(text_col)
    assert isinstance(docs.schema[text_col].dataType, StringType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            for part in slices(batch, place, 256):
                texts = part.column(place).to_pylist()
                known = [t or "" for t in texts]
                base = [base_spans(t) for t in known]
                added = tagger.added(known, base)
                new = [None if t is None else redact(t, b + a) for t, b, a in zip(texts, base, added, strict=True)]
                yield part.set_column(place, part.schema.field(place), pa.array(new, part.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)
