"""Personal data by patterns and a skip-chain conditional random field.

The patterns (e-mail, IP address, payment card, phone) are exact and always stay.  The field
adds mentions that the patterns miss, by the company they keep: its nodes are the tokens with a digit
or an at sign, labelled with one of the kinds or none.  Neighbouring tokens share chain
potentials; distant tokens of the same document that repeat each other (same string, or
same digits) share skip potentials, so a mention that is clear in one place pulls its
repetitions to the same label.  Loopy sum-product message passing gives the marginals of all
documents of a block at once; skip edges join each token to its next occurrence only, so their
number is linear in the text.

The weights are fitted by pseudo-likelihood on the tokens of a sample: documents whose hash
falls under a threshold that yields ``SAMPLE_DOCS`` documents on average, at most ``SAMPLE_TOKENS``
tokens.  The labels there are the patterns' own matches.  Finding runs over all documents
and whole texts, without a shuffle.

Defined results: a null or empty text has no spans; repeated rows give repeated results; null ids are
kept; extra columns are carried by ``find`` and ``redact``.
"""

from __future__ import annotations

import re
import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneflow.llm.common import blocks, ship, text_of, texts_of

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 10_000
SAMPLE_TOKENS = 20_000
FEATURES = 1 << 14
MIN_MARGINAL = 0.95
ROUNDS = 12
FIT_ROUNDS = 80
AGREE = 2.0         # prior skip potential of equal labels; the sample moves it

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MENTION = re.compile(r"[0-9@]\S*")
DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from the at signs: the local part is the run before it (not
    reaching into the previous match), so a long run of letters is read once."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Four dotted numbers at a time from each maximal dotted run."""
    out = []
    for m in DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        at, parts = m.start(), m[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, at + size))
            at += size + 1
    return out


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in NUMBER.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in PHONE.finditer(text) if 8 <= len(DIGITS.findall(m[0])) <= 15]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), by kind, then start."""
    return [(k, a, b) for k, find in enumerate((emails, addresses, cards, phones)) for a, b in find(text)]


# -- the field
def tokens(text: str) -> list[tuple[int, int]]:
    """Blank-separated tokens with a digit or an at sign."""
    out, end = [], 0
    for m in MENTION.finditer(text):
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        out.append((start, m.end()))
        end = m.end()
    return out


def shape(token: str) -> str:
    """Character classes, runs kept up to four long."""
    s = re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_]", "a", token[:64]))
    return re.sub(r"(.)\1{4,}", r"\1\1\1\1", s)


def node_features(text: str, spans: list[tuple[int, int]]) -> list[list[int]]:
    """Hashed features of each token: its own form and the form of tokens next to it."""
    forms = []
    for a, b in spans:
        t = text[a:b]
        digits = "".join(DIGITS.findall(t))
        f = ["s" + shape(t), "d%d" % min(len(digits), 24), "at%d" % min(t.count("@"), 2), "dots%d" % min(t.count("."), 5), "c" + t[0]]
        if 16 <= len(digits) <= 19:
            f.append("luhn%d" % luhn(digits))
        if t.count(".") >= 3 and t.replace(".", "").isdigit():
            f.append("octets%d" % bool(addresses(t)))
        forms.append(f)
    out = []
    for i, f in enumerate(forms):
        near = ["L" + forms[i - 1][0]] if i and spans[i][0] - spans[i - 1][1] <= 2 else ["L-"]
        near += ["R" + forms[i + 1][0]] if i + 1 < len(forms) and spans[i + 1][0] - spans[i][1] <= 2 else ["R-"]
        both = [f[0] + near[0], f[0] + near[1]]
        out.append([zlib.crc32(x.encode("utf-8", "surrogatepass")) % FEATURES for x in ["bias", *f, *near, *both]])
    return out


def edges(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(type, i, j): 0 chain (tokens side by side), 1 skip (the next token that repeats i)."""
    out = [(0, i, i + 1) for i, (x, y) in enumerate(pairwise(spans)) if y[0] - x[1] <= 2]
    last: dict[str, int] = {}
    for i, (a, b) in enumerate(spans):
        t = text[a:b].strip(".,;:!?()[]<>\"'").lower()
        digits = "".join(DIGITS.findall(t))
        joined = set()
        for key in ("t" + t, "d" + digits if len(digits) >= 5 else ""):
            if key:
                j = last.get(key)
                if j is not None and j not in joined:
                    out.append((1, j, i))
                    joined.add(j)
                last[key] = i
    return out


class Field:
    """Weights: ``node`` (features x labels), ``pair`` (chain and skip, labels x labels)."""

    def __init__(self, node: np.ndarray, pair: np.ndarray):
        self.node, self.pair = node, pair

    def scores(self, features: list[list[int]]) -> np.ndarray:
        size = np.fromiter(map(len, features), np.int64, len(features))
        flat = np.fromiter((x for f in features for x in f), np.int64, int(size.sum()))
        return np.add.reduceat(self.node[flat], np.cumsum(size) - size, axis=0)

    def marginals(self, features: list[list[int]], links: list[tuple[int, int, int]]) -> np.ndarray:
        """Loopy sum-product over the graph; documents are its components."""
        score = self.scores(features)
        if links:
            e = np.array(links)
            # each edge carries a message both ways
            kind, src, dst = np.tile(e[:, 0], 2), np.concatenate([e[:, 1], e[:, 2]]), np.concatenate([e[:, 2], e[:, 1]])
            m = len(e)
            back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
            table = np.where((np.arange(2 * m) < m)[:, None, None], self.pair[kind], self.pair[kind].transpose(0, 2, 1))
            msg = np.zeros((2 * m, score.shape[1]))
            for _ in range(ROUNDS):
                belief = score.copy()
                np.add.at(belief, dst, msg)
                x = (belief[src] - msg[back])[:, :, None] + table
                top = x.max(axis=1)
                new = top + np.log(np.exp(x - top[:, None, :]).sum(axis=1))
                new -= new.max(axis=1, keepdims=True)
                if np.abs(new - msg).max() < 1e-3:
                    break
                msg = (msg + new) / 2  # damping keeps loops from swinging
            np.add.at(score, dst, msg)
        score = np.exp(score - score.max(axis=1, keepdims=True))
        return score / score.sum(axis=1, keepdims=True)


def fit_field(features: list[list[int]], links: list[tuple[int, int, int]], labels: np.ndarray) -> Field:
    """Pseudo-likelihood with Adam steps: a token given the labels of the tokens it is linked to."""
    k = len(KINDS) + 1
    prior = np.stack([np.zeros((k, k)), AGREE * np.eye(k)])
    node, pair = np.zeros((FEATURES, k)), prior.copy()
    if not len(labels):
        node[:, 0] = 1.0  # nothing learned: every token is none
        return Field(node, pair)
    size = np.fromiter(map(len, features), np.int64, len(features))
    flat = np.fromiter((x for f in features for x in f), np.int64, int(size.sum()))
    used, flat = np.unique(flat, return_inverse=True)
    rows, begin = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
    e = np.array(links, dtype=np.int64).reshape(-1, 3)
    target = np.eye(k)[labels]
    w = np.zeros((len(used), k))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(pair), np.zeros_like(pair)]
    for step in range(1, FIT_ROUNDS + 1):
        s = np.add.reduceat(w[flat], begin, axis=0)
        np.add.at(s, e[:, 2], pair[e[:, 0], labels[e[:, 1]]])
        np.add.at(s, e[:, 1], pair[e[:, 0], :, labels[e[:, 2]]])
        p = np.exp(s - s.max(axis=1, keepdims=True))
        g = target - p / p.sum(axis=1, keepdims=True)
        gw = np.stack([np.bincount(flat, g[rows, c], len(used)) for c in range(k)], axis=1) - 0.05 * w
        gp = -0.05 * (pair - prior)
        np.add.at(gp, (e[:, 0], labels[e[:, 1]]), g[e[:, 2]])
        np.add.at(gp, (e[:, 0], slice(None), labels[e[:, 2]]), g[e[:, 1]])
        for x, d, m, v in ((w, gw, *moments[:2]), (pair, gp, *moments[2:])):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            x += 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    node[used] = w
    return Field(node, pair)


def label_tokens(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[int]:
    """0, or 1 + the kind of a pattern match that overlaps the token."""
    out, marks = [], sorted((a, b, k) for k, a, b in base)
    i = 0
    for a, b in spans:
        while i < len(marks) and marks[i][1] <= a:
            i += 1
        out.append(marks[i][2] + 1 if i < len(marks) and marks[i][0] < b else 0)
    return out


def train(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS, sample_tokens: int = SAMPLE_TOKENS) -> Field:
    """Fit the field on the sample; at most ``sample_tokens`` short rows reach the driver."""
    ship(docs.sparkSession)
    n = max(1, docs.count())
    t = text_of(text)
    sample = docs.where(F.pmod(F.xxhash64(F.lit(5), t), F.lit(n)) < sample_docs).select(t.alias("t"))

    def run(batches):
        for batch in batches:
            for part in blocks(batch, 0):
                rows = []
                for x in texts_of(part.column(0)):
                    s = tokens(x)[:sample_tokens]
                    if s:
                        links = [v for e in edges(x, s) for v in e]
                        rows.append((node_features(x, s), label_tokens(s, base_spans(x)), links, len(s)))
                if rows:
                    kinds = (pa.list_(pa.list_(pa.int32())), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                     names=["features", "labels", "links", "n"])

    found = sample.mapInArrow(run, "features array<array<int>>, labels array<int>, links array<int>, n int").limit(sample_tokens // 4)
    features, links, labels = [], [], []
    for r in found.toLocalIterator():
        if len(labels) + r["n"] > sample_tokens:
            continue
        at = len(labels)
        features += r["features"]
        labels += r["labels"]
        links += [(r["links"][i], at + r["links"][i + 1], at + r["links"][i + 2]) for i in range(0, len(r["links"]), 3)]
    return fit_field(features, links, np.array(labels, dtype=np.int64))


def all_spans(texts: list[str], field: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(pattern spans, all spans) of each text; a span is (kind number, start, end)."""
    base = [base_spans(t) for t in texts]
    spans = [tokens(t) for t in texts]
    features, links, first = [], [], []
    for t, s in zip(texts, spans, strict=True):
        first.append(len(features))
        if s:
            links += [(e, i + len(features), j + len(features)) for e, i, j in edges(t, s)]
            features += node_features(t, s)
    p = field.marginals(features, links) if features else np.zeros((0, len(KINDS) + 1))
    best, sure = p.argmax(axis=1), p.max(axis=1, initial=0) >= MIN_MARGINAL
    out = []
    for t, b, s, at in zip(texts, base, spans, first, strict=True):
        covered = label_tokens(s, b)
        added: list[list[int]] = []
        for i, (a, z) in enumerate(s):
            k = int(best[at + i]) - 1
            if k < 0 or not sure[at + i] or covered[i]:
                continue
            if KINDS[k] == "card" and not luhn("".join(DIGITS.findall(t[a:z]))):
                continue  # a card number has its check digit
            while z > a and t[z - 1] in ".,;:!?":
                z -= 1
            if added and added[-1][0] == k and added[-1][3] == i - 1 and a - added[-1][2] <= 2:
                added[-1][2:] = [z, i]  # tokens side by side are one mention
            elif z > a:
                added.append([k, a, z, i])
        out.append((b, sorted(b + [(k, a, z) for k, a, z, _ in added])))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _map(df: DataFrame, field: Field, text: str, make, schema: T.StructType) -> DataFrame:
    """Run ``make(record batch, texts, spans)`` over blocks of rows; the weights go to each
    executor once (a table of fixed size)."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((field.node.astype(np.float32), field.pair))
    at = df.columns.index(text)

    def run(batches):
        f = Field(*shared.value)
        for batch in batches:
            for part in blocks(batch, at):
                texts = texts_of(part.column(at))
                yield pa.RecordBatch.from_arrays(make(part, texts, all_spans(texts, f)), names=[x.name for x in schema.fields])

    return df.mapInArrow(run, schema)


def find(df: DataFrame, field: Field, text: str = "text", out: str = "spans") -> DataFrame:
    """All columns of ``df`` plus ``out``: array of (kind, start, end) in code points."""
    df = df.drop(out)
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def make(part, texts, spans):
        col = [[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in every] for _, every in spans]
        return [*part.columns, pa.array(col, struct)]

    return _map(df, field, text, make, T.StructType([*df.schema.fields, T.StructField(out, SPANS)]))


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each span replaced by its kind in angle brackets; spans that overlap merge."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """``df``, same columns, with personal data in ``text`` masked; a null text stays null."""
    at = df.columns.index(text)

    def make(part, texts, spans):
        new = [None if null else mask(t, every) for t, (_, every), null in zip(texts, spans, part.column(at).is_null().to_pylist(), strict=True)]
        return [pa.array(new, pa.string()) if i == at else c for i, c in enumerate(part.columns)]

    return _map(df, field, text, make, df.schema)


def line(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def digest(docs: DataFrame) -> DataFrame:
    """The registered query's columns."""
    import hashlib
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))

    def make(part, texts, spans):
        n = [[sum(k == kind for k, _, _ in base) for base, _ in spans] for kind in range(len(KINDS))]
        return [part.column(0), *[pa.array(x, pa.int64()) for x in n],
                pa.array([hashlib.sha256(line(base).encode()).hexdigest() for base, _ in spans]),
                pa.array([line(every) for _, every in spans], pa.string())]

    schema = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS],
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    return _map(df, train(docs), "text", make, schema)
