"""Personal data: rule spans plus a semi-Markov conditional random field over candidate segments.

Base spans are leftmost non-overlapping matches per kind:

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)        each part at most 255
    card   [0-9]([\\x20-]?[0-9])+                        13 to 19 digits that pass Luhn
    phone  \\+[0-9][\\x20().0-9-]+[0-9]                   9 to 15 digits

They are found from their rare characters (``@``, ``+``, digits) in time linear in the text, however long its runs are.

The random field segments the zones around digits and ``@`` into outside tokens and entities of at most ``MAX_TOKENS``
tokens. A candidate segment is scored as a whole (its digits, groups, separators, check sum, neighbours), and dynamic
programming over (end, length, kind) chooses boundaries and kinds together. Its weights maximise the penalised
conditional likelihood on a bounded sample of zones (``TRAIN_ZONES`` zones with the smallest hash, a documented
parameter), labelled by the base rules; each zone also stands there with its entities loosened (a phone without its
plus sign, a card with other separators), so that the model finds what the rules' fixed patterns miss, and spoiled (a
wrong check digit, an address part over 255), so that it keeps off what only looks alike. Found segments that touch no
base span are added; base spans always stay.

Defined results: null and empty texts have no spans; repeated rows get equal results; null ``doc_id`` is carried
through; without a zone in the table there is no model and only base spans (there are none then); an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from receivables.llm.common import pieces_of

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 16
TRAIN_ZONES = 400
ZONE_CHARS = 200  # of a training zone
STEPS, PENALTY = 80, 0.5
LEAST_SCORE = 2.0  # log odds that a segment needs over its tokens lying outside

Span = tuple[int, int]

_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NON_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def small_part(digits: str) -> bool:
    """Whether a part is at most 255."""
    bare = digits.lstrip("0")
    return len(bare) < 3 or len(bare) == 3 and bare <= "255"


def emails(text: str) -> list[Span]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def ips(text: str) -> list[Span]:
    out = []
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        at = run.start()
        parts = run.group().split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(map(small_part, four)):
                out.append((at, end))
            at = end + 1
    return out


def cards(text: str) -> list[Span]:
    out = []
    for run in _DIGITS.finditer(text):
        digits = _NON_DIGIT.sub("", run.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(run.span())
    return out


def phones(text: str) -> list[Span]:
    out, at = [], text.find("+")
    while at >= 0:
        found = _PHONE.match(text, at)
        if found and 9 <= len(_NON_DIGIT.sub("", found.group())) <= 15:
            out.append(found.span())
        at = text.find("+", found.end() if found else at + 1)
    return out


_TRIGGER = re.compile(r"[0-9]+|@")


def base_spans(text: str) -> dict[str, list[Span]]:
    if not _TRIGGER.search(text):
        return {k: [] for k in KINDS}
    return {"email": emails(text), "ip": ips(text), "card": cards(text), "phone": phones(text)}


# ---- candidate segments and their whole-span features

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]|_")


def zones(text: str) -> Iterator[Span]:
    """Stretches around digits and ``@``, out to the next white space (64 characters at most), near ones joined. Only
    those with seven digits or an ``@``: nothing shorter can be a segment."""
    start = end = -1
    weight = 0
    for m in _TRIGGER.finditer(text):
        if start >= 0 and m.start() <= end + 3:
            weight += 7 if m.group() == "@" else m.end() - m.start()
        else:
            if weight >= 7:
                yield start, end
            start = m.start()
            while start > 0 and m.start() - start < 64 and not text[start - 1].isspace():
                start -= 1
            start = max(start, end)
            weight = 7 if m.group() == "@" else m.end() - m.start()
        stop = m.end()
        while stop < len(text) and stop - m.end() < 64 and not text[stop].isspace():
            stop += 1
        end = max(end, stop)
    if weight >= 7:
        yield start, end


FEATURES = 24
_MAIL = re.compile(r"[A-Za-z0-9._%+-]+ ?@ ?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_FOUR = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_LOCAL_PHONE = re.compile(r"\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}")
_QUADS = re.compile(r"[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}")


def features(segment: str, left: str, right: str) -> np.ndarray:
    """What the model sees of a whole segment and its two neighbouring characters."""
    digits = _NON_DIGIT.sub("", segment)
    n = len(digits)
    four = _FOUR.fullmatch(segment)
    small = bool(four) and all(map(small_part, four.groups()))
    letters = any(c.isalpha() for c in segment)
    separators = {c for c in segment if not c.isalnum()}
    phone_body = segment[1:] if segment[0] == "+" else segment
    return np.array(
        [
            True, bool(_MAIL.fullmatch(segment)), "@" in segment, segment[0] == "+", "(" in segment and ")" in segment,
            9 <= n <= 15, 13 <= n <= 19, 13 <= n <= 19 and luhn(digits), small, bool(four) and not small,
            n == len(segment), separators <= {" ", "-"}, "." in separators, letters,
            left.isalnum() or left in "_+@", right.isalnum() or right in "_@", segment[-1].isalnum(), n == 10 or n == 11,
            bool(_LOCAL_PHONE.search(phone_body)) and not letters, bool(_QUADS.fullmatch(segment)),
            bool(separators - set(" -.()+@_%")), left in "=\"'/#:", n < 7 and "@" not in segment, n > 19,
        ],
        dtype=np.float64,
    )


def candidates(text: str, start: int, end: int) -> tuple[list[Span], list[tuple[int, int, np.ndarray]]]:
    """Tokens of a zone and its candidate segments (first token, end token, features): those that stand between word
    boundaries and hold an ``@``, or 7 to 24 digits and no letter."""
    tokens = [m.span() for m in _TOKEN.finditer(text, start, end)]
    found = []
    for i, (a, _) in enumerate(tokens):
        left = text[a - 1 : a]
        if not (text[a].isalnum() or text[a] in "+(") or left.isalnum() or left == "_":
            continue
        digits = mails = letters = 0
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            s, b = tokens[j]
            if j > i and s - tokens[j - 1][1] > 1:  # more than one white-space character between
                break
            digits += b - s if text[s].isdigit() else 0
            letters += text[s].isalpha()
            mails += text[s] == "@"
            right = text[b : b + 1]
            whole = (text[b - 1].isalnum() or text[b - 1] == ")") and not right.isalnum() and right != "_"
            if whole and (mails or digits >= 7 and digits <= 24 and not letters):
                found.append((i, j + 1, features(text[a:b], left, right)))
    return tokens, found


def best_segments(n: int, found: list[tuple[int, int, np.ndarray]], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """Viterbi over segments of bounded length: (first token, end token, kind)."""
    by_end: dict[int, list] = {}
    if found:
        scores = np.stack([f for _, _, f in found]) @ weights.T - LEAST_SCORE
        kinds = scores.argmax(axis=1)
        for (i, j, _), k, s in zip(found, kinds.tolist(), scores.max(axis=1).tolist(), strict=True):
            by_end.setdefault(j, []).append((i, k, s))
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, k, s in by_end.get(j, ()):
            if best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, (i, k)
    out, j = [], n
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            out.append((back[j][0], j, back[j][1]))
            j = back[j][0]
    return out[::-1]


# ---- training


def _likelihood(examples: list, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Log likelihood of the labelled segmentations and its gradient, by forward and backward sums over segments."""
    value, gradient = 0.0, np.zeros_like(weights)
    for n, ends, starts, feats, gold in examples:
        if not len(feats):
            continue
        scores = feats @ weights.T
        alpha, beta = np.zeros(n + 1), np.zeros(n + 1)
        top = scores.max(axis=1)
        whole = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
        order = np.argsort(ends, kind="stable")
        at = 0
        for j in range(1, n + 1):
            total = alpha[j - 1]
            while at < len(order) and ends[order[at]] == j:
                total = np.logaddexp(total, alpha[starts[order[at]]] + whole[order[at]])
                at += 1
            alpha[j] = total
        order = np.argsort(-starts, kind="stable")
        at = 0
        for i in range(n - 1, -1, -1):
            total = beta[i + 1]
            while at < len(order) and starts[order[at]] == i:
                total = np.logaddexp(total, beta[ends[order[at]]] + whole[order[at]])
                at += 1
            beta[i] = total
        inside = np.exp(alpha[starts] + beta[ends] - alpha[n])[:, None] * np.exp(scores)
        gradient -= inside.T @ feats
        value -= alpha[n]
        for c, k in gold:
            value += scores[c, k]
            gradient[k] += feats[c]
    return value - PENALTY * float((weights**2).sum()) / 2, gradient - PENALTY * weights


def _example(text: str, spans: dict[str, list[Span]]) -> list:
    out = []
    for start, end in zones(text):
        tokens, found = candidates(text, start, end)
        place = {(tokens[i][0], tokens[j - 1][1]): c for c, (i, j, _) in enumerate(found)}
        gold, last = [], -1
        for k, a, b in sorted(((KINDS.index(k), a, b) for k, v in spans.items() for a, b in v), key=lambda x: (x[1], -x[2])):
            if a >= last and (a, b) in place:
                gold.append((place[a, b], k))
                last = b
        ends, starts = np.array([f[1] for f in found], int), np.array([f[0] for f in found], int)
        out.append((len(tokens), ends, starts, np.stack([f[2] for f in found]) if found else np.zeros((0, FEATURES)), gold))
    return out


def _loosened(text: str, spans: dict[str, list[Span]]) -> tuple[str, dict[str, list[Span]]]:
    """The zone with its phones without their country prefix and its grouped cards with dots, spans moved along."""
    out, at, moved = [], 0, {k: [] for k in KINDS}
    length = 0
    for a, b, k in sorted((a, b, k) for k, v in spans.items() for a, b in v):
        if a < at:
            continue
        new = text[a:b]
        if k == "phone":
            body = _LOCAL_PHONE.search(new[1:])
            new = body.group() if body else new
        elif k == "card":
            new = re.sub(r"[ -]", ".", new)
        out += [text[at:a], new]
        length += a - at
        moved[k].append((length, length + len(new)))
        length += len(new)
        at = b
    return "".join([*out, text[at:]]), moved


def _spoiled(text: str, spans: dict[str, list[Span]]) -> str:
    """The zone with its spans made invalid: an address part over 255, a wrong check digit, a phone cut short, no domain.
    Such strings look like entities and are none."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, v in spans.items() for a, b in v):
        if a < at:
            continue
        old = text[a:b]
        new = {
            "ip": "4" + old.split(".")[0].zfill(3)[-3:] + old[old.index(".") :] if k == "ip" else "",
            "card": old[:-1] + str((int(old[-1]) + 1) % 10) if k == "card" else "",
            "phone": old[:8] if k == "phone" else "",
            "email": old.split("@")[0] + "@" if k == "email" else "",
        }[k]
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


def train(texts: list[str]) -> np.ndarray:
    """Weights (kind x feature) from zones: gradient ascent with per-weight step sizes."""
    examples = []
    for text in texts:
        spans = base_spans(text)
        examples += _example(text, spans)
        loose, moved = _loosened(text, spans)
        if loose != text:
            examples += _example(loose, moved)
        spoiled = _spoiled(text, spans)
        if spoiled != text:
            examples += _example(spoiled, base_spans(spoiled))
    weights, seen = np.zeros((len(KINDS), FEATURES)), np.full((len(KINDS), FEATURES), 1e-6)
    for _ in range(STEPS):
        _, gradient = _likelihood(examples, weights)
        seen += gradient**2
        weights += 0.5 * gradient / np.sqrt(seen)
    return weights


def training_zones(docs: DataFrame, zones_wanted: int = TRAIN_ZONES) -> list[str]:
    """The zones (with a little text around them) with the smallest hashes of the whole table; bounded in number and size."""

    def cut(batches):
        for batch in batches:
            out = []
            for lo, hi in pieces_of(batch, "text", 4 << 20):
                for text in batch.column("text")[lo:hi].to_pylist():
                    if text and _TRIGGER.search(text):
                        out += [text[max(0, a - 24) : min(b, a + ZONE_CHARS) + 24] for a, b in zones(text)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["zone"])

    found = docs.select("text").mapInArrow(cut, "zone string").distinct()
    return [r["zone"] for r in found.orderBy(F.xxhash64("zone"), "zone").limit(zones_wanted).collect()]


# ---- the operator


def all_spans(text: str, weights: np.ndarray | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(base spans, base and found spans), by kind, each sorted."""
    base = base_spans(text)
    more = {k: list(v) for k, v in base.items()}
    if weights is None:
        return base, more
    taken: list[list[int]] = []  # the base spans, overlapping ones joined
    for a, b in sorted(x for v in base.values() for x in v):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(b, taken[-1][1])
        else:
            taken.append([a, b])
    for start, end in zones(text):
        tokens, found = candidates(text, start, end)
        for i, j, k in best_segments(len(tokens), found, weights):
            a, b = tokens[i][0], tokens[j - 1][1]
            at = bisect_left(taken, [b, b])  # the joined spans before it start left of the segment's end
            if not at or taken[at - 1][1] <= a:
                more[KINDS[k]].append((a, b))
    return base, {k: sorted(v) for k, v in more.items()}


def listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def masked(text: str, spans: dict[str, list[Span]]) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans, the first and longest."""
    out, at = [], 0
    for a, b, k in sorted(((a, b, k) for k, v in spans.items() for a, b in v), key=lambda x: (x[0], -x[1])):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
            at = b
        elif b > at:
            at = b
    return "".join([*out, text[at:]])


def fit(docs: DataFrame) -> np.ndarray | None:
    found = training_zones(docs)
    return train(found) if found else None


def find(docs: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, and all spans of every document."""
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def scan(batches):
        for batch in batches:
            for lo, hi in pieces_of(batch, "text", 4 << 20):
                rows = []
                for text in batch.column("text")[lo:hi].to_pylist():
                    base, spans = all_spans(text or "", weights.value)
                    rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 6
                types = [pa.int64()] * 4 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo:hi], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                    ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
                )

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, schema)


def masked_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` masked; all columns stay."""
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def mask(batches):
        for batch in batches:
            for lo, hi in pieces_of(batch, "text", 4 << 20):
                part = batch.slice(lo, hi - lo)
                texts = [t if t is None else masked(t, all_spans(t, weights.value)[1]) for t in part.column("text").to_pylist()]
                at = part.schema.get_field_index("text")
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return docs.mapInArrow(mask, docs.schema)
