"""URL filter: fixed host/path rules, and beyond them the ratio of two character language models.

Both models are smoothed variable-order Markov models over the bytes of a URL: the probability of a byte after a
context of k bytes is its count there, interpolated with the probability after the k - 1 last bytes, down to a uniform
distribution; a context that was never seen leaves everything to the shorter one. One model counts the URLs that the
rules accept, the other those that they reject - all of them, each row once. The difference of the two
log-likelihoods, divided by the length, is compared with a threshold that is calibrated over all URLs with a rule:
the cut with the smallest mean of both error rates (``judged`` returns them). A URL's own counts would make it look better known than
the URLs without a rule are, so calibration is cross-fitted: URLs are dealt into ``FOLDS`` by a hash of their text (equal
URLs together), and a URL with a rule counts there with the score of models that leave its fold out.

Counts are exact and live in Spark tables that grow with the corpus. A byte with the ``ORDER`` bytes before it is a window,
packed into one long without loss; the count of every shorter context is a sum over windows, and the log-likelihood
difference of a byte depends on its window only. So every distinct window is judged once (``window_ratios``), and URLs get the
values of their windows in pieces of ``PIECE_BYTES``: a piece asks for each of its distinct windows once, so a window that
stands in every URL is asked for once a piece.

Defined results: a null URL or one without ``://`` has empty host and path, and no rule; a null or empty URL has the
score 0; without accepted or without rejected URLs the threshold is 0; repeated rows count as often as they stand
there and get equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from receivables.functions.joins import lookup_join
from receivables.llm.common import buffers, pieces_of, written

# Fixed values: (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
ORDER = 5  # the longest context, in bytes
STRENGTH = 1.0  # weight of the shorter context's probability
SYMBOL_BITS = 9  # of a window: a byte plus one, or 0 before the URL's start
PIECE_BYTES = 1 << 19  # of URLs that are scored together
FOLDS = 4  # of the calibration
BINS, REACH = 4000, 10.0  # of the calibration's histogram: scores from -REACH to REACH

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def windows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte with the ORDER bytes before it in its URL, as one number; the byte itself stands in the lowest bits."""
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    symbol = data.astype(np.int64) + 1
    out = symbol.copy()
    for k in range(1, ORDER + 1):
        before = np.zeros(len(data), dtype=np.int64)
        before[k:] = symbol[:-k]
        before[place < k] = 0  # before the URL's start
        out |= before << (SYMBOL_BITS * k)
    return out


def in_pieces(parsed: DataFrame) -> DataFrame:
    """All rows with the number of their ``piece``."""
    names = [*parsed.columns, "piece"]

    def number(batches):
        piece = TaskContext.get().partitionId() << 32
        room = 0
        for batch in batches:
            for lo, hi in pieces_of(batch, "url", PIECE_BYTES):
                part = batch.slice(lo, hi - lo)
                size = len(buffers(part.column("url"))[0]) + part.num_rows  # empty URLs fill a piece as well
                if size > room:
                    piece, room = piece + 1, PIECE_BYTES
                room -= size
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([piece] * part.num_rows, pa.int64())], names)

    return parsed.mapInArrow(number, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parsed.schema) + ", piece long")


FOLD_COUNTS = [f"{kind}_{fold}" for kind in ("a", "r") for fold in range(FOLDS)]  # counts in accepted and rejected URLs of a fold


def counted(placed: DataFrame) -> DataFrame:
    """(piece, window, ``FOLD_COUNTS``): how often each distinct window of a piece stands in URLs that the rules accept
    and reject, per fold; all are 0 where only URLs without a rule hold it. A piece that is read in parts has rows for each."""
    names = ["piece", "window", *FOLD_COUNTS]

    def count(batches):
        for batch in batches:
            for lo, hi in pieces_of(batch, "url", PIECE_BYTES):
                numbers = batch.column("piece")[lo:hi].to_numpy()
                cuts = [lo, *(lo + 1 + np.flatnonzero(np.diff(numbers))).tolist(), hi]
                for at, end in zip(cuts[:-1], cuts[1:], strict=True):
                    data, offsets = buffers(batch.column("url")[at:end])
                    if not len(data):
                        continue
                    verdict, fold = batch.column("ruled")[at:end].to_pylist(), batch.column("fold")[at:end].to_pylist()
                    window, where = np.unique(windows(data, offsets), return_inverse=True)
                    place = {"allow": 0, "block": FOLDS}
                    column = np.array([place[v] + f if v is not None else 2 * FOLDS for v, f in zip(verdict, fold, strict=True)])
                    cell = where * (2 * FOLDS + 1) + np.repeat(column, np.diff(offsets))
                    sums = np.bincount(cell, minlength=len(window) * (2 * FOLDS + 1)).reshape(len(window), -1)
                    piece = np.full(len(window), batch.column("piece")[at].as_py(), dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (piece, window, *sums.T[: 2 * FOLDS].astype(np.int64).copy())], names)

    return placed.select("url", "ruled", "fold", "piece").mapInArrow(count, ", ".join(f"{n} long" for n in names))


def window_ratios(total: DataFrame) -> DataFrame:
    """(window, ratio, ratio_0, ...): the log-likelihood difference of every window's last byte, over all counts and with each
    fold left out. ``total``: distinct (window, ``FOLD_COUNTS``).

    A context has at most 256 following bytes and a window at most 257 symbols before it, so no group and no key of the
    joins holds more rows than that.
    """
    models, given = [], []
    for kind in ("a", "r"):
        every = sum((F.col(f"{kind}_{fold}") for fold in range(1, FOLDS)), F.col(f"{kind}_0"))
        given.append(every.alias(kind))
        given += [(every - F.col(f"{kind}_{fold}")).alias(f"{kind}{fold}") for fold in range(FOLDS)]
        models += [kind, *(f"{kind}{fold}" for fold in range(FOLDS))]
    total = total.select("window", *given)
    found = None
    for k in range(ORDER + 1):
        gram = F.col("window").bitwiseAND((1 << (SYMBOL_BITS * (k + 1))) - 1)
        counts = total.groupBy(gram.alias("gram")).agg(*[F.sum(m).alias(m) for m in models])
        after = Window.partitionBy(F.shiftright("gram", SYMBOL_BITS))
        counts = counts.select("gram", *models, *[F.sum(m).over(after).alias(f"of_{m}") for m in models])
        if found is None:
            counts = counts.select("*", *[F.lit(1 / 256).alias(f"p_{m}") for m in models])
        else:
            shorter = F.col("gram").bitwiseAND((1 << (SYMBOL_BITS * k)) - 1)
            counts = counts.withColumn("shorter", shorter).join(found, "shorter")
        smoothed = [((F.col(m) + STRENGTH * F.col(f"p_{m}")) / (F.col(f"of_{m}") + STRENGTH)).alias(f"p_{m}") for m in models]
        found = counts.select(F.col("gram").alias("shorter"), *smoothed)
    ratios = [(F.log("p_a") - F.log("p_r")).alias("ratio")]
    ratios += [(F.log(f"p_a{fold}") - F.log(f"p_r{fold}")).alias(f"ratio_{fold}") for fold in range(FOLDS)]
    return found.select(F.col("shorter").alias("window"), *ratios)


def scored_pieces(placed: DataFrame, known: DataFrame) -> DataFrame:
    """page_id, host, path, rule, ruled, score and unseen_score (without the URL's fold) of every row, from (piece, window,
    ratio, ratio_0, ...) of its piece."""
    kept = ["page_id", "host", "path", "rule", "ruled"]

    def score(urls: pa.Table, found: pa.Table) -> pa.Table:
        window, first = np.unique(found.column("window").to_numpy(), return_index=True)
        data, offsets = buffers(urls.column("url"))
        length = np.diff(offsets)
        of = np.repeat(np.arange(len(length)), length)
        at = first[np.searchsorted(window, windows(data, offsets))] if len(data) else np.zeros(0, np.int64)
        ratios = np.stack([found.column(c).to_numpy() for c in ("ratio", *(f"ratio_{fold}" for fold in range(FOLDS)))])
        fold = urls.column("fold").to_numpy()
        out = []
        for which in (np.zeros(len(length), np.int64), fold + 1):
            each = ratios[which[of], at] if len(data) else np.zeros(0)
            total = np.bincount(of, weights=each, minlength=len(length))
            out.append(pa.array(total / np.maximum(length, 1)))
        return pa.table([*(urls.column(c) for c in kept), *out], names=[*kept, "score", "unseen_score"])

    both = placed.groupBy("piece").cogroup(known.groupBy("piece"))
    return both.applyInArrow(score, "page_id long, host string, path string, rule string, ruled string, score double, unseen_score double")


class Calibration(NamedTuple):
    """The threshold and, over the URLs with a rule by models without their folds, both error rates at it (None without URLs)."""

    cut: float
    lost: float | None  # share of accepted URLs below the cut
    passed: float | None  # share of rejected URLs at or above it


def calibrated(scored: DataFrame) -> Calibration:
    """The cut with the smallest mean of both error rates over all rows of (ruled, score), from a histogram."""
    slot = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("score") + REACH) * (BINS / (2 * REACH)))))
    counts = scored.groupBy(slot.cast("int").alias("bin"), "ruled").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 2 * BINS rows
    found = {k: np.zeros(BINS) for k in ("allow", "block")}
    for r in counts:
        found[r["ruled"]][r["bin"]] += r["n"]
    if not all(v.sum() for v in found.values()):
        return Calibration(0.0, None, None)
    lost = np.concatenate([[0], np.cumsum(found["allow"])]) / found["allow"].sum()  # accepted URLs below the cut
    passed = 1 - np.concatenate([[0], np.cumsum(found["block"])]) / found["block"].sum()  # rejected ones at or above it
    error = lost + passed
    best = np.flatnonzero(error <= error.min() + 1e-12)
    at = best[len(best) // 2]
    return Calibration(float(at * (2 * REACH / BINS) - REACH), float(lost[at]), float(passed[at]))


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> tuple[DataFrame, Calibration]:
    """page_id, host, path, rule, verdict and score of every page, and how the threshold was found."""
    host, path = host_and_path(F.col("url"))
    rule, ruled = longest_rule(F.col("host"), F.col("path"), rules)
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path"))
    fold = F.pmod(F.crc32(F.coalesce("url", F.lit(""))), F.lit(FOLDS)).cast("int")
    parsed = parsed.select("*", rule.alias("rule"), ruled.alias("ruled"), fold.alias("fold"))
    placed = written(in_pieces(parsed), "url-pieces")
    grams = written(counted(placed), "url-windows")
    total = written(grams.groupBy("window").agg(*[F.sum(c).alias(c) for c in FOLD_COUNTS], F.count(F.lit(1)).alias("__n")), "url-window-counts")
    ratios = written(window_ratios(total), "url-window-ratios")
    known = lookup_join(grams.select("piece", "window"), ratios, "window", "inner", spread="piece", key_counts=total)
    scored = written(scored_pieces(placed, known), "url-scores")
    found = calibrated(scored.where(F.col("ruled").isNotNull()).select("ruled", F.col("unseen_score").alias("score")))
    by_model = F.when(F.col("score") >= found.cut, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score"), found


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every page."""
    return judged(pages, rules)[0]
