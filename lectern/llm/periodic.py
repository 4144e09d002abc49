"""Periodic runs of words, by Main and Lorentz's divide and conquer.

The words of a text are interned. A stretch of words is halved again and again; at each midpoint two Z-functions, one forward and
one backward, tell how far the words on from every other place agree with those at the midpoint. Where what agrees before and
behind adds up to the distance, a repetition crosses the midpoint. A run is found whole at the first midpoint inside
it, so a piece that a border of its stretch cuts is the part of a run that is found already, and goes.

Runs of LEAST words have six words or more in a row that agree over their period, so three of them stand on one side of the
midpoint: Z-values are computed at places that agree in three words, and are below three elsewhere. Stretches of fewer
than LEAST words hold no run. Work is in proportion to n log n at most for a text of n words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from lectern.llm.common import bounds, slices, split_words, word_codes

#: Fewest words of a run; below 12 the three words at a side of a midpoint wouldn't be sure.
LEAST = 12
#: Words compared one by one before arrays are compared.
_FEW = 8


def _agree(seq: list[int], codes: np.ndarray, a: int, b: int, end: int) -> int:
    """How many words from a and from b on are equal, up to `end` for the later one."""
    most = end - max(a, b)
    n = 0
    while n < most and n < _FEW:
        if seq[a + n] != seq[b + n]:
            return n
        n += 1
    step = 64
    while n < most:
        size = min(step, most - n)
        differ = np.flatnonzero(codes[a + n : a + n + size] != codes[b + n : b + n + size])
        if len(differ):
            return n + int(differ[0])
        n += size
        step *= 2
    return n


def z_values(seq: list[int], codes: np.ndarray, mid: int, places: list[int], end: int) -> dict[int, int]:
    """For ascending places, how many words agree with those from mid on, before `end`: the Z-function of what follows mid, over places.

    Places behind mid are matched within the pattern itself, those before it against the pattern. A value that a matched box
    already tells isn't compared again.
    """
    own: dict[int, int] = {}  # by distance from mid
    out: dict[int, int] = {}
    for side in (True, False):
        low = high = 0
        for j in places:
            if (j > mid) != side:
                continue
            k = 0
            if j < high:
                known = own.get(j - low, 0)
                k = min(known, high - j)
                if k and known < high - j:
                    out[j] = k
                    if side:
                        own[j - mid] = k
                    continue
            k += _agree(seq, codes, mid + k, j + k, end)
            if j + k > high:
                low, high = j, j + k
            out[j] = k
            if side:
                own[j - mid] = k
    return out


def _same_before_and_after(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places before and behind that have the same key, -1 and the length where there is none."""
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    before, after = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    return before, after


def runs(codes: np.ndarray, edges: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, smallest period), in order of start and period, of every run of several texts that follow each other.

    codes: interned words; edges: where each text begins, and the end. A run has `least` words (12 or more) and twice its period.
    """
    n = len(codes)
    if n < least:
        return []
    codes = codes.astype(np.int64)
    size = int(codes.max()) + 1
    triple = np.full(n, -1, np.int64)
    triple[: n - 2] = (codes[:-2] * size + codes[1:-1]) * size + codes[2:]  # may wrap: equal words have equal keys, and matches are compared
    ends = np.repeat(edges[1:], np.diff(edges))
    single = np.flatnonzero(np.arange(n) + 3 > ends)
    before, after = _same_before_and_after(triple)
    for i in single:  # two places a text at most
        if before[i] >= 0:
            after[before[i]] = after[i]
        if after[i] < n:
            before[after[i]] = before[i]
    before[single], after[single] = -1, n
    start_of = np.repeat(edges[:-1], np.diff(edges))
    lists: tuple | None = None
    found: dict[tuple[int, int], int] = {}
    low, high = edges[:-1], edges[1:]
    while True:
        keep = high - low >= least
        low, high = low[keep], high[keep]
        if not len(low):
            break
        mid = (low + high) // 2
        back = np.maximum(mid - 3, low)
        hit = (after[mid] < high) | (before[mid] >= low) | (after[back] + 3 <= high) | (before[back] >= low)
        for lo, hi, m in zip(low[hit].tolist(), high[hit].tolist(), mid[hit].tolist(), strict=True):
            if lists is None:
                lists = codes.tolist(), codes[::-1].tolist(), codes[::-1].copy(), before.tolist(), after.tolist()
            _crossing(codes, lists, lo, hi, m, int(start_of[m]), int(ends[m]), least, found)
        low, high = np.concatenate([low, mid]), np.concatenate([mid, high])
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def _places(before: list[int], after: list[int], at: int, low: int, high: int, shift: int) -> list[int]:
    left, right = [], []
    j = before[at]
    while j >= low:
        left.append(j + shift)
        j = before[j]
    j = after[at]
    while j < high:
        right.append(j + shift)
        j = after[j]
    return left[::-1] + right


def _crossing(codes: np.ndarray, lists: tuple, lo: int, hi: int, m: int, first: int, last: int, least: int, found: dict[tuple[int, int], int]) -> None:
    """Adds the runs of the stretch [lo, hi) that cross m; its text is [first, last)."""
    seq, seq_back, codes_back, before, after = lists
    n = len(seq)
    ahead = _places(before, after, m, lo, hi, 0)
    behind = _places(before, after, m - 3, lo, hi - 2, 3) if m - 3 >= lo else []
    on = z_values(seq, codes, m, ahead, hi)
    # the same words read backward: place x is n - x there
    off = {n - j: k for j, k in z_values(seq_back, codes_back, n - m, [n - j for j in reversed(behind)], n - lo).items()}
    for j in sorted(on.keys() | off.keys()):
        p = abs(j - m)
        f, b = on.get(j), off.get(j)
        f = _agree(seq, codes, m, j, hi) if f is None else f
        b = _agree(seq_back, codes_back, n - m, n - j, n - lo) if b is None else b
        if f + b < p or f + b + p < least:
            continue
        s, e = min(m, j) - b, max(m, j) + f
        if s == lo > first and seq[s - 1] == seq[s - 1 + p] or e == hi < last and seq[e] == seq[e - p]:
            continue
        found[s, e] = min(p, found.get((s, e), p))


def brute(words: list[str], least: int = LEAST) -> list[tuple[int, int, int]]:
    """The same runs by trying every period."""
    found: dict[tuple[int, int], int] = {}
    n = len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i >= p and j - i + p >= least:
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """The rows with n_words, runs (array of start, length, period; by start, then period) and collapsed (the text without repeats).

    Words are runs without ASCII white space. A run is a stretch of words with smallest period q and max(least, 2 q) words or
    more that no neighbouring word extends. A word that stands in any run after that run's first q words is left out of
    collapsed, which joins the others by one space. Null, empty and blank texts have no words, no runs and an empty collapsed.
    Every row is judged by its own text, whatever its id: repeated rows have the same result. Columns of these three names are
    replaced, others stay; an empty table gives no rows. A task holds the words of one slice of texts, or of one longer text, at a time.
    """
    if least < LEAST:
        raise ValueError(f"least must be {LEAST} or more")
    others = [c for c in docs.columns if c.lower() not in ("n_words", "runs", "collapsed")]
    given = f"c{next(i for i, c in enumerate(others) if c.lower() == text_col.lower())}"
    source = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)))
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, given):
                words, rows = split_words(part.column(given), lower=False)
                edges = bounds(rows, len(part))
                codes, _ = word_codes(words)
                got = np.array(runs(codes, edges, least), np.int64).reshape(-1, 3)
                owner = rows[got[:, 0]] if len(got) else np.zeros(0, np.int64)
                keep = np.ones(len(rows), bool)
                for s, size, q in got:
                    keep[s + q : s + size] = False
                lists = pa.StructArray.from_arrays([pa.array(got[:, 0] - edges[owner]), pa.array(got[:, 1]), pa.array(got[:, 2])], fields=list(kind))
                lists = pa.ListArray.from_arrays(pa.array(bounds(owner, len(part)), pa.int32()), lists)
                kept = pa.ListArray.from_arrays(pa.array(bounds(rows[keep], len(part)), pa.int32()), words.filter(pa.array(keep)))
                collapsed = pc.binary_join(kept, pa.scalar(" ", pa.large_string())).cast(pa.string())
                arrays = [part.column(i) for i in range(part.num_columns)] + [pa.array(np.diff(edges)), lists, collapsed]
                yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names, "n_words", "runs", "collapsed"])

    run = StructType().add("start", "long").add("length", "long").add("period", "long")
    schema = StructType([*source.schema.fields]).add("n_words", "long").add("runs", ArrayType(run)).add("collapsed", "string")
    done = source.mapInArrow(find, schema)
    return done.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(others)), "n_words", "runs", "collapsed")


def digest(done: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of periodic_runs(): the id, n_runs, the longest run's start, length, period and exponent_milli, and digests of runs and collapsed."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return done.select(
        F.col(id_col), F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")
    ).select(
        id_col, "n_runs", (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.period")).alias("period"),
        F.floor(1000 * F.col("b.length") / -F.col("b.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def with_periodic_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the text of every row; one of ten ids, by crc32, has its words from some place on replaced by a repetition of the first of them.

    With h the crc32 of the id and g its tenth: of n words those from a = g % n on become words a + (i - a) % p, p = 1 + (n - a) / (3 + g % 8).
    A row without an id stays as it is.
    """
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.col(text_col), "[ \\x09-\\x0D]+", -1), lambda w: w != "")
    rows = docs.select(F.col(id_col), F.col(text_col), h.alias("_h"), g.alias("_g"), F.when(h % 10 == 0, words).alias("_w"))
    n = F.size("_w")
    rows = rows.withColumn("_a", F.when(n > 0, F.col("_g") % n))
    rows = rows.withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8)))
    head = F.slice("_w", F.lit(1), F.col("_a").cast("int"))
    unit = F.slice("_w", (F.col("_a") + 1).cast("int"), F.col("_p").cast("int"))
    often = F.ceil((n - F.col("_a")) / F.col("_p")).cast("int")
    tail = F.array_join(F.slice(F.concat(head, F.flatten(F.array_repeat(unit, often))), F.lit(1), n), " ")
    return rows.select(id_col, F.when(F.col("_a").isNotNull(), tail).otherwise(F.col(text_col)).alias(text_col))
