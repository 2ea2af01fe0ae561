"""Evaluation passages inside training texts: q-gram lemma filter, then banded alignment.

Nothing of either side is held whole anywhere:

1. Passages are a table. Every window of ``least_words`` words is cut into edits + 1 segments, of which at least one stands
   unchanged wherever the window stands with at most ``edits`` edits; of each segment the q-gram that the fewest
   passages hold becomes an anchor.
2. A Bloom filter of the anchors, of bounded size, goes to the executors. In one pass over the documents every q-gram is
   hashed; where it may be an anchor, the stretch that a window around it could cover is kept as a region.
3. Regions join the passages through their anchors. Of each pair all shared q-grams are counted in overlapping diagonal
   bands; bands with too few for the edit budget are dropped (a window of L characters with k edits keeps at least
   L - q + 1 - k q of its q-grams, all within k diagonals), the rest is verified by alignment within the band.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from . import streams

SIZES = (24, 16, 12, 8)
GAP, EDGE = 32, 10


def stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased words with one gap between them, each text led by an edge mark; and where each text begins."""
    cp, bounds = streams.points(["\x00" + t for t in texts])
    al = streams._tables()[cp]
    word = al > 0
    keep = word.copy()
    keep[1:] |= word[:-1]
    keep[bounds[:-1]] = True
    out = np.where(word, cp, GAP).astype(np.uint32)
    out[bounds[:-1]] = EDGE
    starts = np.zeros(len(bounds), dtype=np.int64)
    starts[1:] = np.cumsum(keep)[bounds[1:] - 1] if len(texts) else 0
    return np.append(out[keep], np.uint32(EDGE)), starts


def qgrams(cp: np.ndarray, q: int) -> np.ndarray:
    """Hash of every q successive characters, built from hashes of doubled length."""
    if len(cp) < q:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        base = streams.mix(cp.astype(np.uint64) + np.uint64(1))
        factor = 0x9E3779B97F4A7C15
        size, power, done, total = 1, factor, 0, None
        step = base
        while True:
            if q & size:
                total = step if total is None else total[: len(step) - done] * np.uint64(power) + step[done:] if done else step
                done += size
            if done == q:
                return streams.mix(total)
            step = step[:-size] * np.uint64(power) + step[size:]
            size, power = size * 2, power * power % (1 << 64)


def windows(passage: str, least_words: int, edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int] | None:
    """(characters, starts, ends, q, need) of the windows of ``least_words`` words of a passage, or None if it has none.

    ``q`` fits edits + 1 times into the shortest window; ``need`` is the number of q-grams that such a window keeps."""
    cp, _ = stream([passage or ""])
    cp = cp[1:-1]
    cp = cp[1:] if len(cp) and cp[0] == GAP else cp
    cp = cp[:-1] if len(cp) and cp[-1] == GAP else cp
    begin = np.flatnonzero(np.append(True, cp[:-1] == GAP)) if len(cp) else np.zeros(0, dtype=np.int64)
    end = np.append(begin[1:] - 1, len(cp))
    if len(begin) < least_words:
        return None
    a, b = begin[: len(begin) - least_words + 1], end[least_words - 1 :]
    shortest = int((b - a).min())
    q = next((s for s in SIZES if s <= 0.75 * shortest / (edits + 1)), max(1, shortest // (edits + 1)))
    return cp, a, b, q, max(1, shortest - q + 1 - edits * q)


def gram_keys(cp: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams that differ between sizes."""
    return (qgrams(cp, q) ^ np.uint64(q * 0x9E3779B97F4A7C15 % (1 << 64))).view(np.int64)


def anchors(a: np.ndarray, b: np.ndarray, q: int, edits: int, held_by: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Positions of the chosen q-grams: of each window's edits + 1 segments the one held by the fewest passages, equals by hash."""
    rank = np.empty(len(keys), dtype=np.int64)
    rank[np.lexsort((keys, held_by))] = np.arange(len(keys))
    picked = set()
    for s, e in zip(a, b, strict=True):
        cuts = s + (e - s) * np.arange(edits + 2) // (edits + 1)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi - q >= lo:
                picked.add(int(lo + rank[lo : hi - q + 1].argmin()))
    return np.array(sorted(picked), dtype=np.int64)


class Passages:
    """Index of some passages for a window of ``least_words`` words and an edit budget."""

    def __init__(self, items: list[tuple[int, str]], least_words: int, edits: int) -> None:
        self.edits, self.ids, self.texts, self.windows, self.need = edits, [], [], [], []
        grams: dict[int, list] = {}
        for item, passage in items:
            if (found := windows(passage, least_words, edits)) is None:
                continue
            cp, a, b, q, need = found
            at = len(self.ids)
            self.ids.append(item)
            self.texts.append(cp)
            self.windows.append((a, b))
            self.need.append(need)
            h = qgrams(cp, q)
            grams.setdefault(q, []).append((h, np.full(len(h), at), np.arange(len(h))))
        self.index = {}
        for q, parts in grams.items():
            if parts:
                h, item, pos = (np.concatenate(p) for p in zip(*parts, strict=True))
                order = np.argsort(h, kind="stable")
                self.index[q] = (h[order], item[order], pos[order])
        self.need = np.array(self.need)

    def candidates(self, cp: np.ndarray, doc_of: np.ndarray) -> np.ndarray:
        """Rows (doc, passage, lowest diagonal, highest diagonal) of the bands with enough shared q-grams."""
        width = 2 * (self.edits + 1)
        found = []
        for q, (keys, item, pos) in self.index.items():
            h = qgrams(cp, q)
            at = np.arange(len(h))
            lo, hi = np.searchsorted(keys, h[at], "left"), np.searchsorted(keys, h[at], "right")
            n = hi - lo
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            if not len(at):
                continue
            post = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            where = np.repeat(at, n)
            diagonal = where - pos[post]
            for shift in (0, width // 2):
                band = (diagonal + shift) // width
                rows = np.stack([doc_of[where], item[post], band], axis=1)
                kinds, count = np.unique(rows, axis=0, return_counts=True)
                kinds = kinds[count >= self.need[kinds[:, 1]]]
                low = kinds[:, 2] * width - shift
                found.append(np.stack([kinds[:, 0], kinds[:, 1], low, low + width - 1], axis=1))
        return np.concatenate(found) if found else np.zeros((0, 4), dtype=np.int64)

    def align(self, cp: np.ndarray, item: int, low: int, high: int) -> tuple[int, bool]:
        """Fewest edits with which a window of the passage stands in the band, and whether one stands there exactly.

        Furthest-reaching alignment: from each window's start on each diagonal of the band, extended by up to the edit
        budget of substitutions, insertions and deletions. More than the budget comes out as budget + 1.
        """
        text = self.texts[item]
        a, b = self.windows[item]
        k = self.edits
        diagonals = np.arange(low - k, high + k + 1)
        m = len(text)
        place = np.arange(m)[None, :] + diagonals[:, None]
        inside = (place >= 0) & (place < len(cp))
        same = inside & (cp[np.clip(place, 0, len(cp) - 1)] == text[None, :])
        # stop[d, i]: first position from i on at which diagonal d differs
        stop = np.where(same, m, np.arange(m)[None, :])
        stop = np.minimum.accumulate(stop[:, ::-1], axis=1)[:, ::-1]
        stop = np.concatenate([stop, np.full((len(diagonals), 1), m)], axis=1)
        core = np.arange(k, len(diagonals) - k)
        reach = np.full((len(diagonals), len(a)), -1)
        reach[core] = stop[core][:, a]
        exact = False
        hit_d, hit_w = np.nonzero(reach[core] >= b[None, :])
        if len(hit_d):
            before = a[hit_w] + diagonals[core][hit_d] - 1
            after = b[hit_w] + diagonals[core][hit_d]
            parted = lambda i: (i < 0) | (i >= len(cp)) | (cp[np.clip(i, 0, len(cp) - 1)] <= GAP)
            exact = bool((parted(before) & parted(after)).any())
            return 0, exact
        for e in range(1, k + 1):
            ahead = np.where(reach >= 0, np.minimum(reach + 1, m), -1)
            best = ahead.copy()  # substitution
            best[:-1] = np.maximum(best[:-1], ahead[1:])  # a passage character is absent from the text
            best[1:] = np.maximum(best[1:], reach[:-1])  # the text has a character more
            reach = np.where(best >= 0, np.take_along_axis(stop, np.maximum(best, 0), axis=1), -1)
            if (reach >= b[None, :]).any():
                return e, False
        return k + 1, False


def search(index: Passages, ids: np.ndarray, texts: list[str], most_chars: int) -> pd.DataFrame:
    rows: dict[tuple[int, int], tuple[int, bool]] = {}
    for a, b in streams.chunks(texts, most_chars):
        cp, starts = stream(texts[a:b])
        doc_of = np.repeat(np.arange(b - a), np.diff(starts))
        doc_of = np.append(doc_of, max(b - a - 1, 0))
        for doc, item, low, high in index.candidates(cp, doc_of):
            # the text's own stretch, its edge marks included; diagonals count from there
            s, e = starts[doc], starts[doc + 1] + 1
            lo = max(s, low - index.edits - 1)
            hi = min(e, high + len(index.texts[item]) + index.edits + 2)
            edits, exact = index.align(cp[lo:hi], item, low - lo, high - lo)
            if edits <= index.edits:
                key = (int(ids[a + doc]), index.ids[item])
                old = rows.get(key, (edits, exact))
                rows[key] = (min(old[0], edits), old[1] or exact)
    return pd.DataFrame([(*k, *v) for k, v in rows.items()], columns=["doc_id", "item_id", "edits", "exact"]).astype({"doc_id": "int64", "item_id": "int64", "edits": "int32", "exact": "bool"})


class Bloom:
    """Bit filter of 64-bit keys, three probes each."""

    def __init__(self, bits: bytes) -> None:
        self.bits = np.frombuffer(bits, dtype=np.uint8)
        self.mask = np.uint64(len(bits) * 8 - 1)

    def __contains__(self, key: int) -> bool:
        return bool(self.may_hold(np.array([key], dtype=np.int64))[0])

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        k = keys.view(np.uint64)
        at = np.flatnonzero(self._bit(k & self.mask))
        at = at[self._bit((k[at] >> np.uint64(32)) & self.mask)]
        at = at[self._bit((k[at] ^ (k[at] >> np.uint64(21))) & self.mask)]
        out = np.zeros(len(k), dtype=bool)
        out[at] = True
        return out

    def _bit(self, place: np.ndarray) -> np.ndarray:
        return (self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def bloom_of(keys: DataFrame, number: int, most_bits: int) -> Bloom:
    """The filter of column ``h``: 64 bits a key, at least 2^23 and at most ``most_bits``. Pieces of 4 KB are built where the keys are; only
    they, at most ``most_bits`` / 8 bytes, come to the driver."""
    bits = 1 << 15
    while bits < min(max(number * 64, 1 << 23), most_bits):
        bits *= 2
    h = F.col("h")
    probes = keys.select(F.explode(F.array(*(p.bitwiseAND(bits - 1) for p in (h, F.shiftrightunsigned(h, 32), h.bitwiseXOR(F.shiftrightunsigned(h, 21)))))).alias("at"))
    pieces = probes.groupBy(F.shiftright("at", 15).alias("k")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND((1 << 15) - 1)).alias("b"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in pieces.toLocalIterator():
        out[r["k"] * 4096 : r["k"] * 4096 + len(r["b"])] = np.frombuffer(bytes(r["b"]), dtype=np.uint8)
    return Bloom(out.tobytes())


def regions(ids: np.ndarray, texts: list[str], sizes: list[int], bloom: Bloom, reach: int, piece: int, most_chars: int) -> Iterator[tuple]:
    """(doc_id, region text, anchor keys that it may hold) around all q-grams that ``bloom`` may hold.

    A region covers ``reach`` characters on both sides of such a q-gram and ends between words; longer ones are cut into
    pieces of about ``piece`` characters that overlap by ``2 reach``, so every window lies within one piece."""
    for a, b in streams.chunks(texts, most_chars):
        cp, starts = stream(texts[a:b])
        held = []
        for q in sizes:
            h = gram_keys(cp, q)
            at = np.flatnonzero(bloom.may_hold(h))
            held.append(np.stack([at, h[at]]))
        at, key = np.concatenate(held, axis=1) if held else np.zeros((2, 0), dtype=np.int64)
        if not len(at):
            continue
        order = np.argsort(at, kind="stable")
        at, key = at[order], key[order]
        doc = np.searchsorted(starts, at, side="right") - 1
        lo, hi = np.maximum(at - reach, starts[doc]), np.minimum(at + reach, starts[doc + 1])
        fresh = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (lo[1:] > hi[:-1])))
        gaps = np.flatnonzero(cp <= GAP)
        for k, first in enumerate(fresh):
            last = fresh[k + 1] if k + 1 < len(fresh) else len(at)
            s, e = int(lo[first]), int(hi[last - 1])
            for left in range(s, max(e - 2 * reach, s + 1), piece):
                right = min(left + piece + 2 * reach, e)
                # out to the next gap or edge
                x = int(gaps[max(np.searchsorted(gaps, left, side="right") - 1, 0)])
                y = int(gaps[min(np.searchsorted(gaps, right), len(gaps) - 1)])
                own = key[np.searchsorted(at, left) : np.searchsorted(at, right)]
                if len(own):
                    yield int(ids[a + doc[first]]), "".join(map(chr, cp[x + 1 : y])), np.unique(own).tolist()


@lru_cache(maxsize=4096)
def _one(item: int, passage: str, least_words: int, edits: int) -> Passages:
    return Passages([(item, passage)], least_words, edits)


def leaked_passages(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    passage: str = "passage",
    least_words: int = 12,
    edits: int = 1,
    most_bits: int = 1 << 28,
    piece: int = 1 << 16,
    most_chars: int = 1_000_000,
) -> DataFrame:
    """(doc_id, item_id, edits, exact): documents in which ``least_words`` successive words of a passage stand with at
    most ``edits`` character edits; ``exact`` if they stand there word for word.

    Words are runs of letters or digits; case and what lies between is ignored. Null ids are left out, null and empty
    texts hold nothing, passages of fewer words are never found, repeated rows count once, and empty tables give no
    rows. The filter takes at most ``most_bits`` bits, whatever the passages; past that it only lets more through.
    Anchors, and the regions around them, are written to the shared folder; neither side is collected.
    """
    chosen = items.select(F.col(item_id).cast("long").alias("item_id"), F.coalesce(F.col(passage), F.lit("")).alias("passage")).where("item_id IS NOT NULL").distinct()
    chosen = chosen.withColumn("pid", F.xxhash64("item_id", "passage"))

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for pid, t in zip(pdf["pid"], pdf["passage"], strict=True):
                if (found := windows(t, least_words, edits)) is not None:
                    h = gram_keys(found[0], found[3])
                    yield pd.DataFrame({"pid": pid, "pos": np.arange(len(h)), "h": h})

    every = chosen.mapInPandas(grams, "pid long, pos long, h long")
    held_by = every.groupBy("h").agg(F.count(F.lit(1)).alias("df"))

    def pick(g: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        found = windows(p["passage"].iloc[0], least_words, edits) if len(p) else None
        if found is None:
            return pd.DataFrame({"pid": [], "h": [], "q": [], "reach": []}).astype("int64")
        g = g.sort_values("pos")
        _, a, b, q, _ = found
        at = anchors(a, b, q, edits, g["df"].to_numpy(), g["h"].to_numpy())
        return pd.DataFrame({"pid": p["pid"].iloc[0], "h": g["h"].to_numpy()[at], "q": q, "reach": int((b - a).max()) + 2 * edits + 2}).drop_duplicates()

    picked = every.join(held_by, "h").groupBy("pid").cogroup(chosen.groupBy("pid")).applyInPandas(pick, "pid long, h long, q long, reach long")
    posts = materialize(picked, "anchors")
    known = posts.agg(F.count_distinct("h").alias("n"), F.collect_set("q").alias("q"), F.max("reach").alias("reach")).first()
    wide = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    sizes, reach = sorted(known["q"]), known["reach"] or 0
    bloom = bloom_of(posts.select("h").distinct(), known["n"], most_bits)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = list(regions(pdf["doc_id"].to_numpy(), list(pdf["text"]), sizes, bloom, reach, max(piece, 2 * reach), most_chars))
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "region", "keys"])

    found = materialize(wide.mapInPandas(scan, "doc_id long, region string, keys array<long>").withColumn("rid", F.xxhash64("doc_id", "region")), "regions")
    pairs = found.select("rid", F.explode("keys").alias("h")).join(posts.select("h", "pid"), "h").select("rid", "pid").distinct()
    texts = found.groupBy("rid").agg(F.min("doc_id").alias("doc_id"), F.min("region").alias("region"))
    joined = pairs.join(texts, "rid").join(chosen, "pid").select("doc_id", "region", "item_id", "passage")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (item, t), own in pdf.groupby(["item_id", "passage"], sort=False):
                rows = search(_one(int(item), t, least_words, edits), own["doc_id"].to_numpy(), list(own["region"]), most_chars)
                if len(rows):
                    yield rows

    checked = joined.mapInPandas(verify, "doc_id long, item_id long, edits int, exact boolean")
    return checked.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"), F.max("exact").alias("exact"))
