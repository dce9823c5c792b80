"""Evaluation texts leaking into training text, whole, in part or with changes.

Latent semantic retrieval: passages of the items and of the documents are vectors of TF-IDF weights over the items'
three-word terms, with document frequencies counted over the whole corpus; a randomised SVD over the items' passages,
computed in distributed products, gives the latent space; document passages near an item's passage by cosine are
candidates; and an alignment of the two word sequences decides. No leak hangs on weights or cosine: whatever shares six
words in a row with an item is aligned as well, and every leak does. Items are the query set, held in blocks of bounded
size, and run against all documents. Documents are taken together in stretches, so that each step is one array operation
over many of them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, functions as F

from ..runtime import stored

#: Words in a passage, and the steps between the starts of the documents' and the items' passages.
WINDOW, DOC_STEP, ITEM_STEP = 24, 8, 4
#: Dimensions of the latent space, power iterations of its computation, and the least cosine of a candidate.
DIMENSIONS, ITERATIONS, COSINE = 96, 2, 0.45
#: Equal words in a row that every leak has, and the most words between the first and the last start of such runs that are aligned at once.
SEED, SPAN = 6, 512
#: Words of a document that are compared with the items' runs at once, words of documents that are taken together, and the most pairs of a word and an item that holds it at once.
PIECE, TOGETHER, MOST_PAIRS = 8192, 262_144, 8_000_000
#: Words of items that are held in memory at once, about; more are taken in blocks, each against all documents.
BLOCK_WORDS = 250_000

_HIDDEN = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤﻿]")
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]*>|<!--|-->")
_ENTITY = re.compile(r"&(?:#\d+|#x[0-9a-fA-F]+|\w{2,8});")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Runs of letters and digits in lower case, without mark-up, entities and invisible characters."""
    if "&" in text and _ENTITY.search(text):
        text = html.unescape(text)
    if not text.isascii():
        text = _HIDDEN.sub("", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall(text.lower())


def own_passage(text: str) -> str:
    """An item's text without the instruction that stands before the first blank line."""
    parts = re.split(r"\n[ \t]*\r?\n", text.lstrip(), maxsplit=1)
    return parts[1] if len(parts) == 2 and parts[1].strip() else parts[0]


def _holders(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different codes, where the holders of each begin (and the end), and the holders: numbers of the lists that have the code."""
    flat = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    pairs = np.unique(np.stack([flat, np.repeat(np.arange(len(codes)), [len(c) for c in codes])]), axis=1)
    different, first = np.unique(pairs[0], return_index=True)
    return different, np.r_[first, pairs.shape[1]], pairs[1]


def _expanded(places: np.ndarray, codes: np.ndarray, first: np.ndarray, holders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, holder) for each holder of the code at each place."""
    n = first[codes + 1] - first[codes]
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(places, n), holders[np.repeat(first[codes], n) + within]


class Items:
    """A block of items: word numbers, three-word terms and passages. Sent to the workers; bounded by BLOCK_WORDS."""

    def __init__(self, rows: list[tuple[int, str]], least: int):
        by_words: dict[tuple[str, ...], list[int]] = {}
        for id_, text in rows:
            w = tuple(words(own_passage(text or "")))
            if len(w) >= least:
                by_words.setdefault(w, []).append(id_)
        self.ids = list(by_words.values())
        self.number: dict[str, int] = {}
        self.sequences = [np.array([self.number.setdefault(x, len(self.number)) for x in w], np.int32) for w in by_words]
        if len(self.number) >= 1 << 21:
            raise ValueError("a block of items has more than 2^21 different words; take smaller blocks")
        grams = [self._grams(s) for s in self.sequences]
        self.terms = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.int64)
        passages, owner = [], []
        for i, g in enumerate(grams):
            t = np.searchsorted(self.terms, g)
            for a in range(0, max(1, len(g) - (WINDOW - 2) + ITEM_STEP), ITEM_STEP):
                a = min(a, max(0, len(g) - (WINDOW - 2)))
                passages.append(t[a : a + WINDOW - 2])
                owner.append(i)
        self.passages, self.owner = passages, np.array(owner, np.int64)
        # the passages of an item lie together
        self.spans = (np.searchsorted(self.owner, np.arange(len(self.ids))), np.searchsorted(self.owner, np.arange(len(self.ids)), "right"))
        numbers = [np.searchsorted(self.terms, g) for g in grams]
        # each run of SEED words and each term once, where its holders begin, and the items that hold it
        self.runs, self.run_first, self.run_holders = _holders([self.run_codes(t) for t in numbers])
        _, self.term_first, self.term_holders = _holders(numbers)

    def run_codes(self, t: np.ndarray) -> np.ndarray:
        """Codes of SEED words in a row (two terms, the second after the first), -1 where one of the terms is in no item."""
        a, b = t[:-3].astype(np.int64), t[3:].astype(np.int64)
        return np.where((a < 0) | (b < 0), -1, a * len(self.terms) + b)

    def shared_runs(self, t: np.ndarray, need: int, around: int) -> dict[int, list[int]]:
        """By item, where in a document of these terms runs of SEED words start that the item has too, in order.

        Left out are runs with fewer than `need` terms of the item within `around` words on both sides.
        """
        out: dict[int, list[int]] = {}
        if (t >= 0).sum() < need:
            return out
        codes = self.run_codes(t)
        for lo in range(0, len(codes), PIECE):
            at = lo + np.flatnonzero(codes[lo : lo + PIECE] >= 0)
            k = np.minimum(np.searchsorted(self.runs, codes[at]), len(self.runs) - 1)
            same = self.runs[k] == codes[at]
            starts, items = _expanded(at[same], k[same], self.run_first, self.run_holders)
            if not len(starts):
                continue
            a = max(0, lo - around)
            piece = t[a : lo + PIECE + SEED + around]
            there = np.flatnonzero(piece >= 0)
            where, whose = _expanded(a + there, piece[there], self.term_first, self.term_holders)
            size = len(t) + 2 * (SEED + around)  # no reach ends in the next item
            places = np.sort(whose * size + where + around)
            low = items * size + starts
            enough = np.searchsorted(places, low + 2 * around + SEED) - np.searchsorted(places, low) >= need
            for p, item in zip(starts[enough].tolist(), items[enough].tolist()):
                out.setdefault(item, []).append(p)
        return out

    def runs_of_many(self, t: np.ndarray, starts: np.ndarray, ends: np.ndarray, need: int, around: int) -> dict[tuple[int, int], list[int]]:
        """shared_runs() of many documents whose terms lie in t from starts to ends: by (document, item), places counted from the document's start."""
        codes = self.run_codes(t)
        at = np.flatnonzero(codes >= 0)
        k = np.minimum(np.searchsorted(self.runs, codes[at]), len(self.runs) - 1)
        same = self.runs[k] == codes[at]
        if not same.any():
            return {}
        doc = np.searchsorted(starts, at[same], "right") - 1
        crowd = np.flatnonzero(np.bincount(doc, minlength=len(starts)))
        known = np.flatnonzero(t >= 0)
        known = known[np.isin(np.searchsorted(starts, known, "right") - 1, crowd)]
        pairs = (self.run_first[k[same] + 1] - self.run_first[k[same]]).sum() + (self.term_first[t[known] + 1] - self.term_first[t[known]]).sum()
        if pairs > MOST_PAIRS:
            return {(d, item): runs for d in crowd.tolist() for item, runs in self.shared_runs(t[starts[d] : ends[d]], need, around).items()}
        places, items = _expanded(at[same], k[same], self.run_first, self.run_holders)
        where, whose = _expanded(known, t[known], self.term_first, self.term_holders)
        doc = np.searchsorted(starts, places, "right") - 1
        size = len(t) + 1
        held = np.sort(whose * size + where)
        low, high = np.maximum(places - around, starts[doc]), np.minimum(places + around + SEED, ends[doc])
        enough = np.searchsorted(held, items * size + high) - np.searchsorted(held, items * size + low) >= need
        out: dict[tuple[int, int], list[int]] = {}
        for d, item, p in zip(doc[enough].tolist(), items[enough].tolist(), (places - starts[doc])[enough].tolist()):
            out.setdefault((d, item), []).append(p)
        return out

    def _grams(self, s: np.ndarray) -> np.ndarray:
        """Codes of three words in a row, -1 where one of them is in no item. Up to 2^21 different words."""
        s = s.astype(np.int64)
        code = (s[:-2] << 42) | (s[1:-1] << 21) | s[2:]
        return np.where((s[:-2] < 0) | (s[1:-1] < 0) | (s[2:] < 0), -1, code)

    def term_numbers(self, s: np.ndarray) -> np.ndarray:
        """The term that starts at each word, -1 where none does."""
        if len(s) < 3 or not len(self.terms):
            return np.full(max(0, len(s) - 2), -1, np.int64)
        g = self._grams(s)
        at = np.minimum(np.searchsorted(self.terms, g), len(self.terms) - 1)
        return np.where(self.terms[at] == g, at, -1)


def aligned(item: np.ndarray, doc: np.ndarray, least: int, per_edit: int, seed: int = SEED) -> bool:
    """Does doc hold at least `least` words of item in a row with at most one in per_edit changed, dropped or added?

    Grows runs of equal words to both sides, each time as far as a number of edits allows. Any stretch of 25 words with
    three edits has a run of at least six words, which is where it starts.
    """
    if len(item) < least or len(doc) < seed:
        return False
    runs, wanted = _run_hashes(item, seed), _run_hashes(doc, seed)
    order = np.argsort(runs)
    low, high = np.searchsorted(runs[order], wanted), np.searchsorted(runs[order], wanted, "right")
    n = high - low
    at_doc = np.repeat(np.arange(len(wanted)), n)
    at_item = order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    # runs that continue a run one word before begin nothing
    place = at_item * (len(doc) + 1) + at_doc
    first = ~np.isin(place - len(doc) - 2, place) | (at_doc == 0) | (at_item == 0)
    most = 2 * (least // per_edit)
    a, b = item.tolist(), doc.tolist()
    # a stretch has a part of less than twice the least words with no more edits for its size: so many words near the run's diagonal are equal
    reach, drift = 2 * least - 1, (2 * least - 1) // per_edit
    band = np.arange(-drift, drift + 1)
    for i, j in zip(at_item[first].tolist(), at_doc[first].tolist()):
        rows = np.arange(max(0, i - reach), min(len(a), i + reach + 1))
        columns = rows[:, None] + (j - i) + band[None, :]
        inside = (columns >= 0) & (columns < len(b))
        if ((doc[np.minimum(np.maximum(columns, 0), len(b) - 1)] == item[rows][:, None]) & inside).any(axis=1).sum() < least - least // per_edit:
            continue
        right = _reach(a, b, int(i), int(j), 1, most)
        left = _reach(a, b, int(i) - 1, int(j) - 1, -1, most)
        for x in range(most + 1):
            for y in range(most + 1 - x):
                n = left[x] + right[y]
                more = max(0, least - n)  # changed words at the ends
                if n + more <= len(a) and n + more >= per_edit * (x + y + more):
                    return True
    return False


def _run_hashes(s: np.ndarray, size: int) -> np.ndarray:
    """64-bit codes of `size` words in a row."""
    n = len(s) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + s[k : k + n].astype(np.uint64) + np.uint64(2)
    return out


def _reach(a: list[int], b: list[int], i: int, j: int, step: int, most: int) -> list[int]:
    """For 0 .. most edits, how many words of a from i on in direction step can be aligned with b from j on, ending in an equal word."""

    def slide(x: int, y: int) -> int:
        n = 0
        while 0 <= x < len(a) and 0 <= y < len(b) and a[x] == b[y]:
            n, x, y = n + 1, x + step, y + step
        return n

    front = {0: slide(i, j)}  # by diagonal (words of a less words of b): words of a used
    out = [front[0]]
    for _ in range(most):
        grown: dict[int, int] = {}
        for d, n in front.items():
            for dd, used in ((d, n + 1), (d + 1, n + 1), (d - 1, n)):  # changed, dropped from b, added in b
                x, y = i + step * used, j + step * (used - dd)
                if used - dd >= 0:
                    far = slide(x, y)
                    if far and used + far > grown.get(dd, -1) or dd not in grown and 0 <= x <= len(a):
                        grown[dd] = max(grown.get(dd, -1), used + far)
        front = grown
        out.append(max([out[-1], *(n for d, n in front.items() if 0 <= i + step * (n - 1) < len(a) and 0 <= j + step * (n - d - 1) < len(b) and a[i + step * (n - 1)] == b[j + step * (n - d - 1)])]))
    return out


def _stretches(runs: list[int], around: int) -> Iterator[tuple[int, int]]:
    """Bounds of the words to align so that each run of SEED words has `around` words on both sides; runs of up to SPAN words apart share one."""
    a = last = runs[0]
    for p in runs[1:]:
        if p - last > 2 * around or p - a > SPAN:
            yield max(0, a - around), last + SEED + around
            a = p
        last = p
    yield max(0, a - around), last + SEED + around


def _basis(spark, items: Items, idf: np.ndarray, dimensions: int, iterations: int, seed: int = 7) -> np.ndarray:
    """Term vectors of the latent space: the leading right singular vectors of the items' passages, by randomised SVD.

    Each round multiplies the passages' matrix and its transpose with a thin matrix in distributed blocks of rows; only
    thin matrices over the items' own terms reach the driver.
    """
    n, k = len(idf), min(dimensions, max(1, len(items.passages)))
    q = np.random.default_rng(seed).standard_normal((n, k)).astype(np.float32)
    rows = spark.createDataFrame([Row(t=p.tolist()) for p in items.passages], "t array<int>").repartition(4)
    for _ in range(iterations):
        thin = spark.sparkContext.broadcast(q)
        weights = spark.sparkContext.broadcast(idf)

        def multiply(batches: Iterator[pa.RecordBatch], thin=thin, weights=weights) -> Iterator[pa.RecordBatch]:
            q, idf = thin.value, weights.value
            total = np.zeros_like(q)
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    v = idf[t]
                    v = v / (np.sqrt((v * v).sum()) or 1.0)
                    np.add.at(total, t, v[:, None] * (v @ q[t])[None, :])
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["z"])

        z = np.zeros((n, k), np.float32)
        for r in rows.mapInArrow(multiply, "z binary").toLocalIterator():
            z += np.frombuffer(r["z"], np.float32).reshape(n, k)
        q = np.linalg.qr(z)[0].astype(np.float32)
        thin.unpersist()
        weights.unpersist()
    return np.ascontiguousarray(q)


def _embed(terms: list[np.ndarray], idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Latent vectors of unit length, one per passage given as term numbers."""
    lengths = np.array([len(t) for t in terms])
    flat = np.concatenate(terms) if len(terms) else np.zeros(0, np.int64)
    sums = np.add.reduceat(basis[flat] * idf[flat][:, None], np.r_[0, np.cumsum(lengths)[:-1]], axis=0) if len(flat) else np.zeros((0, basis.shape[1]), np.float32)
    return sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)


def _together(sequences: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents in stretches of about TOGETHER words: the number of the first, the words with -1 after each document, and where documents start and end."""
    k = 0
    while k < len(sequences):
        n, parts, sizes = 0, [], []
        first = k
        while k < len(sequences) and (not parts or n + len(sequences[k]) < TOGETHER):
            parts += [sequences[k], np.array([-1], np.int32)]
            sizes.append(len(sequences[k]))
            n += len(sequences[k]) + 1
            k += 1
        ends = np.cumsum(np.array(sizes) + 1) - 1
        yield first, np.concatenate(parts), ends - sizes, ends


def _windows(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first term and number of terms of each passage of the documents."""
    terms = np.maximum(ends - starts - 2, 0)
    width = np.minimum(WINDOW - 2, terms)
    spare = terms - width
    n = np.where(terms > 0, spare // DOC_STEP + 1 + (spare % DOC_STEP > 0), 0)
    doc = np.repeat(np.arange(len(starts)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return doc, starts[doc] + np.minimum(within * DOC_STEP, spare[doc]), width[doc]


def leaks(documents: DataFrame, items: DataFrame, id_: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = 25, per_edit: int = 8, cosine: float = COSINE, block_words: int = BLOCK_WORDS, by_cosine_alone: bool = False) -> DataFrame:
    """(doc_id, item_id): the document holds at least `least` words of the item's passage with at most one edit in per_edit words.

    Null and empty texts and items shorter than `least` words match nothing; repeated documents and items with equal
    passages all count; texts are read whole; other columns are ignored; empty tables give no rows. The cosine is that of
    the latent vectors times the root of the share of the passage's terms that some item has: a term that no item has adds
    nothing to any product. Weights have a floor, so that terms of many documents still count. Passages are also aligned
    wherever SEED words in a row are those of an item: at most one edit in eight words leaves such a run in every stretch
    of 25 words or more, and beside it so many unbroken terms (14 for 25 words) that documents and runs without them need
    no alignment. by_cosine_alone leaves that second way out; it is there to measure the first.
    """
    spark = documents.sparkSession
    wanted = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").distinct()
    # blocks of bounded size, fetched one after the other
    total = wanted.agg(F.sum(F.size(F.split("t", "\\W+")))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    texts = documents.select(F.col(id_).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    if blocks > 1:
        texts = stored(_hashed(texts))  # texts are cut into words once for all blocks
    out = None
    for k in range(blocks):
        part = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        found = _block(spark, texts, Items([(r["i"], r["t"]) for r in part.orderBy("i", "t").collect()], least), least, per_edit, cosine, by_cosine_alone)
        out = found if out is None else out.unionByName(found)
    kinds = (documents.schema[id_].dataType, items.schema[item_id].dataType)
    return out.select(F.col("doc_id").cast(kinds[0]).alias(id_), F.col("item_id").cast(kinds[1]).alias(item_id)).distinct()


def _hashed(texts: DataFrame) -> DataFrame:
    """(doc_id, text): the 64-bit hashes of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            data = [np.array([xxhash.xxh64_intdigest(w) for w in words(t)], np.uint64).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "text"])

    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, text binary")


def _numberer(block: Items, hashed: bool):
    """From a text, or the hashes of its words, to the numbers of its words, -1 for words in no item."""
    if not hashed:
        get = block.number.get
        return lambda t: np.array([get(w, -1) for w in words(t)], np.int32)
    import xxhash

    codes = np.array([xxhash.xxh64_intdigest(w) for w in block.number], np.uint64)
    order = np.argsort(codes)
    codes = codes[order]

    def number(data: bytes) -> np.ndarray:
        h = np.frombuffer(data, np.uint64)
        at = np.minimum(np.searchsorted(codes, h), len(codes) - 1)
        return np.where(codes[at] == h, order[at], -1).astype(np.int32)

    return number


def _block(spark, texts: DataFrame, items: Items, least: int, per_edit: int, cosine: float, by_cosine_alone: bool) -> DataFrame:
    if not items.ids:
        return spark.createDataFrame([], "doc_id long, item_id long")
    known = spark.sparkContext.broadcast(items)
    hashed = texts.schema["text"].dataType.simpleString() == "binary"
    # an edit breaks three terms at most, and a longer stretch has a part of these lengths with no more edits for its size
    need = max(1, min(n - 2 - 3 * (n // per_edit) for n in range(least, 2 * least)))
    # of a stretch of `least` words, some passage of a document holds all but half a step
    shared = max(1, need - DOC_STEP // 2 - 1)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Different terms of each text, and its words as numbers; those of a text with fewer terms than any leak has end here."""
        block = known.value
        numbers = _numberer(block, hashed)
        for batch in batches:
            sequences = [numbers(t) for t in batch.column(1).to_pylist()]
            pairs, counts = [], np.zeros(len(sequences), np.int64)
            for first, flat, starts, _ in _together(sequences):
                t = block.term_numbers(flat)
                at = np.flatnonzero(t >= 0)
                doc = np.searchsorted(starts, at, "right") - 1 + first
                counts += np.bincount(doc, minlength=len(sequences))
                pairs.append(np.unique(doc * len(block.terms) + t[at]))
            pairs = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
            doc, term = np.divmod(pairs, max(1, len(block.terms)))
            offsets = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(sequences)))].astype(np.int32)
            data = [s.tobytes() if n >= need else None for s, n in zip(sequences, counts.tolist())]
            arrays = [batch.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(term.astype(np.int32))), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "terms", "words"])

    coded = stored(texts.mapInArrow(number, "doc_id long, terms array<int>, words binary"))
    df, total = np.zeros(len(items.terms)), coded.count()
    for r in coded.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).toLocalIterator():
        df[r["term"]] = r["n"]
    idf = np.maximum(np.log((1 + total) / (1 + df)), np.log(1 + total) / 3).astype(np.float32) + np.float32(1e-3)
    basis = _basis(spark, items, idf, DIMENSIONS, ITERATIONS)
    latent = spark.sparkContext.broadcast((idf, basis, _embed(items.passages, idf, basis)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, (idf, basis, queries) = known.value, latent.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            sequences = [np.frombuffer(w, np.int32) for w in batch.column(1).to_pylist()]
            rows = []
            for first, flat, starts, ends in _together(sequences):
                t = np.r_[block.term_numbers(flat), -1, -1]
                runs = block.runs_of_many(t, starts, ends, need, 2 * least)
                near = _near(block, t, starts, ends, idf, basis, queries, cosine, shared)
                # candidates by cosine come first; whatever has no run of SEED words cannot be aligned
                for d, item in [*(p for p in near if p in runs), *(() if by_cosine_alone else (p for p in runs if p not in near))]:
                    s = sequences[first + d]
                    if any(aligned(block.sequences[item], s[a:b], least, per_edit) for a, b in _stretches(runs[(d, item)], 2 * least)):
                        rows += [(ids[first + d], i) for i in block.ids[item]]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], names=["doc_id", "item_id"])

    return coded.where("words is not null").select("doc_id", "words").mapInArrow(search, "doc_id long, item_id long")


def _near(block: Items, t: np.ndarray, starts: np.ndarray, ends: np.ndarray, idf: np.ndarray, basis: np.ndarray, queries: np.ndarray, cosine: float, shared: int) -> dict[tuple[int, int], None]:
    """(document, item) pairs with passages whose cosine is at least `cosine`.

    A passage is searched among the passages of the items that have `shared` of its terms, which the terms' lists of
    items tell.
    """
    doc, at, width = _windows(starts, ends)
    known = np.flatnonzero(t >= 0)
    low, high = np.searchsorted(known, at), np.searchsorted(known, at + width)
    share = np.sqrt((high - low) / np.maximum(width, 1)).astype(np.float32)
    kept = np.flatnonzero(high - low >= shared)
    n_items, (first, last) = len(block.ids), block.spans
    out: dict[tuple[int, int], None] = {}
    for lo in range(0, len(kept), 2048):
        w = kept[lo : lo + 2048]
        n = high[w] - low[w]
        flat = t[known[np.repeat(low[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())]]
        row, item = _expanded(np.repeat(np.arange(len(w)), n), flat, block.term_first, block.term_holders)
        pairs, times = np.unique(row * n_items + item, return_counts=True)
        row, item = np.divmod(pairs[times >= shared], n_items)
        if not len(row):
            continue
        sums = np.add.reduceat(basis[flat] * idf[flat][:, None], np.r_[0, np.cumsum(n)[:-1]], axis=0)
        vectors = sums * (share[w] / np.maximum(np.linalg.norm(sums, axis=1), 1e-9))[:, None]
        for k in range(0, len(row), 512):
            r, i = row[k : k + 512], item[k : k + 512]
            m = last[i] - first[i]
            passages = np.repeat(first[i] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            near = np.einsum("ij,ij->i", vectors[np.repeat(r, m)], queries[passages])
            best = np.maximum.reduceat(near, np.r_[0, np.cumsum(m)[:-1]])
            for d, x in zip(doc[w][r[best >= cosine]].tolist(), i[best >= cosine].tolist()):
                out[(d, x)] = None
    return out
