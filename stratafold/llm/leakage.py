"""Evaluation texts inside a corpus, by spaced-seed hashing and substitution-tolerant verification.

Every text is a row of words. A seed is a fixed mask over ``SPAN`` consecutive words that ignores some positions; the hash of
the words it looks at is computed at every position of test and training texts for every mask, and equal hashes join them. So
two passages with a few substituted words still meet as long as one mask ignores them, and two passages that share ``SPAN``
words meet under every mask. Around each hit the two texts are compared word by word along the hit's diagonal, over the whole
length both have there: that yields the longest run of equal words and the best overlap that tolerates substitutions.

The test set is the stated query set. Up to ``BLOCK_CHARS`` characters of it are indexed and broadcast, and all training texts
stream by, so nothing of the corpus is shuffled and a passage that a third of all documents share costs no more than its rows.
A larger test set stays distributed: a bitmap of fixed size that holds its seeds screens the training texts where they lie;
texts with a possible seed are written out once, their seeds meet those of the items in a shuffled join (hot seeds are left to
the adaptive planner, which splits them), and each pair of a text and an item is verified along its diagonals as above. Both
ways give the same rows. Words are compared as words (by numbers of a dictionary), so a match is not a matter of hashes.

Defined cases. A word is a longest run of Unicode letters and digits, lower-cased. Null texts, and texts or items with fewer
than ``SPAN`` words, have no case; items without an id are left aside. Items that share a passage are all reported. Documents
or items that repeat are reported once; documents without an id under a null id. Other columns are never read. Empty tables
give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.functions.jsontext import by_bytes
from stratafold.session import broadcast_object, dealt, materialize

SPAN = 12
#: Positions looked at (1) and ignored (0). Any one substitution is ignored by some mask at some place of a longer overlap.
MASKS = ("111011010111", "110110111011", "101101101111")
#: Characters of test text that are broadcast at most; bits (a power of two) of the map that screens texts for larger test sets.
BLOCK_CHARS, SCREEN_BITS = 4_000_000, 1 << 26
#: Texts, bytes of text and hits held at once.
TEXTS, TEXT_BYTES, HITS = 1_000, 4 << 20, 1_000_000
#: Least words and largest share of substitutions of an overlap that is reported as near.
NEAR_WORDS, NEAR_SUBSTITUTIONS = 12, 0.2
_WORD = r"[\p{L}\p{N}]+"
_ANY_WORD = regex.compile(_WORD)
#: The same words where a text has only these signs.
_PLAIN_TEXT = re.compile("[\x00-\u024f\u0400-\u0481\u048a-\u04ff\u2010-\u2027\u2030-\u205e]*")
_PLAIN_WORD = re.compile("[0-9A-Za-z\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xc0-\xd6\xd8-\xf6\xf8-\u024f\u0400-\u0481\u048a-\u04ff]+")
_FACTOR = 0x9E3779B97F4A7C15


def split(text: str | None) -> list[str]:
    """The words of a text as they are written."""
    return (_PLAIN_WORD if _PLAIN_TEXT.fullmatch(text) else _ANY_WORD).findall(text) if text else []


def words_of(text: str | None) -> list[str]:
    return [w.lower() for w in split(text)]


class Numbers(dict):
    """Numbers of words as they are written, by the vocabulary's lower-cased ones; -1 for others."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        number = self[word] = self.vocabulary.get(word.lower(), -1)
        return number


def seed_hashes(ids: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes under one mask, and the positions they stand for: those where the mask sees no unknown word."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    seen = [i for i, m in enumerate(mask) if m == "1"]
    at = np.flatnonzero(ids[: n] >= 0) if seen[0] == 0 else np.arange(n)
    for i in seen[1:]:
        at = at[ids[at + i] >= 0]
    value = np.zeros(len(at), np.uint64)
    for i in seen:
        value = (value ^ ids[at + i].astype(np.uint64)) * np.uint64(_FACTOR)
        value ^= value >> np.uint64(29)
    return value, at


class SeedIndex:
    """The words and seeds of a block of test items."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.vocabulary: dict[str, int] = {}
        self.item_ids: list[int] = []
        rows = []
        for item, text in items:
            words = words_of(text)
            if len(words) >= SPAN:
                self.item_ids.append(item)
                rows.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int64))
        self.starts = np.cumsum([0, *map(len, rows)])
        self.words = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.seeds = []
        for mask in MASKS:
            parts = [seed_hashes(r, mask) for r in rows]
            if not parts:
                self.seeds.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                continue
            hashes = np.concatenate([h for h, _ in parts])
            places = np.concatenate([s + at for s, (_, at) in zip(self.starts, parts)])
            order = np.argsort(hashes, kind="stable")
            self.seeds.append((hashes[order], places[order]))

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (diagonal, item) pairs of all seed hits, the diagonal as text position minus place in the block."""
        found = []
        for mask, (hashes, places) in zip(MASKS, self.seeds):
            value, at = seed_hashes(ids, mask)
            lo = np.searchsorted(hashes, value, "left")
            count = np.searchsorted(hashes, value, "right") - lo
            hit = np.flatnonzero(count)
            if not len(hit):
                continue
            # A seed that many places of the items share is expanded in parts, of which the distinct diagonals are kept.
            ends = np.cumsum(count[hit])
            first = 0
            while first < len(hit):
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + HITS, "right")))
                part = hit[first:last]
                n = count[part]
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                place = places[np.repeat(lo[part], n) + nth]
                found.append(np.unique(np.stack([np.repeat(at[part], n) - place, np.searchsorted(self.starts, place, "right") - 1], 1), axis=0))
                first = last
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.concatenate(found), axis=0)
        return pairs[:, 0], pairs[:, 1]


def compare(text: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int, int, int]:
    """Along one diagonal (text position = item position + shift): the longest run of equal words, and of the best overlap its
    place in text and item, its words and its substitutions."""
    lo, hi = max(0, -shift), min(len(item), len(text) - shift)
    same = text[lo + shift : hi + shift] == item[lo:hi]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    run = int((edges[1::2] - edges[::2]).max()) if len(edges) else 0
    # The segment of greatest score: +1 for an equal word, -3 for a substitution.
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -3))])
    least = np.minimum.accumulate(total[:-1])
    end = int(np.argmax(total[1:] - least))
    start = int(np.flatnonzero(total[: end + 1] == least[end])[-1])
    return run, lo + start + shift, lo + start, end + 1 - start, int((~same[start : end + 1]).sum())


def better(best: dict[tuple, tuple], pair: tuple, found: tuple[int, int, int, int, int]) -> None:
    """Takes up what ``compare`` found for a pair, if it is a case: the longest run and the best overlap of all diagonals."""
    run, doc_pos, item_pos, length, subs = found
    if run < SPAN and (length < NEAR_WORDS or subs > NEAR_SUBSTITUTIONS * length):
        return
    rank = (length - 4 * subs, -doc_pos, -item_pos)
    old = best.get(pair)
    if old is None or rank > old[0]:
        best[pair] = (rank, max(run, old[1] if old else 0), doc_pos, item_pos, length, subs)
    elif run > old[1]:
        best[pair] = (old[0], run, *old[2:])


_OUT = "doc_id long, item_id long, exact_words int, doc_pos int, item_pos int, overlap_words int, substitutions int"


def _join(batches: Iterator[pa.RecordBatch], index: SeedIndex) -> Iterator[pa.RecordBatch]:
    numbers = Numbers(index.vocabulary)
    for batch in batches:
        rows: list[tuple] = []
        for part in (most.slice(lo, TEXTS) for most in by_bytes(batch, 1, TEXT_BYTES) for lo in range(0, most.num_rows, TEXTS)):
            ids: list[int] = []
            starts = []
            for text in part.column(1).to_pylist():
                starts.append(len(ids))
                ids.extend(map(numbers.__getitem__, split(text)))
                ids.extend([-1] * SPAN)
            if len(numbers) > 500_000:
                numbers.clear()
            flat = np.array(ids, np.int64)
            begin = np.array([*starts, len(flat)])
            keys = part.column(0).to_pylist()
            diagonals, items = index.hits(flat)
            best: dict[tuple[int, int], tuple] = {}
            for diagonal, item in zip(diagonals.tolist(), items.tolist()):
                words = index.words[index.starts[item] : index.starts[item + 1]]
                shift = diagonal + int(index.starts[item])
                # The hit lies within one text; its words may begin before the diagonal meets the item.
                for doc in range(int(np.searchsorted(begin, max(shift, 0), "right")) - 1, min(int(np.searchsorted(begin, shift + len(words), "left")), len(keys))):
                    text = flat[begin[doc] : begin[doc + 1] - SPAN]
                    local = shift - int(begin[doc])
                    if len(text) < SPAN or min(len(words), len(text) - local) - max(0, -local) < SPAN:
                        continue
                    better(best, (doc, item), compare(text, words, local))
            rows += [(keys[doc], index.item_ids[item], *found[1:]) for (doc, item), found in best.items()]
        kinds = (pa.int64(), pa.int64(), *[pa.int32()] * 5)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=[c.split()[0] for c in _OUT.split(", ")])


def word_hashes(text: str | None) -> np.ndarray:
    """Numbers of a text's words that need no dictionary, for seeds only."""
    return np.array([xxhash.xxh3_64_intdigest(w) >> 1 for w in words_of(text)], np.int64)


def text_seeds(text: str | None) -> list[tuple[int, int]]:
    """Every (seed, position) of a text, the mask being part of the seed."""
    ids = word_hashes(text)
    out = []
    for number, mask in enumerate(MASKS):
        value, at = seed_hashes(ids, mask)
        out += zip((value + np.uint64(number)).view(np.int64).tolist(), at.tolist())
    return out


def _screen_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(SCREEN_BITS, np.bool_)
    for batch in batches:
        bits[batch.column(0).to_numpy() & (SCREEN_BITS - 1)] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])


def _possible(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Texts that hold a seed of the screen, with those seeds."""
    for batch in batches:
        for part in (most.slice(lo, TEXTS) for most in by_bytes(batch, 1, TEXT_BYTES) for lo in range(0, most.num_rows, TEXTS)):
            rows = []
            for key, text in zip(*(c.to_pylist() for c in part.columns)):
                seeds = [(s, p) for s, p in text_seeds(text) if bits[(s & (SCREEN_BITS - 1)) >> 3] >> (7 - (s & 7)) & 1]
                if seeds:
                    rows.append((key, text, [{"seed": s, "pos": p} for s, p in seeds]))
            seeds_of = pa.list_(pa.struct([("seed", pa.int64()), ("pos", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), seeds_of))], names=["doc_id", "text", "seeds"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a text and an item with their diagonals (doc_id, text, item_id, item_text, shifts)."""
    for batch in batches:
        rows = []
        for key, text, item, item_text, shifts in zip(*(c.to_pylist() for c in batch.columns)):
            numbers: dict[str, int] = {}
            own, other = (np.array([numbers.setdefault(w, len(numbers)) for w in words_of(t)], np.int64) for t in (text, item_text))
            best: dict[tuple, tuple] = {}
            for shift in shifts:
                better(best, (), compare(own, other, shift))
            rows += [(key, item, *found[1:]) for found in best.values()]
        kinds = (pa.int64(), pa.int64(), *[pa.int32()] * 5)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=[c.split()[0] for c in _OUT.split(", ")])


def _shuffled(source: DataFrame, tests: DataFrame) -> DataFrame:
    """The overlaps with a test set of any size, by a join of seeds."""
    spark = source.sparkSession
    find = F.udf(lambda text: [{"seed": s, "place": p} for s, p in text_seeds(text)], "array<struct<seed: long, place: int>>", useArrow=True)
    item_seeds = materialize(tests.distinct().select("item", F.explode(find("text")).alias("s")).select("item", "s.seed", "s.place"))
    bits = np.zeros(SCREEN_BITS // 8, np.uint8)
    # One bitmap of fixed size at a time, from few partitions.
    for row in item_seeds.select("seed").coalesce(16).mapInArrow(_screen_map, "bits binary").toLocalIterator():
        bits |= np.frombuffer(row[0], np.uint8)
    shared = broadcast_object(spark, bits)
    texts = materialize(source.mapInArrow(lambda batches: _possible(batches, shared()), "doc_id long, text string, seeds array<struct<seed: long, pos: int>>").withColumn("row", F.monotonically_increasing_id()))
    hits = texts.select("row", F.explode("seeds").alias("s")).select("row", "s.seed", "s.pos").join(item_seeds, "seed")
    pairs = hits.groupBy("row", "item").agg(F.collect_set(F.col("pos") - F.col("place")).alias("shifts"))
    full = pairs.join(texts.select("row", "doc_id", "text"), "row").join(tests.distinct().select("item", F.col("text").alias("item_text")), "item")
    return full.select("doc_id", "text", F.col("item").alias("item_id"), "item_text", "shifts").mapInArrow(_verify, _OUT)


def leaks(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, partitions: int | None = None) -> DataFrame:
    """One row per document and test item that overlap: ``doc_id, item_id``, the longest run of equal words
    (``exact_words``), and the best overlap that tolerates substitutions (``doc_pos, item_pos, overlap_words,
    substitutions``); pairs with neither a run of ``SPAN`` words nor a near overlap are left out."""
    spark = documents.sparkSession
    tests = items.select(F.col(item_key).cast("long").alias("item"), F.col(item_text).alias("text")).dropna()
    chars = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    source = dealt(documents.select(F.col(key).cast("long"), F.col(text)), partitions)
    if chars > BLOCK_CHARS:
        out = _shuffled(source, tests)
    else:
        # The stated query set, bounded by BLOCK_CHARS, is indexed here and broadcast.
        shared = broadcast_object(spark, SeedIndex(sorted({tuple(r) for r in tests.collect()})))
        out = source.mapInArrow(lambda batches: _join(batches, shared()), _OUT)
    return out.groupBy("doc_id", "item_id").agg(F.max("exact_words").alias("exact_words"), F.max(F.struct((F.col("overlap_words") - 4 * F.col("substitutions")).alias("score"), -F.col("doc_pos"), -F.col("item_pos"), "doc_pos", "item_pos", "overlap_words", "substitutions")).alias("best")).select("doc_id", "item_id", "exact_words", "best.doc_pos", "best.item_pos", "best.overlap_words", "best.substitutions")
