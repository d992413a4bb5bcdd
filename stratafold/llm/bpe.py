"""Byte-level BPE of a whole corpus by DuckDB recursive queries in each partition.

A partition's texts are cut into words by the tokenizer's published pattern. The words that the partition has not met yet
become token-position rows, one for each byte, and a recursive query contracts them: rows join the merge table on adjacent
tokens, each word picks its pair of least rank, and the pair's occurrences are contracted, leftmost first, until no pair of
the word is in the table. All occurrences of one pair go in one step: a contraction makes only pairs of later rank, so they
are what the leftmost rule would contract next anyway. Ordered aggregation returns the ids of a word; a text's ids are those
of its words in order. Decoding is an ordered aggregation of the tokens' bytes.

Long words (more than ``SHORT`` bytes) would need as many rounds as they use merges. A pair may be contracted out of turn if
its rank is the least within the reach of a token on both sides: whatever contracts earlier in the exact order and could
take one of its two tokens makes a token that holds it, so it lies within that reach and starts from a pair of lesser rank
there. The reach is the length of the longest token made of the word's own bytes. So a round contracts pairs all over the
word, and the rounds do not grow with its length. Runs of equal pairs are contracted from their first on, as far as all of them
are least. Words longer than ``PIECE`` tokens are cut into pieces in which pairs near a cut wait; the next pass cuts elsewhere.
That, and fewer rounds a query for longer pieces, bounds the rows that a query holds by ``HELD_ROWS``.

The merge table (about 50,000 rows, a fixed size) is read on the driver and broadcast; the path is a parameter. Nothing is
shuffled, so no key can be hot.

Defined cases. Empty and null texts give an empty list; blank texts give the tokens of their blanks. Texts that look like
special tokens are ordinary text. Repeated rows give repeated output, rows without an id keep their null id. Texts of any
length are encoded whole. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafold.functions.jsontext import by_bytes
from stratafold.session import broadcast_object, dealt

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that the published byte-level vocabularies were made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f\u0400-\u0481\u048a-\u04ff"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: Texts of these signs only are cut by the standard library, to the same words.
_PLAIN_TEXT = re.compile("[\x00-\x1b\x20-\u024f\u0400-\u0481\u048a-\u04ff\u2010-\u2027\u2030-\u205e]*")
_PLAIN_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+")
#: Bytes of a short word; rows that a query of short words holds in all rounds; words a worker remembers.
SHORT, QUERY_ROWS, REMEMBERED = 64, 400_000, 400_000
#: Long words: tokens of a piece, pieces of a query, rows that a query holds in all rounds and rounds at most.
PIECE, PIECES, HELD_ROWS, ROUNDS = 100_000, 2, 1_600_000, 24
#: Texts, and bytes of text, encoded at once.
TEXTS, TEXT_BYTES = 2_000, 4 << 20


@dataclass(frozen=True)
class Vocabulary:
    """Ids of the 256 bytes, merges (left, right, merged) by rank, and the bytes of every id."""

    byte_ids: np.ndarray
    merges: np.ndarray
    token_bytes: list[bytes]


def _byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in shown}
    hidden = [b for b in range(256) if b not in table]
    return table | {b: chr(256 + i) for i, b in enumerate(hidden)}


def load_vocabulary(path: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> Vocabulary:
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocab, shown = model["vocab"], _byte_characters()
    back = {c: b for b, c in shown.items()}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    token_bytes = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        token_bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return Vocabulary(np.array([vocab[shown[b]] for b in range(256)], np.int32), np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int32), token_bytes)


_CONTRACT = """
WITH RECURSIVE state(round, word, pos, token) AS (
  SELECT 0, word, pos, token FROM start_rows
  UNION ALL
  SELECT round + 1, word, pos, CASE WHEN taken THEN merged ELSE token END
  FROM (
    SELECT *, lag(taken, 1, false) OVER (PARTITION BY word ORDER BY pos) AS swallowed
    FROM (
      SELECT *, hit AND (row_number() OVER (PARTITION BY word, hit, island ORDER BY pos)) % 2 = 1 AS taken
      FROM (
        SELECT *, place - row_number() OVER (PARTITION BY word, hit ORDER BY pos) AS island
        FROM (
          SELECT *, rank IS NOT NULL AND rank = best AS hit
          FROM (
            SELECT p.*, m.rank, m.merged, min(m.rank) OVER (PARTITION BY p.word) AS best
            FROM (SELECT *, lead(token) OVER w AS next_token, row_number() OVER w AS place FROM state WINDOW w AS (PARTITION BY word ORDER BY pos)) p
            LEFT JOIN merges m ON m.left_token = p.token AND m.right_token = p.next_token
          ) WHERE best IS NOT NULL
        )
      )
    )
  ) WHERE NOT swallowed
)
SELECT word, list(token ORDER BY pos) AS ids FROM (
  SELECT *, max(round) OVER (PARTITION BY word) AS last_round FROM state
) WHERE round = last_round GROUP BY word
"""


#: The same for long words, in pieces: a pair of least rank within a token's reach on both sides is contracted at once. ``pos``
#: is a byte offset, ``pieces`` says between which offsets a pair's surroundings are all in the piece.
_CONTRACT_LONG = """
WITH RECURSIVE state(round, word, pos, token) AS (
  SELECT 0, word, pos, token FROM start_rows
  UNION ALL
  SELECT round + 1, word, pos, CASE WHEN taken THEN merged ELSE token END
  FROM (
    SELECT *, lag(taken, 1, false) OVER (PARTITION BY word ORDER BY pos) AS swallowed, bool_or(taken) OVER (PARTITION BY word) AS moved
    FROM (
      SELECT *, rank IS NOT NULL AND nth % 2 = 1 AND sure AS taken
      FROM (
        SELECT *, row_number() OVER e AS nth, bool_and(coalesce(rank = best, false) AND pos >= low AND pos <= high) OVER e AS sure
        FROM (
          SELECT *, sum(edge) OVER (PARTITION BY word ORDER BY pos ROWS UNBOUNDED PRECEDING) AS equal_run
          FROM (
            SELECT r.*, b.low, b.high,
              (rank IS DISTINCT FROM lag(rank) OVER (PARTITION BY r.word ORDER BY pos))::INT AS edge,
              min(rank) OVER (PARTITION BY r.word ORDER BY pos RANGE BETWEEN {reach} PRECEDING AND {reach} * 2 FOLLOWING) AS best
            FROM (
              SELECT p.*, m.rank, m.merged
              FROM (SELECT *, lead(token) OVER (PARTITION BY word ORDER BY pos) AS next_token FROM state) p
              LEFT JOIN merges m ON m.left_token = p.token AND m.right_token = p.next_token
            ) r JOIN pieces b USING (word)
          )
        ) WINDOW e AS (PARTITION BY word, equal_run ORDER BY pos ROWS UNBOUNDED PRECEDING)
      )
    )
  ) WHERE moved AND NOT swallowed AND round < {rounds}
)
SELECT word, token FROM (
  SELECT *, max(round) OVER (PARTITION BY word) AS last_round FROM state
) WHERE round = last_round ORDER BY word, pos
"""


class Encoder:
    """The recursive queries of one worker, with the short words it has met."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.pattern = regex.compile(PATTERN)
        self.byte_ids = vocabulary.byte_ids
        self.lengths = np.array([len(b) for b in vocabulary.token_bytes], np.int64)
        self.held_bytes = _byte_sets(vocabulary.token_bytes)
        self.known: dict[str, np.ndarray] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        left, right, merged = vocabulary.merges.T
        self._table("merges", {"left_token": left, "right_token": right, "merged": merged, "rank": np.arange(len(left), dtype=np.int32)})

    def split(self, text: str) -> list[str]:
        return (_PLAIN_WORDS if _PLAIN_TEXT.fullmatch(text) else self.pattern).findall(text)

    def _table(self, name: str, columns: dict[str, np.ndarray]) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _contract(self, words: list[str], bytes_of: list[bytes]) -> None:
        """Encodes short words."""
        sizes = np.array([len(b) for b in bytes_of])
        owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        at = np.arange(len(owner), dtype=np.int32) - np.repeat(np.cumsum(sizes) - sizes, sizes).astype(np.int32)
        self._table("start_rows", {"word": owner, "pos": at, "token": self.byte_ids[np.frombuffer(b"".join(bytes_of), np.uint8)]})
        found = self.db.sql(_CONTRACT).to_arrow_table()
        offsets, flat = found.column("ids").combine_chunks().offsets.to_numpy(), found.column("ids").combine_chunks().values.to_numpy()
        for word, lo, hi in zip(found.column("word").to_pylist(), offsets.tolist(), offsets[1:].tolist()):
            self.known[words[word]] = flat[lo:hi]

    def _short(self, words: set[str]) -> None:
        held: list[str] = []
        spelled: list[bytes] = []
        rows = 0
        for word in sorted(words, key=len):
            raw = word.encode("utf-8")
            # A word's rows of all rounds are held at once.
            weight = len(raw) * len(raw) // 8 + 1
            if held and rows + weight > QUERY_ROWS:
                self._contract(held, spelled)
                held, spelled, rows = [], [], 0
            held.append(word)
            spelled.append(raw)
            rows += weight
        if held:
            self._contract(held, spelled)

    def _reach(self, raw: np.ndarray) -> int:
        """Bytes of the longest token that could occur in the word: no contraction can be felt further away."""
        own = np.zeros(256, np.bool_)
        own[raw] = True
        return int(self.lengths[(self.held_bytes & ~np.packbits(own)).max(axis=1) == 0].max(initial=1))

    def _long(self, word: str) -> np.ndarray:
        """Encodes a word of any length, in pieces whose cuts move from pass to pass."""
        raw = np.frombuffer(word.encode("utf-8"), np.uint8)
        reach = self._reach(raw)
        tokens = self.byte_ids[raw]
        shift = idle = 0
        piece = max(PIECE, 16 * reach)
        while True:
            cuts = np.array([0, *range(shift or piece, len(tokens), piece), len(tokens)])
            before, parts = len(tokens), []
            for first in range(0, len(cuts) - 1, PIECES):
                group = cuts[first : first + PIECES + 1]
                parts.append(self._contract_pieces(tokens[group[0] : group[-1]], np.diff(group), reach, group[0] == 0, group[-1] == before))
            tokens = np.concatenate(parts)
            idle = idle + 1 if len(tokens) == before else 0
            # A single piece has no cuts; otherwise two idle passes have covered each other's.
            if idle and (len(cuts) == 2 or idle == 2):
                return tokens
            shift = 0 if shift else piece // 2

    def _contract_pieces(self, tokens: np.ndarray, sizes: np.ndarray, reach: int, begins: bool, ends: bool) -> np.ndarray:
        piece = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        length = self.lengths[tokens]
        start = np.cumsum(length) - length
        firsts = np.cumsum(sizes) - sizes
        whole = np.add.reduceat(length, firsts)
        low, high = np.full(len(sizes), reach), whole - 3 * reach
        if begins:
            low[0] = 0
        if ends:
            high[-1] = whole[-1]
        self._table("start_rows", {"word": piece, "pos": (start - np.repeat(start[firsts], sizes)).astype(np.int32), "token": tokens})
        self._table("pieces", {"word": np.arange(len(sizes), dtype=np.int32), "low": low.astype(np.int32), "high": high.astype(np.int32)})
        rounds = max(1, min(ROUNDS, HELD_ROWS // len(tokens)))
        found = self.db.sql(_CONTRACT_LONG.format(reach=reach, rounds=rounds)).to_arrow_table()
        return found.column("token").to_numpy()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [self.split(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        fresh = {w for words in cut for w in words} - self.known.keys()
        long = {w for w in fresh if len(w) * 4 > SHORT and len(w.encode("utf-8")) > SHORT}
        self._short(fresh - long)
        own = {w: self._long(w) for w in long}
        known = self.known | own if own else self.known
        none = np.zeros(0, np.int32)
        return [np.concatenate([known[w] for w in words]) if words else none for words in cut]


def _byte_sets(tokens: list[bytes]) -> np.ndarray:
    """For each token the set of its bytes, as 256 packed bits."""
    sets = np.zeros((len(tokens), 256), np.bool_)
    rows = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    sets[rows, np.frombuffer(b"".join(tokens), np.uint8)] = True
    return np.packbits(sets, axis=1)


def _worker(slot: str, make):
    """One object a worker process, kept between tasks."""
    import sys

    store = sys.modules["builtins"].__dict__.setdefault("_stratafold_worker", {})
    if slot not in store:
        store.clear()
        store[slot] = make()
    return store[slot]


def encode(df: DataFrame, key: str, text: str, vocabulary: Vocabulary, partitions: int | None = None) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of every text, without special tokens; ``partitions`` deals the texts out first."""
    shared = broadcast_object(df.sparkSession, vocabulary)
    slot = f"bpe-{len(vocabulary.merges)}-{vocabulary.merges[:: max(1, len(vocabulary.merges) // 64)].tobytes().hex()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker(slot, lambda: Encoder(shared()))
        for batch in batches:
            for most in by_bytes(batch, 1, TEXT_BYTES):
                for lo in range(0, most.num_rows, TEXTS):
                    part = most.slice(lo, TEXTS)
                    ids = encoder.encode(part.column(1).to_pylist())
                    offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[key, "ids"])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return dealt(df.select(F.col(key), F.col(text)), partitions).mapInArrow(run, schema)


_DECODE = """
SELECT t.doc, string_agg(hex(v.bytes), '' ORDER BY t.pos) AS text_hex
FROM token_rows t JOIN token_bytes v ON v.id = t.token GROUP BY t.doc
"""


def decode(df: DataFrame, key: str, ids: str, vocabulary: Vocabulary) -> DataFrame:
    """``key`` and ``text`` of every list of ids; null lists give null, empty ones the empty text.

    Ids outside the vocabulary fail the job; bytes that are no UTF-8 come out as replacement characters.
    """
    shared = broadcast_object(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        tokens = shared().token_bytes
        db.register("given", pa.table({"id": pa.array(range(len(tokens)), pa.int32()), "bytes": pa.array(tokens, pa.binary())}))
        db.execute("CREATE TABLE token_bytes AS SELECT * FROM given")
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                lists = part.column(1).to_pylist()
                owner = np.repeat(np.arange(len(lists)), [len(x or ()) for x in lists])
                flat = np.fromiter((i for x in lists for i in x or ()), np.int32, len(owner))
                if len(flat) and not (0 <= flat.min() and flat.max() < len(tokens)):
                    raise ValueError("an id is outside the vocabulary")
                db.register("token_rows", pa.table({"doc": owner, "pos": np.arange(len(flat)), "token": flat}))
                got = dict(db.execute(_DECODE).fetchall())
                texts = [None if x is None else bytes.fromhex(got.get(i, "")).decode("utf-8", "replace") for i, x in enumerate(lists)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("text", T.StringType())])
    return df.select(F.col(key), F.col(ids)).mapInArrow(run, schema)
