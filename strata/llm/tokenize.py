"""Operator: encoding of a corpus with a public byte-level BPE vocabulary.

Each partition runs the merges as a recursive DuckDB query over token-position rows: a step joins neighbouring tokens
with the merge table, contracts every word's leftmost pair of least rank, and ends when no word has a pair left. Further
places of the same pair are contracted in the same step, from left to right, up to the first where the new token makes a pair
of lower rank, which would come first; so a word of any length takes no more steps than it has different pairs, and the
result is that of one pair a step. The query keeps one row for each position (its key), not one for each step.

Words are encoded once and remembered; texts are put together from their words' ids in order. Decoding joins positions with
the vocabulary and aggregates the bytes in order, in DuckDB too.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word pattern of the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A vocabulary file may have this many bytes to be broadcast.
MOST_BYTES = 16 << 20
#: Words remembered in a worker, and words and bytes of one query.
MEMO, CHUNK, CHUNK_BYTES = 300_000, 20_000, 400_000

STEPS = """
WITH RECURSIVE step(wid, pos, tok) USING KEY (wid, pos) AS (
  SELECT wid, pos, tok FROM letters
  UNION
  (WITH near AS (SELECT wid, pos, tok, lead(tok) OVER w AS nxt, lead(pos) OVER w AS npos, lag(tok) OVER w AS prv, lag(pos) OVER w AS ppos, lead(tok, 2) OVER w AS nxt2
                 FROM recurring.step WHERE tok IS NOT NULL AND wid IN (SELECT wid FROM step) WINDOW w AS (PARTITION BY wid ORDER BY pos)),
   pair AS (SELECT near.*, m.rank FROM near JOIN merges m ON m.a = tok AND m.b = nxt),
   hit AS (SELECT pair.* FROM pair JOIN (SELECT wid, min(rank) AS least FROM pair GROUP BY wid) USING (wid) WHERE rank = least),
   chain AS (SELECT *, sum(CASE WHEN before = pos THEN 0 ELSE 1 END) OVER w AS island FROM (SELECT *, lag(npos) OVER (PARTITION BY wid ORDER BY pos) AS before FROM hit) WINDOW w AS (PARTITION BY wid ORDER BY pos)),
   odd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY wid, island ORDER BY pos) AS k FROM chain) WHERE k % 2 = 1),
   made AS (SELECT *, CASE WHEN lag(npos) OVER w = ppos THEN rank ELSE prv END AS l FROM odd WINDOW w AS (PARTITION BY wid ORDER BY pos)),
   seen AS (SELECT made.wid, made.pos, npos, made.rank, (x.rank < made.rank OR y.rank < made.rank) IS TRUE AS stops FROM made LEFT JOIN merges x ON x.a = l AND x.b = made.rank LEFT JOIN merges y ON y.a = made.rank AND y.b = nxt2),
   done AS (SELECT * FROM (SELECT *, sum(stops::INT) OVER (PARTITION BY wid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stopped FROM seen) WHERE coalesce(stopped, 0) = 0)
   SELECT wid, pos, rank FROM done UNION ALL SELECT wid, npos, NULL FROM done)
)
SELECT wid, list(tok ORDER BY pos) AS ids FROM step WHERE tok IS NOT NULL GROUP BY wid
"""

DECODED = """
SELECT t.row, string_agg(hex(v.bytes), '' ORDER BY t.pos) AS bytes FROM ids t JOIN vocabulary v ON v.id = t.id GROUP BY t.row
"""


def load_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Encoder:
    """Vocabulary, memo of words and DuckDB connection of one worker."""

    def __init__(self, data: bytes):
        import duckdb
        import regex

        self.ranks = load_ranks(data)
        self.split = regex.compile(PATTERN)
        self.memo: dict[str, list[int]] = {}
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        a, b, r = [], [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    a.append(left)
                    b.append(right)
                    r.append(rank)
        pairs = pa.table({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "rank": pa.array(r, pa.int32())})
        self.con.register("pairs", pairs)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM pairs")
        self.con.unregister("pairs")
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)

    def learn(self, words: list[str]) -> None:
        """Encode new words into the memo."""
        rest = []
        for w in words:
            raw = w.encode("utf-8", "replace")
            if (whole := self.ranks.get(raw)) is not None:
                self.memo[w] = [whole]
            else:
                rest.append((w, raw))
        # words of like length take like many steps
        rest.sort(key=lambda x: len(x[1]))
        part: list[tuple[str, bytes]] = []
        size = 0
        for k, x in enumerate(rest):
            part.append(x)
            size += len(x[1])
            if len(part) == CHUNK or size >= CHUNK_BYTES or k == len(rest) - 1:
                self._merge(part)
                part, size = [], 0

    def _merge(self, part: list[tuple[str, bytes]]) -> None:
        lens = np.array([len(raw) for _, raw in part])
        flat = np.frombuffer(b"".join(raw for _, raw in part), np.uint8)
        wid = np.repeat(np.arange(len(part), dtype=np.int32), lens)
        pos = (np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)).astype(np.int32)
        self.con.register("letters", pa.table({"wid": wid, "pos": pos, "tok": self.byte[flat]}))
        for i, ids in self.con.execute(STEPS).fetchall():
            self.memo[part[i][0]] = ids
        self.con.unregister("letters")

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        words = [self.split.findall(t) if t else [] for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        self.learn(list({w: None for ws in words for w in ws if w not in memo}))
        out = []
        for ws in words:
            ids: list[int] = []
            for w in ws:
                ids += memo[w]
            out.append(ids)
        return out


_encoders: dict[int, Encoder] = {}


def _encoder(shared: Broadcast) -> Encoder:
    """One encoder for each vocabulary and worker process; the memo lives on from task to task."""
    data = shared.value
    key = hash(data)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(data)
    return _encoders[key]


def share_vocabulary(spark: SparkSession, path: str = VOCABULARY) -> Broadcast:
    """The vocabulary file as a broadcast: executors need no copy of their own. Its size is checked."""
    if os.path.getsize(path) > MOST_BYTES:
        raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_texts(docs: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) for each row of docs: the ids of its text, no special tokens; their spellings are ordinary text.

    Null and empty texts give the empty list, blank texts are encoded as they are. Repeated rows stay. No shuffle: a map
    over the rows where they lie, with memory bound by the word memo, one Arrow batch and the longest word.
    """
    shared = share_vocabulary(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared)
        for b in batches:
            for at in range(0, b.num_rows, 1_000):
                part = b.slice(at, 1_000)
                ids = enc.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {kind}, ids array<int>")


def decode_ids(rows: DataFrame, key: str, ids: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text) of each row's ids: bytes are aggregated in the order of their positions and read as UTF-8, bad bytes
    as U+FFFD. Null ids give null."""
    shared = share_vocabulary(rows.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        ranks = load_ranks(shared.value)
        con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        con.register("known", pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "bytes": pa.array(list(ranks), pa.binary())}))
        con.execute("CREATE TABLE vocabulary AS SELECT * FROM known")
        for b in batches:
            for at in range(0, b.num_rows, 1_000):
                part = b.slice(at, 1_000)
                ids = part.column(1)
                lens = np.array([len(x) if x is not None else 0 for x in ids.to_pylist()])
                row = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
                pos = (np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)).astype(np.int32)
                con.register("ids", pa.table({"row": row, "pos": pos, "id": ids.flatten()}))
                texts = [None if x is None else "" for x in ids.to_pylist()]
                for i, raw in con.execute(DECODED).fetchall():
                    texts[i] = bytes.fromhex(raw).decode("utf-8", "replace")
                con.unregister("ids")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = dict(rows.dtypes)[key]
    return rows.select(F.col(key), F.col(ids).cast("array<int>")).mapInArrow(run, f"{key} {kind}, text string")


def token_counts(encoded: DataFrame) -> DataFrame:
    """(token_id, n) over all ids; counted map-side first, so a frequent token is no hot key."""
    return encoded.select(F.explode("ids").alias("t")).select(F.col("t").cast("long").alias("token_id")).groupBy("token_id").agg(F.count(F.lit(1)).alias("n"))
