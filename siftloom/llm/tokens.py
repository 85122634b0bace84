"""Problem 7: encoding of the whole corpus with a public byte-level BPE tokenizer.

Method: DuckDB recursive queries per partition. The distinct words of a batch that are not known yet become token-position
rows; each step of the recursion joins neighbouring tokens with the merge table, takes each word's pair of the lowest rank
and contracts it, until no word has a pair left; an ordered aggregation gives the ids of each word, and a gather those of
each text. A word is a row with its list of ids; each step unfolds the lists into token-position rows. Short words contract their leftmost pair in a step. Long ones contract every pair of the lowest rank at once,
from the left and without overlap, which is the same order of merges in fewer steps: a pair with a merged token ranks
after the merge that made the token.

A word that is itself a token needs no steps: its last merge joins the two parts that the earlier merges leave, which is
checked for every token when the merge table is derived from the ranks.

Splitting into words follows the published pattern of the vocabulary, as array operations over code points:
contractions, then letters, numbers or other marks with one space before them, then white space up to the last blank.

Defined cases: null and empty texts have no ids (an empty list); a text that spells a special token is ordinary text;
every row has one answer, repeated ones too; extra columns are ignored. Texts of any length are taken whole; beyond
PIECE bytes they are split at line ends that are token borders anyway.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary files are; only the driver reads them.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PIECE = 4 << 20
SHORT = 256
CHUNK = 50_000
#: Words a worker remembers between batches.
KNOWN = 400_000

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Code points with the property White_Space.
BLANKS = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_CLASSES: np.ndarray | None = None


def _classes() -> np.ndarray:
    global _CLASSES
    if _CLASSES is None:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        table[BLANKS] = SPACE
        _CLASSES = table
    return _CLASSES


def word_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Positions at which words start, for code points of several texts one after another; text_starts are positions too."""
    n = len(points)
    kind = _classes()[points]
    first = np.zeros(n, bool)
    first[text_starts[text_starts < n]] = True
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    # The last blank before a word goes with the word if it is a space, and else stands alone.
    after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~first[1:]) + 1
    start[after - 1] = True
    start[after[points[after - 1] == 32]] = False
    # Contractions, where an apostrophe starts a word.
    marks = np.flatnonzero((points == 39) & start)
    marks = marks[marks + 1 < n]
    marks = marks[~first[marks + 1]]
    if len(marks):
        one = points[marks + 1]
        inside = marks + 2 < n
        two = np.where(inside, points[np.minimum(marks + 2, n - 1)], 0)
        two[inside & first[np.minimum(marks + 2, n - 1)]] = 0
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        single = np.isin(one, [ord(c) for c in "stmd"])
        start[marks[single | pair] + 1] = False
        for found, size in ((marks[single], 2), (marks[pair], 3)):
            end = found + size
            start[end[end < n]] = True
    return np.flatnonzero(start)


def split_words(data: bytes, text_starts: np.ndarray) -> np.ndarray:
    """Byte offsets at which words start, for UTF-8 texts one after another; text_starts are byte offsets."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.int64)
    if raw.max() < 128:
        return word_starts(raw, text_starts)
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    return lead[word_starts(points, np.searchsorted(lead, text_starts))]


def merge_table(ranks: dict[bytes, int]) -> np.ndarray:
    """(left, right, merged) for every token of two bytes or more: what the merges of lower rank leave of its bytes."""
    out = []
    for token, rank in ranks.items():
        if len(token) > 1:
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                best, at = min((ranks.get(x + y, rank), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
                if best >= rank:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) != 2:
                raise ValueError(f"token {rank} has no merge")
            out.append((ranks[parts[0]], ranks[parts[1]], rank))
    return np.array(out, np.int32).reshape(-1, 3)


class Vocabulary:
    """What the workers need: the tokens in order of rank, and the merge table. Fixed in size by the vocabulary file."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = list(ranks.items())
        self.merges = merge_table(ranks)


#: One contraction a word and step: the leftmost of the pairs with the lowest rank. A word is a row; each step unfolds it
#: into rows of neighbouring tokens by position, so that no step has to sort.
LEFTMOST = """
WITH RECURSIVE step(w, ids, live) AS (
  SELECT w, ids, true FROM words
  UNION ALL
  SELECT s.w, CASE WHEN b.k IS NULL THEN s.ids
              ELSE s.ids[:(b.k & 4294967295) - 1] || [(b.k >> 32)::INTEGER] || s.ids[(b.k & 4294967295) + 2:] END, b.k IS NOT NULL
  FROM step s LEFT JOIN (
    SELECT w, min((m.c::BIGINT << 32) | pos) AS k FROM (
      SELECT w, unnest(ids[:-2]) AS a, unnest(ids[2:]) AS b, unnest(range(1, len(ids))) AS pos FROM step WHERE live) p
    JOIN merges m ON m.ab = (p.a::BIGINT << 20 | p.b) GROUP BY w) b ON s.w = b.w
  WHERE s.live)
SELECT w, ids FROM step WHERE NOT live ORDER BY w
"""
_PAIRS = "SELECT w, pos, id, (id::BIGINT << 20) | lead(id) OVER (PARTITION BY w ORDER BY pos) AS ab FROM step WHERE live"
_RANKED = f"SELECT p.w, p.pos, p.id, m.c, m.c AS k FROM ({_PAIRS}) p LEFT JOIN merges m ON p.ab = m.ab"
#: All pairs with the lowest rank in a step; of neighbouring ones, which overlap, every other from the left.
ALL_AT_ONCE = f"""
WITH RECURSIVE step(w, pos, id, live) AS (
  SELECT w, unnest(range(len(ids))), unnest(ids), true FROM words
  UNION ALL
  SELECT w, pos, CASE WHEN hit THEN c ELSE id END, least IS NOT NULL FROM (
    SELECT *, coalesce(lag(hit) OVER (PARTITION BY w ORDER BY pos), false) AS gone FROM (
      SELECT *, pair AND (i - coalesce(max(CASE WHEN NOT pair THEN i END) OVER (PARTITION BY w ORDER BY pos ROWS UNBOUNDED PRECEDING), 0)) % 2 = 1 AS hit FROM (
        SELECT *, least IS NOT NULL AND coalesce(k = least, false) AS pair, row_number() OVER (PARTITION BY w ORDER BY pos) AS i FROM (
          SELECT *, min(k) OVER (PARTITION BY w) AS least FROM ({_RANKED})))))
  WHERE NOT gone)
SELECT w, list(id ORDER BY pos) AS ids FROM step WHERE NOT live GROUP BY w ORDER BY w
"""


class Encoder:
    """One a worker. Words it knows are kept with their ids; others go through the recursion."""

    def __init__(self, vocabulary: Vocabulary):
        import duckdb

        self.con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        left, right, merged = vocabulary.merges.T
        self.con.register("m", pa.table({"a": left, "b": right, "c": merged}))
        self.con.execute("CREATE TABLE merges AS SELECT (a::BIGINT << 20) | b AS ab, c FROM m")
        self.tokens = vocabulary.tokens
        self.byte_ids = np.zeros(256, np.int32)
        for token, rank in self.tokens:
            if len(token) == 1:
                self.byte_ids[token[0]] = rank
        self.forget()

    def forget(self) -> None:
        self.known = {token: i for i, (token, _) in enumerate(self.tokens)}
        self.flat = [np.array([rank for _, rank in self.tokens], np.int32)]
        self.sizes = [np.ones(len(self.tokens), np.int64)]

    def _contract(self, words: list[bytes], query: str) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(ids, pa.int32()))
        self.con.register("words", pa.table({"w": np.arange(len(words), dtype=np.int32), "ids": lists}))
        found = self.con.sql(query).to_arrow_table().column("ids").combine_chunks()
        self.con.unregister("words")
        flat = found.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        return flat, np.asarray(found.value_lengths()).astype(np.int64)

    def learn(self, words: list[bytes]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > KNOWN + len(self.tokens):
            self.forget()
            new = [w for w in words if w not in self.known]
        for group, query in (([w for w in new if len(w) <= SHORT], LEFTMOST), ([w for w in new if len(w) > SHORT], ALL_AT_ONCE)):
            for i in range(0, len(group), CHUNK):
                part = group[i : i + CHUNK]
                flat, sizes = self._contract(part, query)
                at = len(self.known)
                self.known.update(zip(part, range(at, at + len(part))))
                self.flat.append(flat)
                self.sizes.append(sizes)

    def encode(self, data: bytes, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first id of each text): texts as UTF-8, one after another."""
        starts = split_words(data, text_starts)
        if not len(starts):
            return np.empty(0, np.int32), np.zeros(len(text_starts), np.int64)
        offsets = np.append(starts, len(data)).astype(np.int32)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        self.learn(distinct)
        self.flat, self.sizes = [np.concatenate(self.flat)], [np.concatenate(self.sizes)]
        entry = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[words.indices.to_numpy()]
        sizes = self.sizes[0]
        begin = (np.cumsum(sizes) - sizes)[entry]
        count = sizes[entry]
        ends = np.cumsum(count)
        ids = self.flat[0][np.repeat(begin - (ends - count), count) + np.arange(ends[-1])]
        # A text's first id is that of its first word; the starts of empty texts fall on the next word.
        firsts = np.append(ends - count, ends[-1])[np.searchsorted(starts, text_starts)]
        return ids, firsts


_ENCODER: Encoder | None = None


def _encoder(shipped) -> Encoder:
    global _ENCODER
    if _ENCODER is None:
        _ENCODER = Encoder(shipped.value)
    return _ENCODER


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """(rows, pieces) of PIECE bytes or little more; long texts are cut between a line feed and a character that is no blank."""
    rows: list[int] = []
    held: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        at = 0
        while at < len(t):
            end = at + PIECE
            while 0 < end < len(t):
                end = t.find(b"\n", end) + 1
                if end and end < len(t) and 32 < t[end] < 127:
                    break
            if end <= 0 or end > len(t):
                end = len(t)
            rows.append(i)
            held.append(t[at:end])
            size += end - at
            at = end
            if size >= PIECE:
                yield rows, held
                rows, held, size = [], [], 0
    if rows:
        yield rows, held


def encode_texts(encoder: Encoder, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, number of ids of each)."""
    count = np.zeros(len(texts), np.int64)
    out = []
    for rows, held in _pieces(texts):
        sizes = np.fromiter(map(len, held), np.int64, len(held))
        ids, firsts = encoder.encode(b"".join(held), np.cumsum(sizes) - sizes)
        np.add.at(count, rows, np.diff(np.append(firsts, len(ids))))
        out.append(ids)
    return (np.concatenate(out) if out else np.empty(0, np.int32)), count


def encoded_slices(shipped, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(first column, third column or None, ids, number of ids of each row) for slices of batches with the text second.

    Slices keep memory in proportion to PIECE and not to the rows of a batch."""
    encoder = _encoder(shipped)
    for b in batches:
        ends = np.cumsum(_sizes(b.column(1)))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 2 * PIECE)))
            texts = [x or b"" for x in b.column(1)[at:to].cast(pa.large_binary()).to_pylist()]
            ids, count = encode_texts(encoder, texts)
            yield b.column(0)[at:to], b.column(2)[at:to] if b.num_columns > 2 else None, ids, count
            at = to


def _sizes(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)


def _listed(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, ids, count in encoded_slices(shipped, batches):
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.record_batch([key, lists], names=["doc_id", "ids"])

    return run


def shipped(spark: SparkSession, path: str = VOCABULARY):
    # Fixed in size by the vocabulary (some 2 MB), whatever the corpus.
    return spark.sparkContext.broadcast(Vocabulary(path))


def token_ids(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) for every row."""
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_listed(shipped(documents.sparkSession, vocabulary)), "doc_id long, ids array<int>")


DECODE = """
SELECT w, string_agg(h, '' ORDER BY pos) AS h FROM (
  SELECT i.w, i.pos, t.h FROM (SELECT w, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM listed) i JOIN tokens t USING (id)) GROUP BY w ORDER BY w
"""


def _decoded(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        token, rank = zip(*shipped.value.tokens)
        con.register("t", pa.table({"id": pa.array(rank, pa.int32()), "h": pa.array([x.hex() for x in token])}))
        con.execute("CREATE TABLE tokens AS SELECT * FROM t")
        for b in batches:
            sizes = np.cumsum(pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy().astype(np.int64))
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PIECE // 4)))
                con.register("listed", pa.table({"w": np.arange(at, to), "ids": b.column(1)[at:to]}))
                found = con.sql(DECODE).to_arrow_table()
                texts = [""] * (to - at)
                for w, h in zip(found.column("w").to_pylist(), found.column("h").to_pylist()):
                    texts[w - at] = bytes.fromhex(h).decode("utf-8")
                yield pa.record_batch([b.column(0)[at:to], pa.array(texts, pa.string())], names=["doc_id", "text"])
                at = to

    return run


def decoded(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) back from (doc_id, ids), by an ordered aggregation of the tokens of each row; no ids give an empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(shipped(encoded.sparkSession, vocabulary)), "doc_id long, text string")


def decode(ids: list[int], tokens: dict[int, bytes]) -> str:
    """The text back from its ids."""
    return b"".join(tokens[i] for i in ids).decode("utf-8")
