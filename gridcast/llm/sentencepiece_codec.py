"""SentencePiece encoding and decoding from a model's piece table.

The text is escaped (blanks become U+2581, one is put in front) and cut into words where no piece
can reach across: before a U+2581 that follows another character, and around line ends. Words are
counted over the whole corpus; the most frequent ones, at most ``HEAD`` of them, go through the
relational lattice: explode the substrings of bounded length, equi-join them to the piece table,
group the edges by word, fold them with a higher-order aggregate. The fold depends on the model:

* unigram: Viterbi, the path of greatest total score;
* BPE: merges. A BPE model's scores are merge ranks, and the path of greatest total is not what
  its encoder gives; the fold takes the lattice's edges in score order and unites the two
  neighbours under the best one until none applies, which is the encoder's result exactly.

Words outside the dictionary (rare, or longer than a 63-bit set of bounds) are folded the same way
in the task that reads them, many short ones at once, so that no text is shuffled. Characters without a piece become byte
pieces. Decoding joins the pieces' bytes.
"""

import heapq
import itertools
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.llm.common import CHUNK_BYTES, local, map_rows, written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
WORD = re.compile("\n|▁*[^▁\n]+|▁+")
HEAD = 300_000
LONGEST = 60          # characters of a word in the relational lattice
UNKNOWN = 10.0        # an unknown character scores this much below the least piece


@dataclass
class Pieces:
    """Piece table: text and score by id, ids of the byte pieces, unknown id, and the kind."""

    text: list
    score: list
    normal: list
    byte0: int
    unknown: int
    kind: str = "bpe"

    @property
    def longest(self) -> int:
        return max((len(t) for t, ok in zip(self.text, self.normal, strict=True) if ok), default=1)


def load_pieces(model_file: str = MODEL, kind: str = "bpe") -> Pieces:
    """Piece table of a SentencePiece model file, read on the driver. The model must keep line
    ends apart and blanks in front (checked), as byte-fallback models of this kind do."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(m.get_piece_size())
    text = [m.id_to_piece(i) for i in ids]
    normal = [not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)) for i in ids]
    byte0 = text.index("<0x00>") if "<0x00>" in text else -1
    if byte0 >= 0 and text[byte0:byte0 + 256] != [f"<0x{b:02X}>" for b in range(256)]:
        raise ValueError("byte pieces are not in order")
    if any(ok and ("\n" in t or BLANK in t.lstrip(BLANK)) for t, ok in zip(text, normal, strict=True)):
        raise ValueError("a piece reaches across a word's bounds")
    return Pieces(text, [m.get_score(i) for i in ids], normal, byte0, m.unk_id(), kind)


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    if text[0] == " " or "  " in text or BLANK in text:
        return WORD.findall(BLANK + text.replace(" ", BLANK))
    # single blanks: every word ends before the next blank or line end
    return list(filter(None, (BLANK + text.replace(" ", " " + BLANK).replace("\n", " \n ")).split(" ")))


# --- the fold in the relational lattice -----------------------------------------------------------

def _bits(lo: Column, hi: Column) -> Column:
    """Bits lo..hi-1."""
    one = F.lit(1).cast("long")
    return F.call_function("shiftleft", one, hi.cast("int")) - F.call_function("shiftleft", one, lo.cast("int"))


def _lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, n, edges): each word's substrings that are pieces, as (order, s, e, id, score)."""
    ids = [i for i, ok in enumerate(pieces.normal) if ok]
    rank = {i: r for r, i in enumerate(sorted(ids, key=lambda i: (-pieces.score[i], i)))}
    table = words.sparkSession.createDataFrame(
        pd.DataFrame({"piece": [pieces.text[i] for i in ids], "id": ids, "rank": [rank[i] for i in ids],
                      "score": [float(pieces.score[i]) for i in ids]}),
        "piece string, id int, rank int, score double")
    cut = (words.select("word", F.length("word").alias("n"))
           .withColumn("s", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
           .withColumn("e", F.explode(F.sequence(F.col("s") + 1, F.least(F.col("n"), F.col("s") + pieces.longest))))
           .withColumn("piece", F.substring(F.col("word"), F.col("s") + 1, F.col("e") - F.col("s"))))
    hit = cut.join(F.broadcast(table), "piece", "left").filter("id is not null or e = n")  # one row stays
    edge = F.when(F.col("id").isNotNull(), F.struct("rank", "s", "e", "id", "score"))
    return hit.groupBy("word", "n").agg(F.array_sort(F.collect_list(edge)).alias("edges"))


def _marked(edges: Column) -> Column:
    """Edges of two characters and more as bit sets: their ends, and the bounds between them."""
    return F.transform(F.filter(edges, lambda x: x["e"] - x["s"] > 1), lambda x: F.struct(
        (_bits(x["s"], x["s"] + 1) + _bits(x["e"], x["e"] + 1)).alias("ends"), _bits(x["s"] + 1, x["e"]).alias("inner")))


def _merged_bounds(n: Column, marked: Column) -> Column:
    """Bit set of the bounds left after all merges in order of score, leftmost first."""
    def merge(state, _):
        fits = F.filter(marked, lambda x: (state.bitwiseAND(x["ends"]) == x["ends"])
                        & (F.bit_count(state.bitwiseAND(x["inner"])) == 1))
        best = F.get(fits, F.lit(0))
        return F.when(best.isNull(), state).otherwise(state.bitwiseAND(F.bitwise_not(best["inner"])))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), _bits(F.lit(0), n + 1), merge)


def _viterbi_bounds(n: Column, edges: Column, floor: float) -> Column:
    """Bit set of the bounds of the path of greatest total score; an unknown character is an edge
    of score ``floor``; ties go to the longer last piece."""
    start = F.array(F.struct(F.lit(0.0).alias("v"), _bits(F.lit(0), F.lit(1)).alias("b")))

    def at(best, e):
        ways = F.transform(F.filter(edges, lambda x: x["e"] == e), lambda x: F.struct(
            (F.get(best, x["s"])["v"] + x["score"]).alias("v"), F.get(best, x["s"])["b"].alias("b")))
        last = F.get(best, e - 1)
        plain = F.when(F.exists(edges, lambda x: (x["e"] == e) & (x["s"] == e - 1)),
                       F.lit(float("-inf"))).otherwise(last["v"] + floor)
        top = F.array_max(F.concat(ways, F.array(F.struct(plain.alias("v"), last["b"].alias("b")))))
        return F.concat(best, F.array(F.struct(top["v"].alias("v"), (top["b"] + _bits(e, e + 1)).alias("b"))))

    return F.aggregate(F.sequence(F.lit(1), n), start, at, lambda best: F.get(best, n)["b"])


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, ids) for distinct words (column word) of 1 to LONGEST characters."""
    lattice = _lattice(words.select("word").filter(F.length("word").between(1, LONGEST)), pieces)
    if pieces.kind == "bpe":
        lattice = lattice.withColumn("marked", _marked(F.col("edges")))
        bounds = _merged_bounds(F.col("n"), F.col("marked"))
    else:
        low = min((s for s, ok in zip(pieces.score, pieces.normal, strict=True) if ok), default=0.0)
        bounds = _viterbi_bounds(F.col("n"), F.col("edges"), low - UNKNOWN)
    cuts = F.filter(F.sequence(F.lit(0), F.col("n")),
                    lambda i: F.col("bounds").bitwiseAND(_bits(i, i + 1)) != 0)
    found = lattice.withColumn("bounds", bounds).withColumn("cuts", cuts)

    def ids_of(s, e):
        known = F.get(F.filter("edges", lambda x: (x["s"] == s) & (x["e"] == e)), F.lit(0))["id"]
        raw = F.hex(F.substring(F.col("word"), s + 1, e - s).cast("binary"))
        one = F.transform(F.sequence(F.lit(0), (F.length(raw) / 2 - 1).cast("int")), lambda i: (F.conv(
            F.substring(raw, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("int") + pieces.byte0))
        return F.when(known.isNotNull(), F.array(known)).otherwise(
            one if pieces.byte0 >= 0 else F.array(F.lit(pieces.unknown)))

    parts = F.zip_with(F.slice("cuts", F.lit(1), F.size("cuts") - 1), F.slice("cuts", F.lit(2), F.size("cuts") - 1), ids_of)
    return found.select("word", F.flatten(parts).alias("ids"))


# --- the same fold inside a task -------------------------------------------------------------------

def _merged(word: str, rank: dict) -> list[str]:
    """Parts of a word after all merges in order of score, leftmost first (a heap over a linked list)."""
    parts, n = list(word), len(word)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(rank[w], i, w) for i in range(n - 1) if (w := parts[i] + parts[i + 1]) in rank]
    heapq.heapify(heap)
    while heap:
        _, i, w = heapq.heappop(heap)
        j = right[i] if parts[i] is not None else n
        if j >= n or parts[i] + parts[j] != w:
            continue
        parts[i], parts[j], right[i] = w, None, right[j]
        if right[j] < n:
            left[right[j]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b < n and (w := parts[a] + parts[b]) in rank:
                heapq.heappush(heap, (rank[w], a, w))
    return [p for p in parts if p is not None]


def fold_word(word: str, rank: dict, ids: dict, byte0: int, unknown: int) -> list[int]:
    """Ids of one word by merges in order of score, leftmost first."""
    out = []
    for p in _merged(word, rank):
        known = ids.get(p)
        if known is not None:
            out.append(known)
        elif byte0 >= 0:
            out.extend(byte0 + b for b in p.encode())
        else:
            out.append(unknown)
    return out


class Merges:
    """Merges of many short words at once. A symbol is a piece's rank, or a larger number for a
    character without a piece; the pairs of symbols that merge are in an open hash table."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, rank: dict, ids: dict):
        self.symbols = dict(rank)
        pairs = []
        for w in rank:
            for i in range(1, len(w)):
                for side in (w[:i], w[i:]):
                    if len(side) == 1:
                        self.symbols.setdefault(side, len(self.symbols))
                if w[:i] in self.symbols and w[i:] in self.symbols:
                    pairs.append((self.symbols[w[:i]], self.symbols[w[i:]], rank[w]))
        self.pieces, self.width = len(rank), len(self.symbols) + 1               # the last symbol merges with none
        self.id = np.array([ids[w] for w in rank], np.int32)[np.argsort(np.fromiter(rank.values(), np.int64, len(rank)))]
        chars = {ord(c): x for c, x in self.symbols.items() if len(c) == 1}
        self.char = np.full(max(chars, default=0) + 2, self.width - 1, np.int32)
        self.char[list(chars)] = list(chars.values())
        left, right, made = np.array(pairs, np.int64).reshape(-1, 3).T
        self.bits = max(10, int(len(pairs)).bit_length() + 2)
        self.key, self.made = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.NONE)
        key, rest = left * self.width + right, np.arange(len(left))
        at = self._slot(key)
        while len(rest):
            free = rest[self.key[at[rest]] < 0]
            put = free[np.unique(at[free], return_index=True)[1]]
            self.key[at[put]], self.made[at[put]] = key[put], made[put]
            rest = rest[self.key[at[rest]] != key[rest]]
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the piece that two symbols make, NONE if there is none."""
        key = left.astype(np.int64) * self.width + right
        at = self._slot(key)
        there = self.key[at]
        out = np.where(there == key, self.made[at], self.NONE)
        rest = np.flatnonzero((there != key) & (there >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
            there = self.key[at[rest]]
            out[rest] = np.where(there == key[rest], self.made[at[rest]], self.NONE)
            rest = rest[(there != key[rest]) & (there >= 0)]
        return out

    def fold(self, words: list[str]) -> Iterator[bytes | None]:
        """Ids of each word by merges in order of score, leftmost first; None if a character is left
        that has no piece. Every word has a row of cells between two empty ones."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        wide = int(size.max(initial=0)) + 2
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        inner = (np.arange(wide) >= 1) & (np.arange(wide) <= size[:, None])
        symbol = np.full(inner.shape, self.width - 1, np.int32)
        symbol[inner] = self.char[np.minimum(code, len(self.char) - 1)]
        rank = np.full(inner.shape, self.NONE)
        both = inner[:, :-1] & inner[:, 1:]
        rank[:, :-1][both] = self._pair(symbol[:, :-1][both], symbol[:, 1:][both])
        after = np.arange(inner.size) + 1
        before = after - 2
        alive, cells, ranks = inner.ravel().copy(), symbol.reshape(-1), rank.reshape(-1)
        rows = np.arange(len(words))
        while len(rows):
            at = rows * wide + rank[rows].argmin(1)
            best = ranks[at]
            some = best < self.NONE
            rows, at, best = rows[some], at[some], best[some]
            gone = after[at]
            last, first = after[gone], before[at]
            cells[at], alive[gone], ranks[gone] = best, False, self.NONE
            after[at], before[last] = last, at
            ranks[at], ranks[first] = self._pair(best, cells[last]), self._pair(cells[first], best)
        left = alive.reshape(inner.shape)
        known = (symbol < self.pieces) | ~left
        out = self.id[np.minimum(cells[alive], self.pieces - 1)].tobytes()
        ends = np.concatenate([[0], 4 * np.cumsum(left.sum(1))]).tolist()
        return (out[a:b] if ok else None for (a, b), ok in zip(itertools.pairwise(ends), known.all(1).tolist(), strict=True))


def viterbi_word(word: str, score: dict, ids: dict, byte0: int, unknown: int, longest: int, floor: float) -> list[int]:
    """Ids of one word by the path of greatest total score."""
    best = [(0.0, 0)]
    for e in range(1, len(word) + 1):
        ways = [(best[s][0] + score[word[s:e]], s) for s in range(max(0, e - longest), e) if word[s:e] in score]
        if word[e - 1] not in score:
            ways.append((best[e - 1][0] + floor, e - 1))
        top = max(v for v, _ in ways)
        best.append(min((w for w in ways if w[0] == top), key=lambda w: w[1]))
    cut, e = [], len(word)
    while e:
        cut.append(word[best[e][1]:e])
        e = best[e][1]
    return [i for p in reversed(cut) for i in
            ([ids[p]] if p in ids else [byte0 + b for b in p.encode()] if byte0 >= 0 else [unknown])]


class _Count:
    """Word counts of a task, handed on whenever they fill up."""

    def __init__(self):
        self.counts = Counter()

    def __call__(self, rows: pd.DataFrame):
        for t in rows["text"]:
            self.counts.update(words_of(t.decode()))
        return self.end() if len(self.counts) > 400_000 else None

    def end(self):
        out = pd.DataFrame({"word": list(self.counts), "c": list(self.counts.values())})
        self.counts = Counter()
        return out


def frequent_words(docs: DataFrame, text: str = "text", head: int = HEAD) -> DataFrame:
    """(word) for the words of the corpus from the least count down to which there are at most
    ``head``; counts are over all documents."""
    _Count.stateful = True
    counts = written(map_rows(docs.select(F.col(text).alias("text")), _Count, "word string, c long")
                     .groupBy("word").agg(F.sum("c").alias("c")).filter((F.col("c") > 1)
                                                                       & (F.length("word") <= LONGEST)), "words")
    steps = counts.select(F.least("c", F.lit(10_000)).alias("c")).groupBy("c").count().orderBy(F.desc("c")).collect()
    least, total = 10_001, 0
    for r in steps:
        total += r["count"]
        if total > head:
            break
        least = r["c"]
    return counts.filter(F.col("c") >= least).select("word")


def _byte_table(p: dict) -> list[bytes]:
    """Bytes of each piece; control pieces have none."""
    byte0 = p["byte0"]
    return [t.replace(BLANK, " ").encode() if ok else bytes([i - byte0]) if 0 <= byte0 <= i < byte0 + 256 else b""
            for i, (t, ok) in enumerate(zip(p["text"], p["normal"], strict=True))]


def _join(table: list[bytes], ids) -> str:
    return b"".join([table[i] for i in ids]).decode("utf-8", "replace").removeprefix(" ")


def _joined(table: pa.Array, ids: pa.ListArray) -> list[str]:
    """The texts of many lists of valid ids."""
    parts = pa.ListArray.from_arrays(ids.offsets, table.take(ids.values))
    return [t.decode("utf-8", "replace").removeprefix(" ") for t in pc.binary_join(parts, b"").to_pylist()]


def _slices(batch: pa.RecordBatch, text: str, rows: int = 64) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and, but for a single row, about CHUNK_BYTES of text."""
    start = total = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()):
        if i - start == rows or (i > start and total + n > CHUNK_BYTES):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _add(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(batch.columns + list(columns.values()), batch.schema.names + list(columns))


def encode(docs: DataFrame, pieces: Pieces, text: str = "text", out: str = "ids", head: int = HEAD,
           decoded: str | None = None) -> DataFrame:
    """``docs`` with ``out``: the ids of each whole text, and with ``decoded`` the text decoded from
    them in the same pass. Null and empty texts have no ids; repeated rows are encoded each; extra
    columns pass through (those named like the new ones are replaced)."""
    known = local(encode_words(frequent_words(docs, text, head), pieces))     # at most head rows
    entries = {w: np.asarray(i, np.int32).tobytes() for w, i in zip(known["word"], known["ids"], strict=True)}
    normal = [i for i, ok in enumerate(pieces.normal) if ok]
    ids = {pieces.text[i]: i for i in normal}
    value = {pieces.text[i]: pieces.score[i] for i in normal}
    rank = {w: r for r, w in enumerate(sorted(value, key=lambda w: (-value[w], ids[w])))}
    merges = Merges(rank, ids) if pieces.kind == "bpe" and rank else None
    held = docs.sparkSession.sparkContext.broadcast((entries, vars(pieces), ids, value, rank, merges))
    base = docs.drop(out, *([decoded] if decoded else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, p, ids, value, rank, merges = held.value
        longest, low = max(map(len, ids), default=1), min(value.values(), default=0.0) - UNKNOWN
        table = pa.array(_byte_table(p) if decoded else [], pa.binary())
        coded_words = dict(entries)

        def fold(w: str) -> bytes:
            return array("i", fold_word(w, rank, ids, p["byte0"], p["unknown"]) if p["kind"] == "bpe" else
                         viterbi_word(w, value, ids, p["byte0"], p["unknown"], longest, low)).tobytes()

        def learn(words: set[str]) -> None:
            """Codes of new words, short ones in blocks of about equal length."""
            short = sorted((w for w in words if len(w) <= LONGEST), key=len) if merges else []
            for a in range(0, len(short), 2048):
                block = short[a:a + 2048]
                coded_words.update(zip(block, (fold(w) if c is None else c for w, c in
                                               zip(block, merges.fold(block), strict=True)), strict=True))
            for w in words.difference(coded_words):
                coded_words[w] = fold(w)

        for batch in batches:
            for rows in _slices(batch, text):
                if len(coded_words) > len(entries) + 50_000:
                    coded_words.clear()
                    coded_words.update(entries)
                cut = [words_of(t) for t in rows.column(text).to_pylist()]
                learn(set().union(*cut).difference(coded_words))
                coded = [b"".join(map(coded_words.__getitem__, words)) for words in cut]
                ends = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int32)
                new = {out: pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), np.int32)))}
                if decoded:
                    new[decoded] = pa.array(_joined(table, new[out]), pa.string())
                yield _add(rows, **new)

    schema = T.StructType([*base.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType())),
                           *([T.StructField(decoded, T.StringType())] if decoded else [])])
    return base.mapInArrow(run, schema)


def decode(coded: DataFrame, pieces: Pieces, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``coded`` with ``out``: the text of each list of ids (null and empty lists give ''). Control
    pieces vanish, the blank in front goes, broken UTF-8 becomes U+FFFD; ids outside the table raise."""
    held = coded.sparkSession.sparkContext.broadcast(vars(pieces))

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = _byte_table(held.value)
        for lists in batches:
            yield pd.Series(["" if x is None else _join(table, x.tolist()) for x in lists], dtype=object)

    return coded.withColumn(out, run(F.col(ids)))
