"""Token counts of whole texts: Arrow functions that encode batches and return lengths only.

The tokenizer is a file (``.json``: tokenizers, ``.model``: sentencepiece), read on the driver and
sent to the tasks once. A task gathers texts into batches of about ``BATCH`` characters, so that its
memory does not depend on how many rows Arrow hands over, and encodes a batch at a time. A longer
text is split first, where no token reaches across: with a byte-level vocabulary that cuts words by
its usual pattern, a blank or line end after another character always begins a word, whatever
stands left of it. For the same reason such a vocabulary's library encodes a batch's different words
only, each once, and a task keeps what it said of them. Other tokenizers get each text whole.

Null texts count as empty: 0 tokens. Broken UTF-8 is read with U+FFFD in place of the broken bytes.
No begin, end or added special token is counted; special strings inside a text are what the library
makes of them by default. Repeated rows are counted each, an empty table gives no rows.
"""

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"
BATCH = 1 << 18
KNOWN = 1 << 22        # characters of the words whose lengths a task keeps; then it starts anew
#: Before a blank or line end that follows a sign or letter, and before a stop behind a letter of
#: scripts without blanks.
EDGE = re.compile("(?<=[!-~]|[^\\W_])(?=[ \\t\\n\\r])|(?<=[ぁ-ゖァ-ヺ一-龥])(?=[。，、！？；：])")


def tokenizer_file(path: str = TOKENIZER) -> tuple[str, bytes]:
    """(kind, content) of a tokenizer file; a bare name is looked up among the public tokenizers."""
    if os.path.basename(path) == path:
        import public_tokenizers
        path = public_tokenizers.path(path)
    kind = os.path.splitext(path)[1]
    if kind not in (".json", ".model"):
        raise ValueError(f"no library for {path}")
    with open(path, "rb") as f:
        return kind, f.read()


def can_split(kind: str, raw: bytes) -> bool:
    """Whether texts may be split at ``EDGE``: a byte-level pattern without normaliser or blank put
    in front, and no added token that takes blanks with it."""
    if kind != ".json":
        return False
    spec = json.loads(raw)
    cut = spec.get("pre_tokenizer") or {}
    return (cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
            and spec.get("normalizer") is None and not spec["model"].get("dropout")
            and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] or re.search(r"\s", a["content"])
                        for a in spec.get("added_tokens", [])))


def split_text(text: str, limit: int) -> list[str]:
    """``text`` in pieces that each end at the first safe boundary after ``limit`` characters."""
    out, at = [], 0
    while len(text) - at > limit and (m := EDGE.search(text, at + limit)):
        out.append(text[at:m.start()])
        at = m.start()
    return [*out, text[at:]]


def words_of(text: str) -> list[str]:
    """``text`` cut before the blanks that ``EDGE`` allows."""
    out, held = [], ""
    for i, part in enumerate(text.split(" ")):
        if not i:
            held = part
        elif held and ("!" <= held[-1] <= "~" or held[-1].isalnum()):
            out.append(held)
            held = " " + part
        else:
            held += " " + part
    return [*out, held]


def by_word(lengths, most: int = KNOWN):
    """A function from texts to their numbers of tokens, that asks ``lengths`` for each word once."""
    known: dict[str, int] = {}
    size = 0

    def count(texts: list[str]) -> list[int]:
        nonlocal size
        cut = [words_of(t) for t in texts]
        new = list({w for words in cut for w in words if w not in known})
        if size > most:
            known.clear()
            size, new = 0, list({w for words in cut for w in words})
        known.update(zip(new, lengths(new), strict=True))
        size += sum(map(len, new))
        return [sum(map(known.__getitem__, words)) for words in cut]

    return count


def encoder(kind: str, raw: bytes):
    """A function from a list of texts to their numbers of tokens, on one core."""
    if kind == ".json":
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tok = Tokenizer.from_buffer(raw)
        tok.no_truncation()
        tok.no_padding()
        return lambda texts: [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_proto=raw)
    return lambda texts: [len(x) for x in model.encode(texts, num_threads=1, add_bos=False, add_eos=False)]


def batches_of(pieces: Iterator[tuple[int, str]], limit: int) -> Iterator[list[tuple[int, str]]]:
    """(row, piece) pairs in lists of about ``limit`` characters, at least one pair each."""
    held, size = [], 0
    for row, piece in pieces:
        held.append((row, piece))
        size += len(piece)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def n_tokens(docs: DataFrame, text: str = "text", path: str = TOKENIZER, batch: int = BATCH) -> Column:
    """Column with the number of tokens of each whole ``text`` of ``docs``."""
    kind, raw = tokenizer_file(path)
    split = can_split(kind, raw)
    sent = docs.sparkSession.sparkContext.broadcast(raw)

    def count(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lengths = by_word(encoder(kind, sent.value)) if split else encoder(kind, sent.value)
        for column in columns:
            total = [0] * len(column)
            rows = ((i, (v.as_py() or b"").decode("utf-8", "replace")) for i, v in enumerate(column))
            pieces = ((i, p) for i, t in rows if t for p in (split_text(t, batch) if split else [t]))
            for group in batches_of(pieces, batch):
                for (i, _), n in zip(group, lengths([p for _, p in group]), strict=True):
                    total[i] += n
            yield pa.array(total, pa.int64())

    count.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(count, "bigint")(F.col(text).cast("binary"))


def token_counts(docs: DataFrame, text: str = "text", path: str = TOKENIZER, limit: int = 1024,
                 batch: int = BATCH) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8 length of the text), ``n_tokens`` and ``over_limit``
    (more than ``limit`` tokens); columns of these names are replaced."""
    base = docs.drop(*[c for c in ("n_bytes", "n_tokens", "over_limit") if c != text])
    tokens = base.withColumn("__n", n_tokens(base, text, path, batch)).withColumn(
        "__b", F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long"))
    return tokens.select(*base.columns, F.col("__b").alias("n_bytes"), F.col("__n").alias("n_tokens"),
                         (F.col("__n") > limit).alias("over_limit"))
