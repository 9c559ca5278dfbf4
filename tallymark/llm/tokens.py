"""Token counts by a digest cache.

A text's key is the SHA-256 of its normalised UTF-8 bytes under the SHA-256 of the tokenizer's file. Null
is the empty text, and where the tokenizer writes a space as U+2581 and so cannot tell the two apart, that
sign becomes a space; nothing else is rewritten, because it could change a count. Counts lie in a Parquet
table per tokenizer version; a run anti-joins its distinct keys against that table, encodes only those
missing, appends their counts, and joins counts back to documents by key.

Copies meet in the map-side part of the distinct, so one text that a third of all rows share costs a
row a task; the last join carries no texts, and keys of many rows meet a broadcast of their counts.

Defined results: null and empty texts have 0 tokens; repeated rows give a row each; an empty table
gives no rows; extra columns are dropped; strings like ``<s>`` inside a text are plain text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined_widely, scratch, shipped, stored, table

MEMO, MEMO_CHARS = 400_000, 64  #: words whose counts a worker keeps, and how long these may be
MARK = "\u2581"  #: what the tokenizer writes for a space
LIMIT = 4096


class PieceCounter:
    """Counts the pieces of texts as a SentencePiece model gives them.

    Merges never cross a boundary that no piece of the vocabulary crosses. Where every piece has
    the space mark only at its start, a text is therefore the sum of its words (each with the spaces
    before it), and words recur. Models without that property are run on whole texts."""

    _SEGMENT = re.compile(" +[^ ]*")

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        probe = "a  b ▁c\n\td"
        self.memo: dict[str, int] = {}
        self.by_word = not any(re.search("[^▁]▁", p) for p in pieces) and self.model.encode(" a") != self.model.encode("a")
        self.marks = all(self.model.encode(t) == self.model.encode(t.replace(MARK, " ")) for t in (probe, MARK, f"{MARK} x{MARK}{MARK}y {MARK}"))
        self.by_word = self.by_word and self._words(probe.replace(MARK, " ")) == len(self.model.encode(probe))

    def _words(self, text: str) -> int:
        memo, total = self.memo, 0
        for word in self._SEGMENT.findall(" " + text):
            n = memo.get(word)
            if n is None:
                # the model puts one space mark before what it is given
                n = len(self.model.encode(word[1:])) if len(word) > 1 else 1
                if len(word) <= MEMO_CHARS:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[word] = n
            total += n
        return total

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if not self.by_word or MARK in text and not self.marks:
            return len(self.model.encode(text))
        return self._words(text.replace(MARK, " "))


_COUNTERS: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


CACHE = "digest binary, n_tokens long"


def token_counts(docs: DataFrame, model: str, cache: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every row; counts new to the cache are appended to it."""
    spark = shipped(docs.sparkSession)
    with open(model, "rb") as f:
        at = f"{cache.rstrip('/')}/{hashlib.sha256(f.read()).hexdigest()}"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    normal = F.replace(text, F.lit(MARK), F.lit(" ")) if counter(model).marks else text
    keyed = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), normal.alias("text"), F.unhex(F.sha2(normal.cast("binary"), 256)).alias("digest"))
    missing = keyed.select("digest", "text")
    if _exists(spark, at):
        missing = missing.join(spark.read.schema(CACHE).parquet(at), "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([count(t.as_py()) for t in batch.column(1)], pa.int64())], ["digest", "n_tokens"])

    missing.dropDuplicates(["digest"]).mapInArrow(encode, CACHE).write.mode("append").parquet(at)
    # two runs that miss the same text at once both append it; its counts are equal
    counts = spark.read.schema(CACHE).parquet(at).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    rows = stored(keyed.select(id_col, "digest", "n_bytes"), "keys")
    return joined_widely(rows, counts, "digest", F.xxhash64(id_col, "n_bytes")).select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark: SparkSession, sf_dir: str, cache: str | None = None) -> DataFrame:
    """cache: a lasting table; the query by itself starts an empty one, so that its cost is that of
    counting every distinct text once."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), cache or scratch(spark, "token-cache"))


ORACLES = {}
QUERIES = {"op2_token_counts": op2_token_counts}
