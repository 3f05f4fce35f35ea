"""Token counts by overlap resynchronisation.

A boundary before one of space, \\t, \\n, \\r and after a letter, digit or ASCII mark is stable: no pre-token of a
byte-level tokenizer of this kind reaches over it, and what follows is tokenized as if the text began there (the
look-ahead of its pattern concerns white space only, and looks forward).

A text of more than `chunk` characters is encoded in overlapping chunks with offsets. Two neighbouring chunks are spliced
at the last stable boundary in their overlap at which both have a token boundary; where there is none, the overlap and
the chunk are widened, at most to the rest of the text. A text of one chunk is encoded as it is.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Encoding, Tokenizer

from waymark.llm.common import batched, like

STABLE = re.compile(r"(?<=[!-~\w])(?=[ \t\n\r])")


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def tokens_before(e: Encoding, at: int) -> int | None:
    """How many tokens of e end by character `at`, if a token begins there, else None."""
    token = e.char_to_token(at)
    return token if token is not None and e.token_to_chars(token)[0] == at and (not token or e.token_to_chars(token - 1)[1] <= at) else None


def count_huge(text: str, t: Tokenizer, chunk: int, overlap: int) -> int:
    """Tokens of text, encoded in chunks of `chunk` characters that overlap by `overlap`, more where they don't align."""
    encode = lambda i, j: t.encode(text[i:j], add_special_tokens=False)
    n, begin, total = len(text), 0, 0  # tokens before `begin` are counted, and begin is stable
    size, lap = chunk, overlap
    while n - begin > size:
        end = begin + size
        own = encode(begin, end)
        starts = [m.start() for m in STABLE.finditer(text, max(begin + 1, end - lap), end)]
        splice = None
        if len(starts) > 1:
            # the next chunk begins at the first stable place of the overlap; what follows the last common boundary of
            # both may have been cut by the end of this chunk
            first = starts[0]
            other = encode(first, end)
            for s in reversed(starts[1:]):
                before = tokens_before(own, s - begin)
                if before is not None and tokens_before(other, s - first) is not None:
                    splice = s
                    break
        if splice is None:
            size, lap = size * 2, lap * 2
            continue
        total += before
        begin, size, lap = splice, chunk, overlap
    return total + len(t.encode_batch_fast([text[begin:n]], add_special_tokens=False)[0])


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 1024, chunk: int = 4096, overlap: int = 64) -> DataFrame:
    """One row per row of df: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Counts are those of the tokenizers library for the file at `path` on the whole text, without special tokens added,
    truncation or padding. Null texts count as empty: 0 and 0. Repeated rows and null ids are answered row by row;
    other columns are ignored; an empty table gives an empty table. No shuffle. Memory: a batch of texts and the tokens of
    a chunk (of a text without any stable boundary, such as one long word: the tokens of that text).
    """
    batched(df.sparkSession)
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    schema = T.StructType([like(df, id_col), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(0).to_pylist()]
            short = [k for k, x in enumerate(texts) if len(x) <= chunk]
            counts = [count_huge(x, t, chunk, overlap) if len(x) > chunk else 0 for x in texts]
            for i in range(0, len(short), 64):
                some = short[i : i + 64]
                for k, e in zip(some, t.encode_batch_fast([texts[k] for k in some], add_special_tokens=False), strict=True):
                    counts[k] = len(e)
            sizes = [len(x.encode("utf-8", "surrogatepass")) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return df.select(F.col(text_col).alias("_text"), F.col(id_col)).mapInArrow(run, schema)
