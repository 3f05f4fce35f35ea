"""Language identification by compression.

Every language has a raw-content zstandard dictionary made of its training texts. A text belongs to the language whose
dictionary encodes it in the fewest bytes. Texts are lower-cased and encoded in blocks, each from the dictionary alone,
so that a long text doesn't come to teach the encoder its own language. Every block, whatever its length and its text's,
follows the last words of the dictionary: a short one alone would be stored as it is, in as many bytes for every language.
A text's size is the sum of its blocks' sizes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import batched, like

UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageModel:
    """dictionaries: per language the training text. min_margin: share of the runner-up's bytes by which the best
    language must win, else the text is rejected."""

    dictionaries: dict[str, bytes]
    block: int = 4096
    lead: int = 256
    min_margin: float = 0.001

    def encoders(self) -> tuple[list[str], list[zstandard.ZstdCompressor]]:
        names, made = sorted(self.dictionaries), []
        form = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY, min_match=4, search_log=4, hash_log=16, chain_log=16, window_log=17, write_content_size=False, write_checksum=False, write_dict_id=False)
        for name in names:
            d = zstandard.ZstdCompressionDict(self.dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=form)
            made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=form))
        return names, made


def classify(text: str | None, names: list[str], encoders: list[zstandard.ZstdCompressor], model: LanguageModel) -> tuple[str, float, float]:
    """(language, score, margin). Null, empty and letterless texts: und, 0, 0."""
    if not text or not any(map(str.isalpha, text)) or not names:
        return UNDETERMINED, 0.0, 0.0
    raw = text.lower().encode("utf-8", "surrogatepass")
    blocks = [raw[i : i + model.block] for i in range(0, len(raw), model.block)]
    sizes = [sum(len(e.compress(lead + b)) for b in blocks) for e, lead in ((e, model.dictionaries[n][-model.lead :]) for n, e in zip(names, encoders, strict=True))]
    order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
    best = sizes[order[0]]
    score = 1 / sum(math.exp(-min(700.0, (s - best) / 4)) for s in sizes)
    margin = 1.0 if len(order) == 1 else (sizes[order[1]] - best) / sizes[order[1]]
    return names[order[0]], score, margin


def fit_languages(training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 64, dictionary_bytes: int = 49_152, model_bytes: int = 256 << 20, **options) -> LanguageModel:
    """A model from a bounded sample: about docs_per_language texts per language (those with the smallest hash of id and
    text), of each a passage from anywhere in the text, joined to a dictionary of at most dictionary_bytes. Rows without a
    text or language are passed over; repeated rows count as one. Every language is learned; where the dictionaries of all would
    be more than model_bytes, so that a worker couldn't hold them, it is an error and none is left out. An empty training
    table gives a model without languages, which answers `und`. What is collected is bounded by model_bytes, for a row's
    hash decides whether it is in the sample and a hash comes once."""
    most = max(1, model_bytes // dictionary_bytes)
    text = F.col(text_col)
    rows = training.where(F.col(lang_col).isNotNull() & text.isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string"), text).alias("h"), text.alias("text"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).limit(most + 1)
    counts = {r["lang"]: r["n"] for r in counts.collect()}
    if len(counts) > most:
        raise ValueError(f"more than {most} languages: their dictionaries would take over {model_bytes} bytes; raise model_bytes or lower dictionary_bytes")
    if not counts:
        return LanguageModel({}, **options)
    # rows under a threshold of the hash that leaves about twice the wanted number: no sort of a language's rows
    limit = F.lit(None).cast("long")
    for lang, n in sorted(counts.items()):
        share = min(1.0, 2 * docs_per_language / n + 16 / n)
        limit = F.when(F.col("lang") == lang, F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64)))).otherwise(limit)
    chars = 4 * max(1, dictionary_bytes // docs_per_language)
    begin = F.pmod(F.hash("h"), F.greatest(F.lit(1), F.char_length("text") - chars + 1)) + 1
    sample = rows.where(F.col("h") <= limit).select("lang", "h", F.lower(F.substring(F.col("text"), begin, F.lit(chars))).alias("text")).groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    dictionaries = {}
    for lang in counts:
        texts = [r["text"] for r in sorted((r for r in sample if r["lang"] == lang), key=lambda r: (r["h"], r["text"]))[:docs_per_language]]
        each = max(1, dictionary_bytes // max(1, len(texts)))
        spare = sum(max(0, each - len(t.encode("utf-8", "surrogatepass"))) for t in texts)
        raw = b""
        for t in texts:
            b = t.encode("utf-8", "surrogatepass")
            take = min(len(b), each + spare) if len(b) > each else len(b)
            spare -= max(0, take - each)
            raw += b[:take] + b"\n"
        dictionaries[lang] = raw[:dictionary_bytes].ljust(8, b"\n")
    return LanguageModel(dictionaries, **options)


def identify_languages(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of df: id, the columns of `keep`, lang_pred, score (0 to 1), margin, rejected.

    The whole text is encoded. Null, empty and letterless texts give und with score 0 and are rejected; so are texts
    whose margin is below the model's. Of equal sizes the first language in code point order wins. Repeated rows and
    null ids are answered row by row; other columns are ignored; an empty table gives an empty table. No shuffle.
    """
    batched(df.sparkSession)
    told = df.sparkSession.sparkContext.broadcast(model)
    names = [id_col, *keep, "lang_pred", "score", "margin", "rejected"]
    schema = T.StructType([like(df, id_col), *(like(df, c) for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = told.value
        langs, encoders = m.encoders()
        for batch in batches:
            found = [classify(t, langs, encoders, m) for t in batch.column(0).to_pylist()]
            rejected = [lang == UNDETERMINED or margin < m.min_margin for lang, _, margin in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.float64()), pa.array(rejected, pa.bool_())], names)

    return df.select(F.col(text_col).alias("_text"), F.col(id_col), *(F.col(c) for c in keep)).mapInArrow(run, schema)
