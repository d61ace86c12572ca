"""Operator 10: language identification by compression.

Each language has a zstandard raw-content dictionary made of sample texts. A text is cut into
segments, each compressed with every dictionary; the language of the smallest sum wins. Texts of all
lengths go this one way. A decision whose margin over the second is narrow is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .toxicity import held_out

#: Bytes of a segment: short enough that the dictionary, not the segment's own start, predicts it.
SEGMENT = 2048
LEVEL = 6
#: A run that follows each segment. The encoder stores what it can't shorten, and a few words alone
#: would be stored, at one size for all languages; with the run a block always gets shorter, and so
#: its size shows every match with the dictionary.
RUN = b"\n" * 64
#: Share by which the second language must be larger for a decision to be accepted.
MARGIN = 0.002
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Sample:
    """Bounds of what a dictionary is made of: documents of a language, characters of each and the pieces they come in."""

    documents: int = 192
    characters: int = 512
    pieces: int = 4


@dataclass
class Model:
    languages: list[str]
    dictionaries: list[bytes]


def train(docs: DataFrame, sample: Sample = Sample(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_languages: int = 1000) -> Model:
    """Dictionaries of all languages that rows outside the held-out fold name, from a bounded sample.

    The sample of a language is its first rows with a letter in the order of a hash of the id; they
    are ranked within tasks before the shuffle. Of a long text it takes pieces spread from its start
    to its end; of rows that share an id and a language, one. Nulls in any column and texts without
    a letter aren't learned from; an empty table gives a model without languages. More than
    ``most_languages`` is an error, since the model is sent to every task.
    """
    text = F.col(text_col).cast("string")
    docs = docs.where(text.rlike(r"\p{L}"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("long")).alias("order"))
    rows = rows.where("lang is not null and id is not null").where(~held_out(F.col("id")))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order", "id"))).where(F.col("rank") <= sample.documents)
    chosen = ranked.select("id", "lang", "order").distinct().limit(most_languages * sample.documents + 1).toArrow()
    languages = sorted(set(chosen["lang"].to_pylist()))
    if len(languages) > most_languages or chosen.num_rows > most_languages * sample.documents:
        raise ValueError(f"more than {most_languages} languages")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), _spread(text, sample).alias("text"))
    found = texts.join(F.broadcast(spark.createDataFrame(chosen)), ["id", "lang"]).groupBy("order", "id", "lang").agg(F.max("text").alias("text"))
    found = found.orderBy("order", "id").toArrow()  # a row for each chosen one at most
    parts: dict[str, list[str]] = {x: [] for x in languages}
    for lang, text in zip(found["lang"].to_pylist(), found["text"].to_pylist()):
        parts[lang].append(text or "")
    return Model(languages, [words_only(" ".join(parts[x])) for x in languages])


def _spread(text: Column, sample: Sample) -> Column:
    """A text of up to ``sample.characters`` as it is, else its pieces at equal distances, joined by spaces."""
    piece = sample.characters // sample.pieces
    at = lambda i: F.floor((F.length(text) - piece) * i / max(sample.pieces - 1, 1)).cast("int") + 1
    pieces = F.concat_ws(" ", *(F.substring(text, at(i), F.lit(piece)) for i in range(sample.pieces)))
    return F.when(F.length(text) <= sample.characters, text).otherwise(pieces)


def words_only(text: str) -> bytes:
    """Lower case, every run of what isn't a letter turned into a space."""
    return b" " + _OTHER.sub(" ", text.lower()).strip().encode("utf-8", "replace") + b" "


def segments(raw: bytes) -> list[bytes]:
    """A whole text in segments of some SEGMENT bytes, cut at spaces where there are any."""
    out, at = [], 0
    while at < len(raw):
        end = at + SEGMENT
        if end < len(raw):
            space = raw.rfind(b" ", at + SEGMENT // 2, end)
            end = space + 1 if space > 0 else end
        out.append(raw[at:end])
        at = end
    return out


class Classifier:
    def __init__(self, model: Model):
        import zstandard as zstd

        self.languages = model.languages
        self.compressors = []
        for d in model.dictionaries:
            known = zstd.ZstdCompressionDict(d or b"\0" * 8, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            self.compressors.append(zstd.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> np.ndarray:
        cut = [x + RUN for x in segments(words_only(text))]
        return np.array([sum(len(c.compress(x)) for x in cut) for c in self.compressors], np.int64)

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin); a text that is null or has no letter is unknown with score and margin 0."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(text)
        best = int(sizes.argmin())
        if len(sizes) == 1:
            return self.languages[best], 1.0, 1.0
        others = np.delete(sizes, best)
        score = 1 / (1 + float(np.exp2(-np.minimum((others - sizes[best]) / 2.0, 1000)).sum()))
        return self.languages[best], score, float(others.min() / max(sizes[best], 1) - 1)


def identify(text: Column, model: Model) -> Column:
    """A struct of lang, score (0 to 1) and margin for a text column."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = Classifier(model)
        for texts in batches:
            found = [of(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64())], ["lang", "score", "margin"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "lang string, score double, margin double")(text.cast("string"))


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin and accepted for every row.

    A text that is null or has no letter, or any text where nothing was learned, is ``und`` and not
    accepted; on a tie the first language by name wins and, its margin being 0, is not accepted.
    An empty table gives no rows; further columns play no part.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), identify(F.col(text_col), model).alias("x"))
    accepted = (F.col("x.lang") != UNKNOWN) & (F.col("x.margin") >= margin)
    return rows.select("doc_id", "held_out", F.col("x.lang").alias("lang_pred"), F.col("x.score").alias("score"), F.col("x.margin").alias("margin"), accepted.alias("accepted"))


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """The rows of ``docs`` whose language is accepted, repeats each.

    Null and empty texts and those without a letter have no language and so go; an empty table gives
    no rows; columns of any name are kept as they are.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), identify(F.col(text_col), model).alias("x"))
    return rows.where((F.col("x.lang") != UNKNOWN) & (F.col("x.margin") >= margin)).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
