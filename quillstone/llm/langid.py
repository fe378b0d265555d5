"""Language identification by compression.

Text is lower-cased and runs of other characters than letters become one space. Each language has a zstandard raw-content
dictionary made of pieces of its training texts. A text is cut into chunks (one of a few bytes is repeated, since
zstandard stores what it cannot shorten); each chunk is compressed alone once per language and the language with the
fewest bytes in all wins. A text whose two best totals are close is rejected.

Training text is a bounded sample, spread by a hash of the id over `SLOTS` slots per language, one piece of `PIECE`
characters each; so a dictionary has at most SLOTS * PIECE characters, whatever the size of the corpus. All labelled
languages are learned; where they are so many that all pieces would be over `PIECES`, each has as many fewer (`LEAST` at
least).

Defined results: a null text, or one without a letter, is `und` with score 0 and rejected; with no training rows at all
every text is `und`; rows without a language are not learned from; ties go to the language with most training rows, then
to the one that sorts first; repeated rows are judged one by one; other columns are ignored. `accepted` keeps all columns
and rows of texts whose language is told, and drops null, empty and letterless texts.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

SLOTS, PIECE, PIECES, LEAST = 64, 512, 1 << 15, 8
#: Bytes compressed at a time; shorter texts than REPEAT bytes are repeated up to it.
CHUNK, REPEAT = 32768, 160
#: A text is rejected if the second best total is less than this share above the best.
MARGIN = 0.005
UNKNOWN = "und"

_OTHER = re.compile(r"[\W\d_]+")

RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Language to dictionary. The result has a fixed bound, so it may be collected and broadcast."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).alias("lang"),
        F.xxhash64(F.col(id_col).cast("string")).alias("h"),
        F.col(text_col).alias("text"),
    )
    start = F.greatest(F.lit(1), F.pmod(F.shiftright("h", 9), F.greatest(F.lit(1), F.length("text") - PIECE)).cast("int"))
    pieces = rows.select("lang", "h", F.pmod("h", F.lit(SLOTS)).alias("slot"), F.substring(F.col("text"), start, F.lit(PIECE)).alias("piece"))
    slots = C.persisted(pieces.groupBy("lang", "slot").agg(F.min(F.struct("h", "piece")).alias("x"), F.count("*").alias("n")), "language-pieces")
    each = max(LEAST, min(SLOTS, PIECES // max(1, slots.select("lang").distinct().count())))
    kept = slots.groupBy("lang").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.collect_list("x")), 1, each).alias("x")).orderBy(F.desc("n"), "lang")
    return {r.lang: normal(" ".join(x.piece for x in r.x)).encode() for r in kept.select("lang", "x").collect()}


def normal(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


class Judge:
    """dictionaries: the language with most training text first; ties go to it."""

    def __init__(self, dictionaries: dict[str, bytes]):
        how = zstandard.ZstdCompressionParameters(window_log=17, hash_log=14, chain_log=14, search_log=2, min_match=4, target_length=16, strategy=zstandard.STRATEGY_GREEDY)
        self.langs, self.compressors = list(dictionaries), []
        for content in dictionaries.values():
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=how)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=known, compression_params=how))

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.langs or not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0, False
        raw = normal(text).encode() or text.encode()
        if len(raw) < REPEAT:
            raw = (raw + b" ") * -(-REPEAT // (len(raw) + 1))
        chunks = [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)]
        totals = [sum(len(c.compress(x)) for x in chunks) for c in self.compressors]
        best, *rest = sorted(totals)
        gap = (rest[0] - best) / best if rest else 1.0
        # Bytes saved are a log-likelihood ratio; one byte saved counts as a factor e^0.5.
        score = 1 / sum(math.exp(-min(700.0, (x - best) / 2)) for x in totals)
        return self.langs[totals.index(best)], score, gap >= MARGIN


def identify(documents: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, lang_pred, score (0 to 1), accepted."""
    shared = documents.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches):
        judge = Judge(shared.value)
        for batch in batches:
            found = [judge(t.as_py()) for t in C.column(batch, "text")]
            a, b, c = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([C.column(batch, "doc_id"), pa.array(a, pa.string()), pa.array(b, pa.float64()), pa.array(c, pa.bool_())], names=RESULT.names)

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, RESULT)


def accepted(documents: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """The documents, all columns, whose language is told with a sufficient margin."""
    shared = documents.sparkSession.sparkContext.broadcast(dictionaries)
    position = documents.columns.index(text_col)

    def run(batches):
        judge = Judge(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([judge(t.as_py())[2] for t in batch.column(position)], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def held_out(col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(5)) == 0


def op2_language(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents")
    # A null id has no remainder: such a row is neither learned from nor held out.
    known = fit(docs.filter(~held_out()))
    return identify(docs, known).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
