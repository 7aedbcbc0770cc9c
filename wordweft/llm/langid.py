"""Language identification by compression: the language whose dictionary packs a text smallest.

Each language gets a Zstandard raw-content dictionary of whole training texts. A text's words, all of them in order, are
packed in blocks, each with every dictionary, so that later parts of a long text can't lean on earlier ones instead of on
the dictionary; sizes are summed over the whole text. A narrow margin marks the row as rejected.

Defined cases: a null text or one without a letter is ``und`` with score 0; equal sizes go to the language with more
training rows, then to the first by name; a language whose training texts have no letter is no candidate, any other
has a dictionary; no training row gives ``und`` throughout; null and repeated ids are scored apart; texts may have any
length; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_of_id, prepare

BLOCK = 4096
DICTIONARY_BYTES = 64 << 10
#: Pieces of training texts gathered for each language, and their length; with DICTIONARY_BYTES the fit's bound.
SAMPLE_PIECES = 150
LONGEST = 8192
LEVEL = 9
#: Lower case; what is no letter in ASCII becomes a blank, bytes of other characters stay.
LETTERS = bytes(ord(chr(c).lower()) if chr(c).isalpha() and c < 128 else c if c >= 128 else 32 for c in range(256))


def letters(text: str) -> bytes:
    """The text's words without marks and digits."""
    return b" ".join(text.encode().translate(LETTERS).split())


def pieces(train: DataFrame) -> DataFrame:
    """lang and text: all training texts, cut every LONGEST characters, without pieces that have no letter."""
    cuts = f"transform(sequence(0, (length(text) - 1) div {LONGEST}), k -> substring(text, k * {LONGEST} + 1, {LONGEST}))"
    some = train.where("lang is not null and length(text) > 0").select("lang", F.explode(F.expr(cuts)).alias("text"))
    return some.where(F.col("text").rlike(r"[A-Za-z]|[^\x00-\x7F]"))


def fit(train: DataFrame) -> list[tuple[str, bytes]]:
    """(language, dictionary) by falling number of training rows, from columns text and lang.

    SAMPLE_PIECES distinct pieces of each language are gathered, or all if there are fewer: those with the least hashes.
    """
    usable = train.where("lang is not null and text is not null")
    totals = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    mark = F.xxhash64("text").alias("mark")
    cut = pieces(usable)
    scattered = Window.partitionBy("lang").orderBy(F.xxhash64("mark"), "mark")
    chosen = cut.select("lang", mark).distinct().withColumn("place", F.row_number().over(scattered)).where(F.col("place") <= SAMPLE_PIECES)
    # At most SAMPLE_PIECES rows a language.
    some = cut.select("lang", mark, "text").join(F.broadcast(chosen), ["lang", "mark"])
    rows = some.groupBy("lang", "mark").agg(F.first("text").alias("text"), F.first("place").alias("place")).collect()
    texts: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["place"])):
        texts.setdefault(r["lang"], []).append(letters(r["text"]))
    order = sorted(texts, key=lambda x: (-totals[x], x))
    # Zstandard takes eight bytes at least.
    return [(lang, b"\n".join(texts[lang])[-DICTIONARY_BYTES:].rjust(8, b"\n")) for lang in order]


def packers(dictionaries: list[tuple[str, bytes]]):
    """Function from bytes to the packed size for each dictionary."""
    import zstandard

    made = []
    for _, data in dictionaries:
        dictionary = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_dict_id=False))

    def sizes(data: bytes) -> list[int]:
        blocks = [data[k : k + BLOCK] for k in range(0, len(data), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in made]

    return sizes


def identify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], narrow: float = 0.01) -> DataFrame:
    """doc_id, lang_pred, score (share of the best under weights of 2 to the minus surplus bytes), rejected."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(dictionaries)

    def of(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import regex

        langs = [x for x, _ in shared.value]
        sizes, letter = packers(shared.value), regex.compile(r"\p{L}")
        for texts in columns:
            out = []
            for text in texts:
                if not langs or text is None or not letter.search(text):
                    out.append(("und", 0.0, True))
                    continue
                got = np.array(sizes(letters(text)), dtype=np.float64)
                best = int(got.argmin())
                surplus = np.delete(got, best) - got[best]
                close = bool(len(surplus)) and surplus.min() <= max(1.0, narrow * got[best])
                out.append((langs[best], float(1.0 / (1.0 + np.exp2(-surplus).sum())), close))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])

    guess = F.pandas_udf(of, "lang_pred string, score double, rejected boolean")
    return docs.select("doc_id", guess("text").alias("g")).select("doc_id", "g.*")


def held_out(doc_id: str = "doc_id"):
    return crc_of_id(doc_id) % 5 == 0
